"""The domain's tables made of the test tables, for Spark and as SQL with the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Schemas of tables by path: read from a file's footer once in a process.
SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


class Tables:
    """The domain's tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def parts(self, name: str, rows: int = 500_000) -> int:
        """Into how many parts the rows of a table go, so that a task's sorts take the same memory however large the table is; as many as there are cores at least."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw(name).count() // rows))

    def tasks(self, name: str, *rows: int) -> int | None:
        """parts() of a table where these are more than the session shuffles with; else none, since Spark then sees to it."""
        n = self.parts(name, *rows)
        return n if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else None

    def dealt(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """Rows as many as a table's, dealt by keys into parts() where these are more than the session shuffles with; else as they are, since small tables are joined without a shuffle."""
        n = self.tasks(name)
        return df.repartition(n, *keys) if n else df

    def firms(self) -> DataFrame:
        """Firms; the state is null for one nation, so that null keys are met."""
        c, n, r = self.raw("customer"), self.raw("nation"), self.raw("region")
        out = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        state = F.nullif("n_name", F.lit("CHINA"))
        return out.select(F.col("c_custkey").alias("crd"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("aum"), state.alias("state"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("mix"))

    def filings(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("crd"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_totalprice").alias("aum"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))

    def withdrawals(self) -> DataFrame:
        return self.filings().where("filing_id % 50 = 0").select("filing_id", "crd", F.col("filed").alias("gone"))

    def funds(self) -> DataFrame:
        """Rows of fund schedules; the feeder flag is null where the tax is 0."""
        li, o, p = self.raw("lineitem"), self.raw("orders"), self.raw("part")
        li = self.dealt(li, "lineitem", "l_orderkey")
        out = self.dealt(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "lineitem", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
        feeder = F.when(F.col("l_tax") > 0, F.col("l_returnflag") == "R")
        return out.select(
            F.col("l_partkey").alias("fund_id"), F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("crd"), F.col("o_orderdate").cast("date").alias("filed"),
            F.col("p_type").alias("type"), F.col("l_extendedprice").alias("gav"), feeder.alias("feeder"), F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("provider"), F.col("l_quantity").alias("qty"),
        )

    def holdings(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(F.col("l_orderkey").alias("filing_id"), F.col("l_partkey").alias("cusip"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("shares"), F.nullif("l_linestatus", F.lit("O")).alias("option"))

    def offerings(self) -> DataFrame:
        """Offerings; amendments by status, null for one priority; nothing sold where the key is divisible by 4."""
        o = self.raw("orders")
        amendment = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") == "P")
        return o.select(
            F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("crd"), F.col("o_orderdate").cast("date").alias("filed"), amendment.alias("amendment"), F.col("o_orderpriority").alias("industry"),
            F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("sold"), (F.col("o_orderkey") % 3 == 0).alias("pooled"),
        )

    def owners(self) -> DataFrame:
        """Owner rows: identity is the supplier, the stake code the return flag."""
        li, o = self.dealt(self.raw("lineitem"), "lineitem", "l_orderkey"), self.raw("orders")
        out = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return out.select(F.col("l_orderkey").alias("filing_id"), F.col("o_custkey").alias("crd"), F.col("o_orderdate").cast("date").alias("filed"), F.col("l_suppkey").alias("owner"), F.col("l_returnflag").alias("stake"), F.col("l_linestatus").alias("title"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part"))

    def annual(self) -> DataFrame:
        """Yearly value of each firm."""
        return self.filings().groupBy("crd", F.year("filed").alias("year")).agg(F.round(F.sum("aum"), 2).alias("aum"), F.count("*").alias("staff"))


# The same tables in DuckDB's SQL.
WITH = """with firms as (select c_custkey as crd, c_name as name, c_acctbal as aum, nullif(n_name, 'CHINA') as state, r_name as region, c_mktsegment as mix
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
filings as (select o_orderkey as filing_id, o_custkey as crd, o_orderdate::date as filed, o_totalprice as aum, o_orderpriority as kind, o_orderstatus as status from orders),
withdrawals as (select filing_id, crd, filed as gone from filings where filing_id % 50 = 0),
funds as (select l_partkey as fund_id, l_orderkey as filing_id, l_linenumber as line, o_custkey as crd, o_orderdate::date as filed, p_type as type, l_extendedprice as gav,
    case when l_tax > 0 then l_returnflag = 'R' end as feeder, l_returnflag as role, l_suppkey as provider, l_quantity as qty
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
holdings as (select l_orderkey as filing_id, l_partkey as cusip, l_extendedprice as value, l_quantity as shares, nullif(l_linestatus, 'O') as option from lineitem),
offerings as (select o_orderkey as accession, o_custkey as crd, o_orderdate::date as filed, case when o_orderpriority <> '5-LOW' then o_orderstatus = 'P' end as amendment,
    o_orderpriority as industry, case when o_orderkey % 4 = 0 then 0.0 else o_totalprice end as sold, o_orderkey % 3 = 0 as pooled from orders),
owners as (select l_orderkey as filing_id, o_custkey as crd, o_orderdate::date as filed, l_suppkey as owner, l_returnflag as stake, l_linestatus as title, l_linenumber as line, l_quantity as qty, l_partkey as part
    from lineitem join orders on l_orderkey = o_orderkey),
annual as (select crd, year(filed)::int as year, round(sum(aum), 2) as aum, count(*) as staff from filings group by 1, 2),
quarters as (select (date_trunc('quarter', d) + interval 3 months - interval 1 day)::date as quarter from (select unnest(generate_series(date_trunc('quarter', (select min(filed) from filings)), (select max(filed) from filings)::timestamp, interval 3 months)) as d)
    where (date_trunc('quarter', d) + interval 3 months - interval 1 day)::date <= (select max(filed) from filings)),
served as (select q.quarter, f.* from quarters q join filings f on f.filed <= q.quarter and f.filed >= (q.quarter - interval 15 months)::date),
snapshots as (select * from served s where not exists (select 1 from withdrawals w where w.crd = s.crd and w.gone <= s.quarter) qualify row_number() over (partition by crd, quarter order by filed desc, filing_id desc) = 1)
"""

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, plain: bool = False):
    """Registers a function of Tables under a name, with the same in SQL (which may use the tables of WITH)."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql if plain else WITH + (", " + sql.strip()[5:] if sql.strip().startswith("with ") else sql)
        return f

    return add
