"""Round trips through files, and streams over the table of events. What they write goes to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_dir
from ..operators.disclosures import CODES, disclosure_events, headers
from ..sources.archives import field, list_archives, write_archives, zipped_rows
from ..sources.readers import read_delimited, read_xml, resolve_columns
from ..sources.sinks import export_json, refresh, replace_archives, stamped, write_shards
from ..streaming.ingest import first_filings, incremental_load, load_archives, loaded, windowed_counts
from .fixtures import Tables, query


def work_dir(spark: SparkSession) -> str:
    return shared_dir(spark, "plans")


@query("s01_csv_headers", "select c_custkey as crd, c_name as name, c_acctbal as aum, null::varchar as phone from customer")
def s01(t: Tables) -> DataFrame:
    """A delimited file, read as text, its headers resolved."""
    path = work_dir(t.spark)
    t.raw("customer").select(F.col("c_custkey").alias("Organization CRD #"), F.col("c_name").alias("Primary  Name"), F.col("c_acctbal").alias("5F")).write.option("header", True).csv(path)
    df = resolve_columns(read_delimited(t.spark, path), {"crd": ["CRD", "organization crd#"], "name": ["primary name"], "aum": ["5F(2)(c)", "5f"], "phone": ["phone"]}, ["crd"])
    return df.select(F.col("crd").cast("long").alias("crd"), "name", F.col("aum").cast("double").alias("aum"), "phone")


@query("s07_tsv_nulls", "select s_suppkey, nullif(s_name, 'Supplier#000000007') as name, 'NA' as code from supplier")
def s07(t: Tables) -> DataFrame:
    """None is null, NA is data, quotes are plain characters."""
    path = work_dir(t.spark)
    rows = t.raw("supplier").select("s_suppkey", F.when(F.col("s_name") == "Supplier#000000007", "None").otherwise(F.col("s_name")).alias("name"), F.lit("NA").alias("code"))
    rows.write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return read_delimited(t.spark, path, "\t", "", "None").withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("s03_xml_feed", "select c_custkey as crd, c_name as name, n_name as state from customer join nation on n_nationkey = c_nationkey where c_custkey % 3 <> 0")
def s03(t: Tables) -> DataFrame:
    """An element for each firm, attributes nested; those not registered are left out."""
    path = work_dir(t.spark)
    f = t.raw("customer").join(t.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    kind = F.when(F.col("c_custkey") % 3 == 0, "Exempt").otherwise("Registered")
    info = F.struct(F.col("c_custkey").alias("_crd"), F.col("c_name").alias("_name"))
    f.select(info.alias("Info"), F.struct(F.col("n_name").alias("_state")).alias("MainAddr"), F.struct(kind.alias("_type")).alias("Rgstn")).write.format("xml").option("rootTag", "Firms").option("rowTag", "Firm").save(path)
    schema = "Info struct<_crd:bigint,_name:string>, MainAddr struct<_state:string>, Rgstn struct<_type:string>"
    return read_xml(t.spark, path, "Firm", schema).where("Rgstn._type = 'Registered'").select(F.col("Info._crd").alias("crd"), F.col("Info._name").alias("name"), F.col("MainAddr._state").alias("state"))


def _zipped(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """The list of archives made of lines of files, as _csv() makes them, written once to the shared folder."""
    spark = lines.sparkSession
    folder = work_dir(spark)
    write_archives(lines, folder, ["line", "text"], tasks=tasks).write.format("noop").mode("overwrite").save()
    return list_archives(spark, f"{folder}/*.zip")


def _csv(rows: DataFrame, *cols: str) -> DataFrame:
    """The lines (path, member, line, text) of delimited files of rows (path, member and the columns), each file a header and its rows in order of their text."""
    text = F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"')) for c in cols])
    head = rows.select("path", "member").distinct().select("path", "member", F.lit(0).alias("line"), F.lit(",".join(f'"{c}"' for c in cols) + "\n").alias("text"))
    return head.unionByName(rows.select("path", "member", F.lit(1).alias("line"), F.concat(text, F.lit("\n")).alias("text")))


@query("s04_archive_members", "select strftime(filed, '%Y') || '.zip' as source_archive, 'filings_' || strftime(filed, '%m') || '.csv' as member, count(*) as n, round(sum(aum), 2) as aum, count(*) filter (status = 'P') as pending from filings where month(filed) <> 2 group by 1, 2")
def s04(t: Tables) -> DataFrame:
    """An archive for each year with a file for each month; those that fit the pattern are read, the others aren't."""
    f = t.filings().select(F.concat(F.date_format("filed", "yyyy"), F.lit(".zip")).alias("path"), F.concat(F.when(F.month("filed") == 2, "other_").otherwise("filings_"), F.date_format("filed", "MM"), F.lit(".csv")).alias("member"), F.col("filing_id").alias("Filing ID"), F.col("aum").alias("AUM"), F.col("status").alias("5B"))
    rows = zipped_rows(_zipped(_csv(f, "Filing ID", "AUM", "5B")), r"filings_\d\d\.csv").select(F.regexp_extract("source_archive", "([^/]+)$", 1).alias("source_archive"), "member", field("aum").cast("double").alias("aum"), field("5B(1)", "5b").alias("status"))
    return rows.groupBy("source_archive", "member").agg(F.count("*").alias("n"), F.round(F.sum("aum"), 2).alias("aum"), F.count_if(F.col("status") == "P").alias("pending"))


#: Events that an archive of them holds about.
DRP_ROWS = 200_000
DRP = """with e as (select event_id, 1000 + event_id % 700 as filing, event_id // 3 as ref, event_id % 3 as kind, ts, value, event_type, user_id from events)"""


@query("m04_disclosure_events", DRP + """ select (filing % 97)::varchar as crd, filing::bigint as filing_id, case kind when 0 then 'R' when 1 then 'C' else 'J' end || ref as ref, case kind when 0 then 'R' when 1 then 'C' else 'J' end as kind,
    case event_id % 4 when 0 then 'A' when 1 then 'B' else 'F' end as against, case when event_id % 5 = 0 then strftime(ts, '%Y') else strftime(ts, '%Y-%m-%d') end as date, case when event_id % 7 <> 0 then event_type end as what,
    case when floor(round(value, 2)) > 0 or round(value, 2) > 0 then floor(round(value, 2))::bigint end as amount, event_id % 11 = 0 as removed, case when event_id % 6 = 0 then 'A' || user_id else '' end as affiliates from e where filing % 97 > 3""")
def m04(t: Tables) -> DataFrame:
    """Three kinds of reports, each with headers of its own, in one archive with the filings and affiliates that belong to them."""
    e = t.raw("events").withColumns({"FilingID": 1000 + F.col("event_id") % 700, "ReferenceID": F.floor(F.col("event_id") / 3), "_kind": F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 3 + 1).cast("int"))})
    date = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy")).otherwise(F.date_format("ts", "M/d/yyyy"))
    said = F.when(F.col("event_id") % 7 != 0, F.col("event_type")).otherwise(F.lit(" n/a "))
    e = e.withColumns({"_date": date, "_what": said, "Filed Against": F.element_at(F.array(*map(F.lit, ("Affiliates", "Firm and Affiliates", "Advisory Firm", ""))), (F.col("event_id") % 4 + 1).cast("int")), "Monetary Amount": F.concat(F.lit("$"), F.round("value", 2)), "Remove-Expired": F.when(F.col("event_id") % 11 == 0, "y").otherwise(""), "Affiliate Name": F.concat(F.lit("A"), "user_id")})
    # each archive holds the filings of one remainder, so a few archives are read by a few tasks, and many rows go into more archives
    path = F.concat(F.lit("drp"), (F.col("FilingID") % max(8, t.parts("events", DRP_ROWS))).cast("string"), F.lit(".zip"))
    file = lambda rows, member, *cols: _csv(rows.withColumns({"path": path, "member": F.lit(member)}), *cols)
    dates, whats = headers()["date"], headers()["what"]
    parts = [file(e.where(F.col("_kind") == k).withColumns({dates[k][0]: F.col("_date"), whats[k][-1]: F.col("_what")}), f"IA_DRP_{k}_1.csv", "FilingID", "ReferenceID", dates[k][0], whats[k][-1], "Filed Against", "Monetary Amount", "Remove-Expired") for k in CODES]
    parts.append(file(e.where("event_id % 6 = 0"), "IA_DRP_Advisory_Affiliates_1.csv", "FilingID", "ReferenceID", "Affiliate Name"))
    parts.append(file(e.select("FilingID").distinct().withColumn("1E1", F.when(F.col("FilingID") % 97 > 3, F.col("FilingID") % 97)), "IA_ADV_Base_A_1.csv", "FilingID", "1E1"))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    out = disclosure_events(zipped_rows(_zipped(lines, t.tasks("events", DRP_ROWS)), r"IA_.*\.csv", encoding="latin-1"), t.tasks("events", DRP_ROWS))
    return out.select("crd", "filing_id", "ref", "kind", "against", "date", "what", "amount", "removed", F.array_join("affiliates", ",").alias("affiliates"))


@query("k02_replace_archives", "select strftime(filed, '%Y') as source_archive, count(*) as n, sum((status = 'P')::int)::bigint as pending from filings group by 1")
def k02(t: Tables) -> DataFrame:
    """An archive loaded twice is there once."""
    path = work_dir(t.spark)
    f = t.filings().withColumn("source_archive", F.date_format("filed", "yyyy"))
    replace_archives(f, path)
    replace_archives(f.where("source_archive = '1999'"), path)
    out = t.spark.read.parquet(path)
    return out.groupBy(F.col("source_archive").cast("string").alias("source_archive")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "P").alias("pending"))


@query("k03_rebuilt_stamped", "select crd, name, case when aum > 5000 then 'done' else 'open' end as progress from firms where aum is not null")
def k03(t: Tables) -> DataFrame:
    """A table replaced as a whole, twice, the second time with progress stamps on some rows."""
    path = work_dir(t.spark)
    f = t.firms().select("crd", "name", "aum", F.lit("open").alias("progress"))
    refresh(f.limit(5), path)
    refresh(stamped(f.where("aum is not null"), F.col("aum") > 5000, "progress", F.lit("done")), path)
    return t.spark.read.parquet(path).select("crd", "name", "progress")


@query("k06_json_guard", "select crd, name, aum from firms where aum > 9000")
def k06(t: Tables) -> DataFrame:
    """An export that an empty input leaves as it was."""
    path = work_dir(t.spark)
    f = t.firms().select("crd", "name", "aum")
    export_json(f.where("aum > 9000"), path)
    export_json(f.where("aum > 1e12"), path)
    return t.spark.read.schema(f.schema).json(path)


@query("k07_written_shards", "select crd, name from firms where crd % 32 = 5")
def k07(t: Tables) -> DataFrame:
    """One shard read alone, the others pruned."""
    path = work_dir(t.spark)
    write_shards(t.firms().select("crd", "name"), path, "crd")
    return t.spark.read.parquet(path).where("shard = 5").select("crd", "name")


def _events(t: Tables) -> str:
    """A folder with the events: a stream's source has to be one."""
    path = work_dir(t.spark)
    t.raw("events").write.parquet(path)
    return path


def _run(stream: DataFrame, sink: str, mode: str = "append") -> None:
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{sink}-checkpoint").trigger(availableNow=True).start(sink)
    q.awaitTermination()


@query("s06_incremental_stream", "select event_type, count(*) as n from events group by 1")
def s06(t: Tables) -> DataFrame:
    """Files loaded by a stream that stops when it has caught up; a second run finds nothing new."""
    sink, source = work_dir(t.spark), _events(t)
    for _ in range(2):
        incremental_load(t.spark, source, t.raw("events").schema, sink, f"{sink}-checkpoint").awaitTermination()
    return t.spark.read.parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s06_archive_ledger", "select strftime(filed, '%Y') || '.zip' as source_archive, count(*) as n, round(sum(aum), 2) as aum from filings group by 1")
def s06_ledger(t: Tables) -> DataFrame:
    """Archives loaded by a stream with a ledger. Some are there first, all later; a third run, which has forgotten what it read, finds them in the ledger."""
    source, sink = work_dir(t.spark), work_dir(t.spark)
    f = t.filings().select(F.concat(F.date_format("filed", "yyyy"), F.lit(".zip")).alias("path"), F.concat(F.lit("filings_"), F.date_format("filed", "MM"), F.lit(".csv")).alias("member"), F.col("filing_id").alias("Filing ID"), F.col("aum").alias("AUM"))
    lines = _csv(f, "Filing ID", "AUM")
    for some, checkpoint in (("path < '1998'", "first"), ("path >= '1998'", "first"), ("false", "second")):
        write_archives(lines.where(some), source, ["line", "text"]).write.format("noop").mode("overwrite").save()
        load_archives(t.spark, source, sink, f"{sink}-ledger", f"{sink}-{checkpoint}", r"filings_\d\d\.csv").awaitTermination()
    rows = loaded(t.spark, sink, f"{sink}-ledger")
    return rows.groupBy(F.regexp_extract("source_archive", "([^/]+)$", 1).alias("source_archive")).agg(F.count("*").alias("n"), F.round(F.sum(field("aum").cast("double")), 2).alias("aum"))


@query("stream_windows", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by 1, 2")
def windows(t: Tables) -> DataFrame:
    """Daily counts by event time; a window is given out once the watermark, an hour behind, has passed it."""
    sink = work_dir(t.spark)
    e = t.spark.readStream.schema(t.raw("events").schema).parquet(_events(t)).withColumn("ts", F.col("ts").cast("timestamp"))
    _run(windowed_counts(e, "ts", ["event_type"], "1 day", "1 hour", "value"), sink)
    return t.spark.read.parquet(sink).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_dedup", "select count(distinct user_id) as users from events")
def dedup(t: Tables) -> DataFrame:
    """One row for each user within the horizon, which here spans all events."""
    sink = work_dir(t.spark)
    e = t.spark.readStream.schema(t.raw("events").schema).parquet(_events(t)).withColumn("ts", F.col("ts").cast("timestamp"))
    _run(first_filings(e, "ts", ["user_id"], "450 days").select("user_id"), sink)
    return t.spark.read.parquet(sink).agg(F.count("*").alias("users"))
