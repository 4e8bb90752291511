"""Reports and feeds, written as they are filed and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import shared_dir
from ..functions.settings import link_columns
from ..operators.reports import OFFERINGS, annual_reports, icon_sources, newest, roster, segment_share, typed, website_note
from ..sources.archives import list_archives, write_archives, zipped_rows
from ..sources.readers import read_delimited
from .fixtures import Tables, query


#: Filings of the firms that share a part of the annual reports, about.
FILED_ROWS = 500_000
SHEET = "xl/worksheets/sheet1.xml"


def _cells(*cols):
    """A row of a workbook's sheet, texts inline."""
    return F.concat(F.lit("<row>"), *[F.concat(F.lit('<c t="inlineStr"><is><t>'), c, F.lit("</t></is></c>")) for c in cols], F.lit("</row>"))


@query("m01_annual_reports", """select 'ia0630' || lpad((year % 100)::varchar, 2, '0') || case when year % 2 = 1 then '.xlsx' else '.zip' end as source, crd, round(aum, 2) as aum, staff::double as staff, (staff - 1)::double as advisory from annual where crd % 50 <> 49""")
def m01(t: Tables) -> DataFrame:
    """Yearly reports, of even years zipped delimited files with the old headers, of odd years workbooks with the new ones; numbers as filed, a firm's last row counts, rows without its number don't."""
    # a year's report comes in parts by firm, each a file of its own, so no file grows with the table
    parts = max(1, -(-t.raw("orders").count() // FILED_ROWS))
    year, part = F.lpad((F.col("year") % 100).cast("string"), 2, "0"), F.pmod(F.xxhash64("crd"), F.lit(parts)).cast("string")
    path = F.concat(part, F.lit("-ia0630"), year, F.when(F.col("odd"), ".xlsx").otherwise(".zip"))
    member = F.when(F.col("odd"), SHEET).otherwise("report.csv")
    odd = F.col("year") % 2 == 1
    # what stands around the rows, a line of a file before or after all others
    around = t.filings().select("crd", F.year("filed").alias("year")).withColumn("odd", odd).select(path.alias("path"), "odd").distinct()
    some = lambda name, line, text: F.struct(F.lit(name).alias("member"), F.lit(line).alias("line"), text.alias("text"))
    sheet = [some("[Content_Types].xml", 0, F.lit("<Types/>")), some(SHEET, 0, F.concat(F.lit("<worksheet><sheetData>"), _cells(*map(F.lit, ("Organization CRD#", "5F(2)(c)", "5A", "5B(1)"))))), some(SHEET, 3, F.lit("</sheetData></worksheet>"))]
    around = around.select("path", "odd", F.explode(F.when(F.col("odd"), F.array(*sheet)).otherwise(F.array(some("report.csv", 0, F.lit("ORGANIZATION CRD,5F2C,5A,5B1\n"))))).alias("x")).select("path", "odd", "x.*")
    # each firm stands there twice, first with other figures
    body = t.annual().withColumn("odd", odd).select(path.alias("path"), "odd", member.alias("member"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), F.col("crd").alias("k"), "aum", "staff")
    files = body.unionByName(around, allowMissingColumns=True)
    money = F.when(F.col("line") == 1, "1").otherwise(F.coalesce(F.concat(F.lit("$"), F.format_number("aum", 2)), F.lit("")))
    crd, staff, advisory = F.when(F.col("k") % 50 != 49, F.col("k").cast("string")).otherwise(""), F.col("staff").cast("string"), (F.col("staff") - 1).cast("string")
    row = F.when(F.col("odd"), _cells(crd, money, staff, advisory)).otherwise(F.concat(crd, F.lit(',"'), money, F.lit('",'), staff, F.lit(","), advisory))
    folder = shared_dir(t.spark, "reports")
    write_archives(files, folder, ["line", "k"], F.coalesce("text", F.concat(row, F.lit("\n"))), t.tasks("orders")).write.format("noop").mode("overwrite").save()
    out = annual_reports(zipped_rows(list_archives(t.spark, folder), r".*\.csv", encoding="latin-1"), t.tasks("orders"))
    return out.select(F.regexp_extract("source_archive", "([^/-]+)$", 1).alias("source"), "crd", F.round("aum_total", 2).alias("aum"), F.col("employees_total").alias("staff"), F.col("employees_advisory").alias("advisory"))


@query("m05_offerings", "select accession::varchar as accession_number, nullif(industry, '5-LOW') as industry_group, case when crd % 5 > 0 then sold end as total_amount_sold, crd % 3 = 0 as is_pooled_fund, amendment is true as is_amendment, null::double as min_investment from offerings")
def m05(t: Tables) -> DataFrame:
    """Offerings as tab-separated files of the source's headers, renamed and typed; missing values are spelled out there, and some columns aren't filed."""
    o, path = t.offerings(), shared_dir(t.spark, "offerings")
    filed = o.select(
        F.col("accession").cast("string").alias("ACCESSIONNUMBER"), F.when(F.col("industry") == "5-LOW", "None").otherwise(F.concat(F.lit(" "), F.col("industry"))).alias("INDUSTRYGROUPTYPE"), F.when(F.col("crd") % 5 > 0, F.format_string("%.2f", F.col("sold"))).otherwise("Indefinite").alias("TOTALAMOUNTSOLD"),
        F.when(F.col("crd") % 3 == 0, "True").when(F.col("crd") % 3 == 1, "yes").otherwise("false").alias("ISPOOLEDINVESTMENTFUNDTYPE"), F.coalesce(F.col("amendment"), F.lit(False)).cast("string").alias("ISAMENDMENT"),
    )
    filed.write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    out = typed(read_delimited(t.spark, path, "\t", "", "None"), OFFERINGS)
    return out.select("accession_number", "industry_group", "total_amount_sold", "is_pooled_fund", "is_amendment", "min_investment")


@query("m17_newest_feeds", "select kind, case kind when '1-URGENT' then 'advFirmData_' || strftime(max(filed), '%Y%m') || '01_' || strftime(max(filed), '%Y%m%d') || '.zip' else 'IA_INDVL_Feed_' || strftime(max(filed), '%m_%d_%Y') || '.zip' end as name from filings group by 1")
def m17(t: Tables) -> DataFrame:
    """Of each kind of feed the newest by the date in its name, which doesn't sort as text, whether that is a day or a span; names without one come last."""
    day = F.concat(F.lit("IA_INDVL_Feed_"), F.date_format("filed", "MM_dd_yyyy"), F.lit(".zip"))
    span = F.concat(F.lit("advFirmData_"), F.date_format("filed", "yyyyMM"), F.lit("01_"), F.date_format("filed", "yyyyMMdd"), F.lit(".zip"))
    name = F.when(F.col("filing_id") % 100 == 0, "zz_99_99_latest.zip").when(F.col("kind") == "1-URGENT", span).otherwise(day)
    # a name's own day must be there in spite of those that tell none
    f = t.filings()
    return newest(f.select("kind", name.alias("name")).unionByName(f.select("kind", F.when(F.col("kind") == "1-URGENT", span).otherwise(day).alias("name"))), "name", ["kind"]).select("kind", "name")


@query("m18_roster", """select o_orderkey as crd, '[' || o_orderkey || ',"O''Neil \\"' || o_orderpriority || '\\"",[' || coalesce(string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar), '') || '],' || case when o_orderstatus = 'P' then 'null' else '"' || o_orderstatus || '"' end || ',' || (o_custkey % 2) || ',' || year(o_orderdate) || ']' as record
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderpriority, o_orderstatus, o_custkey, o_orderdate""")
def m18(t: Tables) -> DataFrame:
    """A record of each person, sorted by number: name, employers, state, whether there is a disclosure, first year."""
    li = t.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("e"))
    o = t.raw("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    name = F.concat(F.lit('O\'Neil "'), F.col("o_orderpriority"), F.lit('"'))
    people = o.select(
        F.col("o_orderkey").alias("crd"), name.alias("name"), F.transform(F.coalesce("e", F.array().cast("array<string>")), lambda x: x.cast("long")).alias("employers"), F.nullif("o_orderstatus", F.lit("P")).alias("state"),
        (F.col("o_custkey") % 2 == 1).alias("disclosure"), F.year("o_orderdate").alias("first_year"),
    )
    return roster(people, "crd", ["crd", "name", "employers", "state", "disclosure", "first_year"])


ICON_HEADS = """with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, strlen(html) as n from pages),
    a as (select host, min(case when n % 3 = 0 and n >= 64 and n % 11 > 0 then 0 when n % 5 = 0 and n >= 64 then 1 end) as i from p group by 1)"""


@query("m12_icon_sources", ICON_HEADS + " select host, case i when 1 then 'second' end as source from a where i is null or i = 1")
def m12_sources(t: Tables) -> DataFrame:
    """Of each host the first service whose answer is a real icon, by its status and its first bytes; those with the usual source are left out."""
    n, html = F.octet_length("html"), F.encode("html", "UTF-8")
    png, ico = F.unhex(F.lit("89504E470D0A1A0A")), F.unhex(F.lit("00000100"))
    rows = t.raw("pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.when(n % 11 == 0, 404).otherwise(200).alias("s1"), F.when(n % 3 == 0, F.concat(png, html)).otherwise(html).alias("c1"),
        F.lit(200).alias("s2"), F.when(n % 5 == 0, F.concat(ico, html)).otherwise(html).alias("c2"),
    )
    return icon_sources(rows, "host", [("first", "s1", "c1"), ("second", "s2", "c2")]).where("source is null or source <> 'first'")


@query("m15_website_notes", """with p as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages)
    select page_id, 'firm website' || case page_id % 4 when 0 then '' when 1 then ' · redirected' when 2 then '' else ' · researched' end as note from p""")
def m15(t: Tables) -> DataFrame:
    """What is said of a link that isn't the filed one: redirects, researched addresses, and such of the host that was filed."""
    k, host = F.col("page_id") % 4, F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    via = F.when(k == 1, "redirect").when(k >= 2, "research")
    filed = F.when(k == 2, F.concat(F.lit("http://www."), F.regexp_replace(host, "^www[.]", ""), F.lit("/old"))).otherwise("https://social.example.com/firm")
    return t.raw("pages").select("page_id", website_note(via, filed, F.col("url")).alias("note"))


@query("m14_segment_shares", "select c_custkey as crd, case c_mktsegment when 'BUILDING' then case when c_custkey % 3 > 0 then (c_custkey % 90)::double end when 'MACHINERY' then (c_custkey % 70)::double end as share from customer")
def m14(t: Tables) -> DataFrame:
    """The share of the client group that a firm's segment stands for; segments without a group, and groups that aren't told, have none."""
    k = F.col("c_custkey")
    mix = F.map_from_entries(F.array_compact(F.array(F.when(k % 3 > 0, F.struct(F.lit("people"), (k % 90).cast("double"))), F.struct(F.lit("funds"), (k % 70).cast("double")))))
    return t.raw("customer").select(k.alias("crd"), segment_share(mix, F.col("c_mktsegment"), {"BUILDING": "people", "MACHINERY": "funds"}).alias("share"))


@query("p14_link_settings", """select c_custkey as k, case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 2.5e7 when c_custkey % 5 = 2 then 1e8 else least(1e15, greatest(0, c_acctbal * 1000)) end as min_aum,
    case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 1 when c_custkey % 5 = 2 then 3 else floor(c_custkey % 7 + 0.5) end::double as min_staff, case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 0.1 when c_custkey % 5 = 2 then 0.4 when c_custkey % 5 = 3 then least(1, (c_custkey % 20) / 10) else 0 end::double as scale from customer""")
def p14(t: Tables) -> DataFrame:
    """Settings of links, each within its limits: links that can't be read, presets, defaults, values out of range or no numbers, weights given in part."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "{no json").when(k % 5 == 1, '{"p":"boutique"}').when(k % 5 == 2, '{"d":{"min_aum":"lots","weights":7}}').when(
        k % 5 == 3, F.concat(F.lit('{"d":{"min_aum":'), (F.col("c_acctbal") * 1000).cast("string"), F.lit(',"min_staff":'), (k % 7).cast("string"), F.lit(',"weights":{"scale":'), ((k % 20) / 10).cast("string"), F.lit("}}}")),
    ).otherwise(F.concat(F.lit('{"d":{"min_aum":'), (F.col("c_acctbal") * 1000).cast("string"), F.lit(',"min_staff":'), (k % 7).cast("string"), F.lit(',"weights":{"productivity":1}}}')))
    # Spark's base64 breaks long lines
    link = F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "=+$|\\s", "")
    s = link_columns(F.col("link"))
    return t.raw("customer").select(k.alias("k"), link.alias("link")).select("k", s["min_aum"].alias("min_aum"), s["min_staff"].alias("min_staff"), s["weight_scale"].alias("scale"))
