"""Projections, filters, plain joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import shared_dir
from ..functions.clean import band, check_class, display_name, host_of, registrable
from ..operators.asof import latest
from ..operators.people import search_folder, search_people
from ..operators.documents import description, exceptions, first_source, json_ld
from ..operators.text import ATTRIBUTION, FLAGS, NEGATION, WEAK_FLAGS, find_flags
from ..operators.websites import is_real_icon, pick_websites
from ..sources.readers import brochure_list, links, not_loaded
from ..sources.sinks import bucket_directory, oversized, pages, read_keyed, search_buckets, shard, split_long_lists, upsert, upsert_keyed, write_buckets, write_keyed
from .fixtures import SQL, Tables, query


def list_firms(df: DataFrame, least: float | None = None, mix: str | None = None, limit: int = 50) -> DataFrame:
    """Firms that meet the conditions given, largest first, at most 500."""
    for given, condition in ((least, F.col("aum") >= F.lit(least)), (mix, F.col("mix") == F.lit(mix))):
        df = df.where(condition) if given is not None else df
    return df.orderBy(F.desc_nulls_last("aum"), "crd").limit(min(limit, 500))


def get_firm(df: DataFrame, crd: int) -> DataFrame:
    """One firm, or no row."""
    return df.where(F.col("crd") == crd)


def firm_filter(least: float = 0.0, mix: str | None = None, search: str = "") -> Column:
    """One condition of all filters of the firm list."""
    c = F.coalesce("aum", F.lit(0.0)) >= least
    if mix:
        c = c & (F.col("mix") == mix)
    if search.isdigit():
        return c & F.startswith(F.col("crd").cast("string"), F.lit(search))
    return c & F.contains(F.lower("name"), F.lit(search.lower())) if search else c


@query("p01_export_columns", "select crd, name, aum from firms")
def p01(t: Tables) -> DataFrame:
    return t.firms().select("crd", "name", "aum")


@query("p02_list_firms", "select crd, name, aum from firms where aum >= 1000 and mix = 'BUILDING' order by aum desc nulls last, crd limit 50")
def p02(t: Tables) -> DataFrame:
    return list_firms(t.firms(), 1000.0, "BUILDING").select("crd", "name", "aum")


@query("p03_get_firm", "select crd, name, aum, state, region, mix from firms where crd = 42")
def p03(t: Tables) -> DataFrame:
    return get_firm(t.firms(), 42)


@query("p04_firm_list", "select crd, name from firms where coalesce(aum, 0) >= 500 and mix = 'MACHINERY' and contains(lower(name), 'er#0000001')")
def p04(t: Tables) -> DataFrame:
    return t.firms().where(firm_filter(500.0, "MACHINERY", "er#0000001")).select("crd", "name")


@query("p04_id_prefix", "select crd, name from firms where starts_with(crd::varchar, '12')")
def p04_digits(t: Tables) -> DataFrame:
    return t.firms().where(firm_filter(-1e9, None, "12")).select("crd", "name")


@query("p05_bands", "select case when coalesce(aum, 0) < 0 then 'below' when coalesce(aum, 0) < 1000 then 'small' when coalesce(aum, 0) < 5000 then 'middle' else 'large' end as band, count(*) as n from firms group by 1")
def p05(t: Tables) -> DataFrame:
    return t.firms().groupBy(band(F.col("aum"), [0.0, 1000.0, 5000.0], ["below", "small", "middle", "large"]).alias("band")).agg(F.count("*").alias("n"))


@query("p06_not_amendments", "select industry, count(*) as n from offerings where amendment is not true group by 1")
def p06(t: Tables) -> DataFrame:
    return t.offerings().where(~F.coalesce("amendment", F.lit(False))).groupBy("industry").agg(F.count("*").alias("n"))


@query("p08_fallbacks", "select crd, coalesce(nullif(trim(state), ''), region) as domicile, coalesce(nullif(trim(mix), ''), name) as shown from firms")
def p08(t: Tables) -> DataFrame:
    """P08, P09."""
    return t.firms().select("crd", display_name(F.col("state"), F.col("region")).alias("domicile"), display_name(F.col("mix"), F.col("name")).alias("shown"))


@query("p10_required_keys", "select crd, name, state from firms where state is not null and crd is not null")
def p10(t: Tables) -> DataFrame:
    return t.firms().dropna(subset=["state", "crd"]).select("crd", "name", "state")


@query("p11_enum_filter", "select kind, status, count(*) as n from filings where status in ('O', 'F') group by 1, 2")
def p11(t: Tables) -> DataFrame:
    return t.filings().where(F.col("status").isin("O", "F")).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("p12_in_list", "select quarter, crd, aum from snapshots where quarter in (date '1999-12-31', date '2000-12-31')")
def p12(t: Tables) -> DataFrame:
    from .snapshots import current

    return current(t).where(F.col("quarter").isin("1999-12-31", "2000-12-31")).select("quarter", "crd", "aum")


@query("j01_child_rows", "select l_orderkey as filing_id, l_partkey as part, crd, filed from lineitem join filings on filing_id = l_orderkey where l_shipdate >= timestamp '1999-01-01'")
def j01(t: Tables) -> DataFrame:
    c = t.raw("lineitem").where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("filing_id"), F.col("l_partkey").alias("part"))
    return c.join(t.filings().select("filing_id", "crd", "filed"), "filing_id")


@query("j04_primary_issuers", "with i as (select l_orderkey, l_suppkey as issuer from lineitem where l_linenumber <= 2 qualify row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) = 1) select accession, crd, issuer from offerings left join i on l_orderkey = accession")
def j04(t: Tables) -> DataFrame:
    """Offerings with their first issuer."""
    i = latest(t.raw("lineitem").where("l_linenumber <= 2"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_suppkey")]).select(F.col("l_orderkey").alias("accession"), F.col("l_suppkey").alias("issuer"))
    return t.offerings().select("accession", "crd").join(i, "accession", "left")


@query("j06_not_withdrawn", "select filing_id, crd, filed from filings f where not exists (select 1 from withdrawals w where w.crd = f.crd and w.gone <= f.filed)")
def j06(t: Tables) -> DataFrame:
    f, w = t.filings().select("filing_id", "crd", "filed"), t.withdrawals().groupBy(F.col("crd").alias("_crd")).agg(F.min("gone").alias("gone"))
    return f.join(w, (f.crd == w["_crd"]) & (w.gone <= f.filed), "left_anti")


@query("j08_not_in", "select c_custkey as crd from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def j08(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("crd")).join(t.raw("orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("crd")), "crd", "left_anti")


@query("j09_semi", "select c_custkey as crd, c_name as name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def j09(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("crd"), F.col("c_name").alias("name")).join(t.raw("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("crd")), "crd", "left_semi")


@query("j13_lookup", "select s_suppkey, s_name, n_name, r_name from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey")
def j13(t: Tables) -> DataFrame:
    n = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.raw("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:www\\.)?([^/?#:@]+)', 1)"
CHECKS = f"with c as (select page_id, url, {HOST} as host, case page_id % 6 when 0 then 200 when 1 then 301 when 2 then 404 when 3 then 403 when 4 then 200 end as status, case page_id % 6 when 4 then 'https://other.example.edu/' else url end as got from pages)"


def checks(t: Tables) -> DataFrame:
    k = F.col("page_id") % 6
    status = F.when(k == 0, 200).when(k == 1, 301).when(k == 2, 404).when(k == 3, 403).when(k == 4, 200)
    return t.raw("pages").select("page_id", "url", host_of(F.col("url")).alias("host"), status.alias("status"), F.when(k == 4, "https://other.example.edu/").otherwise(F.col("url")).alias("got"))


@query("f14_hosts", CHECKS + " select page_id, host, array_to_string(string_split(host, '.')[-2:], '.') as domain from c")
def f14(t: Tables) -> DataFrame:
    return checks(t).select("page_id", "host", registrable(F.col("host")).alias("domain"))


@query("f15_check_classes", CHECKS + " select page_id, case when status is null then 'unreachable' when status = 403 then 'blocked_by_site' when status = 404 then 'not_found' when got <> url then 'cross_domain_redirect' else 'ok' end as class from c")
def f15(t: Tables) -> DataFrame:
    return checks(t).select("page_id", check_class(F.col("status"), F.col("url"), F.col("got")).alias("class"))


@query("j17_overrides", CHECKS + ", r as (select page_id, 'https://research.example.org/' || page_id as target from pages where page_id % 9 = 0), d as (select page_id, got as target from c where status between 200 and 299 and got <> url) select coalesce(r.page_id, d.page_id) as page_id, coalesce(r.target, d.target) as target, r.page_id is not null as researched from r full outer join d on r.page_id = d.page_id")
def j17(t: Tables) -> DataFrame:
    """Research wins over what a check found."""
    r = t.raw("pages").where("page_id % 9 = 0").select("page_id", F.concat(F.lit("https://research.example.org/"), F.col("page_id").cast("string")).alias("r"))
    d = checks(t).where("status between 200 and 299 and got <> url").select("page_id", F.col("got").alias("d"))
    return r.join(d, "page_id", "full_outer").select("page_id", F.coalesce("r", "d").alias("target"), F.col("r").isNotNull().alias("researched"))


@query("s18_links", "select page_id, len(list_filter(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), lambda x: ends_with(lower(x), 'the')))::int as n from pages")
def s18(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.size(links(F.col("html"), "the")).alias("n"))


@query("u01_union", "select filing_id, crd, 'filed' as kind from filings where status = 'P' union all select filing_id, crd, 'withdrawn' from withdrawals")
def u01(t: Tables) -> DataFrame:
    return t.filings().where("status = 'P'").select("filing_id", "crd", F.lit("filed").alias("kind")).unionByName(t.withdrawals().select("filing_id", "crd", F.lit("withdrawn").alias("kind")))


@query("u02_not_loaded", "select distinct strftime(filed, '%Y-%m') as source_archive from filings where strftime(filed, '%Y-%m') not in (select strftime(filed, '%Y-%m') from filings where filing_id % 97 = 0)")
def u02(t: Tables) -> DataFrame:
    f = t.filings().select(F.date_format("filed", "yyyy-MM").alias("source_archive"), "filing_id")
    return not_loaded(f, f.where("filing_id % 97 = 0"))


@query("u05_distinct_hosts", CHECKS + " select distinct host from c where host <> ''")
def u05(t: Tables) -> DataFrame:
    return checks(t).where("host is not null").select("host").distinct()


@query("t01_top_filings", "select filing_id, aum from filings order by aum desc nulls last, filing_id limit 30")
def t01(t: Tables) -> DataFrame:
    return t.filings().orderBy(F.desc_nulls_last("aum"), "filing_id").limit(30).select("filing_id", "aum")


@query("t09_page", "select crd, name from firms order by aum desc, crd limit 25 offset 50")
def t09(t: Tables) -> DataFrame:
    return t.firms().orderBy(F.desc("aum"), "crd").offset(50).limit(25).select("crd", "name")


@query("k02_upsert", "select o_orderkey as filing_id, case when o_orderkey % 10 = 0 then 'new' else o_orderstatus end as status from orders union all select o_orderkey + 10000000, 'new' from orders where o_orderkey % 100 = 0")
def k02(t: Tables) -> DataFrame:
    """Rows with a known key replaced, others added."""
    old = t.filings().select("filing_id", "status")
    new = old.where("filing_id % 10 = 0").withColumn("status", F.lit("new")).unionByName(old.where("filing_id % 100 = 0").select((F.col("filing_id") + 10000000).alias("filing_id"), F.lit("new").alias("status")))
    return upsert(old, new, ["filing_id"])


@query("k04_upsert_in_place", SQL["k02_upsert"], plain=True)
def k04(t: Tables) -> DataFrame:
    """The same in a table laid out by its key; only the parts that new rows fall into are written anew, in three goes."""
    path = shared_dir(t.spark, "keyed")
    old = t.filings().select("filing_id", "status")
    write_keyed(old, path, ["filing_id"], 16)
    new = old.where("filing_id % 10 = 0").withColumn("status", F.lit("new"))
    upsert_keyed(new, path, ["filing_id"], 16)
    upsert_keyed(old.where("filing_id % 100 = 0").select((F.col("filing_id") + 10000000).alias("filing_id"), F.lit("new").alias("status")), path, ["filing_id"], 16)
    upsert_keyed(new.where("false"), path, ["filing_id"], 16)
    return read_keyed(t.spark, path)


@query("k07_shards", "select (crd % 32)::int as shard, count(*) as n, min(crd) as first from firms group by 1")
def k07(t: Tables) -> DataFrame:
    return t.firms().groupBy(shard(F.col("crd")).alias("shard")).agg(F.count("*").alias("n"), F.min("crd").alias("first"))


@query("k09_search_buckets", "with w as (select unnest(list_distinct(list_filter(regexp_split_to_array(lower(name || ' ' || mix || ' ' || region), '[^a-z0-9]+'), lambda x: x <> ''))) as token, crd from firms), c as (select token, count(*) as n from w group by 1), b as (select token, n, floor(coalesce(sum(n) over (order by token rows between unbounded preceding and 1 preceding), 0) / 400)::bigint as bucket from c) select bucket, min(token) as first, sum(n)::bigint as n from b group by 1")
def k09(t: Tables) -> DataFrame:
    f = t.firms().select("crd", F.concat_ws(" ", "name", "mix", "region").alias("name"))
    return bucket_directory(search_buckets(f, "crd", "name", 400))


@query("k10_index_counts", "select source, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def k10(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


FLAG_TEXTS = ["The firm serves as general partner of the funds. ", "We do not receive a referral fee of any kind. ", "Referral fee ............. 12\n", "Each fund charges a 12b-1 fee. ", "Our staff receives a 12b-1 fee. ", "We invest in proprietary funds; nothing else. "]


@query("f34_real_icons", "select page_id, status = 200 and strlen(html) >= 64 and page_id % 3 > 0 as real from (select page_id, html, case when page_id % 5 = 0 then 404 else 200 end as status from pages)")
def f34(t: Tables) -> DataFrame:
    """what begins as an image does, of an answer that is one."""
    head = F.element_at(F.array(F.lit("3C68746D6C3E"), F.lit("89504E470D0A1A0A"), F.lit("474946383961")), (F.col("page_id") % 3 + 1).cast("int"))
    body = F.concat(F.unhex(head), F.encode("html", "UTF-8"))
    status = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    return t.raw("pages").select("page_id", is_real_icon(status, F.when(F.octet_length("html") >= 64, body).otherwise(F.substring(body, 1, 8))).alias("real"))


def _flag_sql() -> str:
    """The flags by sentences: one holds a flag if it has its words, nothing that takes them back, and, for weak words, a verb that says who is paid."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    has = lambda p: f"len(list_filter(s, lambda x: regexp_matches(x, {lit(p)}, 'i') and not regexp_matches(x, {lit(NEGATION)}, 'i'))) > 0"
    weak = lambda p: f"len(list_filter(s, lambda x: regexp_matches(x, {lit(p)}, 'i') and regexp_matches(x, {lit(ATTRIBUTION)}, 'i') and not regexp_matches(x, {lit(NEGATION)}, 'i'))) > 0"
    columns = ", ".join(has(p) + (f" or {weak(WEAK_FLAGS[k])}" if k in WEAK_FLAGS else "") + f" as {k}" for k, p in FLAGS.items())
    told = "[" + ", ".join(map(lit, FLAG_TEXTS)) + "]"
    return f"""with t as (select doc_id, coalesce(text, '') || '. ' || replace({told}[doc_id % {len(FLAG_TEXTS)} + 1], chr(10), ' ') || coalesce(text, '') as t from documents),
    s as (select doc_id, string_split_regex(regexp_replace(t, '[A-Za-z0-9 -]*[._]{{4,}}\\s*[0-9]{{1,4}}\\b', '', 'g'), '[.;]') as s from t) select doc_id, {columns} from s"""


@query("x01_text_flags", _flag_sql())
def x01(t: Tables) -> DataFrame:
    """Flags of whole documents, each with one more sentence in its middle; what is taken back, a heading or without a receiver isn't one."""
    own = F.coalesce("text", F.lit(""))
    text = F.concat(own, F.lit(". "), F.get(F.array(*map(F.lit, FLAG_TEXTS)), (F.col("doc_id") % len(FLAG_TEXTS)).cast("int")), own)
    f = t.raw("documents").select("doc_id", find_flags(text).alias("f"))
    return f.select("doc_id", *[F.map_contains_key("f", k).alias(k) for k in FLAGS])


@query("rollup_bands", "select region, mix, count(*) as n, grouping(region)::int as g1, grouping(mix)::int as g2 from firms group by rollup (region, mix)")
def rollup(t: Tables) -> DataFrame:
    return t.firms().rollup("region", "mix").agg(F.count("*").alias("n"), F.grouping("region").cast("int").alias("g1"), F.grouping("mix").cast("int").alias("g2"))


F11 = "with p as (select c_custkey as crd, c_mktsegment || ' ' || n_name || ' ' || r_name as name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey), t as (select *, list_filter(regexp_split_to_array(lower(name), '[^a-z]+'), lambda x: x <> '') as t from p) select crd, name from t where len(list_filter(t, lambda x: starts_with(x, 'asia'))) > 0 and len(list_filter(t, lambda x: starts_with(x, 'mach'))) > 0 order by t[-1] = 'asia' desc, name, crd limit 1000"


def people(t: Tables) -> DataFrame:
    n = t.raw("nation").join(t.raw("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return t.raw("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("crd"), F.concat_ws(" ", "c_mktsegment", "n_name", "r_name").alias("name"))


@query("f11_people_search", F11)
def f11(t: Tables) -> DataFrame:
    """every word typed starts a word of the name."""
    return search_people(people(t), "name", "Mach asia", 1000, "crd")


@query("f11_bucket_search", F11)
def f11_buckets(t: Tables) -> DataFrame:
    """The same from written buckets, of which only those that can hold the words typed are read."""
    folder = shared_dir(t.spark, "buckets")
    write_buckets(people(t), folder, "crd", "name", max(400, t.raw("customer").count() // 4))
    return search_folder(t.spark, folder, "crd", "name", "Mach asia", 1000)


@query("f13_own_websites", "select c_custkey as crd, case when c_custkey % 3 = 0 then 'http://' || lower(c_mktsegment) || 'partners' || c_custkey || '.com' when c_custkey % 3 = 1 then 'https://www.' || lower(c_mktsegment) || '.com/' end as website from customer where c_custkey % 3 <> 2")
def f13(t: Tables) -> DataFrame:
    """of several filed addresses the one that tells the firm's name; platforms never do."""
    k, m = F.col("c_custkey"), F.lower("c_mktsegment")
    own = F.concat(m, F.lit("partners"), k.cast("string"), F.lit(".com"))
    filed = F.when(k % 3 == 0, F.array(F.lit("https://facebook.com/x"), F.concat(F.lit("http://elsewhere.org; "), own, F.lit("."))))
    filed = filed.when(k % 3 == 1, F.array(F.concat(F.lit("http://my"), m, F.lit("shop.net/a?b=1")), F.concat(F.lit("https://www."), m, F.lit(".com/")))).otherwise(F.array(F.lit("linkedin.com/in/x"), F.lit(None).cast("string")))
    name = F.when(k % 3 == 0, F.concat(m, F.lit(" partners "), k.cast("string"), F.lit(", L.L.C."))).otherwise(F.concat(F.initcap(m), F.lit(" Inc.")))
    rows = t.raw("customer").select(k.alias("crd"), filed.alias("filed"), F.lit(None).cast("string").alias("business"), name.alias("legal"))
    return pick_websites(rows, "crd", "filed", "business", "legal")


@query("s13_nested_json", "select c_custkey as crd, c_custkey * 10 as version_id, c_name as name from customer where c_custkey % 2 = 0")
def s13(t: Tables) -> DataFrame:
    """Lists inside JSON text that is itself a field of JSON."""
    k = F.col("c_custkey")
    inner = F.to_json(F.struct(F.struct(F.array(F.struct((k * 10).alias("brochureVersionID"), F.col("c_name").alias("brochureName")), F.struct(F.lit(None).cast("bigint").alias("brochureVersionID"), F.lit("none").alias("brochureName"))).alias("brochuredetails")).alias("brochures")))
    payload = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(inner.alias("iacontent")).alias("_source"))).alias("hits")).alias("hits")))).otherwise('{"hits": {"hits": []}}')
    return t.raw("customer").select(k.alias("crd"), F.explode(brochure_list(payload)).alias("b")).select("crd", "b.version_id", "b.name")


@query("k08_long_lists", "with g as (select o_custkey as crd, count(*) as n from orders group by 1) select crd, n > 12 as own_file, n as n_items, case when n <= 12 then n end as kept from g")
def k08(t: Tables) -> DataFrame:
    """Lists beyond a size leave a stub."""
    g = t.raw("orders").groupBy(F.col("o_custkey").alias("crd")).agg(F.collect_list("o_orderkey").alias("xs"))
    short, _ = split_long_lists(g, "xs", 12)
    return short.select("crd", "own_file", F.col("n_items").cast("long").alias("n_items"), F.when(F.col("xs").isNotNull(), F.size("xs")).cast("long").alias("kept"))


@query("k12_pages", "select crd, '<!doctype html><title>' || name || '</title><h1>' || name || '</h1><dl>' || case when state is not null then '<dt>State</dt><dd>' || state || '</dd>' else '' end || '<dt>Mix</dt><dd>' || mix || '</dd></dl>' as page from firms")
def k12(t: Tables) -> DataFrame:
    """A page for each row."""
    return pages(t.firms(), "name", {"State": "state", "Mix": "mix"}).select("crd", "page")


@query("f33_json_ld", """select crd, '<script type="application/ld+json">' || replace('{"@context":"https://schema.org","@type":"FinancialService","name":"' || name || case when crd % 5 = 0 then '</script>' else '' end || '"' || case when crd % 4 = 0 then '' else ',"legalName":"' || name || ' LLC"' end || ',"url":"https://x.org/firm/' || crd || '","identifier":{"@type":"PropertyValue","propertyID":"CRD","value":"' || crd || '"},"sameAs":["https://y.org/' || crd || '"]'
    || case when state is not null then ',"address":{"@type":"PostalAddress","addressRegion":"' || state || '"}' else '' end || case when crd % 3 = 0 then '' else ',"numberOfEmployees":{"@type":"QuantitativeValue","value":' || (crd % 50) || '}' end || '}', '</', '<\\/') || '</script>' as ld,
    name || ' (CRD ' || crd || coalesce(', ' || state, '') || '): ' || lower(mix) || ' with $' || case when aum >= 1000 then case when aum / 1000 < 10 then printf('%.1f', round_even(aum / 1000, 1)) else printf('%.0f', round_even(aum / 1000, 0)) end || 'K' else printf('%.0f', round_even(aum, 0)) end || ' in regulatory AUM, ' || case when crd % 3 = 0 then '' else (crd % 50) || ' employees, ' end || (crd % 3) || ' disciplinary disclosure' || case when crd % 3 = 1 then '' else 's' end || '.' as description from firms""")
def f33(t: Tables) -> DataFrame:
    """Linked data and a description of each firm."""
    crd, name = F.col("crd"), F.col("name")
    staff = F.when(crd % 3 != 0, (crd % 50).cast("int"))
    odd = F.when(crd % 5 == 0, F.concat(name, F.lit("</script>"))).otherwise(name)
    ld = json_ld("https://x.org", crd, odd, F.when(crd % 4 != 0, F.concat(name, F.lit(" LLC"))), F.col("state"), F.lit(None).cast("string"), staff, "https://y.org/")
    return t.firms().select("crd", ld.alias("ld"), description(crd, name, F.col("state"), F.col("mix"), F.col("aum"), staff, (crd % 3).cast("int")).alias("description"))


@query("m12_icon_fallbacks", "select crd, case when crd % 7 = 0 then null when crd % 3 = 0 then 'declared' else 'service' end as source from firms where crd % 7 = 0 or crd % 2 = 1")
def m12(t: Tables) -> DataFrame:
    """Where a firm's icon comes from, of those that don't have one in the usual place."""
    k = F.col("crd")
    source = first_source({"root": (k % 2 == 0) & (k % 7 != 0), "declared": (k % 3 == 0) & (k % 7 != 0), "service": k % 7 != 0})
    return exceptions(t.firms().select("crd", source.alias("source")), "source", "root")


@query("k11_output_guard", "select sum(strlen(name))::bigint as bytes, sum(strlen(name)) > 1000 as too_large from firms")
def k11(t: Tables) -> DataFrame:
    return oversized(t.firms(), F.col("name"), 1000)
