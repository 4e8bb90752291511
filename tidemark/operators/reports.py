"""Reports and feeds as filed: annual reports, exempt offerings, rosters, newest files, icons and notes on websites."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import host_of, to_number
from ..sources.archives import cell, with_cells
from .asof import latest
from .websites import is_real_icon

# Headers of annual reports, as they were named over the years.
ANNUAL = {
    "crd": ["ORGANIZATION CRD#", "ORGANIZATION CRD"],
    "aum_total": ["5F(2)(C)", "5F2C"],
    "accounts_total": ["5F(2)(F)", "5F2F"],
    "employees_total": ["5A"],
    "employees_advisory": ["5B(1)", "5B1"],
}
# Columns of exempt offerings, and what kind they are.
OFFERINGS = {
    "ACCESSIONNUMBER": ("accession_number", "text"),
    "INDUSTRYGROUPTYPE": ("industry_group", "text"),
    "INVESTMENTFUNDTYPE": ("investment_fund_type", "text"),
    "ISPOOLEDINVESTMENTFUNDTYPE": ("is_pooled_fund", "flag"),
    "ISAMENDMENT": ("is_amendment", "flag"),
    "PREVIOUSACCESSIONNUMBER": ("previous_accession_number", "text"),
    "TOTALOFFERINGAMOUNT": ("total_offering_amount", "number"),
    "TOTALAMOUNTSOLD": ("total_amount_sold", "number"),
    "MINIMUMINVESTMENTACCEPTED": ("min_investment", "number"),
    "HASNONACCREDITEDINVESTORS": ("has_non_accredited", "flag"),
}


def annual_reports(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """source_archive and the columns of ANNUAL, as numbers, of the rows of archives or workbooks; rows without a firm's number go, of several of a firm the last line stays.

    Firms are dealt over as many tasks as Spark sees fit, or over `parts`.
    """
    values = with_cells(rows).select("source_archive", "member", "line", *[to_number(cell(*names)).alias(c) for c, names in ANNUAL.items()])
    values = values.where("crd is not null").withColumn("crd", F.col("crd").cast("long"))
    values = values.repartition(parts, "source_archive", "crd") if parts else values
    return latest(values, ["source_archive", "crd"], [F.desc("member"), F.desc("line")]).select("source_archive", *ANNUAL)


def typed(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Columns renamed and typed: numbers that aren't one are null, a flag is only true where it says so, texts are trimmed and null if empty; columns that aren't there are null."""
    have = {c.upper(): c for c in df.columns}

    def one(source: str, kind: str) -> Column:
        if source.upper() not in have:
            return F.lit(None).cast({"number": "double", "flag": "boolean", "text": "string"}[kind])
        c = F.col(f"`{have[source.upper()]}`")
        return {"number": F.try_to_number(F.trim(c), F.lit("S99999999999999999999.999999")).cast("double"), "flag": F.lower(F.trim(c)) == "true", "text": F.nullif(F.trim(c), F.lit(""))}[kind]

    return df.select(*[one(source, kind).alias(name) for source, (name, kind) in columns.items()])


def feed_date(name: Column) -> Column:
    """The date in a feed's name: of the form 05_31_2024, or 20240501_20240531 (its end); null for any other."""
    us = F.try_to_date(F.regexp_extract(name, "(\\d{2}_\\d{2}_\\d{4})", 1), "MM_dd_yyyy")
    span = F.try_to_date(F.regexp_extract(name, "\\d{8}_(\\d{8})", 1), "yyyyMMdd")
    return F.coalesce(span, us)


def newest(files: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Of each group the file whose name tells the latest date, of several the last by name; one without a date only where there is no other."""
    return latest(files, by, [F.desc_nulls_last(feed_date(F.col(name))), F.desc(name)])


def json_text(value: Column) -> Column:
    """A value as it stands in a JSON document; null as null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(value), {"ignoreNullFields": "false"}), "^\\[|\\]$", ""), F.lit("null"))


def roster(people: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and record, a JSON array of the columns, a row for each person in the order of the key; flags are 0 or 1."""
    kinds = dict(people.dtypes)
    values = [F.coalesce(F.col(c), F.lit(False)).cast("int") if kinds[c] == "boolean" else F.col(c) for c in columns]
    return people.select(key, F.concat(F.lit("["), F.concat_ws(",", *map(json_text, values)), F.lit("]")).alias("record")).orderBy(key)


def icon_sources(answers: DataFrame, host: str, sources: list[tuple[str, str, str]]) -> DataFrame:
    """host and source: the first of (name, status, content) that answers with a real icon, null if none does; a host is one row, whatever its answers."""
    found = F.coalesce(*[F.when(is_real_icon(F.col(status), F.col(content)), F.lit(i)) for i, (_, status, content) in enumerate(sources)])
    names = F.array(*[F.lit(n) for n, _, _ in sources])
    return answers.groupBy(host).agg(F.min(found).alias("_i")).select(host, F.get(names, F.col("_i")).alias("source"))


def website_note(via: Column, filed: Column, shown: Column) -> Column:
    """What stands under a firm's link: that it redirects, or that its address was researched where that is another host than the one filed."""
    bare = lambda u: F.regexp_replace(host_of(u), "^www\\.", "")
    own = F.lit("firm website")
    return F.when(via.isNull(), own).when(via != "research", F.concat(own, F.lit(" · redirected"))).when(F.coalesce(bare(filed) == bare(shown), F.lit(False)), own).otherwise(F.concat(own, F.lit(" · researched")))


def segment_share(mix: Column, segment: Column, groups: Mapping[str, str]) -> Column:
    """Of a map of client groups with their shares, the share of a segment's group; null where it has none or isn't told."""
    lookup = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return F.try_element_at(mix, F.try_element_at(lookup, segment))
