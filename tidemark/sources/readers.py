"""Readers of filed archives. Every column of a delimited file is read as text and typed afterwards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def header_key(name: str) -> str:
    return "".join(name.upper().split())


def resolve_columns(df: DataFrame, fields: Mapping[str, list[str]], required: list[str] = ()) -> DataFrame:
    """Fields by the first of their candidate headers that df has, whatever its case and white space; others are null.

    A required field without a header is an error.
    """
    have = {header_key(c): c for c in reversed(df.columns)}
    found = {f: next((have[header_key(c)] for c in names if header_key(c) in have), None) for f, names in fields.items()}
    if missing := [f for f in required if found.get(f) is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(f) for f, c in found.items()])


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', nulls: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, all text; quote="" reads quotes as data, NA stays unless nulls names it."""
    r = spark.read.option("header", True).option("sep", sep).option("quote", quote).option("encoding", encoding).option("multiLine", False)
    return (r.option("nullValue", nulls) if nulls else r).csv(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Good rows, and a one-row frame with the number of malformed ones."""
    full = StructType([*schema.fields]).add("_bad", "string")
    rows = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(full).csv(path)
    every = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in full.names]))  # a row is only seen to be malformed if all its columns are read
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").agg(F.count_if(every >= 0).alias("malformed"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: StructType | str | None = None) -> DataFrame:
    """An XML feed, a row for each element; attributes are fields that begin with an underscore."""
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema else r).load(path)


def read_json_map(spark: SparkSession, path: str, field: str, value_schema: str, key: str = "crd") -> DataFrame:
    """A document that maps ids to values under a field: a row for each id."""
    doc = spark.read.option("wholetext", True).text(path)
    entries = F.from_json("value", f"struct<{field}:map<string,{value_schema}>>")[field]
    return doc.select(F.explode(entries).alias(key, "value"))


def nested_json(c: Column, outer: str, field: str, inner: str) -> Column:
    """A JSON text inside a JSON text's field."""
    return F.from_json(F.from_json(c, outer)[field], inner)


def links(html: Column, ending: str) -> Column:
    """Targets of a page's links that end so."""
    all_ = F.regexp_extract_all(html, F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.filter(all_, lambda x: F.endswith(F.lower(F.regexp_replace(x, "[?#].*$", "")), F.lit(ending)))


def absolute(link: Column, base: Column) -> Column:
    root = F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1)
    return F.when(F.rlike(link, F.lit("^[a-zA-Z]+://")), link).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(root, F.lit("/"), link))


def period_of_name(name: Column) -> Column:
    """The date that a file name tells: 2024q3, ia063024, ia06302024 or 20240701_20240731 (its end)."""
    q = F.regexp_extract(name, "(\\d{4})q([1-4])", 1)
    quarter = F.last_day(F.make_date(F.try_to_number(q, F.lit("9999")).cast("int"), F.regexp_extract(name, "(\\d{4})q([1-4])", 2).cast("int") * 3, F.lit(1)))
    span = F.try_to_date(F.regexp_extract(name, "\\d{8}_(\\d{8})", 1), "yyyyMMdd")
    long = F.try_to_date(F.regexp_extract(name, "ia(\\d{8})", 1), "MMddyyyy")
    short = F.try_to_date(F.regexp_extract(name, "ia(\\d{6})(?!\\d)", 1), "MMddyy")
    return F.coalesce(span, long, short, F.when(q != "", quarter))


def not_loaded(files: DataFrame, loaded: DataFrame, column: str = "source_archive") -> DataFrame:
    """Archives that no loaded table has rows of."""
    return files.select(column).distinct().join(loaded.select(column).distinct(), column, "left_anti")


def brochure_list(payload: Column) -> Column:
    """version_id, name and date_submitted of each brochure in an answer of the firm service (JSON text inside JSON); empty if it has none."""
    outer = F.from_json(payload, "hits struct<hits:array<struct<_source:struct<iacontent:string>>>>")
    content = F.from_json(F.get(outer["hits"]["hits"]["_source"]["iacontent"], F.lit(0)), "brochures struct<brochuredetails:array<struct<brochureVersionID:bigint,brochureName:string,dateSubmitted:string>>>")
    found = F.filter(content["brochures"]["brochuredetails"], lambda b: b["brochureVersionID"].isNotNull())
    named = F.transform(found, lambda b: F.struct(b["brochureVersionID"].alias("version_id"), b["brochureName"].alias("name"), b["dateSubmitted"].alias("date_submitted")))
    return F.coalesce(named, F.array().cast("array<struct<version_id:bigint,name:string,date_submitted:string>>"))


def filing_url(cik: Column, accession: Column) -> Column:
    """The public address of a filing."""
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))
