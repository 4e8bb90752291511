"""What is told of a firm in a page or a document: linked data, a description, change events, fallbacks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import compact_usd


def json_ld(site: str, crd: Column, name: Column, legal: Column, state: Column, country: Column, staff: Column, record: str) -> Column:
    """A script element of linked data on a firm; what isn't known is left out. No name can end the element early."""
    some = lambda x, value: F.when(x, value)
    address = some(state.isNotNull() | country.isNotNull(), F.struct(F.lit("PostalAddress").alias("@type"), state.alias("addressRegion"), country.alias("addressCountry")))
    number = crd.cast("string")
    body = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("FinancialService").alias("@type"), name.alias("name"), legal.alias("legalName"), F.concat(F.lit(f"{site}/firm/"), number).alias("url"),
        F.struct(F.lit("PropertyValue").alias("@type"), F.lit("CRD").alias("propertyID"), number.alias("value")).alias("identifier"), F.array(F.concat(F.lit(record), number)).alias("sameAs"), address.alias("address"),
        some(staff.isNotNull(), F.struct(F.lit("QuantitativeValue").alias("@type"), staff.alias("value"))).alias("numberOfEmployees"),
    )
    return F.concat(F.lit('<script type="application/ld+json">'), F.replace(F.to_json(body), F.lit("</"), F.lit("<\\/")), F.lit("</script>"))


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def description(crd: Column, name: Column, state: Column, kind: Column, aum: Column, staff: Column, disclosures: Column) -> Column:
    """A sentence with a firm's own numbers; the parts that aren't known are left out."""
    where = F.coalesce(F.concat(F.lit(", "), state), F.lit(""))
    facts = F.concat_ws(", ", F.concat(F.coalesce(F.concat(F.lower(kind), F.lit(" with ")), F.lit("")), F.coalesce(compact_usd(aum), F.lit("—")), F.lit(" in regulatory AUM")), F.concat(F.format_number(staff, 0), F.lit(" employees")), plural(F.coalesce(disclosures, F.lit(0)), "disciplinary disclosure"))
    return F.concat(name, F.lit(" (CRD "), crd.cast("string"), where, F.lit("): "), facts, F.lit("."))


def public_event(event: Column, name: Column, old: Column, new: Column, labels: Mapping[str, str]) -> Column:
    """A change event as it is shown: its type, who it is about, and stakes by their labels; a stake that isn't there is left out."""
    by_code = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    label = lambda c: F.when(c.isNotNull(), F.try_element_at(by_code, c))
    return F.to_json(F.struct(event.alias("type"), name.alias("name"), label(old).alias("before"), label(new).alias("after")))


def first_source(checks: Mapping[str, Column]) -> Column:
    """The name of the first check that holds, null where none does."""
    return F.coalesce(*[F.when(ok, F.lit(name)) for name, ok in checks.items()])


def exceptions(df: DataFrame, source: str, usual: str) -> DataFrame:
    """Rows whose source isn't the usual one: all that an export has to name."""
    return df.where(~F.col(source).eqNullSafe(F.lit(usual)))


def compare_sources(key: str, firms: list[int], rows: list[tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """group, label and a column f1, f2 ... for each of a few firms, in the order given: what each row (source, group, label, text) says of it, a dash where that isn't known.

    A source has a row for a firm at most. The firms' keys are a filter on each source, which goes below its joins, groups and windows by that key down to its scans; what is left of all sources meets
    as one long table, of so many rows as firms and texts.
    """
    long = None
    for source in dict.fromkeys(id(x[0]) for x in rows):
        own = [(i, *x) for i, x in enumerate(rows) if id(x[0]) == source]
        told = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(group).alias("group"), F.lit(label).alias("label"), F.coalesce(text, F.lit("—")).alias("text")) for i, _, group, label, text in own])
        some = own[0][1].where(F.col(key).isin(*firms)).select(F.col(key).alias("_key"), F.explode(told).alias("_t")).select("_key", "_t.*")
        long = some if long is None else long.unionByName(some)
    out = long.groupBy("place", "group", "label").pivot("_key", firms).agg(F.first("text"))
    return out.orderBy("place").select("group", "label", *[F.coalesce(str(k), F.lit("—")).alias(f"f{i}") for i, k in enumerate(firms, 1)])


def multiple_text(c: Column) -> Column:
    """1.4×, 23×"""
    return F.when(c.isNotNull(), F.concat(F.when(c < 10, F.format_string("%.1f", F.bround(c, 1))).otherwise(F.format_string("%.0f", F.bround(c, 0))), F.lit("×")))


def count_text(c: Column) -> Column:
    """1,234"""
    return F.format_number(c, 0)


def share_text(part: Column, whole: Column) -> Column:
    """Part of a whole as whole percent; null where the whole is zero or not known."""
    return F.when(whole != 0, F.concat(F.bround(F.coalesce(part, F.lit(0)) / whole * 100, 0).cast("int").cast("string"), F.lit("%")))
