"""Disclosure events of three kinds of reports, brought to one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clean_text, partial_iso, to_number
from ..sources.archives import cell, with_cells

# What is filed where. A line is a kind of report, what it tells, and the headers under which that may stand; of several the first that is filled counts.
FILED = """
Regulatory      date        Date Initiated
Regulatory      by          Initiated By
Regulatory      what        Principal Sanction, Principal Product
Regulatory      status      Status
Regulatory      resolution  Resolution
Regulatory      resolved    Resolution Date
Regulatory      text        Allegations, Summary
Criminal        date        Date First Charged
Criminal        by          Court
Criminal        what        Event Detail
Criminal        status      Status
Criminal        resolution  Disposition
Criminal        resolved    Status Date
Criminal        text        Summary, Event Detail
Civil_Judicial  date        Filing Date
Civil_Judicial  by          Initiated By
Civil_Judicial  what        Relief Sought
Civil_Judicial  status      Status
Civil_Judicial  resolution  Resolution Type
Civil_Judicial  resolved    Resolution Date
Civil_Judicial  text        Allegations, Summary
"""
CODES = {"Regulatory": "R", "Criminal": "C", "Civil_Judicial": "J"}
AGAINST = {"Advisory Firm": "F", "Affiliates": "A", "Firm and Affiliates": "B"}
REMOVED = ["Remove-Affiliate", "Remove-Expired", "Remove-Filed in Error"]
#: Characters after which a text is cut, by what it tells; what isn't here is a date.
LIMITS = {"text": 320, "what": 320, "by": 120, "resolution": 80, "status": 40}


def _cut(value: Column, most: int) -> Column:
    """A cleaned text, cut after a word where it is longer than so many characters."""
    return F.get(F.transform(F.array(clean_text(value, 2**30)), lambda t: _shortened(t, most)), F.lit(0))


def _shortened(t: Column, most: int) -> Column:
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 1), " [^ ]*$", ""), F.lit("…"))).otherwise(t)


def headers() -> dict[str, dict[str, list[str]]]:
    """What is told -> kind of report -> its headers, from the table above."""
    out: dict[str, dict[str, list[str]]] = {}
    for line in FILED.strip().splitlines():
        kind, role, names = line.split(None, 2)
        out.setdefault(role, {})[kind] = names.split(", ")
    return out


def _by_kind(values: dict[str, Column], kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), kind)


def told(kind: Column) -> dict[str, Column]:
    """The columns of the common shape of a report of some kind, in rows of with_cells(): one expression for all kinds, which looks up the kind's headers."""
    out = {}
    for role, names in headers().items():
        places = _by_kind({k: F.array(*[F.lit("".join(h.upper().split())) for h in v]) for k, v in names.items()}, kind)
        out[role] = F.get(F.array_compact(_read(F.transform(places, lambda header: cell(header)), LIMITS.get(role))), F.lit(0))
    amount = to_number(cell("Monetary Amount"))
    trimmed = lambda c: F.trim(F.coalesce(cell(c), F.lit("")))
    out["amount"] = F.when(amount > 0, F.floor(amount)).cast("long")
    out["against"] = F.coalesce(_by_kind({k: F.lit(v) for k, v in AGAINST.items()}, trimmed("Filed Against")), F.lit("F"))
    out["removed"] = F.upper(F.concat_ws(",", *map(trimmed, REMOVED))).rlike("(^|,)Y(,|$)")
    out["kind"] = _by_kind({k: F.lit(v) for k, v in CODES.items()}, kind)
    return out


def _read(values: Column, limit: int | None) -> Column:
    """What stands under a report's headers: texts up to the limit, or else dates. A text is cleaned once."""
    return F.transform(values, partial_iso) if limit is None else F.transform(F.transform(values, lambda v: clean_text(v, 2**30)), lambda t: _shortened(t, limit))


def disclosure_events(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """crd, filing_id, ref, the common shape and affiliates of every report in rows (source_archive, member, fields of zipped_rows()).

    A report's firm is that of its filing in the same archive's base file, of several the first as text; reports without a firm or a reference are left out, as are archives without a
    base file. Affiliates are the named ones of the same filing and reference, sorted.

    The rows are read once and meet by windows over their filing: Spark takes files as large as they are packed, so a join would send whole archives to the driver, to broadcast them.
    They are dealt by filing over as many tasks as Spark sees fit, or over `parts`.
    """
    name = F.regexp_extract("member", "([^/]+)$", 1)
    kind = F.regexp_extract(name, f"^IA_DRP_({'|'.join(CODES)})_", 1)
    base, own = F.startswith(name, F.lit("IA_ADV_Base_A_")), F.startswith(name, F.lit("IA_DRP_Advisory_Affiliates_"))
    columns = told(F.col("_kind"))
    some = with_cells(rows.where(base | own | (kind != "")).withColumns({"_kind": kind, "_base": base, "_own": own}))
    some = some.select("source_archive", "_kind", F.nullif(cell("FilingID"), F.lit("")).alias("_filing"), F.when(~F.col("_base"), cell("ReferenceID")).alias("_ref"), F.when(F.col("_base"), F.nullif(cell("1E1"), F.lit(""))).alias("_crd"), F.when(F.col("_own"), _cut(cell("Affiliate Name"), 80)).alias("_name"), *[c.alias(n) for n, c in columns.items()])
    some = some.where("_filing is not null")
    filing, ref = ["source_archive", "_filing"], ["source_archive", "_filing", "_ref"]
    some = (some.repartition(parts, *filing) if parts else some.repartition(*filing)).sortWithinPartitions(*ref)  # the one order that both windows take
    some = some.withColumns({"affiliates": F.array_sort(F.collect_list("_name").over(Window.partitionBy(*ref))), "crd": F.min("_crd").over(Window.partitionBy(*filing))})
    return some.where("_kind <> '' and _ref <> '' and crd is not null").select("crd", F.col("_filing").cast("long").alias("filing_id"), F.concat("kind", "_ref").alias("ref"), *columns.keys(), "affiliates")
