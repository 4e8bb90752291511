"""The published methodology over a table of firms: factors, screens, signals and presets as data.

Columns of a firm: crd, name, aum_total, employees_advisory, employees_total, accounts_total, fee_pct_of_aum, fee_commissions,
fee_performance_based, affil_count, disciplinary_flag_count, pct_clients_individuals, pct_clients_hnw_individuals, and those that
cohorts need: aum_band, client_mix, region. Outliers may also use advisors and flagged_advisors (of the firm's own people) and recent_events.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import band
from .cohort import in_cohort
from .ranks import at_or_below, below, ranked

# Floors, cuts and caps of the methodology.
DISCLOSURE_CAP = 4
MIN_ADVISORS, ADVISOR_CUT, SIZE_CUT, LOAD_CUT, MIN_AFFILIATIONS = 20, 0.9, 0.95, 0.95, 3
SIZE_BANDS = [1e9, 1e10, 1e11]
LEAST_COHORT = 10


@dataclass(frozen=True)
class Method:
    weights: dict = field(default_factory=dict)
    min_aum: float = 1e8
    min_staff: int = 3
    max_disclosures: int = 0
    risk_min_aum: float = 1e8
    threshold: float = 40
    points: dict = field(default_factory=dict)
    cohorts: tuple = ()


# The four published presets.
METHODS = {
    "default": Method({"scale": 0.4, "productivity": 0.25, "fee_alignment": 0.15}, points={"advisor_disclosures": 50, "recent_firm_disclosures": 25, "commissions_plus_performance": 10}),
    "boutique": Method({"scale": 0.1, "productivity": 0.2, "fee_alignment": 0.25, "hnw_focus": 0.45}, 2.5e7, 1, 0, 2.5e7, 40, {"advisor_disclosures": 50, "recent_firm_disclosures": 25, "commissions_plus_performance": 10}, ("aum_band", "client_mix")),
    "institutional": Method({"scale": 0.25, "productivity": 0.45, "fee_alignment": 0.1, "disciplinary_record": 0.2}, 1e9, 10, 2, 1e9, 40, {"advisor_disclosures": 50, "recent_firm_disclosures": 25, "commissions_plus_performance": 10}, ("aum_band",)),
    "clean_record": Method({"productivity": 0.5, "fee_alignment": 0.5}, threshold=15, points={"disclosures": 15}),
}


def staff() -> Column:
    return F.coalesce("employees_advisory", "employees_total")


def factors() -> dict[str, tuple[Column, bool]]:
    """Each factor's value, and whether it is ranked among peers."""
    ind, hnw = F.col("pct_clients_individuals"), F.col("pct_clients_hnw_individuals")
    flags = F.coalesce("disciplinary_flag_count", F.lit(0))
    return {
        "scale": (F.col("aum_total"), True),
        "productivity": (F.when(staff() > 0, F.col("aum_total") / staff()), True),
        "fee_alignment": (F.when(F.coalesce("fee_pct_of_aum", F.lit(False)), F.when(F.coalesce("fee_commissions", F.lit(False)), 0.5).otherwise(1.0)).otherwise(0.0), False),
        "disciplinary_record": (1 - F.least(flags, F.lit(DISCLOSURE_CAP)) / DISCLOSURE_CAP, False),
        "hnw_focus": (F.when(ind.isNotNull() | hnw.isNotNull(), F.coalesce(ind, F.lit(0.0)) + F.coalesce(hnw, F.lit(0.0))), True),
    }


def top_firms(df: DataFrame, method: Method, n: int | None = 10) -> DataFrame:
    """The best firms by weighted score, then by size. Peers are all firms above the floor, also those that the screens leave out."""
    rows = df.where(F.coalesce("aum_total", F.lit(0.0)) >= method.min_aum)
    used = {k: w for k, w in method.weights.items() if w > 0}
    total, known = sum(used.values()), factors()
    levels = [list(method.cohorts[:i]) for i in range(1, len(method.cohorts) + 1)]
    rows = rows.withColumns({f"_{k}": known[k][0] for k in used})
    rows = in_cohort(rows, {f"_share_{k}": f"_{k}" for k in used if known[k][1]}, levels, LEAST_COHORT)
    share = lambda k: F.coalesce(F.col(f"_share_{k}") if known[k][1] else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"_{k}"))), F.lit(0.0))
    parts = [share(k) * (w / total) for k, w in used.items()]
    screen = (F.coalesce(staff(), F.lit(0)) >= method.min_staff) & (F.coalesce("disciplinary_flag_count", F.lit(0)) <= method.max_disclosures)
    scored = rows.withColumn("score", 100 * sum(parts[1:], parts[0])).where(screen).drop(*[f"_{k}" for k in used], *[f"_share_{k}" for k in used])
    return scored if n is None else scored.orderBy(F.desc("score"), F.desc("aum_total"), "crd").limit(n)


def sliding(points: float, share: Column, cut: float) -> Column:
    """From 40 percent of the points at the cut to all of them at the top, rounded half up."""
    return F.floor(points * (0.4 + 0.6 * (share - cut) / (1 - cut)) + 0.5)


def outlier_firms(df: DataFrame, method: Method, n: int | None = 10) -> DataFrame:
    """Firms whose signals add up to the threshold: score and the names of the signals, best first, then by name.

    A share below a value counts only firms that have one; a firm's own disclosures are judged among firms of its size.
    """
    rows = df.where(F.coalesce("aum_total", F.lit(0.0)) >= method.risk_min_aum)
    size = band(F.col("aum_total"), SIZE_BANDS, [0, 1, 2, 3])
    flags, events = F.coalesce("disciplinary_flag_count", F.lit(0)), F.coalesce("recent_events", F.lit(0))
    rate = F.when(F.col("advisors") >= MIN_ADVISORS, F.col("flagged_advisors") / F.col("advisors"))
    load = F.when(staff() > 0, F.col("accounts_total") / staff())
    rows = rows.withColumns({"_size": size, "_flags": flags, "_events": events, "_rate": rate, "_load": load})
    p = {k: float(v) for k, v in method.points.items() if v}
    # what a signal is judged by: its value, among whom, and which share; only what the method gives points for is counted
    judged = {"advisor_disclosures": ("_rate", [], below), "recent_firm_disclosures": ("_events", ["_size"], below), "disclosures_for_size": ("_flags", ["_size"], below), "high_client_load": ("_load", [], at_or_below)}
    judged = {f"_p{v}": (v, keys, share) for k, (v, keys, share) in judged.items() if k in p}
    rows = ranked(rows, {k: (v, keys) for k, (v, keys, _) in judged.items()})
    rows = rows.withColumns({k: share(k) for k, (_, _, share) in judged.items()})
    both = F.coalesce(F.col("fee_commissions") & F.col("fee_performance_based"), F.lit(False))
    signals = {
        "advisor_disclosures": lambda x: F.when(F.col("_rate").isNotNull() & (F.col("_p_rate") >= ADVISOR_CUT), sliding(x, F.col("_p_rate"), ADVISOR_CUT)),
        "recent_firm_disclosures": lambda x: F.when((F.col("_events") > 0) & (F.col("_p_events") >= SIZE_CUT), sliding(x, F.col("_p_events"), SIZE_CUT)),
        "disclosures_for_size": lambda x: F.when((F.col("_flags") > 0) & (F.col("_p_flags") >= SIZE_CUT), sliding(x, F.col("_p_flags"), SIZE_CUT)),
        "commissions_plus_performance": lambda x: F.when(both, F.lit(x)),
        "disclosures": lambda x: F.when(F.col("_flags") > 0, F.least(F.col("_flags"), F.lit(DISCLOSURE_CAP)) * x),
        "dense_affiliations": lambda x: F.when(F.col("affil_count") >= MIN_AFFILIATIONS, F.lit(x)),
        "high_client_load": lambda x: F.when(F.col("_load").isNotNull() & (F.col("_p_load") >= LOAD_CUT), F.lit(x)),
    }
    got = F.array(*[F.struct(F.coalesce(signals[k](x).cast("double"), F.lit(0.0)).alias("points"), F.lit(k).alias("name")) for k, x in p.items()])
    rows = rows.withColumn("_got", F.filter(got, lambda s: s["points"] > 0))
    rows = rows.withColumns({"score": F.aggregate("_got", F.lit(0.0), lambda a, s: a + s["points"]), "signals": F.transform("_got", lambda s: s["name"])})
    out = rows.where(F.col("score") >= method.threshold).drop("_size", "_flags", "_events", "_rate", "_load", "_p_rate", "_p_events", "_p_flags", "_p_load", "_got")
    return out if n is None else out.orderBy(F.desc("score"), "name").limit(n)
