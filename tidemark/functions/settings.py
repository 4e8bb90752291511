"""Settings that come from links: read with limits, never trusted."""

from __future__ import annotations

import base64
import json
import math
import re
from dataclasses import asdict
from urllib.parse import parse_qs

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.methodology import METHODS, Method

MAX_COMPARED = 4
# Lowest and highest of each setting.
LIMITS = {"min_aum": (0, 1e15), "min_staff": (0, 1e6), "max_disclosures": (0, 999), "risk_min_aum": (0, 1e15), "threshold": (0, 1000)}
WEIGHT_LIMITS, POINT_LIMITS = (0, 1), (0, 500)
FACTOR_NAMES = ("scale", "productivity", "fee_alignment", "disciplinary_record", "hnw_focus")
SIGNAL_NAMES = ("advisor_disclosures", "recent_firm_disclosures", "disclosures_for_size", "commissions_plus_performance", "disclosures", "dense_affiliations", "high_client_load")
COHORT_NAMES = ("aum_band", "client_mix", "region")


def _number(x, low: float, high: float, default: float) -> float:
    ok = isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    return min(high, max(low, x)) if ok else default


def sanitized(raw) -> Method:
    """A method of whatever was given: known settings within their limits, the default for the rest."""
    raw, base = raw if isinstance(raw, dict) else {}, METHODS["default"]
    part = lambda k: raw[k] if isinstance(raw.get(k), dict) else {}
    plain = {k: _number(raw.get(k), *LIMITS[k], getattr(base, k)) for k in LIMITS}
    plain |= {k: int(plain[k] + 0.5) for k in ("min_staff", "max_disclosures")}
    weights = {k: _number(part("weights").get(k), *WEIGHT_LIMITS, base.weights.get(k, 0)) for k in FACTOR_NAMES}
    points = {k: _number(part("points").get(k), *POINT_LIMITS, base.points.get(k, 0)) for k in SIGNAL_NAMES}
    cohorts = raw.get("cohorts") if isinstance(raw.get("cohorts"), (list, tuple)) else ()
    return Method(weights={k: v for k, v in weights.items() if v}, points={k: v for k, v in points.items() if v}, cohorts=tuple(k for k in COHORT_NAMES if k in cohorts), **plain)


def preset_of(method: Method) -> str | None:
    """The name of the preset that a method equals, if any."""
    return next((k for k, m in METHODS.items() if m == method), None)


def encoded(method: Method) -> str:
    """A short text for a link: a preset's name, or what differs from the default."""
    name, base = preset_of(method), asdict(METHODS["default"])
    payload = {"p": name} if name else {"d": {k: v for k, v in asdict(method).items() if v != base[k]}}
    return base64.urlsafe_b64encode(json.dumps(payload, separators=(",", ":")).encode()).decode().rstrip("=")


def decoded(text: str) -> Method | None:
    """The method of a link; None if it can't be read."""
    try:
        payload = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if payload.get("p"):
            return METHODS.get(payload["p"])
        given = payload.get("d") or {}
        if isinstance(given.get("weights"), dict):
            given["weights"] = {k: 0 for k in FACTOR_NAMES} | given["weights"]
        if isinstance(given.get("points"), dict):
            given["points"] = {k: 0 for k in SIGNAL_NAMES} | given["points"]
        return sanitized(given)
    except (ValueError, AttributeError, TypeError):
        return None


def link_columns(text: Column) -> dict[str, Column]:
    """The same as decoded() of a column of links, as columns of numbers: every limit's setting, and the weights by name; null where a link can't be read or names no preset.

    A preset's name gives its settings; else what isn't given, or is no number, is the default's, and of weights given as an object those that it doesn't name are zero.
    """
    body = F.try_to_binary(F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)))), F.lit("base64")).cast("string")
    fine, preset = F.get_json_object(body, "$").isNotNull(), F.get_json_object(body, "$.p")
    named = preset.isNotNull() & (preset != "")
    base = METHODS["default"]

    def of(path: str, low: float, high: float, default: Column | float, own: dict[str, float]) -> Column:
        raw = F.get_json_object(body, f"$.d.{path}")
        given = raw.try_cast("double")
        number = F.when(given.isNotNull() & ~F.isnan(given) & (F.abs(given) != float("inf")), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), given))).otherwise(default)
        presets = F.create_map(*[F.lit(x) for k, v in own.items() for x in (k, float(v))])
        return F.when(fine & named, F.try_element_at(presets, preset)).when(fine, number)

    out = {k: of(k, *LIMITS[k], F.lit(float(getattr(base, k))), {n: getattr(m, k) for n, m in METHODS.items()}) for k in LIMITS}
    out |= {k: F.floor(out[k] + 0.5).cast("double") for k in ("min_staff", "max_disclosures")}
    some = F.get_json_object(body, "$.d.weights").startswith(F.lit("{"))
    out |= {f"weight_{k}": of(f"weights.{k}", *WEIGHT_LIMITS, F.when(F.coalesce(some, F.lit(False)), 0.0).otherwise(float(base.weights.get(k, 0))), {n: m.weights.get(k, 0) for n, m in METHODS.items()}) for k in FACTOR_NAMES}
    return out


def compared(search: str) -> list[int]:
    """Firms of a compare link: whole numbers, each once, four at most."""
    given = parse_qs(search.lstrip("?")).get("firms", [""])[0].split(",")
    return list(dict.fromkeys(int(x) for x in map(str.strip, given) if re.fullmatch(r"[0-9]{1,9}", x)))[:MAX_COMPARED]
