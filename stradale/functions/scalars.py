"""Scalar functions over tags, scores and samples as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

UNTAGGED = "untagged"

# --- fixed values: way filters (key, unanchored pattern that excludes) and road classes -------------
NETWORKS: dict[str, list[tuple[str, str]]] = {
    "drive": [
        ("highway", "abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|rest_area|service|services|steps|track"),
        ("area", "yes"),
        ("access", "private"),
        ("motor_vehicle", "no"),
        ("motorcar", "no"),
        ("service", "alley|driveway|emergency_access|parking|parking_aisle|private"),
    ],
    "all": [
        ("highway", "abandoned|construction|no|planned|platform|proposed|raceway|razed|rest_area|services"),
        ("area", "yes"),
    ],
}
CLASSES = ("motorway", "primary", "secondary", "tertiary", "residential", "unclassified")
CLASS_OF = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary",
    "secondary": "secondary", "secondary_link": "secondary", "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential",
    "living_street": "residential", "unclassified": "unclassified",
}
OTHER = "other"
PEDESTRIAN = ("footway", "path", "steps", "cycleway", "pedestrian", "bridleway", "corridor", "elevator", "platform", "proposed", "construction")
# ----------------------------------------------------------------------------------------------------


def guard(value: Column, *checks: tuple[Column, str]) -> Column:
    """The value, or an error with the message of the first check that does not hold."""
    out = value
    for ok, message in reversed(checks):
        out = F.when(ok, out).otherwise(F.raise_error(F.lit(message)))
    return out


def tag(other_tags: Column, key: str) -> Column:
    """A tag of an HSTORE-like text ("key"=>"value"); absent: empty."""
    return F.coalesce(F.regexp_extract(other_tags, f'(?:^|[,\\s]){_quoted(key)}=>"([^"]*)"', 1), F.lit(""))


def _quoted(key: str) -> str:
    return '"' + "".join("\\" + c if not c.isalnum() and c != "_" else c for c in key) + '"'


def network_mask(highway: Column, tags: dict[str, Column], network: str) -> Column:
    """Whether a way belongs to a network: no exclusion pattern is found in its tags; absent tags pass."""
    if network not in NETWORKS:
        raise ValueError(f"unknown network {network!r}; known: {sorted(NETWORKS)}")
    ok = F.lit(True)
    for key, pattern in NETWORKS[network]:
        value = F.coalesce(highway if key == "highway" else tags.get(key, F.lit("")), F.lit(""))
        ok = ok & ~((value != "") & value.rlike(pattern))
    return ok


def filter_tag_keys() -> list[str]:
    return sorted({k for rules in NETWORKS.values() for k, _ in rules} - {"highway"})


def highway_value(values: Column) -> Column:
    """(highway, multi_valued) of a list of values: the first one; an empty or null list is untagged."""
    empty = values.isNull() | (F.size(values) == 0)
    return F.struct(
        F.when(empty, F.lit(UNTAGGED)).otherwise(F.coalesce(F.get(values, F.lit(0)), F.lit(UNTAGGED))).alias("highway"),
        F.when(empty, F.lit(False)).otherwise(F.size(values) > 1).alias("multi_valued"),
    )


def road_class(highway: Column) -> Column:
    """The class of a highway value; classes outside CLASSES are `other`."""
    table = F.create_map(*[F.lit(x) for kv in CLASS_OF.items() for x in kv])
    c = F.element_at(table, highway)
    return F.when(c.isin(*CLASSES), c).otherwise(OTHER)


def pedestrian(highway: Column) -> Column:
    return highway.isin(*PEDESTRIAN)


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean, 0 where the sum is 0."""
    return f1(a, b)


def pair_score(la: Column, lb: Column) -> Column:
    return 1 - F.least(F.lit(1.0), F.abs(la - lb) / la)


def logit(p: float) -> float:
    """Infinite at 0 and 1; outside [0, 1] raises."""
    if not 0 <= p <= 1:
        raise ValueError("a probability lies in [0, 1]")
    return -math.inf if p == 0 else math.inf if p == 1 else math.log(p / (1 - p))


def predict_mask(logits: Column, threshold: float) -> Column:
    """Strictly above the threshold's logit."""
    return logits > F.lit(logit(threshold))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def interior(x: Column, y: Column, width: Column, height: Column, margin: float) -> Column:
    return (x >= margin) & (x <= width - 1 - margin) & (y >= margin) & (y <= height - 1 - margin)


def positive_kind(proposal_distance: Column) -> Column:
    return F.when(proposal_distance == F.lit(math.inf), "component_join").otherwise("shortcut")


def purity(a: Column, b: Column) -> Column:
    """The smaller of two purities; a null one is skipped."""
    return F.least(a, b)


def loss_shares(score_sum: Column, unlanded: Column, no_path: Column, pairs: Column) -> Column:
    """Shares of the lost score: displacement, severance, length error; they add up to 1 - score."""
    return F.struct(
        ratio(unlanded, pairs).alias("unlanded"),
        ratio(no_path, pairs).alias("no_path"),
        ratio(pairs - unlanded - no_path - score_sum, pairs).alias("length_error"),
    )


def detectable_difference(sem: float, rho: float = 0.0, alpha: float = 0.05, power: float = 0.8) -> float:
    """The smallest paired difference that a test of this power finds."""
    z = NormalDist().inv_cdf
    return (z(1 - alpha / 2) + z(power)) * sem * math.sqrt(2 * (1 - rho))


def key_of(prefix: str, **params: Column) -> Column:
    """`prefix@name=value` keys of grid points, values printed as %g does."""
    parts = [F.concat(F.lit(k), F.regexp_replace(F.format_string("%.6f", v.cast("double")), "\\.?0+$", "")) for k, v in params.items()]
    return F.concat(F.lit(prefix + "@"), F.concat_ws("_", *parts))


def digest(ids: Column) -> Column:
    """Order-sensitive digest of a list of ids."""
    return F.sha2(F.array_join(ids, "\n"), 256)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that is a hash of its parts: a draw that any engine with MD5 can repeat."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def strips(row: Column, col: Column, angle, phase, period, fraction) -> Column:
    """Whether a pixel lies in parallel bands of a coverage pattern."""
    a, p, t, f = (v if isinstance(v, Column) else F.lit(float(v)) for v in (angle, phase, period, fraction))
    return F.pmod(col * F.cos(a) + row * F.sin(a) + p, t) < f * t


def block_of(row: Column, col: Column, height, width, n_rows, n_cols) -> Column:
    """The coverage block of a pixel; blocks share the remainder evenly."""
    r = F.floor(row * n_rows / height).cast("int")
    c = F.floor(col * n_cols / width).cast("int")
    return r * n_cols + c


def observed(value: Column, valid: Column, covered: Column, scale: float, fill: float) -> Column:
    """(data, indicator) of an auxiliary channel: scaled where observed, filled elsewhere."""
    seen = valid & covered
    return F.struct(F.when(seen, value / scale).otherwise(F.lit(fill)).alias("data"), seen.cast("double").alias("indicator"))


def aux_stack(bands: dict[str, tuple[Column, float, float]], valid: Column, covered: Column) -> Column:
    """Auxiliary channels as one array: the bands (column, scale, fill) in order, then the indicator of what was observed."""
    seen = valid & covered
    return F.array(*[F.when(seen, v / s).otherwise(F.lit(float(fill))).cast("double") for v, s, fill in bands.values()], seen.cast("double"))


def mask_unobserved(data: Column, indicator: Column) -> Column:
    return data * indicator


def travel_time(length: Column, speed: Column, default: float = 13.41) -> Column:
    return length / F.coalesce(speed, F.lit(default))
