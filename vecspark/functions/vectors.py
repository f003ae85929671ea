"""Vector arithmetic as Column expressions: everything stays in the JVM, in double precision.

A null vector gives null. Distances order candidates; ties are broken by id where they rank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a sum of squares before the root where files of vectors are normalised (float epsilon).
FILE_EPSILON = 1.1920928955078125e-07
#: Radii at or under this have no direction.
RADIUS_EPSILON = 1e-12
ZERO = F.lit


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; null for a zero vector."""
    norms = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def inner_product(a: Column, b: Column) -> Column:
    """Negated, so that less is closer."""
    return -dot(a, b)


def fast_l2(a: Column, query: Column) -> Column:
    """Ranks as l2 does, without the query's own norm."""
    return squared_norm(a) - 2 * dot(a, query)


METRICS = {"l2": l2, "cosine": cosine, "ip": inner_product, "fast_l2": fast_l2}


def distance(metric: str, a: Column, b: Column) -> Column:
    try:
        return METRICS[metric](a, b)
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}: one of {sorted(METRICS)}") from None


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def normalize(v: Column, epsilon: float = 0.0) -> Column:
    norm = F.sqrt(squared_norm(v) + F.lit(epsilon))
    return F.transform(v, lambda x: x.cast("double") / norm)


def augment_for_ip(v: Column, most: Column) -> Column:
    """v / most and a last coordinate that makes the norm 1: L2 then ranks by inner product."""
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - squared_norm(v) / (most * most)))
    return F.concat(scale(v, 1 / most), F.array(rest))


def pad_to(v: Column, multiple: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.pmod(-F.size(v), F.lit(multiple)).cast("int")))


def quantize_u8(v: Column, factor: float, shift: float = 0.0) -> Column:
    """round((x + shift) * factor), half away from zero, held to 0 .. 255."""
    return F.transform(v, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round((x.cast("double") + shift) * factor).cast("int"))))


def quantize_i8(v: Column, factor: float) -> Column:
    """round(x * factor), half away from zero, held to -128 .. 127."""
    return F.transform(v, lambda x: F.least(F.lit(127), F.greatest(F.lit(-128), F.round(x.cast("double") * factor).cast("int"))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def radius(v: Column, pole: Column) -> Column:
    return F.sqrt(l2(v, pole))


def direction(v: Column, pole: Column) -> Column:
    """Unit direction from the pole, null where there is none."""
    r = radius(v, pole)
    return F.when(r > RADIUS_EPSILON, F.transform(subtract(v, pole), lambda x: x / r))


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


def radial_bin(r: Column, bounds: Column) -> Column:
    """The number of bounds under r: a radius at a bound is in the lower bin."""
    return F.size(F.filter(bounds, lambda b: b < r))


def cell_id(direction_bin: Column, radial: Column, n_radial: int) -> Column:
    return direction_bin * n_radial + radial


def capacity_class(n: Column, classes: tuple[int, ...] = (16, 32, 64, 128)) -> Column:
    """The least class that holds n; null above the last."""
    out = F.when(n <= classes[0], classes[0])
    for c in classes[1:]:
        out = out.when(n <= c, c)
    return out


def block_lower_bound(rho: Column, r0: Column, r1: Column, theta: Column, beta: Column) -> Column:
    """Least squared distance from a point at radius rho to a block of radii [r0, r1] in a cone."""
    phi = F.greatest(F.lit(0.0), theta - beta)
    nearest = F.least(r1, F.greatest(r0, rho * F.cos(phi)))
    return F.greatest(F.lit(0.0), rho * rho + nearest * nearest - 2 * rho * nearest * F.cos(phi))


def event_credit(d_sv: Column, d_wv: Column, d_av: Column, alpha: float = 1.2, squared: bool = False) -> Column:
    """Credit of a witness for pruning a victim, from 0 to 1; d_av is null without an alternative."""
    if squared:
        d_sv, d_wv, d_av = (F.sqrt(x) for x in (d_sv, d_wv, d_av))
    rw = d_wv / d_sv
    rc = F.when(d_av.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(d_av / d_sv, rw)))
    p = F.greatest(F.lit(0.0), 1 - alpha * rw)
    q = F.when(rw < rc, 1 - rw / rc).otherwise(0.0)
    return F.when(d_sv <= RADIUS_EPSILON, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p * q)))


def batch_verdict(evidence: Column, threshold: Column, competitive: Column, scored: Column, evidence_ratio: float, best_ratio: float, least: int, share: float) -> Column:
    """Why a batch of candidates is refused ("evidence", "low_yield"), or "admitted"; a null threshold refuses nothing by distance."""
    far = lambda ratio: threshold.isNotNull() & (evidence.isNull() | (evidence > threshold * ratio))
    low = (competitive < least) | (competitive / scored < share) | far(best_ratio)
    return F.when(far(evidence_ratio), "evidence").when(low, "low_yield").otherwise("admitted")


def is_mature(support: Column, evidence: Column, threshold: Column, least: int, ratio: float) -> Column:
    return (support >= least) & evidence.isNotNull() & (threshold.isNull() | (evidence <= threshold * ratio))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that doesn't hold, or an empty text."""
    out = F.lit("")
    for name, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def relative_increase(merged: Column, fixed: Column) -> Column:
    """merged / fixed - 1; of nothing 0, and infinity if something comes of nothing."""
    return F.when(fixed != 0, merged / fixed - 1).when(merged == 0, 0.0).otherwise(float("inf"))


#: Sizes of the types of chunks in bytes (fixed values).
CHUNK_BYTES = (4096, 65536, 524288, 2097152)


def chunk_id(kind: Column, number: Column) -> Column:
    """The type in the two highest bits over the number."""
    return F.shiftleft(kind.cast("long"), 62).bitwiseOR(number)


def chunk_parts(chunk: Column) -> tuple[Column, Column]:
    """(type, number) of a chunk id."""
    return F.shiftrightunsigned(chunk, 62).cast("int"), chunk.bitwiseAND(F.lit((1 << 62) - 1))
