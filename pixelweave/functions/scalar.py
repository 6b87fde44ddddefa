"""Column expressions; NULL stands for missing, sentinels appear only in final tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("GOLD", "SILVER", "BRONZE")
#: Colour, opacity and initial visibility of each tier's layer.
STYLES = {"GOLD": ("#FFD700", 0.7, True), "SILVER": ("#C0C0C0", 0.6, True), "BRONZE": ("#CD7F32", 0.5, False)}


def stem(name: Column, mark: str = "_mc") -> Column:
    """A field of view's name: every occurrence of the mark goes, not a suffix alone."""
    return F.replace(name, F.lit(mark), F.lit(""))


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int")


def tier_style(tier: Column) -> Column:
    """Struct of colour, opacity and visibility; null for an unknown tier."""
    out = F.lit(None).cast("struct<colour:string,opacity:double,visible:boolean>")
    for name, (colour, opacity, visible) in STYLES.items():
        out = F.when(F.upper(tier) == name, F.struct(F.lit(colour).alias("colour"), F.lit(opacity).alias("opacity"), F.lit(visible).alias("visible"))).otherwise(out)
    return out


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def align_offset(have: Column, want: Column) -> Column:
    """Shift of a coordinate when a frame is cropped or padded about its centre."""
    zero = F.lit(0)
    crop = F.floor(F.greatest(zero, have - want) / 2).cast("int")
    pad = F.floor(F.greatest(zero, want - have) / 2).cast("int")
    return pad - crop


def rescaled(v: Column, low: Column, high: Column, rule: str) -> Column:
    """Percentile stretch.  ``unit``: at least 1e-6 between the ends; ``coarse``: at least
    1; ``uint16``: 1e-8 added, then 16-bit steps cut toward zero."""
    if rule == "uint16":
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low + F.lit(1e-8))))
        return (part * 65535).cast("int")
    span = F.greatest(high - low, F.lit(1e-6 if rule == "unit" else 1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / span))


def half_up(v: Column, places: int) -> Column:
    """Rounded half up; what is within a millionth of a step of a tie counts as one, so a
    mean does not depend on the order in which its values were added."""
    unit = F.lit(10.0**places)
    return F.floor(v * unit + F.lit(0.5 + 1e-6)).cast("double") / unit


#: The colour scale from red over yellow to green at 0, 1/2 and 1.
SCALE = ((0.843, 0.188, 0.153), (1.0, 1.0, 0.749), (0.102, 0.596, 0.314))


def probability_colour(label: Column, probability: Column) -> Column:
    """RGBA of a region's probability, linear between three stops; label 0 is clear."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability))
    low, mid, high = SCALE
    part = lambda k: F.when(p < 0.5, F.lit(low[k]) + (mid[k] - low[k]) * 2 * p).otherwise(F.lit(mid[k]) + (high[k] - mid[k]) * (2 * p - 1))
    rgba = F.array(*[part(k) for k in range(3)], F.lit(1.0))
    return F.when(label > 0, rgba).otherwise(F.array(*[F.lit(0.0)] * 4))


#: Red, green, blue and opacity of refined outlines by tier.
OUTLINES = {"GOLD": (1.0, 0.843, 0.0, 0.7), "SILVER": (0.0, 0.749, 1.0, 0.7), "BRONZE": (1.0, 0.388, 0.278, 0.7)}


def tier_colour(tier: Column) -> Column:
    """RGBA of a tier's refined outlines; null for an unknown tier."""
    out = F.lit(None).cast("array<double>")
    for name, rgba in OUTLINES.items():
        out = F.when(F.upper(tier) == name, F.array(*map(F.lit, rgba))).otherwise(out)
    return out
