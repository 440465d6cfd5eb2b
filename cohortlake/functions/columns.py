"""Scalar expressions that several operators share; all built in, no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    part = part if isinstance(part, Column) else F.lit(part)
    return F.coalesce(part.cast("string"), F.lit("None"))


def keyed_uniform(*parts) -> Column:
    """A draw in [0, 1) that depends on the parts alone, so not on partitioning."""
    digest = F.sha2(F.concat_ws("|", *map(_text, parts)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stable_rank(seed: int, *parts) -> Column:
    return F.sha2(F.concat_ws("\x1f", *map(_text, (seed, *parts))), 256)


def stable_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *map(_text, parts)), 256), 1, 24)


def clipped_sigmoid(logit: Column, temperature: Column | float = 1.0) -> Column:
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit / temperature))
    return 1.0 / (1.0 + F.exp(-z))


def clipped_logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return F.ln(q / (1.0 - q))


def bin_of(p: Column, bins: int = 10) -> Column:
    """Equal-width bin of [0, 1], right-open but for the last, by literal edges.

    The edges are i * (1 / bins) in doubles, which is not the decimal value for some i.
    """
    step = 1.0 / bins
    return sum((F.when(p >= F.lit(i * step), 1).otherwise(0) for i in range(1, bins)), F.lit(0))


def missing(c: Column) -> Column:
    """Null or one of the tokens that stand for a missing id."""
    return c.isNull() | c.isin("", "nan", "<NA>", "None")


def box_from_center(cy: Column, cx: Column, size: int, h: Column, w: Column) -> Column:
    """A square box moved inside the frame, end-exclusive; null in a smaller frame."""
    y0 = F.least(F.greatest(cy - size // 2, F.lit(0)), h - size)
    x0 = F.least(F.greatest(cx - size // 2, F.lit(0)), w - size)
    box = F.struct(y0.alias("y0"), x0.alias("x0"), (y0 + size).alias("y1"), (x0 + size).alias("x1"))
    return F.when((h >= size) & (w >= size), box)


def r6(c: Column) -> Column:
    return F.round(c, 6)
