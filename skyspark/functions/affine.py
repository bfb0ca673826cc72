"""Affine transformations as columns."""

from __future__ import annotations

from pyspark.sql import Column

from skyspark.functions.sky import lit


def apply(x, y, a, b, c, d, xs, ys, xt, yt) -> tuple[Column, Column]:
    """Position after (a b; c d) about (xs, ys), carried to (xt, yt)."""
    dx, dy = lit(x) - lit(xs), lit(y) - lit(ys)
    return lit(xt) + lit(a) * dx + lit(b) * dy, lit(yt) + lit(c) * dx + lit(d) * dy
