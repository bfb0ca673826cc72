"""Geometric distortion from lookup grids: corrected positions, magnitude corrections and Jacobians."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Grid:
    """Corrected x and y and a magnitude correction on every pixel of a chip; positions between pixels are read bilinearly."""

    def __init__(self, x: np.ndarray, y: np.ndarray, mag: np.ndarray | None = None):
        self.x, self.y, self.mag = x, y, np.zeros_like(x) if mag is None else mag

    def _read(self, grid: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float) -> np.ndarray:
        h, w = grid.shape
        with np.errstate(invalid="ignore"):
            inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
        i, j = (np.clip(np.floor(np.where(inside, v, 0)), 0, n - 2).astype(int) for v, n in ((x, w), (y, h)))
        u, v = x - i, y - j
        out = grid[j, i] * (1 - u) * (1 - v) + grid[j, i + 1] * u * (1 - v) + grid[j + 1, i] * (1 - u) * v + grid[j + 1, i + 1] * u * v
        return np.where(inside, out, outside)

    def apply(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected position (NaN outside the chip) and magnitude correction (0 outside)."""
        return self._read(self.x, x, y, np.nan), self._read(self.y, x, y, np.nan), self._read(self.mag, x, y, 0.0)

    def jacobian(self, x: np.ndarray, y: np.ndarray, step: float = 0.1) -> tuple[np.ndarray, ...]:
        """dX/dx, dX/dy, dY/dx, dY/dy by central differences."""
        a, b = self.apply(x + step, y), self.apply(x - step, y)
        c, d = self.apply(x, y + step), self.apply(x, y - step)
        return tuple((p[k] - q[k]) / (2 * step) for k in (0, 1) for p, q in ((a, b), (c, d)))


def correct(df: DataFrame, grids: dict[str, Grid], key: str = "chip") -> DataFrame:
    """df (key, x, y, mag, cov_xx, cov_xy, cov_yy and others) with x_gdc, y_gdc, mag_gdc and the covariance carried along; null where the position lies outside. The grids, one per chip, are broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(grids)
    new = ("x_gdc", "y_gdc", "mag_gdc", "cov_xx_gdc", "cov_xy_gdc", "cov_yy_gdc")
    names = df.columns

    def run(batches):
        for b in batches:
            c = {k: b.column(names.index(k)).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y", "mag", "cov_xx", "cov_xy", "cov_yy")}
            keys = np.array(b.column(names.index(key)).to_pylist(), object)
            out = np.full((6, b.num_rows), np.nan)
            for k, g in sent.value.items():
                on = np.flatnonzero(keys == k)
                x, y = c["x"][on], c["y"][on]
                gx, gy, gm = g.apply(x, y)
                p, q, s, t = g.jacobian(x, y)
                xx, xy, yy = c["cov_xx"][on], c["cov_xy"][on], c["cov_yy"][on]
                out[:, on] = gx, gy, c["mag"][on] + gm, p * p * xx + 2 * p * q * xy + q * q * yy, p * s * xx + (p * t + q * s) * xy + q * t * yy, s * s * xx + 2 * s * t * xy + t * t * yy
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(o, pa.float64(), from_pandas=True) for o in out]], [*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + ", ".join(f"{n} double" for n in new)
    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
