"""Principal axes and extents of point sets; the 3 x 3 eigenvectors are the only Python, one row a component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType

from voxelweave.operators.grids import Spacing, steps
from voxelweave.operators.masks import GROUP


@F.pandas_udf(ArrayType(DoubleType()))
def principal_axes(cov: pd.Series) -> pd.Series:
    """Row-major eigenvectors of symmetric 3 x 3 matrices (xx, xy, xz, yy, yz, zz), longest axis first."""
    m = np.array([[[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]] for c in cov]).reshape(-1, 3, 3)
    if not len(m):
        return pd.Series([], dtype=object)
    _, v = np.linalg.eigh(m)
    return pd.Series(list(v[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9)))


def moments(points: DataFrame, group: list[str], spacing: Spacing) -> DataFrame:
    """Centre and covariance in mm of each group's points, as one aggregate."""
    m = [F.col(a) * s for a, s in zip("xyz", steps(spacing))]
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    return points.groupBy(*group).agg(F.count("*").alias("n_points"), F.array(*[F.avg(c) for c in m]).alias("centre"), F.array(*[F.covar_pop(m[i], m[j]) for i, j in pairs]).alias("cov"))


def pca_extent(points: DataFrame, group: list[str] = GROUP, spacing: Spacing = (1.0, 1.0, 1.0)) -> DataFrame:
    """Extents in mm along the three principal axes of each group's points, longest variance first."""
    stats = moments(points, group, spacing).withColumn("axes", principal_axes("cov"))
    both = points.join(stats.hint("merge"), group)
    proj = []
    for k in range(3):
        p = F.lit(0.0)
        for i, (a, s) in enumerate(zip("xyz", steps(spacing))):
            p = p + (F.col(a) * s - F.get("centre", F.lit(i))) * F.get("axes", F.lit(3 * k + i))
        proj.append((F.max(p) - F.min(p)).alias(f"extent_{k + 1}"))
    return both.groupBy(*group).agg(F.count("*").alias("n_points"), *proj)


def inplane_rotation(points: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Angle in degrees of the main axis of each group's points in the x, y plane, in closed form.

    Of voxel indices the moments are taken as whole numbers, times the square of their number, which turns no angle: a round shape
    has no axis and 0 degrees, where rounding would give it one by chance.
    """
    if all(isinstance(points.schema[a].dataType, IntegralType) for a in "xy"):
        x, y = (F.col(a).cast("bigint") for a in "xy")
        sums = points.groupBy(*group).agg(*[c.cast("decimal(19,0)").alias(n) for n, c in (("n", F.count("*")), ("sx", F.sum(x)), ("sy", F.sum(y)), ("sxx", F.sum(x * x)), ("syy", F.sum(y * y)), ("sxy", F.sum(x * y)))])
        whole = lambda ab, a, b: F.col("n") * F.col(ab) - F.col(a) * F.col(b)
        got = sums.select(*group, (whole("sxx", "sx", "sx") - whole("syy", "sy", "sy")).cast("double").alias("apart"), whole("sxy", "sx", "sy").cast("double").alias("xy"))
    else:
        got = points.groupBy(*group).agg((F.var_pop("x") - F.var_pop("y")).alias("apart"), F.covar_pop("x", "y").alias("xy"))
    return got.select(*group, F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("apart"))).alias("angle"))


def infer_axes(bounds: DataFrame, spacing: Spacing) -> DataFrame:
    """The axis with the longest span and, of the other two, the shorter one."""
    s = [(F.col(f"{a}_max") - F.col(f"{a}_min") + 1) * m for a, m in zip("xyz", steps(spacing))]
    top = F.greatest(*s)
    si = F.when(s[0] == top, 0).when(s[1] == top, 1).otherwise(2)
    ap = F.when(si == 0, F.when(s[1] <= s[2], 1).otherwise(2)).when(si == 1, F.when(s[0] <= s[2], 0).otherwise(2)).otherwise(F.when(s[0] <= s[1], 0).otherwise(1))
    return bounds.withColumns({"si_axis": si, "ap_axis": ap})
