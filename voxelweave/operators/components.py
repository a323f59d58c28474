"""Connected components of sparse masks: tiles are labelled alone, then their parts are joined over the cluster."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.operators import tiles
from voxelweave.operators.grids import steps
from voxelweave.operators.graph import connected_components
from voxelweave.operators.masks import GROUP
from voxelweave.session import cut


def label_runs(voxels: DataFrame, group: list[str] = GROUP, planar: bool = False, corners: bool = True) -> DataFrame:
    """Runs along x with the component they are in; the component's name is the smallest id of its voxels that tiles share.

    With `corners` voxels that share a corner are joined (26 neighbours, 8 in a plane), else only those that share a
    face. `planar` labels every slice by itself. Tiles are labelled alone first, so the graph that is contracted over the
    cluster has the tiles' parts as nodes, not the voxels; one giant mask spreads over its tiles. Runs end at the edge of a
    tile. Repeated voxels count once.
    """
    near = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and (corners or sum(map(abs, o)) == 1) and not (planar and o[2])]
    both = cut(tiles.labelled_runs(voxels, group, near, planar))
    parts = connected_components(both.where("dst is not null"))
    runs = both.where("dst is null").drop("dst")
    return runs.join(parts.withColumnRenamed("node", "src").hint("merge"), "src", "left").withColumn("component", F.coalesce("component", "src")).drop("src")


def describe(labelled: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Each component's number in raster order of its first voxel, voxel count, bounds and centroid."""
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    mid = (F.col("x0") + F.col("x1")) / 2
    got = labelled.groupBy(*group, "component").agg(
        F.sum(n).alias("n_voxels"), F.min(F.struct("x0", "y", "z")).alias("_first"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
        (F.sum(mid * n) / F.sum(n)).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"), (F.sum(F.col("z") * n) / F.sum(n)).alias("cz"),
    )
    return got.withColumn("label", F.row_number().over(W.partitionBy(*group).orderBy("_first"))).drop("_first")


def largest(described: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """The largest component of each group; the lowest label wins a tie."""
    w = W.partitionBy(*group).orderBy(F.col("n_voxels").desc(), "label")
    return described.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def largest_in_slice(described: DataFrame, group: list[str]) -> DataFrame:
    """The largest component of each slice (z is in the group); of equals that whose middle is nearest to the middle of all, then the lowest label."""
    all_of = W.partitionBy(*group)
    mid = [F.sum(F.col(f"c{a}") * F.col("n_voxels")).over(all_of) / F.sum("n_voxels").over(all_of) for a in "xy"]
    far = F.round(F.sqrt((F.col("cx") - F.col("_mx")) ** 2 + (F.col("cy") - F.col("_my")) ** 2), 9)
    rows = described.withColumns({"_mx": mid[0], "_my": mid[1]})
    rows = rows.withColumn("_r", F.row_number().over(all_of.orderBy(F.col("n_voxels").desc(), far, "label")))
    return rows.where("_r = 1").drop("_r", "_mx", "_my")


def ranked(described: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Components numbered by size, then by slice."""
    w = W.partitionBy(*group).orderBy(F.col("n_voxels").desc(), "z_min", "label")
    return described.withColumn("rank", F.row_number().over(w))


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of (n, 2) points."""
    pts = np.unique(points, axis=0).tolist()
    if len(pts) < 3:
        return np.array(pts)
    sides = []
    for line in (pts, pts[::-1]):
        side: list[list[float]] = []
        for p in line:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides)


def feret_axial(labelled: DataFrame, spacing: tuple[float, ...] | None, group: list[str] = GROUP) -> DataFrame:
    """The largest in-slice diameter in mm of each component.

    The outline runs through the middles between pixels in and out. Only hull corners of a slice's part are compared, and
    of a row only its outermost points, with the pixels of the first and last row, can be such.
    """
    sx, sy = steps(spacing)[:2]
    rows = labelled.groupBy(*group, "component", "z", "y").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    parts = rows.groupBy(*group, "component", "z").agg(F.array_sort(F.collect_list(F.struct("y", "lo", "hi"))).alias("rows"))

    @F.pandas_udf("double")
    def diameter(slices: pd.Series, wide: pd.Series, deep: pd.Series) -> pd.Series:
        out = []
        for part, sx, sy in zip(slices, wide, deep):
            r = np.array([[x["y"], x["lo"], x["hi"]] for x in part], float)
            y, lo, hi = r.T
            pts = [np.stack([lo - 0.5, y], 1), np.stack([hi + 0.5, y], 1)]
            pts += [np.array([[lo[k], y[k] + d], [hi[k], y[k] + d]]) for k, d in ((0, -0.5), (-1, 0.5))]
            corners = hull(np.concatenate(pts) * [sx, sy])
            out.append(float(np.sqrt(((corners[:, None] - corners[None]) ** 2).sum(axis=2)).max()))
        return pd.Series(out, dtype=float)

    return parts.select(*group, "component", diameter("rows", sx, sy).alias("d")).groupBy(*group, "component").agg(F.max("d").alias("diameter_mm"))
