"""Erosion, dilation, surfaces and distances of sparse masks, as stencils on tiles and separable distances."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import tiles
from voxelweave.operators.grids import Spacing, within
from voxelweave.operators.masks import GROUP

CROSS = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
CUBE = [o for o in product((-1, 0, 1), repeat=3) if any(o)]


def reach_of(offsets: list[tiles.Offset], rounds: int | Column = 1) -> tuple[int | Column, ...]:
    """How far the offsets go along each axis."""
    if isinstance(rounds, Column):
        return tuple(rounds * far for far in reach_of(offsets))
    return tuple(rounds * max((abs(o[k]) for o in offsets), default=0) for k in range(3))


def shell(voxels: DataFrame, offsets: list[tiles.Offset] = CROSS, group: list[str] = GROUP) -> DataFrame:
    """Background voxels beside the mask."""
    return tiles.stencil(voxels, group, reach_of(offsets), lambda v, *_: tiles.dilated(v, offsets) & ~v)


def surface(voxels: DataFrame, offsets: list[tiles.Offset] = CUBE, group: list[str] = GROUP) -> DataFrame:
    """Mask voxels that have a background neighbour."""
    return tiles.stencil(voxels, group, reach_of(offsets), lambda v, *_: v & ~tiles.eroded(v, offsets))


def background_distance(voxels: DataFrame, most: float, spacing: Spacing, group: list[str] = GROUP) -> DataFrame:
    """Squared distance in mm of each voxel to the background, null where it is over `most`."""

    def work(v: np.ndarray, reach: tiles.Offset, spacing: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        d = tiles.to_empty(v, spacing, reach)
        return v, np.where(d <= most * most, d, np.nan)

    return tiles.stencil(voxels, group, within(most, spacing), work, "d2", spacing)


def erode_mm(voxels: DataFrame, mm: float, spacing: Spacing, group: list[str] = GROUP) -> DataFrame:
    """Voxels at least `mm` away from the background."""
    return tiles.stencil(voxels, group, within(mm, spacing), lambda v, reach, mine: v & (tiles.to_empty(v, mine, reach) >= mm * mm), spacing=spacing)


def erode(voxels: DataFrame, rounds: int | Column = 1, offsets: list[tiles.Offset] = CROSS, group: list[str] = GROUP) -> DataFrame:
    """`rounds` erosions by the neighbourhood that the offsets make; all around the mask is background. One shuffle.

    Rounds that are a column may differ by group.
    """
    far = max(reach_of(offsets))
    return tiles.stencil(voxels, group, reach_of(offsets, rounds), lambda v, reach, _: tiles.eroded(v, offsets, max(reach) // far))


def dilate(voxels: DataFrame, rounds: int | Column = 1, dims: tuple | None = None, group: list[str] = GROUP, offsets: list[tiles.Offset] = CROSS) -> DataFrame:
    """`rounds` dilations by the cross, or by other offsets; clipped to the grid if its size is given. One shuffle."""
    far = max(reach_of(offsets))
    out = tiles.stencil(voxels, group, reach_of(offsets, rounds), lambda v, reach, _: tiles.dilated(v, offsets, max(reach) // far))
    for a, n in zip("xyz", dims or ()):
        out = out.where(F.col(a).between(0, n - 1))
    return out


def dilate_disc(voxels: DataFrame, mm: float, spacing: tuple[float, ...] | None, group: list[str] = GROUP) -> DataFrame:
    """Dilation of each slice by a disc of a radius in mm: the pixels whose distance to the mask, taken axis by axis, is within it."""

    def work(v: np.ndarray, reach: tiles.Offset, mine: tuple[float, ...]) -> np.ndarray:
        return tiles.to_empty(~v, (*mine[:2], 1.0), (*reach[:2], 0)) <= mm * mm

    return tiles.stencil(voxels, group, (*within(mm, spacing)[:2], 0), work, spacing=spacing)


def erosion_profile(voxels: DataFrame, value: str, steps: list[float], spacing: Spacing, group: list[str] = GROUP) -> DataFrame:
    """Count, mean and deviation of a value in the mask eroded by each of the steps: one distance, several cuts."""
    d = background_distance(voxels, max(steps), spacing, group).join(voxels.select(*group, "x", "y", "z", value).hint("merge"), [*group, "x", "y", "z"])
    each = d.withColumn("step", F.explode(F.array(*[F.lit(float(s)) for s in steps]))).where("d2 is null or d2 >= step * step")
    return each.groupBy(*group, "step").agg(F.count("*").alias("n_voxels"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def nearest(points: DataFrame, others: DataFrame, spacing: Spacing, group: list[str], most: float) -> DataFrame:
    """Distance in mm of each point to the nearest of the others in its group.

    Points farther than `most` from any other, or in a group without others, are left out.
    """
    return tiles.distance_to(points, others, spacing, group).where(F.col("distance") <= most)


def lateralize(points: DataFrame, left: DataFrame, right: DataFrame, spacing: Spacing, group: list[str], by: str, most: float, gap: float = 5.0) -> DataFrame:
    """left, right or indeterminate for each `by`: the nearer side by the tenth percentile of surface distances, if `gap` mm apart."""
    sides = [nearest(points, side.select(*group, "x", "y", "z"), spacing, group, most).groupBy(*group, by).agg(F.percentile("distance", 0.1).alias(n)) for side, n in ((left, "d_left"), (right, "d_right"))]
    both = sides[0].join(sides[1].hint("merge"), [*group, by], "full")
    side = F.when(F.col("d_left").isNull() & F.col("d_right").isNull(), "indeterminate").when(F.coalesce(F.abs(F.col("d_left") - F.col("d_right")) < gap, F.lit(False)), "indeterminate")
    return both.withColumn("side", side.when(F.col("d_right").isNull() | (F.col("d_left") < F.col("d_right")), "left").otherwise("right"))
