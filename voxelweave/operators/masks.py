"""Statistics, extents and set operations of sparse label masks, stored as voxels or as runs along x.

Frames have one row a voxel: the group columns (by default study and mask) and x, y, z. A whole volume is never
expanded; work is keyed by group, and within a group by slice, so a giant mask spreads over slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["study", "mask"]


def mask_stats(voxels: DataFrame, group: list[str] = GROUP, value: str = "hu") -> DataFrame:
    """Voxel count, mean and population deviation of a value."""
    return voxels.groupBy(*group).agg(F.count("*").alias("n_voxels"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def bounds(voxels: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """First and last occupied index of each axis, and the voxel count."""
    return voxels.groupBy(*group).agg(*[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))], F.count("*").alias("n_voxels"))


def touched(frame: DataFrame, dims: tuple[int, int, int]) -> Column:
    """The faces of the grid that a mask's bounds reach, in axis order."""
    faces = []
    for a, n in zip("xyz", dims):
        faces += [F.when(frame[f"{a}_min"] <= 0, F.lit(f"{a}_min")), F.when(frame[f"{a}_max"] >= n - 1, F.lit(f"{a}_max"))]
    return F.filter(F.array(*faces), lambda f: f.isNotNull())


def mask_status(voxels: DataFrame, expected: DataFrame, dims: tuple[int, int, int], voxel_cm3: float, group: list[str] = GROUP) -> DataFrame:
    """missing, truncated or complete for each expected mask, with its bounds, the borders it touches and its volume."""
    b = bounds(voxels, group)
    b = b.withColumn("borders", touched(b, dims))
    on = [expected[g].eqNullSafe(b[g]) for g in group]
    both = expected.join(b.hint("merge"), on, "left").select(*[expected[g] for g in group], "n_voxels", "borders")
    status = F.when(F.col("n_voxels").isNull(), "missing").when(F.size("borders") > 0, "truncated").otherwise("complete")
    return both.select(*group, status.alias("status"), F.coalesce("n_voxels", F.lit(0)).alias("n_voxels"), (F.coalesce("n_voxels", F.lit(0)) * voxel_cm3).alias("cm3"), F.coalesce(F.array_join("borders", ","), F.lit("")).alias("borders"))


def status_set(status: DataFrame, group: list[str], mask: str = "mask") -> DataFrame:
    """Per group the masks that are missing and incomplete, and whether all are complete."""
    named = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col(mask)))), ",")
    return status.groupBy(*group).agg(named("missing").alias("missing"), named("truncated").alias("incomplete"), F.bool_and(F.col("status") == "complete").alias("all_complete"))


def file_status(status: DataFrame, files: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """mask_status() told apart by what files there are: missing without one, invalid where its shape is not that of the volume, empty where it has no voxel.

    files has the group columns and `valid`, one row a mask file; several count as one, valid if all are.
    """
    f = files.groupBy(*group).agg(F.bool_and("valid").alias("_valid"))
    both = status.join(f.hint("merge"), group, "left")
    told = F.when(F.col("_valid").isNull(), "missing").when(~F.col("_valid"), "invalid").when(F.col("status") == "missing", "empty").otherwise(F.col("status"))
    return both.withColumn("status", told).drop("_valid")


def file_status_set(status: DataFrame, group: list[str], mask: str = "mask") -> DataFrame:
    """Per group the masks that are missing, invalid, empty and incomplete, and whether all are complete."""
    named = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col(mask)))), ",")
    return status.groupBy(*group).agg(*[named(s).alias(n) for s, n in (("missing", "missing"), ("invalid", "invalid"), ("empty", "empty"), ("truncated", "incomplete"))], F.bool_and(F.col("status") == "complete").alias("all_complete"))


def axial_extent(voxels: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """First and last occupied slice, and the middle of the occupied slices (element n div 2 of their sorted list)."""
    slices = voxels.select(*group, "z").distinct()
    got = slices.groupBy(*group).agg(F.min("z").alias("first_z"), F.max("z").alias("last_z"), F.array_sort(F.collect_list("z")).alias("_z"))
    return got.select(*group, "first_z", "last_z", F.get("_z", F.floor(F.size("_z") / 2).cast("int")).alias("center_z"))


def anatomy_states(voxels: DataFrame, labels: DataFrame, dims: tuple[int, int, int], group: list[str] = GROUP) -> DataFrame:
    """State of each listed label: anatomy_not_detected, anatomy_truncated or anatomy_complete."""
    s = mask_status(voxels, labels, dims, 1.0, group)
    state = F.when(F.col("status") == "missing", "anatomy_not_detected").when(F.col("status") == "truncated", "anatomy_truncated").otherwise("anatomy_complete")
    return s.select(*group, state.alias("state"), "borders")


def inventory(states: DataFrame, group: list[str], key: str, members: dict[str, list]) -> DataFrame:
    """Presence and completeness flags of named sets of masks."""
    there, whole = F.col("state") != "anatomy_not_detected", F.col("state") == "anatomy_complete"
    cols = []
    for name, keys in members.items():
        mine = F.col(key).isin(keys)
        cols += [F.coalesce(F.bool_or(F.when(mine, there)), F.lit(False)).alias(f"{name}_present"), F.coalesce(F.bool_and(F.when(mine, whole)), F.lit(False)).alias(f"{name}_complete")]
    return states.groupBy(*group).agg(*cols)


def coverage_class(flags: DataFrame, chest: Column, abdomen: Column, partial: Column) -> DataFrame:
    """chest_abdomen, chest_only, abdomen_only, partial or unknown."""
    name = F.when(chest & abdomen, "chest_abdomen").when(chest, "chest_only").when(abdomen, "abdomen_only").when(partial, "partial").otherwise("unknown")
    return flags.withColumn("coverage", name)


def slice_area(voxels: DataFrame, pixel_cm2: float, group: list[str] = GROUP) -> DataFrame:
    """Pixels and area of each mask on each slice."""
    return voxels.groupBy(*group, "z").agg(F.count("*").alias("n_pixels"), (F.count("*") * pixel_cm2).alias("cm2"))


def area_ratio(areas: DataFrame, by: list[str], mask: str, one: str, other: str) -> DataFrame:
    """Ratio of two masks' areas on a slice, four digits; null where the second is not there."""
    of = lambda m: F.sum(F.when(F.col(mask) == m, F.col("cm2")))
    got = areas.groupBy(*by).agg(of(one).alias("_a"), of(other).alias("_b"))
    return got.select(*by, F.round(F.try_divide(F.coalesce("_a", F.lit(0.0)), F.col("_b")), 4).alias("ratio"))


def runs(voxels: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Voxels as runs x0..x1 of a row: gaps and islands along x, one window a row of a slice."""
    v = voxels.select(*group, "y", "z", "x").distinct()
    island = F.col("x") - F.row_number().over(W.partitionBy(*group, "z", "y").orderBy("x"))
    return v.withColumn("_i", island).groupBy(*group, "z", "y", "_i").agg(F.min("x").cast("int").alias("x0"), F.max("x").cast("int").alias("x1")).drop("_i")


def merged_runs(all_runs: DataFrame, group: list[str]) -> DataFrame:
    """The union of runs of several masks: overlapping and touching runs of a row become one."""
    row = W.partitionBy(*group, "z", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col("x0") > reach + 1, F.lit(True)), 1).otherwise(0)
    part = F.sum("_new").over(row)
    out = all_runs.withColumn("_new", fresh).withColumn("_part", part)
    return out.groupBy(*group, "z", "y", "_part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_part")


def overlap(a: DataFrame, b: DataFrame, group: list[str], of: str) -> DataFrame:
    """Voxels of each `of` in a's runs, and how many of them b's runs hold; b's runs must not overlap each other."""
    key = [*group, "z", "y"]
    other = b.select(*key, F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    both = a.join(other.hint("merge"), key).where("_b0 <= x1 and x0 <= _b1")
    inside = both.groupBy(*group, of).agg(F.sum(F.least("x1", "_b1") - F.greatest("x0", "_b0") + 1).alias("inside"))
    total = a.groupBy(*group, of).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n_voxels"))
    out = total.join(inside.hint("merge"), [*group, of], "left").withColumn("inside", F.coalesce("inside", F.lit(0).cast("bigint")))
    return out.withColumn("fraction", F.col("inside") / F.col("n_voxels"))


def minus(a: DataFrame, b: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Voxels of a that b does not have."""
    return a.join(b.select(*group, "x", "y", "z").hint("merge"), [*group, "x", "y", "z"], "left_anti")


def projection_any(voxels: DataFrame, low: int, high: int, group: list[str] = GROUP) -> DataFrame:
    """The (x, y) that are occupied anywhere in a window of slices."""
    return voxels.where(F.col("z").between(low, high)).select(*group, "x", "y").distinct()


def slab_project(voxels: DataFrame, thickness: int, value: str, group: list[str] = ["study"]) -> DataFrame:
    """Mean value of each column of a slab."""
    slab = F.floor(F.col("z") / thickness).cast("int")
    return voxels.groupBy(*group, "x", "y", slab.alias("slab")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def centered_slab(center: Column, n: Column, size: int) -> Column:
    """struct(first, last) of an odd number of slices around a centre, shifted at the ends of the volume."""
    first = F.greatest(F.lit(0), F.least(center - size // 2, n - size))
    return F.struct(first.alias("first"), F.least(n - 1, first + size - 1).alias("last"))


def slab_assign(slices: DataFrame, group: list[str], position: str, thickness: float) -> DataFrame:
    """Slices to slabs of a thickness: those within half of it from a slab's centre (ends included, so a slice may be in two), else the nearest.

    Slabs start at the group's lowest position. A slice can only be in the slab that it lies in or the one before, so
    two candidates a slice stand in for a range join. The slice nearest to an empty slab is the one before or after its
    centre in the order of positions.
    """
    base = slices.groupBy(*group).agg(F.min(position).alias("_p0"), F.max(position).alias("_p1"))
    s = slices.join(base.hint("merge"), group)
    k = F.floor((F.col(position) - F.col("_p0")) / thickness).cast("int")
    each = s.withColumn("slab", F.explode(F.array(k, k - 1)))
    centre = F.col("_p0") + (F.col("slab") + 0.5) * thickness
    each = each.where((F.col("slab") >= 0) & (F.col("slab") <= F.floor((F.col("_p1") - F.col("_p0")) / thickness)) & (F.abs(F.col(position) - centre) <= thickness / 2))
    inside = each.select(*group, position, "slab").distinct()
    slabs = base.select(*group, "_p0", F.explode(F.sequence(F.lit(0), F.floor((F.col("_p1") - F.col("_p0")) / thickness).cast("int"))).alias("slab"))
    empty = slabs.join(inside.select(*group, "slab").distinct().hint("merge"), [*group, "slab"], "left_anti")
    centre = F.col("_p0") + (F.col("slab") + 0.5) * thickness
    places = slices.select(*group, F.col(position).alias("_at"), F.col(position).alias("_slice"), F.lit(None).cast("int").alias("slab"))
    places = places.unionByName(empty.select(*group, centre.alias("_at"), F.lit(None).cast(slices.schema[position].dataType).alias("_slice"), "slab"))
    w = W.partitionBy(*group).orderBy("_at")
    low = F.last("_slice", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    high = F.first("_slice", ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    near = places.withColumns({"_low": low, "_high": high}).where("slab is not null")
    nearer = F.when(F.col("_low").isNull() | (F.abs(F.col("_high") - F.col("_at")) < F.abs(F.col("_low") - F.col("_at"))), F.col("_high")).otherwise(F.col("_low"))
    return inside.unionByName(near.select(*group, nearer.alias(position), "slab"))


def slab_volumes(voxels: DataFrame, slabs: DataFrame, group: list[str], label: str, voxel_cm3: float) -> DataFrame:
    """Voxels and volume of each labelled slab (first, last, ends included); a slab without voxels has none."""
    per_slice = voxels.groupBy(*group, "z").agg(F.count("*").alias("n"))
    span = slabs.withColumn("z", F.explode(F.sequence("first", "last")))
    got = span.join(per_slice.hint("merge"), [*group, "z"], "left").groupBy(*group, label).agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_voxels"))
    return got.withColumn("cm3", F.round(F.col("n_voxels") * voxel_cm3, 2))
