"""Fat volumes by vertebral level: slabs between the levels' middles or the levels' own extents, and the block of levels that counts.

`tables` has voxels (study, mask, x, y, z) and maybe volumes. cfg names the masks `subcutaneous` and `torso` and lists the
`levels` in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.operators import windows
from voxelweave.operators.grids import Grid


def level_extents(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """study, level, ordinal, first and last slice of each level's mask, and whether it ends before the first and last slice of the volume."""
    g = Grid.of(t, cfg)
    e = t["voxels"].where(F.col("mask").isin(cfg["levels"])).groupBy("study", F.col("mask").alias("level")).agg(F.min("z").alias("first"), F.max("z").alias("last"))
    place = F.array_position(F.array(*[F.lit(x) for x in cfg["levels"]]), F.col("level")).cast("int") - 1
    e = g.on(e).withColumn("n_slices", g.n_slices if isinstance(g.n_slices, Column) else F.lit(g.n_slices))
    return e.select("study", "level", place.alias("ordinal"), "first", "last", ((F.col("first") > 0) & (F.col("last") < F.col("n_slices") - 1)).alias("complete"), "n_slices")


def abdominal_slabs(extents: DataFrame, levels: list[str]) -> DataFrame:
    """The slab of each level (start, end, ends included), and whether all levels are there (coverage_complete).

    With all levels a slab ends halfway to its neighbours, and as far out at the ends; else each level has its own extent.
    """
    w = W.partitionBy("study").orderBy("ordinal")
    e = extents.withColumn("center", (F.col("first") + F.col("last")) / 2.0)
    e = e.withColumns({"_b": F.lag("center").over(w), "_a": F.lead("center").over(w), "coverage_complete": F.count("*").over(W.partitionBy("study")) == len(levels)})
    c, b, a = F.col("center"), F.col("_b"), F.col("_a")
    alone = F.bround(c)
    start = F.greatest(F.lit(0), F.when(b.isNotNull(), F.floor((b + c) / 2.0)).when(a.isNotNull(), F.floor(c - (a - c) / 2.0)).otherwise(alone).cast("int"))
    end = F.least(F.col("n_slices") - 1, F.when(a.isNotNull(), F.ceil((c + a) / 2.0) - 1).when(b.isNotNull(), F.ceil(c + (c - b) / 2.0)).otherwise(alone).cast("int"))
    whole = F.col("coverage_complete")
    e = e.withColumn("start", F.when(whole, start).otherwise(F.col("first"))).withColumn("end", F.when(whole, F.greatest("start", end)).otherwise(F.col("last")))
    return e.select("study", "level", "ordinal", "start", "end", F.when(whole, "centroid_midpoint").otherwise("mask_extent_fallback").alias("strategy"), "coverage_complete")


def fat_of_slabs(t: dict[str, DataFrame], cfg: dict, slabs: DataFrame, by: list[str]) -> DataFrame:
    """Voxels and volume (three digits) of both masks in each slab (start, end) of `by`, and the ratio to four digits."""
    g = Grid.of(t, cfg)
    n = [F.count_if(F.col("mask") == cfg[k]).alias(f"_{k}") for k in ("subcutaneous", "torso")]
    per = t["voxels"].where(F.col("mask").isin(cfg["subcutaneous"], cfg["torso"])).groupBy("study", "z").agg(*n)
    each = slabs.select(*by, "start", "end", F.explode(F.sequence("start", "end")).alias("z")).join(per.hint("merge"), ["study", "z"], "left")
    got = each.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(f"{k}_voxels") for k in ("subcutaneous", "torso")])
    got = g.on(got).withColumns({f"{k}_cm3": F.round(F.col(f"{k}_voxels") * g.cm3, 3) for k in ("subcutaneous", "torso")}).drop(*g.keys)
    return got.withColumn("ratio", F.round(F.try_divide("torso_cm3", F.nullif("subcutaneous_cm3", F.lit(0.0))), 4))


def fat_distribution(t: dict[str, DataFrame], cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(levels, studies): both masks' volumes in each level's slab, and their sums by study with what is missing."""
    slabs = abdominal_slabs(level_extents(t, cfg), cfg["levels"])
    levels = fat_of_slabs(t, cfg, slabs, ["study", "level", "ordinal"]).join(slabs.select("study", "level", "strategy", "coverage_complete").hint("merge"), ["study", "level"])
    every = F.array(*[F.lit(x) for x in cfg["levels"]])
    s = levels.groupBy("study").agg(
        F.first("strategy").alias("strategy"), F.bool_and("coverage_complete").alias("coverage_complete"), F.array_except(every, F.collect_set("level")).alias("_gone"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.sum(F.col("end") - F.col("start") + 1).alias("n_slices"), *[F.round(F.sum(f"{k}_cm3"), 3).alias(f"{k}_cm3") for k in ("subcutaneous", "torso")],
    )
    s = s.withColumn("ratio", F.round(F.try_divide("torso_cm3", F.nullif("subcutaneous_cm3", F.lit(0.0))), 4))
    return levels, s.withColumn("missing_levels", F.array_join("_gone", ",")).withColumn("needs_review", ~F.col("coverage_complete")).drop("_gone")


def level_volumes(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Both masks' volumes over each level's own extent, with whether the level is complete; a level without a mask has no row."""
    e = level_extents(t, cfg)
    got = fat_of_slabs(t, cfg, e.select("study", "level", "ordinal", F.col("first").alias("start"), F.col("last").alias("end")), ["study", "level", "ordinal"])
    return got.join(e.select("study", "level", "complete").hint("merge"), ["study", "level"])


def abdominal_volumes(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """A row a study with any level: volumes from the lowest to the highest slice of its longest block of complete levels, or of
    levels at all where none is complete; the first of equally long ones. Levels follow each other as they are listed.
    """
    e = level_extents(t, cfg)
    blocks = [windows.longest_block(rows, ["study"], "ordinal").withColumn("used_incomplete", F.lit(how)) for rows, how in ((e.where("complete"), False), (e, True))]
    block = windows.first_by(blocks[0].unionByName(blocks[1]), ["study"], F.col("used_incomplete"))
    inner = e.join(block.withColumnRenamed("first", "_f").hint("merge"), "study").where("ordinal >= _f and ordinal < _f + length")
    span = inner.groupBy("study").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.min_by("level", "ordinal").alias("top"), F.max_by("level", "ordinal").alias("bottom"), F.count("*").alias("n_levels"), F.bool_or("used_incomplete").alias("used_incomplete"))
    named = e.groupBy("study").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ordinal", "level")))), lambda x: x["level"]), ",").alias(n) for n, test in (("levels_complete", F.col("complete")), ("levels_measurable", F.lit(True)))])
    got = fat_of_slabs(t, cfg, span, ["study"]).join(span.drop("start", "end").hint("merge"), "study").join(named.hint("merge"), "study")
    whole = (F.col("n_levels") == len(cfg["levels"])) & ~F.col("used_incomplete")
    got = got.withColumns({"status": F.when(whole, "complete").otherwise("partial"), "measured_region": F.concat_ws("-", "top", "bottom"), "n_slices": F.col("end") - F.col("start") + 1})
    return got.drop("top", "bottom")


def slice_areas(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Both masks' areas (three digits) on the slice halfway between the ends of cfg["level"], and their ratio."""
    g = Grid.of(t, cfg)
    at = t["voxels"].where(F.col("mask") == cfg["level"]).groupBy("study").agg(F.bround((F.min("z") + F.max("z")) / 2.0).cast("int").alias("z"), (F.max("z") - F.min("z") + 1).alias("level_slices"))
    n = [F.count_if(F.col("mask") == cfg[k]).alias(f"{k}_pixels") for k in ("subcutaneous", "torso")]
    px = t["voxels"].where(F.col("mask").isin(cfg["subcutaneous"], cfg["torso"])).groupBy("study", "z").agg(*n)
    got = g.on(at.join(px.hint("merge"), ["study", "z"], "left").fillna(0, ["subcutaneous_pixels", "torso_pixels"]))
    got = got.withColumns({f"{k}_cm2": F.round(F.col(f"{k}_pixels") * g.cm2, 3) for k in ("subcutaneous", "torso")}).drop(*g.keys)
    return got.withColumn("ratio", F.round(F.try_divide("torso_cm2", F.nullif("subcutaneous_cm2", F.lit(0.0))), 4))
