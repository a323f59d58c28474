"""Composite metrics, each one job over all studies, and the registry that names them.

A metric is a function (tables, config) -> DataFrame with a row a study. `tables` has voxels (study, mask, x, y, z, hu)
and what else the metric needs. A study that lacks an input gets a status, not an exception. Where `tables` has volumes (study,
nx, ny, nz, sx, sy, sz), each study is measured on its own grid, and the settings of the grid (spacing, dims, voxel_cm3,
voxel_ml, pixel_cm2, n_slices) are not read; a study without a volume can't be measured then.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.functions import predicates, rules
from voxelweave.operators import components, masks, morphology, shapes, vertebrae, windows
from voxelweave.operators.grids import Grid, Spacing, steps
from voxelweave.session import cut

NAME = re.compile(r"^[a-z][a-z0-9_]*$")


@dataclass(frozen=True)
class Metric:
    name: str
    run: Callable[[dict[str, DataFrame], dict], DataFrame]
    needs: tuple[str, ...] = ()
    requires_inventory: tuple[str, ...] = field(default=())


REGISTRY: dict[str, Metric] = {}


def metric(name: str, needs: tuple[str, ...] = (), requires_inventory: tuple[str, ...] = ()):
    """Register a metric; names are lower-case words, and are given once."""
    if not NAME.match(name) or name in REGISTRY:
        raise ValueError(f"metric name {name!r} is not allowed or taken")

    def keep(f):
        REGISTRY[name] = Metric(name, f, needs, requires_inventory)
        return f

    return keep


def planned(names: list[str]) -> list[Metric]:
    """The named metrics after those that they need; unknown names and cycles are errors. Metrics are code, so this is a list of tens."""
    out: list[Metric] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name not in REGISTRY:
            raise ValueError(f"unknown metric {name}")
        if name in above:
            raise ValueError(f"metrics need each other: {' > '.join((*above, name))}")
        if all(m.name != name for m in out):
            for need in REGISTRY[name].needs:
                visit(need, (*above, name))
            out.append(REGISTRY[name])

    for n in names:
        visit(n, ())
    return out


def with_status(found: DataFrame, studies: DataFrame, key: str = "study") -> DataFrame:
    """Every study with the metric's columns and done, or not_present where there was nothing to measure."""
    both = studies.select(key).distinct().join(found.withColumn("_there", F.lit(True)).hint("merge"), key, "left")
    return both.withColumn("status", F.when(F.col("_there"), "done").otherwise("not_present")).drop("_there")


def appendicular_filter(tissue: DataFrame, bones: DataFrame, mm: float, spacing: tuple[float, ...] | None, most: float = 0.45, grid: list[str] = []) -> DataFrame:
    """Tissue of a slice without the parts that touch the widened arm bones, unless more than `most` of it would go."""
    flat = components.label_runs(tissue.withColumn("mask", F.lit("tissue")), planar=True)
    v = flat.select("study", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component")
    near = morphology.dilate_disc(bones.select("study", *grid, "x", "y", "z"), mm, spacing, ["study", *grid]).drop(*grid)
    hit = v.join(near.hint("merge"), ["study", "x", "y", "z"], "left_semi").select("study", "z", "component").distinct().withColumn("_hit", F.lit(True))
    marked = v.join(hit.hint("merge"), ["study", "z", "component"], "left")
    share = marked.groupBy("study", "z").agg((F.count("_hit") / F.count("*")).alias("removed_fraction"))
    return marked.join(share.hint("merge"), ["study", "z"]).where(F.col("_hit").isNull() | (F.col("removed_fraction") > most)).drop("_hit", "component")


def without_arms(t: dict[str, DataFrame], tissue: str, at: DataFrame, cfg: dict) -> DataFrame:
    """A tissue's pixels (study, x, y, z, hu) on each study's slice (study, z), raw ones with `kept` false where they belong to an arm.

    Arm bones count on the slice if they lie within `half_window_mm` of it; without the list `arms` nothing is an arm.
    """
    v = t["voxels"]
    mine = v.where(F.col("mask") == tissue).join(at.hint("merge"), ["study", "z"]).select("study", "x", "y", "z", "hu")
    if not cfg.get("arms"):
        return mine.withColumn("kept", F.lit(True))
    g = Grid.of(t, cfg)
    sz = steps(g.spacing)[2]
    bones = g.on(v).where(F.col("mask").isin(cfg["arms"])).join(at.withColumnRenamed("z", "_z").hint("merge"), "study")
    bones = bones.where(F.abs(F.col("z") - F.col("_z")) * sz <= cfg.get("half_window_mm", 80.0)).select("study", *g.keys, "x", "y", F.col("_z").alias("z")).distinct()
    kept = appendicular_filter(mine.select("study", "x", "y", "z"), bones, cfg.get("margin_mm", 35.0), g.spacing, cfg.get("most_removed", 0.45), g.keys)
    kept = kept.select("study", "x", "y", "z", F.lit(True).alias("kept"))
    return mine.join(kept.hint("merge"), ["study", "x", "y", "z"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def center_slices(voxels: DataFrame, level: str) -> DataFrame:
    """study and z of the middle slice of a level's mask."""
    return masks.axial_extent(voxels.where(F.col("mask") == level), ["study"]).select("study", F.col("center_z").alias("z"))


@metric("l3_muscle")
def l3_muscle(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Area and mean density of the muscle on the middle slice of L3 without the arms, and indices by height and weight.

    patients has study, contrast, height_m and weight_kg, one row a study. With contrast there is no density. A study that
    lacks the level or the muscle there has status not_present.
    """
    px = without_arms(t, cfg["muscle"], center_slices(t["voxels"], cfg["level"]), cfg)
    kept = F.when(F.col("kept"), F.col("hu"))
    got = px.groupBy("study").agg(F.count("*").alias("raw_pixels"), F.count_if("kept").alias("n_pixels"), F.avg(kept).alias("_mean"), F.stddev_pop(kept).alias("_sd"))
    g = Grid.of(t, cfg)
    got = g.on(got).join(t["patients"].select("study", "contrast", "height_m", "weight_kg").hint("merge"), "study", "left")
    plain = ~F.coalesce("contrast", F.lit(False))
    cm2, tall = F.col("n_pixels") * g.cm2, F.col("height_m").between(0.8, 2.5)
    square = F.col("height_m") * F.col("height_m")
    got = got.select(
        "study", "raw_pixels", "n_pixels", (F.col("raw_pixels") - F.col("n_pixels")).alias("excluded"), cm2.alias("cm2"),
        F.when(plain, F.round("_mean", 2)).alias("mean"), F.when(plain, F.round("_sd", 2)).alias("deviation"),
        F.when(tall, cm2 / square).alias("smi"), F.when(tall & F.col("weight_kg").between(20, 400), F.col("weight_kg") / square).alias("bmi"),
    )
    return with_status(got, t["voxels"])


@metric("vat_sat")
def vat_sat(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Areas of two fat masks on the middle slice of L3 without the arms, and their ratio to four digits.

    A study that lacks the level or one of the masks altogether has status not_present.
    """
    at = center_slices(t["voxels"], cfg["level"])
    there = t["voxels"].groupBy("study").agg(*[F.bool_or(F.col("mask") == cfg[k]).alias(k) for k in ("level", "visceral", "subcutaneous")]).where("level and visceral and subcutaneous")
    g = Grid.of(t, cfg)
    got = g.on(there.select("study"))
    for name, tissue in (("vat", cfg["visceral"]), ("sat", cfg["subcutaneous"])):
        n = without_arms(t, tissue, at, cfg).groupBy("study").agg(F.count_if("kept").alias(f"_{name}"), F.count_if(~F.col("kept")).alias(f"{name}_excluded"))
        got = got.join(n.hint("merge"), "study", "left")
    of = lambda name: (F.coalesce(f"_{name}", F.lit(0)) * g.cm2).alias(f"{name}_cm2")
    got = got.select("study", of("vat"), of("sat"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vat_excluded", "sat_excluded")])
    return with_status(got.withColumn("ratio", F.round(F.try_divide("vat_cm2", F.nullif("sat_cm2", F.lit(0.0))), 4)), t["voxels"])


@metric("organs")
def organs(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Per organ: status, density unless there is contrast, volume only if complete, fat fraction, and whether its volume is alarming.

    patients has study, contrast and maybe age. An organ of cfg["alerts"] (mask: name) is judged by its limit, a kidney also by the
    patient's age. Where there are rows of renal.kidneys() as table `kidneys`, these masks have the volume, density and alert
    of the part that is measured there, so that fragments, grafts and parts of indeterminate anatomy raise none.
    """
    g = Grid.of(t, cfg)
    status = masks.mask_status(g.on(t["voxels"]), g.on(t["expected"]), g.dims, g.cm3, ["study", "mask", *g.keys])
    stats = masks.mask_stats(t["voxels"])
    both = status.join(stats.drop("n_voxels").hint("merge"), ["study", "mask"], "left").join(t["patients"].select("study", "contrast", *[c for c in t["patients"].columns if c == "age"]).hint("merge"), "study", "left")
    plain = ~F.coalesce("contrast", F.lit(False))
    hu, cm3 = F.when(plain, F.round("mean", 2)), F.when(F.col("status") == "complete", F.col("cm3"))
    alert, age = F.lit(None).cast("string"), F.col("age") if "age" in t["patients"].columns else F.lit(None).cast("int")
    for mask, name in cfg.get("alerts", {}).items():
        alert = F.coalesce(alert, F.when((F.col("mask") == mask) & cm3.isNotNull(), predicates.volume_alert(F.lit(name), cm3, age, F.lit(False))))
    got = both.select("study", "mask", "status", hu.alias("hu"), cm3.alias("cm3"), F.when(plain, rules.pdff(F.col("mean"))).alias("pdff"), alert.alias("alert"))
    if "kidneys" not in t:
        return got
    k = t["kidneys"].select("study", "mask", F.struct("hu", "cm3", "alert").alias("_k"))
    got = got.join(k.hint("merge"), ["study", "mask"], "left")
    return got.withColumns({c: F.when(F.col("_k").isNotNull(), F.col(f"_k.{c}")).otherwise(F.col(c)) for c in ("hu", "cm3", "alert")}).drop("_k")


def organ_samples(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """What a mask's density rests on: voxels, volume, slices with voxels, and the extent in mm from the first to the last of them."""
    g = Grid.of(t, cfg)
    got = g.on(t["voxels"].groupBy("study", "mask").agg(F.count("*").alias("n_voxels"), F.count_distinct("z").alias("sample_slices"), (F.max("z") - F.min("z") + 1).alias("_span")))
    return got.select("study", "mask", "n_voxels", F.round(F.col("n_voxels") * g.cm3, 3).alias("sample_cm3"), "sample_slices", F.round(F.col("_span") * steps(g.spacing)[2], 3).alias("sample_mm"))


def liver_fat(measured: DataFrame, patients: DataFrame, liver: str, spleen: str, least_cm3: float = 10.0) -> DataFrame:
    """Steatosis of each study by its liver's and spleen's density (rows of organs()), where both are samples large enough.

    patients has study and kvp. A study with nothing to publish, neither a volume nor a liver sample, has publishable false.
    """
    of = lambda m, c: F.max(F.when(F.col("mask") == m, F.col(c)))
    enough = lambda m: F.coalesce(F.bool_or((F.col("mask") == m) & (F.col("cm3") >= least_cm3)), F.lit(False))
    got = measured.groupBy("study").agg(of(liver, "hu").alias("_liver"), of(spleen, "hu").alias("_spleen"), enough(liver).alias("_lok"), enough(spleen).alias("_sok"), F.bool_or(F.col("cm3").isNotNull()).alias("_any"))
    got = got.join(patients.select("study", "kvp").hint("merge"), "study", "left")
    q = rules.steatosis(F.col("_liver"), F.col("_spleen"), F.col("kvp"), F.col("_lok"), F.col("_sok"))
    return got.select("study", q["status"].alias("steatosis"), q["percent"].alias("percent"), (F.col("_any") | (F.col("_lok") & F.col("_liver").isNotNull())).alias("publishable"))


@metric("brain")
def brain(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Volume of a mask, withheld where it is truncated."""
    g = Grid.of(t, cfg)
    s = masks.mask_status(g.on(t["voxels"]), g.on(t["expected"].where(F.col("mask") == cfg["mask"])), g.dims, g.cm3, ["study", "mask", *g.keys])
    return s.select("study", "status", F.when(F.col("status") == "complete", F.round("cm3", 1)).alias("cm3"))


@metric("head_support")
def head_support(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Voxels of bleeds that lie outside the widened support, and their share to six digits."""
    v = t["voxels"].select("study", "mask", "x", "y", "z")
    support = morphology.dilate(v.where(F.col("mask").isin(cfg["support"])).withColumn("mask", F.lit("s")).distinct(), cfg.get("rounds", 1)).drop("mask")
    bleed = v.where(F.col("mask") == cfg["bleed"])
    out = bleed.join(support.withColumn("_in", F.lit(True)).hint("merge"), ["study", "x", "y", "z"], "left")
    return out.groupBy("study").agg(F.count("*").alias("n_voxels"), F.count_if(F.col("_in").isNull()).alias("outside")).withColumn("fraction", F.round(F.col("outside") / F.col("n_voxels"), 6))


def component_overlap(voxels: DataFrame, mask: str, support: list[str]) -> DataFrame:
    """Components of a mask with their size, and their overlap with the union of the supporting masks."""
    labelled = components.label_runs(voxels.where(F.col("mask") == mask))
    base = masks.merged_runs(masks.runs(voxels.where(F.col("mask").isin(support))).drop("mask"), ["study"])
    return masks.overlap(labelled.select("study", "z", "y", "x0", "x1", "component"), base, ["study"], "component")


@metric("lung_nodules")
def lung_nodules(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Nodule components that touch the lungs: number, voxels and largest."""
    o = component_overlap(t["voxels"], cfg["mask"], cfg["support"]).where("inside > 0")
    return o.groupBy("study").agg(F.count("*").alias("n_nodules"), F.sum("n_voxels").alias("n_voxels"), F.max("n_voxels").alias("largest"))


@metric("liver_lesions")
def liver_lesions(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Lesions with at least half of their voxels in the liver and an axial diameter of at least 4 mm."""
    lesion = t["voxels"].where(F.col("mask") == cfg["mask"])
    labelled = components.label_runs(lesion)
    base = masks.merged_runs(masks.runs(t["voxels"].where(F.col("mask").isin(cfg["support"]))).drop("mask"), ["study"])
    o = masks.overlap(labelled.select("study", "z", "y", "x0", "x1", "component"), base, ["study"], "component")
    g = Grid.of(t, cfg)
    d = components.feret_axial(g.on(labelled), g.spacing, ["study", *g.keys])
    both = o.join(d.hint("merge"), ["study", "component"]).where((F.col("fraction") >= 0.5) & (F.col("diameter_mm") >= cfg.get("least_mm", 4.0)))
    return both.groupBy("study").agg(F.count("*").alias("n_lesions"), F.sum("n_voxels").alias("n_voxels"), F.max("diameter_mm").alias("largest_mm"))


def trabecular_roi(voxels: DataFrame, mm: float, spacing: Spacing, least: int = 25, grid: list[str] = []) -> DataFrame:
    """The inner part of each mask: eroded in rounds of the cross, of every slice the largest component, of those the largest in space.

    A mask that erosion empties stands in whole for its eroded one; that takes the place of a part below `least` voxels.
    """
    key, flat = [*masks.GROUP, "x", "y", "z"], [*masks.GROUP, "z"]
    left = cut(morphology.erode(voxels, vertebrae.rounds_of(mm, spacing), group=[*masks.GROUP, *grid]).select(*key))
    whole = voxels.join(left.select(*masks.GROUP).distinct().hint("merge"), masks.GROUP, "left_anti")
    eroded = left.union(whole.select(*key))
    runs = components.label_runs(eroded, planar=True)
    top = components.largest_in_slice(components.describe(runs, flat), flat).select(*masks.GROUP, "component")
    runs = runs.join(top.hint("merge"), [*masks.GROUP, "component"], "left_semi")
    solid = components.label_runs(runs.select(*masks.GROUP, "y", "z", F.explode(F.sequence("x0", "x1")).alias("x")))
    top = components.largest(components.describe(solid)).where(F.col("n_voxels") >= least).select(*masks.GROUP, "component")
    part = solid.join(top.hint("merge"), [*masks.GROUP, "component"], "left_semi").select(*masks.GROUP, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z")
    return part.union(eroded.join(top.select(*masks.GROUP).hint("merge"), masks.GROUP, "left_anti").select(*key))


@metric("l1_volumetric")
def l1_volumetric(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Density of a vertebra's whole mask and of its inner part."""
    v = t["voxels"].where(F.col("mask") == cfg["mask"])
    full = masks.mask_stats(v, ["study"])
    g = Grid.of(t, cfg)
    core = v.join(trabecular_roi(g.on(v), cfg["mm"], g.spacing, grid=g.keys).hint("merge"), ["study", "mask", "x", "y", "z"], "left_semi")
    core = masks.mask_stats(core, ["study"]).select("study", F.col("n_voxels").alias("n_core"), F.col("mean").alias("core_mean"))
    both = full.join(core.hint("merge"), "study", "left").withColumn("n_core", F.coalesce("n_core", F.lit(0)))
    hu = F.col("core_mean")
    return both.select("study", "n_voxels", "n_core", F.round("mean", 2).alias("full_hu"), F.round(hu, 2).alias("hu"), rules.l1_class(hu).alias("label"))


@metric("kidney_stone")
def kidney_stone(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Components of voxels over 130 HU in the kidneys: number, voxels, the largest and its longest axis by side.

    A component counts from `least_voxels` and `least_mm3` on.
    """
    g = Grid.of(t, cfg)
    x, y, z = steps(g.spacing)
    v = t["voxels"].where(F.col("mask").isin(cfg["kidneys"]) & (F.col("hu") > cfg.get("threshold", 130)))
    labelled = components.label_runs(v)
    d = g.on(components.describe(labelled)).where((F.col("n_voxels") >= cfg.get("least_voxels", 2)) & (F.col("n_voxels") * (x * y * z) >= cfg.get("least_mm3", 0.0))).drop(*g.keys)
    pts = labelled.select("study", "mask", "component", "y", "z", F.explode(F.sequence("x0", "x1")).alias("x"))
    axis = shapes.pca_extent(g.on(pts.join(d.select("component").hint("merge"), "component", "left_semi")), ["study", "mask", "component", *g.keys], g.spacing).select("component", "extent_1")
    both = d.join(axis.hint("merge"), "component")
    return both.groupBy("study", "mask").agg(F.count("*").alias("n_stones"), F.sum("n_voxels").alias("n_voxels"), F.max("n_voxels").alias("largest"), F.max_by("extent_1", F.struct("n_voxels", F.negative("label"))).alias("largest_mm"))


def stone_summary(stones: DataFrame, studies: DataFrame, right: str, left: str) -> DataFrame:
    """A row a study from the rows a side of kidney_stone(): stones by side and in all, the largest one's axis and side, and whether there are any."""
    of = lambda m, c: F.coalesce(F.max(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("bigint")
    got = stones.groupBy("study").agg(of(right, "n_stones").alias("right_stones"), of(left, "n_stones").alias("left_stones"), F.max("largest_mm").alias("largest_mm"), F.max_by("mask", F.struct("largest", "mask")).alias("largest_side"))
    both = studies.select("study").distinct().join(got.hint("merge"), "study", "left").fillna(0, ["right_stones", "left_stones"])
    total = F.col("right_stones") + F.col("left_stones")
    return both.select("study", "right_stones", "left_stones", total.alias("total_stones"), "largest_mm", "largest_side", (total > 0).alias("has_stones"))


def renal_components(t: dict[str, DataFrame], cfg: dict) -> tuple[DataFrame, DataFrame]:
    """Labelled runs of the kidney masks, and their components with region and whether they are significant (computed)."""
    z = masks.axial_extent(t["voxels"].where(F.col("mask").isin(cfg["l3"], cfg["l4"]))).select("study", "mask", "center_z")
    ref = z.groupBy("study").agg(F.max(F.when(F.col("mask") == cfg["l3"], F.col("center_z"))).alias("l3"), F.max(F.when(F.col("mask") == cfg["l4"], F.col("center_z"))).alias("l4"))
    labelled = cut(components.label_runs(t["voxels"].where(F.col("mask").isin(cfg["kidneys"]))))
    d = components.describe(labelled).join(ref.hint("merge"), "study", "left")
    region = F.when(F.col("l3").isNull() | F.col("l4").isNull(), "unknown").when(F.col("cz") >= F.greatest("l3", "l4"), "native_renal_region").when(F.col("cz") <= F.least("l3", "l4"), "pelvic_region").otherwise("between")
    return labelled, cut(d.withColumns({"region": region, "significant": F.col("n_voxels") >= cfg["least_voxels"]}).drop("l3", "l4"))


@metric("renal_anatomy")
def renal_anatomy(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Significant components of each kidney mask by region, and which one is native: above L3, below L4, or between.

    The only native-region component of a side is native; a single one that lies between the levels counts if its
    extent along the body overlaps the other side's single, not pelvic one by at least half. Order matters.
    """
    return native_sides(renal_components(t, cfg)[1].where("significant"))


def renal_roles(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Every component of the kidney masks with its role, the reason, its density, and whether it is measured as a kidney.

    A pelvic component beside a native one is a suspected allograft. Without a native one the only significant component
    is measured, if it lies between the levels or in the pelvis. patients has study and contrast; with contrast there is no density.
    """
    labelled, d = renal_components(t, cfg)
    d = d.join(native_sides(d.where("significant")).select("study", "mask", "n", F.col("native").alias("why")).hint("merge"), ["study", "mask"], "left")
    found = F.col("why") != "indeterminate"
    native = F.col("significant") & found & ((F.col("why") != "single_native_region_component") | (F.col("region") == "native_renal_region"))
    alone = F.col("significant") & ~found & (F.col("n") == 1) & F.col("region").isin("between", "pelvic_region")
    pelvic, upper = F.col("region") == "pelvic_region", F.col("region") == "native_renal_region"
    role = F.when(~F.col("significant"), "segmentation_fragment").when(native, "native_kidney").when(pelvic & found, "suspected_renal_allograft").when(pelvic, "indeterminate_pelvic_renal_component")
    role = role.when(upper, "unclassified_native_region_component").otherwise("unclassified_renal_component")
    reason = F.when(~F.col("significant"), "below_minimum_significant_component_volume").when(native, F.col("why")).when(pelvic & found, "pelvic_component_separate_from_native_component")
    reason = reason.when(pelvic, "pelvic_position_without_identified_native_component").when(upper, "multiple_native_region_components").otherwise("topographic_classification_indeterminate")
    said = d.select("study", "mask", "component", "label", "n_voxels", "region", role.alias("role"), reason.alias("reason"), F.coalesce(native | alone, F.lit(False)).alias("measured"))
    px = labelled.select("study", "mask", "component", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z").join(t["voxels"].select("study", "mask", "x", "y", "z", "hu").hint("merge"), ["study", "mask", "x", "y", "z"])
    hu = px.groupBy("study", "mask", "component").agg(F.round(F.avg("hu"), 2).alias("_hu"))
    both = said.join(hu.hint("merge"), ["study", "mask", "component"], "left").join(t["patients"].select("study", "contrast").hint("merge"), "study", "left")
    return both.withColumn("hu", F.when(~F.coalesce("contrast", F.lit(False)), F.col("_hu"))).drop("_hu", "contrast", "component")


def native_sides(d: DataFrame) -> DataFrame:
    """Per study and mask the significant components by region, and how the native one is told, if it is."""
    side = d.groupBy("study", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("region") == "native_renal_region").alias("n_native"), F.count_if(F.col("region") == "pelvic_region").alias("n_pelvic"), F.min("z_min").alias("lo"), F.max("z_max").alias("hi"), F.max("region").alias("only"))
    o = side.select("study", F.col("mask").alias("_m"), F.col("n").alias("_n"), F.col("n_pelvic").alias("_p"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    both = side.join(o.hint("merge"), "study", "left").where("_m is null or _m <> mask or n is not null")
    over = F.coalesce(F.try_divide(F.greatest(F.lit(0), F.least("hi", "_hi") - F.greatest("lo", "_lo")), F.col("hi") - F.col("lo")), F.lit(0.0))  # of heights, as lengths
    meets = (F.col("_m") != F.col("mask")) & (F.col("_n") == 1) & (F.col("_p") == 0) & (over >= 0.5)
    got = both.groupBy("study", "mask").agg(F.max("n").alias("n"), F.max("n_native").alias("n_native"), F.max("n_pelvic").alias("n_pelvic"), F.max("only").alias("only"), F.coalesce(F.bool_or(meets), F.lit(False)).alias("meets"))
    why = F.when(F.col("n_native") == 1, "single_native_region_component").when((F.col("n") == 1) & (F.col("only") == "between") & F.col("meets"), "contralateral_superior_extent_overlap").when((F.col("n") == 1) & (F.col("only") == "unknown"), "single_significant_component")
    return got.select("study", "mask", "n", "n_native", "n_pelvic", F.coalesce(why, F.lit("indeterminate")).alias("native"))


@metric("body_fat")
def body_fat(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Voxels and volume of the fat masks in each slab between the middles of neighbour levels; totals are sums of rounded parts."""
    lv = windows.midpoint_slabs(t["levels"], ["study"], "ordinal", "center").where("low is not null")
    slabs = lv.select("study", "ordinal", F.ceil("low").cast("int").alias("first"), (F.ceil("high") - 1).cast("int").alias("last")).where("first <= last")
    g = Grid.of(t, cfg)
    got = masks.slab_volumes(g.on(t["voxels"].where(F.col("mask").isin(cfg["masks"]))), g.on(slabs), ["study", *g.keys], "ordinal", g.cm3).drop(*g.keys)
    return got.withColumn("total_cm3", F.sum("cm3").over(W.partitionBy("study")))


@metric("liver_segments")
def liver_segments(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Voxels and volume (whole cm3) of each segment's mask."""
    g = Grid.of(t, cfg)
    got = g.on(t["voxels"].groupBy("study", "mask").agg(F.count("*").alias("n_voxels")))
    return got.select("study", "mask", "n_voxels", F.bround(F.col("n_voxels") * g.cm3, 0).alias("cm3"))


@metric("l1_hu")
def l1_hu(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Density in the sagittal ellipse of L1, its check and class, and the density of the whole mask eroded by 0 to 5 mm.

    patients has study, modality, kvp, contrast and thickness_mm. A study without the mask has status not_present, one
    whose ellipse can't be placed the reason.
    """
    g = Grid.of(t, cfg)
    v, key = g.on(t["voxels"].where(F.col("mask") == cfg["mask"])), ["study", *g.keys]
    roi = vertebrae.l1_sagittal_roi(v, g.spacing, key, cfg.get("lateral", "x"), cfg.get("front_low", False), cfg.get("erosion_mm", 5.0), cfg.get("radius_mm", 6.0))
    deep = morphology.erosion_profile(v.drop("mask"), "hu", [0, 1, 2, 3, 4, 5], g.spacing, key)
    profile = deep.groupBy("study").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("step").cast("int"), F.round("mean", 2).alias("mean"))))).alias("profile"))
    both = roi.join(vertebrae.complete_along(v, g.n_slices, key).select("study", "complete").hint("merge"), "study").join(profile.hint("merge"), "study", "left").join(t["patients"].hint("merge"), "study", "left")
    qc = rules.bone_qc(F.col("modality"), F.col("complete"), F.col("n_pixels"), F.col("kvp"), F.col("contrast"), F.col("thickness_mm"), cfg.get("strict", False))
    got = both.select(
        "study", F.when(F.col("status") == "ok", "done").otherwise(F.col("status")).alias("_said"), "plane", "center_row", "center_col", "n_pixels", F.round("mean", 2).alias("hu"), F.round("deviation", 2).alias("deviation"),
        "complete", qc["passed"].alias("qc_pass"), F.array_join(qc["reasons"], ",").alias("qc_reasons"), rules.l1_class(F.round("mean", 2)).alias("label"), "profile",
    )
    return with_status(got, t["voxels"]).withColumn("status", F.coalesce("_said", "status")).drop("_said")


def bmd_extract(series: DataFrame, t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """One row a series (case_id, series_id, study) with the figures of l1_hu; what can't be measured is a row with its status."""
    return series.select("case_id", "series_id", "study").join(l1_hu(t, cfg).hint("merge"), "study", "left").withColumn("status", F.coalesce("status", F.lit("not_present"))).drop("study", "profile")


def adjacent_grades(graded: DataFrame, group: list[str], ordinal: str, valid: Column) -> DataFrame:
    """Grades of the levels against their neighbours: the loss of the height that the pattern names, or the lowest.

    graded has anterior_height, middle_height, posterior_height and pattern. The neighbours are the next levels up and down;
    only valid ones are a reference, two by their mean. A level without one has no grade.
    """
    h = [F.col(f"{k}_height") for k in ("anterior", "middle", "posterior")]
    low = F.least(*h)
    at = F.when(F.col("pattern") == "wedge", 0).when(F.col("pattern") == "biconcave", 1).when(h[0] == low, 0).when(h[1] == low, 1).otherwise(2)
    w = W.partitionBy(*group).orderBy(ordinal)
    sides = [f(F.when(valid, F.array(*h))).over(w) for f in (F.lag, F.lead)]
    out = graded.withColumns({"_at": at, "_below": sides[0], "_above": sides[1]})
    pick = lambda c: F.get(F.col(c), F.col("_at"))
    ref = F.when(F.col("_below").isNotNull() & F.col("_above").isNotNull(), (pick("_below") + pick("_above")) / 2).otherwise(F.coalesce(pick("_below"), pick("_above")))
    loss = F.when(ref > 0, (1 - F.get(F.array(*h), F.col("_at")) / ref) * 100)
    return out.withColumns({"reference_mm": ref, "adjacent_loss": loss, "grade": rules.grade_of_loss(loss)}).drop("_at", "_below", "_above")


@metric("fracture")
def fracture(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Heights of each vertebra's body in seven slabs, its grade and pattern alone, its grade against its neighbours, and by study.

    cfg["levels"] names the masks from top to bottom. Vertebrae that the volume cuts off are counted and not graded. A
    vertebra is a reference if it has grade 0, a clear front, and a body of at least 35 percent of its mask.
    """
    grid, key = Grid.of(t, cfg), ["study", "mask"]
    v = t["voxels"].where(F.col("mask").isin(cfg["levels"])).select(*key, "x", "y", "z")
    own = [*key, *grid.keys]
    body = cut(vertebrae.isolate_body(grid.on(v), grid.spacing, own))
    heights = vertebrae.parasagittal_heights(body, grid.spacing, own).drop(*grid.keys)
    size = v.groupBy(*key).agg(F.count("*").alias("_n")).join(body.groupBy(*key).agg(F.count("*").alias("_b")).hint("merge"), key, "left")
    each = vertebrae.complete_along(grid.on(v), grid.n_slices, own).drop(*grid.keys).join(size.hint("merge"), key).join(heights.hint("merge"), key, "left")
    g = rules.fracture_grade(F.col("anterior_height"), F.col("middle_height"), F.col("posterior_height"), F.col("depth"), F.col("confidence") >= 0.2)
    each = each.withColumn("_g", g).withColumns({"grade": F.col("_g.grade"), "pattern": F.col("_g.pattern"), "ordinal": F.array_position(F.array(*[F.lit(x) for x in cfg["levels"]]), F.col("mask"))})
    ok = (F.col("grade") == 0) & (F.col("confidence") >= 0.2) & (F.col("_b") >= 0.35 * F.col("_n"))
    whole = adjacent_grades(each.where("complete"), ["study"], "ordinal", ok)
    rest = each.where("not complete").withColumns({"reference_mm": F.lit(None).cast("double"), "adjacent_loss": F.lit(None).cast("double")})
    return windows.fracture_rollup(whole.unionByName(rest), ["study"], F.col("complete"))


def composite(l1: DataFrame, volumetric: DataFrame, fracture: DataFrame, key: str = "case_id") -> DataFrame:
    """The composite of three metrics' results a case, any of which may lack.

    l1 has trabecular_hu and qc_pass, volumetric trabecular_hu, full_hu and qc_pass, fracture suspicion; one row a case each.
    The trabecular value and the check of l1 are preferred; the density class follows the preferred value, else the full one.
    """
    both = l1.select(key, F.col("trabecular_hu").alias("_t1"), F.col("qc_pass").alias("_q1"))
    both = both.join(volumetric.select(key, F.col("trabecular_hu").alias("_t2"), "full_hu", F.col("qc_pass").alias("_q2")).hint("merge"), key, "full")
    both = both.join(fracture.select(key, F.col("suspicion").alias("fracture")).hint("merge"), key, "full")
    got = both.select(key, F.coalesce("_t1", "_t2").alias("preferred_hu"), "full_hu", "fracture", F.coalesce("_q1", "_q2").alias("qc_pass"))
    q = rules.osteoporosis_composite(F.col("preferred_hu"), F.col("full_hu"), F.col("fracture"), F.col("qc_pass"))
    got = got.withColumn("_c", q).select("*", "_c.level", "_c.score", "_c.label", "_c.reasons").drop("_c")
    return got.withColumn("recommendation", rules.recommendation(F.col("fracture"), F.col("level")))


@metric("effusion")
def effusion(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Effusion components by the side of the nearer lung, volumes by side; sides below the least volume don't count."""
    g = Grid.of(t, cfg)
    labelled = components.label_runs(t["voxels"].where(F.col("mask") == cfg["mask"]))
    pts = labelled.select("study", "component", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z")
    lung = lambda m: morphology.surface(t["voxels"].where(F.col("mask") == m)).drop("mask")
    sides = morphology.lateralize(g.on(pts), g.on(lung(cfg["left"])), g.on(lung(cfg["right"])), g.spacing, ["study", *g.keys], "component", cfg.get("most_mm", 512.0))
    n = labelled.groupBy("study", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    both = n.join(sides.select("study", "component", "side").hint("merge"), ["study", "component"], "left")
    vol = g.on(both.groupBy("study", F.coalesce("side", F.lit("indeterminate")).alias("side")).agg(F.sum("n").alias("n")))
    vol = vol.select("study", "side", (F.col("n") * g.ml).alias("ml"))
    return windows.effusion_qc(vol, ["study"], "ml", cfg.get("least_ml", 50))


@metric("effusions", needs=("effusion",))
def effusions(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """A row a study and finding: pleural, by side of the nearer lung, and pericardial, as one volume; published only if positive.

    A pleural effusion is positive if a side reaches `least_ml`, a pericardial one if the whole does; what lies between
    the lungs counts for neither side. cfg names the masks `pleural` and `pericardial` and the lungs `left` and `right`. A study
    without voxels of a finding has no row for it.
    """
    g, least = Grid.of(t, cfg), cfg.get("least_ml", 50.0)
    labelled = components.label_runs(t["voxels"].where(F.col("mask").isin(cfg["pleural"], cfg["pericardial"])))
    size = labelled.groupBy("study", "mask", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    pts = labelled.where(F.col("mask") == cfg["pleural"]).select("study", "component", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z")
    lung = lambda m: morphology.surface(t["voxels"].where(F.col("mask") == m)).drop("mask")
    sides = morphology.lateralize(g.on(pts), g.on(lung(cfg["left"])), g.on(lung(cfg["right"])), g.spacing, ["study", *g.keys], "component", cfg.get("most_mm", 512.0))
    both = g.on(size.join(sides.select("study", "component", "side").hint("merge"), ["study", "component"], "left"))
    ml, pleural = F.col("n") * g.ml, F.col("mask") == cfg["pleural"]
    of = lambda s: F.when(F.max(pleural.cast("int")) == 1, F.round(F.coalesce(F.sum(F.when(F.coalesce("side", F.lit("indeterminate")) == s, ml)), F.lit(0.0)), 6))
    got = both.groupBy("study", F.when(pleural, "pleural_effusion").otherwise("pericardial_effusion").alias("finding")).agg(
        F.count("*").alias("n_components"), F.sum("n").alias("n_voxels"), F.round(F.sum(ml), 6).alias("ml"), of("left").alias("left_ml"), of("right").alias("right_ml"), of("indeterminate").alias("indeterminate_ml"),
    )
    eligible = F.concat_ws(",", F.when(F.col("left_ml") >= least, "left"), F.when(F.col("right_ml") >= least, "right"))
    positive = F.when(F.col("finding") == "pleural_effusion", eligible != "").otherwise(F.col("ml") >= least)
    got = got.withColumns({"eligible_sides": F.when(F.col("finding") == "pleural_effusion", eligible), "positive": positive})
    return got.withColumn("publish", F.bool_or("positive").over(W.partitionBy("study")))


@metric("head_complete")
def head_complete(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """A row a study and structure of the head: its volume (three digits), what borders cut it off, and whether it may be used.

    cfg names the whole `brain` and lists the `structures`. A structure is usable if it is there and complete; the study is
    complete if the brain is, and `usable` counts its structures. Missing and truncated ones are rows too.
    """
    g = Grid.of(t, cfg)
    names = [cfg["brain"], *cfg["structures"]]
    want = t["voxels"].select("study").distinct().withColumn("mask", F.explode(F.array(*[F.lit(n) for n in names])))
    s = masks.mask_status(g.on(t["voxels"].where(F.col("mask").isin(names))), g.on(want), g.dims, g.cm3, ["study", "mask", *g.keys]).drop(*g.keys)
    every = W.partitionBy("study")
    whole, part = F.col("status") == "complete", F.col("mask") != cfg["brain"]
    s = s.withColumns({"complete": F.bool_or(whole & ~part).over(every), "usable": F.count_if(whole & part).over(every)})
    return s.select("study", "mask", "status", F.when(F.col("status") != "missing", F.round("cm3", 3)).alias("cm3"), "borders", "complete", "usable")


def recalculate(names: list[str], tables: dict[str, DataFrame], configs: dict[str, dict], studies: Column | None = None, errors: dict[str, str] | None = None, first: int | None = None) -> dict[str, DataFrame]:
    """The named metrics and what they need, for all or for selected studies; most is computed only when it is asked for.

    `first` takes the first studies by their key, of those selected.

    A metric that lacks a table, a column or a setting is left out and told in `errors`, if that is given, else raised.
    """
    if studies is not None:
        tables = {k: d.where(studies) if "study" in d.columns else d for k, d in tables.items()}
    if first is not None:
        some = tables["voxels"].select("study").distinct().orderBy("study").limit(first)
        tables = {k: d.join(some.hint("merge"), "study", "left_semi") if "study" in d.columns else d for k, d in tables.items()}
    out = {}
    for m in planned(names):
        try:
            out[m.name] = m.run(tables, configs.get(m.name, {}))
        except (KeyError, AnalysisException) as why:
            if errors is None:
                raise
            errors[m.name] = f"{type(why).__name__}: {why}".split("\n")[0]
    return out
