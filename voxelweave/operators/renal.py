"""Parts of the kidney masks in world coordinates: which is a native kidney, which may be a graft, what is measured.

`tables` has voxels (study, mask, x, y, z, hu), volumes (study, its grid, and `affine`, 16 numbers row by row) and patients
(study, contrast, and maybe age). Heights are millimetres along the third world axis, so tilted volumes are no special case.
Topography is a suspicion, not a proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.functions import predicates
from voxelweave.functions import scalars as S
from voxelweave.operators import components
from voxelweave.operators.grids import GRID
from voxelweave.session import cut, small_side

KEY = ["study", "mask"]
#: The least volume of a part that counts, and the least share of its height that the other side's part has to cover.
LEAST_CM3, LEAST_OVERLAP = 5.0, 0.25
NATIVE, PELVIC, BETWEEN = "native_renal_region", "pelvic_region", "indeterminate_between_L3_and_L4"


def height(x: Column, y: Column, z: Column) -> Column:
    """World height of a voxel index by the affine beside it."""
    return F.get(S.affine_world(F.col("affine"), x, y, z), F.lit(2))


def inside() -> Column:
    """Whether bounds touch no face of the grid."""
    return sum([(F.col(f"{a}_min") > 0).cast("int") + (F.col(f"{a}_max") < F.col(f"n{a}") - 1).cast("int") for a in "xyz"], F.lit(0)) == 6


def placed(frame: DataFrame, volumes: DataFrame) -> DataFrame:
    """The frame with grid and affine of its study."""
    return frame.join(small_side(volumes.select("study", *GRID, "affine")), "study")


def reference(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Per study the heights of L3 and L4 (of whole masks only) and whether both are known in their order."""
    v = t["voxels"].where(F.col("mask").isin(cfg["l3"], cfg["l4"]))
    b = v.groupBy(*KEY).agg(*[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mid"))])
    b = placed(b, t["volumes"]).where(inside()).select("study", "mask", height(F.col("x_mid"), F.col("y_mid"), F.col("z_mid")).alias("h"))
    got = b.groupBy("study").agg(*[F.max(F.when(F.col("mask") == cfg[k], F.col("h"))).alias(k) for k in ("l3", "l4")])
    return got.withColumn("available", F.coalesce(F.col("l3") > F.col("l4"), F.lit(False)))


def renal_components(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """Every component of the kidney masks (26 neighbours): place, extent, volume, density, region, and whether it is significant.

    Components are numbered from the highest down, of equally high ones the larger first. A component that touches a face of
    the grid has no volume. With contrast there is no density.
    """
    v = t["voxels"].where(F.col("mask").isin(cfg["kidneys"]))
    labelled = cut(components.label_runs(v))
    d = placed(components.describe(labelled), t["volumes"])
    ends = [height(F.col(x), F.col("y"), F.col("z")) for x in ("x0", "x1")]
    span = placed(labelled, t["volumes"]).groupBy(*KEY, "component").agg(F.round(F.min(F.least(*ends)), 3).alias("inferior"), F.round(F.max(F.greatest(*ends)), 3).alias("superior"), F.count_distinct("z").alias("sample_slices"))
    px = labelled.select(*KEY, "component", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z").join(v.select(*KEY, "x", "y", "z", "hu").hint("merge"), [*KEY, "x", "y", "z"])
    hu = px.groupBy(*KEY, "component").agg(F.round(F.avg("hu"), 2).alias("hu"), F.round(F.stddev_pop("hu"), 2).alias("deviation"))
    d = d.join(span.hint("merge"), [*KEY, "component"]).join(hu.hint("merge"), [*KEY, "component"])
    d = d.join(reference(t, cfg).hint("merge"), "study", "left").join(t["patients"].select("study", "contrast").hint("merge"), "study", "left")
    at, cm3 = height(F.col("cx"), F.col("cy"), F.col("cz")), F.col("n_voxels") * (F.col("sx") * F.col("sy") * F.col("sz")) / 1000.0
    available, plain = F.coalesce("available", F.lit(False)), ~F.coalesce("contrast", F.lit(False))
    region = F.when(~available, "unresolved").when(F.col("h") >= F.col("l3"), NATIVE).when(F.col("h") <= F.col("l4"), PELVIC).otherwise(BETWEEN)
    d = d.withColumns({"h": at, "cm3": cm3}).withColumns({"region": region, "complete": inside(), "available": available})
    order = W.partitionBy(*KEY).orderBy(F.round("h", 3).desc(), F.col("n_voxels").desc(), "label")
    return d.select(
        *KEY, F.row_number().over(order).alias("part"), "n_voxels", F.round("h", 3).alias("height_mm"), "inferior", "superior", F.round("cm3", 3).alias("sample_cm3"), F.when(F.col("complete"), F.round("cm3", 3)).alias("cm3"),
        "complete", "sample_slices", F.round((F.col("z_max") - F.col("z_min") + 1) * F.col("sz"), 3).alias("sample_mm"), F.when(plain, F.col("hu")).alias("hu"), F.when(plain, F.col("deviation")).alias("deviation"),
        "region", (F.col("cm3") >= cfg.get("least_cm3", LEAST_CM3)).alias("significant"), "available",
    )


def kidney_audit(parts: DataFrame, studies: DataFrame, cfg: dict) -> DataFrame:
    """A row a study and kidney mask: its parts by kind, which is native and why, which is measured, and the status that follows.

    The only significant part of the native region is native; a single one between L3 and L4 is, if enough of its height is
    covered by the other side's single one, which must not be pelvic. Without both levels a single one is taken. What is not
    native is measured if it is the only significant part and lies between the levels or in the pelvis.
    """
    sig = F.col("significant")
    of = lambda c: F.max(F.when(sig, F.col(c)))
    s = parts.groupBy(*KEY).agg(
        F.count("*").alias("raw"), F.count_if(sig).alias("n"), F.count_if(sig & (F.col("region") == NATIVE)).alias("n_native"), F.count_if(sig & (F.col("region") == PELVIC)).alias("n_pelvic"),
        of("region").alias("only"), of("inferior").alias("lo"), of("superior").alias("hi"), of("part").alias("single"), F.max(F.when(sig & (F.col("region") == NATIVE), F.col("part"))).alias("upper"), F.bool_or("available").alias("available"),
    )
    s = cut(s)
    o = s.select("study", F.col("mask").alias("_m"), F.col("n").alias("_n"), F.col("only").alias("_only"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    both = s.join(o.hint("merge"), "study").where("_m <> mask and _n = 1").select(*KEY, "_only", "_lo", "_hi")
    s = s.join(both.hint("merge"), KEY, "left")
    single = F.col("n") == 1
    length = F.col("hi") - F.col("lo")
    over = F.when(length > 0, F.greatest(F.lit(0.0), F.least("hi", "_hi") - F.greatest("lo", "_lo")) / length).otherwise(0.0)
    over = F.when(F.col("available") & (F.col("n_native") != 1) & single & (F.col("only") == BETWEEN) & (F.col("_only") != PELVIC), over)
    s = s.withColumn("overlap", over)
    enough = F.coalesce(F.col("overlap") >= cfg.get("least_overlap", LEAST_OVERLAP), F.lit(False))
    why = F.when(F.col("available"), F.when(F.col("n_native") == 1, "single_native_region_component").when(enough, "contralateral_superior_extent_overlap")).when(single, "single_significant_component_legacy_fallback")
    s = s.withColumn("why", why)
    native = F.when(F.col("why") == "single_native_region_component", F.col("upper")).when(F.col("why").isNotNull(), F.col("single"))
    s = s.withColumn("native", native)
    s = s.withColumn("measured", F.coalesce("native", F.when(single & F.col("only").isin(BETWEEN, PELVIC), F.col("single"))))
    known, told = F.col("native").isNotNull(), F.col("measured").isNotNull()
    status = (
        F.when(F.col("n") == 0, "no_significant_component").when(~F.col("available") & single, "single_component_legacy_fallback").when(known & (F.col("n_pelvic") > 0), "native_and_suspected_allograft").when(known & single, "native_only")
        .when(known, "native_with_unclassified_components").when(told & (F.col("only") == PELVIC), "single_pelvic_component_anatomy_indeterminate").when(told, "single_component_anatomy_indeterminate")
        .when(F.col("n") > 1, "ambiguous_multiple_components").otherwise("anatomy_unresolved")
    )
    every = studies.select("study").distinct().withColumn("mask", F.explode(F.array(*[F.lit(k) for k in cfg["kidneys"]])))
    got = every.join(s.withColumn("status", status).hint("merge"), KEY, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return got.select(*KEY, F.coalesce("status", F.lit("missing")).alias("status"), n("raw"), n("n"), n("n_native"), n("n_pelvic"), "why", "native", "measured", F.round("overlap", 3).alias("overlap"))


def renal_roles(parts: DataFrame, audit: DataFrame) -> DataFrame:
    """Each part with its role and the reason, whether it is native and whether it is measured. A role says no side; the mask does."""
    a = audit.select(*KEY, "why", "native", "measured")
    p = parts.join(a.hint("merge"), KEY)
    own = F.coalesce(F.col("native") == F.col("part"), F.lit(False))
    pelvic, some = F.col("region") == PELVIC, F.col("native").isNotNull()
    role = F.when(~F.col("significant"), "segmentation_fragment").when(own, "native_kidney").when(pelvic & some, "suspected_renal_allograft").when(pelvic, "indeterminate_pelvic_renal_component")
    role = role.when(F.col("region") == NATIVE, "unclassified_native_region_component").otherwise("unclassified_renal_component")
    reason = F.when(~F.col("significant"), "below_minimum_significant_component_volume").when(own, F.col("why")).when(pelvic & some, "pelvic_component_separate_from_native_component").when(pelvic, "pelvic_position_without_identified_native_component")
    reason = reason.when(F.col("region") == NATIVE, "multiple_native_region_components").otherwise("topographic_classification_indeterminate")
    measured = F.coalesce(F.col("measured") == F.col("part"), F.lit(False))
    return p.withColumns({"role": role, "reason": reason, "is_native": own, "measured": measured}).drop("why", "native", "available")


def kidneys(t: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """A row a study and kidney: status, the measured part's volume, density and role, and whether its volume alarms.

    A part whose anatomy is indeterminate never alarms, nor does a patient below the age of 16; where the age is not known the
    fixed limit holds. patients may have age.
    """
    parts = cut(renal_components(t, cfg))
    audit = kidney_audit(parts, t["voxels"], cfg)
    mine = audit.join(parts.select(*KEY, F.col("part").alias("measured"), "cm3", "sample_cm3", "hu", "deviation", "complete").hint("merge"), [*KEY, "measured"], "left")
    age = t["patients"].select("study", (F.col("age") if "age" in t["patients"].columns else F.lit(None)).cast("int").alias("age"))
    mine = mine.join(age.hint("merge"), "study", "left")
    vague = F.col("measured").isNotNull() & F.col("native").isNull()
    alert = F.when(F.col("cm3").isNotNull(), predicates.volume_alert(F.lit("kidney"), F.col("cm3"), F.col("age"), vague))
    rule = F.when(F.col("age") < 16, "pediatric_fixed_threshold_suppressed").when(F.col("age").isNull(), "age_unavailable_fixed_threshold_retained").otherwise("fixed_threshold_applied")
    role = F.when(vague, "renal_component_anatomy_indeterminate").otherwise("native_kidney")
    return mine.select(*KEY, "status", role.alias("role"), "measured", "cm3", "sample_cm3", "hu", "deviation", "complete", alert.alias("alert"), rule.alias("alert_rule"))
