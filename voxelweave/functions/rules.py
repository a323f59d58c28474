"""Rule classifications over joined measures, as case expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelweave.functions.predicates import reasons


def l1_class(hu: Column, normal: float = 160, low: float = 100) -> Column:
    """normal above 160, osteopenia from 100 on, osteoporosis below, indeterminate if unknown."""
    return F.when(hu.isNull(), "indeterminate").when(hu > normal, "normal").when(hu >= low, "osteopenia").otherwise("osteoporosis")


def bone_qc(modality: Column, complete: Column, voxels: Column, kvp: Column, contrast: Column, thickness: Column, strict: bool = False, least: int = 25, kvp_range: tuple[float, float] = (110, 130), most_mm: float = 5.0) -> Column:
    """struct(passed, reasons): core flags fail the check, advisory ones only in strict mode; unknown facts don't count against it."""
    ct = F.coalesce(F.upper(F.trim(modality)) == "CT", F.lit(True))
    enough = F.coalesce(voxels, F.lit(0)) >= least
    in_range, thin = kvp.between(*kvp_range), thickness <= most_mm
    why = reasons((~ct, "non_ct_modality"), (~complete, "mask_incomplete"), (~enough, "low_voxel_count"), (~in_range, "kvp_out_of_range"), (contrast, "contrast_present"), (~thin, "slice_thickness_high"))
    ok = ct & complete & enough
    if strict:
        ok = ok & F.coalesce(in_range, F.lit(True)) & ~F.coalesce(contrast, F.lit(False)) & F.coalesce(thin, F.lit(True))
    return F.struct(ok.alias("passed"), why.alias("reasons"))


def osteoporosis_composite(trabecular: Column, full: Column, fracture: Column, qc_pass: Column, density: Column | None = None) -> Column:
    """struct(level, score, label, reasons): 60, 35 or 5 by density, 35 for a fracture, 20 off for a failed check.

    The density class is that of the trabecular value, else of the full one, unless it is given.
    """
    hu = F.coalesce(trabecular, full)
    label = F.coalesce(density, l1_class(hu)) if density is not None else l1_class(hu)
    score = F.when(label == "osteoporosis", 60).when(label == "osteopenia", 35).when(label == "normal", 5).otherwise(0)
    score = score + F.when(fracture, 35).otherwise(0)
    score = F.when(~qc_pass, F.greatest(F.lit(0), score - 20)).otherwise(score)
    level = F.when(hu.isNull() & ~F.coalesce(fracture, F.lit(False)), "indeterminate").when(score >= 70, "high").when(score >= 35, "moderate").otherwise("low")
    why = F.array(
        F.when(label == "osteoporosis", "low_hu").when(label == "osteopenia", "borderline_hu").when(label == "normal", "preserved_hu"),
        F.when(fracture, "fracture_suspicion").when(fracture.isNull(), "fracture_unknown"),
        F.when(~qc_pass, "qc_failed").when(qc_pass.isNull(), "qc_unknown"),
    )
    return F.struct(level.alias("level"), F.least(score, F.lit(100)).alias("score"), label.alias("label"), F.array_compact(why).alias("reasons"))


def recommendation(fracture: Column, level: Column) -> Column:
    """What to do next: a fracture first, then by the composite's level."""
    return (
        F.when(fracture, "review_for_vertebral_fracture_and_consider_dxa").when(level == "high", "consider_dxa_or_bone_health_follow_up")
        .when(level == "moderate", "nonurgent_bone_health_review").otherwise("no_immediate_bone_health_escalation")
    )


def pdff(hu: Column) -> Column:
    """Fat fraction in percent estimated from plain-scan density."""
    return F.round(F.greatest(F.lit(0.0), F.lit(-0.58) * hu + 38.2), 2)


def steatosis(liver: Column, spleen: Column, kvp: Column, liver_ok: Column, spleen_ok: Column, kvp_range: tuple[float, float] = (115, 125)) -> Column:
    """struct(status, percent); null without a liver value. Checks in order: liver sample, tube voltage, density, spleen sample, ratio."""
    ratio = F.try_divide(liver.cast("double"), F.nullif(spleen.cast("double"), F.lit(0.0)))
    status = (
        F.when(liver.isNull(), None)
        .when(~liver_ok, "liver_sample_insufficient")
        .when(~F.coalesce(kvp.between(*kvp_range), F.lit(False)), "kvp_out_of_range")
        .when(liver >= 50, "normal")
        .when(~spleen_ok | ratio.isNull(), "spleen_sample_insufficient")
        .when(ratio > 1, "normal")
        .otherwise("estimated")
    )
    percent = F.when(status == "estimated", F.floor(F.greatest(F.lit(0.0), F.lit(-0.58) * liver + 38.2) + 0.5).cast("int"))
    return F.struct(status.alias("status"), percent.alias("percent"))


def grade_of_loss(percent: Column) -> Column:
    """0 to 3 by height loss: 1 from 20 percent on, 2 from 25 on, 3 above 40."""
    return F.when(percent > 40, 3).when(percent >= 25, 2).when(percent >= 20, 1).when(percent.isNotNull(), 0)


def fracture_grade(anterior: Column, middle: Column, posterior: Column, depth: Column | None = None, confident: Column | None = None, wedge: float = 0.80, biconcave: float = 0.80, crush: float = 0.55) -> Column:
    """struct(grade, severity, pattern, loss_percent, status, confidence) of a vertebra by its three heights and its depth front to back.

    The loss is that of the lowest height against the highest. The pattern of a grade above 0 is wedge if the front is
    at most `wedge` of the back and the middle is not; biconcave if the middle is at most `biconcave` of the lower end and the
    ends differ by 15 percent at most; crush if the highest is at most `crush` of the depth; else it follows the lowest
    height, and a low back is crush only up to 0.10 above that bound. `confident` false caps the confidence at 0.65. A
    missing height leaves all indeterminate.
    """
    a, m, p = (x.cast("double") for x in (anterior, middle, posterior))
    known = a.isNotNull() & m.isNotNull() & p.isNotNull()
    top, low = F.greatest(a, m, p), F.least(a, m, p)
    loss = F.when(known & (top > 0), (1 - low / top) * 100)
    grade = grade_of_loss(loss)
    flat = F.when(depth > 0, top / depth) if depth is not None else F.lit(None).cast("double")
    front, mid = F.try_divide(a, F.nullif(p, F.lit(0.0))), F.try_divide(m, F.nullif(p, F.lit(0.0)))
    pattern = (
        F.when((front <= wedge) & (mid >= min(0.98, wedge + 0.05)), "wedge")
        .when((F.least(a, p) > 0) & (m <= biconcave * F.least(a, p)) & (F.abs(a - p) / F.greatest(a, p) <= 0.15), "biconcave")
        .when(flat <= crush, "crush").when(a == low, "wedge").when(m == low, "biconcave").when(flat <= crush + 0.10, "crush")
    )
    severity = F.when(grade == 0, "none").when(grade == 1, "mild").when(grade == 2, "moderate").when(grade == 3, "severe").otherwise("indeterminate")
    status = F.when(grade.isNull(), "indeterminate").when(grade > 0, "suspected").otherwise("no_suspicion")
    sure = F.when(grade > 0, F.least(F.lit(1.0), loss / 100)).otherwise(0.0)
    sure = sure if confident is None else F.when(~confident, F.least(sure, F.lit(0.65))).otherwise(sure)
    return F.struct(grade.alias("grade"), severity.alias("severity"), F.when(grade > 0, pattern).alias("pattern"), loss.alias("loss_percent"), status.alias("status"), sure.alias("confidence"))


def stage_of_case(processed: Column, metrics: Column, segmentation: Column, queued: Column, ineligible: Column, failed: Column, preparing: Column, prepared: Column) -> Column:
    """The stage a case is in: the first fact that holds, in this order."""
    return (
        F.when(processed, "processed").when(metrics, "metrics").when(segmentation, "segmentation").when(queued, "queued")
        .when(ineligible, "ineligible").when(failed, "failed").when(preparing, "prepare").when(prepared, "prepared").otherwise("intake")
    )


def job_status(delivery: Column, pipeline: Column) -> Column:
    """A delivery event's status overrides that of the pipeline."""
    told = F.when(delivery.isin("case_completed", "delivered"), "completed").when(delivery.isin("case_failed", "failed"), "failed")
    return F.coalesce(told, pipeline)


def qc_tristate(asked: Column, default: Column) -> Column:
    """struct(enabled, reason): what was asked for, else the host's default."""
    return F.struct(F.coalesce(asked, default, F.lit(False)).alias("enabled"), F.when(asked.isNotNull(), "request").otherwise("host_default").alias("reason"))


def legacy_organ(volume: Column, hu: Column, fat: Column) -> Column:
    """struct(hu, pdff): no density for a volume up to 0.1, fat fraction within 0 and 100."""
    return F.struct(F.when(volume > 0.1, hu).alias("hu"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), fat)).alias("pdff"))


def hemorrhage(volume_cm3: Column) -> Column:
    """Whether a bleed's volume is a number above 0.1 cm3; text that is no number and null are not."""
    return F.coalesce(volume_cm3.try_cast("double") > 0.1, F.lit(False))
