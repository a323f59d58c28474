"""Rule classifications over the measures view."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.functions import predicates as P
from voxelweave.functions import rules as R
from voxelweave.operators import metrics, windows
from voxelweave.plans.catalog import Tables, query

c, L = F.col, F.lit
CLASS = "case when hu is null then 'indeterminate' when hu > 160 then 'normal' when hu >= 100 then 'osteopenia' else 'osteoporosis' end"
COUNT = "select case_id, {} as value, count(*) as n from ({}) group by 1, 2"


def counted(df, value):
    """Cases hold several rows of a kind, so values are counted by case."""
    return df.groupBy("case_id", value.alias("value")).agg(F.count("*").alias("n"))


@query(COUNT.format(CLASS, "select case_id, case when voxels < 10 then null else hu end as hu from measures"))
def l1_class(t: Tables):
    return counted(t.measures, R.l1_class(F.when(c("voxels") >= 10, c("hu"))))


QC = "concat_ws(',', case when not complete then 'mask_incomplete' end, case when voxels < 25 then 'low_voxel_count' end, case when kvp < 110 or kvp > 130 then 'kvp_out_of_range' end, case when flag then 'contrast_present' end, case when thickness > 3 then 'slice_thickness_high' end)"


@query(f"select case_id, concat(case when complete and voxels >= 25 and coalesce(kvp between 110 and 130, true) and not coalesce(flag, false) and thickness <= 3 then 'pass:' else 'fail:' end, {QC}) as value, count(*) as n from measures group by 1, 2")
def bone_qc(t: Tables):
    q = R.bone_qc(L("CT"), c("complete"), c("voxels"), c("kvp"), c("flag"), c("thickness"), strict=True, most_mm=3.0)
    return counted(t.measures, F.concat(F.when(q["passed"], "pass:").otherwise("fail:"), F.array_join(q["reasons"], ",")))


COMPOSITE = """select *, case when hu is null and not coalesce(flag, false) then 'indeterminate' when s >= 70 then 'high' when s >= 35 then 'moderate' else 'low' end as level,
  concat_ws(',', case label when 'osteoporosis' then 'low_hu' when 'osteopenia' then 'borderline_hu' when 'normal' then 'preserved_hu' end, case when flag then 'fracture_suspicion' when flag is null then 'fracture_unknown' end, case when not ok then 'qc_failed' when ok is null then 'qc_unknown' end) as why
 from (select *, case when ok = false then greatest(0, s0 - 20) else s0 end as s from (select *, case label when 'osteoporosis' then 60 when 'osteopenia' then 35 when 'normal' then 5 else 0 end + case when flag then 35 else 0 end as s0
 from (select *, case when hu is null then 'indeterminate' when hu > 160 then 'normal' when hu >= 100 then 'osteopenia' else 'osteoporosis' end as label from ({}))))"""


@query("select case_id, concat_ws(':', level, cast(least(s, 100) as varchar), label, why) as value, count(*) as n from (" + COMPOSITE.format("select case_id, flag, case when ordinal % 3 = 0 then null else complete end as ok, case when voxels < 10 then null else hu end as hu from measures") + ") group by 1, 2")
def osteoporosis_composite(t: Tables):
    q = R.osteoporosis_composite(L(None).cast("bigint"), F.when(c("voxels") >= 10, c("hu")), c("flag"), F.when(c("ordinal") % 3 != 0, c("complete")))
    return counted(t.measures, F.concat_ws(":", q["level"], q["score"].cast("string"), q["label"], F.array_join(q["reasons"], ",")))


@query("""select case_id, case when liver is null then 'none' when not complete then 'liver_sample_insufficient' when kvp is null or kvp not between 115 and 125 then 'kvp_out_of_range' when liver >= 50 then 'normal' when voxels < 20 or spleen_hu = 0 then 'spleen_sample_insufficient' when liver / cast(spleen_hu as double) > 1 then 'normal'
 else concat('estimated ', cast(cast(floor(greatest(0.0, cast(-0.58 as double) * liver + cast(38.2 as double)) + 0.5) as int) as varchar)) end as value, count(*) as n from (select *, case when voxels < 6 then null else hu end as liver from measures) group by 1, 2""")
def steatosis(t: Tables):
    q = R.steatosis(F.when(c("voxels") >= 6, c("hu")), c("spleen_hu"), c("kvp"), c("complete"), c("voxels") >= 20)
    return counted(t.measures, F.coalesce(F.concat_ws(" ", q["status"], q["percent"].cast("string")), L("none"))).withColumn("value", F.when(c("value") == "", "none").otherwise(c("value")))


@query("select case_id, ordinal, sum(round(greatest(0.0, cast(-0.58 as double) * hu + cast(38.2 as double)), 2)) as pdff from measures group by 1, 2")
def pdff(t: Tables):
    return t.measures.groupBy("case_id", "ordinal").agg(F.sum(R.pdff(c("hu"))).alias("pdff"))


@query("select case_id, case when ordinal % 3 = 0 and volume > 1800 then 'enlarged_liver' when ordinal % 3 = 1 and volume > 400 then 'enlarged_spleen' when ordinal % 3 = 2 and volume < 100 and voxels >= 16 and not coalesce(flag, false) then 'small_kidney' end as value, count(*) as n from measures group by 1, 2")
def volume_alert(t: Tables):
    organ = F.when(c("ordinal") % 3 == 0, "liver").when(c("ordinal") % 3 == 1, "spleen").otherwise("kidney")
    return counted(t.measures, P.volume_alert(organ, c("volume"), c("voxels"), c("flag")))


# heights and depths on a grid of twentieths, so that every limit is met exactly by some
FRAC = """select *, case when a is null or top <= 0 then null else (1 - low / top) * 100 end as loss, top / nullif(d, 0) as flat from (select *, greatest(a, m, p) as top, least(a, m, p) as low
 from (select case_id, ordinal, complete, case when voxels % 17 = 0 then null else cast(voxels % 12 + 9 as double) end as a, cast(spleen_hu % 13 + 8 as double) as m, cast(20 - ordinal % 9 * 2 as double) as p, cast(case when flag then 20 else 40 end as double) as d from measures))"""
GRADE = f"""select *, case when g > 0 then case when a / p <= cast(0.8 as double) and m / p >= cast(0.85 as double) then 'wedge' when m <= cast(0.8 as double) * least(a, p) and abs(a - p) / greatest(a, p) <= cast(0.15 as double) then 'biconcave'
  when flat <= cast(0.55 as double) then 'crush' when a = low then 'wedge' when m = low then 'biconcave' when flat <= cast(0.65 as double) then 'crush' end end as pattern
 from (select *, case when loss > 40 then 3 when loss >= 25 then 2 when loss >= 20 then 1 when loss is not null then 0 end as g from ({FRAC}))"""


def _graded(t: Tables):
    a = F.when(c("voxels") % 17 != 0, (c("voxels") % 12 + 9).cast("double"))
    m, p = (c("spleen_hu") % 13 + 8).cast("double"), (20 - c("ordinal") % 9 * 2).cast("double")
    return t.measures.select("*", R.fracture_grade(a, m, p, F.when(c("flag"), 20.0).otherwise(40.0)).alias("g"))


@query(f"select case_id, concat_ws(' ', cast(g as varchar), coalesce(case g when 0 then 'none' when 1 then 'mild' when 2 then 'moderate' when 3 then 'severe' end, 'indeterminate'), pattern) as value, count(*) as n from ({GRADE}) group by 1, 2")
def fracture_grade(t: Tables):
    return counted(_graded(t), F.concat_ws(" ", c("g.grade").cast("string"), c("g.severity"), c("g.pattern")))


@query(f"select case_id, max(g) filter (complete) as max_grade, coalesce(bool_or(g > 0) filter (complete), false) as suspicion, coalesce(case max(coalesce(g, -1)) filter (complete) when 0 then 'none' when 1 then 'mild' when 2 then 'moderate' when 3 then 'severe' end, 'indeterminate') as severity, count(*) filter (complete) as n_analyzed, count(*) filter (not complete) as n_incomplete from ({GRADE}) group by case_id")
def fracture_rollup(t: Tables):
    return windows.fracture_rollup(_graded(t).select("case_id", "complete", c("g.grade").alias("grade")), ["case_id"], c("complete"))


@query("select case_id, coalesce(try_cast(v as double) > 0.1, false) as value, count(*) as n from (select case_id, case when flag is null then null when ordinal % 3 = 0 then 'none' else cast(spleen_hu * cast(0.01 as double) as varchar) end as v from measures) group by 1, 2")
def hemorrhage_flag(t: Tables):
    v = F.when(c("flag").isNotNull(), F.when(c("ordinal") % 3 == 0, "none").otherwise((c("spleen_hu") * 0.01).cast("string")))
    return counted(t.measures, R.hemorrhage(v))


@query("select case_id, case when flag and complete then 'processed' when flag then 'metrics' when voxels > 90 then 'segmentation' when voxels > 80 then 'queued' when voxels > 70 then 'ineligible' when voxels > 60 then 'failed' when voxels > 50 then 'prepare' when voxels > 40 then 'prepared' else 'intake' end as value, count(*) as n from measures group by 1, 2")
def stage_of_case(t: Tables):
    v = c("voxels")
    return counted(t.measures, R.stage_of_case(c("flag") & c("complete"), c("flag"), v > 90, v > 80, v > 70, v > 60, v > 50, v > 40))


@query("select case_id, concat(case when flag is not null then flag else complete end, ' ', case when flag is not null then 'request' else 'host_default' end) as value, count(*) as n from measures group by 1, 2")
def qc_tristate(t: Tables):
    q = R.qc_tristate(c("flag"), c("complete"))
    return counted(t.measures, F.concat_ws(" ", q["enabled"].cast("string"), q["reason"]))


@query("select event_id, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status from events")
def job_status(t: Tables):
    told = F.when(c("event_type") == "purchase", "case_completed").when(c("event_type") == "error", "case_failed").otherwise(c("event_type"))
    return t.events.select("event_id", R.job_status(told, L("running")).alias("status"))


@query("select case_id, ordinal, count(case when volume > 100 then hu end) as n_hu, sum(least(100.0, greatest(0.0, cast(hu as double)))) as fat from (select * from measures) group by 1, 2")
def legacy_organ_cleanup(t: Tables):
    q = R.legacy_organ(c("volume") / 1000, c("hu"), c("hu").cast("double"))
    return t.measures.groupBy("case_id", "ordinal").agg(F.count(q["hu"]).alias("n_hu"), F.sum(q["pdff"]).alias("fat"))


@query("select uid, case when z_spacing_mm between 1 and 3 and thickness_mm between 1 and 4 then 'soft_tissue' when z_spacing_mm <= 1 and thickness_mm >= 2 then 'lung' else 'other' end as cls from series")
def window_class(t: Tables):
    return t.series.select("uid", P.window_class(c("z_spacing_mm"), c("thickness_mm"), (1, 3, 1, 4), (1, 2)).alias("cls"))


@query("select case_id, sum(case when s >= 50 then v else 0 end) as kept, count(*) filter (s < 50) as dropped from (select case_id, ordinal % 2 as side, sum(voxels) as v, sum(voxels) as s from measures group by 1, 2) group by case_id")
def effusion_qc(t: Tables):
    sides = t.measures.groupBy("case_id", (c("ordinal") % 2).alias("side")).agg(F.sum("voxels").alias("v"))
    return windows.effusion_qc(sides, ["case_id"], "v", 50)


PAYLOADS = """select case_id, max(k) filter (metric = 'view' and k % 4 <> 0) as hu_mean, max(k) filter (metric = 'click' and k % 3 <> 0) as vol_hu, max(k) filter (metric = 'click') as full_hu, max(case when k > 80 then 1 when k > 30 then 0 end) filter (metric = 'purchase') = 1 as flag,
  coalesce(max(case when k > 20 then 1 else 0 end) filter (metric = 'view'), max(case when k > 20 then 1 else 0 end) filter (metric = 'click')) = 1 as ok from (select study as case_id, metric, cast(json_extract(measurement, '$.k') as double) as k from payloads) group by case_id"""


@query("select case_id, coalesce(hu_mean, vol_hu) as preferred_hu, full_hu, flag as fracture, ok as qc_pass, level, least(s, 100) as score, label, why as reasons, case when flag then 'review_for_vertebral_fracture_and_consider_dxa' when level = 'high' then 'consider_dxa_or_bone_health_follow_up' when level = 'moderate' then 'nonurgent_bone_health_review' else 'no_immediate_bone_health_escalation' end as recommendation from (" + COMPOSITE.format(f"select *, coalesce(hu_mean, vol_hu, full_hu) as hu from ({PAYLOADS})") + ")")
def composite_join(t: Tables):
    """Payloads of three metrics under one case, with values that lack in some."""
    k = F.get_json_object("measurement", "$.k").cast("double")
    of = lambda m, v: F.max(F.when(c("metric") == m, v))
    flag = F.when(k > 80, 1).when(k > 30, 0)
    ok = F.when(k > 20, 1).when(k.isNotNull(), 0)
    rows = t.payloads.select(c("study").alias("case_id"), "metric", k.alias("k"), flag.alias("flag"), ok.alias("ok"))
    hu = rows.groupBy("case_id").agg(of("view", F.when(c("k") % 4 != 0, c("k"))).alias("trabecular_hu"), (of("view", c("ok")) == 1).alias("qc_pass"))
    vol = rows.where("metric = 'click'").groupBy("case_id").agg(F.max(F.when(c("k") % 3 != 0, c("k"))).alias("trabecular_hu"), F.max("k").alias("full_hu"), (F.max("ok") == 1).alias("qc_pass"))
    frac = rows.groupBy("case_id").agg((of("purchase", c("flag")) == 1).alias("suspicion"))
    got = metrics.composite(hu, vol, frac, "case_id")
    return got.select("case_id", "preferred_hu", "full_hu", "fracture", "qc_pass", "level", "score", "label", F.array_join("reasons", ",").alias("reasons"), "recommendation")
