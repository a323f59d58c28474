"""Series geometry, rejection, ranking, equivalence and grouping over the series views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.functions import predicates as P
from voxelweave.operators import series as S
from voxelweave.operators import windows
from voxelweave.plans.catalog import Tables, query

c, L = F.col, F.lit


@query("""with g as (select series, median(g) as z from (select series, p - lag(p) over (partition by series order by p) as g from (select distinct series, round(position, 4) as p from instances)) where g > 1e-4 group by series)
 select b.series, n_images, thickness_mm, spacing_mm, z as z_spacing_mm, case when np > 1 then hi - lo else (n_images - 1) * spacing_mm end as coverage_mm, case when np > 1 then 'position' when spacing_mm is not null then 'estimated' else 'none' end as confidence
 from (select series, count(*) as n_images, median(case when thickness > 0 then thickness end) as thickness_mm, median(case when spacing > 0 then spacing end) as spacing_mm, min(position) as lo, max(position) as hi, count(distinct position) as np from instances group by series) b left join g on g.series = b.series""")
def series_geometry(t: Tables):
    return S.series_geometry(t.instances, "series", "position", "thickness", "spacing")


@query("select series, count(position) > count(distinct position) as is_4d from instances group by series")
def is_4d(t: Tables):
    return S.is_4d(t.instances, "series", "position")


@query("select series, n, case when n < 3 then 'below_min_images_3' end as reason from (select series, count(*) as n from instances group by series)")
def split_min_images(t: Tables):
    return S.split_min_images(t.instances.groupBy("series").agg(F.count("*").alias("n")), "n", 3)


@query("select study, weight from (select study, weight, row_number() over (partition by study order by series, instance, position, weight) as r from instances where weight is not null) where r = 1")
def study_biometrics(t: Tables):
    return S.study_biometrics(t.instances, "study", "weight", ["series", "instance", "position", "weight"])


NORMAL = "case when trim(phase) = '' then 'unknown' else phase end"
REASON = f"""case when modality <> 'CT' then concat('modality_mismatch:', modality) when slice_count < 40 then concat('below_min_slices:', cast(slice_count as varchar)) when contains(lower(description), 'gear') then 'description_rejected:gear'
 when contains(lower(kernel), 'lung') then 'kernel_rejected_contains:lung' when trim(lower(kernel)) = 'b30f' then 'kernel_rejected_exact:b30f' when {NORMAL} not in ('native', 'portal_venous') and not (phase like '%arterial%' or phase like '%venous%') then concat('phase_not_allowed:', {NORMAL}) end"""
RANK = f"case {NORMAL} when 'native' then 0 when 'portal_venous' then 1 else case when phase like '%arterial%' or phase like '%venous%' then 2 end end"
ARGS = ("CT", 40, ["gear"], ["lung"], ["b30f"], ["native", "portal_venous"])


@query(f"select uid, {RANK} as phase_rank, {REASON} as reason from series")
def series_reject(t: Tables):
    return S.reject(t.series, *ARGS).select("uid", "phase_rank", "reason")


KEPT = f"select *, {RANK} as phase_rank, case when coverage_mm > 0 then coverage_mm end as cov, coalesce(case when z_spacing_mm > 0 then z_spacing_mm end, case when thickness_mm > 0 then thickness_mm end) as eff from series where ({REASON}) is null"
TIER = f"select *, case when cov is null or best is null then 2 when cov >= greatest(best * cast(0.92 as double), best - 50) then 0 else 1 end as tier from (select *, max(cov) over (partition by study, phase_rank) as best from ({KEPT}))"
PREF = "(case when kernel = 'soft standard' then -2 when kernel = 'bone sharp' then 2 when kernel = 'Lung 60' then 1 else 0 end)"
RANKED = f"select *, row_number() over (partition by study order by phase_rank, cov is null, tier, case when tier = 0 then eff end asc nulls last, {PREF}, coalesce(cov, 0) desc, phase_detected desc, probability desc, slice_count desc, series_number) as place from ({TIER})"


def _ranked(t: Tables):
    return S.rank_series(S.reject(t.series, *ARGS).where("reason is null"))


@query(f"select uid, tier from ({TIER})")
def coverage_tier(t: Tables):
    return _ranked(t).select("uid", "tier")


@query(f"select study, uid, phase_rank, tier, slice_count from ({RANKED}) where place = 1")
def select_series(t: Tables):
    return _ranked(t).where("place = 1").select("study", "uid", "phase_rank", "tier", "slice_count")


@query(f"""with r as ({RANKED}), p as (select study, max(uid) as previous from r group by study), f as (select r.*, r.uid = p.previous as again, bool_or(r.place = 1 and r.uid = p.previous) over (partition by r.study) as redo from r join p on p.study = r.study)
 select study, uid from (select *, row_number() over (partition by study order by case when redo then cast(again as int) else 0 end, case when redo and kernel = 'bone sharp' then 0 else 1 end, place) as c from f) where c = 1""")
def follow_up_choice(t: Tables):
    r = _ranked(t)
    previous = r.groupBy("study").agg(F.max("uid").alias("previous_uid"))
    return S.follow_up_choice(r, previous, "study", "uid", c("kernel"), "bone sharp").select("study", "uid")


RULES = "(select * from (values ('', 'ring', 1), ('LARGE', 'gear', -2), ('ECONOMY', 'widget', 3), ('', 'blue', -1)) v(maker_token, token, weight))"


@query(f"select p_partkey, coalesce(sum(weight), 0) as score, count(token) as n_rules from part left join {RULES} r on (maker_token = '' or contains(p_type, maker_token)) and contains(p_name, token) group by p_partkey")
def hint_rules(t: Tables):
    rules = t.spark.createDataFrame([("", "ring", 1), ("LARGE", "gear", -2), ("ECONOMY", "widget", 3), ("", "blue", -1)], "maker_token string, token string, weight int")
    return S.hint_rules(t.part.select("p_partkey", c("p_type").alias("maker"), c("p_name").alias("text")), "p_partkey", rules)


@query("select uid, case when contains(lower(description), 'ring') then 'abdomen' else 'unknown' end as region, contains(upper(description), 'SMALL') as small from series")
def series_region_hint(t: Tables):
    text = F.when(F.contains(F.lower("description"), L("ring")), F.concat(L("ABDÔMEN "), c("description"))).otherwise(c("description"))
    return t.series.select("uid", P.region_hint(text).alias("region"), F.contains(F.upper("description"), L("SMALL")).alias("small"))


@query("select uid, p = 0 or d = 1 as derived, d = 2 as localizer from (select uid, slice_count % 3 as p, cast(length(description) % 4 as int) as d from series)")
def series_kind_flags(t: Tables):
    d = F.length("description") % 4
    text = F.when(d == 1, F.concat("description", L(" mip"))).when(d == 2, F.concat("description", L(" scout"))).otherwise(c("description"))
    k = P.kind_flags(text, F.when(c("slice_count") % 3 == 0, F.array(L("derived"), L("primary"))).otherwise(F.array(L("original"))))
    return t.series.select("uid", k["derived"].alias("derived"), k["localizer"].alias("localizer"))


@query(f"select uid, modality = 'CT' and ({NORMAL} in ('native', 'portal_venous') or phase like '%arterial%' or phase like '%venous%') as plain, modality = 'CT' and {NORMAL} = 'arterial' as arterial from series")
def profile_gate(t: Tables):
    return t.series.select("uid", P.profile_gate(c("modality"), c("phase"), "CT", ["native"]).alias("plain"), P.profile_gate(c("modality"), c("phase"), "CT", ["arterial"]).alias("arterial"))


def _recons(t: Tables):
    """Slices tilted around the first axis, so two are parallel if their tilts are alike."""
    tilt = F.radians(c("tilt"))
    return t.recons.withColumn("orientation", F.when(tilt.isNotNull(), F.array(L(1.0), L(0.0), L(0.0), L(0.0), F.cos(tilt), F.sin(tilt))))


# what two series say about each other, from the rules: each is null where one of them says nothing
SAID = """select a.study, a.uid as left_uid, b.uid as right_uid, a.modality <> b.modality as m, nullif(a.frame, '') = nullif(b.frame, '') as f, nullif(a.acquisition, '') = nullif(b.acquisition, '') as n,
  coalesce(nullif(a.phase, ''), 'unknown') as pa, coalesce(nullif(b.phase, ''), 'unknown') as pb, abs(epoch(strptime(substr(a.acquired_at, 1, 14), '%Y%m%d%H%M%S')) - epoch(strptime(substr(b.acquired_at, 1, 14), '%Y%m%d%H%M%S'))) <= 30 as t,
  case when a.low_mm is not null and b.low_mm is not null then greatest(0.0, least(a.high_mm, b.high_mm) - greatest(a.low_mm, b.low_mm)) / least(a.high_mm - a.low_mm, b.high_mm - b.low_mm) end as o, case when not a.derived and not b.derived then abs(a.tilt - b.tilt) <= 5 end as p
 from recons a join recons b on a.study = b.study and a.uid < b.uid"""
PAIRS = f"""select study, left_uid, right_uid, case when m then 'modality_conflict' when not f then 'frame_of_reference_conflict' when pa <> 'unknown' and pb <> 'unknown' and pa <> pb then 'contrast_phase_conflict' when not n then 'acquisition_number_conflict'
  when not t then 'acquisition_time_conflict' when o < 0.8 then 'insufficient_spatial_overlap' when not p then 'orientation_conflict' when not (coalesce(n and f, false) or (coalesce(t, false) and o is not null)) then 'insufficient_equivalence_evidence' end as conflict,
  concat_ws(',', case when f then 'same_frame_of_reference' end, case when pa = pb then 'same_contrast_phase' end, case when n then 'same_acquisition_number' end, case when t then 'acquisition_time_proximity' end, case when o is not null then 'spatial_overlap' end, case when p then 'parallel_orientation' end) as why from ({SAID})"""


@query(f"select study, left_uid, right_uid, conflict is null as equivalent, coalesce(conflict, why) as reasons from ({PAIRS})")
def series_equivalence(t: Tables):
    return S.equivalence(_recons(t), "study", "uid")


@query(f"select study, left_uid, right_uid, why as reasons from ({PAIRS}) where conflict is null")
def equivalent_pairs(t: Tables):
    return S.equivalent_pairs(_recons(t), "study", "uid").drop("equivalent")


@query(f"""with recursive e as materialized (select left_uid, right_uid from ({PAIRS}) where conflict is null), s as materialized (select study, uid, row_number() over (partition by study order by uid) as k from recons),
 f(study, k, leaders, uid, leader) as (select study, k, [uid], uid, uid from s where k = 1 union all
  select s.study, s.k, case when x.l is null then list_append(f.leaders, s.uid) else f.leaders end, s.uid, coalesce(x.l, s.uid) from f join s on s.study = f.study and s.k = f.k + 1
  left join lateral (select min(e.left_uid) as l from e where e.right_uid = s.uid and list_contains(f.leaders, e.left_uid)) x on true)
 select study, uid, leader from f""")
def group_series(t: Tables):
    df = _recons(t)
    return S.group_series(df, S.equivalent_pairs(df, "study", "uid"), "study", "uid")


@query(f"""select study, acquisition, uid from (select *, row_number() over (partition by study, acquisition order by cov < greatest(best * cast(0.92 as double), best - 50), coalesce(nullif(z_spacing_mm, 0), nullif(thickness_mm, 0), 9999), case when kernel = 'soft standard' then -2 else (case when kernel = 'bone sharp' then 2 when kernel = 'Lung 60' then 1 else 0 end) - cast(contains(description, 'STANDARD') as int) end, cov desc, slice_count desc, uid) as r
 from (select *, coalesce(coverage_mm, 0) as cov, max(coalesce(coverage_mm, 0)) over (partition by study, acquisition) as best from series)) where r = 1""")
def pick_representative(t: Tables):
    return S.pick_representative(t.series, ["study", "acquisition"]).select("study", "acquisition", "uid")


@query("""select uid, vol as volumetric, fit as segmentable, concat_ws(',', case when d = 1 then 'derived_series' end, case when conf <> 'position' then 'incomplete_geometry' end, case when modality = 'MR' then 'no_configured_mr_segmenter' end, case when not conv then 'no_converted_volume' end, case when fit then 'ct_compatible' end) as reasons, case when fit then 'segmentation_pending' else 'not_segmentable' end as status
 from (select *, modality = 'CT' and vol and d <> 1 and conv as fit from (select *, slice_count >= 2 and conf <> 'none' as vol from (select *, length(description) % 4 as d, case when coverage_mm is null then 'none' when z_spacing_mm > 0 then 'position' else 'estimated' end as conf, probability > 0.3 as conv from series)))""")
def series_classify(t: Tables):
    df = t.series.withColumns({"confidence": F.when(c("coverage_mm").isNull(), "none").when(c("z_spacing_mm") > 0, "position").otherwise("estimated"), "converted": c("probability") > 0.3, "image_type": F.when(F.length("description") % 4 == 1, F.array(L("derived"))).otherwise(F.array(L("original")))})
    return S.classify(df).select("uid", "volumetric", "segmentable", "reasons", "status")


MID = """select study, ordinal, case when b is not null then center - (center - b) / 2 when a is not null then center + (center - a) / 2 end as l, case when a is not null then center - (center - a) / 2 when b is not null then center + (center - b) / 2 end as h
 from (select *, lag(center) over w as b, lead(center) over w as a from levels window w as (partition by study order by ordinal))"""


@query(f"select study, ordinal, least(l, h) as low, greatest(l, h) as high from ({MID})")
def midpoint_slabs(t: Tables):
    return windows.midpoint_slabs(t.levels, ["study"], "ordinal", "center").select("study", "ordinal", "low", "high")


@query("select study, first, length from (select *, row_number() over (partition by study order by length desc, first) as r from (select study, min(ordinal) as first, count(*) as length from (select study, ordinal, ordinal - row_number() over (partition by study order by ordinal) as i from levels) group by study, i)) where r = 1")
def longest_block(t: Tables):
    return windows.longest_block(t.levels, ["study"], "ordinal")


@query("""select study, ordinal, round(ref, 6) as reference, round(1 - height / ref, 6) as loss from (select *, case when b is not null and a is not null then (b + a) / 2 else coalesce(b, a) end as ref from (select *, last_value(v ignore nulls) over (partition by study order by ordinal rows between unbounded preceding and 1 preceding) as b, first_value(v ignore nulls) over (partition by study order by ordinal rows between 1 following and unbounded following) as a from (select *, case when center > 10 then height end as v from levels)))""")
def adjacent_reference(t: Tables):
    r = windows.adjacent_reference(t.levels, ["study"], "ordinal", "height", c("center") > 10)
    return r.select("study", "ordinal", F.round("reference", 6).alias("reference"), F.round("loss", 6).alias("loss"))


@query("select study, ordinal, round(sum(center) over (partition by study order by ordinal rows between 1 preceding and 1 following) / 3, 6) as smooth, median(center) over (partition by study order by ordinal rows between 2 preceding and 2 following) as median from levels")
def moving_windows(t: Tables):
    r = windows.moving_average(t.levels, ["study"], "ordinal", "center")
    return windows.window_median(r, ["study"], "ordinal", "center").select("study", "ordinal", F.round("smooth", 6).alias("smooth"), "median")


@query("""with k as (select study, ordinal, case when center % 3 <> 0 then center end as v from levels), n as (select k.study, k.ordinal, k.v, max(p.ordinal) as po, min(q.ordinal) as qo from k left join k p on p.study = k.study and p.ordinal <= k.ordinal and p.v is not null left join k q on q.study = k.study and q.ordinal >= k.ordinal and q.v is not null group by 1, 2, 3)
 select n.study, n.ordinal, round(coalesce(n.v, p.v + (q.v - p.v) * (n.ordinal - n.po) / (n.qo - n.po), p.v, q.v), 6) as filled from n left join k p on p.study = n.study and p.ordinal = n.po left join k q on q.study = n.study and q.ordinal = n.qo""")
def interpolate_gaps(t: Tables):
    df = t.levels.withColumn("v", F.when(c("center") % 3 != 0, c("center")))
    return windows.interpolate(df, ["study"], "ordinal", "v").select("study", "ordinal", F.round("filled", 6).alias("filled"))


@query("select user_id as case_id, event_id, row_number() over (partition by user_id order by case when event_id % 3 <> 0 then event_id % 100 end asc nulls last, event_id) as place from events")
def artifact_order(t: Tables):
    df = t.events.withColumn("pos", F.when(c("event_id") % 3 != 0, c("event_id") % 100))
    return windows.artifact_order(df, ["user_id"], "pos", "event_id").select(c("user_id").alias("case_id"), "place", "event_id")


@query("select uid, slice_count >= 2 and (probability > 0.8 or modality <> 'CT' or (phase <> 'native' and slice_count % 3 <> 0)) as convertible from (select *, phase from series)")
def qc_convertible(t: Tables):
    keep = P.qc_convertible(c("slice_count"), c("probability") > 0.8, c("modality"), c("phase") == "native", c("slice_count") % 3 == 0)
    return t.series.select("uid", keep.alias("convertible"))


@query("select a.uid, a.study, b.slice_count as n_converted, b.uid is not null as converted from series a left join (select * from series where phase_detected) b on a.uid = b.uid")
def join_converted(t: Tables):
    done = t.series.where("phase_detected").select("uid", c("slice_count").alias("n_converted"))
    return S.join_converted(t.series.select("uid", "study"), done, "uid")
