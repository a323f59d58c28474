"""Evidence, versions, job graphs and delivery tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import evidence as E
from voxelweave.operators import windows
from voxelweave.plans.catalog import Tables, query

c, L = F.col, F.lit


@query("""with a as (select study, bool_or(status <> 'done') as open, count(distinct acquisition) as n from acquisitions group by 1),
 s as (select e.study, e.anatomy, count(distinct q.acquisition) as seen, bool_or(state = 'anatomy_complete') as co, bool_or(state = 'anatomy_present') as pr, bool_or(state = 'anatomy_truncated') as tr, bool_or(state = 'anatomy_not_detected') as ab from evidence e left join acquisitions q on q.acquisition = e.acquisition and q.study = e.study group by 1, 2)
 select s.study, anatomy, case when co then 'anatomy_complete' when pr then 'anatomy_present' when tr and not ab and not coalesce(open, false) and seen >= coalesce(n, 0) then 'anatomy_truncated' when ab and not tr and not coalesce(open, false) and seen >= coalesce(n, 0) then 'anatomy_not_detected' else 'unknown' end as state, (co or pr or tr) and ab as conflict from s left join a on a.study = s.study""")
def consolidate_states(t: Tables):
    return E.consolidate_states(t.evidence, t.acquisitions)


@query("select study, case when count(*) filter (status = 'done') = count(*) then 'complete' when count(*) filter (status = 'done') = 0 then 'pending' else 'partial' end as status from acquisitions group by study")
def analysis_status(t: Tables):
    return E.analysis_status(t.acquisitions)


@query("select study, coalesce(string_agg(distinct phase, ',' order by phase) filter (phase <> 'unknown'), '') as phases from acquisitions group by study")
def distinct_phases(t: Tables):
    return E.distinct_phases(t.acquisitions)


@query("select study, frame, min(low_mm) as inferior_mm, max(high_mm) as superior_mm, count(*) as n from acquisitions group by study, frame")
def frame_extents(t: Tables):
    return E.frame_extents(t.acquisitions)


@query("""select l.study, l.acquisition as "left", r.acquisition as "right", round(greatest(l.low_mm, r.low_mm) - least(l.high_mm, r.high_mm), 6) as distance_mm from acquisitions l join acquisitions r on l.study = r.study and l.acquisition < r.acquisition and coalesce(nullif(l.frame_uid, '') = nullif(r.frame_uid, ''), true)
 where abs(l.tilt - r.tilt) <= 5 and greatest(l.low_mm, r.low_mm) - least(l.high_mm, r.high_mm) > greatest(l.acquisition % 5, r.acquisition % 5, 1) * cast(1.5 as double)""")
def extent_gaps(t: Tables):
    """Tilts of up to nine degrees, so some are not parallel; some acquisitions have no orientation, some no frame."""
    tilt = F.radians(c("tilt"))
    rows = t.acquisitions.withColumns({"frame": c("frame_uid"), "orientation": F.when(tilt.isNotNull(), F.array(L(1.0), L(0.0), L(0.0), L(0.0), F.cos(tilt), F.sin(tilt)))})
    return E.extent_gaps(rows, (c("acquisition") % 5).cast("double"), digits=6)


@query("select user_id, event_type, row_number() over (partition by user_id order by seen, event_type) as version from (select user_id, event_type, min(ts) as seen from events group by 1, 2)")
def analysis_version(t: Tables):
    return windows.version(t.events, "user_id", ["event_type"], "ts")


@query("select user_id, version, status from (select *, row_number() over (partition by user_id order by status = 'complete' desc, version desc) as r from (select user_id, event_id as version, case when value > 90 then 'complete' else 'partial' end as status from events)) where r = 1")
def analysis_lookup(t: Tables):
    v = t.events.select("user_id", c("event_id").alias("version"), F.when(c("value") > 90, "complete").otherwise("partial").alias("status"))
    return E.analysis_lookup(v, "user_id")


@query("select user_id, event_id, version = m and event_id = ch as selected from (select user_id, event_id, event_id % 3 as version, max(event_id % 3) over (partition by user_id) as m, max(case when event_id % 3 = 2 then event_id end) over (partition by user_id) as ch from events) where ch is not null")
def mark_selected(t: Tables):
    rows = t.events.select("user_id", "event_id", (c("event_id") % 3).alias("version"), c("event_id").alias("uid"))
    chosen = rows.where("version = 2").groupBy("user_id").agg(F.max("uid").alias("uid"))
    got = E.mark_selected(rows, "user_id", chosen).join(chosen.select("user_id").hint("merge"), "user_id", "left_semi")
    return got.select("user_id", "event_id", "selected")


JOBS = [("organs", ["view", "click"]), ("fat", ["purchase"]), ("none", []), ("bone", ["error", "signup"])]


@query("""with j as (select * from (values ('organs', 'view'), ('organs', 'click'), ('fat', 'purchase'), ('none', null), ('bone', 'error'), ('bone', 'signup')) v(job, need)), u as (select distinct user_id from events), f as (select distinct user_id, event_type from events where value > 60),
 x as (select u.user_id, j.job, case when j.need is not null and f.event_type is null then j.need end as miss from u cross join j left join f on f.user_id = u.user_id and f.event_type = j.need)
 select user_id, job, coalesce(string_agg(miss, ',' order by miss), '') as failed, count(miss) = 0 as runs from x group by 1, 2""")
def inventory_gate(t: Tables):
    jobs = t.spark.createDataFrame(JOBS, "job string, requires array<string>")
    facts = t.events.select("user_id", c("event_type").alias("fact"), (c("value") > 60).alias("holds"))
    return E.inventory_gate(jobs, facts, "user_id")


@query("with recursive r(job) as (select distinct job from job_needs where p_size = 7 union select n.need from r join job_needs n on n.job = r.job where n.need is not null) select job as node from r")
def job_closure(t: Tables):
    return E.reachable(t.job_needs, t.job_needs.where("p_size = 7").select("job"), "job", "need")


AUTO = "(select job, p_size % 50 = 3 as automatic, cast(substr(job, 2) as bigint) * 7919 % 10007 as place from job_needs)"


def _jobs(t: Tables):
    n = F.substring("job", 2, 20).cast("bigint")
    return t.job_needs.select("job", (c("p_size") % 50 == 3).alias("automatic"), (n * 7919 % 10007).alias("place"))


ASKED = "(select case when p_size = 7 then job when p_size = 8 then concat('x', job) end as job from job_needs where p_size in (7, 8))"


def _asked(t: Tables):
    return t.job_needs.where("p_size in (7, 8)").select(F.when(c("p_size") == 7, c("job")).otherwise(F.concat(L("x"), "job")).alias("job"))


@query(f"with recursive s as (select job, 0 as k from {ASKED} where job in (select job from job_needs) union select job, 1 from {AUTO} where automatic), r(job) as (select distinct job from s union select n.need from r join job_needs n on n.job = r.job where n.need is not null), k as (select job, min(k) as k from (select * from s union all select job, 2 from r) group by job) select job, case k when 0 then 'requested' when 1 then 'automatic' else 'needed' end as why from k")
def resolved_jobs(t: Tables):
    """Some names that are asked for don't exist; they are left to unknown_jobs."""
    return E.resolved_jobs(_jobs(t), t.job_needs.select("job", "need"), _asked(t))


@query(f"select distinct job from {ASKED} where job not in (select job from job_needs)")
def unknown_jobs(t: Tables):
    return E.unknown_jobs(_jobs(t), _asked(t))


# the needs of some jobs name one that does not exist
NEEDS = "(select job, case when p_size = 11 then concat('no', job) else need end as need from job_needs)"


def _needs(t: Tables):
    return t.job_needs.select("job", F.when(c("p_size") == 11, F.concat(L("no"), "job")).otherwise(c("need")).alias("need"))


@query(f"""with recursive g as materialized (select job, 'r' || p_size as failed from job_needs where p_size = 9), e as materialized (select n.job, n.need, j.place, k.place as at, k.place is null or n.need in (select job from g) as lost from {NEEDS} n join {AUTO} j on j.job = n.job left join {AUTO} k on k.job = n.need where n.need is not null),
 r(job, turn) as (select distinct job, 1 from e where lost union select e.job, r.turn + cast(e.at > e.place as int) from r join e on e.need = r.job where not e.lost),
 t as materialized (select job, min(turn) as turn from r where job not in (select job from g) group by job),
 m as (select e.job, string_agg(distinct e.need, ',' order by e.need) as missing_needs from e join t on t.job = e.job left join t u on u.job = e.need where e.lost or u.turn < t.turn or (u.turn = t.turn and e.at < e.place) group by e.job)
 select j.job, g.job is null and m.job is null as stays, case when g.job is not null then 'inventory_requirements_not_met' when m.job is not null then 'dependency_not_selected' end as reason, case when g.job is null then missing_needs end as missing_needs, failed from {AUTO} j left join g on g.job = j.job left join m on m.job = j.job""")
def job_prune(t: Tables):
    gone = t.job_needs.where("p_size = 9").select("job", F.array(F.concat(L("r"), c("p_size").cast("string"))).alias("failed"))
    return E.job_prune(_jobs(t), _needs(t), gone)


# some needs lead back, some to the job itself, some nowhere
LOOPS = "(select job, case when p_size = 3 then concat('j', cast(cast(substr(job, 2) as int) - 2 as varchar)) when p_size = 4 then job when p_size = 11 then concat('no', job) else need end as need from job_needs)"


@query(f"with recursive e as materialized (select * from {LOOPS} where need is not null), p(a, b) as (select job, need from e where job <> need union select p.a, e.need from p join e on e.job = p.b and e.job <> e.need) select 'missing_need' as finding, job, need as detail from e where need not in (select job from job_needs) union all select 'self_need', job, need from e where job = need union all select 'cycle', p.a, min(p.b) from p join p q on p.a = q.b and p.b = q.a group by p.a")
def job_cycles(t: Tables):
    """Needs that no job has, jobs that need themselves, and the jobs on a cycle."""
    back = F.concat(L("j"), (F.substring("job", 2, 20).cast("int") - 2).cast("string"))
    needs = t.job_needs.select("job", F.when(c("p_size") == 3, back).when(c("p_size") == 4, c("job")).when(c("p_size") == 11, F.concat(L("no"), "job")).otherwise(c("need")).alias("need"))
    return E.job_findings(t.job_needs.select("job"), needs)


@query("select p_brand, p_size % 10 as bin, case when not bool_or(p_size = 50) then string_agg(distinct p_type, ',' order by p_type) end as tasks from part group by 1, 2")
def task_requirements(t: Tables):
    jobs = t.part.select("p_brand", (c("p_size") % 10).alias("bin"), F.when(c("p_size") != 50, F.array("p_type")).alias("tasks_"))
    return E.task_requirements(jobs, "tasks_", ["p_brand", "bin"])


@query("select r.o as job, nr as n_requested, coalesce(nd, 0) as n_delivered, coalesce(miss, '') as missing, sha256(coalesce(del, '')) as digest from (select l_orderkey as o, count(distinct l_linenumber) as nr, string_agg(distinct cast(l_linenumber as varchar), ',' order by cast(l_linenumber as varchar)) filter (not exists (select 1 from lineitem d where d.l_orderkey = lineitem.l_orderkey and d.l_linenumber = lineitem.l_linenumber and d.l_returnflag = 'R')) as miss from lineitem group by 1) r left join (select l_orderkey as o, count(distinct l_linenumber) as nd, string_agg(distinct cast(l_linenumber as varchar), chr(10) order by cast(l_linenumber as varchar)) as del from lineitem where l_returnflag = 'R' group by 1) d on d.o = r.o".replace(" filter (not exists (select 1 from lineitem d where d.l_orderkey = lineitem.l_orderkey and d.l_linenumber = lineitem.l_linenumber and d.l_returnflag = 'R'))", " filter (not got)").replace("from lineitem group by 1) r", "from (select *, bool_or(l_returnflag = 'R') over (partition by l_orderkey, l_linenumber) as got from lineitem) group by 1) r"))
def delivery_manifest(t: Tables):
    rows = t.lineitem.select(c("l_orderkey").alias("job"), c("l_linenumber").cast("string").alias("name"), "l_returnflag")
    return E.delivery_manifest(rows, rows.where("l_returnflag = 'R'"), "job")


@query("select o_custkey as study, count(*) as n_parts, min(o_orderkey) as first_part from orders group by 1")
def study_detail(t: Tables):
    studies = t.orders.select(c("o_custkey").alias("study")).distinct()
    got = E.nested_detail(studies, t.orders.withColumnRenamed("o_custkey", "study"), "study", ["o_orderkey", "o_orderstatus"])
    return got.select("study", F.size("parts").alias("n_parts"), F.get("parts", L(0))["o_orderkey"].alias("first_part"))


@query("select p_partkey, case when p_partkey % 5 = 0 then 'no_previous_output' when p_partkey % 3 = 0 then 'p_size_changed' when p_partkey % 2 = 0 then 'p_brand_changed' else 'match' end as reason, p_partkey % 5 <> 0 and p_partkey % 3 <> 0 and p_partkey % 2 <> 0 as reuse from part")
def reuse_match(t: Tables):
    old = t.part.where("p_partkey % 5 <> 0").select("p_partkey", F.when(c("p_partkey") % 3 == 0, -1).otherwise(c("p_size")).alias("p_size"), F.when(c("p_partkey") % 2 == 0, "x").otherwise(c("p_brand")).alias("p_brand"))
    return E.reuse_match(t.part, old, "p_partkey", ["p_size", "p_brand"]).select("p_partkey", "reason", "reuse")


@query("select study, position, plane from (select p.study, p.position, q.plane, row_number() over (partition by p.study, p.position order by abs(p.position - q.plane), q.plane) as r from (select distinct cast(floor(l_orderkey / 16) as bigint) as study, l_quantity + 0.25 as position from lineitem) p join (select distinct cast(floor(l_orderkey / 16) as bigint) as study, cast(l_partkey % 50 as double) as plane from lineitem) q on p.study = q.study) where r = 1")
def nearest_plane(t: Tables):
    s = F.floor(c("l_orderkey") / 16).alias("study")
    return E.nearest_plane(t.lineitem.select(s, (c("l_quantity") + 0.25).alias("position")), t.lineitem.select(s, (c("l_partkey") % 50).alias("plane")), "study", "position", "plane")


@query("select case_id, study, metric, cast(json_extract(measurement, '$.k') as bigint) as k from payloads")
def scan_payloads(t: Tables):
    v = F.from_json("measurement", "k bigint", {"mode": "PERMISSIVE"})
    return t.payloads.select("case_id", "study", "metric", v["k"].alias("k"))


SUMMARY = """select case_id, coalesce(case when m = 0 then '41.5' end, case when m = 1 then '7' end, case when m = 2 then '88.25' end, case when m = 3 then '12.75' end, case when m = 4 then 'high' end, case when m = 5 then 'true' end, case when m = 6 then 'complete' end, case when m = 7 then 'done' end, 'n/a') as summary
 from (select case_id, case_id % 9 as m from payloads)"""


@query(SUMMARY)
def result_summary(t: Tables):
    """Payloads of each shape: a headline early or late in the list, empty ones before it, none at all, not even a status."""
    kinds = [
        '{"measurement": {"skeletal_muscle_area_cm2": 41.5, "job_status": "late"}, "status": "done"}', '{"measurement": {"skeletal_muscle_area_cm2": null, "exported_slice_count": 7}, "status": "done"}',
        '{"measurement": {"exported_slice_count": "", "l1_trabecular_hu_mean": 88.25}}', '{"measurement": {"aggregate": {"visceral_proxy_volume_cm3": 12.75}, "visceral_proxy_area_cm2": 3}}',
        '{"measurement": {"aggregate": "none", "opportunistic_osteoporosis_composite": "high", "overall_suspicion": false}}', '{"measurement": {"brain_volume_cm3": [], "overall_suspicion": true}}',
        '{"measurement": {"job_status": "complete"}, "status": "done"}', '{"measurement": "text", "status": "done"}', '{"measurement": {}}',
    ]
    payload = F.get(F.array(*[L(k) for k in kinds]), (c("case_id") % 9).cast("int"))
    return t.payloads.select("case_id", E.result_summary(payload).alias("summary"))


@query("select distinct unnest(json_keys(props)) as key from events")
def key_union(t: Tables):
    return E.key_union(t.events, "props")


@query("select job, coalesce(string_agg(name, ',' order by name) filter (not got), '') as missing from (select l_orderkey as job, cast(l_linenumber % 4 as varchar) as name, bool_or(l_returnflag = 'R') as got from lineitem group by 1, 2) group by job")
def missing_outputs(t: Tables):
    rows = t.lineitem.select(c("l_orderkey").alias("job"), (c("l_linenumber") % 4).cast("string").alias("name"), "l_returnflag")
    return E.missing_outputs(rows.select("job", "name"), rows.where("l_returnflag = 'R'").select("job", "name"), "job")
