"""Anatomy evidence over acquisitions: states, gaps, extents, versions, and job dependencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.functions import scalars as S
from voxelweave.session import config_rows, cut

POSITIVE = ["anatomy_complete", "anatomy_present", "anatomy_truncated"]


def consolidate_states(evidence: DataFrame, acquisitions: DataFrame, study: str = "study") -> DataFrame:
    """One state per study and anatomy over its acquisitions, and whether they contradict each other.

    Complete wins over present. Truncated and absent count only if all evidence says so, no acquisition is
    outstanding and none lacks evidence on it; otherwise the state is unknown: pending work is never absence.
    """
    per_study = acquisitions.groupBy(study).agg(F.bool_or(F.col("status") != "done").alias("_open"), F.count_distinct("acquisition").alias("_n"))
    known = evidence.join(acquisitions.select(study, "acquisition").distinct().hint("merge"), [study, "acquisition"], "left_semi")
    seen = known.groupBy(study, "anatomy").agg(F.count_distinct("acquisition").alias("_seen"))
    got = evidence.groupBy(study, "anatomy").agg(F.array_sort(F.collect_set("state")).alias("states"))
    got = got.join(seen.hint("merge"), [study, "anatomy"], "left").join(per_study.hint("merge"), study, "left")
    has = lambda s: F.array_contains("states", s)
    sure = (F.size("states") == 1) & ~F.coalesce("_open", F.lit(False)) & (F.coalesce("_seen", F.lit(0)) >= F.coalesce("_n", F.lit(0)))
    state = F.when(has("anatomy_complete"), "anatomy_complete").when(has("anatomy_present"), "anatomy_present").when(sure & has("anatomy_truncated"), "anatomy_truncated").when(sure & has("anatomy_not_detected"), "anatomy_not_detected").otherwise("unknown")
    conflict = F.exists("states", lambda s: s.isin(POSITIVE)) & has("anatomy_not_detected")
    return got.select(study, "anatomy", state.alias("state"), conflict.alias("conflict"))


def analysis_status(acquisitions: DataFrame, study: str = "study") -> DataFrame:
    """pending while work is open and none done, partial while some is, failed if all failed, else complete."""
    n, done, failed = F.count("*"), F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "error")
    status = F.when(done == n, "complete").when(failed == n, "failed").when(done == 0, "pending").otherwise("partial")
    return acquisitions.groupBy(study).agg(status.alias("status"))


def distinct_phases(acquisitions: DataFrame, study: str = "study") -> DataFrame:
    known = F.when(~F.col("phase").isin("", "unknown"), F.col("phase"))
    return acquisitions.groupBy(study).agg(F.array_join(F.array_sort(F.collect_set(known)), ",").alias("phases"))


def frame_extents(acquisitions: DataFrame, study: str = "study") -> DataFrame:
    """Extent and members of each frame of reference."""
    frame = F.coalesce(F.nullif("frame", F.lit("")), F.lit("unknown"))
    return acquisitions.groupBy(study, frame.alias("frame")).agg(F.min("low_mm").alias("inferior_mm"), F.max("high_mm").alias("superior_mm"), F.count("*").alias("n"))


def extent_gaps(acquisitions: DataFrame, spacing: Column, study: str = "study", digits: int = 4, degrees: float = 5.0) -> DataFrame:
    """Pairs of parallel acquisitions of a study in compatible frames that are farther apart than 1.5 spacings.

    Acquisitions without an extent or an orientation (six cosines) are left out; an empty frame fits every other. A self join
    within the study, of which acquisitions number in tens.
    """
    a = acquisitions.where("low_mm is not null and high_mm is not null").select(study, "acquisition", F.nullif("frame", F.lit("")).alias("frame"), S.slice_normal(F.col("orientation")).alias("normal"), F.least("low_mm", "high_mm").alias("low"), F.greatest("low_mm", "high_mm").alias("high"), F.coalesce(spacing, F.lit(0.0)).alias("mm"))
    a = a.where("normal is not null")
    l, r = a.alias("l"), a.alias("r")  # noqa: E741
    both = l.join(r.hint("merge"), F.col(f"l.{study}") == F.col(f"r.{study}")).where("l.acquisition < r.acquisition and coalesce(l.frame = r.frame, true)")
    both = both.where(F.abs(S.dot(F.col("l.normal"), F.col("r.normal"))) >= math.cos(math.radians(degrees)))
    gap = F.greatest(F.lit(0.0), F.greatest("l.low", "r.low") - F.least("l.high", "r.high"))
    limit = F.greatest(F.col("l.mm"), F.col("r.mm"), F.lit(1.0)) * 1.5
    return both.where(gap > limit).select(F.col(f"l.{study}").alias(study), F.col("l.acquisition").alias("left"), F.col("r.acquisition").alias("right"), F.round(gap, digits).alias("distance_mm"))


def analysis_lookup(versions: DataFrame, study: str) -> DataFrame:
    """The newest complete version of each study, or the newest at all."""
    w = W.partitionBy(study).orderBy((F.col("status") == "complete").desc(), F.col("version").desc())
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mark_selected(rows: DataFrame, study: str, chosen: DataFrame) -> DataFrame:
    """In each study's newest version the chosen series is flagged, the others are not; older versions keep nothing flagged."""
    newest = F.max("version").over(W.partitionBy(study))
    both = rows.withColumn("_n", newest).join(chosen.select(study, F.col("uid").alias("_c")).hint("merge"), study, "left")
    return both.withColumn("selected", F.coalesce((F.col("version") == F.col("_n")) & (F.col("uid") == F.col("_c")), F.lit(False))).drop("_n", "_c")


def inventory_gate(jobs: DataFrame, facts: DataFrame, case: str) -> DataFrame:
    """Per case and job the requirements that its inventory doesn't meet, and whether the job may run."""
    asked = [(r.job, n) for r in config_rows(jobs.select("job", "requires")) for n in (r.requires or [None])]
    cases = facts.select(case).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(j).cast("string").alias("job"), F.lit(n).cast("string").alias("need")) for j, n in asked]))
    each = cases.select(case, each.alias("_a")).select(case, "_a.job", "_a.need")  # jobs are configuration; every case is asked about each
    met = facts.where("holds").select(case, F.col("fact").alias("need"), F.lit(True).alias("_ok")).distinct()
    both = each.join(met.hint("merge"), [case, "need"], "left")
    failed = F.array_sort(F.collect_set(F.when(F.col("need").isNotNull() & F.col("_ok").isNull(), F.col("need"))))
    return both.groupBy(case, "job").agg(F.array_join(failed, ",").alias("failed")).withColumn("runs", F.col("failed") == "")


def closure(edges: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Least weight (w) of a path between any two nodes that one leads to the other, src and dst; an edge weighs 1 unless told.

    Paths double in every round, so rounds are logarithmic in the longest path. Rows are pairs of a node and what follows
    from it, which job graphs have few of. The table is cut each round, the edges are read once.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    p = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w.cast("bigint").alias("w")).where("src is not null and dst is not null")
    p, before = cut(p.groupBy("src", "dst").agg(F.min("w").alias("w"))), None
    while True:
        seen = tuple(p.agg(F.count("*"), F.sum("w")).first())
        if seen == before or not seen[0]:
            return p
        before = seen
        far = p.select("src", F.col("dst").alias("_m"), F.col("w").alias("_w")).join(p.select(F.col("src").alias("_m"), "dst", "w").hint("merge"), "_m")
        p = cut(p.union(far.select("src", "dst", F.col("_w") + F.col("w"))).groupBy("src", "dst").agg(F.min("w").alias("w")))


def reachable(edges: DataFrame, start: DataFrame, src: str, dst: str) -> DataFrame:
    """All nodes that follow from the start nodes, these included (column node): a root before them has them in its closure."""
    e = edges.select(F.array(src).alias("src"), F.array(dst).alias("dst")).where("src[0] is not null and dst[0] is not null")
    kind = e.schema["dst"].dataType.simpleString()
    root = start.toDF("_n").where("_n is not null").select(F.array().cast(kind).alias("src"), F.array("_n").cast(kind).alias("dst"))
    return closure(e.union(root), "src", "dst").where(F.size("src") == 0).select(F.get("dst", F.lit(0)).alias("node"))


def resolved_jobs(jobs: DataFrame, needs: DataFrame, requested: DataFrame) -> DataFrame:
    """The jobs that a request brings about (job, why): those asked for, then what is automatic, then what either needs.

    jobs has job and automatic, needs has job and need, requested has job. Names that no job has are left to unknown_jobs().
    """
    asked = requested.select("job").distinct().join(jobs.select("job").distinct().hint("merge"), "job", "left_semi").withColumn("_by", F.lit(0))
    own = jobs.where("automatic").select("job", F.lit(1).alias("_by"))
    start = cut(asked.union(own))
    found = reachable(needs, start.select("job"), "job", "need").select(F.col("node").alias("job"), F.lit(2).alias("_by"))
    by = found.union(start).groupBy("job").agg(F.min("_by").alias("_by"))
    return by.select("job", F.element_at(F.array(F.lit("requested"), F.lit("automatic"), F.lit("needed")), F.col("_by") + 1).alias("why"))


def unknown_jobs(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """The names asked for that no job has."""
    return requested.select("job").distinct().join(jobs.select("job").hint("merge"), "job", "left_anti")


def job_prune(jobs: DataFrame, needs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Every job (job, place) with whether it stays, and if not the reason and what it misses.

    A job goes if it was dropped (job, failed: what it lacks), or if it needs one that is gone or that does not exist.
    Jobs are gone through in order of place, again and again, until none goes any more; a job misses the needs that
    were gone when its turn came. The pass in which a job goes is the least of those of its needs, plus one where the need
    stands behind it: a shortest path, which doubling finds.
    """
    j = jobs.select("job", "place")
    asks = needs.select("job", "need").where("need is not null").distinct().join(j.hint("merge"), "job")
    asks = cut(asks.join(j.select(F.col("job").alias("need"), F.col("place").alias("_at")).hint("merge"), "need", "left"))
    gone = cut(dropped.groupBy("job").agg(F.array_join(F.array_sort(F.flatten(F.collect_set("failed"))), ",").alias("failed")))
    lost = asks.join(gone.select(F.col("job").alias("need"), F.lit(True).alias("_lost")).hint("merge"), "need", "left")
    lost = cut(lost.withColumn("_lost", F.coalesce("_lost", F.col("_at").isNull())))
    # what is gone before the first pass leads to those who need it in pass one; from there each need leads on
    root = lost.where("_lost").select(F.lit("").alias("src"), F.concat(F.lit("+"), "job").alias("dst"), F.lit(1).alias("w"))
    step = lost.where("not _lost").select(F.concat(F.lit("+"), "need").alias("src"), F.concat(F.lit("+"), "job").alias("dst"), (F.col("_at") > F.col("place")).cast("int").alias("w"))
    turn = closure(root.union(step), "src", "dst", "w").where("src = ''").select(F.substring("dst", 2, 1 << 30).alias("job"), F.col("w").alias("turn"))
    turn = cut(turn.join(gone.select("job").hint("merge"), "job", "left_anti"))
    both = lost.join(turn.hint("merge"), "job").join(turn.select(F.col("job").alias("need"), F.col("turn").alias("_t")).hint("merge"), "need", "left")
    missed = both.where(F.col("_lost") | (F.col("_t") < F.col("turn")) | ((F.col("_t") == F.col("turn")) & (F.col("_at") < F.col("place"))))
    missed = missed.groupBy("job").agg(F.array_join(F.array_sort(F.collect_set("need")), ",").alias("missing_needs"))
    out = j.join(gone.hint("merge"), "job", "left").join(missed.hint("merge"), "job", "left")
    reason = F.when(F.col("failed").isNotNull(), "inventory_requirements_not_met").when(F.col("missing_needs").isNotNull(), "dependency_not_selected")
    return out.select("job", reason.isNull().alias("stays"), reason.alias("reason"), F.when(F.col("failed").isNull(), F.col("missing_needs")).alias("missing_needs"), "failed")


def job_findings(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """What is wrong with a job graph (finding, job, detail): a need that no job has, a job that needs itself, a job on a cycle.

    The detail is the need, or the smallest job of the cycle's component: jobs that lead to each other. Jobs that only lead
    into a cycle are not on it. No row means that the needs can be ordered.
    """
    e = cut(needs.select("job", "need").where("job is not null and need is not null").distinct())
    missing = e.join(jobs.select(F.col("job").alias("need")).hint("merge"), "need", "left_anti").select(F.lit("missing_need").alias("finding"), "job", F.col("need").alias("detail"))
    own = e.where("job = need").select(F.lit("self_need").alias("finding"), "job", F.col("need").alias("detail"))
    # only what both needs and is needed can lie on a cycle
    inner = e.where("job <> need")
    inner = inner.join(inner.select(F.col("need").alias("job")).distinct().hint("merge"), "job", "left_semi").join(inner.select(F.col("job").alias("need")).distinct().hint("merge"), "need", "left_semi")
    p = closure(inner, "job", "need").select("src", "dst")
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    round_ = p.join(back.hint("merge"), ["src", "dst"]).groupBy("src").agg(F.min("dst").alias("detail"))
    return missing.union(own).union(round_.select(F.lit("cycle"), F.col("src"), "detail"))


def task_requirements(jobs: DataFrame, tasks: str, by: list[str]) -> DataFrame:
    """Union of the tasks that jobs require; null if one of them declares none."""
    open_ = F.bool_or(F.col(tasks).isNull())
    return jobs.groupBy(*by).agg(F.when(~open_, F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(tasks, F.array().cast("array<string>")))))), ",")).alias("tasks"))


def delivery_manifest(requested: DataFrame, artifacts: DataFrame, job: str) -> DataFrame:
    """Per job what was requested, delivered and missing, with a digest of what was delivered."""
    r = requested.groupBy(job).agg(F.array_sort(F.collect_set("name")).alias("_r"))
    d = artifacts.groupBy(job).agg(F.array_sort(F.collect_set("name")).alias("_d"))
    both = r.join(d.hint("merge"), job, "left").withColumn("_d", F.coalesce("_d", F.array().cast("array<string>")))
    missing = F.array_except("_r", "_d")
    return both.select(job, F.size("_r").alias("n_requested"), F.size("_d").alias("n_delivered"), F.array_join(missing, ",").alias("missing"), F.sha2(F.array_join("_d", "\n"), 256).alias("digest"))


def nested_detail(studies: DataFrame, parts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each study with its parts as an ordered array of structs."""
    inner = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    return studies.join(inner.hint("merge"), key, "left")


def reuse_match(current: DataFrame, previous: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Whether an earlier output can be used again, or the first field that differs."""
    old = previous.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    both = current.join(old.hint("merge"), key, "left")
    why = F.when(F.col("_there").isNull(), "no_previous_output")
    for f in fields:
        why = why.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f"{f}_changed")
    return both.withColumn("reason", why.otherwise("match")).withColumn("reuse", F.col("reason") == "match").drop("_there", *[f"_{f}" for f in fields])


def nearest_plane(points: DataFrame, planes: DataFrame, key: str, at: str, plane: str) -> DataFrame:
    """The plane nearest to each position within a study, the lower one of two as near.

    An as-of join by window: positions and planes are sorted together once, and each position looks at the plane
    before and after it.
    """
    both = points.select(key, F.col(at).cast("double").alias("_x"), F.lit(None).cast("double").alias("_p")).distinct().union(planes.select(key, F.col(plane).cast("double"), F.col(plane).cast("double")).distinct())
    w = W.partitionBy(key).orderBy("_x", F.col("_p").isNull())
    before = F.last("_p", ignorenulls=True).over(w)
    after = F.first("_p", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    got = both.withColumns({"_b": before, "_a": after}).where("_p is null")
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (F.col("_x") - F.col("_b") <= F.col("_a") - F.col("_x")), F.col("_b")).otherwise(F.col("_a"))
    return got.select(key, F.col("_x").alias(at), near.alias("plane"))


# Where a payload's headline may stand, the first useful one counts.
HEADLINES = [
    "skeletal_muscle_area_cm2", "exported_slice_count", "l1_trabecular_hu_mean", "bone_health_l1_volumetric_trabecular_hu_mean", "brain_volume_cm3",
    "aggregate.visceral_proxy_volume_cm3", "visceral_proxy_area_cm2", "opportunistic_osteoporosis_composite", "overall_suspicion", "job_status",
]


def result_summary(payload: Column) -> Column:
    """The first headline value of a JSON payload that is there and neither empty text nor an empty list, else its status, else n/a."""
    said = F.get_json_object(payload, "$.status")
    found = [F.get_json_object(payload, f"$.measurement.{name}") for name in HEADLINES]
    return F.coalesce(*[F.when(~v.isin("", "[]"), v) for v in found], said, F.lit("n/a"))


def key_union(rows: DataFrame, column: str) -> DataFrame:
    """The keys that any JSON object of a column has (column key)."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("key")).distinct()


def missing_outputs(requested: DataFrame, delivered: DataFrame, job: str) -> DataFrame:
    """The outputs (name) of each job that were asked for and not delivered, sorted and joined by commas; empty if all were."""
    want = requested.select(job, "name").distinct()
    got = delivered.select(job, "name", F.lit(True).alias("_got")).distinct()
    both = want.join(got.hint("merge"), [job, "name"], "left")
    return both.groupBy(job).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("_got").isNull(), F.col("name")))), ",").alias("missing"))
