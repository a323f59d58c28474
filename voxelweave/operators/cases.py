"""Case records: lookups, patches, purges, resets, stage lists and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.scalars import epoch_s
from voxelweave.operators.grids import steps
from voxelweave.operators.queues import ACTIVE


def case_lookup(studies: DataFrame, wanted: DataFrame, payload: str, path: str) -> DataFrame:
    """Studies of the wanted case ids (column case_id), which stand inside a JSON column; the id is taken out once."""
    with_id = studies.withColumn("case_id", F.get_json_object(payload, path))
    return with_id.join(wanted.select("case_id").distinct().hint("merge"), "case_id", "left_semi")


def active_by_stage(handoffs: DataFrame, queues: dict[str, DataFrame], case: str = "case_id") -> DataFrame:
    """Cases at work with their stage: hand-offs being prepared, and claimed rows of each queue in the order of claims."""
    out = handoffs.where("status = 'preparing'").select(case, F.lit("prepare").alias("stage"), F.col("created_at").alias("since"))
    for name, q in queues.items():
        out = out.union(q.where("status = 'claimed'").select(case, F.lit(name), "created_at"))
    return out


def patched(current: DataFrame, incoming: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Records replaced by their new version, where the kept columns stay as they were if the new value is absent."""
    rest = [c for c in current.columns if c != key]
    new = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(True).alias("_in"))
    both = current.join(new.hint("merge"), key, "left")
    value = lambda c: F.when(F.col("_in"), F.coalesce(f"_n_{c}", c) if c in kept else F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(key, *[value(c) for c in rest])


def purge_mark(rows: DataFrame, purged: DataFrame, key: str) -> DataFrame:
    """Records with a flag that tells whether their case was purged."""
    hit = purged.select(key).distinct().withColumn("_p", F.lit(True))
    return rows.join(hit.hint("merge"), key, "left").withColumn("purged", F.coalesce("_p", F.lit(False))).drop("_p")


def downstream_reset(rows: DataFrame, requeued: DataFrame, case: str) -> DataFrame:
    """Dependent rows left after some cases were queued again: their rows that aren't done go."""
    hit = requeued.select(case).distinct().withColumn("_h", F.lit(True))
    both = rows.join(hit.hint("merge"), case, "left")
    return both.where(F.col("_h").isNull() | (F.col("status") == "done")).drop("_h")


def live_elapsed(rows: DataFrame, started: str, ended: str, now: Column) -> DataFrame:
    """Seconds of a stage: until its end, or until now while it runs."""
    return rows.withColumn("elapsed_s", epoch_s(F.coalesce(F.col(ended), now)) - epoch_s(F.col(started)))


def phase_totals(rows: DataFrame, study: str, parts: list[str], ok: Column) -> DataFrame:
    """Sums of durations and the number of successes of each study."""
    return rows.groupBy(study).agg(*[F.sum(p).alias(p) for p in parts], F.count_if(ok).alias("n_ok"))


def text_report(rows: DataFrame, source: str, flagged: Column, failed: Column) -> DataFrame:
    """Findings, errors and clean rows of recognised text by source."""
    return rows.groupBy(source).agg(F.count_if(flagged & ~failed).alias("findings"), F.count_if(failed).alias("errors"), F.count_if(~flagged & ~failed).alias("clean"))


def job_status_lookup(jobs: DataFrame, study: DataFrame, sidecar: DataFrame, delivery: DataFrame, key: str) -> DataFrame:
    """Status of a job by the first of three tables that has one, and which."""
    out = jobs
    for name, d in (("study", study), ("sidecar", sidecar), ("delivery", delivery)):
        out = out.join(d.select(key, F.col("status").alias(f"_{name}")).hint("merge"), key, "left")
    source = F.when(F.col("_study").isNotNull(), "study").when(F.col("_sidecar").isNotNull(), "sidecar").when(F.col("_delivery").isNotNull(), "delivery")
    return out.select(*jobs.columns, F.coalesce("_study", "_sidecar", "_delivery").alias("status"), source.alias("source"))


def abdominal_aggregate(levels: DataFrame, blocks: DataFrame, group: list[str], ordinal: str, low: str, high: str) -> DataFrame:
    """The range from the lowest to the highest edge of the levels in each group's block (first, length)."""
    both = levels.join(blocks.hint("merge"), group).where((F.col(ordinal) >= F.col("first")) & (F.col(ordinal) < F.col("first") + F.col("length")))
    return both.groupBy(*group).agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count("*").alias("n_levels"))


def ellipse_roi(voxels: DataFrame, centres: DataFrame, group: list[str], rx: float, ry: float, spacing: tuple[float, ...] | None, value: str = "hu") -> DataFrame:
    """Count and mean of the voxels of one slice inside an ellipse (mm) around each group's centre (cx, cy, z)."""
    both = voxels.join(centres.hint("merge"), [*group, "z"])
    sx, sy = steps(spacing)[:2]
    dx, dy = (F.col("x") - F.col("cx")) * sx / rx, (F.col("y") - F.col("cy")) * sy / ry
    return both.where(dx * dx + dy * dy <= 1).groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def affine_resample(voxels: DataFrame, group: list[str], step: tuple[float, float, float], value: str = "hu") -> DataFrame:
    """Trilinear values on a grid of another spacing (in source voxels), where all eight corners are known.

    Each source voxel is sent to the target points of the eight cells that it is a corner of, with its weight; the sum
    over corners is a partial aggregate, so no target point looks anything up.
    """
    v = voxels
    for a, s in zip("xyz", step):
        first, last = F.ceil((F.col(a) - 1 + 1e-9) / s).cast("int"), F.floor((F.col(a) + 1 - 1e-9) / s).cast("int")
        v = v.withColumn(f"t{a}", F.explode(F.sequence(first, last))).where(F.col(f"t{a}") >= 0)
        v = v.withColumn(f"_w{a}", 1 - F.abs(F.col(f"t{a}") * s - F.col(a)))
    w = F.col("_wx") * F.col("_wy") * F.col("_wz")
    got = v.groupBy(*group, "tx", "ty", "tz").agg(F.sum(w).alias("_w"), F.sum(w * F.col(value)).alias("_s"))
    return got.where(F.abs(F.col("_w") - 1) < 1e-9).select(*group, F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), (F.col("_s") / F.col("_w")).alias(value))
