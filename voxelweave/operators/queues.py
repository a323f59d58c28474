"""Queues, fan-out, telemetry and patient lists as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.functions.scalars import epoch_s
from voxelweave.session import config_rows, small_side

ACTIVE = ["pending", "claimed"]


def queue_summary(rows: DataFrame, queue: str, status: str, created: str) -> DataFrame:
    """Rows, active rows and the oldest pending one of each queue."""
    return rows.groupBy(queue).agg(F.count("*").alias("total"), F.count_if(F.col(status).isin(ACTIVE)).alias("active"), F.min(F.when(F.col(status) == "pending", F.col(created))).alias("oldest_pending"))


def queue_matrix(rows: DataFrame, queue: str, status: str, statuses: list[str]) -> DataFrame:
    """Counts by queue and status with a total row, in one pass."""
    cols = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return rows.rollup(queue).agg(*cols).withColumn(queue, F.coalesce(queue, F.lit("all")))


def next_pending(rows: DataFrame, queue: str, k: int, due: Column | None = None, retry_at: str | None = None) -> DataFrame:
    """The k oldest pending rows of each queue; `due` limits it to those whose retry is due.

    Where rows are tried again, `retry_at` names the time of the next attempt, which comes before age; a row that was never
    tried has none and comes first.

    An aggregate per queue of the k smallest would do on its own; row_number over a hot queue sorts one task's rows, so
    rows beyond the k-th of their input partition are dropped first by Spark's window group limit.
    """
    p = rows.where(F.col("status") == "pending")
    p = p.where(due) if due is not None else p
    w = W.partitionBy(queue).orderBy(*([F.col(retry_at).asc_nulls_first()] if retry_at else []), "created_at", "item")
    return p.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def stale_claims(rows: DataFrame, heartbeat: str, claimed: str, now: Column, seconds: int) -> DataFrame:
    """Claimed rows whose heartbeat, or else claim, is older than the limit."""
    seen = F.coalesce(heartbeat, claimed)
    return rows.where((F.col("status") == "claimed") & (epoch_s(now) - epoch_s(seen) > seconds))


def retry_policy(rows: DataFrame, most: int, backoff_s: int) -> DataFrame:
    """What becomes of failed rows: pending again after a backoff that doubles, or error once the attempts are used up."""
    again = F.col("attempts") < most
    wait = F.when(again, (F.lit(backoff_s) * F.pow(F.lit(2), F.col("attempts"))).cast("bigint"))
    return rows.withColumns({"next_status": F.when(again, "pending").otherwise("error"), "wait_s": wait})


def cancel(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Active rows of the listed cases become canceled."""
    hit = cases.select("case_id", F.lit(True).alias("_hit")).distinct()
    both = rows.join(hit.hint("merge"), "case_id", "left")
    return both.withColumn("status", F.when(F.coalesce("_hit", F.lit(False)) & F.col("status").isin(ACTIVE), "canceled").otherwise(F.col("status"))).drop("_hit")


def prioritize(rows: DataFrame, cases: DataFrame, queue: str) -> DataFrame:
    """Pending rows of the listed cases move a second before the oldest of their queue. The queues' heads are broadcast if they are few."""
    head = rows.where(F.col("status") == "pending").groupBy(queue).agg(F.min("created_at").alias("_head"))
    hit = cases.select("case_id", F.lit(True).alias("_hit")).distinct()
    both = rows.join(small_side(head), queue, "left").join(hit.hint("merge"), "case_id", "left")
    moved = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "pending")
    return both.withColumn("created_at", F.when(moved, F.col("_head") - F.expr("interval 1 second")).otherwise(F.col("created_at"))).drop("_head", "_hit")


def active_union(frames: list[DataFrame], case: str = "case_id") -> DataFrame:
    """Distinct cases that are active in any of the queues."""
    out = frames[0].where(F.col("status").isin(ACTIVE)).select(case)
    for f in frames[1:]:
        out = out.union(f.where(F.col("status").isin(ACTIVE)).select(case))
    return out.distinct()


def protected_anti(candidates: DataFrame, active: DataFrame, case: str = "case_id") -> DataFrame:
    """Candidates for removal that no queue works on."""
    return candidates.join(active.select(case).hint("merge"), case, "left_anti")


def incomplete_semi(cases: DataFrame, rows: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases that have a row which isn't done."""
    return cases.join(rows.where(F.col("status") != "done").select(case).hint("merge"), case, "left_semi")


def sessions(arrivals: DataFrame, key: str, ts: str, idle_s: int) -> DataFrame:
    """Study arrivals as sessions: a gap of at least `idle_s` starts a new one. Count, first and last time, last known caller."""
    w = W.partitionBy(key).orderBy(ts, "event_id")
    gap = epoch_s(F.col(ts)) - epoch_s(F.lag(ts).over(w))
    s = arrivals.withColumn("_new", F.when(gap >= idle_s, 1).otherwise(0)).withColumn("session", F.sum("_new").over(w))
    return s.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.max_by("caller", F.struct(ts, "event_id")).alias("caller"))


def handoff_dedup(rows: DataFrame, key: list[str], at: str, failed: Column) -> DataFrame:
    """Hand-offs in order: a repeat is suppressed unless the one before it failed."""
    w = W.partitionBy(*key).orderBy(at, "event_id")
    before = F.lag(F.struct(failed.alias("failed"))).over(w)
    return rows.withColumn("_b", before).withColumn("accepted", F.col("_b").isNull() | F.col("_b.failed")).drop("_b")


def case_peaks(samples: DataFrame) -> DataFrame:
    """First and last sample, count and highest gauge of each case and stage. Unknown gauges are skipped, not fatal."""
    return samples.groupBy("case_id", "stage").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("samples"), F.max("gauge").alias("peak"), F.min("gauge").alias("low"))


def single_case(samples: DataFrame, cases: str) -> DataFrame:
    """Samples during which exactly one case was active, with that case; others can't be told apart."""
    return samples.where(F.size(cases) == 1).withColumn("case_id", F.get(cases, F.lit(0)))


def windows_of(samples: DataFrame, ts: str, by: str, length: str, value: str) -> DataFrame:
    """Count and mean of a gauge per service and tumbling window."""
    got = samples.groupBy(F.window(ts, length).alias("_w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return got.select(F.col("_w.start").alias("start"), by, "n", "mean")


def stage_means(rows: DataFrame, case: str, stage: str, ts: str) -> DataFrame:
    """Mean length in seconds of each stage over its cases."""
    each = rows.groupBy(case, stage).agg((epoch_s(F.max(ts)) - epoch_s(F.min(ts))).alias("s"))
    return each.groupBy(stage).agg(F.avg("s").alias("mean_s"), F.count("*").alias("n_cases"))


def pipeline_elapsed(df: DataFrame, parts: list[str]) -> Column:
    """Sum of the durations that are there, null if none is."""
    some = F.coalesce(*[F.when(df[p].isNotNull(), True) for p in parts])
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(df[p], F.lit(0.0))
    return F.when(some, total)


def method_agreement(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson correlation, means, sample deviations and mean difference of two methods."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_samp(a).alias("sd_a"), F.stddev_samp(b).alias("sd_b"), F.avg(F.col(a) - F.col(b)).alias("bias"))


def subscribed(items: DataFrame, destinations: DataFrame, kind: str, address: list[str]) -> DataFrame:
    """Items with each enabled destination that takes their kind: destination, its address, and its place in the configuration.

    destinations has name, accepts (array of kinds; null takes all), enabled, ordinal and the address columns; one without a
    name or a complete address (empty text, a number below 1) gets nothing. Each list is exploded once and meets its items by
    kind; those that take all are configuration, so each item gets their list.
    """
    d = destinations.where(F.coalesce("enabled", F.lit(True)) & (F.trim("name") != ""))
    for c in address:
        d = d.where(F.trim(c) != "" if d.schema[c].dataType.simpleString() == "string" else F.col(c) > 0)
    d = d.select(F.trim("name").alias("destination"), "accepts", F.col("ordinal").alias("_place"), *address)
    kinds = F.array_distinct(F.transform("accepts", lambda x: F.trim(x)))
    one = d.where("accepts is not null").withColumn("_kind", F.explode(kinds)).where("_kind <> ''").drop("accepts")
    met = items.join(small_side(one), F.col("_kind") == F.col(kind)).drop("_kind")
    rest = d.where("accepts is null").drop("accepts")
    each = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rest.schema]) for r in config_rows(rest)]
    every = items.withColumn("_d", F.explode(F.array(*each))).select("*", "_d.*").drop("_d") if each else met.limit(0)
    return met.unionByName(every)


def fanout(items: DataFrame, destinations: DataFrame, kind: str, case: str, path: str, order: str, address: list[str]) -> DataFrame:
    """Artifacts to all destinations that take their kind, a row a case, path and destination: the first artifact that one takes, by `order`, and the first record of the destination.

    Artifacts without a path go nowhere; without a kind they count as secondary_capture.
    """
    own = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("secondary_capture"))
    rows = items.where(F.trim(path) != "").withColumn(kind, own)
    got = subscribed(rows, destinations, kind, address)
    best = got.groupBy(case, F.trim(path).alias(path), "destination").agg(F.min_by(F.struct(kind, *address), F.struct(order, "_place")).alias("_b"))
    return best.select(case, path, "destination", "_b.*")


def fanout_events(events: DataFrame, destinations: DataFrame, kind: str, key: str, address: list[str] = ["url"]) -> DataFrame:
    """Events to all destinations that subscribe to their kind, one row an event and name: the first record of the name, in order of the configuration, that takes the event."""
    got = subscribed(events, destinations, kind, address)
    best = got.groupBy(key, "destination").agg(F.min_by(F.struct(kind, *address), "_place").alias("_b"))
    return best.select(key, "destination", "_b.*")


def unsupported_methods(destinations: DataFrame, method: str = "method") -> DataFrame:
    """The enabled destinations whose method is not POST: configuration errors, as a table."""
    return destinations.where(F.coalesce("enabled", F.lit(True)) & (F.upper(F.coalesce(F.nullif(F.trim(method), F.lit("")), F.lit("POST"))) != "POST")).select("name", method)


def digest_upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Artifacts to enqueue again: new ones, changed ones, and those whose last state was an error."""
    old = current.select(key, F.col("digest").alias("_d"), F.col("status").alias("_s"))
    both = incoming.join(old.hint("merge"), key, "left")
    same = (F.col("_d") == F.col("digest")) & (F.col("_s") != "error")
    return both.withColumn("action", F.when(F.col("_d").isNull(), "insert").when(same, "keep").otherwise("requeue")).drop("_d", "_s")


def keep_done_upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """State after enqueueing: done rows stay done, all others and new ones become pending."""
    both = current.select(key, F.col("status").alias("_s")).join(incoming.select(key, F.lit(True).alias("_in")).distinct().hint("merge"), key, "full")
    return both.select(key, F.when(F.col("_in").isNull() | (F.col("_s") == "done"), F.col("_s")).otherwise("pending").alias("status"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, guarded: list[str]) -> DataFrame:
    """Insert or update by key; blank incoming values never replace known ones in the guarded columns."""
    names = [c for c in current.columns if c != key]
    new = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in names], F.lit(True).alias("_in"))
    both = current.withColumn("_old", F.lit(True)).join(new.hint("merge"), key, "full")
    value = lambda c: F.coalesce(F.nullif(f"_n_{c}", F.lit("")), F.col(c)) if c in guarded else F.when(F.col("_in"), F.col(f"_n_{c}")).otherwise(F.col(c))
    return both.select(key, *[value(c).alias(c) for c in names])


def latest(rows: DataFrame, key: list[str], at: list[str], keep: Column) -> DataFrame:
    """The newest row of each key, where it is to be published; a retracted one leaves nothing."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_v"))
    return got.select(*key, "_v.*").where(keep)


def patient_list(rows: DataFrame, date: str, name: str) -> DataFrame:
    """All studies, newest first, then by name without case. The order is a range shuffle, not one task."""
    return rows.orderBy(F.col(date).desc(), F.lower(name))


def search_filter(rows: DataFrame, needle: str, fields: list[str], date: str, first: str, last: str) -> DataFrame:
    """Rows with the text in one of the fields, whatever its case, and the date in a window, both ends included."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(needle.lower()))
    return rows.where(hit & F.col(date).cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def case_map(frames: dict[str, DataFrame], case: str) -> DataFrame:
    """One row a case from several tables of statuses, each under its own name."""
    out = None
    for name, f in frames.items():
        one = f.select(case, F.col("status").alias(name))
        out = one if out is None else out.join(one.hint("merge"), case, "full")
    return out


def alerts(rows: DataFrame, age_s: Column, limits: dict[str, int]) -> DataFrame:
    """Rows of a stage that have been there for longer than its limit."""
    limit = F.coalesce(*[F.when(F.col("stage") == s, F.lit(v)) for s, v in limits.items()])
    return rows.withColumn("age_s", age_s).where(F.col("age_s") > limit)


def stage_alerts(rows: DataFrame, queue: str, age_s: Column, limits: dict[str, int], most_errors: int) -> DataFrame:
    """A row an alert (kind, queue, n): rows that have been active for longer than their queue's limit, and queues with more errors than `most_errors`."""
    limit = F.coalesce(*[F.when(F.col(queue) == s, F.lit(v)) for s, v in limits.items()])
    old = F.count_if(F.col("status").isin(ACTIVE) & (age_s > limit))
    bad = F.count_if(F.col("status") == "error")
    got = rows.groupBy(F.col(queue).alias("queue")).agg(old.alias("_old"), bad.alias("_bad"))
    told = F.array(F.struct(F.lit("stale_rows").alias("kind"), F.when(F.col("_old") > 0, F.col("_old")).alias("n")), F.struct(F.lit("errors").alias("kind"), F.when(F.col("_bad") > most_errors, F.col("_bad")).alias("n")))
    return got.select("queue", F.inline(told)).where("n is not null")


def backlog(rows: DataFrame, queue: str, status: str, k: int) -> DataFrame:
    """The k queues with most waiting rows, and each one's queued, active, processed and failed rows and its share of failures."""
    n = lambda *s: F.count_if(F.col(status).isin(*s))
    got = rows.groupBy(queue).agg(n("pending").alias("queued"), n("claimed").alias("active"), n("done").alias("processed"), n("error").alias("failed"))
    got = got.withColumn("failure_rate", F.round(F.try_divide("failed", F.col("failed") + F.col("processed")), 4))
    return got.orderBy(F.desc("queued"), queue).limit(k)


def case_recent(rows: DataFrame, case: str, at: str) -> DataFrame:
    """When each case was last touched, the latest first; the order is a range shuffle."""
    return rows.groupBy(case).agg(F.max(at).alias("updated")).orderBy(F.col("updated").desc_nulls_last(), case)
