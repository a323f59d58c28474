"""Streams over the files of a table, run to their end within the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.plans.catalog import Tables, query
from voxelweave.session import work_uri
from voxelweave.streaming import queues as Q

c, L = F.col, F.lit
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _events(t: Tables) -> DataFrame:
    """The events as a stream of files. The name is a pattern, as the table may be one file, and a plain path would have to be a folder."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    return Q.read_arrivals(t.spark, f"{t.sf_dir}/event[s].parquet", schema, "parquet")


@query("select user_id as study, ts, event_type as caller, event_id from events")
def stream_arrivals(t: Tables):
    return Q.run_to_end(_events(t).select(c("user_id").alias("study"), "ts", c("event_type").alias("caller"), "event_id"), work_uri(t.spark, "arrivals"))


@query("select event_type as queue, user_id as item_id, max_by(event_id % 4, epoch_us(ts) * 1000 + event_id % 1000) as status, max(epoch_us(ts) * 1000 + event_id % 1000) as event_time from events group by 1, 2")
def queue_current(t: Tables):
    rows = _events(t).select(c("event_type").alias("queue"), c("user_id").alias("item_id"), (c("event_id") % 4).alias("status"), (F.unix_micros(c("ts").cast("timestamp")) * 1000 + c("event_id") % 1000).alias("event_time"))
    return Q.run_to_end(Q.queue_current(rows), work_uri(t.spark, "states"), ["queue", "item_id"])


@query("select cast(floor(user_id / 4) as bigint) as case_id, event_type as stage, count(*) as samples, max(value) as peak_mb, min(100 - value) as low_mb from events where event_id % 5 > 1 group by 1, 2")
def telemetry_peaks(t: Tables):
    """Of five samples one has no active case and one has two, so they can't be told to a case."""
    case = F.floor(c("user_id") / 4).cast("bigint")
    active = F.when(c("event_id") % 5 == 0, F.array().cast("array<bigint>")).when(c("event_id") % 5 == 1, F.array(case, case + 1)).otherwise(F.array(case))
    rows = _events(t).select(active.alias("active_case_ids"), c("event_type").alias("stage"), c("value").alias("rss_mb"), (100 - c("value")).alias("available_mb"))
    return Q.run_to_end(Q.telemetry_peaks(rows), work_uri(t.spark, "peaks"), ["case_id", "stage"])


IDLE_S = 6 * 3600


@query(f"""select cast(user_id as varchar) as study, count(*) as n, min(ts) as first_at, max(ts) as last_at from (select *, sum(new) over (partition by user_id order by ts, event_id) as part from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < {IDLE_S}000000 then 0 else 1 end as new from events)) group by user_id, part""")
def force_flush(t: Tables):
    """All arrivals, then a control row for every study: each session is told, the open ones because they are closed at once."""
    folder, place, rows = work_uri(t.spark, "flush-in"), work_uri(t.spark, "flushed"), t.events
    arrivals = rows.select(c("user_id").cast("string").alias("study"), c("ts").cast("timestamp").alias("ts"), c("event_type").alias("caller"), L(False).alias("flush"))
    before = t.spark.conf.get(PROVIDER, None)
    t.spark.conf.set(PROVIDER, Q.STATE_STORE)
    try:
        arrivals.write.mode("append").parquet(folder)
        stream = Q.flushable_sessions(t.spark.readStream.schema(arrivals.schema).parquet(folder), IDLE_S * 1000, "1 hour")
        Q.run_to_end(stream, place)
        last = arrivals.agg(F.max("ts")).first()[0]
        Q.force_flush(arrivals.select("study"), L(last)).write.mode("append").parquet(folder)
        told = Q.run_to_end(stream, place)
    finally:
        t.spark.conf.set(PROVIDER, before) if before else t.spark.conf.unset(PROVIDER)
    return told.select("study", "n", "first_at", "last_at")
