"""Queues, sessions, telemetry and fan-out over the queue and event views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.functions.scalars import epoch_s
from voxelweave.operators import queues as Q
from voxelweave.operators import windows
from voxelweave.plans.catalog import Tables, query

c, L = F.col, F.lit
STATUSES = ["pending", "claimed", "done"]


@query("select queue, count(*) as total, count(*) filter (status <> 'done') as active, min(case when status = 'pending' then created_at end) as oldest_pending from queue group by queue")
def queue_summary(t: Tables):
    return Q.queue_summary(t.queue, "queue", "status", "created_at")


@query("select coalesce(queue, 'all') as queue, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'claimed') as claimed, count(*) filter (status = 'done') as done from queue group by rollup(queue)")
def queue_matrix(t: Tables):
    return Q.queue_matrix(t.queue, "queue", "status", STATUSES)


@query("select queue, item, place from (select queue, item, row_number() over (partition by queue order by created_at, item) as place from queue where status = 'pending' and attempts < 4) where place <= 5")
def next_pending(t: Tables):
    return Q.next_pending(t.queue, "queue", 5, c("attempts") < 4).select("queue", "item", "place")


@query("select item from queue where status = 'claimed' and epoch(timestamp '1998-01-01') - epoch(case when item % 3 = 0 then created_at + interval 400 day else created_at end) > 86400")
def stale_claims(t: Tables):
    q = t.queue.withColumn("heartbeat", F.when(c("item") % 3 == 0, F.expr("created_at + interval 400 days")))
    return Q.stale_claims(q, "heartbeat", "created_at", F.lit("1998-01-01").cast("timestamp"), 86400).select("item")


@query("select item, case when attempts < 3 then 'pending' else 'error' end as next_status, case when attempts < 3 then cast(30 * 2 ** attempts as bigint) end as wait_s from queue")
def retry_policy(t: Tables):
    return Q.retry_policy(t.queue, 3, 30).select("item", "next_status", "wait_s")


@query("select item, case when cast(case_id as bigint) % 10 = 0 and status <> 'done' then 'canceled' else status end as status from queue")
def cancel_case(t: Tables):
    return Q.cancel(t.queue, t.queue.where("cast(case_id as bigint) % 10 = 0")).select("item", "status")


@query("select item, case when cast(case_id as bigint) % 10 = 0 and status = 'pending' then head - interval 1 second else created_at end as created_at from queue join (select queue as q, min(created_at) as head from queue where status = 'pending' group by 1) on q = queue")
def prioritize_case(t: Tables):
    return Q.prioritize(t.queue, t.queue.where("cast(case_id as bigint) % 10 = 0"), "queue").select("item", "created_at")


@query("select distinct case_id from (select case_id from queue where status <> 'done' and queue = '1-URGENT' union all select case_id from queue where status <> 'done' and queue = '2-HIGH')")
def active_union(t: Tables):
    return Q.active_union([t.queue.where("queue = '1-URGENT'"), t.queue.where("queue = '2-HIGH'")])


@query("select c_custkey from customer where cast(c_custkey as string) not in (select case_id from queue where status = 'pending')")
def protected_anti(t: Tables):
    cases = t.customer.select("c_custkey", c("c_custkey").cast("string").alias("case_id"))
    return Q.protected_anti(cases, t.queue.where("status = 'pending'")).select("c_custkey")


@query("select c_custkey from customer where cast(c_custkey as string) in (select case_id from queue where status <> 'done')")
def incomplete_semi(t: Tables):
    cases = t.customer.select("c_custkey", c("c_custkey").cast("string").alias("case_id"))
    return Q.incomplete_semi(cases, t.queue).select("c_custkey")


@query("""select study, session, count(*) as n, min(ts) as first_at, max(ts) as last_at, max_by(caller, struct_pack(a := ts, b := event_id)) as caller from (select *, sum(case when ts - b >= interval 4 hour then 1 else 0 end) over (partition by study order by ts, event_id) as session from (select *, lag(ts) over (partition by study order by ts, event_id) as b from arrivals)) group by study, session""")
def study_sessions(t: Tables):
    return Q.sessions(t.arrivals, "study", "ts", 4 * 3600)


@query("select event_id, p is null or p = 'error' as accepted from (select event_id, lag(event_type) over (partition by user_id, cast(floor(value) as bigint) order by ts, event_id) as p from events)")
def handoff_dedup(t: Tables):
    e = t.events.withColumn("digest", F.floor("value"))
    return Q.handoff_dedup(e, ["user_id", "digest"], "ts", c("event_type") == "error").select("event_id", "accepted")


@query("select case_id, stage, min(ts) as first_at, max(ts) as last_at, count(*) as samples, max(gauge) as peak, min(gauge) as low from telemetry group by case_id, stage")
def case_peaks(t: Tables):
    one = Q.single_case(t.telemetry.withColumn("cases", F.array("case_id")).drop("case_id"), "cases")
    return Q.case_peaks(one)


@query("select to_timestamp(floor(epoch(ts) / 300) * 300)::timestamp as start, stage, count(*) as n, round(avg(gauge), 6) as mean from telemetry group by 1, 2")
def telemetry_windows(t: Tables):
    return Q.windows_of(t.telemetry, "ts", "stage", "5 minutes", "gauge").withColumn("mean", F.round("mean", 6))


@query("select stage, round(avg(s), 4) as mean_s, count(*) as n_cases from (select case_id, stage, epoch(max(ts)) - epoch(min(ts)) as s from telemetry group by 1, 2) group by stage")
def stage_means(t: Tables):
    return Q.stage_means(t.telemetry, "case_id", "stage", "ts").withColumn("mean_s", F.round("mean_s", 4))


@query("select item, case when item % 5 <> 0 or item % 7 <> 0 then case when item % 5 <> 0 then bytes else 0 end + case when item % 7 <> 0 then attempts else 0 end end as seconds from queue")
def pipeline_elapsed(t: Tables):
    q = t.queue.withColumns({"a": F.when(c("item") % 5 != 0, c("bytes")), "b": F.when(c("item") % 7 != 0, c("attempts").cast("double"))})
    return q.select("item", Q.pipeline_elapsed(q, ["a", "b"]).alias("seconds"))


@query("select mask, n, round(r, 8) as r, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(sd_a, 6) as sd_a, round(sd_b, 6) as sd_b, round(bias, 6) as bias from (select l_returnflag as mask, count(*) as n, corr(l_quantity, l_extendedprice) as r, avg(l_quantity) as mean_a, avg(l_extendedprice) as mean_b, stddev_samp(l_quantity) as sd_a, stddev_samp(l_extendedprice) as sd_b, avg(l_quantity - l_extendedprice) as bias from lineitem group by 1)")
def method_agreement(t: Tables):
    got = Q.method_agreement(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    digits = {"r": 8, "mean_a": 6, "mean_b": 6, "sd_a": 6, "sd_b": 6, "bias": 6}
    return got.select(c("l_returnflag").alias("mask"), "n", *[F.round(k, d).alias(k) for k, d in digits.items()])


SENT = "(select artifact, origin as case_id, case when artifact % 10 = 0 then '' else concat('p', cast(artifact % 40 as string)) end as path, case when artifact % 6 = 0 then ' ' else kind end as kind from artifacts)"
TAKEN = "list_contains(list_filter(list_transform(string_split(kinds, ','), lambda x: trim(x)), lambda x: x <> ''), {0})"


def _subscribers(t: Tables):
    return t.subscribers.withColumn("accepts", F.split("kinds", ","))


@query(f"""select case_id, path, name as destination, kind, host, port from (select s.*, d.*, row_number() over (partition by case_id, path, name order by artifact, ordinal) as r from (select artifact, case_id, path, case when trim(kind) = '' then 'secondary_capture' else kind end as kind from {SENT} where path <> '') s
 join subscribers d on enabled and trim(name) <> '' and host <> '' and port > 0 and (kinds is null or {TAKEN.format('s.kind')})) where r = 1""")
def fanout_egress(t: Tables):
    """Artifacts share paths within a case, some lack one or a kind; some destinations share a name or lack an address."""
    sent = t.artifacts.select("artifact", c("origin").alias("case_id"), F.when(c("artifact") % 10 == 0, "").otherwise(F.concat(L("p"), (c("artifact") % 40).cast("string"))).alias("path"), F.when(c("artifact") % 6 == 0, " ").otherwise(c("kind")).alias("kind"))
    return Q.fanout(sent, _subscribers(t), "kind", "case_id", "path", "artifact", ["host", "port"])


@query(f"select artifact, name as destination, kind, host from (select a.*, d.*, row_number() over (partition by artifact, name order by ordinal) as r from artifacts a join subscribers d on enabled and trim(name) <> '' and host <> '' and (kinds is null or {TAKEN.format('a.kind')})) where r = 1")
def fanout_events(t: Tables):
    """Every subscriber gets the event, once by its name."""
    return Q.fanout_events(t.artifacts, _subscribers(t), "kind", "artifact", ["host"])


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 'insert' when o_orderkey % 3 = 0 or o_orderstatus = 'F' then 'requeue' else 'keep' end as action from orders")
def digest_upsert(t: Tables):
    cur = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", F.sha2(c("o_custkey").cast("string"), 256).alias("digest"), F.when(c("o_orderstatus") == "F", "error").otherwise("done").alias("status"))
    new = t.orders.select("o_orderkey", F.sha2(F.when(c("o_orderkey") % 3 == 0, "changed").otherwise(c("o_custkey").cast("string")), 256).alias("digest"))
    return Q.digest_upsert(cur, new, "o_orderkey").select("o_orderkey", "action")


@query("select item, case when item % 3 = 0 then case when status = 'done' then 'done' else 'pending' end else status end as status from queue")
def keep_done_upsert(t: Tables):
    return Q.keep_done_upsert(t.queue, t.queue.where("item % 3 = 0"), "item")


@query("select c_custkey, case when c_custkey % 2 = 0 then c_name else upper(c_name) end as c_name, case when c_custkey % 2 = 0 then c_mktsegment when c_custkey % 3 = 0 then c_mktsegment else 'NEW' end as c_mktsegment from customer union all select -1 - c_custkey, c_name, 'NEW' from customer where c_custkey < 10")
def upsert_by_key(t: Tables):
    cur = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = cur.where("c_custkey % 2 <> 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(c("c_custkey") % 3 == 0, "").otherwise("NEW").alias("c_mktsegment"))
    new = new.union(cur.where("c_custkey < 10").select(-1 - c("c_custkey"), "c_name", L("NEW")))
    return Q.upsert(cur, new, "c_custkey", ["c_mktsegment"])


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1 and value > 20")
def publish_latest(t: Tables):
    return Q.latest(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"], c("value") > 20).select("user_id", "event_type", "event_id")


@query("select item, case_id from queue order by created_at desc, lower(case_id)")
def patient_list(t: Tables):
    return Q.patient_list(t.queue, "created_at", "case_id").select("item", "case_id")


@query("select item from queue where (contains(case_id, '17') or contains(lower(queue), '17')) and cast(created_at as date) between date '1996-01-01' and date '1997-06-30'")
def search_filter(t: Tables):
    return Q.search_filter(t.queue, "17", ["case_id", "queue"], "created_at", "1996-01-01", "1997-06-30").select("item")


@query("""with a as (select sum(bytes) as used, count(*) as n from queue), p as (select distinct case_id from queue where status = 'claimed' and attempts = 4),
 r as (select item, bytes, created_at, coalesce(sum(bytes) over w, 0) as freed, row_number() over (order by created_at, item) as place from queue where case_id not in (select case_id from p) window w as (order by created_at, item rows between unbounded preceding and 1 preceding))
 select item, place, round(freed, 2) as freed_before, round((used - freed - bytes) / used * 100, 6) as used_percent_after from r, a where (used - freed) / used * 100 >= 97.5 or used - (used - freed) < 0.03 * used or n - place + 1 > 0.96 * n or created_at < date '1992-03-01'""")
def purge_plan(t: Tables):
    """All four rules at once on a disk that the cases fill; cases with a claim at its last attempt are protected."""
    used, n = t.queue.agg(F.sum("bytes"), F.count("*")).first()
    got = windows.purge_plan(t.queue, ["created_at", "item"], "bytes", used or 1.0, 97.5, 0.03 * (used or 0), int(0.96 * n), c("created_at") < F.lit("1992-03-01").cast("date"), t.queue.where("status = 'claimed' and attempts = 4"))
    return got.select("item", "place", F.round("freed_before", 2).alias("freed_before"), F.round("used_percent_after", 6).alias("used_percent_after"))


@query("select coalesce(a.case_id, b.case_id) as case_id, a.s as intake, b.s as metrics from (select case_id, max(status) as s from queue where queue = '1-URGENT' group by 1) a full join (select case_id, max(status) as s from queue where queue = '2-HIGH' group by 1) b on a.case_id = b.case_id")
def case_map_outer(t: Tables):
    one = lambda q: t.queue.where(c("queue") == q).groupBy("case_id").agg(F.max("status").alias("status"))
    return Q.case_map({"intake": one("1-URGENT"), "metrics": one("2-HIGH")}, "case_id")


@query("select event_id, event_type as stage from events where epoch(timestamp '2024-01-31') - epoch(ts) > case event_type when 'error' then 1000000 when 'click' then 2000000 end")
def stage_alerts(t: Tables):
    rows = t.events.select("event_id", c("event_type").alias("stage"), "ts")
    age = epoch_s(F.lit("2024-01-31")) - epoch_s(c("ts"))
    return Q.alerts(rows, age, {"error": 1000000, "click": 2000000}).select("event_id", "stage")


@query("select queue, item, place from (select queue, item, row_number() over (partition by queue order by created_at desc, item) as place from queue where status = 'pending') where place <= 3")
def backlog_top(t: Tables):
    return windows.first_by(t.queue.where("status = 'pending'"), ["queue"], c("created_at").desc(), c("item"), top=3).withColumn("place", F.row_number().over(W.partitionBy("queue").orderBy(c("created_at").desc(), "item"))).select("queue", "item", "place")


@query("select case_id, max(created_at) as updated from queue group by case_id")
def case_recent(t: Tables):
    return Q.case_recent(t.queue, "case_id", "created_at")


@query("select queue, item, place from (select queue, item, row_number() over (partition by queue order by case when attempts > 0 then created_at + attempts * 40 * interval 1 day end asc nulls first, created_at, item) as place from queue where status = 'pending') where place <= 5")
def next_retry(t: Tables):
    """Rows that were tried before wait for their next attempt; those that were not come first."""
    rows = t.queue.withColumn("next_at", F.when(c("attempts") > 0, F.expr("created_at + make_dt_interval(attempts * 40)")))
    return Q.next_pending(rows, "queue", 5, retry_at="next_at").select("queue", "item", "place")


FAILING = "(select *, case when item % 7 = 3 then 'error' else status end as state from queue)"


@query(f"select * from (select queue, count(*) filter (state = 'pending') as queued, count(*) filter (state = 'claimed') as active, count(*) filter (state = 'done') as processed, count(*) filter (state = 'error') as failed, round(count(*) filter (state = 'error') / nullif(count(*) filter (state in ('error', 'done')), 0), 4) as failure_rate from {FAILING} group by queue) order by queued desc, queue limit 3")
def backlog_counts(t: Tables):
    rows = t.queue.withColumn("state", F.when(c("item") % 7 == 3, "error").otherwise(c("status")))
    return Q.backlog(rows, "queue", "state", 3)


@query(f"""with s as (select queue, count(*) filter (state in ('pending', 'claimed') and epoch(timestamp '1998-08-02') - epoch(created_at) > case queue when '1-URGENT' then 86400 when '2-HIGH' then 200000000 when '5-LOW' then 900000000 end) as o, count(*) filter (state = 'error') as e from {FAILING} group by queue)
 select queue, 'stale_rows' as kind, o as n from s where o > 0 union all select queue, 'errors', e from s where e > 400""")
def alerts_by_queue(t: Tables):
    rows = t.queue.withColumn("status", F.when(c("item") % 7 == 3, "error").otherwise(c("status")))
    return Q.stage_alerts(rows, "queue", epoch_s(F.lit("1998-08-02")) - epoch_s(c("created_at")), {"1-URGENT": 86400, "2-HIGH": 200000000, "5-LOW": 900000000}, 400)
