"""Case records and regridding over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import cases as K
from voxelweave.operators import windows
from voxelweave.plans.catalog import Tables, query

c, L = F.col, F.lit


@query("select event_id from events where cast(json_extract(props, '$.k') as varchar) in (select cast(s_suppkey as varchar) from supplier where s_suppkey % 3 = 0)")
def case_lookup(t: Tables):
    wanted = t.supplier.where("s_suppkey % 3 = 0").select(c("s_suppkey").cast("string").alias("case_id"))
    return K.case_lookup(t.events, wanted, "props", "$.k").select("event_id")


@query("select case_id, 'prepare' as stage, created_at as since from queue where status = 'pending' and attempts = 0 union all select case_id, 'metrics', created_at from queue where status = 'claimed' and queue = '2-HIGH' union all select case_id, 'segmentation', created_at from queue where status = 'claimed' and queue = '1-URGENT'")
def active_by_stage(t: Tables):
    h = t.queue.where("attempts = 0 and status = 'pending'").withColumn("status", L("preparing"))
    return K.active_by_stage(h, {"metrics": t.queue.where("queue = '2-HIGH'"), "segmentation": t.queue.where("queue = '1-URGENT'")})


@query("select c_custkey, case when c_custkey % 2 = 0 then upper(c_name) else c_name end as c_name, case when c_custkey % 2 = 0 and c_custkey % 3 <> 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer")
def biometrics_patch(t: Tables):
    cur = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = cur.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(c("c_custkey") % 3 != 0, c("c_acctbal") + 1).alias("c_acctbal"))
    return K.patched(cur, new, "c_custkey", ["c_acctbal"])


@query("select item, cast(case_id as bigint) % 7 = 0 as purged from queue")
def purge_mark(t: Tables):
    return K.purge_mark(t.queue, t.queue.where("cast(case_id as bigint) % 7 = 0"), "case_id").select("item", "purged")


@query("select item from queue where not (cast(case_id as bigint) % 7 = 0 and status <> 'done')")
def downstream_reset(t: Tables):
    return K.downstream_reset(t.queue, t.queue.where("cast(case_id as bigint) % 7 = 0"), "case_id").select("item")


@query("select item, epoch(case when status = 'done' then created_at + interval 3 day else timestamp '2005-01-01' end) - epoch(created_at) as elapsed_s from queue")
def live_elapsed(t: Tables):
    q = t.queue.withColumn("ended", F.when(c("status") == "done", F.expr("created_at + interval 3 days")))
    return K.live_elapsed(q, "created_at", "ended", L("2005-01-01").cast("timestamp_ntz")).select("item", "elapsed_s")


@query("select l_orderkey as study, sum(l_quantity) as wait, sum(cast(l_linenumber as double)) as run, count(*) filter (l_returnflag <> 'R') as n_ok from lineitem group by 1")
def phase_totals(t: Tables):
    rows = t.lineitem.select(c("l_orderkey").alias("study"), c("l_quantity").alias("wait"), c("l_linenumber").cast("double").alias("run"), "l_returnflag")
    return K.phase_totals(rows, "study", ["wait", "run"], c("l_returnflag") != "R")


@query("select source, count(*) filter (n >= 600 and lang <> 'de') as findings, count(*) filter (lang = 'de') as errors, count(*) filter (n < 600 and lang <> 'de') as clean from (select source, lang, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as n from documents) group by source")
def text_report(t: Tables):
    d = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    return K.text_report(d, "source", F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) >= 600, c("lang") == "de")


@query("select c_custkey, case when c_custkey % 2 = 0 then 'a' when c_custkey % 3 = 0 then 'b' when c_custkey % 5 = 0 then 'c' end as status, case when c_custkey % 2 = 0 then 'study' when c_custkey % 3 = 0 then 'sidecar' when c_custkey % 5 = 0 then 'delivery' end as source from customer")
def job_status_lookup(t: Tables):
    cust = t.customer.select("c_custkey")
    part = lambda k, s: cust.where(c("c_custkey") % k == 0).withColumn("status", L(s))
    return K.job_status_lookup(cust, part(2, "a"), part(3, "b"), part(5, "c"), "c_custkey")


@query("""with b as (select study, first, length from (select *, row_number() over (partition by study order by length desc, first) as r from (select study, min(ordinal) as first, count(*) as length from (select study, ordinal, ordinal - row_number() over (partition by study order by ordinal) as i from levels) group by study, i)) where r = 1)
 select l.study, min(center) as low, max(center + 2) as high, count(*) as n_levels from levels l join b on l.study = b.study and ordinal >= first and ordinal < first + length group by l.study""")
def abdominal_aggregate(t: Tables):
    lv = t.levels.withColumn("top", c("center") + 2)
    return K.abdominal_aggregate(lv, windows.longest_block(lv, ["study"], "ordinal"), ["study"], "ordinal", "center", "top")


@query("select study, mask, count(*) as n, avg(hu) as mean from lattice where z = 12 and ((x - 30) * 0.7 / 12) * ((x - 30) * 0.7 / 12) + ((y - 25) * 0.9 / 9) * ((y - 25) * 0.9 / 9) <= 1 group by study, mask")
def ellipse_roi(t: Tables):
    centres = t.lattice.select("study", "mask").distinct().withColumns({"z": L(12), "cx": L(30), "cy": L(25)})
    return K.ellipse_roi(t.lattice, centres, ["study", "mask"], 12.0, 9.0, (0.7, 0.9))


@query("""with g as (select *, x * 3 + y * 5 + z * 7 as hu from blobs where mask = 0), p as (select distinct study, unnest(generate_series(0, 40)) as tx, ty, tz from (select distinct study, unnest(generate_series(0, 40)) as ty, tz from (select distinct study, unnest(generate_series(0, 40)) as tz from g)))
 select study, tx as x, ty as y, tz as z, cast(tx * 1.5 * 3 + ty * 1.5 * 5 + tz * 1.5 * 7 as double) as hu from p where (select count(*) from g where g.study = p.study and abs(g.x - tx * 1.5) < 1 and abs(g.y - ty * 1.5) < 1 and abs(g.z - tz * 1.5) < 1) = (case when tx % 2 = 0 then 1 else 2 end) * (case when ty % 2 = 0 then 1 else 2 end) * (case when tz % 2 = 0 then 1 else 2 end)""")
def affine_resample(t: Tables):
    v = t.blobs.where("mask = 0").withColumn("hu", c("x") * 3 + c("y") * 5 + c("z") * 7)
    return K.affine_resample(v.select("study", "x", "y", "z", "hu"), ["study"], (1.5, 1.5, 1.5))
