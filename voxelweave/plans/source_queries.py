"""Readers and writers on files that the tables are written to first, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import metrics
from voxelweave.plans.catalog import Tables, query
from voxelweave.session import work_uri
from voxelweave.sources import tables as S

c, L = F.col, F.lit


@query("select series, study, count(*) as n from (select l_orderkey as series, cast(floor(l_orderkey / 7) as bigint) as study from lineitem where l_linenumber <> 3) group by 1, 2")
def scan_instances(t: Tables):
    """Every third instance of a series lacks its series and is dropped."""
    out = work_uri(t.spark, "instances")
    rows = t.instances.select(c("study").cast("string").alias("study_uid"), F.when(c("instance") != 3, c("series").cast("string")).alias("series_uid"), F.array("position").alias("image_position"), F.create_map(L("k"), L("v")).alias("tags"))
    rows.write.json(out)
    got = S.scan_instances(t.spark, out).where("tags['k'] = 'v'")
    return got.groupBy(c("series_uid").cast("bigint").alias("series"), c("study_uid").cast("bigint").alias("study")).agg(F.count("*").alias("n"))


@query("select cast(study as varchar) as case_id, metric as series_id, sum(k) as total, sum(bad) as n_bad from (select user_id as study, event_type as metric, case when event_id % 10 <> 0 then cast(json_extract(props, '$.k') as bigint) end as k, case when event_id % 10 = 0 then 1 else 0 end as bad from (select *, row_number() over (partition by user_id, event_type order by event_id) as r from events) where r = 1) group by 1, 2")
def scan_result_json(t: Tables):
    """One file a case and series, named by its folders; every tenth is broken."""
    from pyspark.sql import Window as W

    out = work_uri(t.spark, "results")
    first = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = t.events.withColumn("_r", first).where("_r = 1").select(F.when(c("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(c("props")).alias("value"), c("user_id").alias("case"), c("event_type").alias("series"))
    S.write_result_json(rows, out)
    good, bad = S.scan_result_json(t.spark, out, "k bigint")
    both = good.select(F.url_decode("case_id").alias("case_id"), F.url_decode("series_id").alias("series_id"), c("k"), L(0).alias("bad"))
    both = both.unionByName(bad.select(F.url_decode("case_id").alias("case_id"), F.url_decode("series_id").alias("series_id"), L(None).cast("bigint").alias("k"), L(1).alias("bad")))
    return both.groupBy("case_id", "series_id").agg(F.sum("k").alias("total"), F.sum("bad").alias("n_bad"))


@query("select n_name as name, n_nationkey as k from nation join region on n_regionkey = r_regionkey where n_nationkey = 7")
def scan_profiles(t: Tables):
    """The nations as profiles of one configuration file, of which the default is number 7."""
    out = work_uri(t.spark, "profiles")
    body = F.to_json(F.struct(F.max(F.when(c("n_nationkey") == 7, c("n_name"))).alias("default"), F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(c("n_nationkey").alias("k"))))).alias("profiles")))
    t.nation.agg(body.alias("value")).coalesce(1).write.text(out)  # a configuration file is one file
    got = S.scan_profile(t.spark, out)
    return got.select("name", F.try_variant_get("profile", "$.k", "bigint").alias("k"))


@query("select study, mask as anatomy, count(*) as n from lattice where mask <> 'N' group by 1, 2")
def scan_masks(t: Tables):
    v = t.lattice.withColumn("mask", F.when(c("mask") == "N", "liver").otherwise(F.concat(L("vertebrae_"), c("mask"))))
    return S.scan_masks(v).groupBy("study", "anatomy").agg(F.count("*").alias("n"))


def _drop(t: Tables, name: str):
    out = work_uri(t.spark, name)
    t.nation.select(c("n_name").alias("value"), c("n_regionkey").alias("study"), c("n_nationkey").alias("series")).repartition("study").write.partitionBy("study", "series").text(out)
    return out


@query("select concat('study=', n_regionkey) as study, count(*) as n_files from nation group by 1")
def fingerprint_content(t: Tables):
    """A file a nation; the names of files are Spark's, so what SQL can tell is how many there are."""
    return S.fingerprint_content(t.spark, _drop(t, "content")).select("study", "n_files")


@query("select concat('study=', n_regionkey) as study, count(*) as n_files from nation group by 1")
def manifest_digest(t: Tables):
    return S.manifest_digest(t.spark, _drop(t, "manifest"), "query").select("study", "n_files")


@query("select cast(r_regionkey as varchar) as case_id, null as amount, r_name as region, null as supplier from region union all select cast(s_suppkey as varchar), cast(cast(s_acctbal as decimal(12, 2)) as varchar), null, s_name from supplier")
def sink_csv_union(t: Tables):
    """Two frames with different columns as one CSV, read again as text."""
    out = work_uri(t.spark, "union")
    a = t.region.select(c("r_regionkey").alias("case_id"), c("r_name").alias("region"))
    b = t.supplier.select(c("s_suppkey").alias("case_id"), c("s_name").alias("supplier"), c("s_acctbal").cast("decimal(12,2)").alias("amount"))
    S.sink_csv_union([a, b], out, ["case_id"])
    return t.spark.read.option("header", True).csv(out)


@query("select distinct user_id as event_key, event_type as destination from events where event_type <> 'click' or user_id % 2 = 1")
def sink_outbox(t: Tables):
    """Clicks of users with an even number were sent before."""
    e = t.events.select(c("user_id").alias("event_key"), c("event_type").alias("destination"), "event_id")
    return S.sink_outbox(e, e.where("destination = 'click' and event_key % 2 = 0")).select("event_key", "destination")


@query("select user_id as case_id, event_type as metric_key, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id % 3 desc, event_id desc) as r from events) where r = 1 and value > 20")
def sink_results(t: Tables):
    """Three batches, each with rows newer and older than those of the others; the newest holds, a low value retracts."""
    path = work_uri(t.spark, "results-table")
    rows = t.events.select(c("user_id").alias("case_id"), c("event_type").alias("metric_key"), F.struct("ts", (c("event_id") % 3).alias("b"), "event_id").alias("result_ts"), (c("value") > 20).alias("publish"), "event_id")
    for batch in range(3):
        S.sink_results(rows.where(c("event_id") % 3 == batch), path, batch)
    return S.current_results(t.spark, path).select("case_id", "metric_key", "event_id")


@query("select event_id, case when event_id % 7 <> 0 then cast(json_extract(props, '$.k') as double) end as k from events")
def materialize_fields(t: Tables):
    """Every seventh payload is broken."""
    j = F.when(c("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(c("props"))
    return S.materialize_fields(t.events.select("event_id", j.alias("j")), "j", {"k": "$.k"}).select("event_id", "k")


@query("select study, 'vat_sat' as metric, status from (select study, case when count(distinct mask) = 3 then 'done' else 'not_present' end as status from lattice where mask <> 'N' or study % 5 <> 0 group by 1) where study % 2 = 0")
def m_recalculate(t: Tables):
    """One metric anew, for the studies with an even number."""
    v = t.lattice.where("mask <> 'N' or study % 5 <> 0")
    got = metrics.recalculate(["vat_sat"], {"voxels": v}, {"vat_sat": {"level": "R", "visceral": "A", "subcutaneous": "N", "pixel_cm2": 0.0063}}, c("study") % 2 == 0)
    return got["vat_sat"].select("study", L("vat_sat").alias("metric"), "status")
