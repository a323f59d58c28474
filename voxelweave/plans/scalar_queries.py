"""Scalar functions over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.functions import predicates as P
from voxelweave.functions import scalars as S
from voxelweave.plans.catalog import Tables, query

c, L = F.col, F.lit


@query("select p_partkey, coalesce(case when a not in ('', 'Unknown') then a end, case when b not in ('', 'Unknown') then b end) as value from (select p_partkey, case p_size % 4 when 0 then 'Unknown' when 1 then '' when 2 then null else p_type end as a, case when p_size % 7 = 0 then 'Unknown' else p_brand end as b from part)")
def first_present(t: Tables):
    a = F.when(c("p_size") % 4 == 0, "Unknown").when(c("p_size") % 4 == 1, "").when(c("p_size") % 4 == 3, c("p_type"))
    b = F.when(c("p_size") % 7 == 0, "Unknown").otherwise(c("p_brand"))
    return t.part.select("p_partkey", S.first_present(a, b).alias("value"))


TRI = "case p_size % 6 when 0 then ' Yes ' when 1 then 'no' when 2 then 'CT with contrast 3' when 3 then '' when 4 then 'w/o contrast scan' else p_type end"


@query(f"select p_partkey, case when w = '' then null when w in ('1','true','t','yes','y','contrast','enhanced','postcontrast','arterial','venous','delayed') or contains(w, 'with contrast') then true when w in ('0','false','f','no','n','native','noncontrast','non-contrast','unenhanced') or contains(w, 'without contrast') or contains(w, 'w/o contrast') then false end as value from (select p_partkey, lower(trim({TRI})) as w from part)")
def parse_tristate(t: Tables):
    return t.part.select("p_partkey", S.parse_tristate(F.expr(TRI)).alias("value"))


@query("select uid, case when phase like '%native%' then false when phase like '%arterial%' or phase like '%venous%' or phase like '%portal%' then true end as contrast, case when trim(phase) = '' then 'unknown' else phase end as normal, phase like '%arterial%' or phase like '%venous%' as is_contrast from series")
def phase_contrast(t: Tables):
    return t.series.select("uid", S.phase_contrast(c("phase")).alias("contrast"), S.phase_normalize(c("phase")).alias("normal"), S.is_contrast(c("phase")).alias("is_contrast"))


@query("select doc_id, replace(strip_accents(replace(lower(coalesce(text, '')), 'ß', chr(1))), chr(1), 'ß') as folded from documents")
def text_fold(t: Tables):
    docs = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    return docs.select("doc_id", S.text_fold(c("text")).alias("folded"))


@query("select p_partkey, try_cast(replace(nullif(regexp_extract(w, '[-+]?[0-9]+(?:[.,][0-9]+)?', 0), ''), ',', '.') as double) as value from (select p_partkey, case p_size % 3 when 0 then concat('W ', replace(cast(p_retailprice as varchar), '.', ','), ' x') when 1 then p_brand else p_name end as w from part)")
def first_number(t: Tables):
    w = F.when(c("p_size") % 3 == 0, F.concat(L("W "), F.replace(c("p_retailprice").cast("string"), L("."), L(",")), L(" x"))).when(c("p_size") % 3 == 1, c("p_brand")).otherwise(c("p_name"))
    return t.part.select("p_partkey", S.first_number(w).alias("value"))


@query("select l_orderkey, l_linenumber, count(*) as n, sum(v[1] + v[2] + v[3]) as total from (select l_orderkey, l_linenumber, case when l_suppkey % 5 <> 0 then [l_quantity, l_tax, l_discount] end as v from lineitem) group by 1, 2")
def parse_sequence(t: Tables):
    text = F.concat_ws("\\", c("l_quantity").cast("string"), c("l_tax").cast("string"), F.when(c("l_suppkey") % 5 == 0, "x").otherwise(c("l_discount").cast("string")))
    v = S.parse_sequence(text, 3)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", v.alias("v"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.expr("v[0] + v[1] + v[2]")).alias("total"))


NAME = "concat(split_part(p_name, ' ', 1), '^', split_part(p_name, ' ', 2), '^ ', p_type)"


@query(f"select p_partkey, replace({NAME}, '^', ' ') as d1, regexp_replace(concat(split_part(p_name, ' ', 2), ' ', p_type, ' ', split_part(p_name, ' ', 1)), ' +', ' ', 'g') as d2 from part".replace("replace(" + NAME + ", '^', ' ')", "concat(split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2), ' ', p_type)"))
def name_display(t: Tables):
    name = F.expr(NAME)
    return t.part.select("p_partkey", S.name_display(name).alias("d1"), S.name_display(name, True).alias("d2"))


@query("select p_partkey, concat(case when p_size % 5 = 0 then '000000' else replace(replace(p_brand, '#', ''), ' ', '') end, '_', upper(substr(a, 1, 1)), substr(a, 2), case when length(b) > 3 then upper(substr(b, 1, 1)) else '' end, substr(p_type, 1, 1)) as value from (select *, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part)")
def case_name(t: Tables):
    acc = F.when(c("p_size") % 5 == 0, "#").otherwise(c("p_brand"))
    return t.part.select("p_partkey", S.case_name(F.expr(NAME), acc).alias("value"))


@query("select p_partkey, concat(replace(p_name, ' ', '_'), '_', replace(p_brand, '#', '_')) as stem from part")
def storage_stem(t: Tables):
    return t.part.select("p_partkey", S.storage_stem(c("p_name"), L(None).cast("string"), c("p_brand")).alias("stem"))


@query("select o_orderkey, case o_orderkey % 4 when 3 then null when 1 then date_trunc('day', o_orderdate) else o_orderdate end as at from orders")
def parse_timestamp(t: Tables):
    k = c("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return t.orders.select("o_orderkey", S.parse_timestamp(text).alias("at"))


@query("select event_id, case event_id % 3 when 0 then date_trunc('second', ts) when 1 then date_trunc('minute', ts) else null end as at from events")
def parse_header_time(t: Tables):
    k = c("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyyMMddHHmmss.SSSSSS")).when(k == 1, F.date_format("ts", "yyyyMMddHHmm")).otherwise("2024x")
    return t.events.select("event_id", S.parse_header_time(text).alias("at"))


@query("select event_id, case when event_id % 7 = 0 then null else cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as double) end as seconds from events")
def duration_seconds(t: Tables):
    text = F.when(c("event_id") % 7 == 0, "12:30").otherwise(F.date_format("ts", "H:mm:ss"))
    return t.events.select("event_id", S.duration_seconds(text).alias("seconds"))


@query("select l_orderkey, l_linenumber, count(*) as n, max(case when o_orderdate <= l_shipdate and l_linenumber % 5 <> 0 then date_part('year', age(l_shipdate, o_orderdate)) end) as years from lineitem join orders on o_orderkey = l_orderkey group by 1, 2")
def age_at_study(t: Tables):
    both = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    birth = F.when(c("l_linenumber") % 5 == 0, "19x0").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    both = both.withColumn("years", S.age_at_study(birth, F.date_format("l_shipdate", "yyyyMMdd")))
    return both.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max("years").alias("years"))


@query("select vec_id, case when sqrt(a*a+b*b+d*d) > 0 then a / sqrt(a*a+b*b+d*d) end as nx, case when sqrt(a*a+b*b+d*d) > 0 then (a*e[7] + b*e[8] + d*e[9]) / sqrt(a*a+b*b+d*d) end as along from (select vec_id, e, e[2]*e[6] - e[3]*e[5] as a, e[3]*e[4] - e[1]*e[6] as b, e[1]*e[5] - e[2]*e[4] as d from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings))")
def slice_normal_projection(t: Tables):
    e = t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    n = e.withColumn("n", S.slice_normal(c("e")))
    return n.select("vec_id", F.get("n", L(0)).alias("nx"), S.dot(c("n"), F.slice("e", 7, 3)).alias("along"))


@query("select vec_id, e[1]*3 + e[2]*5 + e[3]*7 + e[4] as wx, e[9]*3 + e[10]*5 + e[11]*7 + e[12] as wz, case when abs(e[1]) >= abs(e[2]) and abs(e[1]) >= abs(e[3]) then 0 when abs(e[2]) >= abs(e[3]) then 1 else 2 end as axis, case when abs(e[1]) >= abs(e[2]) and abs(e[1]) >= abs(e[3]) then e[1] when abs(e[2]) >= abs(e[3]) then e[2] else e[3] end >= 0 as up from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings)")
def affine_world(t: Tables):
    e = t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    w = S.affine_world(c("e"), L(3), L(5), L(7))
    code = S.axis_code(c("e"), 0)
    return e.select("vec_id", F.get(w, L(0)).alias("wx"), F.get(w, L(2)).alias("wz"), code["axis"].alias("axis"), code["positive"].alias("up"))


AXIS = "case when abs(e[{0}]) >= abs(e[{1}]) and abs(e[{0}]) >= abs(e[{2}]) then 0 when abs(e[{1}]) >= abs(e[{2}]) then 1 else 2 end"
WORLD = {"lateral": (1, 2, 3), "ap": (5, 6, 7), "si": (9, 10, 11)}


@query("select vec_id, " + ", ".join(f"{AXIS.format(*at)} as {name}_axis, e[{at[0]} + {AXIS.format(*at)}] >= 0 as {name}_up" for name, at in WORLD.items()) + " from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings)")
def axis_codes(t: Tables):
    """The array axes that run along the three world axes, and which way."""
    e = t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    codes = {name: S.axis_code(c("e"), row) for row, name in enumerate(WORLD)}
    return e.select("vec_id", *[x for name, code in codes.items() for x in (code["axis"].alias(f"{name}_axis"), code["positive"].alias(f"{name}_up"))])


@query("""select p_partkey, sha256(concat('{"p_name":"', p_name, '","p_size":', cast(p_size as varchar), ',"none":null}')) as signature from part""")
def canonical_signature(t: Tables):
    return t.part.select("p_partkey", S.canonical_signature(c("p_name"), c("p_size"), L(None).cast("string").alias("none")).alias("signature"))


@query("""select study, concat('acq_', substr(sha256(concat('["', string_agg(uid, '","' order by uid), '"]')), 1, 16)) as id from series group by study""")
def acquisition_ids(t: Tables):
    return t.series.groupBy("study").agg(S.acquisition_id(F.collect_list("uid")).alias("id"))


@query("select event_id, coalesce(cast(json_extract(props, '$.k') as bigint) <> 0, false) as set, false as missing from events")
def json_path_value(t: Tables):
    return t.events.select("event_id", S.json_true(c("props"), "k").alias("set"), S.json_true(c("props"), "a.b").alias("missing"))


@query("select l_orderkey, l_linenumber, avg(case when h between 0.8 and 2.5 and l_quantity * 4 between 20 and 400 then l_quantity * 4 / (h * h) end) as bmi, avg(case when h between 0.8 and 2.5 then l_quantity / (h * h) end) as smi, avg(round(sqrt(h * 100 * l_quantity / 3600), 2)) as bsa from (select *, l_extendedprice / 40000 as h from lineitem) group by 1, 2")
def bmi_smi(t: Tables):
    h = c("l_extendedprice") / 40000
    rows = t.lineitem.select("l_orderkey", "l_linenumber", S.bmi(c("l_quantity") * 4, h).alias("b"), S.smi(c("l_quantity"), h).alias("s"), S.body_surface(h * 100, c("l_quantity")).alias("a"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.avg("b").alias("bmi"), F.avg("s").alias("smi"), F.avg("a").alias("bsa"))


@query("select p_partkey, coalesce(nullif(case when p_size % 3 = 0 then 'Unknown' else p_type end, 'Unknown'), nullif(case when p_size % 2 = 0 then 'Unknown' else p_brand end, 'Unknown'), 'Unknown') as kvp from part")
def kvp_backfill(t: Tables):
    a = F.when(c("p_size") % 3 == 0, "Unknown").otherwise(c("p_type"))
    b = F.when(c("p_size") % 2 == 0, "Unknown").otherwise(c("p_brand"))
    return t.part.select("p_partkey", S.kvp_backfill(a, b).alias("kvp"))


@query("select p_partkey, p_brand as note, 'anon' as name from part")
def deidentify_headers(t: Tables):
    tags = F.create_map(L("name"), c("p_name"), L("address"), c("p_type"), L("note"), c("p_brand"), L("uid"), c("p_partkey").cast("string"))
    clean = S.deidentify(tags, ["address"], {"name": "anon"}, ["uid"], "salt")
    rows = t.part.select("p_partkey", clean.alias("m")).where("not map_contains_key(m, 'address') and m['uid'] <> cast(p_partkey as string)")
    return rows.select("p_partkey", c("m")["note"].alias("note"), c("m")["name"].alias("name"))


@query("select doc_id, length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) >= 40 as flagged, length(array_to_string(list_filter(list_transform(string_split(w, chr(10)), lambda s: trim(regexp_replace(s, '[\t\n\x0b\f\r ]+', ' ', 'g'))), lambda s: s <> ''), chr(10))) as n from (select doc_id, text as w from documents)")
def text_normalize_gate(t: Tables):
    docs = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    g = S.text_gate(c("text"), 40)
    return docs.select("doc_id", g["flagged"].alias("flagged"), F.length(g["text"]).alias("n"))


@query("select p_partkey, case when v < 5 then 'normal' when v < 15 then 'mild' when v < 30 then 'moderate' when v >= 30 then 'severe' end as band from (select p_partkey, case when p_size % 10 = 0 then null else p_size end as v from part)")
def pdff_band(t: Tables):
    return t.part.select("p_partkey", S.pdff_band(F.when(c("p_size") % 10 != 0, c("p_size"))).alias("band"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'n/a' else strftime(o_orderdate, '%d/%m/%Y') end as shown from orders")
def format_date(t: Tables):
    return t.orders.select("o_orderkey", S.format_date(F.when(c("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))).alias("shown"))


@query("select o_orderkey, format('{:,}', cast(floor(o_totalprice) as bigint)) as us, replace(format('{:,}', cast(floor(o_totalprice) as bigint)), ',', '.') as br from orders")
def format_numbers(t: Tables):
    v = F.floor("o_totalprice")
    return t.orders.select("o_orderkey", S.format_number(v, 0).alias("us"), S.format_number(v, 0, "pt_BR").alias("br"))


@query("select event_id, case when event_id % 4 = 0 then cast(json_extract(props, '$.k') as varchar) else concat(event_type, '_', cast(user_id as varchar)) end as case_id from events")
def case_id_parse(t: Tables):
    row = F.when(c("event_id") % 4 == 0, F.replace("props", L('"k"'), L('"case_id"'))).otherwise("{}")
    return t.events.select("event_id", S.case_id_parse(row, c("event_type"), c("user_id").cast("string"), L(None).cast("string")).alias("case_id"))


PREF = "cast(contains(k, 'soft') as int) + cast(contains(k, 'standard') as int) + cast(contains(k, 'body') as int) + cast(contains(k, 'mediast') as int) - cast(contains(k, 'lung') as int) - cast(contains(k, 'pulmao') as int) - cast(contains(k, 'bone') as int) - cast(contains(k, 'mip') as int) - cast(contains(k, 'sharp') as int)"


@query(f"select uid, {PREF} as preference from (select uid, lower(concat(description, ' ', kernel)) as k from series)")
def reconstruction_preference(t: Tables):
    return t.series.select("uid", S.reconstruction_preference(F.concat_ws(" ", "description", "kernel")).alias("preference"))


@query("select uid, coalesce(case when z_spacing_mm > 0 then z_spacing_mm end, case when thickness_mm > 0 then thickness_mm end) as mm from series")
def geometry_metrics(t: Tables):
    return t.series.select("uid", S.effective_thickness(c("z_spacing_mm"), L(None).cast("double"), c("thickness_mm")).alias("mm"))


@query("select p_partkey, case when split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) then split_part(p_name, ' ', 1) else concat(split_part(p_name, ' ', 1), '|', split_part(p_name, ' ', 2)) end as modules from part")
def requested_modules(t: Tables):
    text = F.concat(L(" "), F.replace("p_name", L(" "), L(" , ,")), L(","), F.substring_index("p_name", " ", 1))
    return t.part.select("p_partkey", F.array_join(S.requested_modules(text), "|").alias("modules"))


@query("""select event_id, concat('patient_identified:', case when event_id % 3 = 0 then event_type else cast(user_id as varchar) end) as event_key, ts as occurred_at, case when event_id % 3 = 0 then concat('{"case_id":"', event_type, '"}') else concat('{"case_id":"', event_type, '","study":"', cast(user_id as varchar), '"}') end as payload from events""")
def event_payload(t: Tables):
    study = F.when(c("event_id") % 3 != 0, c("user_id").cast("string"))
    return t.events.select("event_id", S.event_payload(c("event_type"), study, L(None).cast("timestamp"), c("ts")).alias("e")).select("event_id", "e.*")


@query("select c_custkey, case when c_custkey % 2 = 0 then c_acctbal else n_nationkey end as least, case when c_custkey % 2 = 0 then 'submitted' else 'profile' end as source from customer join nation on c_nationkey = n_nationkey")
def profile_merge(t: Tables):
    own = F.when(c("c_custkey") % 2 == 0, c("c_acctbal"))
    both = t.customer.join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey"))  # a profile table: one row a nation
    return both.select("c_custkey", S.profile_merge(c("n_nationkey"), own).alias("least"), F.when(own.isNotNull(), "submitted").otherwise("profile").alias("source"))


@query("select user_id, coalesce(upper(trim(max(case when event_type <> 'view' then event_type end))), 'NONE') as modality, max(value) as kvp from events group by user_id")
def technique_context(t: Tables):
    got = t.events.groupBy("user_id").agg(F.max(F.when(c("event_type") != "view", c("event_type"))).alias("m"), F.max("value").alias("v"))
    ctx = got.select("user_id", P.technique_context(c("m"), c("v").cast("string")).alias("ctx"))
    return ctx.select("user_id", "ctx.modality", "ctx.kvp")
