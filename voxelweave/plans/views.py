"""Imaging-shaped views over the driver's star tables, as one SQL text that Spark and DuckDB both read.

{name} stands for a table; {offsets} for the engine's way to give each row all offsets from -6 to 6 along three axes,
{box} for that to give it all places of a box.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxelweave.session import table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
LATTICES = {"{offsets}": [("dx", -6, 6), ("dy", -6, 6), ("dz", -6, 6)], "{box}": [("dx", 0, 10), ("dy", 0, 8), ("dz", 0, 13)]}
#: Rows that a task gives the places of a lattice; each makes up to 2,197, whatever the table's files are like.
SPREAD_ROWS = 512
WAYS = {"spark": "lateral view explode(sequence({1}, {2})) _{0} as {0}", "duckdb": "cross join (select unnest(generate_series({1}, {2})) as {0}) _{0}"}


def _spelt(text: str, engine: str) -> str:
    for name, axes in LATTICES.items():
        text = text.replace(name, " ".join(WAYS[engine].format(*axis) for axis in axes))
    return text


VIEWS = {
    # sparse label voxels: study, mask, x, y, z and a density value
    "lattice": """
        select cast(floor(l_orderkey / 4096) as bigint) as study, l_returnflag as mask, cast(l_partkey % 64 as int) as x,
               cast(l_quantity as int) as y, cast(l_suppkey % 32 as int) as z,
               min(cast(floor(l_extendedprice) as bigint) % 400 - 100) as hu
        from {lineitem} group by 1, 2, 3, 4, 5""",
    # balls of three masks a study; three by three they lie so near to each other that some share voxels, some touch and some are apart
    "blobs": """
        select distinct study, mask, cx + dx as x, cy + dy as y, cz + dz as z
        from (select cast(floor(s_suppkey / 21) as bigint) as study, cast(s_suppkey % 3 as int) as mask,
                     cast(cast(floor(s_suppkey / 3) as int) * 7 % 40 + 8 + s_suppkey % 3 * (floor(s_suppkey / 3) % 6) as int) as cx,
                     cast(cast(floor(s_suppkey / 3) as int) * 11 % 40 + 8 as int) as cy, cast(cast(floor(s_suppkey / 3) as int) * 13 % 40 + 8 as int) as cz,
                     cast(3 + s_suppkey % 4 as int) as r from {supplier}) s {offsets}
        where dx * dx + dy * dy + dz * dz <= r * r""",
    # spines of five vertebrae, a box each that is lower in front, in the middle or all along by a loss of up to 6 of 14 voxels, with a gap in front
    "spine": """
        select study, mask, x, y, z, (x * 7 + y * 5 + z * 3) % 90 + level * 20 as hu
        from (select cast(floor(s_suppkey / 5) as bigint) as study, concat('v', cast(s_suppkey % 5 as string)) as mask, s_suppkey % 5 as level, cast(s_suppkey % 7 as int) as loss, cast(floor(s_suppkey / 7) % 3 as int) as kind,
                     cast(dx + 3 as int) as x, cast(dy + 2 as int) as y, cast(dz + s_suppkey % 5 * 16 + 1 as int) as z, dy, dz from {supplier} s {box}) v
        where dz < 14 - case when kind = 0 and dy < 3 then loss when kind = 1 and dy between 3 and 5 then loss when kind = 2 then loss else 0 end and not (dy < 2 and dz between 3 and 5)""",
    # work-queue rows
    "queue": """
        select o_orderkey as item, cast(o_custkey as string) as case_id, case o_orderstatus when 'F' then 'done' when 'P' then 'pending' else 'claimed' end as status,
               o_orderdate as created_at, o_orderpriority as queue, cast(o_totalprice as double) as bytes, cast(o_orderkey % 5 as int) as attempts
        from {orders}""",
    "arrivals": "select user_id as study, ts, event_type as caller, event_id from {events}",
    "telemetry": "select cast(floor(user_id / 4) as bigint) as case_id, event_type as stage, ts, value as gauge, event_id from {events}",
    # series headers: one row a part and supplier pair, several a study
    "series": """
        select cast(floor(p_partkey / 20) as bigint) as study, concat('s', lpad(cast(p_partkey as string), 8, '0')) as uid, cast(p_partkey as string) as series_number,
               case when p_partkey % 11 = 0 then 'MR' else 'CT' end as modality, concat(p_type, ' ', p_name) as description,
               case p_size % 6 when 0 then 'native' when 1 then 'portal_venous' when 2 then 'arterial' when 3 then 'unknown' when 4 then 'venous' else ' ' end as phase,
               case p_size % 4 when 0 then 'B30f' when 1 then 'Lung 60' when 2 then 'soft standard' else 'bone sharp' end as kernel,
               cast(p_size % 7 * 20 as int) as slice_count, case when p_size % 9 = 0 then null else p_retailprice - 900 + p_size * 10 end as coverage_mm,
               case when p_size % 8 = 0 then 0.0 else cast(p_size % 5 + 1 as double) end as z_spacing_mm, cast(p_size as double) / 10 as thickness_mm,
               cast(p_partkey % 100 as double) / 100 as probability, p_partkey % 2 = 0 as phase_detected, concat('f', cast(p_partkey % 3 as string)) as frame,
               cast(p_partkey % 4 as string) as acquisition, cast(p_partkey % 40 as double) as low_mm, cast(p_partkey % 40 + p_size + 1 as double) as high_mm
        from {part}""",
    # reconstructions with what tells that two show the same: some lack a number, a frame, a time or an orientation; tilt is in degrees
    "recons": """
        select cast(floor(p_partkey / 20) as bigint) as study, concat('s', lpad(cast(p_partkey as string), 8, '0')) as uid, case when p_partkey % 11 = 0 then 'MR' else 'CT' end as modality,
               case p_size % 7 when 0 then 'native' when 1 then 'venous' when 2 then null when 3 then '' else 'unknown' end as phase,
               case when p_partkey % 5 = 0 then '' when p_partkey % 7 = 0 then null else concat('f', cast(p_partkey % 2 as string)) end as frame,
               case when p_partkey % 4 = 0 then null when p_partkey % 13 = 0 then '' else cast(p_size % 3 as string) end as acquisition,
               case when p_partkey % 6 = 0 then null else concat('202401050', cast(8 + p_size % 2 as string), '0', cast(p_partkey % 2 as string), lpad(cast(p_partkey * 7 % 60 as string), 2, '0'), '.5') end as acquired_at,
               case when p_partkey % 9 = 0 then null else p_size % 4 * 3 end as tilt, p_partkey % 10 = 0 as derived,
               case when p_partkey % 17 = 0 then null else cast(p_size % 5 as double) end as low_mm, cast(p_size % 5 + 30 - p_partkey % 3 as double) as high_mm
        from {part}""",
    # image instances of series: a position a line
    "instances": """
        select l_orderkey as series, cast(floor(l_orderkey / 7) as bigint) as study, l_quantity as position, l_tax * 100 as thickness, l_discount * 10 as spacing,
               case when l_linenumber % 3 = 0 then null else l_extendedprice / 1000 end as weight, l_linenumber as instance, l_shipdate as taken_at from {lineitem}""",
    # ordered levels with centres
    "levels": "select l_orderkey as study, l_linenumber as ordinal, min(l_quantity) as center, max(l_extendedprice) / 1000 as height from {lineitem} group by 1, 2",
    "destinations": "select n_name as name, r_name as accepts, n_nationkey % 4 <> 0 as enabled, n_nationkey as ordinal from {nation} join {region} on n_regionkey = r_regionkey",
    # destinations with a list of kinds, or none for all; some share a name, some lack an address
    "subscribers": """
        select case when n_nationkey % 11 = 5 then ' ' else concat('d', cast(n_nationkey % 9 as string)) end as name, n_nationkey % 5 <> 4 as enabled, n_nationkey as ordinal,
               case when n_nationkey % 8 = 0 then null when n_nationkey % 3 = 0 then concat(r_name, ',ASIA, ') else concat(r_name, ',', r_name) end as kinds,
               case when n_nationkey % 7 = 3 then '' else concat('h', cast(n_nationkey as string)) end as host, n_nationkey % 6 * 100 as port
        from {nation} join {region} on n_regionkey = r_regionkey""",
    "artifacts": "select c_custkey as artifact, case c_mktsegment when 'BUILDING' then 'ASIA' when 'MACHINERY' then 'EUROPE' else 'AFRICA' end as kind, c_nationkey as origin from {customer}",
    # anatomy states of acquisitions
    "evidence": """
        select cast(floor(l_orderkey / 64) as bigint) as study, l_orderkey as acquisition, concat('a', cast(l_partkey % 9 as string)) as anatomy,
               case when l_linestatus = 'O' and l_returnflag = 'A' then 'anatomy_complete' when l_returnflag = 'R' then 'anatomy_truncated' when l_returnflag = 'A' then 'anatomy_present' else 'anatomy_not_detected' end as state
        from {lineitem}""",
    "acquisitions": """
        select o_orderkey as acquisition, cast(floor(o_orderkey / 64) as bigint) as study, case when o_orderkey % 37 = 0 then 'pending' else 'done' end as status,
               case o_orderpriority when '1-URGENT' then 'native' when '2-HIGH' then 'portal' when '3-MEDIUM' then 'unknown' else null end as phase,
               concat('f', cast(o_custkey % 2 as string)) as frame, o_totalprice / 10000 as low_mm, o_totalprice / 10000 + cast(o_orderkey % 9 as double) as high_mm,
               case when o_orderkey % 11 = 0 then null else o_orderkey % 4 * 3 end as tilt, case when o_orderkey % 13 = 0 then '' when o_orderkey % 17 = 0 then null else concat('f', cast(o_custkey % 2 as string)) end as frame_uid from {orders}""",
    "payloads": "select event_id as case_id, user_id as study, event_type as metric, props as measurement, ts from {events}",
    # density measures with quality facts
    "measures": """
        select l_orderkey as case_id, l_linenumber as ordinal, cast(floor(l_extendedprice) as bigint) % 250 - 20 as hu, cast(floor(l_extendedprice) as bigint) % 90 as spleen_hu,
               case when l_quantity < 5 then null else 90 + l_quantity end as kvp, cast(l_quantity * 2 as int) as voxels, l_linestatus = 'F' as complete,
               case l_returnflag when 'A' then true when 'R' then false else null end as flag, l_discount * 50 as thickness, l_extendedprice / 30 as volume from {lineitem}""",
    # jobs, fifty a module, and what each needs; the last ones of a module need nothing
    "job_needs": """
        select concat('j', cast(p_partkey as string)) as job, p_size,
               case when floor((p_partkey + 1 + p_size % 5) / 50) = floor(p_partkey / 50) then concat('j', cast(p_partkey + 1 + p_size % 5 as string)) end as need from {part}""",
}


def _spread(frame: DataFrame) -> DataFrame:
    """The frame over as many tasks as its rows need. Small files come in one task, which would make all rows of the lattice alone."""
    n = -(-frame.count() // SPREAD_ROWS)
    return frame.repartition(n) if n > 1 else frame


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the driver's tables, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = _spelt(VIEWS[name], "spark")
    names = [t for t in TABLES if "{" + t + "}" in text]
    many = any(k in VIEWS[name] for k in LATTICES)
    return spark.sql(text, **{t: _spread(table(spark, sf_dir, t)) if many else table(spark, sf_dir, t) for t in names})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    ddl = {n: _spelt(t, "duckdb") for n, t in VIEWS.items()}
    for t in TABLES:
        ddl = {n: x.replace("{" + t + "}", t) for n, x in ddl.items()}
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    sql = sql.strip()
    if not used:
        return sql
    with_ = ", ".join(f"{n} as materialized ({ddl[n].strip()})" for n in used)
    recursive = re.match(r"(?i)with\s+recursive\s+", sql)
    if recursive:
        return f"with recursive {with_}, {sql[recursive.end():]}"
    if re.match(r"(?i)with\s+", sql):
        return f"with {with_}, {sql[5:]}"
    return f"with {with_} {sql}"
