"""Mask statistics, morphology and components over the voxel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import components, masks, morphology, shapes
from voxelweave.plans.catalog import Tables, query

c, L = F.col, F.lit
DIMS, SPACING = (64, 51, 32), (0.7, 0.9, 2.5)
FACES = "concat_ws(',', case when min(x) <= 0 then 'x_min' end, case when max(x) >= 63 then 'x_max' end, case when min(y) <= 0 then 'y_min' end, case when max(y) >= 50 then 'y_max' end, case when min(z) <= 0 then 'z_min' end, case when max(z) >= 31 then 'z_max' end)"


@query("select study, mask, count(*) as n_voxels, avg(hu) as mean, stddev_pop(hu) as deviation from lattice group by study, mask")
def mask_stats(t: Tables):
    return masks.mask_stats(t.lattice)


EXPECTED = "(select study, m as mask from (select distinct study from lattice) cross join (select unnest(['A', 'N', 'R', 'X']) as m))"


def _expected(t: Tables):
    return t.lattice.select("study").distinct().select("study", F.explode(F.array(*[L(m) for m in "ANRX"])).alias("mask"))


@query(f"select e.study, e.mask, case when n is null then 'missing' when b <> '' then 'truncated' else 'complete' end as status, coalesce(n, 0) as n_voxels, coalesce(n, 0) * cast(0.002 as double) as cm3, coalesce(b, '') as borders from {EXPECTED} e left join (select study, mask, count(*) as n, {FACES} as b from lattice where x > 0 and not (mask = 'N' and (x > 62 or y > 49 or y < 1 or z in (0, 31))) group by 1, 2) s on e.study = s.study and e.mask = s.mask")
def mask_status(t: Tables):
    v = t.lattice.where("x > 0 and not (mask = 'N' and (x > 62 or y > 49 or y < 1 or z in (0, 31)))")
    return masks.mask_status(v, _expected(t), DIMS, 0.002)


@query(f"select study, coalesce(string_agg(mask, ',' order by mask) filter (n is null), '') as missing, coalesce(string_agg(mask, ',' order by mask) filter (b <> ''), '') as incomplete, bool_and(n is not null and b = '') as all_complete from (select e.study, e.mask, n, b from {EXPECTED} e left join (select study, mask, count(*) as n, {FACES} as b from lattice group by 1, 2) s on e.study = s.study and e.mask = s.mask) group by study")
def mask_status_set(t: Tables):
    return masks.status_set(masks.mask_status(t.lattice, _expected(t), DIMS, 0.002), ["study"])


@query("select study, mask, min(z) as first_z, max(z) as last_z, list_sort(list(distinct z))[cast(floor(count(distinct z) / 2) as int) + 1] as center_z from lattice group by study, mask")
def axial_extent(t: Tables):
    return masks.axial_extent(t.lattice)


@query(f"select e.study, e.mask, case when n is null then 'anatomy_not_detected' when b <> '' then 'anatomy_truncated' else 'anatomy_complete' end as state, coalesce(b, '') as borders from {EXPECTED} e left join (select study, mask, count(*) as n, {FACES} as b from lattice group by 1, 2) s on e.study = s.study and e.mask = s.mask")
def anatomy_states(t: Tables):
    return masks.anatomy_states(t.lattice, _expected(t), DIMS)


@query("select study, mask, min(x) <= 0 as x_low, max(z) >= 31 as z_high from lattice group by study, mask")
def border_contact(t: Tables):
    b = masks.bounds(t.lattice)
    f = masks.touched(b, DIMS)
    return b.select("study", "mask", F.array_contains(f, "x_min").alias("x_low"), F.array_contains(f, "z_max").alias("z_high"))


STATES = f"select e.study, e.mask, case when n is null then 'anatomy_not_detected' when b <> '' then 'anatomy_truncated' else 'anatomy_complete' end as state from {EXPECTED} e left join (select study, mask, count(*) as n, {FACES} as b from lattice where mask <> 'R' or x between 1 and 62 and y between 1 and 49 and z between 1 and 30 group by 1, 2) s on e.study = s.study and e.mask = s.mask"


def _states(t: Tables):
    v = t.lattice.where("mask <> 'R' or x between 1 and 62 and y between 1 and 49 and z between 1 and 30")
    return masks.anatomy_states(v, _expected(t), DIMS)


@query(f"select study, bool_or(mask in ('A', 'N') and state <> 'anatomy_not_detected') as lungs_present, bool_and(state = 'anatomy_complete') filter (mask in ('A', 'N')) as lungs_complete, bool_or(mask in ('R') and state <> 'anatomy_not_detected') as organs_present, bool_and(state = 'anatomy_complete') filter (mask in ('R')) as organs_complete from ({STATES}) group by study")
def inventory(t: Tables):
    return masks.inventory(_states(t), ["study"], "mask", {"lungs": ["A", "N"], "organs": ["R"]})


@query(f"select study, case when chest and abdomen then 'chest_abdomen' when chest then 'chest_only' when abdomen then 'abdomen_only' when part then 'partial' else 'unknown' end as coverage from (select study, bool_and(state = 'anatomy_complete') filter (mask in ('A', 'N')) as chest, bool_and(state = 'anatomy_complete') filter (mask in ('R')) as abdomen, bool_or(mask in ('A', 'N') and state <> 'anatomy_not_detected') as part from ({STATES}) group by study)")
def coverage_class(t: Tables):
    inv = masks.inventory(_states(t), ["study"], "mask", {"lungs": ["A", "N"], "organs": ["R"]})
    return masks.coverage_class(inv, c("lungs_complete"), c("organs_complete"), c("lungs_present")).select("study", "coverage")


@query("select study, z, round(coalesce(sum(case when mask = 'A' then 1 end), 0) * 0.0063 / nullif(sum(case when mask = 'N' then 1 end) * 0.0063, 0), 4) as ratio from lattice group by study, z")
def slice_area_ratio(t: Tables):
    return masks.area_ratio(masks.slice_area(t.lattice, 0.0063), ["study", "z"], "mask", "A", "N")


@query("select study, mask, z, y, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by study, mask, z, y order by x) as i from lattice) group by study, mask, z, y, i")
def mask_runs(t: Tables):
    return masks.runs(t.lattice)


@query("select study, z, y, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by study, z, y order by x) as i from (select distinct study, x, y, z from blobs where mask <> 2)) group by study, z, y, i")
def mask_union(t: Tables):
    return masks.merged_runs(masks.runs(t.blobs.where("mask <> 2")).drop("mask"), ["study"])


@query("select a.study, a.mask, count(*) as n_voxels, count(b.x) as inside, count(b.x) / count(*) as fraction from blobs a left join (select * from blobs where mask = 0) b on a.study = b.study and a.x = b.x and a.y = b.y and a.z = b.z where a.mask <> 0 group by a.study, a.mask")
def mask_overlap(t: Tables):
    support = masks.runs(t.blobs.where("mask = 0")).drop("mask")
    return masks.overlap(masks.runs(t.blobs.where("mask <> 0")), support, ["study"], "mask")


@query("select study, mask, count(*) as n from blobs a where mask = 1 and not exists (select 1 from blobs b where b.mask = 0 and a.study = b.study and a.x = b.x and a.y = b.y and a.z = b.z) group by study, mask")
def mask_minus(t: Tables):
    other = t.blobs.where("mask = 0").withColumn("mask", L(1))
    return masks.minus(t.blobs.where("mask = 1"), other).groupBy("study", "mask").agg(F.count("*").alias("n"))


@query("select distinct study, mask, x, y from lattice where z between 5 and 9")
def projection_any(t: Tables):
    return masks.projection_any(t.lattice, 5, 9)


@query("select study, x, y, cast(floor(z / 5) as int) as slab, avg(hu) as mean, count(*) as n from lattice group by 1, 2, 3, 4")
def slab_project(t: Tables):
    return masks.slab_project(t.lattice, 5, "hu")


@query("select o_orderkey, greatest(0, least(k - 3, n - 7)) as first, least(n - 1, greatest(0, least(k - 3, n - 7)) + 6) as last from (select o_orderkey, cast(o_orderkey % 40 as int) as k, cast(o_orderkey % 40 + o_custkey % 9 + 1 as int) as n from orders)")
def centered_slab(t: Tables):
    k = (c("o_orderkey") % 40).cast("int")
    s = masks.centered_slab(k, (k + c("o_custkey") % 9 + 1).cast("int"), 7)
    return t.orders.select("o_orderkey", s["first"].alias("first"), s["last"].alias("last"))


SLABS = """with s as (select distinct l_orderkey as study, l_quantity as pos from lineitem), b as (select study, min(pos) as p0, max(pos) as p1 from s group by study),
 k as (select study, p0, unnest(generate_series(0, cast(floor((p1 - p0) / 5.0) as int))) as slab from b),
 i as (select k.study, s.pos, k.slab from k join s on s.study = k.study and abs(s.pos - (k.p0 + (k.slab + 0.5) * 5.0)) <= 2.5),
 e as (select k.* from k where not exists (select 1 from i where i.study = k.study and i.slab = k.slab)),
 n as (select study, pos, slab from (select e.study, s.pos, e.slab, row_number() over (partition by e.study, e.slab order by abs(s.pos - (e.p0 + (e.slab + 0.5) * 5.0)), s.pos) as r from e join s on s.study = e.study) where r = 1)
 select * from i union all select * from n"""


@query(SLABS)
def slab_assign(t: Tables):
    s = t.lineitem.select(c("l_orderkey").alias("study"), c("l_quantity").alias("pos")).distinct()
    return masks.slab_assign(s, ["study"], "pos", 5.0)


@query("select a.study, k as level, count(b.x) as n_voxels, round(count(b.x) * cast(0.02 as double), 2) as cm3 from (select study, unnest([0, 1, 2, 3]) as k from (select distinct study from blobs)) a left join blobs b on a.study = b.study and b.z between 8 + a.k * 10 and 17 + a.k * 10 group by a.study, k")
def slab_volume(t: Tables):
    s = t.blobs.select("study").distinct().select("study", F.explode(F.array(*[L(i) for i in range(4)])).alias("level"))
    s = s.withColumn("first", 8 + c("level") * 10).withColumn("last", 17 + c("level") * 10)
    return masks.slab_volumes(t.blobs, s, ["study"], "level", 0.02)


AROUND = "(select a.d as dx, b.d as dy, c.d as dz from (select unnest([-1, 0, 1]) as d) a cross join (select unnest([-1, 0, 1]) as d) b cross join (select unnest([-1, 0, 1]) as d) c where {})"
CROSS6, CUBE26 = AROUND.format("abs(a.d) + abs(b.d) + abs(c.d) = 1"), AROUND.format("abs(a.d) + abs(b.d) + abs(c.d) > 0")


def _full(n: int, around: str, src: str = "blobs") -> str:
    """Voxels with all n neighbours: each voxel tells its neighbours of itself, and those told n times count."""
    return f"select a.study, a.mask, a.x, a.y, a.z from {src} a join (select study, mask, x + dx as x, y + dy as y, z + dz as z from {src} cross join {around} o group by 1, 2, 3, 4, 5 having count(*) = {n}) s on a.study = s.study and a.mask = s.mask and a.x = s.x and a.y = s.y and a.z = s.z"


@query(f"select * from blobs except {_full(26, CUBE26)}")
def surface_points(t: Tables):
    return morphology.surface(t.blobs)


@query(f"with e as materialized ({_full(6, CROSS6)}) {_full(6, CROSS6, 'e')}")
def erode_iter(t: Tables):
    return morphology.erode(t.blobs, 2)


@query("select distinct study, mask, x + a.d as x, y + b.d as y, z + c.d as z from blobs cross join (select unnest([-2, -1, 0, 1, 2]) as d) a cross join (select unnest([-2, -1, 0, 1, 2]) as d) b cross join (select unnest([-2, -1, 0, 1, 2]) as d) c where abs(a.d) + abs(b.d) + abs(c.d) <= 2 and x + a.d between 0 and 55 and y + b.d between 0 and 55 and z + c.d between 0 and 55")
def dilate_iter(t: Tables):
    return morphology.dilate(t.blobs, 2, (56, 56, 56))


@query("select distinct study, mask, x + a.d as x, y + b.d as y, z from blobs cross join (select unnest(generate_series(-4, 4)) as d) a cross join (select unnest(generate_series(-4, 4)) as d) b where (a.d * 0.7) * (a.d * 0.7) + (b.d * 0.9) * (b.d * 0.9) <= 9")
def dilate_ellipse(t: Tables):
    return morphology.dilate_disc(t.blobs, 3.0, (0.7, 0.9))


# the shell is within 3 mm at most 4, 3 and 1 voxels away along the axes
NEAR = f"""with v as materialized (select study, mask, x, y, z, x % 7 * 10 + y as hu from blobs),
 s as materialized (select distinct a.study, a.mask, a.x + o.dx as x, a.y + o.dy as y, a.z + o.dz as z from blobs a cross join {CROSS6} o except select study, mask, x, y, z from blobs),
 o as materialized (select a.d as dx, b.d as dy, c.d as dz, (a.d * 0.7) * (a.d * 0.7) + (b.d * 0.9) * (b.d * 0.9) + (c.d * 2.5) * (c.d * 2.5) as d2 from (select unnest(generate_series(-4, 4)) as d) a cross join (select unnest(generate_series(-3, 3)) as d) b cross join (select unnest([-1, 0, 1]) as d) c where (a.d * 0.7) * (a.d * 0.7) + (b.d * 0.9) * (b.d * 0.9) + (c.d * 2.5) * (c.d * 2.5) <= 9),
 d as materialized (select s.study, s.mask, s.x + dx as x, s.y + dy as y, s.z + dz as z, min(d2) as d2 from s cross join o group by 1, 2, 3, 4, 5),
 j as materialized (select v.*, d2 from v left join d using (study, mask, x, y, z))"""


@query(f"{NEAR} select study, mask, step, count(*) as n_voxels, avg(hu) as mean, stddev_pop(hu) as deviation from j cross join (select cast(unnest([0, 1, 2, 3]) as double) as step) where d2 is null or d2 >= step * step group by study, mask, step")
def erosion_profile(t: Tables):
    v = t.blobs.withColumn("hu", c("x") % 7 * 10 + c("y"))
    return morphology.erosion_profile(v, "hu", [0, 1, 2, 3], SPACING)


@query(f"{NEAR} select study, mask, x, y, z from j where d2 is null or d2 >= 2.25")
def erode_mm(t: Tables):
    return morphology.erode_mm(t.blobs, 1.5, SPACING)


def _flood(group: str, planar: bool) -> str:
    near = "b.z = a.z" if planar else "abs(b.z - a.z) <= 1"
    return f"""with recursive v as materialized (select *, row_number() over (order by study, mask, z, y, x) as i from (select distinct study, mask, x, y, z from lattice)),
 e as materialized (select a.i as a, b.i as b from v a join v b on a.study = b.study and a.mask = b.mask and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 and {near} and a.i <> b.i),
 r(i, root) as (select i, i from v union select e.b, r.root from r join e on e.a = r.i where r.root < e.b),
 m as (select i, min(root) as root from r group by i)
 select study, mask, {group} count(*) as n_voxels from v join m using (i) group by study, mask, {group} root"""


@query(_flood("", False))
def components_3d(t: Tables):
    runs = components.label_runs(t.lattice)
    return components.describe(runs).select("study", "mask", "n_voxels")


@query(_flood("z,", True))
def components_2d(t: Tables):
    runs = components.label_runs(t.lattice, ["study", "mask"], planar=True)
    return runs.groupBy("study", "mask", "z", "component").agg(F.sum(c("x1") - c("x0") + 1).alias("n_voxels")).drop("component")


FLOOD = _flood("", False).replace("\n select study, mask,", ",\n f as (select study, mask,") + ")"


@query(FLOOD + " select study, mask, max(n_voxels) as n_voxels from f group by study, mask")
def largest_component(t: Tables):
    runs = components.label_runs(t.lattice)
    return components.largest(components.describe(runs)).select("study", "mask", "n_voxels")


@query(FLOOD + " select study, mask, n_voxels, row_number() over (partition by study, mask order by n_voxels desc) as rank from f")
def component_rank(t: Tables):
    runs = components.label_runs(t.lattice)
    return components.ranked(components.describe(runs)).select("study", "mask", "n_voxels", "rank")


@query(None)
def feret_axial(t: Tables):
    runs = components.label_runs(t.blobs)
    return components.feret_axial(runs, (0.7, 0.9)).drop("component")


@query(None)
def pca_extent(t: Tables):
    return shapes.pca_extent(t.blobs, ["study", "mask"], SPACING)


@query("select study, mask, degrees(0.5 * atan2(cast(2 * (n * xy - sx * sy) as double), cast((n * xx - sx * sx) - (n * yy - sy * sy) as double))) as angle from (select study, mask, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy from blobs where mask > 0 group by study, mask)")
def inplane_rotation(t: Tables):
    return shapes.inplane_rotation(t.blobs.where("mask > 0"))


@query("select study, mask, case when sx >= sy and sx >= sz then 0 when sy >= sz then 1 else 2 end as si_axis, case when sx >= sy and sx >= sz then case when sy <= sz then 1 else 2 end when sy >= sz then case when sx <= sz then 0 else 2 end else case when sx <= sy then 0 else 1 end end as ap_axis from (select study, mask, (max(x) - min(x) + 1) * 0.7 as sx, (max(y) - min(y) + 1) * 0.9 as sy, (max(z) - min(z) + 1) * 2.5 as sz from blobs group by study, mask)")
def infer_axes(t: Tables):
    return shapes.infer_axes(masks.bounds(t.blobs), SPACING).select("study", "mask", "si_axis", "ap_axis")


@query("select a.study, a.x, a.y, a.z, round(min(sqrt(((a.x - b.x) * 0.7) * ((a.x - b.x) * 0.7) + ((a.y - b.y) * 0.9) * ((a.y - b.y) * 0.9) + ((a.z - b.z) * 2.5) * ((a.z - b.z) * 2.5))), 6) as distance from blobs a join blobs b on a.study = b.study and b.mask = 0 where a.mask = 1 group by a.study, a.x, a.y, a.z")
def nearest_surface(t: Tables):
    a, b = (t.blobs.where(f"mask = {m}").drop("mask") for m in (1, 0))
    return morphology.nearest(a, b, SPACING, ["study"], 256.0).withColumn("distance", F.round("distance", 6))


def _side(mask: int) -> str:
    return f"(select a.study, quantile_cont(d, 0.1) as d from (select a.study, a.x, a.y, a.z, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) as d from blobs a join blobs b on a.study = b.study and b.mask = {mask} where a.mask = 2 group by 1, 2, 3, 4) a group by 1)"


@query(f"select l.study, 2 as mask, round(l.d, 6) as d_left, round(r.d, 6) as d_right, case when abs(l.d - r.d) < 0.5 then 'indeterminate' when l.d < r.d then 'left' else 'right' end as side from {_side(0)} l join {_side(1)} r on l.study = r.study")
def lateralize(t: Tables):
    side = lambda m: t.blobs.where(f"mask = {m}")
    got = morphology.lateralize(side(2), side(0), side(1), (1.0, 1.0, 1.0), ["study"], "mask", 256.0, 0.5)
    return got.select("study", "mask", F.round("d_left", 6).alias("d_left"), F.round("d_right", 6).alias("d_right"), "side")


@query(f"""with s as (select e.study, e.mask, case when e.mask = 'X' and e.study % 2 = 0 then 'missing' when e.study % 4 = 3 and e.mask = 'A' then 'invalid' when n is null then 'empty' when b <> '' then 'truncated' else 'complete' end as st from {EXPECTED} e left join (select study, mask, count(*) as n, {FACES} as b from lattice where x > 0 and not (mask = 'N' and (x > 62 or y > 49 or y < 1 or z in (0, 31))) group by 1, 2) s on e.study = s.study and e.mask = s.mask)
 select study, coalesce(string_agg(mask, ',' order by mask) filter (st = 'missing'), '') as missing, coalesce(string_agg(mask, ',' order by mask) filter (st = 'invalid'), '') as invalid, coalesce(string_agg(mask, ',' order by mask) filter (st = 'empty'), '') as empty, coalesce(string_agg(mask, ',' order by mask) filter (st = 'truncated'), '') as incomplete, bool_and(st = 'complete') as all_complete from s group by study""")
def mask_file_set(t: Tables):
    """Some masks have no file, some a file of another shape, some an empty one."""
    v, e = t.lattice.where("x > 0 and not (mask = 'N' and (x > 62 or y > 49 or y < 1 or z in (0, 31)))"), _expected(t)
    files = e.where("not (mask = 'X' and study % 2 = 0)").withColumn("valid", ~((c("study") % 4 == 3) & (c("mask") == "A")))
    return masks.file_status_set(masks.file_status(masks.mask_status(v, e, DIMS, 0.002), files), ["study"])
