"""Composite metrics over the voxel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import body_fat as body_fat_levels
from voxelweave.operators import grids, masks, metrics, morphology, renal, vertebrae
from voxelweave.plans.catalog import Tables, query
from voxelweave.plans.mask_queries import NEAR

c, L = F.col, F.lit
SPACING = (0.7, 0.9, 2.5)
CENTER = "(select study, list_sort(list(distinct z))[cast(floor(count(distinct z) / 2) as int) + 1] as z from lattice where mask = 'R' group by study)"


def _blobs(t: Tables):
    """Balls as masks with a density that follows place."""
    return t.blobs.withColumns({"mask": F.concat(L("m"), c("mask").cast("string")), "hu": (c("x") * 7 + c("y") * 5 + c("z") * 3) % 200})


def _expected(t: Tables):
    return t.lattice.select("study").distinct().select("study", F.explode(F.array(*[L(m) for m in "ANRX"])).alias("mask"))


PATIENTS = "(select study, case study % 3 when 0 then true when 1 then false end as contrast, cast(0.75 as double) + study % 8 * cast(0.25 as double) as height_m, cast(15 + study % 50 * 9 as double) as weight_kg, cast(112 + study % 4 * 4 as double) as kvp from (select distinct study from lattice))"


def _patients(v):
    s = c("study")
    rows = v.select("study").distinct()
    return rows.select(s, F.when(s % 3 == 0, True).when(s % 3 == 1, False).alias("contrast"), (0.75 + s % 8 * 0.25).alias("height_m"), (15 + s % 50 * 9).cast("double").alias("weight_kg"), (112 + s % 4 * 4).cast("double").alias("kvp"))


@query(f"""select s.study, n as raw_pixels, n as n_pixels, n - n as excluded, n * cast(0.0063 as double) as cm2, case when not coalesce(contrast, false) then mean end as mean, case when not coalesce(contrast, false) then sd end as deviation,
  case when height_m between 0.8 and 2.5 then n * cast(0.0063 as double) / (height_m * height_m) end as smi, case when n is not null and height_m between 0.8 and 2.5 and weight_kg between 20 and 400 then weight_kg / (height_m * height_m) end as bmi, case when n is null then 'not_present' else 'done' end as status
 from {PATIENTS} s left join (select l.study, count(*) as n, round(avg(hu), 2) as mean, round(stddev_pop(hu), 2) as sd from lattice l join {CENTER} k on l.study = k.study and l.z = k.z where mask = 'A' group by 1) m on m.study = s.study""")
def m_l3_muscle(t: Tables):
    """Without arm bones; those are in appendicular_filter and its test."""
    return metrics.l3_muscle({"voxels": t.lattice, "patients": _patients(t.lattice)}, {"level": "R", "muscle": "A", "pixel_cm2": 0.0063})


@query(f"""with v as (select * from lattice where mask <> 'N' or study % 5 <> 0), m as (select l.study, count(*) filter (mask = 'A') * cast(0.0063 as double) as a, count(*) filter (mask = 'N') * cast(0.0063 as double) as b from v l join {CENTER} k on l.study = k.study and l.z = k.z group by 1)
 select s.study, case when ok then a end as vat_cm2, case when ok then b end as sat_cm2, case when ok then 0 end as vat_excluded, case when ok then 0 end as sat_excluded, case when ok then round(a / nullif(b, 0), 4) end as ratio, case when ok then 'done' else 'not_present' end as status from (select study, count(distinct mask) = 3 as ok from v group by 1) s left join m on m.study = s.study""")
def m_vat_sat(t: Tables):
    """Every fifth study lacks one of the masks."""
    return metrics.vat_sat({"voxels": t.lattice.where("mask <> 'N' or study % 5 <> 0")}, {"level": "R", "visceral": "A", "subcutaneous": "N", "pixel_cm2": 0.0063})


INNER = "x > 0 and not (mask <> 'A' and (x > 62 or y > 49 or y < 1 or z in (0, 31)))"
ORGANS = f"""select e.study, e.mask, case when n is null then 'missing' when b then 'truncated' else 'complete' end as status, case when not coalesce(contrast, false) then round(mean, 2) end as hu, case when n is not null and not b then n * cast(0.2 as double) end as cm3,
  case when not coalesce(contrast, false) then round(greatest(0.0, cast(-0.58 as double) * mean + cast(38.2 as double)), 2) end as pdff, case when e.mask = 'N' and not b and n * cast(0.2 as double) < 100 then 'small_kidney' end as alert, kvp
 from (select study, contrast, kvp, unnest(['A', 'N', 'R', 'X']) as mask from {PATIENTS}) e left join (select study, mask, count(*) as n, avg(hu) as mean, min(x) <= 0 or max(x) >= 63 or min(y) <= 0 or max(y) >= 50 or min(z) <= 0 or max(z) >= 31 as b from lattice where {INNER} group by 1, 2) s on s.study = e.study and s.mask = e.mask"""


def _organs(t: Tables):
    return metrics.organs({"voxels": t.lattice.where(INNER), "expected": _expected(t), "patients": _patients(t.lattice)}, {"dims": (64, 51, 32), "voxel_cm3": 0.2, "alerts": {"N": "kidney"}})


@query(f"select * exclude (kvp) from ({ORGANS})")
def m_organs(t: Tables):
    """A reaches the border, N and R don't, X is missing; every third study has contrast."""
    return _organs(t)


@query(f"""with o as ({ORGANS}), s as (select study, any_value(kvp) as kvp, max(hu) filter (mask = 'R') as l, max(hu) filter (mask = 'N') as s, coalesce(bool_or(mask = 'R' and cm3 >= 90), false) as lok, coalesce(bool_or(mask = 'N' and cm3 >= 90), false) as sok, bool_or(cm3 is not null) as pub from o group by study)
 select study, status as steatosis, case when status = 'estimated' then cast(floor(greatest(0.0, cast(-0.58 as double) * l + cast(38.2 as double)) + 0.5) as int) end as percent, pub or (lok and l is not null) as publishable
 from (select *, case when l is null then null when not lok then 'liver_sample_insufficient' when kvp not between 115 and 125 then 'kvp_out_of_range' when l >= 50 then 'normal' when not sok or s = 0 then 'spleen_sample_insufficient' when l / s > 1 then 'normal' else 'estimated' end as status from s)""")
def m_liver_fat(t: Tables):
    return metrics.liver_fat(_organs(t), _patients(t.lattice), "R", "N", 90.0)


@query("select s.study, case when n is null then 'missing' when b then 'truncated' else 'complete' end as status, case when not b then round(n * cast(0.1 as double), 1) end as cm3 from (select distinct study from blobs) s left join (select study, count(*) as n, max(x) >= 55 or max(y) >= 55 or max(z) >= 50 or min(x) <= 0 or min(y) <= 0 or min(z) <= 0 as b from blobs where mask = 0 and study % 6 <> 4 group by study) k on k.study = s.study")
def m_brain(t: Tables):
    """In a grid that some of the balls reach out of; every sixth study has none."""
    v = _blobs(t).where("mask <> 'm0' or study % 6 <> 4")
    return metrics.brain({"voxels": v, "expected": v.select("study", L("m0").alias("mask")).distinct()}, {"mask": "m0", "dims": (56, 56, 51), "voxel_cm3": 0.1})


@query("""with s as materialized (select distinct study, x + a.d as x, y + b.d as y, z + c.d as z from blobs cross join (select unnest([-1, 0, 1]) as d) a cross join (select unnest([-1, 0, 1]) as d) b cross join (select unnest([-1, 0, 1]) as d) c where mask <> 2 and abs(a.d) + abs(b.d) + abs(c.d) <= 1)
 select study, n_voxels, outside, round(outside / n_voxels, 6) as fraction from (select b.study, count(*) as n_voxels, count(*) filter (s.x is null) as outside from blobs b left join s on s.study = b.study and s.x = b.x and s.y = b.y and s.z = b.z where mask = 2 group by 1)""")
def m_head_support(t: Tables):
    return metrics.head_support({"voxels": _blobs(t)}, {"support": ["m0", "m1"], "bleed": "m2"})


@query(None)
def m_lung_nodules(t: Tables):
    return metrics.lung_nodules({"voxels": _blobs(t)}, {"mask": "m2", "support": ["m0", "m1"]})


@query(None)
def m_liver_lesions(t: Tables):
    return metrics.liver_lesions({"voxels": _blobs(t)}, {"mask": "m2", "support": ["m0", "m1"], "spacing": SPACING})


@query(None)
def m_l1_volumetric(t: Tables):
    return metrics.l1_volumetric({"voxels": _blobs(t)}, {"mask": "m1", "mm": 2.0, "spacing": SPACING})


@query(None)
def m_kidney_stone(t: Tables):
    return metrics.kidney_stone({"voxels": _blobs(t)}, {"kidneys": ["m0", "m1"], "spacing": SPACING})


@query(None)
def m_renal_anatomy(t: Tables):
    return metrics.renal_anatomy({"voxels": _blobs(t)}, {"kidneys": ["m0", "m1"], "l3": "m2", "l4": "m1", "least_voxels": 50})


@query(None)
def renal_roles(t: Tables):
    v = _blobs(t)
    return metrics.renal_roles({"voxels": v, "patients": _patients(v)}, {"kidneys": ["m0", "m1"], "l3": "m2", "l4": "m1", "least_voxels": 50})


@query(None)
def m_effusion(t: Tables):
    return metrics.effusion({"voxels": _blobs(t)}, {"mask": "m2", "left": "m0", "right": "m1", "spacing": SPACING, "voxel_ml": 0.1})


@query("select study, concat('m', cast(mask as string)) as mask, count(*) as n_voxels, round_even(count(*) * cast(0.0016 as double), 0) as cm3 from blobs group by study, mask")
def m_liver_segments(t: Tables):
    return metrics.liver_segments({"voxels": _blobs(t)}, {"voxel_cm3": 0.0016})


@query(None)
def m_fracture(t: Tables):
    return metrics.fracture({"voxels": t.spine}, {"levels": [f"v{k}" for k in range(5)], "spacing": (1.0, 1.0, 1.0), "n_slices": 79})


@query(None)
def isolate_body(t: Tables):
    return vertebrae.isolate_body(t.spine, (1.0, 1.0, 1.0)).groupBy("study", "mask").agg(F.count("*").alias("n_voxels"))


@query(None)
def parasagittal_heights(t: Tables):
    return vertebrae.parasagittal_heights(t.spine.select("study", "mask", "x", "y", "z"), (1.0, 1.0, 1.0))


@query(None)
def height_screen(t: Tables):
    return vertebrae.height_screen(_blobs(t), SPACING)


@query(f"""{NEAR}, f as (select study, mask, min(z) > 0 and max(z) < 50 as complete from v group by 1, 2), p as (select study, mask, step, count(*) as n, round(avg(hu), 2) as mean, round(stddev_pop(hu), 2) as sd from j cross join (select cast(unnest([0, 1, 2, 3]) as double) as step) where d2 is null or d2 >= step * step group by 1, 2, 3)
 select f.study, f.mask, complete, complete as included, s.step, coalesce(n, 0) as n_voxels, mean, sd as deviation from f join (select cast(unnest([0, 1, 2, 3]) as double) as step) s on complete or s.step = 0 left join p on complete and p.study = f.study and p.mask = f.mask and p.step = s.step""")
def vertebra_measure(t: Tables):
    v = t.blobs.withColumn("hu", c("x") % 7 * 10 + c("y"))
    return vertebrae.vertebra_measure(v, SPACING, 51, (0, 1, 2, 3))


@query(None)
def l1_sagittal_roi(t: Tables):
    return vertebrae.l1_sagittal_roi(t.spine, (1.0, 1.0, 1.0), erosion_mm=2.0)


def _l1(t: Tables):
    v = t.spine
    p = _patients(v).select("study", F.when(c("study") % 5 == 4, "MR").otherwise("CT").alias("modality"), "kvp", "contrast", (c("study") % 8).cast("double").alias("thickness_mm"))
    return {"voxels": v, "patients": p}, {"mask": "v3", "spacing": (1.0, 1.0, 1.0), "n_slices": 79, "erosion_mm": 2.0}


@query(None)
def m_l1_hu(t: Tables):
    return metrics.l1_hu(*_l1(t)).withColumn("profile", F.to_json("profile"))


@query(None)
def m_bmd_extract(t: Tables):
    """Every supplier is a series; those of studies without the mask get a row too."""
    s = t.supplier.select((c("s_suppkey") % 7).cast("string").alias("case_id"), c("s_suppkey").cast("string").alias("series_id"), (c("s_suppkey") % 30).alias("study"))
    return metrics.bmd_extract(s, *_l1(t))


@query("""with l as (select study, ordinal, center, lag(center) over w as b, lead(center) over w as a from (select distinct study, k as ordinal, 10.0 + k * 9 + study % 3 as center from (select distinct study from blobs) cross join (select unnest([0, 1, 2, 3]) as k)) window w as (partition by study order by ordinal)),
 s as (select study, ordinal, ceil(coalesce((center + b) / 2, center - (a - center) / 2)) as f, ceil(coalesce((center + a) / 2, center + (center - b) / 2)) - 1 as t from l),
 v as (select s.study, s.ordinal, count(x) as n_voxels, round(count(x) * cast(0.02 as double), 2) as cm3 from s left join blobs on blobs.study = s.study and z between f and t and mask <> 2 group by 1, 2)
 select *, round(sum(cm3) over (partition by study), 2) as total_cm3 from v""")
def m_body_fat(t: Tables):
    lv = t.blobs.select("study").distinct().select("study", F.explode(F.sequence(L(0), L(3))).alias("ordinal")).withColumn("center", 10.0 + c("ordinal") * 9 + c("study") % 3)
    got = metrics.body_fat({"voxels": _blobs(t), "levels": lv}, {"masks": ["m0", "m1"], "voxel_cm3": 0.02})
    return got.withColumn("total_cm3", F.round("total_cm3", 2))


@query(None)
def appendicular_filter(t: Tables):
    """m1 as tissue and m0 as arm bones, on all slices."""
    v = _blobs(t)
    kept = metrics.appendicular_filter(v.where("mask = 'm1'").select("study", "x", "y", "z"), v.where("mask = 'm0'"), 2.0, SPACING[:2])
    return kept.groupBy("study", "z").agg(F.count("*").alias("n"), F.max("removed_fraction").alias("removed_fraction"))


def _fat(t: Tables):
    """Spines with fat masks around their lower part; every third study lacks a level, every second volume ends at the uppermost one."""
    v = t.spine.where("not (mask = 'v2' and study % 3 = 0)").select("study", "mask", "x", "y", "z")
    v = v.unionByName(t.lattice.where("mask <> 'R'").select("study", "mask", "x", "y", (c("z") * 2).cast("int").alias("z")))
    s = c("study")
    return {"voxels": v, "volumes": v.select("study").distinct().select("study", L(64).alias("nx"), L(64).alias("ny"), (79 + s % 2 * 11).cast("int").alias("nz"), (0.5 + s % 3 * 0.25).alias("sx"), L(1.0).alias("sy"), L(2.5).alias("sz"))}


FAT = {"subcutaneous": "A", "torso": "N", "levels": [f"v{k}" for k in range(5)], "level": "v0"}
UNIT = "((cast(0.5 as double) + study % 3 * cast(0.25 as double)) * 2.5 / 1000.0)"
FATS = """w as (select study, z * 2 as z, count(*) filter (mask = 'A') as a, count(*) filter (mask = 'N') as n from lattice where mask <> 'R' group by 1, 2),
 e as (select study, mask as level, cast(substr(mask, 2) as int) as ordinal, min(z) as first, max(z) as last, 79 + study % 2 * 11 as nz, min(z) > 0 and max(z) < 78 + study % 2 * 11 as complete from spine where not (mask = 'v2' and study % 3 = 0) group by 1, 2)"""
SLABS = """s as (select *, greatest(0, case when not whole then first else cast(floor(case when b is not null then (b + c) / 2 else c - (a - c) / 2 end) as int) end) as s0, case when not whole then last else least(nz - 1, cast(case when a is not null then ceil((c + a) / 2) - 1 else ceil(c + (c - b) / 2) end as int)) end as s1
  from (select *, lag(c) over (partition by study order by ordinal) as b, lead(c) over (partition by study order by ordinal) as a, count(*) over (partition by study) = 5 as whole from (select *, (first + last) / 2.0 as c from e)))"""
LEVELS = f"""with {FATS}, {SLABS}, l as (select s.study, level, ordinal, s0, s1, whole, cast(coalesce(sum(a_), 0) as bigint) as va, cast(coalesce(sum(n_), 0) as bigint) as vn from (select s.*, w.a as a_, w.n as n_ from s left join w on w.study = s.study and w.z between s.s0 and s.s1) s group by all)
 select study, level, ordinal, s0 as start, s1 as end_, va as subcutaneous_voxels, vn as torso_voxels, round(va * {UNIT}, 3) as subcutaneous_cm3, round(vn * {UNIT}, 3) as torso_cm3, round(round(vn * {UNIT}, 3) / nullif(round(va * {UNIT}, 3), 0), 4) as ratio, case when whole then 'centroid_midpoint' else 'mask_extent_fallback' end as strategy, whole as coverage_complete from l"""


@query(LEVELS)
def slab_volume_levels(t: Tables):
    return body_fat_levels.fat_distribution(_fat(t), FAT)[0].withColumnRenamed("end", "end_")


@query(f"""select study, strategy, coverage_complete, start, end_, n_slices, a as subcutaneous_cm3, n as torso_cm3, round(n / nullif(a, 0), 4) as ratio, missing_levels, not coverage_complete as needs_review
 from (select study, any_value(strategy) as strategy, bool_and(coverage_complete) as coverage_complete, min(start) as start, max(end_) as end_, cast(sum(end_ - start + 1) as bigint) as n_slices, round(sum(subcutaneous_cm3), 3) as a, round(sum(torso_cm3), 3) as n, array_to_string(list_filter(['v0', 'v1', 'v2', 'v3', 'v4'], lambda x: not list_contains(list(level), x)), ',') as missing_levels from ({LEVELS}) group by study)""")
def m_fat_distribution(t: Tables):
    return body_fat_levels.fat_distribution(_fat(t), FAT)[1].withColumnRenamed("end", "end_")


@query(f"""with {FATS}, l as (select e.study, level, ordinal, first, last, complete, cast(coalesce(sum(w.a), 0) as bigint) as va, cast(coalesce(sum(w.n), 0) as bigint) as vn from e left join w on w.study = e.study and w.z between first and last group by all)
 select study, level, ordinal, first as start, last as end_, va as subcutaneous_voxels, vn as torso_voxels, round(va * {UNIT}, 3) as subcutaneous_cm3, round(vn * {UNIT}, 3) as torso_cm3, round(round(vn * {UNIT}, 3) / nullif(round(va * {UNIT}, 3), 0), 4) as ratio, complete from l""")
def m_level_volumes(t: Tables):
    return body_fat_levels.level_volumes(_fat(t), FAT).withColumnRenamed("end", "end_")


@query(f"""with {FATS}, k as (select study, ordinal, first, last, level, false as inc from e where complete union all select study, ordinal, first, last, level, true from e), b as (select study, inc, min(ordinal) as o0, count(*) as n from (select *, ordinal - row_number() over (partition by study, inc order by ordinal) as i from k) group by study, inc, i),
 c as (select * from (select *, row_number() over (partition by study order by inc, n desc, o0) as r from b) where r = 1), p as (select c.study, inc, n, min(first) as s0, max(last) as s1, min_by(level, ordinal) as top, max_by(level, ordinal) as bottom from c join e on e.study = c.study and ordinal >= o0 and ordinal < o0 + n group by all),
 l as (select p.*, cast(coalesce(sum(w.a), 0) as bigint) as va, cast(coalesce(sum(w.n), 0) as bigint) as vn from p left join w on w.study = p.study and w.z between s0 and s1 group by all), d as (select study, coalesce(string_agg(level, ',' order by ordinal) filter (complete), '') as levels_complete, string_agg(level, ',' order by ordinal) as levels_measurable from e group by study)
 select l.study, s0 as start, s1 as end_, va as subcutaneous_voxels, vn as torso_voxels, round(va * {UNIT.replace('study', 'l.study')}, 3) as subcutaneous_cm3, round(vn * {UNIT.replace('study', 'l.study')}, 3) as torso_cm3, round(round(vn * {UNIT.replace('study', 'l.study')}, 3) / nullif(round(va * {UNIT.replace('study', 'l.study')}, 3), 0), 4) as ratio, n as n_levels, inc as used_incomplete, levels_complete, levels_measurable,
  case when n = 5 and not inc then 'complete' else 'partial' end as status, top || '-' || bottom as measured_region, s1 - s0 + 1 as n_slices from l join d on d.study = l.study""")
def m_body_fat_jobs(t: Tables):
    return body_fat_levels.abdominal_volumes(_fat(t), FAT).withColumnRenamed("end", "end_")


@query(f"""with {FATS} select e.study, cast(round_even((first + last) / 2.0, 0) as int) as z, last - first + 1 as level_slices, coalesce(w.a, 0) as subcutaneous_pixels, coalesce(w.n, 0) as torso_pixels, round(coalesce(w.a, 0) * {UNIT.replace('study', 'e.study')} * 1000 / 2.5 / 100, 3) as subcutaneous_cm2, round(coalesce(w.n, 0) * {UNIT.replace('study', 'e.study')} * 1000 / 2.5 / 100, 3) as torso_cm2,
  round(round(coalesce(w.n, 0) * {UNIT.replace('study', 'e.study')} * 1000 / 2.5 / 100, 3) / nullif(round(coalesce(w.a, 0) * {UNIT.replace('study', 'e.study')} * 1000 / 2.5 / 100, 3), 0), 4) as ratio from e left join w on w.study = e.study and w.z = cast(round_even((first + last) / 2.0, 0) as int) where level = 'v0'""")
def m_fat_slice(t: Tables):
    return body_fat_levels.slice_areas(_fat(t), FAT)


def _tilted(v):
    """Each study's grid and an affine that turns it around the first axis, by up to thirty degrees."""
    s, a = c("study"), F.radians(c("study") % 4 * 10)
    sx, sy, sz = 0.5 + s % 3 * 0.25, L(0.9), 1.0 + s % 2 * 0.5
    zero = L(0.0)
    affine = F.array(sx, zero, zero, L(-20.0), zero, sy * F.cos(a), -sz * F.sin(a), L(5.0), zero, sy * F.sin(a), sz * F.cos(a), L(-300.0), zero, zero, zero, L(1.0))
    return v.select("study").distinct().select("study", L(80).alias("nx"), L(80).alias("ny"), L(80).alias("nz"), sx.alias("sx"), sy.alias("sy"), sz.alias("sz"), affine.alias("affine"))


RENAL = {"kidneys": ["m0", "m1"], "l3": "m2", "l4": "m1", "least_cm3": 0.05}


def _renal(t: Tables):
    v = _blobs(t)
    return {"voxels": v, "volumes": _tilted(v), "patients": _patients(v).withColumn("age", F.when(c("study") % 4 != 3, c("study") % 40))}


@query(None)
def renal_components(t: Tables):
    return renal.renal_components(_renal(t), RENAL)


@query(None)
def renal_part_roles(t: Tables):
    tables = _renal(t)
    parts = renal.renal_components(tables, RENAL)
    return renal.renal_roles(parts, renal.kidney_audit(parts, tables["voxels"], RENAL))


@query(None)
def m_kidneys(t: Tables):
    return renal.kidneys(_renal(t), RENAL)


@query(None)
def l1_axial_roi(t: Tables):
    """On each study's own grid."""
    return vertebrae.l1_axial_roi(grids.on_grid(t.spine, _tilted(t.spine)), None, ["study", "mask", *grids.GRID], erosion_mm=1.5).drop(*grids.GRID)


@query(None)
def sagittal_roi_by_edges(t: Tables):
    """The front told from each plane's own profile."""
    return vertebrae.l1_sagittal_roi(t.spine, (1.0, 1.0, 1.0), front_low=None, erosion_mm=2.0)


# masks of each study on its own grid
OWN_GRID = "(select study, 60 + study % 3 * 2 as nx, 51 + study % 2 as ny, cast(0.5 as double) + study % 3 * cast(0.25 as double) as sx, cast(1.25 as double) as sy, cast(2.5 as double) as sz from (select distinct study from lattice))"


def _own_grid(t: Tables):
    s = c("study")
    return t.lattice.select("study").distinct().select("study", (60 + s % 3 * 2).cast("int").alias("nx"), (51 + s % 2).cast("int").alias("ny"), L(33).alias("nz"), (0.5 + s % 3 * 0.25).alias("sx"), L(1.25).alias("sy"), L(2.5).alias("sz"))


@query(f"""select e.study, e.mask, case when n is null then 'missing' when b then 'truncated' else 'complete' end as status, coalesce(n, 0) as n_voxels, coalesce(n, 0) * (sx * sy * sz / 1000.0) as cm3 from (select g.*, unnest(['A', 'N', 'R', 'X']) as mask from {OWN_GRID} g) e
 left join (select l.study, mask, count(*) as n, min(x) <= 0 or max(x) >= any_value(nx) - 1 or min(y) <= 0 or max(y) >= any_value(ny) - 1 or min(z) <= 0 or max(z) >= 32 as b from lattice l join {OWN_GRID} g on g.study = l.study where x > 0 and x < 61 and z > 0 group by 1, 2) s on s.study = e.study and s.mask = e.mask""")
def mask_status_grids(t: Tables):
    g = _own_grid(t)
    v = t.lattice.where("x > 0 and x < 61 and z > 0")
    cm3 = c("sx") * c("sy") * c("sz") / 1000.0
    return masks.mask_status(grids.on_grid(v, g), grids.on_grid(_expected(t), g), (c("nx"), c("ny"), c("nz")), cm3, ["study", "mask", *grids.GRID]).drop("borders", *grids.GRID)


@query(f"""with v as materialized (select distinct study, mask, x, y, z from blobs), g as (select study, cast(0.5 as double) + study % 3 * cast(0.25 as double) as sx, cast(0.9 as double) as sy, cast(1.0 as double) + study % 2 * cast(0.5 as double) as sz from (select distinct study from v)),
 o as (select unnest(generate_series(-3, 3)) as dx), n as (select g.study, a.dx, b.dx as dy, d.dx as dz from g, o a, o b, o d where (a.dx * sx) ** 2 + (b.dx * sy) ** 2 + (d.dx * sz) ** 2 < 1.5 * 1.5 and not (a.dx = 0 and b.dx = 0 and d.dx = 0)), k as (select study, count(*) as k from n group by study)
 select v.study, v.mask, v.x, v.y, v.z from v join n on n.study = v.study join v w on w.study = v.study and w.mask = v.mask and w.x = v.x + n.dx and w.y = v.y + n.dy and w.z = v.z + n.dz join k on k.study = v.study group by all having count(*) = any_value(k.k)""")
def erode_mm_grids(t: Tables):
    """Erosion by a distance of which every grid makes another number of steps."""
    v = t.blobs.select("study", "mask", "x", "y", "z")
    return morphology.erode_mm(grids.on_grid(v, _tilted(v)), 1.5, None, ["study", "mask", *grids.GRID]).drop(*grids.GRID)


@query(None)
def m_effusions(t: Tables):
    """m2 as the pleural mask, m1 as both the pericardial one and the right lung, each study on its own grid."""
    v = _blobs(t)
    return metrics.effusions({"voxels": v, "volumes": _tilted(v)}, {"pleural": "m2", "pericardial": "m1", "left": "m0", "right": "m1", "least_ml": 0.3})


@query("""with g as (select study, cast(0.5 as double) + study % 3 * cast(0.25 as double) as sx, cast(1.0 as double) + study % 2 * cast(0.5 as double) as sz from (select distinct study from blobs)), k as (select study, mask, count(*) as n, concat_ws(',', case when min(x) <= 0 then 'x_min' end, case when max(x) >= 55 then 'x_max' end, case when min(y) <= 0 then 'y_min' end, case when max(y) >= 55 then 'y_max' end, case when min(z) <= 0 then 'z_min' end, case when max(z) >= 51 then 'z_max' end) as b from blobs where not (mask = 1 and study % 5 = 2) group by 1, 2),
 s as (select g.study, m.mask, sx, sz, n, b, case when n is null then 'missing' when b <> '' then 'truncated' else 'complete' end as status from g cross join (select unnest([0, 1, 2]) as mask) m left join k on k.study = g.study and k.mask = m.mask)
 select study, concat('m', cast(mask as varchar)) as mask, status, case when n is not null then round(n * (sx * cast(0.9 as double) * sz / 1000.0), 3) end as cm3, coalesce(b, '') as borders, bool_or(status = 'complete' and mask = 0) over (partition by study) as complete, count(*) filter (status = 'complete' and mask <> 0) over (partition by study) as usable from s""")
def m_head_complete(t: Tables):
    v = _blobs(t)
    grid = _tilted(v).withColumns({"nx": L(56), "ny": L(56), "nz": L(52)})
    return metrics.head_complete({"voxels": v.where("not (mask = 'm1' and study % 5 = 2)"), "volumes": grid}, {"brain": "m0", "structures": ["m1", "m2"]})


@query(f"select l.study, mask, count(*) as n_voxels, round(count(*) * any_value(sx * sy * sz) / 1000.0, 3) as sample_cm3, count(distinct z) as sample_slices, round((max(z) - min(z) + 1) * any_value(sz), 3) as sample_mm from lattice l join {OWN_GRID} g on g.study = l.study group by 1, 2")
def organ_samples(t: Tables):
    return metrics.organ_samples({"voxels": t.lattice, "volumes": _own_grid(t)}, {})


@query(None)
def organs_with_kidneys(t: Tables):
    """Organs whose kidney masks are judged by the part that is measured, with the patients' ages."""
    tables = _renal(t)
    return metrics.organs(tables | {"expected": tables["voxels"].select("study", "mask").distinct(), "kidneys": renal.kidneys(tables, RENAL)}, {"alerts": {"m0": "kidney", "m2": "liver"}})


@query(None)
def stone_summary(t: Tables):
    tables = _renal(t)
    return metrics.stone_summary(metrics.kidney_stone(tables, {"kidneys": ["m0", "m1"]}), tables["voxels"], "m0", "m1")
