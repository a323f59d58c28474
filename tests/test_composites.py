"""Composite metrics against brute force over the smallest tables' balls."""

import itertools

import numpy as np
import pytest

from voxelweave.operators import metrics
from voxelweave.plans.catalog import Tables
from voxelweave.plans.metric_queries import SPACING, _blobs

from .test_geometry import flood

CUBE = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


@pytest.fixture(scope="module")
def blobs(spark, data):
    v = _blobs(Tables(spark, data)).cache()
    by = {}
    for r in v.collect():
        by.setdefault(r.study, {}).setdefault(r.mask, {})[r.x, r.y, r.z] = r.hu
    return v, by


def feret(comp):
    best = 0.0
    for z in {p[2] for p in comp}:
        flat = {p[:2] for p in comp if p[2] == z}
        edge = np.array([(x + dx / 2, y + dy / 2) for x, y in flat for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (x + dx, y + dy) not in flat]) * np.array(SPACING[:2])
        best = max(best, np.sqrt(((edge[:, None] - edge[None]) ** 2).sum(axis=2)).max())
    return best


def test_nodules_and_lesions(blobs):
    v, by = blobs
    got = {r.study: r for r in metrics.lung_nodules({"voxels": v}, {"mask": "m2", "support": ["m0", "m1"]}).collect()}
    lesions = {r.study: r for r in metrics.liver_lesions({"voxels": v}, {"mask": "m2", "support": ["m0", "m1"], "spacing": SPACING}).collect()}
    for study, m in by.items():
        base = set(m["m0"]) | set(m["m1"])
        parts = flood(m["m2"], CUBE)
        touch = [len(c) for c in parts if c & base]
        assert (got[study].n_nodules, got[study].n_voxels, got[study].largest) == (len(touch), sum(touch), max(touch))
        deep = [(len(c), feret(c)) for c in parts if 2 * len(c & base) >= len(c)]
        deep = [x for x in deep if x[1] >= 4]
        assert bool(deep) == (study in lesions)
        if deep:
            r = lesions[study]
            assert (r.n_lesions, r.n_voxels) == (len(deep), sum(x[0] for x in deep)) and abs(r.largest_mm - max(x[1] for x in deep)) < 1e-9


def test_stones(blobs):
    v, by = blobs
    got = {(r.study, r.mask): r for r in metrics.kidney_stone({"voxels": v}, {"kidneys": ["m0", "m1"], "spacing": SPACING, "least_mm3": 5.0}).collect()}
    for study, m in by.items():
        for side in ("m0", "m1"):
            parts = [c for c in flood([p for p, hu in m[side].items() if hu > 130], CUBE) if len(c) >= 2 and len(c) * np.prod(SPACING) >= 5]
            r = got[study, side]
            assert (r.n_stones, r.n_voxels, r.largest) == (len(parts), sum(map(len, parts)), max(map(len, parts)))


def test_renal_regions(blobs):
    v, by = blobs
    got = {(r.study, r.mask): r for r in metrics.renal_anatomy({"voxels": v}, {"kidneys": ["m0", "m1"], "l3": "m2", "l4": "m1", "least_voxels": 50}).collect()}
    for study, m in by.items():
        mid = lambda k: (z := sorted({p[2] for p in m[k]}))[len(z) // 2]  # noqa: B023, E731
        l3, l4 = mid("m2"), mid("m1")
        for side in ("m0", "m1"):
            cz = [np.mean([p[2] for p in c]) for c in flood(m[side], CUBE) if len(c) >= 50]
            r = got[study, side]
            assert (r.n, r.n_native, r.n_pelvic) == (len(cz), sum(z >= max(l3, l4) for z in cz), sum(z <= min(l3, l4) for z in cz))


def test_renal_roles(spark):
    """A kidney of its own, one with a graft below it, two that compete, one in the pelvis alone, and fragments."""
    box = lambda study, mask, z, n=3, x=0: [(study, mask, x + a, b, z + c, 30.0 + z) for a in range(n) for b in range(n) for c in range(n)]
    level = lambda study: [(study, "L3", 50, 50, 60, 0.0), (study, "L4", 50, 50, 40, 0.0)]
    rows = level(1) + box(1, "r", 80) + box(1, "l", 85) + box(1, "l", 10) + box(1, "l", 20, 1)
    rows += level(2) + box(2, "r", 70) + box(2, "r", 90) + box(2, "l", 5)
    rows += level(3) + box(3, "r", 49) + box(3, "l", 50, 3, 20) + box(4, "r", 49)
    v = spark.createDataFrame(rows, "study int, mask string, x int, y int, z int, hu double")
    p = spark.createDataFrame([(1, False), (2, True), (3, None), (4, False)], "study int, contrast boolean")
    got = {}
    for r in metrics.renal_roles({"voxels": v, "patients": p}, {"kidneys": ["r", "l"], "l3": "L3", "l4": "L4", "least_voxels": 20}).collect():
        got.setdefault((r.study, r.mask), set()).add((r.role, r.measured, r.hu))
    assert got[1, "r"] == {("native_kidney", True, 110.0)} and got[2, "l"] == {("indeterminate_pelvic_renal_component", True, None)}
    assert got[1, "l"] == {("native_kidney", True, 115.0), ("suspected_renal_allograft", False, 40.0), ("segmentation_fragment", False, 50.0)}
    assert got[2, "r"] == {("unclassified_native_region_component", False, None)}
    assert {x[0] for x in got[3, "r"] | got[3, "l"]} == {"native_kidney"}  # each by the other's overlap
    assert got[4, "r"] == {("native_kidney", True, 79.0)}


def test_effusion(blobs):
    v, by = blobs
    got = {r.study: r for r in metrics.effusion({"voxels": v}, {"mask": "m2", "left": "m0", "right": "m1", "spacing": SPACING, "voxel_ml": 0.1, "least_ml": 60}).collect()}
    sp = np.array(SPACING)
    for study, m in by.items():
        ml = {}
        side = {k: np.array([p for p in m[k] if any(tuple(np.add(p, o)) not in m[k] for o in CUBE)]) * sp for k in ("m0", "m1")}
        for c in flood(m["m2"], CUBE):
            p = np.array(list(c)) * sp
            d = {k: np.percentile([np.sqrt(((s - q) ** 2).sum(axis=1).min()) for q in p], 10) for k, s in side.items()}
            name = "indeterminate" if abs(d["m0"] - d["m1"]) < 5 else "left" if d["m0"] < d["m1"] else "right"
            ml[name] = ml.get(name, 0) + 0.1 * len(c)
        assert abs(got[study].kept - sum(x for x in ml.values() if x >= 60)) < 1e-6 and got[study].dropped == sum(x < 60 for x in ml.values())


def test_arms_are_left_out(spark):
    """A muscle that an arm bone touches goes from area and density; with contrast there is no density."""
    body = [(s, "muscle", x, y, 5, 40.0) for s in (1, 2, 3) for x in range(10) for y in range(10)]
    arm = [(s, "muscle", x, y, 5, 90.0) for s in (1, 2) for x in range(20, 24) for y in range(4)]
    bone = [(1, "humerus", 25, 1, 6, 500.0), (2, "humerus", 25, 1, 60, 500.0)]  # the second is too far up
    level = [(s, "L3", 5, 5, z, 200.0) for s in (1, 2, 3, 4) for z in (4, 5, 6)]
    v = spark.createDataFrame(body + arm + bone + level, "study int, mask string, x int, y int, z int, hu double")
    p = spark.createDataFrame([(1, False, 2.0, 80.0), (2, True, 0.5, 80.0), (3, None, 2.0, 10.0), (4, False, 2.0, 80.0)], "study int, contrast boolean, height_m double, weight_kg double")
    cfg = {"level": "L3", "muscle": "muscle", "pixel_cm2": 0.01, "arms": ["humerus"], "spacing": (1.0, 1.0, 1.0), "margin_mm": 2.0, "half_window_mm": 20.0}
    got = {r.study: r for r in metrics.l3_muscle({"voxels": v, "patients": p}, cfg).collect()}
    assert (got[1].raw_pixels, got[1].n_pixels, got[1].excluded, got[1].mean, got[1].smi, got[1].bmi) == (116, 100, 16, 40.0, 0.25, 20.0)
    assert (got[2].n_pixels, got[2].mean, got[2].smi, got[2].bmi) == (116, None, None, None)
    assert (got[3].n_pixels, got[3].bmi, got[4].status) == (100, None, "not_present")
    fat = metrics.vat_sat({"voxels": v}, cfg | {"visceral": "muscle", "subcutaneous": "L3"}).where("study < 3").collect()
    assert {r.study: (r.vat_excluded, round(r.vat_cm2, 6), r.sat_cm2) for r in fat} == {1: (16, 1.0, 0.01), 2: (0, 1.16, 0.01)}


def test_recalculate_tells_what_it_can_not_do(spark):
    v = spark.createDataFrame([(1, "a", 1, 1, 1, 5.0)], "study int, mask string, x int, y int, z int, hu double")
    errors = {}
    got = metrics.recalculate(["liver_segments", "body_fat", "vat_sat"], {"voxels": v}, {"liver_segments": {"voxel_cm3": 1.0}}, v.study == 1, errors)
    assert set(got) == {"liver_segments"} and set(errors) == {"body_fat", "vat_sat"} and errors["body_fat"].startswith("KeyError")
    with pytest.raises(KeyError):
        metrics.recalculate(["body_fat"], {"voxels": v}, {})
