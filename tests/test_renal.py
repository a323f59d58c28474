"""Renal parts, audits and kidney alerts on tilted grids, the axial ellipse, and the front by edges, against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import components, renal, vertebrae

from .test_composites import CUBE
from .test_geometry import flood

CFG = {"kidneys": ["r", "l"], "l3": "L3", "l4": "L4", "least_cm3": 0.02}
SIZE = (40, 40, 60)
GRIDS = [((1.0, 1.0, 1.0), 0), ((0.7, 0.9, 1.5), 12), ((1.2, 0.8, 2.0), -25)]


def affine_of(spacing, degrees):
    a = math.radians(degrees)
    turn = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    m = np.eye(4)
    m[:3, :3] = turn * np.array(spacing)
    m[:3, 3] = (-10, 7, 100)
    return m


def box(x, y, z, n):
    return {(x + a, y + b, z + c) for a in range(n) for b in range(n) for c in range(n)}


def scenes():
    """Studies with one, several or no parts a side, above, below or between the levels, at the border, with a level missing or cut off."""
    rnd, out = random.Random(8), {}
    for study in range(24):
        m = {"L3": box(18, 18, 34, 3), "L4": box(18, 18, 22, 3)}
        if study % 8 == 5:
            del m["L4"]
        if study % 8 == 6:
            m["L3"] = box(0, 18, 34, 3)
        for side, x in (("r", 4), ("l", 30)):
            m[side] = set()
            for _ in range(rnd.choice([0, 1, 1, 1, 2, 3])):
                z = rnd.choice([0, 4, 10, 25, 27, 29, 44, 50, 56])
                m[side] |= box(x + rnd.randint(-4, 4), rnd.choice([5, 14, 26]), z, rnd.choice([1, 3, 4]))
            m[side] = {p for p in m[side] if all(0 <= v < n for v, n in zip(p, SIZE))}
        out[study] = m
    return out


def said(study, m, contrast):
    """Parts and audit of one study, by the rule."""
    spacing, degrees = GRIDS[study % 3]
    a = affine_of(spacing, degrees)
    high = lambda p: float(a[2, :3] @ np.mean(np.array(p, float), axis=0) + a[2, 3])
    whole = lambda ps: all(0 < min(p[k] for p in ps) and max(p[k] for p in ps) < SIZE[k] - 1 for k in range(3))
    ref = {k: high(sorted(m[k])) if m.get(k) and whole(m[k]) else None for k in ("L3", "L4")}
    ok = None not in ref.values() and ref["L3"] > ref["L4"]
    sides = {}
    for side in ("r", "l"):
        parts = []
        for c in flood(m[side], CUBE):
            h, cm3 = high(sorted(c)), len(c) * float(np.prod(spacing)) / 1000
            world = [float(a[2, :3] @ np.array(p, float) + a[2, 3]) for p in c]
            hu = [hu_of(p) for p in c]
            region = "unresolved" if not ok else renal.NATIVE if h >= ref["L3"] else renal.PELVIC if h <= ref["L4"] else renal.BETWEEN
            parts.append({"h": round(h, 3), "n": len(c), "lo": round(min(world), 3), "hi": round(max(world), 3), "cm3": round(cm3, 3) if whole(c) else None, "region": region, "sig": cm3 >= CFG["least_cm3"], "hu": None if contrast else round(float(np.mean(hu)), 2)})
        sides[side] = sorted(parts, key=lambda p: (-p["h"], -p["n"]))
    audit = {}
    for side, other in (("r", "l"), ("l", "r")):
        parts, sig = sides[side], [p for p in sides[side] if p["sig"]]
        theirs, native, over, why = [p for p in sides[other] if p["sig"]], None, None, None
        upper = [p for p in sig if p["region"] == renal.NATIVE]
        if ok and len(upper) == 1:
            native, why = upper[0], "single_native_region_component"
        elif ok and len(sig) == 1 and sig[0]["region"] == renal.BETWEEN and len(theirs) == 1 and theirs[0]["region"] != renal.PELVIC:
            length = sig[0]["hi"] - sig[0]["lo"]
            over = max(0.0, min(sig[0]["hi"], theirs[0]["hi"]) - max(sig[0]["lo"], theirs[0]["lo"])) / length if length > 0 else 0.0
            if over >= renal.LEAST_OVERLAP:
                native, why = sig[0], "contralateral_superior_extent_overlap"
        elif not ok and len(sig) == 1:
            native, why = sig[0], "single_significant_component_legacy_fallback"
        measured = native or (sig[0] if len(sig) == 1 and sig[0]["region"] in (renal.BETWEEN, renal.PELVIC) else None)
        low = any(p["region"] == renal.PELVIC for p in sig)
        if not m[side]:
            status = "missing"
        elif not sig:
            status = "no_significant_component"
        elif not ok and len(sig) == 1:
            status = "single_component_legacy_fallback"
        elif native:
            status = "native_and_suspected_allograft" if low else "native_only" if len(sig) == 1 else "native_with_unclassified_components"
        elif measured:
            status = "single_pelvic_component_anatomy_indeterminate" if measured["region"] == renal.PELVIC else "single_component_anatomy_indeterminate"
        else:
            status = "ambiguous_multiple_components" if len(sig) > 1 else "anatomy_unresolved"
        place = lambda p: 1 + next(k for k, x in enumerate(parts) if x is p) if p else None  # noqa: B023, E731
        audit[side] = (status, len(parts), len(sig), why, place(native), place(measured), None if over is None else round(over, 3))
    return sides, audit


def hu_of(p):
    return (p[0] * 7 + p[1] * 5 + p[2] * 3) % 90


@pytest.fixture(scope="module")
def tables(spark):
    s = scenes()
    rows = [(k, mask, *p, hu_of(p)) for k, m in s.items() for mask, ps in m.items() for p in ps]
    v = spark.createDataFrame(rows, "study long, mask string, x int, y int, z int, hu int").repartition(6)
    vol = spark.createDataFrame([(k, *SIZE, *GRIDS[k % 3][0], affine_of(*GRIDS[k % 3]).ravel().tolist()) for k in s], "study long, nx int, ny int, nz int, sx double, sy double, sz double, affine array<double>")
    p = spark.createDataFrame([(k, k % 4 == 1, None if k % 5 == 0 else 10 + k) for k in s], "study long, contrast boolean, age int")
    return s, {"voxels": v, "volumes": vol, "patients": p}


def test_parts_audits_and_alerts(tables):
    s, t = tables
    parts = renal.renal_components(t, CFG).cache()
    got = {(r.study, r.mask, r.part): r for r in parts.collect()}
    rows = {(r.study, r.mask): r for r in renal.kidney_audit(parts, t["voxels"], CFG).collect()}
    alerts = {(r.study, r.mask): r for r in renal.kidneys(t, CFG).collect()}
    seen, n = set(), 0
    for study, m in s.items():
        sides, audit = said(study, m, study % 4 == 1)
        for side in ("r", "l"):
            for k, p in enumerate(sides[side]):
                if sum((x["h"], x["n"]) == (p["h"], p["n"]) for x in sides[side]) > 1:
                    continue  # equally high and large: either may come first
                r = got[study, side, k + 1]
                n += 1
                assert (r.n_voxels, r.region, r.significant, r.cm3, r.hu) == (p["n"], p["region"], p["sig"], p["cm3"], p["hu"])
                assert abs(r.height_mm - p["h"]) < 2e-3 and abs(r.inferior - p["lo"]) < 2e-3 and abs(r.superior - p["hi"]) < 2e-3
            r = rows[study, side]
            assert (r.status, r.raw, r.n, r.why, r.native, r.measured) == audit[side][:6], (study, side)
            assert (r.overlap is None) == (audit[side][6] is None) and abs((r.overlap or 0) - (audit[side][6] or 0)) < 2e-3
            seen.add(r.status)
            a, mine = alerts[study, side], sides[side][audit[side][5] - 1] if audit[side][5] else None
            child = study % 5 != 0 and 10 + study < 16
            vague = mine is not None and audit[side][4] is None
            assert a.alert == ("small_kidney" if mine and mine["cm3"] is not None and not child and not vague else None)
    assert n > 30 and len(seen) >= 7, seen


def test_roles(tables):
    _, t = tables
    parts = renal.renal_components(t, CFG)
    roles = renal.renal_roles(parts, renal.kidney_audit(parts, t["voxels"], CFG)).collect()
    assert {r.role for r in roles} >= {"segmentation_fragment", "native_kidney", "suspected_renal_allograft", "indeterminate_pelvic_renal_component"}
    for r in roles:
        assert r.is_native == (r.role == "native_kidney") and (r.measured or not r.is_native)
        assert (r.role == "segmentation_fragment") == (not r.significant)


def test_equal_parts_of_a_slice_by_their_distance(spark):
    """Three parts of four pixels: the one nearest to the middle of all counts, in every slice by itself."""
    sq = lambda x, y, z: [(1, "m", x + a, y + b, z) for a in (0, 1) for b in (0, 1)]
    rows = sq(0, 0, 0) + sq(9, 9, 0) + sq(20, 20, 0) + sq(0, 0, 1) + sq(5, 0, 1) + [(1, "m", 30, 30, 1)]
    v = spark.createDataFrame(rows, "study int, mask string, x int, y int, z int")
    key = ["study", "mask", "z"]
    top = components.largest_in_slice(components.describe(components.label_runs(v, planar=True), key), key).collect()
    assert {(r.z, r.x_min) for r in top} == {(0, 9), (1, 5)}


def vertebra(rnd, thick):
    """A body with an arch behind it, in a random direction."""
    n, m = 40, 36
    x, y = np.ogrid[:n, :m]
    body = ((x - 20) / 11) ** 2 + ((y - 13) / 9) ** 2 <= 1
    arch = (abs(x - 20) <= thick) & (y >= 18) & (y < 33)
    cells = (body | arch) & (np.random.default_rng(rnd.randint(0, 99)).random((n, m)) > 0.004)
    if rnd.random() < 0.5:
        cells = cells[:, ::-1]
    return cells.T if rnd.random() < 0.5 else cells


def brute_axial(cells, spacing, mm):
    grid = np.pad(cells, 1)
    core = grid
    for _ in range(max(1, int(mm / min(spacing)))):
        near = [np.roll(core, d, axis=k) for k in (0, 1) for d in (1, -1)]
        core = core & near[0] & near[1] & near[2] & near[3]
    parts = [sorted(c) for c in flood([(int(a), int(b), 0) for a, b in np.argwhere(core)], [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)])]
    if not parts:
        return None
    part = np.array(max(sorted(parts), key=len))[:, :2]
    lean = part.mean(axis=0) - np.argwhere(grid).mean(axis=0)
    lo, hi = part.min(axis=0), part.max(axis=0)
    c, r = (lo + hi) / 2, [max((hi[0] - lo[0]) * 0.35, 1.0), max((hi[1] - lo[1]) * 0.2, 1.0)]
    k = int(abs(lean[1]) > abs(lean[0]))
    c[k] = hi[k] - (hi[k] - lo[k]) / 4 if lean[k] > 0 else lo[k] + (hi[k] - lo[k]) / 4
    inside = [tuple(p - 1) for p in part if ((p - c) ** 2 / np.array(r) ** 2).sum() <= 1 + 1e-12]
    return c - 1, r, inside


def test_axial_ellipse(spark):
    rnd, rows, want = random.Random(3), [], {}
    for study in range(12):
        cells, spacing = vertebra(rnd, study % 4 + 1), [(1.0, 1.0), (0.7, 0.9), (2.0, 1.5)][study % 3]
        if study == 11:
            cells = np.zeros((9, 9), bool)
            cells[3:5, 3:5] = True
        want[study] = brute_axial(cells, spacing, 3.0)
        for z in (4, 5, 6, 9):
            rows += [(study, int(x), int(y), z, (x * 3 + y * 7) % 50, *spacing, 3.0, 50, 50, 50) for x, y in np.argwhere(cells if z == 6 else cells[:1])]
    v = spark.createDataFrame([[*map(int, r[:5]), *map(float, r[5:8]), *r[8:]] for r in rows], "study int, x int, y int, z int, hu int, sx double, sy double, sz double, nx int, ny int, nz int").repartition(5)
    # slices without the body are there too: only the middle one counts
    flat = v.where("z <> 9 or x >= 0")
    got = {r.study: r for r in vertebrae.l1_axial_roi(flat.where("z = 6"), None, ["study", "sx", "sy", "sz"], 3.0).collect()}
    for study, w in want.items():
        r = got[study]
        if w is None:
            assert r.status == "empty_eroded_mask" and r.n_pixels is None
            continue
        values = [(x * 3 + y * 7) % 50 for x, y in w[2]]
        assert r.status == "ok" and r.slice == 6 and r.n_pixels == len(values)
        assert np.allclose([r.center_x, r.center_y, r.radius_x, r.radius_y, r.mean, r.deviation], [*w[0], *w[1], np.mean(values), np.std(values)])


def test_front_by_the_edges_of_the_plane(spark):
    """Two planes that are each other's mirror image have mirrored ellipses, whichever side is the front."""
    x, rows = 5, []
    for study, flip in ((0, False), (1, True)):
        for y in range(30):
            for z in range(10, 24 if y < 22 else 40):
                rows.append((study, "v", x, 29 - y if flip else y, z, 1))
    v = spark.createDataFrame(rows, "study int, mask string, x int, y int, z int, hu int")
    got = {r.study: r for r in vertebrae.l1_sagittal_roi(v, (1.0, 1.0, 1.0), ["study"], front_low=None, erosion_mm=2.0, radius_mm=3.0).collect()}
    assert got[0].center_row == 29 - got[1].center_row and got[0].center_row < 15
    assert got[0].n_pixels == got[1].n_pixels > 5
