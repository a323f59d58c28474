"""Bodies, heights, screens, regions of interest and grades against brute force on small masks."""

import itertools

import numpy as np
import pytest

from voxelweave.functions import rules
from voxelweave.operators import metrics, tiles, vertebrae

from .test_geometry import flood

CUBE = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
SPACING = (1.0, 0.8, 1.3)


def shapes():
    rng = np.random.default_rng(5)
    g = np.zeros((40, 70, 40), bool)
    g[4:20, 3:15, 6:27] = True  # a body
    g[10:13, 15:24, 14:18] = True  # with a thin end behind
    g[6, 5, 7] = False
    wedge = np.zeros_like(g)
    for y in range(14):
        wedge[3:19, 40 + y, 5 : 12 + y] = True
    wedge[30:33, 50, 5:8] = True  # an island
    return {"a": g, "b": wedge, "c": np.pad(np.ones((2, 2, 5), bool), ((3, 35), (3, 65), (3, 32))), "d": g & (rng.random(g.shape) < 0.93)}


def depth(mask, spacing):
    out = np.argwhere(~np.pad(mask, 1)) - 1
    sp = np.array(spacing)
    return {tuple(p): np.sqrt((((out - p) * sp) ** 2).sum(axis=1).min()) for p in np.argwhere(mask)}


def largest(points):
    return max(sorted(flood(points, CUBE), key=min), key=len) if points else set()


def axes_of(points):
    span = [max(p[k] for p in points) - min(p[k] for p in points) + 1 for k in range(3)]
    si = int(np.argmax(span))
    rest = [k for k in range(3) if k != si]
    ap = rest[int(np.argmin([span[k] for k in rest]))]
    return ap, si, 3 - ap - si


def brute_body(mask, spacing):
    points = set(map(tuple, np.argwhere(mask).tolist()))
    ap = axes_of(points)[0]
    part = largest(points)
    grid = np.zeros_like(mask)
    grid[tuple(np.array(list(part)).T)] = True
    far = depth(grid, spacing)
    for limit in (2.5, max(1.875, min(spacing) / 2), max(1.25, min(spacing) / 2), 0):
        core = {p for p, d in far.items() if d >= limit}
        if core:
            break
    body = largest(core)
    for _ in range(max(1, round(1.5 / min(spacing)))):
        body = body | {tuple(np.add(p, o).tolist()) for p in body for o in CUBE}
    body &= part
    area = np.bincount([p[ap] for p in body], minlength=mask.shape[ap])
    lo = hi = int(area.argmax())
    wide = area >= max(1, 0.35 * area.max())
    while lo and wide[lo - 1]:
        lo -= 1
    while hi + 1 < len(wide) and wide[hi + 1]:
        hi += 1
    return {p for p in body if lo - 1 <= p[ap] <= hi + 1}


def window(values, at, width):
    lo = max(0, at - width // 2)
    hi = min(len(values), lo + width)
    return float(np.median(values[max(0, hi - width) : hi]))


def brute_heights(points, spacing):
    ap, si, la = axes_of(points)
    p = [(q[ap], q[si], q[la]) for q in points]
    s0, s1 = min(q[1] for q in p), max(q[1] for q in p)
    known = {s: np.median(sorted({q[2] for q in p if q[1] == s})) for s in range(s0, s1 + 1) if any(q[1] == s for q in p)}
    mid = np.interp(range(s0, s1 + 1), list(known), list(known.values()))
    width = max(1, round(5 / spacing[la]))
    found = []
    for off in vertebrae.OFFSETS:
        cells = set()
        for a, s, lat in p:
            left = round(float(mid[s - s0]) + round(off / spacing[la])) - width // 2
            if max(0, left) <= lat < left + width:
                cells.add((a, s))
        if len({a for a, _ in cells}) < 3:
            continue
        a0, a1 = min(a for a, _ in cells), max(a for a, _ in cells)
        at = [[s for x, s in cells if x == a] for a in range(a0, a1 + 1)]
        tall = np.array([max(x) - min(x) + 1 if x else 0 for x in at]) * spacing[si]
        raw = np.array([len(set(x)) for x in at], float)
        n = len(at)
        smooth = lambda v: np.convolve(v, np.ones(min(3, n)) / min(3, n), mode="same")
        w = max(1, round(n * 0.18))
        low, high = np.median(raw[:w]), np.median(raw[-w:])
        front_low = high > low or max(low, high) == 0
        start = max(0, n // 2 - w // 2)
        left, right = int(np.median(range(w))), int(np.median(range(n - w, n)))
        centre = int(np.median(range(start, min(n, start + w))))
        places = (left, centre, right) if front_low else (right, centre, left)
        found.append([window(smooth(v), x, w) for v in (tall, raw) for x in places] + [n * spacing[ap], abs(high - low) / max(high, low, 1), front_low])
    med = np.median(np.array(found, float), axis=0)
    vote = sum((1 if f[-1] else -1) * max(f[-2], 0.05) for f in found)
    return med[:8], vote >= 0, len(found)


@pytest.fixture(scope="module")
def masks_in():
    return shapes()


@pytest.fixture(scope="module")
def voxels(spark, masks_in):
    rows = [(k, "v", *map(int, p), float(p[0] * 3 + p[1] * 5 + p[2])) for k, g in masks_in.items() for p in np.argwhere(g)]
    return spark.createDataFrame(rows, "study string, mask string, x int, y int, z int, hu double").repartition(4)


def test_bodies_and_heights(voxels, masks_in):
    body = vertebrae.isolate_body(voxels, SPACING).cache()
    heights = {r.study: r for r in vertebrae.parasagittal_heights(body, SPACING).collect()}
    for k, g in masks_in.items():
        want = brute_body(g, SPACING)
        assert {(r.x, r.y, r.z) for r in body.where(f"study = '{k}'").collect()} == want, k
        figures, front_low, n = brute_heights(want, SPACING) if len({p[axes_of(want)[0]] for p in want}) >= 3 else (None, None, 0)
        if n == 0:
            assert k not in heights
            continue
        r = heights[k]
        got = [r.anterior_height, r.middle_height, r.posterior_height, r.anterior_area, r.middle_area, r.posterior_area, r.depth, r.confidence]
        assert np.allclose(got, figures) and (r.anterior_is_low, r.n_slabs) == (front_low, n), k


def test_height_screen(voxels, masks_in):
    got = {r.study: r for r in vertebrae.height_screen(voxels, SPACING).collect()}
    for k, g in masks_in.items():
        p = np.argwhere(g) * np.array(SPACING)
        if len(p) < 40:
            assert (got[k].status, got[k].suspicion, got[k].min_ratio) == ("indeterminate", None, None)
            continue
        p = p - p.mean(axis=0)
        _, v = np.linalg.eigh(np.cov(p.T, bias=True))
        si, ap = p @ v[:, 2], p @ v[:, 1]
        q = np.quantile(ap, [1 / 3, 2 / 3])
        h = [round(float(np.ptp(si[m])), 2) for m in (ap <= q[0], (ap > q[0]) & (ap <= q[1]), ap > q[1])]
        ends = sorted((h[0], h[2]))
        want = [min(h) / max(h), h[1] / max(h), ends[0] / ends[1]]
        assert np.allclose([got[k].min_ratio, got[k].middle_ratio, got[k].end_ratio], want, atol=0.02)
        assert got[k].status == ("suspected_fracture" if got[k].suspicion else "no_suspicion")


def test_sagittal_roi(voxels, masks_in):
    got = {r.study: r for r in vertebrae.l1_sagittal_roi(voxels, SPACING, ["study"], erosion_mm=2.0, radius_mm=3.0, front_low=True).collect()}
    for k, g in masks_in.items():
        points = set(map(tuple, np.argwhere(g).tolist()))
        rounds = max(1, round(2.0 / min(SPACING)))
        near = [o for o in itertools.product(range(-rounds, rounds + 1), repeat=3) if sum(map(abs, o)) <= rounds]
        core = {p for p in points if all(tuple(np.add(p, o).tolist()) in points for o in near)} or points
        xs = [p[0] for p in largest(core)]
        plane = round((min(xs) + max(xs)) / 2)
        flat = {(y, z) for x, y, z in points if x == plane}
        sp = (SPACING[1], SPACING[2])
        n2 = max(1, round(2.0 / min(sp)))
        left = {p for p in flat if all((p[0] + a, p[1] + b) in flat for a in range(-n2, n2 + 1) for b in range(-n2, n2 + 1) if abs(a) + abs(b) <= n2)}
        r = got[k]
        assert r.plane == plane
        if not left:
            assert r.status == "empty_eroded_mask" and r.mean is None
            continue
        parts = flood({(*p, 0) for p in left}, [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)])
        left = {p[:2] for p in min(parts, key=lambda c: np.mean([p[0] for p in c]))}
        box = [(a, b) for a in range(-1, 72) for b in range(-1, 42)]
        out = np.array([p for p in box if p not in left])
        far = {p: np.sqrt((((out - np.array(p)) * np.array(sp)) ** 2).sum(axis=1).min()) for p in left}
        rows, cols = [p[0] for p in left], [p[1] for p in left]
        goal = (min(rows) + (max(rows) - min(rows)) * 2.5 / 7, (min(cols) + max(cols)) / 2)
        score = lambda p: far[p] - 0.12 * np.hypot((p[0] - goal[0]) * sp[0], (p[1] - goal[1]) * sp[1])
        best = max(score(p) for p in left)
        assert score((r.center_row, r.center_col)) > best - 1e-9
        inscribed = max(far.values())
        ap, si = min(max(3 * 0.85, min(sp)), inscribed * 0.95), min(max(3 * 1.15, min(sp)), inscribed * 1.2)
        roi = [p for p in left if ((p[0] - r.center_row) * sp[0]) ** 2 / ap**2 + ((p[1] - r.center_col) * sp[1]) ** 2 / si**2 <= 1]
        hu = [plane * 3 + y * 5 + z for y, z in roi]
        assert r.n_pixels == len(roi) and np.allclose([r.mean, r.deviation, r.radius_ap, r.radius_si], [np.mean(hu), np.std(hu), ap, si])


def test_l1_metric_and_extract(spark, voxels):
    patients = spark.createDataFrame([("a", "CT", 120.0, False, 1.0), ("b", "MR", 120.0, None, 1.0), ("c", "CT", 90.0, True, 9.0)], "study string, modality string, kvp double, contrast boolean, thickness_mm double")
    cfg = {"mask": "v", "spacing": SPACING, "n_slices": 60, "erosion_mm": 2.0}
    extra = voxels.unionByName(spark.createDataFrame([("z", "other", 1, 1, 1, 0.0)], voxels.schema))
    got = {r.study: r for r in metrics.l1_hu({"voxels": extra, "patients": patients}, cfg).collect()}
    assert got["a"].status == "done" and got["a"].qc_pass and got["a"].label in ("normal", "osteopenia", "osteoporosis") and len(got["a"].profile) >= 4
    assert got["b"].qc_reasons == "non_ct_modality" and not got["b"].qc_pass
    assert got["c"].status == "empty_eroded_mask" and got["c"].hu is None and got["z"].status == "not_present"
    series = spark.createDataFrame([("p", "1", "a"), ("p", "2", "nowhere"), ("q", "3", "c")], "case_id string, series_id string, study string")
    rows = {r.series_id: r for r in metrics.bmd_extract(series, {"voxels": extra, "patients": patients}, cfg).collect()}
    assert {k: r.status for k, r in rows.items()} == {"1": "done", "2": "not_present", "3": "empty_eroded_mask"} and rows["1"].hu == got["a"].hu


def test_grades_at_their_limits(spark):
    cases = [  # heights, depth, grade, pattern
        ((12, 20, 20), 40, 2, "wedge"), ((11.9, 20, 20), 40, 3, "wedge"), ((15, 20, 20), 40, 2, "wedge"), ((15.9, 20, 20), 40, 1, "wedge"), ((16, 20, 20), 40, 0, None),
        ((20, 15, 20), 40, 2, "biconcave"), ((20, 14.3, 18), 20, 2, "biconcave"), ((20, 15.9, 16.9), 20, 1, "biconcave"), ((15.9, 15.9, 20), 40, 1, "crush"), ((20, 20, 14), 40, 2, "crush"), ((20, 20, 14), 34, 2, "crush"), ((20, 20, 14), 30, 2, None), ((20, 19, 14), None, 2, None),
        ((None, 20, 20), 40, None, None), ((0, 0, 0), 40, None, None),
    ]
    df = spark.createDataFrame([(k, *(None if v is None else float(v) for v in (*h, d))) for k, (h, d, _, _) in enumerate(cases)], "k int, a double, m double, p double, d double")
    got = {r.k: r.g for r in df.select("k", rules.fracture_grade(df.a, df.m, df.p, df.d).alias("g")).collect()}
    for k, (h, _, grade, pattern) in enumerate(cases):
        assert (got[k].grade, got[k].pattern) == (grade, pattern), h


def test_adjacent_grades_and_roll_up(spark):
    rows = [("s", 1, 20.0, 20.0, 20.0, None, 0), ("s", 2, 14.0, 19.0, 20.0, "wedge", 2), ("s", 3, 20.0, 20.0, 22.0, None, 0), ("s", 4, 19.0, 12.0, 20.0, "biconcave", 3), ("s", 5, 20.0, 20.0, 20.0, None, 1), ("t", 1, 20.0, 20.0, 20.0, None, 0)]
    df = spark.createDataFrame(rows, "study string, ordinal int, anterior_height double, middle_height double, posterior_height double, pattern string, grade int")
    got = {(r.study, r.ordinal): (r.reference_mm, r.grade) for r in metrics.adjacent_grades(df, ["study"], "ordinal", df.grade == 0).collect()}
    assert got == {("s", 1): (None, None), ("s", 2): (20.0, 2), ("s", 3): (None, None), ("s", 4): (20.0, 2), ("s", 5): (None, None), ("t", 1): (None, None)}


def test_fracture_metric(voxels, spark):
    v = voxels.where("study = 'a'")
    levels = v.unionByName(v.selectExpr("study", "'w' mask", "x", "y", "z + 1 as z", "hu")).unionByName(v.where("z < 20").selectExpr("study", "'u' mask", "x", "y", "z", "hu"))
    (got,) = metrics.fracture({"voxels": levels}, {"levels": ["v", "u", "w"], "spacing": SPACING, "n_slices": 40}).collect()
    assert got.n_analyzed == 3 and got.n_incomplete == 0
    (cut,) = metrics.fracture({"voxels": levels}, {"levels": ["v", "u", "w"], "spacing": SPACING, "n_slices": 27}).collect()
    assert cut.n_incomplete == 2 and cut.severity in ("indeterminate", "none", "mild", "moderate", "severe")


def test_stencils_cross_tiles(spark):
    """A mask over many tiles, at negative places too, and with a null in its key."""
    rng = np.random.default_rng(1)
    g = rng.random((70, 40, 35)) < 0.9
    shift = np.array([-40, -3, 20])
    points = [tuple(map(int, p + shift)) for p in np.argwhere(g)]
    df = spark.createDataFrame([(None, "m", *p) for p in points], "study string, mask string, x long, y int, z int").repartition(3)
    have = set(points)
    full = lambda p, near: all(tuple(a + b for a, b in zip(p, o)) in have for o in near)
    from voxelweave.operators import components, morphology

    got = {(r.x, r.y, r.z) for r in morphology.erode(df, 1, morphology.CUBE).collect()}
    assert got == {p for p in have if full(p, CUBE)}
    assert {(r.x, r.y, r.z) for r in morphology.surface(df).collect()} == have - got
    sparse = df.where("(x * 7 + y * 13 + z * 29) % 5 < 1")
    mine = {p for p in have if int(np.fmod(p[0] * 7 + p[1] * 13 + p[2] * 29, 5)) < 1}
    by = {}
    for r in components.label_runs(sparse).collect():
        by.setdefault(r.component, set()).update((x, r.y, r.z) for x in range(r.x0, r.x1 + 1))
    assert {frozenset(c) for c in by.values()} == {frozenset(c) for c in flood(mine, CUBE)}
    assert tiles.joined(5, np.array([4, 1]), np.array([3, 4])).tolist() == [0, 1, 2, 1, 1]


def test_distances_without_a_bound(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-50, 90, (300, 3)), rng.integers(-60, 120, (40, 3))
    df = lambda p, s: spark.createDataFrame([(s, *map(int, q)) for q in p], "study string, x int, y int, z int")
    pts = df(a, "s").unionByName(df(a[:3], "alone"))
    got = {(r.x, r.y, r.z): r.distance for r in tiles.distance_to(pts, df(b, "s"), SPACING, ["study"]).collect()}
    want = {tuple(map(int, p)): np.sqrt((((b - p) * np.array(SPACING)) ** 2).sum(axis=1).min()) for p in a}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
