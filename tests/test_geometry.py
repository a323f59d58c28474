"""Masks against brute force in numpy on small random grids."""

import itertools

import numpy as np
import pytest

from voxelweave.operators import components, masks, morphology, shapes

SPACING = (0.7, 0.9, 2.5)


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(0)
    return {0: rng.random((9, 8, 7)) < 0.8, 1: rng.random((10, 7, 6)) < 0.35}


@pytest.fixture(scope="module")
def voxels(spark, grids):
    rows = [(0, k, *map(int, p)) for k, g in grids.items() for p in np.argwhere(g)]
    return spark.createDataFrame(rows, "study int, mask int, x int, y int, z int").repartition(3)


def points(df, mask):
    return {(r.x, r.y, r.z) for r in df.where(f"mask = {mask}").collect()}


def flood(points, near):
    left, out = set(points), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            p = todo.pop()
            comp.add(p)
            for o in near:
                q = tuple(a + b for a, b in zip(p, o))
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(comp)
    return out


@pytest.mark.parametrize("corners", [True, False])
@pytest.mark.parametrize("planar", [True, False])
def test_components(voxels, grids, corners, planar):
    near = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o) and (corners or sum(map(abs, o)) == 1) and (not planar or o[2] == 0)]
    runs = components.label_runs(voxels, planar=planar, corners=corners)
    for k, g in grids.items():
        by = {}
        for r in runs.where(f"mask = {k}").collect():
            by.setdefault(r.component, set()).update((x, r.y, r.z) for x in range(r.x0, r.x1 + 1))
        want = {frozenset(c) for c in flood(map(tuple, np.argwhere(g).tolist()), near)}
        assert {frozenset(c) for c in by.values()} == want


def test_erosions_and_distance(voxels, grids):
    mm = morphology.erode_mm(voxels, 1.5, SPACING)
    twice = morphology.erode(voxels, 2)
    for k, g in grids.items():
        inside = set(map(tuple, np.argwhere(g).tolist()))
        pad = np.pad(g, 4)
        out = np.argwhere(~pad) - 4
        far = {p for p in inside if ((((out - np.array(p)) * np.array(SPACING)) ** 2).sum(axis=1).min()) >= 1.5**2 - 1e-9}
        assert points(mm, k) == far
        l1 = {p for p in inside if np.abs(out - np.array(p)).sum(axis=1).min() > 2}
        assert points(twice, k) == l1


def test_nearest_and_dilate(voxels, grids, spark):
    a, b = (np.argwhere(grids[k]) for k in (0, 1))
    got = morphology.nearest(voxels.where("mask = 0").drop("mask"), voxels.where("mask = 1").drop("mask"), SPACING, ["study"], 64.0)
    want = {tuple(map(int, p)): np.sqrt((((b - p) * np.array(SPACING)) ** 2).sum(axis=1).min()) for p in a}
    found = {(r.x, r.y, r.z): r.distance for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - d) < 1e-9 for p, d in want.items())
    grown = points(morphology.dilate(voxels, 1, (9, 8, 7)), 0)
    near = {tuple(int(v) for v in p + o) for p in a for o in [np.zeros(3, int), *np.array(morphology.CROSS)]}
    assert grown == {p for p in near if all(0 <= v < n for v, n in zip(p, (9, 8, 7)))}


def test_feret(voxels, grids):
    labelled = components.label_runs(voxels)
    got = {(r.mask, r.component): r.diameter_mm for r in components.feret_axial(labelled, SPACING[:2]).collect()}
    by = {}
    for r in labelled.collect():
        by.setdefault((r.mask, r.component), set()).update((x, r.y, r.z) for x in range(r.x0, r.x1 + 1))
    for key, comp in by.items():
        best = 0.0
        for z in {p[2] for p in comp}:
            flat = {p[:2] for p in comp if p[2] == z}
            edge = np.array([(x + dx / 2, y + dy / 2) for x, y in flat for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (x + dx, y + dy) not in flat]) * np.array(SPACING[:2])
            best = max(best, np.sqrt(((edge[:, None] - edge[None]) ** 2).sum(axis=2)).max())
        assert abs(got[key] - best) < 1e-9


def test_pca_and_partitions(voxels, grids):
    for n in (1, 8):
        got = {r.mask: r for r in shapes.pca_extent(voxels.repartition(n), spacing=SPACING).collect()}
        for k, g in grids.items():
            p = np.argwhere(g) * np.array(SPACING)
            w, v = np.linalg.eigh(np.cov(p.T, bias=True))
            ext = [np.ptp((p - p.mean(axis=0)) @ v[:, i]) for i in (2, 1, 0)]
            assert np.allclose([got[k].extent_1, got[k].extent_2, got[k].extent_3], ext)


def test_runs_and_overlap(voxels, grids):
    runs = masks.runs(voxels)
    assert {(r.mask, x, r.y, r.z) for r in runs.collect() for x in range(r.x0, r.x1 + 1)} == {(k, *map(int, p)) for k, g in grids.items() for p in np.argwhere(g)}
    a, b = (set(map(tuple, np.argwhere(grids[k]).tolist())) for k in (0, 1))
    got = masks.overlap(runs.where("mask = 1"), runs.where("mask = 0").drop("mask"), ["study"], "mask").first()
    assert (got.n_voxels, got.inside) == (len(b), len(a & b))


def test_appendicular_parts_go(spark):
    from voxelweave.operators import metrics

    body = [(1, x, y, 5) for x in range(10) for y in range(10)]
    arm = [(1, x, y, 5) for x in range(20, 24) for y in range(4)]
    df = lambda rows: spark.createDataFrame(rows, "study int, x int, y int, z int")
    bones = df([(1, 25, 1, 5)])
    got = metrics.appendicular_filter(df(body + arm), bones, 2.0, (1.0, 1.0))
    assert sorted((r.x, r.y) for r in got.collect()) == sorted((x, y) for _, x, y, _ in body)
    much = metrics.appendicular_filter(df(arm), bones, 2.0, (1.0, 1.0))
    assert much.count() == len(arm)  # all of it would go, so nothing does


def test_metric_order():
    from voxelweave.operators import metrics

    assert [m.name for m in metrics.planned(["organs", "brain", "organs"])] == ["organs", "brain"]
    with pytest.raises(ValueError):
        metrics.planned(["nothing"])
    with pytest.raises(ValueError):
        metrics.metric("Not Allowed")


def test_labels_follow_the_first_voxel(voxels, grids):
    """Components are numbered in the order of their first voxel by x, then y, then z; sizes, bounds and centres are theirs."""
    got = {}
    for r in components.describe(components.label_runs(voxels)).collect():
        got.setdefault(r.mask, {})[r.label] = (r.n_voxels, (r.x_min, r.y_min, r.z_min), (r.x_max, r.y_max, r.z_max), round(r.cx, 6), round(r.cz, 6))
    near = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
    for k, g in grids.items():
        parts = sorted(flood(map(tuple, np.argwhere(g).tolist()), near), key=min)
        want = {}
        for i, c in enumerate(parts, 1):
            p = np.array(list(c))
            want[i] = (len(c), tuple(p.min(axis=0)), tuple(p.max(axis=0)), round(float(p[:, 0].mean()), 6), round(float(p[:, 2].mean()), 6))
        assert got[k] == want


def test_round_shapes_have_no_angle(spark):
    """Discs, whose moments are equal: what rounding makes of them is no axis."""
    disc = [(x, y) for x, y in itertools.product(range(-6, 7), repeat=2) if x * x + y * y <= 36]
    rows = [(k, "m", 7 * k + x, 11 * k + 3 + y, 0) for k in range(20) for x, y in disc] + [(20, "m", k, 2 * k, 0) for k in range(9)]
    got = {r.study: r.angle for r in shapes.inplane_rotation(spark.createDataFrame(rows, "study int, mask string, x int, y int, z int").repartition(8)).collect()}
    assert got.pop(20) == pytest.approx(np.degrees(np.arctan(2)))
    assert set(got.values()) == {0.0} and len(got) == 20
