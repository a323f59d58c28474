"""The inner part of a vertebra against brute force, with islands, thin masks and small cores."""

import itertools

import numpy as np

from voxelweave.operators import metrics

from .test_geometry import flood

CUBE = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
FLAT = [o for o in CUBE if o[2] == 0]


def box(x, y, z, a, b, c):
    return set(itertools.product(range(x, x + a), range(y, y + b), range(z, z + c)))


def brute(mask):
    near = [o for o in itertools.product(range(-2, 3), repeat=3) if sum(map(abs, o)) <= 2]  # 1.5 mm are two rounds of the cross
    eroded = {p for p in mask if all(tuple(np.add(p, o)) in mask for o in near)} or mask
    best = lambda parts: max(sorted(parts, key=min), key=len)
    slices = set().union(*[best(flood({p for p in eroded if p[2] == z}, FLAT)) for z in {p[2] for p in eroded}])
    got = best(flood(slices, CUBE))
    return got if len(got) >= 25 else eroded


def test_trabecular_roi(spark):
    studies = {
        0: box(0, 0, 0, 8, 8, 7) | box(12, 0, 0, 6, 6, 9),  # an island beside, and slices with that alone
        1: box(0, 0, 0, 2, 2, 2),  # nothing is left of it
        2: box(0, 0, 0, 4, 4, 4) | box(9, 0, 0, 4, 4, 5),  # the largest part is small
    }
    rows = [(k, "v", *p, float(p[0] * 7 + p[1] * 5 + p[2] * 3)) for k, m in studies.items() for p in m]
    voxels = spark.createDataFrame(rows, "study int, mask string, x int, y int, z int, hu double").repartition(3)
    got = {r.study: r for r in metrics.l1_volumetric({"voxels": voxels}, {"mask": "v", "mm": 1.5, "spacing": (1.0, 1.0, 1.0)}).collect()}
    for k, m in studies.items():
        want = brute(m)
        assert (got[k].n_voxels, got[k].n_core) == (len(m), len(want))
        assert abs(got[k].hu - np.mean([x * 7 + y * 5 + z * 3 for x, y, z in want])) < 0.006
