"""Effusions of both kinds, organs with judged kidneys, stones by study, and the choice of first studies, on made-up scenes."""

import pytest
from pyspark.sql import functions as F

from voxelweave.operators import metrics, renal

V = "study long, mask string, x int, y int, z int, hu int"


def box(study, mask, x, n, hu=50, y=10, z=10):
    return [(study, mask, x + a, y + b, z + c, hu) for a in range(n) for b in range(n) for c in range(n)]


@pytest.fixture(scope="module")
def volumes(spark):
    return spark.createDataFrame([(k, 80, 60, 60, 1.0 + k % 2, 1.0, 1.0, [float(x) for x in (1 + k % 2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]) for k in range(6)], "study long, nx int, ny int, nz int, sx double, sy double, sz double, affine array<double>")


def test_effusions_of_both_kinds(spark, volumes):
    lungs = lambda k: box(k, "L", 10, 6) + box(k, "R", 60, 6)
    rows = lungs(0) + box(0, "p", 20, 4) + box(0, "p", 54, 3) + box(0, "p", 37, 2)  # left, right, halfway
    rows += lungs(1) + box(1, "h", 36, 4) + box(1, "p", 57, 2)
    rows += lungs(2) + box(2, "h", 36, 2)
    rows += box(3, "p", 20, 4)  # no lungs
    v = spark.createDataFrame(rows, V).repartition(4)
    cfg = {"pleural": "p", "pericardial": "h", "left": "L", "right": "R", "least_ml": 0.06}
    got = {(r.study, r.finding): r for r in metrics.effusions({"voxels": v, "volumes": volumes}, cfg).collect()}
    assert set(got) == {(0, "pleural_effusion"), (1, "pericardial_effusion"), (1, "pleural_effusion"), (2, "pericardial_effusion"), (3, "pleural_effusion")}
    a = got[0, "pleural_effusion"]
    assert (a.left_ml, a.right_ml, a.indeterminate_ml) == (0.064, 0.027, 0.008) and a.eligible_sides == "left" and a.publish and a.n_components == 3
    b, c = got[1, "pericardial_effusion"], got[1, "pleural_effusion"]
    assert b.ml == 0.128 and b.positive and b.left_ml is None and not c.positive and c.publish and c.right_ml == 0.016
    assert not got[2, "pericardial_effusion"].publish
    d = got[3, "pleural_effusion"]
    assert (d.left_ml, d.right_ml, d.indeterminate_ml) == (0.0, 0.0, 0.128) and not d.publish


def test_organs_take_the_measured_part_of_a_kidney(spark, volumes):
    level = lambda k: box(k, "L3", 30, 2, z=30) + box(k, "L4", 30, 2, z=20)
    rows = level(0) + box(0, "k", 10, 4, 40, z=40) + box(0, "k", 20, 1, 400, z=50)  # a kidney and a fragment
    rows += level(2) + box(2, "k", 10, 4, 40, z=5)  # in the pelvis alone: indeterminate
    rows += level(4) + box(4, "k", 10, 4, 40, z=40)  # a child
    v = spark.createDataFrame(rows, V).repartition(3)
    p = spark.createDataFrame([(0, False, 40), (2, False, 40), (4, False, 9)], "study long, contrast boolean, age int")
    t = {"voxels": v, "volumes": volumes, "patients": p, "expected": v.select("study", "mask").distinct()}
    cfg = {"kidneys": ["k", "o"], "l3": "L3", "l4": "L4", "least_cm3": 0.01}
    alerts = {"alerts": {"k": "kidney"}}
    plain = {r.study: r for r in metrics.organs(t, alerts).where("mask = 'k'").collect()}
    assert {k: r.alert for k, r in plain.items()} == {0: "small_kidney", 2: "small_kidney", 4: None} and plain[0].hu > 40
    judged = {r.study: r for r in metrics.organs(t | {"kidneys": renal.kidneys(t, cfg)}, alerts).where("mask = 'k'").collect()}
    assert {k: r.alert for k, r in judged.items()} == {0: "small_kidney", 2: None, 4: None}
    assert judged[0].hu == 40.0 and judged[0].cm3 == 0.064


def test_stones_by_study_and_first_studies(spark):
    rows = box(1, "r", 5, 3, 300) + box(1, "r", 20, 2, 300) + box(1, "l", 40, 2, 300) + box(2, "l", 40, 2, 20) + box(3, "r", 40, 2, 300)
    t = {"voxels": spark.createDataFrame(rows, V)}
    cfg = {"kidneys": ["r", "l"], "spacing": (1.0, 1.0, 1.0)}
    got = {r.study: r for r in metrics.stone_summary(metrics.kidney_stone(t, cfg), t["voxels"], "r", "l").collect()}
    assert [(r.right_stones, r.left_stones, r.total_stones, r.has_stones, r.largest_side) for r in (got[1], got[2], got[3])] == [(2, 1, 3, True, "r"), (0, 0, 0, False, None), (1, 0, 1, True, "r")]
    assert abs(got[1].largest_mm - 2.0) < 1.5
    some = metrics.recalculate(["kidney_stone"], t, {"kidney_stone": cfg}, studies=F.col("study") > 1, first=2)["kidney_stone"]
    assert {r.study for r in some.collect()} == {3}
