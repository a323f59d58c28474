"""Equivalent series, gaps, fan-out and job graphs on small cases, each against the rule said in plain Python."""

import math
import random

import pytest

from voxelweave.operators import evidence, queues, series

RECON = "study long, uid string, modality string, phase string, frame string, acquisition string, acquired_at string, orientation array<double>, derived boolean, low_mm double, high_mm double"


def tilted(degrees):
    a = math.radians(degrees)
    return [1.0, 0.0, 0.0, 0.0, math.cos(a), math.sin(a)]


def judged(a, b):
    """Conflict or evidence of two series."""
    why, said = [], lambda x: x if x not in (None, "") else None
    if a["modality"] != b["modality"]:
        return False, "modality_conflict"
    for name, conflict, same in (("frame", "frame_of_reference_conflict", "same_frame_of_reference"), ("phase", "contrast_phase_conflict", "same_contrast_phase"), ("acquisition", "acquisition_number_conflict", "same_acquisition_number")):
        x, y = said(a[name]), said(b[name])
        if name == "phase":
            x, y = x or "unknown", y or "unknown"
            if x != y and "unknown" not in (x, y):
                return False, conflict
            if x == y:
                why.append(same)
        elif x and y:
            if x != y:
                return False, conflict
            why.append(same)
    if a["acquired_at"] and b["acquired_at"]:
        if abs(int(a["acquired_at"][8:10]) * 3600 + int(a["acquired_at"][10:12]) * 60 + int(a["acquired_at"][12:14]) - int(b["acquired_at"][8:10]) * 3600 - int(b["acquired_at"][10:12]) * 60 - int(b["acquired_at"][12:14])) > 30:
            return False, "acquisition_time_conflict"
        why.append("acquisition_time_proximity")
    ends = [a["low_mm"], a["high_mm"], b["low_mm"], b["high_mm"]]
    if None not in ends:
        (l1, h1), (l2, h2) = sorted(ends[:2]), sorted(ends[2:])
        if min(h1 - l1, h2 - l2) > 0:
            if max(0, min(h1, h2) - max(l1, l2)) / min(h1 - l1, h2 - l2) < 0.8:
                return False, "insufficient_spatial_overlap"
            why.append("spatial_overlap")
    if a["orientation"] and b["orientation"] and not (a["derived"] or b["derived"]):
        t = [math.degrees(math.atan2(x["orientation"][5], x["orientation"][4])) for x in (a, b)]
        if abs(t[0] - t[1]) > 5:
            return False, "orientation_conflict"
        why.append("parallel_orientation")
    if {"same_acquisition_number", "same_frame_of_reference"} <= set(why) or {"acquisition_time_proximity", "spatial_overlap"} <= set(why):
        return True, ",".join(why)
    return False, "insufficient_equivalence_evidence"


def test_equivalence_and_groups(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(160):
        rows.append({"study": k // 40, "uid": f"u{k:03d}", "modality": rnd.choice(["CT"] * 9 + ["MR"]), "phase": rnd.choice([None, "", "unknown", "native", "native", "venous"]), "frame": rnd.choice([None, "", "f", "f", "g"]), "acquisition": rnd.choice([None, "", "1", "1", "2"]), "acquired_at": rnd.choice([None, "", *[f"202401021000{s:02d}.25" for s in (0, 10, 29, 31, 45)]]), "orientation": rnd.choice([None, tilted(0), tilted(4), tilted(8)]), "derived": rnd.random() < 0.1, "low_mm": rnd.choice([None, 0.0, 3.0, 30.0]), "high_mm": rnd.choice([20.0, 21.0, 3.0])})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], RECON).repartition(4)
    want = {(a["study"], a["uid"], b["uid"]): judged(a, b) for a in rows for b in rows if a["study"] == b["study"] and a["uid"] < b["uid"]}
    got = {(r.study, r.left_uid, r.right_uid): (r.equivalent, r.reasons) for r in series.equivalence(df, "study", "uid").collect()}
    assert got == want
    assert len({x[1] for x in want.values() if not x[0]}) == 8
    pairs = series.equivalent_pairs(df, "study", "uid")
    assert {(r.study, r.left_uid, r.right_uid): (True, r.reasons) for r in pairs.collect()} == {k: v for k, v in want.items() if v[0]}
    leaders, lead = {}, {}
    for r in rows:
        mine = [x for x in leaders.setdefault(r["study"], []) if want[(r["study"], x, r["uid"])][0]]
        lead[r["uid"]] = mine[0] if mine else r["uid"]
        if not mine:
            leaders[r["study"]].append(r["uid"])
    assert {r.uid: r.leader for r in series.group_series(df, pairs, "study", "uid").collect()} == lead


def test_gaps_need_parallel_slices_and_an_orientation(spark):
    rows = [(1, k, f, tilted(d) if d is not None else None, 100.0 * k, 100.0 * k + 10) for k, f, d in ((0, "f", 0), (1, "f", 4), (2, "", 9), (3, "g", 0), (4, None, None))]
    df = spark.createDataFrame(rows, "study long, acquisition long, frame string, orientation array<double>, low_mm double, high_mm double")
    from pyspark.sql import functions as F

    got = {(r.left, r.right) for r in evidence.extent_gaps(df, F.lit(None).cast("double")).collect()}
    assert got == {(0, 1), (1, 2)}


DESTINATIONS = "name string, accepts array<string>, enabled boolean, ordinal int, host string, port int, url string, method string"


def test_every_subscriber_gets_the_event_once(spark):
    d = [("a", ["x", " y "], True, 0, "h0", 1, "u0", None), ("b", None, True, 1, "h1", 2, "u1", "post"), ("a", ["x", "z"], True, 2, "h2", 3, "u2", "POST"), ("c", ["x"], False, 3, "h3", 4, "u3", "GET"), ("d", ["x", "x"], None, 4, "", 5, "", "PUT"), (" ", ["x"], True, 5, "h5", 6, "u5", ""), ("e", [], True, 6, "h6", 0, "u6", "POST")]
    dest = spark.createDataFrame(d, DESTINATIONS)
    ev = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w"), (5, None)], "event long, kind string")
    got = {(r.event, r.destination, r.url) for r in queues.fanout_events(ev, dest, "kind", "event").collect()}
    assert got == {(1, "a", "u0"), (2, "a", "u0"), (3, "a", "u2")} | {(k, "b", "u1") for k in range(1, 6)}
    assert {r.name for r in queues.unsupported_methods(dest).collect()} == {"d"}
    art = spark.createDataFrame([(1, 7, "p", "z"), (2, 7, "p", "x"), (3, 7, "", "x"), (4, 7, "q", None), (5, 8, "p", "x")], "n long, case_id long, path string, kind string")
    sent = {(r.case_id, r.path, r.destination, r.kind, r.host) for r in queues.fanout(art, dest, "kind", "case_id", "path", "n", ["host", "port"]).collect()}
    assert sent == {(7, "p", "a", "z", "h2"), (7, "p", "b", "z", "h1"), (7, "q", "b", "secondary_capture", "h1"), (8, "p", "a", "x", "h0"), (8, "p", "b", "x", "h1")}


def pruned(jobs, needs, failed):
    """Pass after pass over the jobs in their order, as long as one goes."""
    left, out = {j: sorted(needs.get(j, ())) for j in jobs}, {}
    for j in jobs:
        if j in failed:
            out[j] = ("inventory_requirements_not_met", None, failed[j])
            del left[j]
    changed = True
    while changed:
        changed = False
        for j in list(left):
            missing = [n for n in left[j] if n not in left]
            if missing:
                out[j] = ("dependency_not_selected", ",".join(missing), None)
                del left[j]
                changed = True
    return {j: (j not in out, *out.get(j, (None, None, None))) for j in jobs}


@pytest.mark.parametrize("seed", range(3))
def test_pruning_goes_pass_by_pass(spark, seed):
    rnd = random.Random(seed)
    jobs = [f"k{x}" for x in rnd.sample(range(100), 40)]
    needs = {j: set(rnd.sample(jobs + ["gone1", "gone2"], rnd.choice([0, 1, 1, 2]))) - {j} for j in jobs}
    failed = {j: "a,b" for j in rnd.sample(jobs, 3)}
    j = spark.createDataFrame([(x, k) for k, x in enumerate(jobs)], "job string, place long")
    n = spark.createDataFrame([(a, b) for a, bs in needs.items() for b in bs] + [(jobs[0], None)], "job string, need string")
    f = spark.createDataFrame([(x, ["b", "a"]) for x in failed], "job string, failed array<string>")
    got = {r.job: (r.stays, r.reason, r.missing_needs, r.failed) for r in evidence.job_prune(j, n, f).collect()}
    assert got == pruned(jobs, needs, failed)


def test_rounds_are_logarithmic_in_depth(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")
    rounds, plain = [], evidence.cut
    monkeypatch.setattr(evidence, "cut", lambda df: rounds.append(1) or plain(df))
    got = {r.node for r in evidence.reachable(edges, spark.createDataFrame([(10,)], "n long"), "a", "b").collect()}
    assert got == set(range(10, 51)) and len(rounds) - 1 <= 8


def test_findings_of_a_graph(spark):
    needs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "x"), ("d", "d"), ("e", "f"), ("f", "e"), ("g", "e"), ("h", None), ("i", "a")]
    got = {tuple(r) for r in evidence.job_findings(spark.createDataFrame([(c,) for c in "abcdefghi"], "job string"), spark.createDataFrame(needs, "job string, need string")).collect()}
    assert got == {("missing_need", "c", "x"), ("self_need", "d", "d"), ("cycle", "b", "b"), ("cycle", "c", "b"), ("cycle", "e", "e"), ("cycle", "f", "e")}
    none = spark.createDataFrame([], "job string, need string")
    assert evidence.job_findings(spark.createDataFrame([("a",)], "job string"), none).count() == 0


def test_requested_automatic_and_needed_jobs(spark):
    jobs = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", None), ("e", False)], "job string, automatic boolean")
    needs = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "a")], "job string, need string")
    asked = spark.createDataFrame([("a",), ("zz",)], "job string")
    assert {tuple(r) for r in evidence.resolved_jobs(jobs, needs, asked).collect()} == {("a", "requested"), ("b", "needed"), ("c", "automatic"), ("d", "needed")}
    assert [r.job for r in evidence.unknown_jobs(jobs, asked).collect()] == ["zz"]
