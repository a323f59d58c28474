"""Studies on three grids in one job, held against three jobs of one grid each."""

import random

import pytest
from pyspark.sql import functions as F

from voxelweave.operators import cases, components, masks, metrics, morphology, shapes, vertebrae
from voxelweave.operators.grids import GRID, on_grid, rounds_of

#: nx, ny, nz, sx, sy, sz by study % 3
GRIDS = [(40, 40, 30, 1.0, 1.0, 1.0), (24, 30, 18, 0.7, 0.9, 2.5), (30, 26, 22, 2.0, 1.4, 0.6)]


@pytest.fixture(scope="module")
def frames(spark):
    """Solid boxes and balls of some masks in six studies, with holes and specks, that fit into the smallest grid."""
    rnd = random.Random(11)
    rows = []
    for study in range(6):
        for k, mask in enumerate(["m0", "m1", "m2", "m3"]):
            cx, cy, cz = 6 + rnd.randint(0, 6), 7 + rnd.randint(0, 10), 6 + rnd.randint(0, 4)
            r = 5 - k % 2
            cells = {(x, y, z) for x in range(cx - r, cx + r + 1) for y in range(cy - r, cy + r + 1) for z in range(max(0, cz - r), cz + r + 1) if (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 <= r * r + 2}
            cells -= {(cx + 1, cy, cz), (cx, cy + 2, cz + 1)}
            cells |= {(22, 2 + k, 3), (23, 2 + k, 3)}
            rows += [(study, mask, x, y, z, (x * 31 + y * 17 + z * 7) % 260 - 20) for x, y, z in cells if 0 <= x < 24 and 0 <= y < 26 and 0 <= z < 18]
    v = spark.createDataFrame(rows, "study long, mask string, x int, y int, z int, hu int").cache()
    volumes = spark.createDataFrame([(s, *GRIDS[s % 3]) for s in range(6)], "study long, nx int, ny int, nz int, sx double, sy double, sz double").cache()
    return v, volumes


def rows_of(df):
    return sorted(tuple("-" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.select(sorted(df.columns)).collect())


KEY = ["study", "mask"]
OWN = [*KEY, *GRID]


def expected(v):
    return v.select("study").distinct().select("study", F.explode(F.array(*[F.lit(f"m{k}") for k in range(5)])).alias("mask"))


OPERATORS = {
    "mask_status": lambda v, g, s, k: masks.mask_status(v, g(expected(v)), s["dims"], s["cm3"], k),
    "anatomy_states": lambda v, g, s, k: masks.anatomy_states(v, g(expected(v)), s["dims"], k),
    "slice_area": lambda v, g, s, k: masks.slice_area(v, s["cm2"], k),
    "erode_mm": lambda v, g, s, k: morphology.erode_mm(v, 2.1, s["spacing"], k),
    "background_distance": lambda v, g, s, k: morphology.background_distance(v, 3.0, s["spacing"], k),
    "erode": lambda v, g, s, k: morphology.erode(v, rounds_of(2.0, s["spacing"]), group=k),
    "dilate": lambda v, g, s, k: morphology.dilate(v, rounds_of(3.0, s["spacing"]), s["dims"], k),
    "dilate_disc": lambda v, g, s, k: morphology.dilate_disc(v, 2.5, s["spacing"], k),
    "erosion_profile": lambda v, g, s, k: morphology.erosion_profile(v, "hu", [0, 1, 2, 3], s["spacing"], k),
    "nearest": lambda v, g, s, k: morphology.nearest(v.where("mask = 'm0'").drop("mask"), v.where("mask = 'm1'").drop("mask"), s["spacing"], k[:1] + k[2:], 99.0),
    "feret_axial": lambda v, g, s, k: components.feret_axial(g(components.label_runs(v.drop(*GRID))), s["spacing"], k).groupBy(*KEY).agg(F.max("diameter_mm").alias("d"), F.count("*").alias("n")),
    "pca_extent": lambda v, g, s, k: shapes.pca_extent(v, k, s["spacing"]).select(*KEY, *[F.round(f"extent_{i}", 6).alias(f"e{i}") for i in (1, 2, 3)]),
    "infer_axes": lambda v, g, s, k: shapes.infer_axes(masks.bounds(v, k), s["spacing"]),
    "isolate_body": lambda v, g, s, k: vertebrae.isolate_body(v, s["spacing"], k),
    "parasagittal_heights": lambda v, g, s, k: vertebrae.parasagittal_heights(v, s["spacing"], k),
    "height_screen": lambda v, g, s, k: vertebrae.height_screen(v, s["spacing"], k).select(*KEY, "status", "n_voxels", F.round("min_ratio", 3).alias("r")),
    "vertebra_measure": lambda v, g, s, k: vertebrae.vertebra_measure(v, s["spacing"], s["dims"][2], (0, 1, 2), k),
    "l1_sagittal_roi": lambda v, g, s, k: vertebrae.l1_sagittal_roi(v, s["spacing"], k, erosion_mm=1.5, radius_mm=3.0),
    "ellipse_roi": lambda v, g, s, k: cases.ellipse_roi(v, v.groupBy(*k).agg(F.min("z").alias("z"), F.avg("x").alias("cx"), F.avg("y").alias("cy")), k, 4.0, 3.0, s["spacing"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_three_grids_in_one_job(frames, name):
    v, volumes = frames
    own = {"spacing": None, "dims": tuple(F.col(d) for d in GRID[:3]), "cm3": F.col("sx") * F.col("sy") * F.col("sz") / 1000.0, "cm2": F.col("sx") * F.col("sy") / 100.0}
    got = rows_of(OPERATORS[name](on_grid(v, volumes), lambda d: on_grid(d, volumes), own, OWN).drop(*GRID))
    want = []
    for k, (nx, ny, nz, sx, sy, sz) in enumerate(GRIDS):
        one = {"spacing": (sx, sy, sz), "dims": (nx, ny, nz), "cm3": sx * sy * sz / 1000.0, "cm2": sx * sy / 100.0}
        want += rows_of(OPERATORS[name](v.where(F.col("study") % 3 == k), lambda d: d, one, KEY))
    assert got and got == sorted(want)


METRICS = {
    "l3_muscle": (metrics.l3_muscle, {"level": "m0", "muscle": "m1", "arms": ["m2"], "margin_mm": 2.0, "half_window_mm": 4.0}),
    "vat_sat": (metrics.vat_sat, {"level": "m0", "visceral": "m1", "subcutaneous": "m2"}),
    "organs": (metrics.organs, {"alerts": {"m0": "kidney"}}),
    "brain": (metrics.brain, {"mask": "m1"}),
    "liver_lesions": (metrics.liver_lesions, {"mask": "m1", "support": ["m0", "m2"]}),
    "l1_volumetric": (metrics.l1_volumetric, {"mask": "m1", "mm": 2.0}),
    "kidney_stone": (metrics.kidney_stone, {"kidneys": ["m0", "m1"], "least_mm3": 4.0}),
    "body_fat": (metrics.body_fat, {"masks": ["m0", "m1"]}),
    "liver_segments": (metrics.liver_segments, {}),
    "l1_hu": (metrics.l1_hu, {"mask": "m1", "erosion_mm": 1.5, "radius_mm": 3.0}),
    "fracture": (metrics.fracture, {"levels": ["m0", "m1", "m2"]}),
    "effusion": (metrics.effusion, {"mask": "m2", "left": "m0", "right": "m1", "least_ml": 0.1}),
}


@pytest.mark.parametrize("name", sorted(METRICS))
def test_metrics_on_three_grids(frames, name):
    v, volumes = frames
    run, cfg = METRICS[name]

    def tables(x):
        s = x.select("study").distinct()
        patients = s.select("study", (F.col("study") % 2 == 1).alias("contrast"), F.lit(1.7).alias("height_m"), F.lit(70.0).alias("weight_kg"), F.lit(120.0).alias("kvp"), F.lit("CT").alias("modality"), F.lit(1.0).alias("thickness_mm"))
        levels = s.select("study", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ordinal")).withColumn("center", F.col("ordinal") * 4.0 + 2)
        return {"voxels": x, "expected": expected(x), "patients": patients, "levels": levels}

    flat = lambda df: rows_of(df.withColumn("profile", F.to_json("profile")) if "profile" in df.columns else df)
    got = run(tables(v) | {"volumes": volumes}, cfg)
    assert not set(got.columns) & set(GRID)
    want = []
    for k, (nx, ny, nz, sx, sy, sz) in enumerate(GRIDS):
        one = {"spacing": (sx, sy, sz), "dims": (nx, ny, nz), "voxel_cm3": sx * sy * sz / 1000.0, "voxel_ml": sx * sy * sz / 1000.0, "pixel_cm2": sx * sy / 100.0, "n_slices": nz}
        want += flat(run(tables(v.where(F.col("study") % 3 == k)), cfg | one))
    assert want and flat(got) == sorted(want)
