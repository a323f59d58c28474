"""From instance headers to series geometry, and from candidate series to the best one of each study with an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.functions import predicates as P
from voxelweave.functions import scalars as S
from voxelweave.session import config_rows


def series_geometry(instances: DataFrame, series: str, position: str, thickness: str, spacing: str) -> DataFrame:
    """Per series: images, median positive thickness and spacing, gap and coverage of its distinct positions, confidence.

    The gap is the median of the positive steps between sorted positions. Without two positions the coverage is
    estimated as (images - 1) times the spacing.
    """
    base = instances.groupBy(series).agg(
        F.count("*").alias("n_images"), F.percentile(S.positive(F.col(thickness)), 0.5).alias("thickness_mm"), F.percentile(S.positive(F.col(spacing)), 0.5).alias("spacing_mm"),
        F.min(position).alias("low_mm"), F.max(position).alias("high_mm"), F.count_distinct(position).alias("n_positions"),
    )
    steps = instances.where(F.col(position).isNotNull()).select(series, F.round(position, 4).alias("_p")).distinct()
    steps = steps.withColumn("_g", F.col("_p") - F.lag("_p").over(W.partitionBy(series).orderBy("_p")))
    gaps = steps.where("_g > 1e-4").groupBy(series).agg(F.percentile("_g", 0.5).alias("z_spacing_mm"))
    both = base.join(gaps.hint("merge"), series, "left")
    known = F.col("n_positions") > 1
    guess = (F.col("n_images") - 1) * F.col("spacing_mm")
    return both.select(
        series, "n_images", "thickness_mm", "spacing_mm", "z_spacing_mm", F.when(known, F.col("high_mm") - F.col("low_mm")).otherwise(guess).alias("coverage_mm"),
        F.when(known, "position").when(guess.isNotNull(), "estimated").otherwise("none").alias("confidence"),
    )


def is_4d(instances: DataFrame, series: str, position: str) -> DataFrame:
    """Whether a position of the series repeats."""
    return instances.groupBy(series).agg((F.count(position) > F.count_distinct(position)).alias("is_4d"))


def split_min_images(counted: DataFrame, n: str, least: int) -> DataFrame:
    """The series with a discard reason where they have too few images, null where they stay."""
    return counted.withColumn("reason", F.when(F.col(n) < least, F.lit(f"below_min_images_{least}")))


def study_biometrics(instances: DataFrame, study: str, value: str, order: list[str]) -> DataFrame:
    """The first known value of each study in a fixed order."""
    return instances.where(F.col(value).isNotNull()).groupBy(study).agg(F.min_by(value, F.struct(*order)).alias(value))


def reject(df: DataFrame, modality: str, least_slices: int, description: list[str], kernel_contains: list[str], kernel_exact: list[str], phases: list[str]) -> DataFrame:
    """Candidates with phase rank and fallback, or with the first reason that rejects them (column reason)."""
    phase = S.phase_normalize(F.col("phase"))
    rank = F.coalesce(*[F.when(phase == p, F.lit(i)) for i, p in enumerate(phases)], F.when(S.is_contrast(F.col("phase")), F.lit(len(phases))) if "native" in phases else F.lit(None))
    why = F.coalesce(
        F.when(F.col("modality") != modality, F.concat(F.lit("modality_mismatch:"), F.col("modality"))),
        F.when(F.col("slice_count") < least_slices, F.concat(F.lit("below_min_slices:"), F.col("slice_count").cast("string"))),
        P.token_reason(S.text_fold(F.col("description")), description, "description_rejected"),
        P.token_reason(S.text_fold(F.col("kernel")), kernel_contains, "kernel_rejected_contains"),
        P.token_reason(S.text_fold(F.col("kernel")), kernel_exact, "kernel_rejected_exact", exact=True),
        F.when(rank.isNull(), F.concat(F.lit("phase_not_allowed:"), phase)),
    )
    return df.withColumns({"phase_rank": rank, "reason": why})


def hint_rules(df: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """Sum of the weights of the rules whose maker matches (empty matches all) and whose token is in the text.

    `rules` (maker_token, token, weight) is a configuration table of bounded size, so each row tries all rules as expressions.
    """
    hits = [((F.lit(r.maker_token == "") | F.contains("maker", F.lit(r.maker_token))) & F.contains("text", F.lit(r.token)), r.weight) for r in config_rows(rules) if r.token is not None]
    weight = sum((F.when(hit, F.lit(w)).otherwise(0) for hit, w in hits if w is not None), F.lit(0)).cast("bigint")
    n = sum((F.when(hit, 1).otherwise(0) for hit, _ in hits), F.lit(0)).cast("bigint")
    return df.groupBy(key).agg(F.coalesce(F.sum(weight), F.lit(0).cast("bigint")).alias("score"), F.sum(n).alias("n_rules"))


def coverage_tier(df: DataFrame, study: str, rank: str, coverage: str, ratio: float = 0.92, mm: float = 50.0) -> DataFrame:
    """Tier 0 within the equivalent coverage of the study's best in its phase rank, 1 below, 2 without geometry."""
    best = F.max(coverage).over(W.partitionBy(study, rank))
    floor = F.greatest(best * ratio, best - mm)
    return df.withColumn("tier", F.when(F.col(coverage).isNull() | best.isNull(), 2).when(F.col(coverage) >= floor, 0).otherwise(1))


def selection_order(preference: Column) -> list[Column]:
    """The ten keys of the ranking; series numbers compare as text."""
    thin = F.when(F.col("tier") == 0, F.col("effective_mm"))
    return [
        F.col("phase_rank"), F.col("coverage_mm").isNull(), F.col("tier"), thin.asc_nulls_last(), preference, F.coalesce("coverage_mm", F.lit(0.0)).desc(),
        F.coalesce("phase_detected", F.lit(False)).desc(), F.coalesce("probability", F.lit(0.0)).desc(), F.col("slice_count").desc(), F.col("series_number"),
    ]


def rank_series(kept: DataFrame, study: str = "study") -> DataFrame:
    """Candidates with their place in their study."""
    c = kept.withColumn("coverage_mm", S.positive(F.col("coverage_mm")))
    c = c.withColumn("effective_mm", S.effective_thickness(F.col("z_spacing_mm"), F.lit(None).cast("double"), F.col("thickness_mm")))
    c = coverage_tier(c, study, "phase_rank", "coverage_mm").withColumn("preference", -S.reconstruction_preference(F.col("kernel")))
    return c.withColumn("place", F.row_number().over(W.partitionBy(study).orderBy(*selection_order(F.col("preference")))))


def follow_up_choice(ranked: DataFrame, previous: DataFrame, study: str, uid: str, region: Column, wanted: str) -> DataFrame:
    """The first choice, or where that is the series processed before the best other one, of the wanted region if there is one."""
    r = ranked.join(previous.hint("merge"), study, "left").withColumn("_again", F.coalesce(F.col(uid) == F.col("previous_uid"), F.lit(False)))
    w = W.partitionBy(study)
    r = r.withColumn("_first_again", F.bool_or((F.col("place") == 1) & F.col("_again")).over(w)).withColumn("_n", F.count("*").over(w))
    order = [F.when(F.col("_first_again"), F.col("_again").cast("int")).otherwise(0), F.when(F.col("_first_again") & (region == wanted), 0).otherwise(1), F.col("place")]
    return r.withColumn("_c", F.row_number().over(w.orderBy(*order))).where("_c = 1").drop("_again", "_first_again", "_n", "_c", "previous_uid")


def overlap_ratio(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Overlap of two intervals over the shorter one; null if one is unknown or has no length."""
    both = F.greatest(F.lit(0.0), F.least(a_high, b_high) - F.greatest(a_low, b_low))
    return F.when(a_low.isNotNull() & a_high.isNotNull() & b_low.isNotNull() & b_high.isNotNull(), F.try_divide(both, F.nullif(F.least(a_high - a_low, b_high - b_low), F.lit(0.0))))


def _facts(df: DataFrame, study: str, uid: str) -> DataFrame:
    """What equivalence needs of a series, each worked out once: empty texts are null, times are seconds."""
    text = lambda n: F.nullif(F.col(n), F.lit("")).alias(n)
    known = F.col("low_mm").isNotNull() & F.col("high_mm").isNotNull()
    return df.select(
        study, uid, "modality", text("frame"), text("acquisition"), F.coalesce(F.nullif("phase", F.lit("")), F.lit("unknown")).alias("phase"), S.epoch_s(S.parse_header_time(F.col("acquired_at"))).alias("t"),
        F.when(~F.coalesce("derived", F.lit(False)), S.slice_normal(F.col("orientation"))).alias("normal"), F.when(known, F.least("low_mm", "high_mm")).alias("low"), F.when(known, F.greatest("low_mm", "high_mm")).alias("high"),
    )


def _judged(pairs: DataFrame, study: str, uid: str, least_overlap: float, seconds: float, degrees: float) -> DataFrame:
    """Pairs of series (a, b) with whether they show the same, and the evidence in its order or the first conflict.

    Two series with one acquisition number in one frame show the same, or two close in time that overlap in space, unless
    something speaks against it. What is null or empty is neither evidence nor conflict.
    """
    (fa, fb), (aa, ab), (pa, pb), (ta, tb), (na, nb) = ([F.col(f"{side}.{n}") for side in "ab"] for n in ("frame", "acquisition", "phase", "t", "normal"))
    cover = overlap_ratio(F.col("a.low"), F.col("a.high"), F.col("b.low"), F.col("b.high"))
    apart, angle = F.abs(ta - tb), S.angle_between(na, nb)
    pairs = pairs.withColumns({"_cover": cover, "_apart": apart, "_angle": angle})
    cover, apart, angle = F.col("_cover"), F.col("_apart"), F.col("_angle")
    is_ = lambda test: F.coalesce(test, F.lit(False))
    sure = is_((aa == ab) & (fa == fb)) | (is_(apart <= seconds) & cover.isNotNull())
    conflict = P.first_reason(
        (~F.col("a.modality").eqNullSafe(F.col("b.modality")), "modality_conflict"), (fa != fb, "frame_of_reference_conflict"),
        ((pa != "unknown") & (pb != "unknown") & (pa != pb), "contrast_phase_conflict"), (aa != ab, "acquisition_number_conflict"), (apart > seconds, "acquisition_time_conflict"),
        (cover < least_overlap, "insufficient_spatial_overlap"), (angle > degrees, "orientation_conflict"), (~sure, "insufficient_equivalence_evidence"),
    )
    why = P.reasons(
        (fa == fb, "same_frame_of_reference"), (pa == pb, "same_contrast_phase"), (aa == ab, "same_acquisition_number"),
        (apart <= seconds, "acquisition_time_proximity"), (cover.isNotNull(), "spatial_overlap"), (angle.isNotNull(), "parallel_orientation"),
    )
    return pairs.select(F.col(f"a.{study}").alias(study), F.col(f"a.{uid}").alias("left_uid"), F.col(f"b.{uid}").alias("right_uid"), conflict.isNull().alias("equivalent"), F.coalesce(conflict, F.array_join(why, ",")).alias("reasons"))


def equivalence(df: DataFrame, study: str, uid: str, least_overlap: float = 0.8, seconds: float = 30.0, degrees: float = 5.0) -> DataFrame:
    """Each two series of a study (a before b) with whether they show the same, and why or why not: the audit.

    df has modality, frame, phase, acquisition, acquired_at (header text), orientation (six cosines), derived, low_mm and
    high_mm. The audit lists all pairs of a study, of which series number in tens; equivalent_pairs() doesn't.
    """
    rows = _facts(df, study, uid)
    a, b = rows.alias("a"), rows.alias("b")
    p = a.join(b.hint("merge"), F.col(f"a.{study}") == F.col(f"b.{study}")).where(F.col(f"a.{uid}") < F.col(f"b.{uid}"))
    return _judged(p, study, uid, least_overlap, seconds, degrees)


def equivalent_pairs(df: DataFrame, study: str, uid: str, least_overlap: float = 0.8, seconds: float = 30.0, degrees: float = 5.0) -> DataFrame:
    """The pairs that show the same, with the evidence. Only series that can are compared: those with one acquisition number in
    one frame, and those in the same or a neighbour stretch of time; so a study of many series makes no square of them.
    """
    rows = _facts(df, study, uid)
    rows = rows.withColumn("_t", F.floor(F.col("t") / seconds))
    later = rows.withColumn("_t", F.explode(F.array(F.col("_t") - 1, F.col("_t"), F.col("_t") + 1)))
    named = rows.where("frame is not null and acquisition is not null")
    on = lambda *cols: [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (study, *cols)]
    found = []
    for left, right, cols in ((named, named, ("frame", "acquisition")), (rows, later, ("_t",))):
        p = left.alias("a").join(right.alias("b").hint("merge"), on(*cols)).where(F.col(f"a.{uid}") < F.col(f"b.{uid}"))
        found.append(_judged(p, study, uid, least_overlap, seconds, degrees).where("equivalent"))
    return found[0].union(found[1]).dropDuplicates([study, "left_uid", "right_uid"])


def group_series(df: DataFrame, pairs: DataFrame, study: str, uid: str) -> DataFrame:
    """Greedy groups: in order of uid a series joins the first group whose leader it is equivalent to, else leads one.

    The order matters, so each study is folded over its sorted series and the set of its equivalent pairs, inside the
    JVM; a study has tens of series.
    """
    links = pairs.where("equivalent").groupBy(study).agg(F.collect_set(F.concat_ws("|", "left_uid", "right_uid")).alias("_links"))
    rows = df.groupBy(study).agg(F.array_sort(F.collect_list(uid)).alias("_uids")).join(links.hint("merge"), study, "left")
    start = F.struct(F.array().cast("array<string>").alias("leaders"), F.array().cast("array<struct<uid:string,leader:string>>").alias("out"))

    def step(acc, u):
        mine = F.filter(acc["leaders"], lambda x: F.coalesce(F.array_contains(F.col("_links"), F.concat_ws("|", x, u)), F.lit(False)))
        leader = F.coalesce(F.get(mine, F.lit(0)), u)
        leaders = F.when(leader == u, F.concat(acc["leaders"], F.array(u))).otherwise(acc["leaders"])
        return F.struct(leaders.alias("leaders"), F.concat(acc["out"], F.array(F.struct(u.alias("uid"), leader.alias("leader")))).alias("out"))

    folded = rows.select(study, F.explode(F.aggregate("_uids", start, step)["out"]).alias("g"))
    return folded.select(study, F.col("g.uid").alias(uid), F.col("g.leader").alias("leader"))


def pick_representative(df: DataFrame, group: list[str]) -> DataFrame:
    """The best series of each acquisition: by coverage floor, spacing, reconstruction, coverage, slices and uid."""
    best = F.max(F.coalesce("coverage_mm", F.lit(0.0))).over(W.partitionBy(*group))
    cov = F.coalesce("coverage_mm", F.lit(0.0))
    mm = F.coalesce(F.nullif("z_spacing_mm", F.lit(0.0)), F.nullif("thickness_mm", F.lit(0.0)), F.lit(9999.0))
    order = [cov < F.greatest(best * 0.92, best - 50), mm, -S.reconstruction_preference(F.concat_ws(" ", "description", "kernel")), cov.desc(), F.col("slice_count").desc(), F.col("uid")]
    got = df.withColumn("_best", best)
    order[0] = cov < F.greatest(F.col("_best") * 0.92, F.col("_best") - 50)
    return got.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r", "_best")


def classify(df: DataFrame) -> DataFrame:
    """Volumetric, useful and segmentable flags of a series, ordered reasons and the first status."""
    k = P.kind_flags(F.col("description"), F.col("image_type"))
    volumetric = (F.col("slice_count") >= 2) & ~k["localizer"] & (F.col("confidence") != "none")
    fit = (F.col("modality") == "CT") & volumetric & ~k["derived"] & F.col("converted")
    why = P.reasons(
        (k["localizer"], "localizer"), (k["derived"], "derived_series"), (F.col("confidence") != "position", "incomplete_geometry"),
        (F.col("modality") == "MR", "no_configured_mr_segmenter"), (~F.col("modality").isin("CT", "MR"), "unsupported_modality"), (~F.col("converted"), "no_converted_volume"), (fit, "ct_compatible"),
    )
    return df.select("*", volumetric.alias("volumetric"), fit.alias("segmentable"), F.array_join(why, ",").alias("reasons"), F.when(fit, "segmentation_pending").otherwise("not_segmentable").alias("status"))


def join_converted(raw: DataFrame, converted: DataFrame, uid: str) -> DataFrame:
    """Raw series with the attributes of their converted one; those that were not converted have none, and converted is false."""
    there = converted.withColumn("converted", F.lit(True)).hint("merge")
    return raw.join(there, uid, "left").withColumn("converted", F.coalesce("converted", F.lit(False)))
