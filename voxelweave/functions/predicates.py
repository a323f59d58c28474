"""Predicates and ordered rejection reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelweave.functions import scalars as S

# Words that tell a body region, a derived or a scout series.
ABDOMEN = ["abdome", "abdomen", "abdominal"]
CHEST = ["torax", "thorax", "chest", "pulmao", "mediast"]
DERIVED = [" MIP", "MPR", "REFORMAT"]
LOCALIZER = ["LOCALIZER", "SCOUT", "TOPOGRAM", "SURVIEW"]


def first_reason(*rules: tuple[Column, Column | str]) -> Column:
    """The reason of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(test, F.lit(why) if isinstance(why, str) else why) for test, why in rules])


def reasons(*rules: tuple[Column, str]) -> Column:
    """The reasons of all rules that hold, in their order."""
    return F.filter(F.array(*[F.when(test, F.lit(why)) for test, why in rules]), lambda x: x.isNotNull())


def token_reason(text: Column, tokens: list[str], prefix: str, exact: bool = False) -> Column:
    """`prefix:token` of the first token in the text (or equal to it), else null."""
    hit = (lambda t: F.trim(text) == t) if exact else (lambda t: F.contains(text, F.lit(t)))
    return F.coalesce(*[F.when(hit(t), F.lit(f"{prefix}:{t}")) for t in tokens], F.lit(None).cast("string"))


def region_hint(description: Column) -> Column:
    d = S.text_fold(description)
    return F.when(S.any_of(d, ABDOMEN), "abdomen").when(S.any_of(d, CHEST), "chest").otherwise("unknown")


def kind_flags(description: Column, image_type: Column) -> Column:
    """struct(derived, localizer) of a series from its description and image type."""
    types = F.transform(image_type, F.upper)
    text = F.concat_ws(" ", F.upper(description), F.array_join(types, " "))
    derived = F.array_contains(types, "DERIVED") | S.any_of(text, DERIVED)
    return F.struct(derived.alias("derived"), S.any_of(text, LOCALIZER).alias("localizer"))


def profile_gate(modality: Column, phase: Column, wanted: str, phases: list[str]) -> Column:
    """Whether a profile takes a series: its modality, and its phase or, where plain scans are wanted, any contrast phase."""
    p = S.phase_normalize(phase)
    allowed = p.isin([*phases, "portal_venous"] if "native" in phases else phases)
    return (modality == wanted) & (allowed | (S.is_contrast(phase) if "native" in phases else F.lit(False)))


def window_class(center: Column, width: Column, soft: tuple[float, float, float, float], lung: tuple[float, float]) -> Column:
    """soft_tissue, lung, other or unknown by display window."""
    return (
        F.when(center.isNull() | width.isNull(), "unknown")
        .when(center.between(soft[0], soft[1]) & width.between(soft[2], soft[3]), "soft_tissue")
        .when((center <= lung[0]) & (width >= lung[1]), "lung")
        .otherwise("other")
    )


def technique_context(modality: Column, kvp: Column) -> Column:
    """struct(modality, kvp) of a scan in normal form."""
    return F.struct(F.coalesce(F.upper(F.trim(modality)), F.lit("NONE")).alias("modality"), S.number(kvp).alias("kvp"))


def volume_alert(organ: Column, cm3: Column, age: Column, indeterminate: Column) -> Column:
    """Alert of an organ's volume: liver over 1800, spleen over 400, kidney under 100 cm3 from the age of 16 on."""
    kidney = (organ == "kidney") & (cm3 < 100) & (F.coalesce(age, F.lit(99)) >= 16) & ~F.coalesce(indeterminate, F.lit(False))
    return F.when((organ == "liver") & (cm3 > 1800), "enlarged_liver").when((organ == "spleen") & (cm3 > 400), "enlarged_spleen").when(kidney, "small_kidney")


def qc_convertible(n_files: Column, primary: Column, modality: Column, derived: Column, localizer: Column) -> Column:
    """Whether a series is converted for quality control: at least two files, and a primary input, no CT, or neither derived nor localizer."""
    source = ~F.coalesce(derived, F.lit(False)) & ~F.coalesce(localizer, F.lit(False))
    return F.coalesce(n_files >= 2, F.lit(False)) & (F.coalesce(primary, F.lit(False)) | (F.coalesce(F.upper(modality), F.lit("")) != "CT") | source)
