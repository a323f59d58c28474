"""The voxel grid of each study: numbers that hold for a whole job, or columns that go with the voxels of each study.

A volume has its size (nx, ny, nz), the distance of its voxels in mm (sx, sy, sz), and its affine, row by row. Operators
take `spacing` as three numbers, or as None for the columns sx, sy and sz; these belong to the group columns then, so that
they are at hand wherever a group's voxels are. Sizes and volumes are numbers or columns alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.session import small_side

DIMS, SPACING = ["nx", "ny", "nz"], ["sx", "sy", "sz"]
GRID = [*DIMS, *SPACING]
Spacing = tuple[float, float, float] | None


def steps(spacing: Spacing) -> tuple[Column, ...]:
    """The distance of neighbour voxels along x, y and z as columns."""
    return tuple(F.col(s) for s in SPACING) if spacing is None else tuple(F.lit(float(s)) for s in spacing)


def rounds_of(mm: float, spacing: Spacing) -> int | Column:
    """How many rounds of a neighbourhood stand for a distance: by the shortest step, one at least."""
    if spacing is not None:
        return max(1, round(mm / max(min(spacing), 1e-6)))
    return F.greatest(F.lit(1), F.bround(mm / F.greatest(F.least(*steps(None)), F.lit(1e-6))).cast("int"))


def within(mm: float, spacing: Spacing) -> tuple[int | Column, ...]:
    """The number of steps along each axis that a distance has."""
    return tuple(int(mm // s) for s in spacing) if spacing is not None else tuple(F.floor(mm / s).cast("int") for s in steps(None))


def on_grid(frame: DataFrame, volumes: DataFrame, key: str = "study") -> DataFrame:
    """The rows with the grid of their study; those of a study without a volume go, as nothing can be measured there."""
    return frame.join(small_side(volumes.select(key, *GRID)), key)


@dataclass(frozen=True)
class Grid:
    """What a composite metric knows of its grid: its settings, or, where its tables have `volumes`, each study's own."""

    volumes: DataFrame | None
    cfg: dict

    @classmethod
    def of(cls, tables: dict[str, DataFrame], cfg: dict) -> Grid:
        return cls(tables.get("volumes"), cfg)

    @property
    def keys(self) -> list[str]:
        """The columns that go with a group."""
        return [] if self.volumes is None else GRID

    @property
    def spacing(self) -> Spacing:
        return None if self.volumes is not None else self.cfg["spacing"]

    def on(self, frame: DataFrame) -> DataFrame:
        """The frame with the grid's columns, if there are such."""
        return frame if self.volumes is None else on_grid(frame.drop(*GRID), self.volumes)

    def _cubic(self, setting: str, per: float) -> Column:
        if self.volumes is None:
            return F.lit(self.cfg[setting])
        x, y, z = steps(None)
        return x * y * z / per

    @property
    def cm3(self) -> Column:
        return self._cubic("voxel_cm3", 1000.0)

    @property
    def ml(self) -> Column:
        return self._cubic("voxel_ml", 1000.0)

    @property
    def cm2(self) -> Column:
        return F.lit(self.cfg["pixel_cm2"]) if self.volumes is None else F.col("sx") * F.col("sy") / 100.0

    @property
    def dims(self) -> tuple:
        return self.cfg["dims"] if self.volumes is None else tuple(F.col(d) for d in DIMS)

    @property
    def n_slices(self) -> int | Column:
        return self.cfg["n_slices"] if self.volumes is None else F.col("nz")
