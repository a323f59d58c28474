"""Stencils and distances of sparse masks in small dense arrays, dealt out so that no task holds more than a tile or a slice.

A stencil gets each tile's voxels and those within its reach, by one shuffle, whatever the number of rounds. A distance
without a bound is separable: along z in columns of a tile, then within the slices that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from voxelweave.operators.grids import SPACING, Spacing

#: Edge of a tile in voxels, at least; a longer reach makes larger tiles, so a voxel goes to 27 tiles at most.
TILE = 32
Offset = tuple[int, int, int]
FAR = np.iinfo(np.int32).max


def sizes(reach: Offset) -> Offset:
    return tuple(max(TILE, r) for r in reach)


def dealt(voxels: DataFrame, reach: tuple[int | Column, ...]) -> DataFrame:
    """Each voxel once for every tile (_tx, _ty, _tz) that holds it or is within `reach` of it; a reach that is a column may differ by group."""
    for a, r in zip("xyz", reach):
        own = isinstance(r, Column)
        n = F.greatest(F.lit(TILE), r) if own else max(TILE, r)
        tile = lambda d, a=a, n=n: F.floor((F.col(a) + d) / n).cast("int")
        voxels = voxels.withColumn(f"_t{a}", F.explode(F.sequence(tile(-r), tile(r))) if own or r else tile(0))
    return voxels


def repeated(key: tuple[pa.Scalar, ...], n: int) -> list[pa.Array]:
    """The key's values as columns of n rows."""
    return [pa.repeat(k, n) if k.is_valid else pa.nulls(n, k.type) for k in key]


def spacing_of(group: list[str], key: tuple[pa.Scalar, ...]) -> tuple[float, ...]:
    """sx, sy and sz among the values of a key."""
    return tuple(key[group.index(s)].as_py() for s in SPACING)


def stencil(voxels: DataFrame, group: list[str], reach: tuple[int | Column, ...], work: Callable, value: str | None = None, spacing: Spacing = (1.0, 1.0, 1.0)) -> DataFrame:
    """The voxels that `work` leaves of each group, as group columns, x, y, z and maybe a value (double, NaN is null).

    work gets the occupied cells of a tile and its surroundings (bool, axes x, y, z), the reach and the spacing of its group,
    and returns the cells that are occupied afterwards, with their values if `value` names them; only a tile's own cells
    count. Repeated voxels count once.
    """
    flat = voxels.select(*group, "x", "y", "z")
    fields = flat.schema.fields + ([StructField(value, DoubleType())] if value else [])
    reaches = ["_rx", "_ry", "_rz"]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        reach = tuple(k.as_py() for k in key[-6:-3])
        size = sizes(reach)
        own = [k.as_py() * n for k, n in zip(key[-3:], size)]
        cells = np.zeros([n + 2 * r for n, r in zip(size, reach)], bool)
        cells[tuple(rows.column(a).to_numpy() - o + r for a, o, r in zip("xyz", own, reach))] = True
        got = work(cells, reach, spacing_of(group, key) if spacing is None else spacing)
        keep, of = got if value else (got, None)
        inner = tuple(slice(r, r + n) for n, r in zip(size, reach))
        at = np.nonzero(keep[inner])
        cols = repeated(key[:-6], len(at[0])) + [pa.array(i + o).cast(rows.schema.field(a).type) for i, o, a in zip(at, own, "xyz")]
        if value:
            cols.append(pa.array(of[inner][at], pa.float64(), from_pandas=True))
        return pa.Table.from_arrays(cols, [f.name for f in fields])

    each = flat.withColumns({n: r if isinstance(r, Column) else F.lit(r) for n, r in zip(reaches, reach)})
    each = dealt(each, tuple(F.col(n) if isinstance(r, Column) else r for n, r in zip(reaches, reach)))
    return each.groupBy(*group, *reaches, "_tx", "_ty", "_tz").applyInArrow(run, StructType(fields))


def moved(cells: np.ndarray, offset: Offset) -> np.ndarray:
    """Cells moved by an offset; what comes in from outside is empty."""
    out = np.zeros_like(cells)
    to = tuple(slice(max(d, 0), n + min(d, 0)) for d, n in zip(offset, cells.shape))
    of = tuple(slice(max(-d, 0), n + min(-d, 0)) for d, n in zip(offset, cells.shape))
    out[to] = cells[of]
    return out


def eroded(cells: np.ndarray, offsets: list[Offset], rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        left = cells.copy()
        for o in offsets:
            left &= moved(cells, o)
        cells = left
    return cells


def dilated(cells: np.ndarray, offsets: list[Offset], rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        more = cells.copy()
        for o in offsets:
            more |= moved(cells, o)
        cells = more
    return cells


def to_empty(cells: np.ndarray, spacing: tuple[float, float, float], reach: Offset) -> np.ndarray:
    """Squared distance of every cell to the nearest empty one, axis by axis; infinite where none is within reach."""
    d = np.where(cells, np.inf, 0.0)
    for axis, (s, r) in enumerate(zip(spacing, reach)):
        line = np.moveaxis(d, axis, 0)
        near = line.copy()
        for k in range(1, min(r, len(line) - 1) + 1):
            np.minimum(near[k:], line[:-k] + (k * s) * (k * s), out=near[k:])
            np.minimum(near[:-k], line[k:] + (k * s) * (k * s), out=near[:-k])
        d = np.moveaxis(near, 0, axis)
    return d


_BLOCK = [StructField("_x", IntegerType()), StructField("_y", IntegerType()), StructField("_block", BinaryType())]


def _columns(others: DataFrame, planes: DataFrame, group: list[str]) -> DataFrame:
    """For each tile of columns and each plane between the first and last asked for: steps along z to the nearest of the others."""
    rows = others.select(*group, "x", "y", "z").join(planes.hint("merge"), group)
    rows = rows.withColumns({"_x": F.floor(F.col("x") / TILE).cast("int"), "_y": F.floor(F.col("y") / TILE).cast("int")})
    fields = [*others.select(*group).schema.fields, StructField("z", IntegerType()), *_BLOCK]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() for k in key[-2:])
        x, y, z = (rows.column(a).to_numpy().astype(np.int64) for a in "xyz")
        first, last = (int(rows.column(c)[0].as_py()) for c in ("_first", "_last"))
        lo, hi = min(first, int(z.min())), max(last, int(z.max()))
        there = np.zeros((hi - lo + 1, TILE, TILE), bool)
        there[z - lo, x - tx * TILE, y - ty * TILE] = True
        at = np.arange(len(there), dtype=np.int64)[:, None, None]
        below = np.maximum.accumulate(np.where(there, at, -FAR), axis=0)
        above = np.minimum.accumulate(np.where(there, at, 2 * FAR)[::-1], axis=0)[::-1]
        steps = np.minimum(np.minimum(at - below, above - at), FAR).astype(np.int32)[first - lo : last - lo + 1]
        n = len(steps)
        cols = [*repeated(key[:-2], n), pa.array(np.arange(first, last + 1), pa.int32()), pa.repeat(pa.scalar(tx, pa.int32()), n), pa.repeat(pa.scalar(ty, pa.int32()), n), pa.array([s.tobytes() for s in steps], pa.binary())]
        return pa.Table.from_arrays(cols, [f.name for f in fields])

    return rows.groupBy(*group, "_x", "_y").applyInArrow(run, StructType(fields))


def distance_to(points: DataFrame, others: DataFrame, spacing: Spacing, group: list[str]) -> DataFrame:
    """The points, all columns, with the distance in mm to the nearest of the others in their group; left out where there are none.

    Exact, and linear in the volume that the others' columns and the points' planes span: no radius, no pairs. A task
    holds the columns of one tile, then one slice.
    """
    planes = points.groupBy(*group).agg(F.min("z").alias("_first"), F.max("z").alias("_last"))
    blocks = _columns(others, planes, group)
    names = points.columns

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = pa.schema([*(mine.schema.field(c) for c in names), pa.field("distance", pa.float64())])
        if not mine.num_rows or not theirs.num_rows:
            return out.empty_table()
        sx, sy, sz = map(float, spacing_of(group, key) if spacing is None else spacing)
        bx, by = theirs.column("_x").to_numpy(), theirs.column("_y").to_numpy()
        x0, y0 = int(bx.min()), int(by.min())
        d = np.full(((int(bx.max()) - x0 + 1) * TILE, (int(by.max()) - y0 + 1) * TILE), np.inf)
        for tx, ty, block in zip(bx - x0, by - y0, theirs.column("_block").to_pylist()):
            steps = np.frombuffer(block, np.int32).reshape(TILE, TILE)
            d[tx * TILE : (tx + 1) * TILE, ty * TILE : (ty + 1) * TILE] = np.where(steps == FAR, np.inf, (steps * sz) ** 2)
        px, py = (mine.column(c).to_numpy().astype(np.int64) for c in "xy")
        gx, gy = np.arange(d.shape[0]) + x0 * TILE, np.arange(d.shape[1]) + y0 * TILE
        best = np.empty(len(px))
        for y in np.unique(py):
            line = (d + ((gy - y) * sy) ** 2).min(axis=1)
            for at in np.array_split(here := np.flatnonzero(py == y), 1 + len(here) // 4096):
                best[at] = (line + ((px[at, None] - gx) * sx) ** 2).min(axis=1)
        return pa.Table.from_arrays([*(mine.column(c) for c in names), pa.array(np.sqrt(best))], schema=out)

    fields = [*points.schema.fields, StructField("distance", DoubleType())]
    here = points.withColumn("_z", F.col("z").cast("int")).groupBy(*group, "_z")
    return here.cogroup(blocks.withColumnRenamed("z", "_z").groupBy(*group, "_z")).applyInArrow(run, StructType(fields))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component, given edges a-b."""
    f = np.arange(n)
    while len(a):
        low = np.minimum(f[a], f[b])
        np.minimum.at(f, f[a], low)
        np.minimum.at(f, f[b], low)
        while (g := f[f]).tobytes() != f.tobytes():
            f = g
        apart = f[a] != f[b]
        a, b = a[apart], b[apart]
    return f


RUN = "y int, z int, x0 int, x1 int, src long, dst long"


def labelled_runs(voxels: DataFrame, group: list[str], offsets: list[Offset], planar: bool) -> DataFrame:
    """Runs along x of each tile with the local component they are in (src), and edges (src, dst) between those of different tiles.

    A tile sees the voxels around it. Its components are named by their smallest voxel id; each names itself to the voxels
    that another tile sees too, so two tiles' names meet in a voxel's id. Rows with dst are edges, the others runs.
    `offsets` are one of each opposite pair.
    """
    reach = (1, 1, 0 if planar else 1)
    flat = voxels.select(*group, "x", "y", "z").withColumn("_id", F.xxhash64(*group, "x", "y", "z"))
    fields = [*flat.select(*group).schema.fields, *StructType.fromDDL(RUN).fields]
    size = sizes(reach)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first = [k.as_py() * n - r for k, n, r in zip(key[-3:], size, reach)]
        at = tuple(rows.column(a).to_numpy().astype(np.int64) - o for a, o in zip("xyz", first))
        grid = np.full([n + 2 * r for n, r in zip(size, reach)], -1, np.int64)
        ids = rows.column("_id").to_numpy()
        grid[at] = np.arange(len(ids))
        own = np.ones(len(ids), bool)
        seen = np.zeros(len(ids), bool)  # by another tile
        for i, n, r in zip(at, size, reach):
            own &= (i >= r) & (i < r + n)
            seen |= (i < 2 * r) | (i >= n)
        ends = []
        for o in offsets:
            there = moved(grid + 1, tuple(-v for v in o))[at] - 1  # the voxel one offset on, if any
            ok = np.flatnonzero(there >= 0)
            ends.append(np.stack([ok, there[ok]]))
        a, b = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
        both = own[a] | own[b]
        part = joined(len(ids), a[both], b[both])
        name = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(name, part, ids)
        name = name[part]
        held = np.zeros(len(ids), bool)
        held[part[own]] = True
        edge = np.flatnonzero(held[part] & (seen | ~own) & (name != ids))
        cells = np.zeros(grid.shape, bool)
        cells[tuple(i[own] for i in at)] = True
        lines = cells.transpose(2, 1, 0)
        z, y, x0 = np.nonzero(lines & ~moved(lines, (0, 0, 1)))
        x1 = np.nonzero(lines & ~moved(lines, (0, 0, -1)))[2]
        n, m = len(x0), len(edge)
        ints = [pa.concat_arrays([pa.array(v + o, pa.int32()), pa.nulls(m, pa.int32())]) for v, o in ((y, first[1]), (z, first[2]), (x0, first[0]), (x1, first[0]))]
        src = pa.array(np.concatenate((name[grid[x0, y, z]], name[edge])))
        dst = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(ids[edge])])
        return pa.Table.from_arrays([*repeated(key[:-3], n + m), *ints, src, dst], [f.name for f in fields])

    return dealt(flat, reach).groupBy(*group, "_tx", "_ty", "_tz").applyInArrow(run, StructType(fields))
