"""Work along whole lines of a volume: each pass meets only the tiles of one row, so no task holds more than that.

A volume becomes packed tiles (`tiles`), one row a tile, over the whole hull of its voxels. `along` groups the tiles of a row
along one axis, joins them to lines, applies a function that works on each line by itself, and cuts the result into tiles
again. Filters, distances and running maxima that work axis by axis come out exactly as on the whole volume, for any size of the tiles;
each pass shuffles packed arrays once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
HULL = [f"{e}{a}" for e in ("l", "h") for a in AXES]
HEAD = "volume string, bz int, by int, bx int, " + ", ".join(f"{h} int" for h in HULL)
Arrays = dict[str, np.ndarray]
#: Numpy types of Spark's.
SPARK = {"double": "f8", "float": "f4", "long": "i8", "bigint": "i8", "int": "i4", "boolean": "?"}
#: Voxels that are given back at once.
ROWS = 1 << 16


def tiles(vox: DataFrame, arrays: dict[str, tuple[Column, str, float]], tile: tuple[int, int, int]) -> DataFrame:
    """Packed tiles of (volume, z, y, x, ...), with an array for each name: (values, numpy type, value where there is no voxel)."""
    rows = vox.select("volume", *[F.col(a).cast("int").alias(a) for a in AXES], *[F.floor(F.col(a) / t).cast("int").alias(f"b{a}") for a, t in zip(AXES, tile)], *[c.alias(n) for n, (c, _, _) in arrays.items()])
    kinds = {n: (np.dtype(t), fill) for n, (_, t, fill) in arrays.items()}

    def pack(key: tuple, got: pa.Table) -> pa.Table:
        at = tuple(got[a].to_numpy() - k.as_py() * t for a, k, t in zip(AXES, key[1:], tile))
        out = {c: got[c].slice(0, 1) for c in ("volume", "bz", "by", "bx")}
        for n, (kind, fill) in kinds.items():
            one = np.full(tile, fill, kind)
            one[at] = got[n].to_numpy()
            out[n] = pa.array([one.tobytes()], pa.binary())
        return pa.table(out)

    packed = rows.groupBy("volume", "bz", "by", "bx").applyInArrow(pack, "volume string, bz int, by int, bx int, " + ", ".join(f"`{n}` binary" for n in arrays))
    hull = rows.groupBy("volume").agg(*[F.min(a).alias(f"l{a}") for a in AXES], *[F.max(a).alias(f"h{a}") for a in AXES])
    for a, t in zip(AXES, tile):
        hull = hull.withColumn(f"b{a}", F.explode(F.sequence(F.floor(F.col(f"l{a}") / t).cast("int"), F.floor(F.col(f"h{a}") / t).cast("int"))))
    out = hull.join(packed, ["volume", "bz", "by", "bx"], "left")
    return out.select("volume", "bz", "by", "bx", *HULL, *[F.coalesce(n, F.lit(np.full(tile, fill, kind).tobytes())).alias(n) for n, (kind, fill) in kinds.items()])


def along(packed: DataFrame, axis: str, tile: tuple[int, int, int], kinds: dict[str, str], run: Callable[[Arrays], Arrays], out: dict[str, str]) -> DataFrame:
    """Apply `run` to all lines of an axis. It gets arrays of `kinds` with that axis last, cut to the volume's extent, and gives those of `out` in the same shape."""
    k = AXES.index(axis)
    shape = [t for j, t in enumerate(tile) if j != k] + [tile[k]]

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(f"b{axis}")
        first, low, high = (rows[c][0].as_py() for c in (f"b{axis}", f"l{axis}", f"h{axis}"))
        a, b = low - first * tile[k], high - first * tile[k] + 1
        lines = lambda n: np.concatenate([np.moveaxis(np.frombuffer(x, kinds[n]).reshape(tile), k, -1) for x in rows[n].to_pylist()], -1)[..., a:b]
        got = run({n: lines(n) for n in kinds})
        done = {c: rows[c] for c in ("volume", "bz", "by", "bx", *HULL)}
        for n, kind in out.items():
            wide = np.zeros((*shape[:-1], len(rows) * tile[k]), kind)
            wide[..., a:b] = got[n]
            done[n] = pa.array([np.ascontiguousarray(np.moveaxis(wide[..., j * tile[k] : (j + 1) * tile[k]], -1, k)).tobytes() for j in range(len(rows))], pa.binary())
        return pa.table(done)

    others = [f"b{a}" for a in AXES if a != axis]
    return packed.groupBy("volume", *others).applyInArrow(whole, HEAD + ", " + ", ".join(f"`{n}` binary" for n in out))


def voxels(packed: DataFrame, tile: tuple[int, int, int], kinds: dict[str, str], keep: Callable[[Arrays], np.ndarray], out: dict[str, str]) -> DataFrame:
    """(volume, z, y, x and the arrays of `out`, name to Spark type) of the voxels for which `keep` is true; packed tiles are cut to the volume's extent."""

    def run(batches):
        for batch in batches:
            parts, n_rows = [], 0
            for row in batch.to_pylist():
                arrays = {n: np.frombuffer(row[n], t).reshape(tile) for n, t in kinds.items()}
                at = np.nonzero(keep(arrays))
                put = [c + row[f"b{a}"] * t for c, a, t in zip(at, AXES, tile)]
                inner = np.logical_and.reduce([(c >= row[f"l{a}"]) & (c <= row[f"h{a}"]) for c, a in zip(put, AXES)])
                parts.append((row["volume"], {**{a: c[inner].astype(np.int32) for a, c in zip(AXES, put)}, **{n: arrays[n][at][inner] for n in out}}))
                n_rows += int(inner.sum())
                if n_rows >= ROWS:
                    yield joined(parts)
                    parts, n_rows = [], 0
            if n_rows:
                yield joined(parts)

    def joined(parts: list) -> pa.RecordBatch:
        """One batch for many tiles: most have few voxels to give."""
        volume = pa.array([v for v, c in parts for _ in range(len(c["z"]))], pa.string())
        return pa.RecordBatch.from_pydict({"volume": volume, **{n: np.concatenate([c[n] for _, c in parts]) for n in AXES}, **{n: pa.array(np.concatenate([c[n] for _, c in parts]).astype(SPARK[t])) for n, t in out.items()}})

    return packed.mapInArrow(run, "volume string, z int, y int, x int, " + ", ".join(f"`{n}` {t}" for n, t in out.items()))
