"""Box sums and neighbour pairs in blocks: the same as plain sums, for any block."""

import math

import numpy as np
import pytest

from lamina.operators import spatial, window


@pytest.mark.parametrize("block", [(2, 3, 4), (64, 64, 64)])
def test_box_sum(spark, block):
    """Holes, negative coordinates, nulls, repeated voxels, keys, and columns that pass through."""
    rng = np.random.default_rng(0)
    rows = [(int(z), int(y), int(x), None if k % 9 == 0 else int(v), "ab"[k % 2], None if k % 3 else "t") for k, (z, y, x, v) in enumerate(np.c_[rng.integers(-4, 8, (220, 3)), rng.integers(-3, 5, 220)])]
    df = spark.createDataFrame(rows, "z int, y int, x int, v int, part string, note string")
    for keys in ((), ("part",)):
        got = window.box_sum(df, "v", (1, 2, 3), "box", keys, block)
        assert got.columns == [*df.columns, "box"]
        near = lambda q, r: all(abs(q[k] - r[k]) <= k + 1 for k in range(3)) and (not keys or q[4] == r[4])
        want = [(*r, sum(q[3] or 0 for q in rows if near(q, r))) for r in rows]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert window.box_sum(df.limit(0), "v", (1, 1, 1)).count() == 0


@pytest.mark.parametrize("block", [(2, 3, 4), (64, 64, 64)])
def test_pairs(spark, block):
    rng = np.random.default_rng(1)
    cells = {tuple(map(int, p)): int(rng.integers(0, 4)) for p in rng.integers(-3, 5, (200, 3))}
    df = spark.createDataFrame([(*p, v) for p, v in cells.items()], "z int, y int, x int, label long")
    offs = [(0, 0, 1), (1, -2, 0), (-1, 0, 3)]
    want = sorted((*p, v, k, cells[q]) for p, v in cells.items() for k, o in enumerate(offs) if (q := tuple(a + b for a, b in zip(p, o))) in cells)
    assert sorted(map(tuple, window.pairs_at(df, offs, block).collect())) == want
    got = sorted(map(tuple, spatial.contacts(df, block=block).collect()))
    assert got == sorted((min(v, w), max(v, w), *p, k) for p, v in cells.items() for k, o in enumerate(spatial.FORWARD) if (w := cells.get(tuple(a + b for a, b in zip(p, o)), 0)) and v and v != w)
    # one shuffle, whatever the number of offsets
    plan = window.pairs_at(df, offs, block)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_face_maxima(spark):
    """Edges of the box count for each of their faces, ties go to the first in raster order, nulls and NaN never win, low maxima are left out."""
    rng = np.random.default_rng(2)
    at = [(z, y, x) for z in range(-3, 4) for y in range(-2, 5) for x in range(7)]
    values = [None if k % 11 == 0 else math.nan if k % 13 == 0 else float(v) for k, v in enumerate(rng.integers(0, 4, len(at)) / 4)]
    df = spark.createDataFrame([(*p, v, "ab"[k % 2]) for k, (p, v) in enumerate(zip(at, values))], "z int, y int, x int, value double, part string")
    center, delta = (0, 1, 3), (2, 0, 3)
    for keys in ((), ("part",)):
        for threshold in (0.5, 0.75, 0.8):
            want = set()
            for part in "ab" if keys else [""]:
                inside = [(v, p) for k, (p, v) in enumerate(zip(at, values)) if part in ("", "ab"[k % 2]) and v is not None and not math.isnan(v) and all(abs(p[a] - center[a]) <= delta[a] for a in range(3))]
                for a, s in [(a, s) for a in range(3) if delta[a] for s in (-1, 1)]:
                    v, p = min(((-v, p) for v, p in inside if p[a] == center[a] + s * delta[a]))
                    if -v >= threshold:
                        want.add(((part,) if keys else ()) + (-v, *(c - o for c, o in zip(p, center))))
            got = [tuple(r) for r in window.face_maxima(df, center, delta, threshold, keys).collect()]
            assert sorted(got) == sorted(want) and (want or threshold == 0.8)


@pytest.mark.parametrize("times", [1, 2])
def test_erode(spark, times):
    """Holes and negative coordinates; the border and null neighbours erode; a null voxel is null only where all its neighbours hold."""
    rng = np.random.default_rng(3)
    cells = {p: True for p in np.ndindex(7, 6, 8)}
    for p in rng.permutation(sorted(cells))[:6].tolist():
        cells[tuple(p)] = None
    for p in rng.permutation(sorted(cells))[:6].tolist():
        cells[tuple(p)] = False
    del cells[(3, 3, 3)]
    cells[(5, 4, 1)] = None
    for p in ((4, 4, 1), (6, 4, 1), (5, 3, 1), (5, 5, 1), (5, 4, 0), (5, 4, 2)):
        cells[p] = True
    df = spark.createDataFrame([(z - 3, y, x - 4, v) for (z, y, x), v in cells.items()], "z int, y int, x int, m boolean")
    steps = [tuple(s if k == a else 0 for k in range(3)) for a in range(3) for s in (-1, 1)]
    for _ in range(times):
        cells = {p: v if all(cells.get(tuple(c + o for c, o in zip(p, d))) for d in steps) else False for p, v in cells.items()}
    assert times == 2 or {True, False, None} <= set(cells.values())
    got = window.erode(df, "m", times)
    assert got.columns == ["z", "y", "x", "m", "eroded"]
    assert {(r.z + 3, r.y, r.x + 4): r.eroded for r in got.collect()} == cells
