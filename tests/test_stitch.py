"""One numbering across overlapping tiles with local ids."""

import numpy as np
import pandas as pd

from lamina.operators import kernels, stitch


def tiles_of(spark, seg, step, overlap, seed):
    """Tiles of `step` voxels that see `overlap` more after them, components of each numbered by themselves in a random order."""
    rng, parts = np.random.default_rng(seed), []
    for tile, (z, x) in enumerate((z, x) for z in range(0, seg.shape[0], step) for x in range(0, seg.shape[2], step)):
        cut = seg[z : z + step + overlap, :, x : x + step + overlap]
        local = kernels.components(cut, 1)
        local = np.concatenate(([0], rng.permutation(local.max()) + 1))[local]
        at = np.indices(cut.shape).reshape(3, -1) + np.array([[z], [0], [x]])
        parts.append(pd.DataFrame({"tile": tile, "z": at[0], "y": at[1], "x": at[2], "label": local.ravel()}))
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=seed))


def rods(shape, n, rng):
    """Rods along z or x, two voxels apart at least, so that each stays one piece."""
    seg = np.zeros(shape, np.int64)
    for k in range(1, n + 1):
        y = 3 * k
        if k % 2:
            seg[:, y : y + 2, 2:4] = k
        else:
            seg[4:6, y : y + 2, :] = k
    return seg


def test_segments_through_many_tiles(spark):
    seg = rods((18, 30, 20), 8, None)
    df = tiles_of(spark, seg, 6, 2, 1)
    got = stitch.stitched(df, ids := stitch.global_ids(df)).collect()
    out = np.zeros(seg.shape, np.int64)
    for r in got:
        out[r["z"], r["y"], r["x"]] = r["label"]
    assert len(got) == seg.size
    pairs = {(int(a), int(b)) for a, b in zip(seg.ravel(), out.ravel())}
    assert len(pairs) == 9 and {b for _, b in pairs} == set(range(9))  # one to one, ids without gaps
    # the order of rows, and other ids within the tiles, change nothing but the numbers
    again = stitch.global_ids(df.repartition(7).orderBy("x"))
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, again.collect()))


def test_only_mutual_best_matches_join(spark):
    """Tile 1 holds 1 and 2 for what tile 0 calls 5: the larger share is matched, the other stays alone; a small overlap is none."""
    line = [(0, 5)] * 10 + [(0, 6)] * 4 + [(0, 0)] * 4
    other = [(1, 1)] * 7 + [(1, 2)] * 3 + [(1, 0)] * 3 + [(1, 3)] * 5
    rows = [(t, 0, 0, x, label) for seq in (line, other) for x, (t, label) in enumerate(seq)]
    df = spark.createDataFrame(rows, "tile long, z int, y int, x int, label long")
    votes = {(r["id_a"], r["id_b"]): (r["n"], round(r["share"], 6)) for r in stitch.overlap_votes(df).collect()}
    assert votes == {(5, 1): (7, 0.7), (5, 2): (3, 0.3), (6, 3): (1, 0.125)}
    ids = lambda share: {(r["tile"], r["label"]): r["global_id"] for r in stitch.global_ids(df, share).collect()}
    assert ids(0.5) == {(0, 5): 1, (0, 6): 2, (1, 1): 1, (1, 2): 3, (1, 3): 4}
    assert ids(0.1) == {(0, 5): 1, (0, 6): 2, (1, 1): 1, (1, 2): 3, (1, 3): 2}
    assert stitch.global_ids(df.limit(0)).count() == 0
