"""Scores of re-segmented pairs on fixed boxes, and the merge rule at its edges."""

import math

from lamina.operators import evaluation


def frames(spark):
    pairs = spark.createDataFrame([(1, 5, 6, 2, 2, 2), (2, 5, 6, 2, 2, 2), (3, 5, 9, 2, 2, 2), (4, 5, 6, None, 2, 2), (5, 5, 6, 40, 2, 2)], "pair long, id_a long, id_b long, z int, y int, x int")
    vox = spark.createDataFrame([(2, 2, x, 5 if x < 3 else 6) for x in range(1, 5)] + [(2, 2, 9, 5)], "z int, y int, x int, label long")
    both = [(p, r, 2, 2, x, v) for p in (1, 3, 4, 5) for r in "ab" for x, v in ((1, 0.9), (2, 0.5), (3, 0.49 if r == "a" else 0.7), (4, None), (9, 1.0))]
    runs = spark.createDataFrame(both + [(1, "a", 1, 2, 2, math.nan), (2, "a", 2, 2, 2, 1.0)], "pair long, run string, z int, y int, x int, prob double")
    moves = spark.createDataFrame([(1, "a", 2, 2, 4, 7), (1, "a", 2, 2, 5, 100), (1, "b", 2, 2, 0, 3), (1, "b", 2, 2, 0, None)], "pair long, run string, z int, y int, x int, deleted int")
    return pairs, vox, runs, moves


def test_scores_and_statuses(spark):
    got = {r["pair"]: r for r in evaluation.pair_evaluation(*frames(spark), radius=(0, 0, 2), voxel_size=(2, 1, 1)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "incomplete", 3: "missing", 4: "missing", 5: "missing"}
    assert all(got[2][c.split()[0]] is None for c in evaluation.SCORES)
    r = got[1]
    assert (r["num_voxels_a"], r["num_voxels_b"], r["a_num_voxels"], r["b_num_voxels"]) == (2, 2, 2, 3)
    assert r["iou"] == 2 / 3
    # the box holds x from 0 to 4; a step along x is 2 long
    assert (r["max_edt_a"], r["max_edt_b"], r["a_max_edt"], r["b_max_edt"]) == (2.0, 4.0, 2.0, 4.0)
    assert (r["a_deleted_voxels"], r["b_deleted_voxels"]) == (7, 3)
    assert [r[f"{k}_segment_{s}_consistency"] for k in "ab" for s in "ab"] == [1.0, 0.0, 1.0, 0.5]


def test_object_that_fills_its_box_and_empty_tables(spark):
    pairs, vox, runs, moves = frames(spark)
    one = evaluation.pair_evaluation(pairs.where("pair = 1"), vox, runs, moves.limit(0), radius=(0, 0, 0)).collect()
    assert [r["status"] for r in one] == ["missing"]
    same = evaluation.pair_evaluation(pairs.where("pair = 1").selectExpr("pair", "id_a", "id_a AS id_b", "z", "y", "x"), vox, runs, moves.limit(0), radius=(0, 0, 0)).collect()
    assert [(r["status"], r["max_edt_a"], r["iou"], r["a_deleted_voxels"]) for r in same] == [("ok", None, 1.0, 0)]
    assert evaluation.pair_evaluation(pairs.limit(0), vox, runs, moves, radius=(1, 1, 1)).count() == 0
    assert {r["status"] for r in evaluation.pair_evaluation(pairs, vox, runs.limit(0), moves, radius=(1, 1, 1)).collect()} == {"incomplete"}


def test_merge_rule(spark):
    head = "iou double, a_segment_a_consistency double, a_segment_b_consistency double, b_segment_a_consistency double, b_segment_b_consistency double, a_deleted_voxels long, a_num_voxels long, b_deleted_voxels long, b_num_voxels long"
    good = (0.81, 0.7, 0.7, 0.7, 0.7, 1, 100, 50, 100)
    rows = [good, (0.8, *good[1:]), (*good[:4], 0.6, *good[5:]), (*good[:5], 2, 100, 50, 100), (*good[:5], 50, 100, 1, 100), (*good[:5], 0, 0, 0, 0), (None, *good[1:])]
    got = spark.createDataFrame(rows, head).select(evaluation.accepts_merge().alias("m")).collect()
    assert [r["m"] for r in got] == [True, False, False, False, True, False, False]
