"""Edited graphs against rebuilt ones, whatever the edits; pointers and paths on fixed cases."""

import random

from lamina.operators import graphs, labels


def rebuilt(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def edges_of(spark, rows):
    return spark.createDataFrame(list(rows), "src long, dst long")


def test_any_series_of_edits_equals_a_rebuild(spark, tmp_path):
    rng, path = random.Random(3), f"file://{tmp_path}/g"
    nodes, edges, past = set(), set(), []
    some = lambda k: [(rng.randrange(14), rng.randrange(14)) for _ in range(k)]
    for k in range(5):
        merge = some(7) if k != 2 else []
        cut = [e for e in sorted(edges) if rng.random() < 0.3] + some(2) if k else []
        alone = rng.sample(range(14), 3) if k in (2, 3) else None
        new = {(min(e), max(e)) for e in merge if e[0] != e[1]} - edges
        edges |= new
        nodes |= {n for e in new for n in e}
        if alone is not None:
            edges = {e for e in edges if (e[0] in alone) == (e[1] in alone)}
        edges -= {(min(e), max(e)) for e in cut}
        number = graphs.commit(spark, path, edges_of(spark, merge + [(None, 3)] + [e[::-1] for e in merge]), None if alone is None else spark.createDataFrame([(n,) for n in alone], "node long"), edges_of(spark, [e[::-1] for e in cut]))
        assert number == k
        past.append((set(edges), rebuilt(nodes, edges)))
    for k, (e, parts) in enumerate(past):
        assert {tuple(r) for r in graphs.edges_at(spark, path, k).collect()} == e
        assert {tuple(r) for r in graphs.parts_at(spark, path, k).collect()} == set(parts.items())


def test_components_in_one_task_and_over_tasks(spark, monkeypatch):
    """Random graphs and long paths, solved in one task, over tasks and in rounds: the smallest node that each reaches, without a table for every round."""
    rng = random.Random(5)
    written, kept = [], labels.kept
    monkeypatch.setattr(labels, "kept", lambda df, name: written.append(name) or kept(df, name))
    path = [(k, k + 1) for k in rng.sample(range(400), 390)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(7, 7)]
    for rows in (path, some, []):
        nodes = {n for e in rows for n in e}
        for most in (1 << 20, 60, 1):
            monkeypatch.setattr(labels, "ONE_TASK", most, raising=False)
            del written[:]
            got = labels.components(edges_of(spark, rows))
            if most > 1:
                assert len(written) < 6
            assert {tuple(r) for r in got.collect()} == set(rebuilt(nodes, rows).items())
    null = spark.createDataFrame([(1, None), (None, 2), (4, 3)], "src int, dst long")
    assert sorted(map(tuple, labels.components(null).collect())) == [(3, 3), (4, 3)]


def test_a_cut_writes_only_what_it_touches_and_a_dead_version_is_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    assert graphs.version(spark, path) == -1
    graphs.commit(spark, path, edges_of(spark, [(1, 2), (2, 3)] + [(k, k + 1) for k in range(10, 40)]))
    # a job that died before its marker
    spark.createDataFrame([(1, 99, 1)], "node long, component long, version int").write.parquet(f"{path}/parts/1")
    assert {r["component"] for r in graphs.parts_at(spark, path).collect()} == {1, 10}
    assert graphs.commit(spark, path, cut=edges_of(spark, [(3, 2)])) == 1
    assert [tuple(r) for r in spark.read.parquet(f"{path}/parts/1").select("node", "component").collect()] == [(3, 3)]
    assert graphs.commit(spark, path) == 2
    assert graphs.parts_at(spark, path).where("component <> node").count() == 31


def test_pointers_stay_on_their_paths(spark):
    paths = spark.createDataFrame([(s, k, 10 * s + k) for s, n in ((1, 4), (2, 3), (3, 1), (4, 2)) for k in range(n)], "split int, step int, node long")
    moves = [(1, 1, 1), (1, 2, 1), (1, 3, -1), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 5), (4, 1, -1), (4, 2, -3), (9, 1, 1)]
    index = graphs.pointers(paths, spark.createDataFrame(moves, "split int, seq int, delta int"))
    assert {tuple(r) for r in index.collect()} == {(1, 2), (2, 3), (3, 1), (4, 1)}
    assert {tuple(r) for r in graphs.accepted(paths, index).collect()} == {(1, 11, 12), (4, 40, 41)}


def test_paths_searched_together(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (8, 9)] + [(k, k + 1) for k in range(100, 130)])
    goals = spark.createDataFrame([("a", 1, 5), ("b", 5, 5), ("c", 1, 9), ("d", 130, 100), ("e", 77, 1)], "split string, start long, goal long")
    got = {}
    for r in labels.shortest_paths(e, goals).orderBy("split", "step").collect():
        got.setdefault(r["split"], []).append(r["node"])
    assert got == {"a": [1, 2, 3, 5], "b": [5], "d": list(range(130, 99, -1))}
