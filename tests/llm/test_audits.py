"""Divergence audit, periodic runs and the digest index."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import digest_index, divergence, periodic, queries
from lamina.llm.common import as_bytes, table
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, digest string, row int, runs string, n long, value string, batch string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names clash with those inside the operators."""
    rows = [(d, t, (None, "en", "de")[k % 3], (None, "a", "", "b")[k % 4], "x", 1, "r", 2, "v", "b1") for k, (d, t) in enumerate(brute.ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# ---------------------------------------------------------------- divergence


def test_trie(spark):
    """Merged tries hold every counter once, in the order of the terms' bytes, and so do their twigs."""
    rng = random.Random(4)
    word = lambda: bytes(rng.choice(b"ab\xc3\xa4") for _ in range(rng.randint(1, 7)))
    words, want, tries = [(word(), rng.randint(0, 2)) for _ in range(3000)], {}, []
    for w, g in words:
        old = want.setdefault(w, {}).get(g, (0, 0))
        want[w][g] = (old[0] + 2, old[1] + 1)
    for k in range(3):
        part = words[k::3]
        one = np.ones(len(part), np.int64)
        tries.append(divergence.Trie.of(pa.array([w for w, _ in part], pa.large_binary()), np.arange(len(part)), np.array([g for _, g in part]), 2 * one, one))
    trie = divergence.Trie.merge(tries)
    again = divergence.Trie.merge([trie])
    lang_of = np.array([0, 1, 0])
    back = divergence._of_twigs(pa.Table.from_batches([t.twigs(lang_of) for t in tries]))
    for t in (trie, again, back):
        names, got = t.terms.to_pylist(), {}
        assert names == sorted(want)
        for leaf, g, n, d in zip(t.leaf.tolist(), t.group.tolist(), t.n.tolist(), t.docs.tolist()):
            got.setdefault(names[leaf], {})[g] = (n, d)
        assert got == want
    rows = trie.twigs(lang_of).to_pylist()
    at = [(r["lang"], r["prefix"]) for r in rows]
    assert at == sorted(set(at)) and all(r["tails"] == sorted(r["tails"]) for r in rows)


def test_shares_are_exact():
    for n in (0, 5, 10**9, 5 * 10**9, 10**13):
        assert divergence.shares(np.array([0, n]), n + 7).tolist() == [1 + 10**9 // (n + 7), 1 + 10**9 * (n + 1) // (n + 7)]


@pytest.mark.parametrize("counters", [400_000, 50])
def test_divergence(spark, odd, sf_dir, monkeypatch, counters):
    monkeypatch.setattr(divergence, "COUNTERS", counters)
    monkeypatch.setattr(divergence, "CELLS", 40)
    docs = table(spark, sf_dir, "documents")
    for df in (odd, docs):
        assert sorted(rows_of(divergence.audit(df))) == brute.divergence(plain(df, "text", "lang", "source"))
    assert divergence.audit(odd.limit(0)).count() == 0
    # ties at the last rank go by the terms' bytes; a group without terms, one lang without any
    words = [f"t{c}{d}" for c in "abcdefghijklmnopqrst" for d in "aäbz"]
    rows = [(" ".join(words), "en", "a")] * 3 + [("other", "en", "b")] * 3 + [(None, "en", "c"), ("1 2", "xx", "a"), ("rare", "xx", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert sorted(rows_of(divergence.audit(df, top=7))) == brute.divergence(rows, top=7)


# ---------------------------------------------------------------- periodic runs


def test_runs():
    rng = random.Random(5)
    for k in range(3000):
        n, letters = rng.randint(0, 45), "abcd"[: rng.randint(1, 4)]
        w = [rng.choice(letters) for _ in range(n)]
        if k % 3 == 0 and n:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
        for exponent, least in ((2, 2), (4, 6), (3, 3), (2, 7)):
            assert periodic.runs(w, exponent, least) == brute.runs(w, exponent, least)
    with pytest.raises(ValueError):
        periodic.runs("ab", 1)


class Counted(int):
    """A word that counts how often it is compared."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.seen += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("name", ["one letter", "fibonacci", "blocks", "growing", "random", "period"])
def test_runs_take_linear_time(name):
    n = 20_000
    text = {
        "one letter": [0] * n,
        "fibonacci": fibonacci(n),
        "blocks": ([0] * 150 + [1]) * (n // 151),
        "growing": [x for k in range(199) for x in [0] * k + [1]],
        "random": [int(x) for x in np.random.default_rng(6).integers(0, 2, n)],
        "period": list(range(100)) * (n // 100),
    }[name]
    top = max(text)
    for t in (text, [top - c for c in text]):
        Counted.seen = 0
        words = [Counted(c) for c in t]
        nxt, _ = periodic.lyndon_array(words)
        periodic.left_extensions(words, nxt)
        assert Counted.seen <= 10 * len(words)


def test_periodic_runs(spark, odd, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for df in (odd, docs):
        got = periodic.digests(periodic.periodic_runs(periodic.with_periods(df)))
        assert rows_of(got) == sorted(brute.periodic([r for r in plain(df, "doc_id", "text")]), key=str)
    assert periodic.digests(periodic.periodic_runs(odd.limit(0))).count() == 0
    r = periodic.periodic_runs(spark.createDataFrame([(1, "a b\tb b b b\n b c x y x y x y x y z")], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 6, 1), (8, 8, 2)] and (r["n_words"], r["collapsed"]) == (17, "a b c x y z")


# ---------------------------------------------------------------- exact dedup


def groups_of(rows):
    """For (id, text) rows: id, keep_id, group_size, text_sha256, and whether any row of this id may stay."""
    by = {}
    for d, t in rows:
        by.setdefault((t or "").translate(brute.AZ), []).append(d)
    out = []
    for d, t in rows:
        norm = (t or "").translate(brute.AZ)
        keep = max((x for x in by[norm] if x is not None), default=None)
        out.append((d, keep, len(by[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark, odd, tmp_path):
    more = [(20, "Two WORDS"), (21, "É"), (22, "é"), (23, "İ"), (24, "i̇"), (None, None)] + [(100 + k, "hot") for k in range(300)]
    df = odd.select("doc_id", "text", "digest", "row", "n", "batch").unionByName(spark.createDataFrame([(d, t, "", 0, 0, "") for d, t in more], "doc_id long, text string, digest string, row int, n long, batch string"))
    half = F.pmod(F.xxhash64("id"), F.lit(3))
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/i", 3)
    got = digest_index.keep_last(df, index, [(f"b{k}", half == k) for k in range(3)]).collect()
    rows = plain(df, "doc_id", "text")
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == groups_of(rows)
    # of each group just one row stays, and it is one of the largest id
    stay = [r for r in got if r["kept"]]
    assert len(stay) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in stay}) and all(r["doc_id"] == r["keep_id"] for r in stay)
    empty = digest_index.DigestIndex(spark, f"file://{tmp_path}/e", 2)
    assert digest_index.keep_last(df.limit(0), empty, [("b", F.lit(True))]).count() == 0


def test_index_persists(spark, tmp_path):
    """A reopened index knows its batches; one that is committed again changes nothing; the index itself is not shuffled."""
    path = f"file://{tmp_path}/i"
    frame = lambda rows: digest_index.digested(spark.createDataFrame(rows, "doc_id long, text string"))
    index = digest_index.DigestIndex(spark, path, 4)
    one = index.add(frame([(1, "a"), (5, "A"), (2, "b")]), "day-1")
    spark.sql(f"DROP TABLE {index.table}")  # the files stay
    again = digest_index.DigestIndex(spark, path, 4)
    assert again.batches() == ["day-1"]
    two = again.add(frame([(3, "a"), (9, "b"), (4, "c")]), "day-2")
    state = rows_of(again.entries())
    again.add(frame([(3, "a"), (9, "b"), (4, "c")]), "day-2")
    assert rows_of(again.entries()) == state and sorted(r["n"] for r in again.entries().collect()) == [1, 2, 3]
    first = spark.table(again.table).groupBy("batch").agg(F.sum(F.col("first").cast("int")).alias("n")).collect()
    assert sorted(map(tuple, first)) == [("day-1", 2), ("day-2", 1)]
    got = again.resolve(one.unionByName(two)).select("id", "keep_id", "group_size", "kept")
    assert rows_of(got) == [(1, 5, 3, False), (2, 9, 2, False), (3, 5, 3, False), (4, 4, 1, True), (5, 5, 3, True), (9, 9, 2, True)]
    plan = again.entries()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    with pytest.raises(ValueError):
        again.add(one, "a/b")


@pytest.mark.parametrize("name", ["op11_divergence", "op13_exact_dedup"])
def test_against_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    cur = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall()), key=str)
    assert len(want) > 100 and rows_of(got) == want
