"""Source divergence audit by mergeable radix tries.

Each task counts the terms of its documents in a byte trie. The trie is kept flat, in the order of a walk: leaves by the bytes
of their paths, and per leaf one counter for each (lang, source) group: the term's occurrences and the documents that have it.
Tries of slices are merged into the task's; one of more than COUNTERS counters is written out and begun anew, so memory is bounded.
What a task writes are twigs, the parts of a trie below PREFIX bytes of one lang: these bytes once, and what is left of each path.

Twigs of all tasks are dealt by ranges of (lang, prefix), which Spark draws from their spread, and merged prefix by prefix in
UTF-8 order. Terms that fewer than `min_docs` of their lang's documents hold go. A second walk over the kept leaves, in blocks
of bounded size, adds up the divergences of all pairs of sources and picks each group's candidates, value first and ties by
the terms' bytes; a task gives at most `top` candidates a group, so that few meet in the final ranking. All arithmetic
is on integers; where 64 bits do not hold a count's product, Python's integers do.

The names and totals of the groups are held on the driver and sent to the tasks. The result has a row for each pair of groups of a
lang, so this list is of the order of the square root of the result.

Defined cases: null texts, langs and sources count as ''; groups without terms are reported as any other; repeated rows are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import LOWER, as_bytes, columns, materialize, shuffle_width, slices, table_of, word_spans

#: Letters of ASCII and all bytes of other characters.
LETTERS = table_of((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SCALE = 1_000_000_000
#: Counters (a term in a group) that are merged at a time, bytes that the leaves of a twig share, and cells of a block in the second walk.
COUNTERS, PREFIX, CELLS = 1_000_000, 4, 2_000_000
TWIG = "lang int, prefix binary, tails array<binary>, sizes array<int>, groups array<int>, n array<long>, docs array<long>"
KEPT = "lang int, term binary, groups array<int>, counts array<long>"
RESULT = "group int, part string, other int, item string, value long"


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where any of the sorted keys changes, the first place included."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lists(values: pa.Array, firsts: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(firsts, n), pa.int32()), values)


def _cut(terms: pa.Array, n: int) -> tuple[pa.Array, pa.Array]:
    """The first n bytes of each term, and the rest."""
    data, offs = as_bytes(terms)
    size = np.diff(offs)
    here = np.arange(len(data)) - np.repeat(offs[:-1], size) < n
    whole = lambda size, data: pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(data)]).cast(pa.binary())
    return whole(np.minimum(size, n), data[here]), whole(np.maximum(size - n, 0), data[~here])


@dataclass
class Trie:
    """A flat radix trie. terms: paths of the leaves in byte order; counter k belongs to leaf[k] and group[k], ordered by both."""

    terms: pa.Array
    leaf: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray

    @staticmethod
    def of(terms: pa.Array, leaf: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Trie:
        """From counters in any order, of terms in any order and repeated."""
        words = terms.dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        leaf = rank[words.indices.to_numpy()[leaf]] if len(leaf) else leaf
        width = int(group.max()) + 1 if len(group) else 1
        order_ = np.argsort(leaf * width + group)
        leaf, group = leaf[order_], group[order_]
        at = _firsts(leaf, group)
        add = lambda x: np.add.reduceat(x[order_], at) if len(at) else x
        return Trie(words.dictionary.take(pa.array(order)), leaf[at], group[at], add(n), add(docs))

    @staticmethod
    def merge(tries: list[Trie]) -> Trie:
        base = np.cumsum([0, *(len(t.terms) for t in tries)])
        return Trie.of(
            pa.concat_arrays([t.terms for t in tries]), np.concatenate([t.leaf + b for t, b in zip(tries, base)]),
            *(np.concatenate([getattr(t, k) for t in tries]) for k in ("group", "n", "docs")),
        )

    def by_lang(self, lang_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Counters in the order of (lang, leaf): that order, the first counter of each leaf of a lang, its term and its lang."""
        lang = lang_of[self.group]
        order = np.argsort(lang, kind="stable")
        at = _firsts(lang[order], self.leaf[order])
        return order, at, self.terms.take(pa.array(self.leaf[order][at])), lang[order][at]

    def twigs(self, lang_of: np.ndarray) -> pa.RecordBatch:
        """A row for each lang and prefix: what is left of the leaves' paths, counters a leaf, and the counters."""
        order, at, terms, lang = self.by_lang(lang_of)
        prefix, rest = _cut(terms, PREFIX)
        new = np.zeros(len(at), bool)
        new[:1] = True
        new[1:] = (lang[1:] != lang[:-1]) | pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        tails = _lists(rest, first, len(at))
        sizes = _lists(pa.array(np.diff(np.append(at, len(order))), pa.int32()), first, len(at))
        of = lambda x, t: _lists(pa.array(x[order], t), at[first], len(order))
        cols = [pa.array(lang[first], pa.int32()), prefix.take(pa.array(first)), tails, sizes, of(self.group, pa.int32()), of(self.n, pa.int64()), of(self.docs, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=_names(TWIG))


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def count_terms(buf: np.ndarray, offs: np.ndarray, groups: np.ndarray) -> Trie:
    """The trie of some documents, each of a group."""
    starts, ends, doc = word_spans(buf, offs, LETTERS)
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    data = LOWER[buf[LETTERS[buf]]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    key = np.sort(words.indices.to_numpy().astype(np.int64) * len(groups) + doc)
    first = _firsts(key)  # a term in a document
    term, doc = key[first] // len(groups), key[first] % len(groups)
    return Trie.of(words.dictionary, term, groups[doc], np.diff(np.append(first, len(key))), np.ones(len(first), np.int64))


def twigs(docs: DataFrame, groups: Broadcast) -> DataFrame:
    """The twigs of every task's tries; docs: text, lang, source without nulls; groups: number of each (lang, source), and lang of each number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, lang_of = groups.value
        tries, size = [], 0
        for batch in batches:
            col, lang, source = columns(batch, "text", "lang", "source")
            own = np.array([number[x] for x in zip(lang.to_pylist(), source.to_pylist())], np.int64)
            buf, offs = as_bytes(col)
            for a, b in slices(offs):
                tries.append(count_terms(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], own[a:b]))
                size += len(tries[-1].leaf)
                if size > COUNTERS:
                    tries = [Trie.merge(tries)]
                    size = len(tries[0].leaf)
                    if 2 * size > COUNTERS:
                        yield tries.pop().twigs(lang_of)
                        size = 0
        if size:
            yield Trie.merge(tries).twigs(lang_of)

    return docs.mapInArrow(count, TWIG)


def _of_twigs(rows: pa.Table) -> tuple[Trie, np.ndarray]:
    """The merged trie of some twigs."""
    rows = rows.combine_chunks()
    tails, sizes, groups, n, docs = (rows.column(k).combine_chunks() for k in ("tails", "sizes", "groups", "n", "docs"))
    parent = pc.list_parent_indices(tails)
    terms = pc.binary_join_element_wise(rows.column("prefix").combine_chunks().take(parent), tails.flatten(), b"")
    size = sizes.flatten().to_numpy()
    leaf = np.repeat(np.arange(len(size)), size)
    return Trie.of(terms.cast(pa.large_binary()), leaf, *(x.flatten().to_numpy().astype(np.int64) for x in (groups, n, docs)))


def kept_terms(parts: DataFrame, groups: Broadcast, min_docs: int) -> DataFrame:
    """(lang, term, groups, counts): all tries merged, range by range, without the terms that too few documents hold."""
    ranged = parts.repartitionByRange(shuffle_width(parts.sparkSession), "lang", "prefix").sortWithinPartitions("lang", "prefix")

    def kept(rows: pa.Table) -> pa.RecordBatch:
        trie = _of_twigs(rows)
        order, at, terms, lang = trie.by_lang(groups.value[1])
        stay = np.add.reduceat(trie.docs[order], at) >= min_docs
        size = np.diff(np.append(at, len(order)))
        on = np.repeat(stay, size)
        first = np.cumsum(size[stay]) - size[stay]
        of = lambda x, t: _lists(pa.array(x[order][on], t), first, int(on.sum()))
        cols = [pa.array(lang[stay], pa.int32()), terms.filter(pa.array(stay)).cast(pa.binary()), of(trie.group, pa.int32()), of(trie.n, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=_names(KEPT))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(batch.schema.get_field_index("groups")).flatten())
            if size > COUNTERS:
                # the last prefix may go on in the next batch
                rows = pa.Table.from_batches(held)
                last = rows.slice(rows.num_rows - 1)
                same = pc.and_(pc.equal(rows["lang"], last["lang"][0]), pc.equal(rows["prefix"], last["prefix"][0]))
                done = rows.num_rows - pc.sum(same).as_py()
                if done:
                    yield kept(rows.slice(0, done))
                    rows = rows.slice(done)
                held = rows.to_batches()
                size = sum(len(x.column(x.schema.get_field_index("groups")).flatten()) for x in held)
        if held:
            yield kept(pa.Table.from_batches(held))

    return ranged.mapInArrow(merged, KEPT)


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    if counts.size and int(counts.max()) + 1 > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + 1) // total for c in counts.ravel()], np.int64).reshape(counts.shape)
    return 1 + SCALE * (counts + 1) // total


class _Lang:
    """What a task gathers of one lang: sums for each pair of sources, and each source's best terms so far."""

    def __init__(self, first: int, totals: list[int], n_terms: int, top: int):
        self.first, self.totals, self.n_terms, self.top = first, totals, n_terms, top
        self.sums = np.zeros((len(totals), len(totals)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in totals]

    def add(self, terms: pa.Array, groups: pa.Array, counts: pa.Array) -> None:
        c = np.zeros((len(self.totals), len(terms)), np.int64)
        c[groups.flatten().to_numpy() - self.first, pc.list_parent_indices(groups).to_numpy()] = counts.flatten().to_numpy()
        p = np.stack([shares(row, total + self.n_terms) for row, total in zip(c, self.totals)])
        q = shares(c.sum(0), sum(self.totals) + self.n_terms)
        for k, own in enumerate(p):
            d = own - p
            self.sums[k] += (d * d // p).sum(1)
            at = np.flatnonzero((c[k] > 0) & (own > q))
            value = (own - q)[at] ** 2 // q[at]
            if len(at) > self.top:  # what is below the value of rank `top` cannot stay; ties all do until they are ranked
                stay = value >= np.partition(value, -self.top)[-self.top]
                at, value = at[stay], value[stay]
            self.best[k] = sorted(self.best[k] + list(zip((-value).tolist(), terms.take(pa.array(at)).to_pylist())))[: self.top]

    def rows(self) -> Iterator[tuple]:
        for k in range(len(self.totals)):
            for other, v in enumerate(self.sums[k].tolist()):
                if other != k:
                    yield self.first + k, "pair", self.first + other, None, v
            for v, term in self.best[k]:
                yield self.first + k, "term", None, term.decode(), -v


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part `pair`: how far the group's term shares are from each other source's; part `term`: its terms above the lang's share, the first `top` of them."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    names = sorted(map(tuple, read.select("lang", "source").distinct().collect()))
    langs = {lang: k for k, lang in enumerate(sorted({x for x, _ in names}))}
    groups = spark.sparkContext.broadcast(({x: k for k, x in enumerate(names)}, np.array([langs[x] for x, _ in names], np.int64)))
    parts, _ = materialize(twigs(read, groups), "twigs")
    kept, _ = materialize(kept_terms(parts, groups, min_docs), "kept")
    total = dict(kept.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy("x.groups").agg(F.sum("x.counts")).collect())
    n_terms = dict(kept.groupBy("lang").count().collect())
    info: dict[int, tuple[int, list[int], int]] = {}
    for k, (lang, _) in enumerate(names):
        info.setdefault(langs[lang], (k, [], n_terms.get(langs[lang], 0)))[1].append(total.get(k, 0))
    sent = spark.sparkContext.broadcast(info)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, _Lang] = {}
        for batch in batches:
            lang = batch.column(0).to_numpy()
            for x in np.unique(lang).tolist():
                state = states.get(x) or states.setdefault(x, _Lang(*sent.value[x], top))
                rows = batch.filter(pa.array(lang == x))
                step = max(1, CELLS // len(state.totals))
                for a in range(0, rows.num_rows, step):
                    state.add(*rows.slice(a, step).columns[1:])
        for state in states.values():
            got = list(state.rows())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64()))], names=_names(RESULT))

    found, _ = materialize(kept.mapInArrow(score, RESULT), "scores")
    named = spark.createDataFrame([(k, *x) for k, x in enumerate(names)], "group int, lang string, source string")
    other = named.select("lang", F.col("source").alias("item"), F.col("group").alias("other"))
    sums = found.where("part = 'pair'").groupBy("group", "other").agg(F.sum("value").alias("value"))
    pairs = named.join(other, "lang").where("source <> item").join(sums, ["group", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = found.where("part = 'term'").join(named, "group").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS p FROM cells WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS q FROM l WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
