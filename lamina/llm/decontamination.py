"""Benchmark decontamination with suffix arrays over the training documents.

Each slice of documents is a shard: its words become numbers, the suffixes that can match a benchmark
text at all are sorted into a suffix array, and every benchmark suffix is binary-searched in it. That
yields the suffixes that share its first `window` words; each such match is then followed to its end along the
texts, so matches have their whole length, however long, and all their places. Matches shorter than any window are left out.

A window is `window` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. A document word is hit if it lies in any occurrence of a window: the whole matches cover just these words.

Benchmark texts go to the tasks in blocks of at most BLOCK_BYTES (a longer item is a block of its own), one after
another: a larger benchmark takes more passes, and the driver and the tasks hold one block at a time.
Words are told apart by 64-bit hashes within a block and a shard; equal hashes of different words are not looked for.
Defined cases: null and empty texts have no words and no hits; repeated rows each get their own result;
an empty benchmark hits nothing; further columns are ignored (or passed on by the filter).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ALNUM_WORD, as_bytes, columns, materialize, slices, word_hashes, word_spans

WINDOW = 13
BLOCK_BYTES = 8 << 20
SLICE = 8 << 20


@dataclass
class Block:
    """Benchmark items as numbered words. suffix: word positions; need: words of the window that starts there (0: none)."""

    items: np.ndarray
    vocab: np.ndarray
    words: np.ndarray
    item_of: np.ndarray
    need: np.ndarray
    pairs: np.ndarray
    least: int
    window: int


def build_block(ids: list[str], texts: list[str | None], window: int = WINDOW) -> Block:
    buf, offs = as_bytes(pa.array(texts, pa.string()))
    starts, ends, item_of = word_spans(buf, offs, ALNUM_WORD)
    hashes = word_hashes(buf, starts, ends)
    vocab, words = np.unique(hashes, return_inverse=True)
    words = words.astype(np.int64) + 1
    size = np.bincount(item_of, minlength=len(ids))
    at = np.arange(len(words)) - (np.cumsum(size) - size)[item_of]
    left = size[item_of] - at
    need = np.where(left >= window, window, np.where((at == 0) & (left < window), left, 0))
    same = item_of[1:] == item_of[:-1]
    pairs = np.unique((words[:-1] * (len(vocab) + 1) + words[1:])[same])
    return Block(np.array(ids, object), vocab, words, item_of, need, pairs, int(need[need > 0].min()) if (need > 0).any() else 0, window)


def _rows(words: np.ndarray, at: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """The next `width` words from each place, 0 from the text's end on."""
    out = np.zeros((width, len(at)), np.int64)
    for k in range(width):
        ok = left > k
        out[k, ok] = words[at[ok] + k]
    return out


class SuffixArray:
    """Sorted suffixes of a shard, cut after `width` words; ranks of their prefixes let all queries search at once."""

    def __init__(self, words: np.ndarray, at: np.ndarray, left: np.ndarray, width: int, base: int):
        rows = _rows(words, at, left, width)
        order = np.lexsort(rows[::-1]) if len(at) else np.zeros(0, np.int64)
        self.at, self.base, self.keys, self.rank = at[order], base, [], []
        rows = rows[:, order]
        rank = np.zeros(len(at), np.int64)
        for k in range(width):
            key = rank * base + rows[k]
            self.keys.append(key)
            rank = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else rank
            self.rank.append(rank)

    def search(self, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest common prefix with any suffix, and the range of suffixes that share the first `sizes` words."""
        n = queries.shape[1]
        depth, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, rank = np.arange(n), np.zeros(n, np.int64)
        for k, key in enumerate(self.keys):
            word = queries[k, live]
            want = rank * self.base + word
            a, b = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            ok = (b > a) & (word > 0)
            live, a, b = live[ok], a[ok], b[ok]
            depth[live] = k + 1
            done = sizes[live] == k + 1
            lo[live[done]], hi[live[done]] = a[done], b[done]
            rank = self.rank[k][a]
        return depth, lo, hi


def _runs(good: np.ndarray) -> np.ndarray:
    """For each place, how many true values follow without a gap, itself included."""
    n = len(good)
    bad = np.where(good, n, np.arange(n))
    return np.minimum.accumulate(bad[::-1])[::-1] - np.arange(n)


def match(buf: np.ndarray, offs: np.ndarray, block: Block) -> dict[str, np.ndarray]:
    """Matches of one shard: windows as (document, first word, item, item's word, words), words per document, longest per item suffix."""
    starts, ends, doc = word_spans(buf, offs, ALNUM_WORD)
    n_docs = len(offs) - 1
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n_words) - n_words
    out = {"n_words": n_words, "first": first, "doc": (z := np.zeros(0, np.int64)), "at": z, "q": z, "size": z, "longest": np.zeros(len(block.words), np.int64)}
    if not block.least or not len(starts):
        return out
    hashes = word_hashes(buf, starts, ends)
    v = len(block.vocab)
    i = np.minimum(np.searchsorted(block.vocab, hashes), v - 1)
    words = np.where(block.vocab[i] == hashes, i + 1, 0)
    pair = words[:-1] * (v + 1) + words[1:]
    j = np.minimum(np.searchsorted(block.pairs, pair), max(len(block.pairs) - 1, 0))
    good = (block.pairs[j] == pair) & (doc[1:] == doc[:-1]) & (words[:-1] > 0) & (words[1:] > 0) if len(block.pairs) else np.zeros(len(pair), bool)
    reach = np.where(words > 0, 1, 0)
    reach[:-1] += np.where(good, _runs(good), 0)
    at = np.flatnonzero(reach >= block.least)
    if not len(at):
        return out
    array = SuffixArray(words, at, reach[at], block.window, v + 1)
    q = np.arange(len(block.words))
    size = np.bincount(block.item_of)
    left = (np.cumsum(size) - 1)[block.item_of] - q + 1
    queries = _rows(block.words, q, np.minimum(left, block.window), block.window)
    depth, lo, hi = array.search(queries, block.need)
    found = np.flatnonzero((block.need > 0) & (hi > lo))
    n = (hi - lo)[found]
    where = array.at[np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    q = np.repeat(found, n)
    whole = _followed(where, q, block.need[q], doc[where], block.item_of[q])
    np.maximum.at(depth, q, whole)
    return out | {"doc": doc[where], "at": where - first[doc[where]], "q": q, "size": whole, "longest": depth}


def _next(doc: np.ndarray, at: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For matches in order: whether the next one goes on a word later, in the same document and the same item."""
    return (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (q[1:] == q[:-1] + 1)


def _followed(where: np.ndarray, q: np.ndarray, need: np.ndarray, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Words of each whole match: windows that follow one another in one document as in one item are one match."""
    order = np.lexsort((q, where - q))
    on = np.zeros(len(where), bool)  # the next window belongs to the same match
    on[:-1] = _next(doc[order], where[order], item[order], q[order])
    out = np.empty(len(where), np.int64)
    out[order] = need[order] + np.where(on, _runs(on), 0)
    return out


def _maximal(m: dict[str, np.ndarray], block: Block) -> np.ndarray:
    """Numbers of the matches that are not the rest of a longer one."""
    order = np.lexsort((m["at"], m["q"] - m["at"], m["doc"]))
    doc, at, q = (m[k][order] for k in ("doc", "at", "q"))
    new = np.ones(len(order), bool)
    new[1:] = ~_next(doc, at, block.item_of[q], q)
    return order[new]


def _summaries(m: dict[str, np.ndarray], block: Block) -> tuple[list[bytes], list[list[str]]]:
    """Per document: hit words as [start, end) runs (int32 pairs), and the items with occurring windows."""
    n_docs = len(m["n_words"])
    runs: list[bytes] = [b""] * n_docs
    items: list[list[str]] = [[] for _ in range(n_docs)]
    top = _maximal(m, block)
    order = top[np.lexsort((m["at"][top], m["doc"][top]))]
    doc, at, end, item = m["doc"][order], m["at"][order], (m["at"] + m["size"])[order], block.item_of[m["q"][order]]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        e = np.maximum.accumulate(end[a:b])
        new = np.concatenate(([True], at[a + 1 : b] > e[:-1]))
        s = np.flatnonzero(new)
        runs[doc[a]] = np.stack((at[a:b][s], e[np.append(s[1:] - 1, b - a - 1)]), 1).astype(np.int32).tobytes()
        items[doc[a]] = sorted({str(block.items[x]) for x in np.unique(item[a:b])})
    return runs, items


def _n_hit(run: bytes | list[bytes]) -> int:
    """Words covered by the runs of one or more passes."""
    got = np.frombuffer(run if isinstance(run, bytes) else b"".join(run), np.int32).reshape(-1, 2)
    got = got[np.argsort(got[:, 0], kind="stable")]
    total = end = 0
    for a, b in got.tolist():
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _digest(n_words: int, run: bytes | list[bytes], items: list[str]) -> tuple[int, int, int, str, bool]:
    hit = _n_hit(run)
    names = sorted(set(items))
    return n_words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BLOCK_BYTES) -> Iterator[tuple[Broadcast, int]]:
    """(block, number of blocks): the query set as broadcast blocks of bounded size, one at a time: each is given back before the next is made. An item is in one block."""
    sc = benchmark.sparkSession.sparkContext
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 64
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = 1 + 2 * int(total // most)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(n))
    for k in range(n):
        got = benchmark.where(part == k).select(F.col(id_col).cast("string"), text_col).orderBy(id_col, text_col).toArrow()
        sent = sc.broadcast(build_block(got.column(0).to_pylist(), got.column(1).to_pylist(), window))
        yield sent, n
        if n > 1:
            sent.destroy()


SCHEMA = "n_words long, runs binary, items array<string>"


def _pass(docs: DataFrame, sent: Broadcast, text_col: str) -> DataFrame:
    """The columns beside the text, n_words, packed hit runs and items of one block."""
    others = [f for f in docs.schema if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (text,) = columns(batch, text_col)
            buf, offs = as_bytes(text)
            for a, b in slices(offs, SLICE):
                m = match(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], sent.value)
                runs, items = _summaries(m, sent.value)
                kept = [batch.column(k).slice(a, b - a) for k, n in enumerate(batch.schema.names) if n != text_col]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(m["n_words"]), pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=[f.name for f in others] + ["n_words", "runs", "items"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), SCHEMA]))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key_cols: list[str], text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the key columns, n_words, runs (list of packed hit runs) and items."""
    own, hits = docs.select(*key_cols, text_col), None
    for sent, n in blocks(benchmark, item_col, text_col, window, block_bytes):
        if n == 1:
            return _pass(own, sent, text_col).withColumn("runs", F.array("runs"))
        if hits is None:
            own, _ = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "docs")
            words, _ = materialize(_pass(own, sent, text_col), "overlaps")
            hits = words.where("octet_length(runs) > 0").select("_row", "runs", "items")
        else:
            found, _ = materialize(_pass(own.select("_row", text_col), sent, text_col).where("octet_length(runs) > 0"), "overlaps")
            hits = hits.unionByName(found.select("_row", "runs", "items"))
    # only documents with hits meet again
    hits = hits.groupBy("_row").agg(F.collect_list("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return words.drop("runs", "items").join(hits, "_row", "left").select(*key_cols, "n_words", none("runs", "array<binary>"), none("items", "array<string>"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches with their places: item, item_word and doc_word (first words, from 0), n_words. Each goes as far as both texts agree, and holds a window.

    Of matches that end in the same words only the longest is given; every place in every document is given.
    """
    found, kind = None, docs.schema[id_col].dataType.simpleString()

    def matches_of(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, text = columns(batch, id_col, text_col)
                buf, offs = as_bytes(text)
                block = sent.value
                begin = np.searchsorted(block.item_of, np.arange(len(block.items)))
                for a, b in slices(offs, SLICE):
                    m = match(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], block)
                    top = _maximal(m, block)
                    q = m["q"][top]
                    item = block.item_of[q]
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(m["doc"][top] + a)), pa.array([str(x) for x in block.items[item]], pa.string()), pa.array(q - begin[item]), pa.array(m["at"][top]), pa.array(m["size"][top])], names=[id_col, "item", "item_word", "doc_word", "n_words"])

        return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item string, item_word long, doc_word long, n_words long")

    for sent, n in blocks(benchmark, item_col, text_col, window, block_bytes):
        got = matches_of(sent)
        if n > 1:
            got, _ = materialize(got, "matches")
        found = got if found is None else found.unionByName(got)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The digest per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_overlaps(docs, benchmark, [id_col], **kw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, items = (c.to_pylist() for c in columns(batch, "n_words", "runs", "items"))
            got = [_digest(*x) for x in zip(n, runs, items)]
            cols = [batch.column(batch.schema.get_field_index(id_col))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            cols += [pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    names, hits = docs.columns, None
    for sent, n in blocks(benchmark, item_col, text_col, window, block_bytes):
        if n == 1:
            return _clean(docs, sent, text_col)
        if hits is None:
            docs, _ = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
        found, _ = materialize(_pass(docs.select("_row", text_col), sent, text_col).where("octet_length(runs) > 0").select("_row", "n_words", "runs"), "overlaps")
        hits = found if hits is None else hits.unionByName(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, runs = batch.columns
            hit = np.array([_n_hit(r) for r in runs.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(20 * hit >= n.to_numpy()))], names=["_row"])

    rows = hits.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.collect_list("runs").alias("runs"))
    return docs.join(rows.mapInArrow(run, "_row long"), "_row", "left_anti").select(*names)


def _clean(docs: DataFrame, sent: Broadcast, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (text,) = columns(batch, text_col)
            buf, offs = as_bytes(text)
            keep = np.zeros(len(text), bool)
            for a, b in slices(offs, SLICE):
                m = match(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], sent.value)
                hit = np.array([_n_hit(r) for r in _summaries(m, sent.value)[0]])
                keep[a:b] = ~((hit > 0) & (20 * hit >= m["n_words"]))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
