"""Suffix-array dedup: cut every byte covered by a string of LENGTH bytes that also starts in an earlier document.

Strings are dealt to shards by content: the windows of LENGTH bytes that share their minimizer (the smallest
hash of GRAM bytes inside) go to the same shard, as substrings of consecutive windows. Minimizers that only one
text has can't repeat and stay home. Each shard leaves out the substrings whose bytes beside the minimizer no other document
has, and sorts the suffixes of the others by external induced sorting (induction.py), whose queues carry places and common prefixes and go to disk beyond a bound. Neighbours in the sorted
suffixes whose common prefix is LENGTH bytes or more form groups; the smallest document of a group cuts the
string out of all the others.

A shard that one frequent minimizer (or a few) makes larger than LARGE_BYTES is not sorted by one task, though it could
be: its substrings, equal ones once, are cut into their windows, and those are grouped by their bytes on Spark.

Texts, substrings and minimizers are told apart by 64-bit hashes. Equal texts are one text: its copies beyond the
smallest id lose all their bytes. Defined cases: a null text counts as empty; texts shorter than LENGTH lose nothing; a
null id is neither earlier nor cut; rows of one id are not earlier than each other; extra columns are ignored (or passed
on by cut_texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import induction
from lamina.llm.common import as_bytes, columns, drop, materialize, mix, release, shuffle_width, slices, word_hashes

LENGTH = 50
#: Bytes hashed for a minimizer, and windows per substring at most.
GRAM, RUN = 16, 64
#: A window that holds a minimizer has so many bytes at least on one of its sides.
SIDE = (LENGTH - GRAM) // 2
SLICE = 1 << 20
#: Bytes of input for each shard; about a third as many are sorted in it at once.
SHARD_BYTES = 4 << 20
#: Bytes of substrings that one task sorts at most. Evenly dealt text makes up to 2.5 bytes of substrings of each byte of input, so only frequent minimizers exceed it.
LARGE_BYTES = 12 << 20
U = np.uint64


# ---------------------------------------------------------------- substrings by minimizer


def _words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    data = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf),), "<u8", data.tobytes(), 0, (1,))


def _gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of the GRAM bytes from each of the first n places on."""
    return mix(w[:n] * U(0x9E3779B97F4A7C15) + w[8 : 8 + n])


def minimizers(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: (hash, document, first window, windows); windows don't cross documents."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none.astype(U), none, none, none
    h = _gram_hashes(_words8(buf), len(buf) - GRAM + 1)
    span, k = LENGTH - GRAM + 1, 1
    while 2 * k <= span:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    if span > k:
        h = np.minimum(h[: len(h) - (span - k)], h[span - k :])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + LENGTH <= offs[doc + 1])
    if not len(at):
        return none.astype(U), none, none, none
    h, doc = h[at], doc[at]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    # longer runs (periodic texts) in pieces
    parts = -(-size // RUN)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + k * RUN
    size = np.minimum(np.repeat(size, parts) - k * RUN, RUN)
    return h[first], doc[first], at[first], size


# ---------------------------------------------------------------- one shard


def recurring(strings: tuple[np.ndarray, np.ndarray], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which strings can hold a window that a string of another document holds too.

    Equal windows have their minimizers in one place, and SIDE more bytes on its left or on its right: so the strings of one such
    sequence of bytes are told by its hash, and those with one document only (least and most are its ids) are out.
    """
    buf, size = strings
    end = np.cumsum(size)
    at = end - size
    w = _words8(buf)
    string = np.repeat(np.arange(len(size), dtype=np.int32), size)[: len(buf) - GRAM + 1]
    h = _gram_hashes(w, len(string))
    h[np.arange(len(h)) + GRAM > end[string]] = U(0xFFFFFFFFFFFFFFFF)
    gram = np.flatnonzero(h == np.minimum.reduceat(h, at)[string])
    gram = gram[gram + GRAM <= end[string[gram]]]
    codes, holders = [], []
    for salt, a in enumerate((gram - SIDE, gram)):
        own = string[gram]
        ok = (a >= at[own]) & (a + GRAM + SIDE <= end[own])
        a = a[ok]
        code = np.full(len(a), salt, U)
        for k in (*range(0, GRAM + SIDE - 8, 8), GRAM + SIDE - 8):
            code = mix(code * U(0x9E3779B97F4A7C15) + w[a + k])
        codes.append(code)
        holders.append(own[ok])
    code, own = np.concatenate(codes), np.concatenate(holders)
    order = np.argsort(code)
    code, own = code[order], own[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    first = np.flatnonzero(new)
    out = np.zeros(len(size), bool)
    if len(first):
        several = np.minimum.reduceat(least[own], first) < np.maximum.reduceat(most[own], first)
        out[own[several[np.cumsum(new) - 1]]] = True
    return out


def _whole_groups(pieces: Iterator[induction.Piece]) -> Iterator[induction.Piece]:
    """The same suffixes in pieces that never part suffixes with a common prefix of LENGTH."""
    held: list[induction.Piece] = []
    for places, lcps in pieces:
        cut = np.flatnonzero(lcps < LENGTH)
        if held and len(cut):
            k = int(cut[0])
            held.append((places[:k], lcps[:k]))
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, places, lcps, cut = [], places[k:], lcps[k:], cut - k
        if not held and len(cut):
            k = int(cut[-1])
            if k:
                yield places[:k], lcps[:k]
            places, lcps = places[k:], lcps[k:]
        held.append((places, lcps))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def repeats(strings: tuple[np.ndarray, np.ndarray], least: np.ndarray, most: int = induction.QUEUE_BYTES, base: int = induction.BASE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For windows of all strings, a piece at a time: (string, window, smallest document of any string that holds the window)."""
    buf, size = strings
    if not len(size):
        return
    at = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.uint16)
    inside = np.ones(len(text), bool)
    inside[at + size] = False
    text[inside] = buf.astype(np.uint16) + 1
    # places that a window starts at
    inside[:] = True
    for k in range(LENGTH):
        inside[(at + size - k)[size >= k]] = False
    for places, lcps in _whole_groups(induction.induced(text, LENGTH, most, base)):
        window = np.flatnonzero(inside[places])
        if not len(window):
            continue
        # a shorter suffix has a common prefix below LENGTH with both neighbours, so leaving it out parts no group
        places, lcps = places[window], lcps[window]
        own = np.searchsorted(at, places, "right") - 1
        first = np.flatnonzero(lcps < LENGTH)
        group = np.cumsum(lcps < LENGTH) - 1
        yield own, places - at[own], np.minimum.reduceat(least[own], first)[group]


# ---------------------------------------------------------------- Spark


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _anchors(docs: DataFrame, text_col: str, n_parts: int) -> DataFrame:
    """(part, anchors, cids, counts): minimizers by part of the hash range, with the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, text = batch.column(0).to_numpy(), batch.column(1)
            buf, offs = as_bytes(text)
            for a, b in slices(offs, SLICE):
                h, doc, _, _ = minimizers(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                part = (mix(h) % U(n_parts)).astype(np.int64)
                order = np.lexsort((h, doc, part))
                h, doc, part = h[order], doc[order], part[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc, part = h[new], doc[new], part[new]
                edge = np.searchsorted(part, np.arange(n_parts + 1))
                rows = []
                for p in np.flatnonzero(np.diff(edge)):
                    x, y = edge[p], edge[p + 1]
                    d, n = np.unique(doc[x:y], return_counts=True)
                    rows.append((p, h[x:y].tobytes(), cid[a:b][d].tobytes(), n.astype(np.uint32).tobytes()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "anchors", "cids", "counts"])

    return docs.select(F.xxhash64(_text(text_col)).alias("cid"), _text(text_col).alias("text")).mapInArrow(run, "part int, anchors binary, cids binary, counts binary")


def _shared(packed: DataFrame, n_parts: int) -> DataFrame:
    """(bucket, cids, counts, dups): the minimizers of each text that other texts hold too, packed by bucket of texts.

    A row holds one minimizer at least, so there are never more rows than shared minimizers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in columns(b, "anchors", "cids", "counts")))]
        if not rows:
            return
        h = np.frombuffer(b"".join(r[0] for r in rows), U)
        cid = np.repeat(np.frombuffer(b"".join(r[1] for r in rows), np.int64), np.frombuffer(b"".join(r[2] for r in rows), np.uint32))
        del rows
        order = np.lexsort((cid, h))
        h, cid = h[order], cid[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])
        h, cid = h[new], cid[new]
        tie = np.zeros(len(h), bool)
        tie[1:] = h[1:] == h[:-1]
        tie[:-1] |= tie[1:]
        h, cid = h[tie], cid[tie]
        bucket = (mix(cid.view(U)) % U(n_parts)).astype(np.int64)
        order = np.lexsort((cid, bucket))
        h, cid, bucket = h[order], cid[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(n_parts + 1))
        got = []
        for p in np.flatnonzero(np.diff(edge)):
            texts, n = np.unique(cid[edge[p] : edge[p + 1]], return_counts=True)
            got.append((p, texts.tobytes(), n.astype(np.uint32).tobytes(), h[edge[p] : edge[p + 1]].tobytes()))
        if got:
            cols = list(zip(*got))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "cids", "counts", "dups"])

    return packed.repartition(n_parts, "part").mapInArrow(run, "bucket int, cids binary, counts binary, dups binary")


def _lists(shared: DataFrame, n_parts: int) -> DataFrame:
    """(cid, dups): one row per text, with all its shared minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in columns(b, "cids", "counts", "dups")))]
        if not rows:
            return
        cid = np.repeat(np.frombuffer(b"".join(r[0] for r in rows), np.int64), np.frombuffer(b"".join(r[1] for r in rows), np.uint32))
        h = np.frombuffer(b"".join(r[2] for r in rows), U)
        del rows
        order = np.argsort(cid, kind="stable")
        h, cid = h[order], cid[order]
        cuts = np.append(np.flatnonzero(np.diff(cid, prepend=cid[0] - 1)), len(cid))
        for a in range(0, len(cuts) - 1, 5_000):
            some = cuts[a : a + 5_001].tolist()
            data = [h[x:y].tobytes() for x, y in zip(some, some[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(cid[some[:-1]]), pa.array(data, pa.binary())], names=["cid", "dups"])

    return shared.repartition(n_parts, "bucket").mapInArrow(run, "cid long, dups binary")


def _substrings(texts: DataFrame, n_shards: int) -> DataFrame:
    """From (id, cid, text, dups): rows (shard, packed substrings) and rows (hash, id, cid, at) of their occurrences."""
    names = ["shard", "bytes", "sizes", "hashes", "lows", "highs", "total", "hash", "id", "cid", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cids, text, dups = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_pylist()
            buf, offs = as_bytes(text)
            for a, b in slices(offs, 2 * SLICE):
                own, o = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                h, doc, at, n = minimizers(own, o)
                known = np.unique(np.frombuffer(b"".join(dups[a:b]), U))
                if not len(known) or not len(h):
                    continue
                # a minimizer shared by one document of the slice is shared by all that hold it
                spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                use = known[spot] == h
                h, doc, at, n = h[use], doc[use], at[use], n[use]
                size = n + LENGTH - 1
                code = word_hashes(own, at, at + size, lower=False)
                shard = (mix(h ^ U(0x94D049BB133111EB)) % U(n_shards)).astype(np.int64)
                who = ids[a:b][doc]
                none = pa.nulls(len(h), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(h), pa.int32()), none, none, none, none, none, pa.nulls(len(h), pa.int64()), pa.array(code.view(np.int64)), pa.array(who), pa.array(cids[a:b][doc]), pa.array((at - o[doc]).astype(np.int32))], names=names
                )
                order = np.lexsort((who, code, shard))
                code, shard, who, at, size = code[order], shard[order], who[order], at[order], size[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])
                first = np.flatnonzero(new)
                low, high = who[first], who[np.append(first[1:], len(who)) - 1]
                code, shard, at, size = code[first], shard[first], at[first], size[first]
                edge = np.searchsorted(shard, np.arange(n_shards + 1))
                rows = []
                for s in np.flatnonzero(np.diff(edge)):
                    x, y = edge[s], edge[s + 1]
                    start = np.cumsum(size[x:y]) - size[x:y]
                    src = np.repeat(at[x:y] - start, size[x:y]) + np.arange(int(size[x:y].sum()))
                    rows.append((s, _packed(own[src].tobytes()), size[x:y].astype(np.uint8).tobytes(), code[x:y].tobytes(), low[x:y].tobytes(), high[x:y].tobytes(), len(src)))
                if rows:
                    *cols, total = zip(*rows)
                    k = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]], pa.array(total, pa.int64()), *[pa.nulls(k, pa.int64())] * 3, pa.nulls(k, pa.int32())], names=names
                    )

    schema = "shard int, bytes binary, sizes binary, hashes binary, lows binary, highs binary, total long, hash long, id long, cid long, at int"
    return texts.mapInArrow(run, schema)


def _packed(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def _expanded(data: bytes, sizes: bytes) -> bytes:
    """The substrings of a row, one after another; they wait packed for their shard's task."""
    return pa.Codec("zstd").decompress(data, int(np.frombuffer(sizes, np.uint8).sum(dtype=np.int64)), asbytes=True)


def _cuts_of(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One shard: (hash, off, n, low) of the runs to cut."""
    buf = np.frombuffer(b"".join(_expanded(r[0], r[1]) for r in rows), np.uint8)
    size = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).astype(np.int64)
    code = np.frombuffer(b"".join(r[2] for r in rows), U)
    low = np.frombuffer(b"".join(r[3] for r in rows), np.int64)
    high = np.frombuffer(b"".join(r[4] for r in rows), np.int64)
    at = np.cumsum(size) - size
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    lows, highs = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(lows, number, low)
    np.maximum.at(highs, number, high)
    code, at, size = code[first], at[first], size[first]
    start = np.cumsum(size) - size
    own = buf[np.repeat(at - start, size) + np.arange(int(size.sum()))]
    del buf
    if len(size):
        use = recurring((own, size), lows, highs)
        own, code, size, lows, highs = own[np.repeat(use, size)], code[use], size[use], lows[use], highs[use]
    got = [(np.zeros(0, np.int64),) * 3]
    for which, off, least in repeats((own, size), lows):
        use = least < highs[which]
        got.append((which[use], off[use], least[use]))
    which, off, least = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((off, which))
    which, off, least = which[order], off[order], least[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (off[1:] != off[:-1] + 1) | (least[1:] != least[:-1])
    f = np.flatnonzero(new)
    n = np.diff(np.append(f, len(which)))
    return code[which[f]].view(np.int64), off[f].astype(np.int32), n.astype(np.int32), least[f]


def _cuts(packed: DataFrame, n_parts: int) -> DataFrame:
    """(hash, off, n, low): runs of windows of a substring that an earlier document holds, and the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for b in batches:
            for shard, *row in zip(*(c.to_pylist() for c in columns(b, "shard", "bytes", "sizes", "hashes", "lows", "highs"))):
                shards.setdefault(shard, []).append(row)
        while shards:
            _, rows = shards.popitem()
            code, off, n, low = _cuts_of(rows)
            for a in range(0, len(code), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (code, off, n, low)], names=["hash", "off", "n", "low"])

    return packed.repartition(n_parts, "shard").mapInArrow(run, "hash long, off int, n int, low long")


def _by_size(packed: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the shards that one task can sort, rows of the larger ones or None)."""
    large = [r[0] for r in packed.groupBy("shard").agg(F.sum("total").alias("n")).where(F.col("n") > most).select("shard").collect()]
    if not large:
        return packed, None
    return packed.where(~F.col("shard").isin(large)), packed.where(F.col("shard").isin(large))


def _strings(packed: DataFrame) -> DataFrame:
    """(hash, string, low, high): the distinct substrings of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, sizes, hashes, lows, highs in zip(*(c.to_pylist() for c in columns(batch, "bytes", "sizes", "hashes", "lows", "highs"))):
                ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64)).tolist()
                data = _expanded(data, sizes)
                strings = [data[a:b] for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)), pa.array(strings, pa.binary()), *[pa.array(np.frombuffer(x, np.int64)) for x in (lows, highs)]], names=["hash", "string", "low", "high"])

    rows = packed.select("bytes", "sizes", "hashes", "lows", "highs").mapInArrow(run, "hash long, string binary, low long, high long")
    return rows.groupBy("hash").agg(F.first("string").alias("string"), F.min("low").alias("low"), F.max("high").alias("high"))


def _cuts_by_window(strings: DataFrame) -> DataFrame:
    """What _cuts gives, for shards that no task can hold: equal windows meet by their bytes, counted before they are shuffled."""
    places = F.expr(f"sequence(0, octet_length(string) - {LENGTH})")
    windows = strings.select("hash", "string", "low", "high", F.explode(places).alias("off")).select(F.expr(f"substring(string, off + 1, {LENGTH})").alias("window"), "hash", "off", "low", "high")
    least = windows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("window", "least")
    hits = windows.select("window", "hash", "off", "high").join(least, "window").where("least < high")
    # windows that follow one another become runs again; a substring has RUN windows at most
    rank = F.row_number().over(Window.partitionBy("hash", "least").orderBy("off"))
    runs = hits.select("hash", "off", "least", (F.col("off") - rank).alias("run")).groupBy("hash", "least", "run").agg(F.min("off").alias("off"), F.count("*").cast("int").alias("n"))
    return runs.select("hash", "off", "n", F.col("least").alias("low"))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, cid, n_bytes, sha, first id of the text) per row, (id, cid, runs of windows to cut) of first documents)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("cid"), F.octet_length(_text(text_col)).cast("long").alias("n_bytes"), F.sha2(_text(text_col), 256).alias("sha"))
    meta, _ = materialize(own, "texts")
    firsts = meta.groupBy("cid").agg(F.min(F.col("id").cast("long")).alias("first"), F.max("n_bytes").alias("size"))
    total = meta.agg(F.sum("n_bytes")).first()[0] or 0
    # about 16 MB of minimizers a part
    n_parts = int(max(shuffle_width(spark), total // 2 // (16 << 20) + 1))
    shared, at_shared = materialize(_shared(_anchors(docs, text_col, n_parts), n_parts), "shared")
    release(spark)
    lists = _lists(shared, n_parts)
    wanted = firsts.where(F.col("first").isNotNull() & (F.col("size") >= LENGTH)).join(lists, "cid").select(F.col("first").alias("_first"), F.col("cid").alias("_cid"), "dups")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), _text(text_col).alias("_text"))
    chosen = texts.join(wanted, (F.col("_id") == F.col("_first")) & (F.xxhash64("_text") == F.col("_cid")))
    n_shards = int(max(n_parts, total // SHARD_BYTES + 1))
    subs, at_subs = materialize(_substrings(chosen.select("_id", "_cid", "_text", "dups"), n_shards), "substrings")
    drop(spark, at_shared)
    release(spark)
    fit, large = _by_size(subs.where("shard IS NOT NULL"), LARGE_BYTES)
    cuts = _cuts(fit.select("shard", "bytes", "sizes", "hashes", "lows", "highs"), n_parts)
    if large is not None:
        strings, at_strings = materialize(_strings(large), "strings")
        cuts = cuts.unionByName(_cuts_by_window(strings))
    places = subs.where("shard IS NULL").select("hash", "id", "cid", "at")
    hits = places.join(cuts, "hash").where(F.col("low") < F.col("id")).select("id", "cid", (F.col("at") + F.col("off")).alias("a"), (F.col("at") + F.col("off") + F.col("n") + LENGTH - 1).alias("b"))
    runs, _ = materialize(hits.groupBy("id", "cid").agg(F.collect_set(F.struct("a", "b")).alias("runs")), "runs")
    drop(spark, at_subs, *([at_strings] if large is not None else []))
    release(spark)
    named = meta.join(firsts.select("cid", "first"), "cid")
    return named, runs


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _pairs(runs) -> list[tuple[int, int]]:
    return [(r["a"], r["b"]) for r in runs or ()]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    named, runs = _spans(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cid, text, spans = batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            got = []
            for t, s in zip(text, spans):
                m = _merged(_pairs(s))
                got.append((sum(b - a for a, b in m), len(m), hashlib.sha256(_kept(t.encode(), m)).hexdigest()))
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([ids, cid, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["_id", "_cid", "cut", "spans", "kept"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(_text(text_col)).alias("_cid"), _text(text_col).alias("_text"))
    cut = texts.join(runs, (F.col("_id") == F.col("id")) & (F.col("_cid") == F.col("cid"))).select("_id", "_cid", "_text", "runs")
    cut = cut.mapInArrow(run, "_id long, _cid long, cut long, spans long, kept string").dropDuplicates(["_id", "_cid"])
    rows = named.join(cut, (F.col("id").cast("long") == F.col("_id")) & (F.col("cid") == F.col("_cid")), "left")
    copy = F.coalesce((F.col("id").cast("long") > F.col("first")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    return rows.select(
        F.col("id").cast(kind).alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The documents with repeated passages cut out (characters that a cut has broken go too) and their length set anew."""
    named, runs = _spans(docs, id_col, text_col)
    later = named.where((F.col("id").cast("long") > F.col("first")) & (F.col("n_bytes") >= LENGTH)).select(F.col("id").cast("long").alias("_run_id"), F.col("cid").alias("_run_cid"), F.lit(True).alias("_copy"), F.lit(None).alias("_runs")).distinct()
    known = runs.select(F.col("id").alias("_run_id"), F.col("cid").alias("_run_cid"), F.lit(False).alias("_copy"), F.col("runs").alias("_runs"))
    known = known.unionByName(later.withColumn("_runs", F.col("_runs").cast(known.schema["_runs"].dataType)))
    rows = docs.join(known, (F.col(id_col).cast("long") == F.col("_run_id")) & (F.xxhash64(_text(text_col)) == F.col("_run_cid")), "left").drop("_run_id", "_run_cid")
    names = docs.columns
    counted = count_col in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans, copy = (c.to_pylist() for c in columns(batch, text_col, "_runs", "_copy"))
            new, size = [], []
            for t, s, c in zip(text, spans, copy):
                if t is not None and c:
                    t = ""
                elif t is not None and s:
                    t = _kept(t.encode(), _merged(_pairs(s))).decode("utf-8", "ignore")
                new.append(t)
                size.append(len(t) if t is not None else 0)
            cols = []
            for k, n in enumerate(names):
                col = batch.column(k)
                if n == text_col:
                    col = pa.array(new, col.type)
                elif n == count_col and counted:
                    changed = [x if y == z else w for x, y, z, w in zip(col.to_pylist(), new, text, size)]
                    col = pa.array(changed, col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, docs.schema)
