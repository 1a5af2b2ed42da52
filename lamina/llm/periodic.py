"""Periodic runs of words, by Lyndon arrays over ordered alphabets.

A run is a stretch of words with smallest period p that no neighbouring word extends. Each run holds a longest
Lyndon word of length p, under an alphabet's order or its reverse (the end of the text is smallest in both), and is
found from it: from place i to its next smaller suffix j, p = j - i, to the right as far as the suffixes at i and j
agree, to the left as far as the words before i and j do.

`lyndon_array` reads the text once from the left. All pairs of places that it compares are nested, so a later pair
that lies in a stretch matched before was compared there already: its extension is copied, and words are compared
from the end of that stretch on only. `left_extensions` does the same from the right, for pairs of a place
and its next smaller suffix. Every comparison of two words ends its pair or moves the end of what was read, so the
whole takes linear time, and words are only ever compared with each other: no suffix array or tree, no hashes of stretches.

Words that cannot lie in a run of the wanted exponent are left out first (`stretches`): such a run is longer by k than
its period, so each k words in a row within it occur again in the text. What is left is cut into stretches, each of them
searched alone; a run lies in one of them, with the words that end it.

A document is one row of one task, and is held there whole; a task takes one Arrow batch at a time.

Defined cases: null and empty texts, and those of spaces only, have no words and no runs, and collapse to ''; a null id is kept;
repeated rows each get their result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import as_bytes, columns

#: Rows that go back to Spark at a time: collapsed texts are as long as texts.
ROWS = 512


def lyndon_array(text: list[int]) -> tuple[list[int], list[int]]:
    """For each place of a text of numbers from 0: its next smaller suffix, and how many words the two suffixes share."""
    n = len(text)
    t = [*text, -1]
    next_smaller, shared = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n  # the previous smaller suffix, and what it shares
    s = b = e = 0  # t[s : s + e - b] equals t[b:e], the stretch that reaches farthest
    for j in range(1, n):
        i, ext = j - 1, 0
        while True:
            if b < j and j + ext < e:
                shift = b - s
                i2, j2 = i - shift, j - shift
                ext = shared[i2] if next_smaller[i2] == j2 else shared_before[j2]
                if j + ext >= e:
                    ext = e - j
                    while t[i + ext] == t[j + ext]:
                        ext += 1
                    s, b, e = i, j, j + ext
            else:
                while t[i + ext] == t[j + ext]:
                    ext += 1
                if j + ext >= e:
                    s, b, e = i, j, j + ext
            if t[i + ext] < t[j + ext]:
                before[j], shared_before[j] = i, ext
                break
            # i is done; those before it that share more with it than j does are done as well
            next_smaller[i], shared[i] = j, ext
            up, known = before[i], shared_before[i]
            while up >= 0 and known > ext:
                next_smaller[up], shared[up] = j, ext
                up, known = before[up], shared_before[up]
            if up < 0:
                break
            if known < ext:
                before[j], shared_before[j] = up, known
                break
            i = up
    return next_smaller, shared


def left_extensions(t: list[int], next_smaller: list[int]) -> list[int]:
    """For each place i and its next smaller suffix j: how many words before both agree, at most j - i."""
    n = len(t)
    out = [0] * n
    s = b = e = n  # t[e:s] equals t[e + b - s : b], the stretch that reaches farthest to the left
    for i in range(n - 1, -1, -1):
        j = next_smaller[i]
        most = min(j - i, i)
        if i > e:
            k = out[i + b - s]
            if k < i - e:
                out[i] = k
                continue
            k = min(i - e, most)
        else:
            k = 0
        while k < most and t[i - 1 - k] == t[j - 1 - k]:
            k += 1
        out[i] = k
        if i - k <= e:
            s, b, e = i, j, i - k
    return out


def _all_runs(text: list[int]) -> set[tuple[int, int, int]]:
    top, found = max(text), set()
    for t in (text, [top - c for c in text]):
        next_smaller, shared = lyndon_array(t)
        left = left_extensions(t, next_smaller)
        for i, j in enumerate(next_smaller):
            p = j - i
            if left[i] < p <= left[i] + shared[i]:
                found.add((i - left[i], p + left[i] + shared[i], p))
    return found


def stretches(codes: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """[start, end) of the places that a run of at least `least` words and `exponent` periods may hold."""
    n = len(codes)
    # the shortest run of each period is longer than it by so many words
    k = min(max(least, exponent * p) - p for p in range(1, max(least, 1) + 1))
    if n <= k:
        return []
    grams, top, width = codes.astype(np.int64), int(codes.max()) + 1, 1
    while width < k:
        if top > 2_000_000_000:
            names, grams = np.unique(grams, return_inverse=True)
            top = len(names)
        step = min(width, k - width)
        grams, top, width = grams[:-step] * top + grams[step:], top * top, width + step
    order = np.argsort(grams, kind="stable")
    again = grams[order]
    again = again[1:] == again[:-1]
    if not again.any():
        return []
    edge = np.zeros(n + 1, np.int32)
    at = np.unique(np.concatenate((order[1:][again], order[:-1][again])))
    edge[at] += 1
    np.subtract.at(edge, at + k, 1)
    on = np.cumsum(edge[:n]) > 0
    cut = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
    return list(zip(cut[::2].tolist(), cut[1::2].tolist()))


def runs(words: list, exponent: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `exponent` (2 or more) periods and `least` words, by start and period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    if len(words) < max(least, exponent):
        return []
    seen: dict = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    found = []
    for a, b in stretches(codes, exponent, least) if len(seen) < len(words) else []:
        rank = {w: k for k, w in enumerate(sorted(set(words[a:b])))}
        found += [(a + s, n, p) for s, n, p in _all_runs([rank[w] for w in words[a:b]]) if n >= max(least, exponent * p)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per document: the id, n_words, runs (start, length, period; by start, then period) and collapsed, the text's words without repeated periods, joined by one space. Words are split at the characters 9 to 13 and 32."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = columns(batch, id_col, text_col)
            for a in range(0, len(ids), ROWS):
                buf, offs = as_bytes(text.slice(a, ROWS))
                sizes, found, left = [], [], []
                for k in range(len(offs) - 1):
                    words = buf[offs[k] : offs[k + 1]].tobytes().split()  # bytes are split at just these characters
                    got = runs(words, exponent, least)
                    sizes.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r)) for r in got])
                    left.append(b" ".join(collapsed(words, got)).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(a, ROWS), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(run)), pa.array(left, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(search, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the documents whose checksum of the id ends in 0 made periodic from one of their words on; others, and those without an id, as they are."""
    h = F.crc32(F.col(id_col).cast("string"))
    split = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = docs.select(id_col, text_col, F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, split).alias("_words")).withColumn("_n", F.size("_words"))
    n = F.col("_n").cast("long")
    a = (F.col("_g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    words = F.concat(F.slice("_words", F.lit(1), a), F.slice(again, F.lit(1), (n - a).cast("int")))
    return out.select(id_col, F.when(F.col("_n") > 0, F.array_join(words, " ")).otherwise(F.col(text_col)).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each document's runs: their number, the longest one (ties: the first, then the smaller period), and digests of the runs and the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), top.alias("_top"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(id_col, "n_runs", (-F.col("_top.start")).alias("start"), F.col("_top.length").alias("length"), (-F.col("_top.period")).alias("period"), F.floor(1000 * F.col("_top.length") / -F.col("_top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
