"""Context-triggered piecewise hashing of documents, and likeness by edit distance.

A rolling hash over the last ROLL bytes ends a piece where its low k bits are all ones; each piece gives
one letter. The block size 2**k is the smallest from 4 on that makes at most 64 pieces; a second signature
uses twice that size. Fingerprint: `size:letters:letters at twice the size`. Two fingerprints are compared
at equal block sizes or where one is twice the other: 1 - edit distance / longer signature, the best of the
comparable pairs; 0 if the sizes are not compatible.

Defined cases: a null text counts as empty (`4::`); two equal fingerprints have likeness 1; rows of one id
are ordered by text; the document after the last is the first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import columns, mix, shuffle_width

ROLL = 7
LETTERS = 64
LEAST, MOST = 2, 31
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ROLL bytes that end at each place (fewer at the start)."""
    h = np.zeros(len(data), np.uint32)
    for k in range(min(ROLL, len(data))):
        np.multiply(h, np.uint32(0x01000193), out=h)
        h[ROLL - 1 - k :] += data[: len(data) - (ROLL - 1 - k)] if ROLL - 1 - k < len(data) else 0
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _letters(h: np.ndarray, ends: np.ndarray) -> bytes:
    """One letter per piece; pieces beyond the 64th are part of the last."""
    if not len(h):
        return b""
    ends = ends + 1
    if not len(ends) or ends[-1] < len(h):
        ends = np.append(ends, len(h))
    starts = np.concatenate(([0], ends[:-1]))[:LETTERS]
    sums = np.add.reduceat(h, starts, dtype=np.uint32) if len(starts) else h
    sums = mix(sums.astype(np.uint64))
    return ALPHABET[(sums >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(data: bytes) -> str:
    buf = np.frombuffer(data, np.uint8)
    h = rolling(buf)
    low = np.uint32((1 << LEAST) - 1)
    at = np.flatnonzero((h & low) == low)
    if len(at) > LETTERS:
        # zeros below the lowest unset bit: how many low bits are ones
        ones = h[at]
        bits = np.log2((~ones & (ones + np.uint32(1))).astype(np.float64) + (ones == np.uint32(0xFFFFFFFF)) * 2.0**32).astype(np.int64)
        most = np.bincount(np.minimum(bits, MOST), minlength=MOST + 2)
        pieces = np.cumsum(most[::-1])[::-1] + 1
        k = next((k for k in range(LEAST, MOST) if pieces[k] <= LETTERS), MOST)
        first, second = at[bits >= k], at[bits >= k + 1]
    else:
        k, first = LEAST, at
        second = at[(h[at] & np.uint32(7)) == 7]
    if k == LEAST and len(first) + 1 > LETTERS and (not len(first) or first[-1] + 1 < len(h)):
        k, first = k + 1, second
        mask = np.uint32((1 << (k + 1)) - 1)
        second = at[(h[at] & mask) == mask]
    return f"{1 << k}:{_letters(h, first).decode()}:{_letters(h, second).decode()}"


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(count, 64) letters, 0 where none, and lengths."""
    n = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), LETTERS), np.uint8)
    for i, t in enumerate(texts):
        out[i, : n[i]] = np.frombuffer(t, np.uint8)
    return out, n


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Levenshtein distances of pairs of at most 64 letters, all at once: each column of the table is two bit sets."""
    a, n = _pack(left)
    b, m = _pack(right)
    one = np.uint64(1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    up, down, score = np.full(len(n), full), np.zeros(len(n), np.uint64), n.copy()
    top = (n - 1).clip(0).astype(np.uint64)
    weights = one << np.arange(LETTERS, dtype=np.uint64)
    for j in range(int(m.max(initial=0))):
        eq = np.where((a == b[:, j : j + 1]) & (a > 0), weights, np.uint64(0)).sum(1, dtype=np.uint64)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        plus, minus = down | ~(d0 | up), up & d0
        live = j < m
        score = score + np.where(live, ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64), 0)
        plus, minus = (plus << one) | one, minus << one
        new_up, new_down = minus | ~(d0 | plus), plus & d0
        up, down = np.where(live, new_up, up), np.where(live, new_down, down)
    return np.where(n == 0, m, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    out = np.zeros(len(left))
    who, one, two = [], [], []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        s, a, aa = x.split(":")
        t, b, bb = y.split(":")
        s, t = int(s), int(t)
        pairs = [(a, b), (aa, bb)] if s == t else [(aa, b)] if 2 * s == t else [(a, bb)] if s == 2 * t else []
        for p, q in pairs:
            who.append(i), one.append(p.encode()), two.append(q.encode())
    if who:
        size = np.maximum(np.array([max(len(p), len(q)) for p, q in zip(one, two)]), 1)
        np.maximum.at(out, who, 1 - edit_distances(one, two) / size)
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the following text's first ones, as many or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Rows dealt to ranges of ids; the first row of each range is also the last row of the range before."""
    spark = docs.sparkSession
    n = max(2, 3 * shuffle_width(spark))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    marks = [q for q in (ids.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n) or []) if q is not None]
    # at most one mark and one head per range: sizes fixed by the number of partitions
    marks = sorted({int(q) for q in marks})
    at = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    bounds = F.array(*[F.lit(m) for m in marks]).cast("array<bigint>")
    # number of marks <= id: a range number without a join
    part = F.when(F.lit(not marks), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda m: m <= at)))
    heads = docs.select(part.alias("part"), at.alias("id")).groupBy("part").agg(F.min("id").alias("head")).orderBy("part").collect()
    used = [r["part"] for r in heads]
    before = {r["head"]: (used[k - 1], int(k == 0)) for k, r in enumerate(heads)}
    own = F.struct(F.lit(0).alias("late"), part.alias("part"))
    tail = F.create_map(*[x for h, (p, _) in before.items() for x in (F.lit(h).cast("long"), F.struct(F.lit(1).alias("late"), F.lit(p).alias("part")))]) if before else None
    spots = F.array(own) if tail is None else F.array_compact(F.array(own, F.element_at(tail, at)))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), at.alias("_at"), F.explode(spots).alias("_spot"))
    rows = rows.select(id_col, "text", "_at", "_spot.part", "_spot.late")
    return rows.repartition(n, "part").sortWithinPartitions("part", "late", "_at", "text"), "part"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprint, that of its edited text, and how like they and the next document's are."""
    rows, _ = _with_next(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its successor: (part, id, text, fingerprint)
        kinds = None

        def out(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [[]] * 6
            a, b = likeness(list(cols[3]), list(cols[4])), likeness(list(cols[3]), list(cols[5]))
            types = (kinds, pa.int64(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(list(c), t) for c, t in zip(cols, types)] + [pa.array(a, pa.float64()), pa.array(b, pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key, text, part, late = columns(batch, id_col, "text", "part", "late")
            kinds = key.type
            done = []
            for k in range(len(text)):
                now = (part[k].as_py(), key[k].as_py(), text[k].as_py(), late[k].as_py())
                mark = fingerprint(now[2].encode())
                if held is not None and held[0] == now[0] and not held[3]:
                    new = edited(held[2], now[2])
                    done.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), held[4], fingerprint(new.encode()), mark))
                held = (*now, mark)
                if len(done) >= 2000:
                    yield out(done)
                    done = []
            if done:
                yield out(done)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
