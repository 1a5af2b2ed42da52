"""N-gram Jaccard join by filters under several global token orders.

A document's set holds its distinct word shingles as 64-bit hashes; with fewer words than a shingle the whole
sequence is one shingle; without words it is empty and links with nothing. Two documents link when
den * |A and B| >= num * |A or B|.

Orders: each sorts tokens by a frequency level (from counts over all documents) and then by a hash of its
own. Under any such order, linked sets share a token among their first n - ceil(t n) + 1 ("prefix"). The
first order's prefixes make groups, of the sets whose size fits another's in the group; inside a group a pair goes on
only if the sizes fit, the prefixes under the second and the third order can share a token as well (bit maps), and the
parity maps of the whole sets don't differ in more bits than linked sets can. What passes all filters is verified on the whole sets.

Equal sets count once throughout. A first round verifies a few candidates of each set only: those whose parity maps
differ least, and those of the smallest hashes; large groups are looked at around their hubs, the members that differ least from a
sample. The second round verifies all candidates whose sets are then still in different components. Groups of more
than CHUNK sets are compared in blocks. So no link between components is lost, and near copies, however
many, are not verified against all of each other.

Sets and shingles are told apart by 64-bit hashes; equal hashes of different ones are not looked for.

Defined cases: null and empty texts: no shingles, a component of their own; repeated rows: the same component;
a null id is never the smallest unless the component has no other; extra columns are ignored (or passed on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import SPACED_WORD, as_bytes, columns, drop, materialize, mix, release, shuffle_width, slices, word_hashes, word_spans

ORDERS = 3
#: Buckets of the document-frequency sketch, and stripes that it is summed in.
SKETCH, STRIPES = 1 << 21, 64
#: Candidates per set in the first round (half of them the nearest); sets up to which it looks at a whole group; sets per block.
PARTNERS, WHOLE, CHUNK = 4, 256, 2048
#: Members of a large group that all others are measured against, to find its hubs; hubs.
SAMPLE, HUBS = 16, 2
#: Prefix tokens of each set, the smallest by hash, under which the first round looks for partners; the last round looks under all.
FIRST = 8
#: 64-bit words of each prefix bit map; bits a token of the parity maps, and the binary logarithm of their least size.
MAP, NARROW, WIDE, LEAST_LOG = 4, 1 / 2, 4, 9
#: Binary logarithm of the bits of the map of needed documents, by which texts are left out before they are shuffled.
NEED_LOG = 24
U = np.uint64
#: A prefix token of a set, while it waits for its group.
MEMBER = np.dtype([("token", "<u8"), ("sid", "<u8"), ("n", "<u4")])


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes per document, one after another; offsets)."""
    starts, ends, doc = word_spans(buf, offs, SPACED_WORD)
    h = word_hashes(buf, starts, ends)
    n_docs = len(offs) - 1
    n = np.bincount(doc, minlength=n_docs)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))
    first = np.arange(len(h)) == np.repeat(np.cumsum(n) - n, n)
    use = np.flatnonzero((left >= words) | (first & (left < words)))
    out = np.zeros(len(use), U)
    for k in range(words):
        ok = left[use] > k
        out = np.where(ok, mix(out * U(0x9E3779B97F4A7C15) + h[np.minimum(use + k, max(len(h) - 1, 0))]), out) if len(use) else out
    own = doc[use]
    order = np.lexsort((out, own))
    out, own = out[order], own[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    out, own = out[new], own[new]
    return out, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n_docs))))


def set_ids(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets, equal ids (0 for the empty one)."""
    n = np.diff(at)
    total = np.zeros(len(n), U)
    if len(tokens):
        full = n > 0
        total[full] = np.add.reduceat(mix(tokens ^ U(0x5851F42D4C957F2D)), at[:-1][full])
        total[full] = mix(total[full] + n[full].astype(U))
    return total


def prefix_size(n: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    num, den = threshold
    return np.where(n > 0, n - (-(-n * num // den)) + 1, 0)


def most_differing(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """How many tokens linked sets of these sizes can have in one only; negative where the sizes don't fit."""
    num, den = threshold
    need = -(-(a + b) * num // (num + den))  # least intersection
    return np.where(need <= np.minimum(a, b), a + b - 2 * need, -1)


def order_keys(tokens: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """Place of tokens in the k-th order: level first, then a hash of the order's own."""
    # the fixed odd multiples wrap around, as all of this arithmetic does
    salt = U((k + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    lv = level[(tokens >> U(40)).astype(np.int64) % SKETCH].astype(U)
    return (lv << U(56)) | (mix(tokens + salt) >> U(8))


def prefixes(tokens: np.ndarray, at: np.ndarray, level: np.ndarray, k: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(token, document) rows of the prefixes under the k-th order."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((order_keys(tokens, level, k), doc))
    rank = np.arange(len(tokens)) - at[:-1][doc]
    keep = rank < prefix_size(n, threshold)[doc]
    return tokens[order][keep], doc[keep]


def bit_maps(tokens: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, MAP) bit maps of tokens."""
    bit = mix(tokens ^ U(0x2545F4914F6CDD1D)) % U(64 * MAP)
    on = np.bincount(doc * (64 * MAP) + bit.astype(np.int64), minlength=n_docs * 64 * MAP).reshape(n_docs, MAP, 64) > 0
    return np.packbits(on, axis=2, bitorder="little").reshape(n_docs, MAP, 8).copy().view(U)[:, :, 0]


def parity_maps(tokens: np.ndarray, at: np.ndarray, per_token: float) -> list[bytes]:
    """Parity map of each set, of at least so many bits a token; its size is a power of two."""
    code = mix(tokens ^ U(0x9FB21C651E98DF25))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        bits = 1 << max(LEAST_LOG, (int(per_token * (b - a)) - 1).bit_length())
        on = np.bincount((code[a:b] & U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(on.astype(np.uint8), bitorder="little").tobytes())
    return out


def maps_differ(x: bytes, y: bytes) -> int:
    """Bits in which two parity maps differ; the larger is folded to the smaller one's size."""
    a, b = np.frombuffer(x, U), np.frombuffer(y, U)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def differences(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the parity maps of pairs differ: about the tokens that one of them has alone, or fewer."""
    differ = np.zeros(len(i), np.int64)
    # parity maps differ in size by a factor of two at most where the sizes of the sets fit
    one, two = a["class"][i], a["class"][j]
    for p, q in set(zip(one.tolist(), two.tolist())):
        at = np.flatnonzero((one == p) & (two == q))
        x, y = a["parity"][p][a["row"][i[at]]], a["parity"][q][a["row"][j[at]]]
        least = min(x.shape[1], y.shape[1])
        x, y = (np.bitwise_xor.reduce(m.reshape(len(m), -1, least), axis=1) for m in (x, y))
        differ[at] = np.bitwise_count(x ^ y).sum(1)
    return differ


def passing(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs pass the size filter, the prefix filters of the further orders, and the parity filter; and the bits in which they differ."""
    most = most_differing(a["n"][i], a["n"][j], threshold)
    keep = np.flatnonzero(most >= 0)
    for k in range(ORDERS - 1):
        m = a["maps"][:, k * MAP : (k + 1) * MAP]
        keep = keep[(m[i[keep]] & m[j[keep]]).any(1)]
    differ = differences(a, i[keep], j[keep])
    ok = differ <= most[keep]
    return keep[ok], differ[ok]


def unpacked(maps: pa.Array) -> dict:
    """Prefix maps, and parity maps by size class with each row's class and place in it."""
    buf, offs = as_bytes(maps)
    head = (ORDERS - 1) * MAP * 8
    size = np.diff(offs) - head
    first = np.frombuffer(np.ascontiguousarray(buf[(offs[:-1, None] + np.arange(head)).ravel()]), U).reshape(len(size), -1)
    classes, number = np.unique(size, return_inverse=True)
    row, parity = np.zeros(len(size), np.int64), []
    for c, w in enumerate(classes):
        own = np.flatnonzero(number == c)
        row[own] = np.arange(len(own))
        parity.append(np.ascontiguousarray(buf[(offs[own, None] + head + np.arange(w)).ravel()]).view(U).reshape(len(own), -1))
    return {"maps": first, "class": number, "row": row, "parity": parity}


def _scan(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (id, n, sid, cid: a hash of the text) of documents, and rows (stripe, counts) of each task's frequency sketch (counts of 255 or less)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.zeros(SKETCH, np.uint8)
        kind = None
        names = ["id", "n", "sid", "cid", "stripe", "counts"]
        for batch in batches:
            key, text, cid = batch.columns
            kind = key.type
            buf, offs = as_bytes(text)
            for a, b in slices(offs):
                t, at = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                on, more = np.unique((t >> U(40)).astype(np.int64) % SKETCH, return_counts=True)
                freq[on] = np.minimum(freq[on] + more, 255)
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a), pa.array(np.diff(at)), pa.array(set_ids(t, at).view(np.int64)), cid.slice(a, b - a), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names=names)
        if kind is not None:
            none = pa.nulls(STRIPES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(STRIPES, kind), none, none, none, pa.array(np.arange(STRIPES, dtype=np.int32)), pa.array([x.tobytes() for x in freq.reshape(STRIPES, -1)], pa.binary())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {kind}, n long, sid long, cid long, stripe int, counts binary")


def _levels(sketch: DataFrame) -> np.ndarray:
    """Frequency level by bucket: 0 up to twice the median count, then its binary logarithm. SKETCH bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(*(x.to_pylist() for x in batch.columns)):
                total[s] = total.get(s, 0) + np.frombuffer(c, np.uint8).astype(np.int64)
        # an eighth of a power of two is exact enough for an order
        logs = {s: np.minimum(np.log2(x + 1.0) * 4, 255).astype(np.uint8).tobytes() for s, x in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(logs), pa.int32()), pa.array(list(logs.values()), pa.binary())], names=["stripe", "logs"])

    n = min(STRIPES, shuffle_width(sketch.sparkSession))
    got = sketch.repartition(n, "stripe").mapInArrow(run, "stripe int, logs binary").toPandas()
    logs = np.zeros((STRIPES, SKETCH // STRIPES))
    for s, x in zip(got["stripe"], got["logs"]):
        logs[s] = np.frombuffer(x, np.uint8)
    logs = logs.ravel() / 4
    return np.maximum(np.floor(logs - np.median(logs)), 0).astype(np.uint8)


def _members(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: tuple[int, int], level: np.ndarray, n_parts: int) -> DataFrame:
    """Rows (part, tokens, set ids and sizes, packed) of first-order prefixes, and rows (sid, n, maps, wide map) of sets."""
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "sid", "n", "data", "wide"]
        for batch in batches:
            (text,) = columns(batch, text_col)
            buf, offs = as_bytes(text)
            for a, b in slices(offs):
                t, at = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                n, sid = np.diff(at), set_ids(t, at)
                _, one = np.unique(sid, return_index=True)
                one = one[n[one] > 0]
                m = np.empty((len(n), (ORDERS - 1) * MAP), U)
                for k in range(1, ORDERS):  # one order at a time: its arrays are as long as the tokens
                    m[:, (k - 1) * MAP : k * MAP] = bit_maps(*prefixes(t, at, sent.value, k, threshold), len(n))
                small, wide = parity_maps(t, at, NARROW), parity_maps(t, at, WIDE)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(one), pa.int32()), pa.array(sid[one].view(np.int64)), pa.array(n[one]), pa.array([m[x].tobytes() + small[x] for x in one], pa.binary()), pa.array([wide[x] for x in one], pa.binary())], names=names
                )
                del m, small, wide
                tok, doc = prefixes(t, at, sent.value, 0, threshold)
                del t
                chosen = np.zeros(len(n), bool)
                chosen[one] = True
                tok, doc = tok[chosen[doc]], doc[chosen[doc]]
                part = (mix(tok) % U(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                # the lowest bit of a token tells whether it is one of the set's FIRST
                by, rank = np.lexsort((mix(tok), doc)), np.empty(len(tok), np.int64)
                rank[by] = np.arange(len(by)) - np.searchsorted(doc[by], doc[by])
                pairs = np.empty(len(tok), MEMBER)
                pairs["token"], pairs["sid"], pairs["n"] = ((tok >> U(1)) << U(1) | (rank < FIRST).astype(U))[order], sid[doc[order]], n[doc[order]]
                edge = np.searchsorted(part[order], np.arange(n_parts + 1))
                del tok, doc, part, order, by, rank
                on = np.flatnonzero(np.diff(edge))
                none = pa.nulls(len(on), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), none, none, pa.array([pairs[edge[p] : edge[p + 1]].tobytes() for p in on], pa.binary()), pa.nulls(len(on), pa.binary())], names=names)

    return docs.select(text_col).mapInArrow(run, "part int, sid long, n long, data binary, wide binary")


def fitting(token: np.ndarray, n: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which members of the groups of one token have another one there whose size fits: the next smaller or the next larger one fits best."""
    order = np.lexsort((n, token))
    t, m = token[order], n[order]
    pair = np.flatnonzero((t[1:] == t[:-1]) & (most_differing(m[:-1], m[1:], threshold) >= 0))
    ok = np.zeros(len(n), bool)
    ok[order[pair]] = ok[order[pair + 1]] = True
    return ok


def _groups(packed: DataFrame, threshold: tuple[int, int], n_parts: int) -> DataFrame:
    """Rows (key, side, size, sid, low): members of the groups that have another one of fitting size there. Large groups are dealt in pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [x for b in batches for x in b.column(0).to_pylist()]
        got = np.frombuffer(b"".join(data), MEMBER)
        del data
        got = got[np.lexsort((got["sid"], got["token"] >> U(1)))]
        low, token, sid = (got["token"] & U(1)).astype(bool), got["token"] >> U(1) << U(1), got["sid"].copy()
        new = np.ones(len(got), bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        keep = np.flatnonzero(new)
        keep = keep[fitting(token[keep], got["n"][keep].astype(np.int64), threshold)]
        token, sid, low = token[keep], sid[keep], low[keep]
        _, group, size = np.unique(token, return_inverse=True, return_counts=True)
        size = size[group]
        small = size <= CHUNK
        yield _member_rows(mix(token[small]), np.full(int(small.sum()), 2), size[small], sid[small], low[small])
        for t in np.unique(token[~small]):
            own, first = sid[token == t], low[token == t]
            blocks = -(-len(own) // CHUNK)
            mine = mix(own) % U(blocks)
            for p in range(blocks):
                for q in range(p, blocks):
                    key = mix(np.array([t]) + U((p * 0x9E3779B97F4A7C15 + q * 0xC2B2AE3D27D4EB4F) % (1 << 64)))
                    for side, which in ((2, p),) if p == q else ((0, p), (1, q)):
                        part = own[mine == U(which)]
                        yield _member_rows(np.repeat(key, len(part)), np.full(len(part), side), np.full(len(part), len(own)), part, first[mine == U(which)])

    return packed.select("part", "data").repartition(n_parts, "part").select("data").mapInArrow(run, "key long, side int, size long, sid long, low boolean")


def _member_rows(key: np.ndarray, side: np.ndarray, size: np.ndarray, sid: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(side.astype(np.int32)), pa.array(size.astype(np.int64)), pa.array(sid.view(np.int64)), pa.array(low)], names=["key", "side", "size", "sid", "low"])


def _pairs_of_group(g: dict[str, np.ndarray], at: np.ndarray, final: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to test, in pieces of bounded size."""
    size = int(g["size"][at[0]])
    cross = g["side"][at[0]] != 2
    if not final:
        if size <= WHOLE:
            i, j = np.triu_indices(len(at), 1)
            yield at[i], at[j]
            return
        # in an order of the group's own, each member meets the next few, and the hubs
        own = at[np.argsort(mix(g["sid"][at].view(U) ^ g["key"][at].view(U)))]
        for k in () if cross else range(1, PARTNERS + 1):
            yield own[:-k], own[k:]
        total = np.zeros(len(own))
        for k in own[:SAMPLE]:
            total += differences(g, own, np.full(len(own), k)) / (g["n"][own] + g["n"][k])
        for k in own[np.argsort(total, kind="stable")[:HUBS]]:
            yield np.full(len(own), k), own
        return
    left, right = (at[g["side"][at] == 0], at[g["side"][at] == 1]) if cross else (at, at)
    if not len(left) or not len(right):
        return
    comp = g["comp"]
    names, count = np.unique(comp[at], return_counts=True)
    if len(names) < 2:
        return
    largest = names[count.argmax()]
    # members outside the largest component meet all others; inside it all are linked already
    for one, other in ((left, right), (right, left)) if cross else ((left, right),):
        for i in one[comp[one] != largest]:
            o = other[comp[other] != comp[i]]
            yield np.full(len(o), i), o


def _candidates(members: DataFrame, threshold: tuple[int, int], final: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of set ids that pass all filters: a few of each set, or finally all between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        table = pa.Table.from_batches(got)
        g = {k: table[k].to_numpy() for k in ("key", "side", "size", "n")}
        g["sid"] = table["sid"].to_numpy()
        g["comp"] = table["comp"].to_numpy() if final else g["sid"]
        g |= unpacked(table["maps"])
        order = np.lexsort((g["sid"], g["key"]))
        cuts = np.flatnonzero(np.diff(g["key"][order], prepend=g["key"][order[0]] - 1))
        found: list[np.ndarray] = []
        pend: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if pend:
                i, j = (np.concatenate(x) for x in zip(*pend))
                ok, differ = passing(g, i, j, threshold)
                a, b = g["sid"][i[ok]], g["sid"][j[ok]]
                # share of the bits that may differ, in thousandths
                far = 1000 * differ // (g["n"][i[ok]] + g["n"][j[ok]])
                p = np.stack((np.minimum(a, b), np.maximum(a, b), far), 1)
                found.append(np.unique(p[p[:, 0] != p[:, 1]], axis=0))
            pend.clear()
            waiting = 0

        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            for i, j in _pairs_of_group(g, order[a:b], final):
                pend.append((i, j))
                waiting += len(i)
                if waiting > 200_000:
                    flush()
        flush()
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        if final:
            for a in range(0, len(out), 50_000):
                part = out[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int32())], names=["a", "b", "score", "kind"])
            return
        # each set's nearest partner here, and its partner of the smallest hash
        code = (mix(np.ascontiguousarray(out[:, 0]).view(U) ^ mix(np.ascontiguousarray(out[:, 1]).view(U))) >> U(1)).astype(np.int64)
        one, two = np.concatenate((out[:, 0], out[:, 1])), np.concatenate((out[:, 1], out[:, 0]))
        for kind, score in ((0, out[:, 2]), (1, code)):
            score = np.tile(score, 2)
            order = np.lexsort((two, score, one))
            best = order[np.flatnonzero(np.diff(one[order], prepend=one[order[0]] - 1))] if len(order) else order
            for a in range(0, len(best), 50_000):
                at = best[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(one[at]), pa.array(two[at]), pa.array(score[at]), pa.array(np.full(len(at), kind, np.int32))], names=["a", "b", "score", "kind"])

    n = shuffle_width(members.sparkSession)
    cols = ["key", "side", "size", "sid", "n", "maps"] + ["comp"] * final
    rows = (members if final else members.where("low")).select(*cols).repartition(n, "key").mapInArrow(run, "a long, b long, score long, kind int")
    if final:
        return rows.select("a", "b").distinct()
    rank = F.row_number().over(Window.partitionBy("a", "kind").orderBy("score", "b"))
    return rows.distinct().withColumn("_rank", rank).where(F.col("_rank") <= PARTNERS // 2).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near(pairs: DataFrame, wide: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose wide parity maps don't differ in more bits than linked sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n, x, y = columns(batch, "a", "b", "m", "n", "x", "y")
            most = most_differing(m.to_numpy(), n.to_numpy(), threshold)
            keep = pa.array([k >= 0 and maps_differ(x[i].as_buffer(), y[i].as_buffer()) <= k for i, k in enumerate(most.tolist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    one = wide.select(F.col("sid").alias("a"), F.col("n").alias("m"), F.col("wide").alias("x"))
    two = wide.select(F.col("sid").alias("b"), "n", F.col("wide").alias("y"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _needed(texts: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of (_id, ...) whose id may be a rep of `need`, so that the join of both shuffles hardly any other text. The map has 2 ** NEED_LOG bits at most, in words of 64."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << NEED_LOG) - 1))
    on = need.select(place("rep").alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word"))
    words = on.agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 AS int))")).alias("_bits"))
    own = texts.withColumn("_p", place("_id")).join(F.broadcast(words), F.shiftright("_p", 6) == F.col("_word"))
    return own.where(F.getbit("_bits", F.col("_p").bitwiseAND(F.lit(63))) == 1).select(texts.columns)


def _sets(docs: DataFrame, need: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(sid, tokens) of the needed sets, from the one document that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, text = columns(batch, "sid", "_text")
            want = want.to_numpy()
            buf, offs = as_bytes(text)
            for a, b in slices(offs):
                t, at = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                sid = set_ids(t, at).view(np.int64)
                own = np.flatnonzero(sid == want[a:b])  # a repeated id may have other texts
                yield pa.RecordBatch.from_arrays([pa.array(sid[own]), pa.array([t[at[k] : at[k + 1]].tobytes() for k in own], pa.binary())], names=["sid", "tokens"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _needed(texts, need).join(need, F.col("_id").eqNullSafe(F.col("rep"))).select("sid", "_text")
    return rows.mapInArrow(run, "sid long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose whole sets link."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = columns(batch, "a", "b", "x", "y")
            ok = []
            for k in range(len(a)):
                s, t = np.frombuffer(x[k].as_buffer(), U), np.frombuffer(y[k].as_buffer(), U)
                both = np.sort(np.concatenate((s, t)), kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                ok.append(den * n >= num * (len(s) + len(t) - n))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    one = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    # a set may come more than once only for repeated rows; distinct pairs come out again
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def connect(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each component, by neighbours' labels and pointer jumps until nothing changes."""
    spark = links.sparkSession
    both, kept = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels, at = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        new = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = new.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = new.join(jump, "comp", "left").select("node", "old", F.least(F.col("comp"), F.coalesce("up", "comp")).alias("comp"))
        out, path = materialize(new, "labels")
        drop(spark, at)
        labels, at = out.select("node", "comp"), path
        if out.where("comp <> old").isEmpty():
            return labels


def _components(docs: DataFrame, threshold: tuple[int, int], words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, n, sid, cid) per document, (node, comp) of sets that have links)."""
    spark = docs.sparkSession
    scanned, _ = materialize(_scan(docs, id_col, text_col, words), "scan")
    level = _levels(scanned.where("stripe IS NOT NULL").select("stripe", "counts"))
    meta = scanned.where("stripe IS NULL").select("id", "n", "sid", "cid")
    # about 16 MB of prefixes a part
    share = 1 - threshold[0] / threshold[1]
    total = meta.agg(F.sum(F.col("n") * share + 1)).first()[0] or 0
    n_parts = int(max(shuffle_width(spark), total * MEMBER.itemsize // (16 << 20) + 1))
    packed, at_packed = materialize(_members(docs, id_col, text_col, words, threshold, level, n_parts), "prefixes")
    features = packed.where("part IS NULL").groupBy("sid").agg(F.max("n").alias("n"), F.max("data").alias("maps"))
    wide, _ = materialize(packed.where("part IS NULL").select("sid", "n", "wide").dropDuplicates(["sid"]), "wide")
    members, at_members = materialize(_groups(packed.where("part IS NOT NULL"), threshold, n_parts).join(features, "sid"), "members")
    drop(spark, at_packed)
    release(spark)
    reps = meta.where("n > 0").groupBy("sid").agg(F.min("id").alias("rep"))

    def sets_of(need: DataFrame) -> DataFrame:
        got, _ = materialize(_sets(docs, reps.join(need, "sid").select("sid", "rep"), id_col, text_col, words).dropDuplicates(["sid"]), "sets")
        release(spark)
        return got

    pairs, _ = materialize(_near(_candidates(members, threshold, final=False), wide, threshold), "pairs")
    ends = lambda p: p.select(F.col("a").alias("sid")).union(p.select("b")).distinct()
    sets = sets_of(ends(pairs))
    links, _ = materialize(_verified(pairs, sets, threshold), "links")
    comps = connect(links)
    known = members.join(comps.select(F.col("node").alias("sid"), F.col("comp").alias("_c")), "sid", "left").withColumn("comp", F.coalesce("_c", "sid")).drop("_c")
    rest = _near(_candidates(known, threshold, final=True).join(pairs, ["a", "b"], "left_anti"), wide, threshold)
    rest, _ = materialize(rest, "pairs")
    drop(spark, at_members)
    release(spark)
    if not rest.isEmpty():
        new = ends(rest).join(sets.select("sid"), "sid", "left_anti")
        sets = sets.unionByName(sets_of(new)) if not new.isEmpty() else sets
        more, _ = materialize(_verified(rest, sets, threshold), "links")
        if not more.isEmpty():
            comps = connect(links.unionByName(more))
    return meta, comps


def components(docs: DataFrame, threshold: tuple[int, int] = (80, 100), words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    meta, comps = _components(docs, threshold, words, id_col, text_col)
    own = meta.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "sid")))
    first = own.where("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("first"))
    out = own.join(first, "comp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def keep_first(docs: DataFrame, threshold: tuple[int, int] = (80, 100), words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the first by id (nulls last) and text. Rows without shingles all stay.

    Rows are told apart by id and text, so a null or repeated id loses only the rows that are not first in their component.
    """
    meta, comps = _components(docs, threshold, words, id_col, text_col)
    own = meta.where("n > 0").join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("id", "cid", F.coalesce("comp", "sid").alias("comp"))
    first = own.groupBy("comp").agg(F.min("id").alias("first"))
    best = own.join(first, "comp").where(F.col("id").eqNullSafe(F.col("first")))
    best = best.groupBy("comp", "id", "cid").agg(F.count("*").alias("rows"))
    several = best.groupBy("comp").agg((F.sum("rows") > 1).alias("several"))
    keys, _ = materialize(best.join(several, "comp").select(F.col("comp").alias("_comp"), F.col("id").alias("_id"), F.col("cid").alias("_cid"), "several"), "firsts")
    at = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_cid"))
    bare = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x09-\x0d\x20]")
    alone = docs.where(~bare).join(keys.where("NOT several").select("_id", "_cid"), at, "left_semi")
    # only where rows of a component share the first id, or none has an id, their texts decide
    rank = F.row_number().over(Window.partitionBy("_comp").orderBy(text_col))
    tied = docs.where(~bare).join(keys.where("several").select("_comp", "_id", "_cid"), at).withColumn("_rank", rank).where("_rank = 1")
    return docs.where(bare).unionByName(alone).unionByName(tied.select(docs.columns))
