"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows.

A word's input is a trained vector of the (hashed) word next to the mean of trained vectors of its
(hashed) character n-grams, boundaries included. Windows of WINDOW words, every STRIDE words, pass through
a GRU in both directions; attention pools the states; a linear layer gives the window's logit. A
document's score is the calibrated largest logit of all its windows, so no part of a text is left out.

The network is fitted in numpy on at most PER_CLASS labelled documents of each class and FIT_WINDOWS windows
of each (documented bounds); the first epochs learn from all windows, the rest from the likeliest one of
each document. Labels of held-out rows are never read.

Defined cases: a null or empty text (or one without words) has one empty window; without labels of both
classes every score is the share of toxic labels (0 without any); repeated rows each get a score; equal
texts get equal scores; other columns are ignored, or passed on by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ALNUM_WORD, LOWER, as_bytes, columns, mix, slices, word_hashes, word_spans

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 12
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 15
PER_CLASS, FIT_WINDOWS = 1500, 12
#: Passes over the sample: as many as make STEPS steps, within these bounds; the first fifth learns from all windows.
STEPS, LEAST_EPOCHS, MOST_EPOCHS = 350, 7, 24
RATE, BATCH = 0.02, 64
THRESHOLD = 0.3
GRAMS = (3, 4)
SLICE = 2 << 20


@dataclass
class Net:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    d = WORD_DIM + CHAR_DIM

    def init(*shape: int, by: float = 0.3) -> np.ndarray:
        return (r.standard_normal(shape) * by).astype(np.float32)

    p = {"word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32), "char": init(CHAR_BUCKETS, CHAR_DIM, by=0.1)}
    for way in "fb":
        p |= {f"w{way}": init(d, 3 * HIDDEN), f"u{way}": init(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"a": init(2 * HIDDEN, HIDDEN), "ab": np.zeros(HIDDEN, np.float32), "v": init(HIDDEN), "o": init(2 * HIDDEN), "ob": np.zeros(1, np.float32)}
    return Net(p)


# ---------------------------------------------------------------- inputs


@dataclass
class Inputs:
    """Distinct words (hash bucket, n-gram buckets) and windows of word numbers; 0 pads, words count from 1."""

    word: np.ndarray
    gram: np.ndarray
    gram_at: np.ndarray
    windows: np.ndarray
    doc: np.ndarray


def prepare(buf: np.ndarray, offs: np.ndarray) -> Inputs:
    starts, ends, doc = word_spans(buf, offs, ALNUM_WORD)
    hashes = word_hashes(buf, starts, ends)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    # n-grams of <word>: 1 opens, 2 closes
    size = e - s + 2
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    if len(s):
        src = np.clip(np.repeat(s, size) + pos - 1, 0, len(buf) - 1)
        chars = np.where(pos == 0, 1, np.where(pos == np.repeat(size, size) - 1, 2, LOWER[buf[src]])).astype(np.uint64)
    else:
        chars = np.zeros(0, np.uint64)
    left = np.repeat(size, size) - pos
    word_no = np.repeat(np.arange(len(s)), size)
    codes, owners = [], []
    for n in GRAMS:
        ok = np.flatnonzero(left >= n) if n > 3 else np.flatnonzero((left >= n) | ((pos == 0) & (left < n)))
        h = np.full(len(ok), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + chars[np.minimum(ok + k, len(chars) - 1)]
        codes.append((mix(h) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        owners.append(word_no[ok])
    gram, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    gram, owner = gram[order], owner[order]
    gram_at = np.searchsorted(owner, np.arange(len(s)))
    n_docs = len(offs) - 1
    n_words = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(n_words) - n_words
    n_win = 1 + np.maximum(0, -(-(n_words - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(n_docs), n_win)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    # the last window ends with the text
    base = np.minimum(k * STRIDE, np.maximum(n_words[owner] - WINDOW, 0))
    spot = base[:, None] + np.arange(WINDOW)
    inside = spot < n_words[owner][:, None]
    ids = np.append(number.astype(np.int64) + 1, 0)
    windows = np.where(inside, ids[np.minimum(begin[owner][:, None] + spot, len(ids) - 1)], 0)
    return Inputs((distinct % np.uint64(WORD_BUCKETS)).astype(np.int64), gram, gram_at, windows, owner)


def embed(p: dict[str, np.ndarray], x: Inputs) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the distinct words, n-grams per word); row 0 pads."""
    n = np.diff(np.append(x.gram_at, len(x.gram))).astype(np.float32)
    out = np.zeros((len(x.word) + 1, WORD_DIM + CHAR_DIM), np.float32)
    if len(x.word):
        out[1:, :WORD_DIM] = p["word"][x.word]
        out[1:, WORD_DIM:] = np.add.reduceat(p["char"][x.gram], x.gram_at, axis=0) / n[:, None]
    return out, n


# ---------------------------------------------------------------- the network


#: The gates need exp(-x), so their columns are negated.
SIGN = np.repeat(np.float32([-1, -1, 1]), HIDDEN)


def project(p: dict, table: np.ndarray) -> dict[str, np.ndarray]:
    """Each word's share of the gates, for both directions."""
    return {way: (table @ p["w" + way] + p["b" + way]) * SIGN for way in "fb"}


def _gru(p: dict, way: str, proj: np.ndarray, windows: np.ndarray, keep: list | None) -> np.ndarray:
    """States (time, hidden, window) of one direction; windows are (time, window)."""
    h = np.zeros((HIDDEN, windows.shape[1]), np.float32)
    out = np.empty((len(windows), *h.shape), np.float32)
    u = np.ascontiguousarray((p["u" + way] * SIGN).T)
    full = bool(windows.all())
    for t in range(len(windows)) if way == "f" else range(len(windows) - 1, -1, -1):
        ids = windows[t]
        x, g = np.ascontiguousarray(proj.take(ids, axis=0).T), u @ h
        gates = x[: 2 * HIDDEN]
        gates += g[: 2 * HIDDEN]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, gn = gates[:HIDDEN], gates[HIDDEN:], g[2 * HIDDEN :]
        n = r * gn
        n += x[2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        live = True
        if not full:
            live = ids > 0
            new = np.where(live, new, h)
        if keep is not None:
            keep.append((t, ids, h, z, r, gn, n, live))
        out[t] = h = new
    return out


def forward(p: dict, proj: dict[str, np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows."""
    ids = np.ascontiguousarray(windows.T)
    f, b = ([], []) if keep is not None else (None, None)
    states = np.concatenate((_gru(p, "f", proj["f"], ids, f), _gru(p, "b", proj["b"], ids, b)), axis=1)
    t = np.ascontiguousarray(p["a"].T) @ states
    t += p["ab"][:, None]
    np.tanh(t, out=t)
    s = p["v"] @ t
    if not ids.all():
        s[ids == 0] = -30
    s -= s.max(0)
    w = np.exp(s)
    w /= w.sum(0)
    pooled = np.einsum("tn,thn->hn", w, states)
    if keep is not None:
        keep |= {"f": f, "b": b, "states": states, "t": t, "w": w, "pooled": pooled}
    return p["o"] @ pooled + p["ob"][0]


def backward(p: dict, table: np.ndarray, k: dict, d: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the word vectors, given those of the logits."""
    g = {"o": k["pooled"] @ d, "ob": np.array([d.sum()], np.float32)}
    dp = p["o"][:, None] * d
    dw = (k["states"] * dp).sum(1)
    ds = k["w"] * (dw - (k["w"] * dw).sum(0))
    dt = p["v"][:, None] * ds[:, None, :] * (1 - k["t"] ** 2)
    g |= {"v": (k["t"] * ds[:, None, :]).sum((0, 2)), "a": np.einsum("thn,tkn->hk", k["states"], dt), "ab": dt.sum((0, 2))}
    dstates = k["w"][:, None, :] * dp + p["a"] @ dt
    dtable = np.zeros_like(table)
    for way, part in (("f", dstates[:, :HIDDEN]), ("b", dstates[:, HIDDEN:])):
        w, u = p["w" + way], p["u" + way]
        gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros_like(p["b" + way])
        dh = np.zeros(part.shape[1:], np.float32)
        for t, ids, h, z, r, gn, n, live in reversed(k[way]):
            dh = dh + part[t]
            dn = np.where(live, dh * (1 - z) * (1 - n**2), 0)
            dz = np.where(live, dh * (h - n) * z * (1 - z), 0)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate((dz, dr, dn))
            dg = np.concatenate((dz, dr, dn * r))
            gw += (dx @ table[ids]).T
            gu += h @ dg.T
            gb += dx.sum(1)
            np.add.at(dtable, ids, dx.T @ w.T)
            dh = np.where(live, dh * z, dh) + u @ dg
        g |= {"w" + way: gw, "u" + way: gu, "b" + way: gb}
    return g, dtable


def fit(texts: list[list[str]], labels: list[int], seed: int = 7) -> Net:
    """Fit on documents given as lists of windows' texts."""
    net, y = new_net(seed), np.array(labels, np.float32)
    p, rng = net.p, np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step, epochs = 0, min(max(STEPS * BATCH // len(texts), LEAST_EPOCHS), MOST_EPOCHS)
    flat = [w for t in texts for w in t]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    x = prepare(*as_bytes(pa.array(flat, pa.string())))
    # a window's text has WINDOW words at most, so it is one window
    of_doc = [np.flatnonzero(owner == i) for i in range(len(texts))]
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            rows = np.concatenate([of_doc[i] for i in part])
            mine = np.repeat(np.arange(len(part)), [len(of_doc[i]) for i in part])
            used, ids = np.unique(x.windows[rows], return_inverse=True)
            ids = ids.reshape(len(rows), WINDOW)
            if used[0] != 0:
                used, ids = np.append(0, used), ids + 1
            w = used[1:] - 1
            n = np.diff(np.append(x.gram_at, len(x.gram)))[w]
            at = np.cumsum(n) - n
            gram = x.gram[np.repeat(x.gram_at[w] - at, n) + np.arange(int(n.sum()))]
            own = Inputs(x.word[w], gram, at, ids, mine)
            table, count = embed(p, own)
            proj = project(p, table)
            if epoch >= epochs // 5:
                logits = forward(p, proj, ids)
                order = np.lexsort((logits, mine))
                best = order[np.append(np.flatnonzero(np.diff(mine[order])), len(order) - 1)]
                ids, mine = ids[best], mine[best]
            keep: dict = {}
            logits = forward(p, proj, ids, keep)
            d = ((_sigmoid(logits) - y[part][mine]) / len(logits)).astype(np.float32)
            g, dtable = backward(p, table, keep, d)
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            sparse = {"word": (own.word, dtable[1:, :WORD_DIM]), "char": (gram, np.repeat(dtable[1:, WORD_DIM:] / count[:, None], n, axis=0))}
            for key in p:
                if key in sparse:
                    where, back = np.unique(sparse[key][0], return_inverse=True)
                    grad = np.zeros((len(where), p[key].shape[1]), np.float32)
                    np.add.at(grad, back, sparse[key][1])
                else:
                    where, grad = slice(None), g[key]
                m[key][where] = 0.9 * m[key][where] + 0.1 * grad
                s[key][where] = 0.99 * s[key][where] + 0.01 * grad**2
                p[key][where] -= rate * m[key][where] / (np.sqrt(s[key][where]) + 1e-6)
    return net


def calibrate(net: Net, logits: np.ndarray, y: np.ndarray, share: float) -> Net:
    """Logistic regression of the label on a document's largest logit, weighted to the true share of toxic labels."""
    wt = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    mean, dev = logits.mean(), logits.std() + 1e-6
    x = np.stack(((logits - mean) / dev, np.ones_like(logits)), 1)
    beta = np.zeros(2)
    for _ in range(50):
        q = _sigmoid(x @ beta)
        hess = (x * (wt * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta += np.linalg.solve(hess, x.T @ (wt * (y - q)) - 1e-2 * beta)
    net.scale, net.shift = float(beta[0] / dev), float(beta[1] - beta[0] * mean / dev)
    return net


def largest_logits(net: Net, buf: np.ndarray, offs: np.ndarray, step: int = 1024) -> np.ndarray:
    """The largest window logit of each document."""
    x = prepare(buf, offs)
    proj = project(net.p, embed(net.p, x)[0])
    logits = np.zeros(len(x.windows), np.float32)
    whole = x.windows[:, -1] > 0
    for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
        for a in range(0, len(group), step):
            logits[group[a : a + step]] = forward(net.p, proj, x.windows[group[a : a + step]])
    first = np.searchsorted(x.doc, np.arange(len(offs) - 1))
    return np.maximum.reduceat(logits, first) if len(first) else logits


def scores(net: Net, text: pa.Array) -> np.ndarray:
    buf, offs = as_bytes(text)
    if net.constant is not None:
        return np.full(len(text), net.constant)
    out = [largest_logits(net, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(offs, SLICE)]
    return _sigmoid(net.scale * np.concatenate(out).astype(np.float64) + net.shift) if out else np.zeros(0)


# ---------------------------------------------------------------- Spark


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Net:
    """Fit on a bounded sample of the labelled rows that are not held out, the first of each class by a hash of the id."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = count.get(1, 0) / max(sum(count.values()), 1)
    if min(count.get(0, 0), count.get(1, 0)) == 0:
        return Net({}, constant=float(share))
    mark = F.xxhash64(F.col("_id").cast("string"))
    picked = [known.where(F.col("_y") == y).orderBy(mark, "_id").limit(per_class).dropDuplicates(["_id"]) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class ids

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, y, text = columns(batch, "_id", "_y", "_text")
            buf, offs = as_bytes(text)
            got: list[list[str]] = []
            for i in range(len(text)):
                own = buf[offs[i] : offs[i + 1]]
                s, e, _ = word_spans(own, np.array([0, len(own)]), ALNUM_WORD)
                n_win = 1 + max(0, -(-(len(s) - WINDOW) // STRIDE))
                use = sorted({int(k * n_win / FIT_WINDOWS) for k in range(FIT_WINDOWS)})
                base = [min(k * STRIDE, max(len(s) - WINDOW, 0)) for k in use]
                got.append([own[s[b] : e[min(b + WINDOW, len(s)) - 1]].tobytes().decode("utf-8", "ignore") if len(s) else "" for b in base])
            yield pa.RecordBatch.from_arrays([key, y, pa.array(got, pa.list_(pa.string()))], names=["_id", "_y", "windows"])

    kind = labels.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id").select("_id", "_y", "_text")
    got = rows.mapInArrow(windows, f"_id {kind}, _y int, windows array<string>").toPandas().sort_values("_id", kind="stable").drop_duplicates("_id")
    if got["_y"].nunique() < 2:
        return Net({}, constant=float(share))
    net = fit([list(w) for w in got["windows"]], got["_y"].tolist())
    sent = spark.sparkContext.broadcast(net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, text = columns(batch, "_y", "_text")
            buf, offs = as_bytes(text)
            out = [largest_logits(sent.value, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(offs, SLICE)]
            yield pa.RecordBatch.from_arrays([y, pa.array(np.concatenate(out).astype(np.float64) if out else np.zeros(0))], names=["_y", "logit"])

    fitted = rows.mapInArrow(logits, "_y int, logit double").toPandas()
    return calibrate(net, fitted["logit"].to_numpy(), fitted["_y"].to_numpy(float), share)


def scored(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, out, text = columns(batch, id_col, "held_out", text_col)
            s = scores(sent.value, text)
            yield pa.RecordBatch.from_arrays([key, out, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (text,) = columns(batch, text_col)
            yield batch.filter(pa.array(scores(sent.value, text) < threshold))

    return docs.mapInArrow(run, docs.schema)
