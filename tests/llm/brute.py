"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib

import numpy as np

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AZ = str.maketrans(UP, LOW)
#: Rows that every operator must survive: (doc_id, text).
ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "the same passage of words that two documents hold, from its start up to its very end"),
    (5, "the same passage of words that two documents hold, from its start up to its very end"),
    (5, "the same passage of words that two documents hold, from its start up to its very end"),
    (6, "Before it. the same passage of words that two documents hold, from its start up to its very end And after it."),
    (7, "é" * 200 + " ünïcode 漢字 words " + "漢" * 60),
    (8, "漢" * 60 + " other"),
    (9, "x" * 5000),
    (10, "x" * 40),
    (None, "a row without an id that has some words in it"),
    (11, "one"),
    (12, "two words"),
    (13, ("many words of a very long document go on and on %d " * 3000) % tuple(range(3000))),
    (14, "<|endoftext|> don't 12345 \u00a0 \n\n tab\t end  "),
]


def near(rows, words, num, den):
    pat = re.compile(r"[^\x20\x09-\x0d]+")
    sets = []
    for _, t in rows:
        w = pat.findall((t or "").translate(AZ))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and comp[i] != comp[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return out


def contamination(rows, bench, window=13):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pat.findall((t or "").translate(AZ))
    items = {}
    for i, t in bench:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            items.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = sorted({len(x) for x in items})
    out = []
    for d, t in rows:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in items:
                    hit.update(range(k, k + n))
                    got |= items[x]
        sha = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(got), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def removals(rows, n=50):
    """Rows of distinct ids; those without an id remove nothing and give nothing."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for k in range(len(b) - n + 1):
            if d is not None:
                x = b[k : k + n]
                first[x] = min(first.get(x, d), d)
    out = []
    for d, b in data:
        cut = [False] * len(b)
        for k in range(len(b) - n + 1):
            if d is not None and first[b[k : k + n]] < d:
                cut[k : k + n] = [True] * n
        kept = bytes(c for c, x in zip(b, cut) if not x)
        spans = sum(x and not y for x, y in zip(cut, [False, *cut]))
        out.append((d, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def runs(words, exponent, least):
    """(start, length, period) of all runs, period by period."""
    number = {}
    c, out = np.array([number.setdefault(w, len(number)) for w in words]), set()
    for p in range(1, len(words) // exponent + 1):
        same = np.concatenate(([False], c[:-p] == c[p:], [False])).astype(int)
        cut = np.flatnonzero(np.diff(same))
        for s, e in zip(cut[::2], cut[1::2]):
            seg = c[s : e + p]
            if len(seg) >= max(least, exponent * p) and not any((seg[:-q] == seg[q:]).all() for q in range(1, p)):
                out.add((int(s), len(seg), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rows):
    """The digests of op12 for (doc_id, text) rows."""
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        if d is not None and (h := zlib.crc32(str(d).encode())) % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs(w, 4, 6)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((d, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def divergence(rows, top=200):
    """The rows of op11 for (text, lang, source) rows."""
    pat = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [tuple(x or "" for x in r) for r in rows]
    seen, counts = {}, {}
    for t, lang, s in rows:
        w = pat.findall(t.translate(AZ))
        counts.setdefault((lang, s), {})
        for x in set(w):
            seen[lang, x] = seen.get((lang, x), 0) + 1
        for x in w:
            counts[lang, s][x] = counts[lang, s].get(x, 0) + 1
    out = []
    for lang in {k for k, _ in counts}:
        kept = [x for (k, x), n in seen.items() if k == lang and n >= 3]
        own = {s: {x: c.get(x, 0) for x in kept} for (k, s), c in counts.items() if k == lang}
        share = lambda c: {x: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for x, n in c.items()}
        p = {s: share(c) for s, c in own.items()}
        q = share({x: sum(c[x] for c in own.values()) for x in kept})
        for s in p:
            pairs = [(-sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept), o.encode(), o) for o in p if o != s]
            terms = [(-((p[s][x] - q[x]) ** 2 // q[x]), x.encode(), x) for x in kept if own[s][x] > 0 and p[s][x] > q[x]]
            for part, got in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, o, -v, k) for k, (v, _, o) in enumerate(got, 1)]
    return sorted(out)
