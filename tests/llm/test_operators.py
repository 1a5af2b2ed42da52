import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import decontamination, fingerprints, licenses, ngram_join, queries, rollups, sharding, tokens, toxicity, urls
from lamina.llm.common import as_bytes, table
from tests.llm import brute

SCHEMA = "doc_id long, text string, n long, part string, n_words long, key string, sid string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(d, t, 1, "p", 2, None, "s") for d, t in brute.ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").orderBy("doc_id", "text").collect()]


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    got = sharding.permute(np.arange(n), n)
    assert sorted(got) == list(range(n))
    assert (sharding.permute(got, n, inverse=True) == np.arange(n)).all()


def test_shards(spark, docs, odd, empty):
    for df in (docs, odd):
        got = sharding.assign_shards(df, 16).collect()
        want = sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in plain(df))
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
            assert sharding.locate(r["row_no"], len(got), 16) == (r["shard"], r["slot"])
            assert sharding.row_at(r["shard"], r["slot"], len(got), 16) == r["row_no"]
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(16)) <= 1
    assert sharding.assign_shards(empty).count() == 0
    assert rows_of(sharding.assign_shards(docs)) == rows_of(sharding.assign_shards(docs.repartition(7)))


# ---------------------------------------------------------------- licences


def test_licenses(spark, odd, empty, sf_dir, duck):
    got = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert len(got) == len({d for d, _ in brute.ODD}) and all(r["n_known"] == 0 for r in got.values())
    assert licenses.scan(empty).count() == 0
    text = "Hi. Released under the MIT License.\nLicensed under the Apache License, Version 2.0! x\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nother"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_known"], r["sentence_ids"], r["licenses"]) == (3, "mit-released,apache-licensed,bsd-redistribution", "Apache-2.0,MIT")
    full = [".\n\n".join(licenses.SENTENCES[i] for i in seq) + "." for _, seq in licenses.RULES]
    got = licenses.scan(spark.createDataFrame(list(enumerate(full)), "doc_id long, text string")).collect()
    assert [r["licenses"] for r in sorted(got)] == [n for n, _ in licenses.RULES]
    assert rows_of(queries.op3_license_scan(spark, sf_dir)) == sorted(duck.execute(licenses.SQL).fetchall(), key=str)


def wrapped(text, width, mark):
    import textwrap

    return "\n".join(f"{mark}{line}".rstrip() for par in text.split("\n\n") for line in [*textwrap.wrap(par, width, break_long_words=False), ""])


@pytest.mark.parametrize("width,mark", [(10_000, ""), (78, ""), (60, "# "), (70, " * "), (12, "// ")])
def test_license_texts(spark, width, mark):
    """Whole notices, however their lines are broken and marked."""
    s = licenses.SENTENCES
    mit = f"Copyright (c) 2020 Some One\n\n{s['mit-grant']}:\n\n{s['mit-notice']}.\n\n{s['mit-warranty'].upper()}. {s['mit-liability'].upper()}."
    apache = f"Copyright 2019 Some One\n\n{s['apache-header']};\n\n{s['apache-comply']}. {s['apache-copy']}\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n{s['apache-basis']}. {s['apache-see']}."
    gpl3 = f"{s['gpl-free']}: {s['gpl3-terms']}.\n\n{s['gpl-hope']}; {s['gpl-implied']}. {s['gpl-details']}."
    gpl2 = f"{s['gpl-free']}; {s['gpl-terms']}; {s['gpl2-version']}.\n\n{s['gpl-hope']}; {s['gpl-implied']}."
    two = f"{s['bsd-redistribution']}:\n\n1. {s['bsd-source']}.\n\n2. {s['bsd-binary']}.\n\n{s['bsd-warranty']}."
    three = two.replace(f"\n\n{s['bsd-warranty']}", f"\n\n3. {s['bsd-endorse']}.\n\n{s['bsd-warranty']}")
    mpl = f"{s['mpl-source']}. {s['mpl-copy']}."
    texts = {"MIT": f"MIT License\n\n{mit}", "Apache-2.0": apache, "GPL-3.0-or-later": gpl3, "GPL-2.0-or-later": gpl2, "BSD-2-Clause": two, "BSD-3-Clause": three, "MPL-2.0": mpl, "BSD-2-Clause,BSD-3-Clause": f"{three}\n\nand\n\n{two}", "Apache-2.0,MIT": f"{mit}\n\nBut {apache}"}
    rows = [(k, wrapped(t, width, mark)) for k, t in texts.items()]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: k for k in texts}


def test_license_title_above(spark):
    """A title or another line right above a wrapped sentence, without a blank line; a very long text; SQL on the same rows."""
    import duckdb

    grant = wrapped(licenses.SENTENCES["mit-grant"] + ":", 72, "")
    rows = [(1, f"The MIT License\n{grant}"), (2, f"some words\nof prose {'on and on ' * 50_000}\n{grant}"), (3, None), (4, "no licence here"), (5, f"Released under the MIT License\nand more\n" * 3)]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(1, 2, "mit-title,mit-grant", "MIT"), (2, 1, "mit-grant", "MIT"), (3, 0, "", ""), (4, 0, "", ""), (5, 3, ",".join(["mit-released"] * 3), "MIT")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(licenses.SQL).fetchall()) == got


# ---------------------------------------------------------------- URLs


def test_url_rules(spark):
    got = {r["url"]: r for r in spark.createDataFrame([(u,) for u in URLS], "url string").withColumn("_url", urls.F.col("url")).select("url", *[c.alias(n) for c, n in zip(urls.parts(urls.F.col("_url")), ("host", "path"))]).withColumn("rule", urls.rule_of(urls.F.col("host"), urls.F.col("path"), urls.RULES, 1)).collect()}
    for u, (host, path, rule) in URLS.items():
        assert (got[u]["host"], got[u]["path"], got[u]["rule"]) == (host, path, rule), u


URLS = {
    "http://A.Example.COM/en/1?x=1": ("a.example.com", "/en/1", "example.com/en/"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
    "https://x.www.example.com/en/a#b": ("x.www.example.com", "/en/a", "www.example.com/en/"),
    "https://badexample.com/en/": ("badexample.com", "/en/", "com/"),
    "https://example.com": ("example.com", "", None),
    "ftp://b.net/es/?q": ("b.net", "/es/", "net/es/"),
    "http://b.net?/es/": ("b.net", "", None),
    "http://b.org/fr/": ("b.org", "/fr/", None),
    "no scheme": ("", "", None),
    "://h/p://q": ("h", "/p://q", None),
    None: ("", "", None),
}


def test_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = queries.op4_url_filter(spark, sf_dir).collect()
    assert len(got) == pages.count() and {r["verdict"] for r in got} <= {"allow", "block"}
    want = {h + p: v for v, h, p in urls.RULES}
    assert all(r["verdict"] == want[r["rule"]] for r in got if r["rule"])
    none = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "page_id long, url string")
    assert [r["verdict"] for r in urls.verdicts(none).collect()] == ["allow"] * 3
    assert urls.verdicts(none.limit(0)).count() == 0


def test_url_trees_learn(spark):
    """Addresses below a labelled host are told apart by their form alone."""
    good = [(i, f"http://a{i}.com/x/{i}") for i in range(200)]
    bad = [(1000 + i, f"http://b{i}.net/es/{'9' * 30}?a=1&b=2&c=3") for i in range(200)]
    new = [(5000, "http://c.org/y/1"), (5001, f"http://d.org/de/{'8' * 30}?a=1&b=2&c=3")]
    got = {r["page_id"]: r["verdict"] for r in urls.verdicts(spark.createDataFrame(good + bad + new, "page_id long, url string")).collect()}
    assert (got[5000], got[5001]) == ("allow", "block")


def test_url_trees_held_out(spark, sf_dir):
    """Trees rank addresses that they have not seen better than chance; labels from elsewhere tell addresses apart that the rules don't."""
    pages = table(spark, sf_dir.replace("sf0.001", "sf0.1"), "pages")
    got = urls.held_out(pages).collect()
    want = {1.0: 0, 0.0: 0}
    for r in got:
        want[r["_y"]] += 1
    assert min(want.values()) > 20
    # measured: AUC 0.72, accuracy 0.690 where the larger class has 0.685; the rules turn on the path's words, which are no features
    block, allow = ([r["p_block"] for r in got if r["_y"] == y] for y in (1.0, 0.0))
    assert sum((a > b) + 0.5 * (a == b) for a in block for b in allow) / (len(block) * len(allow)) > 0.65
    # below .org, by the number of digits alone
    own = spark.createDataFrame([(i, f"http://h{i}.org/{'7' * (20 if i % 3 else 1)}/a") for i in range(600)], "page_id long, url string")
    known = own.where("page_id < 300").select("url", (urls.F.col("page_id") % 3 > 0).alias("block"))
    verdict = {r["page_id"]: r["verdict"] for r in urls.verdicts(own, labels=known).collect()}
    assert len(verdict) == 600 and all((verdict[i] == "block") == (i % 3 > 0) for i in range(300, 600))


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("block_bytes", [8 << 20, 600])
def test_decontamination(spark, docs, odd, empty, sf_dir, block_bytes):
    bench = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    bench += [(900, None), (901, ""), (902, "two words"), (903, "One"), (904, "many words of a very long document go on and on 77 many words of")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    for df in (docs, odd):
        got = decontamination.contamination(df, b, block_bytes=block_bytes)
        want = sorted(brute.contamination(plain(df), bench), key=str)
        assert rows_of(got) == want
        kept = decontamination.keep_clean(df, b, block_bytes=block_bytes)
        assert kept.columns == df.columns and sorted(map(str, [r[0] for r in kept.collect()])) == sorted(str(w[0]) for w in want if not w[5])
    assert decontamination.contamination(empty, b).count() == 0
    assert rows_of(decontamination.contamination(odd, b.limit(0)))[0][2] == 0


def test_short_items_beside_others(spark):
    """Matches go on within one item and one document only: items of one and two words next to others, matches at the edges of documents."""
    run = " ".join(f"w{k}" for k in range(13))
    fixed = [
        ([("a", "alpha"), ("b", run)], [(1, f"zz alpha {run} yy")]),
        ([("a", "alpha"), ("b", "beta")], [(2, "x alpha"), (3, "beta y")]),
        ([("a", run), ("b", "w13 w14")], [(1, f"{run} w13 w14"), (2, run), (3, "w13 w14")]),
    ]
    rng = np.random.default_rng(11)
    text = lambda n: " ".join("abcd"[k] for k in rng.integers(0, 4, n))
    for _ in range(12):
        items = [(f"i{k:02d}", text(rng.choice([0, 1, 1, 2, 3, 4, 9]))) for k in rng.permutation(8)]
        fixed.append((items, [(k, text(rng.choice([0, 1, 2, 5, 30]))) for k in range(12)]))
    for window in (13, 3):
        for items, rows in fixed:
            block = decontamination.build_block([i for i, _ in items], [t for _, t in items], window)
            m = decontamination.match(*as_bytes(pa.array([t for _, t in rows])), block)
            got = [(d, *decontamination._digest(int(n), *x)) for (d, _), n, *x in zip(rows, m["n_words"], *decontamination._summaries(m, block))]
            assert got == brute.contamination(rows, items, window)
    items, rows = fixed[0]
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), b).first()
    assert (got["n_hit"], got["n_items"]) == (14, 2)


def test_longest_match():
    block = decontamination.build_block(["1"], ["a b c d e f g h i j k l m n o"], 13)
    text = ["x a b c d y", "a b c d e f g h i j k l m n o"]
    m = decontamination.match(*as_bytes(pa.array(text)), block)
    assert m["longest"].tolist() == [15, 14, 13, *[0] * 12]
    assert list(zip(m["doc"], m["at"], m["q"], m["size"])) == [(1, 0, 0, 15), (1, 1, 1, 14), (1, 2, 2, 13)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_longest_matches(spark, docs, sf_dir, block_bytes):
    """Whole matches and their places, against a plain search."""
    rng = np.random.default_rng(2)
    word = lambda: "abcde"[rng.integers(0, 5)]
    bench = [(str(i), " ".join(word() for _ in range(rng.integers(1, 30)))) for i in range(12)] + [("n", None)]
    rows = [(i, " ".join([bench[i % 12][1], word(), bench[(i + 5) % 12][1][:40], word(), word()])) for i in range(40)] + [(99, None), (None, bench[3][1])]
    want = set()
    for d, t in rows:
        w = (t or "").split()
        for i, x in bench:
            q = (x or "").split()
            need = min(4, len(q))
            for a in range(len(w)):
                for b in range(len(q)):
                    n = 0
                    while a + n < len(w) and b + n < len(q) and w[a + n] == q[b + n]:
                        n += 1
                    if q and n >= need and (b == 0 if len(q) < 4 else not (a and b and w[a - 1] == q[b - 1])):
                        want.add((d, i, b, a, n))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontamination.longest_matches(df, spark.createDataFrame(bench, "item_id string, text string"), window=4, block_bytes=block_bytes).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and max(r["n_words"] for r in got) > 4


# ---------------------------------------------------------------- fingerprints


def test_edit_distance():
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"ABC"), rng.integers(0, 65)).astype(np.uint8)) for _ in range(200)]
    for a, b, got in zip(words[:100], words[100:], fingerprints.edit_distances(words[:100], words[100:])):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
        assert got == row[-1]


def test_fingerprints(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = sorted(((d is not None, d or 0, t or "") for d, t in plain(df)))
        got = fingerprints.fingerprints(df).collect()
        want = []
        for k, (known, d, t) in enumerate(rows):
            new = fingerprints.edited(t, rows[(k + 1) % len(rows)][2])
            f, e, n = (fingerprints.fingerprint(x.encode()) for x in (t, new, rows[(k + 1) % len(rows)][2]))
            near = fingerprints.likeness([f, f], [e, n])
            want.append((d if known else None, len(t), hashlib.sha256(new.encode()).hexdigest(), f, e, near[0], near[1]))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fingerprints.fingerprints(empty).count() == 0
    near = fingerprints.fingerprints(docs).selectExpr("avg(near_edited)", "avg(near_next)").first()
    assert near[0] > 0.6 > 0.3 > near[1]
    assert fingerprints.fingerprint(b"") == "4::"


# ---------------------------------------------------------------- n-gram join


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_components(spark, docs, odd, empty, words, num):
    for df in (docs, odd):
        got = ngram_join.components(df, (num, 100), words)
        assert rows_of(got) == sorted(brute.near(plain(df), words, num, 100), key=str)
    assert ngram_join.components(empty).count() == 0


def test_star_beyond_a_block(spark):
    """More copies than a block holds, each linked with the one original only: all are one component, though no two copies link."""
    base = [f"w{k}" for k in range(100)]
    rows = [(5000, " ".join(base))]
    for d in range(ngram_join.CHUNK + 100):
        w = list(base)
        w[10 + d % 40], w[55 + d % 37] = f"a{d}", f"b{d}"
        rows.append((d, " ".join(w)))
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), (80, 100), 5).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {0}


def test_large_group(spark):
    """Near copies linked in chains."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for d in range(120):
        w = list(base)
        for k in rng.integers(0, 100, rng.integers(0, 4)):
            w[k] = f"n{rng.integers(0, 1000)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute.near(rows, 3, 90, 100), key=str)
    assert 1 < len({w[2] for w in want}) < 120
    assert rows_of(ngram_join.components(df, (90, 100), 3)) == want
    kept = ngram_join.keep_first(df, (90, 100), 3)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


def test_keep_first(spark, odd):
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({d for d, _ in brute.ODD} - {5}, key=str)


def test_keep_first_by_row(spark):
    """Null and repeated ids lose only the rows that are not first in their component."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [
        (1, a), (None, a + " more"),  # a copy without an id goes
        (None, b), (None, b + " z"), (None, b),  # no row of these has an id: the first text stays
        (7, c), (7, d), (7, "one more text that is not like any other of them"),  # unlike texts under one id stay
        (3, c + " y"),  # the smaller id wins; the other rows of 7 stay
        (8, "said twice under one id and so it stays only once"), (8, "said twice under one id and so it stays only once"),
        (None, None), (None, ""), (None, " \t"), (9, None), (9, ""),  # no shingles: all stay
    ]
    got = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), (80, 100), 5)
    gone = [(None, a + " more"), (None, b), (None, b + " z"), (7, c), (8, rows[9][1])]
    want = list(rows)
    for r in gone:
        want.remove(r)
    assert rows_of(got) == sorted(want, key=str)


# ---------------------------------------------------------------- toxicity


def test_gradients():
    net = toxicity.new_net()
    x = toxicity.prepare(*as_bytes(pa.array(["the idiot of was", "a b c d e"])))
    rng = np.random.default_rng(0)
    p = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in net.p.items()}
    t, _ = toxicity.embed(p, x)
    d, keep = np.float32([1, -0.5]), {}
    toxicity.forward(p, toxicity.project(p, t), x.windows, keep)
    g, _ = toxicity.backward(p, t, keep, d)
    for k in g:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        old, out = p[k][i], []
        for step in (0.01, -0.01):
            p[k][i] = old + step
            out.append(float(toxicity.forward(p, toxicity.project(p, t), x.windows) @ d))
        p[k][i] = old
        assert abs((out[0] - out[1]) / 0.02 - g[k][i]) < 2e-3, k


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows, labels = [], []
    for d in range(400):
        w = [word() for _ in range(rng.integers(3, 120))]
        bad = d % 5 == 0
        for k in range(0, len(w), 25) if bad else ():
            w[k] = ("zzbad", "zzworse", "zzworst")[rng.integers(0, 3)]
        rows.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, net).collect()}
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (d in set(held)) for d, _ in rows)
    right = [got[d]["predicted"] == labels[d][1] for d in held]
    assert sum(right) / len(right) > 0.9
    # labels of held-out rows don't matter
    turned = spark.createDataFrame([(d, 1 - y if d in set(held) else y) for d, y in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.train(docs, turned)).collect()}
    assert all(abs(again[d] - got[d]["score"]) < 1e-9 for d, _ in rows)
    assert toxicity.scored(odd, net).count() == len(brute.ODD) and toxicity.scored(empty, net).count() == 0
    assert toxicity.keep_clean(odd, net).columns == odd.columns
    assert toxicity.train(docs, lab.where("toxic = 0")).constant == 0.0
    assert {r["score"] for r in toxicity.scored(odd, toxicity.Net({}, constant=0.0)).collect()} == {0.0}


# ---------------------------------------------------------------- token counts


def test_rollups(spark, sf_dir, duck, tmp_path, empty):
    got = rows_of(queries.op9_token_counts(spark, sf_dir))
    assert got == sorted(duck.execute(queries.OP9_SQL).fetchall(), key=str)
    rows = [("a b", None, "s", 7), (None, "en", "s", 7), ("a b", None, "s", 7)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string, n_tokens int")  # a clashing name
    roll = rollups.Rollup(spark, str(tmp_path / "r"))
    assert rows_of(roll.totals()) == [] and roll.totals().columns == [*rollups.KEYS, *rollups.TOTALS]
    assert [roll.commit("b1", rollups.inserts(docs, "spaced-1")) for _ in range(2)] == [True, False]
    assert rows_of(roll.totals()) == [("s", "en", "spaced-1", 1, 0, 0), ("s", None, "spaced-1", 2, 4, 6)]
    roll.commit("b2", rollups.revisions(docs.where("lang is null"), "spaced-1", "alnum-2"))
    roll.commit("b3", rollups.deletes(docs.where("lang = 'en'"), "spaced-1"))
    roll.commit("b4", rollups.inserts(docs.limit(0), "spaced-1"))
    want = [("s", None, "alnum-2", 2, 4, 6)]
    assert rows_of(roll.totals()) == want
    # a document deleted twice under another name is refused, and nothing changes
    with pytest.raises(rollups.NegativeTotal):
        roll.commit("b5", rollups.deletes(docs.where("lang = 'en'"), "spaced-1"))
    assert rows_of(roll.totals()) == want and roll.versions() == [1, 2, 3, 4]
    assert rows_of(roll.totals(1)) == [("s", "en", "spaced-1", 1, 0, 0), ("s", None, "spaced-1", 2, 4, 6)]
    # what a commit that died has left is not seen; one that died after its version was there is not repeated
    (tmp_path / "r" / "data" / "dead").mkdir(parents=True)
    (tmp_path / "r" / "batches" / "b4").unlink()
    (tmp_path / "r" / "last").write_text("99")
    again = rollups.Rollup(spark, str(tmp_path / "r"))
    assert rows_of(again.totals()) == want and not any(again.commit(b, rollups.inserts(docs, "spaced-1")) for b in ("b4", "b1"))
    again.vacuum(1)
    assert again.versions() == [4] and rows_of(again.totals()) == want and not again.commit("b2", rollups.inserts(docs, "spaced-1"))


def test_rollup_commits_at_a_time(spark, tmp_path, monkeypatch):
    """No batch is lost or counted twice when commits meet, and a version that is there is never written over."""
    from concurrent.futures import ThreadPoolExecutor

    delta = spark.createDataFrame([("s", "en", "v", 1, 10, 100)], rollups.SCHEMA)
    rolls = [rollups.Rollup(spark, str(tmp_path / "r")) for _ in range(3)]
    names = [f"b{k % 6}" for k in range(9)]  # three of them twice
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda k: rolls[k % 3].commit(names[k], delta), range(9)))
    assert sum(done) == 6 and rolls[0].versions() == [1, 2, 3, 4, 5, 6]
    assert rows_of(rolls[0].totals()) == [("s", "en", "v", 6, 60, 600)]
    # the other commit takes the number while this one is about to
    real, other = rolls[0]._publish, rolls[1]

    def late(name, text):
        if name.endswith("7") and not other.versions()[-1] == 7:
            assert other.commit("first", delta)
        return real(name, text)

    monkeypatch.setattr(rolls[0], "_publish", late)
    assert rolls[0].commit("second", delta) and rolls[0].versions()[-1] == 8
    assert rows_of(rolls[2].totals()) == [("s", "en", "v", 8, 80, 800)]
    # the way of file systems that are not the machine's own
    for name, is_new in (("7", False), ("9", True)):
        rolls[0]._put("aside/x", "x")
        to = rolls[0]._at("log/" + name.zfill(20))
        qualified = rolls[0]._files().makeQualified
        assert rolls[0]._renamed(qualified(rolls[0]._at("aside/x")), qualified(to)) == is_new
        assert not rolls[0]._files().exists(rolls[0]._at("aside/x"))
    rolls[0]._files().delete(to, False)
    assert not real("log/" + "7".zfill(20), "x") and rows_of(rolls[2].totals(7)) == [("s", "en", "v", 7, 70, 700)]


# ---------------------------------------------------------------- BPE


def test_bpe(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    for df in (docs, odd):
        want = []
        for d, x in plain(df):
            ids = t.encode(x or "", add_special_tokens=False).ids
            sha = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
            want.append((d, len(ids), *sha))
        assert rows_of(tokens.encoded(df, path)) == sorted(want, key=str)
    assert tokens.encoded(empty, path).count() == 0


@pytest.mark.parametrize("mask_bits", [0, 1, 3, 5])
def test_bpe_joints(mask_bits):
    """Cuts anywhere (at every character, too): in words, numbers, contractions, runs of spaces, non-ASCII; repaired joints give the library's ids."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(mask_bits)
    parts = ["don't", "they're", "we'll", "'", "''", "'r", "e", " ", "  ", "\n", "\n\n  ", "\t ", "123", "4567890", "ünïcode", "漢字漢字", "word", "Words", "...", "!?", "\u00a0", "é", "x" * 70, "🎉", "'ve'S", "\u3000", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(300)] + ["", "a", " ", "x" * 500, " " * 300 + "y", "'" * 99, "<|endoftext|><|endoftext|>"]
    for kept in (3, 10_000):
        c = tokens.Codec(queries.tokenizer_path(), kept=kept, mask_bits=mask_bits)
        ids, at = c.encode(*as_bytes(pa.array(texts)))
        for x, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == t.encode(x, add_special_tokens=False).ids, x
    assert any(v is None or v[0] > 0 for v in c.joints.values())  # some joints did not hold


def test_bpe_without_breaks():
    """Long texts that no piece ends in cost about what the encoder alone takes on them, and give the library's ids."""
    import time

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, c = Tokenizer.from_file(path), tokens.Codec(path)
    rng = np.random.default_rng(8)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9000, 200_000)))
    for text in (letters, chinese, " ".join((letters[:70_000], chinese[:30_000], "and on", letters[:300]))):
        began = time.perf_counter()
        alone = c.t.encode_ordinary(text)
        took = [time.perf_counter() - began]
        ids, at = c.encode(*as_bytes(pa.array([text, "x"])))
        took.append(time.perf_counter() - began - took[0])
        assert ids[: at[1]].tolist() == alone
        assert took[1] < 8 * took[0] + 2
    short = letters[:30_000] + chinese[:10_000]
    ids, at = c.encode(*as_bytes(pa.array([short])))
    assert ids.tolist() == t.encode(short, add_special_tokens=False).ids


# ---------------------------------------------------------------- suffix-array dedup


@pytest.mark.parametrize("cap,base", [(50, 10**9), (50, 3), (None, 10**9), (None, 1)])
@pytest.mark.parametrize("most,piece", [(1 << 30, 1 << 16), (300, 7)])
def test_induction(monkeypatch, cap, base, most, piece):
    """Order and common prefixes against plain sorting: in memory, with queues on disk, and through several recursions."""
    from lamina.llm import induction

    spilled, depth = [], []
    spill, order = induction.Queue._spill, induction._seeds_in_order
    monkeypatch.setattr(induction.Queue, "_spill", lambda q: (spill(q), spilled.append(q.spilled))[0])
    monkeypatch.setattr(induction, "_seeds_in_order", lambda text, *a: (depth.append(text.dtype), order(text, *a))[1])
    monkeypatch.setattr(induction, "PIECE", piece)
    rng = np.random.default_rng(0)
    for trial in range(8):
        strings = [rng.integers(1, 1 + rng.integers(1, 6), rng.integers(1, 90)) for _ in range(rng.integers(1, 25))]
        strings += strings[:3] * (trial % 2)
        text = np.concatenate([np.append(s, 0) for s in strings]).astype(np.uint16)
        ends = np.flatnonzero(text == 0)
        sa, lcp = (np.concatenate(x) for x in zip(*induction.induced(text, cap, most, base)))
        assert sorted(sa.tolist()) == np.flatnonzero(text > 0).tolist()
        keys = [text[p : ends[np.searchsorted(ends, p)]][:cap].tolist() for p in sa]
        assert keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], lcp[1:]):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert cap is None or n == same
    assert bool(spilled) == (most == 300)  # far more tuples than the queues may hold
    assert (np.dtype(np.uint32) in depth) == (base < 10)


def test_removals(spark, docs, odd, empty):
    from lamina.llm import suffix_dedup

    periodic = [(100, "ab" * 300), (101, "x" + "ab" * 100 + "y"), (102, "ab" * 300), (103, "z" * 60)]
    more = spark.createDataFrame([(d, t, 1, "p", 2, None, "s") for d, t in periodic], SCHEMA)
    for df in (docs.limit(150), odd.unionByName(more)):
        got = suffix_dedup.removals(df)
        assert rows_of(got) == sorted(brute.removals(plain(df)), key=str)
    assert suffix_dedup.removals(empty).count() == 0


def test_repeats_beyond_memory():
    """One shard of many times what its queues and its base case hold: the same groups as by a table of windows."""
    from lamina.llm import induction, suffix_dedup

    rng = np.random.default_rng(3)
    pool = rng.integers(97, 101, 4000).astype(np.uint8)
    size = rng.integers(50, 114, 400)
    data = [pool[a : a + n] for a, n in zip(rng.integers(0, 3880, 400), size)]
    least = rng.integers(0, 1000, 400)
    want = {}
    for s, d in zip(data, least):
        for k in range(len(s) - 49):
            want[bytes(s[k : k + 50])] = min(want.get(bytes(s[k : k + 50]), d), d)
    seen = 0
    for own, off, low in suffix_dedup.repeats((np.concatenate(data), size), least, most=2000, base=50):
        assert all(want[bytes(data[i][k : k + 50])] == m for i, k, m in zip(own, off, low))
        seen += len(own)
    assert seen == sum(size - 49) and induction.BASE > 50


def test_removals_frequent_phrase(spark, odd, monkeypatch):
    """One phrase in all texts with other surroundings: its shard is too large for a task and is split, with the same result."""
    from lamina.llm import suffix_dedup

    rng = np.random.default_rng(7)
    noise = lambda: bytes(rng.integers(97, 123, 60).astype(np.uint8)).decode()
    rows = [(d, noise() + " a phrase that all of them hold " + noise()) for d in range(300)]
    rows += [(d, noise() + rows[d - 300][1][40:120] + noise()) for d in range(300, 330)]
    most, seen = 5_000, []
    split = suffix_dedup._by_size

    def spy(packed, limit):
        fit, large = split(packed, limit)
        sizes = lambda df: [r[0] for r in df.groupBy("shard").agg(suffix_dedup.F.sum("total")).select("sum(total)").collect()]
        seen.append((max(sizes(fit), default=0), sizes(large)))
        return fit, large

    monkeypatch.setattr(suffix_dedup, "_by_size", spy)
    monkeypatch.setattr(suffix_dedup, "LARGE_BYTES", most)
    got = suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(got) == sorted(brute.removals(rows), key=str)
    assert seen[0][0] <= most and seen[0][1]
    # all shards by windows
    monkeypatch.setattr(suffix_dedup, "LARGE_BYTES", 0)
    assert rows_of(suffix_dedup.removals(odd)) == sorted(brute.removals(plain(odd)), key=str)


def test_cut_texts(spark, odd):
    from lamina.llm import suffix_dedup

    rows = odd.withColumnRenamed("n", "n_chars")
    cut = suffix_dedup.cut_texts(rows)
    assert cut.columns == rows.columns
    want = {(str(d), h) for d, _, _, _, h in brute.removals(plain(odd)) if d not in (7, 8)}
    got = {(str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in cut.collect() if r["doc_id"] not in (7, 8)}
    assert got == want and cut.count() == len(brute.ODD)


def test_license_placeholders_tags_and_full_texts(spark):
    import duckdb
    import pandas as pd

    s = licenses.SENTENCES
    head = f"{s['bsd-redistribution']}:\n\n1. {s['bsd-source']}.\n2. {s['bsd-binary']}.\n"
    endorse = lambda who: s["bsd-endorse"].replace("the copyright holder", who)
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    cases = [
        (head + f"3. {endorse('Google Inc.')}.", "BSD-3-Clause"),
        (wrapped(head + f"3. {endorse('the University of Somewhere, its Regents & Sons Ltd.')}.", 60, " * "), "BSD-3-Clause"),
        (head + f"3. {endorse('机构')}.", "BSD-3-Clause"),
        (head + f"3. {endorse(' '.join(['word'] * 21))}.", "BSD-2-Clause"),
        (head, "BSD-2-Clause"),
        (gpl2, "GPL-2.0-only"),
        (f"{s['gpl-free']}; {s['gpl-terms']}; {s['gpl2-only-version']}.", "GPL-2.0-only"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"),
        ("# SPDX-License-Identifier: MIT\n# Copyright 2020 Some One\nimport x\n", "MIT"),
        ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", ""),
        ("/* SPDX-License-Identifier: GPL-2.0+ */", ""),
        ("Neither the name of " * 20_000, ""),
        (None, ""),
    ]
    rows = [(k, t) for k, (t, _) in enumerate(cases)]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r[3] for r in got] == [n for _, n in cases]
    by = "THIS SOFTWARE IS PROVIDED BY SOME BODY, INC. AND CONTRIBUTORS" + s["bsd-warranty"].split("CONTRIBUTORS")[1]
    assert licenses.scan(spark.createDataFrame([(1, by + ".")], "doc_id long, text string")).first()["sentence_ids"] == "bsd-warranty"
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(con.execute(licenses.SQL).fetchall()) == got


def test_members_of_fitting_size(spark):
    """A member of a group stays if its size fits that of any other one there, for every threshold."""
    rng = np.random.default_rng(5)
    token, sid, n = rng.integers(1, 60, 400).astype(np.uint64) << np.uint64(1), np.arange(400).astype(np.uint64), rng.integers(1, 90, 400)
    for threshold in ((80, 100), (90, 100), (1, 1), (1, 3)):
        num, den = threshold
        fits = lambda a, b: den * min(a, b) >= num * max(a, b)
        want = [any(j != i and token[j] == token[i] and fits(int(n[i]), int(n[j])) for j in range(400)) for i in range(400)]
        assert ngram_join.fitting(token, n, threshold).tolist() == want and (any(want) and not all(want) or num == 1)
        data = np.empty(400, ngram_join.MEMBER)
        data["token"], data["sid"], data["n"] = token, sid, n
        # the same rows twice: a set is no partner of its own
        packed = spark.createDataFrame([(0, bytearray(data[a:b].tobytes())) for a, b in ((0, 250), (250, 400), (0, 400))], "part int, data binary")
        got = ngram_join._groups(packed, threshold, 2).collect()
        assert sorted(r["sid"] for r in got) == [i for i in range(400) if want[i]]
        sizes = {t: sum(w for w, u in zip(want, token.tolist()) if u == t) for t in set(token.tolist())}
        assert all(r["size"] == sizes[int(token[r["sid"]])] for r in got)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_only_needed_texts_move(spark, kind):
    """The join with the needed sets gets their documents, a null id's too, and hardly any other."""
    ids = [None, *range(3000)]
    texts = spark.createDataFrame([(d, f"a b c{d}") for d in ids], "_id long, _text string").selectExpr(f"cast(_id AS {kind}) AS _id", "_text")
    for wanted in ([None, 0, 1500, 2999], [], ids):
        need = spark.createDataFrame([(0, d) for d in wanted], "sid long, rep long").selectExpr("sid", f"cast(rep AS {kind}) AS rep")
        got = [r["_text"] for r in ngram_join._needed(texts, need).collect()]
        assert len(got) == len(set(got)) <= len(wanted) + 3 * bool(wanted) and {f"a b c{d}" for d in wanted} <= set(got)


def test_recurring_strings():
    """Strings with a window that another document has too all stay, periodic ones too; most that share their minimizer only go before the sort."""
    from lamina.llm import suffix_dedup

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(24)]
    docs = [" ".join(rng.choice(words, 40)).encode() for _ in range(120)]
    for k in range(0, 40, 4):
        at = int(rng.integers(0, 250))
        docs[k + 1] = docs[k + 1][:30] + docs[k][at : at + int(rng.integers(49, 90))] + docs[k + 1][30:]
    docs += [b"xyz" * 60, b"zx" + b"yzx" * 40, b"q" * 130, b"q" * 70, docs[7]]
    buf, offs = as_bytes(pa.array(docs))
    h, doc, at, n = suffix_dedup.minimizers(buf, offs)
    size = n + suffix_dedup.LENGTH - 1
    held = {}
    for k in range(len(h)):
        for a in range(int(at[k]), int(at[k] + n[k])):
            held.setdefault(buf[a : a + suffix_dedup.LENGTH].tobytes(), set()).add(int(doc[k]))
    want = np.array([any(len(held[buf[a : a + suffix_dedup.LENGTH].tobytes()]) > 1 for a in range(int(at[k]), int(at[k] + n[k]))) for k in range(len(h))])
    strings = np.concatenate([buf[a : a + s] for a, s in zip(at, size)]), size
    got = suffix_dedup.recurring(strings, doc, doc)
    assert want.sum() > 40 and not (want & ~got).any()
    _, number, of = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.array([len(set(doc[number == k].tolist())) > 1 for k in range(len(of))])[number]
    assert got.sum() - want.sum() < (shared & ~want).sum() / 2
