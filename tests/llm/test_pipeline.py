"""The corpus pipeline against plain versions of its stages, on odd rows, copies, toxic and contaminated documents."""

import hashlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lamina.llm import queries, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n long, part string, key string, sid string, comp string"


def rows_and_labels():
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, labels = dict(t for t in brute.ODD if t[0] is not None and t[0] not in (7, 8)), []
    for d in range(100, 220):
        bad = d % 4 == 0
        w = prose(40).split()
        for k in range(0, 40, 8) if bad else ():
            w[k] = ("zzbad", "zzworse", "zzworst")[rng.integers(0, 3)]
        texts[d] = " ".join(w)
        labels.append((d, int(bad)))
    passage = prose(30)
    items = [(1, prose(20)), (2, prose(15)), (3, None)]
    for k in range(6):
        texts[300 + k] = f"{prose(20)} {passage} {prose(20)}"
        texts[310 + k] = texts[101 + 2 * k] + " and some more"  # near copies
        texts[320 + k] = f"{prose(25)} {items[k % 2][1]} {prose(3)}"
    rows = [(d, t, "en", "web", len(t or ""), 1, "p", None, "s", "c") for d, t in texts.items()]
    rows += [(None, "a row without an id that has some words in it", None, None, None, 1, "p", None, "s", "c"), rows[3], rows[20]]
    return rows, labels, items


def plainly(rows, net, items):
    """(rows after each stage)."""
    scores = toxicity.scores(net, pa.array([r[1] for r in rows], pa.string()))
    rows = [r for r, s in zip(rows, scores) if s < toxicity.THRESHOLD]
    out = [rows]
    near = brute.near([(r[0], r[1]) for r in rows], 5, 80, 100)
    groups = {}
    for r, (d, n, comp) in zip(rows, near):
        groups.setdefault((comp if n else None, None if n else len(groups)), []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for g in groups.values()]
    out.append(rows)
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for k in range(len(b) - 49):
            if r[0] is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], r[0]), r[0])
    cut = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if r[0] is not None and first[b[k : k + 50]] < r[0]:
                gone[k : k + 50] = True
        text = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if r[1] is not None else None
        cut.append((r[0], text, r[2], r[3], len(text) if gone.any() else r[4], *r[5:]))
    out.append(cut)
    judged = brute.contamination([(r[0], r[1]) for r in cut], items)
    out.append([r for r, j in zip(cut, judged) if not j[5]])
    return out


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels, items = rows_and_labels()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = plainly(rows, toxicity.train(docs, lab), items)
    assert len(rows) > len(want[0]) > len(want[1]) > 60 and want[2] != want[1] and len(want[3]) < len(want[2])
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert sorted(map(str, (tuple(r) for r in docs.collect()))) == sorted(map(str, plain)), name
    t = Tokenizer.from_file(queries.tokenizer_path())
    ends = []
    for r in want[3]:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        ends.append((r[0], len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, ends))


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
