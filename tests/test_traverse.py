"""Traversal against a plain version of its rules, pauses, policies, starts and training moves."""

import math

import numpy as np
import pandas as pd
import pytest

from lamina.operators import kernels, traverse

logit = lambda p: math.log(p / (1 - p))


def plain(image, mask, config, predict, seeds, start=None):
    """The rules with dictionaries and lists: {place: id}, origins, overlaps."""
    shape, r = image.shape, [f // 2 for f in config.fov]
    seg = dict(start or {})
    last, origins, overlaps = max(seg.values(), default=0), {}, []

    def inside(p):
        return all(c - h >= 0 and c + h < n for c, h, n in zip(p, r, shape))

    for s in seeds:
        if not inside(s) or seg.get(s, 0) > 0 or mask[s]:
            continue
        near = [seg.get((s[0] + a, s[1] + b, s[2] + c), 0) for a in range(-config.boundary[0], config.boundary[0] + 1) for b in range(-config.boundary[1], config.boundary[1] + 1) for c in range(-config.boundary[2], config.boundary[2] + 1)]
        if any(v > 0 for v in near):
            seg[s] = -1
            continue
        logits, todo, done, n = {s: logit(config.init)}, [s], set(), 0
        while True:
            p = None
            while todo:
                q = todo.pop(0)
                cell = tuple((c - o + d // 2) // d for c, o, d in zip(q, s, config.deltas))
                if cell not in done and not logits.get(q, math.inf) < logit(config.move) and inside(q) and seg.get(q, 0) <= 0:
                    p = q
                    break
            if p is None or logits[s] < logit(config.move):
                break
            if mask[p]:
                continue
            sl = tuple(slice(c - h, c + h + 1) for c, h in zip(p, r))
            places = [(z, y, x) for z in range(p[0] - r[0], p[0] + r[0] + 1) for y in range(p[1] - r[1], p[1] + r[1] + 1) for x in range(p[2] - r[2], p[2] + r[2] + 1)]
            old = np.array([logits.get(q, logit(config.pad)) for q in places]).reshape(config.fov)
            new = predict(image[sl], old)
            object_like = np.mean(new >= logit(config.move)) > config.disconnected
            for q, v in zip(places, new.ravel()):
                was = logits.get(q)
                logits[q] = was if object_like and was is not None and was < 0 and v > was else float(v)
            done.add(tuple((c - o + d // 2) // d for c, o, d in zip(p, s, config.deltas)))
            n += 1
            found = set()
            for axis in range(3):
                for side in (-1, 1):
                    face = [q for q in places if q[axis] - p[axis] == side * config.deltas[axis] and all(abs(q[k] - p[k]) <= config.deltas[k] for k in range(3))]
                    best = max(face, key=lambda q: (logits[q], [-c for c in q]))
                    if logits[best] >= logit(config.move):
                        found.add((logits[best], tuple(b - c for b, c in zip(best, p))))
            todo += [tuple(c + o for c, o in zip(p, off)) for _, off in sorted(found, reverse=True)]
        if n == 0:
            continue
        hit = [q for q, v in logits.items() if v >= logit(config.segment)]
        free = [q for q in hit if seg.get(q, 0) <= 0]
        if logits[s] < logit(config.move) or len(free) < config.min_size:
            if seg.get(s, 0) == 0:
                seg[s] = -1
            continue
        last += 1
        for i in sorted({seg[q] for q in hit if seg.get(q, 0) > 0}):
            overlaps.append((last, i, sum(seg.get(q, 0) == i for q in hit)))
        for q in free:
            seg[q] = last
        origins[last] = (*s, n)
    return {q: v for q, v in seg.items() if v > 0}, origins, overlaps


def rough(seed):
    rng = np.random.default_rng(seed)
    image = kernels.gaussian(rng.standard_normal((9, 12, 14)), 1.0)
    return image / image.std(), rng.random(image.shape) < 0.05


#: Predictions that depend on the logits so far, so that later steps undo earlier ones.
def moody(image, logits):
    return np.clip(6 * (image - 0.1) + 0.3 * logits - 2 * np.abs(image - np.roll(image, 1)), -6, 6)


@pytest.mark.parametrize("seed,disconnected", [(0, 0.0), (1, 0.0), (2, -1.0), (3, 0.3)])
def test_rules(seed, disconnected):
    image, mask = rough(seed)
    config = traverse.Config(fov=(3, 3, 3), deltas=(1, 1, 1), min_size=4, move=0.7, disconnected=disconnected)
    seeds = traverse.brightest_first(image, mask, 0.5)
    if disconnected < 0:
        config = traverse.Config(**{**config.__dict__, "disconnected": 1.0})  # a share that is never exceeded holds nothing
    canvas = traverse.Canvas(image, moody, config, mask)
    assert canvas.segment_all(seeds)
    seg, origins, overlaps = plain(image, mask, config, moody, seeds)
    assert {tuple(int(c) for c in p): int(canvas.labels[tuple(p)]) for p in np.argwhere(canvas.labels > 0)} == seg
    assert canvas.origins == origins and canvas.overlaps == overlaps and len(origins) > 1
    assert canvas.counters["skip_threshold"] > 0 and canvas.counters["voxels_segmented"] == len(seg)


@pytest.mark.parametrize("most", [1, 5, 23])
def test_pauses(most):
    """Saved and restored in the middle of objects, as often as it takes: the same result."""
    image, mask = rough(1)
    config = traverse.Config(fov=(3, 3, 3), min_size=4, move=0.7)
    seeds = traverse.brightest_first(image, mask, 0.5)
    whole = traverse.Canvas(image, moody, config, mask)
    whole.segment_all(seeds)
    state, rounds, limit = None, 0, most
    while True:
        canvas = traverse.Canvas(image, moody, config, mask)
        if state:
            canvas.restored(state)
        limit = canvas.partial + most
        done = canvas.segment_all(seeds, limit)
        state, rounds = canvas.saved(), rounds + 1
        if done:
            break
    assert rounds > 2 and (canvas.labels == whole.labels).all() and canvas.origins == whole.origins and canvas.overlaps == whole.overlaps
    assert canvas.counters == whole.counters


def test_start_from_and_policies():
    image, mask = rough(2)
    config = traverse.Config(fov=(3, 3, 3), min_size=4, move=0.7)
    seeds = traverse.brightest_first(image, mask, 0.5)
    start = np.zeros(image.shape, int)
    start[2:5, 2:6, 2:6], start[6:, 8:, 8:] = 70, 9
    canvas = traverse.Canvas(image, moody, config, mask)
    canvas.start_from(start)
    assert canvas.ids.tolist() == [0, 9, 70] and canvas.last_id == 2
    canvas.segment_all(seeds)
    local = {tuple(int(c) for c in p): {9: 1, 70: 2}[start[tuple(p)]] for p in np.argwhere(start > 0)}
    seg, origins, overlaps = plain(image, mask, config, moody, seeds, local)
    assert {tuple(int(c) for c in p): int(canvas.labels[tuple(p)]) for p in np.argwhere(canvas.labels > 0)} == seg and min(origins) == 3 and canvas.overlaps == overlaps
    best = traverse.Canvas(image, moody, traverse.Config(**{**config.__dict__, "policy": "best"}), mask)
    best.segment_all(seeds)
    assert best.counters["segments"] > 0
    with pytest.raises(KeyError):
        traverse.policy("none")
    none = traverse.Restrictor(np.ones(image.shape, bool))
    assert none.all_masked and not traverse.Restrictor(mask, None).all_masked
    held = traverse.Canvas(image, moody, config, traverse.Restrictor(None, np.ones(image.shape, bool)))
    held.segment_all(seeds)
    assert not held.origins


def test_results(spark):
    """Rows by kind equal one canvas; a start segmentation keeps its ids; a sub-volume masked wholly gives nothing."""
    image, mask = rough(3)
    config = traverse.Config(fov=(3, 3, 3), min_size=4, move=0.7)
    start = np.zeros(image.shape, int)
    start[2:5, 2:6, 2:6] = 70
    canvas = traverse.Canvas(image, moody, config, mask)
    canvas.start_from(start)
    canvas.segment_all(traverse.brightest_first(image, mask, 0.5))
    at = np.indices(image.shape).reshape(3, -1)
    pdf = pd.DataFrame({"z": at[0] + 5, "y": at[1], "x": at[2], "value": image.ravel(), "mask": mask.ravel(), "start_label": start.ravel()})
    both = pd.concat([pdf.assign(volume="a"), pdf.assign(volume="b", mask=True, start_label=0)])
    vox = spark.createDataFrame(both, "z int, y int, x int, value double, mask boolean, start_label long, volume string")
    got = traverse.segment_results(vox, ["volume"], moody, config, 0.5).toPandas()
    assert set(got["volume"]) == {"a"}
    v = got[got["kind"] == "voxel"]
    assert {(z - 5, y, x): s for z, y, x, s in v[["z", "y", "x", "segment_id"]].itertuples(index=False)} == {tuple(p): canvas.labels[tuple(p)] for p in np.argwhere(canvas.labels > 0).tolist()}
    assert set(v[v["segment_id"] == 1]["other"]) == {70}
    o = got[got["kind"] == "origin"]
    assert {int(i): (z - 5, y, x, n) for i, z, y, x, n in o[["segment_id", "z", "y", "x", "n"]].itertuples(index=False)} == canvas.origins
    c = got[got["kind"] == "counter"]
    assert dict(zip(c["name"], c["n"].astype(int))) == canvas.counters
    assert sorted(map(tuple, got[got["kind"] == "overlap"][["segment_id", "other", "n"]].astype(int).to_numpy().tolist())) == sorted(canvas.overlaps)


def test_training_steps(spark):
    image, _ = rough(4)
    target = np.where(image > 0, 0.95, 0.05)
    config = traverse.Config(fov=(3, 3, 3), move=0.7)
    assert [list(o) for o, *_ in traverse.no_step(image, target, 0.0)] == [[0, 0, 0]]
    at = np.indices(image.shape).reshape(3, -1)
    pdf = pd.DataFrame({"k": 1, "z": at[0], "y": at[1], "x": at[2], "value": image.ravel(), "target": target.ravel()})
    vox = spark.createDataFrame(pdf, "k int, z int, y int, x int, value double, target double")
    mid = tuple(n // 2 for n in image.shape)

    def replay(rows):
        logits = np.full(image.shape, logit(config.pad))
        logits[mid] = logit(config.init)
        for r in rows:
            off = (r["dz"], r["dy"], r["dx"])
            c = tuple(m + o for m, o in zip(mid, off))
            assert r["wanted"] == (target[c] >= config.move - 1e-9)
            valid = logits[c] >= logit(config.move)
            if r["made"]:
                assert valid
                sl = tuple(slice(k - 1, k + 2) for k in c)
                logits[sl] = moody(image[sl], logits[sl])
            yield off, valid, r
        assert abs(rows[-1]["loss"] - np.mean(np.log1p(np.exp(-logits)) * target + np.log1p(np.exp(logits)) * (1 - target))) < 1e-9

    shifts = traverse.training_moves((1, 1, 1), 1, seed=5)[1:]
    rows = traverse.training_steps(vox, ["k"], traverse.fixed_steps(shifts), moody, config).orderBy("step").collect()
    steps = list(replay(rows))
    assert [o for o, *_ in steps] == [(0, 0, 0), *shifts] and all(valid == r["made"] for _, valid, r in steps)
    rows = traverse.training_steps(vox, ["k"], traverse.steps_of_maxima((1, 1, 1), (3, 3, 3), (2, 3, 3)), moody, config).orderBy("step").collect()
    steps = list(replay(rows))
    assert all((valid and (r["wanted"] or o == (0, 0, 0))) == r["made"] for o, valid, r in steps) and all(abs(o[0]) <= 2 and abs(o[1]) <= 3 for o, *_ in steps)
    radii = [sum(map(abs, m)) for m in [(0, 0, 0), *shifts]]
    assert radii == sorted(radii) and shifts != traverse.training_moves((1, 1, 1), 1, seed=6)[1:]


def test_training_steps_of_thin_examples(spark):
    """Examples of 1 to 7 slices, as at the end of a volume: every one has rows, moves stay inside, and none is made where the patch does not fit."""
    config = traverse.Config(fov=(3, 3, 3), move=0.7)
    rng = np.random.default_rng(6)
    parts = []
    for n in range(1, 8):
        a = np.abs(rng.normal(1, 0.2, (n, 9, 9)))
        at = np.indices(a.shape).reshape(3, -1)
        parts.append(pd.DataFrame({"k": n, "z": at[0], "y": at[1], "x": at[2], "value": a.ravel(), "target": 0.95}))
    vox = spark.createDataFrame(pd.concat(parts), "k int, z int, y int, x int, value double, target double")
    shifts = traverse.training_moves((1, 1, 1), 2)[1:]
    for go in (traverse.steps_of_maxima((1, 1, 1), (3, 3, 3), (2, 2, 2)), traverse.fixed_steps(shifts), traverse.no_step):
        rows = traverse.training_steps(vox, ["k"], go, traverse.threshold_predictor(0.0, 20.0), config).collect()
        assert {r["k"] for r in rows} == set(range(1, 8))
        made = {(r["k"], r["dz"]) for r in rows if r["made"]}
        assert all(n // 2 + dz >= 1 and n // 2 + dz + 1 < n for n, dz in made) and {n for n, _ in made} == set(range(3, 8))
        assert all(r["loss"] > 0 for r in rows)
    rows = traverse.training_steps(vox.where("k = 1"), ["k"], traverse.steps_of_maxima((1, 1, 1), (3, 3, 3), (2, 2, 2)), traverse.threshold_predictor(0.0, 20.0), config).collect()
    assert [(r["step"], r["dz"], r["dy"], r["dx"], r["wanted"], r["made"], r["deleted"]) for r in rows] == [(0, 0, 0, 0, True, False, 0)]


def test_config():
    c = traverse.config_of('{"fov": [3, 5, 7], "move": 0.8}')
    assert c.fov == (3, 5, 7) and c.move == 0.8 and c.segment == traverse.Config().segment
    with pytest.raises(ValueError):
        traverse.config_of('{"speed": 1}')


def test_resegment(spark):
    """Two bars that touch nothing: each grows back as on a canvas of its own; a point whose segment is not there has a status."""
    a = np.zeros((7, 9, 24))
    a[2:5, 3:6, 2:11], a[2:5, 3:6, 13:22] = 1, 1
    label = np.zeros(a.shape, int)
    label[2:5, 3:6, 2:11], label[2:5, 3:6, 13:22] = 4, 7
    at = np.indices(a.shape).reshape(3, -1)
    vox = spark.createDataFrame(pd.DataFrame({"z": at[0], "y": at[1], "x": at[2], "value": a.ravel(), "label": label.ravel()}), "z int, y int, x int, value double, label long")
    points = spark.createDataFrame([(4, 7, 3, 4, 12), (4, 9, 3, 4, 12)], "id_a long, id_b long, z int, y int, x int")
    got = {(r["id_a"], r["id_b"]): r for r in traverse.resegment(vox, points, (3, 4, 12), traverse.threshold_predictor(0.5, 20.0), traverse.Config(fov=(3, 3, 3))).collect()}
    r, want = got[4, 7], []
    for own in (4, 7):
        d = kernels.distance(label == own)
        canvas = traverse.Canvas(a, traverse.threshold_predictor(0.5, 20.0), traverse.Config(fov=(3, 3, 3)), (label > 0) & (label != own) & (label != 11 - own))
        canvas.segment_at(tuple(int(c) for c in np.unravel_index(np.argmax(d), d.shape)))
        want.append(np.nan_to_num(canvas.logits, nan=-np.inf) >= logit(0.6))
    sizes = [int(w.sum()) for w in want]
    shares = [float((w & (label == own)).sum() / 81) for w, own in zip(want, (4, 7))]
    assert (r["size_a"], r["size_b"], r["both"], r["iou"], r["recovered_a"], r["recovered_b"], r["status"]) == (*sizes, 0, 0.0, *shares, "ok") and min(shares) > 0.95
    assert r["depth_a"] == 2.0 and r["deleted_a"] == 0
    assert got[4, 9]["status"] == "missing"
