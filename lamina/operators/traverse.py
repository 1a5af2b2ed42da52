"""Object traversal: one sub-volume is one task; inside it the order of seeds and moves decides, so it runs in sequence.

The predictor is a plain function of (image patch, logit patch) -> logits, made once per task by a factory
(a model's weights are loaded there); `threshold_predictor` is a deterministic stand-in. Movement policies and
restrictors are found by name or given. Unvisited logits are NaN. Voxels of a sub-volume that are not there are masked.
"""

from __future__ import annotations

import io
import json
import pickle
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AXES = ("z", "y", "x")
Place = tuple[int, int, int]
Predictor = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass(frozen=True)
class Config:
    fov: Place = (5, 5, 5)
    deltas: Place = (1, 1, 1)
    init: float = 0.95
    pad: float = 0.05
    move: float = 0.9
    segment: float = 0.6
    min_size: int = 10
    boundary: Place = (1, 1, 1)
    #: Share of moved-to voxels above which new voxels may not start below one half (0: always).
    disconnected: float = 0.0
    #: Movement policy, by name.
    policy: str = "face_max"


def config_of(text: str) -> Config:
    """A configuration from JSON; unknown names are refused, missing ones keep their defaults."""
    given, known = json.loads(text), {f.name for f in fields(Config)}
    if extra := set(given) - known:
        raise ValueError(f"not in a configuration: {', '.join(sorted(extra))}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def threshold_predictor(level: float, gain: float = 8.0) -> Predictor:
    """Logits from the image alone: positive where it is above the level."""
    return lambda image, logits: np.clip((image - level) * gain, -6, 6)


def merge(old: np.ndarray, new: np.ndarray, move: float, disconnected: float) -> np.ndarray:
    """What a prediction leaves: where the patch is mostly object, voxels that were judged background may not rise again."""
    out = new.copy()
    if disconnected >= 0 and np.mean(new >= move) > disconnected:
        hold = ~np.isnan(old) & (old < 0) & (new > old)
        out[hold] = old[hold]
    return out


# ---------------------------------------------------------------- moves


def scored_moves(logits: np.ndarray, deltas: Place, threshold: float) -> list[tuple[float, Place]]:
    """(logit, offset) of the strongest voxel on each face around the centre, if it reaches the threshold; strongest first."""
    mid = [s // 2 for s in logits.shape]
    box = logits[tuple(slice(m - d, m + d + 1) for m, d in zip(mid, deltas))]
    found = set()
    for axis, d in enumerate(deltas):
        for side in (0, 2 * d) if d else ():
            face = np.take(box, side, axis)
            if np.isnan(face).all():
                continue
            k = np.unravel_index(np.nanargmax(face), face.shape)
            if face[k] >= threshold:
                off = list(k)
                off.insert(axis, side)
                found.add((float(face[k]), tuple(int(o - e) for o, e in zip(off, deltas))))
    return sorted(found, reverse=True)


def moves(logits: np.ndarray, deltas: Place, threshold: float) -> list[Place]:
    return [o for _, o in scored_moves(logits, deltas, threshold)]


class FaceMax:
    """First in, first out: the strongest voxels of a prediction's faces. A lattice cell is done when it was predicted."""

    def __init__(self, deltas: Place, threshold: float):
        self.deltas, self.threshold = deltas, threshold
        self.start((0, 0, 0))

    def start(self, at: Place) -> None:
        self.origin, self.todo, self.done = at, deque([at]), set()

    def cell(self, p: Place) -> Place:
        return tuple((c - s + d // 2) // max(d, 1) for c, s, d in zip(p, self.origin, self.deltas))

    def next(self, valid: Callable[[Place], bool]) -> Place | None:
        while self.todo:
            p = self.todo.popleft()
            if self.cell(p) not in self.done and valid(p):
                return p
        return None

    def update(self, logits: np.ndarray, p: Place) -> None:
        self.done.add(self.cell(p))
        self.todo.extend(tuple(c + o for c, o in zip(p, off)) for off in moves(logits, self.deltas, self.threshold))


class Best(FaceMax):
    """The same candidates, the strongest of all that wait first."""

    def start(self, at: Place) -> None:
        super().start(at)
        self.todo = [(np.inf, at)]

    def next(self, valid: Callable[[Place], bool]) -> Place | None:
        while self.todo:
            k = max(range(len(self.todo)), key=lambda i: self.todo[i])
            _, p = self.todo.pop(k)
            if self.cell(p) not in self.done and valid(p):
                return p
        return None

    def update(self, logits: np.ndarray, p: Place) -> None:
        self.done.add(self.cell(p))
        self.todo.extend((s, tuple(c + o for c, o in zip(p, off))) for s, off in scored_moves(logits, self.deltas, self.threshold))


POLICIES: dict[str, Callable] = {"face_max": FaceMax, "best": Best}


def policy(name: str) -> Callable:
    if name not in POLICIES:
        raise KeyError(f"unknown movement policy {name!r}; known: {', '.join(sorted(POLICIES))}")
    return POLICIES[name]


@dataclass
class Restrictor:
    """Where moves may not go, and where seeds may not start. None restricts nothing."""

    mask: np.ndarray | None = None
    seed_mask: np.ndarray | None = None

    def position(self, p: Place) -> bool:
        return self.mask is None or not self.mask[p]

    def seed(self, p: Place) -> bool:
        return self.seed_mask is None or not self.seed_mask[p]

    @property
    def all_masked(self) -> bool:
        """Nothing can be segmented: no canvas is needed."""
        return any(m is not None and bool(m.all()) for m in (self.mask, self.seed_mask))


class Canvas:
    """State of one sub-volume."""

    def __init__(self, image: np.ndarray, predict: Predictor, config: Config, mask: np.ndarray | Restrictor | None = None):
        self.image, self.predict, self.c = image, predict, config
        self.restrict = mask if isinstance(mask, Restrictor) else Restrictor(mask)
        self.logits = np.full(image.shape, np.nan)
        self.labels = np.zeros(image.shape, np.int64)
        self.prob = np.zeros(image.shape, np.int64)
        self.moves = policy(config.policy)(config.deltas, _logit(config.move))
        self.origins: dict[int, tuple] = {}
        self.overlaps: list[tuple] = []
        self.counters: dict[str, int] = {}
        self.history: list[tuple[Place, int]] = []
        self.last_id = 0
        self.seeds_done, self.partial = 0, 0
        self.ids: np.ndarray | None = None

    def count(self, name: str, by: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + by

    def valid(self, p: Place, start: bool = False) -> bool:
        """Whether a prediction may be made here: still at the move threshold (not asked of a start), inside, and not segmented."""
        if not start and self.logits[p] < _logit(self.c.move):  # false for unvisited voxels
            self.count("skip_threshold")
            return False
        r = [f // 2 for f in self.c.fov]
        if any(c - h < 0 or c + h >= n for c, h, n in zip(p, r, self.image.shape)) or self.labels[p] > 0:
            self.count("skip_invalid_pos")
            return False
        return True

    def step(self, p: Place) -> np.ndarray:
        at = tuple(slice(c - f // 2, c - f // 2 + f) for c, f in zip(p, self.c.fov))
        old = self.logits[at]
        raw = self.predict(self.image[at], np.where(np.isnan(old), _logit(self.c.pad), old))
        self.history.append((p, int(((old >= _logit(0.8)) & (raw < 0)).sum())))
        self.logits[at] = new = merge(old, raw, _logit(self.c.move), self.c.disconnected)
        return new

    def segment_at(self, start: Place, most: int | None = None) -> int:
        """Grow one object until no position is left or its start has fallen below the move threshold; returns the steps made.

        After `most` steps growth pauses (partial tells so); calling again for the same start goes on.
        """
        if not self.partial:
            self.logits[:] = np.nan
            self.logits[start] = _logit(self.c.init)
            self.moves.start(start)
            self.history = []
        n = self.partial
        self.partial = 0
        while (p := self.moves.next(self.valid)) is not None:
            if self.logits[start] < _logit(self.c.move):
                self.count("seed_got_too_weak")
                break
            if not self.restrict.position(p):
                self.count("skip_restricted_pos")
                continue
            self.moves.update(self.step(p), p)
            n += 1
            if most is not None and n >= most:
                self.partial = n
                break
        return n

    def segment_all(self, seeds: Iterable[Place], most: int | None = None) -> bool:
        """Grow objects from the seeds in order, from the first that is not done; False if it paused after `most` steps of one object."""
        for k, s in enumerate(seeds):
            if k < self.seeds_done:
                continue
            if not self.partial:
                self.seeds_done = k + 1
                if not (self.valid(s, start=True) and self.restrict.position(s) and self.restrict.seed(s)):
                    continue
                near = tuple(slice(max(0, c - b), c + b + 1) for c, b in zip(s, self.c.boundary))
                if (self.labels[near] > 0).any():
                    self.labels[s] = -1
                    self.count("too_close")
                    continue
            n = self.segment_at(s, most)
            if self.partial:
                self.seeds_done = k
                return False
            self.seeds_done = k + 1
            self._finish(s, n)
        return True

    def _finish(self, s: Place, n: int) -> None:
        """Keep or reject the object that grew from a seed."""
        if n == 0:
            self.count("no_steps")
            return
        with np.errstate(invalid="ignore"):
            hit = self.logits >= _logit(self.c.segment)
        free = hit & (self.labels <= 0)
        weak = self.logits[s] < _logit(self.c.move)
        if weak or free.sum() < self.c.min_size:
            if self.labels[s] == 0:
                self.labels[s] = -1
            self.count("weak_seed" if weak else "too_small")
            return
        ids, cnt = np.unique(self.labels[hit & (self.labels > 0)], return_counts=True)
        self.last_id += 1
        while self.last_id in self.origins:
            self.last_id += 1
        self.overlaps += [(self.last_id, int(i), int(k)) for i, k in zip(ids, cnt)]
        self.labels[free] = self.last_id
        self.prob[free] = np.floor(254 / (1 + np.exp(-self.logits[free]))) + 1
        self.origins[self.last_id] = (*s, n)
        self.count("segments")
        self.count("voxels_segmented", int(free.sum()))
        self.count("voxels_overlapping", int(hit.sum() - free.sum()))

    def start_from(self, labels: np.ndarray) -> None:
        """Begin with an existing segmentation: its ids become 1, 2, ... in their order (`ids` holds the old ones), and new ones follow."""
        self.ids, local = np.unique(labels, return_inverse=True)
        if self.ids[0] != 0:
            self.ids, local = np.append(0, self.ids), local + 1
        self.labels[:] = local.reshape(labels.shape)
        self.prob[self.labels > 0] = 255
        self.last_id = int(self.labels.max())

    # -------------------------------------------------------- checkpoints

    STATE = ("logits", "labels", "prob", "origins", "overlaps", "counters", "history", "last_id", "seeds_done", "partial", "ids", "moves")

    def saved(self) -> bytes:
        out = io.BytesIO()
        pickle.dump({k: getattr(self, k) for k in self.STATE}, out)
        return out.getvalue()

    def restored(self, state: bytes) -> Canvas:
        """Take over a state that `saved` gave for the same sub-volume (our own bytes only)."""
        for k, v in pickle.loads(state).items():
            setattr(self, k, v)
        return self


# ---------------------------------------------------------------- Spark


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = rows[list(AXES)].min().to_numpy()
    at = tuple((rows[a] - o).to_numpy() for a, o in zip(AXES, low))
    shape = tuple(int(c.max()) + 1 for c in at)
    image, mask = np.zeros(shape), np.ones(shape, bool)
    image[at] = rows["value"]
    mask[at] = rows["mask"] if "mask" in rows else False
    return image, mask, low


def _placed(rows: pd.DataFrame, column: str, shape: tuple, low: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, np.int64)
    out[tuple((rows[a] - o).to_numpy() for a, o in zip(AXES, low))] = rows[column]
    return out


def brightest_first(image: np.ndarray, mask: np.ndarray, threshold: float) -> list[Place]:
    at = np.argwhere(image > threshold)
    order = np.lexsort((*at.T[::-1], -image[tuple(at.T)]))
    return [tuple(int(c) for c in p) for p in at[order]]


RESULT = "kind string, z int, y int, x int, segment_id long, other long, n long, name string"


def segment_results(vox: DataFrame, keys: list[str], predict: Predictor, config: Config, threshold: float) -> DataFrame:
    """Segment every sub-volume; seeds are its voxels above the threshold, the brightest first. Sub-volumes run in parallel.

    Rows by kind: `voxel` (place, segment_id, n: quantised probability), `origin` (place of the seed, segment_id, n: steps), `overlap`
    (segment_id, other: id of an earlier object, n: shared voxels), `counter` (name, n). A `mask` column restricts
    moves, a `start_label` column is a segmentation to begin with, under its own ids in `other`. A sub-volume that is masked wholly gives nothing.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, mask, low = _arrays(rows)
        canvas = Canvas(image, predict, config, mask)
        if "start_label" in rows:
            canvas.start_from(_placed(rows, "start_label", image.shape, low))
        if not canvas.restrict.all_masked:
            canvas.segment_all(brightest_first(image, mask, threshold))
        parts = []
        z, y, x = np.nonzero(canvas.labels > 0)
        own = canvas.labels[z, y, x]
        old = np.where(own < len(canvas.ids), canvas.ids[np.minimum(own, len(canvas.ids) - 1)], 0) if canvas.ids is not None else 0
        parts.append(pd.DataFrame({"kind": "voxel", "z": z + low[0], "y": y + low[1], "x": x + low[2], "segment_id": own, "other": old, "n": canvas.prob[z, y, x]}))
        parts.append(pd.DataFrame([("origin", a + low[0], b + low[1], c + low[2], i, n) for i, (a, b, c, n) in canvas.origins.items()], columns=["kind", "z", "y", "x", "segment_id", "n"]))
        parts.append(pd.DataFrame([("overlap", *o) for o in canvas.overlaps], columns=["kind", "segment_id", "other", "n"]))
        parts.append(pd.DataFrame([("counter", k, n) for k, n in canvas.counters.items()], columns=["kind", "name", "n"]))
        out = pd.concat([p for p in parts if len(p)]) if any(len(p) for p in parts) else parts[0]
        out = out.reindex(columns=["kind", *AXES, "segment_id", "other", "n", "name"])
        out = out.astype({c: "Int64" for c in ("z", "y", "x", "segment_id", "other", "n")} | {"kind": object, "name": object})
        out["name"] = out["name"].where(out["name"].notna(), None)
        for k, v in zip(keys, key):
            out.insert(0, k, v)
        return out

    kinds = ", ".join(f"{k} {vox.schema[k].dataType.simpleString()}" for k in reversed(keys))
    return vox.groupBy(*keys).applyInPandas(run, f"{kinds}, {RESULT}")


def segment(vox: DataFrame, keys: list[str], predict: Predictor, config: Config, threshold: float) -> DataFrame:
    """The voxels of `segment_results`: place, segment_id and quantised probability."""
    rows = segment_results(vox, keys, predict, config, threshold).where("kind = 'voxel'")
    return rows.select(*keys, *AXES, "segment_id", F.col("n").alias("prob"))


def predicted(patches: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.Series]], name: str = "logit") -> DataFrame:
    """Rows with a model's output: `make` builds it once per task, then it is called with Arrow batches as pandas frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{name: model(b)})

    return patches.mapInPandas(run, StructType(list(patches.schema.fields)).add(name, "double"))


def resegment(vox: DataFrame, points: DataFrame, radius: tuple[int, int, int], predict: Predictor, config: Config, exclusion: Place = (0, 0, 0), max_retry: int = 1, recovered: float = 0.0) -> DataFrame:
    """For each decision point, grow again from the deepest voxels of each of its two segments, with both cleared; points are independent rows.

    Seeds lie outside the border and the exclusion box around the point; up to max_retry are tried until a share of the
    segment above `recovered` is recovered. Segments whose deepest voxels give no seed have size 0.
    (id_a, id_b, size_a, size_b, both, iou, recovered_a, recovered_b, depth_a, depth_b, deleted_a, deleted_b, status): depth is the greatest
    distance of the segment to its border, deleted the voxels that growth had and gave up again.
    """
    from lamina.operators import kernels

    names = ["id_a", "id_b", "size_a", "size_b", "both", "iou", "recovered_a", "recovered_b", "depth_a", "depth_b", "deleted_a", "deleted_b", "status"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, mask, low = _arrays(rows)
        labels = _placed(rows, "label", image.shape, low)
        mid = [int(rows[f"p{a}"].iloc[0]) - int(o) for a, o in zip(AXES, low)]
        a, b = int(key[0]), int(key[1])
        others = (labels > 0) & (labels != a) & (labels != b)
        masks_, shares, depths, deleted = [], [], [], []
        for own in (a, b):
            d = kernels.distance(labels == own)
            d[~np.isfinite(d)] = 0
            depths.append(float(d.max()))
            edge = np.ones(d.shape, bool)
            edge[tuple(slice(f // 2, n - f // 2) for f, n in zip(config.fov, d.shape))] = False
            d[edge] = 0
            if any(exclusion):
                d[tuple(slice(max(0, m - e), m + e + 1) for m, e in zip(mid, exclusion))] = 0
            got, share, gone = np.zeros(d.shape, bool), 0.0, 0
            for _ in range(max_retry):
                if d.max() <= 0:
                    break
                start = tuple(int(c) for c in np.unravel_index(np.argmax(d), d.shape))
                canvas = Canvas(image, predict, config, mask | others)
                canvas.segment_at(start)
                got = np.nan_to_num(canvas.logits, nan=-np.inf) >= _logit(config.segment)
                share = float((got & (labels == own)).sum() / max((labels == own).sum(), 1))
                gone = sum(n for _, n in canvas.history)
                if share > recovered:
                    break
                d[tuple(slice(max(0, c - f // 2), c + f // 2 + 1) for c, f in zip(start, config.fov))] = 0
            masks_.append(got)
            shares.append(share)
            deleted.append(gone)
        one, two = masks_
        both, any_ = int((one & two).sum()), int((one | two).sum())
        status = "missing" if not (labels == a).any() or not (labels == b).any() else "incomplete" if not one.any() or not two.any() else "ok"
        row = (a, b, int(one.sum()), int(two.sum()), both, both / any_ if any_ else float("nan"), *shares, *depths, *deleted, status)
        return pd.DataFrame([row], columns=names)

    p = points.select("id_a", "id_b", *[points[a].alias(f"p{a}") for a in AXES])
    for a, r in zip(AXES, radius):
        p = p.selectExpr("*", f"explode(sequence(p{a} - {r}, p{a} + {r})) AS {a}")
    rows = vox.join(p, list(AXES))
    return rows.groupBy("id_a", "id_b").applyInPandas(run, "id_a long, id_b long, size_a long, size_b long, both long, iou double, recovered_a double, recovered_b double, depth_a double, depth_b double, deleted_a long, deleted_b long, status string")


# ---------------------------------------------------------------- training moves


def training_moves(deltas: Place, steps: int, seed: int | None = None) -> list[Place]:
    """All lattice moves up to so many steps a side, by their city-block length; a seed shuffles those of one length."""
    out = [tuple(d * k for d, k in zip(deltas, (i, j, l))) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) for l in range(-steps, steps + 1)]
    draw = np.random.default_rng(seed).permutation(len(out)) if seed is not None else np.arange(len(out))
    return [m for _, _, m in sorted((sum(map(abs, m)), int(k), m) for m, k in zip(out, draw))]


#: (offset, wanted, made) of moves from (seed, labels, threshold, edges of a prediction's patch).
Offsets = Callable[[np.ndarray, np.ndarray, float, Place], Iterator[tuple[Place, bool, bool]]]


def _fits(shape: tuple[int, ...], off: Place, size: Place = (1, 1, 1)) -> bool:
    """Whether a patch around the centre, moved by an offset, lies inside."""
    return all(n // 2 + o - s // 2 >= 0 and n // 2 + o - s // 2 + s <= n for n, o, s in zip(shape, off, size))


def _judged(logits: np.ndarray, labels: np.ndarray, off: Place, threshold: float) -> tuple[bool, bool]:
    """(the seed reaches the threshold there, the label does); neither does outside."""
    if not _fits(logits.shape, off):
        return False, False
    at = lambda a: a[tuple(n // 2 + o for n, o in zip(a.shape, off))]
    return bool(at(logits) >= threshold), bool(at(labels) >= 1 / (1 + np.exp(-threshold)))


def no_step(logits: np.ndarray, labels: np.ndarray, threshold: float, fov: Place = (1, 1, 1)) -> Iterator[tuple[Place, bool, bool]]:
    yield (0, 0, 0), True, _fits(logits.shape, (0, 0, 0), fov)


def fixed_steps(shifts: Iterable[Place]) -> Offsets:
    """The centre and then given moves; each is made if the seed, as it then is, reaches the threshold and the patch lies inside."""

    def go(logits: np.ndarray, labels: np.ndarray, threshold: float, fov: Place = (1, 1, 1)) -> Iterator[tuple[Place, bool, bool]]:
        for off in [(0, 0, 0), *shifts]:
            valid, wanted = _judged(logits, labels, off, threshold)
            yield off, wanted, valid and _fits(logits.shape, off, fov)

    return go


def steps_of_maxima(deltas: Place, crop: Place, most: Place) -> Offsets:
    """Moves as inference makes them, first in, first out, no further than `most` from the centre; unwanted ones are not made.

    Moves whose patch would leave the example are dropped as those beyond `most` are; the centre is told in any case, not made where it does not fit.
    """

    def go(logits: np.ndarray, labels: np.ndarray, threshold: float, fov: Place = (1, 1, 1)) -> Iterator[tuple[Place, bool, bool]]:
        todo, done = deque([(0, 0, 0)]), set()
        fits = lambda off: _fits(logits.shape, off, fov) and _fits(logits.shape, off, crop)
        while todo:
            off = todo.popleft()
            cell = tuple(int((o + d / 2) // max(d, 1)) for o, d in zip(off, deltas))
            if any(abs(o) > m for o, m in zip(off, most)) or cell in done or (any(off) and not fits(off)):
                continue
            valid, wanted = _judged(logits, labels, off, threshold)
            made = valid and (wanted or cell == (0, 0, 0)) and fits(off)
            yield off, wanted, made
            if made:
                done.add(cell)
                at = tuple(slice(n // 2 + o - c // 2, n // 2 + o - c // 2 + c) for n, o, c in zip(logits.shape, off, crop))
                todo.extend(tuple(p + o for p, o in zip(m, off)) for m in moves(logits[at], deltas, threshold))

    return go


def training_steps(examples: DataFrame, keys: list[str], offsets: Offsets, predict: Predictor, config: Config) -> DataFrame:
    """Training examples of patches given as voxel rows (keys, z, y, x, value, target): one row per tried move, in order.

    (keys, step, dz, dy, dx, wanted, made, loss, deleted): made moves are predicted and written into the seed, so later moves see them;
    `loss` is the mean logistic loss of the whole seed against the targets after the move. A move is made only where the whole patch lies in
    the example, as in inference: an example thinner than the patch has the row of its centre, not made.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, _, low = _arrays(rows)
        target = np.zeros(image.shape)
        target[tuple((rows[a] - o).to_numpy() for a, o in zip(AXES, low))] = rows["target"]
        logits = np.full(image.shape, _logit(config.pad))
        logits[tuple(n // 2 for n in image.shape)] = _logit(config.init)
        out = []
        for k, (off, wanted, made) in enumerate(offsets(logits, target, _logit(config.move), config.fov)):
            gone = 0
            if made:
                at = tuple(slice(n // 2 + o - f // 2, n // 2 + o - f // 2 + f) for n, o, f in zip(image.shape, off, config.fov))
                new = predict(image[at], logits[at])
                gone = int(((logits[at] >= _logit(0.8)) & (new < 0)).sum())
                logits[at] = new
            loss = float(np.mean(np.maximum(logits, 0) - logits * target + np.log1p(np.exp(-np.abs(logits)))))
            out.append((*key, k, *off, wanted, made, loss, gone))
        return pd.DataFrame(out, columns=[*keys, "step", "dz", "dy", "dx", "wanted", "made", "loss", "deleted"])

    kinds = ", ".join(f"{k} {examples.schema[k].dataType.simpleString()}" for k in keys)
    return examples.groupBy(*keys).applyInPandas(run, f"{kinds}, step int, dz int, dy int, dx int, wanted boolean, made boolean, loss double, deleted long")
