"""Numpy kernels for one block: distances, edges, smoothing, peaks, components."""

from __future__ import annotations

import numpy as np

#: Distance, in places, up to which `envelope` tries all places.
NEAR = 16


def envelope(f: np.ndarray, label: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place p of each line (the last axis): min over q of f[q] + (step * (p - q))^2, and the label there, of equals the smallest.

    Places up to NEAR apart are tried one distance after another, all lines at once; a line is done when no place further away could
    change it. What is left goes to `_hull`. Lines without a finite value keep infinity and get label 0.
    """
    shape, n = f.shape, f.shape[-1]
    f, label = f.reshape(-1, n), label.reshape(-1, n)
    best, out = np.full(f.shape, np.inf), np.zeros(f.shape, label.dtype)
    todo = np.flatnonzero(np.isfinite(f).any(1))
    if len(todo) and f[todo].min() >= 0:  # else a place far away may win although it is far
        place = step * np.arange(n)
        v, own = f[todo], label[todo]
        near, of = v.copy(), own.copy()
        for k in range(1, min(n, NEAR + 1)):
            if place[k] ** 2 > near.max() * (1 + 1e-9):
                break
            far = (place[k:] - place[:-k]) ** 2
            for to, come in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
                got = v[:, come] + far
                better = (got < near[:, to]) | ((got == near[:, to]) & (own[:, come] < of[:, to]))
                near[:, to], of[:, to] = np.where(better, got, near[:, to]), np.where(better, own[:, come], of[:, to])
        done = near.max(1) * (1 + 1e-9) < (step * (NEAR + 1)) ** 2 if n > NEAR + 1 else np.isfinite(near).all(1)
        best[todo[done]], out[todo[done]] = near[done], of[done]
        todo = todo[~done]
    if len(todo):
        best[todo], out[todo] = _hull(f[todo], label[todo], step)
    return best.reshape(shape), out.reshape(shape)


def _hull(f: np.ndarray, label: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for any lines (rows, n). The lower envelope of the parabolas at all q is built from the left in a time that is linear in
    the line: a new parabola ends those that it undercuts. All lines go on together.
    """
    rows, n = f.shape
    place = step * np.arange(n)
    owner, begin, top = np.zeros((rows, n), np.int32), np.full((rows, n + 1), np.inf), np.full(rows, -1)
    for q in range(n):
        line = np.flatnonzero(np.isfinite(f[:, q]))
        while len(line):
            k = top[line]
            some = k >= 0
            p = owner[line, np.maximum(k, 0)]
            meet = np.full(len(line), -np.inf)
            meet[some] = ((f[line, q] + place[q] ** 2 - f[line, p] - place[p] ** 2)[some]) / (2 * (place[q] - place[p[some]]))
            under = some & (meet < begin[line, np.maximum(k, 0)])  # meets it before it begins; at the same point both stay
            top[line[under]] -= 1
            on = line[~under]
            top[on] += 1
            owner[on, top[on]], begin[on, top[on]] = q, meet[~under]
            begin[on, top[on] + 1] = np.inf
            line = line[under]
    best, out = np.full((rows, n), np.inf), np.zeros((rows, n), label.dtype)
    known = np.flatnonzero(top >= 0)
    at = np.zeros(len(known), np.int64)
    value = lambda line, k, p: f[line, owner[line, k]] + (place[p] - place[owner[line, k]]) ** 2
    for p in range(n):
        while (go := (at < top[known]) & (begin[known, np.minimum(at + 1, n)] < place[p])).any():
            at[go] += 1
        best[known, p], out[known, p] = value(known, at, p), label[known, owner[known, at]]
        # others that begin just here are as near
        more, k = np.arange(len(known)), at + 1
        while len(more := more[(k[more] <= top[known[more]]) & (begin[known[more], np.minimum(k[more], n)] <= place[p])]):
            line = known[more]
            v, own = value(line, k[more], p), label[line, owner[line, k[more]]]
            better = (v < best[line, p]) | ((v == best[line, p]) & (own < out[line, p]))
            best[line[better], p], out[line[better], p] = v[better], own[better]
            k[more] += 1
    return best, out


def nearest(labels: np.ndarray, step: tuple[float, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance to, and label of, the nearest labelled voxel, of equals the smallest label; infinite and 0 where there is none."""
    d, near = np.where(labels > 0, 0.0, np.inf), labels
    for axis, s in enumerate(step or (1.0,) * labels.ndim):
        d, near = (np.moveaxis(x, -1, axis) for x in envelope(np.moveaxis(d, axis, -1), np.moveaxis(near, axis, -1), s))
    return np.sqrt(d), near


def distance(mask: np.ndarray, step: tuple[float, ...] | None = None) -> np.ndarray:
    """Euclidean distance of each true voxel to the nearest false one; infinite where there is none."""
    return nearest((~mask).astype(np.int8), step)[0]


def along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with odd weights along an axis; the border is mirrored with its edge voxel."""
    r = len(weights) // 2
    n = a.shape[axis]
    i = np.arange(-r, n + r) % (2 * n)
    i = np.where(i >= n, 2 * n - 1 - i, i)
    wide = np.take(a, i, axis)
    return sum(w * np.take(wide, np.arange(k, k + n), axis) for k, w in enumerate(weights))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    w = gaussian_weights(sigma)
    out = a.astype(float)
    for axis in range(a.ndim):
        out = along(out, w, axis)
    return out


def sobel(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude."""
    total = np.zeros(a.shape)
    for axis in range(a.ndim):
        g = along(a.astype(float), np.array([-1.0, 0, 1.0]), axis)
        for other in range(a.ndim):
            if other != axis:
                g = along(g, np.array([1.0, 2.0, 1.0]), other)
        total += g**2
    return np.sqrt(total)


def disk_peaks(a: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Maxima of their disk in a plane above a floor, away from the border by the radius."""
    ny, nx = a.shape
    wide = np.pad(a, radius, constant_values=-np.inf)
    top = np.full(a.shape, -np.inf)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                top = np.maximum(top, wide[radius + dy : radius + dy + ny, radius + dx : radius + dx + nx])
    inner = np.zeros(a.shape, bool)
    inner[radius : ny - radius, radius : nx - radius] = True
    return np.argwhere((a == top) & (a > least) & inner)


def running_max(a: np.ndarray, reach: int) -> np.ndarray:
    """Largest value within the reach on both sides along the last axis."""
    wide = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(reach, reach)], constant_values=-np.inf)
    return np.max([wide[..., k : k + a.shape[-1]] for k in range(2 * reach + 1)], axis=0)


def gaussian_weights(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def peaks(a: np.ndarray, min_distance: int, least: float, noise: int | None = None) -> np.ndarray:
    """A noise seed breaks ties by up to 1e-4. Local maxima above a floor, strongest first, none within the distance of a stronger one (ties: raster order); then in raster order."""
    if noise is not None:
        a = a + np.random.RandomState(noise).random_sample(a.shape) * 1e-4
    top = a.copy()
    for axis in range(a.ndim):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (min_distance, min_distance)
        wide = np.pad(top, pad, constant_values=-np.inf)
        top = np.max([np.take(wide, np.arange(k, k + a.shape[axis]), axis) for k in range(2 * min_distance + 1)], axis=0)
    at = np.argwhere((a == top) & (a > least))
    order = np.lexsort((*at.T[::-1], -a[tuple(at.T)]))
    blocked, out = np.zeros(a.shape, bool), []
    for p in at[order]:
        if not blocked[tuple(p)]:
            out.append(p)
            blocked[tuple(slice(max(0, c - min_distance), c + min_distance + 1) for c in p)] = True
    got = np.array(out, np.int64).reshape(-1, a.ndim)
    return got[np.lexsort(got.T[::-1])]


def components(labels: np.ndarray, connectivity: int = 1) -> np.ndarray:
    """Split labels into connected parts (1: faces, 2: edges, 3: corners); parts are numbered by label, then raster order. Labels spread by minima until nothing changes."""
    n = labels.size
    part = np.where(labels > 0, np.arange(n).reshape(labels.shape), n)
    offs = [o for o in np.ndindex(*(3,) * labels.ndim) if 0 < sum(abs(c - 1) for c in o) <= connectivity]
    while True:
        old = part.copy()
        for o in offs:
            a = tuple(slice(max(0, 1 - c), labels.shape[k] - max(0, c - 1)) for k, c in enumerate(o))
            b = tuple(slice(max(0, c - 1), labels.shape[k] - max(0, 1 - c)) for k, c in enumerate(o))
            same = (labels[a] == labels[b]) & (labels[a] > 0)
            part[a] = np.where(same, np.minimum(part[a], part[b]), part[a])
        # jump to the root's root
        flat = np.append(part.ravel(), n)
        part = np.where(labels > 0, flat[np.minimum(flat[part], n)], n)
        if (part == old).all():
            break
    roots = np.unique(part[labels > 0])
    order = roots[np.lexsort((roots, labels.ravel()[roots]))]
    number = np.zeros(n + 1, np.int64)
    number[order] = np.arange(1, len(order) + 1)
    return number[part]


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each is joined to) of edges: roots are hung below smaller ones that they meet, then paths are shortened."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        on = low < high
        if not on.any():
            return nodes, nodes[root]
        a, b = a[on], b[on]
        np.minimum.at(root, high[on], low[on])
        while ((up := root[root]) != root).any():
            root = up


def clahe(a: np.ndarray, tiles: int = 8, limit: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited equalisation of a slice: clipped histograms of tiles, blended bilinearly."""
    low, high = float(a.min()), float(a.max())
    if high <= low:
        return np.zeros(a.shape)
    q = np.minimum(((a - low) / (high - low) * bins).astype(int), bins - 1)
    ys, xs = (np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in a.shape)
    maps = np.empty((len(ys) - 1, len(xs) - 1, bins))
    for i in range(len(ys) - 1):
        for j in range(len(xs) - 1):
            h = np.bincount(q[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=bins).astype(float)
            most = max(1.0, limit * h.sum())
            over = np.maximum(h - most, 0).sum()
            h = np.minimum(h, most) + over / bins
            maps[i, j] = np.cumsum(h) / h.sum()
    cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2

    def place(n: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.interp(np.arange(n), c, np.arange(len(c)))
        i = np.minimum(p.astype(int), max(len(c) - 2, 0))
        return i, np.minimum(i + 1, len(c) - 1), p - i

    (y0, y1, fy), (x0, x1, fx) = place(a.shape[0], cy), place(a.shape[1], cx)
    pick = lambda i, j: maps[i[:, None], j[None, :], q]
    fy, fx = fy[:, None], fx[None, :]
    return (1 - fy) * ((1 - fx) * pick(y0, x0) + fx * pick(y0, x1)) + fy * ((1 - fx) * pick(y1, x0) + fx * pick(y1, x1))
