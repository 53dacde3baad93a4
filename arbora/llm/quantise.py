"""Score-aware anisotropic product quantisation with four-bit codes.

The loss of a code q for a vector x of length 1 is |r|^2 + (eta - 1) <r, x>^2 with r = x - q: the part of the error that is parallel
to x costs eta times as much, since it changes the inner products of the queries that matter most. Plain numpy; models are small
and of a size that doesn't depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LEVELS = 16


@dataclass
class Model:
    """centroids (lists, dims) of the coarse lists; codebooks (parts, 16, width) over the residuals; eta as above."""

    centroids: np.ndarray
    codebooks: np.ndarray
    eta: float

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def lists_of(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centroids.T, axis=1).astype(np.int32)


def coarse(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit vectors; a list that loses all members is set to the worst served vector."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        best, near = np.empty(len(sample), np.int64), np.empty(len(sample), np.float32)
        for at in range(0, len(sample), 8192):
            scores = sample[at : at + 8192] @ centroids.T
            best[at : at + 8192] = scores.argmax(1)
            near[at : at + 8192] = scores.max(1)
        order = np.argsort(best, kind="stable")
        starts = np.searchsorted(best[order], np.arange(lists))
        sums = np.add.reduceat(np.vstack([sample[order], np.zeros((1, sample.shape[1]), sample.dtype)]), np.minimum(starts, len(sample)), axis=0)
        empty = np.bincount(best, minlength=lists) == 0
        sums[empty] = sample[np.argsort(near, kind="stable")[: empty.sum()]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids).astype(np.float32)
    return centroids


def encode(residual: np.ndarray, unit: np.ndarray, codebooks: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """(n, parts) codes: nearest code words first, then coordinate descent on the anisotropic loss."""
    n, (parts, _, width) = len(residual), codebooks.shape
    r, x = residual.reshape(n, parts, width), unit.reshape(n, parts, width)
    codes = np.empty((n, parts), np.uint8)
    error2, along = np.empty((parts, n, LEVELS), np.float32), np.empty((parts, n, LEVELS), np.float32)
    for m in range(parts):
        gap = r[:, m, None, :] - codebooks[m][None]
        error2[m], along[m] = (gap * gap).sum(2), (gap * x[:, m, None, :]).sum(2)
        codes[:, m] = error2[m].argmin(1)
    rows = np.arange(n)
    total = sum(along[m][rows, codes[:, m]] for m in range(parts))
    for _ in range(sweeps):
        for m in range(parts):
            rest = total - along[m][rows, codes[:, m]]
            cost = error2[m] + (eta - 1) * (rest[:, None] + along[m]) ** 2
            codes[:, m] = cost.argmin(1)
            total = rest + along[m][rows, codes[:, m]]
    return codes


def train(sample: np.ndarray, lists: int, width: int = 2, threshold: float = 0.2, rounds: int = 4, seed: int = 7, bound: int = 8192) -> Model:
    """A model from unit vectors; codebooks are fitted on at most ``bound`` of them by exact least squares of the anisotropic loss."""
    dims = sample.shape[1]
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    centroids = coarse(sample, lists, seed=seed)
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(bound, len(sample)), replace=False)]
    residual = x - centroids[np.argmax(x @ centroids.T, axis=1)]
    parts = dims // width
    codebooks = np.stack([_plain(residual[:, m * width : (m + 1) * width], rng) for m in range(parts)])
    for _ in range(rounds):
        codes = encode(residual, x, codebooks, eta, 1)
        codebooks = _refit(residual, x, codes, codebooks, eta)
    return Model(centroids, codebooks.astype(np.float32), eta)


def _plain(points: np.ndarray, rng) -> np.ndarray:
    words = points[rng.choice(len(points), LEVELS, replace=len(points) < LEVELS)].astype(np.float64) + rng.normal(0, 1e-6, (LEVELS, points.shape[1]))
    for _ in range(10):
        near = ((words**2).sum(1)[None] - 2 * (points @ words.T)).argmin(1)
        counts = np.bincount(near, minlength=LEVELS)
        sums = np.stack([np.bincount(near, points[:, j], LEVELS) for j in range(points.shape[1])], 1)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words.astype(np.float32)


def _refit(residual, x, codes, codebooks, eta) -> np.ndarray:
    """Code words that minimise the loss for given codes: (diag(counts) + (eta - 1) Z'Z) w = sums + (eta - 1) Z'<residual, x>."""
    n, (parts, levels, width) = len(x), codebooks.shape
    column = (np.arange(parts)[None, :, None] * levels + codes[:, :, None]) * width + np.arange(width)[None, None]
    z = np.zeros((n, parts * levels * width), np.float32)
    np.put_along_axis(z, column.reshape(n, -1), x, axis=1)
    flat = column.reshape(-1)
    counts = np.bincount(flat, minlength=z.shape[1]).astype(np.float64)
    sums = np.bincount(flat, residual.reshape(-1).astype(np.float64), minlength=z.shape[1])
    a = (eta - 1) * (z.T @ z).astype(np.float64)
    a[np.diag_indices_from(a)] += counts + 1e-3
    b = sums + (eta - 1) * (z.T @ (residual * x).sum(1)).astype(np.float64) + 1e-3 * codebooks.reshape(-1)
    return np.linalg.solve(a, b).reshape(parts, levels, width)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def decode(packed: np.ndarray, model: Model) -> np.ndarray:
    """The residuals that packed codes stand for."""
    codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)
    return model.codebooks[np.arange(codes.shape[1])[None], codes].reshape(len(packed), model.dims)


def tables(queries: np.ndarray, model: Model) -> tuple[np.ndarray, float]:
    """(bytes, 256, queries) int16 tables of the inner products with both code words of a byte, and their scale."""
    parts, _, width = model.codebooks.shape
    single = np.einsum("qmw,mkw->mkq", queries.reshape(len(queries), parts, width), model.codebooks)
    reach = float(np.abs(single).max(1).sum(0).max()) + 1.0  # 1 for the product with the list's centroid
    scale = 32000.0 / reach
    pairs = single[0::2][:, :, None, :] + single[1::2][:, None, :, :]
    return np.rint(pairs.reshape(parts // 2, 256, len(queries)) * scale).astype(np.int16), scale


def _score(lut: np.ndarray, codes: np.ndarray, out: np.ndarray, buf: np.ndarray) -> None:
    """Adds to ``out`` (members, queries) the table scores of the members' codes."""
    for j in range(lut.shape[0]):
        np.take(lut[j], codes[:, j], axis=0, out=buf, mode="clip")
        out += buf


def bases(queries: np.ndarray, model: Model, lists, scale: float) -> np.ndarray:
    """(lists, queries): the part of a score that the list's centroid gives."""
    return np.rint(model.centroids[lists] @ queries.T * scale).astype(np.int16)


def scores(lut: np.ndarray, base: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(members, queries) table scores; base: the row of ``bases`` of each member."""
    out = base.copy()
    _score(lut, codes, out, np.empty_like(out))
    return out


def passing(queries: np.ndarray, model: Model, members: list[tuple[int, np.ndarray]], keep: int, slack: float = 0.0, step: int = 2048) -> Iterator[tuple[int, np.ndarray]]:
    """(first member, (members, queries) booleans) block by block: whose table score is at most ``slack`` below the ``keep``-th best.

    All of them, however many score alike. members: (list, packed codes) in scan order; indices run over their concatenation.
    """
    lut, scale = tables(queries, model)
    base = bases(queries, model, [c for c, _ in members], scale)
    floor = np.full(len(queries), -32768, np.int16)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, offset = 0, 0
    every = np.empty((sum(len(codes) for _, codes in members), len(queries)), np.int16)
    part = np.empty((step, len(queries)), np.int16)
    for number, (_, codes) in enumerate(members):
        for at in range(0, len(codes), step):
            block = codes[at : at + step]
            acc = every[offset + at : offset + at + len(block)]
            acc[:] = base[number]
            _score(lut, block, acc, part[: len(block)])
            first = len(block) > keep and floor.max() == -32768
            if first:
                floor = np.partition(np.ascontiguousarray(acc.T), len(block) - keep, axis=1)[:, len(block) - keep]
            # once keep members reach the floor, only better ones can raise it
            hit = np.flatnonzero(acc >= floor if first else acc > floor)
            found.append((hit % len(queries), acc.reshape(-1)[hit]))
            held += len(hit)
            if held > 6 * keep * len(queries):
                found, floor = _tighten(found, len(queries), keep)
                held = len(found[0][0])
        offset += len(codes)
    _, floor = _tighten(found, len(queries), keep)
    floor = np.maximum(floor.astype(np.int32) - int(np.ceil(slack * scale)), -32768).astype(np.int16)
    for at in range(0, len(every), step):
        yield at, every[at : at + step] >= floor


def scan(queries: np.ndarray, model: Model, members: list[tuple[int, np.ndarray]], keep: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) index pairs of ``passing``."""
    pairs = [np.nonzero(mask.T) + (at,) for at, mask in passing(queries, model, members, keep, slack)]
    return np.concatenate([q for q, _, _ in pairs]), np.concatenate([m + at for _, m, at in pairs])


def _tighten(found, queries: int, keep: int):
    """The ``keep`` best scores of each query, and its keep-th best."""
    q, s = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(q.astype(np.int64) * 65536 + (32767 - s.astype(np.int64)), kind="stable")
    q, s = q[order], s[order]
    starts = np.searchsorted(q, np.arange(queries))
    counts = np.bincount(q, minlength=queries)
    last = np.minimum(starts + keep - 1, len(q) - 1)
    floor = np.where(counts >= keep, s[last] if len(s) else 0, -32768).astype(np.int16)
    kept = np.arange(len(q)) - starts[q] < keep
    return [(q[kept], s[kept])], floor
