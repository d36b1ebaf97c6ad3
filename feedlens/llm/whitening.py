"""op12: whitening of embeddings by shifted CholeskyQR.

Entries become exact integers, columns are centred with exact sums, and the centred rows
are orthogonalised in passes: every pass solves the rows against the factors found so far,
sums their Gram matrix over all tasks and appends its Cholesky factor; the first factor is
shifted, so an ill-conditioned matrix has one.  When the rows are orthonormal, the singular
vectors of the composed factor R are the components and its singular values their scale.
Only Gram matrices (entries of d x d) reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import pick, prepare

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LIMIT = 2.0 ** 62
PASSES, CLOSE = 12, 1e-6       # a Gram matrix this close to the identity has an exact factor: no further pass
HELD = 1 << 23              # matrix entries of other lengths that a task keeps before it hands them on
_CELLS = "dim int, cell long, v double"


@dataclass
class Model:
    """Whitening of the vectors of one length."""
    dim: int
    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    live: np.ndarray | None = None          # columns that vary
    trace: float = 0.0
    axes: np.ndarray | None = None          # components x dim
    scale: np.ndarray | None = None         # square roots of the eigenvalues
    explained: np.ndarray | None = None
    mean: np.ndarray | None = None          # of the whitened rows
    identity_error: float = 0.0


def integers(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) per vector length; rows with a null vector, a null or non-finite
    entry or one beyond 2**62 / 1024 are left out, empty vectors as well."""
    col = batch.column(at).cast(pa.list_(pa.float64()))
    size = np.diff(col.offsets.to_numpy())
    flat = np.asarray(col.values.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
    start = col.offsets.to_numpy()[:-1]
    valid = ~np.asarray(col.is_null())
    for d in np.unique(size[valid & (size > 0)]):
        rows = np.flatnonzero(valid & (size == d))
        v = flat[start[rows][:, None] + np.arange(d)] * SCALE
        ok = (np.abs(v) < LIMIT).all(axis=1)            # false for nan
        if ok.any():
            yield rows[ok], np.floor(v[ok]).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, m: Model) -> np.ndarray:
    """n*x - S, exact: int64 where it fits, Python integers beyond."""
    wide = m.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, m.sums))
    kind = np.int64 if wide < LIMIT else object
    return x.astype(kind) * m.n - np.array(m.sums, kind)


def _orthogonal(x: np.ndarray, m: Model) -> np.ndarray:
    """Centred rows, solved against the triangular factors found so far."""
    q = deviations(x, m).astype(np.float64) / m.n
    for r in m.factors:
        out = np.zeros_like(q)
        for j in range(m.dim):
            out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        q = out
    return q


def _whitened(x: np.ndarray, m: Model) -> np.ndarray:
    centred = deviations(x, m).astype(np.float64) / m.n
    safe = np.where(m.scale > 0, m.scale, np.inf)
    return centred @ m.axes.T / safe


def _sums(vectors: DataFrame, part: Callable[[np.ndarray, Model | None], np.ndarray], models: dict[int, Model]) -> dict[int, np.ndarray]:
    """Per vector length the sum over all tasks of ``part`` (a flat array per batch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for d, s in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), d, np.int32)), pa.array(np.arange(len(s))), pa.array(s)], names=["dim", "cell", "v"])
            held.clear()

        for batch in batches:
            for _, x in integers(batch, 0):
                d = x.shape[1]
                if models and d not in models:
                    continue
                s = part(x, models.get(d))
                held[d] = held[d] + s if d in held else s
                if sum(map(len, held.values())) > HELD and len(held) > 1:
                    yield from out()
        yield from out()

    cells = vectors.mapInArrow(run, _CELLS).groupBy("dim", "cell").agg(F.sum("v").alias("v"))
    got: dict[int, list] = {}
    for r in cells.collect():
        got.setdefault(r.dim, []).append((r.cell, r.v))
    return {d: np.array([v for _, v in sorted(c)]) for d, c in got.items()}


def _count(x: np.ndarray, _) -> np.ndarray:
    # sums in three parts of 21 bits, each exact as a double up to 2**32 rows of a length
    low, mid, high = x & 0x1FFFFF, (x >> 21) & 0x1FFFFF, x >> 42
    return np.concatenate([[len(x)], low.sum(0), mid.sum(0), high.sum(0)]).astype(np.float64)


def _gram(x: np.ndarray, m: Model) -> np.ndarray:
    q = _orthogonal(x, m)
    return (q.T @ q)[np.triu_indices(m.dim)]


def _square(cells: np.ndarray, d: int) -> np.ndarray:
    g = np.zeros((d, d))
    g[np.triu_indices(d)] = cells
    return g + np.triu(g, 1).T


def _factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor of a Gram matrix; shifted by 11 (n d + d (d + 1)) u |G| where asked for or where
    there is none without (n up to 2**20: sums run over batches and tasks, so rounding grows no further)."""
    d = len(g)
    eps = np.finfo(np.float64).eps / 2
    norm = float(np.linalg.eigvalsh(g)[-1])
    s = 11.0 * (min(n, 1 << 20) * d + d * (d + 1)) * eps * norm if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            s = max(10 * s, 11.0 * d * (d + 1) * eps * norm, 1e-300)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models by vector length of a table with the single column embedding."""
    models: dict[int, Model] = {}
    for d, c in _sums(vectors, _count, {}).items():
        low, mid, high = (c[1 + i * d:1 + (i + 1) * d] for i in range(3))
        models[d] = Model(d, int(c[0]), [int(a) + (int(b) << 21) + (int(e) << 42) for a, b, e in zip(low, mid, high)])
    todo = dict(models)
    for step in range(PASSES):
        if not todo:
            break
        grams = _sums(vectors, _gram, todo)
        for d, cells in grams.items():
            m, g = todo[d], _square(cells, d)
            if step == 0:
                m.trace = float(np.trace(g))
                if m.trace == 0:
                    del todo[d]
                    continue
            m.live = np.diag(g) > 0                 # a column without variance stays zero
            if step and np.abs(g - np.diag(m.live.astype(float))).max() <= CLOSE:
                del todo[d]
            m.factors.append(_factor(g, m.n, shifted=step == 0))
    for m in models.values():
        _components(m, components)
    live = {d: m for d, m in models.items() if (m.scale > 0).any()}
    if live:
        for d, s in _sums(vectors, lambda x, m: _whitened(x, m).sum(0), live).items():
            live[d].mean = s / live[d].n
        for d, c in _sums(vectors, _spread, live).items():
            m = live[d]
            k = m.scale > 0
            cov = c.reshape(len(k), len(k)) / m.n
            m.identity_error = float(np.abs(cov[k][:, k] - np.eye(int(k.sum()))).max())
    return models


def _spread(x: np.ndarray, m: Model) -> np.ndarray:
    w = _whitened(x, m) - m.mean
    return (w.T @ w).ravel()


def _components(m: Model, components: int) -> None:
    """Right singular vectors of the composed factor, each with its largest entry positive; an eigenvalue
    below the rounding of the largest counts as zero."""
    k = min(components, m.dim)
    r = np.eye(m.dim) if m.factors else np.zeros((m.dim, m.dim))
    for f in m.factors:
        r = f @ r
    if m.live is not None:
        r = r * m.live[:, None]
    _, s, w = np.linalg.svd(r)
    w = w[:k] * np.sign(w[np.arange(k), np.abs(w[:k]).argmax(1)])[:, None]
    s = np.where(s > s[0] * m.dim * np.finfo(np.float64).eps, s, 0.0)[:k]
    m.axes, m.scale = w, s / np.sqrt(m.n)
    m.explained = s ** 2 / m.trace if m.trace else np.zeros(k)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold a null, non-finite or unrepresentable (2**62 / 1024) entry are
    dropped; vectors of another length are whitened among themselves (n counts their length); repeated rows
    and ids count each; a component without variance has whitened null and explained 0; deviation is null
    where it exceeds a long; an empty table gives an empty result; extra columns are ignored."""
    prepare(embeddings.sparkSession)
    e = pick(embeddings, vec_id="long", embedding="array<double>")
    models = fit(e.select("embedding"), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, x in integers(batch, 1):
                m = models[x.shape[1]]
                k = len(m.scale)
                dev = deviations(x, m)
                exact = dev.astype(object) if dev.dtype == object or float(np.abs(dev).max()) ** 2 * m.dim >= LIMIT else dev
                square = (exact * exact).sum(1)
                square = pa.array([int(v) if v < 1 << 63 else None for v in square.tolist()], pa.int64())
                w = _whitened(x, m)
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(flat), m.n)), square.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(flat, mask=np.tile(m.scale == 0, len(rows))), pa.array(np.tile(m.explained, len(rows))),
                    pa.array(np.full(len(flat), m.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return e.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                        "identity_error double")
