"""Quality classifier: random Fourier features approximate a Gaussian kernel over document statistics;
normal equations summed by partition and fold fit ridge scores; isotonic calibration makes probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared

#: Fourier features, folds of the fit, bins of the calibration, ridge strengths tried.
FEATURES, FOLDS, BINS, RIDGES = 192, 5, 512, (1e-4, 1e-3, 1e-2, 1e-1)
#: A document is called good from this score.
THRESHOLD = 0.7
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b".", b",;:", b"!?", b"|", b"#$%&*@^~", b"\"'()[]{}<>", b"/\\_=+-`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_HASH = hashing.Hash(7)
#: Document statistics: shares of the byte classes, then those of words and lines.
NAMES = [f"x{k:02d}" for k in range(len(_CLASSES) + 1 + 13)]


def distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the number of different values, and of the most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    size, top = np.diff(np.append(at, len(v))), np.zeros(n)
    np.maximum.at(top, d[at], size)
    return np.bincount(d[at], minlength=n).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics per text; null and empty texts give zeros."""
    data, off = hashing.flat(texts)
    out = np.zeros((len(off) - 1, len(NAMES)), np.float64)
    for i, j in hashing.slices(off):
        own, o, n = data[off[i] : off[j]], off[i : j + 1] - off[i], j - i
        size = np.diff(o)
        doc = np.repeat(np.arange(n), size)
        k = len(_CLASSES) + 1
        out[i:j, :k] = np.bincount(doc * k + _CLASS[own], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
        starts, ends, first = hashing.words(own, o, hashing.SEPARATORS["blank"])
        lines, line_ends, line_first = hashing.words(own, o, _NEWLINE)
        nw, nl = np.diff(first), np.diff(line_first)
        w, m = np.maximum(nw, 1), np.maximum(nl, 1)
        wd, ld = np.repeat(np.arange(n), nw), np.repeat(np.arange(n), nl)
        length = (ends - starts).astype(float)
        mean = np.bincount(wd, length, n) / w
        h = _HASH.words(own, starts, ends)
        kinds, top = distinct(wd, h, n)
        pair = np.flatnonzero(wd[1:] == wd[:-1])
        pairs, _ = distinct(wd[pair], hashing.mixed(h[pair] * np.uint64(3) + h[pair + 1]), n)
        line_kinds, line_top = distinct(ld, _HASH.words(own, lines, line_ends), n)
        longest = np.zeros(n)
        np.maximum.at(longest, wd, length)
        last, initial = _CLASS[own[ends - 1]] if len(ends) else wd, _CLASS[own[starts]] if len(starts) else wd
        odd = (last >= 5) & (last < len(_CLASSES))
        out[i:j, k:] = np.stack([np.log1p(size), np.log1p(nw), np.log1p(nl), mean, np.sqrt(np.maximum(np.bincount(wd, length**2, n) / w - mean**2, 0)), np.log1p(longest), kinds / w, top / w, pairs / w, line_kinds / m, line_top / m, np.bincount(wd, odd, n) / w, np.bincount(wd, initial == 0, n) / w], 1)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray | None = None  # per fold, without that fold; the last from all
    steps: tuple[np.ndarray, np.ndarray] | None = None  # raw score to probability

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Features whose products approximate exp(-|u - v|^2 / (2 d)) of the standardised statistics; and a constant."""
        random = np.random.default_rng(77)
        d = x.shape[1]
        freq, phase = random.standard_normal((d, FEATURES)) / np.sqrt(d), random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ freq + phase), np.ones((len(x), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), 0.5)
        return np.interp(self.fourier(x) @ self.w[-1], *self.steps)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over ordered bins, as points to interpolate between."""
    blocks: list[list[float]] = []
    for a, g, m in zip(x, good + 0.5, n + 1.0, strict=True):
        blocks.append([a * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of each row, as a written table: texts are read once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("t"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, x.T)], ["doc_id", *NAMES])

    rows = shared.columns(docs, doc_id=doc_id, t=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return shared.written(rows.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in NAMES)))


def fit(rows: DataFrame, labels: DataFrame, *, label: str = "quality") -> Model:
    """rows: features(). Learns from labelled rows with crc32(doc_id as text) mod 4 other than 2; null labels and
    null doc_ids are left out, several labels of a document count as their mean. Without labels scores are 0.5.
    """
    known = shared.columns(labels, doc_id="doc_id", y=label).where(F.col("y").isNotNull()).groupBy("doc_id").agg(F.avg("y").alias("y"))
    crc = F.crc32(F.col("doc_id").cast("string"))
    train = rows.where(crc % 4 != 2).join(known, "doc_id").withColumn("fold", (F.floor(crc / 4) % FOLDS).cast("int"))
    train = shared.written(train.select("fold", "y", *NAMES))
    got = rows.agg(*(F.avg(n).alias(f"m{n}") for n in NAMES), *(F.stddev_pop(n).alias(f"s{n}") for n in NAMES)).first()
    model = Model(np.array([got[f"m{n}"] or 0.0 for n in NAMES]), np.array([got[f"s{n}"] or 0.0 for n in NAMES]) + 1e-3)
    carried = model

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return carried.fourier(np.stack([b.column(n).to_numpy() for n in NAMES], 1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 3))
        for b in batches:
            z, y, fold = matrix(b), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for f in range(FOLDS):
                a, t = z[fold == f], y[fold == f]
                sums[f] += np.concatenate([a.T @ a, (a.T @ t)[:, None], np.full((FEATURES + 1, 1), (t * t).sum())], 1)
        i = np.arange(FOLDS * (FEATURES + 1))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array([r.tobytes() for r in sums.reshape(len(i), -1)], pa.binary())], ["i", "v"])

    def total(t: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, np.float64) for x in t.column("v").to_pylist())
        return pa.table({"i": t.column("i")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    parts = train.mapInArrow(partial, "i int, v binary").groupBy("i").applyInArrow(total, "i int, v binary").collect()  # FOLDS * (FEATURES + 1) rows
    if not parts:
        return model
    s = np.stack([np.frombuffer(r["v"], np.float64) for r in sorted(parts, key=lambda r: r["i"])]).reshape(FOLDS, FEATURES + 1, FEATURES + 3)
    if not (n := s[:, -1, FEATURES].sum()):
        return model
    rest = np.concatenate([s.sum(0) - s, s.sum(0)[None]])

    def solved(k: int, ridge: float) -> np.ndarray:
        a, b = rest[k][:, : FEATURES + 1], rest[k][:, FEATURES + 1]
        return np.linalg.solve(a + ridge * max(a[-1, -1], 1) * np.diag([1.0] * FEATURES + [1e-6]), b)

    def loss(ridge: float) -> float:
        return sum(s[k][0, -1] - 2 * w @ s[k][:, FEATURES + 1] + w @ s[k][:, : FEATURES + 1] @ w for k in range(FOLDS) for w in [solved(k, ridge)])

    ridge = min(RIDGES, key=loss)
    model.w = np.stack([solved(k, ridge) for k in range(FOLDS + 1)])
    w = model.w

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # scores of the fold's own model, which has not seen the row
            raw = (matrix(b) * w[b.column("fold").to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), b.column("y")], ["bin", "y"])

    bins = train.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("g"), F.count("*").alias("n")).orderBy("bin").collect()
    model.steps = isotonic(np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in bins]), np.array([r["g"] for r in bins], float), np.array([r["n"] for r in bins], float))
    return model


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row of docs.

    labels has doc_id and the label; null ids and labels, and labels without a document, teach nothing; of
    several labels of a document each counts. Null and empty texts have statistics of 0 and the score that goes
    with them. Repeated rows have a row and an equal score each; ties keep equal scores. Very long texts are read
    whole. Without a label to learn from, or with one kind of label only, scores are constant. An empty table
    gives no rows. Columns that aren't named are not read, whatever their names.
    """
    rows = features(docs, doc_id=doc_id, text=text)
    carried = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, label=label))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = carried.value.score(np.stack([b.column(n).to_numpy() for n in NAMES], 1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(p, 0, 1))], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
