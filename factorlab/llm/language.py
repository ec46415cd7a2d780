"""Language identification: nearest of several clustered centroids per language, by the cosine of hashed
TF-IDF character n-grams, with rejection of texts that lie too far from every centroid."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing, shared

#: Hashed n-gram buckets, centroids per language, rows a vector batch.
BUCKETS, CENTROIDS, ROWS = 4096, 4, 256
#: Share of a language's rows that a centroid stands for at least.
LEAST_SHARE = 0.02
#: Labelled rows per language that the fit may use (about; chosen by hash, the same in each run), rows of all
#: languages together, and languages: a model of more would be too large to send to the tasks, so they are an error.
SAMPLE, TOTAL, LANGUAGES = 500, 8000, 1024
#: A text is rejected below this share of the lowest percentile (one in a hundred) of the similarities seen in training.
TOLERANCE, PERCENTILE = 0.7, 1.0
#: Bytes of the shortest cutting of a labelled text, and lengths of cuttings, each twice the one before.
CUTTING, LENGTHS = 8, 10
#: Labelled rows that a length's bound rests on at least, if there are so many; steps in which similarities are counted.
LEAST_ROWS, STEPS = 100, 4096
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[b for b in range(128) if not 97 <= b <= 122]] = 32


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return hashing.flat(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def cuttings(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each longer text its beginning, of a length that its first bytes choose."""
    starts = off[:-1][np.diff(off) > CUTTING]
    size = CUTTING << data[starts[:, None] + np.arange(CUTTING)].sum(1, dtype=np.int64) % LENGTHS
    size = np.minimum(size, np.diff(off)[np.diff(off) > CUTTING])
    return data[hashing.spread(starts, size)], np.concatenate([[0], np.cumsum(size)])


def counts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Batches of n-gram counts (rows x buckets) of lower-cased texts, with the first row of each batch."""
    for i0, j0 in hashing.slices(off):
        for i in range(i0, j0, ROWS):
            j = min(i + ROWS, j0)
            own = _SPACED[data[off[i] : off[j]]].astype(np.uint32)
            doc = np.repeat(np.arange(j - i), np.diff(off[i : j + 1])).astype(np.int64)
            out = np.zeros((j - i) * BUCKETS, np.int64)
            code, ok = np.zeros(len(own), np.uint32), np.ones(len(own), bool)
            for n in (1, 2, 3):  # grams of n bytes, without double blanks, inside one text
                if len(own) < n:
                    break
                m = len(own) - n + 1
                code = code[:m] << np.uint32(8) | own[n - 1 :]
                ok = ok[:m] & (doc[:m] == doc[n - 1 :]) & ~((own[n - 1 :] == 32) & (own[n - 2 : len(own) - 1] == 32) if n > 1 else own == 32)
                bucket = (code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(20)
                out += np.bincount(doc[:m][ok] * BUCKETS + bucket[ok], minlength=len(out))
            yield i, out.reshape(-1, BUCKETS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one a row
    owner: np.ndarray  # index into languages of each centroid
    least: np.ndarray  # by binary logarithm of the number of n-grams: similarity under which a text is rejected

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf, dtype=np.float32)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        return x

    @staticmethod
    def bins(tf: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(np.maximum(tf.sum(1), 1)).astype(int), 23)


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, the same in each run. Each start is as far from the earlier ones as the farthest tenth of the
    rows begins, and a cluster with too few rows is no centroid: mislabelled rows and junk don't get one."""
    start = [int(np.argmax(x @ x.mean(0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argsort((x @ x[start].T).max(1), kind="stable")[len(x) // 10]))
    c = x[start]
    for _ in range(12):
        near = np.argmax(x @ c.T, 1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    size = np.bincount(np.argmax(x @ c.T, 1), minlength=len(c))
    return c[size >= min(LEAST_SHARE * len(x), size.max())]


def bounds(seen: np.ndarray) -> np.ndarray:
    """The bound of each length, from the number of rows by length and similarity. A length with few rows takes
    the next longer ones in until they suffice, then the next shorter ones."""
    out = np.zeros(len(seen))
    for b in range(len(seen)):
        pool, lo, hi = seen[b].copy(), b, b + 1
        while pool.sum() < LEAST_ROWS and (lo > 0 or hi < len(seen)):
            if hi < len(seen):
                pool += seen[hi]
                hi += 1
            else:
                lo -= 1
                pool += seen[lo]
        if pool.any():
            rank = int(PERCENTILE / 100 * (pool.sum() - 1))
            out[b] = TOLERANCE * np.searchsorted(np.cumsum(pool), rank, "right") / STEPS
    return out


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from rows with a language, some letter and crc32(doc_id as text) mod 4 other than 2.

    The driver holds about TOTAL rows of 16 KB; more than LANGUAGES languages raise an error. Null or letterless texts
    teach nothing, repeated rows count again, very long texts are counted whole. Without a row to learn from (an empty table,
    say) there is no language. Only the named columns are read, whatever the names of others. Bounds rest on
    all labelled rows and on a cutting of each, so that short texts have bounds of their own.
    """
    rows = shared.columns(docs, i=doc_id, t=text, l=lang).where(F.col("l").isNotNull() & (F.crc32(F.col("i").cast("string")) % 4 != 2))
    seen = {r["l"]: r["count"] for r in rows.groupBy("l").count().limit(LANGUAGES + 1).collect()}
    if len(seen) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} languages; join rare ones or raise language.LANGUAGES")
    languages = sorted(seen)
    if not languages:
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(24))
    sample = min(sample, TOTAL // len(languages))
    share = F.coalesce(*(F.when(F.col("l") == name, F.lit(int(1e6 * min(1.0, sample / n)) + 1)) for name, n in seen.items()))
    chosen = rows.where((F.pmod(F.xxhash64("i", "t"), F.lit(1_000_000)) < share) & F.col("t").isNotNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, tf in counts(*lowered(b.column("t"))):
                yield pa.RecordBatch.from_arrays([b.column("l").slice(i, len(tf)), pa.array([r.tobytes() for r in tf.astype(np.uint32)], pa.binary())], ["l", "v"])

    got = chosen.select("t", "l").mapInArrow(work, "l string, v binary").toArrow()  # bounded: about TOTAL rows of 16 KB
    tf = np.empty((got.num_rows, BUCKETS), np.uint32)
    for i, v in enumerate(got.column("v")):
        tf[i] = np.frombuffer(v.as_buffer(), np.uint32)
    label = np.array([languages.index(x) for x in got.column("l").to_pylist()], int)
    del got
    size = tf.sum(1, dtype=np.int64)
    order = np.lexsort((*tf[:, :8].T, size, label))  # the same whatever the order of arrival
    order = order[size[order] > 0]
    tf, label = tf[order], label[order]
    if not len(tf):
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(24))
    model = Model(languages, (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32), np.zeros(0), np.zeros(0), np.zeros(24))
    x = model.vectors(tf)
    parts = [(k, clustered(x[label == k], CENTROIDS)) for k in range(len(languages)) if (label == k).any()]
    model.centroids = np.concatenate([c for _, c in parts]).astype(np.float32)
    model.owner = np.concatenate([np.full(len(c), k) for k, c in parts])
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = carried.value, np.zeros(24 * (STEPS + 1), np.int64)
        for b in batches:
            whole = lowered(b.column("t"))
            parts = (cuttings(whole[0][whole[1][i] : whole[1][j]], whole[1][i : j + 1] - whole[1][i]) for i, j in hashing.slices(whole[1]))
            for _, tf in itertools.chain(counts(*whole), itertools.chain.from_iterable(counts(*part) for part in parts)):
                tf = tf[tf.sum(1) > 0]
                cell = (np.clip((m.vectors(tf) @ m.centroids.T).max(1), 0, 1) * STEPS).astype(int)
                out += np.bincount(m.bins(tf) * (STEPS + 1) + cell, minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    # similarities of all labelled rows, not only of the sample: short texts are too few in it
    seen = np.zeros(24 * (STEPS + 1), np.int64)
    for r in rows.where(F.col("t").isNotNull() & F.col("l").isin(languages)).select("t").mapInArrow(tell, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most one a cell
        seen[r["at"]] = r["n"]
    model.least = bounds(seen.reshape(24, -1))
    return model


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with _lang (a learned language; `und` if the text is null or has no letter), _score (cosine to the
    nearest centroid, 0 to 1) and _rejected (too far from every centroid, or `und`).

    Without a learned language all are `und`. Very long texts are counted whole, slice by slice of rows. Repeated
    rows get the same answer, ties go to the language that sorts first, an empty table gives no rows. Other columns
    stay; none may bear the name of an added one.
    """
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("_lang string, _score double, _rejected boolean").fields])
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = carried.value
        for b in batches:
            texts = b.column(text)
            lettered = np.array(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
            lang, score, rejected = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
            for i, tf in counts(*lowered(texts)):
                rows = np.flatnonzero(lettered[i : i + len(tf)])
                if not len(rows) or not m.languages:
                    continue
                close = m.vectors(tf[rows]) @ m.centroids.T
                near = close.argmax(1)
                lang[i + rows] = np.array(m.languages, object)[m.owner[near]]
                score[i + rows] = np.clip(close.max(1), 0, 1)
                rejected[i + rows] = close.max(1) < m.least[m.bins(tf[rows])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema.names)

    return docs.mapInArrow(work, schema)


def digest(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row. A null doc_id is held out of the fit, but
    not marked so; null or letterless texts are `und` with score 0."""
    model = fit(docs, **names)
    rows = shared.columns(docs, doc_id=names.get("doc_id", "doc_id"), text=names.get("text", "text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(rows, model).select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def keep(docs: DataFrame, **names: str) -> DataFrame:
    """The rows that aren't rejected, with their own columns, whatever their names. Null, empty and letterless texts have
    no language and go; repeated rows stay or go together; an empty table stays empty; a table without a labelled row
    has no language to be in, so that all its rows go."""
    plain, new = shared.renamed(docs)
    found = predict(plain, fit(docs, **names), text=new[names.get("text", "text")]).where(~F.col("_rejected"))
    return found.select(*new.values()).toDF(*docs.columns)
