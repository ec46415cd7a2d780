"""Target-distribution importance resampling: word runs are hashed into buckets, the gain of a bucket says how much
likelier the target is to use it than the corpus, and documents are drawn by their sum of gains plus Gumbel noise.

Two passes over the texts, both Arrow batches in numpy. The first gives one vector of bucket counts per partition
(np.bincount), which treeReduce merges; the vector has `buckets` entries, whatever the corpus. The second
broadcasts the gains and sums them per document (np.bincount with weights). Drawing ranks rows of a few numbers by
range partitions, so no task or driver gets all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, shared

#: Hash buckets; percent of the eligible documents that are drawn; words that make a document eligible; noise.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 10, 20, 2024
#: Vectors that one task merges; longer words than this have their checksum taken one by one.
FAN_IN, LONG_WORD = 64, 48


def _table() -> np.ndarray:
    """Checksum register after each byte value, by the polynomial of zlib's crc32."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0xEDB88320), r >> 1)
    return r.astype(np.uint32)


_CRC = _table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """zlib.crc32 of each span, begun with the checksums `before` (else 0): byte by byte for all spans at once."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(size <= LONG_WORD)
    order = short[np.argsort(-size[short], kind="stable")]
    left = np.cumsum(np.bincount(size[order], minlength=LONG_WORD + 1)[::-1])[::-1]  # spans of at least so many bytes
    at, reg = starts[order], ~out[order]
    for j in range(LONG_WORD):
        k = int(left[j + 1])
        if not k:
            break
        reg[:k] = _CRC[(reg[:k] ^ data[at[:k] + j]) & 255] ^ (reg[:k] >> 8)
    out[order] = ~reg
    return out


def features(texts: pa.Array | pa.ChunkedArray, max_n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices i:j of the rows: each feature's row (from 0 in the slice) and checksum, and the rows' numbers of words."""
    data, off = hashing.flat(texts)
    for i, j in hashing.slices(off):
        own, o = hashing.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = hashing.words(own, o, hashing.SEPARATORS["alnum"])
        n = np.diff(first)
        row = np.repeat(np.arange(j - i), n)
        rows, sums = [row], [crc32(own, starts, ends)]
        for k in range(1, max_n):  # runs of k + 1 words: those of k words, a space and the next word
            run = np.flatnonzero(row[k:] == row[:-k]) if len(row) > k else np.zeros(0, np.int64)
            whole = ~sums[-1][_at(rows[-1], row, run, k)]
            spaced = ~(_CRC[(whole ^ np.uint32(32)) & 255] ^ (whole >> 8))
            rows.append(row[run])
            sums.append(crc32(own, starts[run + k], ends[run + k], spaced))
        yield i, j, np.concatenate(rows), np.concatenate(sums), n


def _at(run_rows: np.ndarray, row: np.ndarray, run: np.ndarray, k: int) -> np.ndarray:
    """Where the runs of k words that begin at the words `run` stand among all runs of k words."""
    begins = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) if k > 1 else np.arange(len(row))
    assert len(begins) == len(run_rows)
    return np.searchsorted(begins, run)


def bucket_counts(texts: DataFrame, *, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (one column, null: none) by bucket, as longs: a vector per partition, merged by treeReduce."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, crc, _ in features(b.column(0), max_n):
                total += np.bincount(crc % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = texts.mapInArrow(work, "v binary").rdd.map(lambda r: np.frombuffer(r.v, np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(parts + 1, FAN_IN))))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's smoothed share in the target to that in the corpus."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [(float(t + 1) * float(s_all + k)) / (float(s + 1) * float(t_all + k)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel value) that sha256 of seed and doc_id gives (a null id reads 'null')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, *, max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, t) and target(t) to a written table of doc_id, n_words, n_features, weight and score."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs.select("t"), max_n=max_n, buckets=buckets), bucket_counts(target, max_n=max_n, buckets=buckets)).astype(float))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.zeros((3, b.num_rows), np.int64)
            for i, j, row, crc, n in features(b.column("t"), max_n):
                counts[0, i:j], counts[1, i:j] = n, np.bincount(row, minlength=j - i)
                counts[2, i:j] = np.bincount(row, gain.value[crc % buckets], j - i)  # whole numbers below 2^53: exact
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "t").mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, weight long")
    return shared.written(rows.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "_row": F.monotonically_increasing_id()}))


def resampled(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank (null unless drawn).

    Words are runs of letters and digits with A-Z in small letters, features the runs of 1 to max_n words of a text.
    Of the N rows with least_words words or more, the floor(percent * N / 100) highest scores are drawn; ties go to the
    smaller doc_id (null first), rows equal in both have ranks of their own. Null and empty texts: no features,
    weight 0, never drawn; their score is their noise. Very long texts are taken whole. An empty table of docs gives no
    rows; without target texts the gains only tell rare buckets from common ones. Columns that aren't named are not
    read, whatever their names.
    """
    rows = weights(shared.columns(docs, doc_id=doc_id, t=text), shared.columns(target, t=target_text), max_n=max_n, buckets=buckets, seed=seed)
    able = F.col("n_words") >= least_words
    total, n = rows.agg(F.count("*"), F.count(F.when(able, 1))).first()
    # A row number is the partition's number in the high bits and the place in the partition in the low ones.
    parts = max(8, -(-total // 500_000))
    ranged = rows.repartitionByRange(parts, (~able).cast("int"), F.col("score").desc(), "doc_id", "_row").sortWithinPartitions((~able).cast("int"), F.col("score").desc(), "doc_id", "_row")
    ranged = shared.written(ranged.withColumns({"_able": able, "_at": F.monotonically_increasing_id()}).drop("_row", "n_words"))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    first, before = [], 0
    for p, size in sizes:
        first.append((p, before))
        before += size
    start = docs.sparkSession.createDataFrame(first, "_p long, _first long")
    rank = F.col("_first") + place + 1
    return ranged.withColumn("_p", part).join(F.broadcast(start), "_p").select("doc_id", "n_features", "weight", "score", F.when(F.col("_able") & (rank <= n * percent // 100), rank).alias("rank"))


#: The same in DuckDB SQL, for runs of one word: the checksum is taken of each different word once.
ORACLE = """
WITH RECURSIVE steps AS (
  SELECT b, 0 AS k, b::BIGINT AS r FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT b, r FROM steps WHERE k = 8),
words AS MATERIALIZED (
  SELECT rowid AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word, TRUE AS own
  FROM (SELECT row_number() OVER () AS rowid, text FROM {docs})
  UNION ALL
  SELECT NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')), FALSE FROM {target}),
bytes AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM words),
sums AS (
  SELECT word, x, 0 AS k, 4294967295 AS r FROM bytes
  UNION ALL
  SELECT s.word, s.x, s.k + 1, xor(t.r, s.r >> 8) FROM sums s
  JOIN crc_table t ON t.b = xor(s.r & 255, ('0x' || substr(s.x, 2 * s.k + 1, 2))::BIGINT)
  WHERE s.k < length(s.x) / 2),
buckets AS MATERIALIZED (SELECT word, xor(r, 4294967295) % 10000 AS bucket FROM sums WHERE k = length(x) // 2),
counted AS (
  SELECT i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) r(i)
  LEFT JOIN (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM words JOIN buckets USING (word) GROUP BY bucket) c ON c.bucket = i),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
weighed AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE own GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS id, doc_id FROM {docs}) d LEFT JOIN weighed USING (id)),
ranked AS (
  SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN r END AS rank FROM ranked
"""
