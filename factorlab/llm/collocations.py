"""Phrase collocations by language: all runs of 1 to max_n words become rows, a hash aggregate counts them,
candidates are joined with the counts of their parts, scored in exact decimals, dropped if a one-word extension
keeps half of their occurrences, and ranked by a window.

Runs of one length after another: a run can only be frequent if the two runs of one word less inside it are. These
are marked in a bitmap, and runs without both marks are left out before the shuffle: no frequent one ever, and an
infrequent one that is let through by chance is dropped by its count. The rows are made in Arrow batches, where equal
runs of a slice of text are one row with their number, so a phrase or a language that fills the corpus sends a row a
slice. Only phrases that occur often enough are joined: a part or an extension that matters occurs as often itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing, shared

#: Words of a phrase; occurrences that make a candidate; percent of a phrase's occurrences that an extension must
#: keep to replace it; phrases a language; scale of the score.
MAX_N, LEAST, KEPT, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Language of rows without one.
NONE = "und"
#: Bytes of text whose equal runs are one row.
SLICE = 1 << 22
#: Groups that a language is ranked in first, and next: each passes on its best, so no task ranks a whole language.
SALTS = (1024, 32)
#: Bytes that end a piece, and those that part words.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
PARTS = ENDS.copy()
PARTS[list(b" \t")] = True
#: Bits of the bitmap of frequent phrases, at least and at most (128 MB): beyond it more runs are let through.
BITMAP_BITS = (1 << 23, 1 << 30)
_HASH = hashing.Hash(11)


def dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids numbered anew from 0 without gaps, and where each new number first occurs."""
    new = pc.dictionary_encode(pa.array(ids)).indices.to_numpy() if len(ids) else np.zeros(0, np.int32)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(new), prepend=-1)) if len(new) else np.zeros(0, np.int64)  # numbers are given in order
    return new.astype(np.int64), first


def marks(rows: np.ndarray, words: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words at `begins`, from those of their languages and words."""
    h = rows
    for j in range(k):
        h = hashing.mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[begins + j])
    return h


def counted(data: np.ndarray, off: np.ndarray, lang: np.ndarray, k: int, marked: np.ndarray | None, tongue: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The different runs of k words in texts one after another: a row in the language of each, the runs, their numbers.
    With a bitmap only runs whose two runs of k - 1 words are marked. lang: language by row; tongue: hash by row."""
    data = hashing.LOWER[data]
    starts, ends, first = hashing.words(data, off, PARTS)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    begins = np.arange(len(starts) - k + 1)
    if k > 1:
        piece = np.cumsum(ENDS[data])[starts]
        begins = np.flatnonzero((row[k - 1 :] == row[: 1 - k]) & (piece[k - 1 :] == piece[: 1 - k])) if len(starts) >= k else begins[:0]
        if marked is not None and len(begins):
            spelt = _HASH.words(data, starts, ends)
            at = begins
            for shift in (0, 1):
                h = marks(tongue[row[at]], spelt, at + shift, k - 1) & np.uint64(len(marked) * 64 - 1)
                at = at[(marked[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)) == 1]
            begins = at
    if not len(begins):
        return begins[:0], pa.array([], pa.large_binary()), begins[:0]
    used = np.unique(hashing.spread(begins, np.full(len(begins), k)))  # only the words of such runs are spelt
    place = np.searchsorted(used, begins)
    lengths = (ends - starts)[used]
    kept = np.concatenate(([0], np.cumsum(lengths)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(used), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[hashing.spread(starts[used], lengths)])]).dictionary_encode()
    word = words.indices.to_numpy().astype(np.int64)
    ids, where = dense(lang[row[used]] * len(words.dictionary) + word)
    size, last = len(where), ids[place]
    for j in range(1, k):  # numbered by the run so far and the next word
        last, _ = dense(last)
        last = last * size + ids[place + j]
    last, where = dense(last)
    run = words.dictionary.take(pa.array(word[place[where]]))
    for j in range(1, k):
        run = pc.binary_join_element_wise(run, words.dictionary.take(pa.array(word[place[where] + j])), pa.scalar(b" ", pa.large_binary()))
    return row[begins[where]], run, np.bincount(last, minlength=len(where))


def tongues(names: pa.Array) -> np.ndarray:
    """A hash of each language."""
    data, off = hashing.flat(names)
    return _HASH.words(data, off[:-1], off[1:])


def phrases(docs: DataFrame, k: int, marked: np.ndarray | None = None) -> DataFrame:
    """docs(t, lang) to rows of lang, phrase (k words) and a: occurrences, those of a slice of text in one row."""
    bitmap = docs.sparkSession.sparkContext.broadcast(marked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = hashing.flat(b.column("t"))
            names = b.column("lang").dictionary_encode()
            lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            tongue = tongues(names.dictionary)[lang]
            for i, j in hashing.slices(off, SLICE):
                row, run, n = counted(data[off[i] : off[j]], off[i : j + 1] - off[i], lang[i:j], k, bitmap.value, tongue[i:j])
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(lang[i:j][row])), run.cast(pa.large_string()).cast(pa.string()), pa.array(n)], ["lang", "phrase", "a"])

    return docs.select("t", F.coalesce("lang", F.lit(NONE)).alias("lang")).mapInArrow(work, "lang string, phrase string, a long")


def bitmap_of(frequent: DataFrame, k: int) -> np.ndarray:
    """Marks of the phrases of k words: 16 bits a phrase, within BITMAP_BITS."""
    bits = BITMAP_BITS[0]
    while bits < min(BITMAP_BITS[1], 16 * frequent.count()):
        bits *= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = hashing.flat(b.column("phrase"))
            starts, ends, first = hashing.words(data, off, PARTS)
            h = marks(tongues(b.column("lang")), _HASH.words(data, starts, ends), first[:-1], k) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    cells = frequent.select("lang", "phrase").mapInArrow(work, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.view(np.uint64)


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language by score, occurrences and phrase, with their rank: ranked in many
    groups of a language by a hash of the phrase, then in fewer, then whole."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS[0])))
    for salts in SALTS:
        w = Window.partitionBy("lang", F.pmod("_salt", F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_salt")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, kept: int = KEPT, top: int = TOP) -> DataFrame:
    """Per language its `top` phrases: lang, rank, phrase, a (occurrences), l and r (those of its two parts), n (words
    of the language), score = floor(1000000 a a / (l r)) of the lowest-scoring cut, the first such.

    Pieces end at . , ; : ! ? and line ends, words at blanks and tabs; A-Z is lowered, nothing else; overlapping
    occurrences count. Null and empty texts have no phrases, a null language is 'und'. Repeated rows count each
    time. Very long texts and pieces are taken whole. Ties of score and occurrences go by the
    phrase's UTF-8 bytes. Without frequent phrases, as in an empty table, no rows. Columns that aren't
    named are not read, whatever their names. Exact up to 10^16 occurrences of a phrase.
    """
    rows, marked, counts = shared.columns(docs, t=text, lang=lang), None, []
    for k in range(1, max_n + 1):
        # slices have been summed; most of what is left differs, so a second sum before the shuffle would only cost
        n_of = phrases(rows, k, marked).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        counts.append(shared.written(n_of if k == 1 else n_of.where(F.col("a") >= least)))  # all words, for the languages' sizes
        if k < max_n:
            marked = bitmap_of(counts[-1].where(F.col("a") >= least), k)
    sizes = counts[0].groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = counts[0].where(F.col("a") >= least).withColumn("k", F.lit(1))
    for k, own in enumerate(counts[1:], 2):
        frequent = frequent.union(own.withColumn("k", F.lit(k)))
    candidates = frequent.where(F.col("k") > 1)

    words = F.split("phrase", " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(words, F.lit(1), i), " ").alias("left"), F.array_join(F.slice(words, i + 1, F.col("k") - i), " ").alias("right")))).alias("x")
    cuts = candidates.select("lang", "phrase", "a", cut).select("lang", "phrase", "a", "x.*")
    for side, name in (("left", "l"), ("right", "r")):
        part = frequent.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = cuts.join(part, ["lang", side])
    # `div` of decimals gives the whole quotient; a plain division would be rounded
    score = F.expr(f"CAST({SCALE} * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "i", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.score", "x.a", "x.l", "x.r")

    # a phrase inside a longer candidate is inside one with one more word that occurs as often as the longer one
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase")
    longer = candidates.where(F.col("k") > 2).select("lang", F.col("a").alias("more"), inner).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept_on = scored.alias("s").join(longer.alias("x"), (F.col("s.lang") == F.col("x.lang")) & (F.col("s.phrase") == F.col("x.phrase")) & (100 * F.col("x.more") >= kept * F.col("s.a")), "left_anti")
    ranked = best(kept_on, top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB SQL.
ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {docs}),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3]) AS k)),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL),
candidates AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, i, array_to_string(w[1 : i], ' ') AS lhs, array_to_string(w[i + 1 :], ' ') AS rhs
  FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates) c),
scored AS (
  SELECT c.*, p.a AS l, q.a AS r, ((1000000 * c.a::HUGEINT * c.a::HUGEINT) // (p.a::HUGEINT * q.a::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN counts p ON p.lang = c.lang AND p.phrase = c.lhs JOIN counts q ON q.lang = c.lang AND q.phrase = c.rhs),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_ AS (
  SELECT lang, a, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 :], ' ')]) AS phrase FROM candidates WHERE k > 2),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = s.lang AND x.phrase = s.phrase AND 100 * x.a >= 50 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
