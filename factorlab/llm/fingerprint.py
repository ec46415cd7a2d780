"""Document fingerprints by order MinHash, in DataFrame functions only.

A text's k-mers are numbered by occurrence and hashed; a bucket of the hash range keeps its LENGTH smallest
ones, in the order they have in the text, and the hash of that tuple is one sketch of the fingerprint. Texts
agree in a sketch if they share the k-mers and their order, so the likeness falls with the edit distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Words of a k-mer, sketches of a fingerprint, k-mers of a sketch.
KMER, BUCKETS, LENGTH = 2, 32, 2
#: Packed longs: 31 bits of place (an array has no more), 27 of hash, 5 of bucket.
_PLACE, _HASH = 31, 27
#: Equal-depth ranges of ids; bytes of text in a range's part.
RANGES, PART_BYTES = 128, 64 << 20
#: Tasks that order the parts, at least, and the bytes of text for each.
TASKS, TASK_BYTES = 48, 32 << 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where a lambda refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def indexes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def sketches(text: Column) -> Column:
    """The fingerprint as an array of longs, bucket << 32 | hash; empty without words. Fewer words than a k-mer
    are one k-mer."""
    mask = (1 << _PLACE) - 1

    def kmers(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(F.slice(w, 1, F.greatest(n - KMER + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, KMER))))
        return F.when(n >= KMER, full).otherwise(F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")))

    def numbered(s: Column) -> Column:
        """s: sorted k-mer hashes over places; gives bucket, hash of k-mer and occurrence, and place."""
        starts = F.filter(indexes(F.size(s)), lambda i: (i == 0) | (F.shiftright(F.get(s, i), _PLACE) != F.shiftright(F.get(s, i - 1), _PLACE)))

        def run(b: Column, e: Column) -> Column:
            def packed(x: Column, o: Column) -> Column:
                return let(F.xxhash64(F.shiftright(x, _PLACE), o), lambda v: F.shiftleft(F.shiftrightunsigned(v, 64 - 5 - _HASH), _PLACE).bitwiseOR(x.bitwiseAND(F.lit(mask))))

            return F.when(e - b == 1, F.array(packed(F.get(s, b), F.lit(0)))).otherwise(F.transform(F.slice(s, b + 1, e - b), packed))

        return let(starts, lambda st: F.flatten(F.transform(st, lambda b, j: run(b, F.coalesce(F.get(st, j + 1), F.size(s))))))

    def bucket(x: Column) -> Column:
        return F.shiftright(x, _PLACE + _HASH)

    def tuples(t: Column) -> Column:
        firsts = F.filter(indexes(F.size(t)), lambda i: (i == 0) | (bucket(F.get(t, i)) != bucket(F.get(t, i - 1))))

        def sketch(i: Column) -> Column:
            own = F.filter(F.slice(t, i + 1, LENGTH), lambda x: bucket(x) == bucket(F.get(t, i)))
            in_order = F.array_sort(F.transform(own, lambda x: F.struct(x.bitwiseAND(F.lit(mask)).alias("p"), F.shiftright(x, _PLACE).alias("v"))))
            return F.shiftleft(bucket(F.get(t, i)), 32).bitwiseOR(F.xxhash64(F.transform(in_order, lambda x: x["v"])).bitwiseAND(F.lit(0xFFFFFFFF)))

        return F.transform(firsts, sketch)

    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(shared.WORD), F.lit(0)), lambda x: F.xxhash64(x))
    placed = let(words, lambda w: let(kmers(w), lambda k: F.sort_array(F.transform(k, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, _PLACE), _PLACE).bitwiseOR(i.cast("long"))))))
    return let(let(placed, lambda s: F.sort_array(numbered(s))), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Equal sketches over buckets that either fills; 1 for two empty fingerprints."""
    both = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1))).cast("double")


def text_of(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def with_next(rows: DataFrame, order: str, size: str, names: list[str]) -> DataFrame:
    """rows with next_<name> of the row that follows by `order` (null first, ties by the hash `_x`), after the last the first.

    Ids are cut into equal-depth ranges, and these evenly into parts; each part sorts alone, and its first
    row is copied to the part before it. No task sees more than its part, no row goes to a single task.
    """
    low, high, total, cuts = rows.agg(F.min(order), F.max(order), F.sum(size), F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 1000)).first()
    low = (0 if low is None else low) - 1
    edges = sorted({low, *(cuts or []), (low if high is None else high) + 1})
    per = max(2, -(-(total or 0) // (PART_BYTES * RANGES)))
    id0 = F.coalesce(F.col(order), F.lit(low)).cast("long")
    placed = rows.withColumn("_id0", id0)
    k = F.aggregate(F.array(*(F.lit(e).cast("long") for e in edges[1:-1])), F.lit(0), lambda n, e: n + (F.col("_id0") >= e).cast("int")) if len(edges) > 2 else F.lit(0)
    placed = placed.withColumn("_k", k)
    ends = F.array(*(F.lit(e).cast("double") for e in edges))
    start, end = F.get(ends, F.col("_k")), F.get(ends, F.col("_k") + 1)
    part = F.col("_k") * F.lit(per).cast("long") + F.least(F.floor((F.col("_id0") - start) * per / F.greatest(end - start, F.lit(1.0))), F.lit(per - 1)).cast("long")
    placed = placed.withColumn("_part", part)
    firsts = shared.written(placed.groupBy("_part").agg(F.min("_id0").alias("_first")))
    every = Window.orderBy("_part")  # a row a part, not of the corpus
    firsts = shared.written(firsts.withColumn("_before", F.coalesce(F.lag("_part").over(every), F.max("_part").over(Window.partitionBy()))))
    joined = placed.join(shared.small(firsts, RANGES * per), "_part")
    top = F.col("_before") >= F.col("_part")  # the first part's first row follows the last row
    copy = F.struct(F.col("_before").alias("p"), F.when(top, 1).otherwise(0).alias("w"), F.lit(True).alias("c"))
    own = F.struct(F.col("_part").alias("p"), F.lit(0).alias("w"), F.lit(False).alias("c"))
    sent = joined.withColumn("_to", F.explode(F.when(F.col("_id0") == F.col("_first"), F.array(own, copy)).otherwise(F.array(own))))
    sent = sent.select(*rows.columns, "_id0", F.col("_to.p").alias("_p"), F.col("_to.w").alias("_w"), F.col("_to.c").alias("_c"))
    sent = sent.repartition(max(TASKS, (total or 0) // TASK_BYTES), "_p")  # by measured bytes, not by the session's setting
    ordered = Window.partitionBy("_p").orderBy("_w", "_id0", "_x")
    return sent.withColumns({f"next_{n}": F.lead(n).over(ordered) for n in names}).where(~F.col("_c")).select(*rows.columns, *(f"next_{n}" for n in names))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (code points, rounded down) replaced by the first as many of the
    next document's, by ascending doc_id, null first, equal ids by a hash of the text; the first follows the
    last, and a single document follows itself. Null texts count as empty; a text of any length is taken whole.
    doc_id is a column of integers. Repeated rows follow each other and have equal fingerprints; an empty table
    gives no rows. Other columns, whatever their names, are not read.
    """
    rows = shared.columns(docs, doc_id=doc_id, t=text).withColumn("t", F.coalesce("t", F.lit("")))
    rows = rows.withColumns({"_x": F.xxhash64("t"), "_n": F.octet_length("t")})
    # the id's ranges need no fingerprints, and each is computed once, before the rows move
    near = with_next(rows.withColumn("s", sketches(F.col("t"))), "doc_id", "_n", ["t", "s"])
    n = F.char_length("t")
    quarter = F.floor(n / 4).cast("int")
    near = near.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("t", F.lit(1), n - quarter), F.substring("next_t", F.lit(1), quarter))})
    near = near.withColumns({"edited_sha256": F.sha2("edited", 256), "e": sketches(F.col("edited"))})
    return near.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("s")).alias("fingerprint"), text_of(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"))
