"""Benchmark decontamination with suffix arrays of the training text.

Every slice of documents gets a word-level suffix array. Every benchmark suffix is searched in it by
bisection: the range of suffixes that begin with its window gives all occurrences. Every occurrence is then
searched in the sorted suffixes of the benchmark, where its neighbours give the longest verbatim match that
begins there. The array is sparse: a suffix whose first words no benchmark window begins with can't match and
is left out. No document leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing, shared

#: Words of a window; words of a suffix's start that the sparse array looks at.
WINDOW, HEAD = 10, 3
#: Bytes of benchmark text of a part (about ten times as many with its indexes); more text takes more parts.
PASS_BYTES = 8 << 20
_HASH, _SPAN = hashing.Hash(10), hashing.Hash(11)


class Suffixes:
    """Places of a word-id sequence in the order of the next WINDOW words. Id 0 ends documents and equals nothing."""

    def __init__(self, seq: np.ndarray, places: np.ndarray):
        self.seq = np.concatenate([seq, np.zeros(WINDOW, seq.dtype)])
        self.order = places[np.lexsort(self.seq[places[:, None] + np.arange(WINDOW)].T[::-1])]

    def bisect(self, queries: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """First rank whose suffix isn't smaller than the query (after: and doesn't begin with it)."""
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
        while (on := np.flatnonzero(lo < hi)).size:
            mid = (lo[on] + hi[on]) // 2
            own, asked = self.seq[self.order[mid][:, None] + np.arange(WINDOW)], queries[on]
            differ = (own != asked) & (np.arange(WINDOW) < length[on, None])
            stop, some, row = differ.argmax(1), differ.any(1), np.arange(len(on))
            right = np.where(some, own[row, stop] < asked[row, stop], after)
            lo[on[right]], hi[on[~right]] = mid[right] + 1, mid[~right]
        return lo


def until_zero(seq: np.ndarray) -> np.ndarray:
    """Words from each place up to the next 0 (or the end)."""
    zeros = np.append(np.flatnonzero(seq == 0), len(seq))
    return zeros[np.searchsorted(zeros, np.arange(len(seq)))] - np.arange(len(seq))


def ranks(seq: np.ndarray) -> np.ndarray:
    """The rank of the suffix at each place, by doubling; suffixes that are equal up to their next 0 may tie."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    reach, longest = 1, int(until_zero(seq).max(initial=0)) + 1
    while reach < longest and rank.max(initial=0) + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-reach] = rank[reach:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return rank


class Benchmark:
    """The words, windows and suffixes of the benchmark items of one pass. All arrays grow with its words alone,
    however long an item is; matches are compared by hashes of spans."""

    def __init__(self, items: list[tuple[int | str | None, str | None]]):
        items = sorted(items, key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1] or ""))
        self.ids = [i for i, _ in items]
        data, off = hashing.flat(pa.array([t for _, t in items], pa.string()))
        data = hashing.LOWER[data]
        starts, ends, first = hashing.words(data, off, hashing.SEPARATORS["alnum"])
        h = _HASH.words(data, starts, ends)
        self.vocabulary = np.unique(h)
        counts = np.diff(first)
        item = np.repeat(np.arange(len(counts)), counts)
        self.seq = np.zeros(len(h) + len(counts), np.int32)  # a 0 after each item
        self.seq[np.arange(len(h)) + item] = np.searchsorted(self.vocabulary, h) + 1
        place = np.arange(len(h)) - first[item]
        full = np.minimum(WINDOW, counts[item])
        begins = np.flatnonzero(counts[item] - place >= full)  # words that a window begins with
        self.item, self.place, self.at = item[begins], place[begins], begins + item[begins]
        rank = ranks(self.seq)[self.at]
        self.ranked = np.lexsort((np.arange(len(rank)), rank))  # suffixes by rank
        self.run = until_zero(self.seq)
        size = full[begins]
        keys = _SPAN.spans(hashing.mixed(self.seq.astype(np.uint64)), self.at, self.at + size)
        _, self.first, self.window = np.unique(keys, return_index=True, return_inverse=True)  # of each window its first suffix
        self.size = size[self.first]
        there = np.arange(WINDOW) < self.size[:, None]
        self.windows = np.where(there, self.seq[np.minimum(self.at[self.first][:, None] + np.arange(WINDOW), max(len(self.seq) - 1, 0))], 0) if len(begins) else np.zeros((0, WINDOW), np.int32)
        pairs = np.unique(self.window * np.int64(max(len(items), 1)) + self.item)
        self.owner, self.owner_first = pairs % max(len(items), 1), np.searchsorted(pairs // max(len(items), 1), np.arange(len(self.windows) + 1))
        self.head = int(min(HEAD, self.size.min(initial=HEAD)))
        self.heads = np.unique(self.key(self.windows[:, : self.head]))

    def longest(self, seq: np.ndarray, where: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, words, suffix, place) of the longest matches that begin at the places `where` of seq, of each
        document all that are as long; of suffixes that match as far the first."""
        mine, theirs = (_SPAN.of(hashing.mixed(s.astype(np.uint64))) for s in (seq, self.seq))
        run = until_zero(seq)
        suffixes = self.at[self.ranked]

        def common(p: np.ndarray, s: np.ndarray, most: np.ndarray) -> np.ndarray:
            """Words that place p shares with the benchmark's place s, up to `most`."""
            lo, hi = np.zeros(len(p), np.int64), np.minimum(most, self.run[s])
            while (on := np.flatnonzero(lo < hi)).size:
                mid = (lo[on] + hi[on] + 1) // 2
                same = mine(p[on], p[on] + mid) == theirs(s[on], s[on] + mid)
                lo[on[same]], hi[on[~same]] = mid[same], mid[~same] - 1
            return lo

        def bisect(p: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(p), np.int64), np.full(len(p), len(suffixes), np.int64)
            while (on := np.flatnonzero(lo < hi)).size:
                mid = (lo[on] + hi[on]) // 2
                n = common(p[on], suffixes[mid], size[on])
                stop = n < size[on]
                right = np.where(stop, self.seq[suffixes[mid] + n] < seq[np.minimum(p[on] + n, len(seq) - 1)], after)
                lo[on[right]], hi[on[~right]] = mid[right] + 1, mid[~right]
            return lo

        def beside(rank: np.ndarray) -> np.ndarray:
            ok = (rank >= 0) & (rank < len(suffixes))
            return np.where(ok, common(where, suffixes[np.clip(rank, 0, len(suffixes) - 1)], run[where]), 0)

        if not len(where):
            return doc, np.zeros(0, np.int64), np.zeros(0, np.int64), where
        rank = bisect(where, run[where], False)
        n = np.maximum(beside(rank - 1), beside(rank))
        most = np.zeros(int(doc.max()) + 1, np.int64)
        np.maximum.at(most, doc, n)
        best = n == most[doc]
        where, doc, n = where[best], doc[best], n[best]
        lo, hi = bisect(where, n, False), bisect(where, n, True)
        pair, of = np.unique(lo * (len(suffixes) + 1) + hi, return_inverse=True)
        first = np.array([self.ranked[x // (len(suffixes) + 1) : x % (len(suffixes) + 1)].min() for x in pair.tolist()], np.int64)
        return doc, n, first[of], where

    @staticmethod
    def key(ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.uint64)
        for c in ids.T:
            out = hashing.mixed(out + c.astype(np.uint64) + np.uint64(1))
        return out


def matches(texts: pa.Array, bench: Benchmark) -> Iterator[tuple[int, list[int], list[int | None], tuple | None]]:
    """Per text: its words, the indexes of its hit words, the items with occurring windows, the longest match
    as (item_id, place in the item, place in the text, words)."""
    data, off = hashing.flat(texts)
    for i, j in hashing.slices(off):
        own, o = hashing.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = hashing.words(own, o, hashing.SEPARATORS["alnum"])
        known, at = hashing.in_sorted(_HASH.words(own, starts, ends), bench.vocabulary)
        counts = np.diff(first)
        doc = np.repeat(np.arange(j - i), counts)
        seq = np.zeros(len(starts) + (j - i), np.int32)  # a 0 after each text
        seq[np.arange(len(starts)) + doc] = np.where(known, at + 1, 0)
        base = first[:-1] + np.arange(j - i)
        hits: dict[int, list[int]] = {}
        items: dict[int, set[int]] = {}
        best: dict[int, tuple] = {}
        places = np.flatnonzero(seq > 0)
        if len(places) and len(bench.windows):
            tail = np.concatenate([seq, np.zeros(HEAD, np.int32)])
            heads = bench.key(tail[places[:, None] + np.arange(bench.head)])
            keep, _ = hashing.in_sorted(heads, bench.heads)
            places, present = places[keep], np.unique(heads[keep])
            if len(places):
                array = Suffixes(seq, places)
                asked = np.flatnonzero(hashing.in_sorted(bench.key(bench.windows[:, : bench.head]), present)[0])
                q, size = bench.windows[asked], bench.size[asked]
                lo, hi = array.bisect(q, size, False), array.bisect(q, size, True)
                n = hi - lo
                where = array.order[hashing.spread(lo, n)]
                window = np.repeat(asked, n)
                d = np.searchsorted(base, where, "right") - 1
                hit = np.flatnonzero(hashing.covered(len(seq), where, bench.size[window])) if len(where) else where
                for x, p in zip(np.searchsorted(base, hit, "right") - 1, hit, strict=True):
                    hits.setdefault(int(x), []).append(int(p - base[x]))
                if len(where):
                    for x, w in np.unique(np.stack([d, window], 1), axis=0):
                        items.setdefault(int(x), set()).update(bench.owner[bench.owner_first[w] : bench.owner_first[w + 1]].tolist())
                    whole = bench.size[window] == WINDOW  # shorter ones are whole items and end there
                    long = bench.longest(seq, where[whole], d[whole])
                    short = d[~whole], bench.size[window[~whole]], bench.first[window[~whole]], where[~whole]
                    for x, n, s, p in zip(*(np.concatenate(c).tolist() for c in zip(long, short, strict=True)), strict=True):
                        found = (-n, int(bench.item[s]), int(bench.place[s]), p - int(base[x]))
                        best[x] = min(best.get(x, found), found)
        for x in range(j - i):
            b = best.get(x)
            yield int(counts[x]), hits.get(x, []), [bench.ids[k] for k in sorted(items.get(x, ()))], b and (bench.ids[b[1]], b[2], b[3], -b[0])


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with four more columns: _n_words, _hits (indexes of words inside a window's occurrence), _items
    (ids of the items whose windows occur) and _longest (the longest verbatim match that begins with a window:
    item_id, item_place, place, words; null if no window occurs; of equally long ones that of the smallest
    item_id, a null last, and the first places).

    The benchmark is carried to the tasks in parts of bounded size, which a task takes one after the other: the number of
    parts changes neither its processes nor its memory. An item of any length is searched whole, with memory in
    proportion to the part's words. Ids may be whole numbers or text (other kinds are written as text). Null and empty texts have no words; an item with no words has no
    window; an item of fewer than ten words is one window. Repeated items count once by id, an item without
    id marks words but has no id to report. An empty benchmark hits nothing, an empty table gives no rows.
    Repeated rows each have their result; very long texts are searched whole. Other columns stay; none may
    bear the name of an added one.
    """
    items = shared.columns(benchmark, i=item_id, t=item_text)
    number = isinstance(items.schema["i"].dataType, T.IntegralType)
    items = items.select(F.col("i").cast("long" if number else "string"), "t")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-total // PASS_BYTES) or 1
    kind = "long" if number else "string"
    added = T.StructType.fromDDL(f"_n_words long, _hits array<int>, _items array<{kind}>, _longest struct<item_id:{kind},item_place:int,place:int,words:int>")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    of_id = pa.int64() if number else pa.string()
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(of_id), pa.struct([("item_id", of_id), ("item_place", pa.int32()), ("place", pa.int32()), ("words", pa.int32())])]
    names, fields = [f.name for f in schema.fields], ("item_id", "item_place", "place", "words")
    parts = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k) if passes > 1 else items
        parts.append(docs.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in part.collect()])))

    def better(a: tuple | None, b: tuple | None) -> tuple | None:
        return min(filter(None, (a, b)), key=lambda x: (-x[3], x[0] is None, 0 if x[0] is None else x[0], x[1], x[2]), default=None)

    def answer(batch: pa.RecordBatch, got: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([g[c] if c < 3 or g[c] is None else dict(zip(fields, g[c], strict=True)) for g in got], kind) for c, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], names)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield answer(batch, list(matches(batch.column(text), parts[0].value)))

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's rows wait in a file without a name while one part of the benchmark after the other is searched."""
        with tempfile.TemporaryFile() as kept:
            writer, found = None, []
            for batch in batches:
                writer = writer or pa.ipc.new_stream(kept, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(batch)
                found.append({})  # by row: what has been found in it
            if not writer:
                return
            writer.close()
            words: list[list[int]] = []
            for k, part in enumerate(parts):
                bench = part.value
                kept.seek(0)
                for b, batch in enumerate(pa.ipc.open_stream(kept)):
                    got = list(matches(batch.column(text), bench))
                    if not k:
                        words.append([g[0] for g in got])
                    for row, (_, hits, ids, best) in enumerate(got):
                        if hits:
                            h0, i0, l0 = found[b].get(row, ([], [], None))
                            found[b][row] = sorted({*h0, *hits}), [*i0, *(x for x in ids if x not in i0)], better(l0, best)
                del bench
                vars(part).pop("_value", None)  # one part at a time in memory
            kept.seek(0)
            for b, batch in enumerate(pa.ipc.open_stream(kept)):
                yield answer(batch, [(n, *found[b].get(row, ([], [], None))) for row, n in enumerate(words[b])])

    return docs.mapInArrow(at_once if passes == 1 else in_turn, schema)


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The columns of the report per document, with the words, item and places (from 0) of its longest match."""
    ids = F.array_sort(F.transform(F.array_distinct(F.filter("_items", lambda x: x.isNotNull())), lambda x: x.cast("string")))
    return scanned.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.size("_hits").cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
        F.col("_longest.words").alias("longest_words"),
        F.col("_longest.item_id").alias("longest_item"),
        F.col("_longest.item_place").alias("longest_item_place"),
        F.col("_longest.place").alias("longest_place"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **names: str) -> DataFrame:
    """The documents without any hit, with their own columns, whatever their names. Null and empty texts stay, repeated
    rows stay or go together, an empty table or benchmark removes nothing."""
    plain, new = shared.renamed(docs)
    kept = scan(plain, benchmark, text=new[text], **names).where(F.size("_hits") == 0)
    return kept.select(*new.values()).toDF(*docs.columns)


#: The same report in DuckDB SQL: the longest matches are the longest runs of windows that follow each other in both.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(10, len(w)) AS n, s, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM w, sizes, unnest(range(1, len(w) - n + 2)) AS u(p)),
found AS (SELECT doc_id, item_id, n, s, p FROM starts JOIN windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, n, p FROM found), unnest(range(p, p + n)) AS u(q) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY 1),
runs AS (SELECT doc_id, item_id, n, s, p, p - row_number() OVER (PARTITION BY doc_id, item_id, n, p - s ORDER BY p) AS run FROM found),
longest AS (
  SELECT doc_id, item_id, n + count(*) - 1 AS words, min(s) - 1 AS s, min(p) - 1 AS p FROM runs GROUP BY doc_id, item_id, n, p - runs.s, run
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, item_id NULLS LAST, min(s), min(p)) = 1)
SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, words::INTEGER AS longest_words,
       item_id AS longest_item, longest.s::INTEGER AS longest_item_place, longest.p::INTEGER AS longest_place
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
