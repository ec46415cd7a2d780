"""N-gram Jaccard join with vertical partitioning.

The n-grams of all texts have one global order, rarest first. It is cut into fragments that hold equally many
n-grams, and a set is cut with it. Candidate pairs are dealt in tiles, and a tile is dealt by fragment: tasks that
see one fragment of the sets count its overlaps, and the counts are then summed per pair of the tile. Only pairs
that share an n-gram of their prefixes can link.

Texts with equal sets are one vertex. Vertices are compared with the most central vertex of each prefix
n-gram first; those that stay outside the largest component of an n-gram are then compared, tile by tile, with
its members and with each other. Tiles give links that connect what all their links connect: a group of thousands
of near copies becomes one component without the list of its pairs.

How many rows each row links with is counted afterwards: all links lie inside components, so every pair of
vertices of a component is compared once, in pairs of tiles, and tiles give sums per vertex.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, hashing, shared
from .components import components

#: Words of an n-gram, and the least similarity in hundredths.
NGRAM, PERCENT = 5, 80
#: Fragments of the global order; vertices on a side of a tile; vertices of tiles that a task compares, about.
FRAGMENTS, TILE, TASK = 4, 500, 250
#: N-grams that up to so many sets have are ordered by that number, more common ones by so many steps an octave.
EXACT, STEPS = 16, 8
#: An n-gram that this share of a tile's pairs has (one of so many) is counted by a product of matrices; columns
#: of the matrices, and pairs that are listed at once.
DENSE, COLUMNS, PAIRS = 50, 4096, 1 << 20
_WORD, _GRAM, _SET = hashing.Hash(4), hashing.Hash(41), hashing.Hash(42)


def grams(texts: pa.ChunkedArray | pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of all texts in sequence, each text's sorted, and where each text's begin. A text of
    fewer words, but not none, has its whole sequence as one."""
    data, off = hashing.flat(texts)
    out, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in hashing.slices(off):
        own, o = hashing.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = hashing.words(own, o, hashing.SEPARATORS["blank"])
        k = np.diff(first)
        m = np.where(k > 0, np.maximum(k - n + 1, 1), 0)
        at = hashing.spread(first[:-1], m)
        doc = np.repeat(np.arange(j - i), m)
        h = _GRAM.spans(_WORD.words(own, starts, ends), at, at + np.minimum(n, k)[doc])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        out.append(h[new])
        counts.append(np.bincount(doc[new], minlength=j - i))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A signed 64-bit number per set."""
    x = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(hashing.mixed(h ^ np.uint64(_SET.base)), out=x[1:])
    n = np.diff(first).astype(np.uint64)
    return hashing.mixed(x[first[1:]] - x[first[:-1]] + n * np.uint64(_SET.table[0])).view(np.int64)


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n with any it links with."""
    return -(-percent * n // 100)


def sampled_share(percent: int) -> float:
    """Share of the hash range whose n-grams are compared over the whole corpus: twice what a set may lack of one
    it links with, so about half of them must be shared. Sets with fewer of them than they may lack all stay."""
    return min(1.0, 2 * (100 - percent) / 100)


def candidates(rows: DataFrame, buckets: int, homes: DataFrame, n: int, percent: int) -> DataFrame:
    """(v, n, s): the vertices whose n-grams of the lowest hashes are shared as often as a link asks for, with
    their sets. A vertex is taken from its home, the block that `homes` names."""

    def own(t: pa.Table, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, first = grams(t.column("t"), n)
        v = signatures(h, first)
        size = np.diff(first)
        one = np.zeros(len(v), bool)
        one[np.unique(v, return_index=True)[1]] = True
        rows = np.flatnonzero(one & np.isin(v, home) & (size > 0))
        return h, first, v, rows

    def sampled(h: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(first)[rows]
        own = h[hashing.spread(first[rows], size)]
        low = own <= np.uint64(min(int(sampled_share(percent) * 2**64), 2**64 - 1))
        return own[low], np.repeat(np.arange(len(rows)), size)[low]

    def inbox(other: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        home = other.filter(pc.equal(other.column("k"), 0))
        again = other.filter(pc.equal(other.column("k"), 1))
        return np.frombuffer(b"".join(home.column("v").to_pylist()), np.int64), blocks.received(again, 1)

    def send(t: pa.Table, other: pa.Table) -> pa.Table:
        if not len(t):
            return blocks.sent(0, np.zeros((0, 1), np.uint64), buckets)
        h, first, _, rows = own(t, inbox(other)[0])
        return blocks.sent(t.column("b")[0].as_py(), blocks.unique(sampled(h, first, rows)[0][:, None])[0], buckets)

    def keep(t: pa.Table, other: pa.Table) -> pa.Table:
        home, again = inbox(other)
        h, first, v, rows = own(t, home)
        p, of = sampled(h, first, rows)
        _, count, which = blocks.unique(p[:, None])
        shared_ = np.bincount(of, (count[which] > 1) | blocks.found(p[:, None], again), len(rows))
        n_own = np.diff(first)[rows]
        spare = n_own - needed(n_own, percent)  # n-grams that a linked set may lack
        rows = rows[shared_ >= np.bincount(of, minlength=len(rows)) - spare]
        return pa.table({"v": pa.array(v[rows]), "n": pa.array(np.diff(first)[rows].astype(np.int32)), "s": pa.array([h[first[r] : first[r + 1]].tobytes() for r in rows], pa.binary())})

    pack = lambda t: pa.table({"b": t.column("b")[:1], "k": pa.array([0], pa.int32()), "v": pa.array([t.column("v").to_numpy().tobytes()], pa.binary())})
    home = shared.written(homes.groupBy("b").applyInArrow(pack, "b int, k int, v binary"))
    again = blocks.common(rows.groupBy("b").cogroup(home.groupBy("b")).applyInArrow(send, blocks.SENT), 1)
    mail = home.union(again.select("b", F.lit(1).alias("k"), "v"))
    return rows.groupBy("b").cogroup(mail.groupBy("b")).applyInArrow(keep, "v long, n int, s binary")


def steps(df: np.ndarray) -> np.ndarray:
    """How common n-grams are, in steps: the first key of the global order. The second is their hash."""
    df = np.maximum(df, 1)
    return np.where(df <= EXACT, df, EXACT + np.ceil(STEPS * np.log2(df / EXACT))).astype(np.int64)


def pivots(counted: DataFrame) -> list[tuple[int, int]]:
    """The places (step, hash) that cut the global order into FRAGMENTS parts with about equally many n-grams."""

    def tell(batches):
        seen = np.zeros(0, np.int64)
        for t in batches:
            for raw in t.column("v").to_pylist():
                more = np.bincount(steps(np.frombuffer(raw, np.uint64).reshape(-1, 2)[:, 1].astype(np.int64)))
                seen = np.pad(seen, (0, max(0, len(more) - len(seen))))
                seen[: len(more)] += more
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["step", "n"])

    found = sorted(map(tuple, counted.select("v").mapInArrow(tell, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()))  # a row a step
    total, out, upto = sum(n for _, n in found), [], 0
    for step, n in found:
        while len(out) < FRAGMENTS - 1 and (goal := total * (len(out) + 1) / FRAGMENTS) <= upto + n:
            out.append((step, min(int((goal - upto) / n * 2**64), 2**64 - 1)))
        upto += n
    return out


def ordered(sets: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(v, n, f, prefix, central): sets without n-grams that only they have, cut into fragments of the global order;
    the n-grams of the prefix; and how common the set's n-grams are. Vertices with too few are left out."""
    placed = sets.select(F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int").alias("b"), "v", "n", "s")

    def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, first = numbers(t.column("s"))
        return h, np.repeat(np.arange(len(t)), np.diff(first))

    def send(t: pa.Table) -> pa.Table:
        h, count, _ = blocks.unique(flat(t)[0][:, None])
        return blocks.sent(t.column("b")[0].as_py(), np.concatenate([h, count.astype(np.uint64)[:, None]], 1), buckets)

    counted = shared.written(placed.groupBy("b").applyInArrow(send, blocks.SENT).groupBy("bucket").applyInArrow(blocks.tally, "b int, v binary"))
    cuts = pivots(counted)

    def order(t: pa.Table, other: pa.Table) -> pa.Table:
        h, doc = flat(t)
        got = blocks.received(other, 2)
        ok, at = hashing.in_sorted(h, got[:, 0])
        h, doc, df = h[ok], doc[ok], got[at[ok], 1].astype(np.int64) if len(got) else np.zeros(0, np.int64)
        step = steps(df)
        by = np.lexsort((h, step, doc))
        h, doc, df, step = h[by], doc[by], df[by], step[by]
        n = t.column("n").to_numpy().astype(np.int64)
        m = np.bincount(doc, minlength=len(n))
        first = np.concatenate([[0], np.cumsum(m)])
        p = np.minimum(n - needed(n, percent) + 1 - (n - m), m)  # n-grams of the prefix that others have
        central = np.bincount(doc, np.log2(df), len(n)) / np.maximum(n, 1)
        fragment = sum(((step > x) | ((step == x) & (h >= np.uint64(y)))).astype(np.int64) for x, y in cuts) if cuts else np.zeros(len(h), np.int64)
        rows = np.flatnonzero(p > 0)
        edges = np.searchsorted(doc * FRAGMENTS + fragment, np.arange(len(n) * FRAGMENTS + 1))
        parts = [[h[edges[r * FRAGMENTS + k] : edges[r * FRAGMENTS + k + 1]].tobytes() for k in range(FRAGMENTS)] for r in rows]
        prefix = h[hashing.spread(first[rows], p[rows])].view(np.int64)
        return pa.table({"v": t.column("v").take(pa.array(rows)), "n": pa.array(n[rows].astype(np.int32)), "f": pa.array(parts, pa.list_(pa.binary())), "prefix": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p[rows])]).astype(np.int32)), pa.array(prefix)), "central": pa.array(central[rows])})

    return placed.groupBy("b").cogroup(counted.groupBy("b")).applyInArrow(order, "v long, n int, f array<binary>, prefix array<long>, central double")


def numbers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned numbers of all binary values in sequence, and where each value's begin."""
    data, off = hashing.flat(column)
    return np.frombuffer(data.tobytes(), np.uint64), off // 8


def overlaps(x: np.ndarray, first_x: np.ndarray, y: np.ndarray, first_y: np.ndarray) -> np.ndarray:
    """How many n-grams each set of x shares with each of y. N-grams that many of them have are counted by a
    product of matrices, the others pair by pair."""
    na, nb = len(first_x) - 1, len(first_y) - 1
    i, j = np.repeat(np.arange(na), np.diff(first_x)), np.repeat(np.arange(nb), np.diff(first_y))
    both = np.intersect1d(x, y)
    (ok, x), (ok_y, y) = hashing.in_sorted(x, both), hashing.in_sorted(y, both)
    x, i, y, j = x[ok], i[ok], y[ok_y], j[ok_y]
    by = np.argsort(y, kind="stable")
    y, j = y[by], j[by]
    n = np.bincount(y, minlength=len(both))
    first = np.cumsum(n) - n
    out = np.zeros(na * nb, np.int64)
    common = DENSE * np.bincount(x, minlength=len(both)) * n > len(out)
    at = np.flatnonzero(~common[x])
    for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(n[x[at]]) // PAIRS)) + 1):
        out += np.bincount(np.repeat(i[part], n[x[part]]) * nb + j[hashing.spread(first[x[part]], n[x[part]])], minlength=len(out))
    out = out.reshape(na, nb)
    place, total = np.cumsum(common) - 1, int(common.sum())
    x, i, y, j = place[x[common[x]]], i[common[x]], place[y[common[y]]], j[common[y]]
    for k in range(0, total, COLUMNS):
        p, q = (x >= k) & (x < k + COLUMNS), (y >= k) & (y < k + COLUMNS)
        left, right = (np.zeros((size, min(COLUMNS, total - k)), np.float32) for size in (na, nb))
        left[i[p], x[p] - k] = 1
        right[j[q], y[q] - k] = 1
        out += (left @ right.T).astype(np.int64)
    return out


#: Sides of a tile: only asked, only members, or both at once (a tile with itself).
ASKED, MEMBER, BOTH = 0, 1, 2
COUNTED = "tile long, a array<long>, b array<long>, c binary"


def partial(t: pa.Table) -> pa.Table:
    """Of each tile and fragment in t(tile, side, v, k, s) the overlaps in this fragment, without empty rows and columns."""
    tile, k, side, v = (t.column(c).to_numpy() for c in ("tile", "k", "side", "v"))
    h, first = numbers(t.column("s"))
    order = np.lexsort((v, k, tile))
    out: dict[str, list] = {c: [] for c in ("tile", "a", "b", "c")}

    def sets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = first[rows + 1] - first[rows]
        return h[hashing.spread(first[rows], size)], np.concatenate([[0], np.cumsum(size)])

    for rows in np.split(order, np.flatnonzero((np.diff(tile[order]) != 0) | (np.diff(k[order]) != 0)) + 1):
        x, y = rows[side[rows] != MEMBER], rows[side[rows] != ASKED]
        if len(x) and len(y):
            c = overlaps(*sets(x), *sets(y))
            some, other = c.any(1), c.any(0)
            if some.any():
                for name, value in (("tile", tile[rows[0]]), ("a", v[x[some]]), ("b", v[y[other]]), ("c", c[np.ix_(some, other)].astype(np.int32).tobytes())):
                    out[name].append(value)
    return pa.table({"tile": pa.array(out["tile"], pa.int64()), "a": pa.array(out["a"], pa.list_(pa.int64())), "b": pa.array(out["b"], pa.list_(pa.int64())), "c": pa.array(out["c"], pa.binary())})


def summed(t: pa.Table):
    """Of each tile its asked vertices, its members, and the overlaps of all fragments summed per pair."""
    tile = t.column("tile").to_numpy()
    order = np.argsort(tile, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        got = [[np.array(t.column(c)[r].as_py(), np.int64) for c in "ab"] + [np.frombuffer(t.column("c")[r].as_py(), np.int32)] for r in rows.tolist()]
        a, b = (np.unique(np.concatenate([g[side] for g in got])) for side in (0, 1))
        total = np.zeros((len(a), len(b)), np.int64)
        for x, y, c in got:
            total[np.ix_(np.searchsorted(a, x), np.searchsorted(b, y))] += c.reshape(len(x), len(y))
        yield tile[rows[0]], a, b, total


def compared(dealt: DataFrame, sets: DataFrame, groups: int, finish, result: str) -> DataFrame:
    """dealt(tile, side, v, w): the pairs of each tile's asked vertices with its members, through finish(asked, members,
    link, w of the asked, w of the members), which gives the columns of `result`, with link the matrix of the pairs
    that link. A vertex links with itself."""
    percent = sets.percent
    by = lambda *names: F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int").alias("g")
    cut = dealt.select("tile", "side", "v").join(sets.table.select("v", "f"), "v").select("tile", "side", "v", F.posexplode("f").alias("k", "s")).where(F.octet_length("s") > 0)
    parts = cut.select(by("tile", "k"), "*").groupBy("g").applyInArrow(partial, COUNTED)
    known = dealt.join(sets.table.select("v", "n"), "v").select(by("tile"), "tile", "v", "n", "w")

    def work(t: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        if len(t):
            tile, v = other.column("tile").to_numpy(), other.column("v").to_numpy()
            order = np.lexsort((v, tile))
            tile, v, n, w = tile[order], v[order], other.column("n").to_numpy().astype(np.int64)[order], other.column("w").to_numpy()[order]
            for which, a, b, total in summed(t):
                lo, hi = np.searchsorted(tile, which), np.searchsorted(tile, which, "right")
                x, y = lo + np.searchsorted(v[lo:hi], a), lo + np.searchsorted(v[lo:hi], b)
                out.append(finish(a, b, total >= -(-percent * (n[x][:, None] + n[y]) // (100 + percent)), w[x], w[y]))
        columns = [c.split()[0] for c in result.split(", ")]
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k, c in enumerate(columns)})

    return parts.select(by("tile"), "*").groupBy("g").cogroup(known.groupBy("g")).applyInArrow(work, result)


@dataclass
class Sets:
    """The vertices' cut sets, and the least similarity in hundredths."""

    table: DataFrame
    percent: int


def connecting(a: np.ndarray, b: np.ndarray, link: np.ndarray, *_) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the links connect: each vertex with the smallest that it reaches."""
    x, y, none = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        new_y = np.minimum(y, np.where(link, x[:, None], none).min(0, initial=none))
        new_x = np.minimum(x, np.where(link, new_y, none).min(1, initial=none))
        if (new_x == x).all() and (new_y == y).all():
            break
        x, y = new_x, new_y
    v, c = np.concatenate([a, b]), np.concatenate([x, y])
    return v[v != c], c[v != c]


def touching(asked: DataFrame, members: DataFrame, sets: Sets) -> DataFrame:
    """asked(v, c), members(v, c): pairs (a, b) that connect what the links of asked vertices with members of the same
    c connect. Members and askers of a large c are dealt into tiles, and every pair of tiles meets once."""
    asked = shared.written(asked)
    queries = asked.groupBy("c").agg(F.count("*").alias("q"))
    sizes = shared.written(members.join(queries, "c").groupBy("c").agg(F.count("*").alias("m"), F.max("q").alias("q")))
    total = sizes.agg(F.sum("m"), F.sum("q")).first()
    tiles = sizes.select("c", F.ceil(F.col("m") / TILE).cast("int").alias("tm"), F.ceil(F.col("q") / TILE).cast("int").alias("tq"))

    def dealt(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        df = df.join(tiles, "c").withColumn(f"_{own}", F.pmod(F.xxhash64("v"), F.col(own)).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return df.select(F.xxhash64("c", "_tm", "_tq").alias("tile"), F.lit(side).alias("side"), "v", F.lit(1).cast("long").alias("w"))

    both = dealt(asked, "tq", "tm", ASKED).union(dealt(members.select("v", "c"), "tm", "tq", MEMBER))
    return compared(both, sets, max(64, ((total[0] or 0) + (total[1] or 0)) // TASK), connecting, "a long, b long")


def counted(found: DataFrame, sets: Sets, copies: DataFrame) -> DataFrame:
    """(v, links): with how many rows of other vertices those of v link. found(v, c) has the component of each
    vertex that links, copies(v, copies) its number of rows."""
    tiles = shared.written(found.groupBy("c").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("m")))
    total = tiles.agg(F.sum(F.col("tiles") * F.col("m"))).first()[0] or 0
    dealt = shared.split_join(found.join(copies, "v"), tiles, "c", "m").withColumn("own", F.pmod(F.xxhash64("v"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), ASKED).otherwise(MEMBER)
    dealt = dealt.select(F.xxhash64("c", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), side.alias("side"), "v", F.col("copies").alias("w"))

    def sums(a: np.ndarray, b: np.ndarray, link: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        link = link & (a[:, None] != b)
        if len(a) == len(b) and (a == b).all():  # a tile with itself has each pair twice
            return a, link @ wb
        return np.concatenate([a, b]), np.concatenate([link @ wb, wa @ link])

    return compared(dealt, sets, max(64, total // TASK), sums, "v long, links long").groupBy("v").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, *, count: bool = False, ngram: int = NGRAM, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, v) with the vertex of each row (null if it has no n-gram), and (v, first,
    component_id, kept, copies): the vertices with their smallest doc_id, that of their component, the vertex that has
    it, and the number of rows.
    With count also n_links, the number of other rows that a row of the vertex links with."""
    rows, buckets = blocks.cut(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for t in batches:
            h, first = grams(t.column("t"), ngram)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([t.column("b"), t.column("doc_id"), pa.array(n), pa.array(signatures(h, first), mask=n == 0)], ["b", "doc_id", "n_shingles", "v"])

    meta = shared.written(rows.mapInArrow(describe, f"b int, doc_id {kind}, n_shingles long, v long"))
    vertices = shared.written(meta.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("first"), F.min("b").alias("b"), F.count("*").alias("copies")))
    sets = shared.written(candidates(rows, buckets, vertices.select("b", "v"), ngram, percent))
    table = shared.written(ordered(sets, buckets, percent))
    shared.deleted(sets)
    sets = Sets(table, percent)
    postings = shared.written(table.select(F.explode("prefix").alias("gram"), "v", "n", "central"))

    centre = postings.groupBy("gram").agg(F.max(F.struct("central", "n", "v")).alias("p"), F.count("*").alias("k")).where(F.col("k") > 1)
    centre = shared.written(centre.select("gram", F.col("p.v").alias("c"), F.col("p.n").alias("cn")))
    near = postings.join(centre, "gram").where((F.col("v") != F.col("c")) & (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn"))).select("v", "c").distinct()
    centres = centre.select(F.col("c").alias("v"), "c").distinct()
    links = shared.written(touching(near, centres, sets))

    # what is left at each n-gram, with its largest component and with each other
    label = components(links).withColumnRenamed("c", "c0")
    label = shared.written(table.select("v").join(label, "v", "left").select("v", F.coalesce("c0", "v").alias("c")))
    sized = shared.split_join(label, shared.written(label.groupBy("c").agg(F.count("*").alias("size"))), "c", "size")
    named = shared.written(postings.select("gram", "v").join(sized, "v"))
    there = named.groupBy("gram", "c").agg(F.max("size").alias("size"))
    mixed = there.groupBy("gram").agg(F.max(F.struct("size", "c")).alias("top"), F.count("*").alias("k")).where(F.col("k") > 1)
    mixed = shared.written(mixed.select("gram", F.col("top.c").alias("top")))
    rest = named.join(mixed, "gram").where(F.col("c") != F.col("top")).select("v", F.col("top").alias("c")).distinct()
    rest = shared.written(rest)
    links = shared.written(links.union(touching(rest, label.union(rest), sets)))
    found = components(links)
    named = shared.written(vertices.join(found, "v", "left").select("v", "first", "copies", F.coalesce("c", "v").alias("c")))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"), F.min_by("v", F.struct(F.col("first").isNull(), "first", "v")).alias("kept"), F.count("*").alias("size"))
    told = shared.split_join(named, shared.written(least), "c", "size").select("v", "first", "component_id", "kept", "copies")
    if count:
        told = told.join(counted(found, sets, vertices.select("v", "copies")), "v", "left")
        told = told.select("v", "first", "component_id", "kept", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return meta.drop("b"), shared.written(told)


def joined(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included) and
    n_links (all other rows that it links with, those of equal sets included).

    Rows without words link with nothing; repeated rows and equal texts are one vertex; a null doc_id is never
    the smallest unless all are null. Sets are compared by 64-bit hashes of n-grams. Very long texts are sets like
    others, an empty table has no rows. Other columns are not read, whatever their names.
    """
    rows, vertices = classes(docs, count=True, **options)
    named = shared.split_join(rows, vertices.select("v", "component_id", "n_links", "copies"), "v", "copies", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, *, ngram: int = NGRAM, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, of each component only one row: that with the smallest doc_id. Rows without words all stay; of
    rows that repeat both doc_id and set one stays. Very long texts are compared whole. An empty table stays
    empty; columns may have any names."""
    plain, new = shared.renamed(docs)
    rows, vertices = classes(docs, ngram=ngram, doc_id=doc_id, text=text, **options)
    told = shared.split_join(rows.where(F.col("v").isNotNull()), vertices, "v", "copies")
    stays = (F.col("v") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("first"))
    gone = shared.written(told.where(~stays).select("v", "doc_id").distinct())
    again = shared.written(told.where(stays).groupBy("v", "doc_id").count().where(F.col("count") > 1).select("v", "doc_id"))
    schema = T.StructType([*plain.schema.fields, T.StructField("_v", T.LongType())])

    def sign(batches):
        for t in batches:
            h, first = grams(t.column(new[text]), ngram)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(signatures(h, first), mask=np.diff(first) == 0)], schema.names)

    signed = plain.mapInArrow(sign, schema)

    def named(df: DataFrame) -> DataFrame:
        return df.select("v", F.col("doc_id").alias("_id"))

    def condition(other: DataFrame):
        return (F.col("_v") == other["v"]) & F.col(new[doc_id]).eqNullSafe(other["_id"])

    out, repeats = named(gone), named(again)
    kept = signed.join(shared.small(out, gone.count()), condition(out), "left_anti")
    if not again.isEmpty():
        some = F.broadcast(repeats) if again.count() <= shared.BROADCAST_ROWS else repeats
        kept = kept.join(some, condition(repeats), "left_anti").union(kept.join(some, condition(repeats), "left_semi").dropDuplicates(["_v", new[doc_id]]))
    return kept.select(*new.values()).toDF(*docs.columns)
