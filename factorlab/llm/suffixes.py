"""Suffix-array dedup with a run-length index.

Byte strings of WINDOW that start at two places of the corpus are removed. Their k-mers select what can
repeat: a window whose minimizers no other place has is out, and a window of very common minimizers is out
if no other place has its hash, so that what surrounds a common passage doesn't gather in one task. A window
that stays goes to the shard that its smallest k-mer names, so equal windows meet there. Each shard builds the suffix array
of its segments and keeps its Burrows-Wheeler transform as runs: suffixes and common prefixes are sampled at
the runs' ends only. Matching statistics are streamed from the samples, since inside a run the match with
the neighbour is one shorter at each step; where one reaches the window's length the window is marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, hashing

#: Bytes of a window, of a k-mer and of the part of a window that has a minimizer of its own.
WINDOW, KMER, PART = 200, 32, 150
#: A minimizer is common from so many occurrences on: all its windows are compared by hash.
COMMON = 256
_HASH, _ROUTE = hashing.Hash(6), hashing.Hash(61)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in sequence."""
    n, size = len(h) - w + 1, 1
    if n <= 0:
        return h[:0]
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[w - size : w - size + n])


def run_starts(*values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(values[0]), bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    return np.flatnonzero(new)


class Slice:
    """Some texts of a block: hashes of their k-mers, minimizers, and the windows inside one text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, part: int, kmer: int):
        self.data, self.off, self.window, self.part = data, off, window, part
        n = len(data)
        at = np.arange(max(0, n - kmer + 1))
        self.h = h = _HASH.spans(_HASH.table[data], at, at + kmer)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        left = off[1:][self.doc] - np.arange(n)
        self.few = sliding_min(h, part - kmer + 1)  # minimizer of the part that starts here
        self.few_ok = left[: len(self.few)] >= part
        self.all = sliding_min(h, window - kmer + 1)
        self.ok = left[: len(self.all)] >= window

    def minimizers(self) -> np.ndarray:
        """The k-mers that are the least of some part, one value per occurrence."""
        if not len(self.few):
            return self.few
        w = len(self.h) - len(self.few) + 1
        edge = np.zeros(w - 1, np.uint64)
        most = ~sliding_min(~np.concatenate([edge, np.where(self.few_ok, self.few, np.uint64(0)), edge]), w)
        return self.h[most == self.h]

    def shared(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose parts have shared minimizers, and those among them with a common one."""
        if not len(self.all):
            return self.ok, self.ok
        i = run_starts(self.few)
        known, at = hashing.in_sorted(self.few[i], table[:, 0])
        count = np.where(known, table[at, 1] if len(table) else 0, 0)
        count = np.repeat(count, np.diff(np.append(i, len(self.few))))
        a, b = count[: len(self.all)], count[self.window - self.part :][: len(self.all)]
        some = self.ok & (a > 1) & (b > 1)
        return some, some & (np.minimum(a, b) >= COMMON)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return _ROUTE.spans(_ROUTE.table[self.data], at, at + self.window)

    def segments(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of kept windows of one text with one smallest k-mer: first window, windows, that k-mer."""
        at = np.flatnonzero(some)
        if not len(at):
            return at, at, np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (self.all[at[1:]] != self.all[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]])
        i = np.flatnonzero(new)
        return at[i], np.diff(np.append(i, len(at))), self.all[at[i]]


def suffix_order(symbols: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Suffix array of segments that end in different sentinels, the earlier the smaller.

    symbols: bytes + 1, and 0 for a sentinel; room: symbols up to the sentinel. Seven symbols are sorted at
    once, then the sorted length doubles for what is still tied.
    """
    n, first = len(symbols), 7
    key = np.zeros(n, np.int64)
    for k in range(first):
        key <<= 9
        key[: n - k] |= symbols[k:] * (room[: n - k] > k)
    order = np.argsort(key)
    sorted_, short = key[order], room[order] < first
    at = np.flatnonzero(short)  # equal short suffixes: by place, as their sentinels
    order[at] = order[at][np.lexsort((order[at], sorted_[at]))]
    new = np.ones(n, bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | short[1:] | short[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    single = new & np.append(new[1:], True)
    tied, k = order[~single], first
    while len(tied):  # a tied suffix is longer than k: the sentinels differ
        g, key = rank[tied], rank[np.minimum(tied + k, n - 1)]
        by = np.argsort(g * (n + 1) + key)
        tied, g, key = tied[by], g[by], key[by]
        head = np.ones(len(tied), bool)
        head[1:] = g[1:] != g[:-1]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        at = np.arange(len(tied))
        rank[tied] = g + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class RunIndex:
    """Runs of the Burrows-Wheeler transform of sentinel-ended segments, sampled at both ends of each run."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, limit: int, text_base: int, least: int):
        order = suffix_order(np.where(ends == np.arange(len(text)), 0, text - text_base), ends - np.arange(len(text)))
        before = np.where(order > 0, text[order - 1], -1)
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads, self.tails = np.concatenate([[0], change]), np.concatenate([change, [len(order)]]) - 1
        self.symbols = before[self.heads]
        self.head_at, self.tail_at = order[self.heads], order[self.tails]  # the sampled suffixes
        up = np.where(self.heads > 0, order[self.heads - 1], -1)
        down = np.where(self.tails + 1 < len(order), order[np.minimum(self.tails + 1, len(order) - 1)], -1)
        self.head_match, self.tail_match = matched(text, ends, self.head_at, up, limit, least), matched(text, ends, self.tail_at, down, limit, least)
        self.n = len(text)

    def statistics(self) -> np.ndarray:
        """The longest match of each place with another, streamed: from a sample on, one less at each step."""
        out = np.zeros(self.n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            order = np.argsort(at)
            at, match = at[order], match[order]
            last = np.searchsorted(at, np.arange(self.n), "right") - 1
            np.maximum(out, np.where(last >= 0, match[last] - (np.arange(self.n) - at[last]), 0), out=out)
        return out


def matched(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, least: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b up to their segments' ends (0 where b is -1, or it is below `least`)."""
    n = np.zeros(len(a), np.int64)
    # a first symbol and one further on tell most pairs apart; what is below them is of no use as a match
    probe = [np.minimum(x + min(least - 1, 24), len(text) - 1) for x in (a, b)]
    live = np.flatnonzero((b >= 0) & (text[probe[0]] == text[probe[1]]) & (text[a] == text[b]))
    most = np.minimum(ends[a] - a, np.where(b >= 0, ends[b] - b, 0))
    step = 16
    while len(live):
        x, y = a[live] + n[live], b[live] + n[live]
        room = most[live] - n[live]
        i = np.arange(step)
        differ = (text[np.minimum(x[:, None] + i, len(text) - 1)] != text[np.minimum(y[:, None] + i, len(text) - 1)]) | (i >= room[:, None])
        whole = ~differ.any(1)
        n[live] += np.where(whole, step, differ.argmax(1))
        live = live[whole & (n[live] < limit)]
    return n


def marked(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For different segments: which of their windows start at another place of these segments too."""
    if not segments:
        return []
    size = np.array([len(s) for s in segments])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(start[-1], np.int64)
    inside = np.ones(len(text), bool)
    inside[start[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + len(segments)
    text[start[1:] - 1] = np.arange(len(segments))
    ends = np.repeat(start[1:] - 1, size + 1)
    hit = RunIndex(text, ends, int(size.max()) + 1, len(segments) - 1, window).statistics() >= window
    return [hit[start[k] : start[k] + size[k] - window + 1] for k in range(len(segments))]


def repeated(docs: DataFrame, *, window: int = WINDOW, kmer: int = KMER, part: int = PART, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the other bytes.

    Null and empty texts have no bytes. Equal rows are places of their own. Texts shorter than the window keep
    all, very long ones are read whole. kept may cut a character in two, so it is binary. An empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    rows, buckets = blocks.cut(docs, doc_id, text)
    shards = 4 * buckets
    kind = rows.schema["doc_id"].dataType.simpleString()

    def parts(t: pa.Table):
        data, off = hashing.flat(t.column("t"))
        for i, j in hashing.slices(off):
            yield i, Slice(data[off[i] : off[j]], off[i : j + 1] - off[i], window, part, kmer)

    def counted(t: pa.Table, h: np.ndarray) -> pa.Table:
        u, n, _ = blocks.unique(h[:, None])
        return blocks.sent(t.column("b")[0].as_py(), np.concatenate([u, n.astype(np.uint64)[:, None]], 1), buckets)

    def inbox(other: pa.Table) -> list:
        kinds = other.column("k").to_numpy()
        got = [blocks.received(other.filter(pa.array(kinds == k)), 2) for k in (0, 1)]
        mail = other.filter(pa.array(kinds == 2)).column("v").to_pylist()
        return [*got, np.frombuffer(b"".join(mail), np.int32).reshape(-1, 3)]

    none = np.zeros(0, np.uint64)

    def send_minimizers(t: pa.Table) -> pa.Table:
        return counted(t, np.concatenate([none, *(s.minimizers() for _, s in parts(t))]))

    def send_windows(t: pa.Table, other: pa.Table) -> pa.Table:
        if not len(t):
            return blocks.sent(0, np.zeros((0, 2), np.uint64), buckets)
        table = inbox(other)[0]
        return counted(t, np.concatenate([none, *(s.hashes(np.flatnonzero(s.shared(table)[1])) for _, s in parts(t))]))

    def kept_windows(s: Slice, table: np.ndarray, again: np.ndarray) -> np.ndarray:
        some, common = s.shared(table)
        at, some = np.flatnonzero(common), some.copy()
        some[at[~hashing.in_sorted(s.hashes(at), again[:, 0])[0]]] = False
        return some

    def found_segments(t: pa.Table, table: np.ndarray, again: np.ndarray):
        for i, s in parts(t):
            raw = s.data.tobytes()
            first, n, m = s.segments(kept_windows(s, table, again))
            yield i, s, first, n, m, [raw[a : a + k + window - 1] for a, k in zip(first.tolist(), n.tolist(), strict=True)]

    def send_segments(t: pa.Table, other: pa.Table) -> pa.Table:
        got: dict[bytes, int] = {}
        if len(t):
            table, again, _ = inbox(other)
            for _, _, _, _, m, own in found_segments(t, table, again):
                got.update(zip(own, (hashing.mixed(m) % np.uint64(shards)).tolist(), strict=True))
        by: dict[int, list[tuple[int, bytes]]] = {}
        for k, c in enumerate(sorted(got)):
            by.setdefault(got[c], []).append((k, c))
        b = t.column("b")[0].as_py() if len(t) else 0
        return pa.table({"b": pa.array([b] * len(by), pa.int32()), "shard": pa.array(list(by), pa.int32()), "id": pa.array([[k for k, _ in x] for x in by.values()], pa.list_(pa.int32())), "c": pa.array([[c for _, c in x] for x in by.values()], pa.list_(pa.binary()))})

    def index(t: pa.Table) -> pa.Table:
        owners: dict[bytes, list[tuple[int, int]]] = {}
        for b, ids, cs in zip(t.column("b").to_pylist(), t.column("id").to_pylist(), t.column("c").to_pylist(), strict=True):
            for k, c in zip(ids, cs, strict=True):
                owners.setdefault(c, []).append((b, k))
        out: dict[int, list[tuple[int, int, int]]] = {}
        different = sorted(owners)
        for c, hit in zip(different, marked(different, window), strict=True):
            if len(owners[c]) > 1:
                spans = [(0, len(hit))]
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            for b, k in owners[c]:
                out.setdefault(b, []).extend((k, x, y) for x, y in spans)
        return pa.table({"b": pa.array(list(out), pa.int32()), "k": pa.array([2] * len(out), pa.int32()), "v": pa.array([np.array(x, np.int32).tobytes() for x in out.values()], pa.binary())})

    def remove(t: pa.Table, other: pa.Table) -> pa.Table:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        if len(t):
            table, again, spans = inbox(other)
            found = list(found_segments(t, table, again))
            count: dict[bytes, int] = {}
            for x in found:
                for c in x[5]:
                    count[c] = count.get(c, 0) + 1
            place = {c: k for k, c in enumerate(sorted(count))}
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            edge = np.searchsorted(spans[:, 0], np.arange(len(place) + 1))
            for _, s, first, n, _, own in found:
                at, size = [], []
                for a, k, c in zip(first.tolist(), n.tolist(), own, strict=True):
                    if count[c] > 1:
                        at.append(a)
                        size.append(k + window - 1)
                    else:
                        for _, x, y in spans[edge[place[c]] : edge[place[c] + 1]].tolist():
                            at.append(a + x)
                            size.append(y - x + window - 1)
                gone = hashing.covered(len(s.data), np.array(at, int), np.array(size, int)) if at else np.zeros(len(s.data), bool)
                fresh = gone.copy()
                fresh[1:] &= ~gone[:-1] | (s.doc[1:] != s.doc[:-1])
                docs_ = len(s.off) - 1
                n_bytes += np.diff(s.off).tolist()
                n_removed += np.bincount(s.doc, gone, docs_).astype(int).tolist()
                n_spans += np.bincount(s.doc, fresh, docs_).astype(int).tolist()
                kept += [s.data[a:b][~gone[a:b]].tobytes() for a, b in zip(s.off[:-1], s.off[1:], strict=True)]
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    def shared_by(sent: DataFrame, k: int) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(blocks.tally, "b int, v binary").select("b", F.lit(k).alias("k"), "v")

    def with_mail(mail: DataFrame):
        return rows.groupBy("b").cogroup(mail.groupBy("b"))

    mail = shared_by(rows.groupBy("b").applyInArrow(send_minimizers, blocks.SENT), 0)
    mail = mail.union(shared_by(with_mail(mail).applyInArrow(send_windows, blocks.SENT), 1))
    segments = with_mail(mail).applyInArrow(send_segments, "b int, shard int, id array<int>, c array<binary>")
    mail = mail.union(segments.groupBy("shard").applyInArrow(index, "b int, k int, v binary"))
    return with_mail(mail).applyInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, **names) -> DataFrame:
    return repeated(docs, **names).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
