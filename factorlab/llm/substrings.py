"""Substring dedup with difference-cover anchors.

Two places i and j of a corpus have, for a difference cover D modulo v, a common shift d < v that brings both
into D. So of a window of W words only every anchor of W - v + 1 words at cover places is hashed: two equal
windows share an aligned anchor. Anchors that occur twice are extended to the windows around them, and the
windows that occur twice are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, hashing

#: Words of a window.
WINDOW = 35
#: Perfect difference covers by their period.
COVERS = {1: [0], 3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18]}
_ANCHOR, _LOW, _HIGH = hashing.Hash(1), hashing.Hash(11), hashing.Hash(12)


def cover(window: int) -> tuple[int, np.ndarray]:
    """The largest period whose anchors still have a third of the window or more, and its cover."""
    v = max(v for v in COVERS if window - v + 1 >= max(1, window // 3))
    member = np.zeros(v, bool)
    member[COVERS[v]] = True
    return v, member


class Words:
    """The words of a block's texts, and the windows that lie inside one text."""

    def __init__(self, texts: pa.ChunkedArray, window: int):
        data, off = hashing.flat(texts)
        n, low, high = [], [], []
        for i, j in hashing.slices(off):
            own, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            starts, ends, first = hashing.words(own, o, hashing.SEPARATORS["blank"])
            n.append(np.diff(first))
            low.append(_LOW.words(own, starts, ends))
            high.append(_HIGH.words(own, starts, ends))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.counts, self.low, self.high = join(n, np.int64), join(low, np.uint64), join(high, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.place = np.arange(len(self.low)) - np.repeat(self.first[:-1], self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place  # words from here to the text's end
        self.window = window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of texts with a window."""
        v, member = cover(self.window)
        size = self.window - v + 1
        at = np.flatnonzero(member[self.place % v] & (self.left >= size) & (self.left + self.place >= self.window))
        return at, _ANCHOR.spans(self.low, at, at + size)[:, None]

    def windows(self, at: np.ndarray) -> np.ndarray:
        return np.stack([_LOW.spans(self.low, at, at + self.window), _HIGH.spans(self.high, at, at + self.window)], 1)

    def all(self) -> np.ndarray:
        return np.flatnonzero(self.left >= self.window)


def repeated(docs: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and the kept words joined by blanks.

    A word goes if some window that covers it has a word sequence that starts at another place of the
    corpus too; windows are compared by 128-bit hashes. Null and empty texts have no words and keep "".
    Repeated rows are places of their own, so their windows go from each. Very long texts are read whole. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    rows, buckets = blocks.cut(docs, doc_id, text)
    v, _ = cover(window)

    def send_anchors(t: pa.Table) -> pa.Table:
        _, h = Words(t.column("t"), window).anchors()
        return blocks.sent(t.column("b")[0].as_py(), blocks.unique(h)[0], buckets)

    def send_windows(t: pa.Table, other: pa.Table) -> pa.Table:
        if not len(t):
            return blocks.sent(0, np.zeros((0, 2), np.uint64), buckets)
        w = Words(t.column("t"), window)
        at, h = w.anchors()
        _, n, which = blocks.unique(h)
        again = at[(n[which] > 1) | blocks.found(h, blocks.received(other, 1))]
        near = hashing.covered(len(w.low) + v, again + 1, v)[v : v + len(w.low)]  # an anchor at i to i + v - 1
        at = w.all()
        return blocks.sent(t.column("b")[0].as_py(), blocks.unique(w.windows(at[near[at]]))[0], buckets)

    kind = rows.schema["doc_id"].dataType.simpleString()

    def remove(t: pa.Table, other: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        w = Words(t.column("t"), window)
        at = w.all()
        h = w.windows(at)
        _, n, which = blocks.unique(h)
        gone = hashing.covered(len(w.low), at[(n[which] > 1) | blocks.found(h, blocks.received(other, 2))], window)
        kept, removed = [], np.zeros(len(w.counts), np.int64)
        np.add.at(removed, np.repeat(np.arange(len(w.counts)), w.counts), gone)
        for k, x in enumerate(t.column("t").to_pylist()):
            own = (x or "").encode().split()  # bytes.split() parts at ASCII blanks
            if removed[k]:
                own = [own[i] for i in np.flatnonzero(~gone[w.first[k] : w.first[k + 1]])]
            kept.append(b" ".join(own).decode())
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(w.counts), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.string())})

    again = blocks.common(rows.groupBy("b").applyInArrow(send_anchors, blocks.SENT), 1)
    windows = rows.groupBy("b").cogroup(again.groupBy("b")).applyInArrow(send_windows, blocks.SENT)
    return rows.groupBy("b").cogroup(blocks.common(windows, 2).groupBy("b")).applyInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, **names: str) -> DataFrame:
    return repeated(docs, **names).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The digest in DuckDB SQL.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
starts AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS k FROM w, unnest(range(1, len(w) - 33)) AS u(p)),
again AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, p FROM starts JOIN again USING (k)), unnest(range(p, p + 35)) AS u(q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([x FOR x, i IN w IF NOT list_contains(g, i)], ' ') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
