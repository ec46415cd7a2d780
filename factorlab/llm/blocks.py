"""Finding hashes that several places of a corpus share, without a row per hash or per pair.

Documents are dealt by a hash into blocks. A block sends each of its different hashes once, packed into one
binary value per bucket of the hash range; a bucket sees which hashes reach it from two blocks or more, and
tells those blocks. So a hash that a third of the corpus has costs one entry a block, and no task holds
more than its block or its bucket. What repeats inside one block the block sees for itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared

SENT = "b int, bucket int, v binary"


def cut(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(b, doc_id, t) with the block of each row, and the number of buckets. Blocks grow with the root of the
    corpus, 1 to 128 MB of text, and what a bucket is sent grows with them: at 100 TB there are 0.8 million of
    each, and a block sends a bucket several hashes at once. Equal rows are in one block."""
    rows = shared.columns(docs, doc_id=doc_id, t=text)
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    size = min(max(32 * total**0.5, 1 << 20), 128 << 20)
    n = max(64, int(total / size) + 1)
    buckets = max(64, int(total / max(size, 4 << 20)) + 1)
    return rows.select(F.pmod(F.xxhash64("doc_id", "t"), F.lit(n)).cast("int").alias("b"), "doc_id", "t"), buckets


def unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows of h (n x 64-bit parts) in order, how often each occurs, and which of them each row is."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(h.T[::-1])
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    first = np.flatnonzero(new)
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(new) - 1
    return s[first], np.diff(np.append(first, len(s))), which


def found(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which rows of h are rows of the table (both n x parts; the table sorted by the first part)."""
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    if h.shape[1] == 1:
        return hashing.in_sorted(h[:, 0], table[:, 0])[0]
    both = np.concatenate([table, h])
    _, _, which = unique(both)
    return np.isin(which[len(table) :], which[: len(table)])


def sent(block: int, h: np.ndarray, buckets: int) -> pa.Table:
    """The different hashes h (sorted rows) of a block, a binary value per bucket of the first part."""
    bucket = (h[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) if len(h) else np.zeros(0, np.uint64)
    ids, first = np.unique(bucket, return_index=True)
    parts = np.split(h, first[1:]) if len(ids) else []
    return pa.table({"b": pa.array([block] * len(ids), pa.int32()), "bucket": pa.array(ids.astype(np.int32)), "v": pa.array([p.tobytes() for p in parts], pa.binary())})


def received(table: pa.Table, parts: int) -> np.ndarray:
    """All hashes of a block's incoming rows, sorted."""
    h = np.frombuffer(b"".join(table.column("v").to_pylist()), np.uint64).reshape(-1, parts)
    return h[np.lexsort(h.T[::-1])] if len(h) else h


def meet(parts: int) -> Callable[[pa.Table], pa.Table]:
    """For groupBy("bucket").applyInArrow over what sent() gives: per block its hashes that another has too."""

    def work(table: pa.Table) -> pa.Table:
        values = table.column("v").to_pylist()
        h = np.frombuffer(b"".join(values), np.uint64).reshape(-1, parts)
        block = np.repeat(table.column("b").to_numpy(), [len(v) // (8 * parts) for v in values])
        _, n, which = unique(h)
        keep = n[which] > 1
        h, block = h[keep], block[keep]
        order = np.argsort(block, kind="stable")
        ids, first = np.unique(block[order], return_index=True)
        rows = np.split(h[order], first[1:]) if len(ids) else []
        return pa.table({"b": pa.array(ids.astype(np.int32)), "v": pa.array([r.tobytes() for r in rows], pa.binary())})

    return work


def common(hashes: DataFrame, parts: int) -> DataFrame:
    """(b, v): to each block the hashes that another block has sent as well."""
    return hashes.groupBy("bucket").applyInArrow(meet(parts), "b int, v binary")


def tally(table: pa.Table) -> pa.Table:
    """Over (hash, count) values of a bucket: to each block those of its hashes whose counts sum to 2 or more, with the sum."""
    values = table.column("v").to_pylist()
    h = np.frombuffer(b"".join(values), np.uint64).reshape(-1, 2)
    block = np.repeat(table.column("b").to_numpy(), [len(v) // 16 for v in values])
    _, _, which = unique(h[:, :1])
    total = np.bincount(which, h[:, 1].astype(float)).astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
    keep = total[which] > 1
    out, block = np.stack([h[:, 0], total[which]], 1)[keep], block[keep]
    order = np.argsort(block, kind="stable")
    ids, first = np.unique(block[order], return_index=True)
    parts = np.split(out[order], first[1:]) if len(ids) else []
    return pa.table({"b": pa.array(ids.astype(np.int32)), "v": pa.array([p.tobytes() for p in parts], pa.binary())})
