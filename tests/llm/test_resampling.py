"""Importance resampling against a plain version, with every edge case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factorlab.llm import resampling

SCHEMA = "doc_id long, text string, t string, weight int, score int, n_words int, _row int, _at int"


def plain(rows, target, max_n=1, buckets=10_000, percent=10, least=20):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((float(t[b] + 1) * (big_s + buckets)) / (float(s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for i, words, f in docs:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(spark, rows, target, **how):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)
    return sorted(map(tuple, resampling.resampled(docs, spark.createDataFrame([(t, 1) for t in target], "text string, t int"), **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"max_n": 3, "buckets": 257, "percent": 35, "least_words": 5}])
def test_sample(spark, how):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], **{"least" if k == "least_words" else k: v for k, v in how.items()})
    assert sorted(map(tuple, resampling.resampled(docs, bench, **how).collect()), key=str) == want


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_edges(spark, max_n):
    words = " ".join(f"Wort{i} ÄÖ ß" for i in range(30))
    rows = [(None, words), (None, words), (1, None), (2, ""), (3, "--- !!"), (4, words), (4, words), (4, words.upper()), (5, "x" * 5000 + " é" * 40), (6, "word " * 60_000)] + [(i, f"a b c {i} " * 8) for i in range(10, 60)]
    target = ["wort1 wort2 äö", None, "", "a b c"]
    assert drawn(spark, rows, target, max_n=max_n) == plain(rows, target, max_n)
    assert drawn(spark, rows, [], max_n=max_n) == plain(rows, [], max_n)
    assert drawn(spark, [], target, max_n=max_n) == []


def test_crc32():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4000, 400))
    ends = starts + np.concatenate((rng.integers(0, 100, 399), [900]))
    got = resampling.crc32(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert resampling.crc32(data, ends, ends + 7, got).tolist() == [zlib.crc32(data[b : b + 7].tobytes(), c) for b, c in zip(ends, got.tolist(), strict=True)]
