"""Collocations against a plain count, with every edge case."""

import re
from collections import Counter, defaultdict

from factorlab.llm import collocations

SCHEMA = "text string, lang string, t string, a int, phrase string, k int, n int"


def plain(rows, max_n=3, least=10, kept=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in frequent.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        covered[p[i:j]] = max(covered[p[i:j]], a)
        found = []
        for p, a in frequent.items():
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not (p in covered and 100 * covered[p] >= kept * a):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, phrase.decode(), -a, left, right, n[lang], -score) for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(t, lang, "x", 1, "p", 2, 3) for t, lang in rows], SCHEMA)
    return sorted(map(tuple, collocations.collocations(df, **how).collect()))


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain(rows)
    assert found(spark, rows, max_n=5, least=4, kept=70, top=50) == plain(rows, 5, 4, 70, 50)
    assert found(spark, rows, max_n=2, least=2) == plain(rows, 2, 2)


def test_edges(spark):
    rows = [
        ("New  York\tcity", None), ("new york city, NEW YORK", "en"), ("a a a a a a a a a a a a a", "en"), (None, "en"), ("", "de"), (". , \t \n", "de"), ("x" * 60_000, "fr"),
        ("Ä ä Ä ä " * 10, "de"), ("san francisco\x0bsan francisco\x0c" * 20, "en"), ("one two three four " * 5000, "es"), ("", None),
    ] + [("new york city", None)] * 12 + [("salt and pepper; salt and", "und"), ("é   z", "en")] * 11
    got = found(spark, rows)
    assert got == plain(rows) and {r[0] for r in got} == {"und", "en", "de", "es"}
    assert found(spark, rows, max_n=4, least=3, kept=100) == plain(rows, 4, 3, 100)


def test_ties_and_limit(spark):
    rows = [(f"w{i} v{i}. " * 10, "en") for i in range(300)]
    assert found(spark, rows, top=40) == plain(rows, top=40)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("one word", "en")]) == []


def test_full_bitmap(spark, monkeypatch):
    """A bitmap that is far too small lets runs through and changes nothing."""
    monkeypatch.setattr(collocations, "BITMAP_BITS", (64, 64))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain([(r.text, r.lang) for r in docs.collect()])
