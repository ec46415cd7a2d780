"""The registered queries against plain versions of their contracts, on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from factorlab.llm import fingerprint, jaccard, language, queries, shared

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0d]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_mixing", "op10_decontamination"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_op2(spark, texts):
    got = queries.op2_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    load, slots, at = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        at[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in at.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(Counter({t: sum(r["size"] for r in got if texts[r.doc_id] == t) for t in at}).values())
    assert max(load.values()) - min(load.values()) <= largest


def components(texts, ngram=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(SPACED, (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)) if len(w) >= ngram else frozenset([tuple(w)] if w else [])
    where, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op4(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_jaccard_join(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(texts)
    assert {r.doc_id: r.n_links for r in got} == plain_links(texts)


def plain_links(texts, ngram=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(SPACED, (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + ngram]) for k in range(max(len(w) - ngram + 1, min(len(w), 1))))
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    return {i: sum(100 * n >= percent * (len(s) + len(sets[j]) - n) for j, n in Counter(j for x in s for j in where[x] if j != i).items()) for i, s in sets.items()}


def test_op4_links_of_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(120)], {}
    for i in range(90):  # chains and a dense group; three exact copies
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            w[k] = f"x{rng.integers(0, 40)}"
        texts[i] = " ".join(w) if i % 30 else " ".join(base)
    want = plain_links(texts)
    assert 5 < len(set(want.values())) and max(want.values()) < 90
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for tile, dense in ((7, 50), (7, 0), (500, 10**6)):
        monkeypatch.setattr(jaccard, "TILE", tile)
        monkeypatch.setattr(jaccard, "DENSE", dense)
        assert {r.doc_id: r.n_links for r in jaccard.joined(docs, ngram=4, percent=85).collect()} == want


def test_op5(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in got]) < 0.01


def test_op5_rejects_short_texts(spark):
    rng = np.random.default_rng(3)
    finnish = "ja on se että hän ei olla mutta kun niin myös vain tämä joka kanssa vielä sitten kaikki talo metsä järvi kesä yöllä aamulla työ ihminen".split()
    letters, base64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    foreign = [(i, " ".join(rng.choice(finnish, 20))) for i in range(20)]
    foreign += [(i, " ".join("".join(rng.choice(list(letters), 6)) for _ in range(20))) for i in range(20, 40)]
    foreign += [(i, "".join(rng.choice(list(base64), 140))) for i in range(40, 60)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    got = language.predict(spark.createDataFrame(foreign, "doc_id long, text string"), model).collect()
    assert (model.least > 0).all() and all(r._rejected for r in got)
    short = language.predict(docs.where("lang is not null and length(text) between 1 and 170").select("doc_id", "text"), model).collect()
    assert len(short) > 10 and not any(r._rejected for r in short)


def test_op5_bounds_pool_lengths(monkeypatch):
    monkeypatch.setattr(language, "LEAST_ROWS", 20)
    seen = np.zeros((24, language.STEPS + 1), np.int64)
    seen[6, 1024], seen[7, 3072], seen[9, 2048], seen[15, 1000] = 5, 14, 1, 3
    got = language.bounds(seen)
    low, high = (language.TOLERANCE * at / language.STEPS for at in (1000, 1024))
    assert np.allclose(got[:7], high) and np.allclose(got[7:], low)


@pytest.mark.parametrize("out", ["en", "de", "es", "fr"])
def test_op5_rejects_a_language_left_out(spark, out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = docs.where(f"lang <> '{out}'")
    model = language.fit(rest)
    got = language.predict(docs.where(f"lang = '{out}'").select("text"), model).collect()
    assert np.mean([r._rejected for r in got]) > 0.9
    assert np.mean([r._rejected for r in language.predict(rest.select("text"), model).collect()]) < 0.005


def test_op5_rejects_unseen_scripts(spark):
    model = language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = ["这是一个关于自然语言处理的句子", "これは日本語の文章です", "это предложение на русском языке", "αυτό είναι ένα κείμενο", "да", "好", "xkcd qwrtz bcdfg hjklm npqrs tvwxz", "다음 문장은 한국어로 쓰였습니다"]
    docs = spark.createDataFrame([(" ".join([t] * n),) for t in texts for n in (1, 5, 40)], "text string")
    assert all(r._rejected for r in language.predict(docs, model).collect())


def test_op5_learns_every_language_or_says_so(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'abcdefgh'[i % 8]}lpha beta text", f"l{i % 8 if i % 16 < 8 else i % 3}") for i in range(400)], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == [f"l{k}" for k in range(8)]
    monkeypatch.setattr(language, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.fit(docs)


def test_op6(spark, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for r in queries.op6_suffix_dedup(spark, SF).collect():
        b = raw[r.doc_id]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, sha(kept))


def test_op7(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op7_quality(spark, "/root/testdata/sf0.01").collect()
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_op8(spark, texts):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.op8_secrets(spark, SF).collect():
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        want = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == sha(want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, x, _ in spans) for k in range(3)]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def sketches(text):
    """An order MinHash of the same form over plain Python values: equal exactly where ours are, not the same numbers."""
    words = re.findall(SPACED, text or "")
    kmers = [tuple(words[i : i + 2]) for i in range(len(words) - 1)] or ([tuple(words)] if words else [])
    seen, out = Counter(), defaultdict(list)
    for i, k in enumerate(kmers):
        h = int(hashlib.md5(repr((k, seen[k])).encode()).hexdigest()[:16], 16)
        seen[k] += 1
        out[h % fingerprint.BUCKETS].append((h, i))
    return {b: tuple(h for _, h in sorted((i, h) for h, i in sorted(x)[: fingerprint.LENGTH])) for b, x in out.items()}


def likeness(a, b):
    return len([k for k in a if b.get(k) == a[k]]) / len(a.keys() | b.keys()) if a or b else 1.0


def test_op9(spark, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in queries.op9_fingerprint(spark, SF).collect()}
    mine, theirs = [], []
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert r.near_next == 1.0 or t != after
        mine.append(r.near_edited)
        theirs.append(likeness(sketches(t), sketches(edited)))
    assert len({(texts[i], got[i].fingerprint) for i in order}) == len(set(texts.values()))
    assert abs(np.mean(mine) - np.mean(theirs)) < 0.03 and np.mean(np.abs(np.array(mine) - theirs)) < 0.12


def test_pipeline(spark, texts):
    """Each stage on its own input; the decisions of the exact ones are those of the plain versions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF))
        steps.append(docs.collect())
    assert all(list(s[0].asDict()) == columns for s in steps[:-1])
    kept = {r.doc_id: r.text for r in steps[0]}
    assert len(kept) >= 0.99 * len(texts)
    assert sorted(r.doc_id for r in steps[1]) == sorted({c for _, c in components(kept, 5, 80).values()})
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(LOWER)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in steps[2]) == sorted(r.doc_id for r in steps[1] if not hit(r.text))
    words = lambda t: len(re.findall(SPACED, t))
    total, mixed = sum(words(r.text) for r in steps[2]), sum(words(r.text) for r in steps[3])
    assert abs(mixed / total - 1.5) < 0.1 and max(Counter(r.doc_id for r in steps[3]).values()) == 2
    assert Counter((r.doc_id, r.text) for r in steps[4]) == Counter((r.doc_id, r.text) for r in steps[3])
    assert {r.shard for r in steps[4]} <= set(range(16))
    assert corpus_pipeline.run(spark, SF).count() == len(steps[4])
