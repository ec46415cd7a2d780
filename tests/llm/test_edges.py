"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorlab.llm import components, decontamination, fingerprint, jaccard, language, mixing, quality, secrets, sharding, shared, substrings, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, b int, v long, size int, _key string, _lang string, _v long, _hits int, c0 int, c1 int"
LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(60_000))
PROSE = "Der schnelle braune Fuchs springt über den faulen Hund und läuft danach in den dunklen Wald hinein wo er lange schläft"
ROWS = [
    (None, PROSE, "de", None), (1, None, "en", "a"), (1, None, "en", "a"), (2, "", None, "a"), (3, "one", "en", "b"), (3, "one", "en", "b"), (4, "  \n\t ", "en", "b"),
    (5, LONG, "en", "a"), (6, LONG + " tail", "en", None), (7, PROSE, "de", "b"), (7, PROSE, "de", "b"), (8, "12345 --- !!", "en", "a"), (9, "token = \"" + "ab12" * 10 + "\" x", "en", "c"), (None, None, None, None), (10, "x" * 70_000, "en", "c"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, s, 0, "t", 1, 2, 3, "k", "l", 4, 5, 6, 7) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "braune fuchs springt"), (2, None), (3, " "), (None, "word0 word919 word838"), (1, "braune fuchs springt")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1), (9, 0), (9, 1)], "doc_id long, quality int")


RUNS = {
    "op1": lambda d, b, q: substrings.digest(d), "op2": lambda d, b, q: sharding.shard(d, 4, carry=tuple(d.columns)), "op3": lambda d, b, q: mixing.mix(d), "op4": lambda d, b, q: jaccard.joined(d), "op5": lambda d, b, q: language.digest(d),
    "op6": lambda d, b, q: suffixes.digest(d), "op7": lambda d, b, q: quality.score(d, q), "op8": lambda d, b, q: secrets.digest(d), "op9": lambda d, b, q: fingerprint.fingerprints(d), "op10": lambda d, b, q: decontamination.digest(decontamination.scan(d.select("doc_id", "text"), b)),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result(name, docs, bench, labels):
    got = RUNS[name](docs, bench, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name, bench, labels):
    assert RUNS[name](frame(spark, []), bench, labels).collect() == []


@pytest.mark.parametrize("stage", [language.keep, jaccard.keep_one, mixing.mixed])
def test_stages_keep_columns(stage, docs):
    got = stage(docs)
    assert got.columns == docs.columns
    assert all(tuple(r)[4:] == (0, "t", 1, 2, 3, "k", "l", 4, 5, 6, 7) for r in got.collect())


def test_clean_keeps_columns(docs, bench):
    got = decontamination.clean(docs, bench)
    assert got.columns == docs.columns and not any(r.text and "braune" in r.text for r in got.collect())


def test_repeated_rows_are_removed_whole(docs):
    got = {r.doc_id: r for r in substrings.digest(docs).collect() if r.doc_id is not None}
    assert got[5].n_removed == 60_000 and got[6].n_removed == 60_000 and got[6].kept_sha256 == hashlib.sha256(b"tail").hexdigest()
    assert got[1].n_words == 0 and got[1].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[7].n_removed == 0
    got = {r.doc_id: r for r in suffixes.digest(docs).collect() if r.doc_id is not None}
    assert got[10].n_removed == 70_000 and got[10].n_spans == 1 and got[5].n_removed == len(LONG) and got[6].n_removed == len(LONG) + 1


def test_components_of_edges(docs):
    got = defaultdict(set)
    for r in jaccard.joined(docs, ngram=4, percent=85).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[5] == {(len(set(zip(*(LONG.split()[k:] for k in range(4))))), 5)} and {c for _, c in got[6]} == {5}
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(1, 3)} and got[4] == {(0, 4)}
    assert (len(PROSE.split()) - 3, 7) in got[None] and got[7] == {(len(PROSE.split()) - 3, 7)}
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in jaccard.keep_one(docs).select("doc_id", "text").collect())
    assert kept.count((False, 3, False)) == 1 and kept.count((False, 7, False)) == 1 and (False, 6, False) not in kept and kept.count((False, 1, True)) == 2


def test_null_text_languages(docs):
    got = language.digest(docs).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 4, 8))
    assert all(0 <= r.score <= 1 for r in got)


def test_fingerprints_of_edges(docs):
    got = defaultdict(list)
    for r in fingerprint.fingerprints(docs).collect():
        got[r.doc_id].append(r)
    assert {r.fingerprint for r in got[1]} == {""} and len({r.fingerprint for r in got[7]}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for rs in got.values() for r in rs)
    assert sum(r.near_next == 1.0 for r in got[7]) == 1  # its copy follows one of them


def test_single_document(spark):
    r = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert (r.near_next, r.n_chars, r.edited_sha256) == (1.0, 7, hashlib.sha256(b"a b c a").hexdigest())


def test_shards_of_edges(docs):
    got = sharding.shard(docs, 4, carry=("text",)).collect()
    at = defaultdict(set)
    for r in got:
        at[r.text].add(r.shard)
        assert r["size"] == len((r.text or "").encode()) + 1
    assert all(len(s) == 1 for s in at.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mix_of_edges(docs):
    got = mixing.mix(docs).collect()
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert all(r.target <= 2 * r.source_size for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_passes_over_a_large_benchmark(spark, bench, monkeypatch):
    docs = spark.createDataFrame([(1, PROSE), (2, LONG[:400]), (3, "nothing here")], "doc_id long, text string")
    one = sorted(map(tuple, decontamination.digest(decontamination.scan(docs, bench)).select("doc_id", "n_hit", "n_items", "items_sha256").collect()))
    monkeypatch.setattr(decontamination, "PASS_BYTES", 25)
    many = sorted(map(tuple, decontamination.digest(decontamination.scan(docs, bench)).select("doc_id", "n_hit", "n_items", "items_sha256").collect()))
    assert one == many and one[0][1] == 3 and one[1][1] >= 3 and one[1][2] == 0


def test_longest_match_of_each_copy(spark):
    items = [" ".join(f"a{k}" for k in range(30)), " ".join(f"a{k}" for k in range(5, 45)), "tiny item here", " ".join(["ab"] * 14)]
    words = [i.split() for i in items]
    texts = [f"x{n} y " + " ".join(words[1][s : s + m]) + f" z{n}" for n, (s, m) in enumerate([(0, 40), (0, 40), (0, 22), (0, 22), (3, 15), (3, 15), (20, 12), (1, 9)])]
    texts += ["see tiny item here", "again tiny item here", " ".join(["ab"] * 12), " ".join(["ab"] * 20), items[0] + " q " + items[1], "nothing"]

    def plain(text):
        w, found = text.split(), []
        for i, item in enumerate(words):
            for s in range(len(item)):
                for p in range(len(w)):
                    n = 0
                    while s + n < len(item) and p + n < len(w) and item[s + n] == w[p + n]:
                        n += 1
                    if n >= min(10, len(item)):
                        found.append((-n, i, s, p))
        return (lambda b: (b[1], b[2], b[3], -b[0]))(min(found)) if found else None

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1)
    got = {r.doc_id: r._longest and tuple(r._longest) for r in decontamination.scan(docs, bench).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_scores_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_spans_are_code_points(spark):
    text = "é" * 5 + " Secret: " + "aB3" * 5 + " and " + "0123456789abcdef" * 2 + " AKIA" + "Z9" * 8
    r = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = f"assign:6:{6 + len('Secret: ') + 15},hex:{text.index('0123')}:{text.index('0123') + 32},access:{text.index('AKIA')}:{len(text)}"
    assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    assert F is not None


def test_long_benchmark_item(spark):
    """Memory grows with the words of an item, not with their square; repeated words are sorted in few rounds."""
    words = [f"q{i * 7919 % 5003}" for i in range(20_000)]
    same = ["na"] * 20_000
    docs = [(1, "x " + " ".join(words) + " y"), (2, " ".join(words[5_000:17_000])), (3, " ".join(same[:15_000])), (4, "na na"), (5, " ".join(words[19_995:] + words[:9]))]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(same)), (3, "short")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.digest(decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), bench)).collect()}
    assert [(got[i].n_hit, got[i].longest_words, got[i].longest_item, got[i].longest_item_place, got[i].longest_place) for i in range(1, 6)] == [
        (20_000, 20_000, 1, 0, 1), (12_000, 12_000, 1, 5_000, 0), (15_000, 15_000, 2, 0, 0), (0, None, None, None, None), (0, None, None, None, None),
    ]
    made = decontamination.Benchmark([(1, " ".join(words)), (2, " ".join(same))])
    assert sum(x.nbytes for x in vars(made).values() if hasattr(x, "nbytes")) < 200 * (len(words) + len(same))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], ROWS], ids=["empty", "nulls", "all"])
def test_pipeline_of_edges(spark, rows):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "shards":
            assert got.columns == docs.columns
            docs = shared.written(got)
    got = got.collect()
    assert (len(got) == 0) == (len(rows) < 2) and Counter(r.shard for r in got).keys() <= set(range(16))


def test_a_cluster_must_name_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_written_tables_can_be_deleted(spark):
    t = shared.written(spark.range(5))
    assert t.count() == 5
    shared.deleted(t, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 3), (200, 200)]
    got = {r.v: r.c for r in components.components(spark.createDataFrame(links * 2, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_joins_that_split_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAVY_ROWS", 3)
    rows = spark.createDataFrame([(k if k < 5 else 5, k) for k in range(50)] + [(None, 99)], "v long, x long")
    table = shared.written(rows.where("v > 0").groupBy("v").agg(F.count("*").alias("n")))
    got = shared.split_join(rows, table, "v", "n", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "v", "left").collect()))
    assert sorted(map(str, shared.split_join(rows, table, "v", "n").collect())) == sorted(map(str, rows.join(table, "v").collect()))


def test_pivots_cut_evenly(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    df = np.concatenate([np.full(6000, 2), rng.integers(3, 5000, 4000)])
    h = rng.integers(0, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2)
    v = np.stack([h, df.astype(np.uint64)], 1).tobytes()
    cuts = jaccard.pivots(spark.createDataFrame([(0, bytearray(v))], "b int, v binary"))
    step = jaccard.steps(df)
    fragment = sum(((step > x) | ((step == x) & (h >= np.uint64(y)))).astype(int) for x, y in cuts)
    assert len(cuts) == jaccard.FRAGMENTS - 1 and np.bincount(fragment).min() > 2300


def test_many_languages_and_a_very_long_text(spark, monkeypatch):
    """300 languages are all learned, more than the bound are an error, a count beyond 16 bits stays what it is."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: letters[k // 26] + letters[k % 26]
    rows = [(i, f"{name(k)} {name(k) * 3} {name(k)}x{name(k)} " * 6, f"l{k}", None) for k in range(300) for i in range(k * 8, k * 8 + 8)]
    docs = frame(spark, rows)
    model = language.fit(docs)
    assert len(model.languages) == 300 and set(model.owner) == set(range(300))
    got = language.predict(docs.select("doc_id", "text", "lang"), model).collect()
    assert sum(r._lang == r.lang for r in got) > 0.98 * len(got)
    monkeypatch.setattr(language, "LANGUAGES", 299)
    with pytest.raises(ValueError, match="more than 299 languages"):
        language.fit(docs)
    monkeypatch.undo()
    many = [(i, "e" * 70_000 + " a" * n, "aa" if n else "bb", None) for i, n in enumerate([80_000] * 8 + [0] * 8)]
    texts = [r[1] for r in many]
    tf = next(language.counts(*language.lowered(pa.array(texts[:1]))))[1]
    assert tf.max() > 65_535
    assert language.fit(frame(spark, many)).centroids.shape[0] >= 2
