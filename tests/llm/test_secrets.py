"""Formats that the automata learn: planted credentials that no pattern finds, and ordinary tokens."""

import numpy as np
import pytest

from factorlab.llm import automata, secrets

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SYLLABLES = "con ter na tion al ment ing per sub trans form at ive ness able gen er ic log".split()
PROSE = "international responsibility of the administrative organisation and understanding characteristics"
ORDINARY = "compute_partition_size_bytes getElementsByTagNameNS org/apache/hadoop/mapreduce international-standardisation ghp_partition_size_bytes sk_live_environment_names uncharacteristically HTTP_RESPONSE_HEADERS 2024-01-15T10-30-00 path/to/some/module_name".split()


def drawn(rng, chars, n):
    return "".join(rng.choice(list(chars), n))


def made(rng):
    """A long word of the language of the fixture."""
    return "".join(rng.choice(SYLLABLES, rng.integers(4, 9)))


FORMATS = {
    "git": lambda rng: "ghp_" + drawn(rng, ALNUM, 36),
    "pay": lambda rng: "sk_live_" + drawn(rng, ALNUM, 24),
    "key": lambda rng: drawn(rng, ALNUM + "+/", 40),
    "upper": lambda rng: drawn(rng, "0123456789ABCDEF", 32),
}


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(8)
    names, texts = ("token", "api_key", "secret", "password"), []
    for k in range(150):
        texts.append(" ".join(made(rng) for _ in range(20)))
        texts += [f'{PROSE} {names[i]} = "{make(rng)}" {" ".join(rng.choice(ORDINARY, 3))}' for i, make in enumerate(FORMATS.values())]
    return secrets.fit(spark.createDataFrame([(t,) for t in texts * 2], "text string"))


def test_states_tell_places_apart(model):
    assert "assign" in model.automata
    assert len(model.automata["assign"].log) > 40
    for a in model.automata.values():
        assert np.allclose(np.exp(a.log[:-1]).sum(1), 1) and a.to.min() >= 0


@pytest.mark.parametrize("name", FORMATS)
def test_unseen_credentials_are_found(spark, model, name):
    rng = np.random.default_rng(len(name) + 100)
    docs = [(i, f"{PROSE} {FORMATS[name](rng)} {PROSE}") for i in range(100)]
    got = secrets.digest(spark.createDataFrame(docs, "doc_id long, text string"), model=model).collect()
    assert sum(f"format:{len(PROSE) + 1}:{len(docs[r.doc_id][1]) - len(PROSE) - 1}" in r.spans.split(",") for r in got) >= 90


def test_ordinary_tokens_are_left(spark, model):
    rng = np.random.default_rng(77)
    words = [made(rng) for _ in range(1000)]
    got = secrets.digest(spark.createDataFrame([(i, t) for i, t in enumerate(ORDINARY + words)], "doc_id long, text string"), model=model).collect()
    assert sum(r.n_format for r in got) <= 0.01 * len(got)


def test_scores_of_all_candidates(spark, model):
    rng = np.random.default_rng(5)
    git, word = FORMATS["git"](rng), "uncharacteristically"
    r = secrets.digest(spark.createDataFrame([(1, f"token: {git} token: {word} x{git[4:20]}")], "doc_id long, text string"), model=model).first()
    scores = list(map(float, r.scores.split(",")))
    assert r.n_assign == 2 and len(scores) == len(r.spans.split(",")) and scores[0] > np.log(secrets.ODDS) > 0 > scores[1]


def test_token_that_goes_on_after_a_match(spark, model):
    token = "0123456789abcdef" + "ghijKLMNOPqr+/STUVwxYZ12"
    r = secrets.digest(spark.createDataFrame([(1, token)], "doc_id long, text string"), model=model).first()
    assert r.n_hex == 1 and r.spans == "hex:0:16,format:0:40"


def test_long_and_hidden_tokens(spark, model):
    long = "ab+" * 300_000
    rows = [(1, long), (2, None), (3, ""), (3, ""), (None, "é" * 4 + FORMATS["git"](np.random.default_rng(1)) + "==" + "é")]
    got = secrets.digest(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()
    assert len(got) == 5 and [r.spans for r in got if r.doc_id is None] == ["format:4:46"]


def test_automata_of_few_words():
    one = automata.fitted([b"abc"])
    assert automata.log_probability(one, [b"abc"])[0][0] > automata.log_probability(one, [b"abd"])[0][0]
    long = [b"a" * n for n in (3, 127, 128, 129, 500)]
    got = automata.log_probability(automata.inferred(long, 0.05), long)[0]
    assert np.isfinite(got).all()
    assert automata.inferred(long, 0.05).log.tolist() == automata.inferred(long[::-1], 0.05).log.tolist()
