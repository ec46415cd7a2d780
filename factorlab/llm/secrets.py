"""Secret scans: patterns for three known formats, and automata learned from the credentials they find.

Grammar inference: statistically compatible states of the credentials' prefix tree are merged into a
probabilistic automaton per kind (automata.py). Every candidate, a credential that a pattern found or a token
of twelve bytes or more, is scored by its likelihood under the automata against that under a model of ordinary
tokens; tokens of a likely format that no pattern covers are reported as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing, shared
from .automata import CHARS, END, SYMBOL, SYMBOLS, Automaton, fitted, smoothed

#: Fixed patterns; letters of the first in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Least lengths: of an assigned value, an access key, a hex run, a token that the automata score.
LEAST = {"assign": 12, "access": 18, "hex": 16, "format": 12}
KINDS = ("assign", "access", "hex", "format")
#: Different credentials a kind that the fit may use (about; chosen by hash), and bytes that one of them may have.
SAMPLE, LONGEST = 2000, 512
#: A token is reported if it is so many times likelier under an automaton than as an ordinary token, and its
#: symbols about as likely as those of the credentials.
ODDS = 1e6
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
#: Bytes of a token; up to two = may follow.
_TOKEN = np.zeros(256, bool)
_TOKEN[list(CHARS)] = True
_TOKEN[list(b".=")] = False


def tokens(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of `least` bytes or more."""
    starts, ends, _ = hashing.words(data, off, ~_TOKEN)
    last = off[np.searchsorted(off, starts, "right")]
    for _ in range(2):
        ends = ends + ((ends < last) & (data[np.minimum(ends, len(data) - 1)] == 61))
    long = ends - starts >= least
    return starts[long], ends[long]


def runs(data: np.ndarray, off: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes inside one text, of `least` bytes or more."""
    starts, ends, _ = hashing.words(data, off, ~members)
    long = ends - starts >= least
    return starts[long], ends[long]


def base(data: np.ndarray, off: np.ndarray) -> tuple[dict[int, list[tuple[int, int, int, bytes]]], bytes]:
    """Per text with any: (start, kind, end, credential) of the pattern matches, as places in all the bytes."""
    own, low = data.tobytes(), hashing.LOWER[data].tobytes()
    found: dict[int, list[tuple[int, int, int, bytes]]] = {}

    def texts(where: bytes, *words: bytes) -> set[int]:
        at = []
        for w in words:
            p = where.find(w)
            while p >= 0:
                at.append(p)
                p = where.find(w, p + len(w))
        return set((np.searchsorted(off, at, "right") - 1).tolist()) if at else set()

    for kind, pattern, group, where, keys in ((0, ASSIGN, 2, low, (b"passw", b"secret", b"token", b"key")), (1, ACCESS, 0, own, (b"AKIA",))):
        for d in texts(where, *keys):
            for m in pattern.finditer(own, int(off[d]), int(off[d + 1])):
                if m.end(group) - m.start(group) >= LEAST[KINDS[kind]]:
                    found.setdefault(d, []).append((m.start(), kind, m.end(), m[group]))
    for s, e in zip(*runs(data, off, _HEX, LEAST["hex"]), strict=True):
        found.setdefault(int(np.searchsorted(off, s, "right") - 1), []).append((int(s), 2, int(e), own[s:e]))
    return found, own


@dataclass
class Model:
    automata: dict[str, Automaton]
    ordinary: np.ndarray  # log probability of a symbol after another in tokens that are no credentials

    def judged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: the logarithm of how much likelier it is under the best automaton than as an ordinary
        token (0 if nothing was learned), and whether it is of a likely format."""
        ratio, likely = np.full(len(starts), -np.inf), np.zeros(len(starts), bool)
        if not len(starts) or not self.automata:
            return np.zeros(len(starts)), likely
        s = SYMBOL[data]
        sums = np.concatenate([[0.0], np.cumsum(self.ordinary[s[:-1], s[1:]])])
        usual = self.ordinary[END, s[starts]] + sums[ends - 1] - sums[starts] + self.ordinary[s[ends - 1], END]
        for a in self.automata.values():
            own = a.scores(s, starts, ends)
            ratio = np.maximum(ratio, own - usual)
            likely |= (own - usual >= np.log(ODDS)) & (own >= a.least * (ends - starts + 1))
        return ratio, likely


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Automata from the credentials that the patterns find, of each kind a bounded sample of the different ones,
    and the symbol pairs of all other tokens, counted over all texts.

    Repeated rows count again as ordinary tokens, not as credentials. Null and empty texts and an empty table teach
    nothing; credentials of more than LONGEST bytes have no format to learn and are left out. Only the text is read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in batches:
            data, off = hashing.flat(b.column("t"))
            rows: set[tuple[str, str]] = set()
            for i, j in hashing.slices(off):
                own, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                found, _ = base(own, o)
                rows |= {(KINDS[k], v.decode()) for x in found.values() for _, k, _, v in x if len(v) <= LONGEST}
                s, e = tokens(own, o, LEAST["format"])
                inside = spans(found, len(own))
                other = inside[e] == inside[s]
                s, e = s[other], e[other]
                a = SYMBOL[own[hashing.spread(s, e - s)]].astype(np.int64)
                first = np.cumsum(e - s) - (e - s)
                before = np.roll(a, 1)
                before[first] = END
                pairs += np.bincount(before * SYMBOLS + a, minlength=len(pairs))
                pairs += np.bincount(a[first + (e - s) - 1] * SYMBOLS + END, minlength=len(pairs))
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string()), pa.array([1] * len(rows), pa.int64())], ["kind", "value", "n"])
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(at), pa.string()), pa.array(list(map(str, at.tolist())), pa.string()), pa.array(pairs[at])], ["kind", "value", "n"])

    seen = shared.columns(docs, t=text).mapInArrow(work, "kind string, value string, n long")
    seen = shared.written(seen.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    pairs = np.zeros(SYMBOLS * SYMBOLS)
    for r in seen.where(F.col("kind") == "pair").collect():  # a row a pair of symbols
        pairs[int(r["value"])] = r["n"]
    credentials = seen.where(F.col("kind") != "pair")
    n = {r["kind"]: r["count"] for r in credentials.groupBy("kind").count().collect()}
    got: dict[str, list[bytes]] = {k: [] for k in n}
    if n:
        share = F.coalesce(*(F.when(F.col("kind") == k, F.lit(int(1e6 * min(1.0, sample / n[k])) + 1)) for k in n))
        for r in credentials.where(F.pmod(F.xxhash64("value"), F.lit(1_000_000)) < share).collect():  # about SAMPLE a kind
            got[r["kind"]].append(r["value"].encode())
    return Model({k: fitted(vs) for k, vs in sorted(got.items()) if vs}, smoothed(pairs.reshape(SYMBOLS, SYMBOLS)))


def spans(found: dict[int, list[tuple[int, int, int, bytes]]], n: int) -> np.ndarray:
    """How many of the bytes before each place lie in a span."""
    edges = np.array([m[:3:2] for x in found.values() for m in x], int).reshape(-1, 2)
    return np.concatenate([[0], np.cumsum(hashing.covered(n, edges[:, 0], edges[:, 1] - edges[:, 0]))])


def scan(docs: DataFrame, *, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with _spans, an array of (start, end, kind, score) in code points by start and kind: the pattern matches,
    and as kind `format` tokens of a likely format that the matches don't cover whole. The score is the logarithm
    of how much likelier the credential is under the automata than as an ordinary token.

    Null and empty texts have no spans, repeated rows the same ones, an empty table no rows. Very long texts are
    scanned whole, and so are very long tokens. Other columns stay; none may be called _spans.
    """
    carried = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text))
    fields = "_spans array<struct<start:int,end:int,kind:string,score:double>>"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(fields).fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = carried.value
        for b in batches:
            data, off = hashing.flat(b.column(text))
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for i, j in hashing.slices(off):
                own, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                found, _ = base(own, o)
                s, e = tokens(own, o, LEAST["format"])
                inside = spans(found, len(own))
                new = inside[e] - inside[s] < e - s
                s, e = s[new], e[new]
                rows = [(d, start, k, end, end - len(v), end) for d, x in found.items() for start, k, end, v in x]  # a credential ends its match
                known = np.array([r[4:] for r in rows], int).reshape(-1, 2)
                ratio, likely = m.judged(own, np.concatenate([known[:, 0], s]), np.concatenate([known[:, 1], e]))
                add = np.flatnonzero(likely[len(rows) :])
                where = np.searchsorted(o, s[add], "right") - 1
                rows = [(*r[:4], x) for r, x in zip(rows, ratio, strict=False)]
                rows += [(d, p, 3, q, x) for d, p, q, x in zip(where.tolist(), s[add].tolist(), e[add].tolist(), ratio[len(known) + add], strict=True)]
                if rows:
                    point = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    for d, p, k, q, x in sorted(rows):
                        out[i + d].append({"start": int(point[p] - point[o[d]]), "end": int(point[q] - point[o[d]]), "kind": KINDS[k], "score": round(float(x), 3)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], schema.names)

    return docs.mapInArrow(work, schema)


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format and scores (of the spans, in their order) of every
    row. Repeated rows, null ids, null, empty and very long texts each have a row; an empty table has none. Other
    columns are not read, whatever their names."""
    found = scan(shared.columns(docs, doc_id=doc_id, text=text), model=model)
    joined = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    number = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    plain = F.filter("_spans", lambda s: s["kind"] != "format")
    scores = F.concat_ws(",", F.transform("_spans", lambda s: F.format_string("%.3f", s["score"])))
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), number("format"), scores.alias("scores"))
