"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Both models are character bigram tables. A token's log-likelihood ratio per character tells how much more likely it is as a
random string; the cut is set on a held-out part of the labelled sample.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

KINDS = ("assign", "access", "hex", "markov")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens that the Markov models judge: no shorter ones, and only such as mix digits and letters or are long.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER, LONG = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), 32
#: Labelled tokens that a fit reads at most from a table: those with the smallest hash.
FIT_TOKENS = 50_000
#: Random strings made for training.
FIT_RANDOM = 4_000
SMOOTH = 0.5

_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef")
#: Parts of ordinary identifiers, joined in the ways that code and links join them.
_PARTS = "get set user name file path http https www index page item value list map node data base test main config build version release error count total first last next order date time table column row key id type size max min update create delete load save read write open close start stop init run parse format string number array object class method function return".split()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, code points, end exclusive: leftmost non-overlapping per kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def samples(seed: int = 7, n: int = FIT_RANDOM) -> list[tuple[str, int]]:
    """Labelled tokens (text, 1 for random): n random strings over usual key alphabets and n identifiers put together from ordinary parts."""
    draw = random.Random(seed)
    made = [("".join(draw.choices(draw.choice(_ALPHABETS), k=draw.randint(16, 48))), 1) for _ in range(n)]
    for _ in range(n):
        parts = [draw.choice(_PARTS) for _ in range(draw.randint(3, 6))]
        style = draw.randrange(4)
        name = "".join(p.title() for p in parts) if style == 0 else "_-/"[style - 1].join(parts)
        made.append((name + draw.choice(("", "", str(draw.randrange(100)), "_" + str(draw.randrange(1900, 2030)))), 0))
    return made


def _counts(tokens: list[str]) -> np.ndarray:
    out = np.zeros((128, 128))
    for token in tokens:
        chars = np.frombuffer(token.encode("ascii", "ignore"), np.uint8)
        np.add.at(out, (chars[:-1], chars[1:]), 1)
    return out


@dataclass
class Model:
    """ratio[a, b]: log of how much likelier b after a is in random strings; cut: the mean ratio from which a token counts as random."""

    ratio: np.ndarray
    cut: float

    def score(self, token: str) -> float:
        chars = np.frombuffer(token.encode("ascii", "ignore"), np.uint8)
        return float(self.ratio[chars[:-1], chars[1:]].mean()) if len(chars) > 1 else 0.0

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans of a text: the fixed patterns' and, where they don't overlap those, random tokens. Sorted by start, then kind."""
        base = sorted(base_spans(text))
        more, at = [], 0
        for m in TOKEN.finditer(text):
            s, e = m.span()
            while at < len(base) and base[at][1] <= s:  # ends before this token and all later ones
                at += 1
            if (e - s >= LONG or DIGIT.search(text, s, e)) and LETTER.search(text, s, e) and not (at < len(base) and base[at][0] < e) and self.score(m[0]) > self.cut:
                more.append((s, e, "markov"))
        return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def fit(counts: np.ndarray, labelled: list[tuple[str, int]]) -> Model:
    """counts: bigrams of ordinary text to add to those of the labelled tokens. Every fourth token is held out to set the cut, half-way between the highest ordinary and the lowest random scores' extremes (the 1 % quantiles)."""
    kept = [x for k, x in enumerate(labelled) if k % 4]
    chars = [np.log((c + SMOOTH) / (c + SMOOTH).sum(axis=1, keepdims=True)) for c in (_counts([t for t, y in kept if y]), _counts([t for t, y in kept if not y]) + counts)]
    model = Model(chars[0] - chars[1], 0.0)
    held = [(model.score(t), y) for t, y in labelled[::4]]
    low, high = (np.array([s for s, y in held if y == k]) for k in (0, 1))
    if len(low) and len(high):
        model.cut = max(0.1, (float(np.quantile(low, 0.99)) + float(np.quantile(high, 0.01))) / 2)
    return model


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigram counts of the ordinary words of documents: runs of letters that no fixed pattern covers."""
    total = np.zeros((128, 128), np.int64)
    for part in pieces(batches):
        for text in part.column(0).to_pylist():
            plain = text or ""
            for s, e, _ in sorted(base_spans(plain), reverse=True):
                plain = plain[:s] + " " + plain[e:]
            chars = np.frombuffer(plain.encode("ascii", "replace"), np.uint8).astype(np.int64)
            letter = ((chars | 32) >= 97) & ((chars | 32) <= 122)
            both = np.flatnonzero(letter[:-1] & letter[1:])
            total += np.bincount(chars[both] * 128 + chars[both + 1], minlength=128 * 128).reshape(128, 128)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["pair", "n"])


def train(docs: DataFrame, labelled: DataFrame | list[tuple[str, int]] | None = None) -> Model:
    """Models from labelled tokens and the ordinary words of all documents. The bigram sums, 16,384 rows at most, are added up on the executors.

    labelled: a table (token, label), of which at most FIT_TOKENS rows are read, or a list; label 1 is random, null tokens and labels are left aside; samples() if none are given.
    """
    if isinstance(labelled, DataFrame):
        told = labelled.select("token", "label").dropna().orderBy(F.xxhash64("token"), "token", "label").limit(FIT_TOKENS)
        labelled = [(r["token"], int(r["label"])) for r in told.collect()]
    rows = docs.select("text").mapInArrow(_bigrams, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(128 * 128)
    for r in rows:
        counts[r["pair"]] = r["n"]
    # ordinary words weigh as much as the made identifiers
    labelled = samples() if labelled is None else labelled
    scale = sum(len(t) for t, y in labelled if not y) / max(1.0, counts.sum())
    return fit(counts.reshape(128, 128) * min(1.0, scale), labelled)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans) for every row of docs; spans: array of (start, end, kind) in code points, end exclusive, by start, then kind in the order of KINDS.

    Null texts count as empty and have no spans; very long texts are read whole; repeated rows get equal spans; an empty table gives an empty result; other columns are ignored.
    """
    known = model or train(docs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in known.spans(x or "")] for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by [kind]; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with the secrets in text masked and n_chars, if there, counted anew.

    Null texts stay null and empty ones empty; very long texts are masked whole; repeated rows are masked alike; an empty table gives an empty
    result; all other columns, a null doc_id among them, stay as they are.
    """
    known = model or train(docs)

    @F.arrow_udf(T.StringType())
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if x is None else masked(x, known.spans(x)) for x in batch.to_pylist()], pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)
