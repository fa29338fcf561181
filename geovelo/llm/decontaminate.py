"""Benchmark decontamination: a BM25 inverted index of test items with block maxima, queried by every training passage.

Postings are sparse: each term has the entries that hold it, cut into blocks with their greatest impact. A passage's terms are taken in the order of their
greatest impact anywhere; before the pivot their sums stay well below the threshold, so no entry can get there by these terms alone and only blocks of the terms from the pivot on are
opened. A block is scored only if its own maxima reach the threshold (block-max WAND). Impacts are shares of an entry's own threshold, which is set so that no item is lost
that the check would confirm: the entry's score less the largest impacts of as many terms as may be lacking. An entry for which that is
too little to tell is indexed by its five-word shingles instead of its words. What is retrieved is verified by the item's five-word shingles, its question and its answer apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

K1, B = 1.2, 0.75
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
#: Words of a passage's half, words of an indexed entry at most: an entry's copy with up to 17 words put in still lies in one passage.
HALF, ENTRY = 64, 48
BLOCK = 8
#: Share of its own score below which an entry's threshold is too low for words, and it is indexed by shingles.
FLOOR = 0.3
#: Share of the threshold that the terms before the pivot may reach together; they open no blocks. The lower, the more blocks are opened and the fewer scored.
PIVOT = 0.4
#: Words of one index, some 50 bytes each. A larger benchmark is cut into several indexes, each of which all passages query.
INDEX_WORDS = 16_000_000
_EPS = 1e-6

_PLAIN = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def shingles(found: list[bytes], size: int = SHINGLE) -> set[bytes]:
    """The runs of size words; a shorter text is one shingle, a wordless one has none."""
    return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def halves(text: str) -> tuple[str, str]:
    """An item's question and answer: cut after the first question mark, else at the first line break; without either all of it is the question."""
    for mark in ("?", "\n"):
        head, found, tail = text.partition(mark)
        if found and tail.strip() and head.strip():
            return head, tail
    return text, ""


class _Runs:
    """Rows of arrays one after the other: row k is flat[ends[k]:ends[k + 1]]."""

    def __init__(self, rows: list):
        self.ends = np.cumsum([0, *map(len, rows)])
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]


def _hashed(found: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.sort(np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)))


def _runs(found: list[bytes]) -> list[bytes]:
    """All five-word shingles, repeats included."""
    return [b" ".join(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))] if found else []


class Index:
    """Inverted index with block maxima, in flat arrays: by term the blocks that hold it, by those the entries."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        told = sorted(((i, t or "") for i, t in items if words(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = [i for i, _ in told]
        parts = [[words(part) for part in halves(t)] for _, t in told]
        self.lengths = np.array([[len(w) for w in both] for both in parts], np.int64).reshape(-1, 2)
        self.whole, self.question, self.answer = _Runs([_hashed(shingles(words(t))) for _, t in told]), _Runs([_hashed(shingles(q)) for q, _ in parts]), _Runs([_hashed(shingles(a)) for _, a in parts])
        entries: list[tuple[int, list[bytes], int]] = []  # item, words, missing words from which on another entry of the item holds more
        for k, both in enumerate(parts):
            every = [w for part in both for w in part]
            often = Counter(_runs(words(told[k][1])))
            lacking = sum(n for _, n in often.most_common(int((1 - OVERLAP) * len(often) + 1e-9)))
            pieces_ = -(-len(every) // ENTRY)
            cuts = [len(every) * j // pieces_ for j in range(pieces_ + 1)]
            entries += [(k, every[lo:hi], lacking * (hi - lo) // len(every)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        counts = [Counter(w) for _, w, _ in entries]
        own, self.share = self._weigh(counts, [n for *_, n in entries])
        weak = np.flatnonzero(self.share < FLOOR)
        self.grams = len(weak) > 0
        if self.grams:
            runs = {k: Counter(_runs(entries[k][1])) for k in weak.tolist()}
            lacking = [-(-entries[k][2] * runs[k].total() // max(1, runs[k].total() - SHINGLE + 1)) for k in runs]
            again, share = self._weigh(list(runs.values()), lacking)
            for k, terms, x in zip(runs, again, share, strict=True):
                own[k], self.share[k] = terms, x
        order = sorted(range(len(entries)), key=lambda k: sorted(hash_ for hash_ in _hashed(set(own[k]))[:2].tolist()))  # alike entries share blocks, whose maxima stay low
        self.owner, self.share = np.array([entries[k][0] for k in order], np.int64), self.share[order]
        self._post([own[k] for k in order])

    @staticmethod
    def _weigh(counts: list[Counter], lacking: list[int]) -> tuple[list[dict[bytes, float]], np.ndarray]:
        """BM25 impacts of each entry's terms as shares of its threshold, and the thresholds as shares of the entries' own scores."""
        df = Counter(t for e in counts for t in e)
        n, mean = len(counts), np.mean([e.total() for e in counts]) if counts else 1.0
        told, share = [], np.ones(n)
        for k, (e, gone) in enumerate(zip(counts, lacking, strict=True)):
            norm = K1 * (1 - B + B * e.total() / mean)
            own = {t: float(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) * f * (K1 + 1) / (f + norm) for t, f in e.items()}
            total = sum(own.values())
            share[k] = max(1e-6, 1 - sum(sorted(own.values(), reverse=True)[:gone]) / total)
            told.append({t: x / (share[k] * total) for t, x in own.items()})
        return told, share

    def _post(self, own: list[dict[bytes, float]]) -> None:
        top: dict[bytes, float] = {}
        for terms in own:
            for t, x in terms.items():
                top[t] = max(x, top.get(t, 0.0))
        # terms are numbered by their greatest impact, so that a passage's sorted terms are in the pivot's order
        self.terms = {t: k for k, t in enumerate(sorted(top, key=lambda t: (top[t], t)))}
        self.top = np.array(sorted(top.values()))
        self.blocks = max(1, -(-len(own) // BLOCK))
        size = sum(map(len, own))
        term = np.fromiter((self.terms[t] for terms in own for t in terms), np.int64, size)
        entry = np.repeat(np.arange(len(own)), [len(terms) for terms in own])
        impact = np.fromiter((x for terms in own for x in terms.values()), float, size)
        by = np.lexsort((entry, term))
        term, self.entry, self.impact = term[by], entry[by].astype(np.int32), impact[by]
        key = term * self.blocks + self.entry // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if size else np.zeros(0, np.int64)
        self.key, self.posted = key[first], np.append(first, size)  # (term, block), and where its postings begin
        self.most = np.maximum.reduceat(self.impact, first) if size else np.zeros(0)
        self.opened = np.searchsorted(self.key, np.arange(len(self.terms) + 1) * self.blocks)  # where a term's blocks begin

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays, and about as many as the terms take."""
        arrays = (self.entry, self.impact, self.key, self.posted, self.most, self.opened, self.top, self.owner, self.share, *(x for r in (self.whole, self.question, self.answer) for x in (r.flat, r.ends)))
        return sum(x.nbytes for x in arrays) + sum(len(t) + 120 for t in self.terms)

    def _ids(self, told: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(position over all texts, term) of every known word and, where entries have them, shingle."""
        unknown = -1
        ids = np.concatenate([np.fromiter(map(self.terms.get, w, repeat(unknown)), np.int64, len(w)) for w in told])
        at = np.flatnonzero(ids >= 0)
        if not self.grams:
            return at, ids[at]
        first = np.cumsum([0, *map(len, told)])
        runs = [(first[d] + i, self.terms.get(x, unknown)) for d, w in enumerate(told) for i, x in enumerate(_runs(w))]
        more = np.array([x for x in runs if x[1] >= 0], np.int64).reshape(-1, 2)
        return np.concatenate((at, more[:, 0])), np.concatenate((ids[at], more[:, 1]))

    def hits(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text, by item position: share of the item's BM25 score, question overlap, answer overlap."""
        told = [words(t) for t in texts]
        sizes = np.array([len(w) for w in told], np.int64)
        out: list[dict] = [{} for _ in texts]
        if not sizes.sum() or not self.ids:
            return out
        at, term = self._ids(told)
        # half-passages are numbered on from text to text; a passage has the number of its first half
        per = np.maximum(1, -(-sizes // HALF))
        first, text = np.cumsum(per) - per, np.repeat(np.arange(len(texts)), sizes)
        start = np.cumsum(sizes) - sizes
        half = first[text[at]] + (at - start[text[at]]) // HALF
        last = np.zeros(int(per.sum()), bool)
        last[(first + per - 1)[per > 1]] = True
        behind = half > first[text[at]]
        keys = np.concatenate(((half * len(self.terms) + term)[~last[half]], ((half - 1) * len(self.terms) + term)[behind]))
        keys = _distinct(keys)
        if not len(keys):
            return out
        of = np.repeat(np.arange(len(texts)), per)
        seen: list[dict] = [{} for _ in texts]  # shingles of passages and their surroundings
        for passage, entry, score in self._retrieve(keys // len(self.terms), keys % len(self.terms)):
            d = int(of[passage])
            self._verify(int(self.owner[entry]), told[d], int(passage - first[d]) * HALF, score * float(self.share[entry]), out[d], seen[d])
        return out

    def _retrieve(self, at: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, entry, score) of every entry that reaches its threshold. at, term: the passages' distinct terms, in order."""
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(begin[1:], len(at))
        upto = np.cumsum(self.top[term])
        before = (upto - self.top[term])[begin]
        number = np.repeat(np.arange(len(begin)), ends - begin)
        pivot = upto - before[number] >= PIVOT  # these terms are at or behind their passage's pivot
        rows = np.flatnonzero(pivot)
        reach = np.zeros(len(begin))  # greatest sum of the terms before the pivot
        np.maximum.at(reach, number[~pivot], (upto - before[number])[~pivot])
        many = self.opened[term[rows] + 1] - self.opened[term[rows]]
        upto_rows, changes = np.cumsum(many), np.flatnonzero(np.diff(number[rows], append=-1)) + 1
        lo = 0
        while lo < len(rows):  # whole passages, some millions of blocks at a time
            full = int(np.searchsorted(upto_rows, (upto_rows[lo - 1] if lo else 0) + (1 << 21)))
            hi = int(changes[np.searchsorted(changes, max(lo + 1, full))]) if full < len(rows) else len(rows)
            part = rows[lo:hi]
            blocks = _ranges(self.opened[term[part]], many[lo:hi])
            key = np.repeat(number[part], many[lo:hi]) * self.blocks + self.key[blocks] % self.blocks
            by = np.argsort(key, kind="stable")
            key = key[by]
            lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            bound = np.add.reduceat(self.most[blocks[by]], lead) + reach[key[lead] // self.blocks]
            yield from self._score(key[lead][bound >= 1 - _EPS], begin, ends, at, term)
            lo = hi

    def _score(self, pairs: np.ndarray, begin: np.ndarray, ends: np.ndarray, at: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Exact scores of the entries in the blocks of pairs (passage number * blocks + block) whose maxima reach the threshold."""
        for lo in range(0, len(pairs), 8192):
            number, block = pairs[lo : lo + 8192] // self.blocks, pairs[lo : lo + 8192] % self.blocks
            length = ends[number] - begin[number]
            key = term[_ranges(begin[number], length)] * self.blocks + np.repeat(block, length)
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            held = self.key[spot] == key
            pair, spot = np.repeat(np.arange(len(number)), length)[held], spot[held]
            good = np.bincount(pair, self.most[spot], len(number)) >= 1 - _EPS
            pair, spot = pair[good[pair]], spot[good[pair]]
            many = self.posted[spot + 1] - self.posted[spot]
            posting = _ranges(self.posted[spot], many)
            cell = np.repeat(pair, many) * BLOCK + self.entry[posting] % BLOCK
            score = np.bincount(cell, self.impact[posting], len(number) * BLOCK)
            for x in np.flatnonzero(score >= 1 - _EPS).tolist():
                yield int(at[begin[number[x // BLOCK]]]), int(block[x // BLOCK]) * BLOCK + x % BLOCK, float(score[x])

    def _verify(self, k: int, told: list[bytes], at: int, score: float, found: dict, seen: dict) -> None:
        if k in found and score < found[k][0]:
            return
        reach = int(self.lengths[k].sum())
        near = told[max(0, at - reach) : at + 2 * HALF + reach]
        if (at, reach) not in seen:
            seen[at, reach] = _hashed(shingles(near))
        there, whole = seen[at, reach], self.whole[k]
        if np.isin(whole, there).sum() < OVERLAP * len(whole):
            return
        shares = []
        for n, own in zip(self.lengths[k].tolist(), (self.question[k], self.answer[k]), strict=True):
            held = np.isin(own, _hashed(shingles(near, n)) if 0 < n < SHINGLE else there)
            shares.append(float(held.mean()) if len(own) else 1.0)
        if min(shares) >= PART_OVERLAP:
            found[k] = (min(1.0, score), *shares)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, length of them, one after the other."""
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


def indexes(benchmark: DataFrame) -> list:
    """Broadcast indexes of about INDEX_WORDS words each at most, over all rows of benchmark (item_id, text) whose text has words, null item_ids among them. Repeated rows count once."""
    spark: SparkSession = benchmark.sparkSession
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    n = max(1, -(-total // INDEX_WORDS))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in dealt.where(F.col("part") == k).collect()])) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each document and each test item found in it.

    A passage of two half-passages queries the index wherever it stands in the text. An item counts if the passage and as many words around it as the item has hold
    OVERLAP of the item's five-word shingles and PART_OVERLAP of those of the question and of the answer alike (a part of fewer words is one shingle); copies
    with up to 17 words put into any 48 are retrieved without fail. Null and empty texts hold nothing, very long texts are searched whole, items
    without words are never found, repeated rows give one result, of equal finds the highest score stays; items with a null item_id are found like others. An empty table on either side gives an
    empty result; other columns are ignored.
    """
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    found = [_search(docs, index, schema) for index in indexes(benchmark)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _search(docs: DataFrame, index, schema: str) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for part in pieces(batches):
            ids = part.column(0).to_pylist()
            rows = [(ids[d], own.ids[k], *x) for d, hits in enumerate(own.hits(part.column(1).to_pylist())) for k, x in hits.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap"), r, strict=True)) for r in rows], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(search, schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "question_overlap", "answer_overlap"))])


def _free_of(index):
    """A column function: text -> whether none of the index's items is in it."""

    @F.arrow_udf(T.BooleanType())
    def free(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([not hits for at in range(0, len(batch), 256) for hits in index.value.hits(batch[at : at + 256].to_pylist())], pa.bool_())

    return free


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no test item is found, as contaminated() finds them, all columns unchanged.

    Rows with null or empty texts stay; repeated rows stay or go together, whatever their doc_id; an empty benchmark keeps all rows.
    """
    for index in indexes(benchmark):
        docs = docs.where(_free_of(index)("text"))
    return docs
