"""Substring dedup: recurring phrases confirmed by counting, located by Aho-Corasick automata, and passages removed.

Each window of 50 words is represented by its phrase of 16 words with the smallest hash (a minimizer), so two equal
windows share a phrase. Phrases whose hash stands in two different texts recur. One text of each, the first to hold it, tells the
phrase's words; these go, without places, to the texts that hold it. Each task compiles automata over the phrases that came for its documents,
a bounded number in each, and streams the documents through: where a phrase stands is known from the automata alone. Windows whose
minimizer was found there are counted by a 128-bit hash, and those that a smaller doc_id holds are cut out. Whole texts are shuffled compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, pieces, stored, unpacked, utf8, whole_row

WINDOW, PHRASE = 50, 16
#: Phrases of one automaton at most, documents that share automata, words whose hashes a task remembers.
SHARD_PHRASES, SHARD_DOCS, MEMO = 8192, 128, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)))) if n else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _over(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over each run of width values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def _phrases(hashes: np.ndarray, phrase: int = PHRASE) -> np.ndarray:
    """Hash of each phrase, the same wherever it stands. hashes: of the words, uint64, at least phrase of them."""
    n = len(hashes)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)))
    return _mixed((sums[phrase:] - sums[:-phrase]) * _powers(_BACK, n - phrase + 1))


def anchors(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the phrases that are the smallest of some window; of equal phrases in a window each one. hashes: of the words, uint64."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    phrases = _phrases(hashes, phrase)
    wide = window - phrase + 1
    least = _over(phrases, wide, np.minimum)
    edge = np.zeros(wide - 1, np.uint64)
    chosen = np.flatnonzero(_over(np.concatenate((edge, least, edge)), wide, np.maximum) == phrases)
    return chosen, phrases[chosen]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's minimizers, every one once, with the first place of it."""
    memo = _Hashes()
    for part in pieces(batches):
        at, value, ends = [], [], [0]
        for text in utf8(part.column(2)):
            words = text.split()
            spots, hashes = anchors(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))) if len(words) >= WINDOW else ((), np.zeros(0, np.uint64))
            each, first = np.unique(hashes, return_index=True)
            at.append(np.asarray(spots, np.int32)[first])
            value.append(each.view(np.int64))
            ends.append(ends[-1] + len(each))
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(value)), pa.array(np.concatenate(at))], ["phrase", "at"])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["key", "doc_id", "anchors"])


def _padded(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """The words of a text, a space around each, and where the spaces are."""
    padded = b" " + b" ".join((text or b"").split()) + b" "
    return padded, np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)


def _told(batches: Iterator[pa.RecordBatch], size: int = PHRASE) -> Iterator[pa.RecordBatch]:
    """Rows (phrase, words): the words of the phrases that each text is to tell, a space around each word. Columns: packed, told (phrase, at)."""
    for part in pieces(batches):
        phrases, words = [], []
        for text, told in zip(unpacked(part.column(0)), part.column(1).to_pylist(), strict=True):
            padded, spaces = _padded(text)
            phrases += [x["phrase"] for x in told]
            words += [padded[spaces[x["at"]] : spaces[x["at"] + size] + 1] for x in told]
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.int64()), pa.array(words, pa.binary())], ["phrase", "words"])


def located(texts: list[bytes], phrases: list[list[bytes]], size: int = PHRASE) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """(text, first words of every phrase found in it, places of the spaces, the words each between two spaces).

    phrases: of size words, a space around each word, one list a text. The phrases of all lists are compiled into automata of at
    most SHARD_PHRASES phrases, and all texts are streamed through each.
    """
    import ahocorasick

    padded, spaces = zip(*map(_padded, texts), strict=True) if texts else ((), ())
    ordered = sorted({x for own in phrases for x in own})
    found: list[list[int]] = [[] for _ in texts]
    plain = [p.decode("latin-1") for p in padded]  # one character a byte
    for lo in range(0, len(ordered), SHARD_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for x in ordered[lo : lo + SHARD_PHRASES]:
            automaton.add_word(x.decode("latin-1"))
        automaton.make_automaton()
        for k, text in enumerate(plain):
            found[k] += [end for end, _ in automaton.iter(text)]
    for k, ends in enumerate(found):
        yield k, np.searchsorted(spaces[k], np.array(sorted(ends), np.int64)) - size, spaces[k], padded[k]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w1, w2, cid, low, start): a window's hash and where it starts, for each window whose minimizer the automata found. Windows that equal one of another text are among them. Columns: cid, low, packed, phrases."""
    from xxhash import xxh3_128_digest

    memo = _Hashes()
    for part in pieces(batches, SHARD_DOCS):
        cid, low = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for k, at, spaces, padded in located(unpacked(part.column(2)), part.column(3).to_pylist()):
            words = padded.split()
            if len(words) < WINDOW or not len(at):
                continue
            phrases = _phrases(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
            recurring = np.full(len(phrases), np.iinfo(np.uint64).max)
            recurring[at] = phrases[at]
            wide = WINDOW - PHRASE + 1
            starts = np.flatnonzero(_over(recurring, wide, np.minimum) == _over(phrases, wide, np.minimum))
            if not len(starts):
                continue
            cuts = map(slice, spaces[starts].tolist(), spaces[starts + WINDOW].tolist())
            digests = np.frombuffer(b"".join(map(xxh3_128_digest, map(padded.__getitem__, cuts))), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])), pa.array(np.full(len(starts), cid[k])), pa.array(np.full(len(starts), low[k])), pa.array(starts.astype(np.int32))], ["w1", "w2", "cid", "low", "start"])


def _key():
    """A text's MD5, so that equal texts are one class."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def repeats(docs: DataFrame) -> DataFrame:
    """(key, low, starts) for every distinct text: key is the text's MD5, low its smallest doc_id, starts the first words of its windows that a document with a doc_id below low holds too.

    Texts are shuffled once, to meet the phrases they are to tell, and those with recurring phrases once more, to meet the words of these.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _key().alias("key"))
    squeezed = keyed.select("doc_id", "key", packed("text").alias("packed"))
    prints = stored(keyed.select("key", "doc_id", "text").mapInArrow(_anchored, "key binary, doc_id bigint, anchors array<struct<phrase:bigint,at:int>>"), "anchors")
    classes = stored(prints.groupBy("key").agg(F.min("doc_id").alias("low")).withColumn("cid", F.monotonically_increasing_id()), "text-classes")
    own_rows = (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("low"))
    spots = prints.where("size(anchors) > 0").join(classes.withColumnRenamed("key", "_key"), own_rows).select("cid", F.explode("anchors").alias("a")).select("cid", "a.*")
    spots = stored(spots, "phrases")
    recurring = spots.groupBy("phrase").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x < y").select("phrase", "x")
    recurring = stored(recurring, "recurring")  # a plain side of the join, so that AQE can split a phrase that very many texts hold
    held = spots.join(recurring, "phrase").groupBy("cid", "phrase").agg(F.min(F.when(F.col("cid") == F.col("x"), F.col("at"))).alias("at"))
    held = stored(held, "held-phrases")  # repeated rows count once
    told = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("phrase", "at"))).alias("told")
    holders = held.groupBy("cid").agg(told).join(classes, "cid").select(F.col("key").alias("_key"), "cid", "low", "told")
    holders = stored(squeezed.join(holders, own_rows).select("cid", "low", "packed", "told"), "holders")
    words = holders.where("size(told) > 0").select("packed", "told").mapInArrow(_told, "phrase bigint, words binary")
    words = stored(words.groupBy("phrase").agg(F.first("words").alias("words")), "phrase-words")
    asked = held.select("cid", "phrase").join(words, "phrase").groupBy("cid").agg(F.collect_list("words").alias("phrases"))
    met = holders.select("cid", "low", "packed").join(asked, "cid").select("cid", "low", "packed", "phrases")
    windows = stored(met.mapInArrow(_windows, "w1 bigint, w2 bigint, cid bigint, low bigint, start int"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last").drop("last")
    first = stored(first, "first-windows")  # as above
    removed = windows.join(first, ["w1", "w2"]).where("first < low").groupBy("cid").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    return classes.join(removed, "cid", "left").select("key", "low", "starts")


@F.arrow_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
def _cut(texts: pa.Array, starts: pa.Array, copies: pa.Array) -> pa.Array:
    kept, sizes, gone = [], [], []
    for lo in range(0, len(texts), 256):
        part = slice(lo, lo + 256)
        for text, spots, copy in zip(unpacked(texts[part]), starts[part].to_pylist(), copies[part].to_pylist(), strict=True):
            words = (text or b"").split()
            n = len(words)
            if copy and n >= WINDOW:
                out = []
            elif spots:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, spots, 1)
                np.add.at(change, np.array(spots) + WINDOW, -1)
                stay = np.cumsum(change)[:n] == 0
                out = [w for w, x in zip(words, stay.tolist(), strict=True) if x]
            else:
                out = words
            kept.append(b" ".join(out))
            sizes.append(n)
            gone.append(n - len(out))
    text = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([text, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["kept", "n_words", "n_removed"])


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text cut down to the words that stay, joined by single spaces, plus n_words and n_removed.

    A window is WINDOW consecutive words of one document, words being runs of anything but ASCII white space. A word goes if a window over
    it also starts in a document with a smaller doc_id; all windows are judged on the input. Within one
    document nothing is removed. Null texts count as empty; a null doc_id is neither smaller nor larger than others: its
    text stays and removes nothing, unless the same text has a doc_id. Repeated rows are cut alike; an empty table gives an empty result. Columns of docs named n_words or
    n_removed are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed")])
    found = repeats(docs)
    told = docs.select(whole_row(docs, "text").alias("row"), _key().alias("key"), packed("text").alias("packed")).join(found, "key", "left")
    starts = F.when(F.col("row.doc_id").eqNullSafe(F.col("low")), F.col("starts"))
    cut = told.select("row", _cut("packed", starts, F.coalesce(F.col("row.doc_id") > F.col("low"), F.lit(False))).alias("cut"))
    whole = [(F.col("cut.kept") if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    return cut.select(*whole, "cut.n_words", "cut.n_removed")
