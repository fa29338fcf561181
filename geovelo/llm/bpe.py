"""BPE encoding and decoding by a pair occurrence index.

The words that a task meets for the first time are laid out in one array of symbols. Each pair of neighbouring symbols that
has a rank is mapped to all positions where it stands; ranks are applied in ascending order, each at all its positions, and only
the lists of the pairs that a merge makes anew are updated. Texts are cut at white space first, so a word that a task has
met is looked up; documents never leave their task and nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

#: White space as the tokenizer file's patterns see it (Unicode's White_Space); nothing is composed, cased or merged across it.
_CHUNK = re.compile(r"[^\t-\r \x85\xa0  -     　]+")
_PRINTABLE = re.compile("[!-~]+")
#: Characters of the chunks that a task remembers; beyond it starts anew, which costs time and changes nothing.
REMEMBERED = 5_000_000
#: Symbols in one index, unless a single word is longer.
SYMBOLS = 1_500_000
#: Rows, and characters, of texts that are looked at together for new chunks, unless a single text is longer.
ROWS, CHARS = 4096, 10_000_000
#: Bytes of a tokenizer file at most, since it goes to every task.
FILE_BYTES = 64 << 20
_BITS = 32


class PairIndex:
    """Merges over many words at once. ranks: (left, right) -> (rank, merged), ranks from 0 without gaps."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        table = np.array([(a, b, rank, made) for (a, b), (rank, made) in ranks.items()], np.int64).reshape(-1, 4)
        by_rank = table[np.argsort(table[:, 2])]
        self.left, self.right, self.made = by_rank[:, 0].copy(), by_rank[:, 1].copy(), by_rank[:, 3].copy()
        keys = (self.left << _BITS) | self.right
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order
        # where every symbol is made by one merge that comes before those that use it, a merge can't bring about a pair of a lower rank
        first = {int(m): k for k, m in enumerate(self.made)}
        used = zip(self.left.tolist(), self.right.tolist())
        self.ordered = len(first) == len(self.made) and all(first.get(a, -1) < k and first.get(b, -1) < k for k, (a, b) in enumerate(used))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        if not len(self._keys):
            return np.full(len(left), -1)
        keys = (left << _BITS) | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], -1)

    def merge(self, sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, ends) of the words after all merges that apply: always the lowest rank that a word holds, its leftmost place first. ends: where each word ends in sym."""
        sym, n = sym.astype(np.int64), len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = ends[np.diff(ends, prepend=0) > 0]
        after[full - 1] = -1
        before[np.concatenate(([0], full[:-1]))[: len(full)]] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(starts: np.ndarray) -> int:
            """Enters the pairs that start there; the lowest of their ranks."""
            ranks = self._rank(sym[starts], sym[after[starts]])
            starts, ranks = starts[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return n + len(self.made)
            order = np.argsort(ranks, kind="stable")
            starts, ranks = starts[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            lo = 0
            for hi in (*cuts.tolist(), len(ranks)):
                rank = int(ranks[lo])
                if rank in places:
                    places[rank].append(starts[lo:hi])
                else:
                    places[rank] = [starts[lo:hi]]
                    heappush(active, rank)
                lo = hi
            return int(ranks[0])

        put(np.flatnonzero(after >= 0))
        heapify(active)
        while active:
            rank = heappop(active)
            lists = places.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right = self.left[rank], self.right[rank]
            while len(at):
                # with ranks out of order one place at a time, since what it brings about may come before the next
                some, at = (at, at[:0]) if self.ordered else (at[:1], at[1:])
                # a place counts only while the pair still stands there
                nxt = after[some]
                stands = (sym[some] == left) & (nxt >= 0) & (sym[nxt] == right)
                some, nxt = some[stands], nxt[stands]
                if left == right and len(some) > 1:
                    # of overlapping places every other one, from the left of each run
                    k = np.arange(len(some))
                    begins = np.concatenate(([True], nxt[:-1] != some[1:]))
                    even = (k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0
                    some, nxt = some[even], nxt[even]
                far = after[nxt]
                sym[some], sym[nxt] = self.made[rank], -1
                after[some] = far
                before[far[far >= 0]] = some[far >= 0]
                back = before[some]
                lowest = put(np.unique(np.concatenate((back[back >= 0], some[far >= 0]))))
                if len(at) and lowest < rank:
                    places.setdefault(rank, []).append(at)
                    heappush(active, rank)
                    break
        left_over = np.concatenate(([0], np.cumsum(sym >= 0)))
        return sym[sym >= 0], left_over[ends]


class Tokenizer:
    """A tokenizer file (JSON) of a BPE model whose words don't span white space. Normal forms, case and word borders come from the file's own rules."""

    def __init__(self, text: str):
        import regex
        from tokenizers import Tokenizer as Rules

        told = _plain(text)
        model = told["model"]
        # the library is asked for the file's rules alone, so it gets no vocabulary
        rules = Rules.from_str(json.dumps(told | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self._normal, self._words = rules.normalizer, rules.pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self._inner, self._last = _table({t: k for t, k in vocab.items() if len(t) == 1}), _table({t.removesuffix(end): k for t, k in vocab.items() if len(t) == 1 + len(end) and t.endswith(end)})
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._index = PairIndex({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})
        self.added = {t["content"]: np.int32(t["id"]).tobytes() for t in told["added_tokens"]}
        longest = sorted(self.added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        # printable ASCII is normalized a character at a time and cut by the file's pattern, where its rules are of the kinds that do so
        kinds = told.get("normalizer") or {"type": "Sequence", "normalizers": []}
        kinds = kinds.get("normalizers", [kinds])
        simple = all(k["type"] in ("NFC", "Lowercase") or (k["type"] == "Replace" and k["pattern"] == {"Regex": r"\s+"}) for k in kinds)
        printable = "".join(map(chr, range(33, 127)))
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = [k["type"] for k in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and "Regex" in cuts[0]["pattern"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        self._ascii = regex.compile(cuts[0]["pattern"]["Regex"]).findall if simple and plain and "".join(map(self._normalized, printable)) == printable.lower() else None
        self._known: dict[str, bytes] = {}
        self._size = 0

    def _normalized(self, chunk: str) -> str:
        return self._normal.normalize_str(chunk) if self._normal else chunk

    def _cut(self, chunk: str) -> list[str]:
        normal = self._normalized(chunk)
        return [w for w, _ in self._words.pre_tokenize_str(normal)] if self._words else [normal]

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are not known yet; each word in them once."""
        printable, fast, slow = _PRINTABLE.fullmatch, self._ascii, self._cut
        names: dict[str, int] = {}
        number = names.setdefault
        of_chunk = [[number(w, len(names)) for w in (fast(c.lower()) if fast and printable(c) else slow(c))] for c in chunks]
        ids = self._encoded(list(names))
        for chunk, own in zip(chunks, of_chunk):
            self._known[chunk] = ids[own[0]] if len(own) == 1 else b"".join([ids[k] for k in own])
        self._size += sum(map(len, chunks))

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed."""
        out: list[bytes] = []
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        lo = 0
        while lo < len(words):
            base = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + SYMBOLS, side="right")))
            code = np.frombuffer("".join(words[lo:hi]).encode("utf-32-le"), np.uint32)
            own = ends[lo:hi] - base
            last = np.zeros(len(code), bool)
            last[own - 1] = True
            sym = np.where(last, _looked(self._last, code), _looked(self._inner, code))
            # a character that the vocabulary lacks has no token
            known = sym >= 0
            merged, cuts = self._index.merge(sym[known], np.concatenate(([0], np.cumsum(known)))[own])
            packed, at = merged.astype("<u4").tobytes(), [0, *(4 * cuts).tolist()]
            out += [packed[a:b] for a, b in zip(at, at[1:])]
            lo = hi
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self._size > REMEMBERED:
            self._known, self._size = {}, 0
        told: list[list[str]] = []
        for text in texts:
            if self._split is None or not self._split.search(text or ""):
                told.append(_CHUNK.findall(text or ""))
                continue
            parts: list[str] = []
            for k, piece in enumerate(self._split.split(text)):
                parts += [piece] if k % 2 else _CHUNK.findall(piece)
            told.append(parts)
        # an added token stands for itself, and no chunk can hold one
        known = self._known
        known.update(self.added)
        new: set[str] = set()
        for parts in told:
            new.update(set(parts).difference(known))
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, parts)) for parts in told]


def _plain(text: str) -> dict:
    told = json.loads(text)
    model = told["model"]
    odd = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)}
    plain = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in told["added_tokens"])
    if model.get("type") != "BPE" or odd or told.get("decoder") is not None or not plain:
        raise ValueError(f"not a plain BPE file without decoder: {odd or model.get('type')}")
    return told


def _table(ids: dict[str, int]) -> np.ndarray:
    """ids by code point, -1 where there is none."""
    out = np.full(1 + max(map(ord, ids), default=0), -1, np.int64)
    for c, k in ids.items():
        out[ord(c)] = k
    return out


def _looked(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.where(code < len(table), table[np.minimum(code, len(table) - 1)], -1)


class Vocabulary:
    """Tokens by id, for decoding."""

    def __init__(self, text: str):
        told = _plain(text)
        self.special = np.array([t["id"] for t in told["added_tokens"] if t["special"]], np.int64)
        tokens = {k: t for t, k in told["model"]["vocab"].items()} | {t["id"]: t["content"] for t in told["added_tokens"]}
        self.tokens = pa.array([tokens.get(k) for k in range(1 + max(tokens, default=0))], pa.string())

    def decode(self, lists: pa.ListArray, skip_special_tokens: bool = False) -> pa.Array:
        """Tokens joined by spaces, as a file without a decoder says; ids without a token are left out, a null list stays null."""
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        have = (flat >= 0) & (flat < len(self.tokens))
        have[have] = self.tokens.is_valid().to_numpy(zero_copy_only=False)[flat[have]]
        if skip_special_tokens:
            have &= ~np.isin(flat, self.special)
        left = np.concatenate(([0], np.cumsum(have)))[np.concatenate(([0], np.cumsum(sizes)))]
        told = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), self.tokens.take(pa.array(flat[have]))), " ")
        return pc.if_else(lists.is_valid(), told, pa.scalar(None, pa.string()))


_loaded: dict[tuple[type, int], Tokenizer | Vocabulary] = {}


class Shared:
    """A tokenizer file read by the driver and given to every task; its size is checked."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read(FILE_BYTES + 1)
        if len(text) > FILE_BYTES:
            raise ValueError(f"{path} has over {FILE_BYTES} bytes")
        _plain(text)  # a file that can't be followed is an error here, not in a task
        self._text = spark.sparkContext.broadcast(text)

    def _get(self, kind: type):
        """One of each kind and file a Python worker."""
        key = (kind, hash(self._text.value))
        if key not in _loaded:
            _loaded[key] = kind(self._text.value)
        return _loaded[key]

    @property
    def tokenizer(self) -> Tokenizer:
        return self._get(Tokenizer)

    @property
    def vocabulary(self) -> Vocabulary:
        return self._get(Vocabulary)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS rows and about CHARS characters."""
    for part in pieces(iter([batch]), ROWS):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < part.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHARS, side="right")))
            yield part.slice(lo, hi - lo)
            lo = hi


def encode(docs: DataFrame, shared: Shared, packed: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, ids), one row for each row of docs: the ids of the whole text without added tokens of the file's own, in the order of the text.

    packed adds the ids as little-endian unsigned 32-bit integers, the form in which token files are written; decoded adds the text that the ids stand for.
    A null text is empty; empty and blank texts have no ids; texts of any length, also of one word, are encoded whole. Added tokens that stand in a text are
    their ids. Null and repeated doc_ids, repeated rows and an empty table make no difference; other columns are ignored.
    """
    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if packed:
        kind = kind.add("packed", T.BinaryType())
    if decoded:
        kind = kind.add("decoded", T.StringType())
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.tokenizer
        for batch in batches:
            for part in _parts(batch):
                found = tokenizer.encode(part.column(1).to_pylist())
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                columns = [part.column(0), ids, *([pa.array(found, pa.binary())] if packed else [])]
                del found
                yield pa.RecordBatch.from_arrays([*columns, *([shared.vocabulary.decode(ids)] if decoded else [])], names)
                del columns, ids
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def decoded(ids: Column, shared: Shared, skip_special_tokens: bool = False) -> Column:
    """The text of each list of ids; null for a null list."""

    @F.arrow_udf(T.StringType())
    def run(lists: pa.Array) -> pa.Array:
        decode = shared.vocabulary.decode
        return pa.concat_arrays([decode(lists[at : at + 256], skip_special_tokens) for at in range(0, len(lists), 256)] or [pa.array([], pa.string())])

    return run(ids)
