"""BPE against the tokenizers library, ball k-means and fill-in-middle against plain versions, with odd rows in every table."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import _docs, _odd
from tokenizers import Tokenizer

from geovelo.llm import bpe, clustering, fim, queries

SF, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(open(PATH, encoding="utf-8").read())


def _ids(tokenizer, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode(texts)]


def _plain_bpe(ranks, word):
    word = list(word)
    while found := [(ranks[p][0], k) for k, p in enumerate(zip(word, word[1:])) if p in ranks]:
        k = min(found)[1]
        word[k : k + 2] = [ranks[word[k], word[k + 1]][1]]
    return word


@pytest.mark.parametrize("seed", range(6))
def test_pair_index_equals_one_merge_at_a_time(seed):
    """Also where a merge brings about a pair of a lower rank."""
    rng = random.Random(seed)
    ranks, made = {}, list(range(4))
    while len(ranks) < 25:
        pair = (rng.choice(made), rng.choice(made))
        if pair not in ranks:
            made.append(100 + len(ranks))
            ranks[pair] = (len(ranks), made[-1])
    shuffled = dict(zip(ranks, [(r, v[1]) for r, v in zip(rng.sample(range(len(ranks)), len(ranks)), ranks.values())]))
    words = [[rng.randrange(4) for _ in range(rng.randrange(40))] for _ in range(200)] + [[0] * 500, []]
    ends = np.cumsum([len(w) for w in words])
    for table in (ranks, shuffled, {}):
        index = bpe.PairIndex(table)
        assert index.ordered == (table is not shuffled)
        got, cuts = index.merge(np.array([s for w in words for s in w]), ends)
        assert [got[a:b].tolist() for a, b in zip([0, *cuts[:-1]], cuts)] == [_plain_bpe(table, w) for w in words]


def test_texts_encode_and_decode_as_the_library_does(library, own):
    rng = random.Random(3)
    texts = ["", " \n\t", "It's We'RE they'll I'd 'S ''s", "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|>x<|endoftext", "é É e\u0301 İI ΑΣ Σ ﬁ ǅ", "123 4½ ٣", "x" * 5000, "ab" * 3000 + " " + "ba" * 2999, "日本語 \u200b\u200d🙂🙂", "\x00\x1c\x1d\x1e\x1f a\x1cb", "a\u0300\u0323 \u0301b"]
    texts += ["".join(chr(c) for c in range(lo, lo + 256) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x10000, 256)]
    texts += [f"a{chr(c)}B" for c in [*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF, 0x180E]]
    pool = [chr(c) for c in (*range(32, 127), 0xE9, 0x301, 0x327, 0x3A3, 0x130, 0x1F642, 0x4E2D, 0xA0, 0x2028)]
    texts += ["".join(rng.choices(pool, k=rng.randrange(120))) for _ in range(1500)]
    got = _ids(own, texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == want
    lists = pa.array([*got, [0, 10**6, 5], None, []], pa.list_(pa.int32()))
    for skip in (False, True):
        told = bpe.Vocabulary(open(PATH, encoding="utf-8").read()).decode(lists, skip).to_pylist()
        assert told == [*(library.decode(x, skip_special_tokens=skip) for x in [*want, [0, 10**6, 5]]), None, ""]


def test_small_indexes_and_a_short_memory_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "SYMBOLS", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "CHARS", 30)
    small, rng = bpe.Tokenizer(open(PATH, encoding="utf-8").read()), random.Random(4)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdeü", k=rng.randrange(9))) for _ in range(8)) for _ in range(5)]
        assert _ids(small, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _told(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_op11_equals_the_library_on_a_whole_table(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_bpe(spark, SMALL).collect()}
    assert got == {d: _told(library, t) for d, t in docs}


def test_bpe_on_odd_rows(spark, library):
    shared, texts = bpe.Shared(spark, PATH), _odd(random.Random(2))
    got = bpe.encode(_docs(spark, texts), shared, packed=True, decoded=True).withColumn("text", bpe.decoded(F.col("ids"), shared)).collect()
    assert all(r.text == r.decoded and np.frombuffer(r.packed, "<u4").tolist() == r.ids for r in got)
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in texts]
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == sorted(((d, i, library.decode(i, skip_special_tokens=False)) for d, i in want), key=str)
    assert bpe.encode(_docs(spark, []), shared).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>").select(bpe.decoded(F.col("ids"), shared).alias("x")).first()
    assert nothing.x is None


def test_other_kinds_of_tokenizer_files_are_refused(spark):
    with pytest.raises(ValueError, match="not a plain BPE file"):
        bpe.Shared(spark, public_tokenizers.path("byte_bpe_50k.json"))


# --- ball k-means ----------------------------------------------------------------------------------------------------


def _means(rows, k, rounds, dim):
    """(vec_id, vector) by comparison of all with all, in whole numbers of any size."""
    usable = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(usable, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in usable:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(members[n]) for x in zip(*members[n])) if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in usable]
    each = {}
    for _, n, d in found:
        each[n] = each.get(n, 0) + d
    return sorted(((i, n, d, each[n], sum(each.values()), list(centroids[n])) for i, n, d in found), key=str)


def _cluster(spark, rows, **how):
    table = spark.createDataFrame([(i, v, "x", 1.5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance double").repartition(3)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in clustering.cluster(table, **how).collect()), key=str)


@pytest.mark.parametrize("replayed", [8, 1])
def test_clusters_with_odd_rows(spark, monkeypatch, replayed):
    monkeypatch.setattr(clustering, "REPLAYED", replayed)
    rng = random.Random(8)
    centres = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.4) for x in centres[k % 5]]) for k in range(400)]
    rows += [(1000 + k, [0.5, -0.5, 0.0]) for k in range(60)]  # repeated vectors, so centroids tie
    rows += [(7, rows[7][1]), (None, [1.0, 1.0, 1.0]), (None, [-1.0, 2.0, 0.25]), (2000, None), (2001, []), (2002, [1.0, None, 1.0]), (2003, [1.0, float("nan"), 1.0]), (2004, [float("inf"), 0.0, 0.0]), (2005, [1.0] * 4), (2006, [2.0**18, -(2.0**18), 0.0])]
    assert _cluster(spark, rows, k=12, rounds=4, dim=3) == _means(rows, 12, 4, 3)


def test_few_vectors_no_vectors_and_too_large_ones(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0])]
    assert _cluster(spark, rows, k=5, rounds=2, dim=2) == _means(rows, 5, 2, 2)
    assert _cluster(spark, [(1, None)], k=5, rounds=2, dim=2) == []
    with pytest.raises(Exception, match="is beyond"):
        _cluster(spark, [(1, [1e9, 0.0])], k=1, rounds=1, dim=2)
    with pytest.raises(ValueError, match="clusters"):
        clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<double>"), k=10**6)


def test_moved_balls_find_the_nearest_centroid():
    rng = np.random.default_rng(1)
    for spread in (1, 30, 10**7):
        x, c = rng.integers(-20, 20, (3000, 4)) * spread, rng.integers(-20, 20, (25, 4)) * spread
        before = clustering.Balls(c).all(x)[0]
        balls = clustering.Balls(c + rng.integers(-4, 5, c.shape) * spread)
        want, got = balls.all(x), balls.moved(x, before)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


# --- fill in the middle ----------------------------------------------------------------------------------------------


def _middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, None, text
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_middles_on_odd_rows(spark, rate, spm):
    texts = [*_odd(random.Random(6)), (60, "\n\n"), (61, "a<P>\nb"), (62, "<M>"), (63, "<P\n<S\n<"), (64, "\r\n\u2028x\n🙂"), (65, "x" * 300_000), (66, "y\n" * 50_000), (67, "\\E\n$1\n")]
    made = fim.transform(_docs(spark, texts), rate=rate, spm_rate=spm)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted((_middle(d, t, rate=rate, spm=spm) for d, t in texts), key=str)
    assert sorted((r.back for r in got)) == sorted(t or "" for _, t in texts)
    assert fim.transform(_docs(spark, [])).count() == 0


def test_middles_stay_in_the_jvm_and_sentinels_are_checked(spark):
    plan = queries.op13_fim(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    own = fim.transform(_docs(spark, [(1, "a\nb\nc\n<P>")]), sentinels=("<|a|>", "<|b|>", "<|c.|>"))
    assert own.select(fim.restored(F.col("output"), F.col("form"), ("<|a|>", "<|b|>", "<|c.|>"))).first()[0] == "a\nb\nc\n<P>"
    for bad in (("<a>", "<a>", "<b>"), ("a", "<b>", "<c>"), ("<a<", "<b>", "<c>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.transform(_docs(spark, []), sentinels=bad)
