"""Cases that the driver's tables don't hold: templated benchmarks, vectors of any size, odd rows in every pipeline stage, random event logs, and models against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, EVENTS, _docs, _odd

from geovelo.llm import chat, decontaminate, embedding, licenses, mixing, quality, queries, secretscan

SF = "/root/testdata/sf0.001"


def _held(docs, items):
    """(doc_id, item_id) of the items whose shingles a document holds, by brute force over whole documents."""
    told = [(i, [(x, decontaminate.shingles(x)) for x in map(decontaminate.words, decontaminate.halves(t))], decontaminate.shingles(decontaminate.words(t))) for i, t in items]
    out = set()
    for d, t in docs:
        own = decontaminate.words(t)
        there = decontaminate.shingles(own)
        for k, parts, whole in told:
            if len(whole & there) >= 0.8 * len(whole) and all(len(p & (decontaminate.shingles(own, len(x)) if len(x) < 5 else there)) >= 0.5 * len(p) for x, p in parts if p):
                out.add((d, k))
    return out


@pytest.mark.parametrize("block", [1 << 21, 64])
def test_no_templated_item_is_lost(block):
    """Items of 35 shared and 8 rare words, the rare ones anywhere, copied with an end cut off, words changed and words put in."""
    rng = random.Random(5)
    shared = [f"c{k}" for k in range(35)]
    items = []
    for k in range(80):
        rare = [f"r{k}x{j}" for j in range(8)]
        at = rng.choice([0, 17, 35])
        told = shared[:at] + rare + shared[at:] + [rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 120]))]
        cut = rng.randrange(5, len(told) - 5)
        items.append((k, " ".join(told[:cut]) + "? " + " ".join(told[cut:])))
    docs = []
    for d in range(300):
        told = [x.decode() for x in decontaminate.words(items[rng.randrange(80)][1])]
        lost = rng.randrange(len(told) // 4)
        first = rng.randrange(lost + 1)
        told = told[first : len(told) - lost + first]
        for _ in range(rng.choice([0, 1, 2])):
            told[rng.randrange(len(told))] = "zz"
            told.insert(rng.randrange(len(told)), "yy")
        docs.append((d, " ".join([f"w{rng.randrange(500)}" for _ in range(rng.randrange(200))] + told + [f"w{rng.randrange(500)}" for _ in range(rng.randrange(200))])))
    docs.append((300, " ".join([*shared, *(f"r7x{j}" for j in range(8))][7:])))
    index = decontaminate.Index(items)
    assert index.grams
    got = {(d, index.ids[k]) for (d, _), hits in zip(docs, index.hits([t for _, t in docs])) for k in hits}
    assert got == _held(docs, items) and len(got) > 50


def test_large_benchmark_is_one_index():
    rng = random.Random(6)
    items = [(k, " ".join(f"v{int(rng.paretovariate(0.4)) % 20000}" for _ in range(rng.randint(20, 60)))) for k in range(3000)]
    index = decontaminate.Index(items)
    assert index.nbytes < 3000 * 40 * 100
    docs = [(k, "x " * 70 + items[k][1] + " y" * 70) for k in range(0, 3000, 60)]
    got = {(d, index.ids[k]) for (d, _), hits in zip(docs, index.hits([t for _, t in docs])) for k in hits}
    assert {(k, k) for k, _ in docs} <= got


def test_vectors_in_double_precision(spark):
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    vectors = [(1, [1.0, 0.0]), (2, at(0.95 - 1e-9)), (3, [-1.0, 0.0]), (4, [-(0.95 + 1e-9), at(0.95 + 1e-9)[1]]), (10, [0.0, 1e200, 0.0]), (11, [0.0, 1e200, 1e199]), (12, [0.0, 1e-60, 0.0]), (13, [0.0, -1e-310, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 10: (2, 10), 11: (2, 10), 12: (2, 10), 13: (0, 13)}


def test_links_of_a_tile_of_close_vectors_are_added_up():
    import tracemalloc

    import pandas as pd

    n = 4096
    draw = np.random.default_rng(3)
    close = np.concatenate((np.ones((n, 1)), draw.normal(scale=0.01, size=(n, 7))), axis=1)
    table = pd.DataFrame({"side": 0, "cid": np.arange(n), "n": 1, "embedding": list(close)})
    tracemalloc.start()
    got = embedding._compare(table, np.eye(8), 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["links"].sum() == n * (n - 1) and (got.b.dropna() == 0).all() and peak < 120e6


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = _docs(spark, [*_odd(random.Random(4)), (70, "password = abcdefghijk"), (71, "x" * 300_000)])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        done = spark.read.parquet(str(tmp_path / name))
        assert done.columns[: len(docs.columns)] == docs.columns or name == "mix" and set(docs.columns) <= set(done.columns)
        assert {(r.key, r.label) for r in done.collect()} <= {("x", "x")}
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_event_logs_against_a_plain_fold(spark):
    rng = random.Random(8)
    log = []
    for c in range(40):
        for seq in range(rng.randint(1, 40)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            log.append((c, seq, kind, rng.randrange(5), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "b<", "c"])))
    want = {}
    for c, _, kind, turn, role, text in sorted(log, key=lambda x: x[:2]):
        own = want.setdefault(c, {})
        if kind == "regenerate":
            for t in [t for t in own if t >= turn]:
                del own[t]
        was = own.get(turn, (None, ""))
        if kind == "delta":
            own[turn] = (role or was[0], was[1] + (text or ""))
        else:
            own[turn] = (role, text or "") if kind == "regenerate" else (role or was[0], text or "")
    got = {(r.conv_id, r.turn): r.text for r in chat.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(c, t): x[1] for c, own in want.items() for t, x in own.items()}


def test_quality_scores_against_plain_sums(spark):
    docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    for r in quality.classify(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        x = quality.features((r.text or "").encode())
        place = lambda edges, v: sum(v >= e for e in edges)
        total = model.start + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x)) + sum(t[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])] for i, j, t in model.pairs)
        assert r.score == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, total)))), abs=1e-12)


def test_keys_of_letters_alone_and_a_table_of_labelled_tokens(spark):
    rng = random.Random(2)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=40))
    docs = _docs(spark, [(1, f"see {key} here"), (2, "an ordinary sentence about nothing/in/particular/and/everything/else")])
    made = spark.createDataFrame([*secretscan.samples(), (None, 1), ("abc", None)], "token string, label int")
    for model in (None, secretscan.train(docs, made)):
        got = {r.doc_id: [s.kind for s in r.spans] for r in secretscan.scan(docs, model).collect()}
        assert got == {1: ["markov"], 2: []}


def test_every_copy_of_a_licence_and_the_rest_of_one():
    auto = licenses.Automaton()
    ids = lambda text: np.array([auto.ids.get(w, 0) for w in licenses.words(text.encode())])
    mit, rest = licenses.TEMPLATES["mit"], licenses.REST["mit/2"]
    told = [(s[0], s[1]) for s in auto.spans(ids(f"x {mit} " + "y " * 50 + f"permission is hereby granted {mit} z")) if s[3] >= licenses.COVER and s[0] == "mit"]
    size = len(licenses.words(mit.encode()))
    assert len(told) == 2 and told[0] == ("mit", 1) and told[1][1] > size + 50
    assert {s[0] for s in auto.spans(ids(rest)) if s[3] >= licenses.COVER} == {"mit"}
    twice = licenses.Automaton({"t": "a b c d e f g h a b c d i j k l"})
    put = np.array([twice.ids[w] for w in b"e f g h a b c d i j k l".split()])
    assert twice.spans(put) == [("t", 0, 11, 12 / 16)]


def test_mixing_raises_if_rates_do_not_settle(spark):
    docs = _docs(spark, [(d, "w " * (1 + d % 9)) for d in range(60)], {d: "ab"[d % 2] for d in range(60)})
    counts = mixing.with_sizes(docs.select("doc_id", "text", "source")).groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    aims = mixing.targets(counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("total")))
    with pytest.raises(RuntimeError):
        mixing.tilts(counts.select("key", "size", "n"), aims, 2, max_rounds=1)


@pytest.mark.parametrize("broadcast", [200_000, 0])
@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k % 3])
def test_targets_are_met_whatever_the_ids_and_however_often_a_row_is_repeated(spark, monkeypatch, ids, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_TWINS", broadcast)
    rows = [(ids(k), " ".join(["w"] * 10), "en", "ab"[k % 2], 0, "x", "x", "x", "x", "x") for k in range(1000)] + [(ids(k), f"v{k} " * (k % 5), "en", "c", 0, "x", "x", "x", "x", "x") for k in range(500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).persist()
    got = mixing.mix(docs).select("source", "taken", "target", "doc_id", "size").collect()
    assert len(got) == len(rows)
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10 and all(r.taken <= 3 * int(r["size"]) for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).select("source", "taken", "target", "doc_id", "size").collect()), key=str)
    docs.unpersist()
