"""Mixing sources to target weights by entropy balancing.

Of all document rates whose words add up to each source's target, those closest in relative entropy
to taking every document once are exponential in the document's size: rate = exp(lambda * size / mean size),
held at the cap. The lambdas solve a convex dual; each Newton step is one distributed sum per source
over (source, size) counts. Rates are rounded to whole copies by a hash of the document and one
threshold per source, chosen so that the words taken meet the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, stored, whole_row

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
#: Sources up to which the table of sources (some 100 bytes a row) is broadcast; beyond it both sides are salted and shuffled.
BROADCAST_SOURCES = 20_000
SALTS = 32
BINS = 4096
#: Repeated rows up to which the table of their hashes (some 20 bytes a row) is broadcast; beyond it both sides are shuffled.
BROADCAST_TWINS = 200_000
TOLERANCE = 1e-10


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs plus size, the number of words in the text (null: 0), and key, the source as a string that tells null from ''."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "key": key})


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (key, source, total) plus target: the words that each source gives.

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating. They share the sum of
    all totals; no target is above cap * total, the excess being shared anew by weight. That fixed point is a
    level L with target = least(cap * total, L * weight); sources in order of cap * total / weight tell L from running sums.
    One row a source is ordered here, never documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("place", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = weighed.withColumn("weight", weight).withColumn("most", F.col("total") * F.lit(float(cap)))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy((F.col("most") / F.col("weight")).desc(), F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = weighed.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "weights": F.sum("weight").over(rest), "all": F.sum("total").over(Window.partitionBy())})
    levels = levels.withColumn("level", (F.col("all") - F.col("full")) / F.col("weights"))
    # the first source that its share does not fill sets the level
    level = F.min_by(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level")), F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("most") / F.col("weight"))).over(Window.partitionBy())
    return levels.withColumn("at", level).select("key", "source", "total", F.coalesce(F.least("most", F.col("at") * F.col("weight")), F.col("most")).alias("target"))


def _small(sources: DataFrame, n_sources: int) -> DataFrame:
    """One row a source, to be broadcast while there are few; the other side never is."""
    return F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources.hint("merge")


def tilts(counts: DataFrame, sources: DataFrame, n_sources: int, cap: float = CAP, max_rounds: int = 80) -> DataFrame:
    """sources plus lam and mean: safeguarded Newton steps on log(words at lam) = log(target), all sources at once.

    counts: key, size, n. A round joins the sources' state to counts, sums words and their slope per source and
    checkpoints one row a source. A source at its cap (or without words) needs no step. Sources that are not settled in max_rounds raise an error.
    """
    top = math.log(cap)
    scale = counts.where("size > 0").groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = sources.join(scale, "key", "left").withColumns({"mean": F.coalesce("mean", F.lit(1.0)), "least": F.coalesce("least", F.lit(1)).cast("double")})
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(1.0)
    first = F.col("least") / F.col("mean")
    full = share >= cap * (1 - 1e-12)
    state = state.withColumns({
        "done": (F.col("total") == 0) | full,
        "lam": F.when(full, F.lit(top) / first).otherwise(F.lit(0.0)),
        "lo": F.when(share < 1, (F.log(share) - 1) / first).otherwise(F.lit(0.0)),
        "hi": F.when(share > 1, F.lit(top) / first).otherwise(F.lit(0.0)),
    })
    state = cut(state)
    for _ in range(max_rounds):
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.lit(top), F.greatest(F.lit(-700.0), F.col("lam") * z)))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(F.col("lam") * z < top, words * z).otherwise(0.0)
        sums = counts.join(_small(state.where("NOT done").select("key", "lam", "mean"), n_sources), "key").groupBy("key").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        off = F.log("words") - F.log("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off * F.col("words") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > F.col("to_lo")) & (step < F.col("to_hi"))
        state = state.join(sums, "key", "left").withColumns({"to_lo": lo, "to_hi": hi})
        moved = F.when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("to_lo") + F.col("to_hi")) / 2)
        narrow = (F.col("to_hi") - F.col("to_lo")) * F.col("mean") < 1e-9
        settled = F.col("done") | F.coalesce((F.abs(off) < TOLERANCE) | narrow, F.lit(True))
        state = state.select("key", "source", "total", "target", "mean", "least", settled.alias("done"), F.when(settled, F.col("lam")).otherwise(moved).alias("lam"), F.coalesce("to_lo", "lo").alias("lo"), F.coalesce("to_hi", "hi").alias("hi"))
        state = cut(state)
        if not state.where("NOT done").limit(1).count():
            break
    else:
        raise RuntimeError(f"rates did not settle in {max_rounds} rounds")
    # sums of doubles may differ in the last place from run to run; the documents' rates must not
    return state.select("key", "source", "total", "target", "mean", F.round("lam", 7).alias("lam"))


def attach(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """docs joined to one row a source by key: broadcast up to BROADCAST_SOURCES, beyond that salted so that a hot source is spread."""
    if n_sources <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), "key")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("ident", "number"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text, source and more, with ident, a hash of the three, and number, a row's place in docs."""
    told = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "n").otherwise("t"), F.when(F.col("source").isNull(), "n").otherwise("s"))
    return docs.select("doc_id", "text", "source", *more, F.monotonically_increasing_id().alias("number")).withColumn("ident", F.xxhash64(told, "text", "source"))


def _apart(rows: DataFrame, twins: DataFrame, n_twins: int) -> DataFrame:
    """rows with number 0 but for those that are there more than once: these keep their number, so that each draws for itself."""
    if not n_twins:
        return rows.withColumn("number", F.lit(0).cast("long"))
    some = F.broadcast(twins) if n_twins <= BROADCAST_TWINS else twins
    return rows.join(some, "ident", "left").withColumn("number", F.when(F.col("twin"), F.col("number")).otherwise(0)).drop("twin")


def _draws(cap: float) -> dict[str, Column]:
    rate = F.exp(F.least(F.lit(math.log(cap)), F.greatest(F.lit(-700.0), F.col("lam") * F.col("size") / F.col("mean"))))
    rate = F.least(F.lit(cap), F.round(rate, 9))
    luck = F.pmod(F.xxhash64("ident", "number", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    return {"rate": rate, "whole": F.floor(rate), "lean": luck - (rate - F.floor(rate))}


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs plus size, source_size, target, rate, copies and taken (copies * size).

    Size is the number of words; a null or empty text has size 0 and rate 1. A null source is a source of its own, the
    last one. Very long texts count whole. Ties need no order: the draw is a hash of doc_id, text and source
    and all that lean below their source's threshold get the extra copy. So rows of one doc_id, or without any, draw apart if their texts differ; rows equal in all three are
    documents of their own that draw by their place in the input, so that reruns over the same files agree. An empty table gives an empty result. Columns of
    docs with the names of the six new ones are replaced, all others are kept.
    """
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    slim = stored(with_sizes(_numbered(docs)).select("ident", "number", "source", "key", "size"), "sizes")
    twins = cut(slim.groupBy("ident").agg(F.count("*").alias("n")).where("n > 1").select("ident", F.lit(True).alias("twin")))
    n_twins = twins.limit(BROADCAST_TWINS + 1).count()
    counts = stored(slim.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "size-counts")
    sources = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    aims = cut(targets(sources, weights, cap))
    n = aims.count()
    state = cut(tilts(counts.select("key", "size", "n"), aims, n, cap))
    drawn = attach(_apart(slim.drop("source"), twins, n_twins), state, n).withColumns(_draws(cap))
    # words by how far a document leans to its extra copy, in BINS bins a source; the threshold is the edge at which the sum comes nearest the target
    bins = drawn.groupBy("key", F.floor((F.col("lean") + 1) * (BINS / 2)).alias("bin")).agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"))
    run = Window.partitionBy("key").orderBy("bin")
    edges = bins.withColumns({"upto": F.sum("words").over(run), "sure": F.sum("sure").over(Window.partitionBy("key"))}).join(_small(state.select("key", "target"), n), "key")
    none = F.abs(F.col("sure") - F.col("target"))
    best = edges.groupBy("key").agg(F.min_by((F.col("bin") + 1) * (2.0 / BINS) - 1, F.struct(F.abs(F.col("sure") + F.col("upto") - F.col("target")), F.col("bin"))).alias("edge"), F.min(F.abs(F.col("sure") + F.col("upto") - F.col("target"))).alias("off"), F.min(none).alias("none"))
    final = cut(state.join(best, "key").select("key", F.col("total").alias("source_size"), "target", "lam", "mean", F.when(F.col("none") <= F.col("off"), -2.0).otherwise(F.col("edge")).alias("threshold")))
    rows = with_sizes(_numbered(docs, whole_row(docs, *made).alias("row"))).select("ident", "number", "key", "size", "row")
    whole = attach(_apart(rows, twins, n_twins), final, n).withColumns(_draws(cap))
    copies = F.when(F.col("rate") >= cap, F.lit(cap)).otherwise(F.col("whole") + (F.col("lean") < F.col("threshold")).cast("int")).cast("long")
    return whole.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("row.*", *made)
