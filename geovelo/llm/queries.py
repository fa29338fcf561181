"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontaminate, embedding, fim, licenses, mixing, quality, secretscan, simhash, substrings, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = F.lit("</s>[INST] ok [/INST]")
    rows = F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), probe.alias("text")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), probe.alias("text")))
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(rows).alias("r")).select("conv_id", "r.*")
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    done = chat.format_chats(chat.conversation_events(told))
    read = done.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    told_back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told_back, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.col("places")["label"]
    own = F.filter("spans", lambda s: s["share"] >= licenses.COVER)["template"]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.col("places")["word"]).alias("first_word"), F.array_max(F.col("places")["word"]).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), "score",
    )


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text", "source")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared = bpe.Shared(spark, public_tokenizers.path("word_bpe_49k.json"))
    told = bpe.encode(table(spark, sf_dir, "documents"), shared, packed=True, decoded=True)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clustering.cluster(table(spark, sf_dir, "embeddings"))
    told = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(told, 256).alias("centroid_sha256"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    length = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return made.select("doc_id", "n", "form", length("prefix"), length("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_ALL = (op1_quality, op2_url_filter, op3_chat_format, op4_decontaminate, op5_simhash, op6_secrets, op7_substrings, op8_licenses, op9_mix, op10_embeddings, op11_bpe, op12_ball_kmeans, op13_fim)
QUERIES = {f.__name__: f for f in _ALL}

_URL_SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

_CHAT_SQL = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 27 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS formatted FROM told
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""

_FIM_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(list_slice(u, 1, lo), '') AS prefix, array_to_string(list_slice(u, lo + 1, hi), '') AS middle, array_to_string(list_slice(u, hi + 1, n), '') AS suffix FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM parts
"""


def _means_sql(rounds: int = 5) -> str:
    """One table of clusters and one of centroids a round; all numbers are whole and exact in doubles."""
    nearest = "a{k} AS (SELECT id, vec_id, e, s, c, CAST(s - 2 * list_dot_product(e, ce) + cs AS BIGINT) AS d FROM x, c{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY s - 2 * list_dot_product(e, ce) + cs, c) = 1)"
    moved = """m{k} AS (SELECT c, p, sum(CAST(e[p] AS HUGEINT)) AS t, count(*) AS n FROM a{k}, range(1, 65) g(p) GROUP BY c, p),
      f{k} AS (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS ce FROM m{k} GROUP BY c),
      c{j} AS (SELECT o.c, coalesce(f.ce, o.ce) AS ce, list_dot_product(coalesce(f.ce, o.ce), coalesce(f.ce, o.ce)) AS cs FROM c{k} o LEFT JOIN f{k} f ON f.c = o.c)"""
    steps = [
        "w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64)",
        "x AS (SELECT row_number() OVER () AS id, vec_id, e, list_dot_product(e, e) AS s FROM (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM w WHERE list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))))",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), e) - 1 AS c, e AS ce, s AS cs FROM x QUALIFY c < 40)",
    ]
    for k in range(rounds):
        steps += [nearest.format(k=k), moved.format(k=k, j=k + 1)]
    steps.append(nearest.format(k=rounds))
    return "WITH " + ",\n".join(re.sub(r"^ *(\w+) AS \(", r"\1 AS MATERIALIZED (", s, flags=re.M) for s in steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(ce, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} o ON o.c = a.c"""


ORACLE_SQL = {"op10_embeddings": _EMBEDDING_SQL, "op12_ball_kmeans": _means_sql(), "op13_fim": _FIM_SQL, "op2_url_filter": _URL_SQL, "op3_chat_format": _CHAT_SQL}
