"""Fill-in-middle transformation in Spark SQL functions alone: texts cut into lines by a hash of the document, rearranged under sentinels, and read back.

One projection without any exchange: regexp_extract_all makes the units, conv of substrings of sha2 the cuts, slice and array_join the arrangement.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A line with its end, or the rest of the text.
UNIT = "[^\n]*\n|[^\n]+"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of the seed and the document's id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output), one row for each row of docs.

    n: lines. The prefix ends after the smaller of two hashed numbers of lines, the middle after the larger. form: plain for
    empty texts, texts that hold a sentinel and those of 100 - rate in a hundred hashes, whose output is the text and whose parts are null; of
    the others spm_rate in a hundred are spm (suffix, prefix, middle), the rest psm (prefix, suffix, middle). Sentinels must differ, start with '<' and hold no other '<', so that none
    can arise where a text meets a sentinel. A null text is empty. Rows of one doc_id are cut by the same hash, null ones as if their id were empty. Long texts are cut whole; an
    empty table gives an empty result; other columns are ignored.
    """
    if len(set(sentinels)) != 3 or not all(re.fullmatch("<[^<]+", x) for x in sentinels):
        raise ValueError("sentinels must differ, start with '<' and hold no other '<'")
    pre, suf, mid = map(F.lit, sentinels)
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    rows = rows.withColumn("n", F.size("units").cast("long")).withColumns({"a": F.pmod(h1, F.col("n") + 1).cast("int"), "b": F.pmod(h2, F.col("n") + 1).cast("int")})
    plain = (F.col("text") == "") | F.contains("text", pre) | F.contains("text", suf) | F.contains("text", mid) | (F.pmod(h3, F.lit(100)) >= rate)
    rows = rows.select("doc_id", "text", "units", "n", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm_rate, "spm").otherwise("psm").alias("form"))
    told = F.col("form") != "plain"
    part = lambda start, size: F.when(told, F.array_join(F.slice("units", start, size), ""))
    parts = rows.select("doc_id", "text", "n", "form", part(F.lit(1), F.col("lo")).alias("prefix"), part(F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("middle"), part(F.col("hi") + 1, F.col("n").cast("int") - F.col("hi")).alias("suffix"))
    psm, spm = F.concat(pre, "prefix", suf, "suffix", mid, "middle"), F.concat(suf, "suffix", pre, "prefix", mid, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of: split at the sentinels, the pieces put back in order."""
    pieces = F.split(output, "|".join("\\Q" + x + "\\E" for x in sentinels))
    # before the first sentinel stands nothing
    at = lambda k: F.get(pieces, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
