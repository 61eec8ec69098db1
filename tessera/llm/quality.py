"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured; rule failures are aggregated by host, each host's failure rate is shrunk towards the
corpus by a beta prior fitted to all hosts (method of moments), and the host's verdict is joined back: documents of a
host that nearly always fails are rejected, documents of a suspect host are rejected if they fail a rule themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WORD_GAP, materialize

WINDOW = 8
#: A host is suspect from SUSPECT and bad from BAD on (shrunk failure rates).
SUSPECT, BAD = 0.3, 0.8
#: Flagged hosts are broadcast up to this many (checked by a count), and joined by a shuffle beyond it.
BROADCAST_HOSTS = 100_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed"]


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words in windows of 8 found twice or more: windows sorted by hash, equal neighbours compared word by word."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        window = lambda x: F.slice(words, x["i"] + 1, F.lit(WINDOW))
        same = lambda a, b: (a["h"] == b["h"]) & (window(a) == window(b))
        twice = F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | ((k < F.size(s) - 1) & same(x, F.get(s, k + 1))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"].cast("long")))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(at, start, step)["n"]

    # A one-element array binds the sorted pairs once for all the lambdas above.
    return F.get(F.transform(F.array(pairs), covered), 0)


def measured(df: DataFrame, text_col: str, carry: list[Column]) -> DataFrame:
    """carry and the document's measures. A null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*carry, text.alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", WORD_GAP, -1), ""))
    n = F.size("_words")
    many = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    rows = rows.withColumn("_hashes", many)
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.select(
        "*",
        n.cast("long").alias("n_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[^ \\t-\\r]+", ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(some, repeated_words(F.col("_words"), F.col("_hashes"))), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    odd = (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("_n_lines"))
    odd = odd | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | odd)
    return rows.drop("_text", "_words", "_hashes", "_lines", "_n_lines")


def host_rates(rows: DataFrame) -> DataFrame:
    """_host, host_rate: the failure rate shrunk by the beta prior whose mean and spread all hosts share."""
    hosts = materialize(rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("k")), "hosts")
    p = F.col("k") / F.col("n")
    m = F.sum("k") / F.sum("n")
    found = hosts.agg(F.sum("n").alias("N"), m.alias("m"), F.count(F.lit(1)).alias("H"), (F.sum(F.col("n") * p * p) / F.sum("n")).alias("p2")).first()
    if not found["N"]:
        return hosts.select("_host", F.lit(0.0).alias("host_rate"))
    within = found["m"] * (1 - found["m"])
    # Spread between hosts: the weighted variance of rates less what sampling alone would give.
    between = found["p2"] - found["m"] ** 2 - within * (found["H"] - 1) / found["N"]
    strength = min(1e6, max(1.0, within / between - 1)) if between > 1e-12 else 1e6
    return hosts.select("_host", ((F.col("k") + found["m"] * strength) / (F.col("n") + strength)).alias("host_rate"))


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """carry (all columns by default; those named like a result are replaced) and the measures, host_rate and kept.

    Documents without a host form one host. Repeated rows and ids are judged row by row. Empty tables give no rows.
    kept is false if base_failed, else false if the host is bad, or suspect and the document fails a rule itself.
    """
    taken = {"kept", "host_rate", *STATS}
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    # What is carried stays in one struct, so that no name can clash.
    held = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_none"))
    rows = materialize(measured(df, text_col, [held.alias("_row"), F.col(host_col).alias("_host")]), "quality")
    flagged = host_rates(rows).filter(F.col("host_rate") >= SUSPECT)
    if flagged.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        flagged = F.broadcast(flagged)
    flagged = flagged.withColumnRenamed("_host", "_flagged")
    both = rows.join(flagged, F.col("_host").eqNullSafe(F.col("_flagged")), "left")
    rate = F.coalesce(F.col("host_rate"), F.lit(0.0))
    kept = ~F.col("base_failed") & ~(rate >= BAD) & ~((rate >= SUSPECT) & F.col("rule_failed"))
    return both.select("_row.*", *STATS, rate.alias("host_rate"), kept.alias("kept")) if names else both.select(*STATS, rate.alias("host_rate"), kept.alias("kept"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), r AS (
  SELECT doc_id, sum(least(8, gap)) AS n_repeat_words FROM (
    SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS gap
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), b AS (
  SELECT doc_id, source, len(words) AS n_words,
         length(t) - length(regexp_replace(t, '[^ \x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
), e AS (
  SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS rule_failed FROM f
), h AS (
  SELECT source, count(*) AS n, CAST(sum(CAST(rule_failed AS INT)) AS DOUBLE) AS k FROM e GROUP BY source
), m AS (
  SELECT sum(n) AS nn, sum(k) / sum(n) AS m, count(*) AS hh, sum(n * (k / n) * (k / n)) / sum(n) AS p2 FROM h
), p AS (
  SELECT m, CASE WHEN p2 - m * m - m * (1 - m) * (hh - 1) / nn > 1e-12
            THEN least(1e6, greatest(1.0, m * (1 - m) / (p2 - m * m - m * (1 - m) * (hh - 1) / nn) - 1)) ELSE 1e6 END AS s FROM m
), v AS (
  SELECT source, (k + m * s) / (n + s) AS host_rate FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rate >= 0.8 AND NOT (host_rate >= 0.3 AND rule_failed) AS kept
FROM e JOIN v ON e.source IS NOT DISTINCT FROM v.source
"""
