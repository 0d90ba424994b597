"""Discounts and the rule for what is kept of the quality model (operator 8, ``open_quality``).

A document is kept if its perplexity is at most the given quantile of
the perplexities of good documents of its language (of all good documents where
its language has none).  The quantile is that of perplexities rounded up to three decimals: the
least value that has at least its share of them, whatever the order in which rows arrive.

Defined cases: null or empty text has no perplexity and is not kept; null
languages are one language; a document labelled more than once is good if any
label says so; without good documents the model is uniform and all texts are
kept; repeated rows give a row each; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snippetflow.session import cut_lineage

QUANTILE = 0.99


def _discounts(t: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts (four numbers)."""
    n1, n2, n3, n4 = (float(x or 0) for x in t.agg(*(F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4))).first())
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def _thresholds(fine: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """(*by, own): the quantile of each group, from its counts of rounded perplexities."""
    counts = fine.groupBy(*by, F.ceil(F.col("perplexity") * 1000).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    so_far = group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(*by, "v", F.sum("n").over(so_far).alias("up_to"), F.sum("n").over(group).alias("all"))
    return counts.where(F.col("up_to") >= quantile * F.col("all")).groupBy(*by).agg((F.min("v") / 1000.0).alias("own"))


def judge(scored: DataFrame, trusted: DataFrame, quantile: float) -> DataFrame:
    """Perplexity, the threshold of each language from its trusted documents, and what is kept."""
    scored = cut_lineage(scored.withColumn(
        "perplexity", F.when(F.col("n_symbols") > 0, F.round(F.exp(-F.col("log_prob") / F.col("n_symbols")), 9))))
    fine = cut_lineage(scored.join(trusted, "doc_id", "left_semi").where("perplexity is not null").select("lang", "perplexity"))
    per = _thresholds(fine, ["lang"], quantile)
    overall = _thresholds(fine, [], quantile).first()[0]
    out = scored.alias("s").join(per.alias("p"), F.expr("s.lang <=> p.lang"), "left")
    limit = F.coalesce("own", F.lit(overall).cast("double"))
    return out.select("doc_id", "s.lang", "n_symbols", "log_prob", "perplexity", limit.alias("threshold"),
                      F.coalesce(F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))), F.lit(False)).alias("kept"))
