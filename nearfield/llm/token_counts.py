"""Token counts: an exact histogram of document lengths and its suffix sums.

Documents are aggregated by encoded length (partial sums before the shuffle, so a length that a
third of all documents share is one row per task). Suffix sums over the lengths, by blocks of
1,024 lengths, then answer totals, quantiles and truncated totals for every context limit.

Defined cases: null or empty text has length 0; an empty table gives an empty histogram; repeated
rows count each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_counts
from .common import materialize

BLOCK = 1 << 10


def histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per length: documents and tokens with it, with at least it, and the total if every document is cut to it.

    below_share is the share of documents that are shorter: a quantile q is the largest length whose below_share is at most q.
    """
    bars = counts.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count("*").alias("docs"))
    bars = bars.withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long"))
    bars = materialize(bars, "histogram")  # read twice below
    blocks = bars.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"), F.sum("block_docs").over(every).alias("all_docs"), F.sum("block_tokens").over(every).alias("all_tokens"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.join(blocks, "block").select("*", (F.sum("docs").over(here) + F.col("docs_after")).alias("docs_at_least"), (F.sum("tokens").over(here) + F.col("tokens_after")).alias("tokens_at_least"))
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return rows.select("n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least", cut.alias("tokens_if_cut_here"), ((F.col("all_docs") - F.col("docs_at_least")) / F.col("all_docs")).alias("below_share"))


def at_limits(bars: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, and tokens kept if documents are cut to it."""
    # the shortest length of at least the limit has the suffix sums that hold for the limit
    total = bars.agg(F.sum("tokens").alias("all_tokens"), F.sum("docs").alias("all_docs"))
    picks = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") >= x, F.col("n_tokens"))).alias(f"at_{k}") for k, x in enumerate(limits)]
    one = bars.agg(F.sum("tokens").alias("all_tokens"), F.sum("docs").alias("all_docs"), *picks) if limits else total
    rows = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.col("all_docs"), F.coalesce(F.col(f"at_{k}.docs_at_least"), F.lit(0)).alias("docs_at_least"), (F.col("all_tokens") - F.coalesce(F.col(f"at_{k}.tokens_at_least"), F.lit(0)) + F.lit(x) * F.coalesce(F.col(f"at_{k}.docs_at_least"), F.lit(0))).alias("tokens_if_cut")) for k, x in enumerate(limits)]
    return one.select(F.inline(F.array(*rows)))


def quantile(bars: DataFrame, q: float) -> DataFrame:
    """The largest length with at most a share q of documents below it."""
    return bars.filter(F.col("below_share") <= q).agg(F.max("n_tokens").alias("n_tokens"))


def token_histogram(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return histogram(token_counts(docs, ranks, key, text))
