"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

Each source gets a target number of words: the weights share a multiple of all words, no source
goes over ``cap`` times its size, and what is cut off is shared again by weight (water filling,
solved in one step over the sources ordered by cap / weight). A source's complete epochs come
first; the remaining budget goes to documents in the order of their exponential keys
-ln(u) / quality weight, u being a hash of the document's key, so reruns agree.

The prefix sum never sorts a source: keys fall into 65,536 ordered bins, a histogram of 256 coarse
bins finds the coarse bin in which the budget ends, a second one the fine bin, and only that fine
bin's documents are sorted. Sums are partial before the shuffle, so a source that holds most rows
costs no more than others. The one table with a single-task window has a row for each source.

Defined cases: null text has size 0 and is never taken; a null source is a source, the last; a
null key gets a fixed u; repeated rows are documents of their own; an empty table gives no rows;
a source without words has target 0; quality weights must be above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small_side

#: White space, if any.
BLANK = r"[\x20\x09-\x0D]*"
FINE, COARSE = 1 << 16, 1 << 8


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) with 52 bits, fixed by the key (null: as the empty string)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    every, upto = Window.partitionBy(), Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    ranked = ranked.select("*", (F.sum("source_size").over(every) * F.lit(float(share))).alias("budget"), F.sum("weight").over(every).alias("all_weights"), F.sum("most").over(upto).alias("most_upto"), F.sum("weight").over(upto).alias("weight_upto"))
    full = F.col("most_upto") + F.col("ratio") * (F.col("all_weights") - F.col("weight_upto")) <= F.col("budget")
    ranked = ranked.withColumn("full", full)
    kept = ranked.select("*", (F.col("budget") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)).alias("left"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every).alias("left_weights"))
    level = F.col("weight") * F.col("left") / F.when(F.col("left_weights") > 0, F.col("left_weights"))
    return kept.select("source", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", level)).alias("target"))


def placed(docs: DataFrame, quality: DataFrame | None, quality_weights: tuple[float, float, float], key: str, text: str, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, key, bin) of every row, and the columns ``keep``."""
    low, mid, high = quality_weights
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    if quality is None:
        worth, least = F.lit(mid), mid
    else:
        known = quality.groupBy(F.col(key).alias("doc_id")).agg(F.max("quality").alias("quality"))
        known = materialize(known, "mix-quality")
        sized = sized.join(small_side(known), "doc_id", "left")
        worth, least = F.when(F.col("quality") == 0, low).when(F.col("quality") == 1, high).otherwise(mid), min(quality_weights)
    sized = sized.withColumn("key", -F.ln(uniform(F.col("doc_id"))) / worth)
    place = 1 - F.exp(-F.col("key") * F.lit(least))
    return sized.withColumn("bin", F.least(F.floor(place * FINE), F.lit(FINE - 1)).cast("int")).select("doc_id", "source", "size", "key", "bin", *(f"kept_{c}" for c in keep))


def _with_source(rows: DataFrame, of: DataFrame, n: int) -> DataFrame:
    of = small_side(of.withColumnRenamed("source", "of"), n)
    return rows.join(of, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")


def decide(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, int]:
    """(source, source_size, target, epochs, rest, end_bin, before) of every source, and their number.

    Keys in bins before end_bin are taken once more; in end_bin, where ``before`` words are ahead, as far as the rest goes.
    """
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = materialize(plan, "mix-plan")
    n = plan.count()

    def ends(bins: DataFrame, width: str) -> DataFrame:
        """The bin of each source in which the rest of its budget ends, and the words before it."""
        upto = Window.partitionBy("source").orderBy(width).rowsBetween(Window.unboundedPreceding, 0)
        run = bins.withColumn("until", F.sum("words").over(upto) + F.col("before"))
        return run.filter((F.col("until") >= F.col("rest")) & (F.col("until") - F.col("words") < F.col("rest"))).select("source", "rest", F.col(width), (F.col("until") - F.col("words")).alias("before"))

    coarse = sized.groupBy("source", F.shiftright("bin", 8).alias("coarse")).agg(F.sum("size").alias("words"))
    coarse = _with_source(coarse, plan.select("source", "rest"), n).withColumn("before", F.lit(0).cast("long"))
    found = materialize(ends(coarse, "coarse"), "mix-coarse")
    fine = _with_source(sized, found, n).filter(F.shiftright("bin", 8) == F.col("coarse"))
    fine = fine.groupBy("source", "bin", "before", "rest").agg(F.sum("size").alias("words"))
    found = ends(fine, "bin").select(F.col("source").alias("of"), F.col("bin").alias("end_bin"), "before")
    return materialize(plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "weight"), "mix-ends"), n


def at_end(rows: DataFrame) -> DataFrame:
    """``part`` of the rows of decide() and placed() in each source's end_bin, the only ones that are sorted."""
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.filter(F.col("bin") == F.col("end_bin")).withColumn("ahead", F.sum("size").over(order) - F.col("size") + F.col("before"))
    return last.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("ahead"))).cast("long")).drop("ahead")


def _elsewhere(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.coalesce(F.col("bin") != F.col("end_bin"), F.lit(True)))
    return rows.withColumn("part", F.when(F.col("bin") < F.col("end_bin"), F.col("size")).otherwise(0).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, quality: DataFrame | None = None, quality_weights: tuple[float, float, float] = (0.25, 0.5, 1.0), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of each document.

    quality: (key, quality 0 or 1) of some documents; quality_weights: for 0, unknown and 1.
    Returns key, size, source_size, target, taken, and the parts of taken: epochs (complete
    repeats) and part (words of the fractional epoch).
    """
    sized = materialize(placed(docs, quality, quality_weights, key, text, source), "mix-sized")
    rows = _with_source(sized, *decide(sized, weights, share, cap))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return _elsewhere(rows).unionByName(at_end(rows)).select(F.col("doc_id").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"), "epochs", "part")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, quality: DataFrame | None = None, quality_weights: tuple[float, float, float] = (0.25, 0.5, 1.0), key: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the same columns.

    A document of which the budget takes a part is cut at the end of so many words, its white space kept, and ``length`` is counted anew. quality and quality_weights are as in ``mix``; texts
    are shuffled only to join a quality that is too large to broadcast.
    """
    sized = materialize(placed(docs, quality, quality_weights, key, text, source), "mix-sized")
    plan, n = decide(sized, weights, share, cap)
    rows = _with_source(placed(docs, quality, quality_weights, key, text, source, tuple(docs.columns)), plan, n)
    both = _elsewhere(rows).unionByName(at_end(rows))
    copies = both.withColumn("words", F.explode(F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>")))))
    cut = F.col("words") < F.col("size")
    # a word with the white space before it, so that what is kept is the text's own beginning
    pieces = F.regexp_extract_all(f"kept_{text}", F.lit(BLANK + WORD), F.lit(0))
    short = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("words"), F.lit(1)).cast("int")), "")
    copies = copies.withColumn(f"kept_{text}", F.when(cut, short).otherwise(F.col(f"kept_{text}")))
    if length in docs.columns:
        copies = copies.withColumn(f"kept_{length}", F.when(cut, F.char_length(f"kept_{text}")).otherwise(F.col(f"kept_{length}")).cast(docs.schema[length].dataType))
    return copies.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


#: The same rows in DuckDB's SQL, with plain windows.
ORACLE = """
WITH sized AS (
  SELECT d.doc_id, d.source, COALESCE(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(COALESCE(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE q.quality WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 ELSE 0.5 END AS key
  FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sizes),
summed AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_weights,
    sum(most) OVER (ORDER BY most / weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most_upto,
    sum(weight) OVER (ORDER BY most / weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight_upto FROM ranked),
cut AS (SELECT *, most_upto + most / weight * (all_weights - weight_upto) <= budget AS is_full FROM summed),
shared AS (
  SELECT *, budget - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER () AS rest_budget,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS rest_weights FROM cut),
plan AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE least(most, weight * rest_budget / nullif(rest_weights, 0)) END AS target FROM shared),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM plan),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS ahead
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken,
  epochs, greatest(0, least(size, rest - ahead))::BIGINT AS part FROM placed
"""
