"""Document fingerprints by winnowing, in DataFrame operations.

A text's words give overlapping k-grams. Their rolling hash is the cyclic polynomial of the words' 64-bit
hashes: a gram of m + n words is the first part's hash rotated by n, xor the second part's. Arrays have no
running state, so instead of rolling word by word all grams are composed from shorter ones that neighbours
share, in log2(k) passes; the values are those of the rolling recurrence. Of every window of consecutive
hashes the smallest is kept, the rightmost if several are equal; a window's place of the least hash is
composed from halves in the same way. Kept hashes are whole (64 bits) and carry their positions, at any
length. Two texts that share a run of at least ``window + k - 1`` words share a kept hash.

Next documents are found in one shuffle: rows are dealt out by ranges of keys, and the first row of
each range is also sent, as a guest, to the range before, so every row's follower is in its range.
Ranges are of key and text hash, so that rows that share a key are dealt out, too.

Defined cases: null text is empty; an empty text has an empty fingerprint; a text with fewer than
k words is one gram, with fewer than ``window`` grams one window. Likeness is the Jaccard index of
the sets of kept hashes; equal fingerprints (empty ones too) have likeness 1. Rows that share a
key are documents of their own and follow each other in the order of their text's hash; a single
row follows itself. Rows with a null key have no next document (an empty text stands in).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions

K, WINDOW = 5, 16


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _composed(first: Column, length: int, join) -> Column:
    """For each place what ``join(left, right, n)`` makes of the ``length`` elements of ``first`` from there, n of them in the right part."""
    if length == 1:
        return first
    half = length // 2
    pairs = lambda a, b, skip, n: F.zip_with(F.slice(a, F.lit(1), F.size(b) - skip), F.slice(b, F.lit(skip + 1), F.size(b) - skip), lambda x, y: join(x, y, n))
    both = _let(_composed(first, half, join), lambda a: pairs(a, a, half, half))
    if length % 2 == 0:
        return both
    n = F.size(first) - (length - 1)
    return F.zip_with(F.slice(both, F.lit(1), n), F.slice(first, F.lit(length), n), lambda x, y: join(x, y, 1))


def _rotated(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def gram_hashes(words: Column, k: int = K) -> Column:
    """Hashes of the k-grams of an array of word hashes; fewer than k words are one gram."""
    rolled = lambda h, n: F.transform(_composed(h, n, lambda x, y, m: _rotated(x, m).bitwiseXOR(y)), lambda x: F.xxhash64(x))
    few = F.array(F.xxhash64(words))
    return F.when(F.size(words) == 0, F.array().cast("array<long>")).when(F.size(words) < k, few).otherwise(rolled(words, k))


def kept_places(hashes: Column, window: int = WINDOW) -> Column:
    """Places of the least hash of each window, the rightmost of equal ones; fewer hashes than a window are one."""
    least = lambda x, y, _: F.when(F.get(hashes, y) <= F.get(hashes, x), y).otherwise(x)
    places = F.sequence(F.lit(0), F.size(hashes) - 1)
    half = 1 << (window.bit_length() - 1)  # windows are two overlapping runs of this length
    rest = window - half
    runs = _let(places, lambda p: _composed(p, half, least))
    whole = runs if not rest else _let(runs, lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - rest), F.slice(a, F.lit(rest + 1), F.size(a) - rest), lambda x, y: least(x, y, 0)))
    single = F.array(F.aggregate(places, F.lit(0), lambda x, y: least(x, y, 0)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<int>")).when(F.size(hashes) <= window, single).otherwise(F.array_distinct(whole))


def kept(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The winnowed k-grams of a text: (hashes, places), two arrays."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        return _let(kept_places(h, window), lambda p: F.struct(F.transform(p, lambda i: F.get(h, i)).alias("hashes"), p.alias("places")))

    return _let(words, lambda w: _let(gram_hashes(w, k), chosen))


def spans(found: Column) -> Column:
    """Array of (hash, place in words) of kept()."""
    return F.zip_with(found["hashes"], found["places"], lambda h, p: F.struct(h.alias("hash"), p.alias("place")))


def digest(found: Column) -> Column:
    """The fingerprint as one string: a digest of all kept hashes with their places."""
    return F.md5(F.concat(F.array_join(found["hashes"].cast("array<string>"), ","), F.lit(";"), F.array_join(found["places"].cast("array<string>"), ",")))


def hashes(found: Column) -> Column:
    """The set of kept hashes."""
    return F.array_distinct(found["hashes"])


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def range_starts(ids: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The least (doc_id, mark) of each of about ``ranges`` even ranges: one pair per range comes to the driver."""
    spread = ids.repartitionByRange(ranges, "doc_id", "mark").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    return sorted((r["first"][0], r["first"][1]) for r in spread.select("first").collect())


def range_of(key: Column, mark: Column, starts: list[tuple[int, int]]) -> Column:
    """The place of the last start that isn't after (key, mark), by bisection."""
    keys, marks = F.lit([k for k, _ in starts]), F.lit([m for _, m in starts])
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(max(len(starts) - 1, 1).bit_length()))])
    reached = lambda i: (F.get(keys, i) < key) | (F.get(keys, i) == key) & (F.get(marks, i) <= mark)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(reached(at + step), F.lit(False)), at + step).otherwise(at))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, spans) of every row."""
    found = docs.select(F.col(key), kept(F.col(text)).alias("kept"))
    return found.select(F.col(key), digest(F.col("kept")).alias("fingerprint"), spans(F.col("kept")).alias("spans"))


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    deal = 8 * partitions(docs.sparkSession)
    starts = range_starts(rows.select("doc_id", "mark").filter("doc_id is not null"), deal) or [(0, 0)]
    at = range_of(F.col("doc_id"), F.col("mark"), starts)
    keys, marks = F.lit([k for k, _ in starts]), F.lit([m for _, m in starts])
    placed = rows.withColumn("at", at).withColumn("first", (F.get(keys, F.col("at")) == F.col("doc_id")) & (F.get(marks, F.col("at")) == F.col("mark")))
    real, guest, unkeyed = 0, 1, 2
    seat = lambda range_, kind: F.struct(range_.cast("int").alias("range"), F.lit(kind).alias("kind"))
    seats = F.when(F.col("doc_id").isNull(), F.array(seat(F.pmod(F.col("mark"), F.lit(len(starts))), unkeyed)))
    seats = seats.when(F.col("first"), F.array(seat(F.col("at"), real), seat(F.pmod(F.col("at") - 1, F.lit(len(starts))), guest))).otherwise(F.array(seat(F.col("at"), real)))
    placed = placed.select("doc_id", "text", "mark", F.inline(seats)).repartition(partitions(docs.sparkSession), "range")

    found = placed.withColumn("kept", kept(F.col("text"))).withColumn("fingerprint", digest(F.col("kept"))).withColumn("hashes", hashes(F.col("kept"))).drop("kept")
    order = Window.partitionBy("range").orderBy("kind", "doc_id", "mark")
    led = found.withColumn("next", F.lead(F.struct("text", "hashes", "fingerprint")).over(order)).filter(F.col("kind") != guest)
    empty = digest(F.struct(F.array().cast("array<long>").alias("hashes"), F.array().cast("array<int>").alias("places")))
    nothing = F.struct(F.lit("").alias("text"), F.array().cast("array<long>").alias("hashes"), empty.alias("fingerprint"))
    led = led.withColumn("next", F.when(F.col("kind") == real, F.col("next")).otherwise(nothing))
    both = led.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.char_length("text") / 2).cast("int"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(next.text, 1, half))"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_kept", kept(F.col("edited")))
    both = both.withColumn("edited_fingerprint", digest(F.col("edited_kept"))).withColumn("edited_hashes", hashes(F.col("edited_kept")))
    near = lambda mark, set_: F.when(F.col("fingerprint") == F.col(mark), 1.0).otherwise(likeness(F.col("hashes"), F.col(set_)))
    return both.select(F.col("doc_id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "edited_hashes").alias("near_edited"), near("next.fingerprint", "next.hashes").alias("near_next"))
