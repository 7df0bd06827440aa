"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed to 64 bits. Each shingle flips one bit of a wide bit
sketch, so the Hamming distance of two sketches is at most the size of the symmetric difference.
Sets of size n and m with Jaccard index of at least a/b differ in at most (n + m)(b - a)/(b + a)
shingles. Sketches are cut into chunks, as many as a size band asks for; a chunk is known by
the XOR of its bits' codes. If two sets differ in at most k shingles, at most k chunks of either
differ, so each document needs to index only k + 1 of its non-empty chunks: taken in one global
order, the two first runs must share a chunk (pigeonhole). The order is by how common a chunk is,
rare ones first, so that passages which many documents share are hardly ever indexed.

Candidates share a chunk. The links found are exact, the components too:

1. Small chunks give all their pairs, larger ones each set with the one before it in order of size.
   Of these partners each set is tried against the few that are closest by Hamming distance.
2. The other pairs of step 1 are verified if their sets are in different components (inside a
   component a pair changes nothing); then, of the larger chunks, searched in blocks, each set's
   pairs with sets of other components, if they are more than a few only the closest.
3. Last, the members of chunks of which pairs weren't given are searched again, for all pairs that are
   still in different components. Here their sets travel with them: pairs are verified where they are found,
   and of a run's links only those are given that join components (fewer than it has classes).

In all steps only pairs that can be linked by the Hamming distance of their dense sketches are
verified on the sets themselves.

Texts with the same set are one class from the start, so copies are never expanded into pairs.

A set of n differs in at most n/3 shingles from a partner (threshold 3/4) and has at least n
chunks, of which 0.63 n or more are non-empty on average; that fewer than n/3 + 1 are has a
probability below 1e-12 a document (small sets have 2^30 chunks). Shingle hashes have 64 bits;
a class's id has 57 bits of hash and its size class.

Defined cases: null or empty text has no shingles and is linked with nothing; a text with fewer
words than a shingle is one shingle; rows that repeat a key are each looked at, and all of them
get the component of the smallest key; a null key is kept, gets a component only from others, and
never names one; very long texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textarrays as ta
from .common import bounded_batches, materialize, partitions, slices, small_side

U = np.uint64
SLOTS = 1 << 20  # of the count of chunks: 4 MB, whatever the input
SMALL = 16  # classes of a chunk that is searched by all its pairs
FEW = 4  # partners of a set in a large chunk that are all tried at once
HOT_COPIES = 100_000  # rows of a class that is joined by broadcast: there is at most one for so many rows
HOT = 1 << 20  # codes in a part of the index; classes of a chunk that isn't split
FILTER = 1 << 26  # places of the filter of keys whose sets are needed
BLOCK = 2048  # classes of a chunk that are searched at once
FIRST = 3  # partners that a set is tried against before the open chunks are searched
_SALT = ta.mix(np.arange(1, 65, dtype=np.uint64) * U(0xD1B54A32D192ED03)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5):
    """Sorted array of distinct 64-bit shingle hashes of each row, a run of rows at a time."""
    for first, last in slices(offsets, ta.SLICE):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, heads = ta.words(part, at)
        h = ta.run_hashes(part, starts, ends, lower=True)
        n = len(h)
        grams = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            grams += h[j : n - k + 1 + j] * _SALT[j] if n >= k else U(0)
        grams = ta.mix(grams)
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif b > a:
                yield ta.mix((h[a:b] * _SALT[: b - a]).sum(keepdims=True) + U(0xA5A5A5A5 + b - a))
            else:
                yield np.zeros(0, np.uint64)


def size_steps(a: int, b: int, most: int = 1 << 40) -> np.ndarray:
    """Starts of size classes so wide that partners are in the same or neighbouring ones."""
    out = [1]
    while out[-1] < most and len(out) < 127:
        out.append(out[-1] * b // a + 1)
    return np.array(out, np.int64)


def class_id(shingles: np.ndarray, steps: np.ndarray) -> int:
    """A signed 64-bit id of a set: a hash, its last 7 bits the size class."""
    mixed = ta.mix(shingles ^ U(0x5851F42D4C957F2D))
    folded = mixed.sum(keepdims=True) + np.bitwise_xor.reduce(mixed, keepdims=True) * _SALT[9] + U(len(shingles))
    return int((ta.mix(folded) & ~U(127) | U(np.searchsorted(steps, len(shingles), "right"))).view(np.int64)[0])


def most_apart(n: int, m: int, a: int, b: int) -> int:
    """Shingles in which sets of n and m can differ if their Jaccard index is at least a/b."""
    return (n + m) * (b - a) // (a + b)


def reach(n: int, a: int, b: int) -> int:
    """Most shingles in which a set of n can differ from a partner of any size."""
    return most_apart(n, n * b // a, a, b)


def bands(n: int, a: int, b: int) -> list[int]:
    """Size bands [4^j, 4^(j+1)) in which a set of n has partners that are not smaller, its own first."""
    own = (n.bit_length() - 1) // 2
    return [own, own + 1] if n * b // a >= 4 ** (own + 1) else [own]


def elements(shingles: np.ndarray, band: int) -> np.ndarray:
    """One 64-bit code per non-empty chunk of a set's sketch in a band; the low 4 bits name the band.

    The sketch has 2^64 bits, a shingle's hash being its bit; chunk: the leading 2 (band + 1) bits,
    for sets of under 64 the leading 30 bits.
    """
    chunk = shingles >> U(64 - (2 * (band + 1) if band > 2 else 30))
    heads = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    folded = np.bitwise_xor.reduceat(ta.mix(shingles ^ _SALT[11]), heads)
    return (ta.mix(folded + chunk[heads] * _SALT[12] + _SALT[16 + band]) & ~U(15)) | U(band)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The dense sketch for Hamming distances: one bit for each chunk that the set's own band can have, one to four for a shingle (64 at least)."""
    bits = 4 ** (max((len(shingles).bit_length() - 1) // 2, 2) + 1)
    out = np.zeros(bits, np.uint8)
    np.bitwise_xor.at(out, (shingles >> U(65 - bits.bit_length())).astype(np.int64), 1)
    return np.packbits(out)


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Hamming distances of a sketch to the rows of an array of sketches; the wider ones are folded to the narrower width."""
    while len(one) > many.shape[1]:
        one = _folded(one[None])[0]
    while many.shape[1] > len(one):
        many = _folded(many)
    return np.bitwise_count(many ^ one).sum(1, dtype=np.int64)


def _folded(rows: np.ndarray) -> np.ndarray:
    """Sketches of a quarter of the width: neighbours become one bit by parity."""
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, 4)
    return np.packbits(bits.sum(2, dtype=np.uint8) & 1, axis=1)


def _text(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def classes(docs: DataFrame, a: int, b: int, k: int) -> DataFrame:
    """(doc_id, n, cid) of every row, with the dense sketch where a task first sees the class, and rows (block, counts) with how often chunks occur, by slot."""

    steps = size_steps(a, b)

    def run(batches):
        counts, seen = np.zeros(SLOTS, np.int64), set()
        for batch in batches:
            sizes, ids, marks = [], [], []
            for s in shingle_sets(*ta.buffers(batch.column(1)), k):
                sizes.append(len(s))
                ids.append(class_id(s, steps) if len(s) else None)
                marks.append(sketch(s).tobytes() if len(s) and ids[-1] not in seen else None)
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(ids[-1])
                for band in bands(len(s), a, b) if len(s) else ():
                    np.add.at(counts, (elements(s, band) >> U(44)).astype(np.int64), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        blocks = [x for x in range(0, SLOTS, SLOTS // 32) if counts[x : x + SLOTS // 32].any()]
        m = len(blocks)
        if m:
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([x // (SLOTS // 32) for x in blocks], pa.int32()), pa.array([counts[x : x + SLOTS // 32].astype(np.uint32).tobytes() for x in blocks], pa.binary())], names)

    names = ["doc_id", "n", "cid", "bits", "block", "counts"]
    return docs.mapInArrow(run, "doc_id long, n long, cid long, bits binary, block int, counts binary")


def common_counts(parts: DataFrame) -> np.ndarray:
    """Sum of the slots over all tasks: added up by block on the executors, 2 MB in all."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(data.as_py(), np.uint32).astype(np.int64)
                sums[block] = sums[block] + got if block in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    summed = parts.filter("block is not null").select("block", "counts").repartition(32, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(SLOTS, np.int64)
    for block, data in summed.collect():
        out[block * (SLOTS // 32) : (block + 1) * (SLOTS // 32)] += np.frombuffer(data, np.int64)
    return out


def shared_chunks(docs: DataFrame, counts: np.ndarray, a: int, b: int, k: int) -> DataFrame:
    """What meets in the indexed chunks: pairs (x, y) of classes, and members (elem, x) of chunks with more than ``SMALL`` classes.

    A small chunk gives all its pairs, a larger one its members, and as pairs only each member with
    the one before it in the order of sizes. Pairs of unfit sizes are left out at once; pairs are
    distinct within a task's part. Chunks with the same members are one: elem is a hash of the members.

    Codes travel as packed arrays, dealt out by code; a class is sent once by each task that has it. The
    number of parts grows with the number of codes, and a code that more than ``HOT`` classes may have is dealt
    out by class as well: such a chunk keeps its code as elem and gives members only, and chains of each part.
    """
    spark = docs.sparkSession
    parts, steps = max(8 * partitions(spark), int(counts.sum() // HOT)), size_steps(a, b)
    sent = spark.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    def emit(codes, ids):
        codes, ids = np.concatenate(codes), np.concatenate(ids)
        share = (sent.value[(codes >> U(44)).astype(np.int64)] // HOT).astype(np.uint64)
        part = (((codes >> U(4)) + ta.mix(ids.view(np.uint64)) % (share + U(1))) % U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, ids = part[order], ids[order]
        # the part tells the rest: a code travels as 40 bits
        short = np.ascontiguousarray((codes[order] >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for x in range(0, len(heads), 256):
            some = list(zip(heads[x : x + 256], [*heads[x + 1 : x + 257], len(part)][: len(heads[x : x + 256])], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[[i for i, _ in some]]), pa.array([short[i:j].tobytes() for i, j in some], pa.binary()), pa.array([ids[i:j].tobytes() for i, j in some], pa.binary())], ["part", "codes", "ids"])

    def index(batches):
        rank, seen, codes, ids, held = sent.value, set(), [], [], 0
        for batch in batches:
            for s in shingle_sets(*ta.buffers(batch.column(1)), k):
                if not len(s) or (cid := class_id(s, steps)) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(cid)
                need = reach(len(s), a, b) + 1
                for band in bands(len(s), a, b):
                    e = elements(s, band)
                    common = np.minimum(rank[(e >> U(44)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
                    order = np.argsort((common << U(40)) | (e >> U(24)), kind="stable")[:need]
                    codes.append(e[order])
                    ids.append(np.full(len(order), cid, np.int64))
                    held += len(order)
                if held >= 1 << 18:
                    yield from emit(codes, ids)
                    codes, ids, held = [], [], 0
        if codes:
            yield from emit(codes, ids)

    def meet(table: pa.Table) -> pa.Table:
        short = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 5) for x in table.column("codes")])
        codes = np.ascontiguousarray(np.pad(short, ((0, 0), (0, 3)))).view("<u8").ravel() << U(24)
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("ids")])
        order = np.lexsort((ids, ids & 127, codes))  # by size class within a chunk
        codes, ids = codes[order], ids[order]
        fresh = np.append(True, (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1]))
        codes, ids = codes[fresh], ids[fresh]
        heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        sizes = np.diff(np.append(heads, len(codes)))
        split = sent.value[(codes[heads] >> U(44)).astype(np.int64)] >= HOT
        # chunks with the same members: the first of them stands for all
        elem = np.add.reduceat(ta.mix(ids.view(np.uint64) ^ _SALT[13]), heads)
        elem = np.where(split, codes[heads], ta.mix(elem + sizes.astype(np.uint64)))
        _, first = np.unique(elem, return_index=True)
        first = np.sort(first)
        keep = np.repeat(np.isin(np.arange(len(heads)), first), sizes)
        ids, elem, split, sizes = ids[keep], elem[first], split[first], sizes[first]
        heads = np.cumsum(sizes) - sizes
        pairs = [np.zeros((2, 0), np.int64)]
        for size in range(2, SMALL + 1):
            own = ids[heads[(sizes == size) & ~split][:, None] + np.arange(size)]
            one, two = np.triu_indices(size, 1)
            pairs.append(np.stack([own[:, one].ravel(), own[:, two].ravel()]))
        many = np.repeat((sizes > SMALL) | split, sizes)
        later = many & (np.arange(len(ids)) != np.repeat(heads, sizes))
        pairs.append(np.stack([ids[np.flatnonzero(later) - 1], ids[later]]))
        pairs = np.concatenate(pairs, 1)
        pairs = np.sort(pairs[:, np.abs((pairs[0] & 127) - (pairs[1] & 127)) <= 1], axis=0)
        pairs = np.unique(pairs, axis=1)
        n, m = pairs.shape[1], int(many.sum())
        elems = np.repeat(elem, sizes)[many].view(np.int64)
        columns = [pa.concat_arrays([pa.array(pairs[0]), pa.array(ids[many])]), pa.concat_arrays([pa.array(pairs[1]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(elems)])]
        return pa.table(columns, ["x", "y", "elem"])

    packed = docs.mapInArrow(index, "part int, codes binary, ids binary")
    return packed.groupBy("part").applyInArrow(meet, "x long, y long, elem long")


def key_filter(keys: DataFrame) -> np.ndarray:
    """Which of ``FILTER`` places the keys (of) are hashed to: packed bits, 8 MB at any size."""
    place = key_place("of")
    words = keys.filter("of is not null").groupBy(F.shiftright(place, 6).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def key_place(column: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("place")), F.lit(FILTER)).cast("long")


def sets_of(docs: DataFrame, needed: DataFrame, k: int, steps: np.ndarray) -> DataFrame:
    """(cid, n, hashes) of classes, from one text of each. needed: (of, cid), one row a class; of: the least key that has the class.

    No text is shuffled: texts are read where they are, those whose key can't be needed (by ``key_filter``) or that a
    task had before are left out, and the sets of the others meet ``needed`` by class.
    """
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(needed))

    def run(batches):
        bits, seen = sent.value, set()
        for batch in batches:
            place = batch.column(1).to_numpy(zero_copy_only=False)
            may = ((bits[place >> 6] >> (place & 63).astype(np.uint64)) & U(1)).astype(bool) | np.array(batch.column(0).is_null())
            found = []
            for s in shingle_sets(*ta.buffers(batch.column(2).filter(pa.array(may))), k):
                if len(s) and (cid := class_id(s, steps)) not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(cid)
                    found.append((cid, len(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], ["cid", "n", "hashes"])

    made = docs.select("doc_id", key_place("doc_id").alias("place"), "text").mapInArrow(run, "cid long, n long, hashes binary")
    n = needed.count()
    made = materialize(made.join(small_side(needed.select("cid"), n), "cid", "left_semi"), "join-sets")
    return made if made.count() <= n else materialize(made.dropDuplicates(["cid"]), "join-sets")  # rows repeat a key, or a copy passed the filter


def verified(pairs: DataFrame, sets: DataFrame, a: int, b: int) -> DataFrame:
    """The pairs (x, y) of classes that are linked."""

    def run(batches):
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(linked_sets(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), a, b))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["x", "y"])

    left = sets.select(F.col("cid").alias("x"), F.col("n").alias("n_x"), F.col("hashes").alias("h_x"))
    right = sets.select(F.col("cid").alias("y"), F.col("n").alias("n_y"), F.col("hashes").alias("h_y"))
    both = pairs.join(left, "x").join(right, "y").filter((F.col("n_x") * b >= F.col("n_y") * a) & (F.col("n_y") * b >= F.col("n_x") * a))
    return both.select("x", "y", "h_x", "h_y").mapInArrow(run, "x long, y long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, comp): the least id reachable, by passing minima along links and jumping ahead."""
    both = materialize(links.select("x", "y").union(links.select("y", "x")).distinct(), "join-links")
    comp = materialize(nodes.select("cid", F.col("cid").alias("comp")), "join-comp")
    while True:
        near = both.join(comp, F.col("y") == F.col("cid")).groupBy(F.col("x").alias("cid")).agg(F.min("comp").alias("near"))
        moved = comp.join(near, "cid", "left").select("cid", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        ahead = comp.select(F.col("cid").alias("mid"), F.col("comp").alias("next"))
        new = materialize(moved.join(ahead, "mid").select("cid", F.col("next").alias("comp"), (F.col("next") != F.col("old")).alias("moved")), "join-comp")
        comp = new.select("cid", "comp")
        if new.filter("moved").isEmpty():
            return comp


def likely(pairs: DataFrame, known: DataFrame, a: int, b: int) -> DataFrame:
    """(x, y, apart) of pairs of classes that can be linked by size and Hamming distance; apart: over both sizes. known: (cid, n, bits)."""
    def run(batches):
        for batch in batches:
            share = []
            for n, m, s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                far = apart(np.frombuffer(s.as_buffer(), np.uint8), np.frombuffer(t.as_buffer(), np.uint8)[None])[0]
                share.append(far / (n + m) if far <= most_apart(n, m, a, b) else None)
            share = pa.array(share, pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(share.is_valid()) for c in (0, 1)), share.drop_null()], ["x", "y", "apart"])

    left, right = (known.select(*(F.col(c).alias(f"{c}_{side}") for c in ("cid", "n", "bits"))) for side in "xy")
    both = pairs.join(left, F.col("x") == F.col("cid_x")).join(right, F.col("y") == F.col("cid_y"))
    both = both.filter((F.col("n_x") * b >= F.col("n_y") * a) & (F.col("n_y") * b >= F.col("n_x") * a))
    return both.select("x", "y", "n_x", "n_y", "bits_x", "bits_y").mapInArrow(run, "x long, y long, apart double")


def linked_sets(s: np.ndarray, t: np.ndarray, a: int, b: int) -> bool:
    """Whether two sets (sorted hashes) have a Jaccard index of at least a/b."""
    both = np.sort(np.concatenate([s, t]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return b * same >= a * (len(s) + len(t) - same)


def cross_pairs(open_chunks: DataFrame, known: DataFrame, a: int, b: int, few: int | None) -> DataFrame:
    """(x, y, elem): pairs of classes that share a chunk, are in different components and can be linked by size and Hamming distance.

    few: a class outside a chunk's largest component that has more such partners gives the closest
    one only; rows (elem, x) name it and its partners as members of the chunk that have to be searched again. None: all pairs are
    verified here on the sets that ``known`` then has (hashes), and a run gives a link for each two components that it joins.
    open_chunks: (elem, cid, comp). A chunk with more than ``BLOCK`` classes is searched by size
    class, each with the one below it. What is still larger is cut into blocks; each pair of
    blocks is searched as one run of rows, whole runs in one task, many runs to a task.
    """
    # only chunks above BLOCK are cut, and they are few: at most a BLOCK-th of the rows, so that their names can be sent to all rows
    step = F.col("cid").bitwiseAND(127).cast("int")
    large = open_chunks.groupBy("elem").count().filter(F.col("count") > BLOCK).select("elem")
    busy = small_side(materialize(large.withColumn("large", F.lit(True)), "join-large"))
    rows = open_chunks.join(busy, "elem", "left").withColumn("step", F.explode(F.when(F.col("large"), F.array(step, step + 1)).otherwise(F.array(F.lit(0)))))
    sizes = rows.filter("large").groupBy("elem", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(small_side(materialize(sizes, "join-sizes")), ["elem", "step"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("elem", "step", "cid", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    rows = rows.join(known, "cid").select("elem", "step", "i", "j", "own", "cid", "comp", "n", "bits", *(["hashes"] if few is None else []))
    rows = rows.repartition(4 * partitions(open_chunks.sparkSession), "elem", "step", "i", "j").sortWithinPartitions("elem", "step", "i", "j", "cid")

    def search(run: pa.Table, left: set):
        cid, comp, n, own = (run.column(c).to_numpy() for c in ("cid", "comp", "n", "own"))
        across = run.column("i")[0].as_py() != run.column("j")[0].as_py()
        widths = np.array([len(x.as_buffer()) for x in run.column("bits")])
        bits = {w: np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in run.column("bits").filter(pa.array(widths == w))]) for w in np.unique(widths)}
        place = np.zeros(len(cid), np.int64)
        for w in bits:
            place[widths == w] = np.arange((widths == w).sum())
        # rows of the largest component are only looked at from the others
        names, size = np.unique(comp, return_counts=True)
        largest = comp == names[size.argmax()]
        after = np.arange(len(cid))
        step = run.column("step")[0].as_py()
        below = (cid & 127) < step  # these meet each other in the step below
        if few is None:
            comp = comp.copy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in run.column("hashes")]
        for r in np.flatnonzero(~largest):
            ok = (comp != comp[r]) & (n * b >= n[r] * a) & (n[r] * b >= n * a) & (largest | (after > r))
            if across:
                ok &= own != own[r]
            if below[r]:
                ok &= ~below
            near, far = [], []
            for w in bits:
                at = np.flatnonzero(ok & (widths == w))
                if len(at):
                    d = apart(bits[widths[r]][place[r]], bits[w][place[at]])
                    fit = d <= (n[at] + n[r]) * (b - a) // (a + b)
                    near.append(at[fit])
                    far.append(d[fit] / (n[at[fit]] + n[r]))
            near, far = np.concatenate([np.zeros(0, np.int64), *near]), np.concatenate([np.zeros(0), *far])
            if few is not None and len(near) > few:
                left.update((run.column("elem")[0].as_py(), c) for c in cid[[r, *near]].tolist())
                near = near[far.argsort(kind="stable")[:1]]
            if few is None:
                links = []
                for t in near[far.argsort(kind="stable")].tolist():  # the closest first: what joins components spares the rest
                    if comp[t] != comp[r] and linked_sets(sets[r], sets[t], a, b):
                        comp[comp == comp[t]] = comp[r]
                        links.append(t)
                near = np.array(links, np.int64)
            if len(near):
                yield np.minimum(cid[near], cid[r]), np.maximum(cid[near], cid[r])

    def runs(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("elem", "step", "i", "j")])
            heads = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))).tolist()
            yield from found(table.slice(x, y - x) for x, y in zip(heads[:-1], heads[1:], strict=True))
            held = table.slice(heads[-1])
        if held is not None:
            yield from found([held])

    def found(tables):
        left: set = set()
        got = [pair for t in tables if t.num_rows > 1 for pair in search(t.combine_chunks(), left)]
        if got:
            x, y = (np.concatenate(c) for c in zip(*got, strict=True))
            both = np.unique(np.stack([x, y]), axis=1)
            n, m = both.shape[1], len(left)
            elems, members = (pa.array([c[i] for c in left], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(both[0]), members]), pa.concat_arrays([pa.array(both[1]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), elems])], ["x", "y", "elem"])

    return rows.mapInArrow(runs, "x long, y long, elem long").distinct()


def components_of(docs: DataFrame, key: str, text: str, k: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cid) of every row; and (cid, copies, component_id, kept) of the classes of components with more than one row.

    kept: the class of the component's least key (without any key, the least class).
    """
    a, b = threshold
    steps = size_steps(a, b)
    bounded_batches(docs.sparkSession)
    rows = _text(docs, key, text)
    parts = materialize(classes(rows, a, b, k), "join-classes")
    counts = common_counts(parts)
    own = parts.filter("block is null").select("doc_id", "n", "cid")
    chunks = materialize(shared_chunks(rows, counts, a, b, k), "join-chunks")

    pairs = chunks.filter("elem is null").select("x", "y").distinct()
    nodes = chunks.select(F.col("x").alias("cid")).union(chunks.filter("elem is null").select("y")).distinct()
    nodes = small_side(materialize(nodes, "join-nodes"))
    # a text that many rows have is one row from here on
    per_class = materialize(own.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "join-firsts")
    needed = per_class.select("cid", F.col("least").alias("of"))
    sketches = parts.filter("bits is not null").select("cid", "n", "bits").join(nodes, "cid", "left_semi").dropDuplicates(["cid"])
    sketches = materialize(sketches, "join-sketches")

    def sets_for(ends: DataFrame) -> DataFrame:
        return sets_of(rows, materialize(needed.join(small_side(ends), "cid", "left_semi"), "join-needed"), k, steps)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are linked: only the sets that occur in a pair are made and moved."""
        pairs = materialize(pairs.select("x", "y"), "join-pairs")
        sets = sets_for(pairs.select(F.col("x").alias("cid")).union(pairs.select("y")).distinct())
        return materialize(verified(pairs, sets, a, b), "join-linked")

    best = F.row_number().over(Window.partitionBy("y").orderBy("apart", "x"))
    near = materialize(likely(pairs, sketches, a, b).withColumn("place", best), "join-near")
    comp = components(sketches, linked(near.filter(F.col("place") <= FIRST)))

    def across(pairs: DataFrame) -> DataFrame:
        """With the components cx and cy of x and y, which differ."""
        one, two = (comp.select(F.col("cid").alias(c), F.col("comp").alias(f"c{c}")) for c in "xy")
        return pairs.join(one, "x").join(two, "y").filter("cx != cy").select("x", "y", "cx", "cy")

    def joined(links: DataFrame) -> DataFrame:
        """The components after further links."""
        merged = components(comp.select(F.col("comp").alias("cid")).distinct(), across(links).select(F.col("cx").alias("x"), F.col("cy").alias("y")))
        return materialize(comp.join(merged.select(F.col("cid").alias("comp"), F.col("comp").alias("root")), "comp").select("cid", F.col("root").alias("comp")), "join-joined")

    comp = joined(linked(across(near.filter(F.col("place") > FIRST).select("x", "y"))))
    members = chunks.filter("elem is not null").select("elem", F.col("x").alias("cid")).distinct()
    for few in (FEW, None):
        placed = members.join(comp, "cid")
        mixed = placed.groupBy("elem").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("elem")
        open_ = materialize(placed.join(mixed, "elem", "left_semi"), "join-open")
        if few is None:
            sets = sets_for(open_.select("cid").distinct())
            comp = joined(materialize(cross_pairs(open_, sketches.join(sets.select("cid", "hashes"), "cid"), a, b, None), "join-crossing"))
            break
        crossing = materialize(cross_pairs(open_, sketches, a, b, few), "join-crossing")
        comp = joined(linked(crossing.filter("elem is null")))
        # only members of pairs that weren't given are searched again
        members = crossing.filter("elem is not null").select("elem", F.col("x").alias("cid")).distinct()
    comp = comp.withColumnRenamed("comp", "root")

    # least key of each component, for classes that have more than one row or chunk
    groups = per_class.join(comp, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "cid")).alias("first"), F.sum("copies").alias("rows"))
    roots = roots.filter("rows > 1").select("root", "component_id", F.col("first.cid").alias("kept"))
    return own, materialize(groups.join(roots, "root").select("cid", "copies", "component_id", (F.col("cid") == F.col("kept")).alias("kept")), "join-named")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """(key, n_shingles, component_id) of every row: component_id is the least key reachable by links.

    Two documents link when b * |intersection| >= a * |union| for threshold (a, b).
    """
    found = _found(*components_of(docs, key, text, k, threshold))
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _found(own: DataFrame, named: DataFrame) -> DataFrame:
    """``own`` with component_id, null for rows that are alone.

    A class with very many rows would be one key of the join: such classes are few, and are sent to all rows.
    """
    hot = F.broadcast(materialize(named.filter(F.col("copies") > HOT_COPIES).select("cid", "component_id"), "join-hot"))
    rest = named.filter(F.col("copies") <= HOT_COPIES).select("cid", "component_id")
    return own.join(hot, "cid").unionByName(own.join(hot, "cid", "left_anti").join(rest, "cid", "left"), allowMissingColumns=True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or with as many underscores as it takes to be none of the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """One row of each group of rows that links connect, the one with the least key, in the same columns.

    Rows that share a key, and rows without one, are told apart by their text's class: of each group the least class of
    the least key stays, once. Rows without words stay (those that repeat key and text, once).
    """
    own, named = components_of(docs, key, text, k, threshold)
    of, cid = free_name(docs.columns, "of"), free_name(docs.columns, "cid")
    found = materialize(_found(own, named).select(F.col("doc_id").alias(of), (F.col("doc_id") != F.col("component_id")).alias("gone")), "join-found")
    odd = materialize(found.filter(F.col(of).isNotNull()).groupBy(of).count().filter("count > 1").select(of), "join-odd")
    drop = small_side(materialize(found.filter("gone").select(of).join(odd, of, "left_anti"), "join-gone"))
    if odd.isEmpty() and found.filter(F.col(of).isNull()).isEmpty():
        return docs.join(drop, F.col(key) == F.col(of), "left_anti")
    return _told_apart(docs, key, text, k, threshold, named, small_side(odd), drop, of, cid)


def _told_apart(docs: DataFrame, key: str, text: str, k: int, threshold: tuple[int, int], named: DataFrame, odd: DataFrame, drop: DataFrame, of: str, cid: str) -> DataFrame:
    """one_of_each() where keys repeat or are null: only those rows get their class, and are chosen by it."""
    steps, at = size_steps(*threshold), docs.columns.index(text)

    def classed(batches):
        for batch in batches:
            ids = [class_id(s, steps) if len(s) else None for s in shingle_sets(*ta.buffers(batch.column(at)), k)]
            yield batch.append_column(cid, pa.array(ids, pa.int64()))

    keyed = docs.filter(F.col(key).isNotNull())
    plain = keyed.join(odd, F.col(key) == F.col(of), "left_anti").join(drop, F.col(key) == F.col(of), "left_anti")
    rows = keyed.join(odd, F.col(key) == F.col(of), "left_semi").unionByName(docs.filter(F.col(key).isNull()))
    rows = rows.mapInArrow(classed, StructType([*docs.schema.fields, StructField(cid, LongType())]))
    other, kept = free_name([*docs.columns, of, cid], "class"), free_name([*docs.columns, of, cid], "kept")
    least = free_name([*docs.columns, of, cid], "least")
    rows = rows.join(named.select(F.col("cid").alias(other), F.col("kept").alias(kept), F.col("component_id").alias(least)), F.col(cid) == F.col(other), "left")
    # a class that isn't named is in one row only
    rows = rows.filter(F.col(other).isNull() | F.col(kept) & F.col(key).eqNullSafe(F.col(least)))
    once = rows.filter(F.col(cid).isNotNull()).dropDuplicates([cid]).unionByName(rows.filter(F.col(cid).isNull() & F.col(key).isNotNull()).dropDuplicates([key, text]))
    return plain.unionByName(once.unionByName(rows.filter(F.col(cid).isNull() & F.col(key).isNull())).select(*docs.columns))
