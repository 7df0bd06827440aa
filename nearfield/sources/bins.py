"""Vector and label files: typed binary matrices, label lists, sparse label matrices.

A matrix file has its row and column count (32 or 64 bit) and then the rows. Matrices and sparse label
matrices of any size are read in byte ranges: the driver looks at the header only, and each task reads its own
rows. Label text files are read whole, in one task, since their line numbers are the ids.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element types by file suffix.
TYPES = {"fbin": np.dtype("<f4"), "hbin": np.dtype("<f2"), "f16bin": np.dtype("<f2"), "ibin": np.dtype("<i4"), "u8bin": np.dtype("u1"), "i8bin": np.dtype("i1")}
#: Bytes of a matrix that a task reads.
BLOCK_BYTES = 1 << 26
_SPARK = {"f": "float", "i": "int", "u": "int"}


def element_type(path: str) -> np.dtype:
    suffix = path.rsplit(".", 1)[-1]
    if suffix not in TYPES:
        raise ValueError(f"unknown suffix: {suffix}")
    return TYPES[suffix]


class _File:
    """Byte ranges of a file in any store that Spark can open."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark = spark

    def head(self, n: int) -> bytes:
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def uri(self) -> str:
        """The qualified path as Arrow's file systems read it."""
        uri = self.fs.makeQualified(self.path).toString()
        return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def size(self) -> int:
        return self.fs.getFileStatus(self.path).getLen()

    def write(self, chunks) -> None:
        self.fs.setWriteChecksum(False)  # a plain file, as other tools write it
        side = self.path.getParent().suffix(f"/.{self.path.getName()}.crc")
        if self.fs.exists(side):
            self.fs.delete(side, False)
        stream = self.fs.create(self.path, True)
        try:
            for chunk in chunks:
                stream.write(bytearray(chunk))
        finally:
            stream.close()


def _opened(uri: str):
    """A file at a URI, for reading at any place: local, HDFS, S3 or GCS. Runs on executors."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def shape(spark: SparkSession, path: str, header: str = "<ii") -> tuple[int, int]:
    return struct.unpack(header, _File(spark, path).head(struct.calcsize(header)))


def read_matrix(spark: SparkSession, path: str, header: str = "<ii", rows: int | None = None, start: int = 0, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding): ids are row numbers. rows and start choose a subset. header: "<ii", "<II" or "<qq"."""
    kind = element_type(path)
    n, dim = shape(spark, path, header)
    skip = struct.calcsize(header)
    width = dim * kind.itemsize
    if _File(spark, path).size() < skip + n * width:
        raise ValueError("a matrix file that ends early")
    stop = n if rows is None else min(n, start + rows)
    out = _SPARK[kind.kind]
    arrow = pa.float32() if out == "float" else pa.int32()
    # blocks of rows, each read at its offset by the task that has it
    size = max(1, (BLOCK_BYTES if width else 1) // max(width, 1))
    blocks = -(-max(stop - start, 0) // size)
    uri = _File(spark, path).uri()

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                first, last = start + block * size, min(start + (block + 1) * size, stop)
                with _opened(uri) as f:
                    f.seek(skip + first * width)
                    for at in range(first, last, 8192):
                        end = min(at + 8192, last)
                        rows_ = np.frombuffer(f.read((end - at) * width), kind).reshape(end - at, dim)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, end)), pa.array(list(rows_.astype(np.float32 if out == "float" else np.int32)), pa.list_(arrow))], [id_, vector])

    return spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInArrow(run, f"{id_} long, {vector} array<{out}>")


def write_matrix(rows: DataFrame, path: str, header: str = "<ii", id_: str = "vec_id", vector: str = "embedding") -> None:
    """Rows in id order as one file (a file format of one stream): pulled partition by partition, not at once."""
    kind = element_type(path)
    ordered = rows.select(id_, vector).orderBy(id_)
    n = rows.count()
    first = ordered.first()
    dim = len(first[1]) if first else 0

    def chunks():
        yield struct.pack(header, n, dim)
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            yield np.asarray(row[1], kind).tobytes()

    _File(rows.sparkSession, path).write(chunks())


def read_labels_txt(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, labels): a line per row with whole numbers between commas; -1 or an empty line: no label."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "\r", "").alias("value"))
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    parts = F.transform(F.split(F.trim("line"), ","), lambda x: F.trim(x).cast("int"))
    return lines.select(F.col("at").cast("long").alias("vec_id"), F.when(F.trim("line").isin("", "-1"), F.array().cast("array<int>")).otherwise(parts).alias("labels"))


def write_labels_txt(rows: DataFrame, path: str) -> None:
    ordered = rows.orderBy("vec_id").select(F.when(F.size("labels") == 0, "-1").otherwise(F.array_join(F.col("labels").cast("array<string>"), ",")).alias("line"))
    _File(rows.sparkSession, path).write((r[0] + "\n").encode() for r in ordered.toLocalIterator())


def read_spmat(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, labels) of a sparse matrix file: three 64-bit counts, 64-bit row starts, 32-bit columns."""
    file = _File(spark, path)
    n, _, _ = struct.unpack("<qqq", file.head(24))
    uri, size = file.uri(), BLOCK_BYTES // 64
    blocks = -(-n // size)

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                with _opened(uri) as f:
                    for at in range(block * size, min((block + 1) * size, n), 8192):
                        end = min(at + 8192, n, (block + 1) * size)
                        f.seek(24 + 8 * at)
                        starts = np.frombuffer(f.read(8 * (end - at + 1)), "<i8")
                        f.seek(24 + 8 * (n + 1) + 4 * int(starts[0]))
                        columns = np.frombuffer(f.read(4 * int(starts[-1] - starts[0])), "<i4")
                        lists = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pa.array(columns))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, end)), lists], ["vec_id", "labels"])

    return spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInArrow(run, "vec_id long, labels array<int>")


def write_spmat(rows: DataFrame, path: str, n_labels: int) -> None:
    sizes = [r[0] for r in rows.orderBy("vec_id").select(F.size("labels")).toLocalIterator()]

    def chunks():
        yield struct.pack("<qqq", len(sizes), n_labels, sum(sizes))
        yield np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype("<i8").tobytes()
        for r in rows.orderBy("vec_id").select("labels").toLocalIterator():
            yield np.asarray(r[0], "<i4").tobytes()

    _File(rows.sparkSession, path).write(chunks())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .txt or .spmat."""
    readers = {"txt": read_labels_txt, "spmat": read_spmat}
    suffix = path.rsplit(".", 1)[-1]
    if suffix not in readers:
        raise ValueError(f"unknown label file: {path}")
    return readers[suffix](spark, path)


def read_labeled(spark: SparkSession, vectors: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, embedding, labels) and the inverted lists (label, vec_id)."""
    data = read_matrix(spark, vectors).join(read_labels(spark, labels), "vec_id", "left")
    return data, data.select(F.explode("labels").alias("label"), "vec_id")


def read_cached_matrix(spark: SparkSession, path: str, rows: int, columns: int) -> DataFrame:
    """A graph cache (64-bit header) whose shape must be as given."""
    if shape(spark, path, "<qq") != (rows, columns):
        raise ValueError("a cached matrix of another shape")
    return read_matrix(spark, path, "<qq")


def split_ground_truth(combined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, ids) and (query_id, distances) of array-form neighbours."""
    return combined.select("query_id", "ids"), combined.select("query_id", "distances")


def from_arrays(spark: SparkSession, vectors: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    """A numpy matrix as rows, through Arrow."""
    ids = np.arange(len(vectors)) if ids is None else ids
    table = pa.table([pa.array(ids, pa.int64()), pa.array(list(np.asarray(vectors, np.float32)), pa.list_(pa.float32()))], ["vec_id", "embedding"])
    return spark.createDataFrame(table)


def to_arrays(neighbours: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense (queries x k) ids and distances of a search result; missing places are -1 and infinite. Results of a search are small: queries x k."""
    rows = neighbours.select("query_id", "rank", "vec_id", "distance").toPandas()
    place = {q: i for i, q in enumerate(sorted(rows.query_id.unique()))}
    ids, far = np.full((len(place), k), -1, np.int64), np.full((len(place), k), np.inf)
    at = rows.query_id.map(place).to_numpy(int) if len(rows) else np.zeros(0, int)
    ids[at, rows["rank"] - 1], far[at, rows["rank"] - 1] = rows.vec_id, rows.distance
    return ids, far
