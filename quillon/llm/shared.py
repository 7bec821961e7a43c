"""Helpers that several operators of this subpackage use: written tables, word scanning, exact ranks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}

#: Spark's setting that deletes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of text that one NumPy step handles, so that its 64-bit work arrays stay near 50 MB.
SLICE_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without spark.checkpoint.dir gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own_dir[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends here, and a lost executor costs no more than a task."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files behind the table are of no use once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)



#: Rows of rank offsets (at most a row per range and one per key) up to which they are broadcast, some 40 bytes each.
OFFSET_ROWS = 100_000


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Adds `out`: the gapless rank from 0 of a row within `keys` in the order of `order`, which must be unique within keys; with `weight`, the sum of that column over the rows before.

    One key may hold most rows, so no window spans a whole key. Rows are dealt by range and sorted, and so
    numbered within their range as they are written. What precedes a range's rows of a key is a sum over
    the ranges before it: a small table of counts by range and key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    names = [f"_k{i}" for i in range(len(keys))]
    each = F.lit(1) if weight is None else F.col(weight)
    counts = dealt.select("_id", each.cast("long").alias("_w"), F.col("_part").alias("_p"), *[F.col(k).alias(x) for k, x in zip(keys, names)]).groupBy("_p", *names).agg(F.sum("_w").alias("_n"), F.min("_id").alias("_first"))
    counts = written(counts, "counts")
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if counts.count() <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    cond = F.col("_part") == F.col("_p")
    for k, x in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(x))
    inside = F.col("_id") - F.col("_first")
    if weight is not None:  # a range and key at a time, so a key that fills many ranges is no single group
        dealt = dealt.withColumn("_inside", F.coalesce(F.sum(weight).over(Window.partitionBy("_part", *keys).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.col("_inside")
    return dealt.join(offsets, cond).withColumn(out, inside + F.col("_before")).drop("_inside", "_id", "_part", "_p", "_first", "_before", *names)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns added beside it clash with none."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words as an array: runs of characters other than space and \\x09 to \\x0D. A null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)


# --- word scanning over Arrow batches -----------------------------------------------------------

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Words:
    """The words of a run of documents: `start` and `end` byte offsets, 64-bit `hash`, and `first`, the index of each document's first word (one more at the end)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        """data: the texts' UTF-8 bytes one after another; bounds: their offsets in it."""
        data = np.ascontiguousarray(data)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.bounds = data, bounds
        inside = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | edge[1:-1]
        self.end = np.flatnonzero(finish) + 1
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(self.start):  # in steps of SLICE_BYTES, as a long text would need 32 bytes of work arrays for each of its own
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + SLICE_BYTES)))
            self._hash_words(i, j)
            i = j
        self.first = np.searchsorted(self.start, bounds)

    def _hash_words(self, i: int, j: int) -> None:
        """Sets the hashes of words i to j: running sums of byte values times powers, so that a word's hash is one subtraction."""
        at = self.start[i]
        part = self.data[at : self.end[j - 1]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _powers(_BASE, len(part) + 1)[:-1], out=sums[1:])
        start, end = self.start[i:j] - at, self.end[i:j] - at
        self.hash[i:j] = mix((sums[end] - sums[start]) * _powers(_BASE_INV, len(part) + 1)[start] + (end - start).astype(np.uint64))

    def grams(self, n: int, salt: int = 1) -> np.ndarray:
        """Hash of the n words from each word on. The last n - 1 of a document run into the next one; see `whole`."""
        h = mix(self.hash + np.uint64((salt * 0xD1342543DE82EF95) & (2**64 - 1)))
        if len(h) < n:
            return np.zeros(0, dtype=np.uint64)
        power, back = _powers(_BASE, len(h) + 1), _powers(_BASE_INV, len(h) + 1)
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * power[:-1], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * back[: len(h) - n + 1])

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on belong to one document, for the words that grams(n) covers."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, dtype=bool)
        doc_end = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(total - n + 1) + n <= doc_end[: total - n + 1]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Of a string column, (first row, last row, bytes, bounds) of runs of rows of about `most` bytes; a longer text is a run of its own. A null text has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
