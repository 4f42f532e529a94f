"""Shared pieces: tables in the shared folder, ordered prefix sums, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import importable

#: What the operators count as white space between words: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where it is unset on one machine (tests)
    a temporary folder takes its place, and is stored in the setting; on a cluster that
    is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="epigrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """What Python workers get at once, in bytes: texts are of any length, and a batch by
    number of rows alone could outgrow a worker. The setting holds for the session from
    then on, since rows are made only when the caller reads them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    importable(spark)


def lean(of):
    """A function of Arrow batches that, when its task ends, gives freed memory back to the machine:
    a Python worker goes on to other tasks and would keep the most that it ever used."""

    def batches_of(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from of(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return batches_of


#: What a Python worker gets at once where whole texts go by that need not meet: the JVM and the
#: worker each hold a batch several times, and keep much of what they once held.
SMALL_BATCHES = "2m"


def few_rows(spark: SparkSession, columns: dict, schema: str) -> DataFrame:
    """A table of a few rows that the driver knows, by column. It goes to the JVM as Arrow: rows of
    Python objects would start a second set of Python workers wherever they are read."""
    import pyarrow as pa

    kinds = {f.name: {"integer": pa.int32(), "long": pa.int64()}[f.dataType.typeName()] for f in T._parse_datatype_string(schema).fields}
    return spark.createDataFrame(pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()}), schema)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, 16 bytes of the text's hash; null texts become empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("text_key"))


class Workspace:
    """Tables that cut lineage, written as Parquet in the shared folder.

    ``table`` holds an intermediate result until the block ends; ``result`` holds
    one that the caller reads lazily, until the application ends.
    """

    def __init__(self, spark: SparkSession, label: str, most: str = "8m"):
        bounded_batches(spark, most)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        fs, p = self._path(f"{self.root}/{name}")
        fs.delete(p, True)

    def result(self, df: DataFrame) -> DataFrame:
        fs, p = self._path(f"{self.root}-result")
        fs.deleteOnExit(p)
        return self._write(df, f"{self.root}-result")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        fs, p = self._path(self.root)
        fs.delete(p, True)


class Apart:
    """A table whose columns stand aside under names of their own (own_0, own_1, ...), so that
    a helper column can have any name. ``apart["text"]`` is the column that was ``text``."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"own_{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        return f"own_{[n.lower() for n in self.names].index(name.lower())}"

    def __getitem__(self, name: str):
        return F.col(self.at(name))

    def back(self, df: DataFrame, changed: dict | None = None, more: dict | None = None, without: tuple = ()) -> DataFrame:
        """df's own columns under their former names, those in ``changed`` with new values,
        then the columns in ``more``."""
        out = {n: (changed or {}).get(n, F.col(f"own_{i}")) for i, n in enumerate(self.names) if n not in without} | (more or {})
        # In two steps: within one, a new name could be taken for a helper column of that name.
        return df.select(*[c.alias(f"out_{i}") for i, c in enumerate(out.values())]).toDF(*out)


def running_total(ws: Workspace, df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows that precede in ``order``.

    One range shuffle; each partition adds up its own rows, and a table with one
    row a partition (its only single-task step) carries the totals on.
    ``order`` must name columns that make the order total, or tie only equal rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def local(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, carry = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = np.asarray(batch.column(batch.schema.get_field_index(value)).fill_null(0), dtype=np.int64)
            total = np.cumsum(v)
            cols = [*batch.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(carry + total - v)]
            carry += int(total[-1]) if len(v) else 0
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "_pid", "_local"])

    held = ws.table(ranged.mapInArrow(local, schema), name)
    parts = held.groupBy("_pid").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("long").alias("_sum")).collect()  # one row a partition
    at, starts = 0, []
    for r in sorted(parts, key=lambda r: r["_pid"]):
        starts.append((r["_pid"], at))
        at += r["_sum"]
    offsets = few_rows(ws.spark, {"_pid": [p for p, _ in starts], "_start": [s for _, s in starts]}, "_pid int, _start long")
    return held.join(F.broadcast(offsets), "_pid").withColumn("before", F.col("_local") + F.col("_start")).drop("_pid", "_local", "_start")


# Word hashing, vectorized over a block of texts.

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SAME = np.arange(1, 257, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i mod 2**64 for i < n, kept between calls."""
    have = _POWERS.get("up", np.empty(0, np.uint64))
    if len(have) < n:
        m = max(n, 1 << 18)
        up, down = np.full(m, _BASE), np.full(m, _INVERSE)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public constants of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words begin
    (one more entry than texts). Words are runs of bytes other than white space."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = powers(len(buf))
    space = _SPACE[buf]
    part = (_LOWER if lower else _SAME)[buf] * up
    part[space] = 0
    total = np.cumsum(part)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[::2], edge[1::2]  # the buffer ends with white space, so both are equally many
    h = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
    h = mix(h * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(start, at)


def blocks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together (a longer text alone)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def least_in_windows(gram: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each ``w`` hashes in a row is. The upper half of the hash decides,
    then the place: alike for equal strings anywhere."""
    bits = np.uint64(32)
    least = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if w > size:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    return (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words make one."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(n, width)
    out = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ words[j : n - k + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
