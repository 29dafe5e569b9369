"""Shared helpers: words and their hashes, Arrow mapping, row keys, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words whose hashes one Python worker remembers before it starts afresh.
REMEMBERED_WORDS = 100_000


class WordHashes(dict):
    """Bytes of a word -> 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of all runs of ``n`` words (none if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k:k + count]
    return mixed(out)


def spans_mask(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in ``[start, start + width)`` of any start."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, size), -1)
    return np.cumsum(steps[:-1]) > 0


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``most`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def row_key(*columns: str) -> Column:
    """A non-null key of a row's content; rows that repeat share it and get equal results."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, or with underscores after it the first that no column has (names do not tell case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: str, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the key as text falls in the held-out remainder; a null key never does."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: later plans start from the files."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one computation; those that its result no longer reads are dropped at its end."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def written(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        path = scratch(self._spark, label)
        df.write.parquet(path)
        if not keep:
            self._paths.append(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        hadoop = self._spark.sparkContext._jsc.hadoopConfiguration()
        for path in self._paths:
            target = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)
        self._paths = []


def blocks_of(df: DataFrame, *, rows: int) -> int:
    """How many blocks of about ``rows`` rows hold ``df``; one cheap count."""
    return max(1, -(-df.count() // rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
