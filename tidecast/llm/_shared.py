"""Helpers shared by the corpus operators: shared scratch tables and byte-level text arrays.

Text arrays: a batch of texts is one ``uint8`` array of UTF-8 bytes with document offsets, so that word
splitting and hashing are array operations. Long batches are cut into pieces of about ``PIECE`` bytes (a
text longer than that is a piece by itself), which bounds the memory of a task.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

PIECE = 500_000
#: Rows of an Arrow batch, unless the session says otherwise: Spark's own 10,000 texts or signatures at a time take the executors more memory outside the heap than their workers use.
BATCH_ROWS = 1_000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- scratch


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (tests), a local one is made, once a session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches of ``BATCH_ROWS`` rows where the session sets none. It stays set, since results are computed after an operator returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor costs no more than its running tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.saved = 0, {}
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.saved[path] = name
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later step reads."""
        self._delete(df._scratch_path)

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Removes all tables but those that a result reads."""
        for path in set(self.saved) - {df._scratch_path for df in kept}:
            self._delete(path)

    def _delete(self, name: str) -> None:
        self.saved.pop(name, None)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- ranges


def range_starts(keys: DataFrame, rows: int, fine: int, most: int) -> list[tuple]:
    """Keys (structs in the column ``key``) at which ranges of about ``rows`` rows begin, in order.

    Keys are picked by their hash, every ``rows / fine``-th, ``most`` or so at most, and ranges begin at every ``fine``-th picked key: they are even however keys lie."""
    step = max(1, rows // fine, -(-keys.count() // most))
    picked = keys.filter(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key.*").distinct()
    return sorted(tuple(r) for r in picked.toLocalIterator())[fine - 1 :: fine]


def range_of(key: str, kind: DataType, starts: list[tuple]) -> Column:
    """How many of ``starts`` are not above the struct ``key``, by halving."""
    if not starts:
        return F.lit(0)
    given = json.dumps([dict(zip(kind.names, k, strict=True)) for k in starts])
    listed = F.from_json(F.lit(given), f"array<{kind.simpleString()}>")  # folded to a constant
    steps = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    # an index beyond the end gives null, which counts as above the key
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when(F.get(listed, at + s - 1) <= F.col(key), s).otherwise(0))


# ---------------------------------------------------------------- text arrays


def byte_pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into (first row, end row, bytes, offsets); null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    lengths = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    size = np.diff(lengths)
    if column.null_count:
        size = np.where(np.asarray(column.is_null().to_numpy(zero_copy_only=False)), 0, size)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first, have = 0, 0
    for row in range(n + 1):
        if row == n or (have and have + size[row] > limit):
            parts = size[first:row]
            offsets = np.concatenate([[0], np.cumsum(parts)])
            if (parts == np.diff(lengths)[first:row]).all():
                piece = data[lengths[first] : lengths[first] + offsets[-1]]
            else:  # bytes under a null
                piece = np.concatenate([data[lengths[i] : lengths[i] + size[i]] for i in range(first, row)])
            yield first, row, piece, offsets
            first, have = row, 0
        if row < n:
            have += int(size[row])


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of maximal runs of bytes for which ``breaks[byte]`` is false; runs end at a document's end."""
    inside = ~breaks[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) <= n:
        size = max(n + 1, PIECE + 1)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end); ``codes`` gives each byte's value, equal for bytes that count as equal.

    A polynomial over prefix sums: runs of any length cost the same."""
    if len(data) > 4 * PIECE:  # one very long text: bounded working arrays, a block of runs at a time
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
            lo, hi = int(starts[at]), int(ends[end - 1])
            out[at:end] = _span_hashes(data[lo:hi], starts[at:end] - lo, ends[at:end] - lo, codes)
            at = end
        return out
    return _span_hashes(data, starts, ends, codes)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def ngram_hashes(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within one document, and the index of each run's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    at = np.flatnonzero(docs[:m] == docs[n - 1 :])
    return mix(h[at]), at


def byte_codes(fold: bool) -> np.ndarray:
    """Random 64-bit values of bytes, fixed; with ``fold`` the letters A-Z have the values of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
