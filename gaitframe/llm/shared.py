"""Helpers shared by the operators: intermediate tables, row keys, byte kernels."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: [\x20\x09-\x0D]
SPACE_REGEX = r"[\x20\x09-\x0D]+"
U64 = np.uint64


#: Bytes of one Arrow batch between Spark and a kernel.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the checkpoint folder that was set.

    A local master without either (tests) gets a temporary folder; a cluster is refused, since its executors
    would not see one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gaitframe-"))
    return sc.getCheckpointDir()


def arrow(df: DataFrame, kernel: Callable, schema) -> DataFrame:
    """df.mapInArrow(kernel, schema) with batches bounded in bytes and memory given back when a task ends.

    Batches are bounded in rows only by default, so long texts would fill the executor's memory beside its
    heap. The bound is a setting of the session, lowered here where it is larger.
    """
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks and would keep its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def unpersist(*sent) -> None:
    """Drop the executors' copies of broadcasts whose results are written; a later use would fetch them again."""
    for b in sent:
        b.unpersist()


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/gaitframe-{tag}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two independent 64-bit halves of a row's key by id and text: null and repeated ids stay apart, identical rows share it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.col(id_col), text), F.xxhash64(F.lit(1), text, F.col(id_col))


def row_key(id_col: str, text_col: str) -> Column:
    """Both halves of a row's key as one column."""
    a, b = row_keys(id_col, text_col)
    return F.struct(a.alias("a"), b.alias("b"))


def spaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_REGEX, " ")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply-xorshift)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants drawn from a seed."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


BYTE_CODE = constants(256, 17)
_LEVELS = constants(64, 29)


def window_hash(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n tokens by doubling; the last step overlaps."""
    size, h, s, level = len(x) - n + 1, x, 1, seed * 20
    if size <= 0:
        return x[:0]
    while 2 * s <= n:
        h, s, level = h[: len(h) - s] * _LEVELS[level % 64] + h[s:], 2 * s, level + 1
    if s < n:
        h = h[:size] * _LEVELS[(level + 7) % 64] + h[n - s : n - s + size]
    return mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    s, size = 1, len(x) - w + 1
    if size <= 0:
        return x[:0]
    while 2 * s <= w:
        x, s = np.minimum(x[: len(x) - s], x[s:]), 2 * s
    return np.minimum(x[:size], x[w - s : w - s + size])


_TABLES: dict[str, np.ndarray] = {}


def byte_table(name: str) -> np.ndarray:
    """256 codes: lower() folds A-Z, space marks the contract's white space, other ASCII punctuation may count too."""
    if name not in _TABLES:
        t = np.arange(256, dtype=np.uint8)
        if name in ("fold", "alnum"):
            t[65:91] += 32
        if name == "alnum":  # everything in ASCII that is no letter or digit separates
            for b in range(128):
                if not chr(b).isalnum():
                    t[b] = 32
        for b in (9, 10, 11, 12, 13):
            t[b] = 32
        _TABLES[name] = t
    return _TABLES[name]


BLOCK = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse; those of a block are kept, longer ones are made anew."""

    def made(size: int) -> list[np.ndarray]:
        base, out = 0x2545F4914F6CDD1D, []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return out

    if n > BLOCK:
        return tuple(made(n))  # type: ignore[return-value]
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = made(BLOCK)
    return _POWERS["up"], _POWERS["down"]


def _word_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of a buffer whose white space is byte 32; works in blocks."""
    if len(data) <= BLOCK:
        return _word_block(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK // 2)
        while end < len(data):  # cut where a word ends; a word longer than a block stays whole
            gap = np.flatnonzero(data[end : end + BLOCK] == 32)
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(len(data), end + BLOCK)
        h, s, e = _word_block(data[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def chunks(batches, column: str, limit: int = BLOCK // 2):
    """Groups of documents of about limit bytes: (batch, first row, texts). A longer document comes alone."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        first, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t or b"")
            if size and size + n > limit:
                yield batch, first, texts[first:i]
                first, size = i, 0
            size += n
        if first < len(texts):
            yield batch, first, texts[first:]


def joined(texts: list[bytes | None], table: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all documents with a space after each, and where each begins (one more for the end)."""
    parts = [t or b"" for t in texts]
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    return (byte_table(table)[data] if table else data), at
