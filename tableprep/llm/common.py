"""Shared by the operators: row-wise annotation on Arrow batches, text buffers, rolling hashes, blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableprep.session import written

CHUNK_BYTES = 1 << 20  # texts are worked on in chunks of about so many bytes, which bounds a task's arrays
SEPARATOR = b"\n"
ARROW_BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = "67108864b"


def annotate(
    df: DataFrame,
    text: str,
    outputs: str,
    compute: Callable[[list[bytes | None]], list],
) -> DataFrame:
    """Append to every row the columns that ``compute`` derives from its text; no shuffle.

    ``compute`` gets the texts of a piece of a batch as UTF-8 bytes (None for null) and returns one
    list per output column.  Input columns named like an output column are replaced.
    """
    outs = StructType.fromDDL(outputs)
    taken = {f.name.lower() for f in outs}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    at = next((i for i, f in enumerate(kept) if f.name.lower() == text.lower()), None)
    if at is None:
        raise ValueError(f"no column {text} besides the result columns")
    schema = StructType([*kept, *outs])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            for i, j in ranges([len(t or b"") for t in texts]):
                made = compute(texts[i:j])
                columns = [c.cast(arrow.field(k).type) for k, c in enumerate(batch.slice(i, j - i).columns)]
                for k, v in enumerate(made):
                    kind = arrow.field(n + k).type
                    columns.append(v.cast(kind) if isinstance(v, pa.Array) else pa.array(v, type=kind))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    plain = [F.col("`" + f.name.replace("`", "``") + "`").alias(f"c{i}") for i, f in enumerate(kept)]
    return df.select(plain).mapInArrow(run, schema)


def ranges(sizes: list[int], budget: int = 4 * CHUNK_BYTES, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``budget`` bytes; a longer text is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > budget or i - start >= most):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


class Chunk:
    """Some texts as one byte array, each followed by a separator."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        self.data = np.frombuffer(SEPARATOR.join([*self.texts, b""]), dtype=np.uint8)
        self.lengths = np.fromiter((len(t) for t in self.texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1].astype(np.int64)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of word bytes, and the text each lies in."""
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = is_word[self.data]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.searchsorted(self.starts, starts, side="right") - 1


def chunks(texts: list[bytes | None], budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    for i, j in ranges([len(t or b"") for t in texts], budget):
        yield i, j, Chunk(texts[i:j])


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=np.int8)
    for low, high in spans:
        table[low : high + 1] = 1
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = 1 - byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _constants(seed: str, n: int) -> np.ndarray:
    digest = b"".join(hashlib.blake2b(f"{seed}{i}".encode(), digest_size=64).digest() for i in range(-(-n // 8)))
    return np.frombuffer(digest, dtype=np.uint64)[:n].copy()


_kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
KEPT_POWERS = 3 * CHUNK_BYTES  # longer rows of powers are made for one text and dropped


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random table of bytes, and the powers of the base and of its inverse up to ``n`` at least."""
    if seed in _kept and len(_kept[seed][1]) > n:
        return _kept[seed]
    size = -(-n // (1 << 18)) << 18
    base = int(_constants(f"base{seed}", 1)[0]) | 5
    up, down = np.ones(size + 1, dtype=np.uint64), np.ones(size + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(size, base, dtype=np.uint64), out=up[1:])
    np.multiply.accumulate(np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64), out=down[1:])
    made = (_constants(f"bytes{seed}", 256), up, down)
    if size <= KEPT_POWERS:
        _kept[seed] = made
    return made


class Rolling:
    """Hashes of any byte ranges of an array in constant time each (a polynomial over a random byte table)."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        table, up, self.down = _powers(seed, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def blocks(df: DataFrame, size: str, bound: int) -> Iterator[list]:
    """The rows of a table without repeated rows, in blocks whose summed ``size`` is at most twice ``bound``.

    Rows are dealt to buckets by hash, a running sum cuts each bucket into parts and parts are packed into
    blocks, so no order over the whole table is needed.  A row larger than ``bound`` adds to its block alone.
    """
    total = df.agg(F.sum(F.expr(size))).first()[0] or 0
    if total <= bound:
        yield df.collect()
        return
    columns = [F.col(f"`{c}`") for c in df.columns]
    sized = df.select(*columns, F.expr(size).alias("__size"), F.xxhash64(*columns).alias("__key"))
    sized = sized.withColumn("__bucket", F.pmod("__key", F.lit(math.ceil(total / bound))))
    before = F.sum("__size").over(Window.partitionBy("__bucket").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1))
    dealt = sized.withColumn("__part", F.floor(F.coalesce(before, F.lit(0)) / bound)).drop("__key")
    dealt = written(dealt, "dealt")
    parts = dealt.groupBy("__bucket", "__part").agg(F.sum("__size").alias("size")).orderBy("__bucket", "__part").collect()
    packs: list[tuple[list[tuple[int, int]], int]] = [([], 0)]
    for bucket, part, n in parts:
        if packs[-1][0] and packs[-1][1] + n > bound:
            packs.append(([], 0))
        packs[-1] = (packs[-1][0] + [(bucket, part)], packs[-1][1] + n)
    for members, _ in packs:
        chosen = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(p).cast("long").alias("p")) for k, p in members]
        at = F.struct(F.col("__bucket").cast("long").alias("k"), F.col("__part").cast("long").alias("p"))
        yield dealt.where(at.isin(*chosen)).select(*columns).collect()


def small_batches(spark: SparkSession, size: int = ARROW_BATCH_BYTES) -> None:
    """Have texts handed to Python in batches of at most ``size`` bytes, unless the session says otherwise.

    A batch is held by the executor and by the worker at once, each with room to grow; by default it may
    have ten thousand long texts.
    """
    if spark.conf.get(BATCH_SETTING) in (BATCH_DEFAULT, str(max(size, ARROW_BATCH_BYTES))):
        spark.conf.set(BATCH_SETTING, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
