"""Large files whose records cannot be told apart line by line, read in byte ranges.

A JSON array and a CSV file with line breaks in quotes have one thing in common: where a record ends depends
on everything before it in the file, namely on whether a quote is open and how many brackets are.  So every
range of a file is looked at twice.  First each task says what its range does to that state: whether it has an
odd number of quotes, and how the depth changes if it starts outside or inside a quote.  Running sums of these
few numbers give the state in which every range starts.  Then each range is cut into records.  What stands
before its first record end and after its last one are pieces, which are put together across ranges; all
complete records stay in their task.  No task reads a file whole, whatever its lines.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprep.functions.types import col
from tableprep.session import written

QUOTE, BACKSLASH = ord('"'), ord("\\")
HEAD, TAIL, MIDDLE = 1, 2, 3  # pieces of a range: to its first record end, from its last, a range without any
READ_AT_ONCE = 4 << 20  # bytes of text looked at as one array


@dataclass(frozen=True)
class JsonArray:
    """Elements of a top-level array end where the depth comes back to one."""

    separator = "}"

    def quotes(self, data: np.ndarray) -> np.ndarray:
        """Places of quotes that open or close a string."""
        quotes = np.flatnonzero(data == QUOTE)
        led = quotes[(quotes > 0) & (data[quotes - 1] == BACKSLASH)]
        if not len(led):
            return quotes
        other = np.flatnonzero(data != BACKSLASH)
        before = np.searchsorted(other, led) - 1  # the last other byte before the run of backslashes
        run = led - 1 - np.where(before >= 0, other[before], -1)
        return np.setdiff1d(quotes, led[run % 2 == 1], assume_unique=True)

    def steps(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Places of brackets, their steps in depth, whether an odd number of quotes stands before, all quotes."""
        quotes = self.quotes(data)
        step = DEPTH[data]
        at = np.flatnonzero(step)
        return at, step[at].astype(np.int64), np.searchsorted(quotes, at) % 2 == 1, len(quotes)

    def effect(self, data: np.ndarray) -> tuple[int, int, int]:
        """Quotes, change of depth from a start outside a string, and from a start inside one."""
        _, step, odd, quotes = self.steps(data)
        return quotes, int(step[~odd].sum()), int(step[odd].sum())

    def ends(self, data: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, bool, int]:
        """Where elements end (exclusive), and the state after the data."""
        at, step, odd, quotes = self.steps(data)
        outside = odd == inside
        at, depths = at[outside], depth + np.cumsum(step[outside])
        after = int(depths[-1]) if len(depths) else depth
        return at[(depths == 1) & (step[outside] < 0)] + 1, inside ^ (quotes % 2 == 1), after

    def record(self, raw: bytes) -> bytes:
        """An element as one line; what only opens, parts or closes the array is nothing."""
        text = raw.lstrip(b"[, \t\r\n")
        if not text.strip(b"]} \t\r\n"):
            return b""
        return text.replace(b"\n", b" ").replace(b"\r", b" ")


@dataclass(frozen=True)
class QuotedLines:
    """Records end at line ends that no quote encloses; a doubled quote closes and opens again."""

    separator = "\n"

    def effect(self, data: np.ndarray) -> tuple[int, int, int]:
        return int((data == QUOTE).sum()), 0, 0

    def ends(self, data: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, bool, int]:
        quotes = np.flatnonzero(data == QUOTE)
        at = np.flatnonzero(data == ord("\n"))
        outside = (np.searchsorted(quotes, at) % 2 == 1) == inside
        return at[outside] + 1, inside ^ (len(quotes) % 2 == 1), depth

    def record(self, raw: bytes) -> bytes:
        line = raw.removesuffix(b"\n").removesuffix(b"\r")
        return line if line.strip() else b""


DEPTH = np.zeros(256, dtype=np.int8)
DEPTH[[ord("{"), ord("[")]] = 1
DEPTH[[ord("}"), ord("]")]] = -1

Scanner = JsonArray | QuotedLines


def fragments(spark: SparkSession, uri: str | list[str], scanner: Scanner) -> DataFrame:
    """The files cut at every separator, in splits, each fragment with the split it lies in."""
    read = spark.read.option("lineSep", scanner.separator).text(uri)
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return read.select(*split, "value").withColumn("range", F.xxhash64("file", "start"))


def runs(batch: pa.RecordBatch, scanner: Scanner) -> Iterator[tuple[int, int, bytes]]:
    """Rows of one split each, with their bytes: (first row, split, data)."""
    keys = batch.column("range").to_numpy(zero_copy_only=False)
    values = batch.column("value").cast(pa.binary())
    parts = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)) // READ_AT_ONCE
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
    bounds = [*np.flatnonzero(new).tolist(), len(keys)]
    separator = scanner.separator.encode()
    for i, j in zip(bounds, bounds[1:]):
        yield i, int(keys[i]), separator.join([*values.slice(i, j - i).to_pylist(), b""])


def start_states(found: DataFrame, scanner: Scanner) -> DataFrame:
    """(file, start, range, inside, depth): the state in which each range starts; one row per split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for row, key, data in runs(batch, scanner):
                if key not in rows:
                    rows[key] = [batch.column("file")[row].as_py(), batch.column("start")[row].as_py(), key, 0, 0, 0]
                kept, (quotes, outside, inside) = rows[key], scanner.effect(np.frombuffer(data, dtype=np.uint8))
                if kept[3] % 2:  # this part starts the other way round
                    outside, inside = inside, outside
                kept[3:] = [kept[3] + quotes, kept[4] + outside, kept[5] + inside]
        if rows:
            names = ["file", "start", "range", "quotes", "outside", "inside"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows.values())))))

    effects = found.mapInArrow(run, "file string, start long, range long, quotes long, outside long, inside long")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = effects.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum("change").over(earlier), F.lit(0))
    return opened.withColumn("change", change).select("file", "start", "range", F.col("open").alias("inside"), depth.alias("depth"))


def cut_ranges(found: DataFrame, states: DataFrame, scanner: Scanner, pieces: bool) -> DataFrame:
    """Complete records of every range, or its pieces: (range, kind, value)."""
    read = found.select("range", "value").join(F.broadcast(states.select("range", "inside", "depth")), "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, pending, ended = None, False, 0, [], False
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for row, k, data in runs(batch, scanner):
                if k != key:
                    if key is not None and pieces:
                        out.append((key, TAIL if ended else MIDDLE, b"".join(pending)))
                    key, pending, ended = k, [], False
                    inside, depth = batch.column("inside")[row].as_py(), batch.column("depth")[row].as_py()
                ends, inside, depth = scanner.ends(np.frombuffer(data, dtype=np.uint8), inside, depth)
                stops = ends.tolist()
                if not stops:
                    pending.append(data)
                    continue
                first = b"".join([*pending, data[: stops[0]]])
                if pieces and not ended:
                    out.append((key, HEAD, first))
                if not pieces:
                    raw = [] if not ended else [first]
                    raw += [data[i:j] for i, j in zip(stops, stops[1:])]
                    out += [(key, 0, r) for r in map(scanner.record, raw) if r]
                pending, ended = [data[stops[-1] :]], True
            if out:
                yield as_batch(out)
        if key is not None and pieces:
            yield as_batch([(key, TAIL if ended else MIDDLE, b"".join(pending))])

    def as_batch(rows) -> pa.RecordBatch:
        ranges, kinds, values = zip(*rows)
        columns = [pa.array(ranges, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["range", "kind", "value"])

    return read.mapInArrow(run, "range long, kind int, value binary")


def joined_pieces(cut: DataFrame, states: DataFrame, scanner: Scanner) -> DataFrame:
    """Records that reach over range ends, and the first one of each file: (file, number, value).

    A piece up to a record end closes what was open; so the number of such pieces before it names the
    record that a piece belongs to.
    """
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    slim = cut.select("range", "kind").join(states.select("range", "file", "start"), "range")
    named = slim.withColumn("number", F.coalesce(F.sum((F.col("kind") == HEAD).cast("long")).over(order), F.lit(0)))
    whole = cut.join(named, ["range", "kind"]).groupBy("file", "number")
    parts = F.sort_array(F.collect_list(F.struct("start", "kind", "value")))
    record = F.udf(lambda parts: scanner.record(b"".join(bytes(p) for p in parts)), "binary")
    return whole.agg(record(F.transform(parts, lambda p: p["value"])).alias("value")).where("length(value) > 0")


def records(spark: SparkSession, uri: str | list[str], scanner: Scanner) -> tuple[DataFrame, DataFrame]:
    """Records that lie within a range (value), and the others (file, number, value; 0 is a file's first)."""
    found = fragments(spark, uri, scanner)
    states = written(start_states(found, scanner), "ranges")
    pieces = written(cut_ranges(found, states, scanner, pieces=True), "pieces")
    others = written(joined_pieces(pieces, states, scanner), "joined")
    return cut_ranges(found, states, scanner, pieces=False).select(F.col("value").cast("string").alias("value")), others


def json_lines(spark: SparkSession, uri: str | list[str]) -> DataFrame:
    """The elements of JSON arrays, one line of text each (column ``value``).

    Every file holds one array of objects or arrays.  A file that breaks off gives what is left as its last
    line; an empty array gives no line.
    """
    within, others = records(spark, uri, JsonArray())
    return within.unionByName(others.select(F.col("value").cast("string").alias("value")))


def header_names(record: str) -> list[str]:
    """Column names of a header as the CSV reader makes them: numbered where empty or repeated."""
    names = next(csv.reader(io.StringIO(record, newline="")), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def quoted_csv(spark: SparkSession, files: list[str], options: dict[str, str]) -> DataFrame:
    """CSV files with line breaks in quotes, all columns as text, named by the first file's first record.

    Every file has a header.  Lines end with LF or CR LF; breaks within quotes stay as they are.  Records
    without any character but blanks are left out.  A quote that is never closed takes the rest of its file.
    """
    within, others = records(spark, files, QuotedLines())
    header = others.where("number = 0").orderBy("file").select(F.col("value").cast("string")).first()
    names = header_names(header[0]) if header else []
    rows = within.unionByName(others.where("number > 0").select(F.col("value").cast("string").alias("value")))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.select(F.from_csv("value", schema, {**options, "multiLine": "true"}).alias("r"))
    return parsed.select(*[col("r")[f"c{i}"].alias(c) for i, c in enumerate(names)])


def first_character(spark: SparkSession, file: str) -> str:
    """The first character of a file that is not white space; the driver opens the file and reads no further."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    path = hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        stream = codec.createInputStream(stream) if codec is not None else stream
        skipped = {*b" \t\r\n", 0xEF, 0xBB, 0xBF}  # blanks and a byte order mark
        byte = stream.read()
        while byte in skipped:
            byte = stream.read()
        return chr(byte) if byte >= 0 else ""
    finally:
        stream.close()
