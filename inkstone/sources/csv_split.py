"""S1 in many tasks: quoted multi-line CSV files read by byte ranges.

Where a record starts depends on all quotes before it, but only on whether their number is even.  One scan
counts the quotes of each range; the prefix sums of these counts (one small row per range) tell every range whether it
begins inside quotes; a second scan lets each range read the records that start in it, the last one past
its end.  A task holds one record and one batch of rows at a time, whatever the size of the file.

Defined results: a record ends with a line feed (or carriage return and line feed) outside quotes; a doubled quote
stands for one, and line ends inside quotes stay as they are; an empty field is null, a quoted empty one the empty string; empty lines are skipped; the first record of
each file is its header; bytes that are no UTF-8 become U+FFFD.  A record with too few or too many fields, or with
text after a closing quote, keeps the fields that the schema names (none in the latter case), and its own text in
``_corrupt_record``.  A file that ends inside quotes has no certain records: it raises an error before any row is read.
Compressed files have no byte ranges and raise an error too; :func:`inkstone.sources.io.read_pairs` reads both kinds.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.sources.io import PAIRS_SCHEMA, null_na_words, scratch_path

SPLIT_BYTES, BLOCK_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 500
CORRUPT = "_corrupt_record"
# endings by which Hadoop's codecs are known
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def open_bytes(uri: str) -> io.BufferedReader:
    """A file of the shared storage, open for reading at any place."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri if ":" in uri else f"file://{uri}"))
    return io.BufferedReader(files.open_input_file(path), BLOCK_BYTES)


def byte_ranges(spark: SparkSession, path: str | list, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, start, stop) of every range of the files below ``path``, one range to a partition."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    packed = files.filter(F.lower("path").rlike("(" + "|".join(map(re.escape, COMPRESSED)) + ")$")).select("path").take(1)
    if packed:
        raise ValueError(f"{packed[0].path} is compressed and has no byte ranges: use read_pairs")
    files = files.filter("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    starts = files.select(F.col("path").alias("file"), "length",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return starts.select("file", "start", F.least("length", F.col("start") + split_bytes).alias("stop")).repartition(int(n))


def count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the number of quotes of each range is odd."""
    for batch in batches:
        odd = []
        for row in batch.to_pylist():
            with open_bytes(row["file"]) as f:
                f.seek(row["start"])
                left, n = row["stop"] - row["start"], 0
                while left > 0 and (block := f.read(min(left, BLOCK_BYTES))):
                    left, n = left - len(block), n + block.count(b'"')
            odd.append(n % 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.int32())], ["file", "start", "stop", "odd"])


def record_at(f: io.BufferedReader, odd: int = 0) -> bytes:
    """Bytes up to the next line feed outside quotes; ``odd`` if they begin inside quotes."""
    lines = []
    while line := f.readline():
        lines.append(line)
        odd ^= line.count(b'"') & 1
        if not odd:
            break
    return b"".join(lines)


def own_records(file: str, start: int, stop: int, inside: int) -> Iterator[str]:
    """Texts of the records that start in the range, without the header."""
    with open_bytes(file) as f:
        at = start
        if start:
            f.seek(start - 1)
            # the byte before tells whether a record ends there
            if f.read(1) != b"\n" or inside:
                at += len(record_at(f, inside))
        while at < stop and (raw := record_at(f)):
            if at and (text := raw.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")):
                yield text
            at += len(raw)


def fields_of(text: str, width: int) -> tuple[list, str | None]:
    """``width`` fields of a record, and its text if it does not hold just as many."""
    try:
        found = next(csv.reader([text], quoting=csv.QUOTE_NOTNULL, strict=True))
    except csv.Error:
        return [None] * width, text
    return ([*found, *[None] * width])[:width], None if len(found) == width else text


def record_reader(width: int, schema: pa.Schema):
    """mapInArrow function from (file, start, stop, inside) to the records of each range."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2 ** 31 - 1)
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for text in own_records(row["file"], row["start"], row["stop"], row["inside"]):
                    fields, bad = fields_of(text, width)
                    rows.append((*fields, bad))
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
    return read


def read_pairs_split(spark: SparkSession, path: str | list, schema: T.StructType = PAIRS_SCHEMA,
                     split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of :func:`inkstone.sources.io.read_pairs`, ``_corrupt_record`` included, by many tasks a file.

    All columns of ``schema`` are strings.
    """
    names = [f.name for f in schema.fields] + [CORRUPT]
    if any(f.dataType != T.StringType() for f in schema.fields):
        raise ValueError("all columns of a pair file are strings")
    ranges = byte_ranges(spark, path, split_bytes)
    counted = scratch_path(spark, "csv-ranges")
    ranges.mapInArrow(count_quotes, "file string, start long, stop long, odd int").write.parquet(counted)
    counted = spark.read.parquet(counted)
    torn = counted.groupBy("file").agg(F.sum("odd").alias("n")).filter("n % 2 = 1").take(1)
    if torn:
        raise ValueError(f"{torn[0].file} ends inside quotes: use read_pairs")
    # one small row per range: a file of 100 TB has 1.6 million
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside")
    placed = counted.select("file", "start", "stop", inside).repartition(max(1, counted.count()))
    out = placed.mapInArrow(record_reader(len(schema.fields), pa.schema([(n, pa.string()) for n in names])),
                            T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return null_na_words(out, [f.name for f in schema.fields if f.name != "id"])


def pairs_to_parquet(spark: SparkSession, path: str | list, out: str, schema: T.StructType = PAIRS_SCHEMA,
                     split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """One pass from CSV to Parquet: (good rows, quarantined rows with their text, number of the latter)."""
    rows = read_pairs_split(spark, path, schema, split_bytes)
    rows.withColumn("corrupt", F.col(CORRUPT).isNotNull()).write.partitionBy("corrupt").parquet(out)
    written = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("corrupt", T.BooleanType())])).parquet(out)
    bad = written.filter("corrupt").drop("corrupt")
    return written.filter("not corrupt").drop("corrupt", CORRUPT), bad, bad.count()
