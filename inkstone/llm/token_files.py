"""Operator 3: token ids in binary files with a shared zstandard dictionary.

A file holds one frame per document, compressed on its own with a dictionary that all
files share, so one short document is read without its neighbours:

    header   MAGIC, SHA-256 of the dictionary
    frames   zstandard frames of little-endian unsigned 32-bit ids
    footer   frame offsets (u64) and id counts (u64), number of frames (u64), MAGIC

Beside the files lies an index table (doc_id, file, offset, bytes, n_tokens, start).
Files are in ascending doc_id order: ranges of ids, found from the id column alone,
are dealt to partitions, and only compressed frames are shuffled and sorted.  A writing
task names its file by a new UUID and hands its index rows to Spark's committer; a file
of a lost or repeated attempt is in no committed row and so is never read.

The dictionary is trained on at most DICTIONARY_DOCS documents (the smallest by a hash
of the id), at most DICTIONARY_CHARS characters of each; it changes the size of the files only.

Defined results: a null text counts as empty and holds the end id alone; null ids come
first; rows that share an id are all kept, ordered by the checksum of their ids.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import id_column, store, text_runs
from inkstone.operators.index import sized_partitions
from inkstone.sources.io import scratch_path

MAGIC = b"IDZSTD01"
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES = 1000, 4096, 64 << 10
CACHE_WORDS = 600_000
ROW = "doc_id long, file string, range int, offset long, bytes long, n_tokens long, before long"


class WordIds(dict):
    """Ids by word, filled on demand; at most CACHE_WORDS recent words and, once as many more were met,
    as many older ones."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.older.get(word) or self.find(word)
        return ids

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and none of its steps looks across an ASCII white-space
    character, so the ids of a text are those of its words in order.  It also cuts between
    letters and the signs behind them, and its other steps on a run of Latin letters are
    lower-casing and byte mapping: the letters of such a word go in lower case to the library's
    BPE model.  Signs, and all other words, pass its whole pipeline.
    """

    # letters with a one-letter lower case and no other normal form, then ASCII signs but the apostrophe
    LATIN = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)"

    def __init__(self, tokenizer_json: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.pieces, self.latin, self.letters = self.tokenizer.model.tokenize, re.compile(self.LATIN).fullmatch, byte_letters()
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.signs, self.stems, self.known = {"": b""}, {}, WordIds(self.find)

    def whole(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def stem(self, letters: str) -> bytes:
        ids = self.stems.get(letters)
        if ids is None:
            mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
            ids = self.stems[letters] = b"".join([self.packed[p.id] for p in self.pieces(mapped)])
        return ids

    def find(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters only
            return self.stem(word.lower().decode())
        text = word.decode()
        match = self.latin(text)
        if not match:
            return self.whole(text)
        letters, signs = match.groups()
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs = {"": b""}
            self.signs[signs] = self.whole(signs)
        return self.stem(letters.lower()) + self.signs[signs]

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        self.known.age()
        if len(self.stems) > CACHE_WORDS:
            self.stems.clear()
        ids = self.known.__getitem__
        return [b"".join(map(ids, t.split())) + end for t in texts]


def byte_letters() -> dict[int, int]:
    """Byte to code point as the byte-level step maps it: printable bytes stand for themselves, the
    others follow in order from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def train_dictionary(df: DataFrame, tokenizer_json: str, end: bytes) -> bytes:
    """A dictionary from a bounded sample; empty when the sample is too small to train one."""
    import zstandard

    hashed = df.withColumn("h", F.xxhash64("doc_id"))
    least = F.broadcast(hashed.select("h").distinct().orderBy("h").limit(DICTIONARY_DOCS))
    sample = hashed.join(least, "h", "left_semi").select("h", F.substring("text", 1, DICTIONARY_CHARS).alias("text"))
    rows = sample.dropDuplicates(["h"]).collect()  # at most DICTIONARY_DOCS
    ids = WordEncoder(tokenizer_json).encode([(r["text"] or "").encode() for r in rows], end)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, ids)) // 10), ids).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(df: DataFrame, tokenizer_json: str, end_id: int, path: str | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> str:
    """Encode and write all rows of ``df``; returns the folder with files, dictionary and index."""
    import hashlib

    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, "token-files")
    df = df.select(id_column(df, id_col).cast("long").alias("doc_id"), id_column(df, text_col).alias("text"))
    end = struct.pack("<I", end_id)
    dictionary = train_dictionary(df, tokenizer_json, end)
    mark = hashlib.sha256(dictionary).digest()
    fs, folder = store(path)
    fs.create_dir(f"{folder}/data", recursive=True)
    with fs.open_output_stream(f"{folder}/dictionary") as out:
        out.write(dictionary)
    n = sized_partitions(df)
    bounds = df.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import zlib

        import numpy as np
        import zstandard

        gc.disable()  # nothing here makes reference cycles, and each collection walks the word table
        own, cuts = WordEncoder(tokenizer_json), np.array(bounds)
        pack = zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            keys = batch.column(0)
            ranges = np.searchsorted(cuts, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            for a, b, texts in text_runs(batch.column(1)):
                ids = own.encode(texts, end)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(ranges[a:b], pa.int32()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())],
                    ["doc_id", "range", "crc", "n_tokens", "frame"])
        gc.enable()

    def write_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        name, out, at, before, offsets, counts = f"{uuid.uuid4().hex}.ids", None, len(MAGIC) + len(mark), 0, [], []
        disk, there = store(path)
        try:
            for batch in batches:
                if out is None:
                    out = disk.open_output_stream(f"{there}/data/{name}")
                    out.write(MAGIC + mark)
                frames, n_tokens = batch.column(4).to_pylist(), batch.column(3).to_numpy()
                sizes = np.array([len(f) for f in frames], np.int64)
                starts, tokens = at + np.cumsum(sizes) - sizes, before + np.cumsum(n_tokens) - n_tokens
                out.write(b"".join(frames))
                at, before = at + int(sizes.sum()), before + int(n_tokens.sum())
                offsets.append(starts)
                counts.append(n_tokens)
                k = len(frames)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * k), batch.column(1), pa.array(starts, pa.int64()),
                     pa.array(sizes), pa.array(n_tokens, pa.int64()), pa.array(tokens, pa.int64())],
                    ["doc_id", "file", "range", "offset", "bytes", "n_tokens", "before"])
            if out is not None:
                k = sum(map(len, offsets))
                out.write(np.concatenate(offsets).astype("<u8").tobytes() + np.concatenate(counts).astype("<u8").tobytes()
                          + struct.pack("<Q", k) + MAGIC)
        finally:
            if out is not None:
                out.close()

    frames = df.mapInArrow(encode, "doc_id long, range int, crc long, n_tokens long, frame binary")
    dealt = frames.repartitionById(n, "range").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc", "n_tokens")
    dealt.mapInArrow(write_file, ROW).write.parquet(f"{path}/parts")
    rows = spark.read.schema(ROW).parquet(f"{path}/parts")
    # one total per range (at most n), summed up in range order
    totals = {r["range"]: r["n"] for r in rows.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    first, run = {}, 0
    for k in sorted(totals):
        first[k], run = run, run + totals[k]
    starts = F.element_at(F.from_json(F.lit(str([first.get(k, 0) for k in range(n)])), "array<bigint>"), F.col("range") + 1)
    rows.withColumn("start", starts + F.col("before")).drop("before", "range").write.parquet(f"{path}/index")
    return path


INDEX = "doc_id long, file string, offset long, bytes long, n_tokens long, start long"


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids) read from the files; ``wanted`` (a column doc_id) restricts them to some documents."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    if wanted is not None:
        index = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        disk, there = store(path)
        with disk.open_input_file(f"{there}/dictionary") as f:
            dictionary = f.read()
        mark = hashlib.sha256(dictionary).digest()
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        name, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, ids = batch.slice(at, 500), []
                for file, offset, size in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "bytes"))):
                    if file != name:
                        name, source = file, disk.open_input_file(f"{there}/data/{file}")
                        if source.read(len(MAGIC) + len(mark)) != MAGIC + mark:
                            raise ValueError(f"{file}: not a file of this dictionary")
                    source.seek(offset)
                    ids.append(unpack.decompress(source.read(size)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), pa.array(ids, pa.binary())],
                                                 ["doc_id", "start", "ids"])

    return index.mapInArrow(fetch, "doc_id long, start long, ids binary")
