"""Operator 10: removal of line chunks that repeat across the corpus.

A line and the next one *repeat* when the same two lines are neighbours at another place of the corpus
(another document or another position).  No chunk that spans a pair of lines found once can repeat, so
chunks end there: a repeated passage becomes chunks of its own, whatever stands around it.  Inside a run
of repeated pairs a rolling hash over two line hashes (the first eight hex digits of their MD5) ends a
chunk after a line when it is 0 modulo CHUNK_LINES, unless the line before already does or a piece of one line
would be left at either end of the run.  Such boundaries depend on nearby lines of the run only and come back in
step after an insertion.  A line of LONG_LINE words or more is a passage of its own: chunks also end
before and after it.  Words are runs of characters other than [\\x20\\x09-\\x0D].

A chunk can be removed when it has at least MIN_LINES lines and MIN_WORDS words, or at
least LONG_LINE words.  Chunks with equal SHA-256 over their line hashes are one group; its keeper is the chunk
of the smallest id (then row, then position).  Every other occurrence is removed after its
bytes were compared with the keeper's.

Shuffles: pairs are counted with partial aggregation over two longs a line; the few that repeat find their
rows through a bitmap of bounded size, then by key (hot pairs by a broadcast of bounded size).  Line hashes, not
texts, meet the repeated positions of their document.  Chunk hashes are counted with partial aggregation; the positions
of repeated chunks go back to their documents by row key; only texts of repeated chunks travel to the comparison,
where a chunk with more than a thousandth of all occurrences is dealt over salts.
Everything is DataFrame expressions; arrays stay inside a document's row.

Defined results: null texts stay null; empty texts stay empty; a text whose every line is
removed becomes empty; rows that repeat an id and a text count as one document; a null id
comes first; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import attach, discard, id_column, materialise, salted_join, thinned

CHUNK_LINES, MIN_LINES, MIN_WORDS, LONG_LINE = 3, 2, 12, 50
HASH_BASE = 31
WORD = r"[^\x20\x09-\x0D]+"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def hashes_of(lines: Column) -> Column:
    """array<long>: the first fifteen hex digits of each line's MD5."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long"))


def pairs_of(hashes: Column) -> Column:
    """array<long>: one key for every line and the next."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
                       lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))


def chunks_of(hashes: Column, words: Column, repeated: Column) -> Column:
    """array<struct<start, len, hash>> of the chunks that can be removed; start counts from 0.
    ``repeated`` says of each line whether it and the next repeat."""
    def of_row(row: Column) -> Column:
        n = F.size(row["hashes"])
        front = lambda i: F.shiftright(F.get(row["hashes"], i), 28)
        rolls = lambda i: (front(i) + HASH_BASE * front(i - 1)) % CHUNK_LINES == 0
        pair = lambda i: F.coalesce(F.get(row["repeated"], i), F.lit(False))
        inner = lambda i: pair(i - 1) & pair(i + 1) & rolls(i) & ~(pair(i - 2) & rolls(i - 1))
        long = lambda i: F.coalesce(F.get(row["words"], i) >= LONG_LINE, F.lit(False))
        ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~pair(i) | long(i) | long(i + 1) | inner(i))
        return F.transform(F.array(F.struct(row.alias("row"), ends.alias("ends"))), lambda x: spans(x["row"], x["ends"]))

    def spans(row: Column, ends: Column) -> Column:
        def size(end: Column, j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(ends, j - 1) + 1)
            return F.struct(start.alias("start"), (end - start + 1).alias("len"), F.aggregate(
                F.slice(row["words"], start + 1, end - start + 1), F.lit(0), lambda a, b: a + b).alias("words"))
        whole = F.filter(F.transform(ends, size), lambda c: ((c["len"] >= MIN_LINES) & (c["words"] >= MIN_WORDS))
                         | (c["words"] >= LONG_LINE))
        digits = lambda c: F.transform(F.slice(row["hashes"], c["start"] + 1, c["len"]), lambda h: h.cast("string"))
        return F.transform(whole, lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"),
                                                     F.sha2(F.array_join(digits(c), " "), 256).alias("hash")))

    # F.transform over a one-element array binds its lambda variable once: nothing is computed twice
    packed = F.struct(hashes.alias("hashes"), words.alias("words"), repeated.alias("repeated"))
    return F.flatten(F.flatten(F.transform(F.array(packed), of_row)))


def repeated_pairs(shapes: DataFrame) -> DataFrame:
    """row_key, repeated: of each line whether it and the next are neighbours at another place too; rows without
    such a line are left out.  ``shapes`` (row_key, hashes) must be materialised."""
    places = shapes.select("row_key", F.posexplode(pairs_of(F.col("hashes"))).alias("i", "pair"))
    # rows that repeat an id and a text are one place, so places are compared and not counted
    place = F.xxhash64("row_key", "i")
    pairs = places.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    pairs = materialise(pairs.filter("first <> last").select("pair", "n"), "line-pairs")
    found = materialise(thinned(places, pairs, "pair"), "line-places")
    flags = attach(found, pairs, "pair", "n", found.count(), "inner").groupBy("row_key").agg(
        F.sort_array(F.collect_set("i")).alias("at"))
    at = F.col("at")
    gaps = F.transform(at, lambda i, k: F.concat(
        F.array_repeat(F.lit(False), i - F.coalesce(F.get(at, k - 1) + 1, F.lit(0))), F.array(F.lit(True))))
    out = materialise(flags.select("row_key", F.flatten(gaps).alias("repeated")), "line-flags")
    discard(pairs, found)
    return out


def without(lines: Column, removed: Column) -> Column:
    """Lines outside the sorted (start, len) ranges of ``removed``."""
    def piece(k: Column) -> Column:
        before = F.get(removed, k - 1)
        start = F.coalesce(before["start"] + before["len"], F.lit(0))
        end = F.coalesce(F.get(removed, k)["start"], F.size(lines))
        return F.slice(lines, start + 1, end - start)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), piece))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated chunks cut out of the text, in a struct ``row`` of its columns, beside
    removed_chunks and removed_lines (longs)."""
    text, key = id_column(df, text_col), id_column(df, id_col).cast("long")
    row_key = F.unhex(F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit(""))), 256))
    rows = df.select(F.struct(*[id_column(df, c).alias(c) for c in df.columns]).alias("row"),
                     text.alias("text"), row_key.alias("row_key"))

    lines = lines_of(text)
    shapes = materialise(df.filter(text.isNotNull()).select(
        key.alias("id"), row_key.alias("row_key"), hashes_of(lines).alias("hashes"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words")), "line-shapes")
    flags = repeated_pairs(shapes)
    # only a long line or a repeated pair makes a chunk that can repeat
    found = shapes.join(flags, "row_key", "left").filter(
        F.col("repeated").isNotNull() | F.exists("words", lambda w: w >= LONG_LINE))
    found = found.select("id", "row_key", F.explode(chunks_of(
        F.col("hashes"), F.col("words"), F.coalesce("repeated", F.array().cast("array<boolean>")))).alias("c"))
    chunks = materialise(found.select("id", "row_key", "c.*"), "line-chunks")
    first = F.min(F.struct("id", "row_key", "start")).alias("first")
    groups = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), first).filter(F.col("n") > 1)
    groups = materialise(groups, "chunk-groups")
    total = chunks.count()
    repeated = attach(chunks, groups, "hash", "n", total, "inner").withColumn(
        "keeper", (F.col("row_key") == F.col("first.row_key")) & (F.col("start") == F.col("first.start")))
    marks = materialise(repeated.groupBy("row_key").agg(
        F.collect_set(F.struct("start", "len", "hash", "keeper")).alias("marks")), "chunk-marks")

    # texts of the repeated chunks; rows that repeat an id and a text are one document
    own = lambda m: F.struct(m["hash"].alias("hash"), m["start"].alias("start"), m["len"].alias("len"),
                             m["keeper"].alias("keeper"), F.array_join(F.slice(F.col("lines"), m["start"] + 1, m["len"]), "\n").alias("bytes"))
    texts = rows.select("row_key", lines_of(F.col("text")).alias("lines")).join(marks, "row_key").select(
        "row_key", F.explode(F.transform("marks", own)).alias("m")).select("row_key", "m.*")
    texts = materialise(texts, "chunk-texts")
    keepers = texts.filter("keeper").groupBy("hash").agg(F.max("bytes").alias("kept_bytes"))
    checked = salted_join(texts.filter("not keeper"), keepers, groups.select("hash", "n"), "hash", "n", total, ["row_key", "start"])
    equal = checked.filter(F.col("bytes") == F.col("kept_bytes")).groupBy("row_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("removed"))
    equal = materialise(equal, "removed-chunks")
    discard(shapes, flags, chunks, groups, marks, texts)

    lines = lines_of(F.col("text"))
    new = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(without(lines, F.col("removed")), "\n"))
    count = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["len"])
    return rows.join(equal, "row_key", "left").select(
        F.col("row").withField(f"`{text_col}`", new).alias("row"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("removed_chunks"),
        F.coalesce(count, F.lit(0)).cast("long").alias("removed_lines"))
