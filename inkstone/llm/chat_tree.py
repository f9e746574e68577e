"""Operator 6: chat formatting as a prefix tree.

A turn is formatted as ``<turn ROLE>\\nTEXT</turn>\\n``.  Inside role and text a backslash goes
before each backslash, ``<`` and ``>``, so no text can hold a control string and the escape is
undone by dropping one backslash of each pair.

Conversations that share their first turns share the nodes of those turns.  A node is known by
the chained SHA-256 of its turns; shared turns are written once, depth first.  The stream
of all nodes is cut nowhere, one code point is one token:

    nodes    start, length     place of the node in the stream
             position          position id of its first token (tokens of its ancestors)
             depth, role, segment
             loss_from, loss_to   token range of the segment under the loss mask (assistant texts)
             attends           ancestors as intervals [from, to) of the stream, merged when adjacent;
                               a token attends to these and to its own node up to itself
    members  conv_id, place, turn number, start of the turn's node

Order: a conversation's path is the list of its node digests; conversations sorted by path visit
the tree depth first, and the least conversation through a node writes it.  Paths are sorted by
range partitions, node sums are prefix-summed in blocks of conversations, and a node with
more than a thousandth of all members (a common first turn) is joined through salts, so no tree
and no node is gathered in one task.  Within a conversation rows are streamed in turn order.

Defined results: null texts and roles count as empty; rows are ordered by turn (null first), role
and text; rows that repeat are turns of their own; rows with a null conv_id are one
conversation; an empty table gives no nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.common import id_column, materialise, parts, salted_join
from inkstone.operators.index import with_global_index
from inkstone.sources.io import scratch_path

# FIXED VALUES: the template
OPEN, OPENED, CLOSE = "<turn ", ">\n", "</turn>\n"
LOSS_ROLE = "assistant"
BLOCK = 1 << 14
TURN = ("conv_id long, place int, role string, text string, node binary, length long, loss_from long, loss_to long, "
        "path binary, n_turns int")
NODES = ("start long, length long, position long, depth int, role string, segment string, loss_from long, loss_to long, "
         "attends array<struct<from: long, to: long>>")
MEMBERS = "conv_id long, place long, turn int, start long"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<>])", r"\\$1")


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(OPENED), escaped(text), F.lit(CLOSE))


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> rows with node digests; a conversation's last row also
    gets its path and turn count.  Memory holds one batch and the digests of one conversation."""
    import hashlib

    names = [x.split()[0] for x in TURN.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    special = re.compile(r"[\\<>]")
    out, current, digest, path = [], object(), b"", []

    def ended() -> None:
        if path:
            out[-1][8:10] = [b"".join(path), len(path)]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv != current:
                ended()
                current, digest, path = conv, b"", []
                if len(out) > 500:  # the last row of a conversation stays back until it is known to be the last
                    yield batch_of(out)
                    out = []
            elif len(out) > 500:
                yield batch_of(out)
                out = []
            digest = hashlib.sha256(digest + repr((role, text)).encode("utf-8", "surrogatepass")).digest()[:16]
            at = len(OPEN) + len(role) + len(special.findall(role)) + len(OPENED)
            size = len(text) + len(special.findall(text))
            mask = (at, at + size) if role == LOSS_ROLE else (0, 0)
            out.append([conv, len(path), role, text, digest, at + size + len(CLOSE), *mask, None, None])
            path.append(digest)
    ended()
    if out:
        yield batch_of(out)


def write(df: DataFrame, path: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> str:
    """Format all conversations of ``df`` into the tables nodes and members; returns their folder."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, "chat-tree")
    rows = df.select(id_column(df, id_col).cast("long").alias("conv_id"), id_column(df, turn_col).alias("turn"),
                     F.coalesce(id_column(df, role_col), F.lit("")).alias("role"),
                     F.coalesce(id_column(df, text_col), F.lit("")).alias("text"))
    ordered = rows.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = materialise(ordered.mapInArrow(chain, TURN), "chat-turns")

    # place of each conversation in depth-first order
    last = turns.filter("path IS NOT NULL").select("conv_id", "path", "n_turns")
    placed = materialise(with_global_index(last, ["path", "conv_id"], "rank").select("conv_id", "rank", "path"), "chat-order")
    turned = turns.join(placed.select(F.col("conv_id").alias("c"), "rank"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c", "path", "n_turns")
    turned = materialise(turned, "chat-ranked")

    # the first conversation through a node writes it; what a conversation writes is prefix-summed
    nodes = turned.groupBy("node").agg(F.min("rank").alias("writer"), F.max("length").alias("length"),
                                       F.max("place").alias("depth"), F.count(F.lit(1)).alias("refs"))
    nodes = materialise(nodes, "chat-nodes")
    written = nodes.groupBy(F.col("writer").alias("rank")).agg(F.sum("length").alias("sum"), F.min("depth").alias("least"))
    written = written.withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = written.groupBy("block").agg(F.sum("sum").alias("sum"))  # one row per BLOCK conversations
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("sum").over(up_to(Window.orderBy("block"))), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("sum").over(up_to(Window.partitionBy("block").orderBy("rank"))), F.lit(0))
    starts = written.withColumn("inner", inner).join(blocks, "block").select("rank", (F.col("base") + F.col("inner")).alias("base"))
    inside = F.coalesce(F.sum("length").over(up_to(Window.partitionBy("writer").orderBy("depth"))), F.lit(0))
    nodes = nodes.withColumn("inside", inside).join(starts.withColumnRenamed("rank", "writer"), "writer")
    nodes = materialise(nodes.select("node", "writer", "refs", (F.col("base") + F.col("inside")).alias("start")), "chat-starts")

    # every turn learns the place of its node; a common node meets its turns through salts
    total = turned.count()
    known = salted_join(turned.select("conv_id", "rank", "place", "node", "length"), nodes.select("node", "writer", "start"),
                        nodes.select("node", "refs"), "node", "refs", total, ["rank", "place"])
    known = materialise(known, "chat-members")
    known.select("conv_id", F.col("rank").alias("place"), F.col("place").alias("turn"), "start").write.parquet(f"{path}/members")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by conversation and turn -> position and ancestors of the nodes that it writes."""
        rank, position, merged, rows = None, 0, [], []
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            for r, start, length, writer in zip(*(batch.column(c).to_pylist() for c in ("rank", "start", "length", "writer"))):
                if r != rank:
                    rank, position, merged = r, 0, []
                if writer == r:
                    rows.append((start, position, [{"from": a, "to": b} for a, b in merged]))
                if merged and merged[-1][1] == start:
                    merged[-1] = (merged[-1][0], start + length)
                else:
                    merged.append((start, start + length))
                position += length
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), kind))],
                                                     ["start", "position", "attends"])
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), kind))],
                                             ["start", "position", "attends"])

    lines = known.repartition(parts(spark), "rank").sortWithinPartitions("rank", "place")
    spans = lines.mapInArrow(intervals, "start long, position long, attends array<struct<from: long, to: long>>")
    texts = turned.join(known.filter("writer = rank").select("rank", "place", "start"), ["rank", "place"])
    out = texts.join(spans, "start").select(
        "start", "length", "position", F.col("place").alias("depth"), "role", segment(F.col("role"), F.col("text")).alias("segment"),
        "loss_from", "loss_to", "attends")
    out.repartitionByRange(parts(spark), "start").sortWithinPartitions("start").write.parquet(f"{path}/nodes")
    return path


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, place, turn, role, text, loss, length) of every turn, from the written tables: role and text unescaped,
    loss the text under the mask (null where there is none), length that of the formatted turn."""
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    members = spark.read.schema(MEMBERS).parquet(f"{path}/members")
    counts = members.groupBy("start").agg(F.count(F.lit(1)).alias("refs"))
    turns = salted_join(members, nodes.select("start", "length", "segment", "loss_from", "loss_to"), counts, "start", "refs",
                        members.count(), ["place", "turn"])
    plain = lambda c: F.regexp_replace(c, r"\\([\\<>])", "$1")
    # possessive, so that a long role takes no stack
    body = r"(?s)^<turn ((?:[^\\<>]++|\\[\\<>])*+)>\n(.*)</turn>\n$"
    masked = F.expr("substring(segment, int(loss_from) + 1, int(loss_to - loss_from))")
    return turns.select("conv_id", "place", "turn", plain(F.regexp_extract("segment", body, 1)).alias("role"),
                        plain(F.regexp_extract("segment", body, 2)).alias("text"),
                        F.when(F.col("loss_to") > 0, plain(masked)).alias("loss"), F.col("length"))


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of read_turns(): counts and digests, streamed in turn order."""
    out_type = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [x.split()[0] for x in out_type.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        place, now, rows = None, None, []

        def ended() -> None:
            if now:
                rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("place", "conv_id", "role", "text", "loss", "length"))
            for p, conv, role, text, loss, length in zip(*columns):
                if p != place:
                    ended()
                    place, now = p, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        ended()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    ordered = turns.repartition(parts(turns.sparkSession), "place").sortWithinPartitions("place", "turn")
    return ordered.mapInArrow(fold, out_type)
