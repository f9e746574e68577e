"""Operator 12: near-duplicate embeddings by spherical-cap filters from structured random product codes.

A code rotates the space at random and cuts it into blocks, each with a few random unit words; a filter is
one word of every block, so a code has words ^ blocks directions that are never listed.  List decoding finds the
directions that exceed a vector's cap from its best words of each block: of the products of words with
ranks i, j, ... only those with i * j * ... <= LIST can be among its LIST best.  The cap's angle follows
the vector (it holds the LIST best directions of each of CODES codes).  One angle for all vectors was measured too: block sums
spread so much that 5 to 20 % of the pairs at the threshold met on no filter at 24 to 36 filters a
vector (64 dimensions), against none of 4000 with LIST = 3 and CODES = 8.

Vectors that share a filter are candidates.  A filter's least vector is its centre, and each other member is
verified against it in double precision.  Filters whose members then lie in different components are verified whole, in
blocks of at most about BLOCK vectors a task, which hand on one edge a vector and never all pairs.  Links
are counted inside each component, in blocks too, so no pair is ever written that was not first narrowed
down by a filter, and n_links counts every pair of a component.

Copies (equal label and equal entries, by a 128-bit digest) are represented by one row with its number of copies.
Hot filters, centres and components are split (see common.attach, common.salted_join and _in_blocks).

Defined results: vectors that are null, empty, zero or hold null or non-finite entries, and rows without a
label, link with nothing; neither do vectors of different lengths.  Rows that repeat an id are vectors of
their own.  Rows without an id take part, but a component's id is the least of those it has (null if none);
``kept`` compares null-safe.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.llm.common import attach, id_column, materialise, salted_join, thinned
from inkstone.llm.components import components

CODES = 8
LIST = 3
BLOCKS = 4
MIN_BLOCK = 8  # dimensions of a block
BLOCK = 4096
CHUNK = 512


class Code:
    """One product code over ``dim`` dimensions."""

    def __init__(self, dim: int, number: int, words: int, threshold: float):
        import itertools
        import math

        import numpy as np

        rng = np.random.default_rng([12, dim, number])
        rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        n = max(1, min(BLOCKS, dim // MIN_BLOCK))
        self.blocks = []
        for part in np.array_split(np.arange(dim), n):
            # words no denser than twice the angle of a pair, or near vectors would share none
            dense = 3 * (1 / max(math.sin(min(2 * math.acos(threshold), math.pi / 2)), 1e-3)) ** (len(part) - 1)
            word = rng.standard_normal((len(part), int(min(max(round(words ** (1 / n)), 16), 512, max(dense, 2)))))
            self.blocks.append(rotation[:, part] @ (word / np.linalg.norm(word, axis=0)))
        self.keep = [min(LIST, b.shape[1]) for b in self.blocks]
        self.ranks = np.array([c for c in itertools.product(*map(range, self.keep)) if np.prod([i + 1 for i in c]) <= LIST])

    def decode(self, unit):
        """Indices of the best filters of each vector, one row a vector."""
        import numpy as np

        total, index = 0, 0
        for j, (block, keep) in enumerate(zip(self.blocks, self.keep)):
            dots = unit @ block
            best = np.argpartition(-dots, keep - 1, axis=1)[:, :keep] if keep < dots.shape[1] else np.tile(np.arange(keep), (len(dots), 1))
            value = np.take_along_axis(dots, best, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            total = total + value[:, self.ranks[:, j]]
            index = index * dots.shape[1] + best[:, self.ranks[:, j]]
        n = min(LIST, len(self.ranks))
        pick = np.argsort(-total, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(index, pick, 1)


def unit_rows(column):
    """[(positions, unit vectors)] for each length of usable vectors in an Arrow list column."""
    import numpy as np

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes))
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    good = (sizes > 0) & (np.diff(bad[ends]) == 0)
    out = []
    for d in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == d))
        x = values[ends[at][:, None] + np.arange(d)]
        size = np.abs(x).max(1)
        at, x = at[size > 0], x[size > 0] / size[size > 0][:, None]
        out.append((at, x / np.linalg.norm(x, axis=1)[:, None]))
    return out


def _signed(df: DataFrame, words: int, threshold: float) -> DataFrame:
    """row, vec_id, space (length and label of usable rows), vector, digest, keys of the filters."""
    schema = T.StructType([*df.schema.fields, T.StructField("space", T.StringType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        codes: dict[int, list[Code]] = {}
        for batch in batches:
            labels = batch.column(2).to_pylist()
            spaces, digests, keys = [None] * len(labels), [None] * len(labels), [[]] * len(labels)
            for at, unit in unit_rows(batch.column(3)):
                d = unit.shape[1]
                if d not in codes:
                    codes[d] = [Code(d, k, words, threshold) for k in range(CODES)]
                for i, x in zip(at, pc.take(batch.column(3), pa.array(at)).flatten().cast(pa.float64()).to_numpy().reshape(-1, d) + 0.0):
                    if labels[i] is not None:
                        spaces[i] = f"{d}:{labels[i]}"
                        digests[i] = hashlib.blake2b(spaces[i].encode() + b"\0" + x.tobytes(), digest_size=16).digest()
                base = {s: np.frombuffer(hashlib.blake2b(s.encode(), digest_size=8 * CODES).digest(), np.uint64)
                        for s in {spaces[i] for i in at} - {None}}
                found = [code.decode(unit).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for code in codes[d]]
                for j, i in enumerate(at):
                    if spaces[i] is not None:
                        keys[i] = np.concatenate([f[j] + b for f, b in zip(found, base[spaces[i]])]).view(np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(spaces, pa.string()), pa.array(digests, pa.binary()),
                                                              pa.array(keys, pa.list_(pa.int64()))],
                                             names=batch.schema.names + ["space", "digest", "keys"])
    return df.mapInArrow(sign, schema)


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs (centre, row) of one space whose cosine reaches the threshold."""
    @F.arrow_udf("boolean")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np

        for left, right in batches:
            out = np.zeros(len(left), bool)
            for (at, x), (_, y) in zip(unit_rows(left), unit_rows(right)):  # of one space, so of one length
                out[at] = np.einsum("ij,ij->i", x, y) >= threshold
            yield pa.array(out)
    side = lambda c: vectors.select(F.col("row").alias(c), F.struct("space", "vector").alias(f"v_{c}"))
    counts = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
    both = salted_join(pairs.join(side("row"), "row"), side("centre"), counts, "centre", "n", pairs.count(), ["row"])
    both = both.filter(F.col("v_row.space") == F.col("v_centre.space"))
    return both.filter(near("v_centre.vector", "v_row.vector")).select("centre", "row")


def _in_blocks(rows: DataFrame, group: str, vectors: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over the vectors of each group: whole if small, else over each pair of its blocks.

    ``rows`` (group, row and more) is a materialised table.  A task holds two blocks of about BLOCK vectors."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    dealt = attach(rows, sizes, group, "size", rows.count(), "inner")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("blocks", blocks).drop("size")
    dealt = dealt.join(vectors, "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    return dealt.groupBy(group, "space", "first", "second").applyInArrow(function, schema)


def _linker(threshold: float):
    def links(table: pa.Table) -> pa.Table:
        """One edge (u, v) from each vector to the least one it is connected with in these blocks."""
        import numpy as np

        unit, rows = _matrix(table), table.column("row").to_numpy()
        n, label = len(unit), np.arange(len(unit))
        order = np.argsort(rows)
        unit, rows = unit[order], rows[order]
        while True:
            new = label.copy()
            for start in range(0, n, CHUNK):
                linked = unit[start:start + CHUNK] @ unit.T >= threshold
                new[start:start + CHUNK] = np.minimum(new[start:start + CHUNK], np.where(linked, label, n).min(1))
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        far = np.flatnonzero(label != np.arange(n))
        return pa.table({"u": rows[far], "v": rows[label[far]]})
    return links


def _counter(threshold: float):
    def counts(table: pa.Table) -> pa.Table:
        """For each vector the weight of the other block's vectors (of its own, if there is one only) that it links with."""
        import numpy as np

        unit, weight, rows = _matrix(table), table.column("weight").to_numpy(), table.column("row").to_numpy()
        block, first, second = table.column("block").to_numpy(), table.column("first")[0].as_py(), table.column("second")[0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        total = np.zeros(len(unit), np.int64)
        for start in range(0, len(left), CHUNK):
            part = left[start:start + CHUNK]
            linked = unit[part] @ unit[right].T >= threshold
            if first == second:
                linked[rows[part][:, None] == rows[right]] = False
                total[part] += linked @ weight[right]
            else:
                total[part] += linked @ weight[right]
                total[right] += weight[part] @ linked
        return pa.table({"row": rows, "links": total})
    return counts


def _matrix(table: pa.Table):
    """Unit vectors of a group, all usable and of one length."""
    (_, unit), = unit_rows(table.column("vector").combine_chunks())
    return unit


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors of one label link when their cosine is at least
    ``threshold``."""
    source = df.select(F.monotonically_increasing_id().alias("row"), id_column(df, id_col).cast("long").alias("vec_id"),
                       id_column(df, label_col).cast("string").alias("label"), id_column(df, vector_col).alias("vector"))
    # about eight filters of a code for each vector
    signed = materialise(_signed(source, 8 * max(df.count(), 1), threshold), "signed")
    usable = signed.filter("digest IS NOT NULL")
    total = usable.count()

    copied = materialise(usable.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copied")
    copies = attach(usable.select("row", "digest"), copied, "digest", "n", total, "inner")
    copies = materialise(copies.filter("row <> rep").select("row", "rep"), "copies")
    if copies.take(1):
        usable = usable.join(copies.select("row"), "row", "left_anti")

    # filters with two members or more
    keys = usable.select("row", F.explode("keys").alias("key"))
    centres = keys.groupBy("key").agg(F.min("row").alias("centre"), F.max("row").alias("most"), F.count(F.lit(1)).alias("n"))
    centres = materialise(centres.filter("centre < most").select("key", "centre", "n"), "centres")
    met = materialise(thinned(keys, centres, "key"), "met")
    members = materialise(attach(met, centres, "key", "n", met.count(), "inner").filter("row <> centre").select("key", "row", "centre"), "members")
    pairs = materialise(members.select("centre", "row").distinct(), "pairs")
    wanted = materialise(pairs.select(F.col("centre").alias("row")).unionByName(pairs.select("row")).distinct(), "wanted")
    vectors = thinned(signed, wanted, "row").join(wanted, "row", "left_semi").select("row", "space", "vector")
    vectors = materialise(vectors, "vectors")
    links = materialise(_verified(pairs, vectors, threshold).select(F.col("row").alias("u"), F.col("centre").alias("v")), "links")
    found = materialise(components(links), "components")

    # members of one filter in different components, none of them its centre
    label = found.select(F.col("id").alias("row"), F.col("component").alias("of"))
    placed = materialise(members.join(label, "row", "left").select("key", "row", F.coalesce("of", "row").alias("of")), "placed")
    several = placed.groupBy("key").agg(F.min("of").alias("least"), F.max("of").alias("most"), F.count(F.lit(1)).alias("n"))
    several = materialise(several.filter("least < most").select("key", "n"), "several")
    opened = materialise(attach(placed.select("key", "row"), several, "key", "n", placed.count(), "inner").select("key", "row"), "opened")
    more = materialise(_in_blocks(opened, "key", vectors, _linker(threshold), "u long, v long"), "more-links")
    stars = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    found = materialise(components(stars.unionByName(more)), "components")

    # links inside each component; a vector counts as often as it has copies
    weights = copied.select(F.col("rep").alias("row"), F.col("n").alias("weight"))
    placed = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())  # the least ones too
    placed = placed.select(F.col("id").alias("row"), "component").join(weights, "row", "left").select(
        "row", "component", F.coalesce("weight", F.lit(1)).alias("weight"))
    placed = materialise(placed, "placed")
    counts = _in_blocks(placed, "component", vectors, _counter(threshold), "row long, links long")
    counts = counts.groupBy("row").agg(F.sum("links").alias("links"))
    nodes = placed.join(counts, "row", "left").unionByName(
        weights.join(placed, "row", "left_anti").select("row", F.col("row").alias("component"), "weight", F.lit(0).cast("long").alias("links")))
    nodes = nodes.select(F.col("row").alias("rep"), "component", "weight", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    nodes = materialise(nodes, "nodes")

    rows = signed.select("row", "vec_id").join(copies, "row", "left").select("vec_id", F.coalesce("rep", "row").alias("rep"))
    rows = materialise(attach(materialise(rows, "rows"), nodes, "rep", "weight", total, "left").select("vec_id", "component", "n_links"), "rows")
    linked = rows.filter("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    out = attach(linked, least, "component", "n", total, "inner").select("vec_id", "n_links", "component_id").unionByName(
        rows.filter("component IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
