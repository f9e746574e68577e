"""Operator 8: exact n-gram Jaccard join by universe partitions and the pigeonhole principle.

A document is the set of its distinct word shingles (64-bit hashes).  Sets are split into
size bands; two linked sets lie in one band or in neighbouring ones, and the scheme of the
smaller set's band finds them.  The scheme cuts the hash universe into U units, where
U = H + 1 + E and H is the largest symmetric difference of a linked pair of the band:

* a plain unit is indexed by its subset: pairs that agree on it meet;
* two units may be merged into one segment, indexed by its subset and by all its
  one-deletion subsets: pairs that differ by at most one shingle there meet (a deletion
  never meets a deletion).  Missing each other costs a pair one difference per plain unit
  and two per merged segment, hence U in all, more than the H it may have.

Cost-based allocation: per band, the number of merged segments is the one with the least
cost of index rows plus expected false candidates, from the number of documents in the
band.  Subsets that are empty would join strangers; E spare units make up for them: a set
loses one unit per empty plain unit and per one-shingle merged segment and two per empty
merged segment, and while it loses at most E the pair still meets on another key.  Only sets
that lose more index their empty subsets too, so no link is lost.

Candidates of a key are not expanded into pairs: its least set is the centre, and each
other member is a candidate of the centre.  Before the exact intersection of two sets is
taken, their odd sketches are compared: each shingle toggles one bit, so the number of
differing bits is at most the symmetric difference and a pair with more than a linked pair may
have is ruled out for certain.  Links make components.  What then is left on a key, members of
different components other than the centre, is compared by sketch in the join on the
key and verified likewise.  Members of one component need no further test.

Copies are joined through the digest of their set, without verification.

Defined results: texts without words have an empty set and link with nothing; a text with
fewer words than a shingle is one shingle; rows with a null id get a null component and
link with nothing; rows that share an id count as linked; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_rows, attach, discard, id_column, materialise, salted_join, text_runs, thinned
from inkstone.llm.components import components

# Cost model of the allocation: chance that two unrelated documents agree on a given shingle, cost
# of one candidate in index rows (a key's members only meet its centre, so it is one row to compare by sketch),
# bytes of text to one shingle.
AGREE, CANDIDATE_COST, BYTES_PER_SHINGLE = 0.003, 1, 6
# bits of a sketch per difference that a linked pair may have
SKETCH_BITS = 8


def bands(limit: int, num: int, den: int) -> list[tuple[int, int]]:
    """(lo, hi) of each size band up to ``limit`` shingles."""
    out, lo = [], 1
    while lo <= limit:
        out.append((lo, max(lo, lo * den // num)))
        lo = out[-1][1] + 1
    return out


def scheme(lo: int, hi: int, num: int, den: int, documents: float, merged: int | None = None) -> tuple[int, int, int]:
    """(units, merged segments, spare units) of a band; ``merged`` overrides the cost model."""
    most = (den - num) * (hi + hi * den // num) // (den + num)
    spare = 0
    for _ in range(20):
        empty = (most + 1 + spare) * math.exp(-lo / (most + 1 + spare))
        spare = max(spare, math.ceil(empty + 3 * math.sqrt(empty) - 0.5))
        if spare > 2 * most + 4:
            break
    spare = min(spare, most + 1)
    units = most + 1 + spare
    if merged is not None:
        return units, min(merged, units // 2), spare

    def chance(mean: float, deletions: bool) -> float:
        p = [math.exp(-mean) * mean ** j / math.factorial(j) for j in range(40)]
        same = sum(p[j] ** 2 * AGREE ** j for j in range(1, 40))
        return same + deletions * 2 * sum(p[j] * p[j + 1] * AGREE ** j for j in range(1, 39))

    mean = lo / units
    plain, pair = chance(mean, False), chance(2 * mean, True)

    def cost(m: int) -> float:
        rows = documents * (units - 2 * m + m * (1 + 2 * mean))
        return rows + CANDIDATE_COST * documents ** 2 / 2 * ((units - 2 * m) * plain + m * pair)

    return units, min({0, units // 8, units // 4, units // 2}, key=cost), spare


def mix(x):
    """A bijective mixing of unsigned 64-bit integers (two multiply-xorshift rounds)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], words: int) -> list:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased, words are runs of other
    than [\\x20\\x09-\\x0D]."""
    import numpy as np
    import pandas as pd

    split = [t.lower().split() for t in texts]
    flat = np.array([w for ws in split for w in ws], object)
    hashed = pd.util.hash_array(flat, categorize=True).astype(np.uint64) if len(flat) else np.zeros(0, np.uint64)
    rolled = np.zeros(len(hashed), np.uint64)
    for j in range(words):
        rolled[:len(hashed) - j] = mix(rolled[:len(hashed) - j] + hashed[j:] + np.uint64(1))
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= words:
            out.append(np.unique(rolled[at:at + n - words + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for h in hashed[at:at + n]:
                whole = mix(whole + h + np.uint64(2))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class Signer:
    """Index keys of sets: ``full`` of whole subsets, ``dels`` of subsets with one deletion."""

    def __init__(self, num: int, den: int, schemes: dict):
        self.num, self.den, self.schemes = num, den, schemes  # {band number: (units, merged, spare)}
        self.edges: list[int] = []

    def band_of(self, n: int) -> int:
        import bisect

        while not self.edges or self.edges[-1] < n:
            lo = self.edges[-1] + 1 if self.edges else 1
            self.edges.append(max(lo, lo * self.den // self.num))
        return bisect.bisect_left(self.edges, n)

    def scheme_of(self, band: int) -> tuple[int, int, int]:
        if band not in self.schemes:  # a size that the estimate did not foresee
            lo = self.edges[band - 1] + 1 if band else 1
            self.schemes[band] = scheme(lo, self.edges[band], self.num, self.den, 1)
        return self.schemes[band]

    def sketch(self, items, band: int):
        """Odd sketch of a set, sized by the largest symmetric difference of a linked pair of the band."""
        import numpy as np

        if band < 0:
            return np.zeros(1, np.int64)
        units, _, spare = self.scheme_of(band)
        longs = -(-(units - spare) * SKETCH_BITS // 64)
        place = (mix(items + np.uint64(5)) % np.uint64(64 * longs)).astype(np.int64)
        return np.packbits((np.bincount(place, minlength=64 * longs) & 1).astype(np.uint8), bitorder="little").view(np.int64)

    def keys(self, items) -> tuple:
        """(full, dels) of one set, under its own band and under the next smaller one."""
        import numpy as np

        n, full, dels = len(items), [], []
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self.band_of(n)
        place, value = mix(items + np.uint64(3)) >> np.uint64(32), mix(items + np.uint64(4))
        for band in (own, own - 1):
            if band < 0 or (band < own and n > self.edges[band] * self.den // self.num):
                continue
            units, merged, spare = self.scheme_of(band)
            unit = ((place * np.uint64(units)) >> np.uint64(32)).astype(np.int64)
            segment = np.where(unit < 2 * merged, unit >> 1, unit - merged)
            count = units - merged
            size = np.bincount(segment, minlength=count)
            total = np.zeros(count, np.uint64)
            np.add.at(total, segment, value)
            salt = mix(np.arange(count, dtype=np.uint64) + np.uint64((band + 1) << 32))
            lost = np.count_nonzero(size[merged:] == 0) + 2 * np.count_nonzero(size[:merged] == 0)
            lost += np.count_nonzero(size[:merged] == 1)
            shown = size > 0 if lost <= spare else np.ones(count, bool)
            full.append(mix(total[shown] + salt[shown]))
            if merged:
                inside = segment < merged
                if lost <= spare:
                    inside &= size[segment] > 1
                where = segment[inside]
                dels.append(mix(total[where] - value[inside] + salt[where]))
        one = lambda x: np.unique(np.concatenate(x)).view(np.int64) if x else np.zeros(0, np.int64)
        return one(full), one(dels)


def _signatures(df: DataFrame, words: int, num: int, den: int, merged: int | None) -> DataFrame:
    """(doc_id, n_shingles, digest, band, sketch, smaller, full, dels), one row per row of ``df`` (doc_id, text);
    sketch is that of the own band, smaller that of the next smaller band."""
    size = F.greatest(F.lit(1.0), F.octet_length(F.coalesce("text", F.lit(""))) / BYTES_PER_SHINGLE)
    step = math.log(den / num)
    # rows per band, from text bytes: one row per factor den / num of size
    near = {int(r["b"]): r["n"] for r in df.groupBy(F.floor(F.log(size) / step).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = bands(math.ceil(math.exp((max(near, default=0) + 1) * step)), num, den)
    schemes = {k: scheme(lo, hi, num, den, near.get(int(math.log(lo) / step), 1), merged) for k, (lo, hi) in enumerate(ranges)}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        signer = Signer(num, den, dict(schemes))
        for batch in batches:
            for a, b, texts in text_runs(batch.column(1)):
                sets = shingle_sets(texts, words)
                keys = [signer.keys(s) for s in sets]
                own = [signer.band_of(len(s)) if len(s) else -1 for s in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array(own, pa.int32()), pa.array([signer.sketch(s, k) for s, k in zip(sets, own)], longs),
                     pa.array([signer.sketch(s, k - 1) for s, k in zip(sets, own)], longs),
                     pa.array([k[0] for k in keys], longs), pa.array([k[1] for k in keys], longs)],
                    ["doc_id", "n_shingles", "digest", "band", "sketch", "smaller", "full", "dels"])

    return df.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, band int, sketch array<long>, "
                               "smaller array<long>, full array<long>, dels array<long>")


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Whether the sizes and sketches of the structs ``x`` and ``y`` (n, band, sketch, smaller) leave a link possible."""
    x, y = F.col(x), F.col(y)
    n = x["n"] + y["n"]
    most = n - 2 * F.floor((num * n + (num + den - 1)) / F.lit(num + den))
    left = F.when(x["band"] <= y["band"], x["sketch"]).otherwise(x["smaller"])
    right = F.when(y["band"] <= x["band"], y["sketch"]).otherwise(y["smaller"])
    flips = F.aggregate(F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return (F.abs(x["band"] - y["band"]) <= 1) & (F.abs(x["n"] - y["n"]) <= most) & (flips <= most)


def _verify(pairs: DataFrame, df: DataFrame, words: int) -> DataFrame:
    """(a, b, distance) of pairs (a, b) of ids, by the exact intersection of the two sets."""
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    @F.arrow_udf("binary")
    def blob(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for _, _, texts in text_runs(batch):
                out += [s.tobytes() for s in shingle_sets(texts, words)]
            yield pa.array(out, pa.binary())

    @F.arrow_udf("double")
    def distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np

        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append(1 - common / max(len(both) - common, 1))
            yield pa.array(out, pa.float64())

    wanted = materialise(wanted, "wanted")
    rows = thinned(df, wanted, "doc_id").join(wanted, "doc_id", "left_semi")
    with arrow_rows(df.sparkSession):
        sets = materialise(rows.select("doc_id", blob("text").alias("set")), "sets")
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}"))
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    both = salted_join(pairs.join(side("b"), "b"), side("a"), counts, "a", "n", pairs.count(), ["b"])
    with arrow_rows(df.sparkSession):
        return materialise(both.select("a", "b", distance("set_a", "set_b").alias("distance")), "distances")


def jaccard_components(df: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id",
                       text_col: str = "text", merged: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; sets link when their Jaccard similarity is at
    least num / den.  ``merged`` fixes the number of merged segments of all bands (for tests)."""
    df = df.select(id_column(df, id_col).cast("long").alias("doc_id"), id_column(df, text_col).alias("text"))
    with arrow_rows(df.sparkSession):
        signed = materialise(_signatures(df, words, num, den, merged), "signatures")
    narrow = signed.select("doc_id", "n_shingles", "digest").filter("doc_id IS NOT NULL AND n_shingles > 0")
    total = narrow.count()

    # copies: the least id with a set stands for it
    sets = materialise(narrow.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "set-groups")
    reps = materialise(attach(narrow, sets, "digest", "n", total, "inner").select("doc_id", "rep"), "representatives").distinct()

    # keys with two members or more: the centre is the least member by a whole subset
    keys = signed.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.explode(F.concat(
        F.transform("full", lambda k: F.struct(k.alias("key"), F.lit(False).alias("deletion"))),
        F.transform("dels", lambda k: F.struct(k.alias("key"), F.lit(True).alias("deletion"))))).alias("k")).select("id", "k.key", "k.deletion")
    centres = keys.groupBy("key").agg(F.min(F.when(~F.col("deletion"), F.col("id"))).alias("centre"),
                                      F.min("id").alias("least"), F.max("id").alias("most"))
    centres = materialise(centres.filter("centre IS NOT NULL AND least < most").select("key", "centre"), "centres")
    met = thinned(keys, centres, "key", 26).join(centres, "key").filter("id <> centre")
    met = met.join(reps.select(F.col("doc_id").alias("id"), F.col("rep").alias("member")), "id")
    members = materialise(met.groupBy("key", "centre", "member").agg(F.min("deletion").alias("deletion")), "members")
    pivots = reps.select(F.col("doc_id").alias("centre"), F.col("rep").alias("pivot"))
    sketches = signed.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(
        "doc_id", F.struct(F.col("n_shingles").alias("n"), "band", "sketch", "smaller").alias("s"))
    sketches = materialise(sketches.filter("s.n > 0"), "sketches")
    sizes = materialise(signed.select("doc_id", "n_shingles"), "set-sizes")
    discard(signed)  # the keys have done their work
    sketch = lambda c, name: sketches.select(F.col("doc_id").alias(c), F.col("s").alias(name))
    stars = members.select("centre", "member").distinct().join(pivots, "centre").filter("pivot <> member").select("pivot", "member").distinct()
    stars = materialise(stars.join(sketch("member", "y"), "member"), "stars")
    counts = stars.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    stars = salted_join(stars, sketch("pivot", "x"), counts, "pivot", "n", stars.count(), ["member"]).filter(_may_link("x", "y", num, den))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    near = F.col("distance") <= 1 - num / den + 1e-12
    tested = _verify(stars.select(*pair("pivot", "member")).distinct(), df, words).filter(near)
    copies = reps.filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = copies.unionByName(tested.select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = materialise(components(links), "components")

    # what the centres left open: members of one key in different components, none of them the centre
    label = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    placed = members.join(pivots, "centre").filter("pivot <> member").join(label("member"), "member", "left").select(
        "key", "member", "deletion", F.coalesce("of_member", "member").alias("of_member"))
    several = F.min("of_member").alias("least"), F.max("of_member").alias("most"), F.min("deletion").alias("deletion")
    opened = materialise(placed, "placed")
    several = opened.groupBy("key").agg(*several).filter("least < most AND NOT deletion").select("key")
    opened = opened.join(several, "key", "left_semi").join(sketch("member", "s"), "member")
    opened = materialise(opened.select("key", "member", "deletion", "of_member", "s"), "open-members")
    side = lambda name: opened.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("member", "deletion", "of_member")],
                                      F.col("s").alias(name))
    rest = side("x").join(side("y"), "key").filter(
        (F.col("x_member") < F.col("y_member")) & (F.col("x_of_member") != F.col("y_of_member"))
        & ~(F.col("x_deletion") & F.col("y_deletion")) & _may_link("x", "y", num, den))
    more = _verify(rest.select(*pair("x_member", "y_member")).distinct(), df, words).filter(near)
    stars = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    final = components(stars.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    out = sizes.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
