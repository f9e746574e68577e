"""Operator 11: cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes (space + text).  A byte offset where tokens of both end is
a shared cut.  An interval is divided at the shared cut next to its middle, which is located by
bisecting the other side's token ends, and both halves are divided in turn; an interval without
a shared cut inside is a leaf group.  The intervals of one level of the recursion, of all texts of a
run, are divided together, so a run takes about log2(tokens) steps on arrays.

Links are the pairs of tokens whose byte ranges overlap.  :func:`align` yields groups and links
of every document, :func:`score_links` counts id pairs over the corpus and scores the links of every
document by those counts.  The TOP most frequent pairs (a fixed number of rows) are looked up in a
broadcast table, all rarer pairs in an ordinary join, where no key can be hot.

Encoding is one scan without a shuffle, of whole texts, in runs of about a megabyte.

Defined results: null and empty texts, and texts that a tokenizer does not reproduce byte for byte,
have no tokens: all numbers are 0 and ``groups`` is ''.  Rows are kept as they are, repeated or without
an id; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.llm.common import arrow_rows, attach, id_column, materialise, text_runs

TOP = 1 << 17
PARTIAL_PAIRS = 1 << 20

ALIGNED = """row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string,
             link_a array<int>, link_b array<int>, link_n array<int>"""


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on in byte order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Side:
    """One tokenizer in a worker: ids of texts (each with its leading space), bytes of each id, and whether the tokens
    of a text, if they have its length, are sure to be its bytes."""

    encode: Callable
    pieces: list[bytes]
    lossless: bool

    def __post_init__(self):
        import numpy as np

        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def ids(self, texts: list[bytes], strings: list[str]) -> tuple[list, list[bool]]:
        """Ids of each text, and whether they reproduce it."""
        import numpy as np

        out = [np.array(i, np.int64) for i in self.encode(strings)]
        same = [int(self.lengths[i].sum()) == len(t) for i, t in zip(out, texts)]
        if not self.lossless:
            same = [ok and b"".join(map(self.pieces.__getitem__, i.tolist())) == t for ok, i, t in zip(same, out, texts)]
        return out, same


def byte_level(tokenizer: str, pattern: str) -> Side:
    """Side A: a byte-level BPE tokenizer from the text of its JSON file; special tokens are plain text.

    Where the file is no more than ranked merges (ids in merge order, no normaliser, split by ``pattern``), its
    vocabulary goes to the library for ranks, which gives the same ids in a fifth of the time."""
    import os

    spec = json.loads(tokenizer)
    before, model = spec["pre_tokenizer"], spec["model"]
    if before["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("side A takes a byte-level tokenizer without normaliser")
    vocab, alphabet = model["vocab"], byte_alphabet()
    size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
    pieces = [b""] * size
    for piece, i in ranks.items():
        pieces[i] = piece
    lossless = all(bytes([b]) in ranks for b in range(256))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    if lossless and plain and before["use_regex"] and not before["add_prefix_space"] and made == sorted(set(made)) and len(made) + 256 == len(ranks):
        import tiktoken

        ranked = tiktoken.Encoding("side-a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [ranked.encode_ordinary(t) for t in texts], pieces, lossless)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(tokenizer)
    own.encode_special_tokens = True
    return Side(lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)], pieces, lossless)


def piece_level(model: bytes) -> Side:
    """Side B: a sentencepiece model that itself adds the leading space."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(model)
    normal, pieces, byte_pieces = spec.normalizer_spec, [], 0
    for p in spec.pieces:
        byte_pieces += p.type == p.BYTE
        pieces.append(bytes([int(p.piece[3:-1], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode())
    # the text is rewritten only where it holds U+2581, which then counts two bytes less
    lossless = (byte_pieces == 256 and normal.add_dummy_prefix and normal.escape_whitespaces
                and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap)
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    return Side(lambda texts: own.encode([t[1:] for t in texts], num_threads=1), pieces, lossless)


def _next_shared(a, b, at, stop):
    """Index of the first shared end of ``a`` from ``at`` on and below ``stop``, or -1."""
    import numpy as np

    out, who = np.full(len(at), -1), np.flatnonzero(at < stop)
    k = at[who]
    while len(who):
        end = b[np.searchsorted(b, a[k])]
        hit = end == a[k]
        out[who[hit]] = k[hit]
        who, end = who[~hit], end[~hit]
        k = np.searchsorted(a, end)  # no end of a before this one can be shared
        inside = k < stop[who]
        who, k = who[inside], k[inside]
    return out


def _last_shared(a, b, at, start):
    """Index of the last shared end of ``a`` before ``at`` and from ``start`` on, or -1."""
    import numpy as np

    out, who = np.full(len(at), -1), np.flatnonzero(at > start)
    k = at[who] - 1
    while len(who):
        p = np.searchsorted(b, a[k], side="right") - 1
        who, k, p = who[p >= 0], k[p >= 0], p[p >= 0]
        hit = b[p] == a[k]
        out[who[hit]] = k[hit]
        who, p = who[~hit], p[~hit]
        k = np.searchsorted(a, b[p], side="right") - 1
        inside = k >= start[who]
        who, k = who[inside], k[inside]
    return out


def shared_cuts(a, b, last):
    """Indices into ``a`` of the shared ends of ``a`` and ``b`` (increasing byte offsets of all texts of a run, one
    after the other), where ``last`` are the indices into ``a`` of the texts' last tokens."""
    import numpy as np

    cuts = [last]
    low, high = np.concatenate([[0], last[:-1] + 1]), last  # ends a[low:high] lie inside an interval
    while True:
        open_ = low < high
        low, high = low[open_], high[open_]
        if not len(low):
            return np.sort(np.concatenate(cuts))
        middle = (low + high) >> 1
        cut = _next_shared(a, b, middle, high)
        none = np.flatnonzero(cut < 0)
        cut[none] = _last_shared(a, b, middle[none], low[none])
        found = cut >= 0  # the others are leaves
        low, high, cut = low[found], high[found], cut[found]
        cuts.append(cut)
        low, high = np.concatenate([low, cut + 1]), np.concatenate([cut, high])


class Aligner:
    """Groups and links of runs of texts in one Python worker."""

    def __init__(self, tokenizer: str, pattern: str, model: bytes):
        self.a, self.b = byte_level(tokenizer, pattern), piece_level(model)
        self.n_a, self.n_b = len(self.a.pieces), len(self.b.pieces)
        # how a token is written: with "," or, as the last of its side of a group, with "|" or ";"
        self.words = [f"{i}{mark}" for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for mark in marks for i in range(n)]

    def run(self, texts: list[bytes]) -> dict:
        """Columns for the texts; the link columns are one flat array each with ``n_pairs`` entries a text."""
        import numpy as np

        spaced = [b" " + t if t else b"" for t in texts]
        strings = [t.decode(errors="replace") for t in spaced]
        (all_a, same_a), (all_b, same_b) = (side.ids(spaced, strings) for side in (self.a, self.b))
        whole = np.array([bool(t) and x and y for t, x, y in zip(spaced, same_a, same_b)], bool)
        used = np.flatnonzero(whole)
        zeros = np.zeros(len(texts), np.int64)
        out = {"n_a": zeros, "n_b": zeros.copy(), "n_groups": zeros.copy(), "n_links": zeros.copy(), "n_pairs": zeros.copy(),
               "groups": [""] * len(texts), "a": zeros[:0], "b": zeros[:0], "n": zeros[:0]}
        if not len(used):
            return out
        ids_a, ids_b = (np.concatenate([ids[k] for k in used]) for ids in (all_a, all_b))
        n_a, n_b = (np.array([len(ids[k]) for k in used], np.int64) for ids in (all_a, all_b))
        a, b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        cut_a = shared_cuts(a, b, last_a)
        cut_b = np.searchsorted(b, a[cut_a])

        # the tokens of both sides in the order of the groups
        size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        code_a, code_b = ids_a.copy(), ids_b + 2 * self.n_a
        code_a[cut_a] += self.n_a
        code_b[cut_b] += self.n_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(cut_b - size_b + 1, size_a)] = code_a
        order[np.arange(len(b)) + np.repeat(cut_a + 1, size_b)] = code_b
        word, start, groups = self.words.__getitem__, 0, out["groups"]
        for k, end in zip(used, last_a + last_b + 2):
            groups[k] = "".join(map(word, order[start:end].tolist()))[:-1]
            start = end

        # every stretch between neighbouring ends of either side is one overlap
        inner = np.ones(len(b), bool)
        inner[cut_b] = False
        ends = np.sort(np.concatenate([a, b[inner]]), kind="stable")
        n_groups = np.diff(np.searchsorted(cut_a, last_a, side="right"), prepend=0)
        n_links = n_a + n_b - n_groups
        text = np.repeat(np.arange(len(used)), n_links)
        key = (text * self.n_a + ids_a[np.searchsorted(a, ends)]) * self.n_b + ids_b[np.searchsorted(b, ends)]
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(new, len(key)))
        key = key[new]
        text, pair = key // (self.n_a * self.n_b), key % (self.n_a * self.n_b)
        for name, value in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links),
                            ("n_pairs", np.bincount(text, minlength=len(used)))):
            out[name][used] = value
        return out | {"a": pair // self.n_b, "b": pair % self.n_b, "n": times}


def _lists(values, sizes) -> pa.Array:
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                    pa.array(values.astype(np.int32)))


def align(df: DataFrame, tokenizer: str, pattern: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``, with the columns ALIGNED: sizes, ``groups`` as ``a1,a2|b1;a3|b2,b3`` in decimal ids,
    and the distinct id pairs of the links with the number of links of each.  ``row`` numbers the rows of
    this result, so materialise it before using it twice.

    ``tokenizer`` is the text of a byte-level JSON file (it encodes space + text by ``pattern``), ``model`` a
    sentencepiece model that adds the space itself."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), id_column(df, id_col).cast("long").alias("doc_id"),
                     id_column(df, text_col).alias("text"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(tokenizer, pattern, model)
        for batch in batches:
            for start, end, texts in text_runs(batch.column(2)):
                out = own.run(texts)
                head = batch.slice(start, end - start)
                columns = [pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                columns += [pa.array(out["groups"], pa.string())] + [_lists(out[c], out["n_pairs"]) for c in ("a", "b", "n")]
                yield pa.RecordBatch.from_arrays(head.columns[:2] + columns, names=[
                    "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b", "link_n"])
    return rows.mapInArrow(aligned, ALIGNED)


def _pairs(batch: pa.RecordBatch):
    """Pair keys and link numbers of the flat link columns, the last three of a batch, with the sizes of the rows."""
    import numpy as np

    a, b, n = (c.flatten().to_numpy().astype(np.int64) for c in batch.columns[-3:])
    return a << 32 | b, n, np.diff(batch.columns[-3].offsets.to_numpy())


def count_links(aligned: DataFrame) -> DataFrame:
    """(a, b, count): links of each id pair in the corpus.  A task adds up at most PARTIAL_PAIRS distinct pairs before it
    hands them on."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def merged(keys, counts):
            keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            return keys, np.bincount(where, np.concatenate(counts), len(keys)).astype(np.int64)

        def rows(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], names=["a", "b", "n"])

        keys, counts, held = [], [], 0
        for batch in batches:
            key, n, _ = _pairs(batch)
            keys.append(key), counts.append(n)
            held += len(key)
            if held > 2 * PARTIAL_PAIRS:
                key, n = merged(keys, counts)
                if len(key) > PARTIAL_PAIRS:
                    yield rows(key, n)
                    key, n = key[:0], n[:0]
                keys, counts, held = [key], [n], len(key)
        if keys:
            yield rows(*merged(keys, counts))
    parts = aligned.select("link_a", "link_b", "link_n").mapInArrow(partial, "a long, b long, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("count"))


def score_links(aligned: DataFrame, top: int = TOP) -> DataFrame:
    """``aligned`` (a materialised table of :func:`align`, with or without ``groups``) without its link columns, with n_best
    (links whose pair has the highest count of its B id) and count_sum (sum of the counts of all links)."""
    counts = materialise(count_links(aligned), "link-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("highest"), F.count(F.lit(1)).alias("n"))
    scored = attach(counts, best, "b", "n", counts.count(), "inner")
    scored = materialise(scored.select("a", "b", "count", (F.col("count") == F.col("highest")).alias("is_best")), "link-scores")
    # at most ``top`` rows reach the driver and the workers
    common = scored.orderBy(F.desc("count"), "a", "b").limit(top).toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    common = common.combine_chunks()
    kept = [c for c in aligned.columns if not c.startswith("link_")]
    fields = [f for f in aligned.schema.fields if f.name in kept]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in ("best", "total")]
                          + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("link_a", "link_b", "link_n")])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        a, b, count, is_best = (common.column(k).to_numpy() for k in range(4))
        table = np.append(a << 32 | b, np.iinfo(np.int64).max)
        worth, is_best = np.append(count, 0), np.append(is_best, False)
        for batch in batches:
            key, n, sizes = _pairs(batch)
            at = np.searchsorted(table, key)
            known = table[at] == key
            n_known, ends = n * known, np.append(0, np.cumsum(sizes))

            def per_row(values):
                return np.diff(np.append(0, np.cumsum(values))[ends])
            total, best, left = per_row(worth[at] * n_known), per_row(is_best[at] * n_known), per_row(~known)
            rare = [_lists(x, left) for x in (key[~known] >> 32, key[~known] & 0xFFFFFFFF, n[~known])]
            yield pa.RecordBatch.from_arrays(batch.columns[:-3] + [pa.array(best), pa.array(total)] + rare,
                                             names=kept + ["best", "total", "link_a", "link_b", "link_n"])
    found = aligned.select(*kept, "link_a", "link_b", "link_n").mapInArrow(looked_up, schema)
    found = materialise(found, "looked-up")
    rare = found.select("row", F.explode(F.arrays_zip("link_a", "link_b", "link_n")).alias("p")).select(
        "row", F.col("p.link_a").cast("long").alias("a"), F.col("p.link_b").cast("long").alias("b"), F.col("p.link_n").alias("n"))
    rare = rare.join(scored, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).cast("long").alias("rare_best"),
        F.sum(F.col("n") * F.col("count")).cast("long").alias("rare_total"))
    out = found.drop("link_a", "link_b", "link_n").join(rare, "row", "left")
    return out.select(*kept, (F.col("best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
                      (F.col("total") + F.coalesce("rare_total", F.lit(0))).alias("count_sum"))


def align_corpus(df: DataFrame, tokenizer: str, pattern: str, model: bytes, **columns) -> DataFrame:
    """:func:`align` and :func:`score_links` over all rows; of ``groups`` the SHA-256 (groups_sha256; '' without tokens)
    is kept, which is a fraction of their size."""
    with arrow_rows(df.sparkSession, 500):
        rows = align(df, tokenizer, pattern, model, **columns)
        digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
        rows = rows.withColumn("groups_sha256", digest).drop("groups")
        return score_links(materialise(rows, "aligned"))
