"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from inkstone.llm import (alignment, bpe, cap_filters, chat_tree, exact_dedup, jaccard_join, line_dedup, mixing, quality, sharding,
                          token_files, warc, whitening)
from inkstone.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return put


@query("op1_exact_dedup", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, length(text) AS n_chars,
             sha256(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM t),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op1_exact_dedup(spark, sf_dir):
    """Two loads into a new digest index: the second is deduplicated against the first."""
    docs = load(spark, sf_dir, "documents")
    out = exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark), loads=2)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_virtual_slots")
def op9_virtual_slots(spark, sf_dir):
    """All documents into 40 shards of nearly equal bytes through 8192 virtual slots."""
    out = sharding.assign(load(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    """Encode and decode every document with the sentencepiece model made from the rank file."""
    model = bpe.build_model(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    docs = load(spark, sf_dir, "documents")
    ids = docs.select("doc_id", bpe.encoder(model, public_tokenizers.PATTERN)("text").alias("ids"))
    out = ids.select("doc_id", "ids", bpe.decoder(model)("ids").alias("decoded"))
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    """Write the ids of all documents to dictionary-compressed files and read them back."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = token_files.write(load(spark, sf_dir, "documents"), tokenizer, 2)
    out = token_files.read(spark, path)
    return out.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                      F.crc32("ids").cast("long").alias("ids_crc32"))


@query("op5_divergence")
def op5_divergence(spark, sf_dir):
    """Counts and verdict for every document; the references are those of the whole table."""
    out = quality.quality_rules(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "quality.*")


@query("op10_line_chunks", f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, line, i, n, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words,
             CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, lead(line) OVER w AS next_line
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT line, next_line, count(*) > 1 AS pair FROM h WHERE next_line IS NOT NULL GROUP BY line, next_line),
g AS (SELECT h.*, coalesce(q.pair, FALSE) AS pair FROM h LEFT JOIN q ON q.line = h.line AND q.next_line = h.next_line),
r AS (SELECT *, (h + {line_dedup.HASH_BASE} * coalesce(lag(h) OVER w, 0)) % {line_dedup.CHUNK_LINES} = 0 AS rolls,
             coalesce(lead(words) OVER w, 0) AS next_words, coalesce(lag(pair) OVER w, FALSE) AS pair_before,
             coalesce(lag(pair, 2) OVER w, FALSE) AS pair_before_that, coalesce(lead(pair) OVER w, FALSE) AS pair_after
      FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, (NOT pair OR words >= {line_dedup.LONG_LINE} OR next_words >= {line_dedup.LONG_LINE}
                 OR (pair_before AND pair_after AND rolls
                     AND NOT (pair_before_that AND lag(rolls) OVER w))) AS is_end
      FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(is_end AS INT)) OVER (PARTITION BY doc_id ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
k AS (SELECT doc_id, chunk, count(*) AS n_lines, sum(words) AS n_words,
             string_agg(line, chr(10) ORDER BY i) AS bytes FROM c GROUP BY doc_id, chunk),
d AS (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, chunk) AS place FROM k
      WHERE (n_lines >= {line_dedup.MIN_LINES} AND n_words >= {line_dedup.MIN_WORDS}) OR n_words >= {line_dedup.LONG_LINE}),
x AS (SELECT doc_id, chunk, n_lines FROM d WHERE place > 1),
t AS (SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.i) AS text
      FROM c LEFT JOIN x USING (doc_id, chunk) WHERE x.doc_id IS NULL GROUP BY c.doc_id),
s AS (SELECT doc_id, count(*) AS removed_chunks, sum(n_lines) AS removed_lines FROM x GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       CAST(coalesce(removed_chunks, 0) AS BIGINT) AS removed_chunks,
       CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines
FROM documents o LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)""")
def op10_line_chunks(spark, sf_dir):
    """Every document without the line chunks that an earlier document holds."""
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "row.text", "removed_chunks", "removed_lines")


_SHINGLES = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
               THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id
      GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT id AS doc_id, min(seen) AS component_id FROM r GROUP BY id) c USING (doc_id)"""


@query("op8_jaccard_components", _SHINGLES)
def op8_jaccard_components(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.jaccard_components(load(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query("op7_seekable_warc")
def op7_seekable_warc(spark, sf_dir):
    """Write all pages to seekable bundles and read every record back; digest and size of a response
    are those of the payload that was read."""
    out = warc.read(spark, warc.write(load(spark, sf_dir, "pages")))
    return out.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
                      F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", "refers_to")


# FIXED VALUES: the extra conversation of the formatting query
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@query("op6_chat_tree")
def op6_chat_tree(spark, sf_dir):
    """All conversations and conversation -7 into the prefix tree, read back turn by turn."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_tree.digests(chat_tree.read_turns(spark, chat_tree.write(rows)))


# shares of the words that the mix shall have, by label
MIX_WEIGHTS = {"q1t0": 0.90, "q1t1": 0.02, "q0t0": 0.07, "q0t1": 0.01}


@query("op4_soft_mixing")
def op4_soft_mixing(spark, sf_dir):
    """Rate and copies of every document for a mix of as many words as the corpus has."""
    out = mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), MIX_WEIGHTS)
    return out.select("row.doc_id", "words", "domain", "posterior", "rate", "copies")


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    """Groups and links of every document between a byte-level and a sentencepiece tokenizer."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    out = alignment.align_corpus(load(spark, sf_dir, "documents"), tokenizer, public_tokenizers.PATTERN, model)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_cap_filters", """
WITH RECURSIVE n AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v,
                  sqrt(list_sum(list_transform(embedding, lambda c: CAST(c AS DOUBLE) * CAST(c AS DOUBLE)))) AS size FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM n WHERE size > 0 AND isfinite(size)),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
      WHERE list_inner_product(x.v, y.v) >= 0.98 * x.size * y.size),
r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT id AS vec_id, min(seen) AS component_id FROM r GROUP BY id),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)""")
def op12_cap_filters(spark, sf_dir):
    """Links and components of all vectors with a cosine of 0.98 or more to another of their label."""
    return cap_filters.near_duplicates(load(spark, sf_dir, "embeddings"), 0.98)


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    """Every usable vector on the 32 leading components of all of them."""
    return whitening.whitened_rows(load(spark, sf_dir, "embeddings"), 32)
