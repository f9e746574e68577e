import os
import struct

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkstone.llm import token_files as tf

os.environ["TOKENIZERS_PARALLELISM"] = "false"
with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
    JSON = f.read()
REFERENCE = Tokenizer.from_str(JSON)
OWN = tf.WordEncoder(JSON)
END = struct.pack("<I", 2)


def packed(text):
    ids = REFERENCE.encode(text or "", add_special_tokens=False).ids + [2]
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aBİıſ'sSt.,;:!? \n\tÉé漢字̸́\x1c\x85 ǅΣσ9", max_size=60)
       | st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "It's", "we'll,", "fin.", "...", "Été!", " ", "\n", "1,5"])).map("".join))
def test_words_encode_as_the_whole_text(text):
    assert OWN.encode([text.encode()], END) == [packed(text)]


def test_every_latin_letter():
    text = " ".join(chr(c) + "a" + chr(c) + "," for c in range(0xA1, 0x250))
    assert OWN.encode([text.encode()], END) == [packed(text)]


def test_generations_of_the_cache(monkeypatch):
    monkeypatch.setattr(tf, "CACHE_WORDS", 40)
    own = tf.WordEncoder(JSON)
    texts = [" ".join(f"W{chr(97 + i)}{chr(97 + j)}. common" for i in range(20)) for j in range(20)]
    assert [own.encode([t.encode()], END)[0] for t in texts] == [packed(t) for t in texts]
    assert len(own.known) + len(own.known.older) < 400


ROWS = [(5, "five five"), (1, None), (2, ""), (3, "Long text, " * 5000), (None, "no id"), (7, "x" * 5000), (5, "again five"), (-4, "minus")]


def check(spark, docs, rows):
    path = tf.write(docs(rows), JSON, 2)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in tf.read(spark, path).collect()]
    got.sort(key=lambda r: r[1])
    assert sorted(g[2] for g in got) == sorted(packed(t) for _, t in rows)
    assert [g[0] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids) // 4
    return path


def test_write_and_read(spark, docs):
    check(spark, docs, ROWS)
    path = check(spark, docs, [(i, f"Document {i} speaks of things, number {i * i}.") for i in range(700)])
    wanted = spark.createDataFrame([(17,), (400,), (9999,)], "doc_id long")
    some = {r.doc_id: bytes(r.ids) for r in tf.read(spark, path, wanted).collect()}
    assert some == {i: packed(f"Document {i} speaks of things, number {i * i}.") for i in (17, 400)}


def test_empty_table(spark, docs):
    assert tf.read(spark, tf.write(docs([]), JSON, 2)).count() == 0


def test_file_format(spark, docs):
    import hashlib

    import zstandard
    path = check(spark, docs, [(i, "some words " * (i % 7)) for i in range(300)])
    disk, folder = tf.store(path)
    dictionary = disk.open_input_file(f"{folder}/dictionary").read()
    index = {}
    for r in spark.read.schema(tf.INDEX).parquet(f"{path}/index").collect():
        index.setdefault(r.file, []).append((r.offset, r.bytes, r.n_tokens))
    for name, rows in index.items():
        data = disk.open_input_file(f"{folder}/data/{name}").read()
        assert data[:8] == tf.MAGIC == data[-8:] and data[8:40] == hashlib.sha256(dictionary).digest()
        n = struct.unpack("<Q", data[-16:-8])[0]
        assert n == len(rows)
        numbers = struct.unpack(f"<{2 * n}Q", data[-16 - 16 * n:-16])
        assert sorted(zip(numbers[:n], numbers[n:])) == sorted((o, t) for o, _, t in rows)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for offset, size, tokens in rows:
            assert len(unpack.decompress(data[offset:offset + size])) == 4 * tokens
