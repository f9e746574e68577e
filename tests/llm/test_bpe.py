import base64
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
MODEL = bpe.build_model(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(RANKS)}, special_tokens={})
OWN = bpe.Encoder(MODEL, public_tokenizers.PATTERN)


def packed(text):
    ids = REFERENCE.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 's\n\tÉé漢字́\x1c\x85  09!?", max_size=60))
def test_encodes_as_tiktoken(text):
    assert OWN.encode([text]) == [packed(text)]


def test_every_code_point():
    texts = []
    for start in range(0, 0x30000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c} {c}{c}1 " for c in chars))
    assert OWN.encode(texts) == [packed(t) for t in texts]


def test_every_piece_of_the_vocabulary_is_one_id():
    got = OWN.model.encode([bpe.byte_mapped(p) for p in RANKS], out_type=int, num_threads=1)
    assert got == [[i] for i in range(len(RANKS))]


def test_cache_restarts_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    own = bpe.Encoder(MODEL, public_tokenizers.PATTERN)
    texts = [" ".join(f"w{i}x{j}" for i in range(30)) for j in range(20)]
    assert [own.encode([t])[0] for t in texts] == [packed(t) for t in texts]
    assert len(own.known) <= 200


def test_columns_and_round_trip(spark, docs):
    rows = [(1, "Hello wörld's 123\n\n  end"), (2, None), (3, ""), (4, "long " * 50_000), (5, "x" * 20_000), (1, "\x00￾🎉")]
    df = docs(rows)
    out = df.select("doc_id", "text", bpe.encoder(MODEL, public_tokenizers.PATTERN)("text").alias("ids"))
    for r in out.select("text", "ids", bpe.decoder(MODEL)("ids").alias("back")).collect():
        assert bytes(r.ids) == packed(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert docs([]).select(bpe.encoder(MODEL, public_tokenizers.PATTERN)("text")).count() == 0


def test_rank_file_order_does_not_matter(tmp_path):
    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)] + [base64.b64encode(b"ab") + b" 256"]
    (tmp_path / "v").write_bytes(b"\n".join(reversed(lines)) + b"\n")
    ranks = bpe.read_ranks(str(tmp_path / "v"))
    assert ranks[256] == b"ab" and ranks[65] == b"A"
    with pytest.raises(FileNotFoundError):
        bpe.read_ranks(str(tmp_path / "none"))
