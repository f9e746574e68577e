"""Operator 2: byte-level BPE encoding and decoding with a sentencepiece model.

A sentencepiece BPE model is serialised directly from a vocabulary of byte strings in
rank order: each piece is the byte string with byte b written as the code point
BYTE_BASE + b, its score is the negative rank, the normaliser is the identity without
dummy prefix, white-space removal or escaping.  The model's merge of the best-scored
neighbours is then the merge of the lowest rank.  Every match of the split pattern (a
pre-token) is encoded on its own; ids are decoded by the inverse byte mapping.

Encoding is one scan without a shuffle.  A worker keeps the ids of at most CACHE_WORDS
recent pre-tokens, which bounds its memory; a text is processed whole.

Defined results: null and empty texts give no ids; ids are little-endian unsigned 32-bit
integers in one binary value per row; any text round-trips byte for byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from inkstone.llm.common import text_runs

# FIXED VALUE: first code point of the byte mapping (letters without normal forms of their own here)
BYTE_BASE = 0x100
CACHE_WORDS = 250_000


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


def build_model(ranks: list[bytes]) -> bytes:
    """The serialised sentencepiece model; ids are ranks, the unknown piece comes last and is never used."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, piece in enumerate(ranks):
        model.pieces.add(piece=byte_mapped(piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=-float(len(ranks)), type=pb.ModelProto.SentencePiece.UNKNOWN)
    trainer, normal = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size, trainer.unk_id = pb.TrainerSpec.BPE, len(ranks) + 1, len(ranks)
    normal.name, normal.add_dummy_prefix = "identity", False
    normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


def byte_mapped(piece: bytes) -> str:
    return piece.decode("latin-1").translate({b: BYTE_BASE + b for b in range(256)})


class Encoder:
    """Pre-token splitter, model and bounded cache of one Python worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.shift = {b: BYTE_BASE + b for b in range(256)}
        self.known: dict[str, bytes] = {}

    def learn(self, words: set) -> None:
        """Encode pre-tokens that are not in the cache."""
        import numpy as np

        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        mapped = [w.encode().decode("latin-1").translate(self.shift) for w in new]
        for w, ids in zip(new, self.model.encode(mapped, out_type=int, num_threads=1)):
            self.known[w] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.split(t) for t in texts]
        missing = set().union(*words) - self.known.keys()
        if missing:
            if len(self.known) + len(missing) > CACHE_WORDS:  # learn() starts the cache anew
                missing = set().union(*words)
            self.learn(missing)
        known = self.known
        return [b"".join(map(known.__getitem__, w)) for w in words]


def encoder(model: bytes, pattern: str):
    """Column function text -> ids (binary)."""
    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(model, pattern)
        for batch in batches:
            out: list[bytes] = []
            for _, _, texts in text_runs(batch):
                out += own.encode([t.decode() for t in texts])
            yield pa.array(out, pa.binary())
    return encode


def decoder(model: bytes):
    """Column function ids (binary) -> bytes, by the inverse of the byte mapping."""
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {BYTE_BASE + b: b for b in range(256)}
        pieces = [sp.id_to_piece(i).translate(back).encode("latin-1") for i in range(sp.get_piece_size() - 1)]
        for batch in batches:
            yield pa.array([b"".join(map(pieces.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
                            for ids in batch.to_pylist()], pa.binary())
    return decode
