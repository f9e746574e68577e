"""Operator 11 against brute force: the libraries on whole texts, set intersection and counting."""
import hashlib
import json
import random
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from inkstone.llm import alignment as al

with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    TOKENIZER = f.read()
with open(P.path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_str(TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def brute(libraries, rows):
    """Expected rows by id position from whole-text encodings."""
    a_lib, b_lib = libraries
    alphabet = al.byte_alphabet()
    pieces_a = {i: bytes(alphabet.get(c, 63) for c in t) for t, i in a_lib.get_vocab().items()}
    out, counts = [], Counter()
    for doc_id, text in rows:
        if not text:
            out.append((doc_id, [], [], [], Counter()))
            continue
        a = a_lib.encode(" " + text, add_special_tokens=False).ids
        b = b_lib.encode(text)
        bytes_a = [pieces_a[i] for i in a]
        bytes_b = [bytes([int(t[3:5], 16)]) if b_lib.is_byte(i) else t.replace("▁", " ").encode()
                   for i, t in ((i, b_lib.id_to_piece(i)) for i in b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((doc_id, [], [], [], Counter()))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (bytes_a, bytes_b))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links, i, j = Counter(), 0, 0
        while i < len(a) and j < len(b):
            links[a[i], b[j]] += 1
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        counts.update(links)
        out.append((doc_id, a, b, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    result = []
    for doc_id, a, b, groups, links in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        result.append((doc_id, len(a), len(b), len(groups), sum(links.values()),
                       sum(n for p, n in links.items() if counts[p] == best[p[1]]), sum(n * counts[p] for p, n in links.items()),
                       hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return result


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def run(df, **kw):
    return sorted((tuple(r[c] for c in COLUMNS) for r in al.align_corpus(df, TOKENIZER, P.PATTERN, MODEL, **kw).collect()),
                  key=repr)


TEXTS = [None, "", " ", "   ", "\n", "a", "Hello world, it's fine.", " leading and trailing  ", "tabs\tand\r\nlines\n\n  indented",
         "has ▁ in it", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café 東京都 ☃ \U0001f600\U0001f469‍\U0001f467",
         "x" * 5000, "ab" * 3000 + " " * 700 + "é" * 900, "0123456789 " * 300, "the the the the", "\x00\x01 nul",
         "don't we'll 1st 2nd  3rd   4th", "Hello world, it's fine.", "é    　x"]


def test_matches_brute_force_with_clashing_columns(spark, docs, libraries):
    rng = random.Random(3)
    chars = [c for c in map(chr, range(0x20, 0x3000)) if unicodedata.category(c) not in ("Cs", "Cn")]
    texts = TEXTS + ["".join(rng.choice(chars + [" "] * 900) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "the the the the"), (None, "no id"), (None, None)]
    want = sorted(brute(libraries, rows), key=repr)
    assert run(docs(rows)) == want
    assert [r for r in want if r[1] == 0 and r[0] is not None and rows[r[0]][1]], "some texts are not reproduced"


def test_rare_pairs_take_the_join(spark, docs, libraries, monkeypatch):
    rows = list(enumerate(TEXTS))
    real = al.score_links
    for top in (0, 7):
        monkeypatch.setattr(al, "score_links", lambda t, top=top: real(t, top))
        assert run(docs(rows)) == sorted(brute(libraries, rows), key=repr)


def test_partial_counts_are_flushed(spark, docs, libraries, monkeypatch):
    rows = list(enumerate(TEXTS))
    aligned = al.align(docs(rows), TOKENIZER, P.PATTERN, MODEL)
    whole = sorted(map(tuple, al.count_links(aligned).collect()))
    monkeypatch.setattr(al, "PARTIAL_PAIRS", 5)
    assert sorted(map(tuple, al.count_links(aligned).collect())) == whole


def test_groups_are_whole_and_empty_table(spark, docs):
    first = al.align(docs([(1, "Hello world")]), TOKENIZER, P.PATTERN, MODEL).first()
    assert first["groups"].count(";") == first["n_groups"] - 1 and first["n_links"] == sum(first["link_n"])
    assert run(docs([])) == [] and run(docs([(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("seed", range(40))
def test_shared_cuts_are_the_intersection(seed):
    rng = np.random.default_rng(seed)
    ends, a, b, last = 0, [], [], []
    for _ in range(rng.integers(1, 6)):
        size = int(rng.integers(1, 400))
        for side in (a, b):
            inner = rng.choice(size, rng.integers(0, size), replace=False) if size > 1 else []
            side += sorted({ends + int(x) for x in inner if x} | {ends + size})
        ends += size
        last.append(len(a) - 1)
    cuts = al.shared_cuts(np.array(a), np.array(b), np.array(last))
    assert np.array(a)[cuts].tolist() == sorted(set(a) & set(b))


def test_ids_equal_the_library_for_every_assigned_code_point(libraries):
    """Side A by ranks gives what the file's own library gives; lengths tell which texts side B reproduces."""
    a, b = al.byte_level(TOKENIZER, P.PATTERN), al.piece_level(MODEL)
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    texts = [" " + "".join(f"a{c}b{c} {c}{c}1{c}\n{c} x  {c}" for c in chars[k:k + 64]) for k in range(0, len(chars), 64)]
    coded = [t.encode() for t in texts]
    (ids_a, same_a), (_, same_b) = a.ids(coded, texts), b.ids(coded, texts)
    whole = libraries[0].encode_batch(texts, add_special_tokens=False)
    assert [k for k, (x, y) in enumerate(zip(ids_a, whole)) if x.tolist() != y.ids] == [] and all(same_a)
    assert a.lossless and b.lossless
    a.lossless = b.lossless = False  # compare the bytes themselves
    assert a.ids(coded, texts)[1] == same_a and b.ids(coded, texts)[1] == same_b
    assert [t for t, ok in zip(texts, same_b) if not ok] == [t for t in texts if "\u2581" in t]


def test_other_byte_level_files_take_their_own_library(libraries):
    spec = json.loads(TOKENIZER)
    spec["model"]["ignore_merges"] = True
    side = al.byte_level(json.dumps(spec), P.PATTERN)
    texts = [" Hello wonderful world", " 1 2"]
    ids, same = side.ids([t.encode() for t in texts], texts)
    assert all(same) and [b"".join(side.pieces[i] for i in x) for x in ids] == [t.encode() for t in texts]
    spec["normalizer"] = {"type": "Lowercase"}
    with pytest.raises(ValueError, match="normaliser"):
        al.byte_level(json.dumps(spec), P.PATTERN)
