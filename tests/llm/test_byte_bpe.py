"""Byte-level BPE: against the tiktoken library and a merge list, and round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import time
from array import array

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import Encoder, byte_bpe, decoded, ranks_of
from tidemark.llm.queries import op13_byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def lines():
    with open(VOCABULARY, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def encoder(lines):
    return Encoder(lines, PATTERN)


@pytest.fixture(scope="module")
def library(lines):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(lines), special_tokens={})


def plain(ranks, piece):
    """Merge the leftmost pair of least rank until none is left."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges_against_a_plain_list():
    rng = random.Random(2)
    for _ in range(30):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(60):
            new = rng.choice(tokens[97:103] + tokens[256:]) + rng.choice(tokens[97:103] + tokens[256:])
            tokens += [new] if new not in tokens else []
        own = Encoder(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)), PATTERN)
        for _ in range(40):
            piece = bytes(rng.choice(b"abcdef") for _ in range(rng.randrange(1, 40)))
            assert own.merged(piece) == plain(own.ranks, piece)
        pieces = [bytes(rng.choice(b"abcdef") for _ in range(rng.randrange(2, 33))) for _ in range(60)]
        assert [array("I", ids).tolist() for ids in own.merged_rows(pieces, 32)] == [plain(own.ranks, p) for p in pieces]
    with pytest.raises(ValueError, match="single byte"):
        Encoder(base64.b64encode(b"ab") + b" 0", PATTERN)


def test_texts_against_the_library(encoder, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cdeéÜ漢字🙂 \n\t'stll12$<|>\x1c\x85 ") for _ in range(rng.randrange(300))) for _ in range(300)]
    texts += [chr(c) + "a " + chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for text in [*texts, "<|endoftext|>", " " * 5_000, "ab" * 5_000 + "x" * 9_999]:
        packed = encoder.encode(text)
        assert array("I", packed).tolist() == library.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()


def test_one_long_piece_is_not_quadratic(encoder):
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(200_000))
    start = time.time()
    assert encoder.decode(encoder.encode(text)) == text.encode() and time.time() - start < 60


def test_full_cache_gives_the_same_ids(lines, library, monkeypatch):
    from tidemark.llm import byte_bpe as module

    monkeypatch.setattr(module, "_CACHED", 5)
    own = Encoder(lines, PATTERN)
    text = " ".join(random.Random(8).choice(["one", "zwei", "trois", "cuatro", "fem", "zzyzx", "qwrtp", "brrm"]) for _ in range(500))
    assert array("I", own.encode(text)).tolist() == library.encode_ordinary(text)


def test_odd_rows(spark, odd_documents, library):
    docs = odd_documents.withColumns({c: F.lit(1) for c in ("token_ids", "decoded", "coded")})
    rows = byte_bpe(docs, VOCABULARY, PATTERN).collect()
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_documents.collect())
    found = sorted((r["doc_id"] or -1, bytes(r["decoded"]).decode()) for r in rows)
    assert found == texts
    for r in rows:
        assert array("I", bytes(r["token_ids"])).tolist() == library.encode_ordinary(bytes(r["decoded"]).decode())
    assert byte_bpe(docs.limit(0), VOCABULARY, PATTERN).count() == 0
    back = byte_bpe(odd_documents, VOCABULARY, PATTERN).select(decoded(F.col("token_ids"), VOCABULARY, PATTERN).alias("t"))
    assert sorted(r["t"] for r in back.collect()) == sorted(t for _, t in texts)


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op13_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
