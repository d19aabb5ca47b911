import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.q_bpe import op5_bpe, vocabulary


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(vocabulary()), Tokenizer.from_file(vocabulary())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_fuzz_against_the_library(both):
    own, lib = both
    rng = random.Random(1)
    alphabet = "ab cdE'st 're\n\t 　é中文\U0001f642123٣\x85\x1c​́ª²ⅷaaaa"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts = [t[:5] + "<|endoftext|>" + t[5:] if k % 7 == 0 else t for k, t in enumerate(texts)]
    texts += ["<|endoftext|><|endoftext|>", "<|endoftext", "a" * 70, "x" * 3000, "ab" * 999, "a" * 64, "a" * 65, ""]
    got = own.encode_many(texts)
    for t, packed, want in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(packed) == want.ids, t
        assert own.decode(packed) == lib.decode(want.ids, skip_special_tokens=False) == t


def test_scalar_and_batched_trees_agree(both):
    own, _ = both
    rng = random.Random(2)
    words = ["".join(rng.choice("thean ing") for _ in range(rng.randint(1, 64))) for _ in range(300)]
    made = own._merged(words)
    for w in words:
        assert ids(made[w]) == bpe.merge_piece(own.byte_ids[np.frombuffer(w.encode(), np.uint8)].tolist(), own.merges)


def test_any_ids_decode_as_in_the_library(both):
    own, lib = both
    rng = random.Random(3)
    for _ in range(300):
        some = [rng.randrange(50257) for _ in range(8)]
        assert own.decode(np.array(some, "<u4").tobytes()) == lib.decode(some, skip_special_tokens=False)
    assert own.decode(np.array([4_000_000_000], "<u4").tobytes()) == ""


def test_nulls_repeats_and_clashing_columns(spark, both):
    rows = [(1, None, "x"), (1, None, "x"), (None, "café \n", None), (3, "", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.encode_decode(d, vocabulary()).collect()
    assert sorted((r.text or "", r.decoded, r.n_tokens) for r in out) == [("", "", 0)] * 3 + [("café \n", "café \n", len(both[1].encode("café \n").ids))]
    assert bpe.encode_decode(d.where("false"), vocabulary()).count() == 0
    apart = bpe.decode(bpe.encode(d, vocabulary()), vocabulary(), text="back").collect()
    assert all((r.text or "") == r.back for r in apart)


def test_query(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: both[1].encode(r.text or "", add_special_tokens=False).ids for r in docs}
    text = {r.doc_id: r.text or "" for r in docs}
    for r in op5_bpe(spark, "/root/testdata/sf0.001").collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
