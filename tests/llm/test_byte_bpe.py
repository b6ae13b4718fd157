"""Byte-level BPE against the tiktoken library."""

import hashlib
import pickle
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tallyscope.llm import byte_bpe, registry

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path(request.param))
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return model, byte_bpe.ChunkTable(byte_bpe.BytePairs(ranks), public_tokenizers.PATTERN)


def check(both, text):
    ids, decoded = both[1].encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == both[0].encode_ordinary(text)
    assert decoded == text.encode()


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.sampled_from([*"ab eE19\n\t.-'_ é—中́\x1c\x85\xa0　ह\U0001f600\x00", "the", "  ", " \n ", "'ll", "aaaa", "<|endoftext|>"]), max_size=40).map("".join))
def test_equals_the_library(both, text):
    check(both, text)


def test_any_text(both):
    rng = random.Random(5)
    for size in (1, 2, 3, 7, 50, 3000):
        check(both, "".join(chr(c) for c in (rng.randrange(1, 0x2FFFF) for _ in range(size)) if not 0xD800 <= c < 0xE000))


@pytest.mark.parametrize("unit", ["a", "ab", "0123456789", "-=", "é", "ſ"])
def test_long_words(both, unit):
    check(both, unit * 20_000)


def test_words_of_few_letters_have_many_merges(both):
    rng = random.Random(1)
    for alphabet in ("ab", "abcde", "eorst", "0012"):
        check(both, " ".join("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400)))


def test_merges_of_a_small_table():
    """Dead ends and repeated letters, against merging by rank step by step."""
    base = {bytes([b]): b for b in range(256)}
    extra = [b"aa", b"ab", b"aab", b"ba", b"bb", b"abab", b"bba", b"aaaa", b"cab", b"bab", b"xyz"]
    ranks = base | {token: 256 + i for i, token in enumerate(extra)}
    pairs = byte_bpe.BytePairs(ranks)
    assert "xyz" not in pairs.reached and pairs.encode(b"xyz") == [ranks[b"xyz"]]  # only as a whole word

    def merged(word):
        if word in ranks:
            return [ranks[word]]
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(2)
    for _ in range(20_000):
        word = bytes(rng.choices(b"aabbcxyz" if rng.random() < 0.2 else b"aab", k=rng.randrange(1, 14)))
        assert pairs.encode(word) == merged(word), word
    with pytest.raises(ValueError):
        byte_bpe.BytePairs({b"a": 0})


def test_full_tables_change_nothing(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_CHUNKS", 2)
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 3)
    small = byte_bpe.ChunkTable(pickle.loads(pickle.dumps(both[1].pairs)), public_tokenizers.PATTERN)
    text = "unbelievable antidisestablishment words, repeated unbelievable words; 12345 zzzyzx" * 3
    assert small.encode(text) == both[1].encode(text) and len(small) <= 2 and len(small.pairs.known) <= 3


def test_rows(spark, odd, none, both):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(FILES[0]))
    want = []
    for row in odd.collect():
        ids, decoded = both[1].encode(row.text or "")
        want.append((row.doc_id, np.frombuffer(ids, "<u4").tolist() == both[0].encode_ordinary(row.text or ""), hashlib.sha256(decoded).hexdigest()))
    assert all(same for _, same, _ in want)
    table = byte_bpe.ChunkTable(byte_bpe.BytePairs(ranks), public_tokenizers.PATTERN)
    rows = byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(((r.id, bytes(r.ids), bytes(r.decoded)) for r in rows), key=repr) == sorted(((r.doc_id, *table.encode(r.text or "")) for r in odd.collect()), key=repr)
    assert byte_bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_registered_query(spark, folder):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path(FILES[0]))
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = model.encode_ordinary(row.text or "")
        want.add((row.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in registry.queries()["op13_byte_bpe"](spark, folder).collect()} == want
