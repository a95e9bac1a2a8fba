import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelake.llm import packing
from tests.llm.tables import cases, documents, empty, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_json_vocabulary(tokenizer, text):
    assert packing.encode(text, RANKS).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \n\ta1.é'", max_size=120), st.integers(1, 9))
def test_stretches_dont_change_ids(text, limit):
    parts = list(packing.stretches(text, limit))
    assert "".join(parts) == text
    enc = packing.encoder(RANKS)
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_against_a_plain_one(lengths):
    bins = packing.best_fit(lengths, 50)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 50 for b in bins)
    plain = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(plain) if room >= n]
        if fitting:
            plain[min(fitting, key=lambda k: plain[k])] -= n
        else:
            plain.append(50 - n)
    assert len(plain) == len(bins)


def check(rows, docs, tokenizer, size):
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in docs]
    want = []
    for (doc_id, _), own in zip(docs, ids, strict=True):
        first = len(own) % size or size
        for piece, start in enumerate([0, *range(first, len(own), size)]):
            part = own[start : first if piece == 0 else start + size]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences), len(packing.best_fit([w[3] for w in want], size))


def test_about_as_few_sequences_as_in_one_task(spark, tokenizer):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["of", "the", "horizon", "zebra"]) for _ in range(rng.choice([3, 20, 90, 400])))) for k in range(400)]
    used, at_once = check(packing.pack(documents(spark, [(*r, None) for r in rows]), size=64).collect(), rows, tokenizer, 64)
    assert used <= at_once + 2


def test_underfull_bins_meet_across_tasks(spark, tokenizer):
    rows = [(k, prose(k, 5 + k % 11)) for k in range(60)]
    df = documents(spark, [(*r, None) for r in rows]).repartition(20)
    used, at_once = check(packing.pack(df, size=256).collect(), rows, tokenizer, 256)
    assert used <= at_once + 1


def test_cases(spark, tokenizer):
    docs = cases(spark)
    check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 1024)
    assert packing.pack(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def contract():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_added_tokens_are_one_id(contract):
    assert packing.encode("a <|endoftext|> b", RANKS).tolist() == [64, 220, 50256, 275, 2]
    assert contract.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "a", "é", "it's", "12", "."]), max_size=20),
    st.integers(1, 9),
)
def test_ids_with_added_tokens_in_any_stretch(contract, parts, limit):
    text = "".join(parts)
    want = contract.encode(text, add_special_tokens=False).ids
    assert packing.encode(text, RANKS).tolist() == [*want, 2]
    enc = packing.encoder(RANKS)
    assert [i for p in packing.stretches(text, limit) for i in enc.encode(p, allowed_special="all")] == want


def test_added_tokens_in_packed_documents(spark, contract):
    rows = [(1, "one<|endoftext|>two <|endoftext|>"), (2, "<|endoftext|>"), (3, prose(3))]
    check(packing.pack(documents(spark, [(*r, None) for r in rows])).collect(), rows, contract, 1024)
