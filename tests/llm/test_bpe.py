import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import bpe, token_counts
from nearfield.llm import textarrays as ta

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read())


def check(own, reference, texts):
    for text, (ids, back) in zip(texts, own.rows(*ta.buffers(pa.array(texts, pa.string()))), strict=True):
        assert list(ids) == reference.encode_ordinary(text or ""), repr(text)
        assert back.tobytes() == (text or "").encode()


def test_against_the_library(own, reference):
    r = random.Random(1)
    alphabet = list("  \n\t\r'srtvmdle aAbB19.!?é中 　²½ß'’\u0085")
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(map(chr, range(a, a + 256))) for a in range(0, 0xD700, 256)]
    texts += [None, "", " ", "'s's'll've", "x'S don't", "a" * 40_000, " " * 9000, "<|endoftext|>", "\n\n a  b\t\tc "]
    check(own, reference, texts)


def test_merging_of_any_bytes(own, reference):
    r = random.Random(4)
    slices = [bytes(r.choices(b"aaabeinrst \xc3\xa9\xff\x00", k=r.randint(1, 60))) for _ in range(3000)]
    slices += [b"a" * 20_001, b"ab" * 5000, bytes(r.choices(range(97, 123), k=30_000)), bytes(r.choices(range(256), k=9000))]
    for piece in slices:
        assert bpe.merged(piece, own.ranks) == reference._core_bpe.encode_single_piece(piece), piece[:80]


def test_another_pattern_is_refused(spark, monkeypatch):
    monkeypatch.setattr(public_tokenizers, "PATTERN", r"\S+")
    with pytest.raises(ValueError):
        bpe.encode_digests(spark.createDataFrame([(1, "x")], "doc_id long, text string"), PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_any_text(own, reference, texts):
    check(own, reference, texts)


def test_a_wrong_cache_entry_is_noticed(own, reference):
    own.clear()
    check(own, reference, ["one two three"])
    own.pool[0] += 1
    check(own, reference, ["one two three", "one", ""])


def test_cache_starts_anew_when_full(reference):
    with open(PATH, "rb") as f:
        small = bpe.Codec(f.read())
    small.KEPT = 10
    r = random.Random(2)
    for _ in range(30):
        check(small, reference, [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(50))])
    assert len(small.slots) <= 60


def test_frames(spark, reference):
    texts = ["Hello there, world", None, "", "Ünï 中文 1234", "Hello there, world"]
    rows = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, PATH).collect()}
    want = set()
    for key, text, *_ in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        want.add((key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    encoded = bpe.encode(docs, PATH)
    back = bpe.decode(encoded, PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in texts)
    assert all(list(r.ends) == sorted(r.ends) and (not r.ends or r.ends[-1] == len(r.text.encode())) for r in back)
    assert bpe.encode_digests(docs.limit(0), PATH).collect() == []


def test_token_histogram(spark, reference):
    r = random.Random(3)
    texts = [" ".join("word" for _ in range(r.choice([0, 1, 1, 1, 5, 1500, 2100]))) for _ in range(60)] + [None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bars = token_counts.token_histogram(docs, PATH)
    sizes = [len(reference.encode_ordinary(t or "")) for t in texts]
    got = {x.n_tokens: x for x in bars.collect()}
    assert set(got) == set(sizes)
    for n, x in got.items():
        assert (x.docs, x.tokens) == (sizes.count(n), n * sizes.count(n))
        assert x.docs_at_least == sum(s >= n for s in sizes)
        assert x.tokens_at_least == sum(s for s in sizes if s >= n)
        assert x.tokens_if_cut_here == sum(min(s, n) for s in sizes)
        assert x.below_share == pytest.approx(sum(s < n for s in sizes) / len(sizes))
    limits = token_counts.at_limits(bars, [1, 3, 1000, 10_000]).collect()
    for x in limits:
        assert x.docs_at_least == sum(s >= x.context_limit for s in sizes)
        assert x.tokens_if_cut == sum(min(s, x.context_limit) for s in sizes)
    assert token_counts.quantile(bars, 0.5).first()[0] == max(n for n in set(sizes) if sum(s < n for s in sizes) / len(sizes) <= 0.5)
    assert token_counts.token_histogram(docs.limit(0), PATH).collect() == []
