"""Ids against the tiktoken library, exact round trips, appends and edits."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import bpe, queries

PATH = public_tokenizers.path(queries.VOCABULARY)
ENCODER = bpe.Encoder(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.vocabulary.ranks, special_tokens={}
)


def digests(text):
    ids = LIBRARY.encode_ordinary(text or "")
    data = (text or "").encode()
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()


def test_query(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op3_byte_bpe(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: digests(t) for i, t in texts.items()}
    assert len(rows) == len(texts)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000, "ab" * 9_000, "é" * 9_000, "<|endoftext|>", "\x1c\x85 ᠎ "])
def test_long_and_odd_texts(text):
    assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 10)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 30)
    encoder = bpe.Encoder(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN)
    texts = [f"word{i} again {i % 3}" for i in range(200)] + ["", "x"]
    ids, counts = map(np.concatenate, zip(*encoder.encode_all(texts)))
    assert [t.tolist() for t in np.split(ids, np.cumsum(counts)[:-1])] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert len(encoder.place) < 100


def test_forgotten_pairs_are_judged_again(monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 50)
    encoder = bpe.Encoder(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN)
    random.seed(3)
    for _ in range(30):
        text = " ".join("".join(random.choice("abcdeé") for _ in range(random.randint(1, 70))) for _ in range(20))
        assert encoder.encode(text) == LIBRARY.encode_ordinary(text)


def test_step_by_step_and_in_step_agree():
    """Strings filled together have the ids of each alone, whatever their lengths."""
    random.seed(7)
    strings = [bytes(random.choice(b"etaoin shrdl\xc3\xa9") for _ in range(random.randint(1, 64))) for _ in range(500)]
    ids, counts = bpe.Lockstep(ENCODER.vocabulary).encode(strings)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [bpe.Prefixes(ENCODER.vocabulary, s).tokens() for s in strings]


def test_appends_and_edits():
    random.seed(6)
    draw = lambda n: bytes(random.choice(b"abcdeth ing") for _ in range(random.randint(0, n)))
    for _ in range(300):
        data, more, new = draw(200), draw(20), draw(6)
        state = bpe.Prefixes(ENCODER.vocabulary, data)
        state.append(more)
        data += more
        assert state.last == bpe.Prefixes(ENCODER.vocabulary, data).last
        start = random.randint(0, len(data))
        stop = random.randint(start, len(data))
        state.edit(start, stop, new)
        again = bpe.Prefixes(ENCODER.vocabulary, data[:start] + new + data[stop:])
        assert (state.data, state.last, state.tokens()) == (again.data, again.last, again.tokens())
    state = bpe.Prefixes(ENCODER.vocabulary, b"the thing is in the thing " * 400)
    assert state.edit(100, 101, b"q") < 500


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "héllo"), (4, "x y " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("TOKENS", F.lit(1))
    found = queries.token_digests(docs).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(((i, *digests(t)) for i, t in rows), key=str)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "tokens"]
    assert queries.token_digests(docs.limit(0)).count() == 0
    apart = bpe.decode(encoded, PATH, keep=["doc_id"])
    both = bpe.recoded(docs, PATH, public_tokenizers.PATTERN, keep=["doc_id"])
    assert Counter(map(str, both.drop("tokens").collect())) == Counter(map(str, apart.collect()))


def test_ids_outside_the_vocabulary(spark):
    ids = spark.createDataFrame([([1, 2],), (None,), ([],)], "tokens array<int>")
    assert sorted(len(r.decoded) for r in bpe.decode(ids, PATH, keep=[]).collect())[:2] == [0, 0]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([10_000_000],)], "tokens array<int>"), PATH).collect()
