"""Counts against the libraries, and what the cache holds and saves."""

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import counts, queries

PATH = public_tokenizers.path(queries.PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string"


def expected(doc_id, text):
    n = len(LIBRARY.encode(text or ""))
    return doc_id, len((text or "").encode()), n, n > 4096


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_query(spark, documents):
    rows = [expected(r.doc_id, r.text) for r in documents.collect()]
    assert found(queries.op12_token_counts(spark, SF)) == sorted(rows, key=str)


ODD = ["", " ", "▁", " a", "▁a", "a▁b", "a b", "<s> x </s>", "<unk>", "a\0b", "\n\t x", "é" * 5000, "x " * 60_000, "🙂‍"]


def test_odd_texts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ""), (0, None), (None, None), (None, "a b"), (3, " a")]
    frame = spark.createDataFrame(rows, SCHEMA)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert found(queries.counted(frame, cache)) == sorted((expected(*r) for r in rows), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ▁\n<s>é", max_size=30))
def test_normalising_keeps_the_count(text):
    assert len(LIBRARY.encode(text)) == len(LIBRARY.encode(text.replace(counts.SPACE_MARK, " ")))


@pytest.mark.parametrize("few", [counts.FEW, 0])
def test_only_misses_are_encoded(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(counts, "FEW", few)
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], SCHEMA)
    queries.counted(first, cache).collect()
    assert spark.read.parquet(cache).count() == 5
    # A wrong stored count shows what is looked up and what is encoded.
    tokenizer = counts.Tokenizer(PATH)
    content = F.unhex(F.sha2(F.lit("known"), 256)).alias("content")
    planted = spark.range(1).select(content, F.lit(99).cast("long").alias("n_tokens"), F.lit(tokenizer.version).alias("tokenizer"))
    planted.write.partitionBy("tokenizer").mode("append").parquet(cache)
    other = planted.select(content, F.lit(77).cast("long").alias("n_tokens"), F.lit("another version").alias("tokenizer"))
    other.write.partitionBy("tokenizer").mode("append").parquet(cache)
    second = spark.createDataFrame([(1, "known"), (2, "text 1"), (3, "new"), (4, "new")], SCHEMA)
    rows = {r.doc_id: r.n_tokens for r in queries.counted(second, cache).collect()}
    assert rows == {1: 99, **{i: expected(i, t)[2] for i, t in ((2, "text 1"), (3, "new"), (4, "new"))}}
    assert spark.read.parquet(cache).where(F.col("tokenizer") == tokenizer.version).count() == 7


def test_repeated_entries_count_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    frame = spark.createDataFrame([(1, "a"), (2, "b c")], SCHEMA)
    queries.counted(frame, cache).collect()
    stored = spark.read.parquet(cache)
    twice = spark.createDataFrame(stored.collect(), stored.schema)
    twice.write.partitionBy("tokenizer").mode("append").parquet(cache)
    assert found(queries.counted(frame, cache)) == sorted((expected(1, "a"), expected(2, "b c")), key=str)


def test_other_columns_and_empty_table(spark, tmp_path):
    cache = str(tmp_path / "cache")
    frame = spark.createDataFrame([("x", "a b", 3)], "CONTENT string, text string, N_TOKENS int")
    tokenizer = counts.Tokenizer(PATH)
    rows = counts.token_counts(frame, tokenizer, cache)
    assert [r.asDict() for r in rows.collect()] == [{"CONTENT": "x", "text": "a b", "n_tokens": 2}]
    assert counts.token_counts(frame.limit(0), tokenizer, str(tmp_path / "other")).count() == 0
    assert not (tmp_path / "other").exists()


def test_tokenizers_library(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["Two words", "<|endoftext|> x", "<|ENDOFTEXT|> x", "", "▁a", " a"]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = counts.token_counts(frame, counts.Tokenizer(path), str(tmp_path / "cache")).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {
        i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)
    }
