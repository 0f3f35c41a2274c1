"""Token counts with a cache of digests.

A stored count is found by two digests: that of the content as the tokenizer normalises it,
and that of the tokenizer's version (its file, its library and the library's version). The
distinct contents of a table are looked up by digest alone; the texts of those that are
missing, one for each digest, are encoded and their counts appended to the cache, so a text
is encoded once however often and in however many tables it occurs. The cache is a Parquet
table with a folder per tokenizer version. Two jobs that append the same digest at a time
store the same count twice, which readers take as one.

What is normalised is what surely leaves the count as it is: a NULL text is an empty one,
and a piece model without a mapping of characters reads its space mark as a space.

Texts are counted whole, as the library encodes them, without begin, end or added special
tokens. Repeated rows are one content. An empty table gives an empty result and appends
nothing. Other columns pass through; one with the name of a result is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.llm.bpe import read_vocabulary
from weekover.llm.common import fresh, lookup, with_columns, written

# Digests are sent to every executor up to this many, 32 bytes each; more are joined by a shuffle.
FEW = 200_000
# Fixed value: how a piece model writes a space.
SPACE_MARK = "▁"
CACHE = "tokenizer string, content binary, n_tokens long"


@functools.lru_cache(maxsize=2)
def counter(content: bytes, kind: str) -> Callable[[str], int]:
    """The library's number of ids of a text."""
    if kind == ".model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda text: len(pieces.encode_as_numpy(text))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_buffer(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


class Tokenizer:
    """A tokenizer's file: ``.model`` for piece models, ``.json`` for the tokenizers library."""

    def __init__(self, path: str):
        self.kind = os.path.splitext(path)[1]
        if self.kind not in (".model", ".json"):
            raise ValueError(f"no tokenizer library for {path}")
        self.content = read_vocabulary(path)
        library = __import__("sentencepiece" if self.kind == ".model" else "tokenizers")
        marks = f"{library.__name__} {library.__version__}".encode()
        self.version = hashlib.sha256(marks + b"\0" + self.content).hexdigest()

    def normalised(self, text: F.Column) -> F.Column:
        whole = F.coalesce(text, F.lit(""))
        return F.replace(whole, F.lit(SPACE_MARK), F.lit(" ")) if self._spaces_alike() else whole

    def _spaces_alike(self) -> bool:
        if self.kind != ".model":
            return False
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(self.content).normalizer_spec
        return not spec.precompiled_charsmap and spec.escape_whitespaces and not spec.remove_extra_whitespaces


def known(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) that the cache holds for a tokenizer version, once for each content."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    except AnalysisException as error:
        # Nothing was appended yet.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "content binary, n_tokens long")
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _counted(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    sent, kind = texts.sparkSession.sparkContext.broadcast(tokenizer.content), tokenizer.kind

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        count = counter(sent.value, kind)
        return {"n_tokens": pa.array([count(text.as_py()) for text in batch.column(0)], pa.int64())}

    return with_columns(texts, make, ["text"], {"n_tokens": T.LongType()}, ["content"])


def token_counts(
    docs: DataFrame, tokenizer: Tokenizer, cache: str, text: str = "text", output: str = "n_tokens"
) -> DataFrame:
    """Adds the number of tokens of the whole text, by way of the cache in the folder ``cache``."""
    spark = docs.sparkSession
    value = tokenizer.normalised(F.col(f"`{text}`"))
    digest = F.unhex(F.sha2(value, 256)).alias("content")
    contents = docs.select(digest).distinct()
    missing = written(contents.join(known(spark, cache, tokenizer.version), "content", "left_anti"), "missing")
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(digest, value.alias("text"))
        few = n_missing <= FEW
        if few:
            texts = texts.join(F.broadcast(missing), "content", "left_semi")
        # Copies meet in the task that reads them, so a common text is shuffled once per task.
        texts = texts.groupBy("content").agg(F.first("text").alias("text"))
        if not few:
            texts = texts.join(missing, "content", "left_semi")
        counted = _counted(texts, tokenizer).withColumn("tokenizer", F.lit(tokenizer.version))
        counted.write.partitionBy("tokenizer").mode("append").parquet(cache)
    mark = fresh(docs, "content")
    counts = known(spark, cache, tokenizer.version).withColumnsRenamed({"content": mark, "n_tokens": output})
    rows = docs.drop(*(c for c in docs.columns if c.lower() == output.lower())) if output != text else docs
    return lookup(rows.withColumn(mark, digest), counts, [mark]).drop(mark)
