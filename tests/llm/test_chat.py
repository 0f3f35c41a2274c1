"""Formatted conversations read back, and typed parts."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        conversations[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    result = {}
    for conv_id, turns in conversations.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        result[conv_id] = (len(turns), digest(whole), len(loss), digest(loss))
    return result


def as_found(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()]
    assert as_found(queries.op10_chat(spark, SF)) == expected(rows + queries.SPIKED)


def test_odd_texts(spark):
    texts = [None, "", "\\", "\\\\<|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "</s>[INST] <<SYS>>\\n$1", "é😀\n\n", "x" * 100_000]
    texts += ["<", "|", "<|", "<\\|", "\\<|", "[/INST", "\\E.*", "<|image|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(None, None, None, "a"), (None, None, "assistant", None), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")]
    rows += [(3, 0, "us<|im_sep|>er\n", "q"), (3, 1, "assistant", "")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("PARTS", F.lit("x")).withColumn("Formatted", F.lit(1))
    assert as_found(queries.chat_digests(frame)) == expected(rows)
    assert queries.chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_lie_in_the_string(spark):
    rows = [(1, 0, "user", "hi\\"), (1, 1, "assistant", "é</s>"), (1, 2, "user", "more"), (1, 3, "assistant", "end")]
    turns = spark.createDataFrame(rows, SCHEMA).select("conv_id", "turn", "role", chat.text_parts().alias("parts"))
    row = chat.formatted(turns).first()
    assert [row.formatted[m.start : m.start + m.length] for m in row.loss_mask] == ["é<\\/s>", "end"]
    assert "</s>" not in row.formatted


def test_typed_parts(spark):
    parts = [
        ("text", "see ", None, None, None, None, None),
        ("image", None, "a.png", 28, 15, None, None),
        ("text", "<|audio|>", None, None, None, None, None),
        ("audio", None, "b.wav", None, None, 1.5, None),
        ("document", None, "c.pdf", None, None, None, 3),
        ("image", None, None, None, None, None, None),
        None,
    ]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.formatted(turns).first()
    assert row.formatted == (
        "<|im_start|>user<|im_sep|>see <|image|><\\|audio|><|audio|><|document|><|image|><|im_end|>"
        "<|im_start|>assistant<|im_sep|><|im_end|>"
    )
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, 0, "image", "a.png", 4), (0, 1, "audio", "b.wav", 38), (0, 2, "document", "c.pdf", 1536), (0, 3, "image", None, 1)
    ]
    assert row.expanded_tokens == 1579
