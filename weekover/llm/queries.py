"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekover.llm import (
    bpe,
    chat,
    codes,
    counts,
    embeddings,
    mixing,
    quality,
    sharding,
    simhash,
    toxicity,
    urls,
    warc,
    whitening,
)
from weekover.llm.common import lookup, read_table, written
from weekover.session import shared_folder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_archive(spark)
    warc.archive(read_table(spark, sf_dir, "pages"), path)
    return warc.restored(spark, path)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents")).drop("tokens")


def token_digests(docs: DataFrame) -> DataFrame:
    """Ids of each text, their count, and digests of them and of the bytes they decode to."""
    both = bpe.recoded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["doc_id"])
    return both.selectExpr(
        "doc_id",
        "CAST(size(tokens) AS bigint) AS n_tokens",
        "sha2(array_join(tokens, ','), 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
        "tokens",
    )


SHINGLE_WORDS, DISTANCE = 3, 3


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), SHINGLE_WORDS, DISTANCE)
    return rows.select("doc_id", "fingerprint", "component_id")


EPOCHS = 3.0


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(read_table(spark, sf_dir, "documents"), EPOCHS)
    return rows.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


N_SHARDS = 40


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards(read_table(spark, sf_dir, "documents"), N_SHARDS)
    return rows.selectExpr(
        "doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS int) AS grown_shard"
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learned_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).selectExpr(
        "doc_id", *(f"stats.{name}" for name in quality.COUNTS), "base_failed", "kept"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep=["doc_id"]).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        F.expr("CAST(score >= 0.5 AS int) AS predicted"),
    )


# Host, beginning of the path, and verdict of the rules that are applied.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


COSINE = 0.95


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), COSINE)


# A conversation whose texts hold control strings of other templates.
SPIKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(SPIKED, "conv_id long, turn long, role string, text string")
    return chat_digests(read_table(spark, sf_dir, "conversations").select(*own.columns).union(own))


def chat_digests(rows: DataFrame) -> DataFrame:
    """Digests of turns and trained texts, read back from the formatted conversations."""
    turns = rows.select("conv_id", "turn", "role", chat.text_parts().alias("parts"))
    return chat.read_back(chat.formatted(turns)).selectExpr(
        "conv_id",
        "CAST(size(turns) AS bigint) AS n_turns",
        "sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256) AS turns_sha256",
        "CAST(char_length(array_join(loss_texts, '')) AS bigint) AS loss_chars",
        "sha2(array_join(loss_texts, ''), 256) AS loss_sha256",
        "CAST(char_length(formatted) AS bigint) AS formatted_chars",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = whitening.whiten(vectors, whitening.fitted(vectors), keep=["vec_id"])
    return rows.select("*", F.posexplode("whitened").alias("place", "value")).selectExpr(
        "vec_id",
        "place + 1 AS component",
        "n",
        "TRY_CAST(deviation AS bigint) AS deviation",
        "value AS whitened",
        "explained[place] AS explained",
        "identity_error",
    )


PIECES, TOKEN_LIMIT = "piece_bpe_32k.model", 4096


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, shared_folder(spark, "token-counts"))


def counted(docs: DataFrame, cache: str) -> DataFrame:
    """Counts of the documents by way of a cache."""
    sized = docs.selectExpr("doc_id", "CAST(octet_length(coalesce(text, '')) AS bigint) AS n_bytes", "text")
    rows = counts.token_counts(sized, counts.Tokenizer(public_tokenizers.path(PIECES)), cache)
    return rows.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {TOKEN_LIMIT} AS over_limit")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def coded(vectors: DataFrame) -> DataFrame:
    """Codes in hex and errors, with the errors summed over equal labels."""
    books = codes.fitted(vectors)
    rows = codes.encoded(vectors, books, keep=["vec_id", "label"])
    # A struct, so that NULL labels meet too.
    rows = written(rows.withColumn("labelled", F.struct("label")), "vector-codes")
    sums = rows.groupBy("labelled").agg(F.sum("error").alias("label_error"))
    return lookup(rows, sums, ["labelled"]).select(
        "vec_id",
        F.expr("array_join(transform(code, i -> lower(lpad(hex(i), 2, '0'))), '')").alias("code"),
        "error",
        "label_error",
        F.lit(codes.digest(books)).alias("codebooks_sha256"),
    )


def _codes_oracle() -> str:
    """The rounds of the codebooks one after the other, by the distances of all entries."""
    parts, entries = codes.PARTS, codes.ENTRIES
    ctes = [
        f"""base AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
                len(embedding) // {parts} AS width
            FROM embeddings
            WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""cut AS MATERIALIZED (
            SELECT vec_id, part, v[part * width + 1 : part * width + width] AS p
            FROM base, (SELECT unnest(range({parts})) AS part)
        )""",
        f"""book0 AS (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c
            FROM cut WHERE vec_id IN (SELECT vec_id FROM base ORDER BY vec_id LIMIT {entries})
        )""",
    ]
    for k in range(codes.ROUNDS + 1):
        ctes.append(
            f"""near{k} AS MATERIALIZED (
            SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
                SELECT vec_id, cut.part, entry,
                    CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                FROM cut JOIN book{k} AS book ON book.part = cut.part
            ) GROUP BY ALL
        )"""
        )
        if k < codes.ROUNDS:
            ctes.append(
                f"""mean{k} AS (
            SELECT part, entry, list(m ORDER BY pos) AS c FROM (
                SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
                    SELECT cut.part, best.entry AS entry, unnest(p) AS x, unnest(range(len(p))) AS pos
                    FROM cut JOIN near{k} USING (vec_id, part)
                ) GROUP BY ALL
            ) GROUP BY ALL
        )"""
            )
            ctes.append(
                f"""book{k + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (part, entry)
        )"""
            )
    last = codes.ROUNDS
    ctes.append(
        f"""coded AS (
            SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
            FROM near{last} GROUP BY vec_id
        )"""
    )
    return f"""
        WITH {", ".join(ctes)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{last}) AS codebooks_sha256
        FROM coded JOIN base USING (vec_id)
    """


def _chat_oracle() -> str:
    own = ", ".join(f"({conv_id}, {turn}, '{role}', '{text}')" for conv_id, turn, role, text in SPIKED)

    def length(column: str) -> str:
        """Code points of a text once escaped: backslashes double, control strings gain one."""
        escaped = f"replace({column}, '\\', '\\\\')"
        for head in chat.CONTROL_HEADS:
            escaped = f"replace({escaped}, '{head}', '{head[0]}\\{head[1:]}')"
        return f"length({escaped})"

    marks = len(chat.START) + len(chat.MIDDLE) + len(chat.END)
    return f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {own})
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{chat.TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                FILTER (WHERE role = '{chat.TRAINED_ROLE}'), '')) AS loss_sha256,
            CAST(sum({marks} + {length("role")} + {length("text")}) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_urls": op8_urls,
    "op9_embeddings": op9_embeddings,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH sized AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), held AS (
            SELECT *, CASE WHEN octet_length(payload) >= 1000
                THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS holder FROM sized
        )
        SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
            CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < holder THEN holder END AS refers_to
        FROM held
    """,
    "op8_urls": """
        WITH rules(rule_host, rule_path, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), rests AS (
            SELECT DISTINCT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages WHERE url IS NOT NULL
        ), raws AS (
            SELECT url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests
        ), parts AS (
            SELECT url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
            FROM raws
        ), best AS (
            SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
                arg_max(verdict, length(rule_host || rule_path) * 1000 + length(rule_host)) AS verdict
            FROM parts JOIN rules
                ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY url
        )
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
        FROM pages LEFT JOIN parts USING (url) LEFT JOIN best USING (url)
    """,
    "op9_embeddings": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings
        ), links AS (
            SELECT a.vec_id AS one, b.vec_id AS other FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.vector, b.vector) >= 0.95
        ), reached(vec_id, other) AS (
            SELECT vec_id, vec_id FROM vectors
            UNION
            SELECT reached.vec_id, links.other FROM reached JOIN links ON links.one = reached.other
        ), lowest AS (
            SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
        )
        SELECT vec_id, (SELECT count(*) FROM links WHERE one = vec_id) AS n_links, component_id,
            vec_id = component_id AS kept
        FROM vectors JOIN lowest USING (vec_id)
    """,
    "op10_chat": _chat_oracle(),
    "op13_vector_codes": _codes_oracle(),
}
