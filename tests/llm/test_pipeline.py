"""The pipeline against brute force on its own stages' inputs."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_bpe import digests
from tests.llm.test_mixing import slow_targets
from tests.llm.test_quality import base_failed, slow_counts
from tests.llm.test_simhash import slow_components, slow_fingerprint
from weekover.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, documents):
    found, docs = {"documents": documents}, documents
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        found[name] = docs
    return {name: frame.collect() for name, frame in found.items()}


def test_columns_stay(stages, documents):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name] and list(stages[name][0].asDict()) == documents.columns


def test_quality_and_toxicity(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = stages["documents"]
    kept = {r.doc_id for r in stages["quality_rules"]}
    assert not any(base_failed(slow_counts(r.text)) for r in stages["quality_rules"])
    clean = [r.doc_id for r in before if not base_failed(slow_counts(r.text)) and r.doc_id in labels and labels[r.doc_id].quality == 1]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    calm = {r.doc_id for r in stages["toxicity"]}
    judged = [(i in calm, labels[i].toxic) for i in kept if i in labels]
    assert all(stays for stays, toxic in judged if not toxic)


def test_few_toxic_documents_stay(spark, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    before, calm = ({r.doc_id for r in stages[name]} & toxic for name in ("quality_rules", "toxicity"))
    assert len(calm) <= 0.1 * len(before)


def test_one_of_each_group(stages):
    texts = {r.doc_id: r.text for r in stages["toxicity"]}
    ids = sorted(texts)
    components = slow_components(ids, [slow_fingerprint(texts[i]) for i in ids])
    assert sorted(r.doc_id for r in stages["simhash_dedup"]) == sorted(set(components))


def test_mix_and_tokens(stages):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in stages["simhash_dedup"]:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in stages["mixing"]:
        taken[r.source] += len(WORD.findall(r.text))
    for source, target in slow_targets(sizes).items():
        assert abs(taken[source] - target) <= 0.05 * target
    assert max(Counter(r.doc_id for r in stages["mixing"]).values()) <= 3
    expected = Counter((r.doc_id, *digests(r.text)) for r in stages["mixing"])
    assert Counter(tuple(r)[:4] for r in stages["byte_bpe"]) == expected
    assert all(len(r.tokens) == r.n_tokens for r in stages["byte_bpe"])


def test_run_gives_the_last_stage(spark, stages):
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, stages["byte_bpe"]))


def odd_documents():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    text = lambda k: " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] + str(k * j) for j in range(25))
    rows = [(1, None, "en", "web", 0), (2, "", "en", "web", 0), (3, " \n", None, None, None)]
    rows += [(10 + k, text(k), "en", ["web", "books", None][k % 3], 1) for k in range(12)]
    rows += [(40, text(3), "en", "web", 1), (41, text(3), "en", "web", 1), (13, text(3), "en", "web", 1)]
    rows += [(None, text(77), "de", None, 1), (50, " ".join(f"w{j}" for j in range(40_000)), "en", "books", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder), f"odd-{name}")
        yield name, before, docs


def test_odd_documents(spark, tmp_path):
    labels = [(10, 1, 0), (11, 0, 1), (12, None, None), (None, 1, 1), (10, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    docs = docs.selectExpr("*", "1 AS SCORE", "2 AS s", "3 AS Draw", "4 AS tokens", "5 AS component")
    kept = {}
    for name, before, after in run_stages(spark, docs, str(tmp_path)):
        kept[name] = after.collect()
        if name != "byte_bpe":
            assert after.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept["quality_rules"]}
    assert not {1, 2, 3} & set(texts) and {None, 50, 40, 41, 13} <= set(texts)
    assert [r.doc_id for r in kept["simhash_dedup"] if r.text == texts[40]] == [13]
    assert Counter(tuple(r)[:4] for r in kept["byte_bpe"]) == Counter((r.doc_id, *digests(r.text)) for r in kept["mixing"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, _, after in run_stages(spark, docs, str(tmp_path)):
        assert after.count() == 0
