"""Statistics against plain Python, and learned lists on planted junk."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import quality, queries
from weekover.llm.common import lowest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


def base_failed(counts):
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def test_query(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op7_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = slow_counts(texts[r.doc_id])
        assert tuple(r[1:6]) == counts
        assert r.base_failed == base_failed(counts)
        assert not (r.base_failed and r.kept)
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r for r in rows if quality_of.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 12_000, "é#*\n\n \né#*\nb", "l\nl\nl\r\nl", "a b c d e f a b c d e g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("KEPT", F.lit("x"))
    rows = quality.judged(docs, []).orderBy("doc_id").collect()
    assert [tuple(r.stats[k] for k in quality.COUNTS) for r in rows] == [slow_counts(t) for t in texts]
    assert [r.kept for r in rows] == [not base_failed(slow_counts(t)) for t in texts]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.kept_documents(docs, spark.createDataFrame([(1, 0), (2, None)], "doc_id long, quality int")).count() == 0


def test_learns_conjunctions(spark):
    random.seed(2)
    docs, labels = [], []
    for i in range(900):
        kind = i % 4
        words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(3, 9))) for _ in range(40)]
        if kind == 1:
            words = [w.upper() + "!" for w in words]
        if kind == 2:
            words = [w + "%" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if kind in (1, 2) else 1))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality.learned_rules(docs, labels)
    assert 1 <= len(rules) <= 3
    judged = quality.judged(docs, rules).join(labels, "doc_id")
    assert judged.where("quality = 1 AND NOT kept").count() == 0
    assert judged.where("quality = 0 AND kept").count() <= 20


def test_a_pure_statistic_beats_a_common_blurred_one(spark):
    random.seed(5)
    docs, labels = [], []
    for i in range(900):
        junk = i % 3 == 0
        # Junk is longer in words, but so is much good text; only junk has capitals.
        size = random.randint(4, 9) if junk else random.choice([3, 3, 4, 8])
        words = ["".join(random.choice("abcdefgh") for _ in range(size)) for _ in range(30)]
        if junk:
            words[0] = words[0].upper()
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    judged = quality.judged(docs, quality.learned_rules(docs, labels)).join(labels, "doc_id")
    assert judged.where("kept <> (quality = 1)").count() == 0


def plain_cover(rows, bounds):
    """Covering with every rule judged by going through the rows."""
    sides = [(share, above, place) for share in quality.SHARES for place in range(len(bounds[share])) for above in (False, True)]
    fits = lambda r, rule: all((r.bins[s] > b) == above for s, above, b in rule)

    def telling(group):
        bad = sum(r.bad for r in group)
        found = {}
        for s, above, b in sides if bad else ():
            inside = [r for r in group if (r.bins[s] > b) == above]
            p = sum(r.bad for r in inside)
            gain = p * (math.log2(p / len(inside)) - math.log2(bad / len(group))) if p else 0.0
            if gain > found.get(s, (1e-9,))[0] + 1e-9:
                found[s] = (gain, (s, above, b), len(inside) - p)
        return sorted(found.values(), key=lambda f: -f[0])

    def choice(group, aside):
        free = [r for r in group if r.grow and not any(fits(r, a) for a in aside)]
        first = telling(free)[: quality.FIRST_CONDITIONS]
        grown, going = [(c,) for _, c, _ in first], [(c,) for _, c, good in first if good]
        for _ in range(quality.MOST_CONDITIONS - 1):
            further = []
            for rule in going:
                for _, c, good in telling([r for r in free if fits(r, rule)])[:1]:
                    grown.append((*(x for x in rule if x[:2] != c[:2]), c))
                    further += [grown[-1]] if good else []
            going = further
        judged = []
        for rule in dict.fromkeys(grown):
            inside = [r for r in group if fits(r, rule)]
            bad, held = sum(r.bad for r in inside), [r.bad for r in inside if not r.grow]
            able = sum(held) >= quality.LEAST_COVER and sum(held) >= quality.PRECISION * len(held)
            judged.append((able, (bad + 1) / (len(inside) + 2), bad, -len(rule), rule, len(inside) - bad))
        able = [j for j in judged if j[0]] or judged
        return max(able, key=lambda j: j[1:4]) if able else None

    outside = lambda rules: [r for r in rows if not any(fits(r, x) for x in rules)]
    rules, aside = [], []
    while len(rules) < quality.MOST_RULES and len(aside) <= quality.MOST_FAILURES:
        best = choice(outside(rules), aside)
        if best is None:
            break
        (rules if best[0] else aside).append(best[4])
    for k in range(len(rules)):
        own = outside(rules[:k] + rules[k + 1 :])
        inside = [r for r in own if fits(r, rules[k])]
        bad = sum(r.bad for r in inside)
        best = choice(own, []) if bad < len(inside) else None
        if best and best[0] and best[5] < len(inside) - bad and best[1] > (bad + 1) / (len(inside) + 2):
            rules[k] = best[4]
    return rules, fits


def test_kept_against_plain_covering(spark):
    random.seed(11)
    rows = []
    for i in range(260):
        s = {k: random.randint(0, 6) for k in ("n_words", "n_symbols", "n_upper", "n_digits", "n_marks")}
        s |= {"n_words": 20 + s["n_words"], "word_chars": 80, "n_lines": 3, "n_dup_lines": 0, "n_repeat_words": 0, "n_distinct": 15}
        odd = s["n_symbols"] > 4 or (s["n_upper"] > 3 and s["n_digits"] > 2)
        rows.append((i, odd if random.random() < 0.97 else not odd, tuple(s.values())))
    fields = ", ".join(f"{k}: long" for k in s)
    labelled = spark.createDataFrame(rows, f"doc_id long, bad boolean, s struct<{fields}>")
    binned, bounds = quality.binned(labelled)
    table = binned.collect()
    expected, fits = plain_cover(table, bounds)
    found = quality.cover(binned, bounds)
    assert [tuple((c.share, c.above, c.bin) for c in rule) for rule in found] == expected and expected
    rejected = labelled.where(quality.rejects(quality.learn(labelled), "s")).select("doc_id").collect()
    assert {r.doc_id for r in rejected} == {r.doc_id for r in table if any(fits(r, rule) for rule in expected)}


def test_small_shares_draw_someone(spark):
    """A share of 8000 out of 2e10 is a share of the hashes, not none."""
    share = 8000 / 2e10
    edge = int(share * 2.0**64) - 2**63
    spots = spark.createDataFrame([(-(2**63),), (edge - 1,), (edge,), (2**63 - 1,)], "spot long")
    assert spots.where(lowest(F.col("spot"), share)).count() == 2 and edge > -(2**63)
    assert spots.where(lowest(F.col("spot"), 1.0)).count() == 4
    drawn = spark.range(200_000).where(lowest(F.xxhash64("id"), 0.01)).count()
    assert 1700 < drawn < 2300
