"""Quality rules as learned decision lists.

Statistics of every whole text are computed by SQL functions, and rules over them are
learned from labels by sequential covering. On two thirds of the labelled rows rules are
grown from each of the most telling first conditions, one threshold at a time by the best
information gain, so that a common but blurred statistic does not keep out a pure one. They
are cut back to all their beginnings; of those that are precise enough on the other third,
the one that is surest to be pure joins the list. The rows it covers are set aside and the
next rule is grown. Where no rule is precise enough, the rows of the best one are left out
of growing and other rules are tried. Last, a rule of the list that covers good rows is
replaced if a purer one can be grown in its place. The result is an ordered list of
conjunctions that becomes one ``CASE`` expression.

Learning needs only counts by (rule, statistic, bin, label), which Spark aggregates; the
driver sees some ``2 * BINS`` counts per rule and statistic in each step. Fitting uses about
``label_rows`` labelled rows, those with the lowest hashes of their ids; everything else
covers all rows.

Only DataFrame and SQL functions are used. Texts are read whole, whatever their length. NULL
and empty texts have no words and fail the base rules. Rows without a label, or with a NULL
one, are not learned from. Without labels of both kinds the list is empty and only the base
rules reject. Repeated rows are judged alike, each on its own; among rules that are equally
good the shorter and then the earlier grown one is taken. An empty table gives an empty one.
Other columns pass through; one with the name of a result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.llm.common import WORD, fresh, lowest, written

WINDOW = 5
# Base rules: fewest words, and per cent of words in repeated windows that is too much.
LEAST_WORDS, REPEAT_PERCENT = 10, 20

BINS = 32
LABEL_ROWS = 20_000
MOST_RULES, MOST_CONDITIONS = 12, 3
# First conditions that rules are grown from, and how often no grown rule may be precise enough.
FIRST_CONDITIONS, MOST_FAILURES = 5, 4
# A rule must be this precise on rows it was not grown on, and cover so many of them.
PRECISION, LEAST_COVER = 0.95, 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# What rules are learned over: shares of the counts, free of a text's length, but for the first.
SHARES = {
    "n_words": "CAST(s.n_words AS double)",
    "mean_word": "s.word_chars / s.n_words",
    "symbol_share": "s.n_symbols / s.n_words",
    "dup_line_share": "s.n_dup_lines / s.n_lines",
    "repeat_share": "s.n_repeat_words / s.n_words",
    "distinct_share": "s.n_distinct / s.n_words",
    "upper_share": "s.n_upper / s.word_chars",
    "mark_share": "s.n_marks / s.n_words",
    "digit_share": "s.n_digits / s.word_chars",
    "line_words": "s.n_words / s.n_lines",
}


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in windows that occur twice or more, from the words ``v.w``.

    Sorting the windows' hashes brings equal ones together; their starts in order then tell
    how many new words each covers. Most texts have no equal windows and stop at once.
    """
    hashed = ", ".join(f"v.w[i + {k}]" for k in range(WINDOW))
    windows = (
        f"if(size(v.w) < {WINDOW}, CAST(array() AS array<bigint>), "
        f"transform(sequence(0, size(v.w) - {WINDOW}), i -> xxhash64({hashed})))"
    )
    starts = (
        "sort_array(transform(filter(s, (x, k) -> x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h), x -> x.i))"
    )
    covered = (
        f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (a, c) -> a + c)"
    )
    pairs = "array_sort(transform(g, (h, i) -> struct(h AS h, i AS i)))"
    repeated = _let(pairs, "s", _let(starts, "p", covered))
    return _let(windows, "g", f"if(size(array_distinct(g)) = size(g), 0L, {repeated})")


def statistics_expression(text: str) -> str:
    """A struct of counts of a text."""
    lines = f"filter(split(v.t, '\\n'), l -> l RLIKE r'{WORD}')"
    counts = {
        "n_words": "CAST(size(v.w) AS bigint)",
        "word_chars": "CAST(char_length(array_join(v.w, '')) AS bigint)",
        "n_symbols": "CAST(regexp_count(v.t, '[#*$%&|<>]') AS bigint)",
        "n_lines": "CAST(size(ls) AS bigint)",
        "n_dup_lines": "CAST(size(ls) - size(array_distinct(ls)) AS bigint)",
        "n_repeat_words": _repeat_words(),
        "n_distinct": "CAST(size(array_distinct(v.w)) AS bigint)",
        "n_upper": "CAST(regexp_count(v.t, '[A-Z]') AS bigint)",
        "n_marks": "CAST(regexp_count(v.t, '[!?]') AS bigint)",
        "n_digits": "CAST(regexp_count(v.t, '[0-9]') AS bigint)",
    }
    struct = "named_struct(" + ", ".join(f"'{k}', {e}" for k, e in counts.items()) + ")"
    body = f"coalesce(`{text}`, '')"
    parts = f"struct({body} AS t, regexp_extract_all({body}, r'{WORD}', 0) AS w)"
    return _let(parts, "v", _let(lines, "ls", struct))


def with_statistics(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the struct ``name``. Unfolding a one-entry array keeps it from being computed twice."""
    return rows.select("*", F.explode(F.array(F.expr(statistics_expression(text)))).alias(name))


def base_failed(s: str) -> str:
    return f"({s}.n_words < {LEAST_WORDS} OR 100 * {s}.n_repeat_words > {REPEAT_PERCENT} * {s}.n_words)"


@dataclass(frozen=True)
class Condition:
    share: str
    above: bool  # greater than the bound, or not
    bound: float
    bin: int  # the bound's place among the bounds of its share

    def sql(self, shares: dict[str, str]) -> str:
        return f"({shares[self.share]}) {'>' if self.above else '<='} {self.bound!r}D"

    def binned(self) -> str:
        return f"bins['{self.share}'] {'>' if self.above else '<='} {self.bin}"


Rule = tuple[Condition, ...]


def rejects(rules: list[Rule], s: str) -> str:
    """The ordered list as one expression over the struct ``s``: whether the first rule that fits rejects."""
    shares = {k: e.replace("s.", f"{s}.") for k, e in SHARES.items()}
    cases = "".join(f" WHEN {' AND '.join(c.sql(shares) for c in rule)} THEN true" for rule in rules)
    return f"(CASE{cases} ELSE false END)" if rules else "false"


def _matches(rule: Rule) -> str:
    return " AND ".join(c.binned() for c in rule) if rule else "true"


Table = dict[str, list[tuple[int, int]]]


def _counts(rows: DataFrame, rules: list[Rule], bounds: dict[str, list[float]]) -> list[Table]:
    """For each rule the bad and good rows that fit it, by share and bin."""
    fits = ", ".join(f"if({_matches(rule)}, {k}, NULL)" for k, rule in enumerate(rules))
    found = (
        rows.selectExpr("bad", "bins", f"explode(array({fits})) AS rule")
        .where("rule IS NOT NULL")
        .select("bad", "rule", F.explode("bins").alias("share", "bin"))
        .groupBy("rule", "share", "bin")
        .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    )
    tables = [{share: [(0, 0)] * (len(bounds[share]) + 1) for share in SHARES} for _ in rules]
    # A bounded histogram: one row per rule, share and bin.
    for row in found.collect():
        tables[row["rule"]][row["share"]][row["bin"]] = (row["p"], row["n"])
    return tables


def _telling(table: Table, bounds: dict[str, list[float]]) -> list[tuple[float, Condition, int]]:
    """The condition of the highest gain of each share and the good rows it leaves, most telling first."""
    found = []
    for share, bins in table.items():
        best: tuple[float, Condition | None, int] = (1e-9, None, 0)
        p_all, n_all = sum(p for p, _ in bins), sum(n for _, n in bins)
        if not p_all:
            continue
        now = math.log2(p_all / (p_all + n_all))
        p_low = n_low = 0
        for place, bound in enumerate(bounds[share]):
            p_low, n_low = p_low + bins[place][0], n_low + bins[place][1]
            for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                gain = p * (math.log2(p / (p + n)) - now) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, Condition(share, above, bound, place), n)
        if best[1] is not None:
            found.append(best)
    return sorted(found, key=lambda b: -b[0])


def _joined(rule: Rule, condition: Condition) -> Rule:
    """The rule with one condition more; it takes the place of a wider one on the same side."""
    return (*(c for c in rule if (c.share, c.above) != (condition.share, condition.above)), condition)


def _grown(rows: DataFrame, bounds: dict[str, list[float]]) -> list[Rule]:
    """Rules from each of the most telling first conditions, with all their beginnings."""
    first = _telling(_counts(rows, [()], bounds)[0], bounds)[:FIRST_CONDITIONS]
    rules: list[Rule] = [(condition,) for _, condition, _ in first]
    going = [(condition,) for _, condition, good in first if good]
    for _ in range(MOST_CONDITIONS - 1):
        if not going:
            break
        further = []
        for rule, table in zip(going, _counts(rows, going, bounds)):
            for _, condition, good in _telling(table, bounds)[:1]:
                longer = _joined(rule, condition)
                rules.append(longer)
                if good:
                    further.append(longer)
        going = further
    return list(dict.fromkeys(rules))


@dataclass(frozen=True)
class Cover:
    """Bad and good rows that a rule covers, in all and of those it was not grown on."""

    bad: int
    good: int
    held_bad: int
    held_good: int

    @property
    def purity(self) -> float:
        """Share of bad rows, as sure as their number makes it."""
        return (self.bad + 1) / (self.bad + self.good + 2)

    @property
    def precise(self) -> bool:
        return self.held_bad >= LEAST_COVER and self.held_bad >= PRECISION * (self.held_bad + self.held_good)


def _covers(rows: DataFrame, rules: list[Rule]) -> list[Cover]:
    counts = {
        f"{name}{k}": f"count_if({kind} AND {_matches(rule)})"
        for k, rule in enumerate(rules)
        for name, kind in (("b", "bad"), ("g", "NOT bad"), ("hb", "bad AND NOT grow"), ("hg", "NOT bad AND NOT grow"))
    }
    row = rows.agg(*(F.expr(f"{count} AS {name}") for name, count in counts.items())).first()
    return [Cover(row[f"b{k}"], row[f"g{k}"], row[f"hb{k}"], row[f"hg{k}"]) for k in range(len(rules))]


def _without(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return rows.where(" AND ".join(f"NOT ({_matches(rule)})" for rule in rules)) if rules else rows


def _choice(rows: DataFrame, aside: list[Rule], bounds: dict[str, list[float]]) -> tuple[Rule, Cover] | None:
    """The rule that is surest to be pure among those that are precise enough, else among all; None if none grows."""
    rules = _grown(_without(rows, aside).where("grow"), bounds)
    if not rules:
        return None
    found = list(zip(rules, _covers(rows, rules)))
    able = [(rule, cover) for rule, cover in found if cover.precise] or found
    return max(able, key=lambda f: (f[1].purity, f[1].bad, -len(f[0])))


def cover(rows: DataFrame, bounds: dict[str, list[float]]) -> list[Rule]:
    """The list of rules for rows (bad, bins, grow)."""
    rules: list[Rule] = []
    aside: list[Rule] = []
    while len(rules) < MOST_RULES and len(aside) <= MOST_FAILURES:
        choice = _choice(_without(rows, rules), aside, bounds)
        if choice is None:
            break
        (rules if choice[1].precise else aside).append(choice[0])
    for k, rule in enumerate(rules):
        own = _without(rows, rules[:k] + rules[k + 1 :])
        (now,) = _covers(own, [rule])
        choice = _choice(own, [], bounds) if now.good else None
        if choice and choice[1].precise and choice[1].good < now.good and choice[1].purity > now.purity:
            rules[k] = choice[0]
    return rules


def _centred(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Bounds moved halfway to the next larger value of all rows, which changes no row's side."""
    conditions = sorted({c for rule in rules for c in rule}, key=repr)
    if not conditions:
        return rules
    above = rows.agg(
        *(F.expr(f"min(if(shares['{c.share}'] > {c.bound!r}D, shares['{c.share}'], NULL))").alias(f"c{k}") for k, c in enumerate(conditions))
    ).first()
    moved = {
        c: c if above[f"c{k}"] is None else replace(c, bound=(c.bound + above[f"c{k}"]) / 2) for k, c in enumerate(conditions)
    }
    return [tuple(moved[c] for c in rule) for rule in rules]


def binned(labelled: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Rows (bad, shares, bins, grow) from rows (doc_id, bad, s), and the bounds of the bins of each share."""
    shares = F.expr("map(" + ", ".join(f"'{k}', {e}" for k, e in SHARES.items()) + ")")
    rows = written(labelled.select("doc_id", "bad", shares.alias("shares")), "labelled")
    steps = "array(" + ", ".join(f"{k / BINS}D" for k in range(1, BINS)) + ")"
    cut = rows.agg(
        *(F.expr(f"percentile_approx(shares['{k}'], {steps}, 10000)").alias(k) for k in SHARES),
        *(F.expr(f"percentile_approx(if(bad, shares['{k}'], NULL), {steps}, 10000)").alias(f"{k}_bad") for k in SHARES),
    ).first()
    bounds = {k: sorted({float(b) for b in [*(cut[k] or []), *(cut[f"{k}_bad"] or [])]}) for k in SHARES}
    listed = "map(" + ", ".join(
        f"'{k}', size(filter(array({', '.join(f'{b!r}D' for b in bounds[k])}), b -> b < shares['{k}']))" for k in SHARES
    ) + ")"
    grow = "pmod(xxhash64(doc_id, 'grow'), 3) < 2 AS grow"
    return written(rows.selectExpr("doc_id", "bad", "shares", f"{listed} AS bins", grow), "binned"), bounds


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules from rows (doc_id, bad, s), the first that was learned first."""
    kinds = labelled.agg(F.max("bad"), F.min("bad")).first()
    if kinds[0] is not True or kinds[1] is not False:
        return []
    rows, bounds = binned(labelled)
    return _centred(rows, cover(rows, bounds))


def learned_rules(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_rows: int = LABEL_ROWS
) -> list[Rule]:
    """Rules from the labels (doc_id, quality 0 or 1) of documents that pass the base rules."""
    known = labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    drawn = lowest(F.xxhash64("doc_id", F.lit("label")), label_rows / max(1, known.count()))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(drawn)
    stats = with_statistics(narrow, "text", "s").select("doc_id", "s").where(f"NOT {base_failed('s')}")
    # Statistics are computed once, before learning goes over them.
    return learn(written(stats.join(known.where(drawn), "doc_id"), "labelled-statistics"))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents with the struct ``stats`` and the booleans ``base_failed`` and ``kept``.

    Existing columns of these names are replaced.
    """
    added = {"stats", "base_failed", "kept"}
    s = fresh(docs, "s")
    with_s = with_statistics(docs, text, s)
    others = [f"`{c}`" for c in docs.columns if c.lower() not in added]
    return with_s.selectExpr(
        *others,
        f"{s} AS stats",
        f"{base_failed(s)} AS base_failed",
        f"NOT {base_failed(s)} AND NOT {rejects(rules, s)} AS kept",
    )


def kept_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the base rules and the learned list keep, with their own columns."""
    rules = learned_rules(docs, labels, doc_id, text)
    s = fresh(docs, "s")
    passed = f"NOT {base_failed(s)} AND NOT {rejects(rules, s)}"
    return with_statistics(docs, text, s).where(passed).drop(s)
