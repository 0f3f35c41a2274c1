"""Money, rounding, ratios and deltas as SQL expressions.

They return text for ``selectExpr`` and ``F.expr``: reports have dozens of measures of the
same form, and one parsed expression is built faster than a chain of column calls.

Money is rounded to four decimals per value and added up in whole ten-thousandths, so a sum does not depend on the order in
which partial aggregates meet, and a row costs one primitive addition per amount. Only
totals turn into decimals. Ratios are doubles, rounded half up through a decimal, which
gives the same digits in every engine.
"""

from __future__ import annotations


# Money values from here on, like ones that are not finite, are not amounts.
LARGEST_AMOUNT = "1e11D"


def is_amount(value: str) -> str:
    return f"abs({value}) < {LARGEST_AMOUNT}"


def units(value: str) -> str:
    """A money value in whole ten-thousandths, NULL counted as zero.

    What is no amount gives NULL, which a ``sound_sum`` hands on.
    """
    return f"(CASE WHEN {value} IS NULL THEN 0L WHEN {is_amount(value)} THEN cast(rint({value} * 10000) AS bigint) END)"


def sound_sum(amount: str, day: str = "TRUE", total: str | None = None) -> str:
    """Sum over the rows of a day, NULL if an amount among them is."""
    return f"if(count_if({day} AND ({amount}) IS NULL) > 0, NULL, {total or f'sum({amount})'})"


def copied_sum(amount: str, *factors: str, day: str = "TRUE") -> str:
    """Exact sum over the rows of a day of a whole amount times its factors.

    Factors are counts of copies, nearly always one: those rows add up as integers, and
    only the others, whose products may pass the integer range, as decimals.
    """
    single = " AND ".join(f"{factor} = 1" for factor in factors)
    product = " * ".join([f"cast({amount} as decimal(38,0))", *factors])
    total = (
        f"(coalesce(sum({amount}) FILTER (WHERE {day} AND {single}), 0)"
        f" + coalesce(sum({product}) FILTER (WHERE {day} AND NOT ({single})), 0))"
    )
    return sound_sum(amount, day, total)


def exact(total: str) -> str:
    """A total of money in the one decimal type that facts carry."""
    return f"cast({total} as decimal(38,4))"


def as_money(total_units: str) -> str:
    return exact(f"cast({total_units} as decimal(38,0)) * 0.0001BD")


def rounded(value: str, digits: int) -> str:
    return f"cast(round(cast({value} as decimal(28,10)), {digits}) as double)"


def ratio(numerator: str, denominator: str) -> str:
    """Quotient as a double, NULL when the denominator is zero."""
    return f"(cast({numerator} as double) / nullif(cast({denominator} as double), 0))"


def percent(part: str, whole: str) -> str:
    """Unrounded percentage."""
    return f"({ratio(part, whole)} * 100)"


def growth_pct(tw: str, lw: str) -> str:
    """Unrounded growth over last week in percent, NULL when last week is zero."""
    return percent(f"({tw} - {lw})", lw)


def change(tw: str, lw: str, kind: str, digits: int) -> str:
    """Rounded change of a metric: percent for growth metrics, difference otherwise."""
    return rounded(growth_pct(tw, lw) if kind == "growth" else f"{tw} - {lw}", digits)


def aliased(columns: dict[str, str]) -> list[str]:
    """``{name: expression}`` as a select list."""
    return [f"{expression} AS {name}" for name, expression in columns.items()]
