"""Parsing, repair, banding and exact-rounding expressions.

Every function maps Columns to a Column, so Catalyst keeps them inside
whole-stage codegen; none of them triggers a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens a CSV reader with pandas defaults turns into missing values.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null")

# Text treated as missing by the date and money parsers (compared
# lower-cased after trimming) and by the blank-text rule (compared as is).
DATE_BLANKS = ("", "nan", "nat", "none")
MONEY_BLANKS = ("", "nan", "none", "n/a")
TEXT_BLANKS = ("", "nan", "None", "<NA>")
MONEY_STRIP = ("$", ",", "USD")

# Date layouts tried in order (single letters accept one or two
# digits), then a listed best-effort tail.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "MMM d yyyy", "MMMM d yyyy")
DATE_FALLBACK_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy/M/d", "M-d-yyyy",
                         "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_tokens_to_null(col: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    c = _c(col)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def parse_date(col: Column | str, formats: Sequence[str] = DATE_FORMATS + DATE_FALLBACK_FORMATS) -> Column:
    """Mixed-format text to DATE; anything unparseable is NULL (never raises)."""
    s = F.trim(_c(col))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("date")
    return F.when(s.isNull() | F.lower(s).isin(*DATE_BLANKS), F.lit(None).cast("date")).otherwise(parsed)


def parse_money(col: Column | str, precision: int = 18, scale: int = 6) -> Column:
    """Currency text ("$1,234.50", "USD 12") to DECIMAL; blanks and junk are NULL.

    Parses at a wider scale than cents so that sign tests see the value as
    written; round to cents with ``.cast(MONEY)`` (HALF_UP).
    """
    s = F.trim(_c(col))
    body = s
    for token in MONEY_STRIP:
        body = F.replace(body, F.lit(token), F.lit(""))
    parsed = F.trim(body).try_cast(f"decimal({precision},{scale})")
    return F.when(s.isNull() | F.lower(s).isin(*MONEY_BLANKS),
                  F.lit(None).cast(f"decimal({precision},{scale})")).otherwise(parsed)


def parse_number(col: Column | str, dtype: str = "double") -> Column:
    """Lenient numeric parse: NULL for anything that is not a plain number.

    Goes through a decimal for every type, so NaN and infinity texts and Java
    suffixes ("700d") are missing values, as "42.0" is a number for an integer."""
    return F.trim(_c(col)).try_cast("decimal(38,10)").try_cast(dtype)


def null_outside(col: Column | str, lo, hi) -> Column:
    c = _c(col)
    return F.when(c.between(lo, hi), c)


def clip(col: Column | str, lo, hi) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    c = _c(col)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def fill_blank_text(col: Column | str, default: str = "Unknown") -> Column:
    c = _c(col)
    return F.when(c.isNull() | F.trim(c).isin(*TEXT_BLANKS), F.lit(default)).otherwise(F.trim(c))


def is_blank_text(col: Column | str) -> Column:
    c = _c(col)
    return c.isNull() | F.trim(c).isin(*TEXT_BLANKS)


def title_case(col: Column | str) -> Column:
    """Capital after every non-letter, lower elsewhere ("SELF-EMPLOYED" -> "Self-Employed")."""
    chunks = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(chunks, lambda x: F.initcap(x)), "")


def band(col: Column | str, edges: Sequence[float], labels: Sequence[str],
         right: bool = False, null_label: str | None = None) -> Column:
    """Ordered CASE: label i for values below edge i (left-closed bins), the last
    label for everything else.  ``right=True`` closes bins on the right.

    NULL falls into the last label, as an SQL ``ELSE`` does, unless
    ``null_label`` is given.
    """
    assert len(labels) == len(edges) + 1
    c = _c(col)
    expr = None
    for edge, label in zip(edges, labels):
        cond = (c <= edge) if right else (c < edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.otherwise(F.lit(labels[-1]))
    if null_label is not None:
        expr = F.when(c.isNull(), F.lit(null_label)).otherwise(expr)
    return expr


def ratio_half_up(num: Column, den: Column, digits: int, pow10: int = 0) -> Column:
    """round(num / den * 10^pow10, digits) with exact HALF_UP, as DOUBLE.

    ``num`` and ``den`` are integral or fixed-point; the quotient is taken on
    integers (DECIMAL(38,0)), so a tie such as 57/20000 = 0.285% rounds to
    0.29 in every engine.  A NULL or zero denominator gives NULL.
    """
    big = "decimal(38,0)"
    n = num.cast(big)
    d = F.nullif(den.cast(big), F.lit(0).cast(big))
    scaled = F.abs(n) * F.lit(2 * 10 ** (digits + pow10)).cast(big) + F.abs(d)
    q = F.call_function("div", scaled, F.abs(d) * F.lit(2).cast(big))
    # Negative only for a non-zero result of opposite-signed inputs (no -0.0).
    negative = (F.signum(n) * F.signum(d) < 0) & (q != 0)
    sign = F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0))
    return (q.cast("double") * sign) / F.lit(float(10 ** digits))


def rate(k: Column | str, n: Column | str, digits: int = 2) -> Column:
    """Percentage k/n*100 rounded HALF_UP to ``digits`` (counts)."""
    return ratio_half_up(_c(k), _c(n), digits, pow10=2)


def share(part: Column | str, total: Column | str, digits: int = 1, scale: int = 2) -> Column:
    """Percentage of two fixed-point sums with ``scale`` decimals (money: cents)."""
    mult = F.lit(10 ** scale).cast("decimal(38,0)")
    p = (_c(part) * mult).cast("decimal(38,0)")
    t = (_c(total) * mult).cast("decimal(38,0)")
    return ratio_half_up(p, t, digits, pow10=2)


def half_up(sum_col: Column | str, count_col: Column | str, digits: int = 0) -> Column:
    """Exact HALF_UP mean of an integral column from its sum and count."""
    return ratio_half_up(_c(sum_col), _c(count_col), digits, pow10=0)


def round_half_up(col: Column | str, digits: int) -> Column:
    """HALF_UP rounding of a DOUBLE at its shortest decimal form, as DOUBLE.

    The value is first fixed to 10 decimals so that engines which differ in the
    last binary digit of a float sum still round the same way.
    """
    return F.round(_c(col).cast("decimal(38,10)"), digits).cast("double")


def round_half_even(col: Column | str, digits: int = 0) -> Column:
    return F.bround(_c(col).cast("decimal(38,10)"), digits)
