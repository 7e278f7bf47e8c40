"""Raw exports -> clean, typed tables with an audit of every repair (B-1..B-18).

Each ``clean_<table>`` returns ``(clean, audit)``.  ``audit`` is a lazy frame of
(table_name, check_name, cnt) rows built from one aggregate pass over the
parsed, unrepaired projection, which also carries how many copies each row stands
for; so the counts cost one scan per table rather than one per rule.  Medians for imputation come from exact distributed
aggregates and enter the rows as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from creditscope.functions.exprs import (clip, fill_blank_text, is_blank_text, parse_date,
                                         parse_money, parse_number, round_half_even,
                                         round_half_up, title_case)
from creditscope.operators.joins import keep_referenced, orphans
from creditscope.operators.radix import radix_medians
from creditscope.operators.ranking import approximate_medians
from creditscope.schema import MONEY, MONEY_COLS, TABLES
from creditscope.session import freeze

POS = "_row_pos"
Tables = dict[str, DataFrame]


@dataclass
class Cleaned:
    tables: Tables
    audit: DataFrame


COPIES = "_copies"
#: Whether a row's parents exist.
PARENTS = "_parents"


def with_position(raw: DataFrame) -> DataFrame:
    """The raw frame, which must say its rows' input positions (readers do, at the
    scan): a position taken later would not be the input's."""
    if POS not in raw.columns:
        raise ValueError(f"raw rows need their input position in {POS}")
    return raw


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row dedupe that keeps the first position of each copy group and counts
    the group in ``COPIES``.

    An aggregate, so a group of many copies is combined map-side."""
    cols = [c for c in df.columns if c != POS]
    return df.groupBy(*cols).agg(F.min(POS).alias(POS), F.count(F.lit(1)).alias(COPIES))


def first_by_key(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key by input position, and the key's rows in ``COPIES``.

    Exact copies need no pass of their own: the first row of a key stays the first."""
    cols = [c for c in df.columns if c not in (POS, key)]
    first = F.min_by(F.struct(*cols), POS)
    grouped = df.groupBy(key).agg(first.alias("_first"), F.min(POS).alias(POS), F.count(F.lit(1)).alias(COPIES))
    return grouped.select(key, "_first.*", POS, COPIES)


def _audit(table: str, counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row frame of counts -> long (table_name, check_name, cnt) rows."""
    pairs = ", ".join(f"'{n}', cast(`{n}` as bigint)" for n in names)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) as (check_name, cnt)") \
        .select(F.lit(table).alias("table_name"), "check_name", "cnt")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _n(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery (computed once, used as a value)."""
    return df.agg(F.count(F.lit(1))).scalar()


def in_money(value: Column) -> Column:
    """NULL for an amount that the money type cannot hold, so it counts as missing."""
    return F.when(value.try_cast(MONEY).isNotNull(), value)


def medians_of(df: DataFrame, cols: Sequence[str], method: str = "exact") -> Column:
    """The columns' medians as one scalar subquery (a struct), so that all come from one run."""
    return (approximate_medians if method == "approx" else radix_medians)(df, cols).select(F.struct(*cols)).scalar()


def impute_median(df: DataFrame, col: str, digits: int = 2, rounding: str = "half_up",
                  method: str = "exact", out: str | None = None, cast=None,
                  medians: Column | None = None) -> DataFrame:
    """Fill NULLs of ``col`` with its median rounded to ``digits`` (HALF_UP, or
    HALF_EVEN for whole-number medians such as age) into ``out``.

    The median enters every row as a scalar subquery (computed once); ``medians`` is a
    value of ``medians_of`` that has it already."""
    med = (medians if medians is not None else medians_of(df, [col], method)).getField(col)
    fill = round_half_even(med, digits) if rounding == "half_even" else round_half_up(med, digits)
    value = F.coalesce(F.col(col), fill)
    if cast is not None:
        value = F.coalesce(F.col(col).cast(cast), fill.cast(cast))
    return df.withColumn(out or col, value)


def with_existence(df: DataFrame, flag: str, **parents: DataFrame) -> DataFrame:
    """Adds ``flag``: whether each named key column exists in its parent frame (one
    column, any name).  A NULL key does not.  Kept rows and orphan counts then come
    from one frame."""
    out, found = df, F.lit(True)
    for key, parent in parents.items():
        has = f"_has_{key}"
        keys = parent.select(F.col(parent.columns[0]).alias(f"_{has}")).distinct().withColumn(has, F.lit(True))
        out = out.join(keys, F.col(key) == F.col(f"_{has}"), "left")
        found = found & F.coalesce(F.col(has), F.lit(False))
    return out.select(*df.columns, found.alias(flag))


def clean_reference(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Small reference tables: exact dedupe and typed cast."""
    schema = TABLES[table]
    out = raw.drop(POS).dropDuplicates().select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return out, _audit(table, _count(out, "rows_out"), ["rows_out"])


def _parsed_cardholders(raw: DataFrame) -> DataFrame:
    raw = with_position(raw)
    dedup = drop_exact_duplicates(raw)
    age = parse_number(F.col("age"), "double")
    fico = parse_number(F.col("fico_origination"), "double")
    return dedup.select(
        POS,
        F.col("cardholder_id").cast("bigint").alias("cardholder_id"),
        F.col("region_id").cast("int").alias("region_id"),
        in_money(parse_money(F.col("annual_income"))).alias("_income"),
        age.alias("_age_raw"),
        F.when(age.between(18, 100), age).alias("_age"),
        F.col("employment_status").alias("_emp"),
        fico.alias("_fico"),
        parse_number(F.col("credit_history_months"), "int").alias("_hist"), COPIES)


def _surplus() -> Column:
    """Rows of the export beyond the distinct ones."""
    return F.coalesce(F.sum(COPIES), F.lit(0)) - F.count(F.lit(1))


def _orphans(parsed: DataFrame, name: str, cond: Column | None = None) -> list[Column]:
    """The orphan count of a frame that says whether its rows' parents exist."""
    if PARENTS not in parsed.columns:
        return []
    orphan = ~F.col(PARENTS)
    return [F.count_if(orphan if cond is None else cond & orphan).alias(name)]


def clean_cardholders(raw: DataFrame, median_method: str = "exact") -> tuple[DataFrame, DataFrame]:
    parsed = _parsed_cardholders(raw)
    return _clean_cardholders(parsed, median_method), _counted("cardholders", parsed, _holder_counts(parsed))


def _clean_cardholders(parsed: DataFrame, median_method: str = "exact", medians: Column | None = None) -> DataFrame:
    med = medians_of(parsed, ["_income", "_age"], median_method) if medians is None else medians
    filled = impute_median(parsed, "_income", digits=2, out="_inc_fill", cast=MONEY, medians=med)
    filled = impute_median(filled, "_age", digits=0, rounding="half_even", out="_age_fill", medians=med)
    out = filled.select(
        "cardholder_id",
        F.col("_age_fill").cast("int").alias("age"),
        F.col("_inc_fill").alias("annual_income"),
        title_case(fill_blank_text(F.col("_emp"))).alias("employment_status"),
        "region_id",
        clip(F.col("_fico"), 300, 850).cast("int").alias("fico_origination"),
        F.coalesce(F.col("_hist"), F.lit(0)).cast("int").alias("credit_history_months"),
        POS, *_kept_flag(parsed))
    return out


def _holder_counts(parsed: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows_out"), _surplus().alias("exact_duplicates_removed"),
            F.count_if(F.col("_income").isNull()).alias("missing_income_imputed"),
            F.count_if((F.col("_age_raw") < 18) | (F.col("_age_raw") > 100)).alias("impossible_ages_fixed"),
            F.count_if(is_blank_text(F.col("_emp"))).alias("employment_blanks_filled"),
            F.count_if((F.col("_fico") < 300) | (F.col("_fico") > 850)).alias("fico_out_of_range_clipped"),
            *_orphans(parsed, "orphan_region_fk_dropped")]


def _parsed_accounts(raw: DataFrame) -> DataFrame:
    return first_by_key(with_position(raw), "account_id").select(
        F.col("account_id").cast("bigint").alias("account_id"),
        F.col("cardholder_id").cast("bigint").alias("cardholder_id"),
        F.col("product_id").cast("int").alias("product_id"),
        parse_date(F.col("open_date")).alias("open_date"),
        in_money(parse_money(F.col("credit_limit"))).alias("_limit"), POS, COPIES)


def _bad_limit() -> Column:
    return F.col("_limit").isNull() | (F.col("_limit") <= 0)


def _kept_flag(parsed: DataFrame) -> list[str]:
    return [PARENTS] if PARENTS in parsed.columns else []


def clean_accounts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = _parsed_accounts(raw)
    return _clean_accounts(parsed), _counted("accounts", parsed, _account_counts(parsed))


def _clean_accounts(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~_bad_limit()).select("account_id", "cardholder_id", "product_id", "open_date",
                                               F.col("_limit").cast(MONEY).alias("credit_limit"), POS, *_kept_flag(parsed))


def _account_counts(parsed: DataFrame) -> list[Column]:
    return [F.count_if(~_bad_limit()).alias("rows_out"), _surplus().alias("duplicate_accounts_removed"),
            F.count_if(_bad_limit()).alias("nonpositive_limit_dropped"),
            *_orphans(parsed, "orphan_fk_dropped", ~_bad_limit())]


def _parsed_statements(raw: DataFrame) -> DataFrame:
    dedup = drop_exact_duplicates(with_position(raw))
    money = {c: in_money(parse_money(F.col(c))) for c in MONEY_COLS}
    return dedup.select(
        POS,
        F.col("statement_id").cast("bigint").alias("statement_id"),
        F.col("account_id").cast("bigint").alias("account_id"),
        parse_date(F.col("statement_month")).alias("statement_month"),
        *[expr.alias(f"_{c}") for c, expr in money.items()],
        parse_number(F.col("days_past_due"), "int").alias("_dpd"),
        parse_number(F.col("charge_off_flag"), "int").alias("_flag"), COPIES)


def clean_statements(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = _parsed_statements(raw)
    return _clean_statements(parsed), _counted("monthly_statements", parsed, _statement_counts(parsed))


def _statement_counts(parsed: DataFrame) -> list[Column]:
    pay = F.col("_payment_amount")
    return [F.count(F.lit(1)).alias("rows_out"), _surplus().alias("exact_duplicates_removed"),
            F.count_if(pay < 0).alias("negative_payments_corrected"),
            F.count_if(pay.isNull()).alias("missing_payments_zeroed"),
            *_orphans(parsed, "orphan_account_fk_dropped")]


def _clean_statements(parsed: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(MONEY)

    def money_out(c: str) -> Column:
        v = F.col(f"_{c}")
        if c == "payment_amount":
            v = F.when(v < 0, F.abs(v)).otherwise(v)
        return F.coalesce(v.cast(MONEY), zero).alias(c)

    return parsed.select("statement_id", "account_id", "statement_month",
                         *[money_out(c) for c in MONEY_COLS],
                         F.coalesce(F.col("_dpd"), F.lit(0)).alias("days_past_due"),
                         F.coalesce(F.col("_flag"), F.lit(0)).alias("charge_off_flag"), POS, *_kept_flag(parsed))


def _counted(table: str, parsed: DataFrame, counts: list[Column]) -> DataFrame:
    one = parsed.agg(*counts)
    return _audit(table, one, one.columns)


def enforce_integrity(t: Tables) -> Cleaned:
    """Cascade parents -> children: cardholders need a region; accounts need a
    cardholder and a product; statements need an account.  A NULL key is an
    orphan."""
    regions = t["regions"].select("region_id")
    products = t["card_products"].select("product_id")
    ch = t["cardholders"]
    ch_ok = keep_referenced(ch, "region_id", regions)
    ac = t["accounts"]
    ac_ok = keep_referenced(keep_referenced(ac, "cardholder_id", ch_ok), "product_id", products)
    st = t["monthly_statements"]
    st_ok = keep_referenced(st, "account_id", ac_ok)
    audit = (_audit("cardholders", _count(orphans(ch, "region_id", regions), "orphan_region_fk_dropped"),
                    ["orphan_region_fk_dropped"])
             .unionByName(_audit("accounts", _count(ac_ok, "_ok").select(
                 (_n(ac) - F.col("_ok")).alias("orphan_fk_dropped")), ["orphan_fk_dropped"]))
             .unionByName(_audit("monthly_statements",
                                 _count(orphans(st, "account_id", ac_ok), "orphan_account_fk_dropped"),
                                 ["orphan_account_fk_dropped"])))
    out = dict(t, cardholders=ch_ok, accounts=ac_ok, monthly_statements=st_ok)
    return Cleaned(out, audit)


# The order in which checks are reported, per table.
CHECK_ORDER = {
    "regions": ("rows_out",),
    "card_products": ("rows_out",),
    "cardholders": ("exact_duplicates_removed", "missing_income_imputed", "impossible_ages_fixed",
                    "employment_blanks_filled", "fico_out_of_range_clipped", "rows_out",
                    "orphan_region_fk_dropped"),
    "accounts": ("duplicate_accounts_removed", "nonpositive_limit_dropped", "rows_out", "orphan_fk_dropped"),
    "monthly_statements": ("exact_duplicates_removed", "negative_payments_corrected",
                           "missing_payments_zeroed", "rows_out", "orphan_account_fk_dropped"),
}


def account_keys(raw: Tables) -> DataFrame:
    """Ids of the accounts that cleaning keeps, from the keys of their ancestors alone."""
    regions = raw["regions"].select(F.col("region_id").cast("int").alias("region_id"))
    holders = keep_referenced(raw["cardholders"].select(
        F.col("cardholder_id").cast("bigint").alias("cardholder_id"),
        F.col("region_id").cast("int").alias("region_id")), "region_id", regions)
    products = raw["card_products"].select(F.col("product_id").cast("int").alias("product_id"))
    kept = _parsed_accounts(raw["accounts"]).filter(~_bad_limit())
    return keep_referenced(keep_referenced(kept, "cardholder_id", holders), "product_id", products)


def clean_table(raw: Tables, name: str, median_method: str = "exact") -> DataFrame:
    """One clean table.  Only its own rows and the keys of its ancestors are read, and
    nothing runs before its result is asked for, but the medians of cardholders."""
    if name in ("regions", "card_products"):
        return clean_reference(raw[name], name)[0]
    if name == "cardholders":
        regions = raw["regions"].select(F.col("region_id").cast("int").alias("region_id"))
        return keep_referenced(clean_cardholders(raw[name], median_method)[0].drop(POS), "region_id", regions)
    if name == "accounts":
        return account_keys(raw).select("account_id", "cardholder_id", "product_id", "open_date",
                                        F.col("_limit").cast(MONEY).alias("credit_limit"))
    return keep_referenced(clean_statements(raw[name])[0].drop(POS), "account_id", account_keys(raw))


PARSED_COUNTS = {"cardholders": _holder_counts, "accounts": _account_counts, "monthly_statements": _statement_counts}


def parse_all(raw: Tables, regions: DataFrame, products: DataFrame) -> Tables:
    """The three tables that need repairs, parsed once, with a flag that says whether a row's
    parents exist: clean rows, all counts and the children's parents come from these
    frames.  Cardholders and accounts are checkpointed, as medians, counts, rows and
    children read them."""
    holders = freeze(with_existence(_parsed_cardholders(raw["cardholders"]), PARENTS, region_id=regions.select("region_id")))
    accounts = freeze(with_existence(
        _parsed_accounts(raw["accounts"]), PARENTS, product_id=products.select("product_id"),
        cardholder_id=holders.where(PARENTS).select("cardholder_id")))
    statements = with_existence(_parsed_statements(raw["monthly_statements"]), PARENTS, account_id=accounts.where(
        F.col(PARENTS) & ~_bad_limit()).select("account_id"))
    return {"cardholders": holders, "accounts": accounts, "monthly_statements": statements}


def clean_rows(name: str, parsed: DataFrame, rows: DataFrame | None = None, median_method: str = "exact") -> DataFrame:
    """The clean rows of a parsed table, without its position; from ``rows``, the same
    frame under observation, if given (medians read the plain one)."""
    rows = parsed if rows is None else rows
    if name == "cardholders":
        out = _clean_cardholders(rows, median_method, medians_of(parsed, ["_income", "_age"], median_method))
    else:
        out = (_clean_accounts if name == "accounts" else _clean_statements)(rows)
    return out.where(PARENTS).drop(POS, PARENTS)


def clean_all(raw: Tables, median_method: str = "exact") -> Cleaned:
    """All five tables in dependency order, with the integrity cascade.  The
    position column is dropped from the outputs."""
    regions, a1 = clean_reference(raw["regions"], "regions")
    products, a2 = clean_reference(raw["card_products"], "card_products")
    parsed = parse_all(raw, regions, products)
    tables, audit = {"regions": regions, "card_products": products}, a1.unionByName(a2)
    for name, df in parsed.items():
        tables[name] = clean_rows(name, df, median_method=median_method)
        audit = audit.unionByName(_counted(name, df, PARSED_COUNTS[name](df)))
    return Cleaned(tables, audit)


def clean_and_write(raw: Tables, write: Callable[[str, DataFrame], DataFrame], median_method: str = "exact") -> DataFrame:
    """Cleans every table and hands it to ``write(name, rows)``, which writes it and returns it
    as written; returns the audit, counted on the rows while they are written.

    The counts are observed metrics of the writing stage (a retried task counts once), so
    nothing is read a second time for them; 18 numbers reach the driver."""
    counts: dict[str, dict[str, int]] = {}

    def observed(name: str, df: DataFrame, aggregates: list[Column], rows) -> DataFrame:
        seen = Observation(f"audit_{name}")
        written = write(name, rows(df.observe(seen, *aggregates)))
        counts[name] = seen.get
        return written

    small = {name: observed(name, clean_reference(raw[name], name)[0], [F.count(F.lit(1)).alias("rows_out")], lambda df: df)
             for name in ("regions", "card_products")}
    spark = raw["regions"].sparkSession
    parsed = parse_all(raw, small["regions"], small["card_products"])
    for name, df in parsed.items():
        observed(name, df, PARSED_COUNTS[name](df), lambda rows: clean_rows(name, df, rows, median_method))
    rows = [(table, check, int(counts[table][check])) for table, checks in CHECK_ORDER.items() for check in checks]
    return spark.createDataFrame(rows, "table_name string, check_name string, cnt long")
