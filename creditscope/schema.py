"""Typed table definitions of the clean layer and their declared constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType, StringType,
                               StructField, StructType)

MONEY = DecimalType(12, 2)
MONEY_OUT = DecimalType(18, 2)


def _s(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


TABLES: dict[str, StructType] = {
    "regions": _s(("region_id", IntegerType(), False), ("region_name", StringType(), False)),
    "card_products": _s(("product_id", IntegerType(), False), ("product_name", StringType(), False),
                        ("base_apr", DecimalType(6, 4), False), ("annual_fee", DecimalType(8, 2), False)),
    "cardholders": _s(("cardholder_id", LongType(), False), ("age", IntegerType(), True),
                      ("annual_income", MONEY, True), ("employment_status", StringType(), True),
                      ("region_id", IntegerType(), False), ("fico_origination", IntegerType(), True),
                      ("credit_history_months", IntegerType(), True)),
    "accounts": _s(("account_id", LongType(), False), ("cardholder_id", LongType(), False),
                   ("product_id", IntegerType(), False), ("open_date", DateType(), False),
                   ("credit_limit", MONEY, False)),
    "monthly_statements": _s(("statement_id", LongType(), False), ("account_id", LongType(), False),
                             ("statement_month", DateType(), False), ("opening_balance", MONEY, False),
                             ("purchase_amount", MONEY, False), ("payment_amount", MONEY, False),
                             ("ending_balance", MONEY, False), ("minimum_due", MONEY, False),
                             ("days_past_due", IntegerType(), False), ("charge_off_flag", IntegerType(), False)),
}

# Load order that respects foreign keys (parents first).
LOAD_ORDER = ("regions", "card_products", "cardholders", "accounts", "monthly_statements")

MONEY_COLS = ("opening_balance", "purchase_amount", "payment_amount", "ending_balance", "minimum_due")


def raw_schema(table: str) -> StructType:
    """The raw export of a table: same column names, every column a string."""
    return StructType([StructField(f.name, StringType(), True) for f in TABLES[table].fields])


@dataclass(frozen=True)
class Constraint:
    table: str
    name: str
    kind: str            # pk | not_null | fk | check
    column: str
    sql: str = ""        # check predicate that must hold (NULL passes, as in SQL)
    ref_table: str = ""
    ref_column: str = ""


def _not_null(table: str) -> list[Constraint]:
    return [Constraint(table, f"{f.name}_not_null", "not_null", f.name)
            for f in TABLES[table].fields if not f.nullable]


CONSTRAINTS: list[Constraint] = [
    Constraint("regions", "regions_pkey", "pk", "region_id"),
    *_not_null("regions"),
    Constraint("card_products", "card_products_pkey", "pk", "product_id"),
    *_not_null("card_products"),
    Constraint("card_products", "base_apr_check", "check", "base_apr", "base_apr >= 0"),
    Constraint("card_products", "annual_fee_check", "check", "annual_fee", "annual_fee >= 0"),
    Constraint("cardholders", "cardholders_pkey", "pk", "cardholder_id"),
    *_not_null("cardholders"),
    Constraint("cardholders", "age_check", "check", "age", "age BETWEEN 18 AND 100"),
    Constraint("cardholders", "annual_income_check", "check", "annual_income", "annual_income >= 0"),
    Constraint("cardholders", "fico_origination_check", "check", "fico_origination",
               "fico_origination BETWEEN 300 AND 850"),
    Constraint("cardholders", "credit_history_months_check", "check", "credit_history_months",
               "credit_history_months >= 0"),
    Constraint("cardholders", "cardholders_region_id_fkey", "fk", "region_id",
               ref_table="regions", ref_column="region_id"),
    Constraint("accounts", "accounts_pkey", "pk", "account_id"),
    *_not_null("accounts"),
    Constraint("accounts", "credit_limit_check", "check", "credit_limit", "credit_limit > 0"),
    Constraint("accounts", "accounts_cardholder_id_fkey", "fk", "cardholder_id",
               ref_table="cardholders", ref_column="cardholder_id"),
    Constraint("accounts", "accounts_product_id_fkey", "fk", "product_id",
               ref_table="card_products", ref_column="product_id"),
    Constraint("monthly_statements", "monthly_statements_pkey", "pk", "statement_id"),
    *_not_null("monthly_statements"),
    Constraint("monthly_statements", "days_past_due_check", "check", "days_past_due", "days_past_due >= 0"),
    Constraint("monthly_statements", "charge_off_flag_check", "check", "charge_off_flag",
               "charge_off_flag IN (0, 1)"),
    Constraint("monthly_statements", "monthly_statements_account_id_fkey", "fk", "account_id",
               ref_table="accounts", ref_column="account_id"),
]
