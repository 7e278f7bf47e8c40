"""The portfolio model bound to the driver's test tables.

One text per clean table, written once and run by both engines: Spark binds the
``{name}`` placeholders to DataFrames, the DuckDB oracle binds them to its
registered views and inlines the texts as leading CTEs.  Account = customer;
statement = a customer's order activity in one month.

The raw layer re-dirties the clean layer with faults keyed on the ids (currency
text, blanks, impossible ages, mixed date formats, exact duplicate rows,
negative payments, an orphan region), so expected clean results can be stated
with the same modulus predicates.  It is Spark-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NumericType

from creditscope.schema import TABLES

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CLEAN_SQL: dict[str, str] = {
    "regions": """
select r_regionkey as region_id, r_name as region_name from {region}""",
    "card_products": """
select product_id, product_name, cast(0.1799 + 0.02 * product_id as decimal(6,4)) as base_apr,
       cast(product_id * 45 as decimal(8,2)) as annual_fee
from (select distinct case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2
             when 'FURNITURE' then 3 when 'HOUSEHOLD' then 4 else 5 end as product_id,
             c_mktsegment as product_name from {customer}) t""",
    "cardholders": """
select c_custkey as cardholder_id, cast(18 + (c_custkey * 37) % 83 as int) as age,
       cast(20000 + c_acctbal * 10 as decimal(12,2)) as annual_income,
       case when c_custkey % 20 = 0 then 'Unknown' when c_custkey % 4 = 0 then 'Self-Employed'
            else 'Employed' end as employment_status,
       n_regionkey as region_id, cast(520 + (c_custkey * 7919) % 331 as int) as fico_origination,
       cast((c_custkey * 31) % 240 as int) as credit_history_months
from {customer} join {nation} on c_nationkey = n_nationkey""",
    "accounts": """
select c_custkey as account_id, c_custkey as cardholder_id,
       case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2
            when 'FURNITURE' then 3 when 'HOUSEHOLD' then 4 else 5 end as product_id,
       cast(date '1988-01-01' + cast((c_custkey * 13) % 2500 as int) as date) as open_date,
       cast(100000 + ((c_custkey * 17) % 46) * 20000 as decimal(12,2)) as credit_limit
from {customer}""",
    "monthly_statements": """
select statement_id, account_id, statement_month,
       cast(0 as decimal(12,2)) as opening_balance, ending_balance as purchase_amount,
       case when days_past_due = 0 then cast(25 as decimal(12,2)) else cast(0 as decimal(12,2)) end as payment_amount,
       ending_balance, cast(25 as decimal(12,2)) as minimum_due, days_past_due, charge_off_flag
from (select min(o_orderkey) as statement_id, o_custkey as account_id,
             last_day(cast(o_orderdate as date)) as statement_month,
             cast(sum(cast(o_totalprice as decimal(12,2))) as decimal(12,2)) as ending_balance,
             cast(30 * (max(cast(substr(o_orderpriority, 1, 1) as int)) - 1) as int) as days_past_due,
             max(case when o_orderpriority like '5%' and o_orderstatus = 'F' then 1 else 0 end) as charge_off_flag
      from {orders} group by o_custkey, last_day(cast(o_orderdate as date))) t""",
}

# Base tables each clean text reads.
CLEAN_INPUTS = {"regions": ("region",), "card_products": ("customer",),
                "cardholders": ("customer", "nation"), "accounts": ("customer",),
                "monthly_statements": ("orders",)}

RAW_SQL: dict[str, str] = {
    "cardholders": """
select cast(cardholder_id as string) as cardholder_id,
       case when cardholder_id % 37 = 0 then '199' else cast(age as string) end as age,
       case when cardholder_id % 33 = 0 then '' when cardholder_id % 3 = 0 then concat('$', format_number(annual_income, 2))
            else cast(annual_income as string) end as annual_income,
       case when employment_status = 'Unknown' then '' when cardholder_id % 7 = 0 then upper(employment_status)
            when cardholder_id % 5 = 0 then lower(employment_status) else employment_status end as employment_status,
       case when cardholder_id % 211 = 0 then '99' else cast(region_id as string) end as region_id,
       case when cardholder_id % 41 = 0 then '900' else cast(fico_origination as string) end as fico_origination,
       case when cardholder_id % 43 = 0 then '' else cast(credit_history_months as string) end as credit_history_months,
       cardholder_id as _row_pos
from {cardholders}""",
    "accounts": """
select b.*, struct(cast(b.account_id as bigint) as id, copy_no) as _row_pos from (select cast(account_id as string) as account_id, cast(cardholder_id as string) as cardholder_id,
       cast(product_id as string) as product_id,
       case account_id % 3 when 0 then date_format(open_date, 'yyyy-MM-dd') when 1 then date_format(open_date, 'MM/dd/yyyy')
            else date_format(open_date, 'MMM dd yyyy') end as open_date,
       case when account_id % 53 = 0 then '0' when account_id % 2 = 0 then concat('$', format_number(credit_limit, 2))
            else cast(credit_limit as string) end as credit_limit
from {accounts}) b lateral view explode(case when cast(b.account_id as bigint) % 61 = 0 then array(1, 2) else array(1) end) d as copy_no""",
    "monthly_statements": """
select b.*, struct(cast(b.statement_id as bigint) as id, copy_no) as _row_pos from (select cast(statement_id as string) as statement_id, cast(account_id as string) as account_id,
       case statement_id % 3 when 0 then date_format(statement_month, 'yyyy-MM-dd') when 1 then date_format(statement_month, 'MM/dd/yyyy')
            else date_format(statement_month, 'MMM dd yyyy') end as statement_month,
       cast(opening_balance as string) as opening_balance, cast(purchase_amount as string) as purchase_amount,
       case when statement_id % 97 = 0 then '' when statement_id % 89 = 0 then concat('-', cast(payment_amount as string))
            else cast(payment_amount as string) end as payment_amount,
       case when statement_id % 5 = 0 then concat('$', format_number(ending_balance, 2)) else cast(ending_balance as string) end as ending_balance,
       cast(minimum_due as string) as minimum_due, cast(days_past_due as string) as days_past_due,
       cast(charge_off_flag as string) as charge_off_flag
from {monthly_statements}) b lateral view explode(case when cast(b.statement_id as bigint) % 101 = 0 then array(1, 2) else array(1) end) d as copy_no""",
}

Tables = dict[str, DataFrame]


def broken_sql(name: str, source: str) -> str:
    """A clean table with rows that violate its constraints, for both engines: by the
    key's remainder each column is NULL in some rows and, if a number, negative in
    others; some rows come twice."""
    fields = TABLES[name].fields
    key = fields[0].name
    cells = []
    for j, f in enumerate(fields):
        kind = f.dataType.simpleString()
        wrong = f"when {key} % 19 = {(j + 4) % 19} then cast(-{key} - 1 as {kind})" if isinstance(
            f.dataType, NumericType) else ""
        cells.append(f"case when {key} % 19 = {j + 1} then null {wrong} else {f.name} end as {f.name}")
    return (f"select {', '.join(cells)} from {source} union all "
            f"select {', '.join(x.name for x in fields)} from {source} where {key} % 3 = 2")


def bind_broken(spark: SparkSession, clean: Tables) -> Tables:
    return {name: spark.sql(broken_sql(name, "{source}"), source=df) for name, df in clean.items()}


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind_clean(spark: SparkSession, sf_dir: str) -> Tables:
    """The five clean tables as lazy DataFrames over ``sf_dir``."""
    base = {name: read_base(spark, sf_dir, name)
            for name in {b for deps in CLEAN_INPUTS.values() for b in deps}}
    return {name: spark.sql(CLEAN_SQL[name], **{b: base[b] for b in CLEAN_INPUTS[name]})
            for name in CLEAN_SQL}


def bind_raw(spark: SparkSession, clean: Tables) -> Tables:
    """Raw (all-string, dirty) exports derived from the clean tables.

    The two small reference tables are exported clean, as in the analysed data.
    ``_row_pos`` is the rows' place in the export.
    """
    raw = {name: spark.sql(sql, **{name: clean[name]}) for name, sql in RAW_SQL.items()}
    for small in ("regions", "card_products"):
        raw[small] = clean[small].select([clean[small][c].cast("string").alias(c)
                                          for c in clean[small].columns])
    return raw


def oracle_ctes(names: tuple[str, ...] = tuple(CLEAN_SQL)) -> str:
    """``with`` prefix that defines the clean tables for an engine that only has
    the base tables registered.  Callers append ``, more as (...)`` or a select."""
    fmt = {b: b for b in BASE_TABLES}
    parts = [f"{n} as ({CLEAN_SQL[n].format(**fmt).strip()})" for n in names]
    return "with " + ",\n".join(parts)
