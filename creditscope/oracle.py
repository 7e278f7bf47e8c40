"""Oracle SQL for the differential check (DuckDB dialect).

Each text stands alone: the clean tables are inlined as leading CTEs over the
registered base tables.  Metrics follow their definitions: one account-level
relation, looked-up scales, one set of group sums, ratios of them.  Shared with the
Spark side are only the binding texts and the exact HALF_UP rounding rule.
"""

from __future__ import annotations

from creditscope.schema import CONSTRAINTS, LOAD_ORDER, TABLES
from creditscope.sources.binding import broken_sql, oracle_ctes


def ratio(num: str, den: str, digits: int, pow10: int = 2) -> str:
    """round(num/den * 10^pow10, digits), exact HALF_UP on integers, as DOUBLE."""
    n, d = f"cast({num} as hugeint)", f"cast(nullif({den}, 0) as hugeint)"
    q = f"((2 * abs({n}) * {10 ** (digits + pow10)} + abs({d})) // (2 * abs({d})))"
    sign = f"(case when sign({n}) * sign({d}) < 0 and {q} <> 0 then -1 else 1 end)"
    return f"(cast({q} as double) * {sign} / {10 ** digits})"


def pct(k: str, n: str, digits: int = 2) -> str:
    return ratio(k, n, digits)


def money_pct(part: str, total: str, digits: int = 1) -> str:
    return ratio(f"round(({part}) * 100)", f"round(({total}) * 100)", digits)


def avg_int(s: str, n: str, digits: int = 0) -> str:
    return ratio(s, n, digits, pow10=0)


def avg_pct(s: str, n: str, digits: int = 1) -> str:
    return f"cast(round(cast(({s}) / ({n}) * 100.0 as decimal(38,10)), {digits}) as double)"


def r_half_up(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(38,10)), {digits}) as double)"


MONEY = "decimal(18,2)"

# One relation carries everything the account-level metrics need.  Scores, tiers
# and buckets are looked up in small value tables rather than spelled as branches.
BOOK = """newest as (
  select account_id, max(struct_pack(m := statement_month, i := statement_id, bal := ending_balance,
                                     dpd := days_past_due, co := charge_off_flag)) as s
  from monthly_statements group by account_id),
fico_scale(under, pts) as (values (660, 2), (720, 1)),
util_scale(least_, pts) as (values (cast(0.90 as double), 2), (cast(0.60 as double), 1)),
tier_scale(pts, tier) as (values (0, 'Tier 1 - Low Risk'), (1, 'Tier 2 - Moderate'), (2, 'Tier 2 - Moderate'),
  (3, 'Tier 3 - Elevated'), (4, 'Tier 4 - High Risk'), (5, 'Tier 4 - High Risk')),
facts as (
  select newest.account_id as acct, holder.cardholder_id as holder_id, acc.product_id as product, s.bal as bal,
         acc.credit_limit as lim, s.dpd as dpd, s.co as co, s.m as month, acc.open_date as opened,
         cast(s.bal as double) / cast(nullif(acc.credit_limit, 0) as double) as util,
         holder.fico_origination as fico, holder.credit_history_months as hist, holder.annual_income as income,
         holder.region_id as region, holder.age as age, holder.credit_history_months < 24 as thin
  from newest, accounts acc, cardholders holder
  where acc.account_id = newest.account_id and holder.cardholder_id = acc.cardholder_id),
book as (
  select f.*, tier_scale.tier, tier_scale.pts
  from facts f, tier_scale
  where tier_scale.pts = coalesce((select max(pts) from fico_scale where f.fico < under), 0)
                       + coalesce((select max(pts) from util_scale where f.util >= least_), 0)
                       + coalesce(cast(f.thin as int), 0))"""

# Every measure of a group, as sums; a metric is a ratio of two of them.
SUMS = """count(*) as n, sum(util) as u, count(util) as u_n, sum(fico) as f, count(fico) as f_n, sum(hist) as h,
  count(hist) as h_n, sum(lim) as lim, sum(bal) as bal, coalesce(sum(cast(thin as int)), 0) as thin_n,
  coalesce(sum(cast(dpd >= 30 as int)), 0) as late30, coalesce(sum(cast(dpd >= 60 as int)), 0) as late60,
  coalesce(sum(cast(dpd >= 90 as int)), 0) as late90, coalesce(sum(co), 0) as lost,
  sum(case co when 1 then bal end) as lost_bal"""


def with_clean(*ctes: str) -> str:
    prefix = oracle_ctes()
    return prefix + "".join(",\n" + c for c in ctes) + "\n"


def _book(*more: str) -> str:
    return with_clean(BOOK, *more)


def _grouped(key: str, source: str = "book", more: str = "") -> str:
    """CTE ``g``: the sums of each value of ``key``; ``every``: of all groups."""
    return (f"g as (select {key} as k, {SUMS} from {source} {more} group by 1),\n"
            "every as (select sum(n) as n, sum(late30) as late30, sum(bal) as bal, sum(lost_bal) as lost_bal from g)")


def _of_all(column: str) -> str:
    return f"(select {column} from every)"


def _scale(name: str, rows: list[tuple]) -> str:
    """A value table (low, high, label) of half-open ranges; None is open."""
    cells = ", ".join("(" + ", ".join("cast(null as double)" if v is None else f"'{v}'" if isinstance(v, str)
                                      else f"cast({v} as double)" for v in r) + ")" for r in rows)
    return f"{name}(low, high, label) as (values {cells})"


AGING = _scale("aging", [(None, 1, "1 Current"), (1, 60, "2 30 DPD"), (60, 90, "3 60 DPD"), (90, 120, "4 90 DPD"),
                         (120, None, "5 120+ DPD")])
BANDS = _scale("bands", [(None, 0.3, "1 <30%"), (0.3, 0.6, "2 30-60%"), (0.6, 0.9, "3 60-90%"), (0.9, None, "4 90%+")])
CLOSED_BANDS = _scale("bands", [(-0.01, 0.3, "<30%"), (0.3, 0.6, "30-60%"), (0.6, 0.9, "60-90%"), (0.9, None, "90%+")])
ROLL = _scale("roll", [(None, 1, "0 Current"), (1, 60, "1 30 DPD"), (60, 90, "2 60 DPD"), (90, None, "3 90+ DPD")])


def _portfolio(key: str = "") -> str:
    return f"""n as accounts, cast(bal as {MONEY}) as total_balance, {avg_pct('u', 'u_n')} as avg_utilization_pct,
  {money_pct('bal', 'lim', 1)} as portfolio_utilization_pct, {pct('late30', 'n')} as delinquency_rate_30plus_pct,
  {pct('late60', 'n')} as delinquency_rate_60plus_pct, {pct('late90', 'n')} as delinquency_rate_90plus_pct,
  {pct('lost', 'n')} as charge_off_rate_pct, {money_pct('lost_bal', 'bal', 2)} as charge_off_balance_pct,
  cast(coalesce(lost_bal, 0) as {MONEY}) as charge_off_balance"""


def _file_depth(flag: str) -> str:
    return f"list_extract(['Established file', 'Thin file (<24 mo)'], 1 + cast(coalesce({flag}, false) as int))"


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["account_current"] = _book() + """
select acct as account_id, holder_id as cardholder_id, product as product_id, bal as ending_balance, lim as credit_limit,
  dpd as days_past_due, co as charge_off_flag, util as utilization, fico as fico_origination,
  hist as credit_history_months, income as annual_income, region as region_id, thin as thin_file,
  cast(pts as int) as risk_points, tier as risk_tier, age, opened as open_date, month as statement_month
from book"""
    q["portfolio_kpis"] = _book(_grouped("1")) + f"select {_portfolio()} from g"
    q["delinquency_buckets"] = _book(AGING, """named as (
  select f.*, a.label from facts f join aging a on coalesce(f.dpd >= a.low, true) and coalesce(f.dpd < a.high, true)
  where f.co is distinct from 1 union all select f.*, '6 Charged Off' from facts f where f.co = 1)""",
                                       _grouped("label", "named")) + f"""
select k as delinquency_bucket, n as accounts, {pct('n', _of_all('n'), 2)} as pct_of_portfolio from g"""
    segment = (f"n as accounts, {avg_pct('u', 'u_n')} as avg_utilization_pct, "
               f"{pct('late30', 'n')} as delinquency_rate_pct, {pct('lost', 'n')} as charge_off_rate_pct")
    q["kpis_by_product"] = _book(_grouped("product", "facts")) + f"""
select (select max(product_name) from card_products c where c.product_id = k) as product_name, {segment},
  cast(bal as {MONEY}) as total_balance from g"""
    q["kpis_by_region"] = _book(_grouped("region", "facts")) + f"""
select (select max(region_name) from regions c where c.region_id = k) as region_name, {segment} from g"""
    q["portfolio_kpis_by_product_region_band"] = _book(BANDS, f"""g as (
  select product, region, label, {SUMS} from book join bands
  on (low is null or util >= low) and (high is null or util < high) or util is null and high is null group by all)""") + f"""
select cast(product as int) as product_id, cast(region as int) as region_id, label as utilization_band, {_portfolio()} from g"""
    banded = """banded as (select book.*, label from book join bands
  on (low is null or util >= low) and (high is null or util < high) or util is null and high is null)"""
    q["portfolio_cube"] = _book(BANDS, banded, f"""g as (
  select cast(grouping_id(tier, product, region, label) as int) as level, tier, product, region, label, {SUMS}
  from banded group by cube (tier, product, region, label))""") + f"""
select level as grouping_level, tier as risk_tier, cast(product as int) as product_id, cast(region as int) as region_id,
  label as utilization_band, {_portfolio()} from g"""
    q["portfolio_slice_stored"] = _book(BANDS, banded, _grouped(
        "region", "banded", "where label in ('3 60-90%', '4 90%+') and tier <> 'Tier 1 - Low Risk'")) + f"""
select cast(k as int) as region_id, {_portfolio()} from g"""
    q["risk_tier_kpis"] = _book(_grouped("tier")) + f"""
select k as risk_tier, n as accounts, {pct('n', _of_all('n'), 1)} as pct_of_accounts, {avg_int('f', 'f_n')} as avg_fico,
  {avg_pct('u', 'u_n')} as avg_utilization_pct, {pct('thin_n', 'n', 1)} as pct_thin_file,
  {pct('late30', 'n')} as delinquency_rate_pct, {pct('lost', 'n')} as charge_off_rate_pct,
  cast(bal as {MONEY}) as total_balance, {money_pct('bal', _of_all('bal'), 1)} as pct_of_balance from g"""
    q["risk_tier_extract"] = _book(_grouped("tier")) + f"""
select k as risk_tier, n as accounts, {avg_int('f', 'f_n')} as avg_fico, {avg_pct('u', 'u_n', 2)} as avg_utilization,
  {pct('thin_n', 'n', 2)} as pct_thin_file, {pct('late30', 'n')} as delinquency_rate, {pct('lost', 'n')} as charge_off_rate,
  cast(bal as {MONEY}) as total_balance, {pct('n', _of_all('n'), 1)} as pct_of_accounts,
  {money_pct('bal', _of_all('bal'), 1)} as pct_of_balance, cast(coalesce(lost_bal, 0) as {MONEY}) as charge_off_balance,
  coalesce({money_pct('coalesce(lost_bal, 0)', _of_all('lost_bal'), 1)}, cast(0 as double)) as pct_of_chargeoff_balance
from g"""
    q["utilization_extract"] = _book(CLOSED_BANDS, _grouped(
        "label", "book join bands on util > low and coalesce(util <= high, true)")) + f"""
select k as utilization_band, n as accounts, late30 as delinquents, {pct('late30', 'n')} as delinquency_rate,
  {pct('n', '(select count(*) from book)', 1)} as pct_of_accounts,
  {pct('late30', _of_all('late30'), 1)} as pct_of_all_delinquents from g"""
    q["file_depth_extract"] = _book(_grouped("coalesce(thin, false)")) + f"""
select k as thin_file, n as accounts, {avg_int('h', 'h_n')} as avg_history_months, {pct('late30', 'n')} as delinquency_rate,
  {pct('lost', 'n')} as charge_off_rate, {_file_depth('k')} as file_depth from g"""
    q["interaction_extract"] = _book(_grouped("[coalesce(util >= 0.60, false), coalesce(thin, false)]")) + f"""
select k[1] as util_hi, k[2] as thin_file, n as accounts, {pct('late30', 'n')} as delinquency_rate,
  concat_ws(' + ', if(k[1], 'High util (>=60%)', 'Lower util (<60%)'), if(k[2], 'Thin file', 'Established')) as segment
from g"""
    q["risk_concentration"] = _book(_grouped("tier")) + f"""
select k as risk_tier, {money_pct('bal', _of_all('bal'), 1)} as pct_total_balance,
  {money_pct('lost_bal', _of_all('lost_bal'), 1)} as pct_charged_off_balance from g"""
    q["risk_deciles"] = _book("""placed as (
  select book.*, row_number() over (order by least(util, cast(1 as double)) * cast(0.6 as double)
      + cast(850 - fico as double) / cast(550 as double) * cast(0.4 as double) nulls last, acct) - 1 as pos
  from book)""", "sized as (select count(*) // 10 as q, count(*) % 10 as r from book)",
        _grouped("case when pos < r * (q + 1) then pos // (q + 1) else r + (pos - r * (q + 1)) // q end", "placed, sized")) + f"""
select cast(k + 1 as int) as risk_decile, n as accounts, {avg_pct('u', 'u_n')} as avg_utilization_pct,
  {avg_int('f', 'f_n')} as avg_fico, {pct('late30', 'n')} as delinquency_rate_pct from g"""
    q["delinquency_by_utilization"] = _book(BANDS, _grouped("label", """book join bands
  on (low is null or util >= low) and (high is null or util < high) or util is null and high is null""")) + f"""
select k as utilization_band, n as accounts, {pct('n', _of_all('n'), 1)} as pct_of_accounts,
  {pct('late30', 'n')} as delinquency_rate_pct, {pct('late30', _of_all('late30'), 1)} as pct_of_all_delinquents from g"""
    q["delinquency_by_file_depth"] = _book(_grouped("thin")) + f"""
select {_file_depth('k')} as file_depth, n as accounts, {avg_int('h', 'h_n')} as avg_history_months,
  {pct('late30', 'n')} as delinquency_rate_pct, {pct('lost', 'n')} as charge_off_rate_pct from g"""
    q["delinquency_interaction"] = _book("""cells as (
  select if(util >= 0.60, 'High util (>=60%)', 'Lower util (<60%)') as a, if(thin, 'Thin file', 'Established') as b,
    count(*) as n, coalesce(sum(cast(dpd >= 30 as int)), 0) as late from book group by cube (a, b))""") + f"""
select a as utilization_band, b as file_depth, n as accounts, {pct('late', 'n')} as delinquency_rate_pct
from cells where (a is null) = (b is null)"""
    q["driver_segment_concentration"] = _book(_grouped("util >= 0.60 or thin")) + f"""
select if(k, 'High-util or thin-file', 'Rest of book') as segment, n as accounts,
  {pct('n', _of_all('n'), 1)} as pct_of_accounts, {pct('late30', 'n')} as delinquency_rate_pct,
  {pct('late30', _of_all('late30'), 1)} as pct_of_all_delinquents,
  {money_pct('lost_bal', _of_all('lost_bal'), 1)} as pct_of_chargeoff_balance from g"""
    q["monthly_trend"] = with_clean("""panel as (
  select s.statement_month as month, s.days_past_due as dpd, s.charge_off_flag as co, s.ending_balance as bal,
    cast(s.ending_balance as double) / cast(nullif(a.credit_limit, 0) as double) as util, a.credit_limit as lim,
    null as fico, null as hist, null as thin
  from monthly_statements s, accounts a where a.account_id = s.account_id)""", _grouped("month", "panel"), f"""
rated as (select k, n, {pct('late30', 'n')} as late, {pct('lost', 'n')} as lost, {avg_pct('u', 'u_n')} as util,
  row_number() over (order by k) as pos from g)""") + f"""
select t.k as statement_month, t.n as active_accounts, t.late as delinquency_rate_pct,
  {r_half_up('t.late - p.late', 2)} as delinquency_mom_change, t.lost as charge_off_rate_pct, t.util as avg_utilization_pct
from rated t left join rated p on p.pos + 1 = t.pos"""
    q["monthly_trend_extract"] = "select strftime(statement_month, '%Y-%m-%d') as statement_month, " \
        "active_accounts, delinquency_rate_pct as delinquency_rate, charge_off_rate_pct as charge_off_rate, " \
        "avg_utilization_pct as avg_utilization, delinquency_mom_change from (" + q["monthly_trend"] + ") t"
    q["roll_rates"] = with_clean(ROLL, """line as (
  select account_id, days_past_due as dpd,
    row_number() over (order by account_id, statement_month, statement_id) as pos from monthly_statements)""") + f"""
select label as from_bucket, count(*) as observations,
  {pct('sum(cast(b.dpd > a.dpd as int))', 'count(*)', 1)} as roll_forward_rate_pct,
  {pct('sum(cast(b.dpd = 0 as int))', 'count(*)', 1)} as cure_rate_pct
from line a join line b on b.pos = a.pos + 1 and b.account_id = a.account_id
join roll on coalesce(a.dpd >= low, true) and coalesce(a.dpd < high, true) group by label"""
    q["vintage"] = _book(_grouped("cast(year(opened) as int)", "facts")) + f"""
select k as vintage_year, n as accounts, {pct('late30', 'n')} as delinquency_rate_pct,
  {pct('lost', 'n')} as charge_off_rate_pct from g"""
    q.update(cleaning_queries())
    q.update(model_and_decision_queries())
    return q


# ---------------------------------------------------------------------------
# Cleaning: expected clean rows and audit counts, stated with the modulus
# predicates that put the faults into the raw layer (see sources/binding.py).
# ---------------------------------------------------------------------------

MEDIANS = """med as (
  select quantile_cont(cast(age as double), 0.5) filter (where cardholder_id % 37 <> 0) as age_m,
         quantile_cont(cast(annual_income as double), 0.5) filter (where cardholder_id % 33 <> 0) as inc_m
  from cardholders),
fill as (
  select cast(case when age_m = floor(age_m) + 0.5
                   then (case when cast(floor(age_m) as bigint) % 2 = 0 then floor(age_m) else floor(age_m) + 1 end)
                   else round(age_m) end as int) as age_fill,
         cast(round(cast(inc_m as decimal(38,10)), 2) as decimal(12,2)) as inc_fill
  from med)"""


def cleaning_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_regions"] = with_clean() + "select region_id, region_name from regions"
    q["clean_card_products"] = with_clean() + "select product_id, product_name, base_apr, annual_fee from card_products"
    q["clean_cardholders"] = with_clean(MEDIANS) + """
select cardholder_id,
  case when cardholder_id % 37 = 0 then age_fill else age end as age,
  case when cardholder_id % 33 = 0 then inc_fill else annual_income end as annual_income,
  employment_status, region_id,
  case when cardholder_id % 41 = 0 then 850 else fico_origination end as fico_origination,
  case when cardholder_id % 43 = 0 then 0 else credit_history_months end as credit_history_months
from cardholders, fill
where cardholder_id % 211 <> 0"""
    q["clean_accounts"] = with_clean() + """
select account_id, cardholder_id, product_id, open_date, credit_limit from accounts
where account_id % 53 <> 0 and cardholder_id % 211 <> 0"""
    q["clean_statements"] = with_clean() + """
select statement_id, s.account_id, statement_month, opening_balance, purchase_amount,
  case when statement_id % 97 = 0 then cast(0 as decimal(12,2)) else payment_amount end as payment_amount,
  ending_balance, minimum_due, days_past_due, charge_off_flag
from monthly_statements s
where s.account_id % 53 <> 0 and s.account_id % 211 <> 0"""
    q["quality_report"] = with_clean() + """
select 'regions' as table_name, 'rows_out' as check_name, count(*) as cnt from regions
union all select 'card_products', 'rows_out', count(*) from card_products
union all select 'cardholders', 'exact_duplicates_removed', 0
union all select 'cardholders', 'missing_income_imputed', count(*) filter (where cardholder_id % 33 = 0) from cardholders
union all select 'cardholders', 'impossible_ages_fixed', count(*) filter (where cardholder_id % 37 = 0) from cardholders
union all select 'cardholders', 'employment_blanks_filled', count(*) filter (where employment_status = 'Unknown') from cardholders
union all select 'cardholders', 'fico_out_of_range_clipped', count(*) filter (where cardholder_id % 41 = 0) from cardholders
union all select 'cardholders', 'rows_out', count(*) from cardholders
union all select 'cardholders', 'orphan_region_fk_dropped', count(*) filter (where cardholder_id % 211 = 0) from cardholders
union all select 'accounts', 'duplicate_accounts_removed', count(*) filter (where account_id % 61 = 0) from accounts
union all select 'accounts', 'nonpositive_limit_dropped', count(*) filter (where account_id % 53 = 0) from accounts
union all select 'accounts', 'rows_out', count(*) filter (where account_id % 53 <> 0) from accounts
union all select 'accounts', 'orphan_fk_dropped', count(*) filter (where account_id % 53 <> 0 and cardholder_id % 211 = 0) from accounts
union all select 'monthly_statements', 'exact_duplicates_removed', count(*) filter (where statement_id % 101 = 0) from monthly_statements
union all select 'monthly_statements', 'negative_payments_corrected',
  count(*) filter (where statement_id % 89 = 0 and statement_id % 97 <> 0 and payment_amount > 0) from monthly_statements
union all select 'monthly_statements', 'missing_payments_zeroed', count(*) filter (where statement_id % 97 = 0) from monthly_statements
union all select 'monthly_statements', 'rows_out', count(*) from monthly_statements
union all select 'monthly_statements', 'orphan_account_fk_dropped',
  count(*) filter (where account_id % 53 = 0 or account_id % 211 = 0) from monthly_statements"""
    q["table_counts"] = with_clean() + """
select 'regions' as table_name, count(*) as rows from regions
union all select 'card_products', count(*) from card_products
union all select 'cardholders', count(*) from cardholders
union all select 'accounts', count(*) from accounts
union all select 'monthly_statements', count(*) from monthly_statements"""
    q["constraint_report"] = with_clean() + constraint_sql()
    broken = [f"broken_{t} as ({broken_sql(t, t)})" for t in LOAD_ORDER]
    q["constraint_report_dirty"] = with_clean(*broken) + constraint_sql("broken_")
    loads = [_load_cte(t) for t in LOAD_ORDER]
    q["load_report_dirty"] = with_clean(*broken, *loads) + "\nunion all ".join(
        f"""select '{t}' as table_name, outcome, count(*) as rows, cast(sum({TABLES[t].fieldNames()[0]}) as bigint) as key_sum
from load_{t} group by outcome""" for t in LOAD_ORDER)
    q["load_kept_statements"] = with_clean(*broken, *loads) + f"""
select {', '.join(TABLES['monthly_statements'].fieldNames())} from load_monthly_statements where outcome = 'loaded'"""
    return q


def _load_cte(table: str) -> str:
    """CTE ``load_<table>``: every row of the broken table with its outcome at the gate."""
    mine = {kind: [c for c in CONSTRAINTS if c.table == table and c.kind == kind] for kind in ("not_null", "check", "fk", "pk")}
    key = mine["pk"][0].column
    faults = [f"when x.{c.column} is null then '{c.name}'" for c in mine["not_null"]]
    faults += [f"when not coalesce({c.sql}, true) then '{c.name}'" for c in mine["check"]]
    faults += [f"when x.{c.column} is not null and not exists (select 1 from load_{c.ref_table} p where p.outcome = 'loaded' "
               f"and p.{c.ref_column} = x.{c.column}) then '{c.name}'" for c in mine["fk"]]
    order = ", ".join(f"{f} nulls first" for f in TABLES[table].fieldNames())
    return f"""load_{table} as (
  select * exclude (fault), coalesce(fault, case row_number() over (partition by fault is null, {key} order by {order})
                                     when 1 then 'loaded' else '{mine['pk'][0].name}' end) as outcome
  from (select x.*, case {' '.join(faults)} end as fault from broken_{table} x) judged)"""


def constraint_sql(prefix: str = "") -> str:
    parts = []
    for c in CONSTRAINTS:
        t = prefix + c.table
        if c.kind == "not_null":
            body = f"select count(*) filter (where {c.column} is null) from {t}"
        elif c.kind == "check":
            body = f"select count(*) filter (where not coalesce({c.sql}, true)) from {t}"
        elif c.kind == "pk":
            body = (f"select coalesce(sum(case when k is null then n else n - 1 end), 0) from "
                    f"(select {c.column} as k, count(*) as n from {t} group by {c.column}) g")
        else:
            body = (f"select count(*) from {t} x where x.{c.column} is not null and not exists "
                    f"(select 1 from {prefix}{c.ref_table} p where p.{c.ref_column} = x.{c.column})")
        parts.append(f"select '{c.table}' as table_name, '{c.name}' as constraint_name, "
                     f"cast(({body}) as bigint) as violations")
    return "\nunion all ".join(parts)


# ---------------------------------------------------------------------------
# Models (deterministic parts) and decision layer.
# ---------------------------------------------------------------------------

SEG = {"utilization": "util", "fico_origination": "fico", "annual_income": "income", "credit_history_months": "hist",
       "days_past_due": "dpd"}
CENTRES = ((-0.5, 1.0, 0.5, 0.3, -0.4), (-0.2, 0.0, -0.2, 1.2, -0.3),
           (0.0, -0.5, -0.3, -0.6, -0.2), (2.0, -1.0, -0.5, -0.2, 2.5))
SEGMENT_NAMES = ("Segment A - Lowest risk", "Segment B - Moderate", "Segment C - Elevated",
                 "Segment D - Highest risk")
HIGH_TIERS = "('Tier 3 - Elevated', 'Tier 4 - High Risk')"


def _standard_rows() -> tuple[str, ...]:
    """CTEs up to ``z``: one list of five z-scores per account, medians filled in."""
    columns = list(SEG.values())
    filled = ", ".join(f"coalesce(cast({c} as double), (select quantile_cont(cast({c} as double), 0.5) from book)) as v{i}"
                       for i, c in enumerate(columns))
    spread = "(case when coalesce(stddev_pop(v{0}) over (), 0) = 0 then cast(1 as double) else stddev_pop(v{0}) over () end)"
    scores = ", ".join(f"(v{i} - avg(v{i}) over ()) / {spread.format(i)}" for i in range(len(columns)))
    return (f"filled as (select book.*, {filled} from book)", f"z as (select filled.*, [{scores}] as z from filled)")


def _nearest() -> tuple[str, ...]:
    cells = ", ".join(f"({i}, [{', '.join(f'cast({v} as double)' for v in centre)}])" for i, centre in enumerate(CENTRES))
    distance = " + ".join(f"(z[{j}] - c[{j}]) * (z[{j}] - c[{j}])" for j in range(1, len(SEG) + 1))
    return (f"centres(i, c) as (values {cells})",
            f"apart as (select acct, i, {distance} as d from z, centres)",
            "chosen as (select acct, cast(min(struct_pack(d := d, i := i)).i as int) as cluster, min(d) as d from apart group by acct)",
            "assigned as (select z.*, chosen.cluster, chosen.d from z join chosen on chosen.acct = z.acct)")


def _segment_assign() -> str:
    names = ", ".join(f"'{n}'" for n in SEGMENT_NAMES)
    return _book(*_standard_rows(), *_nearest(), _grouped("cluster", "assigned"), f"""
pay as (select cluster, sum(income) as s, count(income) as n from assigned group by cluster),
prof as (select k as cluster, g.n as accounts, {avg_pct('u', 'u_n')} as avg_utilization, {avg_int('f', 'f_n')} as avg_fico,
  {ratio('round(pay.s * 100)', 'pay.n * 100', 0, 0)} as avg_income, {avg_int('h', 'h_n')} as avg_history_months,
  {pct('late30', 'g.n', 2)} as delinquency_rate from g join pay on pay.cluster = g.k)""") + f"""
select *, list_extract([{names}],
  cast(row_number() over (order by delinquency_rate asc nulls last, accounts desc, cluster) as int)) as segment
from prof"""


def _segments_step() -> str:
    """One assign-and-update round from the literal centres."""
    means = ", ".join(f"{r_half_up(f'avg(z[{j + 1}])', 6)} as {c}" for j, c in enumerate(SEG))
    return _book(*_standard_rows(), *_nearest()) + f"""
select cluster, count(*) as accounts, {r_half_up('sum(d)', 6)} as cost, {means} from assigned group by cluster"""


def _segments_run(steps: int = 6, k: int = 4) -> str:
    """A fixed number of assign-and-update rounds from the first accounts by digest."""
    distance = " + ".join(f"(z[{j}] - c[{j}]) * (z[{j}] - c[{j}])" for j in range(1, len(SEG) + 1))
    means = ", ".join(f"avg(z[{j}])" for j in range(1, len(SEG) + 1))
    ctes = [*_standard_rows(), "zs as materialized (select acct, z from z)",
            f"c0 as materialized (select cast(row_number() over (order by md5(concat(acct, '-42')), acct) as int) - 1 as i, z as c "
            f"from zs order by i limit {k})"]
    for t in range(steps + 1):
        ctes.append(f"own{t} as materialized (select acct, min(struct_pack(d := {distance}, i := i)) as n, any_value(z) as z "
                    f"from zs, c{t} group by acct)")
        if t < steps:
            ctes.append(f"c{t + 1} as materialized (select c{t}.i, coalesce(any_value(m.c), any_value(c{t}.c)) as c from c{t} "
                        f"left join (select n.i as i, [{means}] as c from own{t} group by n.i) m on m.i = c{t}.i group by c{t}.i)")
    centre = ", ".join(f"{r_half_up(f'any_value(c[{j + 1}])', 6)} as {name}" for j, name in enumerate(SEG))
    return _book(*ctes) + f"""
select i as cluster, count(*) as accounts, {r_half_up('sum(n.d)', 6)} as cost, {centre}
from own{steps} join c{steps} on c{steps}.i = own{steps}.n.i group by i"""


DRIVER_EXPR = {
    "utilization": "least(greatest(util, cast(0 as double)), cast(2 as double))",
    "thin_file": "cast(coalesce(thin, false) as double)",
    "fico_origination": "cast(fico as double)",
    "log_income": "ln(greatest(cast(income as double), cast(1 as double)))",
    "age": "cast(age as double)",
}
# The point at which driver_gradient evaluates the loss.
GRADIENT_AT = {"intercept": -1.5, "utilization": 0.8, "thin_file": 0.2, "fico_origination": -0.5, "log_income": -0.1,
               "age": 0.05}


def _driver_rows() -> str:
    cols = ", ".join(f"{e} as {d}" for d, e in DRIVER_EXPR.items())
    return (f"d as (select {cols}, cast(dpd >= 30 as double) as label from book "
            "where util is not null and fico is not null and income is not null and age is not null)")


def _driver_features() -> str:
    parts = [f"select '{d}' as driver, count({d}) as n, {r_half_up(f'avg({d})', 6)} as mean, "
             f"{r_half_up(f'stddev_pop({d})', 6)} as std from d" for d in DRIVER_EXPR]
    return _book(_driver_rows()) + "\nunion all ".join(parts)


def _driver_gradient() -> str:
    """Gradient of the mean log loss plus the L2 term (C = 1) at ``GRADIENT_AT``."""
    z = ", ".join(f"({d} - avg({d}) over ()) / (case when coalesce(stddev_pop({d}) over (), 0) = 0 then cast(1 as double) "
                  f"else stddev_pop({d}) over () end) as z_{d}" for d in DRIVER_EXPR)
    line = " + ".join([f"cast({GRADIENT_AT['intercept']} as double)"] +
                      [f"cast({GRADIENT_AT[d]} as double) * z_{d}" for d in DRIVER_EXPR])
    parts = [f"select 'intercept' as term, {r_half_up('avg(miss)', 6)} as gradient from e"]
    parts += [f"select '{d}' as term, {r_half_up(f'avg(miss * z_{d}) + cast({GRADIENT_AT[d]} as double) / count(*)', 6)} "
              "as gradient from e" for d in DRIVER_EXPR]
    return _book(_driver_rows(), f"zd as (select {z}, label from d)",
                 f"e as (select *, 1 / (1 + exp(-({line}))) - label as miss from zd)") + "\nunion all ".join(parts)


def _newton(steps: int = 9) -> tuple[str, ...]:
    """CTEs ``beta0`` to ``beta<steps>``: Newton steps on the summed log loss with the L2
    term (C = 1), each solved by elimination spelled out in scalars."""
    z = ", ".join(f"({d} - avg({d}) over ()) / (case when coalesce(stddev_pop({d}) over (), 0) = 0 then cast(1 as double) "
                  f"else stddev_pop({d}) over () end) as x{i + 1}" for i, d in enumerate(DRIVER_EXPR))
    n = len(DRIVER_EXPR) + 1
    one = "cast(1 as double)"
    ctes = [_driver_rows(), f"zd as materialized (select {z}, {one} as x0, label from d)",
            "beta0 as (select " + ", ".join(f"cast(0 as double) as b{i}" for i in range(n)) + ")"]
    for k in range(steps):
        line = " + ".join(f"b{i} * x{i}" for i in range(n))
        sums = [f"sum((p - label) * x{i}) + {'0' if i == 0 else f'max(b{i})'} as g{i}" for i in range(n)]
        sums += [f"sum(p * (1 - p) * x{i} * x{j}) + {1 if i == j and i else 0} as h{i}_{j}" for i in range(n) for j in range(i + 1)]
        ctes.append(f"e{k}_0 as materialized (select {', '.join(sums)}, {', '.join(f'max(b{i}) as b{i}' for i in range(n))} "
                    f"from (select *, 1 / (1 + exp(-({line}))) as p from zd, beta{k}))")
        # Elimination, a column at a time, then the unknowns from the last one up.
        for c in range(n - 1):
            new = [f"h{i}_{j} - h{i}_{c} * h{j}_{c} / h{c}_{c} as h{i}_{j}" for i in range(c + 1, n) for j in range(c + 1, i + 1)]
            new += [f"g{i} - h{i}_{c} * g{c} / h{c}_{c} as g{i}" for i in range(c + 1, n)]
            ctes.append(f"e{k}_{c + 1} as materialized (select * replace ({', '.join(new)}) from e{k}_{c})")
        for i in reversed(range(n)):
            rest = "".join(f" - h{j}_{i} * s{j}" for j in range(i + 1, n))
            ctes.append(f"e{k}_{n + n - 1 - i} as materialized (select *, (g{i}{rest}) / h{i}_{i} as s{i} from e{k}_{n + n - 2 - i})")
        ctes.append(f"beta{k + 1} as materialized (select {', '.join(f'b{i} - s{i} as b{i}' for i in range(n))} from e{k}_{2 * n - 1})")
    return tuple(ctes)


def _drivers(steps: int = 9) -> tuple[str, ...]:
    """The Newton CTEs and ``drivers``: the fitted model as published."""
    rows = " union all ".join(f"select '{d}' as driver, {r_half_up(f'b{i + 1}', 3)} as coef_per_sd, "
                              f"{r_half_up(f'exp(b{i + 1})', 2)} as odds_ratio_per_sd from beta{steps}"
                              for i, d in enumerate(DRIVER_EXPR))
    return (*_newton(steps), f"drivers as ({rows})")


DECISION = f"""lost as (select coalesce(sum(bal), 0) as everyone, coalesce(sum(case when tier in {HIGH_TIERS} then bal end), 0) as high
  from book where co = 1),
open_ as (select coalesce(sum(bal), 0) as everyone, coalesce(sum(case when tier not in {HIGH_TIERS} then bal end), 0) as low
  from book where co <> 1),
decided as (select cast(lost.high as {MONEY}) as high_risk_co_balance,
  coalesce({money_pct('lost.high', 'lost.everyone', 1)}, cast(0 as double)) as high_risk_tier_share_of_chargeoff_balance_pct,
  {ratio('19', '100', 0, 2)} as cli_growth_share_assumption_pct,
  coalesce({ratio('round(lost.high * 100) * 19', 'round(lost.everyone * 100) * 100', 1, 2)}, cast(0 as double))
    as projected_chargeoff_exposure_reduction_pct,
  {money_pct('open_.low', 'open_.everyone', 1)} as low_risk_performing_balance_share_pct
  from lost, open_)"""


def _headline(with_drivers: bool = False) -> str:
    top = [f"(select {c} from drivers order by odds_ratio_per_sd desc, driver limit 1) as {name}" for c, name in (
        ("driver", "top_driver"), ("odds_ratio_per_sd", "top_driver_odds_ratio"))] if with_drivers else []
    cells = f"""cells as (select if(util >= 0.60, 'High util (>=60%)', 'Lower util (<60%)') || ' + '
    || if(thin, 'Thin file', 'Established') as cell, {pct('sum(cast(dpd >= 30 as int))', 'count(*)')} as late
  from book group by 1)"""
    by_file = f"""depth as (select coalesce(thin, false) as thin, {pct('sum(cast(dpd >= 30 as int))', 'count(*)')} as late
  from book group by 1)"""
    by_band = f"""banded as (select low, {pct('sum(cast(dpd >= 30 as int))', 'count(*)')} as late
  from book join bands on util > low and coalesce(util <= high, true) group by low)"""
    by_month = f"""months as (select s.statement_month as month, {pct('sum(cast(s.days_past_due >= 30 as int))', 'count(*)')} as late
  from monthly_statements s where exists (select 1 from accounts a where a.account_id = s.account_id) group by 1)"""
    return _book(_grouped("1"), cells, by_file, CLOSED_BANDS, by_band, by_month, DECISION,
                 *(_drivers() if with_drivers else ())) + f"""
select {''.join(c + ', ' for c in top)}p.* exclude (charge_off_balance_pct),
  (select min_by(late, month) from months) as delinquency_trend_start_pct,
  (select max_by(late, month) from months) as delinquency_trend_end_pct,
  (select max_by(late, low) from banded) as high_util_band_delinquency_pct,
  (select max(late) from depth where thin) as thin_file_delinquency_pct,
  (select max(late) from depth where not thin) as established_file_delinquency_pct,
  (select min(cell) from cells where late = (select max(late) from cells)) as worst_segment,
  (select max(late) from cells) as worst_segment_delinquency_pct, x.* exclude (high_risk_co_balance)
from (select {_portfolio()} from g) p, decided x"""


def _trim(table: str, key: str, order: str, flag: str, cols: str) -> str:
    return with_clean() + f"""
select {cols} from (select *, sum(case when {flag} then 1 else 0 end) over (partition by {key} order by {order}
  rows between unbounded preceding and current row) as run_n from {table}) x
where run_n <= 1"""


def model_and_decision_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["segment_assign"] = _segment_assign()
    q["behavior_segments_step"] = _segments_step()
    q["behavior_segments_run"] = _segments_run()
    q["driver_features"] = _driver_features()
    q["driver_gradient"] = _driver_gradient()
    q["cost_benefit"] = _book(DECISION) + "select * from decided"
    q["headline_metrics"] = _headline()
    q["headline_findings"] = _headline(with_drivers=True)
    q["delinquency_drivers"] = _book(*_drivers()) + "select * from drivers"
    sample = _book() + f"""
select acct as account_id, tier as risk_tier, {r_half_up('util', 4)} as utilization, fico as fico_origination,
  income as annual_income, hist as credit_history_months, thin as thin_file, dpd as days_past_due, bal as ending_balance,
  co as charge_off_flag, product as product_id, region as region_id
from book order by md5(concat(acct, '-42')), acct limit """
    q["scored_sample"] = sample + "8000"
    q["scored_sample_500"] = sample + "500"
    q["trim_after_event"] = _trim("events", "user_id", "ts, event_id", "event_type = 'purchase'",
                                  "event_id, ts, user_id, event_type, value, props")
    q["statements_through_chargeoff"] = _trim(
        "monthly_statements", "account_id", "statement_month, statement_id", "charge_off_flag = 1",
        "statement_id, account_id, statement_month, opening_balance, purchase_amount, payment_amount, "
        "ending_balance, minimum_due, days_past_due, charge_off_flag")
    return q
