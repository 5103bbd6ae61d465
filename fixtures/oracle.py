"""The same results in DuckDB SQL, written the direct way: range joins, ranked rows, correlated
subqueries and one branch per case, so that the operators' rewrites are checked against something
of another shape. Rounding is spelt out in whole cents, because averages and quotients of decimals
are floating point there."""

from __future__ import annotations

import re

from cashweave.functions import month_ranges

from .derive import LINES
from .queries import MONTHS

ENTRIES = ", ".join(f"({n}, '{s}', '{t}', {a}, {m}, {r})" for n, (s, t, a, m, r) in enumerate(LINES))


def ratio(num: str, den: str, digits: int = 2) -> str:
    """``num / den`` rounded half up, for whole numbers with ``num >= 0`` and ``den > 0``."""
    scale = 10 ** digits
    return (f"cast((2 * {scale} * cast({num} as hugeint) + {den}) // (2 * {den}) as double)"
            f" / {scale}.0")


def nine(expr: str) -> str:
    """A double to nine significant digits: the last ones depend on the order of summation."""
    return f"cast(format('{{:.8e}}', cast({expr} as double)) as double)"


def cents(expr: str) -> str:
    return f"cast(({expr}) * 100 as hugeint)"


def average(expr: str) -> str:
    """The mean of an amount in currency, rounded to cents."""
    return f"{ratio(f'sum({cents(expr)})', 'count(' + expr + ')', 0)} / 100.0"


def in_months(col: str) -> str:
    return "(" + " or ".join(f"({col} >= date '{a}' and {col} < date '{b}')"
                             for a, b in month_ranges(MONTHS)) + ")"


CTES = {
    "fx_checks": """
        select cast(o_custkey as varchar) employee_id, cast(o_orderdate as date) check_date,
          cast(o_orderkey as varchar) check_number, o_orderkey k,
          concat('payslip_', cast(o_orderkey % 100 as varchar), '.xlsx') source_file,
          cast(o_totalprice as decimal(12,2)) gross_pay,
          cast(cast(o_totalprice as decimal(12,2)) - 350 as decimal(12,2)) net_pay
        from orders""",
    "fx_lines": f"""
        select employee_id, check_date - 14 pay_period_begin, check_date - 1 pay_period_end,
          check_date, check_number, section, description,
          cast(case when description in ('Gross Pay', 'Regular') then gross_pay
            when description = 'Net Pay' then net_pay
            when description = 'Bank A' then net_pay - case when k % 2 = 0 then 100 else 0 end
            else amt end as decimal(12,2)) amount,
          cast(case description when 'Gross Pay' then gross_pay * 2 when 'Net Pay' then net_pay * 2
            else amt * 2 end as decimal(14,2)) ytd,
          case section when 'earnings' then 80.0 end as hours,
          case section when 'earnings' then 12.5 end rate,
          case section when 'earnings' then concat(cast(check_date - 14 as varchar), ' - ',
            cast(check_date - 1 as varchar)) end dates,
          case description when 'Bank A' then 'Checking' when 'Bank B' then 'My Roth IRA' end account_name,
          case section when 'payment_information'
            then concat('****', cast(k % 10000 as varchar)) end account_number,
          row_no, source_file
        from fx_checks join (values {ENTRIES}) v(row_no, section, description, amt, m, r)
          on k % m = r""",
    "fx_raw": """
        select cast(o_custkey as varchar) entity_id, cast(l_shipdate as date) transaction_date,
          p_type category_group, p_brand category_item,
          case when l_returnflag = 'N' and l_linestatus = 'O' then 'fund'
            when l_linenumber = 7 then 'adjustment' else 'expense' end transaction_type,
          concat('Supplier#', cast(l_suppkey as varchar), case l_linenumber when 1 then '   Tulsa OK'
            when 2 then ' Norman' when 3 then ' **** X12' when 4 then '  Main  St' else '' end) merchant,
          case when year(l_shipdate) < 1999 then null
            else concat('acct_', cast(l_suppkey % 3 as varchar)) end account,
          cast(case when l_linenumber = 5 then l_extendedprice else -l_extendedprice end
            as decimal(12,2)) amount,
          case when l_discount = 0 then null else 'n' end note,
          concat('budget_', cast(year(l_shipdate) as varchar), '.csv') source_file
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        union all
        select employee_id, check_date + cast(k % 5 as integer), 'Income',
          concat('Paycheck ', cast(1 + k % 2 as varchar)), 'income', 'Employer', null,
          cast(net_pay - case when k % 2 = 0 then 100 else 0 end
            + case k % 4 when 1 then 20 when 2 then 500 else 0 end as decimal(12,2)),
          null, concat('budget_', cast(year(check_date) as varchar), '.csv')
        from fx_checks where k % 4 <> 3""",
    "fx_txns": r"""
        select *, cast(year(transaction_date) as integer) as year,
          cast(month(transaction_date) as integer) as month,
          strftime(transaction_date, '%Y-%m') year_month,
          case transaction_type when 'fund' then 'transfer' when 'income' then 'income'
            when 'expense' then 'expense' else 'other' end flow_category,
          transaction_type = 'fund' is_transfer,
          category_group = 'Income' and regexp_matches(category_item, '^Paycheck [0-9]+$') is_deposit,
          regexp_replace(regexp_replace(trim(regexp_replace(merchant, '\s+', ' ', 'g')),
            '\s+(Tulsa|Norman|Oklahoma City|Oklahoma Cityok)\s*(OK)?$', ''),
            '\s+\*+\s*\w*$', '') merchant_clean,
          abs(amount) amount_abs
        from fx_raw""",
    "fx_totals": """
        select employee_id, pay_period_begin, pay_period_end, check_date, check_number, source_file,
          max(amount) filter (description = 'Hours Worked') hours_worked,
          max(amount) filter (description = 'Gross Pay') gross_pay,
          max(amount) filter (description = 'Pre Tax Deductions') pre_tax_deductions,
          max(amount) filter (description = 'Employee Taxes') employee_taxes,
          max(amount) filter (description = 'Post Tax Deductions') post_tax_deductions,
          max(amount) filter (description = 'Net Pay') net_pay,
          max(ytd) filter (description = 'Hours Worked') hours_worked_ytd,
          max(ytd) filter (description = 'Gross Pay') gross_pay_ytd,
          max(ytd) filter (description = 'Pre Tax Deductions') pre_tax_deductions_ytd,
          max(ytd) filter (description = 'Employee Taxes') employee_taxes_ytd,
          max(ytd) filter (description = 'Post Tax Deductions') post_tax_deductions_ytd,
          max(ytd) filter (description = 'Net Pay') net_pay_ytd
        from fx_lines where section = 'totals' group by 1, 2, 3, 4, 5, 6""",
    "fx_accounts": """
        select user_id % 10 household_id, user_id account_id,
          concat('Account ', cast(user_id as varchar)) as name,
          case user_id % 8 when 0 then 'checking' when 1 then 'savings' when 2 then 'retirement'
            when 3 then 'hsa' when 4 then 'investment' when 5 then 'cash' when 6 then 'liability'
            else 'vehicle' end account_type,
          concat('Institution ', cast(user_id % 3 as varchar)) institution,
          case when user_id % 11 = 0 then null else user_id % 10 <> 0 end is_active,
          cast(user_id % 20 as integer) display_order
        from (select distinct user_id from events) u""",
    "fx_snapshots": """
        select user_id % 10 household_id, event_id snapshot_id, user_id account_id,
          cast(ts as date) snapshot_date, cast(round(value * 100) as decimal(14,2)) balance,
          cast(null as varchar) note, case when event_id % 7 = 0 then null else ts end entered_at
        from events""",
    "fx_kinds": """
        values ('checking', 'Liquid', 1), ('savings', 'Liquid', 1), ('cash', 'Liquid', 1),
          ('retirement', 'Retirement/Tax-Advantaged', 1), ('hsa', 'Retirement/Tax-Advantaged', 1),
          ('investment', 'Investment', 1), ('liability', 'Liability', -1)""",
    "fx_buckets": """
        select a.*, coalesce(k.bucket, 'Other') bucket, coalesce(k.sign, 1) sign
        from fx_accounts a left join fx_kinds k(account_type, bucket, sign)
          on k.account_type = a.account_type where is_active""",
    "fx_current": """
        select a.household_id, a.account_id, name, account_type, institution, display_order,
          snapshot_date as_of_date, balance, bucket, sign
        from fx_buckets a left join (
          select *, row_number() over (partition by account_id order by snapshot_date desc,
            entered_at desc nulls last, snapshot_id desc) n from fx_snapshots) s
        on s.account_id = a.account_id and n = 1""",
    # One row per date and active account: the balance known then.
    "fx_carried": """
        select d.household_id, d.snapshot_date as_of_date, a.account_id, a.bucket, a.sign,
          (select s.balance from fx_snapshots s where s.account_id = a.account_id
             and s.snapshot_date <= d.snapshot_date
           order by s.snapshot_date desc, s.entered_at desc nulls last, s.snapshot_id desc
           limit 1) balance
        from (select distinct household_id, snapshot_date from fx_snapshots) d
        join fx_buckets a on a.household_id = d.household_id""",
    "fx_carried_all": """
        select d.snapshot_date as_of_date, a.account_id, a.bucket, a.sign,
          (select s.balance from fx_snapshots s where s.account_id = a.account_id
             and s.snapshot_date <= d.snapshot_date
           order by s.snapshot_date desc, s.entered_at desc nulls last, s.snapshot_id desc
           limit 1) balance
        from (select distinct snapshot_date from fx_snapshots) d cross join fx_buckets a""",
    "fx_history": """
        select as_of_date, cast(sum(sign * balance) as double) net_worth,
          cast(sum(case bucket when 'Liquid' then balance else 0 end) as double) liquid,
          cast(sum(if(bucket like 'Retirement%', balance, 0)) as double) retirement,
          cast(sum(case bucket when 'Investment' then balance else 0 end) as double) investments
        from fx_carried_all where balance is not null group by 1""",
    "fx_history_keyed": """
        select household_id, as_of_date, cast(sum(sign * balance) as double) net_worth,
          cast(sum(case bucket when 'Liquid' then balance else 0 end) as double) liquid,
          cast(sum(if(bucket like 'Retirement%', balance, 0)) as double) retirement,
          cast(sum(case bucket when 'Investment' then balance else 0 end) as double) investments
        from fx_carried where balance is not null group by 1, 2""",
}


def _category_sql(keys: str = "") -> str:
    return f"""
        select {keys} year_month, year, month, category_group, category_item,
          count(*) transaction_count, cast(sum(amount_abs) as double) total_spent,
          {average('amount_abs')} avg_transaction,
          {ratio(f"sum({cents('amount_abs')}) * 100", f"sum(sum({cents('amount_abs')})) over (partition by {keys} year_month)")} pct_of_month
        from fx_txns where flow_category = 'expense'
        group by {keys} year_month, year, month, category_group, category_item"""


CTES["fx_categories"] = _category_sql()


def _savings_sql(keys: str = "") -> str:
    on = f"using ({keys} check_date)"

    def part(name: str, condition: str) -> str:
        return (f"left join (select {keys} check_date, sum(amount) {name} from fx_lines"
                f" where {condition} group by {keys} check_date) {on}")

    own = "coalesce(pre, 0) + coalesce(post, 0) + coalesce(roth, 0)"
    return f"""
        select {keys} check_date, strftime(check_date, '%Y-%m') year_month,
          cast(gross_pay as double) gross_pay, cast(net_pay as double) net_pay,
          cast(coalesce(pre, 0) as double) pretax_savings,
          cast(coalesce(post, 0) as double) posttax_savings,
          cast(coalesce(roth, 0) as double) roth_ira_deposit,
          cast(coalesce(emp, 0) as double) employer_contributions,
          {ratio(cents(own) + ' * 100', cents('gross_pay'))} savings_rate_pct,
          {ratio(cents(own + ' + coalesce(emp, 0)') + ' * 100', cents('gross_pay'))} total_savings_rate_pct
        from fx_totals
        {part('pre', "section = 'pre_tax_deductions' and description in ('401(k) Pre-tax', 'Health Savings Account-employee (HHSAEE)')")}
        {part('post', "section = 'post_tax_deductions' and description = '401(k) Roth'")}
        {part('roth', "section = 'payment_information' and lower(account_name) like '%roth ira%'")}
        {part('emp', "section = 'employer_paid_benefits'")}"""


CTES["fx_savings"] = _savings_sql()


def _recon_sql(keyed: bool) -> str:
    key, select_key = ("employee_id", "employee_id,") if keyed else ("1", "")
    t_key = "entity_id" if keyed else "1"
    return f"""
        with days as (select {t_key} k, transaction_date d, sum(amount) income from fx_txns
            where is_deposit group by 1, 2),
          c as (select distinct {key} k, check_date from fx_totals),
          near as (select c.k, c.check_date, sum(income) income from c join days on days.k = c.k
            and d between c.check_date - 5 and c.check_date + 5 group by 1, 2),
          paid as (select {key} k, check_date,
              sum(case when lower(account_name) not like '%roth ira%' then amount end) budgeted,
              sum(case when lower(account_name) like '%roth ira%' then amount end) roth
            from fx_lines where section = 'payment_information' group by 1, 2)
        select {select_key} check_number, t.check_date, cast(gross_pay as double) gross_pay,
          cast(net_pay as double) net_pay, cast(coalesce(budgeted, 0) as double) budgeted_deposits,
          cast(coalesce(roth, 0) as double) roth_ira_deposit,
          cast(pre_tax_deductions as double) pre_tax_deductions,
          cast(employee_taxes as double) employee_taxes,
          cast(post_tax_deductions as double) post_tax_deductions,
          cast(income as double) income_near_check,
          cast(coalesce(budgeted, 0) - coalesce(income, 0) as double) variance,
          case when income is null then 'MISSING' when abs(coalesce(budgeted, 0) - income) < 1 then 'MATCH'
            when abs(coalesce(budgeted, 0) - income) < 50 then 'Minor variance' else 'INVESTIGATE' end status
        from fx_totals t
        left join near on near.k = {('t.' if keyed else '') + key} and near.check_date = t.check_date
        left join paid on paid.k = {('t.' if keyed else '') + key} and paid.check_date = t.check_date"""


def _edges_sql(key: str = "", where_pay: str = "true", where_txn: str = "true") -> str:
    """One branch per kind of edge."""
    k, t = (f"{key}, ", f"entity_id {key}, ") if key else ("", "")
    g, gt = (f"{key}, ", "entity_id, ") if key else ("", "")
    dates = "min(check_date) first_date, max(check_date) last_date"
    spent = "min(transaction_date), max(transaction_date)"
    branches = [
        f"select {k}'Gross Pay' source_node, description target_node, cast(sum(amount) as double) amount,"
        f" 1 as level, 'paycheck' flow_type, {dates} from fx_lines where section = '{s}' and {where_pay}"
        f" group by {g}description"
        for s in ("employee_taxes", "pre_tax_deductions", "post_tax_deductions")]
    branches.append(f"select {k}'Gross Pay', 'Take-Home', cast(sum(net_pay) as double), 1, 'paycheck',"
                    f" {dates} from fx_totals where {where_pay}" + (f" group by {key}" if key else ""))
    branches.append(f"select {t}'Take-Home', category_group, cast(sum(amount_abs) as double), 2, 'spending',"
                    f" {spent} from fx_txns where flow_category = 'expense' and {where_txn}"
                    f" group by {gt}category_group")
    branches.append(f"select {t}category_group, category_item, cast(sum(amount_abs) as double), 3,"
                    f" 'spending', {spent} from fx_txns where flow_category = 'expense' and {where_txn}"
                    f" group by {gt}category_group, category_item")
    return " union all ".join(branches)


CTES["fx_edges"] = _edges_sql()


def _steps_sql(detail: bool) -> str:
    """Waterfall steps: part of the chart, then the amount within it."""
    pay = "select 0 part, 'Gross Pay' as label, sum(gross_pay) amount, 'absolute' measure from fx_totals"
    total = " union all select 4, 'Take-Home', 0, 'total'"
    if detail:
        ded = "".join(f" union all select {n}, description, -sum(amount), 'relative' from fx_lines"
                      f" where section = '{s}' group by description"
                      for n, s in enumerate(("employee_taxes", "pre_tax_deductions",
                                             "post_tax_deductions"), 1))
        ded += (" union all select 5, category_group, -sum(amount_abs), 'relative' from fx_txns"
                " where flow_category = 'expense' group by category_group"
                " union all select 6, 'Remaining', 0, 'total'")
    else:
        ded = "".join(f" union all select {n}, '{label}', -sum({c}), 'relative' from fx_totals"
                      for n, (label, c) in enumerate([("Taxes", "employee_taxes"),
                                                      ("Pre-Tax Ded.", "pre_tax_deductions"),
                                                      ("Post-Tax Ded.", "post_tax_deductions")], 1))
    order = "order by part, amount, label"
    return f"""select cast(row_number() over ({order}) as integer) step, label,
        cast(amount as double) amount, measure,
        cast(sum(amount) over ({order} rows unbounded preceding) as double) balance
        from ({pay}{total}{ded})"""


def _fit_sql(history: str, key: str = "", exponential: bool = True) -> str:
    """Least squares on whole days in log space where that is possible, from exact sums of integers."""
    k = f"{key}, " if key else ""
    by = f"partition by {key}" if key else ""
    group = f"group by {key}" if key else ""
    can = "min(y) over w > 0" if exponential else "false"
    label = ("case when logs then 'Exponential Fit' else 'Linear Fit (exponential unavailable)' end"
             if exponential else "'Linear Fit'")
    return f"""
        with s0 as (select {k}as_of_date, cast(liquid + retirement + investments as double) y from {history}),
          s1 as (select {k}as_of_date, y, {can} logs, cast(as_of_date - date '2000-01-01' as hugeint) x,
            cast(min(as_of_date) over w - date '2000-01-01' as hugeint) x0 from s0 window w as ({by})),
          s2 as (select *, cast(case when logs then floor(ln(y) * 1000000000000.0::double + 0.5)
            else floor(y * 10000.0::double + 0.5) end as hugeint) v from s1),
          s3 as (select {k}cast(count(*) as hugeint) n, min(as_of_date) first_date, max(as_of_date) last_date,
            arg_max(y, as_of_date) last_y, any_value(logs) logs, any_value(x0) x0, sum(x) sx, sum(v) sv, sum(x * x) sxx,
            sum(x * v) sxv, sum(v * v) svv from s2 {group}),
          s4 as (select *, case when logs then 1000000000000.0::double else 10000.0::double end unit,
            cast(n * sxx - sx * sx as double) dxx, cast(n * sxv - sx * sv as double) dxv,
            cast(n * svv - sv * sv as double) dvv, cast(sx - n * x0 as double) / cast(n as double) mean_x from s3 where n >= 2),
          f as (select {k}cast(n as bigint) n, first_date, last_date, last_y, logs,
            cast(last_date - first_date as double) span, mean_x, cast(sv as double) / cast(n as double) / unit mean_y,
            dxv / dxx / unit slope,
            sqrt(greatest(dvv - dxv * dxv / dxx, 0.0::double)) / cast(n as double) / unit resid from s4),
          m as (select *, {label} model, greatest(resid, case when logs then 0.05::double else mean_y * 0.05::double end) sigma
            from f)"""


def _forecast_sql(history: str, key: str = "", exponential: bool = True, width: int = 15) -> str:
    k = f"{key}, " if key else ""
    return _fit_sql(history, key, exponential) + f""",
          g as (select m.*, cast(i as integer) point,
            case when i = 199 then span + 365 else i * ((span + 365) / 199) end x from m, range(200) t(i)),
          p as (select *, mean_y + slope * (x - mean_x) line, sigma * {width} / 15.0 spread from g),
          b as (select *, case when logs then exp(line) else line end predicted,
            spread * 2 * case when model = 'Linear Fit'
              then greatest(1, 1 + (x - span) / greatest(span, 1) * 0.5) else 1 end half from p)
        select {k}point, round(x, 6) x, first_date + cast(floor(x) as integer) as_of_date, model,
          {nine('predicted')} predicted,
          {nine('case when logs then predicted / exp(spread * 1.5) else predicted - half end')} as lower,
          {nine('case when logs then predicted * exp(spread * 1.5) else predicted + half end')} as upper,
          x > span is_future
        from b"""


RAW_COLUMNS = ("category_group, category_item, transaction_type, transaction_date, merchant, account,"
               " cast(amount as double) amount, note")
CHECK = "employee_id, pay_period_begin, pay_period_end, check_date, check_number, source_file"
LINE_AMOUNTS = "description, cast(amount as double) amount, cast(ytd as double) ytd"


def money(expr: str) -> str:
    return f"'$' || format('{{:,.2f}}', cast({expr} as double))"


# The payslip grid of each check, by sheet row; the section of a data row and its opening row.
_DATE = "strftime(check_date, '%m/%d/%Y')"
_GRID = [
    ("'Payslip Information|||'", "", 0, ""),
    ("'Employee ID|Pay Period Begin|Pay Period End|Check Date|Check Number'", "", 0, ""),
    (f"employee_id || '|' || strftime(check_date - 14, '%m/%d/%Y') || '|' ||"
     f" strftime(check_date - 1, '%m/%d/%Y') || '|' || {_DATE} || '|' || check_number", "", 0, ""),
    ("''", "", 0, ""),
    ("'Current and YTD Totals'", "", 0, ""),
    ("'Balance Period|Hours Worked|Gross Pay|Net Pay'", "", 0, ""),
    (f"'Current|80|' || {money('gross_pay')} || '|' || {money('net_pay')}", "totals", 4, 5),
    (f"'YTD||' || {money('gross_pay * 2')} || '|' || {money('net_pay * 2')}", "totals", 4, 5),
    ("' Earnings '", "", 0, ""),
    ("'Description|Dates|Hours|Rate|Amount'", "", 0, ""),
    (f"'Regular|' || {_DATE} || '|80|12.5|' || {money('gross_pay')}", "earnings", 8, 9),
    ("''", "", 0, ""),
    ("'Employee Taxes'", "", 0, ""),
    ("'Description|Amount|YTD|YTD'", "", 0, ""),
    ("'OASDI|120.00|1.00|240.00'", "employee_taxes", 12, 13),
    ("'Adjustment|(5.25)'", "employee_taxes", 12, 13),
    ("'Pre Tax Deductions'", "", 0, ""),
    ("'Description|Amount'", "", 0, ""),
    ("'Dental|n/a'", "pre_tax_deductions", 16, 17),
    ("'Payment Information'", "", 0, ""),
    ("'Bank|Account Name|Account Number|Amount in Pay Group Currency'", "", 0, ""),
    (f"'Bank A|Checking|****1|' || {money('net_pay')}", "payment_information", 19, 20),
]


def _pad(text: str) -> str:
    return f"{text} || repeat('|', cast(4 - length({text}) + length(replace({text}, '|', '')) as integer))"


def _grid_sql() -> str:
    """Sheet rows 16 to 18 exist on even checks only, so later rows move up on odd ones."""
    parts = []
    for n, (text, section, start, header) in enumerate(_GRID):
        where = "where k % 2 = 0" if n in (16, 17, 18) else ""

        def at(r):
            return f"{r} - case when k % 2 = 1 then 3 else 0 end" if r > 18 else str(r)
        head = _pad(_GRID[header][0]) if section else "null"
        parts.append(f"select concat('payslip_', check_number, '.xlsx') source_file,"
                     f" cast({at(n)} as integer) row_no, {_pad(text)} cells, '{section}' section,"
                     f" cast({at(start)} as integer) as start, {head} headers from fx_checks {where}")
    return " union all ".join(parts)


CTES["fx_grid"] = _grid_sql()

_FILE = "concat('payslip_', check_number, '.xlsx') source_file"
_NULLS = ("cast(null as double) as hours, cast(null as double) rate, cast(null as varchar) dates,"
          " cast(null as varchar) account_name, cast(null as varchar) account_number")
CTES["fx_sheet_totals"] = " union all ".join(
    f"select employee_id, check_date, check_number, 'totals' section, '{d}' description,"
    f" cast({a} as double) amount, cast({y} as double) ytd, {_NULLS}, 0 fields from fx_checks"
    for d, a, y in (("Hours Worked", "80", "null"), ("Gross Pay", "gross_pay", "gross_pay * 2"),
                    ("Net Pay", "net_pay", "net_pay * 2")))
CTES["fx_sheet_lines"] = f"""
    select employee_id, check_date, check_number, 'earnings' section, 'Regular' description,
      cast(gross_pay as double) amount, cast(null as double) ytd, cast(80 as double) as hours,
      cast(12.5 as double) rate, {_DATE} dates, cast(null as varchar) account_name,
      cast(null as varchar) account_number, 5 fields from fx_checks
    union all select employee_id, check_date, check_number, 'employee_taxes', 'OASDI', 120, 240,
      {_NULLS}, 3 from fx_checks
    union all select employee_id, check_date, check_number, 'employee_taxes', 'Adjustment', -5.25, null,
      {_NULLS}, 3 from fx_checks
    union all select employee_id, check_date, check_number, 'pre_tax_deductions', 'Dental', null, null,
      {_NULLS}, 2 from fx_checks where k % 2 = 0
    union all select employee_id, check_date, check_number, 'payment_information', 'Bank A',
      cast(net_pay as double), null, null, null, null, 'Checking', '****1', 4 from fx_checks"""

_PRINTED = """case when note is null and amount < 0 then '(' || format('{:,.2f}', cast(-amount as double)) || ')'
    when note is null then '$' || format('{:,.2f}', cast(amount as double)) else cast(amount as varchar) end"""
_PER_FILE = "count(*) \"rows\", cast(sum(amount) as double) amount, count(account) with_account"
_PAY_SUM = ("cast(sum(gross_pay) as double) gross, cast(sum(employee_taxes) as double) taxes,"
            " cast(sum(pre_tax_deductions) as double) pretax,"
            " cast(sum(post_tax_deductions) as double) posttax, cast(sum(net_pay) as double) net")
_SEARCH = ("select transaction_date, category_group, category_item, merchant_clean,"
           " cast(amount as double) amount, cast(amount_abs as double) amount_abs, flow_category, note"
           " from fx_txns where ")


def _cashflow_sql(keys: str = "") -> str:
    return f"""select {keys} year_month, year, month, flow_category, count(*) transaction_count,
        cast(sum(amount_abs) as double) total_amount, {average('amount_abs')} avg_transaction,
        cast(max(amount_abs) as double) max_transaction, count(distinct category_item) unique_categories
        from fx_txns where not is_transfer group by {keys} year_month, year, month, flow_category"""


def _breakdown_sql(key: str = "") -> str:
    sections = {"employee_taxes": ("tax_", "Employee Taxes"),
                "pre_tax_deductions": ("pretax_", "Pre-Tax Deductions"),
                "post_tax_deductions": ("posttax_", "Post-Tax Deductions"),
                "payment_information": ("deposit_", "Net Deposits"),
                "employer_paid_benefits": ("employer_", "Employer Benefits")}
    return (f"select {key} check_date, 'gross_pay' bucket, 'Gross Pay' bucket_label, 'Gross' bucket_group,"
            " cast(gross_pay as double) amount from fx_totals" + "".join(
                f" union all select {key} check_date, '{p}' || lower(replace(description, ' ', '_')),"
                f" description, '{g}', cast(amount as double) from fx_lines where section = '{s}'"
                for s, (p, g) in sections.items()))


def _summary_sql(key: str = "") -> str:
    def part(bucket: str, name: str) -> str:
        return f"cast(sum(case bucket when '{bucket}' then balance else 0 end) as double) {name}"
    return f"""select {key + ',' if key else ''}
        cast(sum(sign * balance) as double) net_worth,
        {part('Liquid', 'liquid_cash')}, {part('Retirement/Tax-Advantaged', 'retirement_total')},
        {part('Investment', 'investments')}, {part('Liability', 'liabilities')},
        max(as_of_date) latest_snapshot_date from fx_current {'group by ' + key if key else ''}"""


CTES["fx_breakdown"] = _breakdown_sql()
CTES["fx_recon_keyed"] = _recon_sql(True)

BODIES: dict[str, str] = {
    "a1_transactions_csv": f"select {RAW_COLUMNS} from fx_raw",
    "a2_csv_layouts": """
        select case when account is null then 'old' else 'new' end layout,
          case when account is null then 'Group,Item,Type,Date,Merchant,Amount,Note'
            else 'Note,Amount,Account,Merchant,Date,Type,Item,Group' end as header, count(*) "rows"
        from fx_raw group by 1, 2""",
    "a6_clean_transactions": """
        select category_group, category_item, transaction_type,
          case when transaction_type = 'adjustment' and note is null then null else transaction_date end transaction_date,
          merchant, account, case when transaction_type = 'adjustment' and note is not null then null
            else cast(amount as double) end amount, note from fx_raw""",
    "a6_rejected_transactions": """
        select transaction_type "Type", case when note is null then 'unreadable date'
          else 'unreadable amount' end reason, count(*) "rows"
        from fx_raw where transaction_type = 'adjustment' group by 1, 2""",
    "a7_payslip_grids": "select source_file, row_no, cells from fx_grid",
    "a8_payslip_meta": f"""
        select {_FILE}, employee_id, check_date - 14 pay_period_begin, check_date - 1 pay_period_end,
          check_date, check_number from fx_checks""",
    "a9_payslip_sections": """
        select source_file, row_no, section, start, headers, cells as "values"
        from fx_grid where section <> ''""",
    "a10_payslip_totals": f"select {_FILE}, check_number, description, amount, ytd from fx_sheet_totals",
    "a11_payslip_lines": f"""
        select {_FILE}, section, description, amount, ytd, hours, rate, dates, account_name,
          account_number, fields payload_fields from fx_sheet_lines""",
    "a12_parse_money": f"select distinct {_PRINTED} \"Amount\", cast(amount as double) parsed from fx_raw",
    "a13_payroll_bronze": f"""
        select {_FILE}, check_date - 14 pay_period_begin, check_date - 1 pay_period_end,
          s.* exclude (fields) from (select * from fx_sheet_totals union all select * from fx_sheet_lines) s""",
    "a4_empty_source": f"select {RAW_COLUMNS} from fx_raw where account is null",
    "a5_provenance": """
        select cast(year(transaction_date) as varchar) budget_year, true is_named_and_stamped, count(*) "rows"
        from fx_raw group by 1""",
    "a14_replace_one_file": """
        with kept as (select source_file, account,
            case when source_file = 'budget_1996.csv' then -amount else amount end amount
          from fx_raw where source_file <> 'budget_1996.csv' or transaction_type <> 'fund')
        select source_file, count(*) "rows", count(account) with_account, cast(sum(amount) as double) amount,
          cast(case when source_file = 'budget_1996.csv' then 2 else 1 end as bigint) loads, count(*) current_rows
        from kept group by source_file""",
    "a17_gold_refresh_keyed": " union all ".join(
        f"""select '{gold}' gold, {key} employee_id, count(*) "rows",
              cast(sum(cast({total} as decimal(20,2))) as double) total from ({body}) group by 2"""
        for gold, key, total, body in (
            ("monthly_cashflow", "entity_id", "total_amount", _cashflow_sql("entity_id,")),
            ("spending_by_category", "entity_id", "total_spent", _category_sql("entity_id,")),
            ("paycheck_breakdown", "employee_id", "amount", _breakdown_sql("employee_id,")),
            ("paycheck_reconciliation", "employee_id", "variance", "select * from fx_recon_keyed"),
            ("money_flow_edges", "employee_id", "amount", _edges_sql("employee_id")),
            ("savings_rate", "employee_id", "pretax_savings", _savings_sql("employee_id,")))),
    "a20_delete_from_stored": """
        select snapshot_id, account_id, snapshot_date, cast(balance as double) balance
        from fx_snapshots where entered_at is not null and account_id % 13 <> 0""",
    "a14_replace_by_file": """
        select source_file, count(*) "rows", count(account) with_account,
          cast(sum(amount) * case when source_file >= 'budget_1998.csv' then 2 else 1 end as double) amount
        from fx_raw group by source_file""",
    "a15_schema_evolution": """
        select source_file, count(*) "rows", cast(sum(amount) as double) amount,
          case when source_file < 'budget_2000.csv' then 0 else count(account) end with_account
        from fx_raw group by source_file""",
    "a16_full_refresh": "select * from fx_categories",
    "a18_insert_missing": """
        select cast(account_id as varchar) account_id, name, account_type, institution,
          true is_active, display_order from fx_accounts
        where account_id not in (select account_id from fx_accounts where is_active)""",
    "a19_new_snapshots": """
        select cast(c_custkey as varchar) account_id, date '2024-02-01' snapshot_date, c_acctbal balance,
          c_mktsegment note, true is_stamped from customer where c_acctbal > 0""",
    "a20_delete_by_key": """
        select snapshot_id, account_id, snapshot_date, cast(balance as double) balance
        from fx_snapshots where entered_at is not null""",
    "a21_new_accounts": """
        with r as (select p_name || ' No. ' || cast(p_size as varchar) as name, p_brand institution from part),
          i as (select name, institution, 'acct_' || regexp_replace(substr(replace(lower(name), ' ', '_'), 1, 20),
            '[^a-z0-9_]', '', 'g') account_id from r)
        select account_id || case when n > 1 then '-' || n else '' end account_id, name, 'cash' account_type, institution,
          true is_active
        from (select *, row_number() over (partition by account_id order by name, institution) n from i)""",
    "a21_refused_accounts": """
        select name, account_type, institution,
          case when p_size % 7 = 1 then 'blank name' else 'unknown account type' end reason
        from (select case when p_size % 7 = 1 then '  ' else p_name end as name, p_size, p_brand institution,
                case when p_size % 7 = 2 then 'boat' when p_size % 7 <> 3 then 'cash' end account_type from part)
        where p_size % 7 in (1, 2, 3)""",
    "a22_scan": """
        select * from fx_categories where year = 1996
        order by total_spent desc, year_month, category_group, category_item limit 100""",
    "b1_direction": """
        select case when amount > 0 then 'inflow' when amount < 0 then 'outflow' else 'zero' end direction,
          count(*) "rows", cast(sum(abs(amount)) as double) amount_abs from fx_raw group by 1""",
    "b2_b3_flow_category": """
        select transaction_type, is_transfer, flow_category, count(*) "rows" from fx_txns group by 1, 2, 3""",
    "b4_date_parts": """
        select distinct transaction_date, year, month, year_month,
          cast(weekofyear(transaction_date) as integer) week_of_year, dayname(transaction_date) day_of_week,
          cast(day(transaction_date) as integer) day_of_month from fx_txns""",
    "b5_merchant_clean": "select merchant, merchant_clean, count(*) \"rows\" from fx_txns group by 1, 2",
    "b6_paycheck_deposit": """
        select category_group, is_deposit is_paycheck_deposit, count(*) "rows" from fx_txns group by 1, 2""",
    "b7_transaction_key": """
        select sha256(concat_ws('||', cast(transaction_date as varchar), category_group, category_item,
          merchant, cast(amount as varchar), source_file)) transaction_key, count(*) "rows"
        from fx_raw group by 1""",
    "b8_clean_silver": """
        select sha256(concat_ws('||', cast(transaction_date as varchar), category_group, category_item,
            merchant, cast(amount as varchar), source_file)) transaction_key, transaction_date, year, month,
          year_month, cast(weekofyear(transaction_date) as integer) week_of_year,
          dayname(transaction_date) day_of_week, cast(day(transaction_date) as integer) day_of_month,
          category_group, category_item, transaction_type, flow_category,
          case when amount > 0 then 'inflow' when amount < 0 then 'outflow' else 'zero' end direction,
          is_transfer, is_deposit is_paycheck_deposit, merchant merchant_raw, merchant_clean,
          cast(amount as double) amount, cast(amount_abs as double) amount_abs, note, source_file, account
        from fx_txns""",
    **{f"b9_{s}": f"select {CHECK}, {LINE_AMOUNTS} from fx_lines where section = '{s}'"
       for s in ("employee_taxes", "pre_tax_deductions", "post_tax_deductions",
                 "employer_paid_benefits", "taxable_wages", "withholding")},
    "b9_earnings": f"""
        select {CHECK}, {LINE_AMOUNTS}, cast(hours as double) as hours, cast(rate as double) rate,
          dates date_range from fx_lines where section = 'earnings'""",
    "b10_payments": f"""
        select {CHECK}, description bank, account_name, account_number account_number_masked,
          cast(amount as double) deposit_amount from fx_lines where section = 'payment_information'""",
    "b12_b13_account_bucket": """
        select account_id, bucket, cast(sign * balance as double) signed_balance from fx_current""",
    "e1_monthly_cashflow": _cashflow_sql(),
    "e1_monthly_cashflow_keyed": _cashflow_sql("entity_id,"),
    "e2_spending_by_category": "select * from fx_categories",
    "e2_spending_by_category_keyed": _category_sql("entity_id,"),
    "e3_paycheck_totals": f"select {CHECK}, " + ", ".join(
        f"cast({m}{y} as double) {m}{y}" for m in ("hours_worked", "gross_pay", "pre_tax_deductions",
                                                   "employee_taxes", "post_tax_deductions", "net_pay")
        for y in ("", "_ytd")) + " from fx_totals",
    "t4_dedupe_checks": """
        select * exclude (row_no, source_file, amount, ytd, hours, rate),
          cast(amount as double) amount, cast(ytd as double) ytd, cast(hours as double) as hours,
          cast(rate as double) rate, case when cast(check_number as bigint) % 4 = 0
            then 'again_' || source_file else source_file end source_file from fx_lines""",
    "e4_paycheck_breakdown": "select * from fx_breakdown",
    "e4_paycheck_breakdown_keyed": _breakdown_sql("employee_id,"),
    "e5_deposits_per_check_date": """
        select check_date, cast(sum(case when lower(account_name) not like '%roth ira%' then amount end) as double) budgeted_total,
          cast(sum(case when lower(account_name) like '%roth ira%' then amount end) as double) roth_ira_amount
        from fx_lines where section = 'payment_information' group by 1""",
    "e6_daily_paycheck_income": """
        select transaction_date, cast(sum(amount) as double) income from fx_txns where is_deposit group by 1""",
    "j3_sum_within_days": """
        select check_number, check_date, cast((select sum(amount) from fx_txns x where is_deposit
          and x.transaction_date between t.check_date - 5 and t.check_date + 5) as double) income_near
        from fx_totals t""",
    "j3_sum_within_days_keyed": """
        select employee_id, check_number, check_date, cast((select sum(amount) from fx_txns x where is_deposit
          and x.entity_id = t.employee_id
          and x.transaction_date between t.check_date - 30 and t.check_date + 30) as double) income_near
        from fx_totals t""",
    "e7_paycheck_reconciliation": _recon_sql(False),
    "e7_paycheck_reconciliation_keyed": _recon_sql(True),
    "r19_reconciliation_kpis": """
        select count(*) total_checks, count(*) filter (status = 'MATCH') clean_matches,
          count(*) filter (status = 'INVESTIGATE' or status = 'MISSING') need_attention from fx_recon_keyed""",
    "e8_money_flow_edges": "select * from fx_edges",
    "e8_money_flow_edges_keyed": _edges_sql("employee_id"),
    "r4_money_flow": "select source_node, target_node, amount, level from fx_edges where amount > 0",
    "r4_money_flow_months": f"""
        select source_node, target_node, amount, level from ({_edges_sql('', in_months('check_date'),
            in_months('transaction_date'))}) where amount > 0 and level < 3""",
    "e9_savings_rate": "select * from fx_savings",
    "e9_savings_rate_keyed": _savings_sql("employee_id,"),
    "e10_net_worth_summary": _summary_sql(),
    "e10_net_worth_summary_keyed": _summary_sql("household_id"),
    "e11_net_worth_history": "select * from fx_history",
    "e11_net_worth_history_keyed": "select * from fx_history_keyed",
    "e12_flow_summary": """
        select year_month, flow_category, count(*) txn_count, cast(sum(amount_abs) as double) total_abs
        from fx_txns group by 1, 2""",
    "e12_top_expense_categories": """
        select category_group, category_item, count(*) txn_count, cast(sum(amount_abs) as double) total_spent
        from fx_txns where flow_category = 'expense' group by 1, 2 order by 4 desc, 1, 2 limit 15""",
    "e13_load_report": "select source_file, account, count(*) \"rows\" from fx_raw group by 1, 2",
    "g3_newest_transactions": f"""
        select {RAW_COLUMNS}, source_file from fx_raw
        order by transaction_date desc, source_file, category_group, category_item, merchant, fx_raw.amount
        limit 20""",
    "g3_newest_payroll_lines": """
        select check_date, section, description, check_number, cast(amount as double) amount from fx_lines
        order by check_date desc, section, description, check_number limit 40""",
    "j5_latest_balances": """
        select * exclude (household_id, balance, sign), cast(balance as double) balance from fx_current""",
    "j6_as_of_probes": """
        with d as (select account_id, snapshot_date, balance, row_number() over (
            partition by account_id, snapshot_date order by entered_at desc nulls last, snapshot_id desc) n from fx_snapshots),
          p as (select event_id, user_id account_id, cast(ts as date) + cast(event_id % 11 - 5 as integer) as_of_date
            from events),
          s as (select event_id, max(snapshot_date) snapshot_date from p join d using (account_id)
            where n = 1 and snapshot_date <= as_of_date group by event_id)
        select p.account_id, p.as_of_date, cast(d.balance as double) balance, s.snapshot_date
        from p left join s using (event_id)
          left join d on d.account_id = p.account_id and d.snapshot_date = s.snapshot_date and d.n = 1""",
    "j6_net_worth_as_of": """
        with p as (select event_id, user_id % 10 household_id, cast(ts as date) + cast(event_id % 11 - 5 as integer) as_of_date
            from events),
          s as (select event_id, max(h.as_of_date) known from p join fx_history_keyed h using (household_id)
            where h.as_of_date <= p.as_of_date group by event_id)
        select p.household_id, p.as_of_date, net_worth, liquid, retirement, investments
        from p left join s using (event_id)
          left join fx_history_keyed h on h.household_id = p.household_id and h.as_of_date = s.known""",
    "j6_as_of_balances": """
        with d as (select s.account_id, account_type, snapshot_date, balance, row_number() over (
            partition by s.account_id, snapshot_date order by entered_at desc nulls last, snapshot_id desc) n
          from fx_snapshots s join fx_buckets a on a.account_id = s.account_id)
        select account_id, account_type, snapshot_date valid_from, (select min(e.snapshot_date) from d e
          where e.account_id = d.account_id and e.snapshot_date > d.snapshot_date) valid_to,
          cast(balance as double) balance from d where n = 1""",
    "r1_table_counts": f"""
        select 'Cashflow records' metric, (select count(*) from ({_cashflow_sql()})) as "value"
        union all select 'Spending categories tracked', (select count(*) from fx_categories)
        union all select 'Paychecks loaded', (select count(*) from fx_totals)
        union all select 'Sankey flow edges', (select count(*) from fx_edges)""",
    "r3_available_months": """
        select year_month from fx_txns union select strftime(check_date, '%Y-%m') from fx_totals""",
    "r5_pay_totals": f"select {_PAY_SUM} from fx_totals",
    "r5_pay_totals_months": f"select {_PAY_SUM} from fx_totals where {in_months('check_date')}",
    **{f"r6_deduction_breakdown_{s}": f"""
        select description, cast(sum(amount) as double) amount from fx_lines where section = '{s}' group by 1"""
       for s in ("employee_taxes", "pre_tax_deductions", "post_tax_deductions")},
    "r7_spending_by_group": """
        select category_group, cast(sum(amount_abs) as double) amount from fx_txns
        where flow_category = 'expense' group by 1""",
    "r7_spending_by_group_months": f"""
        select category_group, cast(sum(amount_abs) as double) amount from fx_txns
        where flow_category = 'expense' and year_month in {tuple(MONTHS)} group by 1""",
    "r8_waterfall_summary": _steps_sql(False),
    "r8_waterfall_detail": _steps_sql(True),
    "r9_pay_summary": f"""
        select cast(sum(gross_pay) as double) total_gross, cast(sum(net_pay) as double) total_net,
          cast(sum(employee_taxes + pre_tax_deductions + post_tax_deductions) as double) total_deductions,
          {ratio(f"sum({cents('employee_taxes + pre_tax_deductions + post_tax_deductions')}) * 100",
                 f"sum({cents('gross_pay')})", 4)} effective_rate,
          {ratio(f"sum({cents('net_pay')}) * 100", f"sum({cents('gross_pay')})", 4)} take_home_rate,
          count(distinct check_date) paychecks from fx_totals""",
    "r10_spending_kpis": f"""
        with c as (select *, {cents('total_spent')} c from fx_categories)
        select cast(sum(c) as double) / 100 total, {ratio('sum(c)', 'count(*)')} / 100 avg_rough,
          count(distinct year_month) as months, count(distinct category_item) unique_items,
          cast(sum(transaction_count) as bigint) txns,
          {ratio('sum(c)', 'count(distinct year_month) * 100', 4)} monthly_average,
          {ratio('sum(c)', 'count(*) * 100', 4)} avg_category from c""",
    "r11_spending_mix": f"""
        select category_group, cast(sum(amount_abs) as double) total_spent,
          {ratio(f"sum({cents('amount_abs')}) * 100", f"sum(sum({cents('amount_abs')})) over ()", 4)} pct
        from fx_txns where flow_category = 'expense' group by 1""",
    "r12_top_categories": """
        select category_group, category_item, cast(sum(amount_abs) as double) total_spent
        from fx_txns where flow_category = 'expense' group by 1, 2 order by 3 desc, 1, 2 limit 15""",
    "r12_top_categories_months": f"""
        select category_group, category_item, cast(sum(amount_abs) as double) total_spent
        from fx_txns where flow_category = 'expense' and year_month in {tuple(MONTHS)}
        group by 1, 2 order by 3 desc, 1, 2 limit 25""",
    "r13_spending_trend": """
        select year_month, category_group, cast(sum(amount_abs) as double) total_spent
        from fx_txns where flow_category = 'expense' group by 1, 2""",
    "r14_spending_detail": """
        select year_month, category_group, category_item, transaction_count, total_spent, pct_of_month
        from fx_categories""",
    "r15_paycheck_kpis": f"""
        select count(*) check_count, cast(sum({cents('gross_pay')}) as double) / 100 total_gross,
          cast(sum({cents('net_pay')}) as double) / 100 total_net,
          {ratio(f"sum(cast(round(savings_rate_pct * 100) as hugeint))", 'count(*) * 100', 4)} avg_savings_rate,
          {ratio(f"sum(cast(round(total_savings_rate_pct * 100) as hugeint))", 'count(*) * 100', 4)} avg_total_savings_rate
        from fx_savings""",
    "r16_paycheck_composition": f"""
        select check_date, bucket_group, cast(sum({cents('amount')}) as double) / 100 amount from fx_breakdown
        where bucket_group <> 'Employer Benefits' group by 1, 2""",
    "r17_savings_trend": """
        select check_date, savings_rate_pct, total_savings_rate_pct, pretax_savings, posttax_savings,
          roth_ira_deposit, employer_contributions from fx_savings""",
    "r17_savings_long": " union all ".join(
        f"select check_date, '{b}' bucket, {b} amount from fx_savings"
        for b in ("pretax_savings", "posttax_savings", "roth_ira_deposit", "employer_contributions")),
    "r18_paycheck_detail": "select check_date, " + ", ".join(
        f"cast({c} as double) as {c}" for c in ("hours_worked", "gross_pay", "employee_taxes",
                                             "pre_tax_deductions", "post_tax_deductions", "net_pay",
                                             "gross_pay_ytd", "net_pay_ytd")) + " from fx_totals",
    "r20_search_transactions": _SEARCH + "flow_category = 'expense' and merchant_clean ilike '%supplier#1%'",
    "r20_search_by_month_and_group": _SEARCH + f"""
        year_month in {tuple(MONTHS)} and category_group in ('PROMO', 'Income')""",
    "r21_search_totals": """
        select count(*) transactions,
          cast(coalesce(sum(amount_abs) filter (flow_category = 'income'), 0) as double) total_inflow,
          cast(coalesce(sum(amount_abs) filter (flow_category = 'expense'), 0) as double) total_outflow
        from fx_txns where not is_transfer""",
    "r22_category_groups": "select distinct category_group from fx_txns where category_group is not null",
    "r22_transaction_months": "select distinct year_month from fx_txns",
    "r23_current_balances": """
        select name, account_type, institution, bucket, cast(balance as double) balance, as_of_date
        from fx_current""",
    "r23_active_accounts": "select account_id, name, account_type, institution from fx_buckets",
    "r6_deduction_breakdown_keyed": """
        select employee_id, description, cast(sum(amount) as double) amount from fx_lines
        where section = 'employee_taxes' group by 1, 2""",
    "r9_pay_summary_keyed": f"""
        select employee_id, cast(sum(gross_pay) as double) total_gross, cast(sum(net_pay) as double) total_net,
          cast(sum(employee_taxes + pre_tax_deductions + post_tax_deductions) as double) total_deductions,
          {ratio(f"sum({cents('employee_taxes + pre_tax_deductions + post_tax_deductions')}) * 100",
                 f"sum({cents('gross_pay')})", 4)} effective_rate,
          {ratio(f"sum({cents('net_pay')}) * 100", f"sum({cents('gross_pay')})", 4)} take_home_rate,
          count(distinct check_date) paychecks from fx_totals group by 1""",
    "r15_paycheck_kpis_keyed": f"""
        select employee_id, count(*) check_count, cast(sum({cents('gross_pay')}) as double) / 100 total_gross,
          cast(sum({cents('net_pay')}) as double) / 100 total_net,
          {ratio(f"sum(cast(round(savings_rate_pct * 100) as hugeint))", 'count(*) * 100', 4)} avg_savings_rate,
          {ratio(f"sum(cast(round(total_savings_rate_pct * 100) as hugeint))", 'count(*) * 100', 4)} avg_total_savings_rate
        from ({_savings_sql("employee_id,")}) group by 1""",
    "r17_savings_trend_keyed": f"""
        select employee_id, check_date, savings_rate_pct, total_savings_rate_pct, pretax_savings, posttax_savings,
          roth_ira_deposit, employer_contributions from ({_savings_sql("employee_id,")})""",
    "r17_savings_long_keyed": f"with s as ({_savings_sql('employee_id,')}) " + " union all ".join(
        f"select employee_id, check_date, '{b}' bucket, {b} amount from s"
        for b in ("pretax_savings", "posttax_savings", "roth_ira_deposit", "employer_contributions")),
    "r18_paycheck_detail_keyed": "select employee_id, check_date, " + ", ".join(
        f"cast({c} as double) as {c}" for c in ("hours_worked", "gross_pay", "employee_taxes",
                                             "pre_tax_deductions", "post_tax_deductions", "net_pay",
                                             "gross_pay_ytd", "net_pay_ytd")) + " from fx_totals",
    "r19_reconciliation_kpis_keyed": """
        select employee_id, count(*) total_checks, count(*) filter (status = 'MATCH') clean_matches,
          count(*) filter (status = 'INVESTIGATE' or status = 'MISSING') need_attention
        from fx_recon_keyed group by 1""",
    "r23_current_balances_keyed": """
        select household_id, name, account_type, institution, bucket, cast(balance as double) balance, as_of_date
        from fx_current""",
    "r23_active_accounts_keyed":
        "select household_id, account_id, name, account_type, institution from fx_buckets",
    "r23_snapshot_log": """
        select snapshot_date, name account, cast(balance as double) balance, s.note, snapshot_id,
          epoch_us(entered_at) entered_at
        from fx_snapshots s join fx_accounts a on a.account_id = s.account_id
        order by snapshot_date desc, s.entered_at desc nulls last, snapshot_id limit 200""",
    "r23_snapshot_log_keyed": """
        select household_id, snapshot_date, name account, cast(balance as double) balance, s.note, snapshot_id,
          epoch_us(entered_at) entered_at
        from (select *, account_id // 10 a from fx_snapshots) s
        join (select household_id, account_id // 10 a, name from fx_accounts) using (household_id, a)
        qualify row_number() over (partition by household_id
          order by snapshot_date desc, s.entered_at desc nulls last, snapshot_id) <= 200""",
    "r24_paycheck_deposits": """
        select transaction_date, category_item, merchant_clean, cast(amount as double) amount
        from fx_txns where is_deposit""",
    "r25_spending_by_merchant": """
        select merchant_clean, count(*) transaction_count, cast(sum(amount_abs) as double) total_spent
        from fx_txns where flow_category = 'expense' group by 1""",
    "k1_k5_fit_exponential": _fit_sql("fx_history") + """
        select n, first_date, last_date, round(last_y, 4) last_y, model, logs exponential,
          cast(span as integer) span, round(mean_x, 4) mean_x, round(mean_y, 4) mean_y,
          round(slope, 4) slope, round(sigma, 4) sigma from m""",
    "k6_k8_forecast_exponential": _forecast_sql("fx_history"),
    "k6_k8_forecast_linear": _forecast_sql("fx_history", exponential=False, width=25),
    "k6_k8_forecast_keyed": _forecast_sql("fx_history_keyed", "household_id"),
    "k9_forecast_summary": _fit_sql("fx_history_keyed", "household_id") + """,
          p as (select *, case when logs then exp(mean_y + slope * (span + 365 - mean_x)) else mean_y + slope * (span + 365 - mean_x) end projected,
            sigma * 1.5 s, sigma * 2 h from m)
        select household_id, model, last_y as "current", """ + nine("projected") + " projected, " + nine(
        "case when logs then projected / exp(s) else projected - h end") + " low, " + nine(
        "case when logs then projected * exp(s) else projected + h end") + " high, " + nine(
        "projected - last_y") + " growth, " + nine(
        "case when last_y > 0 then (projected - last_y) / last_y * 100 else 0 end") + """ growth_pct
        from p""",
}
BODIES["r10_spending_kpis"] = f"select * exclude (avg_rough) from ({BODIES['r10_spending_kpis']})"


def _needed(sql: str) -> list[str]:
    """The shared tables a text needs, each after those it needs itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in out:
                visit(CTES[name])
                if name not in out:
                    out.append(name)
    visit(sql)
    return out


def oracle_sql() -> dict[str, str]:
    def complete(body: str) -> str:
        ctes = ", ".join(f"{n} as ({CTES[n]})" for n in _needed(body))
        return f"with {ctes} select * from ({body})" if ctes else body
    out = {name: complete(body) for name, body in BODIES.items()}
    # However the layers are stored, the rows are the same.
    return {**out, "a17_gold_refresh_bucketed": out["a17_gold_refresh_keyed"]}
