"""Independent DuckDB SQL for the whole chain (the correctness oracle).

Written from the operator definitions, not from the Spark code: plain global windows,
correlated lookups and row numbers are fine here because the oracle only runs on small
fixtures.  ``cte(*names)`` returns a ``WITH`` clause with everything the named stages
need; report oracles append their final ``SELECT``.
"""

from __future__ import annotations

from spendlens.sources.fixture import ADAPTER_SQL, LOOKUP_ROWS


def _sql_str(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_LOOKUP_VALUES = ", ".join(f"({i + 1}, {_sql_str(n)}, {_sql_str(c)})" for i, (n, c) in enumerate(LOOKUP_ROWS))

STAGES: dict[str, str] = {}

STAGES["raw_txn"] = ADAPTER_SQL.format(orders="orders")

STAGES["lk"] = f"""
SELECT upper(trim(merchant_name)) AS name, min(pos) AS pos, arg_max(trim(category), pos) AS category
FROM (VALUES {_LOOKUP_VALUES}) AS t(pos, merchant_name, category)
WHERE merchant_name IS NOT NULL AND category IS NOT NULL AND lower(trim(merchant_name)) <> 'merchant_name'
GROUP BY 1
"""

STAGES["parsed"] = r"""
SELECT *,
  CASE WHEN starts_with(du, 'SMS CHRG') OR contains(du, 'SMS CHARGE') THEN 'SMS'
       WHEN contains(du, 'INT.PD') OR contains(du, 'INTEREST PAID') THEN 'INTEREST'
       WHEN contains(du, 'ATM') THEN 'ATM'
       WHEN starts_with(du, 'NEFT') THEN 'NEFT'
       WHEN starts_with(du, 'IMPS') THEN 'IMPS'
       WHEN starts_with(du, 'UPI') THEN 'UPI'
       WHEN contains(du, 'POS') THEN 'CARD'
       ELSE 'OTHER' END AS kind,
  CASE upper(parts[2]) WHEN 'DR' THEN 'DEBIT' WHEN 'CR' THEN 'CREDIT' ELSE 'OTHER' END AS upi_dir,
  CASE WHEN len(parts) >= 4 THEN trim(parts[4]) ELSE '' END AS payee_raw
FROM (SELECT *, upper(ds) AS du, string_split(ds, '/') AS parts
      FROM (SELECT *, trim(coalesce(description, '')) AS ds FROM raw_txn))
"""

STAGES["parsed2"] = r"""
SELECT *,
  CASE WHEN kind = 'UPI' THEN
    upper(trim(CASE WHEN scrubbed = '' THEN 'UNKNOWN' ELSE scrubbed END)) END AS payee_key
FROM (SELECT *, trim(regexp_replace(regexp_replace(payee_raw, '\b\d{10}\b', '', 'g'), '[\w.\-]+@\w+', '', 'g')) AS scrubbed
      FROM parsed)
"""

KEYWORD_CASE = """
  CASE WHEN contains(k, 'SALARY') OR contains(k, 'SAL ') OR contains(k, 'STIPEND') OR contains(k, 'PAYROLL') THEN 'Income'
       WHEN contains(k, 'INT.PD') OR contains(k, 'INTEREST PAID') OR contains(k, 'INT CREDIT') THEN 'Interest'
       WHEN contains(k, 'CHRG') OR contains(k, 'CHARGE') OR contains(k, 'FEE') OR contains(k, 'PENALTY')
            OR contains(k, 'MIN BAL') OR contains(k, 'SMS') THEN 'Bank Charges'
       WHEN contains(k, 'ATM') OR contains(k, 'CASH WITH') THEN 'Cash Withdrawal'
       WHEN contains(k, 'NEFT') OR contains(k, 'IMPS') OR contains(k, 'RTGS') THEN 'Bank Transfer'
       ELSE 'Transfer' END
"""

STAGES["keys"] = f"""
SELECT k AS payee_key, first_date, first_no,
  coalesce((SELECT category FROM lk WHERE lk.name = k),
           (SELECT arg_min(category, pos) FROM lk WHERE contains(k, lk.name)),
           {KEYWORD_CASE}) AS category
FROM (SELECT payee_key AS k, txn_date AS first_date, txn_no AS first_no
      FROM (SELECT payee_key, txn_date, txn_no,
                   row_number() OVER (PARTITION BY payee_key ORDER BY txn_date, txn_no) AS rn
            FROM parsed2 WHERE payee_key IS NOT NULL) WHERE rn = 1)
"""

STAGES["tokens"] = """
SELECT *, printf('%s_%03d', entity_type, row_number() OVER (PARTITION BY entity_type ORDER BY first_date, first_no)) AS entity_id
FROM (SELECT *, CASE WHEN category IN ('Transfer', 'Bank Transfer', 'Income') THEN 'PERSON' ELSE 'MERCHANT' END AS entity_type
      FROM keys)
"""

STAGES["clean"] = """
SELECT p.txn_no, p.txn_date,
  CASE p.kind WHEN 'SMS' THEN 'BANK' WHEN 'INTEREST' THEN 'BANK' WHEN 'ATM' THEN 'ATM' WHEN 'NEFT' THEN 'NEFT'
              WHEN 'IMPS' THEN 'IMPS' WHEN 'UPI' THEN 'UPI' WHEN 'CARD' THEN 'CARD' ELSE 'OTHER' END AS payment_mode,
  CASE p.kind WHEN 'SMS' THEN 'DEBIT' WHEN 'INTEREST' THEN 'CREDIT' WHEN 'ATM' THEN 'DEBIT'
              WHEN 'NEFT' THEN CASE WHEN contains(p.du, '/IN/') OR contains(p.du, '-IN-') THEN 'CREDIT' ELSE 'DEBIT' END
              WHEN 'IMPS' THEN 'DEBIT' WHEN 'UPI' THEN p.upi_dir WHEN 'CARD' THEN 'DEBIT' ELSE 'OTHER' END AS direction,
  CASE p.kind WHEN 'SMS' THEN 'Bank Charges' WHEN 'INTEREST' THEN 'Interest' WHEN 'ATM' THEN 'Cash Withdrawal'
              WHEN 'NEFT' THEN 'Bank Transfer' WHEN 'IMPS' THEN 'Bank Transfer' WHEN 'UPI' THEN t.category
              WHEN 'CARD' THEN 'Card Purchase' ELSE 'Transfer' END AS category,
  CASE p.kind WHEN 'UPI' THEN t.entity_type WHEN 'CARD' THEN 'MERCHANT' WHEN 'OTHER' THEN 'UNKNOWN' ELSE 'BANK' END AS entity_type,
  CASE p.kind WHEN 'SMS' THEN 'BANK_CHARGES' WHEN 'INTEREST' THEN 'BANK_INTEREST' WHEN 'ATM' THEN 'ATM_WITHDRAWAL'
              WHEN 'NEFT' THEN 'BANK_TRANSFER' WHEN 'IMPS' THEN 'BANK_TRANSFER' WHEN 'UPI' THEN t.entity_id
              WHEN 'CARD' THEN 'CARD_PURCHASE' ELSE 'UNKNOWN' END AS entity_id,
  CASE p.kind WHEN 'SMS' THEN 'SMS_CHARGES' WHEN 'INTEREST' THEN 'INTEREST_CREDIT' WHEN 'ATM' THEN 'ATM_CASH'
              WHEN 'NEFT' THEN 'NEFT_TRANSFER' WHEN 'IMPS' THEN 'IMPS_TRANSFER'
              WHEN 'UPI' THEN 'UPI_' || p.upi_dir || '_' || t.entity_type || '_' || t.entity_id
              WHEN 'CARD' THEN 'CARD_PURCHASE' ELSE 'UNKNOWN' END AS description,
  p.dr_amount, p.cr_amount
FROM parsed2 p LEFT JOIN tokens t ON p.payee_key = t.payee_key
"""

STAGES["ent"] = """
SELECT entity_id,
  count(*) AS entity_transaction_count,
  sum(dr_amount) AS entity_total_amount,
  round_even(CAST(sum(dr_amount) AS DOUBLE) / count(*) * 100.0, 0) / 100.0 AS entity_avg_amount,
  min(txn_date) AS entity_first_seen, max(txn_date) AS entity_last_seen,
  count_if(direction = 'DEBIT') AS entity_debit_count, count_if(direction = 'CREDIT') AS entity_credit_count,
  round_even(CAST(sum(dr_amount) AS DOUBLE) / count(*) * 100.0, 0) / 100.0 AS entity_avg_debit,
  round_even(CAST(sum(cr_amount) AS DOUBLE) / count(*) * 100.0, 0) / 100.0 AS entity_avg_credit,
  CAST(datediff('day', min(txn_date), max(txn_date)) + 1 AS INTEGER) AS entity_days_active,
  round_even(CAST(count(*) AS DOUBLE) / (datediff('day', min(txn_date), max(txn_date)) + 1) * 1000.0, 0) / 1000.0
    AS entity_transactions_per_day,
  CASE WHEN count(*) >= 10 THEN 'Frequent' WHEN count(*) >= 5 THEN 'Regular' WHEN count(*) >= 3 THEN 'Occasional'
       ELSE 'Rare' END AS entity_frequency
FROM clean GROUP BY entity_id
"""

STAGES["feat1"] = """
SELECT c.txn_no, c.txn_date, c.payment_mode, c.direction,
  CASE WHEN c.category <> 'Transfer' THEN c.category
       WHEN c.direction = 'CREDIT' THEN 'Income_Transfer'
       WHEN e.entity_transaction_count >= 3 THEN
         CASE WHEN c.dr_amount < 500 THEN 'Recurring_Micro' WHEN c.dr_amount < 2000 THEN 'Recurring_Transfer' ELSE 'Recurring_Large' END
       ELSE CASE WHEN c.dr_amount < 500 THEN 'One_off_Micro' WHEN c.dr_amount < 5000 THEN 'One_off_Transfer' ELSE 'One_off_Large' END
  END AS category,
  c.entity_type, c.entity_id, c.description, c.dr_amount, c.cr_amount,
  CAST(year(c.txn_date) AS INTEGER) AS year, CAST(quarter(c.txn_date) AS INTEGER) AS quarter,
  CAST(month(c.txn_date) AS INTEGER) AS month, monthname(c.txn_date) AS month_name,
  CAST(weekofyear(c.txn_date) AS INTEGER) AS week, CAST(day(c.txn_date) AS INTEGER) AS day,
  dayname(c.txn_date) AS weekday, isodow(c.txn_date) >= 6 AS is_weekend,
  c.dr_amount + c.cr_amount AS amount,
  CAST(CASE c.direction WHEN 'DEBIT' THEN -1 WHEN 'CREDIT' THEN 1 ELSE 0 END AS INTEGER) AS transaction_sign,
  c.direction = 'DEBIT' AS is_debit, c.direction = 'CREDIT' AS is_credit,
  c.dr_amount > 0 AND c.dr_amount <= 500 AS is_small_transaction,
  c.dr_amount > 500 AND c.dr_amount <= 5000 AS is_medium_transaction,
  c.dr_amount > 5000 AS is_high_value_transaction,
  e.entity_transaction_count, e.entity_total_amount, e.entity_avg_amount, e.entity_first_seen, e.entity_last_seen,
  e.entity_debit_count, e.entity_credit_count, e.entity_avg_debit, e.entity_avg_credit, e.entity_days_active,
  e.entity_transactions_per_day, e.entity_frequency,
  lag(c.txn_date) OVER (PARTITION BY c.entity_id ORDER BY c.txn_date, c.txn_no) AS previous_transaction_date,
  max(c.txn_date) OVER () AS max_date,
  sum(c.cr_amount) OVER (ORDER BY c.txn_date, c.txn_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_income,
  sum(c.dr_amount) OVER (ORDER BY c.txn_date, c.txn_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_expense
FROM clean c JOIN ent e ON c.entity_id = e.entity_id
"""

STAGES["monthly"] = """
SELECT CAST(year(txn_date) AS INTEGER) AS year, CAST(month(txn_date) AS INTEGER) AS month,
  sum(dr_amount) AS monthly_spend, sum(cr_amount) AS monthly_income, sum(cr_amount) - sum(dr_amount) AS monthly_savings
FROM clean GROUP BY 1, 2
"""

STAGES["features"] = """
SELECT f.* EXCLUDE (max_date, running_income, running_expense),
  CAST(coalesce(datediff('day', f.previous_transaction_date, f.txn_date), -1) AS INTEGER) AS days_since_last_transaction,
  f.previous_transaction_date IS NULL AS is_first_transaction,
  datediff('day', f.txn_date, f.max_date) <= 30 AS is_recent_transaction,
  f.entity_transaction_count >= 5 AS is_regular_entity,
  f.entity_days_active >= 30 AS is_long_term_entity,
  f.is_weekend AND f.is_debit AS is_weekend_spending,
  f.entity_transaction_count >= 3 AS is_recurring_entity,
  f.category = 'Subscription' AS is_subscription,
  f.is_debit AND f.category IN ('Food', 'Shopping', 'Entertainment', 'Subscription') AND f.is_small_transaction AS is_micro_leakage,
  f.is_debit AND f.category = 'Shopping' AND f.dr_amount >= 2000 AS is_large_shopping,
  f.is_debit AND f.category = 'Food' AND f.dr_amount >= 200 AS is_food_habit,
  CAST(f.is_debit AND f.category IN ('Food', 'Shopping', 'Entertainment', 'Subscription') AS INTEGER) AS potential_leakage,
  f.running_income, f.running_expense, f.running_income - f.running_expense AS net_cash_flow,
  m.monthly_spend, m.monthly_income, m.monthly_savings
FROM feat1 f JOIN monthly m ON f.year = m.year AND f.month = m.month
"""

STAGES["amount_pct"] = """
SELECT txn_no,
  ((rank() OVER (ORDER BY dr_amount) - 1) + CAST(count(*) OVER (PARTITION BY dr_amount) + 1 AS DOUBLE) / 2.0)
    / CAST(count(*) OVER () AS DOUBLE) AS pct
FROM features WHERE direction = 'DEBIT'
"""

STAGES["scored0"] = """
SELECT f.*,
  CAST(CASE f.category WHEN 'Subscription' THEN 20 WHEN 'Entertainment' THEN 18 WHEN 'Food' THEN 16 WHEN 'Shopping' THEN 15
    WHEN 'Recurring_Micro' THEN 10 WHEN 'One_off_Micro' THEN 8 WHEN 'Electronics' THEN 12 WHEN 'Travel' THEN 8
    WHEN 'Recurring_Transfer' THEN 5 WHEN 'One_off_Transfer' THEN 4 WHEN 'Recurring_Large' THEN 3 WHEN 'One_off_Large' THEN 3
    WHEN 'Utilities' THEN 2 WHEN 'Healthcare' THEN 2 WHEN 'Grocery' THEN 2 WHEN 'Finance' THEN 1
    WHEN 'Income_Transfer' THEN 0 WHEN 'Interest' THEN 0 WHEN 'Bank Charges' THEN 0 WHEN 'Bank Transfer' THEN 0
    WHEN 'Cash Withdrawal' THEN 0 ELSE 5 END AS INTEGER) AS score_category,
  CAST(CASE WHEN f.direction = 'DEBIT' THEN round_even(a.pct * 20.0, 0) ELSE 0 END AS INTEGER) AS score_amount,
  CAST(CASE f.entity_frequency WHEN 'Frequent' THEN 20 WHEN 'Regular' THEN 15 WHEN 'Occasional' THEN 8 WHEN 'Rare' THEN 3
    ELSE 5 END AS INTEGER) AS score_frequency,
  CAST(least(20, (CASE WHEN f.is_weekend THEN 10 ELSE 0 END) + (CASE WHEN f.day <= 5 THEN 10 ELSE 0 END)) AS INTEGER) AS score_timing,
  CAST(CASE WHEN f.entity_transaction_count >= 5 THEN 2 WHEN f.is_long_term_entity THEN 5
            WHEN f.is_first_transaction THEN 20 ELSE 10 END AS INTEGER) AS score_recency
FROM features f LEFT JOIN amount_pct a ON f.txn_no = a.txn_no
"""

STAGES["scored"] = """
SELECT *, CASE WHEN leakage_score <= 25 THEN 'Low Risk' WHEN leakage_score <= 50 THEN 'Moderate Risk'
               WHEN leakage_score <= 75 THEN 'High Risk' ELSE 'Critical Risk' END AS risk_band
FROM (SELECT *, CAST(least(100, greatest(0, score_category + score_amount + score_frequency + score_timing + score_recency))
              AS INTEGER) AS leakage_score FROM scored0)
"""

STAGES["predictions"] = """
SELECT *, CAST(leakage_score > 50 AS INTEGER) AS predicted_leakage,
  round_even(CAST(leakage_score AS DOUBLE) / 100.0 * 10000.0, 0) / 10000.0 AS predicted_proba,
  potential_leakage = 1 AND leakage_score > 50 AS correctly_identified
FROM scored
"""

STAGES["transactions"] = """
SELECT txn_no, txn_date, payment_mode, direction, category, entity_type, entity_id, description,
  CAST(dr_amount AS DECIMAL(12,2)) AS dr_amount, CAST(cr_amount AS DECIMAL(12,2)) AS cr_amount,
  CAST(amount AS DECIMAL(12,2)) AS amount, year, quarter, month, month_name, week, day, weekday,
  CAST(NULL AS VARCHAR) AS day_type, is_weekend, is_small_transaction, is_medium_transaction, is_high_value_transaction,
  transaction_sign, is_debit, is_credit, CAST(entity_transaction_count AS INTEGER) AS entity_transaction_count,
  CAST(entity_total_amount AS DECIMAL(12,2)) AS entity_total_amount, CAST(entity_avg_amount AS DECIMAL(12,2)) AS entity_avg_amount,
  entity_days_active, CAST(entity_transactions_per_day AS DECIMAL(8,3)) AS entity_transactions_per_day,
  CAST(entity_debit_count AS INTEGER) AS entity_debit_count, CAST(entity_credit_count AS INTEGER) AS entity_credit_count,
  CAST(entity_avg_debit AS DECIMAL(12,2)) AS entity_avg_debit, CAST(entity_avg_credit AS DECIMAL(12,2)) AS entity_avg_credit,
  entity_frequency, days_since_last_transaction, is_first_transaction, is_recent_transaction,
  is_regular_entity, is_long_term_entity, is_weekend_spending, is_recurring_entity, is_subscription,
  is_micro_leakage, is_large_shopping, is_food_habit, potential_leakage,
  CAST(leakage_score AS DECIMAL(6,2)) AS leakage_score, score_category, score_amount, score_frequency, score_timing,
  score_recency, risk_band,
  CAST(running_income AS DECIMAL(12,2)) AS running_income, CAST(running_expense AS DECIMAL(12,2)) AS running_expense,
  CAST(net_cash_flow AS DECIMAL(12,2)) AS net_cash_flow,
  CAST(monthly_spend AS DECIMAL(12,2)) AS monthly_spend, CAST(monthly_income AS DECIMAL(12,2)) AS monthly_income,
  CAST(monthly_savings AS DECIMAL(12,2)) AS monthly_savings,
  predicted_leakage, CAST(predicted_proba AS DECIMAL(6,4)) AS predicted_proba, correctly_identified
FROM predictions
"""

ORDER = list(STAGES)


def cte(upto: str = "transactions") -> str:
    """``WITH`` clause containing every stage up to and including ``upto``."""
    names = ORDER[: ORDER.index(upto) + 1]
    return "WITH " + ",\n".join(f"{n} AS ({STAGES[n]})" for n in names) + "\n"


def query(final_select: str, upto: str = "transactions") -> str:
    return cte(upto) + final_select
