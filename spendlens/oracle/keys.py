"""DuckDB oracle SQL per catalogue key.

Money is exact DECIMAL in both engines and leaves as DOUBLE.  Half-up rounding of
quotients (AVG, percentages) is written with integer arithmetic here, so the oracle does
not depend on how DuckDB rounds a DOUBLE.
"""

from __future__ import annotations

from spendlens.operators.load import LOAD_SCHEMA, RATES, TOTALS
from spendlens.oracle.chain import query

ORACLE: dict[str, str] = {}


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS BIGINT)"


def rdiv(num: str, den: str, digits: int = 2) -> str:
    """round(num / den, digits) half away from zero for integer num/den; NULL if den = 0."""
    s = 10**digits
    return (
        f"(CASE WHEN ({den}) = 0 THEN NULL ELSE "
        f"(CASE WHEN ({num}) * ({den}) < 0 THEN -1 ELSE 1 END) * "
        f"((abs({num}) * {2 * s} + abs({den})) // (2 * abs({den}))) / {float(s)} END)"
    )


def mavg(x: str, n: str = "count(*)") -> str:
    """ROUND(AVG(money), 2)."""
    return f"({rdiv('sum(' + cents(x) + ')', n, 0)} / 100.0)"


def iavg(x: str, n: str = "count(*)") -> str:
    """ROUND(AVG(integer-valued), 2)."""
    return rdiv(f"sum(CAST({x} AS BIGINT))", n, 2)


def pct(part: str, whole: str) -> str:
    return rdiv(f"CAST({part} AS BIGINT) * 100", whole, 2)


def money(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def heven(x: str, digits: int) -> str:
    s = float(10**digits)
    return f"(round_even(CAST({x} AS DOUBLE) * {s}, 0) / {s})"


def O(name: str, sql: str) -> None:  # noqa: E743, N802
    ORACLE[name] = sql


K = "CAST(substr(txn_no, 2) AS BIGINT)"
FILE = f"'statement_' || CAST(year(txn_date) AS VARCHAR) || '_' || CAST({K} // 1000000 AS VARCHAR) || '.csv'"

# ---------------------------------------------------------------------------
# ING (expected values follow from how the statement lines are derived)
# ---------------------------------------------------------------------------

O("ing_01", query(f"""
SELECT file_path, 3 + count(*) + count_if(k % 50 = 0) + count_if(k % 70 = 0) + count_if(k % 90 = 0) + count_if(k % 110 = 0)
  + count_if(k % 13 = 0) AS n_lines  -- a branch name with a line break
FROM (SELECT {FILE} AS file_path, {K} AS k FROM raw_txn) GROUP BY file_path""", "raw_txn"))

O("ing_02", query(f"SELECT DISTINCT {FILE} AS file_path, CAST(2 AS BIGINT) AS header_pos FROM raw_txn", "raw_txn"))

# a record's position is its number in its file: three records before the first, then by key
_LINES = f"""
derived AS (
  SELECT {FILE} AS file_path, CASE WHEN {K} % 5 = 0 THEN 10 ELSE 8 END AS n_cells,
         CASE WHEN {K} % 5 = 0 THEN 2 ELSE 0 END AS popped, TRUE AS kept, txn_no AS txn_id, 0 AS j, txn_no, {K} AS k
  FROM raw_txn
  UNION ALL SELECT {FILE}, 8, 0, TRUE, 'Txn No.', 1, txn_no, {K} FROM raw_txn WHERE {K} % 50 = 0
  UNION ALL SELECT {FILE}, 4, 0, FALSE, 'S' || CAST({K} AS VARCHAR), 2, txn_no, {K} FROM raw_txn WHERE {K} % 70 = 0
  UNION ALL SELECT {FILE}, 8, 0, TRUE, 'X' || CAST({K} AS VARCHAR), 3, txn_no, {K} FROM raw_txn WHERE {K} % 90 = 0
  UNION ALL SELECT {FILE}, 8, 0, TRUE, 'T' || CAST({K} AS VARCHAR) || 'B', 4, txn_no, {K} FROM raw_txn WHERE {K} % 110 = 0
),
lines AS (SELECT *, 2 + row_number() OVER (PARTITION BY file_path ORDER BY k, j) AS pos FROM derived)"""


def _ing(final: str) -> str:
    base = query("", "raw_txn").rstrip()
    return base + "," + _LINES + "\n" + final


O("ing_03", _ing("SELECT file_path, CAST(pos AS BIGINT) AS pos, CAST(n_cells AS INTEGER) AS n_cells, CAST(popped AS INTEGER) AS popped, kept FROM lines"))
O("ing_04", _ing("SELECT file_path, CAST(pos AS BIGINT) AS pos, txn_id FROM lines WHERE kept AND substr(txn_id, 1, 1) IN ('T', 'S', 'U')"))
O("ing_05", _ing("""SELECT count_if(kept AND substr(txn_id, 1, 1) IN ('T', 'S', 'U')) AS rows_loaded,
  CAST(sum(popped) AS BIGINT) AS rows_corrected, count_if(NOT (kept AND substr(txn_id, 1, 1) IN ('T', 'S', 'U'))) AS rows_skipped FROM lines"""))
O("ing_06", _ing("""
SELECT l.file_path, CAST(l.pos AS BIGINT) AS pos,
  CASE l.j WHEN 0 THEN r.txn_no WHEN 1 THEN 'Txn No.' ELSE l.txn_id END AS txn_no,
  CASE l.j WHEN 0 THEN strftime(r.txn_date, '%d-%m-%Y') WHEN 1 THEN 'Txn Date' WHEN 3 THEN '05-01-2026' ELSE '31-02-2026' END AS txn_date,
  CASE l.j WHEN 0 THEN r.description WHEN 1 THEN 'Description' WHEN 3 THEN 'x' ELSE 'bad' END AS description,
  CASE l.j WHEN 0 THEN 'BR' || CAST(l.k % 7 AS VARCHAR) || CASE WHEN l.k % 13 = 0 THEN ', "MAIN"' || chr(10) || 'ROAD' ELSE '' END WHEN 1 THEN 'Branch Name' ELSE 'b' END AS branch_name,
  CASE l.j WHEN 1 THEN 'Cheque No.' ELSE '' END AS cheque_no,
  CASE l.j WHEN 0 THEN (CASE WHEN r.dr_amount = 0 THEN '' ELSE format('{:,.2f}', CAST(r.dr_amount AS DOUBLE)) END)
           WHEN 1 THEN 'Dr Amount' ELSE '1' END AS dr_amount,
  CASE l.j WHEN 0 THEN (CASE WHEN r.cr_amount = 0 THEN '' ELSE format('{:,.2f}', CAST(r.cr_amount AS DOUBLE)) END)
           WHEN 1 THEN 'Cr Amount' ELSE '' END AS cr_amount,
  CASE l.j WHEN 0 THEN (CASE WHEN l.k % 11 = 0 THEN '500.00 Dr.' ELSE '10,000.00 Cr.' END) WHEN 1 THEN 'Balance' ELSE '' END AS balance
FROM lines l JOIN raw_txn r ON l.txn_no = r.txn_no
WHERE l.kept AND substr(l.txn_id, 1, 1) IN ('T', 'S', 'U')"""))
O("ing_07", query("SELECT txn_no, CAST(dr_amount AS DOUBLE) AS dr_amount, CAST(cr_amount AS DOUBLE) AS cr_amount FROM raw_txn", "raw_txn"))
O("ing_08", query(f"SELECT txn_no, CASE WHEN {K} % 11 = 0 THEN NULL ELSE 10000.0 END AS balance FROM raw_txn", "raw_txn"))
O("ing_09", query("SELECT txn_no, txn_date FROM raw_txn", "raw_txn"))
O("ing_10", query(f"SELECT txn_no, txn_date, row_number() OVER (ORDER BY txn_date, {K}) AS seq FROM raw_txn", "raw_txn"))
O("ing_12", query(f"""SELECT txn_no, txn_date, CAST(dr_amount AS DOUBLE) AS dr_amount, CAST(cr_amount AS DOUBLE) AS cr_amount,
  row_number() OVER (ORDER BY txn_date, {K}) AS seq FROM raw_txn""", "raw_txn"))

_CUST_LOOKUP = """
clk_raw AS (
  SELECT c_custkey * 4 AS pos, 'PAYEE ' || CAST(c_custkey AS VARCHAR) AS merchant_name, c_mktsegment AS category FROM customer
  UNION ALL SELECT c_custkey * 4 + 1, 'merchant_name', 'category' FROM customer WHERE c_custkey % 100 = 0
  UNION ALL SELECT c_custkey * 4 + 2, NULL, 'Food' FROM customer WHERE c_custkey % 97 = 0
  UNION ALL SELECT c_custkey * 4 + 3, ' payee ' || CAST(c_custkey - 1 AS VARCHAR) || ' ', lower(c_mktsegment) || '_dup'
    FROM customer WHERE c_custkey % 13 = 0
),
clk_file AS (SELECT row_number() OVER (ORDER BY pos) AS pos, merchant_name, category FROM clk_raw),
clk AS (
  SELECT min(pos) AS pos, upper(trim(merchant_name)) AS merchant_name, arg_max(trim(category), pos) AS category
  FROM clk_file WHERE merchant_name IS NOT NULL AND category IS NOT NULL AND lower(trim(merchant_name)) <> 'merchant_name'
  GROUP BY 2
)"""


def _with_cust(final: str, upto: str = "parsed2") -> str:
    return query("", upto).rstrip() + "," + _CUST_LOOKUP + "\n" + final


O("ing_11", _with_cust("SELECT CAST(pos AS BIGINT) AS pos, merchant_name, category FROM clk", "raw_txn"))

# ---------------------------------------------------------------------------
# PAR / ANO
# ---------------------------------------------------------------------------

_CLEAN_FIELDS = """
  CASE kind WHEN 'SMS' THEN 'BANK' WHEN 'INTEREST' THEN 'BANK' WHEN 'ATM' THEN 'ATM' WHEN 'NEFT' THEN 'NEFT'
            WHEN 'IMPS' THEN 'IMPS' WHEN 'UPI' THEN 'UPI' WHEN 'CARD' THEN 'CARD' ELSE 'OTHER' END AS payment_mode,
  CASE kind WHEN 'SMS' THEN 'DEBIT' WHEN 'INTEREST' THEN 'CREDIT' WHEN 'ATM' THEN 'DEBIT'
            WHEN 'NEFT' THEN CASE WHEN contains(du, '/IN/') OR contains(du, '-IN-') THEN 'CREDIT' ELSE 'DEBIT' END
            WHEN 'IMPS' THEN 'DEBIT' WHEN 'UPI' THEN upi_dir WHEN 'CARD' THEN 'DEBIT' ELSE 'OTHER' END AS direction"""

O("par_01", query(f"SELECT txn_no, kind, {_CLEAN_FIELDS} FROM parsed2", "parsed2"))
O("par_02", query("SELECT txn_no, payment_mode, direction, category, entity_type, entity_id, description FROM clean "
                  "WHERE entity_id IN ('BANK_CHARGES', 'BANK_INTEREST')", "clean"))
O("par_03", query("SELECT txn_no, payment_mode, direction, category, entity_type, entity_id, description FROM clean "
                  "WHERE payment_mode IN ('ATM', 'IMPS', 'CARD')", "clean"))
O("par_04", query("SELECT txn_no, direction FROM clean WHERE payment_mode = 'NEFT'", "clean"))
O("par_05", query("SELECT txn_no, upi_dir AS direction, CAST(len(parts) AS INTEGER) AS n_parts FROM parsed2 WHERE kind = 'UPI'", "parsed2"))
O("par_06", query("SELECT txn_no, payee_raw FROM parsed2 WHERE kind = 'UPI'", "parsed2"))
O("par_07", _with_cust("""SELECT DISTINCT p.payee_key, c.category FROM parsed2 p JOIN clk c ON p.payee_key = c.merchant_name"""))
O("par_08", _with_cust("""SELECT k AS payee_key, CAST(min(c.pos) AS BIGINT) AS pos, arg_min(c.category, c.pos) AS category
FROM (SELECT DISTINCT payee_key AS k FROM parsed2 WHERE payee_key IS NOT NULL) JOIN clk c ON contains(k, c.merchant_name)
GROUP BY k"""))
from spendlens.oracle.chain import KEYWORD_CASE  # noqa: E402

O("par_09", query(f"SELECT k AS payee_key, {KEYWORD_CASE} AS keyword_category FROM (SELECT DISTINCT payee_key AS k FROM parsed2 "
                  "WHERE payee_key IS NOT NULL)", "parsed2"))
O("par_10", query("SELECT payee_key, category, entity_type FROM tokens", "tokens"))
O("ano_01", query("SELECT txn_no, payee_raw, CASE WHEN scrubbed = '' THEN 'UNKNOWN' ELSE scrubbed END AS payee_name FROM parsed2 "
                  "WHERE kind = 'UPI'", "parsed2"))
O("ano_02", query("SELECT payee_key, entity_type, entity_id, first_date, first_no FROM tokens", "tokens"))
O("ano_02_hashed", query("SELECT payee_key, entity_type, entity_type || '_' || substr(sha256('fixture|' || payee_key), 1, 32) AS entity_id, "
                         "CAST(1 AS BIGINT) AS n_keys FROM tokens", "tokens"))
O("ano_02_deliveries", ORACLE["ano_02"])
O("ano_03", query("SELECT txn_no, description FROM clean", "clean"))
O("ano_04", query("SELECT txn_no, txn_date, payment_mode, direction, category, entity_type, entity_id, description, "
                  "CAST(dr_amount AS DOUBLE) AS dr_amount, CAST(cr_amount AS DOUBLE) AS cr_amount FROM clean", "clean"))
O("ano_05", query("""
SELECT 'total' AS section, 'transactions' AS item, count(*) AS n FROM clean
UNION ALL SELECT 'total', 'unique_persons', count(DISTINCT entity_id) FROM clean WHERE entity_type = 'PERSON'
UNION ALL SELECT 'total', 'unique_merchants', count(DISTINCT entity_id) FROM clean WHERE entity_type = 'MERCHANT' AND payment_mode = 'UPI'
UNION ALL SELECT 'category', category, count(*) FROM clean GROUP BY category""", "clean"))

# ---------------------------------------------------------------------------
# FEA / SCO (over the oracle's feature and score stages)
# ---------------------------------------------------------------------------

O("fea_01", query("SELECT txn_no, year, quarter, month, month_name, week, day, weekday, is_weekend FROM features", "features"))
O("fea_02", query("SELECT txn_no, category FROM features", "features"))
O("fea_03", query("SELECT txn_no, CAST(amount AS DOUBLE) AS amount, transaction_sign, is_debit, is_credit, is_small_transaction, "
                  "is_medium_transaction, is_high_value_transaction FROM features", "features"))
O("fea_04", query("SELECT entity_id, entity_transaction_count, CAST(entity_total_amount AS DOUBLE) AS entity_total_amount, "
                  "entity_avg_amount, entity_first_seen, entity_last_seen, entity_debit_count, entity_credit_count, "
                  "entity_avg_debit, entity_avg_credit FROM ent", "ent"))
O("fea_05", query("SELECT entity_id, entity_days_active, entity_transactions_per_day FROM ent", "ent"))
O("fea_06", query("SELECT entity_id, entity_frequency FROM ent", "ent"))
O("fea_07", query("SELECT txn_no, previous_transaction_date, days_since_last_transaction, is_first_transaction FROM features", "features"))
O("fea_08", query("SELECT txn_no, is_recent_transaction FROM features", "features"))
O("fea_09", query("SELECT txn_no, is_regular_entity, is_long_term_entity, is_weekend_spending, is_recurring_entity, is_subscription "
                  "FROM features", "features"))
O("fea_10", query("SELECT txn_no, is_micro_leakage, is_large_shopping, is_food_habit, potential_leakage FROM features", "features"))
O("fea_11", query(f"SELECT CAST(sum(potential_leakage) AS BIGINT) AS leakage_count, count(*) AS transactions, "
                  f"{heven('CAST(sum(potential_leakage) AS DOUBLE) / count(*) * 100.0', 2)} AS leakage_pct FROM features", "features"))
O("fea_12", query("SELECT txn_no, CAST(running_income AS DOUBLE) AS running_income, CAST(running_expense AS DOUBLE) AS running_expense, "
                  "CAST(net_cash_flow AS DOUBLE) AS net_cash_flow FROM features", "features"))
O("fea_13", query("SELECT year, month, CAST(monthly_spend AS DOUBLE) AS monthly_spend, CAST(monthly_income AS DOUBLE) AS monthly_income, "
                  "CAST(monthly_savings AS DOUBLE) AS monthly_savings FROM monthly", "monthly"))
O("fea_14", query("""
SELECT 'potential_leakage' AS section, CAST(potential_leakage AS VARCHAR) AS item, CAST(count(*) AS DOUBLE) AS value
FROM features GROUP BY potential_leakage
UNION ALL SELECT 'category', category, CAST(count(*) AS DOUBLE) FROM features GROUP BY category
UNION ALL SELECT unnest(['monthly_spend', 'monthly_income', 'monthly_savings']), month_name,
  unnest([CAST(ms AS DOUBLE), CAST(mi AS DOUBLE), CAST(msv AS DOUBLE)])
FROM (SELECT month_name, arg_min(monthly_spend, (txn_date, txn_no)) AS ms, arg_min(monthly_income, (txn_date, txn_no)) AS mi,
             arg_min(monthly_savings, (txn_date, txn_no)) AS msv FROM features GROUP BY month_name)""", "features"))

for i, c in enumerate(["score_category", "score_amount", "score_frequency", "score_timing", "score_recency"], start=1):
    O(f"sco_0{i}", query(f"SELECT txn_no, {c} FROM scored", "scored"))
O("sco_06", query("SELECT txn_no, leakage_score FROM scored", "scored"))
O("sco_07", query("SELECT txn_no, risk_band FROM scored", "scored"))
O("sco_08", query("SELECT txn_no, category, CAST(dr_amount AS DOUBLE) AS dr_amount, leakage_score, risk_band FROM scored "
                  "WHERE potential_leakage = 1", "scored"))
O("sco_09", query("SELECT risk_band, count(*) AS n FROM scored GROUP BY risk_band", "scored"))
O("sco_10", query(f"SELECT category, {heven('CAST(sum(leakage_score) AS DOUBLE) / count(*)', 1)} AS mean_score FROM scored "
                  "WHERE direction = 'DEBIT' GROUP BY category", "scored"))

# ---------------------------------------------------------------------------
# SNK
# ---------------------------------------------------------------------------


def _tx_select() -> str:
    cols = []
    for name, t in LOAD_SCHEMA:
        cols.append(f"CAST({name} AS DOUBLE) AS {name}" if t.upper().startswith("NUMERIC") else name)
    return ", ".join(cols)


O("snk_01", query(f"SELECT {_tx_select()} FROM transactions"))
O("snk_03", query(f"SELECT {_tx_select()} FROM transactions"))


def _reject_sql() -> str:
    parts = []
    for name, t in LOAD_SCHEMA:
        u = t.upper()
        if u.startswith("VARCHAR(") and name != "day_type":
            n = int(u[8:-1])
            parts.append(f"CASE WHEN length(CAST({name} AS VARCHAR)) > {n} THEN '{name}: longer than {n}' END")
        if u.startswith("NUMERIC(") and name not in TOTALS | RATES:
            p, d = (int(x) for x in u[8:-1].split(","))
            parts.append(f"CASE WHEN abs(round(CAST({name} AS DECIMAL(38, 10)), {d})) >= {10 ** (p - d)} THEN '{name}: overflows NUMERIC({p},{d})' END")
    parts.append("CASE WHEN txn_date IS NULL THEN 'txn_date: NOT NULL' END")
    parts.append("CASE WHEN txn_no IS NULL THEN 'txn_no: PRIMARY KEY is NULL' END")
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    spoilt = (
        f"SELECT * REPLACE (CASE WHEN {K} % 97 = 0 THEN dr_amount + 10000000000 ELSE dr_amount END AS dr_amount, "
        f"CASE WHEN {K} % 91 = 0 THEN repeat('x', 60) ELSE category END AS category) FROM predictions"
    )
    return f"SELECT txn_no, array_to_string(r, '; ') AS reasons FROM (SELECT txn_no, {arr} AS r FROM ({spoilt})) WHERE len(r) > 0"


O("snk_02", query(_reject_sql(), "predictions"))
O("snk_04", query(f"SELECT txn_no, description, CAST(dr_amount AS DOUBLE) AS dr_amount FROM transactions WHERE {K} % 3 <> 0"))
O("snk_05", query("""SELECT count(*) AS total_rows, count_if(txn_date IS NULL) AS null_dates,
  count(*) - count(DISTINCT txn_no) - count_if(txn_no IS NULL) AS duplicate_keys, count_if(txn_no IS NULL) AS null_keys FROM transactions"""))
O("snk_06", query("SELECT count(*) AS total_transactions, count_if(potential_leakage = 1) AS leakage_flagged, "
                  "min(txn_date) AS min_date, max(txn_date) AS max_date FROM transactions"))

# ---------------------------------------------------------------------------
# Q01…Q17
# ---------------------------------------------------------------------------

O("q01", query(f"""
SELECT month_name, month, {money('sum(cr_amount)')} AS total_income, {money('sum(dr_amount)')} AS total_expenses,
  {money('sum(cr_amount) - sum(dr_amount)')} AS net_savings,
  {rdiv('(sum(' + cents('cr_amount') + ') - sum(' + cents('dr_amount') + ')) * 100', 'sum(' + cents('cr_amount') + ')', 2)} AS savings_rate_pct
FROM transactions GROUP BY month_name, month"""))

O("q02", query(f"""
SELECT category, count(*) AS transaction_count, {money('sum(dr_amount)')} AS total_spent, {mavg('dr_amount')} AS avg_per_transaction,
  {money('max(dr_amount)')} AS largest_transaction
FROM transactions WHERE direction = 'DEBIT' AND dr_amount > 0 GROUP BY category ORDER BY total_spent DESC, category LIMIT 5"""))

O("q03", query(f"""
SELECT risk_band, count(*) AS transaction_count, {money('sum(dr_amount)')} AS total_amount, {iavg('leakage_score')} AS avg_leakage_score,
  {rdiv('count(*) * 100', 'sum(count(*)) OVER ()', 2)} AS pct_of_all_transactions
FROM transactions GROUP BY risk_band"""))

_LEAK_AMT = "sum(CASE WHEN potential_leakage = 1 THEN dr_amount ELSE 0 END)"
O("q04", query(f"""
SELECT month_name, month, count(*) AS total_transactions, CAST(sum(potential_leakage) AS BIGINT) AS leakage_count,
  {money(_LEAK_AMT)} AS leakage_amount, {pct('sum(potential_leakage)', 'count(*)')} AS leakage_rate_pct,
  {money(_LEAK_AMT + ' - lag(' + _LEAK_AMT + ') OVER (ORDER BY month)')} AS mom_leakage_change
FROM transactions GROUP BY month_name, month"""))

O("q05", query(f"""
SELECT payment_mode, total_txn, leakage_txn, total_spent, avg_leakage_score, {pct('leakage_txn', 'total_txn')} AS leakage_rate_pct
FROM (SELECT payment_mode, count(*) AS total_txn, CAST(sum(potential_leakage) AS BIGINT) AS leakage_txn,
        {money('sum(dr_amount)')} AS total_spent, {iavg('leakage_score')} AS avg_leakage_score
      FROM transactions GROUP BY payment_mode)"""))

O("q06", query(f"""
SELECT CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type, count(*) AS transaction_count,
  {money('sum(dr_amount)')} AS total_spent, {mavg('dr_amount')} AS avg_transaction,
  CAST(sum(potential_leakage) AS BIGINT) AS leakage_count, {iavg('leakage_score')} AS avg_risk_score
FROM transactions WHERE direction = 'DEBIT' GROUP BY is_weekend"""))

O("q07", query("""
SELECT txn_no, txn_date, category, entity_id, CAST(dr_amount AS DOUBLE) AS amount, CAST(leakage_score AS DOUBLE) AS leakage_score,
  risk_band, CAST(predicted_proba AS DOUBLE) AS ml_leakage_probability
FROM transactions WHERE direction = 'DEBIT' ORDER BY leakage_score DESC, txn_no LIMIT 10"""))

O("q08", query("""
SELECT entity_id, entity_type, category, entity_transaction_count AS times_paid, CAST(entity_total_amount AS DOUBLE) AS total_paid,
  CAST(entity_avg_debit AS DOUBLE) AS avg_payment, entity_days_active AS days_span,
  CAST(entity_transactions_per_day AS DOUBLE) AS payments_per_day, CAST(max(leakage_score) AS DOUBLE) AS max_risk_score
FROM transactions WHERE entity_type IN ('PERSON', 'MERCHANT') AND direction = 'DEBIT'
GROUP BY entity_id, entity_type, category, entity_transaction_count, entity_total_amount, entity_avg_debit, entity_days_active,
  entity_transactions_per_day
HAVING entity_transaction_count >= 3
ORDER BY total_paid DESC, entity_id, category LIMIT 10"""))

O("q09", query(f"""
SELECT month_name, month, {money('sum(dr_amount)')} AS total_high_risk_spend,
  ({rdiv('sum(' + cents('dr_amount') + ')', '2', 0)} / 100.0) AS potential_savings_if_halved, count(*) AS high_risk_transactions
FROM (SELECT month_name, month, dr_amount, ntile(10) OVER (ORDER BY leakage_score DESC, txn_no) AS score_decile
      FROM transactions WHERE direction = 'DEBIT') WHERE score_decile = 1
GROUP BY month_name, month"""))

O("q10", query(f"""
SELECT count(*) AS total_transactions, CAST(sum(potential_leakage) AS BIGINT) AS actual_leakage,
  CAST(sum(predicted_leakage) AS BIGINT) AS predicted_leakage,
  count_if(potential_leakage = 1 AND predicted_leakage = 1) AS true_positives,
  count_if(potential_leakage = 0 AND predicted_leakage = 1) AS false_positives,
  count_if(potential_leakage = 1 AND predicted_leakage = 0) AS false_negatives,
  count_if(potential_leakage = 0 AND predicted_leakage = 0) AS true_negatives,
  {pct('count_if(potential_leakage = 1 AND predicted_leakage = 1)', 'sum(potential_leakage)')} AS recall_pct
FROM transactions"""))

O("q11", query("""
SELECT txn_date, txn_no, direction, CAST(dr_amount AS DOUBLE) AS debit, CAST(cr_amount AS DOUBLE) AS credit,
  CAST(running_expense AS DOUBLE) AS cumulative_expense, CAST(running_income AS DOUBLE) AS cumulative_income,
  CAST(net_cash_flow AS DOUBLE) AS net_cash_flow,
  CAST(sum(cr_amount - dr_amount) OVER (ORDER BY txn_date, txn_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
    AS running_balance
FROM transactions ORDER BY txn_date, txn_no LIMIT 20"""))

O("q12", query(f"""
SELECT * FROM (
  SELECT month_name, month, category, category_spend, leakage_count,
    CAST(rank() OVER (PARTITION BY month ORDER BY category_spend DESC) AS INTEGER) AS spend_rank
  FROM (SELECT month_name, month, category, {money('sum(dr_amount)')} AS category_spend,
          CAST(sum(potential_leakage) AS BIGINT) AS leakage_count
        FROM transactions WHERE direction = 'DEBIT' GROUP BY month_name, month, category))
WHERE spend_rank <= 3"""))

O("q13", query(f"""
SELECT entity_id, count(*) AS charge_count, {money('min(dr_amount)')} AS min_charge, {money('max(dr_amount)')} AS max_charge,
  {money('sum(dr_amount)')} AS total_charged, min(txn_date) AS first_charge, max(txn_date) AS last_charge,
  CAST(datediff('day', min(txn_date), max(txn_date)) AS INTEGER) AS days_subscribed, {iavg('leakage_score')} AS avg_risk_score
FROM transactions WHERE category = 'Subscription' AND direction = 'DEBIT' GROUP BY entity_id"""))

O("q14", query(f"""
SELECT weekday, count(*) AS transaction_count, {money('sum(dr_amount)')} AS total_spent, {mavg('dr_amount')} AS avg_spent,
  CAST(sum(potential_leakage) AS BIGINT) AS leakage_transactions, {iavg('leakage_score')} AS avg_risk_score,
  CAST(rank() OVER (ORDER BY sum(dr_amount) DESC) AS INTEGER) AS spend_rank
FROM transactions WHERE direction = 'DEBIT' GROUP BY weekday"""))

O("q15", query("""
SELECT t.txn_date, t.txn_no, t.category, t.entity_id, CAST(t.dr_amount AS DOUBLE) AS amount,
  CAST(round(CAST(p.p75 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS p75_threshold,
  CAST(round(CAST(p.p90 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS p90_threshold,
  CASE WHEN t.dr_amount >= p.p90 THEN 'Top 10% Spend' WHEN t.dr_amount >= p.p75 THEN 'Top 25% Spend' END AS alert_level,
  CAST(t.leakage_score AS DOUBLE) AS leakage_score, t.risk_band
FROM transactions t,
  (SELECT quantile_cont(CAST(dr_amount AS DOUBLE), 0.75) AS p75, quantile_cont(CAST(dr_amount AS DOUBLE), 0.90) AS p90
   FROM transactions WHERE direction = 'DEBIT' AND dr_amount > 0) p
WHERE t.direction = 'DEBIT' AND t.dr_amount >= p.p75"""))

O("q16", query(f"""
SELECT CASE WHEN is_first_transaction THEN 'First Visit' ELSE 'Repeat Visit' END AS visit_type, count(*) AS transaction_count,
  {mavg('dr_amount')} AS avg_amount, {iavg('leakage_score')} AS avg_risk_score, CAST(sum(potential_leakage) AS BIGINT) AS leakage_count,
  {pct('sum(potential_leakage)', 'count(*)')} AS leakage_rate_pct
FROM transactions WHERE direction = 'DEBIT' GROUP BY is_first_transaction"""))

O("q17", query(f"""
SELECT category, count(*) AS transactions, {money('sum(dr_amount)')} AS total_spent, {mavg('dr_amount')} AS avg_amount,
  {money('max(dr_amount)')} AS largest_transaction, CAST(sum(potential_leakage) AS BIGINT) AS leakage_count
FROM transactions WHERE month = 3 AND direction = 'DEBIT' GROUP BY category"""))

# ---------------------------------------------------------------------------
# REP
# ---------------------------------------------------------------------------

_DESC = f"""count(leakage_score) AS count, {heven('avg(CAST(leakage_score AS DOUBLE))', 2)} AS mean,
  {heven('stddev_samp(CAST(leakage_score AS DOUBLE))', 2)} AS std, {heven('min(leakage_score)', 2)} AS min,
  {heven('quantile_cont(CAST(leakage_score AS DOUBLE), 0.25)', 2)} AS p25, {heven('quantile_cont(CAST(leakage_score AS DOUBLE), 0.5)', 2)} AS p50,
  {heven('quantile_cont(CAST(leakage_score AS DOUBLE), 0.75)', 2)} AS p75, {heven('max(leakage_score)', 2)} AS max"""
O("rep_01", query(f"SELECT {_DESC} FROM scored", "scored"))
O("rep_02", query("SELECT risk_band, count(*) AS n FROM scored GROUP BY risk_band", "scored"))
O("rep_03", query(f"SELECT potential_leakage, {_DESC} FROM scored GROUP BY potential_leakage", "scored"))
O("rep_04", query("SELECT txn_no, txn_date, category, CAST(dr_amount AS DOUBLE) AS dr_amount, leakage_score, risk_band FROM scored "
                  "ORDER BY leakage_score DESC, txn_date, txn_no LIMIT 10", "scored"))
O("rep_05", query(f"SELECT month_name, {heven('CAST(sum(leakage_score) AS DOUBLE) / count(*)', 1)} AS mean_score FROM scored "
                  "GROUP BY month_name", "scored"))
O("rep_06", query("SELECT unnest(['score_category', 'score_amount', 'score_frequency', 'score_timing', 'score_recency']) AS factor, "
                  f"unnest([{heven('avg(CAST(score_category AS DOUBLE))', 2)}, {heven('avg(CAST(score_amount AS DOUBLE))', 2)}, "
                  f"{heven('avg(CAST(score_frequency AS DOUBLE))', 2)}, {heven('avg(CAST(score_timing AS DOUBLE))', 2)}, "
                  f"{heven('avg(CAST(score_recency AS DOUBLE))', 2)}]) AS mean FROM scored", "scored"))
O("rep_07", query(f"""SELECT {money('sum(cr_amount)')} AS total_income, {money('sum(dr_amount)')} AS total_expenses,
  {money('sum(cr_amount) - sum(dr_amount)')} AS net_savings, {pct('sum(potential_leakage)', 'count(*)')} AS leakage_rate_pct FROM transactions"""))
O("rep_08", query(f"SELECT month_name, month, {money('sum(cr_amount)')} AS total_income, {money('sum(dr_amount)')} AS total_expenses "
                  "FROM transactions GROUP BY month_name, month"))
O("rep_09", query(f"SELECT category, {money('sum(dr_amount)')} AS total_spent FROM transactions WHERE direction = 'DEBIT' GROUP BY category"))
O("rep_10", query("SELECT month_name, month, CAST(sum(potential_leakage) AS BIGINT) AS leakage_count FROM transactions GROUP BY month_name, month"))
O("rep_11", query(f"SELECT risk_band, {money('sum(dr_amount)')} AS total_spent FROM transactions WHERE direction = 'DEBIT' GROUP BY risk_band"))
O("rep_12", query(f"SELECT category, count(*) AS leakage_count, {money('sum(dr_amount)')} AS leakage_amount FROM transactions "
                  "WHERE direction = 'DEBIT' AND potential_leakage = 1 GROUP BY category"))
O("rep_13", query("SELECT txn_no, txn_date, category, entity_id, CAST(dr_amount AS DOUBLE) AS amount, CAST(leakage_score AS DOUBLE) AS leakage_score "
                  "FROM transactions WHERE risk_band = 'High Risk'"))
O("rep_14", query(f"""
SELECT (SELECT {pct('sum(potential_leakage)', 'count(*)')} FROM transactions) AS leakage_rate_pct,
  (SELECT arg_min(month_name, (-r, month)) FROM (SELECT month_name, month, {pct('sum(potential_leakage)', 'count(*)')} AS r
     FROM transactions GROUP BY month_name, month)) AS highest_risk_month,
  (SELECT arg_min(weekday, (-r, weekday)) FROM (SELECT weekday, {iavg('leakage_score')} AS r FROM transactions
     WHERE direction = 'DEBIT' GROUP BY weekday)) AS riskiest_day,
  (SELECT {pct('sum(potential_leakage)', 'count(*)')} FROM transactions WHERE payment_mode = 'UPI') AS upi_leakage_rate_pct,
  (SELECT {pct('sum(potential_leakage)', 'count(*)')} FROM transactions WHERE direction = 'DEBIT' AND is_first_transaction)
    AS first_visit_rate_pct,
  (SELECT {pct('sum(potential_leakage)', 'count(*)')} FROM transactions WHERE direction = 'DEBIT' AND NOT is_first_transaction)
    AS repeat_visit_rate_pct"""))

# ---------------------------------------------------------------------------
# ML (SQL-checkable parts; model outputs are checked by invariants)
# ---------------------------------------------------------------------------

from spendlens.ml.matrix import FEATURE_COLS  # noqa: E402

_BOOL_FEATURES = {
    "is_small_transaction", "is_medium_transaction", "is_high_value_transaction", "is_weekend", "is_regular_entity",
    "is_long_term_entity", "is_weekend_spending", "is_recurring_entity", "is_subscription", "is_first_transaction",
    "is_recent_transaction",
}


def _mcol(c: str) -> str:
    x = f"CAST({c} AS INTEGER)" if c in _BOOL_FEATURES else c
    return f"coalesce(CAST({x} AS DOUBLE), 0.0) AS {c}"


_MATRIX = "SELECT txn_no, " + ", ".join(_mcol(c) for c in FEATURE_COLS) + ", CAST(potential_leakage AS INTEGER) AS label FROM scored"
O("ml_01", query(_MATRIX, "scored"))
O("ml_02", query("""SELECT n_pos, n_neg, CAST(n_pos AS DOUBLE) / (n_pos + n_neg) AS positive_rate,
  round_even(CAST(n_neg AS DOUBLE) / n_pos * 100.0, 0) / 100.0 AS scale_pos_weight
FROM (SELECT count_if(potential_leakage = 1) AS n_pos, count_if(potential_leakage = 0) AS n_neg FROM scored)""", "scored"))
O("ml_03", query("""SELECT txn_no, CAST(potential_leakage AS INTEGER) AS label,
  CAST((row_number() OVER (PARTITION BY potential_leakage ORDER BY md5('42' || txn_no), txn_no) - 1) % 5 AS INTEGER) AS fold
FROM scored""", "scored"))
O("ml_04", query("""SELECT CAST(label AS INTEGER) AS label, n_rows, n_synthetic FROM (
  SELECT 0 AS label, count_if(potential_leakage = 0) AS n_rows, CAST(0 AS BIGINT) AS n_synthetic FROM scored
  UNION ALL SELECT 1, count_if(potential_leakage = 0), count_if(potential_leakage = 0) - count_if(potential_leakage = 1) FROM scored)""",
                  "scored"))
O("ml_05", query(
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in FEATURE_COLS) + "]) AS feature, "
    "unnest([" + ", ".join(f"round_even(avg({c}) * 1000000.0, 0) / 1000000.0" for c in FEATURE_COLS) + "]) AS mean, "
    "unnest([" + ", ".join(f"round_even(stddev_pop({c}) * 1000000.0, 0) / 1000000.0" for c in FEATURE_COLS) + "]) AS std "
    "FROM (" + _MATRIX + ")", "scored"))

_RULE = "SELECT txn_no, potential_leakage AS y, predicted_leakage AS p, CAST(predicted_proba AS DOUBLE) AS s FROM transactions"
O("ml_10", query(f"""
SELECT {heven('CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END', 4)} AS precision,
  {heven('CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END', 4)} AS recall,
  {heven('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END', 4)} AS f1_score,
  tp, fp, tn, fn
FROM (SELECT count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 1) AS fp, count_if(y = 0 AND p = 0) AS tn,
             count_if(y = 1 AND p = 0) AS fn FROM ({_RULE}))"""))
_CURVE = f"""
(SELECT sum(CAST(pos AS DOUBLE) / P * tp / seen) AS ap, sum((neg * (tp - pos) + neg * pos / 2.0) / (P * N)) AS auc
 FROM (SELECT pos, cnt - pos AS neg,
         sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
         sum(cnt) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen,
         CAST(sum(pos) OVER () AS DOUBLE) AS P, CAST(sum(cnt) OVER () - sum(pos) OVER () AS DOUBLE) AS N
       FROM (SELECT s, sum(y) AS pos, count(*) AS cnt FROM ({_RULE}) GROUP BY s)))"""
O("ml_11", query(f"SELECT {heven('auc', 4)} AS roc_auc FROM {_CURVE}"))
O("ml_12", query(f"SELECT {heven('ap', 4)} AS pr_auc FROM {_CURVE}"))
O("ml_15", query("SELECT txn_no, potential_leakage, predicted_leakage, CAST(predicted_proba AS DOUBLE) AS predicted_proba, "
                 "correctly_identified FROM transactions"))
