-- Q09 savings potential: decile 1 of NTILE(10) by score (descending, txn_no ties).
-- ``debit_deciles`` is produced by the distributed NTILE operator (no single-partition window).
SELECT month_name, month,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_high_risk_spend,
       CAST(ROUND(SUM(dr_amount) * 0.5, 2) AS DOUBLE) AS potential_savings_if_halved,
       COUNT(*) AS high_risk_transactions
FROM {debit_deciles}
WHERE score_decile = 1
GROUP BY month_name, month
ORDER BY month
