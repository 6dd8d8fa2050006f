-- Q16 first vs repeat visit (debits)
SELECT CASE WHEN is_first_transaction THEN 'First Visit' ELSE 'Repeat Visit' END AS visit_type,
       COUNT(*) AS transaction_count,
       CAST(ROUND(SUM(dr_amount) / COUNT(dr_amount), 2) AS DOUBLE) AS avg_amount,
       CAST(ROUND(SUM(leakage_score) / COUNT(leakage_score), 2) AS DOUBLE) AS avg_risk_score,
       CAST(SUM(potential_leakage) AS BIGINT) AS leakage_count,
       CAST(ROUND(SUM(potential_leakage) * 100.0 / NULLIF(COUNT(*), 0), 2) AS DOUBLE) AS leakage_rate_pct
FROM {transactions}
WHERE direction = 'DEBIT'
GROUP BY is_first_transaction
ORDER BY avg_risk_score DESC
