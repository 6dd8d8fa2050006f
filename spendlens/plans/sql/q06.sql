-- Q06 weekend vs weekday spending (debits)
SELECT CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type,
       COUNT(*) AS transaction_count,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_spent,
       CAST(ROUND(SUM(dr_amount) / COUNT(dr_amount), 2) AS DOUBLE) AS avg_transaction,
       CAST(SUM(potential_leakage) AS BIGINT) AS leakage_count,
       CAST(ROUND(SUM(leakage_score) / COUNT(leakage_score), 2) AS DOUBLE) AS avg_risk_score
FROM {transactions}
WHERE direction = 'DEBIT'
GROUP BY is_weekend
ORDER BY avg_risk_score DESC
