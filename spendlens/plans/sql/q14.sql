-- Q14 day-of-week pattern; RANK over at most 7 aggregated rows
SELECT weekday,
       COUNT(*) AS transaction_count,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_spent,
       CAST(ROUND(SUM(dr_amount) / COUNT(dr_amount), 2) AS DOUBLE) AS avg_spent,
       CAST(SUM(potential_leakage) AS BIGINT) AS leakage_transactions,
       CAST(ROUND(SUM(leakage_score) / COUNT(leakage_score), 2) AS DOUBLE) AS avg_risk_score,
       RANK() OVER (ORDER BY SUM(dr_amount) DESC) AS spend_rank
FROM {transactions}
WHERE direction = 'DEBIT'
GROUP BY weekday
ORDER BY total_spent DESC
