-- Q03 risk-band breakdown; the share uses a window over the (at most 4-row) aggregate
SELECT risk_band,
       COUNT(*) AS transaction_count,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_amount,
       CAST(ROUND(SUM(leakage_score) / COUNT(leakage_score), 2) AS DOUBLE) AS avg_leakage_score,
       CAST(ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS DOUBLE) AS pct_of_all_transactions
FROM {transactions}
GROUP BY risk_band
ORDER BY avg_leakage_score DESC
