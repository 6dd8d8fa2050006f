-- Q13 subscription drain
SELECT entity_id,
       COUNT(*) AS charge_count,
       CAST(ROUND(MIN(dr_amount), 2) AS DOUBLE) AS min_charge,
       CAST(ROUND(MAX(dr_amount), 2) AS DOUBLE) AS max_charge,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_charged,
       MIN(txn_date) AS first_charge,
       MAX(txn_date) AS last_charge,
       DATEDIFF(MAX(txn_date), MIN(txn_date)) AS days_subscribed,
       CAST(ROUND(SUM(leakage_score) / COUNT(leakage_score), 2) AS DOUBLE) AS avg_risk_score
FROM {transactions}
WHERE category = 'Subscription' AND direction = 'DEBIT'
GROUP BY entity_id
ORDER BY total_charged DESC
