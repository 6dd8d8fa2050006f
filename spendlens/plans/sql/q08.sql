-- Q08 recurring entities; HAVING on a group key is pushed below the aggregate
SELECT entity_id, entity_type, category,
       entity_transaction_count AS times_paid,
       CAST(ROUND(entity_total_amount, 2) AS DOUBLE) AS total_paid,
       CAST(ROUND(entity_avg_debit, 2) AS DOUBLE) AS avg_payment,
       entity_days_active AS days_span,
       CAST(ROUND(entity_transactions_per_day, 3) AS DOUBLE) AS payments_per_day,
       CAST(MAX(leakage_score) AS DOUBLE) AS max_risk_score
FROM {transactions}
WHERE entity_type IN ('PERSON', 'MERCHANT') AND direction = 'DEBIT'
GROUP BY entity_id, entity_type, category, entity_transaction_count, entity_total_amount,
         entity_avg_debit, entity_days_active, entity_transactions_per_day
HAVING entity_transaction_count >= 3
ORDER BY total_paid DESC, entity_id, category
LIMIT 10
