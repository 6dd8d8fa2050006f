-- Q02 top-5 spending categories (AVG written as SUM/COUNT: exact decimal quotient)
SELECT category,
       COUNT(*) AS transaction_count,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_spent,
       CAST(ROUND(SUM(dr_amount) / COUNT(dr_amount), 2) AS DOUBLE) AS avg_per_transaction,
       CAST(ROUND(MAX(dr_amount), 2) AS DOUBLE) AS largest_transaction
FROM {transactions}
WHERE direction = 'DEBIT' AND dr_amount > 0
GROUP BY category
ORDER BY total_spent DESC, category
LIMIT 5
