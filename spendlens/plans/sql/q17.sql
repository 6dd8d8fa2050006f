-- Q17 drill-down of one month (parameter ${month}, default 3); month filter prunes partitions
SELECT category,
       COUNT(*) AS transactions,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_spent,
       CAST(ROUND(SUM(dr_amount) / COUNT(dr_amount), 2) AS DOUBLE) AS avg_amount,
       CAST(ROUND(MAX(dr_amount), 2) AS DOUBLE) AS largest_transaction,
       CAST(SUM(potential_leakage) AS BIGINT) AS leakage_count
FROM {transactions}
WHERE month = ${month} AND direction = 'DEBIT'
GROUP BY category
ORDER BY total_spent DESC
