-- Q12 top-3 categories per month: RANK over the month x category aggregate
SELECT *
FROM (
    SELECT month_name, month, category,
           CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS category_spend,
           COUNT_IF(potential_leakage = 1) AS leakage_count,
           RANK() OVER (PARTITION BY month ORDER BY ROUND(SUM(dr_amount), 2) DESC) AS spend_rank
    FROM {transactions}
    WHERE direction = 'DEBIT'
    GROUP BY month_name, month, category
)
WHERE spend_rank <= 3
ORDER BY month, spend_rank
