-- Q04 monthly leakage trend; the change is a LAG over the monthly aggregate (at most 12 rows)
SELECT month_name, month, total_transactions, leakage_count,
       CAST(ROUND(leaked, 2) AS DOUBLE) AS leakage_amount,
       CAST(ROUND(leakage_count * 100.0 / total_transactions, 2) AS DOUBLE) AS leakage_rate_pct,
       CAST(ROUND(leaked - LAG(leaked) OVER (ORDER BY month), 2) AS DOUBLE) AS mom_leakage_change
FROM (
    SELECT month_name, month,
           COUNT(*) AS total_transactions,
           CAST(SUM(potential_leakage) AS BIGINT) AS leakage_count,
           COALESCE(SUM(dr_amount) FILTER (WHERE potential_leakage = 1), 0) AS leaked
    FROM {transactions}
    GROUP BY month_name, month
)
ORDER BY month
