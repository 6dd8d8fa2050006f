-- Q01 monthly income / expense / savings rate (grouped by month name and month; year ignored)
SELECT month_name, month,
       CAST(ROUND(SUM(cr_amount), 2) AS DOUBLE) AS total_income,
       CAST(ROUND(SUM(dr_amount), 2) AS DOUBLE) AS total_expenses,
       CAST(ROUND(SUM(cr_amount) - SUM(dr_amount), 2) AS DOUBLE) AS net_savings,
       CAST(ROUND((SUM(cr_amount) - SUM(dr_amount)) / NULLIF(SUM(cr_amount), 0) * 100, 2) AS DOUBLE) AS savings_rate_pct
FROM {transactions}
GROUP BY month_name, month
ORDER BY month
