-- Q11 running cash flow, first 20 rows in (txn_date, txn_no) order.  A running sum over the
-- first 20 rows only needs those rows, so the top-20 is taken first (distributed top-k)
-- and the window runs over 20 rows instead of one partition holding the table.
SELECT txn_date, txn_no, direction,
       CAST(ROUND(dr_amount, 2) AS DOUBLE) AS debit,
       CAST(ROUND(cr_amount, 2) AS DOUBLE) AS credit,
       CAST(ROUND(running_expense, 2) AS DOUBLE) AS cumulative_expense,
       CAST(ROUND(running_income, 2) AS DOUBLE) AS cumulative_income,
       CAST(ROUND(net_cash_flow, 2) AS DOUBLE) AS net_cash_flow,
       CAST(ROUND(SUM(cr_amount - dr_amount) OVER (ORDER BY txn_date, txn_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS running_balance
FROM (SELECT * FROM {transactions} ORDER BY txn_date, txn_no LIMIT 20) first_rows
ORDER BY txn_date, txn_no
