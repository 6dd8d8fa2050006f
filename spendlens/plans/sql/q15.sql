-- Q15 high-value alerts at or above the 75th percentile of positive debits.
-- ``debit_percentiles`` (one row: p75, p90) is produced by the distributed exact
-- PERCENTILE_CONT operator; the outer side does not repeat ``dr_amount > 0``.
SELECT t.txn_date, t.txn_no, t.category, t.entity_id,
       CAST(ROUND(t.dr_amount, 2) AS DOUBLE) AS amount,
       CAST(ROUND(CAST(p.p75 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS p75_threshold,
       CAST(ROUND(CAST(p.p90 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS p90_threshold,
       CASE WHEN t.dr_amount >= p.p90 THEN 'Top 10% Spend'
            WHEN t.dr_amount >= p.p75 THEN 'Top 25% Spend' END AS alert_level,
       CAST(t.leakage_score AS DOUBLE) AS leakage_score,
       t.risk_band
FROM {transactions} t JOIN {debit_percentiles} p ON t.dr_amount >= p.p75
WHERE t.direction = 'DEBIT'
ORDER BY t.dr_amount DESC
