-- Q07 top-10 riskiest debits (txn_no breaks score ties; the top-k runs per partition first)
SELECT txn_no, txn_date, category, entity_id,
       CAST(ROUND(dr_amount, 2) AS DOUBLE) AS amount,
       CAST(leakage_score AS DOUBLE) AS leakage_score,
       risk_band,
       CAST(ROUND(predicted_proba, 4) AS DOUBLE) AS ml_leakage_probability
FROM {transactions}
WHERE direction = 'DEBIT'
ORDER BY leakage_score DESC, txn_no
LIMIT 10
