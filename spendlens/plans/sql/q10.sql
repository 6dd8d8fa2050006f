-- Q10 confusion summary of the stored predictions
SELECT COUNT(*) AS total_transactions,
       COUNT_IF(potential_leakage = 1) AS actual_leakage,
       COUNT_IF(predicted_leakage = 1) AS predicted_leakage,
       COUNT_IF(potential_leakage = 1 AND predicted_leakage = 1) AS true_positives,
       COUNT_IF(potential_leakage = 0 AND predicted_leakage = 1) AS false_positives,
       COUNT_IF(potential_leakage = 1 AND predicted_leakage = 0) AS false_negatives,
       COUNT_IF(potential_leakage = 0 AND predicted_leakage = 0) AS true_negatives,
       CAST(ROUND(100.0 * COUNT_IF(potential_leakage = 1 AND predicted_leakage = 1)
                  / NULLIF(COUNT_IF(potential_leakage = 1), 0), 2) AS DOUBLE) AS recall_pct
FROM {transactions}
