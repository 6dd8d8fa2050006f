"""Golden description cases (PAR/ANO) asserted cell by cell."""

import pytest
from pyspark.sql import functions as F

from spendlens.operators.anonymize import clean_transactions
from spendlens.sources.fixture import raw_lookup
from spendlens.sources.lookup import normalize_lookup

CASES = [
    # description, payment_mode, direction, category, entity_type, entity_id (None = token)
    ("UPI/DR/1/BATMAN STORE/B/x@y/z", "ATM", "DEBIT", "Cash Withdrawal", "BANK", "ATM_WITHDRAWAL"),
    ("UPI/cr/1/COFFEE HOUSE/B/x@y", "UPI", "CREDIT", "Bank Charges", "MERCHANT", None),
    ("UPI/DR/1/9876543210 raj.k@okaxis/B", "UPI", "DEBIT", "Transfer", "PERSON", None),
    ("UPI/DR/1", "UPI", "DEBIT", "Transfer", "PERSON", None),
    ("UPI", "UPI", "OTHER", "Transfer", "PERSON", None),
    ("NEFT-IN-44", "NEFT", "CREDIT", "Bank Transfer", "BANK", "BANK_TRANSFER"),
    ("NEFT/OUT/44", "NEFT", "DEBIT", "Bank Transfer", "BANK", "BANK_TRANSFER"),
    (None, "OTHER", "OTHER", "Transfer", "UNKNOWN", "UNKNOWN"),
    ("SMS CHRG QTR", "BANK", "DEBIT", "Bank Charges", "BANK", "BANK_CHARGES"),
    ("0123:INT.PD:QTR", "BANK", "CREDIT", "Interest", "BANK", "BANK_INTEREST"),
    ("POS 5512 STORE", "CARD", "DEBIT", "Card Purchase", "MERCHANT", "CARD_PURCHASE"),
    ("IMPS/77", "IMPS", "DEBIT", "Bank Transfer", "BANK", "BANK_TRANSFER"),
    ("UPI/DR/9/Amazon Prime 13/B", "UPI", "DEBIT", "Shopping", "MERCHANT", None),
    ("UPI/DR/9/PAYEE 105/B", "UPI", "DEBIT", "Travel", "MERCHANT", None),
    ("UPI/DR/9/NETFLIX/B", "UPI", "DEBIT", "Subscription", "MERCHANT", None),
    ("UPI/DR/9/ACME PAYROLL/B", "UPI", "DEBIT", "Income", "PERSON", None),
]


def _clean(spark, descs):
    rows = [(f"T{i:05d}", i, d) for i, d in enumerate(descs)]
    df = spark.createDataFrame(rows, "txn_no string, i int, description string").select(
        "txn_no", F.date_add(F.lit("2026-01-01").cast("date"), F.col("i")).alias("txn_date"), "description",
        F.lit(1).cast("decimal(12,2)").alias("dr_amount"), F.lit(0).cast("decimal(12,2)").alias("cr_amount"),
    )
    lookup = normalize_lookup(raw_lookup(spark))
    return {r.txn_no: r for r in clean_transactions(df, lookup).collect()}


def test_golden_descriptions(spark):
    out = _clean(spark, [c[0] for c in CASES])
    for i, (desc, mode, direction, cat, etype, eid) in enumerate(CASES):
        r = out[f"T{i:05d}"]
        assert (r.payment_mode, r.direction, r.category, r.entity_type) == (mode, direction, cat, etype), desc
        if eid is not None:
            assert r.entity_id == eid, desc
        else:
            assert r.entity_id.startswith(etype + "_"), desc
            assert r.description == f"UPI_{direction}_{etype}_{r.entity_id}"


def test_same_payee_same_token_and_whitespace(spark):
    out = _clean(spark, ["UPI/DR/1/ravi /B", "UPI/DR/2/RAVI/B", "UPI/DR/3/RAVI /B", "UPI/DR/4/ravi\t/B"])
    assert len({r.entity_id for r in out.values()}) == 1


def test_unknown_payee_is_one_person(spark):
    out = _clean(spark, ["UPI/DR/1/9876543210/B", "UPI/DR/2/x@okaxis/B", "UPI/DR/3"])
    ids = {r.entity_id for r in out.values()}
    assert len(ids) == 1 and next(iter(ids)).startswith("PERSON_")


def test_token_widens_past_999(spark):
    descs = [f"UPI/DR/{i}/FRIEND {i:04d}/B" for i in range(1001)]
    out = _clean(spark, descs)
    ids = sorted(r.entity_id for r in out.values())
    assert "PERSON_1000" in ids and "PERSON_001" in ids and "PERSON_1001" in ids
    # first appearance order = date order
    assert out["T00000"].entity_id == "PERSON_001"
    assert out["T01000"].entity_id == "PERSON_1001"


def test_lookup_first_position_last_value(spark):
    lk = {r.merchant_name: (r.pos, r.category) for r in normalize_lookup(raw_lookup(spark)).collect()}
    assert lk["NETFLIX"] == (5, "Subscription")
    assert "MERCHANT_NAME" not in lk and len(lk) == 7
