"""Description parsing as column expressions (PAR-01…06, PAR-09, PAR-10, ANO-01).

The reference runs a Python function per row; here every rule is one branch of a single
``CASE`` chain evaluated inside whole-stage codegen.  The merchant lookup (PAR-07/08) is
a join on the distinct payee keys, see ``operators.categorize``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.functions.text import py_strip, split_part, n_parts, upper_strip

# The output of each fixed-rule channel, in rule order
# (payment_mode, direction, category, entity_type, entity_id, clean_description).
SMS_CHARGE = ("BANK", "DEBIT", "Bank Charges", "BANK", "BANK_CHARGES", "SMS_CHARGES")
INTEREST = ("BANK", "CREDIT", "Interest", "BANK", "BANK_INTEREST", "INTEREST_CREDIT")
ATM = ("ATM", "DEBIT", "Cash Withdrawal", "BANK", "ATM_WITHDRAWAL", "ATM_CASH")
NEFT = ("NEFT", None, "Bank Transfer", "BANK", "BANK_TRANSFER", "NEFT_TRANSFER")
IMPS = ("IMPS", "DEBIT", "Bank Transfer", "BANK", "BANK_TRANSFER", "IMPS_TRANSFER")
CARD = ("CARD", "DEBIT", "Card Purchase", "MERCHANT", "CARD_PURCHASE", "CARD_PURCHASE")
OTHER = ("OTHER", "OTHER", "Transfer", "UNKNOWN", "UNKNOWN", "UNKNOWN")

# Keyword fallback for payee names, first matching rule wins (substring test).
KEYWORD_RULES = (
    ("Income", ("SALARY", "SAL ", "STIPEND", "PAYROLL")),
    ("Interest", ("INT.PD", "INTEREST PAID", "INT CREDIT")),
    ("Bank Charges", ("CHRG", "CHARGE", "FEE", "PENALTY", "MIN BAL", "SMS")),
    ("Cash Withdrawal", ("ATM", "CASH WITH")),
    ("Bank Transfer", ("NEFT", "IMPS", "RTGS")),
)
DEFAULT_CATEGORY = "Transfer"

# Categories whose UPI payee is tokenised as a PERSON (else MERCHANT).
PERSON_CATEGORIES = ("Transfer", "Bank Transfer", "Income")

# PII patterns removed from UPI payee names (Unicode classes, like Python re).
PHONE_RE = "(?U)\\b\\d{10}\\b"
UPI_HANDLE_RE = "(?U)[\\w.\\-]+@\\w+"

def _any_contains(c: Column, needles) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | c.contains(n)
    return cond


def stripped_description(desc: Column) -> Column:
    """``str(description).strip()`` — the input every rule below expects (NULL → '')."""
    return py_strip(F.coalesce(desc, F.lit("")))


def neft_direction(ds: Column) -> Column:
    """PAR-04: NEFT is a credit iff the text carries ``/IN/`` or ``-IN-``."""
    d = F.upper(ds)
    return F.when(d.contains("/IN/") | d.contains("-IN-"), "CREDIT").otherwise("DEBIT")


def upi_direction(ds: Column) -> Column:
    """PAR-05: second ``/`` field DR → DEBIT, CR → CREDIT (any case), else OTHER."""
    p1 = F.upper(split_part(ds, "/", 1))
    return F.when(p1 == "DR", "DEBIT").when(p1 == "CR", "CREDIT").otherwise("OTHER")


def upi_payee_raw(ds: Column) -> Column:
    """PAR-06: fourth ``/`` field, stripped; empty when there are fewer than 4 fields."""
    s = ds
    return F.when(n_parts(s, "/") >= 4, py_strip(split_part(s, "/", 3))).otherwise(F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once (a ``CASE`` branch evaluates what it names twice twice)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scrub_pii(name: Column) -> Column:
    """ANO-01: drop 10-digit numbers, then UPI handles; strip; empty → ``UNKNOWN``."""
    x = F.regexp_replace(name, PHONE_RE, "")
    x = F.regexp_replace(x, UPI_HANDLE_RE, "")
    return bound(py_strip(x), lambda x: F.when(x == "", F.lit("UNKNOWN")).otherwise(x))


def payee_key(raw: Column) -> Column:
    """Normalised payee key of a UPI row's payee: ``upper(strip(scrubbed name))``."""
    return upper_strip(scrub_pii(raw))


def keyword_category(key: Column) -> Column:
    """PAR-09: keyword fallback on the upper-cased payee key (substring semantics)."""
    expr = None
    for category, needles in KEYWORD_RULES:
        cond = _any_contains(key, needles)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(DEFAULT_CATEGORY))


def entity_type_of(category: Column) -> Column:
    """PAR-10: PERSON for transfer-like categories, MERCHANT otherwise."""
    return F.when(category.isin(*PERSON_CATEGORIES), F.lit("PERSON")).otherwise(F.lit("MERCHANT"))


def parse_struct(ds: Column) -> Column:
    """PAR-01…06 in one CASE: a struct (kind, payment_mode, direction, category,
    entity_type, entity_id, clean_description, payee_key, payee_raw, n_parts) for the text ``ds``.

    Each rule condition is written once; UPI rows carry the payee key and leave the
    category/entity fields NULL (they come from the payee table).
    """
    d = F.upper(ds)

    def fixed(kind: str, values, direction: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(values[0]).alias("payment_mode"),
            (direction if direction is not None else F.lit(values[1])).alias("direction"),
            F.lit(values[2]).alias("category"),
            F.lit(values[3]).alias("entity_type"),
            F.lit(values[4]).alias("entity_id"),
            F.lit(values[5]).alias("clean_description"),
            F.lit(None).cast("string").alias("payee_key"),
            F.lit(None).cast("string").alias("payee_raw"),
            F.lit(None).cast("int").alias("n_parts"),
        )

    upi = lambda raw: F.struct(
        F.lit("UPI").alias("kind"),
        F.lit("UPI").alias("payment_mode"),
        upi_direction(ds).alias("direction"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("entity_type"),
        F.lit(None).cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("clean_description"),
        payee_key(raw).alias("payee_key"),
        raw.alias("payee_raw"),
        n_parts(ds, "/").cast("int").alias("n_parts"),
    )
    return (
        F.when(d.startswith("SMS CHRG") | d.contains("SMS CHARGE"), fixed("SMS", SMS_CHARGE))
        .when(d.contains("INT.PD") | d.contains("INTEREST PAID"), fixed("INTEREST", INTEREST))
        .when(d.contains("ATM"), fixed("ATM", ATM))
        .when(d.startswith("NEFT"), fixed("NEFT", NEFT, neft_direction(ds)))
        .when(d.startswith("IMPS"), fixed("IMPS", IMPS))
        .when(d.startswith("UPI"), bound(upi_payee_raw(ds), upi))
        .when(d.contains("POS"), fixed("CARD", CARD))
        .otherwise(fixed("OTHER", OTHER))
    )
