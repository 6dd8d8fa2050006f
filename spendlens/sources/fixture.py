"""Driver-table adapter: one bank transaction per ``orders`` row.

The reference reads one private bank statement.  The test tables are TPC-H-like, so the
statement is derived from ``orders`` with the SQL below (identical text runs on Spark and
DuckDB).  It reaches every channel, sub-category, frequency label and risk band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADAPTER_SQL = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS st,
         CAST(FLOOR(o_totalprice / 50) AS DECIMAL(12,2)) AS amt,
         CASE o_custkey % 12
           WHEN 0 THEN 'SWIGGY ' || CAST(o_custkey AS STRING)
           WHEN 1 THEN 'Amazon Prime ' || CAST(o_custkey AS STRING)
           WHEN 2 THEN 'AMAZON RETAIL ' || CAST(o_custkey AS STRING)
           WHEN 3 THEN 'NETFLIX'
           WHEN 4 THEN 'BOOKMYSHOW ' || CAST(o_custkey AS STRING)
           WHEN 5 THEN 'COFFEE HOUSE ' || CAST(o_custkey AS STRING)
           WHEN 6 THEN 'ACME PAYROLL'
           WHEN 7 THEN '9876543210 raj.k@okaxis'
           WHEN 8 THEN 'Ravi ' || CAST(o_custkey AS STRING) || ' 9876543210'
           ELSE 'PAYEE ' || CAST(o_custkey AS STRING) END AS nm
  FROM {orders})
SELECT CASE k % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'S' ELSE 'U' END || lpad(CAST(k AS STRING), 9, '0') AS txn_no,
       d AS txn_date,
       CASE k % 16
         WHEN 0 THEN 'SMS CHRG QTR' WHEN 1 THEN '0123:INT.PD:QTR' WHEN 2 THEN 'ATM WDL 4411'
         WHEN 3 THEN 'NEFT/IN/' || CAST(k AS STRING) WHEN 4 THEN 'NEFT/OUT/' || CAST(k AS STRING)
         WHEN 5 THEN 'IMPS/' || CAST(k AS STRING) WHEN 6 THEN 'POS 5512 STORE'
         WHEN 7 THEN 'CHQ DEP ' || CAST(k AS STRING)
         ELSE 'UPI/' || CASE WHEN st = 'P' THEN 'CR' ELSE 'DR' END || '/' || CAST(k AS STRING) || '/' || nm || '/PUNB/x@okaxis/pay' END AS description,
       CASE WHEN k % 16 IN (1,3,7) OR (k % 16 > 7 AND st = 'P') THEN CAST(0 AS DECIMAL(12,2)) ELSE amt END AS dr_amount,
       CASE WHEN k % 16 IN (1,3,7) OR (k % 16 > 7 AND st = 'P') THEN amt ELSE CAST(0 AS DECIMAL(12,2)) END AS cr_amount
FROM o
"""

# The merchant lookup fixture, in file order (header row first, one
# repeated header and one nameless row included on purpose).
LOOKUP_ROWS = [
    ("SWIGGY", "Food"),
    ("AMAZON", "Shopping"),
    ("merchant_name", "category"),
    ("AMAZON PRIME", "Subscription"),
    (" netflix ", "Entertainment"),
    ("NETFLIX", "Subscription"),
    ("BOOKMYSHOW", "Entertainment"),
    ("DMART", "Grocery"),
    (None, "Food"),
    ("PAYEE 10", "Travel"),
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def processed_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed statement (txn_no, txn_date, description, dr_amount, cr_amount)."""
    view = "__spendlens_orders"
    read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"
    ).createOrReplaceTempView(view)
    return spark.sql(ADAPTER_SQL.format(orders=view))


def raw_lookup(spark: SparkSession) -> DataFrame:
    """The lookup fixture as raw (pos, merchant_name, category) rows (built JVM-side)."""
    rows = [
        F.struct(
            F.lit(i + 1).cast("long").alias("pos"),
            F.lit(n).cast("string").alias("merchant_name"),
            F.lit(c).cast("string").alias("category"),
        )
        for i, (n, c) in enumerate(LOOKUP_ROWS)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
