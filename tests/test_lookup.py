"""ING-11: merchant lookup CSV (repeated headers, missing names, first position / last value)."""

from spendlens.sources.lookup import normalize_lookup, read_lookup_csv, read_lookup_records, write_lookup_csv

CSV = """merchant_name,category
SWIGGY,Food
AMAZON,Shopping
merchant_name,category
AMAZON PRIME,Subscription
 netflix ,Entertainment
NETFLIX,Subscription
BOOKMYSHOW,Entertainment
DMART,Grocery
,Food
PAYEE 10,Travel
"""


def test_lookup_csv(spark, tmp_path):
    p = tmp_path / "merchant_mapping.csv"
    p.write_text(CSV)
    got = {r.merchant_name: (r.category) for r in normalize_lookup(read_lookup_csv(spark, str(p))).collect()}
    assert got == {
        "SWIGGY": "Food", "AMAZON": "Shopping", "AMAZON PRIME": "Subscription", "NETFLIX": "Subscription",
        "BOOKMYSHOW": "Entertainment", "DMART": "Grocery", "PAYEE 10": "Travel",
    }
    order = [r.merchant_name for r in normalize_lookup(read_lookup_csv(spark, str(p))).orderBy("pos").collect()]
    assert order == ["SWIGGY", "AMAZON", "AMAZON PRIME", "NETFLIX", "BOOKMYSHOW", "DMART", "PAYEE 10"]


def test_missing_lookup_is_empty(spark, tmp_path):
    assert read_lookup_csv(spark, str(tmp_path / "nope.csv")).count() == 0


def test_lookup_records_follow_the_order_of_many_files(spark, tmp_path):
    """Quoted names with line breaks, repeated headers, swapped columns; a name's first place counts over all files."""
    (tmp_path / "a.csv").write_text('category,merchant_name\nFood,"A, ""B""\nC"\nTravel,X\n')
    (tmp_path / "b.csv").write_text('category,merchant_name\nToys,x \n,Y\n\nToys,Z\n')
    got = [tuple(r) for r in normalize_lookup(read_lookup_records(spark, str(tmp_path))).orderBy("pos").collect()]
    assert got == [(1, 'A, "B"\nC', "Food"), (2, "X", "Toys"), (7, "Z", "Toys")]


def test_lookup_written_and_read_back(spark, tmp_path):
    rows = [(i * 3, f'n"{i},\n{i}' if i % 5 else None, f"c{i}" if i % 7 else None) for i in range(200)]
    raw = spark.createDataFrame(rows, "pos long, merchant_name string, category string").repartition(6)
    write_lookup_csv(raw, str(tmp_path / "out"))
    got = [tuple(r) for r in read_lookup_records(spark, str(tmp_path / "out")).orderBy("pos").collect()]
    assert got == [(i + 1, n or "", c or "") for i, (_, n, c) in enumerate(rows)]
