"""Golden statement lines (ING)."""

from spendlens.sources import statement

LINES = [
    "Account Statement,,",
    "Tx,a,b,c,d,e,f,g",
    "Txn No.,Txn Date,Description,Branch Name,Cheque No.,Dr Amount,Cr Amount,Balance",
    'T1,05-01-2026,D,B,-,"1,250.50",-,"10,000.00 Cr.",,',
    "S2,06-01-2026,short,row",
    "U5,07-01-2026,a,b,c,1,,",
    "X3,07-01-2026,a,b,c,1,,x",
    "T4,31-02-2026,a,b,c,1,,x",
    "Txn No.,Txn Date,Description,Branch Name,Cheque No.,Dr Amount,Cr Amount,Balance",
    "T6,08-01-2026,a,b,c,-,2,500.00 Dr.",
]


def test_statement_parse(spark, tmp_path):
    p = tmp_path / "stmt.csv"
    p.write_text("\n".join(LINES) + "\n")
    lines = statement.read_statement_lines(spark, str(p))
    rows = statement.id_filter(statement.repair_ragged(statement.after_header(statement.with_cells(lines))))
    c = statement.load_counters(rows).first()
    # loaded: T1, U5, T4, repeated header, T6; skipped: S2 (short), X3 (id)
    assert (c.rows_loaded, c.rows_corrected, c.rows_skipped) == (5, 2, 2)
    out = {r.txn_no: r for r in statement.parse_statement(lines).collect()}
    assert set(out) == {"T1", "U5", "T6"}
    t1 = out["T1"]
    assert float(t1.dr_amount) == 1250.50 and float(t1.cr_amount) == 0 and float(t1.balance) == 10000.0 and t1.cheque_no == ""
    u5 = out["U5"]
    assert float(u5.dr_amount) == 1 and float(u5.cr_amount) == 0 and u5.balance is None
    assert out["T6"].balance is None and float(out["T6"].cr_amount) == 2
    assert [out[k].seq for k in ("T1", "U5", "T6")] == [1, 2, 3]


def test_amounts_and_dates_of_other_layouts_are_kept(spark):
    from pyspark.sql import functions as F

    rows = [("123,456,789,012.50", "05-01-26"), ("1e3", "05-01-2026 10:22:01"), ("9" * 30, "20260105"), ("abc", "5/1/26 9:05 PM"), ("", "31-02-26")]
    df = spark.createDataFrame(rows, "a string, d string").select(
        statement.parse_amount(F.col("a")).alias("a"), statement.parse_balance(F.col("a")).alias("b"), statement.parse_date(F.col("d")).cast("string").alias("d")
    )
    got = df.collect()
    assert [float(r.a) for r in got] == [123456789012.50, 1000.0, 0.0, 0.0, 0.0]
    assert [r.d for r in got] == ["2026-01-05"] * 4 + [None]
    assert float(got[0].b) == 123456789012.50


def test_cells(spark):
    from pyspark.sql import functions as F

    lines = ['a,"b,c",d', ",,", "", '"x ""y"" z",', 'a"b,c', '"open,rest']
    got = [r.c for r in spark.createDataFrame([(x,) for x in lines], "v string").select(statement.split_cells(F.col("v")).alias("c")).collect()]
    assert got == [["a", "b,c", "d"], ["", "", ""], [""], ['x "y" z', ""], ['a"b', "c"], ['"open', "rest"]]
