"""Streaming statement load: whole files per batch, keyed keep-first appends."""

from spendlens.streaming.statements import start

HEADER = "Txn No.,Txn Date,Description,Branch Name,Cheque No.,Dr Amount,Cr Amount,Balance"


def test_stream_appends_new_keys_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("\n".join(["Bank,,", HEADER, "T1,05-01-2026,UPI/DR/1/X/B,B,-,10,-,-", "T2,06-01-2026,ATM,B,-,5,-,-"]) + "\n")
    target, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = start(spark, str(src), target, ckpt)
    q.awaitTermination()
    (src / "b.csv").write_text("\n".join([HEADER, "T2,06-01-2026,again,B,-,7,-,-", "S3,07-01-2026,IMPS/1,B,-,3,-,-"]) + "\n")
    q = start(spark, str(src), target, ckpt)
    q.awaitTermination()
    rows = {r.txn_no: r for r in spark.read.parquet(target).collect()}
    assert set(rows) == {"T1", "T2", "S3"}
    assert rows["T2"].description == "ATM"  # the first delivery is kept


def test_token_dictionary_grows_with_the_stream(spark, tmp_path):
    """Two deliveries, one of them twice, give the tokens of one load; a quoted line break does no harm."""
    from spendlens.operators import anonymize
    from spendlens.sources.fixture import raw_lookup
    from spendlens.sources.lookup import normalize_lookup

    lookup = normalize_lookup(raw_lookup(spark))
    row = lambda n, day, name: f'T{n},{day:02d}-01-2026,UPI/DR/{n}/{name}/PUNB/x@okaxis/pay,"B\nX",-,{n},-,-'
    early = [row(1, 5, "Ravi 77"), row(2, 6, "SWIGGY 9"), row(3, 6, "Asha 5"), row(4, 7, "Ravi 77")]
    late = [row(5, 8, "DMART 1"), row(6, 8, "Asha 5"), row(7, 9, "Mona 3"), row(8, 9, "Zed 4")]
    src, target, ckpt, tokens = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt"), str(tmp_path / "tokens")
    src.mkdir()
    for name, rows in (("a.csv", early), ("b.csv", late), ("c.csv", early)):
        (src / name).write_text("\n".join([HEADER, *rows]) + "\n")
        start(spark, str(src), target, ckpt, tokens_path=tokens, lookup=lookup).awaitTermination()
    loaded = spark.read.parquet(target)
    assert loaded.count() == 8
    cols = ["payee_key", "entity_type", "entity_id"]
    once = anonymize.payee_tokens(anonymize.parsed_rows(loaded), lookup)
    got = sorted(map(tuple, spark.read.parquet(tokens).select(cols).collect()))
    assert got == sorted(map(tuple, once.select(cols).collect())) and len(got) == 6
    parsed = anonymize.parsed_rows(loaded)
    clean = anonymize.clean_transactions(loaded, lookup, parsed=parsed, tokens=anonymize.delivery_tokens(spark.read.parquet(tokens), parsed))
    want = anonymize.clean_transactions(loaded, lookup)
    assert sorted(map(str, clean.collect())) == sorted(map(str, want.collect()))


def test_hashed_tokens_are_checked(spark):
    from spendlens.operators import anonymize

    df = spark.createDataFrame([("a", "X_1"), ("b", "X_1"), ("c", "X_2"), ("c", "X_2")], "payee_key string, entity_id string")
    assert [tuple(r) for r in anonymize.shared_tokens(df).collect()] == [("X_1", 2)]
