"""Records of files read in small splits equal the csv module's and DuckDB's reading of the whole files."""

import csv
import random

import duckdb
import pytest

from spendlens.sources import records, statement

HEADER = ",".join(records.EXPECTED_HEADER)


def write(path, n, seed, wild):
    """A statement with quoted commas, quotes and line breaks; ``wild`` adds stray quotes and blank lines."""
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(["a", "b ", "é", ",", "\n", '"', "Txn No.", "\n\n", "x" * 30]) for _ in range(r.randrange(8)))
    with path.open("w", newline="\n", encoding="utf-8") as f:
        f.write('Account,"two\nlines, ""quoted"""\nTxn,a\n' + HEADER + "\n")
        out = csv.writer(f, lineterminator="\n")
        for i in range(n):
            out.writerow([f"T{i}", "05-01-2026", cell(), cell(), "-", "1", "-", cell()])
            if wild and r.random() < 0.1:
                f.write(r.choice(['a"b,c"d\n', "\n", '"q"rest,"x\ny"tail,z\n', f'"in\n{HEADER}\n",x\n', '""\n', '"""\n"""\n']))


def plain(path):
    with path.open(newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield size
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [300, 1000, 65536])
def test_records_across_splits_equal_the_csv_module(spark, tmp_path, small_splits, size):
    small_splits(size)
    want = {}
    for i, (n, wild) in enumerate([(60, True), (3, True), (0, False), (40, False)]):
        path = tmp_path / f"s{i}.csv"
        write(path, n, i, wild)
        want |= {(path.name, k): cells for k, cells in enumerate(plain(path))}
    lines = records.raw_lines(spark, str(tmp_path))
    states = records.block_states(records.block_summaries(lines))
    got = {(r.file_path.rsplit("/", 1)[1], r.pos): r.cells for r in records.read_records(lines, states).collect()}
    assert got == want
    if size == 300:
        assert states.where("begins").count() > 3
    heads = {r.file_path.rsplit("/", 1)[1]: r.header_pos for r in records.header_positions(states).collect()}
    assert heads == {f"s{i}.csv": 2 for i in range(4)}


def test_splits_of_64_kb_equal_duckdb(spark, tmp_path, small_splits):
    small_splits(65536)
    path = tmp_path / "big.csv"
    write(path, 20_000, 5, False)
    lines = records.raw_lines(spark, str(tmp_path))
    assert records.block_summaries(lines).count() > 5
    rows = statement.statement_rows(lines, records.block_states(records.block_summaries(lines)))
    got = sorted((r.txn_id, *r.cells[2:4], r.cells[7]) for r in rows.where("loaded").collect())
    names = ", ".join(f"'c{i}': 'VARCHAR'" for i in range(8))
    body = tmp_path / "body.txt"
    body.write_text(path.read_text(encoding="utf-8").split(HEADER + "\n", 1)[1], encoding="utf-8")
    want = duckdb.sql(
        f"SELECT c0, coalesce(c2, ''), coalesce(c3, ''), coalesce(c7, '') FROM read_csv('{body}', header=false, delim=',', quote='\"', escape='\"', "
        f"columns={{{names}}}, max_line_size=10000000, parallel=false)"
    ).fetchall()
    assert len(got) == 20_000 and got == sorted(want)


def test_record_over_many_blocks_and_unclosed_quote(spark, tmp_path, small_splits):
    small_splits(200)
    long = "\n".join(f"line {i}" for i in range(200))
    (tmp_path / "a.csv").write_text(f'{HEADER}\nT1,05-01-2026,"{long}",b,-,1,-,-\nT2,05-01-2026,c,b,-,1,-,-\n')
    (tmp_path / "b.csv").write_text(f'{HEADER}\nT3,05-01-2026,"{long}\n{HEADER}\n')
    lines = records.raw_lines(spark, str(tmp_path))
    states = records.block_states(records.block_summaries(lines))
    got = {(r.file_path[-5:], r.pos): r.cells for r in records.read_records(lines, states).collect()}
    for name in ("a.csv", "b.csv"):
        for k, cells in enumerate(plain(tmp_path / name)):
            assert got.pop((name, k)) == cells
    assert not got


def test_blocks_beyond_the_broadcast_bound(spark, tmp_path, small_splits, monkeypatch):
    small_splits(400)
    write(tmp_path / "s.csv", 80, 8, True)
    monkeypatch.setattr(records, "BROADCAST_BLOCKS", 0)
    lines = records.raw_lines(spark, str(tmp_path))
    states = records.block_states(records.block_summaries(lines))
    got = {r.pos: r.cells for r in records.read_records(lines, states).collect()}
    assert got == dict(enumerate(plain(tmp_path / "s.csv")))


def test_counters_come_with_the_write(spark, tmp_path):
    write(tmp_path / "s.csv", 50, 1, True)
    lines = records.raw_lines(spark, str(tmp_path))
    rows, seen = statement.observed_counters(statement.statement_rows(lines, records.block_states(records.block_summaries(lines))))
    rows.write.parquet(str(tmp_path / "out"))
    want = statement.load_counters(spark.read.parquet(str(tmp_path / "out"))).first()
    assert seen.get == want.asDict() and want.rows_loaded >= 50
