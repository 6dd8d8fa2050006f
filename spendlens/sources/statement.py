"""ING-01…10: raw bank-statement CSV lines → the processed statement table.

``records`` reads files whose quoted cells may hold line breaks, split by split (``statement_rows``).
``read_statement_lines`` takes a line for a record: ``spark.read.text`` (splittable), keeping
``(file_path, pos, value)``; ``pos`` orders lines within a file.  Each file is one statement:

* ING-02 the header is the first line whose first 8 stripped cells equal the expected
  header; per-file positions are a small aggregate joined back; lines up to and including
  it are dropped;
* ING-03 trailing empty cells are popped while there are more than 8, shorter rows are
  skipped, the rest truncated to 8;
* ING-04 ids must start with T, S or U (stripped; the stored id is stripped too);
* ING-06…09 ``-`` means missing; amounts lose thousands separators (bad → 0); a balance
  loses ``Cr.`` (anything else non-numeric → NULL); day-first dates (bad → row dropped);
* ING-10 the chronological position ``seq`` is a distributed row number by
  (date, file, line) — never a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.text import py_strip
from spendlens.operators.ordered import row_number_by
from spendlens.sources import records
from spendlens.sources.records import EXPECTED_HEADER

PROCESSED_COLUMNS = ["txn_no", "txn_date", "description", "branch_name", "cheque_no", "dr_amount", "cr_amount", "balance"]
# Accepted day-first date layouts, tried in order.
DATE_FORMATS = ["d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "d-MMM-yyyy", "d MMM yyyy"]
# The same with two-digit years, and the compact form; each only for texts of its shape.
SHORT_YEARS = ["d-M-yy", "d/M/yy", "d.M.yy", "d-MMM-yy", "d MMM yy"]
COMPACT = "yyyyMMdd"
AMOUNT = "decimal(18,2)"
BALANCE = "decimal(20,2)"
NUMERIC_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# One cell after its comma: quoted up to the closing quote, or anything up to the next comma.
_CSV_CELL = ',("(?:[^"]|"")*+"(?=,|$)|[^,]*)'
BROADCAST_HEADERS = 100_000  # rows of a path and a number
FILE_KEYS = 1_000_000  # transaction keys of one derived statement file


def read_statement_lines(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """ING-01: ``(file_path, pos, value)`` for every line of every statement file.

    ``first_only`` keeps the lexicographically first file, like the reference (which reads
    one statement); the default reads them all, one statement per file.  No file → error.
    ``pos`` grows with the place in the file: the block's first byte plus the line's number in the
    task (a block that another follows fills its task alone, so numbers never overtake bytes).
    """
    source = spark.read.text(path)
    if first_only:
        source = spark.read.text(min(source.inputFiles()))
    return source.select(
        F.col("_metadata.file_path").alias("file_path"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"),
        F.regexp_replace("value", "�", "").alias("value"),
    )


def split_cells(value: F.Column) -> F.Column:
    """Quote-aware CSV split; surrounding quotes removed and doubled quotes unescaped."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), value), F.lit(_CSV_CELL), F.lit(1))
    return F.transform(
        raw,
        lambda c: F.when(
            c.startswith('"') & c.endswith('"') & (F.length(c) >= 2),
            F.regexp_replace(F.substring(c, 2, F.length(c) - 2), '""', '"'),
        ).otherwise(c),
    )


def with_cells(lines: DataFrame) -> DataFrame:
    return lines.withColumn("cells", split_cells(F.col("value")))


def header_positions(cells: DataFrame) -> DataFrame:
    """ING-02: first header line per file ``(file_path, header_pos)``."""
    match = F.size("cells") >= 8
    for i, h in enumerate(EXPECTED_HEADER):
        match = match & (py_strip(F.get(F.col("cells"), i)) == F.lit(h))
    return cells.filter(match).groupBy("file_path").agg(F.min("pos").alias("header_pos"))


def after_header(cells: DataFrame, require_header: bool = True, headers: DataFrame | None = None) -> DataFrame:
    """Rows after their file's header; files without a header raise when checked.

    ``headers`` (file_path, header_pos) is looked for in ``cells`` if it is not given.
    """
    hp = header_positions(cells) if headers is None else headers
    small = hp.limit(BROADCAST_HEADERS + 1).count() <= BROADCAST_HEADERS
    j = cells.join(F.broadcast(hp) if small else hp, on="file_path", how="left")
    if require_header:
        j = j.withColumn(
            "header_pos",
            F.when(F.col("header_pos").isNull(), F.raise_error(F.concat(F.lit("Transaction header not found: "), F.col("file_path"))))
            .otherwise(F.col("header_pos")),
        )
    return j.filter(F.col("pos") > F.col("header_pos")).drop("header_pos")


def statement_rows(lines: DataFrame, states: DataFrame) -> DataFrame:
    """ING-01…04 from files: repaired and id-checked records after their file's header.

    ``lines`` and ``states`` come from ``records``: the header is known from the blocks' summaries, and
    every line is split into cells once.
    """
    cells = records.read_records(lines, states)
    return id_filter(repair_ragged(after_header(cells, headers=records.header_positions(states))))


def observed_counters(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """ING-05 without a pass of its own: ``rows`` and an observation that whoever writes them fills in."""
    seen = Observation()
    counters = [
        F.count_if("loaded").cast("long").alias("rows_loaded"),
        F.coalesce(F.sum("popped"), F.lit(0)).cast("long").alias("rows_corrected"),
        F.count_if(~F.col("loaded")).cast("long").alias("rows_skipped"),
    ]
    return rows.observe(seen, *counters), seen


def repair_ragged(rows: DataFrame) -> DataFrame:
    """ING-03: ``n_cells``, ``popped`` (trailing empties removed), ``kept``, 8 ``cells``."""
    n = F.size("cells")
    last_nonempty = F.array_max(F.transform(F.col("cells"), lambda c, i: F.when(c != "", i)))
    trailing = F.when(last_nonempty.isNull(), n).otherwise(n - 1 - last_nonempty)
    popped = F.least(trailing, F.greatest(n - 8, F.lit(0)))
    return rows.select(
        "*",
        n.alias("n_cells"),
        popped.alias("popped"),
        ((n - popped) >= 8).alias("kept"),
    ).withColumn("cells", F.slice("cells", 1, 8))


def id_filter(rows: DataFrame) -> DataFrame:
    """ING-04: ``loaded`` = kept row whose stripped id is non-empty and starts T/S/U."""
    tid = py_strip(F.get(F.col("cells"), 0))
    return rows.withColumn("txn_id", tid).withColumn(
        "loaded", F.col("kept") & (tid != "") & F.substring(tid, 1, 1).isin("T", "S", "U")
    )


def load_counters(rows: DataFrame) -> DataFrame:
    """ING-05: loaded rows, popped fields ("corrected"), skipped rows (one row)."""
    return rows.agg(
        F.count_if("loaded").cast("long").alias("rows_loaded"),
        F.coalesce(F.sum("popped"), F.lit(0)).cast("long").alias("rows_corrected"),
        F.count_if(~F.col("loaded")).cast("long").alias("rows_skipped"),
    )


def _cell(i: int) -> F.Column:
    c = F.get(F.col("cells"), i)
    return F.when(c == "-", F.lit("")).otherwise(F.coalesce(c, F.lit("")))


def normalize_missing(rows: DataFrame) -> DataFrame:
    """ING-06: whole-cell ``-`` and NULL become ``""`` (8 named string columns)."""
    return rows.filter("loaded").select(
        "file_path", "pos", *[_cell(i).alias(PROCESSED_COLUMNS[i]) for i in range(8)]
    ).withColumn("txn_no", py_strip(F.col("txn_no")))


def parse_amount(c: F.Column) -> F.Column:
    """ING-07: strip thousands separators; empty, non-numeric or beyond the type → 0."""
    x = py_strip(F.replace(c, F.lit(","), F.lit("")))
    value = F.when(x.rlike(NUMERIC_RE), x.try_cast(AMOUNT))
    return F.coalesce(value, F.lit(0).cast(AMOUNT)).alias("amt")


def parse_balance(c: F.Column) -> F.Column:
    """ING-08: drop ``Cr.`` and separators; anything else non-numeric → NULL."""
    x = py_strip(F.replace(F.replace(c, F.lit("Cr."), F.lit("")), F.lit(","), F.lit("")))
    return F.when(x.rlike(NUMERIC_RE), x.try_cast(BALANCE))


def parse_date(c: F.Column) -> F.Column:
    """ING-09: day-first date in one of the accepted layouts, a time of day ignored, else NULL."""
    x = F.regexp_replace(py_strip(c), r"[ T]\d{1,2}:\d{2}(:\d{2})?([.]\d+)?( ?[AaPp][Mm])?$", "")
    short = x.rlike(r"^\d{1,2}([-/.]\d{1,2}[-/.]|[- ][A-Za-z]{3}[- ])\d{2}$")
    compact = x.rlike(r"^\d{8}$")
    return F.coalesce(
        F.when(short, F.coalesce(*[F.try_to_date(x, fmt) for fmt in SHORT_YEARS])).when(compact, F.try_to_date(x, COMPACT)).otherwise(
            F.coalesce(*[F.try_to_date(x, fmt) for fmt in DATE_FORMATS])
        )
    )


def typed_rows(normalized: DataFrame) -> DataFrame:
    """ING-07…09: typed columns; rows with an unparseable date are dropped."""
    return normalized.select(
        "file_path",
        "pos",
        "txn_no",
        parse_date(F.col("txn_date")).alias("txn_date"),
        "description",
        "branch_name",
        "cheque_no",
        parse_amount(F.col("dr_amount")).alias("dr_amount"),
        parse_amount(F.col("cr_amount")).alias("cr_amount"),
        parse_balance(F.col("balance")).alias("balance"),
    ).filter(F.col("txn_date").isNotNull())


def with_sequence(typed: DataFrame) -> DataFrame:
    """ING-10: ``seq`` = position in (txn_date, file, line) order, distributed."""
    return row_number_by(typed, [("txn_date", True), ("file_path", True), ("pos", True)], "seq")


def parse_statement(lines: DataFrame) -> DataFrame:
    """ING-02…10 end to end: the processed statement with ``seq``."""
    rows = id_filter(repair_ragged(after_header(with_cells(lines))))
    return with_sequence(typed_rows(normalize_missing(rows)))


# ---------------------------------------------------------------------------
# Statement lines derived from the driver tables (for tests and the query catalogue)
# ---------------------------------------------------------------------------


def _fmt_money(x: F.Column) -> F.Column:
    s = F.format_number(x, 2)
    return F.when(x == 0, F.lit("-")).otherwise(F.concat(F.lit('"'), s, F.lit('"')))


def statement_lines_from_processed(processed: DataFrame) -> DataFrame:
    """Statement files of the orders-derived transactions, one per year and ``FILE_KEYS`` keys.

    Per file: a short preamble line, an 8-cell preamble line starting with ``T``, the
    header.  Per transaction (key ``k``): its record (``,,`` appended when k % 5 = 0,
    a ``Dr.`` balance when k % 11 = 0, a branch name with a quote, a comma and a line break when
    k % 13 = 0) and, derived from the same key, a repeated header
    (k % 50 = 0), a short row (k % 70 = 0), a bad id (k % 90 = 0) and an impossible date
    (k % 110 = 0).  Every transaction survives parsing.  ``pos`` orders a file's records.
    """
    k = F.substring("txn_no", 2, 20).cast("long")
    base = processed.select(
        "*",
        k.alias("k"),
        F.concat(
            F.lit("statement_"), F.year("txn_date").cast("string"), F.lit("_"),
            F.floor(F.substring("txn_no", 2, 20).cast("long") / FILE_KEYS).cast("string"), F.lit(".csv"),
        ).alias("file_path"),
    )
    data = F.concat_ws(
        ",",
        F.col("txn_no"),
        F.date_format("txn_date", "dd-MM-yyyy"),
        F.col("description"),
        F.when(F.col("k") % 13 == 0, F.concat(F.lit('"BR'), (F.col("k") % 7).cast("string"), F.lit(', ""MAIN""\nROAD"'))).otherwise(
            F.concat(F.lit("BR"), (F.col("k") % 7).cast("string"))
        ),
        F.lit("-"),
        _fmt_money(F.col("dr_amount")),
        _fmt_money(F.col("cr_amount")),
        F.when(F.col("k") % 11 == 0, F.lit("500.00 Dr.")).otherwise(F.lit('"10,000.00 Cr."')),
    )
    data = F.when(F.col("k") % 5 == 0, F.concat(data, F.lit(",,"))).otherwise(data)
    header = ",".join(EXPECTED_HEADER)
    variants = F.array(
        F.struct(F.lit(0).alias("j"), data.alias("value")),
        F.struct(F.lit(1).alias("j"), F.when(F.col("k") % 50 == 0, F.lit(header)).alias("value")),
        F.struct(F.lit(2).alias("j"), F.when(F.col("k") % 70 == 0, F.concat(F.lit("S"), F.col("k").cast("string"), F.lit(",06-01-2026,short,row"))).alias("value")),
        F.struct(F.lit(3).alias("j"), F.when(F.col("k") % 90 == 0, F.concat(F.lit("X"), F.col("k").cast("string"), F.lit(",05-01-2026,x,b,-,1,-,-"))).alias("value")),
        F.struct(F.lit(4).alias("j"), F.when(F.col("k") % 110 == 0, F.concat(F.lit("T"), F.col("k").cast("string"), F.lit("B,31-02-2026,bad,b,-,1,-,-"))).alias("value")),
    )
    tx = base.select("file_path", "k", F.explode(variants).alias("v")).filter(F.col("v.value").isNotNull()).select(
        "file_path", (F.lit(10) + F.col("k") * 8 + F.col("v.j")).alias("pos"), F.col("v.value").alias("value")
    )
    files = base.select("file_path").distinct()
    pre = files.select(
        "file_path",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("pos"), F.lit("Account Statement,,").alias("value")),
                F.struct(F.lit(1).cast("long").alias("pos"), F.lit("Tx,a,b,c,d,e,f,g").alias("value")),
                F.struct(F.lit(2).cast("long").alias("pos"), F.lit(header).alias("value")),
            )
        ).alias("p"),
    ).select("file_path", "p.pos", "p.value")
    return pre.unionByName(tx.select("file_path", F.col("pos").cast("long"), "value"))


def write_statements(lines: DataFrame, path: str) -> None:
    """Write lines (file_path, pos, value) as text files, each statement whole and in order.

    A statement is one file, so one task writes it; the derived statements hold ``FILE_KEYS`` keys at most.
    """
    ordered = lines.repartition("file_path").sortWithinPartitions("file_path", "pos")
    ordered.select("value", F.col("file_path").alias("statement")).write.mode("overwrite").partitionBy("statement").text(path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """``records.raw_lines`` of files that ``write_statements`` wrote, under the statements' names."""
    return records.raw_lines(spark, path).withColumn("file_path", F.regexp_extract("file_path", "statement=([^/]+)/", 1))
