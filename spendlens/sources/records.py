"""CSV records of statement files, read in splits although quoted cells may hold line breaks.

Spark deals a file's lines to tasks in blocks.  Whether a line begins a record depends on every quote
before it, so a block is read without knowing where it stands, in two passes over the lines and without
a shuffle of them:

1. ``block_summaries``: each block is walked once under both assumptions (its first line begins a record;
   it stands inside a quoted cell).  The two meet again at the first line that ends alike either way, which
   is nearly every line with a quote.  A block's summary is one row: how many records begin in it, whether it
   ends inside a cell, where its first header record is, for either assumption.
2. ``block_states``: a running composition of these summaries along each file tells how every block begins,
   how many records lie before it and which block holds the head of the record it continues.
3. ``read_records``: each block is cut into records by its own state.  Its leading lines that continue a record,
   and a last record that the block leaves open, are handed on as fragments; only fragments are grouped.

Cells follow the ``csv`` module's default dialect (a quote counts at the beginning of a cell only, doubled
quotes stand for one), and line breaks inside cells become ``\n``.  ``pos`` is the record's number in
its file, from 0.  A quote that is never closed makes the rest of its file, last line break included, one record.
"""

from __future__ import annotations

import csv
import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.session import materialize, ship_package

# The statement header (first 8 cells, stripped).
EXPECTED_HEADER = ["Txn No.", "Txn Date", "Description", "Branch Name", "Cheque No.", "Dr Amount", "Cr Amount", "Balance"]
BROADCAST_BLOCKS = 100_000  # rows of a path and a few numbers; beyond it blocks are shuffled to their state

# a line that begins a cell and leaves one open: complete cells, then a quote without its closing one
_OPEN = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+(?:""[^"]*+)*+', re.S)

SUMMARY = (
    "file_path string, block long, n_lines long, records_out long, inside_out boolean, header_out long, "
    "records_in long, inside_in boolean, header_in long"
)
PIECES = "file_path string, pos long, cells array<string>, owner long, block long, raw string"


def raw_lines(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """(file_path, block, value) of every line, in file order within a task; ``block`` is its split's first byte."""
    source = spark.read.text(path)
    if first_only:
        source = spark.read.text(min(source.inputFiles()))
    return source.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "�", "").alias("value"),
    )


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, which begins inside one or at a record's beginning."""
    if '"' not in line:
        return inside
    return _OPEN.fullmatch('"' + line if inside else line) is not None


def is_header(line: str) -> bool:
    cells = next(csv.reader([line]), [])
    return len(cells) >= 8 and [c.strip() for c in cells[:8]] == EXPECTED_HEADER


def summarise(lines: Iterator[str]) -> tuple:
    """(n_lines, then records, inside, header for a block that begins outside, then inside, a quoted cell)."""
    n_lines = 0
    records, inside, header = [0, 0], [False, True], [None, None]
    for line in lines:
        n_lines += 1
        named: bool | None = None
        for side in (0, 1):
            if not inside[side]:
                if header[side] is None and "Txn No." in line:
                    named = is_header(line) if named is None else named
                    if named:
                        header[side] = records[side]
                records[side] += 1
        if '"' in line:
            alike = inside[0] == inside[1]
            inside[0] = ends_inside(line, inside[0])
            inside[1] = inside[0] if alike else ends_inside(line, inside[1])
    return n_lines, records[0], inside[0], header[0], records[1], inside[1], header[1]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) per block of a task: rows hold the remaining columns; a block's lines stand together."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        key = ahead[:2]

        def own(key=key):
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                current, ahead = ahead, next(source, None)
                yield current[2:]

        lines = own()
        yield key, lines
        for _ in lines:  # what the reader left
            pass


def block_summaries(lines: DataFrame) -> DataFrame:
    """One row per block; see ``SUMMARY``.  A block's lines must stand together and in order in one task."""

    def run(batches):
        for (path, block), rows in _blocks(batches):
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, (path, block, *summarise(r[0] for r in rows)), strict=True))], schema=pa.schema(kinds)
            )

    names = [c.split()[0] for c in SUMMARY.split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    kinds = [(c.split()[0], arrow[c.split()[1]]) for c in SUMMARY.split(", ")]
    return ship_package(lines).select("file_path", "block", "value").mapInArrow(run, SUMMARY)


def block_states(summaries: DataFrame) -> DataFrame:
    """(file_path, block, n_lines, begins, ends, records, first, owner, header_pos) of every block.

    ``begins`` and ``ends``: whether the block begins and ends inside a quoted cell; ``first``: the records of
    the file before it; ``owner``: the block whose last record this one continues; ``header_pos``: the block's first
    header record.  The running composition along a file works on one small row per block.
    """
    along = Window.partitionBy("file_path").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("inside_out") == F.col("inside_in")  # ends alike however it begins
    swap = (F.col("inside_out") & ~F.col("inside_in")).cast("int")
    swaps = summaries.withColumn("settled", settled).withColumn("swaps", F.sum(swap).over(along))
    last = lambda value: F.last(F.when(F.col("settled"), value), ignorenulls=True).over(before)
    after = F.coalesce(F.lag("swaps").over(along), F.lit(0)) - F.coalesce(last(F.col("swaps")), F.lit(0))
    odd = after % 2 == 1
    begins = F.coalesce(last(F.col("inside_out")), F.lit(False)) != odd
    known = swaps.withColumn("begins", begins)
    choose = lambda c: F.when(F.col("begins"), F.col(f"{c}_in")).otherwise(F.col(f"{c}_out"))
    known = known.select("file_path", "block", "n_lines", "begins", choose("inside").alias("ends"), choose("records").alias("records"), choose("header").alias("header"))
    opens = F.col("ends") & (F.col("records") > 0)
    return known.select(
        "file_path", "block", "n_lines", "begins", "ends", "records",
        F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first"),
        F.when(F.col("begins"), F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)).alias("owner"),
        (F.coalesce(F.sum("records").over(before), F.lit(0)) + F.col("header")).alias("header_pos"),
    )


def header_positions(states: DataFrame) -> DataFrame:
    """(file_path, header_pos) of the first header record of every file that has one."""
    return states.where("header_pos is not null").groupBy("file_path").agg(F.min("header_pos").alias("header_pos"))


def cut(lines: Iterator[str], begins: bool, ends: bool, records: int, first: int, owner: int | None, block: int) -> Iterator[tuple]:
    """(pos, cells, owner, block, raw) of a block's records; fragments carry raw text and their owner block."""
    if begins:
        head, inside = [], True
        for line in lines:
            head.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                break
        yield None, None, owner, block, "\n".join(head)
    csv.field_size_limit(sys.maxsize)
    held: list[str] = []

    def fed():
        for line in lines:
            held.append(line)
            yield line + "\n"

    reader, pos = csv.reader(fed()), first
    for cells in reader:
        own, pos = list(held), pos + 1
        held.clear()
        if ends and pos == first + records:
            yield pos - 1, None, block, block, "\n".join(own)
        else:
            yield pos - 1, cells, None, block, None


def _parsed(fragments: DataFrame) -> DataFrame:
    """(file_path, pos, cells) of whole records given as raw text."""

    def run(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            cells = [next(csv.reader([raw + "\n"]), []) for raw in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], names=["file_path", "pos", "cells"])

    return ship_package(fragments).select("file_path", "pos", "raw").mapInArrow(run, "file_path string, pos long, cells array<string>")


def read_records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(file_path, pos, cells) of every record of ``lines`` (from ``raw_lines``), by the blocks' ``states``.

    The cut pieces are stored once; records that lie in one block are read from there as they are, those that cross
    blocks are put together from their fragments.
    """
    small = states.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    wanted = states.select("file_path", "block", "begins", "ends", "records", "first", "owner")
    numbered = lines.withColumn("__at", F.monotonically_increasing_id())
    placed = numbered.join(F.broadcast(wanted) if small else wanted, ["file_path", "block"])
    if not small:  # the shuffle join loses the order of lines
        placed = placed.repartition("file_path", "block").sortWithinPartitions("file_path", "block", "__at")

    def run(batches):
        arrow = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
        held: list[tuple] = []

        def flush():
            columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), arrow, strict=True)]
            held.clear()
            return pa.record_batch(columns, names=["file_path", "pos", "cells", "owner", "block", "raw"])

        for (path, block), rows in _blocks(batches):
            one = next(rows)
            state = one[1:]

            def values(one=one, rows=rows):
                yield one[0]
                for r in rows:
                    yield r[0]

            for piece in cut(values(), *state, block):
                held.append((path, *piece))
                if len(held) >= 10_000:
                    yield flush()
        if held:
            yield flush()

    pieces = ship_package(placed).select("file_path", "block", "value", "begins", "ends", "records", "first", "owner").mapInArrow(run, PIECES)
    stored = materialize(pieces, "record-pieces", uuid.uuid4().hex)
    whole = stored.where("owner is null and raw is null").select("file_path", "pos", "cells")
    parts = F.sort_array(F.collect_list(F.struct("block", "raw")))  # of one record
    crossing = stored.where("raw is not null").groupBy("file_path", "owner").agg(
        F.max("pos").alias("pos"), F.array_join(F.transform(parts, lambda p: p["raw"]), "\n").alias("raw")
    )
    return whole.unionByName(_parsed(crossing))
