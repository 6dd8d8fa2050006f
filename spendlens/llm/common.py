"""Helpers shared by the operators: table reads, stage tables, word hashing in numpy.

Stage tables go to the shared folder the session names (see ``spendlens.session``), never
to a machine's own disk.  The numpy helpers work on one bounded chunk of texts at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import application_folder

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
CHUNK_BYTES = 1 << 20  # texts are hashed in chunks of about this size (one text is never cut)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark, 'spendlens-llm')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it (cuts the lineage)."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_folder = path
    return out


def release(*stages: DataFrame) -> None:
    """Delete stage tables whose every reader has been written; the application's end deletes the others."""
    for df in stages:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stage_folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def on_workers(df: DataFrame) -> DataFrame:
    """``df``; Python workers that Spark starts from now on find this package where the driver did."""
    env = df.sparkSession.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, have)])
    return df


def text_of(column: str):
    """The text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


# ---------------------------------------------------------------------------
# Word classes and word hashes (bytes of UTF-8; multi-byte characters never hold ASCII)
# ---------------------------------------------------------------------------


def _mask(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


# words of [^\x20\x09-\x0D]+
SPACE_WORDS = _mask(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z): digits, letters, non-ASCII;
# upper-case letters count because they are lower-cased first
ALNUM_WORDS = _mask(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)

_U = np.uint64
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) | _U(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z hash as a-z
_BASE = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def hash_words(texts: list[bytes], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and where each text's words begin.

    Returns ``(hashes, offsets)``: text i has the words ``hashes[offsets[i]:offsets[i+1]]``.
    A-Z hash as a-z.
    """
    hashes, offsets, _ = hash_words_at(texts, word_bytes)
    return hashes, offsets


def hash_words_at(texts: list[bytes], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``hash_words``, and each word's length in bytes."""
    n = len(texts)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=n)
    ends_of_text = np.cumsum(sizes)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = word_bytes[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    lengths = ends - starts
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64), lengths
    places = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(places)) - np.repeat(first, lengths)
    terms = _BYTE[data[places]] * _powers(int(lengths.max()))[within]
    hashes = mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    offsets = np.zeros(n + 1, np.int64)
    offsets[1:] = np.searchsorted(starts, ends_of_text, side="left")
    return hashes, offsets, lengths


_PLACE = np.random.default_rng(77).integers(1, 1 << 63, size=64, dtype=np.uint64) | _U(1)


def hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words: result[i] stands for words[i:i+n]."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    last = len(words) - n + 1
    total = np.zeros(last, np.uint64)
    for k in range(n):
        total += words[k : k + last] * _PLACE[k]
    return mix64(total)


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) in chunks of about ``limit`` bytes; null counts as empty."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and total + len(t) > limit:
            yield first, held
            first, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield first, held


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as a list of UTF-8 byte strings."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
