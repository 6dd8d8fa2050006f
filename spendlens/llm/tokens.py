"""Token ids in Arrow files of equal-length sequences (operator 6).

``write_sequences`` range-partitions documents by id, encodes each partition in one pass and
packs its ids, document after document, into sequences of ``seq_len`` ids.  A partition is one
Arrow IPC file: record batches of ``ROWS_PER_BATCH`` rows with two fixed-size-list columns,
``ids`` (uint16, or uint32 for larger vocabularies) and ``mask`` (true: an id of the corpus,
false: padding after the partition's last id).  Batches are uncompressed and, but for the last,
equally long, so id k of a file is batch ``k // (rows * seq_len)``: a reader maps the file and
slices without copying or scanning.

Files are named per attempt and listed in a manifest that Spark commits; a task run twice or
lost leaves a file nobody reads.  ``read_documents`` goes from the manifest back to the ids.

Encoding: a byte-level BPE never joins ids across the border from a non-space to a space
character, so a text is cut there and each distinct piece is encoded once per worker (a bounded
dictionary, ``CACHE_PIECES``); the ids equal those of encoding the text in one call.  Texts that hold one of the
tokenizer's added tokens literally (``<|endoftext|>``) are encoded in one call, with the library's defaults.

Cases: a null text counts as empty (one end id); null doc_ids come first; rows that repeat a
doc_id are documents of their own, in order of their text; an empty table writes no file.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import on_workers, stage, stage_path, text_of

SEQ_LEN = 2048
ROWS_PER_BATCH = 256
CACHE_PIECES = 1_000_000
PIECES_PER_CALL = 400
END_ID = 0

MANIFEST = "part int, file string, place long, doc_id long, local_start long, n_tokens long"

# white space as the tokenizer's pattern sees it (Unicode White_Space), less space and newline
_ODD_SPACE = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　"
_ODD = re.compile(f"[{_ODD_SPACE}]")
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class Encoder:
    """Ids of texts through the tokenizers library, one library call per new piece only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # strings that the library takes out of a text before anything else, such as control tokens
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.ids: dict[str, bytes] = {}  # of words, by what follows a space
        size = self.library.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.byte_length = np.zeros(size, np.int64)
        for token, i in self.library.get_vocab().items():
            self.byte_length[i] = len(token)  # one letter of the byte alphabet per byte

    @staticmethod
    def plain(text: str) -> bool:
        """Single spaces and newlines are the text's only white space, and it neither starts nor ends with one."""
        return not (
            text[:1] in ("", " ", "\n") or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or _ODD.search(text)
        )

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces; a piece led by a space or newline may follow any text without joining it."""
        led = [p for p in pieces if p[0] in " \n" and not p.isspace()]
        groups = [led[i : i + PIECES_PER_CALL] for i in range(0, len(led), PIECES_PER_CALL)]
        groups += [[p] for p in pieces if p[0] not in " \n" or p.isspace()]
        return self._cut(groups, ["".join(g) for g in groups], 0)

    def learn_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that follow a single space."""
        groups = [words[i : i + PIECES_PER_CALL] for i in range(0, len(words), PIECES_PER_CALL)]
        return self._cut(groups, [" " + " ".join(g) for g in groups], 1)

    def _cut(self, groups: list[list[str]], texts: list[str], led: int) -> dict[str, bytes]:
        """Ids of every piece; a group's text holds its pieces in order, each after ``led`` further bytes."""
        found: dict[str, bytes] = {}
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        for group, text, e in zip(groups, texts, encoded, strict=True):
            ids = np.array(e.ids, dtype=self.kind)
            raw, width = ids.tobytes(), ids.itemsize
            at = np.cumsum(self.byte_length[ids])
            sizes = map(len, group) if text.isascii() else (len(p.encode()) for p in group)
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(group)) + led)
            highs = ((np.searchsorted(at, ends, side="left") + 1) * width).tolist()
            found.update(zip(group, map(raw.__getitem__, map(slice, [0, *highs], highs))))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as packed integers of ``kind``; texts that hold an added token by one library call each."""
        whole = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if not whole:
            return self.by_pieces(texts)
        out: list[bytes] = [b""] * len(texts)
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=self.kind).tobytes()
        rest = sorted(set(range(len(texts))) - set(whole))
        for i, ids in zip(rest, self.by_pieces([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens.

        ``self.ids`` knows words by what follows a single space; other pieces (a text's first word,
        pieces with other white space) are encoded by their whole text.
        """
        held, unknown, whole = [], set(), set()
        for t in texts:
            if self.plain(t):
                first, *words = t.split(" ")
                unknown.update(words)
                held.append(([first], words))
                whole.add(first)
            else:
                pieces = _PIECES.findall(t)
                held.append((pieces, []))
                whole.update(pieces)
        new = self.learn_words(list(unknown.difference(self.ids)))
        of = self.ids.__getitem__
        if len(self.ids) + len(new) <= CACHE_PIECES:
            self.ids.update(new)
        else:
            of = lambda w: self.ids.get(w) or new[w]  # noqa: E731 - a word has at least one id
        other = self.learn(list(whole))
        return [b"".join([*map(other.__getitem__, pieces), *map(of, words)]) for pieces, words in held]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_system(uri: str):
    """(file system, path) of a folder of the shared store, by its URI."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class SequenceFile:
    """Writes packed ids as record batches of ``ROWS_PER_BATCH`` sequences."""

    def __init__(self, folder: str, name: str, kind, seq_len: int):
        self.store, path = file_system(folder)
        self.store.create_dir(path, recursive=True)
        self.kind, self.seq_len = np.dtype(kind), seq_len
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(self.kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))],
            metadata={"rows_per_batch": str(ROWS_PER_BATCH), "seq_len": str(seq_len)},
        )
        self.sink = self.store.open_output_stream(f"{path}/{name}")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.held_bytes = [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.held_bytes += len(ids)
        full = ROWS_PER_BATCH * self.seq_len * self.kind.itemsize
        if self.held_bytes >= full:
            data = b"".join(self.held)
            for low in range(0, len(data) - full + 1, full):
                self._batch(np.frombuffer(data, self.kind, count=ROWS_PER_BATCH * self.seq_len, offset=low))
            rest = data[len(data) // full * full :]
            self.held, self.held_bytes = [rest], len(rest)

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.seq_len)
        flat = np.full(rows * self.seq_len, END_ID, self.kind)
        flat[: len(ids)] = ids
        mask = np.arange(len(flat)) < len(ids)
        self.out.write_batch(
            pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)], schema=self.schema
            )
        )

    def close(self) -> None:
        if self.held_bytes:
            self._batch(np.frombuffer(b"".join(self.held), self.kind))
        self.out.close()
        self.sink.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder`` in ascending doc_id order; returns the manifest.

    Manifest: one row per document with its file, its place there and its ids' range within
    the file.  ``part`` numbers the files in doc_id order.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, out, name, place, at = encoder(tokenizer), None, "", 0, 0
        end = np.array([END_ID], enc.kind).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, 256):
                some = [t or "" for t in texts.slice(low, 256).to_pylist()]
                coded = enc.encode(some)
                if out is None and coded:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
                    out = SequenceFile(folder, name, enc.kind, seq_len)
                counts = np.array([len(c) // np.dtype(enc.kind).itemsize + 1 for c in coded], np.int64)
                for c in coded:
                    out.add(c)
                    out.add(end)
                starts = at + np.cumsum(counts) - counts
                k = len(coded)
                yield pa.record_batch(
                    [
                        pa.array(np.full(k, part, np.int32)), pa.array([name] * k), pa.array(np.arange(place, place + k)),
                        doc_ids.slice(low, 256).cast(pa.int64()), pa.array(starts), pa.array(counts),
                    ],
                    names=["part", "file", "place", "doc_id", "local_start", "n_tokens"],
                )
                place, at = place + k, at + int(counts.sum())
        if out is not None:
            out.close()

    ordered = on_workers(docs).select("doc_id", text_of("text").alias("text")).repartitionByRange(n, "doc_id")
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST)


class SequenceReader:
    """Random access to the ids of one file; local files are memory-mapped."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        store, path = file_system(folder)
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(f"{path}/{name}") if local else store.open_input_file(f"{path}/{name}")
        self.file = pa.ipc.open_file(self.source)
        meta = self.file.schema.metadata
        self.at, self.ids, self.mask = -1, None, None  # the batch read last
        self.per_batch = int(meta[b"rows_per_batch"]) * int(meta[b"seq_len"])

    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if self.at != k:
            batch = self.file.get_batch(k)
            self.at, self.ids, self.mask = k, batch.column(0).flatten().to_numpy(), batch.column(1).flatten()
        return self.ids, self.mask

    def parts(self, start: int, count: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(ids, mask) slices that make up ``count`` ids from ``start`` on."""
        while count > 0:
            k, low = divmod(start, self.per_batch)
            take = min(count, self.per_batch - low)
            ids, mask = self._batch(k)
            yield ids[low : low + take], mask.slice(low, take)
            start, count = start + take, count - take

    def close(self) -> None:
        self.source.close()


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every document's ids back; per row: start (global), n_tokens and ids_crc32 from the files.

    ``n_tokens`` counts the ids whose mask is set; ``ends`` tells whether the last one is the end id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            rows = batch.to_pydict()
            counts, sums, ends = [], [], []
            for file, start, n in zip(rows["file"], rows["local_start"], rows["n_tokens"], strict=True):
                if file != name:
                    if reader is not None:
                        reader.close()
                    name, reader = file, SequenceReader(folder, file)
                crc, real, last = 0, 0, -1
                for ids, mask in reader.parts(start, n):
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                    real += mask.true_count
                    last = int(ids[-1])
                counts.append(real)
                sums.append(crc)
                ends.append(last == END_ID)
            yield pa.record_batch(
                [
                    batch.column("part"), batch.column("doc_id"), batch.column("local_start"),
                    pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(ends, pa.bool_()),
                ],
                names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32", "ends"],
            )

    schema = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ends boolean"
    read = on_workers(manifest).mapInArrow(run, schema)
    # one row per file: its first id's number in the corpus
    sizes = manifest.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return read.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "ends"
    )


def encode_documents(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write ``docs`` as sequence files in the shared folder and read every document back."""
    folder = stage_path(docs.sparkSession, "sequences")
    manifest = stage(write_sequences(docs, folder, tokenizer, seq_len), "manifest")
    return read_documents(manifest, folder)
