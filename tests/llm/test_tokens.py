"""Token files: the ids of one library call per text, a round trip, and places in doc_id order."""

import zlib

import numpy as np

from spendlens.llm import tokens
from spendlens.llm.common import stage_path
from spendlens.llm.queries import tokenizer_path
from tests.llm.common import documents, edge_texts, empty


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = [
    "a  b", " lead", "trail ", "\n\nx\n y", "tab\tand\r\nreturn", "it's we'll I'd 'tis", "x1 22 3a", "no\xa0break  em line",
    "\x1c\x1d!\x1e a", "<|endoftext|> inside<|endoftext|>", "hello <|endoftext|> world", " <|endoftext|>", "<|endoftext|><|endoftext|>\n\n", "a<|endoftext", "|endoftext|>", "日本語 テキスト", "é combining", "\x85next", "!!! ... ?", " ", "\n",
]


def test_pieces_encode_like_whole_texts():
    lib, enc = library(), tokens.Encoder(tokenizer_path())
    for texts in (ODD, [t or "" for t in edge_texts()], ODD):
        got = [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(texts)]
        assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_are_the_librarys():
    ids = np.frombuffer(tokens.Encoder(tokenizer_path()).encode(["hello <|endoftext|> world"])[0], np.uint16).tolist()
    assert 50256 in ids and ids == library().encode("hello <|endoftext|> world", add_special_tokens=False).ids


def test_documents_come_back_whole_and_in_order(spark):
    docs = documents(spark, edge_texts() + ODD)
    rows = tokens.encode_documents(docs, tokenizer_path(), seq_len=64).orderBy("start").collect()
    lib, at = library(), 0
    texts = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in docs.select("doc_id", "text").collect()])
    assert [r.doc_id for r in rows] == [t[3] for t in texts]
    for r, (_, _, text, _) in zip(rows, texts, strict=True):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ends) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        at += len(ids)


def test_files_hold_equal_length_sequences(spark):
    folder = stage_path(spark, "test-sequences")
    manifest = tokens.write_sequences(documents(spark), folder, tokenizer_path(), seq_len=128).cache()
    for file, n in manifest.groupBy("file").sum("n_tokens").collect():
        reader = tokens.SequenceReader(folder, file)
        batches = [reader.file.get_batch(k) for k in range(reader.file.num_record_batches)]
        assert all(len(x) == 128 for b in batches for x in b.column("ids"))
        mask = np.concatenate([b.column("mask").flatten().to_numpy(zero_copy_only=False) for b in batches])
        assert mask.sum() == n and mask[:n].all() and len(mask) - n < 128
        reader.close()


def test_empty_table(spark):
    assert tokens.encode_documents(empty(documents(spark)), tokenizer_path()).collect() == []
