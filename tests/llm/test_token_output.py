import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ionsieve.llm import token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    tokenizer = Tokenizer.from_file(PATH)
    start = 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_output.END_ID]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_give_back_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = token_output.write_sequences(docs, PATH, shard_bytes=100_000)
    assert manifest.count() > 3
    expected = list(plain(sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect())))
    assert sorted(map(tuple, token_output.read_documents(manifest).collect())) == expected
    first = manifest.orderBy("shard").first()
    ids, mask = token_output.read_sequence(first.path, 1)
    assert len(ids) == len(mask) == token_output.SEQUENCE and mask.all() and not ids.flags.owndata
    rows = -(-first.n_tokens // token_output.SEQUENCE)
    ids, mask = token_output.read_sequence(first.path, rows - 1)
    assert mask.sum() == first.n_tokens - (rows - 1) * token_output.SEQUENCE and not ids[~mask].any()


def test_odd_rows(spark, odd_docs, no_docs):
    found = token_output.read_documents(token_output.write_sequences(odd_docs, PATH)).orderBy("start").collect()
    rows = sorted(((x.doc_id, x.text) for x in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [x.doc_id for x in found] == [i for i, _ in rows]
    counts = {(i, n, crc) for i, _, n, crc in plain(rows)}
    assert {(x.doc_id, x.n_tokens, x.ids_crc32) for x in found} == counts
    assert [x.start for x in found] == np.cumsum([0, *(x.n_tokens for x in found[:-1])]).tolist()
    assert token_output.read_documents(token_output.write_sequences(no_docs, PATH)).count() == 0


@pytest.mark.parametrize("text", ["a  b\n\n c", "  x", "x ", "don't stop's.\n\nB", "12,3 4.5%", "…. .…", "<|endoftext|> hi", "é.\nA 'll", "a　b  c"])
def test_pieces_encode_like_the_whole(text):
    from ionsieve.llm.words import text_bytes
    import pyarrow as pa

    encode = token_output.Encoder(PATH)
    ids, begins = encode(*text_bytes(pa.array([text, None, text])))
    expected = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == expected * 2 and begins.tolist() == [0, len(expected), len(expected), 2 * len(expected)]


@pytest.mark.parametrize("text", ["one <|endoftext|> two", "a  <|endoftext|>  b.\n<|endoftext|>\nA", "<|endoftext|><|endoftext|>x <|endoftext", "x <|endoftext|>", "|><|endoftext|>, y"])
def test_added_tokens_are_what_the_library_gives(text):
    from ionsieve.llm.words import text_bytes
    import pyarrow as pa

    expected = [Tokenizer.from_file(PATH).encode(x, add_special_tokens=False).ids for x in (text, "<|endof", "text|> z", text)]
    ids, begins = token_output.Encoder(PATH)(*text_bytes(pa.array([text, "<|endof", "text|> z", text])))
    assert 50256 in expected[0]
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == expected


def test_pieces_are_encoded_once_and_in_one_call(monkeypatch):
    texts = ["a  b, c\n\nd é", " ", "", "x  <|endoftext|>  y", "  two\t\tthree four" + " word" * 20_000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(x.encode()) for x in texts)])
    encoder = token_output.Encoder(PATH)
    library, calls = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, *args, **options):
            calls.append(args)
            return library.encode_batch_fast(*args, **options)

    encoder.tokenizer = Counted()
    expected = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for remembered, n in ((token_output.REMEMBERED, 1), (token_output.REMEMBERED, 1), (1, 2)):
        monkeypatch.setattr(token_output, "REMEMBERED", remembered)
        ids, begins = encoder(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == expected and len(calls) == n
