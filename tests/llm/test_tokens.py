"""Token files and byte-pair encoding against the library on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import bpe, token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", " ", "  ", "\n", "\t", "\r\n", "　", "\xa0", "é", "ß", "漢", "😀", "1", "23", "'s", "'", "!", "...",
    "<|endoftext|>", "<|", "\x85", "\x1c", " ", "x" * 50, "é", "Σ", "Word", "İ", "?!$$", "),", "THE", "<|startoftext|>", ";",
]


def nasty(seed, n, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_chunks_and_joins_are_exact(monkeypatch):
    monkeypatch.setattr(bpe, "LEAST_CHUNK", 4)
    monkeypatch.setattr(bpe, "CUT_BITS", 2)
    monkeypatch.setattr(bpe, "WINDOW", 3)
    codec, whole = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    texts = nasty(1, 1500)
    for i in range(0, len(texts), 3):
        for text, ids in zip(texts[i : i + 3], codec.encode(texts[i : i + 3])):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
            assert codec.decode(ids) == whole.decode(ids.tolist(), skip_special_tokens=False) == text
    assert codec.chunks


def test_shared_passages_share_chunks(texts):
    codec = bpe.Codec(BYTE)
    long = texts[-1]
    codec.encode([long])
    before = len(codec.chunks)
    codec.encode(["another beginning " + long])
    assert before > 5 and len(codec.chunks) <= before + 3


def test_round_trip(docs, no_docs):
    whole = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.round_trip(docs.withColumn("ids_sha256", F.lit(1)), BYTE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(0)), BYTE), BYTE).collect()
    assert all((r.text or "") == r.decoded for r in back)
    assert bpe.round_trip(no_docs, BYTE).count() == 0


def test_words_encode_as_whole_texts():
    encoder, whole = token_files.WordEncoder(WORD), Tokenizer.from_file(WORD)
    texts = nasty(3, 1500)
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def files(docs):
    return token_files.write(docs.withColumn("part", F.lit("x")), WORD, documents_per_file=9)


def test_files_read_back(files, docs):
    whole = Tokenizer.from_file(WORD)
    rows = sorted(token_files.read(files).collect(), key=lambda r: r.start)
    assert files.manifest.count() > 2 and len(rows) == docs.count()
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    assert rows[-1].doc_id is None
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    at = 0
    for r in rows:
        ids = np.array([*whole.encode(texts[r.doc_id], add_special_tokens=False).ids, token_files.END_ID], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = {r.doc_id: r.ids for r in token_files.lookup(files, [3, 20]).collect()}
    assert set(found) == {3, 20} and found[3][-1] == token_files.END_ID


def test_any_reader_gets_the_ids_and_damage_shows(tmp_path):
    writer = token_files._Writer(str(tmp_path), 0)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 700_000, 3)]
    for i, raw in enumerate(ids):
        writer.add(i, raw)
    _, path, n, tokens = writer.close()
    assert (n, tokens) == (4, 700_008)
    with open(path, "rb") as file:
        plain = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert plain == b"".join(ids)
    reader = token_files.TokenFile(path)
    assert len(reader.frames) > 3 and [reader.ids(i).tobytes() for i in range(4)] == ids
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.offsets[1]) + 40] ^= 1
    open(path, "wb").write(raw)
    damaged = token_files.TokenFile(path)
    assert damaged.ids(1).tobytes() == ids[1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.ids(2)


def test_no_documents_no_files(no_docs):
    files = token_files.write(no_docs, WORD)
    assert files.manifest.count() == 0 and token_files.read(files).count() == 0
