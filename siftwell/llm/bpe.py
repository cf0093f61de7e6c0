"""Byte-pair encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts every text where its own content says so, so passages that documents share give
the same chunks wherever they stand. A chunk is encoded once and kept, within bounds, for the documents that follow
in the same worker. The ids of a chunk are right except at its two ends, which the neighbouring chunk may change.
There the join is repaired: the text from the last point in the left chunk to the first point in the right chunk at
which every encoding of the text has a boundary is encoded anew. A chunk without such a point is taken into the join
whole and the join goes on to the next one, until both sides agree.

The points rest on how byte-level BPE splits text before merging: no part of its pattern goes on from a character
that is not white space into white space, so such a place always ends a part, and the split from there on depends
only on what follows. Special tokens hold no white space and never span such a place.

Nothing is shuffled: keeping chunks per worker costs less than moving texts to where a chunk is first seen.
"""

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftwell.llm.batches import slices, with_columns
from siftwell.llm.shared import ship

# The rolling hash: a sum over this many bytes; one position in 2 ** CUT_BITS cuts, never closer than LEAST_CHUNK.
WINDOW = 16
CUT_BITS = 10
LEAST_CHUNK = 256
_BYTE_VALUE = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_MIXER = np.uint32(2654435769)

# Bounds of what a worker keeps: chunks by the bytes of their ids, pieces by number.
KEPT_CHUNK_BYTES = 32 << 20
KEPT_PIECES = 300_000
KEPT_PIECE_BYTES = 64

# A piece ends where white space follows something else.
_PIECE = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
# Bytes with which white space other than a blank or a line feed begins.
_OTHER_SPACE = re.compile(rb"[\t\x0b\x0c\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _pieces(chunk: bytes) -> list[bytes]:
    """The chunk cut wherever a character that is not white space is followed by a blank or a line feed."""
    pieces = _PIECE.findall(chunk)
    if not _OTHER_SPACE.search(chunk):
        return pieces
    joined: list[bytes] = []
    for piece in pieces:
        if joined and joined[-1].decode()[-1].isspace():
            joined[-1] += piece
        else:
            joined.append(piece)
    return joined


def cut_points(data: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Where to cut each of the texts that lie one after another in `data`, whose first bytes are at `starts`.

    Cuts fall between characters and depend on the bytes before them only.
    """
    sums = np.cumsum(_BYTE_VALUE[data], dtype=np.uint32)
    found = np.zeros(0, np.int64)
    if len(data) > WINDOW:
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * _MIXER
        found = np.flatnonzero((rolled >> np.uint32(32 - CUT_BITS)) == 0) + WINDOW + 1
        found = found[found < len(data)]
        found = found[(data[found] & 0xC0) != 0x80]
    ends = np.append(starts[1:], len(data))
    out = []
    for start, end, i, j in zip(starts.tolist(), ends.tolist(), *np.searchsorted(found, [starts, ends]).tolist()):
        cuts, last = [], start
        for cut in found[i:j].tolist():
            if cut - last >= LEAST_CHUNK and cut < end:
                cuts.append(cut)
                last = cut
        out.append(cuts)
    return out


class Codec:
    """Encodes and decodes as the tokenizer file does, without special tokens added, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.pieces: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes | None]] = {}
        self.chunk_bytes = 0
        self.token_bytes = _token_bytes(self.tokenizer, size)

    def _learn(self, pieces: set[bytes]) -> list[bytes]:
        """Learn the ids of pieces, as bytes; returns the long ones, which are to be forgotten after use."""
        new = [p for p in pieces if p not in self.pieces]
        encoded = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        self.pieces.update(zip(new, [array(self.code, e.ids).tobytes() for e in encoded]))
        return [p for p in new if len(p) > KEPT_PIECE_BYTES]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        raw = [t.encode() if t else b"" for t in texts]
        starts = np.cumsum([0, *map(len, raw)])[:-1]
        whole = b"".join(raw)
        documents, fresh = [], {}
        for start, text, cuts in zip(starts.tolist(), raw, cut_points(np.frombuffer(whole, np.uint8), starts)):
            bounds = [start, *cuts, start + len(text)]
            keys = []
            for a, b in zip(bounds, bounds[1:]):
                if a < b:
                    chunk = whole[a:b]
                    key = hashlib.blake2b(chunk, digest_size=16).digest() if len(bounds) > 2 else chunk
                    if key not in self.chunks and key not in fresh:
                        fresh[key] = _pieces(chunk)
                    keys.append(key)
            documents.append(keys)
        # Every chunk once; what can be kept at its ends is known only when joins are made.
        ids_of = self.pieces.__getitem__
        long = self._learn({p for pieces in fresh.values() for p in pieces[1:-1]})
        ready = {
            key: (p[0], b"".join(map(ids_of, p[1:-1])), p[-1] if len(p) > 1 else None) for key, p in fresh.items()
        }
        chunk_of = lambda key: ready.get(key) or self.chunks[key]
        parts = [list(_joined(map(chunk_of, keys))) for keys in documents]
        long += self._learn({p for part in parts for is_text, p in part if is_text})
        out = [b"".join([ids_of(p) if is_text else p for is_text, p in part]) for part in parts]
        for piece in long:
            del self.pieces[piece]
        self._keep(ready)
        return [np.frombuffer(ids, self.dtype) for ids in out]

    def _keep(self, ready: dict) -> None:
        size = sum(len(ids) for _, ids, _ in ready.values())
        if self.chunk_bytes + size > KEPT_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        if size <= KEPT_CHUNK_BYTES:
            self.chunks.update((key, chunk) for key, chunk in ready.items() if len(key) == 16)
            self.chunk_bytes += size

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _joined(chunks: Iterator[tuple[bytes, bytes, bytes | None]]) -> Iterator[tuple[bool, bytes]]:
    """(True, text to encode anew) at joins and ends, (False, ids) of what lies between."""
    seam = b""
    for head, ids, tail in chunks:
        seam += head
        if tail is not None:
            yield True, seam
            yield False, ids
            seam = tail
    if seam:
        yield True, seam


def _token_bytes(tokenizer, size: int) -> list[bytes]:
    """The bytes behind each id. Byte-level vocabularies write the bytes without a visible character of their own,
    in order, as the characters from 256 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokens = [tokenizer.id_to_token(i) or "" for i in range(size)]
    return [bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t in tokens]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, text):
            yield part, codec(path).encode(part.column(text).to_pylist())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the ids of `text` as an array; a column of that name is replaced.

    Null and empty texts have no ids. Rows are encoded one by one, so repeated rows and other columns stay as
    they are, and an empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in encode_batches(batches, path, text):
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            values = pa.array(np.concatenate([*found, []]).astype(np.int32), pa.int32())
            yield with_columns(part, **{ids: pa.ListArray.from_arrays(offsets, values)})

    kept = [f for f in docs.schema.fields if f.name != ids]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids; null ids give an empty text, a column of that name is replaced."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [codec(path).decode(np.array(row or [], np.int64)) for row in part.column(ids).to_pylist()]
                yield with_columns(part, **{text: pa.array(texts, pa.string())})

    kept = [f for f in encoded.schema.fields if f.name != text]
    return encoded.mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, without moving the ids between processes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimals = list(map(str, range(len(codec(path).token_bytes))))
        for part, found in encode_batches(batches, path, "text"):
            listed = [",".join(map(decimals.__getitem__, ids.tolist())) for ids in found]
            decoded = [codec(path).decode(ids) for ids in found]
            yield with_columns(
                part.select(["doc_id"]),
                n_tokens=pa.array(list(map(len, found)), pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
                decoded_sha256=pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
            )

    key = docs.select("doc_id").schema.fields
    strings = [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    schema = T.StructType([*key, T.StructField("n_tokens", T.LongType()), *strings])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
