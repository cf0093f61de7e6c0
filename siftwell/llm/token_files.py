"""Token-id files: independent zstandard frames, a directory of documents and a trailing seek table.

A file holds the ids of a range of documents in ascending order of their doc_id, each document closed by an end id.
The ids are little-endian unsigned 32-bit integers, cut into frames of a fixed size before compression. Two skippable
frames follow: the directory (doc_id, whether it is null, number of ids) and the seek table of the seekable
zstandard format, which holds the sizes of each frame and a checksum of its content. Any zstandard reader gets the
plain ids; readers that know the table fetch and decompress only the frames that a requested document touches.

Writers name files by attempt and report them as rows. Only files in the table of those rows count, so a task that
is run again, or twice at once, leaves at most a file that nobody refers to.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.batches import slices
from siftwell.llm.shared import fresh_folder, qualified, ship
from siftwell.storage import staged

FRAME_BYTES = 1 << 20
DOCUMENTS_PER_FILE = 8_192
MOST_FILES = 65_536
END_ID = 1
LEVEL = 3

# Fixed values of the seekable zstandard format.
SKIPPABLE_DIRECTORY, SKIPPABLE_TABLE, TABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

# Words up to this many bytes are kept with their ids, so many per worker at most.
KEPT_WORD_BYTES = 64
KEPT_WORDS = 600_000
LINE_WORDS = 500

ID = np.dtype("<u4")

# Hadoop's names of file systems that pyarrow has under others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, word by word.

    Nothing such a tokenizer does to a text reaches over ASCII white space, so the ids of a text are those of its
    words in turn, and each distinct word goes through the tokenizer once as long as it is kept. Ids are kept and given as
    integers of the width that the vocabulary needs.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        mark = self.tokenizer.model.end_of_word_suffix or ""
        self.kind = np.dtype("<u2") if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else ID
        self.ends = np.array([bool(mark) and (self.tokenizer.id_to_token(i) or "").endswith(mark) for i in range(size)])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text as bytes; none for null."""
        if len(self.words) > KEPT_WORDS:
            # Words that came early are the common ones.
            self.words = dict(islice(self.words.items(), KEPT_WORDS // 2))
            self.cores = dict(islice(self.cores.items(), KEPT_WORDS // 2))
        split = [t.split() if t else [] for t in texts]
        new = list(set().union(*split) - self.words.keys())
        parts = list(map(_core, new))
        self._learn({p for pair in parts for p in pair if p and p not in self.cores})
        ids = self.cores.__getitem__
        self.words.update((w, ids(core) + ids(tail) if tail else ids(core)) for w, (core, tail) in zip(new, parts))
        out = [b"".join(map(self.words.__getitem__, found)) for found in split]
        for word, (core, _) in zip(new, parts):
            if len(word) > KEPT_WORD_BYTES:
                del self.words[word]
                self.cores.pop(core, None)
        return out

    def _learn(self, new: set[bytes]) -> None:
        """Words of letters go through the tokenizer in lines, since each gives one run of tokens up to one that ends a word."""
        words = [w.decode() for w in new]
        plain = [w for w in words if w.isalpha() and len(w) <= KEPT_WORD_BYTES]
        others = [w for w in words if not (w.isalpha() and len(w) <= KEPT_WORD_BYTES)]
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for line, found in zip(lines, self.tokenizer.encode_batch_fast(list(map(" ".join, lines)), add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(line):
                others += line
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            bounds = [0, *(ends * size).tolist()]
            self.cores.update((w.encode(), raw[i:j]) for w, i, j in zip(line, bounds, bounds[1:]))
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        self.cores.update((w.encode(), np.array(e.ids, self.kind).tobytes()) for w, e in zip(others, encoded))


_CLOSING = b".,;:!?()*#$%&"


def _core(word: bytes) -> tuple[bytes, bytes]:
    """A word as the tokenizer sees it: without case, punctuation at its end apart.

    Only where that changes nothing: in ASCII, after a letter or digit, and without what might be a special token.
    """
    if not word.isascii() or b"<" in word:
        return word, b""
    low = word.lower()
    core = low.rstrip(_CLOSING)
    return (core, low[len(core) :]) if core[-1:].isalnum() else (low, b"")


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a qualified path by the name that pyarrow knows it under, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + (rest or scheme).lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


class _Writer:
    """Writes one file; `close` returns its row of the manifest."""

    def __init__(self, folder: str, part: int):
        self.part, self.path = part, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        system, path = _open(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.pending, self.frames, self.documents, self.tokens = bytearray(), [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.pending += ids
        self.documents.append((doc_id or 0, doc_id is None, len(ids) // ID.itemsize))
        self.tokens += len(ids) // ID.itemsize
        while len(self.pending) >= FRAME_BYTES:
            self._frame(bytes(self.pending[:FRAME_BYTES]))
            del self.pending[:FRAME_BYTES]

    def _frame(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> tuple[int, str, int, int]:
        if self.pending:
            self._frame(bytes(self.pending))
        ids, nulls, counts = zip(*self.documents)
        packed = zstandard.compress(
            np.array(ids, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(counts, "<i8").tobytes(), LEVEL
        )
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        return self.part, self.path, len(self.documents), self.tokens


class TokenFile:
    """Reads a file by its seek table."""

    def __init__(self, path: str):
        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != TABLE_MAGIC:
            raise ValueError(f"{path} does not end in a seek table")
        self.frames = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.cumsum([0, *self.frames[:, 0]])
        self.raw_ends = np.cumsum(self.frames[:, 1])
        packed = self._at(self.offsets[n - 1] + 8, self.frames[n - 1, 0] - 8)
        directory = zstandard.decompress(packed)
        m = len(directory) // 17
        nulls = np.frombuffer(directory, "u1", m, 8 * m)
        self.doc_ids = [None if null else i for i, null in zip(np.frombuffer(directory, "<i8", m).tolist(), nulls.tolist())]
        self.counts = np.frombuffer(directory, "<i8", m, 9 * m)
        self.starts = np.cumsum(np.append(0, self.counts))[:-1]
        self.decompressor = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(size))

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.decompressor.decompress(self._at(self.offsets[k], self.frames[k, 0]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def pieces(self, row: int) -> Iterator[bytes]:
        """The ids of the document at this place of the directory, frame by frame."""
        a, b = int(self.starts[row]) * ID.itemsize, int(self.starts[row] + self.counts[row]) * ID.itemsize
        k = int(np.searchsorted(self.raw_ends, a, side="right"))
        while a < b:
            begin, end = int(self.raw_ends[k] - self.frames[k, 1]), int(self.raw_ends[k])
            yield self._frame(k)[a - begin : b - begin]
            a, k = end, k + 1

    def ids(self, row: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(row)), ID)


class TokenFiles(NamedTuple):
    """manifest: part, path, n_docs, n_tokens and start of each file; readers: how many tasks should read them."""

    manifest: DataFrame
    readers: int


def write(docs: DataFrame, path: str, folder: str | None = None, documents_per_file: int = DOCUMENTS_PER_FILE) -> TokenFiles:
    """Encode `docs` (doc_id, text) with the tokenizer at `path` and write the ids in ascending doc_id order.

    Null texts are empty ones: their ids are the end id alone. Rows with a null doc_id come last; rows with equal
    doc_id stay together, ordered by their ids. Other columns are not written. An empty table gives no file. Files hold
    about `documents_per_file` documents; beyond MOST_FILES files they hold more.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = qualified(spark, folder or fresh_folder(spark, "tokens"))
    rows = docs.select(F.count(F.lit(1)).alias("n")).first().n
    files = max(1, min(MOST_FILES, -(-rows // documents_per_file)))
    cuts = [i / files for i in range(1, files)]
    bounds = []
    if cuts:
        found = docs.select(F.percentile_approx("doc_id", cuts, max(10_000, 20 * files)).alias("bounds")).first().bounds
        bounds = sorted(set(found or []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = part.column("doc_id").to_pylist()
                ids = pa.array(word_encoder(path).encode(part.column("text").cast(pa.binary()).to_pylist()), pa.binary())
                place = [len(bounds) + 1 if k is None else int(p) for k, p in zip(keys, np.searchsorted(bounds, [k or 0 for k in keys]))]
                columns = [pa.array(place, pa.int32()), pa.array(keys, pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []
        kind, end = word_encoder(path).kind, np.array([END_ID], ID).tobytes()
        for batch in batches:
            for part, key, ids in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")]):
                if writer is None or writer.part != part:
                    if writer is not None:
                        rows.append(writer.close())
                    writer = _Writer(folder, part)
                writer.add(key, np.frombuffer(ids, kind).astype(ID, copy=False).tobytes() + end)
        if writer is not None:
            rows.append(writer.close())
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "path", "n_docs", "n_tokens"])

    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "part int, doc_id long, ids binary")
    # Ids of the ranges, and one for rows without a doc_id.
    ordered = encoded.repartitionById(len(bounds) + 2, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "ids")
    manifest = staged(ordered.mapInArrow(store, "part int, path string, n_docs long, n_tokens long"))
    # One row per file.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).cast("long")
    return TokenFiles(manifest.withColumns({"start": start}), len(bounds) + 2)


def read(files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and a checksum of the ids of every document, from the files."""
    spark = files.manifest.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(path)
                sums = []
                for row in range(len(file.doc_ids)):
                    crc = 0
                    for piece in file.pieces(row):
                        crc = zlib.crc32(piece, crc)
                    sums.append(crc)
                columns = [
                    pa.array(file.doc_ids, pa.int64()), pa.array(file.starts + start, pa.int64()),
                    pa.array(file.counts, pa.int64()), pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.manifest.repartitionById(files.readers, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(files: TokenFiles, wanted: list[int]) -> DataFrame:
    """doc_id and ids of the wanted documents; only the frames they touch are decompressed."""
    ship(files.manifest.sparkSession)
    keys = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file = TokenFile(path)
                rows = [r for r, key in enumerate(file.doc_ids) if key in keys]
                columns = [
                    pa.array([file.doc_ids[r] for r in rows], pa.int64()),
                    pa.array([file.ids(r).tolist() for r in rows], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])

    return files.manifest.repartitionById(files.readers, "part").mapInArrow(run, "doc_id long, ids array<long>")
