"""Token-ID output: documents keyed by identifier in sorted-string-table shards.

File format of a shard (all integers little-endian unless said otherwise):

    data block*   zstd frame of entries; an entry is varint shared, varint unshared, varint ids,
                  the unshared key bytes, then the ids in `width` bytes each. A block's first key is whole.
    index         zstd frame: per block varint key length, last key, varint offset, varint length, crc32 (4 bytes)
    bloom         4 bytes number of probes, then the bits
    footer        FOOTER struct: offsets and lengths of index and bloom, blocks, documents, ids, id width, magic

A key is one byte 0 for a null identifier (sorts first), or byte 1 and the identifier as 8 big-endian bytes with
the sign bit flipped, so that byte order is numeric order.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .textbytes import same_spans, text_views, word_hash

END_ID = 2
BLOCK_BYTES = 1 << 16
#: Bytes of text in a shard, about, where shuffles have too few partitions for that.
SHARD_BYTES = 256 << 20
BLOOM_BITS = 10
BLOOM_PROBES = 7
MAGIC = b"TSSST01\n"
FOOTER = struct.Struct("<QQQQQQQI8s")
#: Pieces remembered with their ids in one worker; a full memory is emptied, which costs time only.
CACHE_PIECES = 800_000


# ---------------------------------------------------------------- tokens

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,$%&*#|;:!?()")] = True
#: Bytes that begin no white space: printable ASCII, and lead bytes under which Unicode has no white space.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *(b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3))]] = True


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places where a byte-level pre-tokenizer always starts a new piece: encoding the pieces alone gives the same ids.

    A space before a visible character belongs to what follows it; a line feed is white space of its own before a
    visible character; a letter run ends at punctuation other than the apostrophe.
    """
    n = len(data)
    at = np.zeros(n + 1, bool)
    at[offs] = True
    if n > 1:
        a, b = data[:-1], data[1:]
        solid = _SOLID[b] & ~at[1:n]
        at[: n - 1] |= ((a == 32) | (a == 10)) & solid
        at[1:n] |= ((a == 10) & solid) | (_LETTER[a] & _PUNCT[b]) | ((b == 10) & _SOLID[a] & (a < 128))
    return np.flatnonzero(at[:n])


def _byte_chars() -> dict[int, str]:
    """The characters under which byte-level vocabularies spell bytes: visible ones stand for themselves, others follow from 256."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    unseen = sorted(set(range(256)) - seen)
    return {b: chr(256 + k) for k, b in enumerate(unseen)}


_BYTE_CHARS = _byte_chars()


class Encoder:
    """Ids of whole texts; equal pieces are encoded once and remembered, by their bytes.

    Texts are cut into pieces only for a tokenizer without a normalizer whose pre-tokenizer is the byte-level one that
    piece_starts() knows; for any other, a text is one piece.

    With `added`, a text that spells an added token (as <|endoftext|>) gets that token's id there, as the library gives
    by default; without, spellings are text like any other.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = {t.content.encode(): (k, t) for k, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        if any(t.lstrip or t.rstrip or t.single_word or (t.normalized and self.tokenizer.normalizer) for _, t in self.added.values()):
            raise ValueError("an added token that takes spaces, whole words or normalised text is not supported")
        # of spellings that start at one place the library takes the longest
        self.spelled = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end_id = end_id
        self.known: dict[bytes, bytes] = {}
        plan = json.loads(self.tokenizer.to_str())
        pre = plan["pre_tokenizer"] or {}
        self.cuts = not plan["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces. A piece of letters, with or without a space before, is one word to the pre-tokenizer: its model is called at once."""
        out: list = [None] * len(pieces)
        tokenize, code, rest = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I", []
        for k, p in enumerate(pieces):
            if not self.cuts:
                rest.append(k)
            elif p in self.added:
                out[k] = array(code, [self.added[p][0]]).tobytes()
            elif (p[1:] if p[0] == 32 else p).decode().isalpha():
                word = p.decode().replace(" ", "\u0120") if p.isascii() else p.decode("latin-1").translate(_BYTE_CHARS)
                out[k] = array(code, [t.id for t in tokenize(word)]).tobytes()
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = array(code, e.ids).tobytes()
        return out

    def _added(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        """Starts and ends of the added tokens' spellings within documents."""
        out: list[tuple[int, int]] = []
        if self.spelled is not None and self.spelled.search(raw):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                out += [m.span() for m in self.spelled.finditer(raw, a, b)]
        return np.array(out, np.int64).reshape(-1, 2)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in turn, each with the end id, and their offsets.

        Added tokens are cut out first: their spellings are pieces of their own, and what lies between is cut as if
        each part were a document.
        """
        raw = data.tobytes()
        if self.cuts:
            cuts = self._added(raw, offs)
            starts = piece_starts(data, np.unique(np.r_[offs, cuts.ravel()]))
            if len(cuts):
                inside = np.cumsum(np.bincount(cuts[:, 0] + 1, minlength=len(data) + 1) - np.bincount(cuts[:, 1], minlength=len(data) + 1)[: len(data) + 1])
                starts = starts[inside[starts] == 0]
        else:
            starts = np.unique(offs[:-1][np.diff(offs) > 0])
        ends = np.append(starts[1:], len(data))
        unique, first, inverse = np.unique(word_hash(data, starts, ends), return_index=True, return_inverse=True)
        # pieces that only share a hash are pieces of their own
        odd = np.flatnonzero(~same_spans(data, starts, ends, starts[first[inverse]], ends[first[inverse]]))
        inverse[odd] = len(first) + np.arange(len(odd))
        first = np.r_[first, odd]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known, keys = self.known, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = [x for x in dict.fromkeys(keys) if x not in known]
        if new:
            known.update(zip(new, self._pieces(new), strict=True))
        parts = [known[x] for x in keys]
        blob = np.frombuffer(b"".join(parts), self.dtype)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        each = size[inverse]
        to = np.cumsum(each)
        body = blob[np.repeat(begin[inverse] - (to - each), each) + np.arange(to[-1] if len(to) else 0)]
        bounds = np.r_[0, to][np.searchsorted(starts, offs)]
        if self.end_id is None:
            return body, bounds
        out = np.insert(body, bounds[1:], self.end_id)
        return out, bounds + np.arange(len(bounds))


# ---------------------------------------------------------------- shards


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, k: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(k)]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ShardWriter:
    """Takes (key, ids) in key order. The file gets its name only when it is whole, so a lost task leaves none."""

    def __init__(self, folder: str, width: int):
        import zstandard

        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        self.path, self.tmp, self.final = f"{folder.rstrip('/')}/{name}.sst", f"{base}/.{name}.tmp", f"{base}/{name}.sst"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.z, self.width = zstandard.ZstdCompressor(level=1), width
        self.block: list[bytes] = []
        self.block_bytes = self.at = self.docs = self.ids = 0
        self.last = b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        body = ids.tobytes()
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(ids)), key[shared:], body]
        self.block_bytes += len(body) + 12
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        frame = self.z.compress(b"".join(self.block))
        self.out.write(frame)
        self.index.append((self.last, self.at, len(frame), zlib.crc32(frame)))
        self.at += len(frame)
        self.block, self.block_bytes = [], 0

    def close(self) -> dict:
        if self.block:
            self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        field = np.zeros(bits, bool)
        for k in self.keys:
            field[_probes(k, bits, BLOOM_PROBES)] = True
        bloom = struct.pack("<I", BLOOM_PROBES) + np.packbits(field, bitorder="little").tobytes()
        index = self.z.compress(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) + c.to_bytes(4, "little") for k, a, n, c in self.index))
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.index), self.docs, self.ids, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.final)
        return {"path": self.path, "first_key": self.keys[0], "last_key": self.last, "n_docs": self.docs, "n_ids": self.ids}

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.tmp)


class Shard:
    """One shard: all documents in key order, or those of one identifier by Bloom filter and binary search."""

    def __init__(self, path: str):
        import zstandard

        fs, base = filesystem(path)
        self.file = fs.open_input_file(base)
        size = self.file.size()
        foot = self.file.read_at(FOOTER.size, size - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, blocks, self.n_docs, self.n_ids, width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.dtype, self.z = np.dtype(f"<u{width}"), zstandard.ZstdDecompressor()
        raw, at = self.z.decompress(self.file.read_at(index_n, index_at)), 0
        self.index: list[tuple[bytes, int, int, int]] = []
        for _ in range(blocks):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            off, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, off, length, int.from_bytes(raw[at : at + 4], "little")))
            at += 4
        bloom = self.file.read_at(bloom_n, bloom_at)
        self.probes, self.bits = struct.unpack("<I", bloom[:4])[0], np.frombuffer(bloom[4:], np.uint8)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, off, length, crc = self.index[k]
        frame = self.file.read_at(length, off)
        if zlib.crc32(frame) != crc:
            raise ValueError("a block of a token shard is damaged")
        raw, at, key = self.z.decompress(frame), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + rest], at + rest
            yield key, np.frombuffer(raw, self.dtype, n, at)
            at += n * self.dtype.itemsize

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), len(self.bits) * 8, self.probes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier."""
        if not self.may_have(doc_id):
            return []
        key, found = key_of(doc_id), []
        k = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            for other, ids in self._block(k):
                if other == key:
                    found.append(ids)
                elif other > key:
                    return found
            k += 1
        return found


# ---------------------------------------------------------------- operators

MANIFEST = "path string, first_key binary, last_key binary, n_docs bigint, n_ids bigint"


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, added: bool = False) -> DataFrame:
    """Encodes every whole text and writes one shard per range of identifiers; returns the manifest of the written shards.

    A null text is empty (its ids are the end id alone); a null identifier sorts first; rows that repeat an identifier
    are all kept, by a hash of their texts, and may take several shards, so one identifier's rows are no single task. An empty table gives no
    shard; long texts are encoded whole; other columns are ignored. The folder must be
    reachable from every executor; by default it is a new one in the shared folder. The manifest names whole files
    only, so files of lost or repeated tasks are never read, and a task that fails deletes its own. `added`: whether
    spelled added tokens get their ids (see Encoder).
    """
    spark = docs.sparkSession
    storage.bound_batches(spark)
    folder = folder or storage.fresh_path(spark, "token-shards")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    by = [F.col("doc_id"), F.xxhash64("text")]
    if partitions is None and (n := storage.parts_of(rows, "text", SHARD_BYTES)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        partitions = n
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, done = Encoder(tokenizer_path, end_id, added), None, None
        try:
            for rows, data, offs in text_views(batches, limit=1 << 21):
                ids, bounds = encoder.encode(data, offs)
                writer = writer or ShardWriter(folder, encoder.dtype.itemsize)
                b = bounds.tolist()
                for k, doc_id in enumerate(rows.column(0).to_pylist()):
                    writer.add(key_of(doc_id), ids[b[k] : b[k + 1]])
            done = writer and writer.close()
        finally:
            if writer and not done:
                writer.abandon()
        if done:
            yield pa.RecordBatch.from_pylist([done], schema=pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return storage.table(dealt.sortWithinPartitions(*by).mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before; it needs the totals of the shards alone (one manifest row each).
    """
    before = Window.orderBy("first_key", "last_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in Shard(path):
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    base += len(ids)
                    if len(rows) == 50_000:
                        yield _read_batch(rows)
                        rows = []
                if rows:
                    yield _read_batch(rows)

    return shards.repartition(n, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))
