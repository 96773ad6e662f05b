"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter and footer."""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import fresh_path, qualified, stash, text_key

BLOCK = 1 << 16
SHARD = 256 << 20
CACHE = 500_000
END_ID = 1
MAGIC = b"TWSST001"
#: Shards in an order of their own: a place's key stands before each id's.
ORDERED = b"TWORDER1"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7


class Encoder:
    """Batch encoding of whole texts that encodes each distinct piece between ASCII white space once.

    Exact for tokenizers that lower the case, drop white space, never merge across it, take a run of letters and a
    run of signs as separate words and close each word with a token that ends in ``</w>``: as ``word_bpe_49k.json``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.closes[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begins, self.sizes = (np.zeros(0, x) for x in ("<u4", np.int64, np.int64))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Add words to the pieces known. ASCII letters are one word of the tokenizer, so they are encoded in
        lines of many and parted again where a word closes."""
        plain = [w for w in words if w.isascii() and w.isalpha()]
        other = [w for w in words if not (w.isascii() and w.isalpha())]
        lines = np.array([i for line in self._encode([" ".join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]) for i in line], "<u4")
        stops = np.flatnonzero(self.closes[lines]) + 1
        if len(stops) != len(plain):
            raise ValueError("words don't close as expected")
        single = self._encode(other)
        sizes = np.concatenate([np.diff(stops, prepend=0), np.fromiter(map(len, single), np.int64, len(single))])
        self.known |= {w: len(self.known) + i for i, w in enumerate(plain + other)}
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, lines, np.array([i for x in single for i in x], "<u4")])
        self.begins, self.sizes = np.concatenate([self.begins, begin]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as little-endian uint32."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else lowering could make a special token
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,]+)([ \n])", r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        named = split.flatten().dictionary_encode()
        words = named.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self._forget()
        self._learn([w for w in words if w not in self.known])
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[named.indices.to_numpy()]
        sizes = self.sizes[index]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(stops[-1]) + np.repeat(self.begins[index] - stops[:-1], sizes)]
        bounds = split.offsets.to_numpy()
        cuts = stops[bounds - bounds[0]]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder for each worker process, so that its pieces outlive a task; their number is bounded by CACHE."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    """Order-preserving key: empty for null, else the id with its sign bit flipped, big-endian."""
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Streams ascending (doc_id, ids) entries into one shard.

    Layout: zstd-compressed blocks; index (for each block: key of its first entry, offset, size); Bloom filter over
    keys; footer (offsets and sizes of both, documents, ids, magic). An entry is varint shared key length, varint
    further key length, varint value length, key bytes, ids as little-endian uint32. With ``ordered`` entries ascend by
    (place, doc_id): a key is the place's and the id's, and the Bloom filter holds the ids' alone.
    """

    def __init__(self, path: str, ordered: bool = False):
        self.magic = ORDERED if ordered else MAGIC
        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        self.path, self.out = path, system.open_output_stream(inner)
        self.block, self.index, self.keys, self.press = bytearray(), [], [], zstandard.ZstdCompressor(level=1)
        self.at = self.docs = self.ids = self.raw = 0
        self.first = self.last = b""

    def add(self, doc_id: int | None, ids: np.ndarray, place: int | None = None) -> None:
        own, value = key_of(doc_id), np.ascontiguousarray(ids, "<u4").tobytes()
        key = own if place is None else key_of(place) + own
        if len(self.block) >= BLOCK:
            self._flush()
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = len(os.path.commonprefix([key, self.last]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(own)
        self.docs, self.ids, self.raw = self.docs + 1, self.ids + len(ids), self.raw + len(value)

    def _flush(self) -> None:
        packed = self.press.compress(bytes(self.block))
        self.index.append((self.first, self.at, len(packed)))
        self.out.write(packed)
        self.at += len(packed)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + struct.pack("<Q", bits) + bloom.tobytes())
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), 8 + len(bloom), self.docs, self.ids, self.magic))
        self.out.close()


class ShardReader:
    """Reads a shard; ``get`` asks the Bloom filter, then binary search in the sparse index, then one block."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.docs, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic not in (MAGIC, ORDERED):
            raise ValueError(f"{path} is no shard")
        self.lead = 8 if magic == ORDERED else 0
        data, at = self._read(index_at, index_n), 0
        self.blocks: list[tuple[bytes, int, int]] = []
        while at < len(data):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.blocks.append((key, offset, length))
        bloom = self._read(bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if n else b""

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n = self.blocks[block]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._read(offset, n)), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            more, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, "<u4", size // 4, at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(len(self.blocks)):
            for key, ids in self.entries(b):
                yield id_of(key[self.lead :]), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents with this identifier."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        if self.lead:  # ids lie in no order
            return [ids for b in range(len(self.blocks)) for k, ids in self.entries(b) if k[self.lead :] == key]
        firsts = [b[0] for b in self.blocks]
        out = []
        for b in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            out += [ids for k, ids in self.entries(b) if k == key]
        return out


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = END_ID, shard_bytes: int = SHARD, order: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored) into shards under ``folder``; returns the manifest.

    Shards are disjoint ranges in ascending doc_id order (nulls first; rows that repeat an id lie side by side). A
    null text is empty and gets its end id alone. A file's name is new in each attempt of a task and the manifest
    names those of attempts that succeeded, so lost executors leave unused files at worst. Manifest: path, low,
    low_tag (first entry), docs, ids. order: a column of whole numbers without nulls that gives the order instead of
    doc_id; low is then its value.
    """
    folder = qualified(docs.sparkSession, folder)
    low_of = F.col(order or "doc_id").cast("long").alias("low")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text"))[0].alias("tag"), F.col("text").cast("string").alias("text"), low_of)
    rows = rows.repartitionByRange(F.col("low").asc_nulls_first(), F.col("tag")).sortWithinPartitions(F.col("low").asc_nulls_first(), "tag")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, done, low = encoder_for(tokenizer_path), None, [], None
        end = np.array([] if end_id is None else [end_id], "<u4")
        name = f"{folder}/shard-{TaskContext.get().partitionId():06d}"
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                texts = part.column(2)
                texts = texts.cast(pa.large_string()) if texts.nbytes > 1 << 30 else texts
                for doc_id, tag, ids, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoder.encode(texts), part.column(3).to_pylist(), strict=True):
                    if out is None:
                        out, low = ShardWriter(f"{name}-{len(done):04d}-{uuid.uuid4().hex}.sst", bool(order)), (at, tag)
                    out.add(doc_id, np.concatenate([ids, end]), at if order else None)
                    if out.raw >= shard_bytes:
                        out.close()
                        done.append((out.path, *low, out.docs, out.ids))
                        out = None
        if out is not None:
            out.close()
            done.append((out.path, *low, out.docs, out.ids))
        columns = list(zip(*done, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "low", "low_tag", "docs", "ids"])

    return stash(rows.mapInArrow(write, "path string, low long, low_tag long, docs long, ids long"), "manifest")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ids) of every document, from the shards' files alone.

    ``start`` counts the ids of all documents before it; shard offsets come from a running sum over the manifest,
    one row for each shard.
    """
    order = Window.orderBy(F.col("low").asc_nulls_first(), "low_tag", "path").rowsBetween(Window.unboundedPreceding, -1)
    # a number of its own: shards are few and small rows, which adaptive execution would merge into one task
    shards = manifest.select("path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, ids in ShardReader(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                    start += len(ids)
                    held += len(ids) if with_ids else 1
                    if held > 100_000:
                        yield _table(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _table(rows, with_ids)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _table(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc_id, start, n, crc, ids = zip(*rows, strict=True)
    columns = [pa.array(x, pa.int64()) for x in (doc_id, start, n, crc)] + ([pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def token_table(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = END_ID, order: str | None = None) -> DataFrame:
    """Write docs as shards (in the shared folder unless ``folder`` is given), by doc_id or ``order``, and read them back."""
    return read_shards(write_shards(docs, tokenizer_path, folder or fresh_path(docs.sparkSession, "shards"), end_id, order=order))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
