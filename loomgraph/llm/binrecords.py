"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard file is a run of records, each ``length (8 bytes) | masked checksum of those 8 bytes (4) | payload | masked checksum of
the payload (4)``, all little-endian. The payload is the document's ids, 2 bytes each or 4 if records are ``wide``.
The checksum is CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that a checksum stored among checked bytes stays useful.
The index is a Parquet table: document, shard file, offset and length of the record, its ids and the ids before it.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.tokencount import byte_symbols

INDEX = "doc_id long, shard int, file string, offset long, length long, local_start long, n_tokens long"
#: Pieces and words that a worker remembers, some 250 bytes each: twice so many pieces, as old ones stay for a while. Marks of pieces met once.
CACHE_PIECES, CACHE_WORDS, SEEN = 200_000, 60_000, 1 << 22
#: The byte-level pre-tokenizer's pattern: a fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
READ_BYTES = 16 << 20
#: Shard files that a reading task keeps open.
OPEN_FILES = 64


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview | bytes, offset: int) -> bytes:
    """The payload of the record at an offset; raises ValueError if a checksum doesn't fit."""
    head = bytes(data[offset : offset + 8])
    if struct.unpack_from("<I", data, offset + 8)[0] != masked(head):
        raise ValueError(f"damaged record length at {offset}")
    n = struct.unpack("<Q", head)[0]
    payload = bytes(data[offset + 12 : offset + 12 + n])
    if len(payload) != n or struct.unpack_from("<I", data, offset + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at {offset}")
    return payload


class Words(dict):
    """Pre-tokenizer piece -> its ids as bytes, by the library's model."""

    def __init__(self, tokenizer, dtype: str):
        super().__init__()
        self.tokenize, self.dtype = tokenizer.model.tokenize, np.dtype(dtype)
        self.symbols = dict(enumerate(byte_symbols()))

    def ids(self, piece: str) -> bytes:
        found = self.tokenize(piece.encode().decode("latin-1").translate(self.symbols))
        return array(self.dtype.char, [t.id for t in found]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[piece] = self.ids(piece)
        return ids


class Pieces(dict):
    """What stands between two single spaces -> the ids of it with the space before.

    Only what is met twice is remembered. When full, all pieces grow old; an old one that is met again is remembered anew, so that only rare ones are lost.
    """

    def __init__(self, words: Words):
        super().__init__()
        self.words, self.space, self.old, self.seen = words, byte_symbols()[0x20], {}, bytearray(SEEN)

    def ids(self, x: str) -> bytes | None:
        """Ids by the library; None if the piece is no unit, as more white space meets a space."""
        if not x or x[0].isspace() or x[-1].isspace():
            return None
        if x.isalpha():  # one word to the pre-tokenizer
            return array(self.words.dtype.char, [t.id for t in self.words.tokenize(self.space + x)]).tobytes() if x.isascii() else self.words.ids(" " + x)
        word = x.rstrip(string.punctuation)
        if word.isalpha():  # one word and a run of signs
            return (self.get(word) or self.old.get(word) or self.ids(word)) + self.words[x[len(word) :]]
        return b"".join(map(self.words.__getitem__, PATTERN.findall(" " + x)))

    def find(self, pieces: list[str], counts: list[int]) -> list[bytes | None]:
        """Ids of distinct pieces, which stand so many times each in the texts at hand."""
        found = list(map(self.get, pieces))
        for i, x in enumerate(pieces):
            if found[i] is not None:
                continue
            ids = found[i] = self.old.get(x)
            if ids is None:
                ids = found[i] = self.ids(x)
                if ids is None:
                    continue
                if counts[i] == 1 and not self.seen[h := hash(x) % SEEN]:
                    self.seen[h] = 1
                    continue
            if len(self) >= CACHE_PIECES:
                self.old, self.seen = dict(self), bytearray(SEEN)
                self.clear()
            self[x] = ids
        return found


class Encoder:
    """Ids of whole texts by the library, as bytes; each distinct piece is encoded once and remembered while there is room.

    Where no other white space meets a space, the pre-tokenizer never looks across one, so what stands between spaces is a
    unit; other texts are cut by the pre-tokenizer's pattern. Texts with characters beyond U+024F, whose classes may depend on
    the Unicode version, or with a special token go to the library whole, and so does every text if the file is of another kind.
    """

    #: The kind of file for which pieces are units: fixed values.
    PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False}

    def __init__(self, file: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.dtype = Tokenizer.from_file(file), np.dtype(dtype)
        self.words = Words(self.tokenizer, dtype)
        self.pieces = Pieces(self.words)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = spec["normalizer"] is None and spec["pre_tokenizer"] == self.PRE_TOKENIZER and all(spec["model"].get(k) == v for k, v in self.MODEL.items())
        self.marks = ["\x1c", "\x1d", "\x1e", "\x1f", *(t["content"] for t in spec["added_tokens"])]

    def whole(self, text: str) -> bool:
        """Whether the library takes the text as it is."""
        if not self.known or any(x in text for x in self.marks):
            return True
        return not text.isascii() and bool(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").max() > 0x24F)

    def uncut(self, text: str) -> bytes:
        """Ids of a text that is not cut at spaces."""
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return b"".join(map(self.words.__getitem__, PATTERN.findall(text)))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. What stands between spaces is looked up once for all the texts, and ids are put together by number."""
        found: list[bytes] = [b""] * len(texts)
        at, rests = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            first, _, rest = text.partition(" ")
            if not first or not rest or first[-1].isspace() or "  " in rest or self.whole(text):
                found[i] = self.uncut(text)
            else:
                at.append(i)
                rests.append(rest)
        if not rests:
            return found
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self.pieces.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(which).tolist())
        bad = [n for n, x in enumerate(ids) if x is None]
        for n in bad:
            ids[n] = b""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts, known = common.ragged(sizes)[:-1], np.frombuffer(b"".join(ids), self.dtype)
        ends = common.ragged(sizes[which])
        put = np.repeat(starts[which] - ends[:-1], sizes[which])
        put += np.arange(len(put))
        all_ids = known[put]
        parts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        cuts = ends[parts].tolist()
        odd = np.add.reduceat(np.isin(which, bad), parts[:-1]) if bad else None
        for k, i in enumerate(at):
            if odd is not None and odd[k]:
                found[i] = self.uncut(texts[i])
            else:
                first = texts[i].partition(" ")[0]
                found[i] = b"".join(map(self.words.__getitem__, PATTERN.findall(first))) + all_ids[cuts[k] : cuts[k + 1]].tobytes()
        return found


@lru_cache(maxsize=2)
def encoder(file: str, dtype: str) -> Encoder:
    return Encoder(file, dtype)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer_file: str, path: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """Encodes every whole text, appends ``end_id``, writes shards in ascending id order under ``path`` and returns the stored index.

    ``wide`` takes 4 bytes an id, for vocabularies beyond 65,536. Null ids come first, null and empty texts are just the end id, repeated ids stay as many records, in the order of their texts'
    hashes, and repeated rows as many equal ones; an empty table writes no shard, and other columns are ignored. Range partitioning gives
    each shard a run of ids of like size. A shard's name is unique to the task attempt and only the attempt whose index rows
    Spark commits is read, so lost executors and speculative attempts leave at most unreferenced files.
    """
    spark = docs.sparkSession
    common.ship(spark)
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, out, at, before = task.partitionId(), None, 0, 0
        name = f"{path}/shard-{shard:06d}-{task.taskAttemptId()}.rec"
        enc = encoder(tokenizer_file, dtype)
        tail = np.array([end_id], dtype=dtype).tobytes()
        width = len(tail)
        for whole in batches:
            for b in common.slices(whole, most=4 << 20):
                if out is None:
                    store, place = _open(name)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place)
                rows = []
                for i, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                    record = frame(ids + tail)
                    out.write(record)
                    n = len(ids) // width + 1
                    rows.append((i, shard, name, at, len(record), before, n))
                    at, before = at + len(record), before + n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    rows = common.with_columns_kept(docs, key, text).repartitionByRange("doc_id", F.xxhash64("text"), F.length("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), F.length("text"))
    return common.stored(rows.mapInArrow(run, INDEX), "record-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before. Shards have one row each here, as many as there were tasks."""
    shards = index.groupBy("shard").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("ids"))
    shards = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return index.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_records(index: DataFrame, *, wide: bool = False, digest: bool = False) -> DataFrame:
    """Reads the records that the index rows name, in whatever order and selection the rows have, and checks them.

    Returns the index columns with ``ids array<int>``, or with ``ids_crc32 long`` (of the ids as 4-byte integers) for a digest.
    """
    common.ship(index.sparkSession)
    dtype = np.dtype("<u4" if wide else "<u2")
    columns = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files = None, OrderedDict()  # a shuffled order goes back and forth between files
        for b in batches:
            got, rows = [], b.to_pylist()
            i = 0
            while i < len(rows):
                r = rows[i]
                if r["file"] != name:
                    name = r["file"]
                    if name not in files:
                        store, place = _open(name)
                        files[name] = store.open_input_file(place)
                        if len(files) > OPEN_FILES:
                            files.popitem(last=False)[1].close()
                    files.move_to_end(name)
                    file = files[name]
                j, end = i + 1, r["offset"] + r["length"]
                while j < len(rows) and rows[j]["file"] == name and rows[j]["offset"] == end and end - r["offset"] < READ_BYTES:
                    end += rows[j]["length"]
                    j += 1
                data = memoryview(file.read_at(end - r["offset"], r["offset"]))
                for x in rows[i:j]:
                    ids = np.frombuffer(unframe(data, x["offset"] - r["offset"]), dtype=dtype)
                    got.append((x["doc_id"], x["start"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64)))
                i = j
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64())))], names=[c.split()[0] for c in columns.split(", ")])

    return index.select("doc_id", "start", "file", "offset", "length").mapInArrow(run, columns)


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """Index rows in a seeded random order, for a training epoch: only the index is shuffled, the records stay where they are."""
    return index.orderBy(F.xxhash64(F.lit(seed), "file", "offset"))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_file: str, *, end_id: int = 0) -> DataFrame:
    """Writes all documents as records and reads every one back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    index = with_starts(write_records(docs, tokenizer_file, common.new_path(spark, "records"), end_id=end_id))
    return read_records(index.repartition(max(1, index.select("shard").distinct().count()), "shard").sortWithinPartitions("shard", "offset"), digest=True)
