"""Token files: ids packed at the fewest bits that hold the vocabulary, with block offsets for random access.

Documents are range-partitioned and sorted by doc_id, then by the text's beginning and hash, so that rows which share an id or
have none are dealt to many tasks; a partition is a shard. A shard's ids go to frames of about
``FRAME_IDS`` ids (whole documents). A frame: magic, bits, shard, number, ids before it in the shard, document ids and
ends, byte offsets of its blocks of ``BLOCK_IDS`` ids, the packed bits, each block from a whole byte on. Frames name their
own length, so the line feed that Spark's text sink puts after each is skipped. Reading is a bulk numpy unpack; ``ids_at``
reads any range from the blocks that hold it. Starts in the whole order are the shards' totals before plus those inside.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import joined, keyed, lean, only, shared_path, slices, stored, text_batches

END_ID = 2
FRAME_IDS = 1 << 20
BLOCK_IDS = 4096
FRAMES_PER_FILE = 4
MAGIC = b"VLTOK1\0\0"
HEAD = struct.Struct("<8sQIIIQQII")
#: Units of text whose ids a worker remembers (some 60 bytes each), and of those the new ones (some 250 bytes each).
CACHE_UNITS = 700_000
NEW_UNITS = 200_000
#: Texts are encoded in slices of this size.
ENCODE_BYTES = 8 << 20
#: The same two where memory is short, as in the pipeline, whose executors have served other stages; more CPU time.
LEAN_UNITS = 100_000
LEAN_BYTES = 2 << 20
#: White space other than single spaces and line feeds between other characters.
IRREGULAR = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ ]|[ ]$"
#: Units that begin with a space are encoded in lines of this many.
LINE_UNITS = 1024
STEM = re.compile(r"( ?[^\W_]+)([.,]\n?)")
BROADCAST_SHARDS = 200_000
HEAD_CHARS = 32


def bits_for(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as big-endian bit fields of the given width; whole bytes need no bit work."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    every = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(every[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    own = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - bits :] = own
    return np.packbits(full, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def block_starts(n_ids: int, bits: int) -> np.ndarray:
    """Byte offsets of the blocks and of the end."""
    full = (BLOCK_IDS * bits + 7) // 8
    blocks = -(-n_ids // BLOCK_IDS)
    starts = np.arange(blocks + 1, dtype=np.uint64) * np.uint64(full)
    if blocks:
        starts[-1] = (blocks - 1) * full + ((n_ids - (blocks - 1) * BLOCK_IDS) * bits + 7) // 8
    return starts


def frame(shard: int, number: int, before: int, doc_ids: list, ends: list[int], ids: np.ndarray, bits: int) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], np.int64)
    starts = block_starts(len(ids), bits)
    if bits % 8 == 0 or BLOCK_IDS * bits % 8 == 0:  # blocks end on whole bytes, so one call packs all of them
        body = pack(ids, bits)
    else:
        body = b"".join(pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS))
    tables = docs.tobytes() + known.tobytes() + np.array(ends, np.int64).tobytes() + starts.tobytes()
    return HEAD.pack(MAGIC, HEAD.size + len(tables) + len(body), bits, shard, number, before, len(ids), len(doc_ids), len(starts)) + tables + body


class Frame:
    """A frame in a buffer; nothing is unpacked until it is asked for."""

    def __init__(self, data: memoryview):
        magic, self.size, self.bits, self.shard, self.number, self.before, self.n_ids, n, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token frame")
        at = HEAD.size
        docs = np.frombuffer(data, np.int64, n, at)
        known = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(docs, known)]
        self.ends = np.frombuffer(data, np.int64, n, at + 9 * n)
        self.starts = np.frombuffer(data, np.uint64, blocks, at + 17 * n)
        self.body = data[at + 17 * n + 8 * blocks : self.size]

    def ids(self) -> np.ndarray:
        return self.ids_at(0, self.n_ids)

    def ids_at(self, first: int, end: int) -> np.ndarray:
        """Ids [first, end) of the frame, read from the blocks that hold them."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK_IDS, -(-end // BLOCK_IDS)
        n = min(self.n_ids, b * BLOCK_IDS) - a * BLOCK_IDS
        return unpack(self.body[int(self.starts[a]) : int(self.starts[b])], n, self.bits)[first - a * BLOCK_IDS : end - a * BLOCK_IDS]


def frames(data: bytes) -> Iterator[Frame]:
    view, at = memoryview(data), 0
    while at < len(view):
        made = Frame(view[at:])
        yield made
        at += made.size + 1


def listed(parts: list[bytes], kind: type) -> pa.ListArray:
    """Packed ids of a numpy kind as an Arrow list each."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), kind)))


class Encoder:
    """Whole texts to ids. Ids of a text are those of its units in a row, so units seen before need no new encoding.

    A unit begins at a single space, or after a single line feed, between two characters that are not white space: the
    tokenizer always splits there. A new unit that is letters and digits with a full stop or comma behind is split again.
    Texts with other white space, or with an added token's content, are encoded whole. Known units are an Arrow table, looked up a slice of texts at a time;
    units new since it was made are in a dict.
    """

    def __init__(self, path: str, most_new: int | None = None):
        self.most_new = most_new or NEW_UNITS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([IRREGULAR, *added])
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.batch = self.tok.encode_batch_fast if hasattr(self.tok, "encode_batch_fast") else self.tok.encode_batch
        space = self.tok.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]  # how a space is written in the vocabulary
        self.opens = np.zeros(self.vocab, bool)
        self.opens[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.startswith(space)]] = True
        self.new: dict[str, bytes] = {}
        self.kind, self.code = (np.uint16, "H") if self.vocab <= 1 << 16 else (np.uint32, "I")
        self.keys, self.table, self.used = pa.array([], pa.string()), listed([], self.kind), np.zeros(0, np.int64)

    def many(self, parts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.batch(parts, add_special_tokens=False)]

    def spaced(self, units: list[str]) -> list[bytes]:
        """Ids of units that begin with their only space, encoded in lines: the first token of each holds the space."""
        out: list[bytes] = []
        lines = [units[i : i + LINE_UNITS] for i in range(0, len(units), LINE_UNITS)]
        for own, e in zip(lines, self.batch(["".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(own) or cuts[0]:
                out += self.many(own)
                continue
            data, ends = ids.tobytes(), (np.append(cuts, len(ids)) * ids.itemsize).tolist()
            out += [data[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def learn(self, units: list[str]) -> list[bytes]:
        """Ids of units that the settled table lacks."""
        new = self.new
        missing = [u for u in units if u not in new]
        parts = {u: m.groups() for u in missing if (m := STEM.fullmatch(u))}
        fresh = list({x for m in parts.values() for x in m}.union(u for u in missing if u not in parts).difference(new))
        begin = [u for u in fresh if u[:1] == " " and u[-1] not in " \n"]
        rest = [u for u in fresh if u[:1] != " " or u[-1] in " \n"]
        new.update(zip(begin, self.spaced(begin)))
        new.update(zip(rest, self.many(rest)))
        for u, (stem, tail) in parts.items():
            new[u] = new[stem] + new[tail]
        return list(map(new.__getitem__, units))

    def settle(self) -> None:
        """Move new units to the table, with those of its own that most slices used."""
        best = np.argsort(-self.used, kind="stable")[: CACHE_UNITS - self.most_new]
        best = pa.array(np.sort(best[self.used[best] > 0]))
        units, ids = listed(list(self.new.values()), self.kind), pa.array(list(self.new), pa.string())
        self.keys = pa.concat_arrays([self.keys.take(best), ids])
        self.table = pa.concat_arrays([self.table.take(best), units])
        self.used = np.zeros(len(self.keys), np.int64)
        self.new = {}

    def encode_regular(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.new) > self.most_new:
            self.settle()
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(batch, "\n", "\n\0"), " ", "\0 "), "\0")
        coded = split.values.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        lacking = np.flatnonzero(place < 0)
        self.used[place[place >= 0]] += 1
        fresh = listed(self.learn(coded.dictionary.take(pa.array(lacking)).to_pylist()), self.kind)
        place[lacking] = len(self.table) + np.arange(len(lacking))
        table = pa.concat_arrays([self.table, fresh])
        sizes = np.diff(table.offsets.to_numpy()).astype(np.int64)
        index = place[coded.indices.to_numpy()]
        total = np.concatenate(([0], np.cumsum(sizes[index])))
        return table.take(pa.array(index)).values.to_numpy(), np.diff(total[split.offsets.to_numpy()])

    def encode(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number for each text."""
        batch = batch.cast(pa.string())
        odd = pc.match_substring_regex(batch, self.odd)
        plain = ~odd.to_numpy(zero_copy_only=False)
        if plain.all() and len(batch):
            return self.encode_regular(pa.concat_arrays([batch]))
        each: list[np.ndarray] = [np.zeros(0, self.kind)] * len(batch)
        if plain.any():
            ids, counts = self.encode_regular(batch.filter(pa.array(plain)))
            for i, part in zip(np.flatnonzero(plain), np.split(ids, np.cumsum(counts)[:-1])):
                each[i] = part
        rest = np.flatnonzero(~plain)
        for i, ids in zip(rest, self.many(batch.take(pa.array(rest)).to_pylist())):
            each[i] = np.frombuffer(ids, self.kind)
        return np.concatenate(each) if each else np.zeros(0, self.kind), np.array([len(e) for e in each], np.int64)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, short: bool = False) -> Encoder:
    if (path, short) not in _encoders:
        _encoders[path, short] = Encoder(path, LEAN_UNITS if short else None)
    return _encoders[path, short]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, short: bool = False) -> None:
    """Write the ids of ``docs(doc_id, text)`` under ``path`` in ascending doc_id order (null first; equal ids by the first
    ``HEAD_CHARS`` characters of the text, then by its hash), the end id after each."""
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text_batches(docs.sparkSession)
    # Equal rows can stand in any order, so a number drawn for each deals them too.
    placed = rows.select("doc_id", "text", F.substring("text", 1, HEAD_CHARS).alias("head"), F.xxhash64("text").alias("hash"), F.rand(7).alias("any"))
    rows = placed.repartitionByRange("doc_id", "head", "hash", "any").sortWithinPartitions("doc_id", "head", "hash").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer, short), TaskContext.get().partitionId()
        bits, end = bits_for(max(enc.vocab, end_id + 1)), np.uint32(end_id)
        number = before = held = 0
        doc_ids, ends, parts = [], [], []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([frame(shard, number, before, doc_ids, ends, np.concatenate(parts), bits)], pa.binary())], ["frame"])

        for batch in batches:
            for a, b in slices(batch, "text", LEAN_BYTES if short else ENCODE_BYTES):
                part = batch.slice(a, b - a)
                ids, counts = enc.encode(part.column("text"))
                stops = np.cumsum(counts)
                parts.append(np.insert(ids.astype(np.uint32), stops, end))
                ends += (held + stops + np.arange(1, len(stops) + 1)).tolist()
                doc_ids += part.column("doc_id").to_pylist()
                held += len(ids) + len(stops)
                if held >= FRAME_IDS:
                    yield done()
                    number, before, held = number + 1, before + held, 0
                    doc_ids, ends, parts = [], [], []
            pa.default_memory_pool().release_unused()
        if doc_ids:
            yield done()

    rows.mapInArrow(lean(run), "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", "\n").option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for f in frames(content.as_py()):
                    raw = memoryview(np.ascontiguousarray(f.ids(), "<u4")).cast("B")
                    starts = np.concatenate(([0], f.ends[:-1]))
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), f.ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([f.shard] * len(crc), pa.int64()), pa.array(f.doc_ids, pa.int64()), pa.array(starts + f.before), pa.array(f.ends - starts), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    rows = stored(files.select("content").mapInArrow(lean(run), "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = stored(totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "shards")
    rows = joined(rows, keyed(base, "shard"), ["shard"], "inner", BROADCAST_SHARDS, base.count())
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, tokenizer: str | None = None, short: bool = False) -> DataFrame:
    """Token files of ``docs``, read back; ``short`` is for workers with little memory left."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path(), short=short)
    return read_tokens(docs.sparkSession, path)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"))
