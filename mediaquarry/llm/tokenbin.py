"""Token ids as bit- or byte-plane shuffled blocks, and reading them back.

Rows are range-partitioned by doc_id; a task encodes its rows in order, appends the end id to each and cuts the stream
of ids into blocks of BLOCK ids. A block is transposed into planes (plane k holds byte k, or bit k, of every id), each
plane is compressed with zstandard, and header, lengths and planes make one frame. `<path>/blocks` is a Parquet table of
frames with the pieces of documents that each holds; `<path>/index` is the chunk index (shard, block, first id, ids,
bytes), by which one block can be found and read alone. Both go through Spark's writers, so any store that Spark reaches
will do. A frame: 4 bytes MAGIC, then little-endian 32-bit numbers (bits in a plane, ids, planes, each plane's length),
then the planes.

Encoding: byte-level BPE never joins what stands before a single space to what stands after it (unless white space meets
white space there), so a text is encoded piece by piece between such spaces. Pieces are put together from words and the marks
after them; those seen before come from a bounded cache, the others are encoded together, in one text, by the tokenizers library. A text where white space meets white space, or
with the name of an added token in it, goes to the library as it is. The ids are those that the library gives for the whole text.

Defined cases: a null text counts as empty and gives the end id alone; null doc_ids come first; rows that share a doc_id
follow one another by text and each keep a row of their own; an empty table gives empty tables; other columns play no part.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Runs, by_size

BLOCK = 1 << 16
LEVEL = 3
MAGIC = b"MQTB"
#: Runs in the cache; of a full one the half that is used most is kept.
CACHED = 500_000

MARKS = ".,;:!?%*$#&|)"
#: Characters of one text of pieces that are encoded together, and bytes of texts that are split at the same time.
TOGETHER, BYTES_AT_ONCE = 64_000, 4 << 20

BLOCKS = "shard int, block long, first_id long, n_ids int, frame binary, rows array<long>, doc_ids array<long>, lengths array<int>"
BLOCKS_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("frame", pa.binary()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])


class PieceEncoder:
    """Ids of the texts of Arrow columns. The cache has runs of ids of words with the space or line break before them, and of marks after words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.n_bytes[i] = len(piece)  # a character of a byte-level piece stands for a byte
        self.known: dict[str, int] = {}
        self.runs = Runs()
        self.uses = np.zeros(0, np.int64)  # by run, the batches that it was met in, halved whenever the cache is thinned

    def thin(self) -> None:
        """Keep the half of the cache that is used most; of runs used alike those learnt last."""
        count = self.runs.count
        kept = np.lexsort((np.arange(count), self.uses[:count]))[::-1][: CACHED // 2]
        kept = np.sort(kept[np.cumsum(self.runs.lengths[kept]) <= 8 * CACHED])
        ids, lengths = self.runs.joined(kept)
        self.runs = Runs()
        self.runs.add(ids, lengths)
        self.uses = self.uses[kept] // 2
        place = np.full(count, -1)
        place[kept] = np.arange(len(kept))
        place = place.tolist()
        self.known = {x: i for x, old in self.known.items() if (i := place[old]) >= 0}

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, texts: list[str]) -> None:
        """Make runs of texts that are one space or line break and what has no white space at its edges, or marks alone."""
        for before in " \n":
            self.learn_together([x for x in texts if x[0] == before])
        marks = [x for x in texts if x[0] not in " \n"]
        for x, ids in zip(marks, self.library(marks)):
            self.known[x] = self.runs.add(ids, np.array([len(ids)]))

    def learn_together(self, texts: list[str]) -> None:
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and size < TOGETHER:
                size += len(texts[upto])
                upto += 1
            some = texts[at:upto]
            ids = self.library(["".join(some)])[0]
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in some])) + 1
            first = self.runs.add(ids, np.diff(cuts, prepend=0))
            self.known.update(zip(some, range(first, self.runs.count)))
            at = upto

    def numbers(self, texts: pa.Array) -> np.ndarray:
        """The runs of texts; those that aren't known are learnt."""
        texts = texts.dictionary_encode()
        names = texts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            self.learn([names[i] for i in new])
            found[new] = [self.known[names[i]] for i in new]
            self.uses = np.concatenate([self.uses, np.zeros(self.runs.count - len(self.uses), np.int64)])
        self.uses[found] += 1
        return found[np.asarray(texts.indices)]

    def parts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The runs that pieces without white space at their edges are made of, one piece after another, and how many each has."""
        lined = np.asarray(pc.match_substring(pieces, "\n"))
        split = np.flatnonzero(lined)  # into lines, unless some line has white space at its edges
        lists = pc.split_pattern(pieces.take(pa.array(split)), "\n")
        lines, cuts = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        piece = np.repeat(split, np.diff(cuts))
        lined[piece[edgy(lines)]] = False
        later = lined[piece]
        first = np.zeros(len(piece), bool)
        first[cuts[:-1]] = later[cuts[:-1]]
        later &= ~first
        words = pa.concat_arrays([pieces.filter(pa.array(~lined)), lines.filter(pa.array(first)), lines.filter(pa.array(later))])
        piece = np.concatenate([np.flatnonzero(~lined), piece[first], piece[later]])
        # Marks after a word of letters are a token's start for sure: the word is learnt once for all marks that may follow.
        bare = pc.utf8_rtrim(words, MARKS)
        n_marks = np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(bare))
        marked = np.asarray(pc.utf8_is_alpha(bare)) & (n_marks > 0)
        marks = [x[-k:] for x, k in zip(words.filter(pa.array(marked)).to_numpy(zero_copy_only=False).tolist(), n_marks[marked].tolist())]
        bare = pc.if_else(pa.array(marked), bare, words)
        spaced = len(piece) - int(later.sum())
        space, line, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", "\n", ""))
        bare = pa.concat_arrays([pc.binary_join_element_wise(before, x, nothing) for before, x in ((space, bare[:spaced]), (line, bare[spaced:]))])
        runs, tails = self.numbers(bare), np.zeros(len(piece), np.int64)
        tails[marked] = self.numbers(pa.array(marks, pa.large_string()))
        order = np.argsort(piece, kind="stable")
        marked = marked[order]
        ends = np.cumsum(1 + marked)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        out[ends - 1 - marked] = runs[order]
        out[ends[marked] - 1] = tails[order][marked]
        return out, np.bincount(piece[order], 1 + marked, len(pieces)).astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after those of each, and how many each has. Looks for cycles, which none of this makes, would go over the cache again and again."""
        gc.disable()
        try:
            return self.encoded(texts.cast(pa.large_string()).fill_null(""), end_id)
        finally:
            gc.enable()

    def encoded(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if self.runs.count > CACHED or self.runs.used > 16 * CACHED:
            self.thin()
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        cuts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        pieces, doc = lists.flatten(), np.repeat(np.arange(n), np.diff(cuts))
        heads = pieces.take(pa.array(cuts[:-1])).to_pylist()
        whole = np.zeros(n, bool)  # texts that go to the library as they are: white space meets white space, or an added token's name
        for name in self.added:
            whole |= np.asarray(pc.match_substring(texts, name))
        whole[[i for i, x in enumerate(heads) if x[-1:].isspace()]] = True
        inside = np.ones(len(doc), bool)
        inside[cuts[:-1]] = False
        body, doc = pieces.filter(pa.array(inside)).dictionary_encode(), doc[inside]
        seen, codes = body.dictionary, np.asarray(body.indices)
        whole[doc[edgy(seen)[codes]]] = True
        if whole.any():
            inside = ~whole[doc]
            there, codes = np.unique(codes[inside], return_inverse=True)
            seen, doc = seen.take(pa.array(there)), doc[inside]
            for i in np.flatnonzero(whole).tolist():
                heads[i] = texts[i].as_py()
        parts, counts = self.parts(seen)
        ids, lengths = self.runs.joined(parts)
        piece = self.runs.add(ids, np.add.reduceat(lengths, np.cumsum(counts) - counts) if len(seen) else lengths)
        first = self.library(heads)
        head = self.runs.add(np.concatenate([*first, np.array([end_id], np.uint32)]), np.array([*map(len, first), 1]))
        upto = np.cumsum(np.bincount(doc, minlength=n) + 2)
        order = np.empty(int(upto[-1]) if n else 0, np.int64)
        between = np.ones(len(order), bool)
        starts = np.concatenate(([0], upto[:-1]))[:n]
        between[starts] = between[upto - 1] = False
        order[starts], order[upto - 1] = head + np.arange(n), head + n
        order[between] = piece + codes
        ids, lengths = self.runs.joined(order)
        self.runs.forget(piece)  # whole pieces and heads aren't kept
        return ids, np.add.reduceat(lengths, starts) if n else lengths


def edgy(pieces: pa.Array) -> np.ndarray:
    """Which pieces are empty or have white space at an edge."""
    return np.asarray(pc.or_(pc.equal(pieces, ""), pc.not_equal(pieces, pc.utf8_trim_whitespace(pieces))))


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def frame_of(ids: np.ndarray, plane_bits: int = 8) -> bytes:
    """A frame of ids, in planes of 8 bits or 1 bit of each id."""
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        planes = [np.ascontiguousarray(x).tobytes() for x in as_bytes.T]
    elif plane_bits == 1:
        planes = [np.packbits(x, bitorder="little").tobytes() for x in np.unpackbits(as_bytes, axis=1, bitorder="little").T]
    else:
        raise ValueError("planes have 1 or 8 bits of an id")
    packer = zstandard.ZstdCompressor(level=LEVEL)
    packed = [packer.compress(x) for x in planes]
    return b"".join([MAGIC, struct.pack(f"<{3 + len(packed)}I", plane_bits, len(ids), len(packed), *map(len, packed)), *packed])


def ids_of(frame: bytes) -> np.ndarray:
    if frame[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    plane_bits, n, planes = struct.unpack_from("<3I", frame, 4)
    lengths = struct.unpack_from(f"<{planes}I", frame, 16)
    at, unpacker, out = 16 + 4 * planes, zstandard.ZstdDecompressor(), []
    for length in lengths:
        out.append(np.frombuffer(unpacker.decompress(frame[at : at + length], max_output_size=n), np.uint8))
        at += length
    if plane_bits == 1:
        bits = np.stack([np.unpackbits(x, count=n, bitorder="little") for x in out], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    return np.ascontiguousarray(np.stack(out, axis=1)).view("<u4").ravel()


def crc_of_joined(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings after each other, from theirs: the first moves on by the second's bits, modulo the CRC's polynomial."""

    def times(a: int, b: int) -> int:
        product = 0
        for i in range(32):  # bit 31 stands for x^0
            if a >> (31 - i) & 1:
                product ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return product

    power, square, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(power, first) ^ second


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, plane_bits: int = 8, block: int = BLOCK) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order into <path>/blocks and <path>/index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        waiting, n_waiting, pieces = [], 0, []  # ids not yet in a block; (row, doc_id, ids) of them
        row = number = first = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal waiting, n_waiting, pieces, number, first
            ids = np.concatenate(waiting) if len(waiting) > 1 else waiting[0]
            mine, left = [], n
            while left:
                r, doc_id, length = pieces[len(mine)]
                mine.append((r, doc_id, min(length, left)))
                left -= mine[-1][2]
            rest = pieces[len(mine) - 1][2] - mine[-1][2]
            pieces = [(mine[-1][0], mine[-1][1], rest)] * (rest > 0) + pieces[len(mine) :]
            waiting, n_waiting = [ids[n:]], n_waiting - n
            out = pa.RecordBatch.from_pylist([{"shard": shard, "block": number, "first_id": first, "n_ids": n, "frame": frame_of(ids[:n], plane_bits), "rows": [x[0] for x in mine], "doc_ids": [x[1] for x in mine], "lengths": [x[2] for x in mine]}], BLOCKS_ARROW)
            number, first = number + 1, first + n
            return out

        for whole in batches:
            for batch in by_size(whole, "text", BYTES_AT_ONCE):
                ids, lengths = encoder(vocabulary).encode(batch.column("text"), end_id)
                pieces += zip(range(row, row + len(lengths)), batch.column("doc_id").to_pylist(), lengths.tolist())
                waiting, n_waiting, row = [*waiting, ids], n_waiting + len(ids), row + len(lengths)
                while n_waiting >= block:
                    yield cut(block)
        if n_waiting:
            yield cut(n_waiting)

    spark = docs.sparkSession
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = order.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    dealt.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    blocks.select("shard", "block", "first_id", "n_ids", F.octet_length("frame").alias("n_bytes")).coalesce(max(1, parts // 8)).write.parquet(f"{path}/index")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base), base the ids before it: as many rows as shards, that is as tasks that wrote."""
    index = spark.read.parquet(f"{path}/index")
    return index.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("base"))


def read_ids(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """Ids [start, start + n) of the whole stream, by the index: only the blocks that hold some are read. A row for each block: start, ids."""
    first = F.col("base") + F.col("first_id")
    index = spark.read.parquet(f"{path}/index").join(F.broadcast(shard_starts(spark, path)), "shard").select("shard", "block", first.alias("first"), "n_ids")
    wanted = index.where((F.col("first") < start + n) & (F.col("first") + F.col("n_ids") > start))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, frame in zip(batch.column("first").to_pylist(), batch.column("frame")):
                ids = ids_of(frame.as_py())[max(0, start - first) : start + n - first]
                yield pa.RecordBatch.from_arrays([pa.array([max(first, start)]), pa.array([ids.astype("<i8")], pa.list_(pa.int64()))], names=["start", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "block", "frame")
    return blocks.join(wanted, ["shard", "block"]).select("first", "frame").mapInArrow(cut, "start long, ids array<long>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = ids_of(b["frame"])
                cuts = np.concatenate(([0], np.cumsum(b["lengths"])))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([b["shard"]] * len(b["rows"]), pa.int32()), "row": pa.array(b["rows"], pa.int64()), "doc_id": pa.array(b["doc_ids"], pa.int64()),
                    "at": pa.array((b["first_id"] + cuts[:-1]), pa.int64()), "n": pa.array(b["lengths"], pa.int64()),
                    "crc": pa.array([zlib.crc32(ids[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])], pa.int64()),
                })

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column("parts").to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_of_joined(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    bases = shard_starts(spark, path)
    found = blocks.mapInArrow(pieces, "shard int, row long, doc_id long, at long, n long, crc long")
    by_row = found.groupBy("shard", "row", "doc_id").agg(F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    placed = by_row.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "parts")
    return placed.mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long")
