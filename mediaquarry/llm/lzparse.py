"""Repeated passages by relative Lempel-Ziv parsing.

A window of WINDOW words that also starts in a document with a smaller doc_id is a repeat. The corpus is indexed in blocks:
each window belongs to the block of its anchor, the least-hashed of its runs of ANCHOR words, so that equal windows always
meet in one block and documents are parsed against no other. Consecutive windows with one anchor are a segment. In a block,
segments come in the order of doc_id and are factored greedily: where a window of the segment stands in the index of
earlier ones, the factor runs on as long as the words agree; factors of WINDOW words and more are repeats. A window that
straddles the end of a factor may still stand elsewhere in the block, so each is looked up by itself before the next factor
begins. Segments overlap where anchors change; what their factors cover adds up to a document's repeated spans.

What doesn't repeat isn't shuffled as text: a first pass counts anchors, and only those of two documents or more are
blocks. They reach the tasks as a bit table of at most FILTER_BITS, which lets a few more through and drops none. Anchors
of more than HOT segments (common passages) would be large blocks: their windows go one by one. Spark groups them by their
words, with map-side sums; windows with more than a COMMON-th of all occurrences, of which there can be no more than COMMON,
are one more block, broadcast as digests of fixed size, against which every task parses the documents that it reads; the
others, none of which is hot, are joined by their words. Words are compared as they are, but for that digest (SHA-256);
other hashes only choose blocks.

Defined cases: a null text has no words; a null doc_id is no smaller than any, so such rows are no reference and lose nothing;
rows alike in doc_id (whether or not their texts are) are no references for each other; repeats within a document stay; very
long texts and words are worked on whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpointed, discard, stored

WINDOW = 13
ANCHOR = 5
#: Segments of an anchor beyond which its windows go one by one.
HOT = 2000
COMMON = 100_000
#: At most 64 MB; so many bits for each anchor as long as that allows it.
FILTER_BITS, ROOM = 1 << 29, 16
BITMAP_BITS = 32768
BATCH_BYTES, HASHED_BYTES, LONG_WORD = 2 << 20, 1 << 19, 1 << 16

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = np.frombuffer(hashlib.shake_256(b"bytes").digest(2048), "<u8")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, from its bytes alone."""
    out = np.empty(len(starts), np.uint64)
    long_ones = np.flatnonzero(ends - starts > LONG_WORD)
    at = 0
    up = down = None
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED_BYTES, "right")))
        low, high = starts[at], ends[upto - 1]
        if high - low <= HASHED_BYTES:
            if up is None:
                up, down = powers(MULTIPLIER, HASHED_BYTES), powers(INVERSE, HASHED_BYTES + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(BYTE_CODES[data[low:high]] * up[: high - low], out=sums[1:])
            out[at:upto] = (sums[ends[at:upto] - low] - sums[starts[at:upto] - low]) * down[starts[at:upto] - low]
        at = upto
    out = mixed(out + (ends - starts).astype(np.uint64))
    for i in long_ones:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A number for each n hashes that follow one another."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * MULTIPLIER + h[j : len(h) - n + 1 + j]
    return mixed(out)


class Words:
    """The words of a column of texts: in bytes starts[i] to ends[i] of data, of row rows[i]; word w of a row is first[row] + w."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = (data != 32) & ((data < 9) | (data > 13))
        breaks = np.zeros(len(data) + 1, bool)  # a row begins here
        breaks[offsets[:-1]] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        self.starts = np.flatnonzero(inside & (~before[:-1] | breaks[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.rows, np.arange(len(column)))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window (by first word) of each segment, its anchor's hash, and the hashes of all words."""
        h = hashed(self.data, self.starts, self.ends)
        none = np.zeros(0, np.int64)
        if len(h) < WINDOW:
            return none, none, np.zeros(0, np.uint64), h
        g = runs(h, ANCHOR)
        n = len(h) - WINDOW + 1
        least, at = g[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, WINDOW - ANCHOR + 1):
            lower = g[j : j + n] < least
            least[lower] = g[j : j + n][lower]
            at[lower] = j
        at += np.arange(n)
        whole = self.rows[:n] == self.rows[WINDOW - 1 :]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
        begins = np.flatnonzero(new & whole)
        last = np.ones(n, bool)
        last[:-1] = new[1:] | ~whole[1:]
        return begins, np.flatnonzero(last & whole), least[begins], h

    def joined(self, begins: np.ndarray, upto: np.ndarray) -> pa.Array:
        """For each range of words a string of them, parted by one space."""
        sizes = upto - begins
        words = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        lengths = self.ends[words] - self.starts[words] + 1
        past = np.cumsum(lengths)
        index = np.repeat(self.starts[words] - (past - lengths), lengths) + np.arange(past[-1] if len(past) else 0)
        data = self.data[np.minimum(index, len(self.data) - 1)]
        data[past - 1] = 32
        cuts = past[np.cumsum(sizes) - 1] if len(sizes) else past
        offsets = np.zeros(len(sizes) + 1, np.int64)
        offsets[1:] = cuts
        return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


ANCHORS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
PARTS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("same", pa.int64()), ("at", pa.int32()), ("words", pa.large_string())])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each document, with their segments."""
    for whole in batches:
        for batch in by_size(whole, "text", BATCH_BYTES):
            words = Words(batch.column("text"))
            begins, _, anchors, _ = words.segments()
            if len(begins):
                ids = np.asarray(batch.column("doc_id"))[words.rows[begins]]
                order = np.lexsort((anchors, ids))
                ids, anchors = ids[order], anchors[order]
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (anchors[1:] != anchors[:-1])
                cuts = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchors[cuts])), pa.array(ids[cuts]), pa.array(np.diff(np.append(cuts, len(ids))))], schema=ANCHORS)


class Bits:
    """A table of bits for anchors, of bounded size."""

    def __init__(self, anchors: DataFrame, n: int):
        self.bits = BITMAP_BITS
        while self.bits < min(n * ROOM, FILTER_BITS):
            self.bits *= 2
        places = anchors.select(F.explode(F.array(F.col("anchor").bitwiseAND(F.lit(self.bits - 1)), F.shiftrightunsigned("anchor", 32).bitwiseAND(F.lit(self.bits - 1)))).alias("p")).withColumn("p", F.col("p") + 1)
        maps = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
        self.table = np.zeros(self.bits // 8, np.uint8)
        for r in maps.toLocalIterator():  # FILTER_BITS at most
            at = (r.bucket - 1) * BITMAP_BITS // 8
            self.table[at : at + BITMAP_BITS // 8] = np.frombuffer(r.bitmap, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for shift in (0, 32):
            p = ((h >> np.uint64(shift)) & np.uint64(self.bits - 1)).astype(np.int64)
            found &= (self.table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return found


def kept_segments(batch: pa.RecordBatch, shared: Bits, hot: Bits | None, want_hot: bool) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the batch, and first and last window and anchor of segments of blocks, or, of hot ones, of single windows."""
    words = Words(batch.column("text"))
    begins, lasts, anchors, _ = words.segments()
    keep = shared.has(anchors)
    if hot is not None:
        keep &= hot.has(anchors) == want_hot
    begins, lasts, anchors = begins[keep], lasts[keep], anchors[keep]
    if want_hot:
        sizes = lasts - begins + 1
        begins = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        lasts, anchors = begins, np.repeat(anchors, sizes)
    return words, begins, lasts, anchors


def shared_segments(shared, hot, want_hot: bool, common=None):
    """For mapInArrow: segments of blocks, or, of hot ones, single windows but the common ones. The arguments are broadcast (hot and common may be None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", BATCH_BYTES):
                words, begins, lasts, anchors = kept_segments(batch, shared.value, hot and hot.value, want_hot)
                ids, same = np.asarray(batch.column("doc_id")), np.asarray(batch.column("same"))
                for at in range(0, len(begins), 20000):
                    few, last, anchor = begins[at : at + 20000], lasts[at : at + 20000], anchors[at : at + 20000]
                    strings = words.joined(few, last + WINDOW)
                    if common:
                        rest = np.array([digest(x) not in common.value for x in strings.to_pylist()], bool)
                        few, anchor, strings = few[rest], anchor[rest], strings.filter(pa.array(rest))
                    rows = words.rows[few]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(ids[rows]), pa.array(same[rows]), pa.array((few - words.first[rows]).astype(np.int32)), strings], schema=PARTS)

    return run


def digest(words: str) -> bytes:
    return hashlib.sha256(words.encode()).digest()


def parsed_by_common(shared, hot, common):
    """For mapInArrow: spans of words that the windows in common (digest: first document) repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", BATCH_BYTES):
                words, begins, _, _ = kept_segments(batch, shared.value, hot.value, True)
                ids, same = np.asarray(batch.column("doc_id")), np.asarray(batch.column("same"))
                met = []
                for at in range(0, len(begins), 20000):
                    few = begins[at : at + 20000]
                    firsts = [common.value.get(digest(x)) for x in words.joined(few, few + WINDOW).to_pylist()]
                    met.append(few[np.array([f is not None and f < doc for f, doc in zip(firsts, ids[words.rows[few]].tolist(), strict=True)], bool)])
                found = np.sort(np.concatenate(met)) if met else begins
                if len(found):
                    rows = words.rows[found]
                    new = np.ones(len(found), bool)
                    new[1:] = (found[1:] > found[:-1] + WINDOW) | (rows[1:] != rows[:-1])  # factors that follow one another are one span
                    first, last = found[new], found[np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)]
                    rows = words.rows[first]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(same[rows]), pa.array((first - words.first[rows]).astype(np.int32)), pa.array((last + WINDOW - words.first[rows]).astype(np.int32))], schema=SPANS)

    return run


SPANS = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])


class Block:
    """The index of one block: where each window stood first, and the words that follow it there."""

    def __init__(self):
        self.index: dict[tuple[bytes, ...], tuple[int, list[bytes], int]] = {}

    def factors(self, doc: int, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Ranges of words that repeat earlier documents; then the segment is part of the block."""
        at = 0
        while at + WINDOW <= len(words):
            window = tuple(words[at : at + WINDOW])
            met = self.index.setdefault(window, (doc, words, at))
            first, there, place = met
            if first == doc:  # a literal: nothing earlier has it
                at += 1
                continue
            n = WINDOW
            while at + n < len(words) and place + n < len(there) and words[at + n] == there[place + n]:
                n += 1
            yield at, at + n
            at += n - WINDOW + 1  # the first window that straddles the factor's end


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from segments that come by anchor and doc_id."""
    held, block = None, Block()
    for batch in batches:
        out: list[tuple] = []
        for anchor, doc, same, at, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor != held:
                held, block = anchor, Block()
            out += ((doc, same, at + a, at + b) for a, b in block.factors(doc, words.encode().split()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 4, SPANS, strict=True)], schema=SPANS)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_words(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    gone = bytearray(len(words))
    for s in spans:
        gone[s["from"] : s["to"]] = b"\x01" * (s["to"] - s["from"])
    return [w for w, g in zip(words, gone, strict=True) if not g]


def finished(texts: bool):
    """For mapInArrow: what is left of the texts, or its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", BATCH_BYTES):
                few = batch.to_pydict()
                n, left = [], []
                for text, spans in zip(few["text"], few["spans"], strict=True):
                    words = text.encode().split()
                    n.append(len(words))
                    left.append(kept_words(words, spans))
                kept = [b" ".join(x) for x in left]
                out = pa.array([x.decode() for x in kept] if texts else [hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([a - len(b) for a, b in zip(n, left, strict=True)], pa.int64()), out], names=["doc_id", "n_words", "n_removed", "kept_text" if texts else "kept_sha256"])

    return run


def repeated_spans(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, same and the spans of repeated words of rows (doc_id, same, text), and the paths of what is stored."""
    sc = rows.sparkSession.sparkContext
    known = rows.where("doc_id IS NOT NULL AND text <> ''")
    anchors = known.select("doc_id", "text").mapInArrow(counted, "anchor long, doc_id long, n long").groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n").alias("n"))
    shared, path = stored(anchors.where("first < last").select("anchor", "n"), "anchors")
    paths = [path]
    n, n_hot = shared.agg(F.count("*"), F.count_if(F.col("n") > HOT)).first()
    bits = sc.broadcast(Bits(shared, n))
    hot_bits = sc.broadcast(Bits(shared.where(F.col("n") > HOT), n_hot)) if n_hot else None

    schema = "anchor long, doc_id long, same long, at int, words string"
    parts = known.mapInArrow(shared_segments(bits, hot_bits, False), schema)
    spans = parts.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(parsed, "doc_id long, same long, from int, to int")
    if hot_bits:
        windows = lambda common: known.mapInArrow(shared_segments(bits, hot_bits, True, common), schema).drop("anchor")
        firsts, firsts_path = stored(windows(None).groupBy("words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last"), "windows")
        paths.append(firsts_path)
        total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        is_common = F.col("n") * COMMON > total
        common = sc.broadcast({bytes(r.d): r.first for r in firsts.where(is_common).select(F.unhex(F.sha2("words", 256)).alias("d"), "first").toLocalIterator()})  # COMMON at most
        met = windows(common).join(firsts.where(~is_common).select("words", "first"), "words").where("doc_id > first")
        spans = spans.unionByName(met.select("doc_id", "same", F.col("at").alias("from"), (F.col("at") + WINDOW).alias("to"))).unionByName(known.mapInArrow(parsed_by_common(bits, hot_bits, common), "doc_id long, same long, from int, to int"))
    return spans.groupBy("doc_id", "same").agg(F.collect_list(F.struct("from", "to")).alias("spans")), paths


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words left, parted by one space) or its kept_sha256, for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.xxhash64("text")).select("doc_id", "same", "text")
    spans, paths = repeated_spans(rows)
    joined = rows.join(spans, ["doc_id", "same"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(finished(texts), RESULT.replace("kept_sha256", "kept_text") if texts else RESULT)
    if texts:
        return out
    result = checkpointed(out)
    for path in paths:
        discard(docs.sparkSession, path)
    return result
