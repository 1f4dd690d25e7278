"""SentencePiece encoding and decoding by one pass of Viterbi over an Aho-Corasick automaton of the pieces.

The automaton reads a text once; at each position its output links name every piece that ends there, from the longest
to the shortest, and each relaxes the best score of the position from that of the piece's start. Scores are the model's
own, summed. A character that no piece spells is written in byte pieces, at
UNKNOWN_PENALTY below the worst score. Where no piece holds a space mark after another character (so for usual models),
the best path of a text is that of its words put together; words are kept in a bounded cache.

The normaliser must be the identity, apart from the space mark for each space and one put in front; other models are
refused. Decoding joins the pieces, reads byte pieces as UTF-8 (what isn't UTF-8 becomes U+FFFD) and drops the first space.

Defined cases: a null text counts as empty and has no ids; a text with the space mark itself decodes to a space there
(round_trip is false); of paths with equal sums the one whose last piece is the longest stays; repeated rows each give a row; an
empty table gives an empty result; other columns play no part unless asked for. Texts are encoded whole.
"""

from __future__ import annotations

import gc
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ROWS_AT_ONCE, Runs, by_size

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words in the cache (a full one is emptied), and bytes of texts that are split at the same time.
CACHED, BYTES_AT_ONCE = 200_000, 2 << 20
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

COLUMNS = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, score double, round_trip boolean"


def parts_of(pieces: list[str]) -> re.Pattern:
    """Matches the parts of a word that no piece joins: runs of letters and figures, and runs of all else; signs such as ², which count as figures but stand in pieces with others, go with these."""
    mixed = [x for x in pieces if len(re.findall(r"[^\W_]+|[\W_]+", x)) > 1]
    signs = {c for x in mixed for c in x if c.isalnum()}
    if any(c.isalpha() or c.isdecimal() for c in signs):
        return re.compile("(?s).+")
    also = re.escape("".join(sorted(signs)))
    return re.compile(rf"[^\W_{also}]+|[\W_{also}]+")


class PieceModel:
    """Ids of the texts of Arrow columns, and their texts again. A known word, with its mark, is a run of ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models whose normaliser is the identity with a space in front are supported")
        kinds = pb.ModelProto.SentencePiece
        self.scores = np.array([p.score for p in model.pieces])
        self.spelled: list[bytes] = [b""] * len(model.pieces)
        self.automaton, self.single, self.byte_ids, whole = ahocorasick.Automaton(), set(), {}, False
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.automaton.add_word(p.piece, (len(p.piece), i, p.score))
                self.spelled[i] = p.piece.replace(MARK, " ").encode()
                whole |= MARK in p.piece.lstrip(MARK)
                if len(p.piece) == 1:
                    self.single.add(p.piece)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        self.automaton.make_automaton()
        self.words = None if whole else WORDS
        self.parts = parts_of([p.piece.lstrip(MARK) for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)])
        self.unknown = float(min(p.score for p in model.pieces)) - UNKNOWN_PENALTY
        self.is_byte = np.zeros(len(model.pieces), bool)
        self.is_byte[list(self.byte_ids.values())] = True
        sizes = np.array([len(x) for x in self.spelled], np.int64)
        self.letters, self.n_letters, self.first_letter = np.frombuffer(b"".join(self.spelled), np.uint8), sizes, np.cumsum(sizes) - sizes
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.known_parts: dict[str, int] = {}
        self.runs = Runs()

    def best_path(self, text: str) -> list[int]:
        """Ids of the best path over a text in which spaces are marks already; a position keeps its best sum and the piece that gave it (None: byte pieces)."""
        n = len(text)
        best, last = [0.0] * (n + 2), [None] * (n + 1)
        most, chosen, at = -math.inf, None, 0
        for end, piece in chain(self.automaton.iter(text), ((n, (0, 0, 0.0)),)):
            while at < end:  # no more pieces end there
                if text[at] not in self.single and (total := best[at] + self.unknown) > most:
                    most, chosen = total, None
                at += 1
                best[at], last[at], most = most, chosen, -math.inf
            if (total := best[end + 1 - piece[0]] + piece[2]) > most:
                most, chosen = total, piece
        path, at = [], n
        while at:
            if piece := last[at]:
                path.append(piece[1])
                at -= piece[0]
            else:
                at -= 1
                path.extend(self.byte_ids[b] for b in reversed(text[at].encode("utf-8", "surrogatepass")))
        return path[::-1]

    def learn(self, words: list[str]) -> None:
        """Make runs of words. Where no piece joins letters or figures with anything else, a word's path is that of its parts, which are learnt once."""
        split = [[MARK + p[0], *p[1:]] if (p := self.parts.findall(x)) else [MARK] for x in words]
        new = list({y for parts in split for y in parts}.difference(self.known_parts))
        found = list(map(self.best_path, new))
        first = self.runs.add(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        self.known_parts.update(zip(new, range(first, self.runs.count)))
        numbers = [[self.known_parts[y] for y in parts] for parts in split]
        single = {x: n[0] for x, n in zip(words, numbers) if len(n) == 1}
        self.known.update(single)
        several = [(x, n) for x, n in zip(words, numbers) if len(n) > 1]
        if several:
            ids, lengths = self.runs.joined(np.fromiter(chain.from_iterable(n for _, n in several), np.int64))
            first = self.runs.add(ids, np.add.reduceat(lengths, np.cumsum([0, *(len(n) for _, n in several[:-1])])))
            self.known.update(zip([x for x, _ in several], range(first, self.runs.count)))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has. Where words part at single spaces they are looked up by columns."""
        gc.disable()  # nothing here makes cycles, and looks for them would go over the cache again and again
        try:
            return self.encoded(texts.cast(pa.large_string()).fill_null(""))
        finally:
            gc.enable()

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.runs.count > CACHED or self.runs.used > 16 * CACHED:
            self.clear()
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        cuts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        words, doc = lists.flatten().dictionary_encode(), np.repeat(np.arange(n), np.diff(cuts))
        seen, codes = words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(words.indices)
        number = np.fromiter(map(self.known.get, seen, repeat(-1)), np.int64, len(seen))
        new = np.flatnonzero(number < 0).tolist()
        odd = [i for i in new if not seen[i] or MARK in seen[i]]
        alone = np.zeros(n, bool)  # texts whose words don't part at single spaces
        if self.words is None:
            alone[:] = True
        elif odd:
            alone[doc[np.isin(codes, odd)]] = True
        if alone.any():
            inside = ~alone[doc]
            codes, doc = codes[inside], doc[inside]
            there = np.zeros(len(seen), bool)
            there[codes] = True
            new = [i for i in new if there[i]]
        if new:
            self.learn([seen[i] for i in new])
            number[new] = [self.known[seen[i]] for i in new]
        places = np.flatnonzero(alone)
        ids = [self.unparted(texts[i].as_py()) for i in places.tolist()]
        kept = self.runs.count
        if ids:
            self.runs.add(np.concatenate(ids), np.array([len(x) for x in ids]))
        order = np.argsort(np.concatenate([doc, places]), kind="stable")
        runs = np.concatenate([number[codes], np.arange(kept, kept + len(places))])[order]
        owner = np.concatenate([doc, places])[order]
        out, lengths = self.runs.joined(runs)
        self.runs.forget(kept)
        return out, np.bincount(owner, lengths, minlength=n).astype(np.int64)

    def unparted(self, text: str) -> np.ndarray:
        """The ids of a text with spaces that stand together or at its ends, or with marks."""
        if not text:
            return np.empty(0, np.uint32)
        marked = MARK + text.replace(" ", MARK)
        return np.fromiter(chain.from_iterable(map(self.best_path, self.words.findall(marked) if self.words else [marked])), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.n_letters[ids]
        ends = np.cumsum(sizes)
        letters = self.letters[np.repeat(self.first_letter[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return letters.tobytes().decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=1)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


def encoded_batches(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of some megabytes of text, with the ids of their texts and where each text's begin and end."""
    for whole in batches:
        for batch in by_size(whole, "text", BYTES_AT_ONCE):
            ids, lengths = model_at(model).encode_all(batch.column("text"))
            yield batch, ids, np.concatenate(([0], np.cumsum(lengths)))


def same_again(batch: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray, model: str) -> list[bool]:
    """Whether decoding gives each text (null counts as empty)."""
    decode = model_at(model).decode
    return [decode(ids[a:b]) == (text or "") for text, a, b in zip(batch.column("text").to_pylist(), ends[:-1].tolist(), ends[1:].tolist())]


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """A row for each row of docs (doc_id, text): ids counted and digested, the path's score, and whether decoding gives the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in encoded_batches(batches, model):
            pieces, parts = model_at(model), list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            is_byte, scores = pieces.is_byte[ids], pieces.scores[ids]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends)), pa.array([int(is_byte[a:b].sum()) for a, b in parts], pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in parts], pa.int64()),
                pa.array([float(scores[a:b].sum()) for a, b in parts], pa.float64()), pa.array(same_again(batch, ids, ends, model), pa.bool_()),
            ], names=[x.split()[0] for x in COLUMNS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def with_ids(docs: DataFrame, model: str, checked: bool) -> DataFrame:
    docs = docs.drop("ids", *["round_trip"] * checked)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in encoded_batches(batches, model):
            array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype("<i4")))
            more = [pa.array(same_again(batch, ids, ends, model), pa.bool_())] * checked
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), array, *more], names=[*names, "ids", *["round_trip"] * checked])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, ids array<int>{', round_trip boolean' * checked}")


def encode_column(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids (array<int>) for each text (a column of that name is replaced); the other columns stay."""
    return with_ids(docs, model, False)


def encode_checked(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids and round_trip, whether decoding them gives the text (null counts as empty), in one pass of one worker a task; columns of these names are replaced."""
    return with_ids(docs, model, True)


def decode_column(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with decoded (string) for each array of ids (a column of that name is replaced); null stays null."""
    encoded = encoded.drop("decoded")
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [None if x is None else model_at(model).decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kept}, decoded string")
