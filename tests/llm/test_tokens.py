"""Token files and pieces: exact ids, exact round trips."""

import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mediaquarry.llm import pieces, tokenbin

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WHOLE = Tokenizer.from_file(VOCABULARY)
TEXT = st.text(st.sampled_from("ab Z,.'!1\n\t é🙂 　"), max_size=60) | st.text(max_size=40) | st.lists(st.sampled_from(["ab", " ", "\n", "<|endoftext|>", "on.", "'s", "  ", "\t"]), max_size=20).map("".join)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def files_match(spark, tokenizer, docs, folder, **how):
    path = f"file://{folder}/{uuid.uuid4().hex}"
    tokenbin.write_ids(docs, path, VOCABULARY, 2, **how)
    got = sorted(map(tuple, tokenbin.read_documents(spark, path).collect()), key=lambda r: r[1])
    want, start = [], 0
    rows = docs.select("doc_id", "text").collect()
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [r[0] for r in got] == [w[0] for w in want]
    assert sorted(((d, n, c) for d, _, n, c in got), key=repr) == sorted(want, key=repr)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()][: len(got)]
    return path


def test_all_documents(spark, tokenizer, documents, tmp_path):
    path = files_match(spark, tokenizer, documents, tmp_path)
    index = spark.read.parquet(f"{path}/index").collect()
    blocks = {(r.shard, r.block): r for r in spark.read.parquet(f"{path}/blocks").collect()}
    assert len(index) == len(blocks)
    for r in index:
        b = blocks[r.shard, r.block]
        assert len(tokenbin.ids_of(b.frame)) == r.n_ids == sum(b.lengths) and len(b.frame) == r.n_bytes and b.first_id == r.first_id


@pytest.mark.parametrize("how", [{"block": 7}, {"block": 1000, "plane_bits": 1}])
def test_odd_rows(spark, tokenizer, odd_documents, tmp_path, how):
    rows = odd_documents if how["block"] > 7 else odd_documents.where("length(text) < 1000 OR text IS NULL")
    files_match(spark, tokenizer, rows, tmp_path, **how)


def test_names_of_added_tokens_are_tokens(spark, tokenizer, tmp_path):
    assert tokenizer.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "<|endof text|>", "on.\nHa. Ha\n\nthe end.\n", " a\n b"]
    files_match(spark, tokenizer, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path)


def test_a_range_is_read_by_the_index(spark, tokenizer, documents, tmp_path):
    path = files_match(spark, tokenizer, documents, tmp_path, block=500)
    whole = []
    for r in sorted(documents.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        whole += [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
    for start, n in ((0, 1), (499, 2), (1234, 5000), (len(whole) - 3, 10), (len(whole), 5), (7, 0)):
        got = sorted(map(tuple, tokenbin.read_ids(spark, path, start, n).collect()))
        assert [x for _, ids in got for x in ids] == whole[start : start + n]
        assert all(whole[s : s + len(ids)] == ids for s, ids in got)


def test_long_text_and_no_rows(spark, tokenizer, odd_documents, no_documents, tmp_path):
    files_match(spark, tokenizer, odd_documents, tmp_path)
    files_match(spark, tokenizer, no_documents, tmp_path)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_cached_pieces_give_the_ids_of_the_whole(texts):
    t = tokenbin.encoder(VOCABULARY)
    ids, lengths = t.encode(pa.array(texts, pa.string()), 2)
    want = [[*x.ids, 2] for x in WHOLE.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert ids.tolist() == [i for x in want for i in x] and lengths.tolist() == list(map(len, want))


def asked(t, texts):
    """Ids of texts by t, against the library, and the texts that t sends to the library meanwhile."""
    sent, send = [], t.library
    t.library = lambda some: sent.extend(some) or send(some)
    ids, lengths = t.encode(pa.array(texts, pa.string()), 2)
    t.library = send
    want = [[*x.ids, 2] for x in WHOLE.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and lengths.tolist() == list(map(len, want))
    return "".join(sent)


def test_a_full_cache_keeps_what_is_used_most(monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHED", 60)
    t = tokenbin.PieceEncoder(VOCABULARY)
    common, rare = [f"often{'abcdefghij'[i]}" for i in range(10)], iter(f"rare{i}x" for i in range(10_000))
    for k in range(40):
        sent = asked(t, [" ".join(["Head", *common, *(next(rare) for _ in range(15))]), " ".join(["Head", *common])])
        assert ("often" in sent) == (k == 0)
        assert t.runs.count <= 60 + 25
        assert len(t.known) == t.runs.count


def test_a_word_is_learnt_once_for_all_marks_and_lines():
    t = tokenbin.PieceEncoder(VOCABULARY)
    assert asked(t, ["Head quirlish\nquirlish"]).count("quirlish") == 2
    for text in ("Head quirlish. quirlish?!\nquirlish, quirlish\nquirlish.", "quir x\nquirlish)) quirlish.\nx"):
        assert "quirlish" not in asked(t, [text])
    assert len(t.known) == t.runs.count


def test_marks_after_every_letter():
    letters = [chr(i) for i in range(0x110000) if chr(i).isalpha()]
    t = tokenbin.PieceEncoder(VOCABULARY)
    for at in range(0, len(letters), 20_000):
        asked(t, ["x " + ". ".join(letters[at : at + 20_000]) + ".", "x y\n" + ",\n".join(letters[at : at + 1000])])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=0, max_size=300), st.sampled_from([1, 8]))
def test_frames_round_trip(ids, bits):
    assert tokenbin.ids_of(tokenbin.frame_of(np.array(ids, "<u4"), bits)).tolist() == ids


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_crc(a, b):
    assert tokenbin.crc_of_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def plain_path(model, scores, text):
    """The ids of the best path over the whole text by trying all pieces at all places; of equal sums the one whose last piece is the longest."""
    marked = "▁" + text.replace(" ", "▁")
    best, last = [0.0] + [-np.inf] * len(marked), [None] * (len(marked) + 1)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 20), end):
            piece = scores.get(marked[start:end])
            if piece and best[start] + piece[1] > best[end]:
                best[end], last[end] = best[start] + piece[1], (start, [piece[0]])
        if marked[end - 1] not in scores and best[end - 1] + model.unknown > best[end]:
            best[end], last[end] = best[end - 1] + model.unknown, (end - 1, [model.byte_ids[b] for b in marked[end - 1].encode()])
    path, at = [], len(marked)
    while at:
        at, piece = last[at]
        path.append(piece)
    return [i for piece in reversed(path) for i in piece]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


@pytest.fixture(scope="module")
def scores():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}


def test_best_paths_of_whole_texts(model, scores, documents):
    assert max(map(len, scores)) <= 20
    texts = [r.text for r in documents.select("text").collect() if r.text] + [" ", "  a  b ", "naïve 🙂🙂 x", "line\nbreak\ttab", "a" * 5000, "x². y²z ▁▁a ▁", "on.\nHa (a)_b, 12 \n\n c"]
    for text in texts:
        assert model.encode(text).tolist() == plain_path(model, scores, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_texts_together_are_those_alone(model, scores, texts):
    ids, lengths = model.encode_all(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for x in texts for i in (plain_path(model, scores, x) if x else [])] and lengths.sum() == len(ids)


@settings(max_examples=200, deadline=None)
@given(TEXT.filter(lambda x: "▁" not in x))
def test_round_trip(text):
    m = pieces.model_at(MODEL)
    assert m.decode(m.encode(text)) == text


def test_the_library_reads_the_ids(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ["The river runs past an old mill.", "naïve 🙂 x", " two  spaces "]:
        assert sp.decode(model.encode(text).tolist()) == text


def test_columns_of_odd_rows(odd_documents, no_documents):
    both = pieces.decode_column(pieces.encode_column(odd_documents, MODEL), MODEL)
    assert set(both.columns) == set(odd_documents.columns)
    for r in both.collect():
        assert r.decoded == (r.text or "").replace("▁", " ") and (r.ids == []) == (not r.text)
    digests = pieces.encode_digests(odd_documents, MODEL).collect()
    assert len(digests) == odd_documents.count() and [r.round_trip for r in digests if r.doc_id == 7] == [False]
    assert all(r.round_trip for r in digests if r.doc_id != 7)
    assert pieces.encode_digests(no_documents, MODEL).count() == 0 and pieces.encode_column(no_documents, MODEL).count() == 0
