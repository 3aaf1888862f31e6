import struct

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from contactmill.llm import sentencepiece_fst as fst
from tests.llm import cases

FILE = public_tokenizers.path("piece_bpe_32k.model")
CONTENT = open(FILE, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_awkward_documents(spark):
    coded = fst.encoded(spark, cases.awkward(spark), CONTENT)
    have = cases.ordered((r.doc_id, r.ids, r.n_ids, r.round_trip) for r in coded.collect())
    want = []
    for doc_id, text, *_ in cases.ROWS:
        ids = LIBRARY.encode(text or "")
        want.append((doc_id, ids, len(ids), LIBRARY.decode(ids) == (text or "")))
    assert have == cases.ordered(want)
    assert fst.encoded(spark, cases.empty(spark), CONTENT).collect() == []


def test_whole_table_against_library_and_back(spark):
    docs = spark.read.parquet(f"{cases.folder()}/documents.parquet")
    coded = fst.decoded(spark, fst.encoded(spark, docs, CONTENT), CONTENT)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = coded.collect()
    assert len(rows) == len(texts)
    assert all(r.ids == LIBRARY.encode(texts[r.doc_id]) for r in rows)
    assert all(r.decoded == texts[r.doc_id] and r.round_trip for r in rows)


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in fst.decoded(spark, rows, CONTENT).orderBy("doc_id").collect()] == [None, ""]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeht  ▁\n\t.,12TIé日🙂\x00")), max_size=50))
def test_same_ids_as_the_library(text):
    tool = fst.transducer(CONTENT)
    ids = tool.encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert tool.decode(ids) == LIBRARY.decode(ids.tolist())


def test_memo_generations_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(fst, "MEMO_SIZE", 3)
    tool = fst.Transducer(CONTENT)
    for _ in range(3):
        for text in ("one two three four five", "five four three two one", "one three five"):
            assert tool.encode(text).tolist() == LIBRARY.encode(text)


def _field(number, kind, payload):
    return bytes([number << 3 | kind]) + payload


def _model(pieces, model_type):
    out = b""
    for piece, score, kind in pieces:
        raw = piece.encode()
        body = _field(1, 2, bytes([len(raw)]) + raw) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, bytes([kind]))
        out += _field(1, 2, bytes([len(body)]) + body)
    trainer = _field(3, 0, bytes([model_type]))
    normaliser = _field(3, 0, b"\x01") + _field(4, 0, b"\x01")
    return out + _field(2, 2, bytes([len(trainer)]) + trainer) + _field(3, 2, bytes([len(normaliser)]) + normaliser)


def test_unigram_model_takes_the_best_scores():
    pieces = [("<unk>", 0, 2), ("▁", -2, 1), ("a", -1.5, 1), ("b", -1.5, 1), ("▁a", -3, 1), ("ab", -2, 1), ("▁ab", -4.5, 1)]
    tool = fst.Transducer(_model(pieces, 1))
    best = {}

    def split(text):
        if not text:
            return [(0.0, [])]
        return [
            (s - score, [i, *rest])
            for i, (p, score, kind) in enumerate(pieces)
            if kind == 1 and text.startswith(p)
            for s, rest in split(text[len(p) :])
        ]

    for text in ("ab", "aab", "b ab", "abab"):
        best = min(split("▁" + text.replace(" ", "▁")))
        got = tool.encode(text)
        assert np.isclose(sum(-pieces[i][1] for i in got), best[0])
        assert tool.decode(got) == text
    assert tool.encode("a?").tolist()[-1] == 0
