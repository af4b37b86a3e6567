import os

import pytest
import sentencepiece

from riskframe.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no tokenizer file")

TEXTS = [
    "aaaaaaaaaaaaaaaaa", "  two  spaces ", " \n\t x", "日本語 emoji 😀\x00", "", " ", "   ", "hahaha " * 4,
    "====== ------ ......", "Ciónueta ñasboja.\nRabo", "the the the", "a" * 3000, "ab " * 5000,
    "mmmmm mmmmmmm mmm", "é́ �", "<s> </s> <unk> <0x41>",
]


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


def test_ids_are_those_of_the_reference(reference):
    encoder = pieces.Encoder(pieces._model_bytes(pieces.MODEL_PATH))
    ids, sizes, again, _ = encoder.encode(TEXTS)
    start = 0
    for text, size, same in zip(TEXTS, sizes, again, strict=True):
        own = ids[start : start + size].tolist()
        assert own == reference.encode(text), text[:40]
        assert same == (reference.decode(own) == text)
        start += size
    # A second time everything is known.
    assert encoder.encode(TEXTS)[0].tolist() == ids.tolist()


def test_library_alone_agrees_on_whole_texts(reference):
    tokenizer = pieces.build_tokenizer(pieces.PieceModel.parse(pieces._model_bytes(pieces.MODEL_PATH)))
    for text in TEXTS[3:4] + TEXTS[8:11]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == reference.encode(text)
        assert tokenizer.decode(ids, skip_special_tokens=False) == text


def test_forgetting_changes_nothing(monkeypatch):
    data = pieces._model_bytes(pieces.MODEL_PATH)
    expected = pieces.Encoder(data).encode(TEXTS)[0].tolist()
    monkeypatch.setattr(pieces, "KNOWN_UNITS", 1)
    encoder = pieces.Encoder(data)
    assert [i for t in TEXTS for i in encoder.encode([t])[0].tolist()] == expected


def test_awkward_documents(docs, awkward, reference):
    rows = pieces.encode(docs).collect()
    assert sorted((r.ids for r in rows)) == sorted(reference.encode(t or "") for _, t, _ in awkward)
    assert all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in rows)
    again = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(r.text for r in again) == sorted(t or "" for _, t, _ in awkward)


def test_marks_in_a_text_do_not_come_back(spark):
    rows = pieces.encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")).collect()
    assert not rows[0].round_trip
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing).first().text is None


def test_empty_table(no_docs):
    assert pieces.encode(no_docs).count() == 0


def _message(number, kind, value):
    key = bytes([number << 3 | kind])
    return key + (bytes([len(value)]) + value if kind == 2 else value)


def test_unigram_model_is_parsed_and_rebuilt():
    import struct

    def piece(text, score, kind=1):
        inner = _message(1, 2, text.encode()) + _message(2, 5, struct.pack("<f", score)) + _message(3, 0, bytes([kind]))
        return _message(1, 2, inner)

    data = piece("<unk>", 0.0, 2) + piece("▁ab", -1.0) + piece("▁", -3.0) + piece("a", -4.0)
    data += piece("b", -4.0) + piece("c", -2.0) + _message(2, 2, _message(3, 0, b"\x01"))
    model = pieces.PieceModel.parse(data)
    assert (model.kind, len(model.pieces), model.splits_at_marks()) == (pieces.UNIGRAM, 6, True)
    tokenizer = pieces.build_tokenizer(model)
    assert tokenizer.encode("ab c  ab", add_special_tokens=False).tokens == ["▁ab", "▁", "c", "▁ab"]
    assert tokenizer.decode([1, 2, 5, 1]) == "ab c ab"
