import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import pieces
from threadloom.llm.queries import PIECES

CODEC = pieces.Codec(PIECES)
TEXTS = ["Plain words here.", "  two  spaces   three", "x" * 3000, "é́ 😀 漢字", " " * 37 + "end" + " " * 21, "tab\tline\n\n next", "<s> </s> <0x0A> <unk>", "\x00 \x01", ""]


@pytest.mark.parametrize("text", TEXTS)
def test_parity_and_round_trip(text):
    codec = pieces.Codec(PIECES)
    for texts in ([text], [text, "and more", text]):
        ids, ends, odd, back = codec.encode(texts)
        each = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert each == codec.reference.encode(texts) and not odd.any()
        assert codec.decode(each) == texts and back.all()


def test_marker_in_a_text_does_not_come_back():
    codec = pieces.Codec(PIECES)
    ids, _, odd, back = codec.encode(["a▁b c"])
    assert ids.tolist() == codec.reference.encode("a▁b c") and not odd.any() and not back.any()


@given(st.lists(st.text(st.sampled_from("ab é\n 0▁漢😀."), max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_parity_on_any_text(texts):
    ids, ends, _, back = CODEC.encode(texts)
    each = [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []
    assert each == CODEC.reference.encode(texts)
    assert back.tolist() == [a == b for a, b in zip(CODEC.decode(each), texts, strict=True)]


def test_differing_words_are_counted(monkeypatch):
    codec = pieces.Codec(PIECES)
    other = pieces.Tokenizer(pieces.models.BPE({p.piece: i for i, p in enumerate(codec.proto.pieces)}, [], unk_token="<unk>", byte_fallback=True))
    other.decoder = codec.tokenizer.decoder
    monkeypatch.setattr(codec, "tokenizer", other)
    ids, _, odd, back = codec.encode(["some odd words"])
    assert ids.tolist() == other.encode("▁some▁odd▁words", add_special_tokens=False).ids and odd.tolist() == [3] and back.all()


def test_unigram_is_rebuilt():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for piece, score, kind in (("<unk>", 0, 2), ("▁", -4, 1), ("a", -5, 1), ("b", -5, 1), ("ab", -3, 1), ("▁ab", -2.5, 1), ("aba", -9, 1)):
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type = 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    tokenizer = pieces.rebuilt(model)
    for text in ("ab", "aba ab", "bbab  ab"):
        assert tokenizer.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids == reference.encode(text)


def test_operator(spark):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, None, None), (0, TEXTS[0], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode(docs, PIECES)
    got = {(r.doc_id, r.n_tokens is None): r for r in coded.collect()}
    assert coded.count() == len(rows)
    assert got[(None, True)].ids is None and got[(None, True)].round_trip is None
    assert all(r.round_trip and r.n_odd == 0 and len(r.ids) == r.n_tokens for k, r in got.items() if not k[1])
    back = {r.doc_id: r.text for r in pieces.decode(coded, PIECES).collect()}
    assert back == {None: None} | dict(enumerate(TEXTS))
    assert pieces.encode(docs.filter("false"), PIECES).count() == 0
