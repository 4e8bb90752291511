import random
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import spm
from tidemark.llm.pieces import DEFAULT_MODEL, NORMAL, UNKNOWN, Pieces, read_model
from tidemark.llm.spm import Decoder, Transducer, decode, encode, load

MODEL = read_model(load())
OURS, BACK = Transducer(MODEL), Decoder(MODEL)
THEIRS = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_same_ids_as_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at = OURS.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == THEIRS.encode(t)
    assert BACK.decode(ids, at) == [t.replace("▁", " ") for t in texts]


def test_mixed_strings():
    rng = random.Random(0)
    parts = ["the", " an", "ing", "   ", "1999", "http://", "    ", "//", "==", "é", "漢字", "😀", "\n", "\t", " ", "a", "Q", "▁"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert OURS.encode([t])[0].tolist() == THEIRS.encode(t)


def test_runs_of_spaces():
    for n in [*range(1, 140), 1000, 4001]:
        for t in (" " * n, " " * n + "the", "a" + " " * n + "word" + " " * (n // 2), "x" * n):
            assert OURS.encode([t])[0].tolist() == THEIRS.encode(t), (n, t[-6:])
    start = time.time()
    ids, at = OURS.encode([" " * 100_000 + "end"])
    assert time.time() - start < 10 and BACK.decode(ids, at) == [" " * 100_000 + "end"]


def test_follows_is_what_merging_says():
    rng = random.Random(1)
    known = [i for i, k in enumerate(MODEL.kinds) if k == NORMAL]
    for _ in range(4000):
        a, b = rng.choice(known), rng.choice(known)
        whole = MODEL.texts[a] + MODEL.texts[b]
        assert OURS.follows(a, b) == (OURS.merges(whole) == [a, b])


def test_unigram_takes_the_least_weight():
    model = Pieces(["<unk>", "▁", "a", "b", "ab", "▁a", "bab"], [0, -1.0, -2.0, -2.5, -3.0, -2.2, -3.5], [UNKNOWN] + [NORMAL] * 6, False, True, True)
    t = Transducer(model)
    ids = [model.texts[i] for i in t.encode(["abab"])[0]]
    assert ids == ["▁a", "bab"]


def test_one_long_word_and_small_stores(monkeypatch):
    monkeypatch.setattr(spm, "KEPT_RUNS", 5)
    monkeypatch.setattr(spm, "KEPT_PAIRS", 7)
    t = Transducer(MODEL)
    for text in ("abcdefgh" * 400, "some words and some more words", "x y z " * 50):
        assert t.encode([text])[0].tolist() == THEIRS.encode(text)


def test_decoder_takes_any_ids():
    assert BACK.decode(np.array([-1, 10**6, 1, 2]), np.array([0, 4])) == [""]


def test_odd_rows(spark, odd, none):
    out = decode(encode(odd.withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(1))))
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.decoded == (r.text or "") for r in rows)
    assert all((not r.ids) == (not r.text) for r in rows)
    assert encode(none).count() == 0 and decode(encode(none)).count() == 0


def test_null_lists_decode_to_nothing(spark):
    df = spark.createDataFrame([(None,), ([],), ([None],)], "ids array<int>")
    assert [r.decoded for r in decode(df).collect()] == ["", "", ""]


@pytest.fixture(scope="module", params=[("nmt_nfkc", True), ("nmt_nfkc_cf", False), ("nfkc", False)])
def mapped(request):
    """The model with a character map put in: ours and the library's."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rule, trimmed = request.param
    m, n = pb.ModelProto(), pb.ModelProto()
    m.ParseFromString(load())
    n.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    m.normalizer_spec.precompiled_charsmap = n.normalizer_spec.precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces = trimmed
    data = m.SerializeToString()
    return Transducer(read_model(data)), sentencepiece.SentencePieceProcessor(model_proto=data)


def test_character_maps(mapped):
    ours, theirs = mapped
    rng = random.Random(7)
    parts = ["ＡＢＣ", "ﬁ", "é", "e\u0301", "①", "™", "\u3000", " ", "  ", "\t", "ｶﾞ", "가", "\u1100\u1161", "\u200b", "ǅ", "SS", "ẞ", "word", "½", "\n", "\u00ad", "Å", "▁", "😀"]
    assert ours.model.characters
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert ours.encode([t])[0].tolist() == theirs.encode(t), repr(t)


TOY = ["▁", "a", "b", "c", "ab", "▁a", "bc", "abc", "漢字", "字a", ">", "<", "x", "<x"]


@pytest.fixture(scope="module", params=[(kind, fallback) for kind in (1, 2) for fallback in (True, False)])
def toy(request):
    """Small models of either kind, with user pieces and characters that are pieces only together with others, with and without bytes: ours and the library's."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    kind, fallback = request.param
    m = pb.ModelProto()
    add = lambda t, score, k: m.pieces.append(pb.ModelProto.SentencePiece(piece=t, score=score, type=k))
    for t, k in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(t, 0.0, k)
    for t in ("<漢>", "ab<", "cd", "<漢>c"):
        add(t, 0.0, 4)
    for b in range(256 if fallback else 0):
        add(f"<0x{b:02X}>", 0.0, 6)
    for i, t in enumerate(TOY):
        add(t, -1.5 - (i * 37 % 11) / 7 - len(t) / 3, 1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = kind, fallback, len(m.pieces)
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    data = m.SerializeToString()
    return Transducer(read_model(data)), sentencepiece.SentencePieceProcessor(model_proto=data)


def test_user_pieces_and_bytes_inside_the_lattice(toy):
    ours, theirs = toy
    rng = random.Random(11)
    parts = ["<漢>", "<漢>c", "漢", "漢字", "字", ">", "<", "a", "b", "c", "ab", "abc", "cd", "d", "ab<", " ", "x", "é", "😀", "q"]
    for t in ["<漢a", "漢>x", "字字", "éé q漢", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000))]:
        got = ours.encode([t, t])
        assert got[0][: got[1][1]].tolist() == got[0][got[1][1] :].tolist() == theirs.encode(t), t
