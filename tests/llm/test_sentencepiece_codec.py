"""Streaming Viterbi against the library's unigram encoder, exact round trips, edges."""

import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from citewerk.llm.sentencepiece_codec import DEFAULT_MODEL, Codec, decode_column, encode_and_decode, encode_column

RAW = open(DEFAULT_MODEL, "rb").read()
CODEC = Codec(RAW)


def own_model(pieces, **rules):
    proto = pb.ModelProto.FromString(RAW)
    del proto.pieces[259:]
    proto.trainer_spec.byte_fallback = True
    for text, score in pieces:
        proto.pieces.add(piece=text, score=score)
    proto.trainer_spec.vocab_size = len(proto.pieces)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    proto.normalizer_spec.add_dummy_prefix = rules.get("dummy", True)
    return proto.SerializeToString()


def test_equals_library():
    """The library reads the same pieces as a unigram model: the same ids on short texts."""
    proto = pb.ModelProto.FromString(RAW)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece in proto.pieces:  # the library adds scores in single precision
        piece.score = max(piece.score, -40_000.0)
    model = proto.SerializeToString()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), Codec(model)
    random.seed(5)
    syllables = "the tion er an in q x é ß 漢 🙂 \n 1 2  . ab zz".split(" ")
    for _ in range(300):
        text = "".join(random.choice(syllables) for _ in range(random.randint(0, 12)))
        assert list(codec.encode(text)) == library.encode(text), text


def brute(codec, text):
    """Greatest score by full dynamic programming, backwards, without a window."""
    best = [0.0] * (len(text) + 1)
    for at in range(len(text) - 1, -1, -1):
        ways = []
        for end in range(at + 1, len(text) + 1):
            piece = codec.known.get(text[at:end])
            if piece:
                ways.append(piece[1] + best[end])
        if not codec.known.get(text[at]):
            ways.append(codec.penalty + best[at + 1])
        best[at] = max(ways)
    return best[0]


PIECES = [(c, -8.0) for c in "ab▁"] + [("ab", -3.0), ("ba", -3.1), ("aab", -3.5), ("b▁a", -2.5), ("abba", -4.0), ("bb", -2.9)]

SMALL = Codec(own_model(PIECES))


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", max_size=60))
def test_best_score_with_pieces_across_words(text):
    codec = SMALL
    assert codec.stretches is None
    ids = list(codec.encode(text))
    scores = {i: s for i, s, _ in filter(None, codec.known.values())}
    normal = "▁" + text.replace(" ", "▁") if text else ""
    unknown = text.count("c")
    total = sum(scores.get(i, 0.0) for i in ids) + codec.penalty * unknown
    assert total == pytest.approx(brute(codec, normal))
    assert codec.decode(ids) == text


def test_window_stays_small():
    codec = SMALL
    out = list(codec.stream("ab" * 50_000))
    assert codec.decode(codec.encode("ab" * 50_000)) == "ab" * 50_000
    assert len(out) >= 25_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    assert CODEC.decode(CODEC.encode(text)) == text


def test_queries(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "  a  b ", 7), (4, "▁x▁", 8), (5, "y" * 60_000, 9), (5, "a\x00é", 9), (None, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = encode_and_decode(docs, ["doc_id", "ids"])
    assert found.columns == ["doc_id", "ids", "ids_", "n_tokens", "decoded_sha256", "round_trip"]
    got = found.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[2] == 0
    both = docs.withColumn("made", encode_column(docs))
    both = both.withColumn("back", decode_column(both, "made"))
    assert both.where(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0
    assert encode_and_decode(docs.limit(0), ["doc_id"]).count() == 0
