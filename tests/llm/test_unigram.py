import random

import public_tokenizers as tok

from dossierlake.llm import unigram

PATH = tok.path("piece_bpe_32k.model")


def library(pieces):
    """The same pieces and scores run by the library's own unigram search."""
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    for text, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((t, s, 1) for t, s in pieces)]:
        piece = proto.pieces.add()
        piece.piece, piece.score, piece.type = text, score, kind
    return sp.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_ties_of_the_library():
    rng = random.Random(6)
    total = 0
    for _ in range(200):
        letters = "abc" + unigram.SPACE
        pieces = {x: float(-rng.randrange(1, 6)) for x in letters}
        pieces |= {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))): float(-rng.randrange(1, 9)) for _ in range(rng.randrange(1, 15))}
        model, other = unigram.Unigram(list(pieces.items())), library(list(pieces.items()))
        for _ in range(20):
            t = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 25)))
            total += 1
            assert model.count(t) == len(other.encode(t)), (pieces, t)
    assert total == 4000


def brute(pieces, text):
    """Best path by trying every start left to right."""
    table = dict(pieces)
    low = min(table.values()) - unigram.UNKNOWN_PENALTY
    best = [(0.0, 0)] + [None] * len(text)
    for at in range(len(text)):
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            if piece in table:
                step = (table[piece], 1)
            elif end == at + 1:
                step = (low, len(piece.encode()))
            else:
                continue
            if best[end] is None or best[at][0] + step[0] > best[end][0]:
                best[end] = (best[at][0] + step[0], best[at][1] + step[1])
    return best[-1]


def test_ties_unknowns_and_inner_spaces():
    rng = random.Random(4)
    for case in range(300):
        letters = "ab" + unigram.SPACE
        pieces = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 4)) for _ in range(rng.randrange(1, 10))}.items())
        model = unigram.Unigram(pieces)
        for _ in range(10):
            t = "".join(rng.choice("ab 🙂" if case % 2 else "ab ") for _ in range(rng.randrange(1, 14)))
            assert model.count(t) == brute(pieces, unigram.SPACE + t.replace(" ", unigram.SPACE))[1], (pieces, t)


def test_frame(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "hello world " * 20_000, 5), (3, "hello world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = unigram.count_tokens(df, PATH)
    model = unigram.load(PATH)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    assert sorted(r.n_tokens for r in got.collect()) == sorted([0, 0, model.count("hello world " * 20_000), model.count("hello world")])
    assert got.limit(0).count() == 0 and unigram.count_tokens(df.limit(0), PATH).count() == 0
