"""SentencePiece encoding and decoding against the library, and against plain merging."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from brinelog.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a ", "▁a▁", "a  b\n\n c\t", "é你好😀Ⅷ²½", "\x00\x01", "x" * 3000, "the" * 900, " " * 70 + "end", "12345 67", "ﬁne ①", "ÀÈ é", "a　b", "���"]


@pytest.fixture(scope="module")
def model():
    return piece_bpe.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_is_the_librarys(spark, model, library):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = [(i, t, [1], "x") for i, t in enumerate(texts)] + [(0, "again", [2], ""), (None, "no id", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, token_ids array<int>, decoded string").repartition(3)
    got = sorted(map(tuple, piece_bpe.encode_decode(frame, model).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert piece_bpe.encode_decode(frame.limit(0), model).count() == 0


def test_backtracking_is_plain_merging_and_the_library(model, library):
    encoder = piece_bpe.Encoder(model)
    known = piece_bpe.Remembered(encoder, piece_bpe.cuts_of(encoder.score).findall, 500)
    random.seed(5)
    for _ in range(3000):
        text = "".join(random.choice("aeioutnsrh   ▁é你\U0001f600\x00\n\tзн1234²½'.") for _ in range(random.randrange(50)))
        ids = [i for c in known.cuts(model.prepared(text)) for i in encoder(c)]
        assert ids == library.encode(text) == [i for p in piece_bpe.merged(list(model.prepared(text)), encoder.score) for i in encoder.ids.get(p) or encoder.spelt(p)]
    for text in ("ab " * 2000, "你好" * 2000, "nt" * 3000):
        assert encoder(model.prepared(text)) == library.encode(text)


def test_decoding_any_ids(spark, model, library):
    random.seed(6)
    lists = [[random.choice([random.randrange(32000), random.randrange(262)]) for _ in range(random.randrange(12))] for _ in range(800)]
    frame = spark.createDataFrame(list(enumerate(lists)) + [(-1, None)], "doc_id long, token_ids array<int>")
    got = {r.doc_id: r.decoded for r in piece_bpe.decode(frame, model).collect()}
    assert got.pop(-1) == "" and got == {i: library.decode(x) for i, x in enumerate(lists)}
    with pytest.raises(Exception, match="an id that the model doesn't have"):
        piece_bpe.decode(spark.createDataFrame([(1, [32000])], "doc_id long, token_ids array<int>"), model).collect()


def test_forgetting_changes_no_ids(model):
    encoder = piece_bpe.Encoder(model)
    cuts = ["▁the", "▁thand", "▁zzq", "▁ontion", "a" * 100] * 3
    small = piece_bpe.Remembered(encoder, None, 2)
    assert [small[c] for c in cuts] == [piece_bpe.Remembered(encoder, None, 99)[c] for c in cuts]
    assert len(small) <= 2 and len(small.before) <= 2 and "a" * 100 not in small


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as f:
        content = f.read()
    other = content.replace(b"identity\x12\x00\x18\x01\x20\x00", b"identity\x12\x00\x18\x01\x20\x01", 1)
    assert other != content
    (tmp_path / "model").write_bytes(other)
    with pytest.raises(ValueError, match="only merge-type models"):
        piece_bpe.read_model(str(tmp_path / "model"))
