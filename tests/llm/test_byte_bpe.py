import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers as P
from tidewell.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return byte_bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_joins_equal_the_whole(ranks, library):
    model = byte_bpe.ByteBpe(ranks, P.PATTERN, leaf_bytes=3)
    rnd, tokens = random.Random(7), list(ranks)
    for n in range(3000):
        data = b"".join(rnd.choices(tokens, k=rnd.choice([1, 2, 3, 9]))) if n % 2 else bytes(rnd.choices(b"aab ceth\xc3\xa9", k=rnd.randint(1, 60)))
        assert model.piece(data) == library._encode_single_piece(data)
        assert model.decode(model.piece(data)) == data
        cuts = sorted(rnd.sample(range(len(data) + 1), min(3, len(data))))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        if data not in ranks:
            assert byte_bpe.join_all(model, [model.tree(p) for p in parts]) == library._encode_single_piece(data)


def test_every_token_is_its_own_encoding(ranks):
    model = byte_bpe.ByteBpe(ranks, P.PATTERN)
    assert all(model._merged(t) == [n] for t, n in list(ranks.items())[::37])


def test_texts_equal_the_library(spark, library):
    rnd = random.Random(3)
    alphabet = ["a", "B", "é", "1", "²", "'s", "'", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "!", "$", "漢", "́", "😀", "\x00", "word", " the"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 14))) for _ in range(2000)] + ["y" * 50_000, "z " * 50_000]
    docs = spark.createDataFrame([(n, t, "c") for n, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, n_tokens string")
    out = byte_bpe.encode_texts_column(docs, PATH, P.PATTERN)
    rows = {r.doc_id: r for r in byte_bpe.decode_ids_column(out, PATH, P.PATTERN).collect()}
    for n, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        raw = np.array(ids, np.uint32).tobytes()
        assert (rows[n].n_tokens, rows[n].token_ids, rows[n].ids_sha256) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert rows[n].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert rows[n].decoded == t
    assert (rows[None].n_tokens, rows[None].decoded) == (0, "")


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_texts_column(docs, PATH, P.PATTERN).count() == 0
    rows = spark.createDataFrame([(None,)], "token_ids binary")
    assert byte_bpe.decode_ids_column(rows, PATH, P.PATTERN).first().decoded is None


def test_ordinary_text_goes_through_joins(ranks, library):
    model = byte_bpe.ByteBpe(ranks, P.PATTERN)
    text = "Ordinary prose, whose longest word is incomprehensibilities, has no match of any great length."
    assert model.encode(text) == library.encode_ordinary(text)
    words = [m.group(0).encode() for m in model.pattern.finditer(text)]
    rare = [w for w in dict.fromkeys(words) if w not in ranks]
    assert rare and model.joins >= len(rare)
    fresh = byte_bpe.ByteBpe(ranks, P.PATTERN)
    fresh.piece(rare[0])
    assert fresh.joins + 1 >= len(set(rare[0]))  # halves down to single bytes; equal halves are remembered


def test_pieces_in_use_stay_when_others_fill_the_memory(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 40)
    model, rnd = byte_bpe.ByteBpe(ranks, P.PATTERN), random.Random(6)
    hot, again = "qzxvkjwqyz", 0
    assert hot.encode() not in ranks
    for n in range(400):
        word = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéß", k=rnd.randint(3, 30)))
        assert model.encode(word) == library.encode_ordinary(word)
        before = model.joins
        assert model.encode(hot) == library.encode_ordinary(hot)
        again += (model.joins > before) * (n > 0)
    assert again == 0
    assert max(map(len, (model.pairs, model.windows, model.pieces, model.older))) <= 40


def test_a_worker_encodes_parts_once_for_all_its_tasks(library, monkeypatch):
    with open(PATH, "rb") as f:
        lines = f.read()
    texts = ["Plain words, and others too", "", " and words", "漢 and\nothers", "two  spaces"] * 3
    monkeypatch.setattr(byte_bpe, "_models", {})
    asked, plain = [], byte_bpe.ByteBpe.encode
    monkeypatch.setattr(byte_bpe.ByteBpe, "encode", lambda self, text: asked.append(text) or plain(self, text))
    for task in range(3):
        ids = list(byte_bpe._batch_ids(pa.array(texts), *byte_bpe._model(lines, P.PATTERN)))
        assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
        parts = [x for x in asked if x != "two  spaces"]  # cutting there might change matches, so this text goes whole
        assert len(parts) == len(set(parts))
