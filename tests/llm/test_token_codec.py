import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import token_codec as codec
from tidewell.llm.pieces import ColumnCache, PartCache, encode_texts

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH) as f:
        return codec.WordTokenizer(f.read())


def test_parts_equal_the_whole_text(tokenizer):
    rnd = random.Random(5)
    alphabet = ["a", "B", "é", "É", "ß", "À", "×", "1", "²", "'s", "'", " ", "  ", "\n", "\t", "\xa0", "!", ".", ",", "漢", "́", "😀", "Σ", "İ", "ǰ", "J̌", "</w>", "<|endoftext|>", "the", "K"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 12))) for _ in range(5000)]
    ids, bounds = encode_texts(codec.simplified(pa.array(texts)), PartCache(tokenizer.encode, limit=500), False)
    for n, e in enumerate(tokenizer.full.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[bounds[n] : bounds[n + 1]].tolist() == e.ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=5000), st.integers(1, 3))
def test_files_round_trip(tmp_path_factory, values, skew):
    values = np.array([v // 10 ** (skew - 1) for v in values], np.uint32)
    table = codec.FrequencyTable.from_counts(np.bincount(values, minlength=3001))
    uri = "file://" + str(tmp_path_factory.mktemp("rans") / "f.rans")
    writer = codec.FileWriter(uri, table, lanes=8, block=64)
    cuts = sorted({len(values) // 3, len(values) // 2})
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(values)])):
        writer.add(n or None, values[a:b])
    writer.close()
    reader = codec.FileReader(uri, table)
    read = lambda a, b: np.concatenate([np.zeros(0, np.uint32), *reader.tokens(a, b)])
    assert (read(0, len(values)) == values).all()
    a, b = len(values) // 4, len(values) * 3 // 4
    assert (read(a, b) == values[a:b]).all()
    assert reader.ids[:2] == [None, 1] and int(reader.sizes.sum()) == len(values)


def test_damage_and_other_tables_are_noticed(tmp_path):
    values = np.arange(5000, dtype=np.uint32) % 7
    table = codec.FrequencyTable.from_counts(np.bincount(values))
    path = tmp_path / "f.rans"
    writer = codec.FileWriter(f"file://{path}", table)
    writer.add(1, values)
    writer.close()
    with pytest.raises(ValueError, match="another frequency table"):
        codec.FileReader(f"file://{path}", codec.FrequencyTable.from_counts([1, 2]))
    raw = bytearray(path.read_bytes())
    raw[400] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(codec.FileReader(f"file://{path}", table).tokens(0, 5000))


def test_nulls_repeats_order_and_clashing_columns(spark, tmp_path):
    long = "very long text " * 40_000
    rows = [(3, "c", 1), (1, "One two", 2), (None, "no id", 3), (2, None, 4), (1, "One two", 5), (4, "", 6), (5, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    files = codec.write_token_files(docs, PATH, 2, out_uri=f"file://{tmp_path}/out", file_tokens=50_000)
    library = Tokenizer.from_file(PATH)
    want, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    got = {(r.doc_id, r.start): tuple(r) for r in files.digests().collect()}
    assert sorted(got.values(), key=lambda r: r[1]) == [w[:4] for w in want]
    assert {(r.doc_id, r.start): r.token_ids for r in files.documents().collect()} == {w[:2]: w[4] for w in want}
    assert len(list((tmp_path / "out").glob("*.rans"))) >= 2 and not list((tmp_path / "out").glob("*.draft"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert codec.write_token_files(docs, PATH, 2).digests().count() == 0


def test_column_cache_gives_the_ids_of_the_library(tokenizer):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    words = ["plain", "Éàíß", "ÿÀÖ", "x" * 120, "é" * 60, "word,", "çà.", "12a", "漢字", "a,,", "", "É.x", "don't"] + ["".join(rnd.choices("abcdeàíÿß", k=rnd.randint(1, 9))) for _ in range(900)]
    cache, asked = ColumnCache(lambda parts: asked.extend(parts.to_pylist()) or tokenizer.runs(parts), limit=300), []
    for _ in range(6):
        texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 200))) for _ in range(4)]
        ids, bounds = encode_texts(pa.array(texts), cache, False)
        assert len(cache.parts) <= 300 and len(cache.flat) == cache.lengths.sum()
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(set(asked)) < len(asked) < 6 * len(words)  # some were held, some had to go
