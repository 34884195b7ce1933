import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken

from tidewell.llm import byte_bpe


def test_stages_in_order_with_their_effects(spark, tmp_path):
    line = "this is one long line of good and plain words number {} with an end"
    docs = [(n, "\n".join(line.format(chr(97 + n) * 3 + "q" * k) + f" {hashlib.md5(bytes([n, k])).hexdigest()} {hashlib.md5(bytes([k, n])).hexdigest()}" for k in range(4)), "en", "s", 1) for n in range(20)]
    docs += [(50, docs[3][1], "en", "s", 1), (51, docs[4][1] + "\nextra words at the very end of it", "en", "s", 1), (52, "before it " + "one two three four five six seven eight nine ten eleven" + " after it", "en", "s", 1), (53, None, None, None, None)]
    frames = {"documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "One, two three four five six seven eight nine ten")], "item_id long, text string")}
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    kept = {}
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, f"file://{tmp_path}")
        if number < 4:
            assert out.columns == frames["documents"].columns
        out.write.parquet(f"file://{tmp_path}/out{number}")
        now = spark.read.parquet(f"file://{tmp_path}/out{number}")
        kept[name] = {r.doc_id for r in now.collect()}
    everyone = {d[0] for d in docs}
    first, lines, near, clean, last = kept.values()
    assert first == lines == everyone  # without labels none is rejected
    # Line dedup has emptied the copy 50; of the empty texts 50 and 53 one stays.
    assert near <= lines and {0, 3, 50, 52} <= near and 53 not in near
    assert clean == near - {52} and last == clean
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(f.read()), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"file://{tmp_path}/out3").collect()}
    for r in now.collect():
        assert r.token_ids == np.array(library.encode_ordinary(texts[r.doc_id] or ""), np.uint32).tobytes()
    run = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {r.doc_id for r in run.collect()} == last
