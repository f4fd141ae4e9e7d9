"""The pipeline's stages one after the other."""

import corpus_pipeline
from pageforge.llm.common import cut, shared_dir

TEXT = "It was a day like any other, and nobody in the town thought that anything would ever change there at all"


def test_stages(spark):
    rows = [(1, TEXT, "en", "a", 5), (2, TEXT, "en", "a", 5), (3, TEXT + " soon", "en", "a", 5), (4, "call +1 (212) 555-0199 for more", "en", "b", 5), (5, "12345 !!", "en", "b", 5), (6, None, None, None, None), (7, "Der Hund ging nach Hause und schlief", "de", "c", 5)]
    docs, where = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shared_dir(spark)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, ""), where, name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept == [[1, 2, 3, 4, 7], [1, 4, 7], [1, 4, 7]]
    text = {r["doc_id"]: r for r in docs.collect()}
    assert text[4]["text"] == "call <phone> for more" and text[4]["n_chars"] == 21 and text[1]["text"] == TEXT
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in packed) == [1, 4, 7] and len({r["sequence_id"] for r in packed}) == 1


def test_run(spark, tmp_path):
    """run() against plain Python: every piece of every document that should be left, and no other."""
    import random
    import zlib

    import numpy as np
    import pyarrow as pa
    from public_tokenizers import path
    from pyspark.sql import Row
    from test_corpus_operators import brute_groups
    from tokenizers import Tokenizer

    from pageforge.llm import langid, pii

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).union(
        spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, "12 + 34", "en", "x", 7), (9004, "call +1 (212) 555-0199 " * 4000, "en", "x", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    rows = docs.collect()
    rng = random.Random(4)
    for k in range(40):  # copies, and copies with a word more
        r = rng.choice(rows[:150])
        rows.append(Row(doc_id=9100 + k, text=r["text"] + " more" * (k % 2), lang=r["lang"], source=r["source"], n_chars=r["n_chars"]))
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    model = langid.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    seen, has = langid.presence(pa.array([r["text"] for r in rows], pa.string()))
    kept = [r for r, h, x in zip(rows, has, model.scores(seen).max(1)) if h and x >= langid.LEAST_SCORE]
    assert 9004 in {r["doc_id"] for r in kept} and not {9001, 9002, 9003} & {r["doc_id"] for r in kept}
    stays = {i for i, _, group in brute_groups([(r["doc_id"], r["text"]) for r in kept]) if i == group}
    kept = [r for r in kept if r["doc_id"] in stays]
    base, added = pii.find(pa.array([r["text"] for r in kept]), pii.train())
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = set()
    for r, b, a in zip(kept, base, added):
        ids = own.encode(pii.masked(r["text"], b + a), add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.add((r["doc_id"], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert len(got) == len(want) and set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    filled = got.sort_values("offset").groupby("sequence_id")
    for _, s in filled:
        assert (s["offset"].to_numpy() == np.concatenate([[0], np.cumsum(s["length"])[:-1]])).all() and s["length"].sum() <= 4096
    assert len(filled) <= -(-got["length"].sum() // 4096) + 1


def test_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, stays boolean, rows long, __id long, __node long, node string, part int, score double, `a b` int"
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").columns == none.columns and stage(spark, none, "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
    rows = [(1, TEXT, "en", "a", 5, None, None, None, None, "x", 1, None, 7), (2, TEXT, None, None, None, True, 1, 1, 1, None, None, 1.0, None), (3, None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and {r["a b"] for r in kept.collect()} == {7, None}
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in corpus_pipeline.personal_data(spark, docs, "").collect()) == [1, 2, 3]
