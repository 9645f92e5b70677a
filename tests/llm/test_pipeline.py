import random

import corpus_pipeline
from fotolake.llm import exact_dedup, mixing, ngram_join, quality


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    rng = random.Random(14)
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioubcd") for _ in range(5)) for _ in range(n))
    rows = [(i, text(60), "en", "ab"[i % 2], 1) for i in range(120)]
    rows += [(200, rows[0][1], "en", "a", 1), (201, rows[1][1] + " tail", "en", "b", 1), (202, "short text", "en", "a", 1), (203, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}
    want = docs.where(docs.doc_id.isin([r["doc_id"] for r in quality.quality(docs).where("kept").collect()]))
    found = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert ids(found) == ids(want) and not {202, 203} & ids(found) and set(range(120)) <= ids(found) | {0}
    second = corpus_pipeline.STAGES[1][1](spark, found, str(tmp_path))
    assert ids(second) == {r["doc_id"] for r in exact_dedup.exact_dedup(found).where("kept").collect()} and 200 not in ids(second)
    third = corpus_pipeline.STAGES[2][1](spark, second, str(tmp_path))
    assert 201 not in ids(third) and ids(third) == {r["component_id"] for r in ngram_join.jaccard_groups(second, 5, 4, 5).collect()}
    fourth = corpus_pipeline.STAGES[3][1](spark, third, str(tmp_path))
    assert ids(fourth) == {r["doc_id"] for r in mixing.mix_report(third).where("taken > 0").collect()}
    assert all(f.columns == docs.columns for f in (found, second, third, fourth))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids(fourth)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __id long, __h string, kept string, size int, `a.b` string, `c``d` int"


def test_stages_on_awkward_tables(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("aeioubcd") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    more = (1, "h", "k", 2, "dot", 3)
    rows = [(i, text(40), "en", "ab"[i % 2], 1, *more) for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "a", 1, *more), (None, None, None, None, None, *more), (None, None, None, None, None, *more), (70, "", "en", None, 1, *more), (71, text(30_000), None, None, 1, *more)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        full, empty = (spark.createDataFrame(r, COLUMNS) for r in (rows, []))
        found = stage(spark, full, "").collect()
        assert stage(spark, empty, "").collect() == [] and stage(spark, empty, "").columns == full.columns
        ids = [r["doc_id"] for r in found]
        known = {tuple(r) for r in rows}
        assert found and {tuple(r) for r in found} <= known and 71 in ids, name
        if name == "exact_dedup":
            assert ids.count(0) == 1 and ids.count(None) == 1 and 70 not in ids or ids.count(70) == 1
            assert len({r["text"] or "" for r in found}) == len(found)
        if name == "ngram_join":
            assert ids.count(0) == 3 and ids.count(None) == 3 and 70 in ids
        if name == "quality_rules":
            assert 70 not in ids and all(r["text"] for r in found)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, spark.createDataFrame([], COLUMNS), "").count() == 0
    assert last(spark, spark.createDataFrame(rows, COLUMNS), "").groupBy().sum("length").first()[0] > 30_000
