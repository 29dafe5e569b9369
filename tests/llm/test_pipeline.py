"""run() against brute force: every stage judged on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from hourloom.llm.queries import quality_model
from hourloom.llm.text import written

from .cases import frame, prose
from .test_duplicates import brute_components, brute_repeats
from .test_scores_and_benchmark import brute_contamination

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality_classifier", "near_duplicates", "substring_dedup", "decontamination", "mixing"]

    model = quality_model(spark, SF)
    before = texts(docs)
    docs = written(stages["quality_classifier"](spark, docs, SF), "t")
    _, scores = model.scores([r["text"].encode() for r in before.values()])
    after = texts(docs)
    assert set(after) == {i for i, p in zip(before, scores) if p >= 0.7} and docs.columns == COLUMNS

    rows = sorted((i, r["text"]) for i, r in after.items())
    docs = written(stages["near_duplicates"](spark, docs, SF), "t")
    after = texts(docs)
    assert set(after) == {i for i, _, c in brute_components(rows, 5, 80) if i == c} and docs.columns == COLUMNS

    rows = sorted((i, r["text"]) for i, r in after.items())
    docs = written(stages["substring_dedup"](spark, docs, SF), "t")
    before, after = after, texts(docs)
    judged = {r[0]: r for r in brute_repeats(rows, 50)}
    assert set(after) == {i for i, r in judged.items() if not r[2] or r[2] < r[1]} and docs.columns == COLUMNS
    for i, r in after.items():
        assert len(r["text"].encode().split()) == judged[i][1] - judged[i][2] and r["n_chars"] == len(r["text"])
        assert judged[i][2] or r["text"] == before[i]["text"]

    rows = sorted((i, r["text"]) for i, r in after.items())
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = written(stages["decontamination"](spark, docs, SF), "t")
    after = texts(docs)
    assert set(after) == {r[0] for r in brute_contamination(rows, bench) if not r[-1]} and docs.columns == COLUMNS

    mixed = stages["mixing"](spark, docs, SF)
    assert {c: mixed.schema[c].dataType for c in COLUMNS} == {f.name: f.dataType for f in docs.schema}
    assert {r["doc_id"] for r in mixed.collect()} <= set(after)
    # run() chains the same stages.
    assert Counter((r["doc_id"], r["text"], r["copy_no"]) for r in cp.run(spark, SF).collect()) == Counter(
        (r["doc_id"], r["text"], r["copy_no"]) for r in mixed.collect())


def test_one_row_of_each_group_stays(spark):
    a, b, c = (prose(k, 80) for k in (1, 2, 3))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (None, b + " end"), (7, c), (None, c), (8, "."), (9, None), (9, None)]
    kept = dict(cp.STAGES)["near_duplicates"](spark, frame(spark, rows).select(*COLUMNS), SF)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == COLUMNS and got[1, a] == got[7, c] == 1 and got[9, None] == 2 and got[8, "."] == 1
    assert got[None, b] + got[None, b + " end"] == 1 and sum(got.values()) == 6


def test_stages_take_empty_input(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    a = prose(1, 80)
    rows = [(1, a), (1, a), (2, a), (None, None), (3, prose(3, 90))]
    names = ("_key", "_of", "_first", "_stays", "_row_key", "_mix_mean", "_mix_source", "_changed_key", "_n", "row_key", "n_removed")
    docs = frame(spark, rows).select(*COLUMNS).withColumns({c: F.lit(5) for c in names}).withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, SF), "t")
        assert out.columns[:len(docs.columns)] == docs.columns
        assert all(r[c] == 5 for r in out.collect() for c in names)
        if name == "near_duplicates":
            assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]
