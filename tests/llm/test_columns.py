"""Pipeline stages keep columns of any name and type, and rows of any kind."""

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from stepweave.llm import decontamination, jaccard, lines, quality

INNER = ("covered lines line_id line_key line_key2 own_text row row_id row_key judged_id judged_key kept_text n_lines n_removed "
         "removed w1 w2 pos first print component shard hits near text_key found copies own n f low").split()


def clashing(spark, rows):
    """Documents whose further columns have the operators' inner names, with values that must come through."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.StringType()),
                           *[T.StructField(c, T.ArrayType(T.StringType()) if i % 3 == 0 else T.StringType() if i % 3 else T.IntegerType())
                             for i, c in enumerate(INNER)]])
    extra = [[f"v{i}", None] if i % 3 == 0 else f"v{i}" for i in range(len(INNER))]
    return spark.createDataFrame([(i, t, "many", *extra) for i, t in rows], schema), tuple(extra)


PASSAGE = "\n".join(f"shared line number {i} of a passage" for i in range(6))
ROWS = [(1, f"one\n{PASSAGE}"), (2, f"two\n{PASSAGE}"), (3, "alone here"), (None, f"three\n{PASSAGE}"), (5, None), (6, ""),
        (7, "word " * 40000), (7, "word " * 40000), (None, None)]


def stages(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "alone here")], "item_id bigint, text string")
    return {"quality": lambda d: quality.kept(d, labels), "lines": lines.dedup_text, "jaccard": jaccard.one_of_each,
            "clean": lambda d: decontamination.clean(d, bench)}


@pytest.mark.parametrize("stage", ["quality", "lines", "jaccard", "clean"])
def test_columns_come_through(spark, stage):
    docs, extra = clashing(spark, ROWS)
    out = stages(spark)[stage](docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert all(tuple(r)[3:] == extra for r in rows)
    if stage == "lines":
        texts = {(r.doc_id, r.text): r.n_chars for r in rows}
        assert texts[1, ROWS[0][1]] == "many" and texts[2, "two"] == "3" and texts[None, "three"] == "5" and len(rows) == 9
    if stage == "clean":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 2, 5, 6, 7, 7]
    if stage == "jaccard":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 3, 5, 6, 7]


@pytest.mark.parametrize("stage", ["quality", "lines", "jaccard", "clean"])
def test_empty_tables(spark, stage):
    docs, _ = clashing(spark, [])
    out = stages(spark)[stage](docs)
    assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == 0


def test_results_replace_columns_of_their_names(spark):
    docs, _ = clashing(spark, ROWS)
    found = lines.dedup(docs)
    assert sorted(found.columns) == sorted(docs.columns) and found.where("n_removed = 6").count() == 2


def test_pipeline_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    docs, _ = clashing(spark, ROWS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "alone here")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert 3 not in kept and {6, 7} <= kept
