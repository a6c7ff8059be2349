"""The pipeline's stages, and the queries as the driver calls them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pixelbrook.llm import decontaminate, pieces, queries, secrets, simhash, toxicity
from pixelbrook.llm.arrow import read

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = queries.QUERIES[name](spark, SF)
    if name.split("_")[0] in ("op1", "op2", "op3", "op5", "op7", "op8"):
        assert rows.count() == n and rows.select("doc_id").distinct().count() == n
    else:
        assert rows.count() > 0


def test_stages(spark):
    docs = read(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "password=abcdefg1", "en", "s", 17), (9001, "", "en", "s", 0), (9002, "you idiot, you scum", "en", None, 19), (9002, "you idiot, you scum", "en", None, 19)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, SF)
        assert docs.columns == COLUMNS and docs.count() <= before
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert docs.where("doc_id = 9002").count() == 0 and docs.where("text like '%password=abcdefg1%'").count() == 0
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert decontaminate.report(docs, read(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert secrets.report(docs).where("n_assign + n_access + n_hex > 0 and spans not like '%<%'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() and last.where("not round_trip").count() == 0


def test_stages_are_their_operators(spark):
    docs = read(spark, SF, "documents")
    grammar = toxicity.learn(docs, read(spark, SF, "labels"))
    kept = {r.doc_id for r in corpus_pipeline.clean_language(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if grammar.read(r.text)[0] < toxicity.THRESHOLD}
    one = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()}
    assert one == {r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_results_hold_the_segmentations(spark):
    """The registered query and the last stage give ids, from which the text that was segmented comes back."""
    docs = read(spark, SF, "documents", "doc_id", "text")
    for rows in (queries.QUERIES["op9_pieces"](spark, SF), corpus_pipeline.STAGES[-1][1](spark, docs, SF)):
        back = pieces.decoded(rows).join(docs.withColumnRenamed("text", "want"), "doc_id")
        assert back.count() > 0 and back.where("not coalesce(length(ids) = 4 * n_pieces and text = coalesce(want, ''), false)").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
