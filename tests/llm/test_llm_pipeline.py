import time

import corpus_pipeline
from conftest import DATA
from llm_cases import ROWS, SCHEMA, edge_docs
from pyspark.sql import functions as F
from test_llm_corpus import brute_force_components, tokens

from dupeframe.llm.quality_rules import clean_lines
from dupeframe.staging import CLEANUP_KEY, stage


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.dtypes, []
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, DATA)
        assert out.dtypes == columns
        out = corpus_pipeline.stage(out, name)
        assert out.where("n_chars <> length(text)").count() == 0
        seen.append((docs, out))
        docs = out
    kept = clean_lines(seen[0][0]).where("_quality.kept").count()
    assert seen[0][1].count() == kept
    assert seen[1][1].count() <= kept
    before = [(r.doc_id, r.text) for r in seen[2][0].collect()]
    firsts = {c for _, n, c in brute_force_components(before) if n}
    assert sorted(r.doc_id for r in seen[2][1].collect()) == sorted(firsts)
    pieces = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert sum(p.length for p in pieces if p.start == 0) > 0
    assert sum(p.start == 0 for p in pieces) == docs.count()


def test_near_duplicates_of_edges(spark):
    docs = edge_docs(spark)
    out = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(not tokens(r.text) for r in rows) == sum(not tokens(row[1]) for row in ROWS)
    assert sorted(r.text for r in rows if tokens(r.text)) == sorted({row[1] for row in ROWS if tokens(row[1])})


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_staging_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before = files()
    staged = stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "counted")
    ends = time.time() + 20  # they are deleted in the background
    while files() - before and time.time() < ends:
        time.sleep(0.1)
    assert not files() - before
    assert staged.count() == 7
    assert spark.conf.get(CLEANUP_KEY) == "false"
