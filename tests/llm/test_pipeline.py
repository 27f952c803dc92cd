from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyline.llm import cube_mixing, jaccard_join, pii, quality_forest


@pytest.fixture(scope="module")
def sf_dir(docs, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    junk = " ".join(f"w{i}###" for i in range(80))
    more = spark.createDataFrame([(100 + i, f"word{i} " + " ".join(f"t{i}x{j}" for j in range(80)), "en", "s9", 1) for i in range(30)] + [(200 + i, f"{i} {junk}", "en", "s9", 1) for i in range(20)] + [(300, f"word1 {' '.join(f't1x{j}' for j in range(80))} more", "en", "s9", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(*more.columns).unionByName(more).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(25)] + [(200 + i, 0, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_every_stage_takes_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in quality_forest.judged(docs, labels).where("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    assert {r.doc_id for r in one.collect()} == kept and set(range(100, 130)) <= kept and not kept & set(range(200, 220))
    classes = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(one).collect()}
    assert None not in kept and len(classes) == one.count()  # here ids do for rows
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(classes.values())) and 300 not in {r.doc_id for r in two.collect()}
    three = corpus_pipeline.personal_data(spark, two, sf_dir).cache()
    assert three.count() == two.count() and three.where(F.length("text") != F.col("n_chars")).count() == 0
    assert all(not any(pii.base_spans(r.text or "").values()) for r in three.collect())
    copies = {r.doc_id: r["copies"] for r in cube_mixing.mixed(three).collect()}
    four = corpus_pipeline.mixing(spark, three, sf_dir).cache()
    assert Counter(r.doc_id for r in four.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert one.columns == two.columns == three.columns == four.columns == columns
    five = corpus_pipeline.packing(spark, four, sf_dir)
    assert five.select("doc_id").distinct().count() == four.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0] == five.agg(F.sum("length")).first()[0]


def test_empty_table(spark, sf_dir, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_rows_count_and_not_ids(spark, sf_dir):
    """Null and repeated ids, and columns whose names stages could use, at every stage."""
    long = [" ".join(f"a{i}b{j}" for j in range(70)) for i in range(4)]
    mail = "write to jo.doe@mail.example.com and "
    rows = [(None, mail + long[0], "en", "s", 7, "x"), (None, long[1], "en", "s", 7, "x"), (5, mail + long[2], "en", "s", 7, "y"), (5, long[3], "en", "s", 7, "z"), (5, "too short", "en", "s", 7, "z"), (None, None, None, None, None, None), (5, long[3], "en", "s", 7, "z"), (6, long[3], "en", "t", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_key long, copies string")
    names = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    good = [r[:2] for r in rows if r[1] and len(r[1].split()) >= 50]
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert names(one) == sorted(good, key=str) and one.columns == docs.columns
    two = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert names(two) == sorted({*good, (5, "too short"), (None, None)} - {(6, long[3])}, key=str) and two.columns == docs.columns
    three = corpus_pipeline.personal_data(spark, docs, sf_dir)
    assert names(three) == sorted(((i, t and t.replace("jo.doe@mail.example.com", "[EMAIL]")) for i, t, *_ in rows), key=str) and three.schema.names == docs.columns
    four = corpus_pipeline.mixing(spark, docs, sf_dir).collect()
    assert {r.row_key for r in four} == {7} and {r[:2] for r in map(tuple, four)} <= {r[:2] for r in rows}
    weight = sum(len((r.text or "").split()) for r in four if r.source == "s")
    assert weight > 0 and corpus_pipeline.packing(spark, docs, sf_dir).select("doc_tokens").count() >= len(rows)


def test_masking_reads_spelled_out_addresses_and_keys(spark, sf_dir):
    filler = "the morning was long and nobody said a word about it to the others who had come along "
    planted = [filler * 3 + "or write to jane dot porter at fields dot org" + ". " + filler, filler + 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"' + " " + filler * 2]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*planted, filler * 4])], "doc_id long, text string")
    out = [r.text for r in sorted(pii.masked(docs).collect())]
    assert "porter" not in out[0] and "[EMAIL]" in out[0] and "9f86d081" not in out[1] and "[SECRET]" in out[1] and out[2] == filler * 4
