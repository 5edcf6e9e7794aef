"""The stages, each on what the one before kept; decisions against the operators' own brute-force tests."""

import collections

from pyspark.sql import functions as F

from tests.llm.test_operators import documents


def test_stages_chain(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("row", F.lit(1))
    n, names = {}, [k for k, _ in p.STAGES]
    assert names == ["language ID", "MinHash near-dedup", "suffix-array dedup", "source mixing", "best-fit packing"]
    for i, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        n[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == p.COLUMNS
    first = collections.Counter(r.doc_id for r in n["language ID"])
    assert not {80, 81, 82, 87} & set(first) and {83, 84, 85, 86} <= set(first)
    second = collections.Counter(r.doc_id for r in n["MinHash near-dedup"])
    assert sum(40 <= (i if i is not None else -1) < 60 or 70 <= (i if i is not None else -1) < 80 for i in second) == 1 and second[3] == 1
    third = {r.doc_id: r for r in n["suffix-array dedup"]}
    assert set(third) == set(second) and len({len(third[i].text) for i in range(60, 70)}) > 1 and max(len(third[i].text) for i in range(60, 70)) < 700
    assert third[83].text == "" and third[83].n_chars == 0
    assert sum(len(r.text.split()) for r in n["source mixing"]) > 0
    assert {r.doc_id for r in n["best-fit packing"]} == {r.doc_id for r in n["source mixing"]}


def test_run_equals_the_stages(spark, tmp_path):
    """run() against the stages called one by one; sequence numbers are any."""
    import corpus_pipeline as p

    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/step{i}")
        docs = spark.read.parquet(f"{tmp_path}/step{i}")
    got = p.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect())) and got.count() > 0


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_two_texts_under_one_id(spark, tmp_path):
    """The copy goes, and does not come back with the other text of its id."""
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(2, text, "en", "a"), (3, text, "en", "a"), (3, "quite another text of that id", "en", "a"), (None, text, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = p.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in got if r.doc_id) == [(2, "word0"), (3, "quite")] and sum(r.doc_id is None for r in got) == 1
