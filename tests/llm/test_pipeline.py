import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(P.STAGES):
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[4]


def test_poor_documents_go_and_good_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.drop_poor_quality(spark, docs, SF).select("doc_id").distinct()
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(docs, "doc_id", "left_semi")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    assert good.join(kept, "doc_id", "left_semi").count() > 0.97 * good.count()
    assert bad.join(kept, "doc_id", "left_semi").count() < 0.1 * bad.count() + 1


def test_rows_without_an_id_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id at all", "en", "src0", 12), (5, "x y z", "en", None, 5), (5, "x y z", "en", None, 5)], docs.schema)
    once = P.drop_near_duplicates(spark, odd, SF)
    assert sorted(r["text"] for r in once.collect()) == ["no id at all", "x y z"]
    assert P.mix_sources(spark, odd, SF).where("doc_id is null").count() == 1
