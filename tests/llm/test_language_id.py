import numpy as np
from pyspark.sql import functions as F

from storyloom.llm import language_id
from storyloom.llm.common import crc_remainder

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    model = language_id.train(docs.where(~F.col("held_out")), per_language=30)
    got = language_id.predict(docs.where("held_out"), model, ["doc_id", "lang"]).collect()
    assert len(got) > 200
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_blocks_do_not_change_a_score(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc def " * 50, "en"), (2, "xyz uvw ", "fr")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    texts = ["abc xyz def uvw " * 9, "a", "", "xyzabcdef"]

    letters = language_id._letters()

    def sums():
        out = np.zeros((len(texts), 2))
        for rows, parts, more in language_id._blocks(texts):
            grams, starts, _ = language_id._grams(parts, more, letters)
            for bucket in grams:
                np.add.at(out, rows, np.add.reduceat(model[1][: language_id.BUCKETS + 1][bucket], starts, axis=0))
        return out

    whole = sums()
    for size in (7, 10, 64):
        monkeypatch.setattr(language_id, "_BLOCK", size)
        assert np.allclose(sums(), whole)


def test_odd_documents(spark, odd_docs, no_docs):
    model = language_id.train(odd_docs)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.predict(odd_docs, model).collect()}
    assert {(2, "und", False), (3, "und", False), (4, "und", False), (6, "und", False), (1, "en", True)} <= got
    assert language_id.predict(odd_docs, model).count() == odd_docs.count()
    none = language_id.train(no_docs)
    assert none[0] == [] and {r.lang_pred for r in language_id.predict(odd_docs, none).collect()} == {"und"}
    assert language_id.predict(no_docs, model).collect() == []
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 5, 7, 8, None}
    assert kept.where("doc_id = 1 and score = 'clash'").count() == 2


def test_without_labels_every_lettered_text_stays(spark, odd_docs):
    from pyspark.sql import functions as F

    kept = language_id.keep_identified(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, 5, 7, None, 8], key=str)
