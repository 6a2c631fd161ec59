"""Slices land in files over all tasks, and each reader's rows of a slice are in one file."""

from pyspark.sql import functions as F

from storyloom.checks import streams
from storyloom.checks.streams import land_slices
from storyloom.streaming import jobs


def test_slices_land_over_all_tasks(spark, tmp_path):
    path, tasks = str(tmp_path / "slices"), spark.sparkContext.defaultParallelism
    rows = spark.range(400).select(F.concat(F.lit("p"), F.col("id") % 50).alias("profile_id"), "id")
    assert land_slices([rows.where("id < 200"), rows.where("id >= 200")], path) == tasks > 2
    got = spark.read.parquet(path).withColumn("file", F.input_file_name())
    assert got.count() == 400
    assert got.groupBy("profile_id", F.expr("id < 200")).agg(F.countDistinct("file").alias("n")).where("n <> 1").count() == 0


def test_each_half_is_one_micro_batch(spark, tmp_path, monkeypatch):
    """The number of micro-batches of ``stream_ingest`` does not grow with the files that its halves land as."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    halves = []

    def counted(raw, sources, store, checkpoint, *rest):
        def each(batch, _):
            rows = batch.select((F.col("ord") % 2).alias("half"), F.input_file_name().alias("file")).collect()
            halves.append((len({r.file for r in rows}), {r.half for r in rows}, len(rows)))

        jobs.run_batches(raw, each, checkpoint)

    monkeypatch.setattr(jobs, "ingest_stream", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        streams.stream_ingest(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [half for _, half, _ in halves] == [{0}, {1}] and halves[0][0] > 4
    assert sum(n for _, _, n in halves) == docs.count()
