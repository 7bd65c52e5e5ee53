"""Streams that keep tables: what a micro-batch reads and writes, and spans without a finish."""

from pyspark.sql import functions as F

from waymark.operators.dedup import semantic_dedup
from waymark.session import fresh_path
from waymark.streaming import alerts, logs, runner


def drained(writer, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def vectors(spark, low, high):
    rows = spark.range(low, high).withColumnRenamed("id", "vec_id").withColumn("label", (F.col("vec_id") % 5).cast("int"))
    return rows.withColumn("embedding", F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.sin(F.col("vec_id") % 23 * (i + 1)).cast("float")))


def test_dedup_stream_reads_the_parts_it_needs(spark):
    source, out, checkpoint = (fresh_path(spark, n) for n in ("v", "accepted", "c"))
    rows = vectors(spark, 0, 300)
    rows.limit(0).write.parquet(source)
    for low, high in ((0, 200), (200, 300)):
        vectors(spark, low, high).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        drained(runner.dedup_stream(stream, out, "vec_id", bucket=("label",), threshold=0.92, parts=7), checkpoint)
    want = semantic_dedup(rows, "vec_id", "embedding", ("label",), 0.92).filter("kept")
    kept = sorted(r["vec_id"] for r in spark.read.parquet(out).collect())
    assert kept == sorted(r["vec_id"] for r in want.collect()) and len(kept) < 300

    def placed(df):
        return df.withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(7)).cast("int"))

    one = vectors(spark, 0, 300).filter("label = 3")
    read = runner.accepted_of(spark, out, one, 9, placed)
    part = placed(one).first()["_part"]
    assert read.columns == rows.columns and read.filter("label = 3").count() > 0
    files = {f.split("_part=")[1].split("/")[0] for f in read.select("vec_id", F.input_file_name().alias("f")).rdd.map(lambda r: r["f"]).distinct().collect()}
    assert files == {str(part)}
    assert "PartitionFilters: [isnotnull(_part" in read._jdf.queryExecution().toString() or "PartitionFilters: [(_part" in read._jdf.queryExecution().toString()


def test_log_stream_has_two_tables(spark):
    source, kept, broken, checkpoint = (fresh_path(spark, n) for n in ("l", "k", "b", "c"))
    lots = [['{"timestamp": "2024-03-01T10:00:00Z", "severity": "INFO", "message": "a"}', "plain", ""], ['{"severity": "DEBUG", "message": "b"}', '{"message": "c", "extra": 1}', '{"cut'], []]
    for lot in lots:
        spark.createDataFrame([(x,) for x in lot], "value string").write.mode("append").text(source)
        drained(logs.split_log_stream(spark.readStream.text(source), kept, broken), checkpoint)
    good, bad = spark.read.parquet(kept), spark.read.parquet(broken)
    assert sorted((r["message"], r["_batch"]) for r in good.collect()) == [("a", 0), ("c", 1)]
    assert sorted((r["broken"], r["_batch"]) for r in bad.collect()) == [("", 0), ("plain", 0), ('{"cut', 1)]


def test_spans_without_a_finish(spark):
    folder = fresh_path(spark, "spans")
    # (id, start, finish): finished, finished twice, open for long, open for a while, the last moves the watermark
    spans = [(1, 0, 5), (2, 10, 20), (2, None, 30), (3, 60, None), (4, 9000, None), (5, 10_000, 10_001)]
    spark.createDataFrame(spans, "span_id long, s long, e long").write.parquet(folder)

    def frames(rows):
        starts = rows.filter("s IS NOT NULL").select("span_id", F.lit("n").alias("name"), F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("started_at"))
        return starts, rows.filter("e IS NOT NULL").select("span_id", F.timestamp_seconds(F.col("e") + 1_700_000_000).alias("finished_at"), F.lit(True).alias("success"))

    table = spark.read.parquet(folder)
    batch = sorted((r["span_id"], r["duration_ms"]) for r in alerts.span_durations(*frames(table)).collect() if r["span_id"] != 2)
    assert batch == [(1, 5000.0), (3, None), (4, None), (5, 1000.0)]
    stream = spark.readStream.schema(table.schema).parquet(folder)
    found = runner.drain(alerts.span_durations(*frames(stream), max_hours=1), "spans").collect()
    got = sorted((r["span_id"], r["duration_ms"]) for r in found if r["span_id"] != 2)
    # span 4 may still be finished
    assert got == [(1, 5000.0), (3, None), (5, 1000.0)]
    assert len([r for r in found if r["span_id"] == 2]) == 1
