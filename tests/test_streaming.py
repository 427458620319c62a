"""Streams give what batch runs give."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from seed import AS_OF, seed_rows, within

from querylog import read_query_log, write_tsv
from querylog.operators.timeseries import queries_over_time
from querylog.plans.fixture import fixture_log
from querylog.sinks.tsv import tsv_lines
from querylog.streaming.counts import (
    counts_to_table,
    merged_counts,
    read_top_names,
    top_names_to_table,
    top_per_bucket,
    windowed_counts,
    windowed_names,
)
from querylog.streaming.growing import stream_growing
from querylog.streaming.ingest import stream_jsonl, stream_tsv
from querylog.streaming.table import append_batch, compact_table, stream_to_table

SF_DIR = "/root/testdata/sf0.001"


def _drain(stream, folder, sink):
    """Run a stream to its present end into Parquet files and read them."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/{sink}")
        .option("checkpointLocation", f"{folder}/{sink}-progress")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    return stream.sparkSession.read.parquet(f"{folder}/{sink}")


def _bag(frame):
    return sorted(map(str, frame.collect()))


def _log_files(spark, folder, closing=True):
    """The fixture log as line files; a last far-off line closes all windows."""
    log = fixture_log(spark, SF_DIR)
    tsv_lines(log, fraction=True).select("line").repartition(3).write.text(f"{folder}/in")
    if closing:
        last = log.limit(1).withColumn("request_ts", F.lit("2999-01-01").cast("timestamp_ntz"))
        # Spark applies filters before the watermark: this row must pass them.
        last = last.withColumn("question_name", F.lit("tion.example"))
        tsv_lines(last, fraction=True).select("line").write.mode("append").text(f"{folder}/in")
    return log


def test_ingest_equals_batch(spark, seed_log, tmp_path):
    write_tsv(seed_log, f"{tmp_path}/in", fraction=True)
    batch = read_query_log(spark, "csv", f"{tmp_path}/in", glob="*.txt")
    query = stream_to_table(
        stream_tsv(spark, f"{tmp_path}/in", glob="*.txt"), f"{tmp_path}/t", f"{tmp_path}/progress"
    )
    assert query.awaitTermination(120)
    stored = read_query_log(spark, "table", f"{tmp_path}/t")
    assert _bag(stored.drop("request_date")) == _bag(batch)
    series = queries_over_time(stored, "30d", as_of=AS_OF)
    assert series.agg(F.sum("total")).first()[0] == len(within("30d"))


def test_json_ingest_equals_batch(spark, seed_log, tmp_path):
    record = F.struct(
        F.date_format("request_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_time"),
        F.lit("queryLog").alias("prefix"),
        F.col("client_name").alias("client_names"),
        "question_name",
        "response_type",
    )
    seed_log.select(F.to_json(record)).write.text(f"{tmp_path}/in")
    streamed = _drain(stream_jsonl(spark, f"{tmp_path}/in"), tmp_path, "out")
    batch = read_query_log(spark, "console", f"{tmp_path}/in")
    assert streamed.count() == len(seed_rows())
    assert _bag(streamed) == _bag(batch)


def test_windowed_counts(spark, tmp_path):
    log = _log_files(spark, tmp_path)
    stream = stream_tsv(spark, f"{tmp_path}/in", glob="*.txt")
    for sink, options in (("all", {}), ("some", {"domain": "tion"})):
        streamed = _drain(windowed_counts(stream, "24h", watermark="60 days", **options), tmp_path, sink)
        batch = windowed_counts(log, "24h", **options)
        assert _bag(streamed) == _bag(batch)


def test_windowed_names(spark, tmp_path):
    log = _log_files(spark, tmp_path)
    stream = stream_tsv(spark, f"{tmp_path}/in", glob="*.txt")
    streamed = _drain(windowed_names(stream, "clients", "30d", "60 days"), tmp_path, "out")
    batch = windowed_names(log, "clients", "30d")
    assert _bag(streamed) == _bag(batch)
    assert _bag(top_per_bucket(streamed, 3)) == _bag(top_per_bucket(batch, 3))


def test_late_rows_are_dropped(spark, tmp_path):
    """Streams drop what batch runs count: rows behind the watermark."""
    log = _log_files(spark, tmp_path)
    stream = stream_tsv(spark, f"{tmp_path}/in", glob="*.txt", max_files_per_trigger=1)
    streamed = _drain(windowed_counts(stream, "24h", watermark="1 minute"), tmp_path, "out")
    kept = streamed.agg(F.sum("total")).first()[0] or 0
    assert kept < log.count()


# --- Tables that streams keep ------------------------------------------------


def _ended(query):
    assert query.awaitTermination(180)


def _stored(spark, path):
    return read_query_log(spark, "table", str(path)).drop("request_date")


def _per_date(path):
    return {p.name: len(list(p.glob("*.parquet"))) for p in Path(path).glob("request_date=*")}


def test_stream_appends_batches_sorted_and_compacts(spark, tmp_path):
    log = fixture_log(spark, SF_DIR)
    tsv_lines(log, fraction=True).select("line").repartition(6).write.text(f"{tmp_path}/in")
    stream = stream_tsv(spark, f"{tmp_path}/in", glob="*.txt", max_files_per_trigger=1)
    _ended(stream_to_table(stream, f"{tmp_path}/t", f"{tmp_path}/progress", most_files=3))
    batch = read_query_log(spark, "csv", f"{tmp_path}/in", glob="*.txt")
    assert _bag(_stored(spark, tmp_path / "t")) == _bag(batch)
    last = "stream-000000000005-"
    for date in Path(tmp_path, "t").glob("request_date=*"):  # but for the last batch, no more than three
        assert sum(not f.name.startswith(last) for f in date.glob("*.parquet")) <= 3
    assert not list(Path(tmp_path).glob("t/_*/*"))
    for file in list(Path(tmp_path).glob("t/request_date=2024-01-1*/*.parquet"))[:12]:
        times = [r[0] for r in spark.read.parquet(str(file)).select("request_ts").collect()]
        assert times == sorted(times)
    # more arrives, the stream goes on where it was
    tsv_lines(log.limit(40), fraction=True).select("line").write.mode("append").text(f"{tmp_path}/in")
    stream = stream_tsv(spark, f"{tmp_path}/in", glob="*.txt")
    _ended(stream_to_table(stream, f"{tmp_path}/t", f"{tmp_path}/progress"))
    assert _stored(spark, tmp_path / "t").count() == log.count() + 40


def test_a_repeated_batch_adds_nothing(spark, seed_log, tmp_path):
    path = str(tmp_path / "t")
    halves = seed_log.where("duration_ms < 20"), seed_log.where("NOT coalesce(duration_ms < 20, false)")
    append_batch(halves[0], path, 0)
    append_batch(halves[1], path, 1)
    before = _bag(_stored(spark, path))
    assert before == _bag(seed_log)
    # cut short after some files were moved: what is there is replaced
    moved = next(Path(path).glob("request_date=*/stream-000000000001-*.parquet"))
    moved.unlink()
    append_batch(halves[1], path, 1)
    append_batch(halves[0], path, 0)
    assert _bag(_stored(spark, path)) == before
    append_batch(halves[0], path, 0, writer="other")  # another stream's first batch
    assert _stored(spark, path).count() == len(before) + halves[0].count()
    with pytest.raises(ValueError, match="writer"):
        append_batch(halves[0], path, 0, writer="a/b")


def test_compaction_that_was_cut_short_is_finished(spark, seed_log, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        append_batch(seed_log.where(F.pmod(F.hash("request_ts"), F.lit(5)) == i), path, i)
    before = _bag(_stored(spark, path))
    dates = [d.split("=")[1] for d, n in _per_date(path).items() if n > 1]
    assert dates
    date = dates[0]
    # as if it had stopped after its first removal: the list and the new files are there
    old = sorted(Path(path).glob(f"request_date={date}/*.parquet"))
    journal = Path(path, "_compacted", f"request_date={date}")
    spark.read.parquet(*map(str, old)).coalesce(1).write.parquet(str(journal / "files"))
    (journal / "_replaced").write_text("\n".join(f"request_date={date}/{f.name}" for f in old))
    old[0].unlink()
    assert sorted(compact_table(spark, path, most_files=1)) == sorted(set(dates) - {date})
    assert _bag(_stored(spark, path)) == before
    assert set(_per_date(path).values()) == {1}
    assert compact_table(spark, path, most_files=1) == []


def test_compaction_spares_the_batch_that_may_be_repeated(spark, seed_log, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        append_batch(seed_log, path, i)
    compact_table(spark, path, most_files=1, spare="stream-000000000002-")
    for date in Path(path).glob("request_date=*"):
        kinds = [f.name.startswith("stream-000000000002-") for f in date.glob("*.parquet")]
        assert kinds.count(False) == 1 and True in kinds
    append_batch(seed_log, path, 2)
    assert _stored(spark, path).count() == 3 * seed_log.count()


def test_top_names_of_buckets(spark, tmp_path):
    log = _log_files(spark, tmp_path)
    stream = stream_tsv(spark, f"{tmp_path}/in", glob="*.txt", max_files_per_trigger=1)
    expected = _bag(top_per_bucket(windowed_names(log, "clients", "30d"), 3))
    counts = windowed_names(stream, "clients", "30d", "60 days")
    for mode in ("append", "complete"):
        path = f"{tmp_path}/top-{mode}"
        _ended(top_names_to_table(counts, 3, path, f"{path}-progress", mode))
        found = read_top_names(spark, path).where("bucket_start < '2999-01-01'")
        assert _bag(found) == expected
    with pytest.raises(ValueError, match="whole buckets"):
        top_names_to_table(counts, 3, f"{tmp_path}/no", f"{tmp_path}/no-progress", "update")


def test_late_rows_are_added(spark, tmp_path):
    log = _log_files(spark, tmp_path, closing=False)
    late = log.where("request_ts < '2024-01-03'")
    first, then = f"{tmp_path}/log", f"{tmp_path}/log-progress"
    stream = stream_tsv(spark, f"{tmp_path}/in", glob="*.txt", max_files_per_trigger=1)

    def run(**options):
        _ended(counts_to_table(stream, "24h", first, then, lateness=timedelta(hours=1), **options))

    run()
    assert _bag(merged_counts(spark, first).drop("late")) == _bag(windowed_counts(log, "24h"))
    before = merged_counts(spark, first).agg(F.sum("late")).first()[0]
    tsv_lines(late, fraction=True).select("line").write.mode("append").text(f"{tmp_path}/in")
    run()
    assert _bag(merged_counts(spark, first).drop("late")) == _bag(windowed_counts(log.unionByName(late), "24h"))
    assert merged_counts(spark, first).agg(F.sum("late")).first()[0] == before + late.count()
    some = f"{tmp_path}/some"
    _ended(counts_to_table(stream, "24h", some, f"{some}-progress", domain="tion"))
    assert _bag(merged_counts(spark, some).drop("late")) == _bag(windowed_counts(log.unionByName(late), "24h", domain="tion"))


# --- Files that grow ---------------------------------------------------------


def _line(i, name="a.example"):
    return "\t".join(["2024-01-30 10:00:00", "10.0.0.1", "c", str(i), "CACHED", name, "x", "NOERROR", "CACHED", "A", "h"])


def test_growing_files_give_each_line_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out = str(tmp_path / "t")
    file = folder / "today.log"

    def taken():
        stream = stream_growing(spark, str(folder), most_bytes=300)
        _ended(stream_to_table(stream, out, f"{tmp_path}/progress"))
        return sorted(r["duration_ms"] for r in _stored(spark, out).collect())

    half = _line(3)
    file.write_text(f"{_line(1)}\n{_line(2)}\n{half[:30]}")
    (folder / "note.txt").write_text(_line(99) + "\n")
    assert taken() == [1, 2]  # the half line waits
    assert taken() == [1, 2]
    with file.open("a") as f:
        f.write(f"{half[30:]}\n{_line(4)}\n" + "\n" + _line(5, "b" * 900 + ".example") + "\n" + _line(6))
    (folder / "other.log").write_text(_line(7) + "\n" + _line(8) + "\n")
    assert taken() == [1, 2, 3, 4, 5, 7, 8]
    file.write_text(_line(10) + "\n")  # started anew
    assert taken() == [1, 2, 3, 4, 5, 7, 8, 10]


def test_written_directories_are_followed(spark, seed_log, tmp_path):
    write_tsv(seed_log, f"{tmp_path}/in", per_client=True, fraction=True)
    stream = stream_tsv(spark, f"{tmp_path}/in")
    _ended(stream_to_table(stream, f"{tmp_path}/t", f"{tmp_path}/progress"))
    assert _stored(spark, tmp_path / "t").count() == len(seed_rows())
    (tmp_path / "in" / "more.log").write_text(_line(1) + "\n")
    with pytest.raises(ValueError, match="beside written dates"):
        stream_tsv(spark, f"{tmp_path}/in")
