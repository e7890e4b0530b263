"""Live forms against their batch forms."""

from datetime import datetime, timedelta, timezone

from tessitura.operators import segments
from tessitura.streaming import live
from tests.test_folds import WORDS, make_words

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_live_spans_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = make_words(7, streams=2, n=80)
    timed = [(str(r[0]), r[1], r[2], r[3], EPOCH + timedelta(seconds=r[2])) for r in rows]
    far = [("end", 0, 9e5, 9e5 + 1, EPOCH + timedelta(seconds=9e5))]
    schema = "stream_id string, token_id long, start_s double, end_s double, ts timestamp"
    ordered = sorted(timed, key=lambda r: r[4])
    late = [("0", 999, ordered[0][2], ordered[0][2] + 0.1, ordered[60][4])]
    # After the far words the watermark stands behind everything; these words must still be told.
    lost = [("0", 1000, 1.0, 1.5, EPOCH + timedelta(seconds=1)), ("new", 1, 2.0, 2.5, EPOCH + timedelta(seconds=2))]
    parts = [ordered[:60], ordered[60:120] + late, ordered[120:], far, lost]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/cp")
    got = live.run_to_table(live.live_spans(stream), spark).collect()
    want = segments.span_rows(segments.gap_islands(spark.createDataFrame(rows, WORDS), 2.0)).collect()
    spans = {(r.stream_id, r.start_s, r.end_s, r.n_words) for r in got if r.kind == "span" and r.stream_id != "end"}
    assert spans == {(str(r.stream_id), r.start_s, r.end_s, r.n_words) for r in want}
    assert sorted(r.token_id for r in got if r.kind == "late") == [1, 999, 1000]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
