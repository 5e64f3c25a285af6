"""The stateful quality stream equals the batch score at later instants without new events; repeated events change nothing."""

from datetime import datetime, timedelta

import pytest

from docweave.operators import stats
from docweave.streaming import quality

EVENTS = "chunk_id long, event_id long, kind string, ts timestamp"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, quality.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def test_quality_follows_the_days(rocksdb, tmp_path):
    spark, day = rocksdb, datetime(2024, 1, 1)
    first = [(c, 100 + c, "created", day - timedelta(days=40 * c)) for c in range(1, 6)]
    first += [(c, 1000 + 10 * c + i, kind, day + timedelta(hours=i)) for c in range(1, 6) for i, kind in enumerate(["hit", "hit", "like", "dislike", "correction"][: c + 1])]
    again = first[5:12] + [(5, 900, "deleted", day + timedelta(hours=9))]
    beats = [[(99, 5000 + i, "hit", at), (99, 6000 + i, "hit", at + timedelta(hours=2))] for i, at in enumerate((day + timedelta(days=n) for n in (1, 3, 200)))]
    out = []

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/events")
        quality.quality_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def want(as_of):
        chunks = [(c, at, sum(k == "hit" for x, _, k, _ in first if x == c)) for c, _, kind, at in first if kind == "created" and c != 5]
        count = lambda c, kind: sum(k == kind for x, _, k, _ in first if x == c)
        rows = [(c, n, at, count(c, "like"), count(c, "dislike"), count(c, "correction")) for c, at, n in chunks]
        df = spark.createDataFrame(rows, "chunk_id long, hit_count long, created_at timestamp, like_count long, dislike_count long, correction_count long")
        counts = df.select("chunk_id", "like_count", "dislike_count", "correction_count")
        return {r.chunk_id: r.quality_score for r in stats.recalculate_quality(df.select("chunk_id", "hit_count", "created_at"), counts, as_of.isoformat(" ")).collect()}

    run(first)
    assert {r[0] for r in sum(out, [])} == {1, 2, 3, 4, 5}
    out.clear()
    run(again)
    assert not [r for r in sum(out, []) if r[0] != 99]  # repeated events, and the end of a chunk, give no row
    for rows in beats:
        out.clear()
        run(rows)
        at = rows[0][3]
        got = {r[0]: r[2] for r in sum(out, []) if r[0] != 99 and r[1] == at}
        assert got == want(at), at
