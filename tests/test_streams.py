"""Streams of chunks: disorder over several batches, gaps, and restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import media
from tarnweave.streaming import jitter, log


@pytest.fixture(autouse=True)
def provider(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": jitter.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def chunks(seed, n, utterances=("u", "v")):
    rng = random.Random(seed)
    out = []
    for u in utterances:
        at = 0.0
        for k in range(n):
            at += rng.choice([0.0, 0.05, 0.4])
            out.append((u, k, bytes(rng.randrange(256) for _ in range(rng.randrange(5))), at, rng.choice([0.1, 0.2]), k == n - 1))
    return out


def run(spark, path, rows, batches, **how):
    """Each list of rows is a file, and a batch of the stream."""
    for part in batches:
        log.append(spark.createDataFrame([rows[k] for k in part], jitter.CHUNK).coalesce(1), f"{path}/in")
    stream = jitter.played(log.source(spark, f"{path}/in", files=1), **how)
    log.sink(stream, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log.committed(spark, f"{path}/out", jitter.GIVEN)


def test_a_shuffled_stream_gives_the_batch_schedule(spark, tmp_path):
    rows = chunks(1, 8)
    order = list(range(len(rows)))
    random.Random(2).shuffle(order)
    order += order[:3]  # some come twice
    got = run(spark, f"file://{tmp_path}", rows, [order[k::3] for k in range(3)], wait_ms=600_000)
    df = spark.createDataFrame(rows, jitter.CHUNK)
    want = {(r.utt_id, r.seq): r.begins for r in media.schedule(df, "utt_id", "seq", "at", "seconds").collect()}
    given = got.filter("NOT late").orderBy("utt_id", "seq").collect()
    assert {(r.utt_id, r.seq): r.begins for r in given} == want and len(given) == len(rows)
    for u in ("u", "v"):
        whole = b"".join(r[2] for r in rows if r[0] == u)
        assert b"".join(bytes(r.pcm) for r in given if r.utt_id == u) == whole[: len(whole) // 2 * 2]
        assert all(len(r.pcm) % 2 == 0 for r in given)
    assert all((b.epoch, b.seq) >= (a.epoch, a.seq) for a, b in zip(given, given[1:], strict=False) if a.utt_id == b.utt_id)
    assert [(r.utt_id, r.n, r.complete) for r in log.ended(df).orderBy("utt_id").collect()] == [("u", 8, True), ("v", 8, True)]
    assert [r.complete for r in log.ended(df.filter("seq <> 3")).collect()] == [False, False]


def test_a_gap_is_left_behind_and_what_comes_later_is_late(spark, tmp_path):
    rows = [("u", k, bytes([k, k]), 0.1 * k, 0.1, False) for k in range(6)] + [(None, 0, b"", 0.0, 0.1, False), ("u", None, b"", 0.0, 0.1, False)]
    path = f"file://{tmp_path}"
    for k, part in enumerate([[0, 3, 6, 7], [4], [1, 2, 5]]):
        log.append(spark.createDataFrame([rows[j] for j in part], jitter.CHUNK).coalesce(1), f"{path}/in")
        stream = jitter.played(log.source(spark, f"{path}/in", files=1), wait_ms=1)
        log.sink(stream, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        time.sleep(0.1)
    got = {r.seq: (r.late, r.begins) for r in log.committed(spark, f"{path}/out", jitter.GIVEN).collect()}
    assert {k: late for k, (late, _) in got.items()} == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False}
    assert got[1] == (True, None) and got[0][1] == 0.05


def test_a_stopped_query_goes_on_without_loss_or_doubles(spark, tmp_path):
    rows, path = chunks(3, 12), f"file://{tmp_path}"
    order = list(range(len(rows)))
    random.Random(5).shuffle(order)
    for k in range(4):
        log.append(spark.createDataFrame([rows[j] for j in order[k::4]], jitter.CHUNK).coalesce(1), f"{path}/in")
    calls = []

    def start(fails):
        def write(batch, epoch):
            calls.append(epoch)
            batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
            if fails and len(calls) == 3:
                raise RuntimeError("stopped behind a write")

        stream = jitter.played(log.source(spark, f"{path}/in", files=1), wait_ms=600_000)
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stopped behind a write"):
        start(True).awaitTermination()
    stream = jitter.played(log.source(spark, f"{path}/in", files=1), wait_ms=600_000)
    log.sink(stream, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = log.committed(spark, f"{path}/out", jitter.GIVEN).filter("NOT late").groupBy("utt_id", "seq").agg(F.count("*").alias("n")).collect()
    assert sorted((r.utt_id, r.seq, r.n) for r in got) == sorted((u, k, 1) for u, k, *_ in rows)
