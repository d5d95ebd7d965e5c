"""Streams over a bounded folder give the rows of their batch twins."""

import pytest
from pyspark.sql import functions as F

from plenum.operators import decisions
from plenum.streaming import rules


@pytest.fixture
def stream(spark, tmp_path):
    # A rule with a time to live always asks for one more batch, so a bounded run must not start batches without data.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def run(rows, schema, make, parts=2):
        d = spark.createDataFrame(rows, schema)
        for k in range(parts):
            n = len(rows)
            spark.createDataFrame(rows[k * n // parts : (k + 1) * n // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
        q = make(s).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        if not q.awaitTermination(60):
            q.stop()
            raise TimeoutError
        return sorted(tuple(r) for r in spark.table("out").collect())

    return run


ROWS = [(k, i, f"2024-01-01 00:{m:02d}:00", i % 5 == 0) for i, (k, m) in enumerate([(1, 0), (2, 1), (1, 10), (1, 31), (2, 32), (1, 33), (2, 50), (1, 59)])]


def timed(d):
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def test_cooldown(spark, stream):
    schema = "k int, id int, ts string, r boolean"
    want = decisions.cooled_down(timed(spark.createDataFrame(ROWS, schema)), ["k"], "ts", "id", 1800).select("k", "id", "accepted")
    assert stream(ROWS, schema, lambda s: rules.cooled_down(timed(s), "k", "ts", "id", 1800)) == sorted(map(tuple, want.collect()))


def test_alerts(spark, stream):
    schema = "k int, id int, ts string, r boolean"
    want = decisions.alerts(timed(spark.createDataFrame(ROWS, schema)), ["k"], "r", "ts", "id").select("k", "id", "shown")
    assert stream(ROWS, schema, lambda s: rules.alerts(timed(s), "k", "r", "ts", "id")) == sorted(map(tuple, want.collect()))


def test_unknown_and_gaps(stream):
    rows = [(1, i, i < 4, 500) for i in range(8)] + [(1, 8 + i, True, 500) for i in range(2)] + [(1, 10, False, 500)]
    assert stream(rows, "k int, seq int, s boolean, ms int", lambda d: rules.silence_gaps(d, "k", "s", "seq", "ms")) == [(1, 1000, False), (1, 2000, True)]


def test_utterances(stream):
    rows = [(1, i, i not in (0, 6, 7), 500) for i in range(12)]
    assert stream(rows, "k int, seq int, v boolean, ms int", lambda d: rules.utterances(d, "k", "v", "seq", "ms")) == [(1, 500, 3500)]


def test_soft_cut(stream):
    # A pause of 200 ms at 26 s, in the last three seconds before 28 s: the cut is there; the rest ends by its own silence.
    rows = [(1, i, i not in (260, 261) and i < 330, 100) for i in range(340)]
    assert stream(rows, "k int, seq int, v boolean, ms int", lambda d: rules.utterances(d, "k", "v", "seq", "ms")) == [(1, 0, 26000), (1, 26000, 33500)]


def test_hard_cut(stream):
    rows = [(1, i, i not in (100, 101), 100) for i in range(300)]
    assert stream(rows, "k int, seq int, v boolean, ms int", lambda d: rules.utterances(d, "k", "v", "seq", "ms")) == [(1, 0, 28000)]


def test_once(spark, stream):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:06"), (2, "2024-01-01 00:00:07")]
    assert [r[0] for r in stream(rows, "k int, ts string", lambda d: rules.once(timed(d), ["k"], "ts").select("k"))] == [1, 2]


def test_unknown_speakers(stream):
    rows = [(1, i, u) for i, u in enumerate([False, True, False, True, True, True])] + [(2, 0, True), (2, 1, True)]
    assert stream(rows, "k int, seq int, u boolean", lambda d: rules.unknown_speakers(d, "k", "u", "seq", "seq")) == [(1, 5)]


def test_quality_warnings(stream):
    rows = [(1, 0, True, 0.0, 30.0, 0.5), (1, 1, False, 0.5, 30.0, 0.5), (1, 2, False, 0.5, 5.0, 0.5), (1, 3, True, 0.0, 5.0, 0.001), (1, 4, True, 0.0, None, 0.5), (1, 5, False, 0.0, 5.0, 0.5), (1, 6, True, 0.5, 30.0, 0.5)]
    got = stream(rows, "k int, seq int, sp boolean, clip double, snr double, vol double", lambda d: rules.quality_warnings(d, "k", "seq", "sp", "clip", "snr", "vol"))
    assert got == [(1, 1, "no_speech"), (1, 2, "clipping"), (1, 3, "low_snr"), (1, 5, "low_snr"), (1, 6, "clipping")]


def test_open_set(spark, stream):
    from plenum.operators import speakers

    rows = [(1, i, v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [-1.0, 0.0], [0.8, 0.2]])]
    schema = "k int, seq int, v array<double>"
    want = sorted(map(tuple, speakers.open_set(spark.createDataFrame(rows, schema), "k", "seq", cap=2).collect()))
    assert stream(rows, schema, lambda d: rules.open_set(d, "k", "seq", cap=2)) == want


def test_sessions(spark, stream):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:20"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 01:00:00")]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    got = stream(rows, "k int, ts string", lambda d: rules.sessions(timed(d), "k", "ts").select("k", "n"), parts=4)
    assert got[:2] == [(1, 1), (1, 2)] or got == [(1, 1), (1, 2)]


def test_sinks(spark, tmp_path):
    from plenum.sources import readers

    rows = [(1, 1, 900, "b"), (1, 0, 100, "a"), (2, 0, 0, "c")]
    spark.createDataFrame(rows, "meeting_id long, segment_index long, start_ms long, text string").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("meeting_id long, segment_index long, start_ms long, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        q = rules.append(live, str(tmp_path / "out"), str(tmp_path / "c1"), ["meeting_id"])
        assert q.awaitTermination(60)
    assert [r.text for r in readers.transcript(spark, str(tmp_path / "out"), 1).collect()] == ["a", "b"]
    seen = []
    q = rules.every(live, 1, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 3)]


def test_words(stream):
    rows = [(1, 0, "we will meet"), (1, 1, "we will meat today"), (1, 2, "we will meat today at noon")]
    assert stream(rows, "k int, seq int, t string", lambda d: rules.agreed_words(d, "k", "seq", "t")) == [(1, 0, ""), (1, 1, "we will"), (1, 2, "we will meat today")]


def test_transitions(stream):
    moves = [("new", "open"), ("open", "done"), ("new", "open"), ("done", "new"), ("open", "gone"), ("open", None)]
    rows = [(k, i, *moves[(i * 7 + k) % len(moves)]) for i in range(1, 16) for k in (1, 2)]
    # What comes again, or later than what has been answered, moves nothing.
    rows += [(1, 15, "open", "done"), (1, 3, "new", "open"), (2, 16, "new", "open")]
    allowed = {"new": {"open"}, "open": {"done"}, "done": {"new"}}

    def loop(part):
        state = {}
        for batch in part:
            for key, seq, was, to in sorted(batch, key=lambda r: (r[0], r[1])):
                status, version, last = state.get(key, ("new", 0, -1))
                if seq <= last:
                    yield key, seq, "late", status, version
                    continue
                ok = was == status and to in allowed.get(status, ())
                status, version = (to, version + 1) if ok else (status, version)
                state[key] = (status, version, seq)
                yield key, seq, "ok" if ok else "conflict", status, version

    half = len(rows) // 2
    want = sorted(loop([rows[:half], rows[half:]]))
    got = stream(rows, "k int, seq int, was string, new string", lambda s: rules.transitions(s, "k", "seq", "was", "new", "new", allowed))
    assert got == want and {"ok", "conflict", "late"} == {r[2] for r in got}


def test_finish_grace_and_late_rows(spark, stream):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    # The last batch holds a row that is later than the watermark, which holds from the batch after the next on, and one that closes all before it.
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:10:00"), (2, "2024-01-01 00:10:20"), (4, "2024-01-01 00:10:30"), (4, "2024-01-01 00:10:30"), (1, "2024-01-01 00:00:50"), (3, "2024-01-01 01:00:00")]
    got = stream(rows, "k int, ts string", lambda s: rules.sessions(timed(s), "k", "ts", "25 seconds", "1 minute"), parts=4)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    assert [(k, n, (e - s).total_seconds()) for k, s, e, n in got] == [(1, 2, 45), (2, 2, 45), (4, 2, 25)]


def test_unassigned_pool(spark, stream):
    import random

    from plenum.operators.speakers import unassigned

    rng = random.Random(1)
    rows = [(k, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60) for k in (1, 2)] + [(1, 60, [0.0, 0.0, 0.0])]
    schema = "k int, seq int, v array<double>"
    for cap in (4, 256):
        # The plain rule: a list of profiles, and the one that was heard least recently goes.
        want = []
        for key in (1, 2):
            held, number = [], 0
            for k, seq, v in rows:
                if k != key:
                    continue
                norm = sum(x * x for x in v) ** 0.5
                if not norm:
                    want.append((k, seq, None))
                    continue
                cos = [sum(a * b for a, b in zip(p["v"], v)) / (sum(a * a for a in p["v"]) ** 0.5 * norm) for p in held]
                best = max(range(len(held)), key=lambda i: cos[i]) if held else -1
                if held and cos[best] >= 0.75:
                    p = held[best]
                    p["v"] = [0.9 * a + 0.1 * b for a, b in zip(p["v"], v)]
                else:
                    number += 1
                    if len(held) == cap:
                        held.remove(min(held, key=lambda p: p["at"]))
                    p = {"v": v, "n": number}
                    held.append(p)
                p["at"] = seq
                want.append((k, seq, f"SPEAKER_미상{p['n']}"))
        batch = unassigned(spark.createDataFrame(rows, schema), "k", "seq", cap=cap)
        assert sorted(map(tuple, batch.collect())) == sorted(want)
    got = stream(rows, schema, lambda s: rules.unassigned(s, "k", "seq"))
    assert got == sorted(want)


def test_reminders_are_sent_once(spark, tmp_path):
    meetings = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00") for i in range(50)], "m int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, minute in enumerate((0, 10, 20)):
        one = spark.createDataFrame([(f"2024-01-01 00:{minute:02d}:00",)], "ts string").select(F.col("ts").cast("timestamp").alias("now"))
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "clock"))
    sent = f"file://{tmp_path}/sent"

    def due(now):
        return meetings.where((F.col("ts") > F.lit(now)) & (F.col("ts") <= F.lit(now) + F.expr("interval 15 minutes"))).select("m")

    def poll(state):
        clock = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "clock"))
        rules.reminders(clock, "now", due, sent, ["m"], str(tmp_path / state)).awaitTermination()
        return sorted(r.m for r in spark.read.parquet(sent).collect())

    assert poll("state") == list(range(1, 36))
    # A new query with no memory of its batches polls all again: each batch replaces its own folder.
    assert poll("other-state") == list(range(1, 36))


def test_reminders_join_their_tables_once(spark, monkeypatch):
    from plenum.catalog import QUERIES
    import datetime

    from plenum.plans import live
    from tests.conftest import SMALL

    plans = []
    plain = live.rules.reminders

    def polls(clock, at, due, *rest):
        plans.append(due(datetime.datetime(1995, 1, 1))._jdf.queryExecution().optimizedPlan().toString())
        return plain(clock, at, due, *rest)

    monkeypatch.setattr(live.rules, "reminders", polls)
    assert QUERIES["x8_reminders"](spark, SMALL).count() > 0
    assert "Join" not in plans[0]
