"""Streaming rules over live segments and judgements. Each has a batch twin in ``plenum.operators``.

State is one small value for a key. The rules that the batch side keeps for ever would grow without bound in a
stream, so each takes a time to live after which an idle key's state goes; that is an addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plenum.operators.speakers import UNASSIGNED, OpenSet


def once(events: DataFrame, keys: list[str], at: str, wait: str = "1 hour") -> DataFrame:
    """The first event of each key; late repeats after ``wait`` count anew."""
    return events.withWatermark(at, wait).dropDuplicatesWithinWatermark(keys)


def by_key(events: DataFrame, keys: list[str], order: list[str], start: tuple, step, state: str, out: str, idle_ms: int = 86_400_000) -> DataFrame:
    """Runs ``step(state, row) -> (state, output row or None)`` over each key's events in order.

    A micro-batch's events of one key are sorted; they must not come later than the batch after their successors. With trigger(availableNow=True) set
    spark.sql.streaming.noDataMicroBatches.enabled to false: the time to live would ask for batches for ever.
    """

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = tuple(held.get) if held.exists else start
        rows = pd.concat(list(batches))
        made = []
        for row in rows.sort_values(order).itertuples(index=False):
            now, result = step(now, row)
            if result is not None:
                made.append((*key, *result))
        held.update(now)
        held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(made, columns=[c.strip().split()[0] for c in out.split(",")])

    return events.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def cooled_down(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """key, tie, accepted: accepted if ``seconds`` have passed since the key's last accepted event."""
    kind = dict(events.dtypes)

    def step(state, row):
        t = int(pd.Timestamp(getattr(row, at)).value // 1000)
        ok = state[0] is None or t >= state[0] + seconds * 1_000_000
        return ((t if ok else state[0]),), (getattr(row, tie), ok)

    return by_key(events.select(key, at, tie), [key], [at, tie], (None,), step, "last long", f"{key} {kind[key]}, {tie} {kind[tie]}, accepted boolean")


def alerts(events: DataFrame, key: str, reasoned: str, at: str, tie: str) -> DataFrame:
    """key, tie, shown: after a reasoned alert nothing is shown; an unreasoned one once, and only before a reasoned one."""
    kind = dict(events.dtypes)

    def step(state, row):
        any_before, reason_before = state
        r = bool(getattr(row, reasoned))
        shown = not reason_before and (r or not any_before)
        return (True, reason_before or r), (getattr(row, tie), shown)

    return by_key(events.select(key, at, tie, reasoned), [key], [at, tie], (False, False), step, "seen boolean, reasoned boolean", f"{key} {kind[key]}, {tie} {kind[tie]}, shown boolean")


def unknown_speakers(events: DataFrame, key: str, unknown: str, at: str, tie: str, ratio: float = 0.6, least: int = 3) -> DataFrame:
    """key, at_count: once, when ``ratio`` of ``least`` or more chunks have no known speaker."""
    kind = dict(events.dtypes)

    def step(state, row):
        n, u, told = state[0] + 1, state[1] + int(bool(getattr(row, unknown))), state[2]
        hit = not told and n >= least and u >= ratio * n
        return (n, u, told or hit), ((n,) if hit else None)

    return by_key(events.select(*dict.fromkeys([key, at, tie, unknown])), [key], [*dict.fromkeys([at, tie])], (0, 0, False), step, "n long, unknown long, told boolean", f"{key} {kind[key]}, at_count long")


def silence_gaps(frames: DataFrame, key: str, silent: str, seq: str, ms: str, warn: int = 2000, record: int = 500) -> DataFrame:
    """key, length, warned: runs of silent frames, told when they end; ``warned`` for the first long one only."""
    kind = dict(frames.dtypes)

    def step(state, row):
        run, warned = state
        if bool(getattr(row, silent)):
            return (run + int(getattr(row, ms)), warned), None
        hit = run >= warn and not warned
        return (0, warned or hit), ((run, hit) if run >= record else None)

    return by_key(frames.select(key, seq, silent, ms), [key], [seq], (0, False), step, "run long, warned boolean", f"{key} {kind[key]}, length long, warned boolean")


def utterances(frames: DataFrame, key: str, voiced: str, seq: str, ms: str, least: int = 2000, most: int = 28000, quiet: int = 500, look_back: int = 3000, pause: int = 100) -> DataFrame:
    """key, start_ms, end_ms: an utterance ends after ``quiet`` of silence once it has ``least``, or at ``most``.

    At ``most`` it ends where the last pause of ``pause`` or longer began, if that lies in the last ``look_back``; what follows opens the next one.
    """
    kind = dict(frames.dtypes)

    def step(state, row):
        now, start, silence, gap = state
        d, v = int(getattr(row, ms)), bool(getattr(row, voiced))
        now += d
        if start < 0:
            return (now, now - d if v else -1, 0, -1), None
        if v and silence >= pause:
            gap = now - d - silence
        silence = 0 if v else silence + d
        if now - start >= most:
            soft = gap > max(start, now - look_back)
            return (now, gap if soft else -1, silence if soft else 0, -1), (start, gap if soft else now)
        if silence >= quiet and now - start >= least:
            return (now, -1, 0, -1), (start, now)
        return (now, start, silence, gap), None

    return by_key(frames.select(key, seq, voiced, ms), [key], [seq], (0, -1, 0, -1), step, "now long, start long, silence long, gap long", f"{key} {kind[key]}, start_ms long, end_ms long")


def quality_warnings(chunks: DataFrame, key: str, seq: str, speech: str, clip: str, snr: str, volume: str) -> DataFrame:
    """key, seq, warning: the most urgent of no_speech, clipping, low_snr and low_volume, each once; a good chunk re-arms all but the first."""
    kind = dict(chunks.dtypes)
    names = ("no_speech", "clipping", "low_snr", "low_volume")

    def step(state, row):
        told = set(filter(None, state[0].split(",")))
        now = [not getattr(row, speech), getattr(row, clip) > 0.01, pd.notna(getattr(row, snr)) and getattr(row, snr) < 10, getattr(row, volume) < 0.01]
        if not any(now):
            return (",".join(told & {"no_speech"}),), None
        new = next((n for n, hit in zip(names, now) if hit and n not in told), None)
        return (",".join(sorted(told | ({new} if new else set()))),), ((getattr(row, seq), new) if new else None)

    return by_key(chunks.select(key, seq, speech, clip, snr, volume), [key], [seq], ("",), step, "told string", f"{key} {kind[key]}, {seq} {kind[seq]}, warning string")


def open_set(voices: DataFrame, key: str, seq: str, cap: int = 8) -> DataFrame:
    """key, seq, name: moving profiles of each session, up to ``cap``; the batch twin is ``operators.speakers.open_set``."""
    import numpy as np

    kind = dict(voices.dtypes)

    def step(state, row):
        flat, n = state
        held = [np.array(x) for x in np.array(flat).reshape(n, -1)] if n else []
        s = OpenSet(held, cap=cap)
        name = s.name(row.v)
        return ([float(y) for p in s.profiles for y in p], len(s.profiles)), (getattr(row, seq), name)

    return by_key(voices.select(key, seq, "v"), [key], [seq], ([], 0), step, "profiles array<double>, n int", f"{key} {kind[key]}, {seq} {kind[seq]}, name string")


def unassigned(voices: DataFrame, key: str, seq: str, cap: int = 256) -> DataFrame:
    """key, seq, name: the pool of voices without a profile, up to ``cap`` of them a session; the batch twin is ``operators.speakers.unassigned``."""
    import numpy as np

    kind = dict(voices.dtypes)

    def step(state, row):
        flat, numbers, heard, after, time = state
        s = OpenSet(cap=cap, **UNASSIGNED)
        if len(numbers):
            s.matrix = np.array(flat, float).reshape(len(numbers), -1)
        s.numbers, s.heard, s.next, s.time = list(numbers), list(heard), after, time
        name = s.name(row.v)
        return (s.matrix.ravel().tolist(), s.numbers, s.heard, s.next, s.time), (getattr(row, seq), name)

    state = "profiles array<double>, numbers array<long>, heard array<long>, next long, time long"
    return by_key(voices.select(key, seq, "v"), [key], [seq], ([], [], [], 1, 0), step, state, f"{key} {kind[key]}, {seq} {kind[seq]}, name string")


def transitions(requests: DataFrame, key: str, seq: str, expected: str, to: str, start: str, allowed: dict[str, set[str]] | None = None) -> DataFrame:
    """key, seq, verdict, status, version: a request moves its key from the ``expected`` status to another, if the key is there.

    ``verdict``: ok, conflict (another status, or a move that ``allowed`` doesn't hold), late (a request with this or a later ``seq`` has been
    answered before, so one that is sent twice moves nothing). ``status`` and ``version`` are those after the request. A key begins at ``start``, version 0.
    """
    kind = dict(requests.dtypes)

    def step(state, row):
        status, version, last = state
        at, was, new = int(getattr(row, seq)), getattr(row, expected), getattr(row, to)
        if last is not None and at <= last:
            return state, (at, "late", status, version)
        ok = was == status and new is not None and (allowed is None or new in allowed.get(status, ()))
        status, version = (new, version + 1) if ok else (status, version)
        return (status, version, at), (at, "ok" if ok else "conflict", status, version)

    d = requests.select(key, F.col(seq).cast("long").alias(seq), expected, to)
    return by_key(d, [key], [seq], (start, 0, None), step, "status string, version long, last long", f"{key} {kind[key]}, {seq} long, verdict string, status string, version long")


def sessions(events: DataFrame, key: str, at: str, grace: str = "25 seconds", late: str = "1 minute") -> DataFrame:
    """key, start, end, n: a session ends when nothing came for ``grace``."""
    d = events.withWatermark(at, late).groupBy(F.session_window(at, grace).alias("w"), key).agg(F.count("*").alias("n"))
    return d.select(key, "w.start", "w.end", "n")


def agreed_words(drafts: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """key, seq, agreed: the leading words that a draft shares with the one before it."""
    kind = dict(drafts.dtypes)

    def step(state, row):
        words = (getattr(row, text) or "").split()
        old = (state[0] or "").split()
        n = next((i for i, (a, b) in enumerate(zip(old, words)) if a != b), min(len(old), len(words)))
        return (" ".join(words),), (getattr(row, seq), " ".join(words[:n]))

    return by_key(drafts.select(key, seq, text), [key], [seq], ("",), step, "words string", f"{key} {kind[key]}, {seq} {kind[seq]}, agreed string")


def append(rows: DataFrame, path: str, checkpoint: str, partition: list[str] | None = None, seconds: int | None = None):
    """Appends a stream to Parquet files, exactly once; with ``seconds`` a batch so often, else all there is and then an end. Returns the running query."""
    w = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    w = w.partitionBy(*partition) if partition else w
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def every(rows: DataFrame, seconds: int, handle, checkpoint: str):
    """Calls ``handle(batch, number)`` every ``seconds``; a batch may come again after a failure, with its number. Returns the running query."""
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def reminders(clock: DataFrame, at: str, due, sent: str, keys: list[str], checkpoint: str, seconds: int | None = None):
    """Polls with every batch of ``clock`` and writes what is due and hasn't been sent to ``sent``, a folder for each batch. Returns the running query.

    ``due(now)`` gives the rows that are due at the latest ``at`` of the batch. What other batches have sent is left out, and a batch's own
    folder is replaced, so one that comes again after a failure sends what it sent before, and nothing twice. With ``seconds`` there is a poll so often, else one for each batch there is, and then an end.
    """

    def poll(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(at)).first()[0]
        if now is None:
            return
        spark = batch.sparkSession
        rows = due(now).dropDuplicates(keys)
        folder = spark._jvm.org.apache.hadoop.fs.Path(sent)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        before = [s.getPath().toString() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        others = [p for p in before if not p.endswith(f"/batch={number}")]
        if others:
            rows = rows.join(spark.read.schema(rows.schema).parquet(*others).select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{sent}/batch={number}")

    w = clock.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()
