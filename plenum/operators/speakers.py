"""Speaker identity: closed-set match, and the open set's moving profiles as ordered state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .search import _matrix, passes, unit_products


def closed_set(rows: DataFrame, profiles: DataFrame, key: str, least: float = 0.35, margin: float = 0.05, alone: float = 0.4) -> DataFrame:
    """``rows`` (key, v) with the best of ``profiles`` (name, q), or null: its score must reach ``least`` and lead by ``margin``; a single profile must reach ``alone``.

    ``profiles`` are those of a meeting's people; more of them than ``search.QUERY_BYTES`` are met in several passes. Rows that
    meet no profile, as their vector is null or zero or has another dimension, give no row.
    """
    kind, names = dict(rows.dtypes)[key], dict(profiles.dtypes)["name"]
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], f"name {names}").schema).field("name").type
    found = None
    for part in passes(profiles, "name", "q"):
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, (names, q) in shared.value.items():
                    at, m = _matrix(b.column(1), d)
                    score = np.nan_to_num(unit_products(m, q), nan=-np.inf)
                    # By score, then by name, the best two.
                    rank = np.argsort([str(n) for n in names], kind="stable") if isinstance(names[0], str) else np.argsort(names, kind="stable")
                    order = rank[np.argsort(-score[:, rank], axis=1, kind="stable")][:, :2]
                    best = np.take_along_axis(score, order, 1)
                    ok = best[:, 0] > -np.inf
                    second = [None if len(x) < 2 or x[1] == -np.inf else float(x[1]) for x in best[ok]]
                    yield pa.record_batch(
                        [b.column(0).take(pa.array(at[ok])), pa.array([names[i] for i in order[ok, 0]], arrow), pa.array(best[ok, 0]), pa.array(second, pa.float64())], [key, "name", "score", "next"]
                    )

        one = rows.select(key, "v").mapInArrow(run, f"{key} {kind}, name {names}, score double, next double")
        found = one if found is None else found.unionByName(one)
    # Over several passes the best two of all, by key.
    ends = F.array_sort(F.flatten(F.collect_list(F.array(F.struct((-F.col("score")).alias("s"), "name"), F.when(F.col("next").isNotNull(), F.struct((-F.col("next")).alias("s"), F.lit(None).cast(names).alias("name")))))))
    s = found.groupBy(key).agg(F.filter(ends, lambda x: x.isNotNull()).alias("e"))
    s = s.select(key, F.col("e")[0]["name"].alias("name"), (-F.col("e")[0]["s"]).alias("score"), (-F.get("e", F.lit(1))["s"]).alias("next"))
    sure = F.when(F.col("next").isNull(), F.col("score") >= alone).otherwise((F.col("score") >= least) & (F.col("score") - F.col("next") >= margin))
    return s.select(key, F.when(sure, F.col("name")).alias("name"), "score")


class OpenSet:
    """Moving profiles of one session: a voice joins the nearest profile at ``least`` or more, which then moves towards it; else it opens a new one.

    Profiles are the rows of a matrix, so a voice meets all of them in one product. With ``cap`` profiles no more are opened: the voice gets the nearest one's name, which doesn't
    move; or, if ``forget``, the profile that was heard least recently goes, and its number isn't given again.
    """

    def __init__(self, profiles: list[np.ndarray] | None = None, least: float = 0.5, keep: float = 0.9, cap: int | None = 8, prefix: str = "S", forget: bool = False):
        self.least, self.keep, self.cap, self.prefix, self.forget = least, keep, cap, prefix, forget
        self.matrix = np.array(profiles, float) if profiles else np.zeros((0, 0))
        self.numbers, self.heard = list(range(1, len(self.matrix) + 1)), list(range(len(self.matrix)))
        self.next, self.time = len(self.matrix) + 1, len(self.matrix)

    @property
    def profiles(self) -> list[np.ndarray]:
        return list(self.matrix)

    def name(self, v: np.ndarray) -> str | None:
        v = np.asarray(v, float)
        norm = np.linalg.norm(v)
        if not norm:
            return None
        n = len(self.matrix)
        scores = self.matrix @ v / (np.linalg.norm(self.matrix, axis=1) * norm) if n else np.zeros(0)
        best = int(scores.argmax()) if n else -1
        self.time += 1
        if n and scores[best] >= self.least:
            self.matrix[best] = self.keep * self.matrix[best] + (1 - self.keep) * v
        elif self.cap is None or n < self.cap:
            self.matrix = np.vstack([self.matrix, v]) if n else v[None, :].copy()
            best = n
            self.numbers.append(self.next)
            self.heard.append(0)
            self.next += 1
        elif self.forget:
            best = int(np.argmin(self.heard))
            self.matrix[best], self.numbers[best], self.next = v, self.next, self.next + 1
        self.heard[best] = self.time
        return f"{self.prefix}{self.numbers[best]}"


def open_set(rows: DataFrame, session: str, order: str, **how) -> DataFrame:
    """session, order, name of ``rows`` (session, order, v): each session's voices in order, one task a session."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        state = OpenSet(**how)
        return pd.DataFrame({session: rows[session], order: rows[order], "name": [state.name(v) for v in rows["v"]]})

    kind = dict(rows.dtypes)
    return rows.select(session, order, "v").groupBy(session).applyInPandas(run, f"{session} {kind[session]}, {order} {kind[order]}, name string")


#: What names a voice that no profile matched.
UNASSIGNED = {"least": 0.75, "prefix": "SPEAKER_미상", "forget": True}


def unassigned(rows: DataFrame, session: str, order: str, cap: int | None = None) -> DataFrame:
    """Names for the voices that no profile matched: a pool of its own, with a higher bar, as one person under two names does less harm than two under one.

    ``cap``: profiles that are held at a time; beyond it the one heard least recently is forgotten. Without it all are kept.
    """
    return open_set(rows, session, order, cap=cap, **UNASSIGNED)


def agglomerate(rows: DataFrame, group: str, item: str, floor: float = 0.55, most: int = 8) -> DataFrame:
    """group, item, cluster: the two most similar clusters join while their similarity reaches ``floor`` or there are more than ``most``. A group is one meeting's few profiles."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item)
        v = [np.asarray(x, float) / (np.linalg.norm(x) or 1) for x in rows["v"]]
        members, sums = [[i] for i in range(len(v))], [x.copy() for x in v]
        while len(members) > 1:
            m = np.stack(sums)
            m = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
            s = np.triu(m @ m.T, 1) - 2 * np.tri(len(m))
            i, j = np.unravel_index(int(s.argmax()), s.shape)
            if s[i, j] < floor and len(members) <= most:
                break
            members[i] += members.pop(j)
            sums[i] = sums[i] + sums.pop(j)
        of = {k: min(m) for m in members for k in m}
        return pd.DataFrame({group: rows[group], item: rows[item], "cluster": [of[k] for k in range(len(rows))]})

    kind = dict(rows.dtypes)
    return rows.select(group, item, "v").groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {item} {kind[item]}, cluster int")
