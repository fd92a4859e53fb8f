"""Stateful streams over hashed files: first duplicates, finished folders."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.functions import paths

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that transformWithState needs, as long as a stream is started and run."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


#: Shares of the hashes that are one key of the state each; a checkpoint is bound to their number.
SHARES = 1 << 12


class SecondCopy(StatefulProcessor):
    """Emits once per hash, when its second file comes; key: a share of the hashes; state: the ids seen of each, two at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "session_id long, pixel_hash string, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        come: dict[tuple, list[int]] = {}
        for part in rows:
            for session, pixel_hash, i in zip(part["session_id"].tolist(), part["pixel_hash"].tolist(), part["id"].tolist(), strict=True):
                least = come.setdefault((session, pixel_hash), [])
                if len(least) < 2 or i < least[1]:
                    least.append(i)
                    least.sort()
                    del least[2:]
        known: dict[tuple, list[int]] = {}
        for session, pixel_hash, i in self.seen.get():
            if (session, pixel_hash) in come:
                known.setdefault((session, pixel_hash), []).append(i)
        new, pairs = [], []
        for at, ids in come.items():
            before = known.get(at, [])
            more = ids[: 2 - len(before)]
            new += [(*at, i) for i in more]
            if more and len(before) + len(more) == 2:
                pairs.append((*at, *before, *more))
        if new:
            self.seen.appendList(new)
        if pairs:
            yield pd.DataFrame(pairs, columns=["session_id", "pixel_hash", "first_id", "second_id"])

    def close(self) -> None:
        pass


def first_duplicates(hashed: DataFrame, shares: int = SHARES) -> DataFrame:
    """From a stream of files (session_id, id, pixel_hash): one row per session and hash at its second file.

    Within a micro-batch the lesser id is first. Files without a hash do not
    count. State is two ids per hash, however many copies come. A key of the
    state is a share of the hashes: with a key per hash, the calls to the store
    and a table for each took nearly all the time. A micro-batch reads the
    shares that its hashes are in. The stream is started and run inside rocks().
    """
    rows = hashed.filter("pixel_hash IS NOT NULL").select(F.pmod(F.xxhash64("session_id", "pixel_hash"), F.lit(shares)).alias("share"), "session_id", "pixel_hash", "id")
    return rows.groupBy("share").transformWithStateInPandas(
        SecondCopy(), "session_id long, pixel_hash string, first_id long, second_id long", "append", "None"
    )


class Finished(StatefulProcessor):
    """Emits a folder when the last of its pending files is done; state: how many are still to come, at first those expected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "left long")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.left.update((int(initial["pending"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        done = sum(int(part["done"].sum()) for part in rows)
        if not self.left.exists():
            return  # a folder of which nothing is expected
        left = self.left.get()[0]
        if left > 0 and done:
            self.left.update((max(0, left - done),))
            if left <= done:
                yield pd.DataFrame({"folder": [key[0]]})

    def close(self) -> None:
        pass


def finished_folders(hashed: DataFrame, expected: DataFrame) -> DataFrame:
    """From a stream of files (path, pixel_hash) and each folder's number of pending files (folder, pending): a row per folder (folder) when its last file is done, once.

    A file that failed (null hash) is never done, so its folder never ends.
    State is one number per folder. The stream is started and run inside
    rocks().
    """
    done = hashed.select(paths.parent(F.col("path")).alias("folder"), F.when(F.col("pixel_hash").isNotNull(), 1).otherwise(0).alias("done"))
    return done.groupBy("folder").transformWithStateInPandas(Finished(), "folder string", "append", "None", initialState=expected.select("folder", "pending").groupBy("folder"))


def folder_progress(hashed: DataFrame, expected: DataFrame) -> DataFrame:
    """From the stream and each folder's number of files (folder, pending): folder, done, pending, complete; output mode "complete" or "update".

    A file that failed (null hash) is never done, so its folder never completes.
    """
    done = hashed.filter("pixel_hash IS NOT NULL").select(paths.parent(F.col("path")).alias("folder")).join(expected, "folder")
    return done.groupBy("folder", "pending").agg(F.count("*").alias("done")).select("folder", "done", "pending", (F.col("done") >= F.col("pending")).alias("complete"))
