"""Incremental tails and change feeds with Structured Streaming."""

from __future__ import annotations

import codecs
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.operators.snapshot import bulk_build
from keyspan.sources.files import _file_system
from keyspan.sources.store import Store


def follow_logs(spark: SparkSession, where: str) -> DataFrame:
    """Lines of the log files that arrive in a folder, as a stream of (value, file)."""
    return spark.readStream.text(where).select("value", F.col("_metadata.file_path").alias("file"))


class LogTail:
    """What is appended to one log file after an offset; a file that became shorter is read from its start again."""

    def __init__(self, path: str, offset: int = 0):
        self.system, self.path = _file_system(path)
        self.offset = offset
        self._decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def read(self) -> str:
        """The text since the last read, as far as its characters are whole; empty if nothing came or the file isn't there yet."""
        from pyarrow import fs

        info = self.system.get_file_info(self.path)
        if info.type == fs.FileType.NotFound:
            return ""
        if info.size < self.offset:
            self.offset = 0
            self._decoder.reset()
        with self.system.open_input_file(self.path) as f:
            f.seek(self.offset)
            data = f.read()
        self.offset += len(data)
        return self._decoder.decode(data)


def followed(tail: LogTail, running: Callable[[], bool], wait: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Pieces of a log as they come, until its writer has ended and what it wrote last is read."""
    while True:
        alive = running()
        text = tail.read()
        if text:
            yield text
        if not alive:
            return
        sleep(wait)


def commit_feed(store: Store, branch: str, author: str = "feed", clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: applies a batch of changes (key, value; null value: delete; ord) to a branch and commits it.

    Only the buckets that a batch touches are read and written. The batch id in the message makes a repeated batch a no-op.
    """

    def apply(batch: DataFrame, number: int) -> None:
        tip = store.refs().get(f"branch/{branch}")
        message = f"batch {number}"
        last = store.commits().where(F.col("hash") == tip).first() if tip else None
        if last and last["message"] == message:
            return
        changes = bulk_build(batch.select("key", "value", "ord"), [F.col("ord")]).drop("ord").persist()
        try:
            name = store.apply(last["tree"] if last else None, changes)
        finally:
            changes.unpersist()
        store.set_ref("branch", branch, store.commit(name, [tip] if tip else [], author, message, int(clock())), expected=tip)

    return apply


def supervised_waits(attempts: DataFrame) -> DataFrame:
    """Stream of (id, attempt, wait, restarts) for a stream of attempts (id, attempt, up_seconds, exit_code, policy).

    State per instance: the next wait and the restarts so far.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        wait, restarts, ended = state.get if state.exists else (1, 0, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("attempt").itertuples():
            if ended:
                continue
            if r.up_seconds >= 60:
                wait = 1
            if r.policy == "always" or r.policy == "on-failure" and r.exit_code != 0:
                restarts += 1
                out.append((key[0], r.attempt, wait, restarts))
                wait = min(wait * 2, 60)
            else:
                ended = True
                out.append((key[0], r.attempt, None, restarts))
        state.update((wait, restarts, ended))
        yield pd.DataFrame(out, columns=["id", "attempt", "wait", "restarts"]).astype({"wait": "Int32"})

    return attempts.groupBy("id").applyInPandasWithState(fold, "id string, attempt long, wait int, restarts int", "wait int, restarts int, ended boolean", "append", "NoTimeout")
