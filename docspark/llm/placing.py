"""Places of rows laid end to end in an order: prefix sums in two levels, and look-up by row without a join.

Rows are range-sorted; running sums inside the partitions are added to the partitions' totals, of which there are as many as partitions.
The result goes back to where a row was numbered: row numbers are those of ``monotonically_increasing_id``, whose upper bits
name the task that wrote the row, so there is one file of places for each such task, and a task that reads rows loads the files of the
rows that it meets.  The rows themselves, which are large, aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import load_file, new_path, store_file, written

PART_BITS = 33


@lru_cache(maxsize=4)
def _file(path: str) -> np.ndarray:
    return np.frombuffer(load_file(path), np.int64)


def placed(tokens: DataFrame, order: list[str]) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    """A function for tasks, from row numbers to places, and the sum of ``n_tokens``.

    ``tokens``: a written table with row, n_tokens and the columns of ``order``; ties are broken by row.
    """
    keys = [*order, "row"]
    ordered = tokens.select(*order, "row", "n_tokens").repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", "n_tokens")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            ends = total + np.cumsum(n)
            if len(n):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), b.column("row"), pa.array(ends - n), pa.array(n)], names=["part", "row", "local", "n"])

    local = written(ordered.mapInArrow(running, "part long, row long, local long, n long"), "places")
    totals = sorted((r.part, r.n) for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases = list(accumulate((n for _, n in totals), initial=0))
    base = local.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, bases, strict=False)], "part long, base long")
    folder = new_path(local.sparkSession, "places")
    by_task = F.shiftright("row", PART_BITS).cast("int")
    back = local.join(F.broadcast(base), "part").select(by_task.alias("task"), "row", (F.col("local") + F.col("base")).alias("first"))
    back = back.repartition("task").sortWithinPartitions("row")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for b in batches:
            task, first = b.column("task").to_numpy(), b.column("first").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a and task[a] != now:
                    if held:
                        store_file(f"{folder}/{now}", np.concatenate(held).tobytes())
                    now, held = int(task[a]), []
                held.append(first[a:z])
        if now >= 0:
            store_file(f"{folder}/{now}", np.concatenate(held).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([1 if now >= 0 else 0])], names=["n"])

    back.mapInArrow(store, "n long").agg(F.sum("n")).collect()  # runs it; each row number's lower bits count from 0 within its task

    def place(rows: np.ndarray) -> np.ndarray:
        task, at = rows >> PART_BITS, rows & ((1 << PART_BITS) - 1)
        out = np.empty(len(rows), np.int64)
        for t in np.unique(task):
            mine = task == t
            out[mine] = _file(f"{folder}/{t}")[at[mine]]
        return out

    return place, bases[-1]
