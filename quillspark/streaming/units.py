"""Control loops over units whose rounds arrive in any order: the state of a unit is its rounds so far, kept in a bucket of units.

Each batch gives the units that it touched their result anew; a timer of event time ends a unit that is no longer heard
of, gives its last result as final, and frees its state.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups of units that share a state and a timer: a call of Python handles one with all that a batch has for its units.
BUCKETS = 4_096

#: A round as ``decide`` gets it: its number, then the fields that decide. A state has a list for each of these instead.
Round = Sequence


def brake(rounds: list[Round]) -> tuple:
    """``chosen, stopped_at, accepted`` of [level, score, baseline]: see ``ordering.brake``, with a slack of 1."""
    failed = [level for level, score, baseline in rounds if score is None or baseline is None or score < baseline - 1]
    stop = min(failed, default=None)
    passed = [r[0] for r in rounds if stop is None or r[0] < stop]
    return max(passed, default=0), stop, len(passed)


BRAKE = "chosen int, stopped_at int, accepted long"


def repairs(most: int) -> Callable[[list[Round]], tuple]:
    """``state, recall_pre, recall_post, repairs`` of [round, parse_ok, matched, total]: see ``experiment.repairs``."""

    def decide(rounds: list[Round]) -> tuple:
        checked, before, after, last, known = False, None, None, None, -1
        for number, ok, matched, total in sorted(rounds, key=lambda r: r[0]):
            if number > most:
                break
            last = number
            recall = matched / total if ok and total else None
            checked = checked or bool(ok) and number == 0
            before = recall if number == 0 else before
            if recall is not None and number > known:
                after, known = recall, number
            if not (ok and matched < total):
                break
        return "checked" if checked else "unparsed", before, after, last

    return decide


REPAIRS = "state string, recall_pre double, recall_post double, repairs int"


def decided(stream: DataFrame, keys: list[str], number: str, fields: list[str], time: str, decide: Callable[[list[Round]], tuple], result: str, delay: str = "10 minutes", hold_ms: int = 3_600_000) -> DataFrame:
    """``keys``, the columns of ``result``, ``final``: of each unit that a batch touches, and of each that expires.

    ``decide`` gets all rounds of a unit that have arrived, in any order. A unit expires ``hold_ms`` after its latest round, once
    the watermark (``delay`` behind the latest time seen) has passed that; rounds that are later still are dropped. A
    round that is sent twice counts twice: drop repeats before.
    """
    named = [x.split()[0] for x in result.split(", ")]
    wide = len(keys)
    plain = lambda c: c.astype(object).where(c.notna(), None).tolist() if c.hasnans else c.tolist()

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = pickle.loads(zlib.decompress(state.get[0])) if state.exists else [[] for _ in range(wide + 2 + len(fields))]  # keys, round, when it is due
        due, held, mark = columns[-1], len(columns[-1]), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for part in parts:
                times = part[time].to_numpy("datetime64[ms]").astype("int64")
                for column, new in zip(columns, [*map(plain, map(part.get, [*keys, number, *fields])), np.maximum(times + hold_ms, max(mark + 1, 1)).tolist()], strict=True):
                    column.extend(new)
        units, rounds = defaultdict(list), list(zip(*columns[wide:-1], strict=True))
        for place, unit in enumerate(zip(*columns[:wide], strict=True)):
            units[unit].append(place)
        out, over, wake = [], set(), None
        for unit, places in units.items():
            ends, touched = max([due[i] for i in places]), places[-1] >= held
            final = ends <= mark and not touched
            if final:
                over.update(places)
            else:
                wake = ends if wake is None else min(wake, ends)
            if touched or final:
                out.append((*unit, *decide([rounds[i] for i in places]), final))
        if wake is None:
            state.remove()
        else:
            kept = [[x for i, x in enumerate(c) if i not in over] for c in columns] if over else columns
            state.update((zlib.compress(pickle.dumps(kept), 1),))
            state.setTimeoutTimestamp(max(mark + 1, wake))
        if out:
            yield pd.DataFrame(dict(zip([*keys, *named, "final"], zip(*out, strict=True), strict=True)))

    kinds = {k: stream.schema[k].dataType.simpleString() for k in keys}
    rows = stream.select(*keys, number, *fields, time).withWatermark(time, delay)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).withColumns({k: F.col(k).cast("string") for k in keys})  # as text, keys stay what they are, null or not
    given = ", ".join(f"`{k}` string" for k in keys)
    decided = rows.groupBy("_bucket").applyInPandasWithState(step, f"{given}, {result}, final boolean", "units binary", "update", GroupStateTimeout.EventTimeTimeout)
    return decided.withColumns({k: F.col(k).cast(kind) for k, kind in kinds.items()})


def put_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store what each batch updates, a folder a batch, so that a batch that is done again replaces itself; all that is there,
    then stop. ``latest`` reads it."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The last result of each unit."""
    rest = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
