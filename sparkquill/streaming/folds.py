"""Ordered folds by key: in batch over sorted partitions, live with keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, key: str, order: list[str], machine, event: list[str], outcome: str) -> DataFrame:
    """Adds the outcome columns (DDL) of the machine over each key's rows in order.

    Rows stream through sorted partitions: a task holds one key's state at a time, whatever the key's size.
    """
    names = [c.split()[0] for c in outcome.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + outcome

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            out = []
            for k, *values in pdf[[key, *event]].itertuples(index=False, name=None):
                if k != current:
                    current, state = k, machine.start()
                state, result = machine.step(state, tuple(values))
                out.append(result)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def live(stream: DataFrame, key: str, order: list[str], machine, event: list[str], outcome: str) -> DataFrame:
    """The same over a stream: state is kept by key between batches; rows of a batch are taken in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split()[0] for c in outcome.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", " + outcome

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(json.loads(state.get[0])) if state.exists else machine.start()
        pdf = pd.concat(list(batches)).sort_values(order).reset_index(drop=True)  # one key's rows of one trigger
        out = []
        for values in pdf[event].itertuples(index=False, name=None):
            now, result = machine.step(now, tuple(values))
            out.append(result)
        state.update((json.dumps(now),))
        yield pd.concat([pdf, pd.DataFrame(out, columns=names)], axis=1)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
