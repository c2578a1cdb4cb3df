"""Overlapping predictions averaged as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "rollout long, step long, mean double, votes long"


def ensemble_stream(chunks: DataFrame) -> DataFrame:
    """rollout, step, mean, votes: each chunk that comes settles the steps before the one it starts at.

    ``chunks`` streams rollout, start and chunk (array<double>); chunks of one batch may come in any order.  State holds, by
    rollout, the sums and counts of the steps still open, at most as many as a chunk is long, and the step up to which
    all is settled: what a late chunk says of settled steps is ignored.  A null chunk ends its rollout: all open steps
    are settled and the state goes, so that a rollout of that name would begin anew.

    A batch's chunks are added up as they are read, so a task holds a sum and a count for each step of a rollout in the batch, and
    never its chunks.
    """

    def settle(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, sums, votes, settled = state.get if state.exists else ([], [], [], None)
        open_ = {s: [x, n] for s, x, n in zip(steps, sums, votes, strict=True)}
        newest, ended = settled, False
        for rows in batches:
            for start, chunk in zip(rows["start"], rows["chunk"], strict=True):
                if chunk is None:
                    ended = True
                    continue
                newest = int(start) if newest is None else max(newest, int(start))
                for step, x in enumerate(chunk, int(start)):
                    if settled is None or step >= settled:
                        cell = open_.setdefault(step, [0.0, 0])
                        cell[0] += float(x)
                        cell[1] += 1
        order = sorted(open_)
        done = order if ended else [s for s in order if s < newest]
        out = [(key[0], s, open_[s][0] / open_[s][1], open_.pop(s)[1]) for s in done]
        if ended:
            state.remove()
        else:
            left = sorted(open_)
            state.update((left, [open_[s][0] for s in left], [open_[s][1] for s in left], newest))
        yield pd.DataFrame(out, columns=["rollout", "step", "mean", "votes"])

    state = "steps array<long>, sums array<double>, votes array<long>, settled long"
    return chunks.groupBy("rollout").applyInPandasWithState(settle, OUTPUT, state, "append", GroupStateTimeout.NoTimeout)
