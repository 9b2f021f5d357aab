"""Growing replies: the parsed reply after every token of a request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from askgrid.functions.text import END_MARK

PREFIX = "request_id string, pos int, output string"
STATE = "done boolean, text string, next int, waiting map<int,string>"
KEEP_MILLISECONDS = 3_600_000


def prefixes(tokens: DataFrame) -> DataFrame:
    """All prefixes of every request at once: ``(request_id, pos, output)``.

    The end mark and everything after it gives no prefix. A reply's text, one value, is
    built once per request; its prefixes are cut at the running length of the tokens.
    """
    ends = tokens.where(F.col("token") == END_MARK).groupBy("request_id").agg(F.min("pos").alias("end_pos"))
    live = tokens.join(ends, "request_id", "left").where(
        F.col("end_pos").isNull() | (F.col("pos") < F.col("end_pos"))
    )
    so_far = W.partitionBy("request_id").orderBy("pos", "token").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.coalesce(F.sum(F.length("token")).over(so_far), F.lit(0)).cast("int")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "token")))
    texts = live.groupBy("request_id").agg(F.array_join(F.transform(in_order, lambda t: t["token"]), "").alias("text"))
    return live.select("request_id", "pos", upto.alias("upto")).join(texts, "request_id").select(
        "request_id", "pos", F.substring(F.col("text"), F.lit(1), F.col("upto")).alias("output")
    )


def _advance(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int | None
) -> Iterator[pd.DataFrame]:
    """Add a request's new tokens in order; out-of-order ones wait for their turn."""
    if state.hasTimedOut:
        # Only ended requests go; the text of the others waits for their next token.
        if state.get[0]:
            state.remove()
        else:
            state.update(state.get)
        return
    done, text, upcoming, waiting = state.get if state.exists else (False, "", 0, {})
    waiting = dict(waiting or {})
    for batch in batches:
        if not done:
            waiting.update({int(p): t for p, t in zip(batch["pos"], batch["token"]) if p >= upcoming})
    rows = []
    while not done and upcoming in waiting:
        token = waiting.pop(upcoming)
        if token == END_MARK:
            done = True
            break
        text += token
        rows.append((key[0], upcoming, text))
        upcoming += 1
    # After the end only the flag is kept, so that late tokens cannot start over.
    state.update((True, "", upcoming, {}) if done else (False, text, upcoming, waiting))
    if keep_ms:
        state.setTimeoutDuration(keep_ms)
    if rows:
        yield pd.DataFrame(rows, columns=["request_id", "pos", "output"])


def growing_replies(tokens: DataFrame, keep_ms: int | None = KEEP_MILLISECONDS) -> DataFrame:
    """Streaming twin of :func:`prefixes`, one state per request.

    A continuous stream forgets an ended request ``keep_ms`` after its last token and
    keeps the others, so that no reply loses a part however late it comes. Pass None for a run that ends with its input (``availableNow``): a pending timeout would
    keep such a run alive.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _advance(key, batches, state, keep_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return tokens.groupBy("request_id").applyInPandasWithState(advance, PREFIX, STATE, "append", timeout)
