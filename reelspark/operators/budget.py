"""Rolling budgets of requests and tokens."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

WINDOW_US = 60_000_000


#: Time that one task reads in a row, in minutes; a busy key is dealt to as many tasks as it has such spans.
SPAN = 60


def rolling_usage(rows: DataFrame, keys: Sequence[str], cost: str = "cost", order: str = "t_us") -> DataFrame:
    """rows with requests and tokens used in the minute that ends with each: (now - 60 s, now].

    A key's time is cut into spans. Rows of a span's last minute are copied into the next one, where they are only counted.
    """
    span = lambda t: F.floor(t / (SPAN * WINDOW_US))
    t = F.col(order)
    dealt = rows.withColumn("_span", F.explode(F.array_distinct(F.array(span(t), span(t + WINDOW_US - 1)))))
    own = Window.partitionBy(*keys, "_span").orderBy(order).rangeBetween(-(WINDOW_US - 1), 0)
    used = dealt.withColumn("used_requests", F.count(F.lit(1)).over(own)).withColumn("used_tokens", F.sum(cost).over(own))
    return used.filter(F.col("_span") == span(t)).drop("_span")


#: Parts that the range of an order is cut into, so that a key of very many rows is dealt to many tasks.
PARTS = 256


def largest_prefix(rows: DataFrame, keys: Sequence[str], order: str, budget: Column | int, cost: str = "cost") -> DataFrame:
    """rows with whether they belong to the longest start of their group whose costs fit the budget.

    Where the order is a number, its range is cut into parts: the sums of the parts before are added to a running sum within each part.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    running = lambda by: F.sum(cost).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if not isinstance(rows.schema[order].dataType, NumericType):
        return rows.withColumn("admitted", running(keys) <= limit)
    at = F.col(order).cast("double")
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, wide = ends["low"] or 0.0, max((ends["high"] or 0.0) - (ends["low"] or 0.0), 1e-300)
    part = F.coalesce(F.least(F.floor((at - low) / wide * PARTS), F.lit(PARTS - 1)), F.lit(-1)).cast("int")
    dealt = rows.withColumn("_part", part)
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(cost).alias("_sum"))  # PARTS rows a key at most
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "_part")], F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "_part")]
    dealt = dealt.join(sums, same).withColumn("admitted", F.col("_before") + running([*keys, "_part"]) <= limit)
    return dealt.select(*rows.columns, "admitted")


@dataclass(frozen=True)
class Reservation:
    """A start of requests: its number, when it was, how many items it took and the tokens set aside for them."""

    number: int
    t: float
    items: int
    tokens: int


def _whole(value: object, least: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{what} must be a whole number, {least} at least")
    return value


class RollingLimiter:
    """Admits starts of requests under limits of requests and tokens a minute; time is given, so it runs over stored events too.

    A ledger: the times of all starts in order, and the running total of tokens before each. What is in force at a moment is a
    suffix of it, found by binary search, and what that holds is a difference of totals.
    Waiting for exactly wait() and trying again needs times that add without rounding: whole microseconds, say.
    """

    def __init__(self, requests: int, tokens: int, window: float = 60.0) -> None:
        self.requests, self.tokens, self.window = _whole(requests, 1, "requests"), _whole(tokens, 1, "tokens"), window
        self._times: list[float] = []
        self._totals: list[int] = [0]
        self._dropped = 0

    def _in_force(self, now: float) -> int:
        """How many of the ledger's starts have left; long ledgers lose them."""
        gone = bisect_right(self._times, now - self.window)
        if gone > 1024:
            del self._times[:gone], self._totals[:gone]
            self._dropped += gone
            return 0
        return gone

    def attempt(self, now: float, costs: Sequence[int]) -> Reservation | None:
        """What of the costs is admitted now, or None."""
        sums = list(accumulate(_whole(c, 1, "a cost") for c in costs))
        if not sums:
            raise ValueError("there must be a cost")
        if sums[0] > self.tokens:
            raise ValueError(f"an item of {sums[0]} tokens can never be admitted")
        gone = self._in_force(now)
        free = self.tokens - (self._totals[-1] - self._totals[gone])
        items = bisect_right(sums, free) if len(self._times) - gone < self.requests else 0
        if items == 0:
            return None
        self._times.append(now)
        self._totals.append(self._totals[-1] + sums[items - 1])
        return Reservation(self._dropped + len(self._times) - 1, now, items, sums[items - 1])

    def wait(self, now: float) -> float:
        """How long until the oldest start in force leaves; the whole window if there is none."""
        left = self._times[gone] - now if (gone := self._in_force(now)) < len(self._times) else 0
        return max(0, left + self.window)

    def reconcile(self, reservation: Reservation, actual: int) -> None:
        """Puts the tokens that were really used in place of those set aside."""
        change = _whole(actual, 0, "actual tokens") - reservation.tokens
        at = reservation.number - self._dropped
        for i in range(max(0, at + 1), len(self._totals) if at >= 0 else 0):
            self._totals[i] += change


def admission_times(rows: DataFrame, key: str, requests: int, tokens: int, order: str = "t_us", cost: str = "cost") -> DataFrame:
    """When each single-item request of a provider is admitted: each waits for those before it. Sequential for each key by nature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter, own, clock = None, None, 0
        for batch in batches:
            out = []
            for k, t, c in zip(batch[key], batch[order], batch[cost], strict=True):
                t = int(t)
                if limiter is None or k != own:
                    limiter, own, clock = RollingLimiter(requests, tokens, WINDOW_US), k, t
                clock = max(clock, t)
                while limiter.attempt(clock, [int(c)]) is None:
                    clock += limiter.wait(clock)
                out.append(clock)
            yield batch.assign(admitted_us=out)

    # Rows of a key stand together and in order; nothing of a group is held but the last minute.
    dealt = rows.select(key, order, cost).repartition(F.col(key)).sortWithinPartitions(key, order, cost)
    kinds = dict(rows.dtypes)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {cost} {kinds[cost]}, admitted_us long")
