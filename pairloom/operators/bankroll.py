"""A bankroll along its bets: stakes that follow what it holds, lead days until bets settle, caps, least stakes, deposits and ruin.

Each stake depends on all results before it, so that a path is one fold. A day's bets of equal units have equal stakes, so that their
number and the sum of their gains stand for them: rows are summed up by day and units before they are dealt to systems and sorted. A
task gets its paths' rows sorted by day and folds them as they stream by: it holds one day's rows and the days that have not settled
yet, however long the path is. Different paths (scenarios, and the values of ``keys``) run side by side.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Products of stakes beyond this leave the range of doubles.
ENDLESS = 1e290


@dataclass(frozen=True)
class System:
    """How a bankroll is run.

    A day's bets are placed ``lead`` days ahead, when only days that ended before that have settled. ``unit`` says what one unit is worth
    at a bankroll; stakes are cut at ``most``, and left out below ``least``; if a day's stakes are more than the cash that is not tied
    up, all are scaled down to it. ``deposit`` is added at the start of each calendar month after the first (at its first day with bets,
    for all months since). Below ``ruin`` when bets are to be placed, it is over. A bankroll above ``ENDLESS`` counts as infinite and
    places no more; cash below a billionth of the bankroll is rounding.
    """

    start: float
    unit: Callable[[float], float]
    lead: int = 0
    least: float = 0.0
    most: float | None = None
    deposit: float = 0.0
    ruin: float = 5.0


def whole_hundreds(bankroll: float) -> float:
    """One per cent, in whole hundreds of the bankroll."""
    return math.floor(bankroll / 100) if bankroll >= 100 else bankroll / 100


def bold(bankroll: float) -> float:
    """Ten for each hundred beyond the first, or a twentieth of less than two hundred."""
    return 10.0 * (math.floor(bankroll / 100) - 1) if bankroll >= 200 else bankroll / 20


def one(bankroll: float) -> float:
    return 1.0


@dataclass
class Path:
    """A bankroll under way."""

    system: System
    held: float = field(init=False)
    open: deque = field(default_factory=deque)
    month: int | None = None
    bets: int = 0
    staked: float = 0.0
    deposited: float = field(init=False)
    lowest: float = field(init=False)
    highest: float = field(init=False)
    down: float = 0.0
    ruined: bool = False

    def __post_init__(self):
        self.held = self.deposited = self.lowest = self.highest = self.system.start

    def _settle(self, before: float) -> None:
        while self.open and self.open[0][0] < before:
            _, _, profit = self.open.popleft()
            self.held += profit
            self.lowest, self.highest = min(self.lowest, self.held), max(self.highest, self.held)
            self.down = max(self.down, 1 - self.held / self.highest)

    def day(self, day: int, month: int, units: np.ndarray, counts: np.ndarray, gains: np.ndarray) -> None:
        """``counts``: bets of so many units; ``gains``: sum of their profits for each unit staked."""
        s = self.system
        if self.ruined:
            return
        self._settle(day - s.lead)
        if s.deposit and self.month is not None and month > self.month:
            self.held += s.deposit * (month - self.month)
            self.deposited += s.deposit * (month - self.month)
        self.month = month
        if self.held < s.ruin:
            self.ruined = True
            return
        if self.held > ENDLESS:
            self.held = self.highest = math.inf
            self.open.clear()
            return
        cash = self.held - sum(stake for _, stake, _ in self.open)
        stakes = units * s.unit(self.held)
        if s.most is not None:
            stakes = np.minimum(stakes, s.most)
        keep = stakes >= s.least
        stakes, counts, gains = stakes[keep], counts[keep], gains[keep]
        total = float((stakes * counts).sum())
        if total <= 0 or cash <= 1e-9 * self.held:
            return
        if total > cash:
            stakes, total = stakes * (cash / total), cash
        self.open.append((day, total, float((stakes * gains).sum())))
        self.bets += int(counts.sum())
        self.staked += total

    def end(self) -> dict[str, object]:
        self._settle(math.inf)
        return {"final": self.held, "bets": self.bets, "staked": self.staked, "deposited": self.deposited, "lowest": self.lowest, "down": self.down, "ruined": self.ruined or self.held < self.system.ruin}


def bankrolls(bets: DataFrame, systems: dict[str, System], keys: list[str], day: str, month: str, units: str, gain: str) -> DataFrame:
    """``keys``, system, final, bets, staked, deposited, lowest, down (deepest fall, as a share) and ruined: a row for each path.

    ``day`` and ``month`` are whole numbers that rise with time, ``units`` what is staked in units, ``gain`` the profit for each unit (0 if
    stakes come back). Bets without one of them are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in bets.schema}
    rows = bets.select(*keys, F.col(day).cast("int").alias("__day"), F.col(month).cast("int").alias("__month"), F.col(units).cast("double").alias("__units"), F.col(gain).cast("double").alias("__gain")).dropna(subset=["__day", "__month", "__units", "__gain"])
    rows = rows.groupBy(*keys, "__day", "__month", "__units").agg(F.count("*").alias("__n"), F.sum("__gain").alias("__gain"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, systems))).alias("system")).repartition(*keys, "system").sortWithinPartitions(*keys, "system", "__day", "__month", "__units")
    path_keys = [*keys, "system"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = path = today = None
        held: list[tuple[np.ndarray, ...]] = []

        def close_day() -> None:
            if held:
                path.day(*today, *(np.concatenate(c) for c in zip(*held, strict=True)))
                held.clear()

        def result() -> pd.DataFrame:
            close_day()
            return pd.DataFrame([dict(zip(path_keys, now, strict=True)) | path.end()])

        for b in batches:
            if not len(b):
                continue
            values = [b[k].astype(object).where(b[k].notna(), None).tolist() for k in path_keys]
            days, months = b["__day"].to_numpy(), b["__month"].to_numpy()
            ids = list(zip(*values, days.tolist(), strict=True))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                key = ids[i][:-1]
                if path is None or key != now:
                    if path is not None:
                        yield result()
                    now, path = key, Path(systems[key[-1]])
                if today is None or not held or days[i] != today[0]:
                    close_day()
                    today = int(days[i]), int(months[i])
                held.append(tuple(b[c].to_numpy()[i:j] for c in ("__units", "__n", "__gain")))
        if path is not None:
            yield result()

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + "system string, final double, bets long, staked double, deposited double, lowest double, down double, ruined boolean"
    return rows.mapInPandas(run, schema)
