"""Ratings by period: each contest sees the states from before its period, then all results of the period are folded in at once.

States are a table by entity. A period is two joins of its contests with that table, sums by entity, and a projection to the new
states, so that neither a league nor an entity's history has to fit in a task, and what is ordered is the few periods only. With one
day as the period the contests of a date are folded together, as they see the same states. Elo, Glicko-2, line filters and Poisson
skills differ in what they sum and how they update; the formulas are those of the papers on each (Elo 1978; Glickman 2012; Kalman 1960;
one Gauss-Newton step of a Poisson state-space model, as in West, Harrison and Migon 1985).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.tables import written

#: Points of a rating for one unit of Glicko-2's scale; a fixed value.
GLICKO_SCALE = 173.7178
Values = dict[str, Column]


def expectation(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


@dataclass(frozen=True)
class Elo:
    """``score`` is side a's share of a point; null scores are skipped. ``finish`` multiplies steps of contests where ``finished`` holds,
    ``weight`` names a column that multiplies all; ``decay`` makes first contests count more; after ``layoff`` days without one, ``keep``
    of the distance from ``initial`` is left."""

    score: str = "y"
    k: float = 40.0
    initial: float = 1500.0
    finish: float = 1.0
    decay: float = 0.0
    finished: str | None = None
    weight: str | None = None
    layoff: int | None = None
    keep: float = 1.0

    def start(self) -> dict[str, float]:
        return {"rating": self.initial, "seen": 0.0}

    def observe(self, a: bool) -> Values:
        s = F.col(self.score).cast("double")
        step = F.when(F.col(self.finished), self.k * self.finish).otherwise(self.k) if self.finished else F.lit(self.k)
        return {"score": s if a else 1 - s, "step": step * F.col(self.weight) if self.weight else step}

    def drift(self, state: Values, idle: Column) -> Values:
        if self.layoff is None:
            return state
        return state | {"rating": F.when(idle > self.layoff, self.initial + (state["rating"] - self.initial) * self.keep).otherwise(state["rating"])}

    def sums(self, own: Values, opp: Values, seen: Values) -> Values:
        gain = seen["step"] * (1 + self.decay / (1 + own["seen"])) * (seen["score"] - expectation(own["rating"], opp["rating"]))
        return {"gain": gain, "count": F.when(seen["score"].isNotNull(), 1.0)}

    def update(self, own: Values, total: Values) -> Values:
        return {"rating": own["rating"] + total["gain"], "seen": own["seen"] + total["count"]}

    def value(self, state: Values) -> Column:
        return state["rating"]


@dataclass(frozen=True)
class Glicko2:
    """Rating, deviation and volatility; the deviation of a side that rests grows with its volatility for each ``days``."""

    score: str = "y"
    tau: float = 0.5
    deviation: float = 350.0
    volatility: float = 0.06
    days: float = 30.0

    def start(self) -> dict[str, float]:
        return {"mu": 0.0, "phi": self.deviation / GLICKO_SCALE, "sigma": self.volatility}

    def observe(self, a: bool) -> Values:
        s = F.col(self.score).cast("double")
        return {"score": s if a else 1 - s}

    def drift(self, state: Values, idle: Column) -> Values:
        wide = F.sqrt(state["phi"] ** 2 + state["sigma"] ** 2 * idle / self.days)
        return state | {"phi": F.least(wide, F.lit(self.deviation / GLICKO_SCALE))}

    def sums(self, own: Values, opp: Values, seen: Values) -> Values:
        g = 1 / F.sqrt(1 + 3 * opp["phi"] ** 2 / F.lit(3.141592653589793) ** 2)
        e = 1 / (1 + F.exp(-g * (own["mu"] - opp["mu"])))
        known = seen["score"].isNotNull()
        return {"information": F.when(known, g * g * e * (1 - e)), "surprise": g * (seen["score"] - e)}

    def update(self, own: Values, total: Values) -> Values:
        v = 1 / total["information"]
        change = v * total["surprise"]
        sigma = self._volatility(own["phi"] ** 2, own["sigma"], v, change**2)
        phi2 = 1 / (1 / (own["phi"] ** 2 + sigma**2) + total["information"])
        played = total["information"] > 0
        new = {"mu": own["mu"] + phi2 * total["surprise"], "phi": F.sqrt(phi2), "sigma": sigma}
        return {k: F.when(played, new[k]).otherwise(own[k]) for k in new}

    def _volatility(self, phi2: Column, sigma: Column, v: Column, change2: Column) -> Column:
        """The root of the paper's function of the log variance, which falls from plus to minus between the two ends; halved 45 times."""
        a = F.ln(sigma**2)
        ends = F.struct((a - 10.0).alias("lo"), F.greatest(a, F.ln(F.greatest(change2 - phi2 - v, F.lit(1e-12)))).alias("hi"))

        def halve(x: Column, _: Column) -> Column:
            mid = (x["lo"] + x["hi"]) / 2
            e = F.exp(mid)
            up = e * (change2 - phi2 - v - e) / (2 * (phi2 + v + e) ** 2) - (mid - a) / self.tau**2 > 0
            return F.struct(F.when(up, mid).otherwise(x["lo"]).alias("lo"), F.when(up, x["hi"]).otherwise(mid).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(45)), ends, halve)
        return F.exp((found["lo"] + found["hi"]) / 4)

    def value(self, state: Values) -> Column:
        return 1500.0 + GLICKO_SCALE * state["mu"]


@dataclass(frozen=True)
class LineFilter:
    """Strengths whose difference is seen in a line (log odds of side a) with noise of variance ``r``; uncertainty grows by ``q`` a year."""

    line: str = "line"
    p0: float = 0.3
    q: float = 0.05
    r: float = 0.2

    def start(self) -> dict[str, float]:
        return {"mean": 0.0, "variance": self.p0}

    def observe(self, a: bool) -> Values:
        return {"line": F.col(self.line) if a else -F.col(self.line)}

    def drift(self, state: Values, idle: Column) -> Values:
        return state | {"variance": F.least(state["variance"] + self.q * idle / 365.25, F.lit(2 * self.p0))}

    def sums(self, own: Values, opp: Values, seen: Values) -> Values:
        # what a line says of one side, if the other is known with its own variance
        noise = self.r + opp["variance"]
        return {"precision": F.when(seen["line"].isNotNull(), 1 / noise), "weighted": (seen["line"] + opp["mean"]) / noise}

    def update(self, own: Values, total: Values) -> Values:
        variance = 1 / (1 / own["variance"] + total["precision"])
        return {"mean": variance * (own["mean"] / own["variance"] + total["weighted"]), "variance": variance}

    def value(self, state: Values) -> Column:
        return state["mean"]


@dataclass(frozen=True)
class PoissonSkills:
    """Attack and defence on a log scale. Counts of both sides are Poisson with rate exp(level + attack - the other's defence) times the exposure."""

    counts: tuple[str, str] = ("a_count", "b_count")
    exposure: str = "exposure"
    level: str = "level"
    p0: float = 0.2
    q: float = 0.03

    def start(self) -> dict[str, float]:
        return {"attack": 0.0, "attack_var": self.p0, "defence": 0.0, "defence_var": self.p0}

    def observe(self, a: bool) -> Values:
        made, conceded = self.counts if a else self.counts[::-1]
        known = F.col(made).isNotNull() & F.col(conceded).isNotNull() & (F.col(self.exposure) > 0)
        keep = lambda c: F.when(known, F.col(c).cast("double"))
        return {"made": keep(made), "conceded": keep(conceded), "base": F.when(known, F.col(self.exposure) * F.exp(self.level))}

    def drift(self, state: Values, idle: Column) -> Values:
        grown = lambda c: F.least(state[c] + self.q * idle / 365.25, F.lit(1.5 * self.p0))
        return state | {c: grown(c) for c in ("attack_var", "defence_var")}

    def sums(self, own: Values, opp: Values, seen: Values) -> Values:
        """Slope and curvature of the log likelihood at the states before; the other side's doubt takes from both."""
        made = seen["base"] * F.exp(own["attack"] - opp["defence"])
        conceded = seen["base"] * F.exp(opp["attack"] - own["defence"])
        out = {}
        for name, got, expected, doubt, sign in (("attack", seen["made"], made, opp["defence_var"], 1), ("defence", seen["conceded"], conceded, opp["attack_var"], -1)):
            less = 1 + expected * doubt
            out |= {f"{name}_slope": sign * (got - expected) / less, f"{name}_curve": expected / less}
        return out

    def update(self, own: Values, total: Values) -> Values:
        out = {}
        for name in ("attack", "defence"):
            variance = 1 / (1 / own[f"{name}_var"] + total[f"{name}_curve"])
            # a step of one at most keeps a single surprise from running away
            step = F.greatest(F.least(variance * total[f"{name}_slope"], F.lit(1.0)), F.lit(-1.0))
            out |= {name: own[name] + step, f"{name}_var": variance}
        return out

    def value(self, state: Values) -> Column:
        return state["attack"] + state["defence"]

    def more(self, state: Values) -> Values:
        return {f"_{c}": state[c] for c in ("attack", "attack_var", "defence", "defence_var")}

    @staticmethod
    def expected(level: Column, exposure: Column, name: str = "skill") -> Values:
        """Columns of ``rated`` as the expected counts of both sides (with half the doubt, as rates are log-normal) and side a's share of them."""
        rate = lambda x, y: exposure * F.exp(level + F.col(f"{x}_{name}_attack") - F.col(f"{y}_{name}_defence") + (F.col(f"{x}_{name}_attack_var") + F.col(f"{y}_{name}_defence_var")) / 2)
        return {"a_expected": rate("a", "b"), "b_expected": rate("b", "a"), "share": rate("a", "b") / (rate("a", "b") + rate("b", "a"))}


def league_level(contests: DataFrame, period: str, counts: Sequence[str], exposure: str, out: str = "level", rate: float = 1.0, weight: float = 500.0, fade: float = 0.5) -> DataFrame:
    """``contests`` plus ``out``: the log of the counts' rate over all earlier periods, each worth ``fade`` of the one after it, and ``weight`` of exposure at ``rate``."""
    made = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    sums = contests.filter(made.isNotNull() & (F.col(exposure) > 0)).groupBy(period).agg(F.sum(made).cast("double").alias("__c"), F.sum(F.col(exposure) * len(counts)).cast("double").alias("__t"))
    # one row for each period, so that the window without a key is small; what lies 60 periods back has faded away
    w = Window.orderBy(period).rowsBetween(-60, -1)
    spine = contests.select(period).distinct().join(sums, period, "left")
    earlier = lambda c: F.aggregate(F.collect_list(F.coalesce(F.col(c), F.lit(0.0))).over(w), F.lit(0.0), lambda a, x: (a + x) * fade)
    level = spine.select(period, F.ln((earlier("__c") + rate * weight) / (earlier("__t") + weight)).alias(out))
    return contests.join(F.broadcast(level), period)


def rated(contests: DataFrame, ratings: dict[str, object], period: str, contest: str = "contest_id", day: str = "day", sides: tuple[str, str] = ("a_id", "b_id")) -> DataFrame:
    """``contest`` and, for each rating, both sides' values ``a_<name>`` and ``b_<name>`` from before its period, drifted to its day (and what its ``more`` adds, with its endings)."""
    fields = {n: list(r.start()) for n, r in ratings.items()}

    def side(k: int) -> Column:
        seen = [F.struct(*(c.alias(f) for f, c in r.observe(k == 0).items())).alias(f"__seen_{n}") for n, r in ratings.items()]
        return F.struct(F.lit("ab"[k]).alias("side"), F.col(sides[k]).alias("id"), F.col(sides[1 - k]).alias("opp"), *seen)

    rows = contests.select(F.col(contest).alias("contest"), F.col(period).alias("period"), F.col(day).alias("day"), F.explode(F.array(side(0), side(1))).alias("s"))
    rows = written(rows.select("contest", "period", "day", "s.*"))
    kinds = [f"{n}__{f} double" for n in ratings for f in fields[n]]
    state = rows.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)['id']}, last int, " + ", ".join(kinds))

    def states(df: DataFrame, table: DataFrame, key: str, prefix: str, on: list[str]) -> DataFrame:
        """``df`` with each rating's state of ``key`` (its start where there is none) drifted to the row's day, as ``<prefix><name>``."""
        j = df.join(table.select(F.col("id").alias(key), *on, F.struct("*").alias("__st")), [key, *on], "left")
        out = {}
        for n, r in ratings.items():
            st = {f: F.coalesce(F.col(f"__st.{n}__{f}"), F.lit(v)) for f, v in r.start().items()}
            idle = F.coalesce(F.greatest(F.col("day") - F.col("__st.last"), F.lit(0)), F.lit(0))
            out[prefix + n] = F.struct(*(c.alias(f) for f, c in r.drift(st, idle).items()))
        return j.withColumns(out).drop("__st")

    of = lambda prefix, n: {f: F.col(f"{prefix}{n}.{f}") for f in fields[n]}
    seen = lambda n, r: {f: F.col(f"__seen_{n}.{f}") for f in r.observe(True)}
    before = []
    for k in sorted(x[0] for x in rows.select("period").distinct().collect() if x[0] is not None):
        before.append(state.withColumn("period", F.lit(k).cast(dict(rows.dtypes)["period"])))
        now = states(states(rows.filter(F.col("period") == k), state, "id", "own_", []), state, "opp", "opp_", [])
        sums, names = [], {}
        for n, r in ratings.items():
            for f, c in r.sums(of("own_", n), of("opp_", n), seen(n, r)).items():
                sums.append(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{n}__sum_{f}"))
                names.setdefault(n, []).append(f)
            # all rows of an entity start from one state; the earliest day's drift is the one it is updated from
            sums.append(F.min_by(F.col("own_" + n), "day").alias("own_" + n))
        met = now.groupBy("id").agg(F.max("day").cast("int").alias("last"), *sums)
        new = {f"{n}__{f}": c for n, r in ratings.items() for f, c in r.update(of("own_", n), {f: F.col(f"{n}__sum_{f}") for f in names[n]}).items()}
        met = met.select("id", "last", *(new[c.split()[0]].alias(c.split()[0]) for c in kinds))
        state = written(state.join(met, "id", "left_anti").unionByName(met))
    if not before:
        before = [state.withColumn("period", F.lit(None).cast(dict(rows.dtypes)["period"]))]
    history = before[0]
    for b in before[1:]:
        history = history.unionByName(b)
    known = states(rows.select("contest", "side", "period", "day", "id"), history, "id", "own_", ["period"])
    values = lambda n, r: {"": r.value(of("own_", n))} | (r.more(of("own_", n)) if hasattr(r, "more") else {})
    each = [F.max(F.when(F.col("side") == s, v)).alias(f"{s}_{n}{end}") for n, r in ratings.items() for s in "ab" for end, v in values(n, r).items()]
    return known.groupBy("contest").agg(*each).withColumnRenamed("contest", contest)
