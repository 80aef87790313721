"""Three-way decisions from model outputs, and set-based search over their parameters."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import clip, nonzero
from tidegrid.plans.regimes import level_label, level_regime


@dataclass(frozen=True)
class DecisionRule:
    """The tuned decision parameters."""

    up_advantage: float = -0.0452
    threshold: float = 0.6840
    up_classifier: float = 0.6011
    up_magnitude: float = 0.3989
    down_classifier: float = 0.6624
    down_magnitude: float = 0.3376
    up_large: float = 9.9973
    down_large: float = 9.2031


def _p(rule: DecisionRule | Column, name: str) -> Column:
    return rule[name] if isinstance(rule, Column) else F.lit(getattr(rule, name))


def confidence(prob: Column, magnitude: Column, up: Column, rule: DecisionRule | Column) -> Column:
    """Blend of class probability and size: w_c * p + w_m * min(|m| / large, 1), within 0..1."""
    side = lambda n: F.when(up, _p(rule, f"up_{n}")).otherwise(_p(rule, f"down_{n}"))
    strength = clip(F.abs(magnitude) / side("large"), hi=1)
    return clip(side("classifier") * prob + side("magnitude") * strength, 0, 1)


def pct_from_log(log: str | Column) -> Column:
    """Log change clipped to +-2 as a percent change clipped to -50..100."""
    x = F.col(log) if isinstance(log, str) else log
    return clip((F.exp(clip(x, -2, 2)) - 1) * 100, -50, 100)


def decide(df: DataFrame, rule: DecisionRule | Column = DecisionRule(), level: str | None = "vix") -> DataFrame:
    """From p_up_raw, p_down_raw, expansion_log and compression_log: normalised probabilities, the
    side, its size, confidence, NO_DECISION below the threshold, and the expected level."""
    total = nonzero(F.col("p_up_raw") + F.col("p_down_raw"))
    df = df.withColumns({
        "p_up": F.col("p_up_raw") / total, "p_down": F.col("p_down_raw") / total, "expansion_pct": pct_from_log("expansion_log"), "compression_pct": pct_from_log("compression_log"),
    })
    up = ~(F.col("p_down") > F.col("p_up") + _p(rule, "up_advantage"))
    size, prob = F.when(up, F.col("expansion_pct")).otherwise(F.col("compression_pct")), F.when(up, F.col("p_up")).otherwise(F.col("p_down"))
    df = df.withColumns({"_up": up, "_size": size, "direction_probability": prob})
    df = df.withColumn("direction_confidence", confidence(F.col("direction_probability"), F.col("_size"), F.col("_up"), rule))
    weak = F.col("direction_confidence") < _p(rule, "threshold")
    df = df.withColumns({
        "direction": F.when(weak, "NO_DECISION").when(F.col("_up"), "UP").otherwise("DOWN"), "magnitude_pct": F.when(weak, 0.0).otherwise(F.col("_size")),
    }).drop("_up", "_size")
    if level:
        df = df.withColumn("expected_vix", F.col(level) * (1 + F.col("magnitude_pct") / 100))
        here, there = level_label(level_regime(level, "left")), level_label(level_regime("expected_vix", "left"))
        df = df.withColumns({"current_regime": here, "expected_regime": there, "regime_change": (here != there).cast("int")})
    return df


# Ranges the search samples decision parameters from.
SEARCH_RANGES = {
    "up_advantage": (-0.10, 0.10), "threshold": (0.65, 0.80), "up_classifier": (0.55, 0.75), "down_classifier": (0.65, 0.85), "up_large": (9.0, 13.0), "down_large": (9.0, 14.0),
}


# Irrational steps, one per searched weight, whose multiples' fractions fill the ranges evenly.
LATTICE = {"up_advantage": math.sqrt(2) - 1, "up_classifier": math.sqrt(3) - 1, "down_classifier": math.sqrt(5) - 2, "up_large": math.sqrt(7) - 2, "down_large": math.sqrt(11) - 3}


def candidate_rules(weights: int = 100, thresholds: int = 20, ranges: dict[str, tuple[float, float]] | None = None) -> list[DecisionRule]:
    """``weights`` settings of a lattice over the ranges, each with ``thresholds`` even thresholds; a magnitude weight
    is what the classifier weight leaves. The default is the 2,000 trials of a full search."""
    span = {**SEARCH_RANGES, **(ranges or {})}
    rules = []
    for w in range(1, weights + 1):
        v = {k: round(span[k][0] + (span[k][1] - span[k][0]) * (w * step - math.floor(w * step)), 4) for k, step in LATTICE.items()}
        v["up_magnitude"], v["down_magnitude"] = round(1 - v["up_classifier"], 4), round(1 - v["down_classifier"], 4)
        lo, hi = span["threshold"]
        rules += [DecisionRule(threshold=round(lo + (hi - lo) * t / max(1, thresholds - 1), 4), **v) for t in range(thresholds)]
    return rules


def _groups(rules: list[DecisionRule]) -> dict[tuple, list[tuple[float, int]]]:
    """Weights -> ascending (threshold, candidate)."""
    found: dict[tuple, list[tuple[float, int]]] = {}
    for i, r in enumerate(rules):
        found.setdefault(tuple(v for k, v in asdict(r).items() if k != "threshold"), []).append((r.threshold, i))
    return {w: sorted(t) for w, t in found.items()}


def _constant(value: list, kind: str) -> Column:
    """A nested value as one literal; Spark folds it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def score_candidates(df: DataFrame, rules: list[DecisionRule], actual: str = "actual") -> DataFrame:
    """Decision scores of every candidate rule, as ``direction_scores`` gives them.

    Side, size and confidence depend on a rule's weights alone, so a row is worked out once per set of weights and
    counted in the step between two thresholds that its confidence falls into (a binary search). Steps are folded
    map-side to one row per task, weights and step; a threshold's scores are the sums of the steps from it up. So the cost
    is rows times sets of weights, however many thresholds there are. No refit, no join."""
    groups = _groups(rules)
    names = [k for k in asdict(DecisionRule()) if k != "threshold"]
    every = _constant([dict(zip(names, w), g=g, threshold=-1.0, steps=[t for t, _ in ts]) for g, (w, ts) in enumerate(groups.items())], "array<struct<g:int,threshold:double,steps:array<double>," + ",".join(f"{n}:double" for n in names) + ">>")
    rows = df.select("p_up_raw", "p_down_raw", "expansion_log", "compression_log", actual).withColumn("rule", F.explode(every))
    d = decide(rows, F.col("rule"), level=None)  # below every confidence: each row is decided
    halves = [1 << k for k in reversed(range(max(len(t) for t in groups.values()).bit_length()))]
    passed = F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda at, h: at + F.when(F.try_element_at("rule.steps", at + h) <= F.col("direction_confidence"), h).otherwise(0))
    step = F.when(F.col("direction_confidence").isNull(), F.size("rule.steps")).otherwise(passed)
    hit = (F.col("direction") == F.col(actual)).cast("int")
    sums = [F.count(F.lit(1)).alias("n")]
    for side in ("UP", "DOWN"):
        on = F.col("direction") == side
        sums += [
            F.count(F.when(on, 1)).alias(f"{side}_n"), F.coalesce(F.sum(F.when(on, hit)), F.lit(0)).alias(f"{side}_hit"), F.count(F.when(on, hit)).alias(f"{side}_known"), F.coalesce(F.sum(F.when(on, F.col("direction_confidence"))), F.lit(0.0)).alias(f"{side}_conf"),
            F.count(F.when(on, F.col("direction_confidence"))).alias(f"{side}_confs"), F.coalesce(F.sum(F.when(on, F.col("magnitude_pct"))), F.lit(0.0)).alias(f"{side}_size"), F.count(F.when(on, F.col("magnitude_pct"))).alias(f"{side}_sizes"),
        ]
    per = d.groupBy(F.col("rule.g").alias("g"), step.alias("step")).agg(*sums)
    columns = [c for c in per.columns if c not in ("g", "step")]
    listed = per.groupBy("g").agg(F.collect_list(F.struct("step", *columns)).alias("steps"))  # at most a row per threshold, and one
    which = _constant([[{"candidate": i, "least": k} for k, (_, i) in enumerate(ts, 1)] for ts in groups.values()], "array<array<struct<candidate:int,least:int>>>")
    each = listed.select("steps", F.explode(F.element_at(which, F.col("g") + 1)).alias("_c")).select("steps", "_c.*")
    total = lambda c, least: F.aggregate("steps", F.lit(0).cast(dict(per.dtypes)[c]), lambda a, s: a + F.when(s["step"] >= least, s[c]).otherwise(F.lit(0)))
    each = each.select("candidate", *[total(c, F.col("least")).alias(c) for c in columns], total("n", F.lit(0)).alias("all"))
    mean = lambda a, b: F.coalesce(a / nonzero(b), F.lit(0.0))
    c = F.col
    out = [
        "candidate", c("all").alias("total_samples"), c("n").alias("made_decision"), (c("all") - c("n")).alias("no_decision"), ((c("all") - c("n")) / c("all")).alias("no_decision_pct"),
        mean(c("UP_hit") + c("DOWN_hit"), c("UP_known") + c("DOWN_known")).alias("overall_accuracy"),
    ]
    for side in ("UP", "DOWN"):
        s = side.lower()
        out += [c(f"{side}_n").alias(f"{s}_count"), mean(c(f"{side}_hit"), c(f"{side}_known")).alias(f"{s}_accuracy"), mean(c(f"{side}_conf"), c(f"{side}_confs")).alias(f"{s}_confidence"), mean(c(f"{side}_size"), c(f"{side}_sizes")).alias(f"{s}_magnitude")]
    return each.select(*out)


def composite_score(min_accuracy: float = 0.70, min_decisions: int = 100, none_range: tuple[float, float] = (0.15, 0.40), natural_up: float = 0.44) -> Column:
    """Lower is better; 999 where a hard constraint fails. Reads ``direction_scores`` columns."""
    up, down, none, made = F.col("up_accuracy"), F.col("down_accuracy"), F.col("no_decision_pct"), F.col("made_decision")
    up_share = F.coalesce(F.col("up_count") / nonzero(made), F.lit(0.0))
    barred = (up < min_accuracy) | (down < min_accuracy) | (made < min_decisions) | (none < none_range[0]) | (none > none_range[1])
    none_pen = F.when(none < 0.20, (0.20 - none) * 100).when(none > 0.35, (none - 0.35) * 100).otherwise(-5.0)
    thin = F.when(made < 150, (150 - made) * 0.5).otherwise(0.0)
    score = (1 - F.least(up, down)) * 100 + (1 - (up + down) / 2) * 30 + F.pow(up - down, 2) * 200 + F.pow(up_share - natural_up, 2) * 50 + none_pen + thin
    return F.when(barred, 999.0).otherwise(score)


def unified_score(expansion_mae: tuple[str, str] | None = None, compression_mae: tuple[str, str] | None = None, min_decisions: int = 80) -> Column:
    """The joint tuner's penalty: accuracy near 75 %, balanced sides, regressor errors when their
    (train, val) columns are given, enough decisions."""
    up, down, none, made = F.col("up_accuracy"), F.col("down_accuracy"), F.col("no_decision_pct"), F.col("made_decision")
    share = lambda side: F.coalesce(F.col(f"{side}_count") / nonzero(made), F.lit(0.0))
    acc = sum_columns([F.abs(a - 0.75) * 3 + F.when(a < 0.70, 15.0).otherwise(0.0) for a in (up, down)])
    off = sum_columns([F.when(share(s) < 0.40, (0.40 - share(s)) * 200).when(share(s) > 0.60, (share(s) - 0.60) * 200).otherwise(0.0) for s in ("up", "down")])
    lopsided = F.when((share("up") > 0.70) | (share("down") > 0.70), 50.0).otherwise(0.0)
    gap = F.when(F.abs(up - down) > 0.05, (F.abs(up - down) - 0.05) * 100).otherwise(0.0)
    reg = F.lit(0.0)
    for cols, limit, slack in ((expansion_mae, 12.0, 3.0), (compression_mae, 8.0, 2.0)):
        if cols:
            tr, va = F.col(cols[0]), F.col(cols[1])
            reg = reg + F.when(va > limit, (va - limit) * 2).otherwise(0.0) + F.when(F.abs(tr - va) > slack, (F.abs(tr - va) - slack) * 1.5).otherwise(0.0)
    few = F.when(made < 120, (120 - made) * 0.2).otherwise(0.0)
    rate = F.when(none > 0.50, (none - 0.50) * 100).when(none < 0.20, (0.20 - none) * 50).otherwise(0.0)
    return F.when(made < min_decisions, 999.0).otherwise(acc + off + lopsided + gap + reg + few + rate)


def sum_columns(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out
