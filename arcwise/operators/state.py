"""State tables over series, and actions scored against each state.

Conditions and formulas are Spark SQL over the state's columns. They come from the program's own
configuration and must never be taken from outside input.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwise.functions import geometry as g
from arcwise.operators.path import EFFECTOR_PATHS, PathColumns, curvature, flag_crossovers, with_neighbours
from arcwise.operators.series import MAX_ROWS, Series

# -- state parameters ---------------------------------------------------------------------------

# All of these are combined on the map side, so one large group is no burden for a single task.
AGGREGATES = {
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "count": F.count,
    "stddev": F.stddev,
    "variance": F.variance,
}


@dataclass(frozen=True)
class StateParam:
    """One parameter: aggregate ``value_col`` of table ``source`` per ``group_by``."""

    param_name: str
    source: str
    group_by: tuple[str, ...]
    value_col: str
    aggregation: str = "max"


def state_param(tables: Mapping[str, DataFrame], param: StateParam) -> DataFrame:
    """The parameter's value per group, named after the first grouping column."""
    if param.aggregation not in AGGREGATES:
        raise ValueError(f"unknown aggregation {param.aggregation!r}; known: {sorted(AGGREGATES)}")
    value = AGGREGATES[param.aggregation](param.value_col)
    return (
        tables[param.source]
        .groupBy(*param.group_by)
        .agg(value.alias("value"))
        .select(
            F.col(param.group_by[0]).cast("string").alias("state_id"),
            F.col("value").cast("double").alias("param_value"),
            F.lit(param.param_name).alias("param_name"),
        )
    )


def state_params(tables: Mapping[str, DataFrame], params: list[StateParam]) -> DataFrame:
    """All parameters stacked into one long table."""
    return reduce(DataFrame.unionByName, [state_param(tables, param) for param in params])


# -- state of a path ----------------------------------------------------------------------------


@dataclass(frozen=True)
class StateVariable:
    name: str
    kind: str
    default: str = "NULL"


# The variables of a state and what they hold before anything is known.
STATE_VARIABLES = (
    StateVariable("sample_moments", "array<double>", "array()"),
    StateVariable("sample_positions", "array<struct<x:double,y:double>>", "array()"),
    StateVariable("curvature_sample_indices", "array<array<bigint>>", "array()"),
    StateVariable("curvature_magnitudes", "array<double>", "array()"),
    StateVariable("lowest_curvature_magnitude", "double"),
    StateVariable("curvature_sign_change", "boolean", "false"),
    StateVariable("guessed_zero_crossing", "double"),
    StateVariable("verified_guessed_zero_crossing", "boolean"),
    StateVariable("true_zero_crossing", "double"),
    StateVariable("action_taken", "string"),
)


def with_defaults(state: DataFrame, variables: tuple[StateVariable, ...] = STATE_VARIABLES) -> DataFrame:
    """Fill variables that are NULL or missing with their defaults."""
    present = set(state.columns)
    filled = {}
    for variable in variables:
        default = F.expr(variable.default).cast(variable.kind)
        filled[variable.name] = (
            F.coalesce(F.col(variable.name).cast(variable.kind), default)
            if variable.name in present
            else default
        )
    return state.withColumns(filled)


def state_features(
    points: DataFrame | Series,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """One row per path: sample count, curvature count, lowest magnitude, sign change, zero crossing.

    Curvatures are those of points with both neighbours. The zero crossing is guessed on the straight
    line between the two curvatures around the first change of sign. The samples themselves are held in
    the pages of ``samples.state_samples``, which new samples can be folded into.
    """
    series = with_neighbours(points, columns, max_rows)
    inner = F.col("prev_x").isNotNull() & F.col("next_x").isNotNull()
    series = series.select(
        *columns.point, inner.alias("is_inner"), curvature(columns).alias("curvature")
    )
    series = flag_crossovers(series, digits).neighbours(previous={"time_before": columns.time})
    time, before = F.col(columns.time), F.col("time_before")
    size, size_before = F.abs("level"), F.abs("level_before")
    crossing = before + (time - before) * (size_before / (size_before + size))
    crossing = F.when(F.col("is_crossover"), crossing)
    magnitude = F.when(F.col("is_inner"), F.abs("curvature"))
    return (
        series.table()
        .groupBy(*columns.keys)
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.count(magnitude).alias("curvature_count"),
            F.min(magnitude).alias("lowest_curvature_magnitude"),
            F.coalesce(F.bool_or("is_crossover"), F.lit(False)).alias("curvature_sign_change"),
            F.min_by(crossing, F.when(F.col("is_crossover"), F.struct(*columns.order))).alias(
                "guessed_zero_crossing"
            ),
        )
    )


# -- actions ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reward:
    """Counts only where all ``defer_conditions`` hold, that is once its inputs are known."""

    formula: str
    defer_conditions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Action:
    id: str
    conditions: tuple[str, ...]
    rewards: tuple[Reward, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Policy:
    method: str
    value: float

    def factor(self) -> float:
        if self.method == "epsilon_greedy":
            return 1 - self.value
        if self.method == "max_reward":
            return self.value
        raise ValueError(f"unknown policy {self.method!r}")


_GUESS_REWARDS = (
    Reward("0"),
    Reward(
        "CASE WHEN verified_guessed_zero_crossing THEN 5 ELSE -5 END",
        ("verified_guessed_zero_crossing IS NOT NULL",),
    ),
    Reward(
        "15 / (1 + abs(CAST(verified_guessed_zero_crossing AS INT) - true_zero_crossing))",
        ("verified_guessed_zero_crossing IS NOT NULL", "true_zero_crossing IS NOT NULL"),
    ),
)

# The actions, when they apply and what they earn.
ACTIONS = (
    Action("add_4_samples", ("curvature_count = 0",), _GUESS_REWARDS),
    Action("make_guess", ("curvature_count >= 2", "guessed_zero_crossing IS NOT NULL"), _GUESS_REWARDS),
    Action(
        "add_4_samples_at_guess__bounded",
        ("curvature_sign_change = true", "guessed_zero_crossing IS NOT NULL"),
        (Reward("5"),),
    ),
    Action(
        "add_4_samples_at_guess__unbounded",
        ("curvature_sign_change = false", "guessed_zero_crossing IS NOT NULL"),
        (Reward("5"),),
    ),
)

# The policies and their parameters, applied in this order.
POLICIES = (Policy("epsilon_greedy", 0.2), Policy("max_reward", 0.95))


def _all_hold(conditions: tuple[str, ...]) -> Column:
    holds = (F.coalesce(F.expr(f"({condition})"), F.lit(False)) for condition in conditions)
    return reduce(lambda a, b: a & b, holds, F.lit(True))


def _scored(order: int, action: Action, policies: tuple[Policy, ...]) -> Column:
    eligible = _all_hold(action.conditions)
    zero = F.lit(0.0)
    earned = (
        F.when(_all_hold(reward.defer_conditions), F.expr(reward.formula).cast("double")).otherwise(zero)
        for reward in action.rewards
    )
    reward = F.when(eligible, reduce(lambda a, b: a + b, earned, zero)).otherwise(zero)
    score = reduce(lambda value, policy: value * F.lit(policy.factor()), policies, reward)
    return F.struct(
        F.lit(order).alias("action_order"),
        F.lit(action.id).alias("action_id"),
        eligible.alias("eligible"),
        reward.alias("reward"),
        score.alias("score"),
        score.cast("int").alias("priority"),
    )


def score_actions(
    states: DataFrame,
    keys: list[str],
    actions: tuple[Action, ...] = ACTIONS,
    policies: tuple[Policy, ...] = POLICIES,
) -> DataFrame:
    """One row per state and action: eligible, reward, score after the policies, priority.

    The actions are a fixed short list, so every state row unfolds into them in place; there is no
    join and no shuffle.
    """
    options = F.array(*[_scored(order, action, policies) for order, action in enumerate(actions)])
    return states.select(*keys, F.explode(options).alias("option")).select(*keys, "option.*")


def rank_actions(
    states: DataFrame,
    keys: list[str],
    actions: tuple[Action, ...] = ACTIONS,
    policies: tuple[Policy, ...] = POLICIES,
) -> DataFrame:
    """The actions of each state by falling priority (then in their given order), and the total.

    A state has a handful of actions, all on its own row: they are ranked by sorting that array.
    """
    options = F.array(*[_scored(order, action, policies) for order, action in enumerate(actions)])
    by_rank = F.array_sort(
        F.transform("options", lambda o: F.struct((-o["priority"]).alias("down"), o["action_order"].alias("o"), o.alias("option")))
    )
    total = F.aggregate("options", F.lit(0), lambda sum_, o: sum_ + o["priority"])
    return (
        states.select(*keys, options.alias("options"))
        .select(*keys, total.alias("total_priority"), F.posexplode(by_rank).alias("place", "ranked"))
        .select(
            *keys,
            F.col("ranked.option.action_id").alias("action_id"),
            F.col("ranked.option.priority").alias("priority"),
            (F.col("place") + 1).alias("rank"),
            "total_priority",
        )
    )
