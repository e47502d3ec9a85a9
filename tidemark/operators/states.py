"""Users in states over windows: grids, transitions, spells, hazards, flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

INACTIVE, NOT_YET = "Inactive", "Not-yet-active"


def user_window_grid(states: DataFrame, windows: DataFrame, user: str = "user_key", index: str = "window_index", state: str = "state", fill: str = INACTIVE) -> DataFrame:
    """Every user in every window; the state where there is none is `fill`. windows is a short specification."""
    users = states.select(user).distinct()
    return users.crossJoin(F.broadcast(windows)).join(states.select(user, index, state), [user, index], "left").withColumn(state, F.coalesce(state, F.lit(fill)))


def life_state(active: Column, first_active: Column, window_start: Column) -> Column:
    """The cluster while active; before the first comment not yet active, afterwards inactive."""
    return F.coalesce(active, F.when(first_active >= window_start, F.lit(NOT_YET)).otherwise(F.lit(INACTIVE)))


def transitions(states: DataFrame, user: str = "user_key", index: str = "window_index", state: str = "state", carry: Sequence[str] = ()) -> DataFrame:
    """A row for each step to a user's next window: current_*, future_* of index, state and the carried columns."""
    order = W.partitionBy(user).orderBy(index)
    cols = [index, state, *carry]
    out = states.select(user, *[F.col(c).alias(f"current_{c}") for c in cols], *[F.lead(c).over(order).alias(f"future_{c}") for c in cols])
    return out.filter(F.col(f"future_{index}").isNotNull())


def transition_table(steps: DataFrame, names: Sequence[str], state: str = "state", by: Sequence[str] = ()) -> DataFrame:
    """from_state, to_state, n, probability over the whole grid of names; a state without exits has probability 0."""
    cells = F.array(*[F.lit(n) for n in names])
    counted = steps.groupBy(*by, F.col(f"current_{state}").alias("from_state")).agg(*[F.count(F.when(F.col(f"future_{state}") == n, 1)).alias(f"st_{i}") for i, n in enumerate(names)])
    wide = F.array(*[F.col(f"st_{i}") for i in range(len(names))])
    groups = (steps.select(*by).distinct() if by else steps.sparkSession.range(1).select()).select(*by, F.explode(cells).alias("from_state"))
    full = groups.join(counted, [*by, "from_state"], "left")
    total = sum((F.coalesce(F.col(f"st_{i}"), F.lit(0)) for i in range(len(names))), F.lit(0))
    rows = full.select(*by, "from_state", total.alias("total"), F.posexplode(cells).alias("st_at", "to_state"), wide.alias("st_wide"))
    n = F.coalesce(F.get("st_wide", F.col("st_at")), F.lit(0))
    return rows.select(*by, "from_state", "to_state", n.cast("long").alias("n"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0).alias("probability"))


def block_transitions(states: DataFrame, size: int, last_index: int, user: str = "user_key", index: str = "window_index", state: str = "state") -> DataFrame:
    """Steps between neighbouring windows of one block of `size` windows (from index 1); an incomplete last block is left out."""
    block = F.floor((F.col(index) - 1) / size).cast("int")
    rows = states.withColumn("block", block).filter((F.col("block") + 1) * size <= last_index)
    order = W.partitionBy(user, "block").orderBy(index)
    nxt = F.lead(F.struct(index, state)).over(order)
    return rows.select(user, "block", F.col(index).alias(f"current_{index}"), F.col(state).alias(f"current_{state}"), nxt.alias("st_next")).filter(F.col(f"st_next.{index}") == F.col(f"current_{index}") + 1).select(user, "block", f"current_{state}", F.col(f"st_next.{state}").alias(f"future_{state}"))


def spells(states: DataFrame, user: str = "user_key", index: str = "window_index", state: str = "state") -> DataFrame:
    """Runs of one state: spell_number, state, start_index, end_index, duration, next_state, is_censored, has_exit."""
    order = W.partitionBy(user).orderBy(index)
    fresh = (~F.col(state).eqNullSafe(F.lag(state).over(order)) | F.lag(index).over(order).isNull()).cast("int")
    runs = states.withColumn("st_new", fresh).withColumn("spell_number", F.sum("st_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = runs.groupBy(user, "spell_number").agg(F.first(state).alias(state), F.min(index).alias("start_index"), F.max(index).alias("end_index"), F.count(F.lit(1)).alias("duration"))
    out = out.withColumn("next_state", F.lead(state).over(W.partitionBy(user).orderBy("spell_number")))
    return out.withColumns({"is_censored": F.col("next_state").isNull(), "has_exit": F.col("next_state").isNotNull()})


def _times(weight: str | None) -> Column:
    """How many runs a row stands for."""
    return F.lit(1).cast("long") if weight is None else F.col(weight)


def hazards(runs: DataFrame, state: str = "state", weight: str | None = None) -> DataFrame:
    """Discrete life table: at_risk, exits, censored, hazard for each state and duration from 1 to the state's longest. weight: how many runs a row stands for."""
    w = _times(weight)
    sizes = runs.groupBy(state, "duration").agg(F.sum(w).alias("n"), F.sum(F.when(F.col("has_exit"), w).otherwise(0)).alias("exits"), F.sum(F.when(F.col("has_exit"), 0).otherwise(w)).alias("censored"))
    longest = sizes.groupBy(state).agg(F.max("duration").alias("m"))
    grid = longest.select(state, F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("duration"))
    full = grid.join(sizes, [state, "duration"], "left").fillna(0, ["n", "exits", "censored"])
    at_risk = F.sum("n").over(W.partitionBy(state).orderBy("duration").rowsBetween(W.currentRow, W.unboundedFollowing))
    return full.select(state, "duration", at_risk.alias("at_risk"), "exits", "censored").withColumn("hazard", F.col("exits") / F.col("at_risk"))


def survival(table: DataFrame, durations: Sequence[int] = (2, 3, 4), state: str = "state") -> DataFrame:
    """prob_d_ge_m: the product of (1 - hazard) below m; 0 where the table doesn't reach that far."""
    picked = []
    for m in durations:
        known = F.count(F.when(F.col("duration") == m - 1, 1))
        picked.append(F.when(known > 0, F.product(F.when(F.col("duration") < m, 1 - F.col("hazard")))).otherwise(0.0).alias(f"prob_d_ge_{m}"))
    return table.groupBy(state).agg(*picked)


def durations(runs: DataFrame, state: str = "state", digits: int = 4) -> DataFrame:
    d = F.col("duration")
    return runs.groupBy(state).agg(
        F.count(F.lit(1)).alias("spells"), F.count(F.when(F.col("has_exit"), 1)).alias("completed"), F.count(F.when(F.col("is_censored"), 1)).alias("censored"),
        F.bround(F.avg(d), digits).alias("mean_duration"), F.bround(F.median(d), digits).alias("median_duration"), F.max(d).alias("max_duration"),
    )


def exit_destinations(runs: DataFrame, state: str = "state", weight: str | None = None) -> DataFrame:
    """state, next_state, n, exit_probability among spells that ended."""
    n = runs.filter("has_exit").groupBy(state, "next_state").agg(F.sum(_times(weight)).alias("n"))
    return n.withColumn("exit_probability", F.col("n") / F.sum("n").over(W.partitionBy(state)))


def top_exits(destinations: DataFrame, k: int = 3, state: str = "state") -> DataFrame:
    """top_1, p_1, ... top_k, p_k of each state; equal probabilities in the order of next_state."""
    rank = F.row_number().over(W.partitionBy(state).orderBy(F.desc("exit_probability"), "next_state"))
    ranked = destinations.withColumn("st_rank", rank).filter(F.col("st_rank") <= k)
    return ranked.groupBy(state).agg(*[f for i in range(1, k + 1) for f in (F.max(F.when(F.col("st_rank") == i, F.col("next_state"))).alias(f"top_{i}"), F.max(F.when(F.col("st_rank") == i, F.col("exit_probability"))).alias(f"p_{i}"))])


def exit_risks(runs: DataFrame, state: str = "state", idle: Sequence[str] = (INACTIVE, NOT_YET)) -> DataFrame:
    """For active states: chance to leave at once, and where to; role: by whether leaving is likely and leads to inactivity.

    Runs are counted once, by state, duration and next state. Those counts are kept, as filters pushed below them would
    make each part compute the runs anew; they have at most states * windows * states rows.
    """
    sized = runs.groupBy(state, "duration", "next_state").agg(F.count(F.lit(1)).alias("st_n")).withColumn("has_exit", F.col("next_state").isNotNull()).persist()
    table = survival(hazards(sized, state, "st_n"), (2,), state)
    mean = sized.groupBy(state).agg(F.bround(F.sum(F.col("duration") * F.col("st_n")) / F.sum("st_n"), 4).alias("mean_duration"))
    out = exit_destinations(sized, state, "st_n").filter(~F.col(state).isin(*idle))
    active = ~F.col("next_state").isin(*idle)
    best = F.max_by(F.when(active, F.col("next_state")), F.when(active, F.struct("exit_probability", F.col("n"))))
    to = out.groupBy(state).agg(
        F.coalesce(F.sum(F.when(F.col("next_state") == INACTIVE, F.col("exit_probability"))), F.lit(0.0)).alias("to_inactive"),
        F.coalesce(F.sum(F.when(active, F.col("exit_probability"))), F.lit(0.0)).alias("to_active"),
        F.coalesce(F.max(F.when(active, F.col("exit_probability"))), F.lit(0.0)).alias("top_active_probability"), best.alias("top_active_state"),
    )
    joined = mean.join(table, state).filter(~F.col(state).isin(*idle)).join(to, state, "left").fillna(0.0, ["to_inactive", "to_active", "top_active_probability"])
    return joined.withColumn("exit_within_1", 1 - F.col("prob_d_ge_2")).drop("prob_d_ge_2")


def flows(states: DataFrame, checkpoints: Sequence[int], user: str = "user_key", index: str = "window_index", state: str = "state", idle: str = INACTIVE) -> DataFrame:
    """stage, source, target, n: users between consecutive checkpoints, without those idle at every one."""
    at = states.filter(F.col(index).isin(*checkpoints)).groupBy(user).agg(*[F.max(F.when(F.col(index) == c, F.col(state))).alias(f"st_{i}") for i, c in enumerate(checkpoints)])
    some = F.lit(False)
    for i in range(len(checkpoints)):
        some |= F.coalesce(F.col(f"st_{i}"), F.lit(idle)) != idle
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.coalesce(F.col(f"st_{i}"), F.lit(idle)).alias("source"), F.coalesce(F.col(f"st_{i + 1}"), F.lit(idle)).alias("target")) for i in range(len(checkpoints) - 1)]))
    return at.filter(some).select(steps.alias("s")).groupBy("s.stage", "s.source", "s.target").agg(F.count(F.lit(1)).alias("n"))
