"""Sliding windows, states, transitions, spells, hazards, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import levels, metrics, states, temporal
from .bindings import EV, WINDOWS, Query, comments, posts, rounded, rounded_sql, window_values

NAMES = ["Casual", "Regular", "Devoted", "Inactive"]
BLOCK = 4


def window_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(temporal.explode_windows(x, "ts", WINDOWS) for x in (comments(spark, d), posts(spark, d)))


def metrics_of(spark: SparkSession, d: str) -> DataFrame:
    """Posts with at least one comment count; recency is a number of posts."""
    c, p = window_rows(spark, d)
    p = p.join(comments(spark, d).select("media_id").distinct(), "media_id", "left_semi")
    out = metrics.engagement_metrics(c, p, by="window_id", min_comments=2, recency="count")
    return out.select("window_id", F.substring("window_id", 2, 9).cast("int").alias("window_index"), "user_key", "comment_count", F.col("recency").cast("long").alias("recency"), F.col("frequency").cast("long").alias("frequency"), "engagement")


def _state(m: DataFrame) -> DataFrame:
    s = F.when((F.col("frequency") <= 6) & (F.col("engagement") < 50), "Casual").when(F.col("frequency") <= 10, "Regular").otherwise("Devoted")
    return m.select("user_key", "window_index", s.alias("state"))


def user_states(spark: SparkSession, d: str) -> DataFrame:
    return _state(rounded(metrics_of(spark, d)))


def grid(spark: SparkSession, d: str) -> DataFrame:
    windows = temporal.interval_table(spark, WINDOWS).select("window_index", "window_start")
    return states.user_window_grid(user_states(spark, d), windows)


_SEEN = f"""WITH {EV}, w AS (SELECT * FROM {window_values(WINDOWS)}), pc AS (SELECT * FROM p WHERE media_id IN (SELECT media_id FROM c)),
cw AS (SELECT c.*, w.window_id, w.window_index FROM c JOIN w ON c.ts >= w.window_start AND c.ts < w.window_end + 1), pw AS (SELECT pc.*, w.window_id FROM pc JOIN w ON pc.ts >= w.window_start AND pc.ts < w.window_end + 1),
n AS (SELECT window_id, count(*) AS np FROM pw GROUP BY 1),
s AS (SELECT * FROM (SELECT *, sum(1 - tag) OVER (PARTITION BY window_id ORDER BY ts, tag ROWS UNBOUNDED PRECEDING) AS posts_seen FROM (SELECT comment_id, user_key, media_id, ts, words, window_id, window_index, 1 AS tag FROM cw UNION ALL BY NAME SELECT ts, window_id, 0 AS tag FROM pw)) WHERE tag = 1),
m AS (SELECT window_id, window_index, user_key, count(*)::BIGINT AS comment_count, (max(np) - arg_max(posts_seen, (ts, comment_id)))::BIGINT AS recency, count(DISTINCT media_id)::BIGINT AS frequency, avg(words) AS engagement FROM s JOIN n USING (window_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
_STATES = f"{_SEEN}, st AS (SELECT user_key, window_index, CASE WHEN frequency <= 6 AND round(engagement, 9) < 50 THEN 'Casual' WHEN frequency <= 10 THEN 'Regular' ELSE 'Devoted' END AS state FROM m)"
_FULL = f"{_STATES}, g AS (SELECT u.user_key, w.window_index, w.window_start, coalesce(st.state, 'Inactive') AS state FROM (SELECT DISTINCT user_key FROM st) u CROSS JOIN w LEFT JOIN st ON st.user_key = u.user_key AND st.window_index = w.window_index)"
_STEPS = f"{_FULL}, t AS (SELECT * FROM (SELECT user_key, window_index AS current_window_index, state AS current_state, lead(window_index) OVER x AS future_window_index, lead(state) OVER x AS future_state FROM g WINDOW x AS (PARTITION BY user_key ORDER BY window_index)) WHERE future_window_index IS NOT NULL)"
_NAMES = "(VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ")"
_SPELLS = f"""{_FULL}, f AS (SELECT *, CASE WHEN lag(state) OVER x IS NULL OR lag(state) OVER x <> state THEN 1 ELSE 0 END AS fresh FROM g WINDOW x AS (PARTITION BY user_key ORDER BY window_index)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_key ORDER BY window_index ROWS UNBOUNDED PRECEDING) AS spell_number FROM f),
a AS (SELECT user_key, spell_number::BIGINT AS spell_number, min(state) AS state, min(window_index) AS start_index, max(window_index) AS end_index, count(*)::BIGINT AS duration FROM i GROUP BY user_key, spell_number),
sp AS (SELECT *, lead(state) OVER (PARTITION BY user_key ORDER BY spell_number) AS next_state FROM a),
hz AS (SELECT state, duration, (sum(n) OVER (PARTITION BY state ORDER BY duration DESC))::BIGINT AS at_risk, exits, censored FROM (
  SELECT g.state, g.duration, coalesce(n, 0) AS n, coalesce(exits, 0)::BIGINT AS exits, coalesce(censored, 0)::BIGINT AS censored FROM (SELECT state, unnest(range(1, max(duration) + 1)) AS duration FROM sp GROUP BY state) g
  LEFT JOIN (SELECT state, duration, count(*) AS n, count(next_state) AS exits, count(*) FILTER (next_state IS NULL) AS censored FROM sp GROUP BY 1, 2) z ON z.state = g.state AND z.duration = g.duration)),
sv AS (SELECT state, {', '.join(f'CASE WHEN count(*) FILTER (duration = {m - 1}) > 0 THEN product(CASE WHEN duration < {m} THEN 1 - exits::DOUBLE / at_risk END) ELSE 0.0 END AS prob_d_ge_{m}' for m in (2, 3, 4))} FROM hz GROUP BY state),
xd AS (SELECT state, next_state, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY state) AS exit_probability FROM sp WHERE next_state IS NOT NULL GROUP BY 1, 2)"""


def sliding_window_metrics(spark, d):
    return rounded(metrics_of(spark, d))


def window_table(spark, d):
    p = temporal.explode_windows(posts(spark, d), "ts", WINDOWS).groupBy("window_id").agg(F.count(F.lit(1)).alias("posts_in_window"))
    w = temporal.interval_table(spark, WINDOWS).join(p, "window_id", "left").fillna(0, ["posts_in_window"])
    return w.select("window_id", "window_index", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"), "window_total_days", "posts_in_window")


def user_window_grid(spark, d):
    return grid(spark, d).groupBy("window_index", "state").agg(F.count(F.lit(1)).alias("users"))


def state_matrix(spark, d):
    """Before a user's first comment: not yet active."""
    first = comments(spark, d).groupBy("user_key").agg(F.min("ts").alias("first_ts"))
    g = grid(spark, d).join(first, "user_key")
    active = F.when(F.col("state") != "Inactive", F.col("state"))
    return g.select("user_key", "window_index", states.life_state(active, F.col("first_ts"), F.col("window_start").cast("timestamp_ntz")).alias("state"))


def transitions_long(spark, d):
    return states.transitions(grid(spark, d))


def _table(spark, d):
    return states.transition_table(states.transitions(grid(spark, d)), NAMES)


def transition_counts(spark, d):
    return _table(spark, d).select("from_state", "to_state", "n")


def transition_probabilities(spark, d):
    return rounded(_table(spark, d).select("from_state", "to_state", "probability"))


def block_transitions(spark, d):
    steps = states.block_transitions(grid(spark, d), BLOCK, len(WINDOWS))
    return steps.groupBy("block", "current_state", "future_state").agg(F.count(F.lit(1)).alias("n"))


def _runs(spark, d):
    return states.spells(grid(spark, d))


def spells(spark, d):
    return _runs(spark, d)


def discrete_hazard(spark, d):
    return rounded(states.hazards(_runs(spark, d)))


def survival_tail(spark, d):
    return rounded(states.survival(states.hazards(_runs(spark, d))))


def duration_summary(spark, d):
    return states.durations(_runs(spark, d))


def exit_destinations(spark, d):
    return rounded(states.exit_destinations(_runs(spark, d)))


def top_exits(spark, d):
    return rounded(states.top_exits(states.exit_destinations(_runs(spark, d))))


def exit_risk_summary(spark, d):
    return rounded(states.exit_risks(_runs(spark, d)))


def checkpoint_flows(spark, d):
    return states.flows(grid(spark, d), [1, 8, 16, 24])


def _levels(spark, d):
    m = rounded(metrics_of(spark, d))
    return m.select("user_key", levels.three_levels(F.col("recency"), 50, 200, missing="Mid", names=("Low", "Mid", "High")).alias("recency"), levels.three_levels(F.col("frequency"), 8, 12, missing="Mid", names=("Low", "Mid", "High")).alias("frequency"), levels.three_levels(F.col("engagement"), 40.0, 60.0, strict=True, missing="Mid", names=("Low", "Mid", "High")).alias("engagement"))


def user_level_counts(spark, d):
    return levels.level_counts(_levels(spark, d), "user_key", ["recency", "frequency", "engagement"])


_LV = {"recency": "CASE WHEN recency <= 50 THEN 'Low' WHEN recency <= 200 THEN 'Mid' ELSE 'High' END", "frequency": "CASE WHEN frequency <= 8 THEN 'Low' WHEN frequency <= 12 THEN 'Mid' ELSE 'High' END", "engagement": "CASE WHEN round(engagement, 9) < 40 THEN 'Low' WHEN round(engagement, 9) < 60 THEN 'Mid' ELSE 'High' END"}
_IDLE = "('Inactive', 'Not-yet-active')"

QUERIES: dict[str, Query] = {
    "sliding_window_metrics": (sliding_window_metrics, rounded_sql(f"{_SEEN} --main SELECT * FROM m", "engagement")),
    "window_table": (window_table, f"WITH {EV}, w AS (SELECT * FROM {window_values(WINDOWS)}) SELECT window_id, window_index, window_start::VARCHAR AS window_start, window_end::VARCHAR AS window_end, window_total_days, count(p.ts)::BIGINT AS posts_in_window FROM w LEFT JOIN p ON p.ts >= w.window_start AND p.ts < w.window_end + 1 GROUP BY ALL"),
    "user_window_grid": (user_window_grid, f"{_FULL} SELECT window_index, state, count(*)::BIGINT AS users FROM g GROUP BY 1, 2"),
    "state_matrix": (state_matrix, f"{_FULL}, fi AS (SELECT user_key, min(ts) AS first_ts FROM c GROUP BY 1) SELECT user_key, window_index, CASE WHEN state <> 'Inactive' THEN state WHEN first_ts >= window_start THEN 'Not-yet-active' ELSE 'Inactive' END AS state FROM g JOIN fi USING (user_key)"),
    "transitions_long": (transitions_long, f"{_STEPS} SELECT * FROM t"),
    "transition_counts": (transition_counts, f"{_STEPS} SELECT a.s AS from_state, b.s AS to_state, count(t.user_key)::BIGINT AS n FROM {_NAMES} a(s) CROSS JOIN {_NAMES} b(s) LEFT JOIN t ON t.current_state = a.s AND t.future_state = b.s GROUP BY 1, 2"),
    "transition_probabilities": (transition_probabilities, rounded_sql(f"{_STEPS}, n AS (SELECT a.s AS from_state, b.s AS to_state, count(t.user_key) AS n FROM {_NAMES} a(s) CROSS JOIN {_NAMES} b(s) LEFT JOIN t ON t.current_state = a.s AND t.future_state = b.s GROUP BY 1, 2) --main SELECT from_state, to_state, coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY from_state), 0), 0) AS probability FROM n".replace(", n AS (SELECT a.s", ", tn AS (SELECT a.s").replace("FROM n", "FROM tn"), "probability")),
    "block_transitions": (block_transitions, f"{_STEPS} SELECT ((current_window_index - 1) // {BLOCK})::INT AS block, current_state, future_state, count(*)::BIGINT AS n FROM t WHERE (current_window_index - 1) // {BLOCK} = (future_window_index - 1) // {BLOCK} AND ((current_window_index - 1) // {BLOCK} + 1) * {BLOCK} <= {len(WINDOWS)} GROUP BY 1, 2, 3"),
    "spells": (spells, f"{_SPELLS} SELECT *, next_state IS NULL AS is_censored, next_state IS NOT NULL AS has_exit FROM sp"),
    "discrete_hazard": (discrete_hazard, rounded_sql(f"{_SPELLS} --main SELECT *, exits::DOUBLE / at_risk AS hazard FROM hz", "hazard")),
    "survival_tail": (survival_tail, rounded_sql(f"{_SPELLS} --main SELECT * FROM sv", "prob_d_ge_2", "prob_d_ge_3", "prob_d_ge_4")),
    "duration_summary": (duration_summary, f"{_SPELLS} SELECT state, count(*)::BIGINT AS spells, count(next_state)::BIGINT AS completed, count(*) FILTER (next_state IS NULL)::BIGINT AS censored, round_even(avg(duration), 4) AS mean_duration, round_even(quantile_cont(duration::DOUBLE, 0.5), 4) AS median_duration, max(duration)::BIGINT AS max_duration FROM sp GROUP BY state"),
    "exit_destinations": (exit_destinations, rounded_sql(f"{_SPELLS} --main SELECT * FROM xd", "exit_probability")),
    "top_exits": (top_exits, rounded_sql(f"{_SPELLS}, rk AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY exit_probability DESC, next_state) AS rn FROM xd) --main SELECT state, {', '.join(f'max(next_state) FILTER (rn = {i}) AS top_{i}, max(exit_probability) FILTER (rn = {i}) AS p_{i}' for i in (1, 2, 3))} FROM rk GROUP BY state", "p_1", "p_2", "p_3")),
    "exit_risk_summary": (
        exit_risk_summary,
        rounded_sql(f"""{_SPELLS}, du AS (SELECT state, round_even(avg(duration), 4) AS mean_duration FROM sp GROUP BY state),
        ex AS (SELECT state, coalesce(sum(exit_probability) FILTER (next_state = 'Inactive'), 0) AS to_inactive, coalesce(sum(exit_probability) FILTER (next_state NOT IN {_IDLE}), 0) AS to_active, coalesce(max(exit_probability) FILTER (next_state NOT IN {_IDLE}), 0) AS top_active_probability, arg_max(next_state, exit_probability) FILTER (next_state NOT IN {_IDLE}) AS top_active_state FROM xd GROUP BY state) --main
        SELECT du.state, mean_duration, coalesce(to_inactive, 0) AS to_inactive, coalesce(to_active, 0) AS to_active, coalesce(top_active_probability, 0) AS top_active_probability, top_active_state, 1 - prob_d_ge_2 AS exit_within_1 FROM du JOIN sv USING (state) LEFT JOIN ex USING (state) WHERE du.state NOT IN {_IDLE}""", "mean_duration", "to_inactive", "to_active", "top_active_probability", "exit_within_1"),
    ),
    "checkpoint_flows": (
        checkpoint_flows,
        f"""{_FULL}, a AS (SELECT user_key, {', '.join(f"max(state) FILTER (window_index = {c}) AS s{i}" for i, c in enumerate((1, 8, 16, 24)))} FROM g GROUP BY user_key), ok AS (SELECT * FROM a WHERE NOT (s0 = 'Inactive' AND s1 = 'Inactive' AND s2 = 'Inactive' AND s3 = 'Inactive'))
        {' UNION ALL '.join(f"SELECT {i + 1} AS stage, s{i} AS source, s{i + 1} AS target, count(*)::BIGINT AS n FROM ok GROUP BY 1, 2, 3" for i in range(3))}""",
    ),
    "user_level_counts": (user_level_counts, f"{_SEEN}, l AS (SELECT user_key, {', '.join(f'{e} AS {m}' for m, e in _LV.items())} FROM m) SELECT user_key, {', '.join(f'count(*) FILTER ({m} = {chr(39)}{v}{chr(39)})::BIGINT AS {m}_{v.lower()}' for m in _LV for v in ('Low', 'Mid', 'High'))} FROM l GROUP BY user_key"),
}
