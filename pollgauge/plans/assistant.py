"""Registered queries: assistant scenarios and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollgauge.config import FEED, PERIOD_SERIES, STATION, US
from pollgauge.operators import answers as A, inject
from pollgauge.plans import common as K
from pollgauge.plans import faults as X
from pollgauge.plans.catalog import query, view
from pollgauge.session import materialise, work_path
from pollgauge.sources import adapters, snapshots as S

PK = (*PERIOD_SERIES, US)
KEYS = ", ".join(A.ANSWER_KEYS)

view("spots", """
SELECT feed_id || '-' || station_id || '-' || us AS scenario_id, num_bikes_available AS b, num_docks_available AS d FROM flagged WHERE jump_flag""")
view("answer_cells", f"""
SELECT *, {K.hash_sql("'answer|' || model || '|' || rep || '|' || scenario_id || '|' || condition || '|' || config")} AS h,
  {K.hash_sql("'p|' || scenario_id")} % 100 AS p, {K.hash_sql("'flip|' || scenario_id")} AS drawn
FROM spots CROSS JOIN (VALUES ('m1'), ('m2')) m(model) CROSS JOIN (VALUES (0), (1)) r(rep)
CROSS JOIN (VALUES ('clean'), ('corrupted'), ('corrupted_flagged')) c(condition) CROSS JOIN (VALUES ('blind'), ('aware')) g(config)""")
view("answers", f"""
SELECT model, rep, scenario_id, condition, config, drawn % 2 = 0 AS flip,
  CASE WHEN drawn % 3 = 0 THEN 'dispatch' ELSE 'no_dispatch' END AS true_decision,
  'bikes ' || b || ' docks ' || d || ' p = 0.' || lpad(p::VARCHAR, 2, '0') AS tool_output,
  CASE WHEN h % 13 = 0 THEN 'I cannot decide.' WHEN h % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS reply
FROM (SELECT *, '{{"decision": "' || CASE WHEN h % 11 = 0 THEN 'maybe' WHEN h % 3 = 0 THEN 'dispatch' WHEN h % 3 = 1 THEN 'no_dispatch' ELSE 'abstain' END
  || '", "data_quality_warning": ' || CASE WHEN h % 17 = 0 THEN '"true"' WHEN (h // 3) % 2 = 1 THEN 'true' ELSE 'false' END
  || ', "rationale": "' || CASE WHEN h % 7 = 0 THEN 'about 40.5 bikes' ELSE 'Probability 0.' || lpad(p::VARCHAR, 2, '0') || ' (' || p || '%) with bikes ' || b END
  || '"}}' AS body FROM answer_cells)""")
view("parsed", r"""
SELECT * EXCLUDE (body, ok), coalesce(ok, false) AS valid, CASE WHEN ok THEN json_extract_string(body, '$.decision') END AS decision,
  CASE WHEN ok THEN json_extract_string(body, '$.data_quality_warning') = 'true' END AS data_quality_warning,
  CASE WHEN ok THEN json_extract_string(body, '$.rationale') END AS rationale
FROM (SELECT *, json_type(body, '$.decision') = 'VARCHAR' AND json_extract_string(body, '$.decision') IN ('dispatch', 'no_dispatch', 'abstain')
    AND json_type(body, '$.data_quality_warning') = 'BOOLEAN' AND json_type(body, '$.rationale') = 'VARCHAR' AS ok
  FROM (SELECT *, CASE WHEN json_valid(b0) THEN b0 END AS body FROM (SELECT *, regexp_extract(reply, '\{.*\}', 0, 's') AS b0 FROM answers)))""")
view("rubric", r"""
SELECT *, list_has_all(shown || list_transform(list_filter(shown, lambda x: x < 1), lambda x: round(x * 100, 6)),
    list_transform(regexp_extract_all(rationale, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE)) AS grounded,
  data_quality_warning = (condition <> 'clean') AS warning_appropriate,
  (decision = 'abstain') = (condition <> 'clean' AND flip) AS abstention_correct,
  CASE WHEN condition <> 'clean' THEN decision = clean_decision END AS consistent,
  decision = true_decision AS correct_action, data_quality_warning AS warned, decision = 'abstain' AS abstained
FROM (SELECT *, list_transform(regexp_extract_all(tool_output, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS shown,
    max(CASE WHEN condition = 'clean' THEN decision END) OVER (PARTITION BY model, rep, scenario_id, config) AS clean_decision
  FROM parsed WHERE valid)""")


def answer_rows(spark, sf):
    """Answers as a written table, as the experiment leaves them."""
    return materialise(adapters.answers(K.flagged(spark, sf)), "answers")


def rubric_rows(spark, sf):
    return A.answer_rubric(A.parse_answer(answer_rows(spark, sf)).filter("valid"))


@query("answers_scan", f"SELECT {KEYS}, flip, true_decision, tool_output, reply FROM answers")
def answers_scan(spark, sf):
    path = work_path(spark, "answers")
    adapters.answers(K.flagged(spark, sf)).write.json(path)
    return S.answers_scan(spark, path)


@query("parse_answer", f"SELECT {KEYS}, valid, decision, data_quality_warning, rationale FROM parsed")
def parse_answer(spark, sf):
    return A.parse_answer(answer_rows(spark, sf)).select(
        *A.ANSWER_KEYS, "valid", "decision", "data_quality_warning", "rationale"
    )


@query("grounded", f"SELECT {KEYS}, grounded FROM rubric")
def grounded(spark, sf):
    rows = A.parse_answer(answer_rows(spark, sf)).filter("valid")
    return rows.select(*A.ANSWER_KEYS, A.grounded("rationale", "tool_output").alias("grounded"))


@query("answer_vs_clean", f"SELECT {KEYS}, decision, clean_decision FROM rubric")
def answer_vs_clean(spark, sf):
    rows = A.parse_answer(answer_rows(spark, sf)).filter("valid")
    return A.answer_vs_clean(rows).select(*A.ANSWER_KEYS, "decision", "clean_decision")


@query("answer_rubric", f"SELECT {KEYS}, {', '.join(A.RATES)} FROM rubric")
def answer_rubric(spark, sf):
    return rubric_rows(spark, sf).select(*A.ANSWER_KEYS, *A.RATES)


@query("answer_rates", f"""
SELECT model, config, condition, {", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in A.RATES)}, count(*) AS n FROM rubric GROUP BY 1, 2, 3""")
def answer_rates(spark, sf):
    return X.tidy(A.answer_rates(rubric_rows(spark, sf)), *A.RATES)


@query("answer_stability", """
SELECT model, round(avg(same::INT), 6) AS stable_share, count(*) AS cells FROM (
  SELECT model, count(DISTINCT decision) = 1 AND count(DISTINCT data_quality_warning) = 1 AS same
  FROM rubric GROUP BY model, scenario_id, condition, config) GROUP BY 1""")
def answer_stability(spark, sf):
    return X.tidy(A.answer_stability(rubric_rows(spark, sf)), "stable_share")


# ---- scenarios ------------------------------------------------------------------------------

_FLAG = """coalesce(abs(num_bikes_available - lag(num_bikes_available) OVER w) > (us - lag(us) OVER w) / 60000000.0::DOUBLE, false) AS jf"""
_W = "WINDOW w AS (PARTITION BY feed_id, period_id, station_id ORDER BY us)"
_EXTRA = ", ".join(
    ["*"] + [f"lag({c}, {k}) OVER w AS {n}{k}" for k in (1, 2, 5, 15) for c, n in (("us", "u"), ("jf", "f"))]
)


def _side(source: str) -> str:
    return K.lag_sql(f"(SELECT *, {_FLAG} FROM {source} {_W})", "feed_id, period_id, station_id", _EXTRA)


# One jump experiment over all periods: the strongest magnitude, first seed.
EXPERIMENT = "class5_jump__i3__seed0"
view("side_all", _side("certified"))
view("side_k", f"SELECT *, {K.PROBA} AS proba FROM ({_side('certified')})")
view("side_c", f"SELECT *, {K.PROBA} AS proba FROM ({_side("(SELECT * FROM jump_copies WHERE intensity_idx = 3)")})")


def _hhmm(us: str) -> str:
    return f"strftime(timezone('Europe/Rome', timezone('UTC', make_timestamp({us}))), '%H:%M')"


@query("reading_window", f"""
SELECT feed_id, period_id, station_id, us, 0 AS polls_ago, {_hhmm("us")} AS time, num_bikes_available AS bikes, num_docks_available AS docks, jf AS jump_flag FROM side_all
UNION ALL SELECT feed_id, period_id, station_id, us, 1, {_hhmm("u1")}, bikes_lag1, docks_lag1, f1 FROM side_all WHERE us - u1 <= 1350000000
UNION ALL SELECT feed_id, period_id, station_id, us, 2, {_hhmm("u2")}, bikes_lag2, docks_lag2, f2 FROM side_all WHERE us - u2 <= 2700000000
UNION ALL SELECT feed_id, period_id, station_id, us, 5, {_hhmm("u5")}, bikes_lag5, docks_lag5, f5 FROM side_all WHERE us - u5 <= 6750000000
UNION ALL SELECT feed_id, period_id, station_id, us, 15, {_hhmm("u15")}, bikes_lag15, docks_lag15, f15 FROM side_all WHERE us - u15 <= 20250000000""")
def reading_window(spark, sf):
    rows = A.side_view(K.certified(spark, sf), K.CFG, K.MODEL, adapters.weather(spark, sf))
    return rows.select(*PK, F.explode("readings").alias("r")).filter("r IS NOT NULL").select(*PK, "r.*")


_PAST = ", ".join(
    f"k.bikes_lag{k} AS kb{k}, k.docks_lag{k} AS kk{k}, k.u{k} AS ku{k}, c.bikes_lag{k} AS cb{k}, c.docks_lag{k} AS ck{k}, c.f{k}" for k in (1, 2, 5, 15)
)
view("candidates", f"""
SELECT k.feed_id, k.period_id, k.station_id, k.us, k.proba >= 0.4::DOUBLE AS kd, c.proba >= 0.4::DOUBLE AS cd,
  (k.proba >= 0.4::DOUBLE) <> (c.proba >= 0.4::DOUBLE) AS flip, round(k.proba, 3) AS kp, round(c.proba, 3) AS cp,
  {_PAST},
  k.num_bikes_available AS kb0, k.num_docks_available AS kk0,
  c.num_bikes_available AS cb0, c.num_docks_available AS ck0, c.jf AS f0, {K.hash_sql("'0|scenario|' || k.station_id || '|' || k.period_id")} AS draw
FROM side_k k JOIN side_c c USING (feed_id, period_id, station_id, us)
WHERE k.label IS NOT NULL AND k.proba IS NOT NULL AND c.proba IS NOT NULL
  AND (k.bikes_lag1 <> c.bikes_lag1 OR k.bikes_lag2 <> c.bikes_lag2 OR k.bikes_lag5 <> c.bikes_lag5 OR k.bikes_lag15 <> c.bikes_lag15)
  AND (c.jf OR c.f1 OR c.f2 OR c.f5 OR c.f15) AND NOT (k.jf OR k.f1 OR k.f2 OR k.f5 OR k.f15)
  AND (round(k.proba, 3) >= 0.4::DOUBLE) = (k.proba >= 0.4::DOUBLE) AND (round(c.proba, 3) >= 0.4::DOUBLE) = (c.proba >= 0.4::DOUBLE)""")
view("firsts", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, station_id, flip ORDER BY draw, us) AS rn FROM candidates) WHERE rn = 1""")
view("picked_flips", "SELECT *, row_number() OVER (ORDER BY draw, feed_id, station_id) AS kind_rank FROM firsts WHERE flip QUALIFY kind_rank <= 4")
view("picked_others", """
SELECT *, row_number() OVER (ORDER BY draw, feed_id, station_id) AS kind_rank FROM firsts
WHERE NOT flip AND (feed_id, station_id) NOT IN (SELECT (feed_id, station_id) FROM picked_flips) QUALIFY kind_rank <= 4""")
view("picked", """
SELECT *, 'F' || kind_rank AS scenario_id FROM picked_flips UNION ALL SELECT *, 'N' || kind_rank FROM picked_others""")


def candidate_rows(spark, sf):
    base = materialise(K.certified(spark, sf), "base")
    exps = inject.experiments(spark, X.G).filter(F.col("experiment_id") == EXPERIMENT)
    changes = inject.inject_jump(base, exps, X.G)
    hit = inject.apply_changes(base, changes, exps).select(*base.columns)
    weather = adapters.weather(spark, sf)
    clean = A.side_view(base, K.CFG, K.MODEL, weather, times=False)
    return materialise(A.scenario_candidates(clean, A.side_view(hit, K.CFG, K.MODEL, weather, times=False), K.CFG, K.MODEL.tau), "candidates")


@query("scenario_select", """
SELECT feed_id, period_id, station_id, us, flip, kd AS clean_decision, cd AS corrupted_decision, kp AS clean_proba, cp AS corrupted_proba FROM candidates""")
def scenario_select(spark, sf):
    return candidate_rows(spark, sf).select(
        *PK, "flip", F.col("k_decision").alias("clean_decision"), F.col("c_decision").alias("corrupted_decision"),
        F.col("k_shown").alias("clean_proba"), F.col("c_shown").alias("corrupted_proba"),
    )


@query("first_n_per_kind", "SELECT scenario_id, feed_id, period_id, station_id, us, flip FROM picked")
def first_n_per_kind(spark, sf):
    return A.first_n_per_kind(candidate_rows(spark, sf), 4).select("scenario_id", *PK, "flip")


def _line(side: str, k: int, flag: str) -> str:
    return (f"printf('  %s  bikes %2d  docks %2d', {_hhmm('us' if k == 0 else f'ku{k}')}, {side}b{k}, {side}k{k}) || "
            f"CASE WHEN config = 'aware' THEN CASE WHEN condition = 'corrupted_flagged' AND {flag} THEN '  quality: IMPLAUSIBLE JUMP' "
            f"ELSE '  quality: ok' END ELSE '' END")


def _text(side: str) -> str:
    lines = " || chr(10) || ".join(_line(side, k, f"f{k}") for k in (15, 5, 2, 1, 0))
    return f"""
'STATION Station ' || station_id || ' (id ' || station_id || ') - ' || strftime(timezone('Europe/Rome', timezone('UTC', make_timestamp(us))), '%Y-%m-%d %H:%M')
  || ' local time' || chr(10) || 'Recent polls (bikes available / free docks):' || chr(10) || {lines} || chr(10)
  || 'Forecast: probability the station is critical (<=2 bikes or <=2 docks) in 1 hours = ' || printf('%.3f', {side}p) || chr(10)
  || 'Policy: dispatch when probability >= 0.40 -> model recommendation: ' || CASE WHEN {side}d THEN 'DISPATCH' ELSE 'NO DISPATCH' END || chr(10)
  || 'Cost of one van dispatch: EUR 15' || CASE WHEN config = 'aware' THEN chr(10) ||
    'Quality check: a poll is flagged IMPLAUSIBLE JUMP when bikes change by more than 1 per minute since the previous poll.' ELSE '' END"""


_questions = ", ".join(f"({i + 1}, '{q}')" for i, q in enumerate(A.QUESTIONS))
CELLS_SQL = f"""
SELECT scenario_id, station_id, us, flip, condition, config, replace(q, '{{name}}', 'Station ' || station_id) AS question,
  CASE WHEN condition = 'clean' THEN {_text("k")} ELSE {_text("c")} END AS tool_output
FROM picked CROSS JOIN (VALUES ('clean'), ('corrupted'), ('corrupted_flagged')) c(condition) CROSS JOIN (VALUES ('blind'), ('aware')) g(config)
JOIN (VALUES {_questions}) t(i, q) ON i = (kind_rank - 1) % 4 + 1"""


def cells(spark, sf):
    picked = A.first_n_per_kind(candidate_rows(spark, sf), 4)
    named = picked.join(adapters.registry(spark, sf).select(FEED, STATION, "name"), [FEED, STATION], "left")
    return A.scenario_cells(named, K.CFG, K.MODEL.tau, K.COSTS.dispatch)


@query("render_context", CELLS_SQL)
def render_context(spark, sf):
    return cells(spark, sf)


@query("scenario_cells", f"SELECT scenario_id, condition, config, flip FROM ({CELLS_SQL})")
def scenario_cells(spark, sf):
    return cells(spark, sf).select("scenario_id", "condition", "config", "flip")


