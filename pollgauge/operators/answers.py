"""Assistant scenarios and the scoring of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, PERIOD, PERIOD_SERIES, SECOND_US, STATION, US, FeedConfig, FrozenModel
from pollgauge.functions.columns import hash32, local_ts, logistic, true_when
from pollgauge.operators.features import weather_join, with_calendar, with_label, with_lags
from pollgauge.operators.sequence import Blocks, at_home, near_window, neighbourhood
from pollgauge.session import fixed_table, materialise

# Fixed values of the experiment: conditions, configurations, decisions, questions.
CONDITIONS = ("clean", "corrupted", "corrupted_flagged")
CONFIGS = ("blind", "aware")
DECISIONS = ("dispatch", "no_dispatch", "abstain")
QUESTIONS = (
    "Should the rebalancing van go to station {name} now?",
    "The van is nearby. Is it worth stopping at station {name}, or should it skip it?",
    "We have one van left this hour. Do you recommend dispatching it to station {name}?",
    "Station {name}: dispatch or not?",
)
ANSWER_KEYS = ("model", "rep", "scenario_id", "condition", "config")
RATES = (
    "grounded", "warning_appropriate", "abstention_correct", "consistent", "correct_action", "warned", "abstained",
)
NUMBER = r"(\d+(?:\.\d+)?)"


# ---- parsing and scoring ------------------------------------------------------------------


def parse_answer(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add `valid` and the three answer fields from the JSON object inside a reply.

    An answer is valid when the decision is a known one, the warning is a boolean
    and the rationale is a string.  Invalid replies stay as rows with null fields.
    """
    body = F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)\{.*\}", 0)
    rows = df.withColumn("_v", F.try_parse_json(body))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", path, "variant"))

    decision = F.try_variant_get("_v", "$.decision", "string")
    warning = F.try_variant_get("_v", "$.data_quality_warning", "boolean")
    rationale = F.try_variant_get("_v", "$.rationale", "string")
    valid = true_when(
        decision.isin(*DECISIONS)
        & (kind("$.decision") == "STRING")
        & (kind("$.data_quality_warning") == "BOOLEAN")
        & (kind("$.rationale") == "STRING")
    )
    return (
        rows.withColumn("valid", valid)
        .withColumn("decision", F.when(F.col("valid"), decision))
        .withColumn("data_quality_warning", F.when(F.col("valid"), warning))
        .withColumn("rationale", F.when(F.col("valid"), rationale))
        .drop("_v")
    )


def grounded(rationale: str | Column, tool: str | Column) -> Column:
    """Every number of the rationale occurs in the tool text; a fraction may appear as a percentage."""

    def numbers(text) -> Column:
        col = F.col(text) if isinstance(text, str) else text
        return F.transform(F.regexp_extract_all(col, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))

    shown = numbers(tool)
    percent = F.transform(F.filter(shown, lambda x: x < 1), lambda x: F.round(x * 100, 6))
    allowed = F.concat(shown, percent)
    return F.forall(numbers(rationale), lambda x: F.array_contains(allowed, x))


def answer_vs_clean(df: DataFrame) -> DataFrame:
    """Add the decision that the same model, repeat, scenario and configuration gave on clean data."""
    peers = Window.partitionBy("model", "rep", "scenario_id", "config")
    return df.withColumn("clean_decision", F.max(F.when(F.col("condition") == "clean", F.col("decision"))).over(peers))


def answer_rubric(df: DataFrame) -> DataFrame:
    """Add the seven binary scores of a valid answer; `consistent` is null on clean data."""
    damaged = F.col("condition") != "clean"
    abstained = F.col("decision") == "abstain"
    rows = answer_vs_clean(df)
    return rows.withColumns(
        {
            "grounded": grounded("rationale", "tool_output"),
            "warning_appropriate": F.col("data_quality_warning") == damaged,
            "abstention_correct": abstained == (damaged & F.col("flip")),
            "consistent": F.when(damaged, F.col("decision") == F.col("clean_decision")),
            "correct_action": F.col("decision") == F.col("true_decision"),
            "warned": F.col("data_quality_warning"),
            "abstained": abstained,
        }
    )


def answer_rates(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "config", "condition").agg(
        *[F.avg(F.col(c).cast("int")).alias(c) for c in RATES], F.count(F.lit(1)).alias("n")
    )


def answer_stability(scored: DataFrame) -> DataFrame:
    """Share of cells in which all repeats give the same decision and the same warning."""
    cells = scored.groupBy("model", "scenario_id", "condition", "config").agg(
        ((F.min("decision") == F.max("decision")) & (F.min("data_quality_warning") == F.max("data_quality_warning"))).alias("same")
    )
    return cells.groupBy("model").agg(F.avg(F.col("same").cast("int")).alias("stable_share"), F.count(F.lit(1)).alias("cells"))


def duplicate_answers(df: DataFrame) -> DataFrame:
    """Answer keys that occur more than once; a complete run has none."""
    return df.groupBy(*ANSWER_KEYS).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


# ---- scenarios ----------------------------------------------------------------------------


def _reading(k: int, bikes: Column, docks: Column, us: Column, flag: Column) -> Column:
    return F.struct(
        F.lit(k).alias("polls_ago"), us.alias(US), bikes.alias("bikes"), docks.alias("docks"), flag.alias("jump_flag"),
    )


def with_times(readings: str, cfg: FeedConfig) -> Column:
    """Readings with the local time as text in place of `us`; best on few rows, as the text is dear."""
    time = lambda r: F.date_format(local_ts(r[US], cfg.local_tz), "HH:mm").alias("time")
    return F.transform(readings, lambda r: F.when(
        r.isNotNull(), F.struct(r["polls_ago"].alias("polls_ago"), time(r), *[r[c].alias(c) for c in ("bikes", "docks", "jump_flag")])
    ))


def side_view(
    rows: DataFrame, cfg: FeedConfig, model: FrozenModel, weather: DataFrame | None = None, keys: Sequence[str] = PERIOD_SERIES,
    times: bool = True,
) -> DataFrame:
    """Flags, lags, score, decision and label of one side, with its recent readings as one array.

    Readings run from the oldest lag to the current poll; a lag that spans too
    long a time is null.  Without `times` they keep `us`, for `with_times` later.
    """
    blocks = Blocks(rows, keys, cfg.block_us).previous("_prev", [US, BIKES])
    minutes = (F.col(US) - F.col("_prev.us")) / F.lit(60.0 * SECOND_US)
    flag = true_when(F.abs(F.col(BIKES) - F.col(f"_prev.{BIKES}")) > F.lit(cfg.max_flow_per_min) * minutes)
    seen = blocks.frame().withColumn("jump_flag", flag).drop("_prev")
    seen = seen.withColumn("critical", (F.col(BIKES) <= cfg.critical_at) | (F.col(DOCKS) <= cfg.critical_at))
    near = neighbourhood(seen, cfg.lag_reach_us, cfg.reach_us(cfg.horizon), cfg.block_us)
    w = near_window(keys)
    near = with_label(with_lags(near, cfg, w), cfg, w)
    items = []
    for k in sorted(cfg.lags, reverse=True):
        enough = (F.col(US) - F.lag(US, k).over(w)) <= cfg.reach_us(k)
        past = F.lag(F.struct(US, BIKES, DOCKS, "jump_flag"), k).over(w)
        near = near.withColumn(f"_past{k}", F.when(enough, past))
        p = f"_past{k}"
        items.append(
            F.when(
                F.col(p).isNotNull(),
                _reading(k, F.col(f"{p}.{BIKES}"), F.col(f"{p}.{DOCKS}"), F.col(f"{p}.us"), F.col(f"{p}.jump_flag")),
            )
        )
    items.append(_reading(0, F.col(BIKES), F.col(DOCKS), F.col(US), F.col("jump_flag")))
    out = at_home(near.withColumn("readings", F.array(*items)))
    out = with_calendar(out.drop(*[f"_past{k}" for k in cfg.lags]))
    if times:
        out = out.withColumn("readings", with_times("readings", cfg))
    out = (out if weather is None else weather_join(out, weather)).withColumn("proba", logistic(model))
    return out.withColumn("decision", F.col("proba") >= model.tau)


def scenario_candidates(clean: DataFrame, corrupted: DataFrame, cfg: FeedConfig, tau: float) -> DataFrame:
    """Rows where the fault changed the inputs and shows on the corrupted side only.

    The rounded score must lead to the same decision as the exact one, on both sides.
    """
    lags = [f"bikes_lag{k}" for k in cfg.lags]
    cols = [*lags, "proba", "decision", "readings"]
    k = clean.filter(F.col("proba").isNotNull() & F.col("label").isNotNull()).select(
        *PERIOD_SERIES, US, *[F.col(c).alias(f"k_{c}") for c in cols]
    )
    c = corrupted.filter(F.col("proba").isNotNull()).select(*PERIOD_SERIES, US, *[F.col(x).alias(f"c_{x}") for x in cols])
    rows = k.join(c, [*PERIOD_SERIES, US])
    touched = F.lit(False)
    for name in lags:
        touched = touched | (F.col(f"k_{name}") != F.col(f"c_{name}"))
    rows = rows.filter(touched)
    for side in ("k", "c"):
        shown = F.round(f"{side}_proba", 3)
        rows = rows.withColumn(f"{side}_shown", shown).filter((shown >= tau) == F.col(f"{side}_decision"))
    rows = rows.filter(F.exists("c_readings", lambda r: r["jump_flag"]) & ~F.exists("k_readings", lambda r: r["jump_flag"]))
    for side, view in (("k", clean), ("c", corrupted)):
        if US in view.schema["readings"].dataType.elementType.fieldNames():
            rows = rows.withColumn(f"{side}_readings", with_times(f"{side}_readings", cfg))
    return rows.withColumn("flip", F.col("k_decision") != F.col("c_decision")).withColumn(
        "draw", hash32("0", "scenario", F.col(STATION), F.col(PERIOD))
    )


def first_n_per_kind(candidates: DataFrame, n: int) -> DataFrame:
    """At most `n` flips and `n` others, one per station of a feed, in hash order; flips choose first."""
    station = [FEED, STATION]
    rest = [c for c in candidates.columns if c not in (*station, "flip")]
    firsts = candidates.groupBy(*station, "flip").agg(
        F.min_by(F.struct(*rest), F.struct("draw", US)).alias("x")
    ).select(*station, "flip", "x.*")
    firsts = materialise(firsts, "firsts")
    flips = firsts.filter("flip").orderBy("draw", *station).limit(n)
    others = firsts.filter("NOT flip").join(flips.select(*station), station, "left_anti").orderBy("draw", *station).limit(n)
    picked = flips.unionByName(others)
    # At most 2n rows from here on.
    order = Window.partitionBy("flip").orderBy("draw", *station)
    return picked.withColumn("kind_rank", F.row_number().over(order)).withColumn(
        "scenario_id", F.concat(F.when(F.col("flip"), "F").otherwise("N"), F.col("kind_rank"))
    )


def question(rank: Column, name: Column) -> Column:
    """The question of the n-th scenario of a kind, with the station's name."""
    texts = F.array(*[F.lit(q) for q in QUESTIONS])
    return F.replace(F.element_at(texts, ((rank - 1) % len(QUESTIONS) + 1).cast("int")), F.lit("{name}"), name)


def render_context(
    readings: Column, show_flags: Column, flags_on: Column, name: Column, station: Column, local_time: Column,
    proba: Column, decision: Column, tau: float, horizon_h: float, dispatch_cost: float,
) -> Column:
    """The text that the monitoring tool returns.  Fixed format of the experiment."""

    def line(r: Column) -> Column:
        flagged = F.when(r["jump_flag"] & flags_on, "  quality: IMPLAUSIBLE JUMP").otherwise("  quality: ok")
        return F.concat(
            F.format_string("  %s  bikes %2d  docks %2d", r["time"], r["bikes"], r["docks"]),
            F.when(show_flags, flagged).otherwise(""),
        )

    note = (
        "\nQuality check: a poll is flagged IMPLAUSIBLE JUMP when bikes change by more than 1 per minute "
        "since the previous poll."
    )
    return F.concat(
        F.format_string("STATION %s (id %s) - %s local time\n", name, station, local_time),
        F.lit("Recent polls (bikes available / free docks):\n"),
        F.concat_ws("\n", F.transform(readings, line)),
        F.format_string(
            f"\nForecast: probability the station is critical (<=2 bikes or <=2 docks) in {horizon_h:g} hours = %.3f\n", proba
        ),
        F.lit(f"Policy: dispatch when probability >= {tau:.2f} -> model recommendation: "),
        F.when(decision, "DISPATCH").otherwise("NO DISPATCH"),
        F.lit(f"\nCost of one van dispatch: EUR {dispatch_cost:g}"),
        F.when(show_flags, note).otherwise(""),
    )


def scenario_cells(scenarios: DataFrame, cfg: FeedConfig, tau: float, dispatch_cost: float) -> DataFrame:
    """Every scenario under each condition and configuration, with question and tool text."""
    spark = scenarios.sparkSession
    grid = fixed_table(spark, [(c, g) for c in CONDITIONS for g in CONFIGS], "condition string, config string")
    rows = scenarios.crossJoin(F.broadcast(grid))
    clean = F.col("condition") == "clean"

    def side(name: str) -> Column:
        return F.when(clean, F.col(f"k_{name}")).otherwise(F.col(f"c_{name}"))

    text = render_context(
        side("readings"), F.col("config") == "aware", F.col("condition") == "corrupted_flagged", F.col("name"),
        F.col(STATION), F.date_format(local_ts(US, cfg.local_tz), "yyyy-MM-dd HH:mm"), side("shown"), side("decision"),
        tau, cfg.horizon * cfg.cadence_s / 3600, dispatch_cost,
    )
    return rows.select(
        "scenario_id", STATION, US, "flip", "condition", "config",
        question(F.col("kind_rank"), F.col("name")).alias("question"), text.alias("tool_output"),
    )
