"""Score, split, training and threshold choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollgauge.config import FEED, PERIOD, SERIES, US, CostModel, FeedConfig, FrozenModel
from pollgauge.functions.columns import count_if, logistic
from pollgauge.operators.ranking import mid_rank, quantiles, rank_table
from pollgauge.operators.sequence import at_home, near_window, neighbourhood
from pollgauge.session import materialise

TAUS = [i / 20.0 for i in range(1, 20)]


def score(df: DataFrame, model: FrozenModel, drop_missing: bool = True) -> DataFrame:
    """Add `proba` and `decision`; rows with a missing input are dropped unless asked otherwise."""
    rows = df.withColumn("proba", logistic(model)).withColumn("decision", F.col("proba") >= model.tau)
    return rows.filter(F.col("proba").isNotNull()) if drop_missing else rows


def split_bounds(features: DataFrame, first: float = 0.6, second: float = 0.8) -> DataFrame:
    """One row: row quantiles of time, pushed on to the next period end, and the last time.

    A period is then never split between the sets.
    """
    cuts = quantiles(features, [], US, {"q1": first, "q2": second})
    ends = features.groupBy(FEED, PERIOD).agg(F.max(US).alias("period_end"))

    def snapped(q: str):
        return F.coalesce(F.min(F.when(F.col("period_end") >= F.col(q), F.col("period_end"))), F.max("period_end"))

    return ends.crossJoin(cuts).agg(
        snapped("q1").alias("train_end"), snapped("q2").alias("val_end"), F.max("period_end").alias("test_end")
    )


def assign_split(features: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add `split`: train, val or test.  `bounds` is the single row of `split_bounds`."""
    which = (
        F.when(F.col(US) <= F.col("train_end"), "train")
        .when(F.col(US) <= F.col("val_end"), "val")
        .when(F.col(US) <= F.col("test_end"), "test")
    )
    return features.crossJoin(bounds).withColumn("split", which).drop("train_end", "val_end", "test_end")


def train_classifier(train: DataFrame, columns: Sequence[str], c: float = 1.0, n_rows: int | None = None) -> FrozenModel:
    """L2 logistic regression with strength C, returned as plain coefficients.

    MLlib averages the loss over rows, so its regularisation is 1 / (rows * C).
    """
    n = n_rows if n_rows is not None else train.count()
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        train.select(F.col("label").cast("double").alias("label"), *[F.col(x).cast("double") for x in columns])
    )
    fit = LogisticRegression(
        maxIter=1000, regParam=1.0 / (n * c), elasticNetParam=0.0, standardization=False, tol=1e-10
    ).fit(vectors)
    return FrozenModel(float(fit.intercept), dict(zip(columns, map(float, fit.coefficients))))


def balance(train: DataFrame, model: FrozenModel, c: float = 1.0) -> DataFrame:
    """term, train_rows, observed and imbalance: the conditions that a penalised logistic fit satisfies.

    For every term the fitted sum of its column falls short of the observed one by coefficient / C, and by nothing
    for the intercept. `imbalance` is what is left, per row.
    """
    y = F.col("label").cast("double")
    rows = score(train, model)
    terms = [("intercept", F.lit(1.0), 0.0), *((name, F.col(name).cast("double"), w / c) for name, w in model.coefficients.items())]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"s{i}_{k}") for i, (_, col, _) in enumerate(terms) for k, x in (("y", F.sum(y * col)), ("p", F.sum(F.col("proba") * col)))])
    listed = F.array(*[
        F.struct(F.lit(name).alias("term"), F.col("n").alias("train_rows"), F.col(f"s{i}_y").alias("observed"),
                 ((F.col(f"s{i}_p") - F.col(f"s{i}_y") + penalty) / F.col("n")).alias("imbalance"))
        for i, (name, _, penalty) in enumerate(terms)
    ])
    return sums.select(F.explode(listed).alias("t")).select("t.*")


def tau_costs(scored: DataFrame, cfg: FeedConfig, costs: CostModel, taus: Sequence[float] = TAUS) -> DataFrame:
    """Total cost of each candidate threshold, all thresholds in one pass.

    The thresholds become an array of decisions per row, so rows are shuffled once
    and not once per threshold.
    """
    decisions = F.array(*[F.col("proba") >= F.lit(t) for t in taus])
    rows = scored.select(*SERIES, US, "label", decisions.alias("dec"))
    near = neighbourhood(rows, cfg.max_gap_us, 0, cfg.block_us)
    w = near_window(SERIES)
    joined = (F.col(US) - F.lag(US).over(w)) <= cfg.max_gap_us
    rows = at_home(near.withColumn("before", F.when(joined, F.lag("dec").over(w))))
    aggs = []
    for i, _ in enumerate(taus):
        on = F.col("dec")[i]
        before = F.coalesce(F.col("before")[i], F.lit(False))
        aggs.append(count_if(on & ~before).alias(f"e{i}"))
        aggs.append(count_if(F.col("label") & ~on).alias(f"m{i}"))
    one = rows.agg(*aggs)
    listed = F.array(
        *[
            F.struct(F.lit(t).alias("tau"), F.col(f"m{i}").alias("missed"), F.col(f"e{i}").alias("n_dispatches"))
            for i, t in enumerate(taus)
        ]
    )
    out = one.select(F.explode(listed).alias("x")).select("x.*")
    total = F.col("missed") * F.lit(costs.penalty_per_row(cfg.row_hours)) + F.col("n_dispatches") * F.lit(costs.dispatch)
    return out.withColumn("total", total)


def calibrate_tau(scored: DataFrame, cfg: FeedConfig, costs: CostModel) -> DataFrame:
    """One row: the cheapest threshold, the first one on a tie."""
    by_cost = tau_costs(scored, cfg, costs)
    best = F.min_by(F.struct("tau", "total"), F.struct(F.round("total", 9), "tau")).alias("best")
    return by_cost.agg(best).select("best.*")


def roc_auc(df: DataFrame, score_col: str = "proba", label: str = "label") -> DataFrame:
    """Exact area under the curve from average ranks (Mann-Whitney), one row."""
    seen = df.filter(F.col(label).isNotNull())
    ranks = rank_table(seen, [], score_col, pos=count_if(F.col(label)))
    sums = ranks.agg(
        F.sum(F.col("pos") * mid_rank()).alias("rank_sum"), F.sum("pos").alias("p"), F.sum("n").alias("t")
    )
    p, neg = F.col("p"), F.col("t") - F.col("p")
    auc = (F.col("rank_sum") - p * (p + 1) / F.lit(2.0)) / F.nullif(p * neg, F.lit(0))
    return sums.select(auc.alias("auc"), p.alias("positives"), neg.alias("negatives"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns, null where one of them does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def train_freeze(
    features: DataFrame, columns: Sequence[str], cfg: FeedConfig, costs: CostModel
) -> tuple[FrozenModel, DataFrame]:
    """Split, fit, choose the threshold, and report.  The driver sees only scalars."""
    usable = features.dropna(subset=[*columns, "label"])
    bounds = materialise(split_bounds(usable), "bounds")
    parts = assign_split(usable, bounds)
    train = parts.filter("split = 'train'")
    fitted = train_classifier(train, columns)
    best = calibrate_tau(score(parts.filter("split = 'val'"), fitted), cfg, costs).first()
    model = fitted.with_tau(best["tau"])
    test = score(parts.filter("split = 'test'"), model)
    sizes = parts.agg(
        count_if(F.col("split") == "train").alias("trained_on_rows"),
        *[
            F.count_distinct(F.when(F.col("split") == s, F.struct(FEED, PERIOD))).alias(f"{s}_periods")
            for s in ("train", "val", "test")
        ],
    )
    report = (
        sizes.crossJoin(bounds)
        .crossJoin(roc_auc(test).select(F.col("auc").alias("test_auc")))
        .crossJoin(test.agg(pearson(F.col(columns[0]).cast("double"), F.col("label").cast("double")).alias("test_corr")))
        .withColumn("tau", F.lit(model.tau))
    )
    return model, report

