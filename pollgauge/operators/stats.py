"""Statistics on experiment results, as joins and grouped sums.

Spark SQL has no chi-square, F or normal tail, so the operators return the
statistic and its degrees of freedom; a probability only where it has a closed form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollgauge.functions.columns import count_if, hash32
from pollgauge.operators.ranking import mid_rank, rank_table
from pollgauge.session import fixed_table, materialise

RANK_SLICE = 4096
ROUNDS_A_TABLE = 4  # rounds of proportional fitting between two written tables


def unevenness(bins: DataFrame, factor: Sequence[str], count: str = "n_jump", exposure: str = "n_obs") -> DataFrame:
    """One row: G statistic of the flag rate over a factor given exposure, its df, and the dispersion.

    `bins` holds counts per bin.  Bins are summed to the factor first; expected
    counts follow the exposure.  The dispersion is the Pearson sum per df.
    """
    levels = bins.groupBy(*factor).agg(F.sum(count).alias("y"), F.sum(exposure).alias("n"))
    whole = levels.agg(F.sum("y").alias("_y"), F.sum("n").alias("_n"))
    rows = levels.crossJoin(whole).withColumn("e", F.col("n") * F.col("_y") / F.col("_n"))
    term = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col("e"))).otherwise(F.lit(0.0))
    sq = F.col("y") - F.col("e")
    out = rows.agg(
        (F.lit(2.0) * F.sum(term)).alias("g"), (F.count(F.lit(1)) - 1).alias("df"),
        F.sum(sq * sq / F.nullif(F.col("e"), F.lit(0.0))).alias("pearson"),
    )
    dispersion = F.col("pearson") / F.nullif(F.col("df"), F.lit(0))
    return out.withColumn("dispersion", dispersion).withColumn("g_scaled", F.col("g") / F.nullif(dispersion, F.lit(0.0)))


def two_factor_fit(
    bins: DataFrame, a: Sequence[str], b: Sequence[str], count: str = "n_jump", exposure: str = "n_obs",
    tolerance: float = 1e-9, rounds: int = 500,
) -> DataFrame:
    """Levels of both factors, `y`, `n` and `prediction` of the Poisson model count ~ a + b with exposure as offset.

    Iterative proportional fitting: the rate of a level is its count over the exposure weighted with the rates of
    the other factor, for `a` and `b` in turn, until `ROUNDS_A_TABLE` rounds move less than `tolerance` of all counts.
    Each half of a round is one join and one grouped sum, so neither factor has a bound on its levels; a written table
    of rates after those rounds cuts the lineage. Bins with a null level or without exposure take no part, repeated bins add up, and a level without counts
    is predicted as zero. A fit that has not settled after `rounds` is an error.
    """
    cells = bins.dropna(subset=[*a, *b]).groupBy(*a, *b).agg(F.sum(count).alias("y"), F.sum(exposure).cast("double").alias("n"))
    cells = materialise(cells.filter("n > 0"), "bins")

    def ratio(weight: Column) -> Column:
        return F.coalesce(F.sum("y") / F.nullif(F.sum(F.col("n") * weight), F.lit(0.0)), F.lit(0.0))

    def fitted_rates(by: Sequence[str], other: Sequence[str], rates: DataFrame) -> DataFrame:
        return cells.join(rates, list(other)).groupBy(*by).agg(ratio(F.col("rate")).alias("rate"), F.sum("y").alias("_y"))

    rates = materialise(cells.groupBy(*b).agg(ratio(F.lit(1.0)).alias("rate")), "rates")
    for _ in range(0, rounds, ROUNDS_A_TABLE):
        fitted = rates
        for _ in range(ROUNDS_A_TABLE):
            of_a = fitted_rates(a, b, fitted.select(*b, "rate")).select(*a, "rate")
            fitted = fitted_rates(b, a, of_a)
        fitted = fitted.join(rates.withColumnRenamed("rate", "before"), list(b))
        moved = F.when(F.col("rate") > 0, F.col("_y") * F.abs(F.col("before") / F.nullif(F.col("rate"), F.lit(0.0)) - 1))
        written = materialise(fitted.withColumn("moved", moved), "rates")
        change, total = written.agg(F.coalesce(F.sum("moved"), F.lit(0.0)), F.coalesce(F.sum("_y"), F.lit(0))).first()
        rates = written.select(*b, "rate")
        if change <= tolerance * total:
            break
    else:
        raise RuntimeError(f"the two-factor fit has not settled after {rounds} rounds")
    of_a = fitted_rates(a, b, rates).select(*a, F.col("rate").alias("rate_a"))
    both = cells.join(rates.withColumnRenamed("rate", "rate_b"), list(b)).join(of_a, list(a))
    return both.select(*a, *b, "y", "n", (F.col("n") * F.col("rate_a") * F.col("rate_b")).alias("prediction"))


def adjusted_ratio(fitted: DataFrame, factor: Sequence[str], other: Sequence[str]) -> DataFrame:
    """One row: bins, likelihood ratio of `factor` beside `other`, its df, and the moment dispersion.

    `fitted` comes from `two_factor_fit`. The model without `factor` follows the rate of each level of `other`; both
    models fit the total, so the ratio is a sum over bins with counts. df is levels less one, which holds where the
    bins link all levels.
    """
    margin = fitted.groupBy(*other).agg(F.sum("y").alias("_y"), F.sum("n").alias("_n"))
    rows = fitted.join(margin, list(other)).withColumn("e", F.col("n") * F.col("_y") / F.col("_n"))
    term = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("prediction") / F.nullif(F.col("e"), F.lit(0.0)))).otherwise(F.lit(0.0))
    miss = F.col("y") - F.col("prediction")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n_bins"), (F.lit(2.0) * F.sum(term)).alias("lr"),
        (F.sum(miss * miss - F.col("prediction")) / F.nullif(F.sum(F.col("prediction") * F.col("prediction")), F.lit(0.0))).alias("dispersion"),
    )
    levels = fitted.select(*factor).distinct().agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("lr_df"))
    return sums.crossJoin(levels).select("n_bins", "lr", "lr_df", "dispersion")


def holm_adjust(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Add `p_holm` and `reject`.  Works on any number of tests.

    Equal p-values get equal results, so the running maximum runs over distinct
    values; slices of ranks carry it, so no task holds all tests.
    """
    ranks = rank_table(df, [], p)
    step = F.least(F.lit(1.0), (F.col("total") - F.col("below")) * F.col(p))
    ranks = ranks.withColumn("_step", step).withColumn("_s", (F.col("below") / RANK_SLICE).cast("bigint"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranks.groupBy("_s").agg(F.max("_step").alias("_m")).withColumn("_carry", F.max("_m").over(before)).drop("_m")
    inside = Window.partitionBy("_s").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = (
        ranks.join(carry, "_s")
        .withColumn("p_holm", F.greatest(F.max("_step").over(inside), F.coalesce(F.col("_carry"), F.lit(0.0))))
        .select(p, "p_holm")
    )
    return df.join(adjusted, p).withColumn("reject", F.col("p_holm") < alpha)


def _cell_means(rows: DataFrame, a: str, b: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Per cell: count, mean, sum of squares within, and the row, column and grand means.

    Balanced cells are required: then the means of means are the plain means.
    """
    cells = rows.groupBy(*by, a, b).agg(
        F.count(F.lit(1)).alias("r"), F.avg(y).alias("m"), F.var_pop(F.col(y)).alias("_v")
    )
    return (
        cells.withColumn("ss_in", F.col("_v") * F.col("r"))
        .withColumn("ma", F.avg("m").over(Window.partitionBy(*by, a)))
        .withColumn("mb", F.avg("m").over(Window.partitionBy(*by, b)))
        .withColumn("g", F.avg("m").over(Window.partitionBy(*by)))
        .drop("_v")
    )


def _sq(col: Column) -> Column:
    return col * col


def _sums(cells: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    r = F.col("r")
    return cells.groupBy(*by).agg(
        F.count_distinct(a).alias("na"), F.count_distinct(b).alias("nb"),
        F.count(F.lit(1)).alias("cells"), F.min(r).alias("r_min"), F.max(r).alias("r_max"),
        F.sum(r * _sq(F.col("ma") - F.col("g"))).alias("ss_a"),
        F.sum(r * _sq(F.col("mb") - F.col("g"))).alias("ss_b"),
        F.sum(r * _sq(F.col("m") - F.col("ma") - F.col("mb") + F.col("g"))).alias("ss_ab"),
        F.sum("ss_in").alias("ss_res"),
    )


def two_way_anova(rows: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """One row: sums of squares, degrees of freedom and F of both factors and their interaction.

    `balanced` is false where cells are missing or unequal; F is then null.
    """
    s = _sums(_cell_means(rows, a, b, y), a, b)
    df_a, df_b = F.col("na") - 1, F.col("nb") - 1
    s = s.withColumn("balanced", (F.col("cells") == F.col("na") * F.col("nb")) & (F.col("r_min") == F.col("r_max")))
    s = s.withColumn("df_a", df_a).withColumn("df_b", df_b).withColumn("df_ab", df_a * df_b)
    s = s.withColumn("df_res", F.col("cells") * (F.col("r_min") - 1))
    mse = F.nullif(F.col("ss_res") / F.nullif(F.col("df_res"), F.lit(0)), F.lit(0.0))
    for part in ("a", "b", "ab"):
        ratio = F.col(f"ss_{part}") / F.nullif(F.col(f"df_{part}"), F.lit(0)) / mse
        s = s.withColumn(f"f_{part}", F.when(F.col("balanced"), ratio))
    return s.drop("na", "nb", "cells", "r_min", "r_max")


def permutation_interaction(rows: DataFrame, a: str, b: str, y: str, unit: str, n_perm: int) -> DataFrame:
    """One row: observed interaction F, replicates, and how many reach it (Freedman-Lane).

    Residuals of the main-effects fit are dealt out anew in hash order in every
    replicate.  `unit` names a row within its cell.  A replicate is one group of
    the result table's size, which the fault grid fixes.
    """
    observed = two_way_anova(rows, a, b, y).select(F.col("f_ab").alias("f_observed"))
    by_a, by_b, whole = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    order = Window.orderBy(a, b, unit)
    fitted = F.avg(y).over(by_a) + F.avg(y).over(by_b) - F.avg(y).over(whole)
    base = rows.select(a, b, y, F.row_number().over(order).alias("pos"), fitted.alias("fit"))
    reps = rows.sparkSession.range(n_perm).withColumnRenamed("id", "rep")
    dealt = base.select((F.col(y) - F.col("fit")).alias("res"), "pos").crossJoin(reps)
    deal = Window.partitionBy("rep").orderBy(hash32(F.col("rep"), "perm", F.col("pos")), "pos")
    dealt = dealt.select("rep", "res", F.row_number().over(deal).alias("pos"))
    pseudo = dealt.join(base.select(a, b, "fit", "pos"), "pos").withColumn("y_new", F.col("fit") + F.col("res"))
    sums = _sums(_cell_means(pseudo, a, b, "y_new", ["rep"]), a, b, ["rep"])
    df_ab = (F.col("na") - 1) * (F.col("nb") - 1)
    df_res = F.col("cells") * (F.col("r_min") - 1)
    f = sums.select((F.col("ss_ab") / df_ab / (F.col("ss_res") / df_res)).alias("f"))
    return f.crossJoin(observed).groupBy("f_observed").agg(
        F.count(F.lit(1)).alias("replicates"), count_if(F.col("f") >= F.col("f_observed")).alias("reached"),
        F.max("f").alias("f_max"), F.avg("f").alias("f_mean"),
    ).withColumn("p_value", F.col("reached") / F.col("replicates"))


def levene(rows: DataFrame, cell: Sequence[str], y: str) -> DataFrame:
    """One row: equal-variance statistic, centred on the median of each cell.

    A cell holds one value per seed of the fault grid, so the exact median is cheap.
    """
    medians = rows.groupBy(*cell).agg(F.median(y).alias("_med"))
    z = rows.join(medians, list(cell)).withColumn("z", F.abs(F.col(y) - F.col("_med")))
    cells = z.groupBy(*cell).agg(F.count(F.lit(1)).alias("r"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    whole = z.agg(F.avg("z").alias("g"), F.count(F.lit(1)).alias("n"))
    out = cells.crossJoin(whole).groupBy("n").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * _sq(F.col("m") - F.col("g"))).alias("between"),
        F.sum(F.col("r") * F.col("v")).alias("within"),
    )
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    stat = (F.col("between") / df1) / F.nullif(F.col("within") / df2, F.lit(0.0))
    return out.select(stat.alias("levene"), df1.alias("df1"), df2.alias("df2"))


def normality(rows: DataFrame, cell: Sequence[str], y: str) -> DataFrame:
    """One row: Jarque-Bera of the residuals around the cell means; p = exp(-JB / 2)."""
    means = rows.groupBy(*cell).agg(F.avg(y).alias("_m"))
    e = F.col("e")
    moments = rows.join(means, list(cell)).select((F.col(y) - F.col("_m")).alias("e")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("m2"), F.avg(e * e * e).alias("m3"), F.avg(e * e * e * e).alias("m4")
    )
    m2 = F.nullif(F.col("m2"), F.lit(0.0))
    out = moments.withColumn("skew", F.col("m3") / F.pow(m2, F.lit(1.5))).withColumn("kurt", F.col("m4") / (m2 * m2) - 3)
    jb = F.col("n") / F.lit(6.0) * (_sq(F.col("skew")) + _sq(F.col("kurt")) / 4)
    return out.select("n", "skew", "kurt", jb.alias("jb"), F.exp(-jb / 2).alias("p_value"))


def bootstrap_ci(
    rows: DataFrame, cell: Sequence[str], unit: str, y: str, n_boot: int, name: str = "mean"
) -> DataFrame:
    """Per cell: mean of `y` and the 2.5 and 97.5 percentiles of resampled means; nulls are left out.

    Draws pick row numbers by hash, so a replicate does not depend on partitioning.
    The percentiles run over `n_boot` values per cell.
    """
    seen = rows.filter(F.col(y).isNotNull())
    order = Window.partitionBy(*cell).orderBy(unit)
    numbered = seen.select(*cell, y, (F.row_number().over(order) - 1).alias("pos"))
    sizes = seen.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias(name))
    draws = (
        sizes.crossJoin(rows.sparkSession.range(n_boot).withColumnRenamed("id", "rep"))
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        .withColumn("pos", (hash32(*[F.col(c) for c in cell], F.col("rep"), F.col("draw")) % F.col("n")).cast("int"))
    )
    means = draws.join(numbered, [*cell, "pos"]).groupBy(*cell, "rep").agg(F.avg(y).alias("_m"))
    ends = means.groupBy(*cell).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    return sizes.join(ends, list(cell)).select(
        *cell, "n", name, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high")
    )


def paired_bootstrap(rows: DataFrame, cell: Sequence[str], unit: str, before: str, after: str, n_boot: int) -> DataFrame:
    """Per cell: mean difference with its bootstrap interval, and the recovered share."""
    pairs = rows.filter(F.col(before).isNotNull() & F.col(after).isNotNull())
    pairs = pairs.withColumn("_diff", F.col(before) - F.col(after))
    ci = bootstrap_ci(pairs, cell, unit, "_diff", n_boot, "mean_recovered")
    sums = pairs.groupBy(*cell).agg(
        F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"),
        (F.sum("_diff") / F.nullif(F.sum(before), F.lit(0.0))).alias("recovered_share"),
    )
    return ci.join(sums, list(cell))


def wilcoxon_signed_rank(rows: DataFrame, by: Sequence[str], before: str, after: str, digits: int = 9) -> DataFrame:
    """Per group: pairs, non-zero pairs, W = min(W+, W-), z with tie correction; null if all are equal."""
    pairs = rows.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).withColumn(
        "_d", F.round(F.col(before) - F.col(after), digits)
    )
    n_pairs = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    ranks = rank_table(pairs.filter("_d <> 0").withColumn("_abs", F.abs("_d")), by, "_abs", pos=count_if(F.col("_d") > 0))
    w = ranks.groupBy(*by).agg(
        F.max("total").alias("n_nonzero"),
        F.sum(F.col("pos") * mid_rank()).alias("w_plus"),
        F.sum((F.col("n") - F.col("pos")) * mid_rank()).alias("w_minus"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("_ties"),
    )
    n = F.col("n_nonzero")
    var = n * (n + 1) * (2 * n + 1) / F.lit(24.0) - F.col("_ties") / F.lit(48.0)
    stat = F.least("w_plus", "w_minus")
    z = (stat - n * (n + 1) / F.lit(4.0)) / F.sqrt(F.nullif(var, F.lit(0.0)))
    return n_pairs.join(w, list(by), "left").select(
        *by, "n_pairs", F.coalesce(n, F.lit(0)).alias("n_nonzero"), stat.alias("w"), z.alias("z")
    )
