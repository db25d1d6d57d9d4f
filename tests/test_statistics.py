"""Statistics against published results.  The cell values below are fixed values from the published table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollgauge.operators import stats

# Extra cost of the jump class by intensity and seed, before and after the repair.
JUMP = [
    [1244.9838333333319, 855.0404166666631, 1124.991916666666, 1275.0323333333326, 960.105083333332],
    [2445.040416666663, 1950.0484999999971, 2174.9595833333296, 2534.983833333332, 2085.1374166666646],
    [3930.0242499999986, 3645.0889166666675, 3704.9110833333325, 4049.9595833333296, 3465.105083333332],
    [5940.234416666666, 6165.379916666665, 6210.274833333333, 6315.234416666666, 5535.290999999997],
]
JUMP_REPAIRED = [
    [105.0161666666645, 90.02424999999494, 105.00808333333043, 180.05658333332758, 60.0161666666645],
    [120.02424999999494, 105.06466666666165, 135.0484999999935, 105.06466666666165, 45.0161666666645],
    [194.97574999999415, 165.07274999999572, 240.0484999999935, 120.06466666666165, 105.0161666666645],
    [224.97574999999415, 225.10508333332837, 270.0565833333276, 150.0808333333298, 135.0161666666645],
]
SILENT = [
    [3.7264166666682286, 5.496666666665988, 4.518583333334391, 2.87766666666721, 3.8395833333343035],
    [10.73466666666718, 12.601916666662873, 12.698916666664445, 6.8708333333343035, 13.280916666666599],
    [21.16216666666878, 20.790333333334274, 30.23166666666657, 14.646999999997206, 30.3125],
    [39.74574999999459, 32.13933333332898, 55.40316666666695, 32.0827500000014, 52.30724999999802],
]
REPAIR_ONLY = -15.048500000000786


@pytest.fixture(scope="module")
def results(spark):
    """The 120 published experiments; all cells not listed above are zero but one."""
    rows = []
    for c in ("class1_dropout", "class2_frozen", "class3_stale", "class4_capacity", "class5_jump", "class6_silent"):
        for i in range(4):
            for s in range(5):
                cost = {"class5_jump": JUMP, "class6_silent": SILENT}.get(c, [[0.0] * 5] * 4)[i][s]
                if (c, i, s) == ("class1_dropout", 2, 3):
                    cost = 15.0
                after = {"class2_frozen": REPAIR_ONLY, "class4_capacity": 0.0, "class5_jump": JUMP_REPAIRED[i][s]}.get(c)
                rows.append((c, i, s, cost, after))
    return spark.createDataFrame(
        rows, "class string, intensity_idx int, seed int, delta_cost double, delta_cost_recovered double"
    ).cache()


def test_anova_matches_the_published_table(results):
    got = stats.two_way_anova(results, "class", "intensity_idx", "delta_cost").first()
    assert got["balanced"] and (got["df_a"], got["df_b"], got["df_ab"], got["df_res"]) == (5, 3, 15, 96)
    assert got["f_ab"] == pytest.approx(373.12698439454783, rel=1e-9)
    assert got["f_a"] == pytest.approx(3523.8538741336647, rel=1e-9)
    assert got["f_b"] == pytest.approx(380.25143050141804, rel=1e-9)
    assert got["ss_res"] == pytest.approx(974850.6263227632, rel=1e-9)


def test_unbalanced_cells_give_no_f(results):
    short = results.filter("NOT (class = 'class5_jump' AND seed = 4)")
    got = stats.two_way_anova(short, "class", "intensity_idx", "delta_cost").first()
    assert not got["balanced"] and got["f_ab"] is None


def test_no_permutation_reaches_the_observed_f(results):
    got = stats.permutation_interaction(results, "class", "intensity_idx", "delta_cost", "seed", 100).first()
    assert got["replicates"] == 100 and got["reached"] == 0 and got["f_observed"] == pytest.approx(373.127, abs=1e-3)


def test_wilcoxon_matches_the_published_statistics(results):
    tested = results.filter(F.col("class").isin("class2_frozen", "class4_capacity", "class5_jump"))
    got = {r["class"]: r for r in stats.wilcoxon_signed_rank(tested, ["class"], "delta_cost", "delta_cost_recovered").collect()}
    assert (got["class5_jump"]["w"], got["class5_jump"]["n_pairs"]) == (0.0, 20)
    assert got["class2_frozen"]["w"] == 0.0
    assert got["class4_capacity"]["w"] is None and got["class4_capacity"]["n_nonzero"] == 0


def test_paired_bootstrap_matches_the_published_shares(results):
    jump = results.filter("class = 'class5_jump'")
    got = stats.paired_bootstrap(jump, ["class", "intensity_idx"], "seed", "delta_cost", "delta_cost_recovered", 500)
    shares = [round(r["recovered_share"], 3) for r in got.orderBy("intensity_idx").collect()]
    assert shares == [0.901, 0.954, 0.956, 0.967]
    frozen = results.filter("class = 'class2_frozen'")
    row = stats.paired_bootstrap(frozen, ["class", "intensity_idx"], "seed", "delta_cost", "delta_cost_recovered", 200).first()
    assert row["mean_recovered"] == pytest.approx(15.0485) and row["recovered_share"] is None


def test_bootstrap_interval_is_near_the_published_one(results):
    cells = results.filter("class = 'class5_jump' AND intensity_idx = 0")
    got = stats.bootstrap_ci(cells, ["class", "intensity_idx"], "seed", "delta_cost", 2000).first()
    assert got["mean"] == pytest.approx(1092.030716666665)
    assert got["ci_low"] == pytest.approx(951, abs=25) and got["ci_high"] == pytest.approx(1233, abs=25)


def test_holm_matches_the_step_down_rule(spark):
    rng = np.random.default_rng(1)
    ps = [round(float(p), 4) for p in rng.random(200) ** 3] + [0.01, 0.01, 0.01]
    got = stats.holm_adjust(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p").collect()
    running, want = 0.0, {}
    for rank, p in enumerate(sorted(ps)):
        running = max(running, min(1.0, (len(ps) - rank) * p))
        want.setdefault(p, running)
    assert len(got) == len(ps)
    for r in got:
        assert r["p_holm"] == pytest.approx(want[r["p"]], abs=1e-12)


def test_evenness_of_equal_rates_is_zero(spark):
    bins = spark.createDataFrame([("a", 10, 100), ("b", 20, 200), ("c", 5, 50)], "k string, n_jump int, n_obs int")
    got = stats.unevenness(bins, ["k"]).first()
    assert got["g"] == pytest.approx(0.0, abs=1e-9) and got["df"] == 2


# Published flags and rows by local day and hour: fixed values, the first three days that hold a full hour.
DAY_HOUR = {
    "2026-07-25": [(22, 236, 17920), (23, 204, 18560)],
    "2026-07-26": [
        (0, 276, 18880), (1, 269, 18880), (2, 190, 18880), (3, 159, 18880), (4, 48, 5760), (12, 195, 16320),
        (13, 223, 18880), (14, 193, 18880), (15, 253, 18560), (16, 174, 12480), (20, 198, 17280), (21, 215, 18880),
        (22, 159, 17920),
    ],
    "2026-07-29": [
        (9, 1, 640), (10, 333, 18880), (11, 388, 18880), (12, 384, 18560), (13, 451, 18880), (14, 218, 13120),
        (15, 130, 7680), (16, 340, 18880), (17, 385, 18560), (18, 200, 7040), (22, 52, 4480), (23, 199, 18560),
    ],
}


def poisson_deviance(y, n, *factors):
    """Deviance of y ~ factors with offset log(n), by Newton steps on a dense design."""
    columns = [np.ones(len(y))]
    for f in factors:
        columns += [(np.array(f) == level).astype(float) for level in sorted(set(f))[1:]]
    x, beta = np.stack(columns, 1), None
    mu = y + 0.5
    for _ in range(200):
        z = np.log(mu / n) + (y - mu) / mu
        beta = np.linalg.lstsq(x * np.sqrt(mu)[:, None], z * np.sqrt(mu), rcond=None)[0]
        mu = n * np.exp(x @ beta)
    return 2 * sum(a * np.log(a / m) if a else 0.0 for a, m in zip(y, mu)), mu


def test_adjusted_ratios_of_the_published_counts_match_newton_steps(spark):
    flat = [(d, h, y, n) for d, rows in DAY_HOUR.items() for h, y, n in rows]
    days, hours = [r[0] for r in flat], [r[1] for r in flat]
    y, n = (np.array([r[i] for r in flat], float) for i in (2, 3))
    # A bin in two parts, a bin without a level and one without exposure change nothing.
    given = [(d, h, k - 10, m - 100) if i == 3 else (d, h, k, m) for i, (d, h, k, m) in enumerate(flat)]
    given += [(*flat[3][:2], 10, 100), (None, 3, 5, 10), ("2026-07-30", 1, 0, 0)]
    bins = spark.createDataFrame(given, "day string, hour int, n_jump long, n_obs long")
    fitted = stats.two_factor_fit(bins, ["day"], ["hour"])
    full, mu = poisson_deviance(y, n, days, hours)
    got = {(r["day"], r["hour"]): r["prediction"] for r in fitted.collect()}
    assert len(got) == len(flat)
    for d, h, m in zip(days, hours, mu):
        assert got[d, h] == pytest.approx(m, rel=1e-6)
    for factor, other, levels in (("day", hours, set(days)), ("hour", days, set(hours))):
        row = stats.adjusted_ratio(fitted, [factor], ["hour" if factor == "day" else "day"]).first()
        assert row["lr"] == pytest.approx(poisson_deviance(y, n, other)[0] - full, rel=1e-6)
        assert (row["n_bins"], row["lr_df"]) == (len(flat), len(levels) - 1)
        assert row["dispersion"] == pytest.approx(float(np.sum((y - mu) ** 2 - mu) / np.sum(mu**2)), rel=1e-5)


def test_fit_of_levels_without_flags_and_of_no_bins(spark):
    schema = "a string, b string, n_jump long, n_obs long"
    rows = [("x", "p", 4, 10), ("x", "q", 2, 10), ("y", "p", 0, 10), ("y", "q", 0, 20), ("z", "p", 2, 5), ("z", "q", 1, 5)]
    fitted = stats.two_factor_fit(spark.createDataFrame(rows, schema), ["a"], ["b"])
    got = {(r["a"], r["b"]): r["prediction"] for r in fitted.collect()}
    assert got["y", "p"] == got["y", "q"] == 0.0
    assert got["x", "p"] == pytest.approx(4.0) and got["z", "q"] == pytest.approx(1.0)
    assert stats.adjusted_ratio(fitted, ["b"], ["a"]).first()["lr"] > 0
    empty = stats.two_factor_fit(spark.createDataFrame([], schema), ["a"], ["b"])
    assert empty.count() == 0
    assert stats.adjusted_ratio(empty, ["a"], ["b"]).first()["n_bins"] == 0
