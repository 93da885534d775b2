import math
import random

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from twinloom.operators import assemble, copula, evaluate, marginals
from twinloom.operators import marginals as mg
from twinloom.operators import bootstrap as bs
from twinloom.functions import counter
from twinloom.functions.normal import np_norm_cdf, np_norm_ppf
from twinloom.operators import kernels
from twinloom.operators.kernels import kernel_sums
from twinloom.staging import stage


def cells_of(spark, columns):
    rows = [(i, name, float(v)) for name, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, feature string, value double")


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(0)
    n = 3000
    return stage(cells_of(spark, {
        "norm": rng.normal(50, 4, n),
        "lognorm": np.exp(rng.normal(1, 0.8, n)),
        "gamma": rng.gamma(2.5, 3.0, n),
        "beta": rng.beta(2, 5, n) * 10 + 1,
        "t": rng.standard_t(8, n) * 2 + 100,
        "flat": rng.uniform(3, 9, n),
        "signed": rng.normal(0, 4, n),
    }))


def test_fits_recover_parameters(simulated):
    families = list(mg.SELECTABLE) + ["uniform"]
    fits = {r["feature"]: r for r in mg.fit(simulated, families).collect()}
    assert fits["norm"]["norm"]["loc"] == pytest.approx(50, abs=0.3)
    assert fits["norm"]["norm"]["scale"] == pytest.approx(4, rel=0.05)
    ln = fits["lognorm"]["lognorm"]
    assert ln["s"] == pytest.approx(0.8, rel=0.06) and ln["scale"] == pytest.approx(math.e, rel=0.06)
    assert fits["gamma"]["gamma"]["a"] == pytest.approx(2.5, rel=0.08)
    assert fits["gamma"]["gamma"]["scale"] == pytest.approx(3.0, rel=0.08)
    assert fits["t"]["t"]["scale"] == pytest.approx(2.0, rel=0.1)
    assert fits["flat"]["uniform"]["loc"] == pytest.approx(3, abs=0.01)
    beta = fits["beta"]["beta"]
    assert beta["a"] / (beta["a"] + beta["b"]) == pytest.approx((np.mean(2 / 7) * 10 + 1 - beta["loc"]) / beta["scale"], rel=0.05)
    tn = fits["norm"]["truncnorm"]
    assert tn["loc"] == pytest.approx(50, abs=0.5)


def test_densities_integrate_to_one(spark, simulated):
    families = ["norm", "lognorm", "gamma", "beta", "t", "truncnorm", "uniform"]
    fits = mg.fit(simulated, families)
    grid = fits.filter("feature = 'gamma'").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19999))))
    step = (F.col("mx") - F.col("mn")) / 20000.0
    x = F.col("mn") + (F.col("i") + 0.5) * step
    sums = grid.agg(*[
        F.sum(F.exp(mg.REGISTRY[f].logpdf(x, lambda p, f=f: F.col(f)[p])) * step).alias(f) for f in families
    ]).first()
    assert sums["truncnorm"] == pytest.approx(1.0, abs=1e-3) and sums["uniform"] == pytest.approx(1.0, abs=1e-9)
    for f in ("gamma", "lognorm", "beta"):
        assert sums[f] == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("method", mg.METHODS)
def test_selection_finds_the_family(simulated, method):
    got = {r["feature"]: r["family"] for r in mg.select_family(simulated, ["norm", "lognorm", "gamma"], method).collect()}
    # gamma needs positive values; a far-shifted lognorm is close to a normal
    assert got["signed"] in ("norm", "lognorm") and got["lognorm"] == "lognorm" and got["gamma"] == "gamma"


def test_selection_guards():
    with pytest.raises(ValueError, match="cannot be selected"):
        mg.check_families(["norm", "cauchy"])
    with pytest.raises(ValueError, match="is unknown"):
        mg.check_families(["norm"], "rss")


def test_constant_feature(spark):
    cells = stage(cells_of(spark, {"c": [4.0] * 30, "v": range(1, 31)}))
    best = {r["feature"]: r for r in mg.select_family(cells, ["lognorm", "norm", "beta", "gamma", "t", "gaussian_kde"]).collect()}
    assert best["c"]["family"] == "lognorm" and best["c"]["score"] is None
    families = spark.createDataFrame([("c", "norm"), ("v", "beta")], "feature string, family string")
    out = copula.sample(cells, copula.fit_model(cells, families), 20, 1).collect()
    assert {r["value"] for r in out if r["feature"] == "c"} == {4.0}


def test_kernel_sums_against_numpy(spark):
    rng = random.Random(3)
    values = {"a": [rng.gauss(0, 1) for _ in range(200)], "b": [rng.gauss(5, 2) for _ in range(50)]}
    counted = cells_of(spark, values).select("feature", "value", F.lit(2).alias("weight"))
    grids = stage(spark.createDataFrame([("a", -3.0, 3.0, 0.4), ("b", 0.0, 10.0, 0.9)], "feature string, first double, last double, bandwidth double"))
    got = kernel_sums(counted, grids, ["feature"], 50).toPandas()
    for name, lo, hi, h in (("a", -3, 3, 0.4), ("b", 0, 10, 0.9)):
        x = np.linspace(lo, hi, 50)
        d = (x[:, None] - np.array(values[name])) / h
        want = 2 * (np.exp(-0.5 * d * d) / math.sqrt(2 * math.pi) / h).sum(axis=1)
        mine = got[got.feature == name].sort_values("point")
        assert np.allclose(mine["total"], want) and np.allclose(mine["x"], x)


@pytest.mark.parametrize("family", ["norm", "lognorm", "uniform", "truncnorm", "beta", "gamma", "t", "gaussian_kde"])
def test_scores_and_inverse_are_inverse(spark, simulated, family):
    cells = simulated.filter("feature in ('gamma', 'beta')")
    families = cells.select("feature").distinct().withColumn("family", F.lit(family))
    model = copula.fit_model(cells, families)
    z = copula.normal_scores(cells, model)
    assert z.agg(F.max(F.abs("z"))).first()[0] <= copula.Z_MAX + 1e-12
    back = copula.inverse_marginals(z.withColumnRenamed("id", "synth"), model)
    joined = back.select(F.col("synth").alias("id"), "feature", F.col("value").alias("back")).join(cells, ["id", "feature"])
    spread = 60.0
    worst = joined.filter(F.col("value").between(1.5, 5.0)).agg(F.max(F.abs(F.col("back") - F.col("value")))).first()[0]
    assert worst < 0.004 * spread


@pytest.fixture(scope="module")
def correlated(spark):
    rng = np.random.default_rng(5)
    cov = np.array([[1, 0.8, -0.5], [0.8, 1, -0.2], [-0.5, -0.2, 1]])
    x = rng.multivariate_normal([10, 20, 30], cov, 1200)
    x = np.round(x, 3)
    cells = cells_of(spark, {f"x{j}": x[:, j] for j in range(3)})
    holes = cells.withColumn("value", F.when((F.col("feature") != "x2") | (F.col("id") % 4 != 0), F.col("value")))
    return stage(holes), x


@pytest.mark.parametrize("mixing", ["rows", "factor"])
def test_samples_keep_correlation_and_missing_rate(spark, correlated, mixing):
    cells, x = correlated
    families = spark.createDataFrame([(f"x{j}", "norm") for j in range(3)], "feature string, family string")
    model = copula.fit_model(cells, families)
    drawn = copula.sample(cells, model, 4000, 9, mixing=mixing).toPandas()
    wide = drawn.pivot(index="synth", columns="feature", values="value")
    assert len(wide) == 4000
    assert wide["x0"].corr(wide["x1"]) == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs=0.04)
    assert wide["x2"].isna().mean() == pytest.approx(0.25, abs=0.03)
    assert wide["x0"].isna().sum() == 0
    assert wide["x0"].min() >= x[:, 0].min() and wide["x0"].max() <= x[:, 0].max()
    assert np.allclose(wide["x0"] * 1000, np.round(wide["x0"] * 1000))


def test_draws_do_not_depend_on_partitions_or_tiles(spark, correlated, monkeypatch):
    cells, _ = correlated
    families = spark.createDataFrame([(f"x{j}", "norm") for j in range(3)], "feature string, family string")
    model = copula.fit_model(cells, families)
    z = stage(copula.standardise(copula.normal_scores(cells, model)))
    one = {(r["synth"], r["feature"]): r["z"] for r in copula.latent_draws(z, 50, 4, 1200, 3, "rows").collect()}
    monkeypatch.setattr(copula, "ROW_TILE", 100)
    monkeypatch.setattr(copula, "FEATURE_TILE", 1)
    two = {(r["synth"], r["feature"]): r["z"] for r in copula.latent_draws(z.repartition(5), 50, 4, 1200, 3, "rows").collect()}
    assert one.keys() == two.keys()
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9
    gram = {(r[0], r[1]): r[2] for r in copula.correlation(z, 1200, 3).collect()}
    assert len(gram) == 6 and gram[("x0", "x0")] == pytest.approx(1.0)
    wide = z.toPandas().pivot(index="id", columns="feature", values="z")
    assert gram[("x0", "x1")] == pytest.approx(wide["x0"].corr(wide["x1"]), abs=1e-9)
    three = {(r["synth"], r["feature"]): r["z"] for r in copula.latent_draws(z, 50, 4, 1200, 3, "factor").collect()}
    monkeypatch.setattr(copula, "ROW_TILE", 8192)
    four = {(r["synth"], r["feature"]): r["z"] for r in copula.latent_draws(z, 50, 4, 1200, 3, "factor").collect()}
    assert max(abs(three[k] - four[k]) for k in three) < 1e-9


@pytest.mark.parametrize("block", [2, 3, 100])
def test_reduced_rows_keep_all_cross_products(spark, block):
    """More columns than one block holds, one column the sum of two others, one constant zero."""
    rng = np.random.default_rng(15)
    z = rng.normal(size=(60, 7))
    z[:, 3] = z[:, 0] + z[:, 1]
    z[:, 5] = 0.0
    scores = cells_of(spark, {f"f{j}": z[:, j] for j in range(7)}).withColumnRenamed("value", "z").repartition(3)
    reduced = stage(copula.reduce_rows(scores, 60, 7, block)).toPandas()
    wide = reduced.pivot(index="id", columns="feature", values="z").fillna(0.0)
    assert len(wide) == 5 and sorted(wide.index) == list(range(5))
    assert np.allclose(wide.to_numpy().T @ wide.to_numpy(), z.T @ z, atol=1e-9)
    drawn = copula.latent_draws(scores, 6000, 3, 60, 7, "factor", block=block).toPandas().pivot(index="synth", columns="feature", values="z")
    want = z.T @ z / 60
    assert np.allclose(drawn.to_numpy().T @ drawn.to_numpy() / 6000, want, atol=0.12 * want.max())


def test_categories_roundtrip(spark):
    rows = spark.createDataFrame([(i, "abbcccdddd"[i % 10], i % 3) for i in range(200)], "id bigint, c string, n int")
    levels = copula.category_levels(rows, ["c", "n"])
    encoded = copula.encode_categories(rows, ["c", "n"], levels)
    decoded = {(r["id"], r["feature"]): r["level"] for r in copula.decode_categories(encoded, levels).collect()}
    assert decoded == {(r["id"], f): str(r[f]) for r in rows.collect() for f in ("c", "n")}
    edges = spark.createDataFrame([("c", 0.0), ("c", 1.0)], "feature string, value double")
    assert copula.decode_categories(edges, levels).count() == 2


def test_low_count_fill_is_exact(spark):
    stats = stage(spark.createDataFrame([("u", 4.9, 7), ("v", 0.5, 9)], "feature string, mean double, n_zero bigint"))
    out = assemble.low_count_fill(stats, 10, 42).toPandas()
    assert (out.groupby("feature")["value"].apply(lambda v: (v == 0).sum())).to_dict() == {"u": 7, "v": 9}
    assert sorted(out[out.feature == "u"].synth) == list(range(10))
    with pytest.raises(ValueError, match="not found"):
        assemble.fill_from(stats, ["u", "nope"], stats)


def test_synth_index_spans_chunks(spark):
    out = assemble.synth_index(spark.createDataFrame([("a",)], "f string"), 10_000)
    assert out.agg(F.count("*"), F.count_distinct("synth"), F.max("synth")).first() == (10_000, 10_000, 9_999)


def test_merge_needs_equal_lists(spark):
    with pytest.raises(ValueError, match="do not pair"):
        assemble.merge_pairs([spark.range(1)], [])


def brute_ks(a, b):
    both = np.sort(np.concatenate([a, b]))
    return max(abs(np.searchsorted(np.sort(a), both, "right") / len(a) - np.searchsorted(np.sort(b), both, "right") / len(b)))


def brute_kl(sample, original):
    def kde(v, x):
        h = np.std(v, ddof=1) * len(v) ** -0.2
        return (np.exp(-0.5 * ((x[:, None] - v) / h) ** 2) / (h * math.sqrt(2 * math.pi))).mean(axis=1)

    x = np.linspace(min(sample.min(), original.min()), max(sample.max(), original.max()), 1000)
    p, q = kde(original, x), kde(sample, x)
    ok = (p > 0) & (q > 0)
    return float((p[ok] * np.log(p[ok] / q[ok])).sum())


@pytest.fixture(scope="module")
def two_tables(spark):
    rng = np.random.default_rng(11)
    made = {f: np.round(rng.lognormal(1, 0.7, 60) * (rng.random(60) > 0.2), 1) for f in ("a", "b", "c")}
    real = {f: np.round(rng.lognormal(1.1, 0.7, 40) * (rng.random(40) > 0.25), 1) for f in ("a", "b", "c")}
    return stage(cells_of(spark, made)), stage(cells_of(spark, real)), made, real


def test_ks_and_kl_against_numpy(two_tables):
    made, real, m, r = two_tables
    for row in evaluate.ks_test(made, real).collect():
        assert row["ks"] == pytest.approx(brute_ks(m[row["feature"]], r[row["feature"]]), abs=1e-12)
        assert 0 <= row["ks_p"] <= 1 and (row["n1"], row["n2"]) == (60, 40)
    for row in evaluate.kl_divergence(made, real).collect():
        assert row["kl_divergence"] == pytest.approx(brute_kl(m[row["feature"]], r[row["feature"]]), rel=1e-9)


def test_kl_without_spread_is_null(spark, two_tables):
    _, real, *_ = two_tables
    flat = real.withColumn("value", F.lit(1.0))
    assert {r["kl_divergence"] for r in evaluate.kl_divergence(flat, real).collect()} == {None}


def test_replicate_distances_against_numpy(two_tables):
    made, real, m, r = two_tables
    samples = stage(bs.draw_samples(made.select("id").distinct(), 20, 6, 42))
    assert samples.groupBy("draw").agg(F.count_distinct("id").alias("n")).filter("n <> 20").count() == 0
    picks = {}
    for row in samples.collect():
        picks.setdefault(row["draw"], []).append(row["id"])
    for row in bs.replicate_distances(samples, made, real).collect():
        want = brute_ks(m[row["feature"]][picks[row["draw"]]], r[row["feature"]])
        assert row["ks"] == pytest.approx(want, abs=1e-12)
    seed = samples.filter("draw = 3").first()["seed"]
    again = {x["id"] for x in bs.sample_by_seed(made.select("id").distinct(), 20, seed).collect()}
    assert again == set(picks[3])


@pytest.mark.parametrize("cells", [40, 1 << 22])
def test_distances_with_hot_values_and_gaps(spark, monkeypatch, cells):
    """One value holds most cells and is cut by ranges and blocks; one feature lacks cells and has nulls."""
    monkeypatch.setattr(bs, "SWEEP_CELLS", cells)
    monkeypatch.setattr(bs, "DRAW_BLOCK", 4)
    rng = np.random.default_rng(21)
    made = {"hot": np.where(rng.random(400) < 0.8, 0.0, rng.integers(1, 9, 400)).astype(float), "gaps": rng.normal(size=400)}
    made["only"] = rng.random(400)
    rows = [(k, f, None if f == "gaps" and k % 5 == 0 else float(v)) for f, own in made.items() for k, v in enumerate(own) if f != "gaps" or k % 7]
    real = {"hot": np.where(rng.random(90) < 0.6, 0.0, rng.integers(0, 12, 90)).astype(float), "gaps": rng.normal(0.3, 1, 90)}
    synthetic = stage(spark.createDataFrame(rows, "id bigint, feature string, value double").repartition(3))
    samples = stage(bs.draw_samples(synthetic.select("id"), 100, 10, 5))
    picks = {}
    for r in samples.collect():
        picks.setdefault(r["draw"], set()).add(r["id"])
    assert {len(p) for p in picks.values()} == {100}
    got = {(r["draw"], r["feature"]): r for r in bs.replicate_distances(samples, synthetic, stage(cells_of(spark, real))).collect()}
    assert len(got) == 20
    for (draw, feature), r in got.items():
        own = np.array([v for k, f, v in rows if f == feature and v is not None and k in picks[draw]])
        assert (r["n1"], r["n2"]) == (len(own), 90)
        assert r["ks"] == pytest.approx(brute_ks(own, real[feature]), abs=1e-12)
    empty = samples.filter("draw < 0")
    assert bs.replicate_distances(empty, synthetic, synthetic).count() == 0


def test_samples_beyond_the_ids_take_all(spark):
    ids = spark.range(7).withColumnRenamed("id", "n").select((F.col("n") * 10).alias("id"))
    drawn = bs.draw_samples(ids, 50, 2, 1).collect()
    assert sorted((r["draw"], r["id"]) for r in drawn) == [(d, 10 * k) for d in range(2) for k in range(7)]
    assert bs.draw_samples(ids, 0, 3, 1).count() == 0


def test_cut_kernels_equal_whole_ones():
    rng = np.random.default_rng(2)
    values, weights = np.sort(rng.standard_cauchy(3000) * 5), rng.integers(1, 4, 3000).astype(float)
    grid = np.linspace(values[0], values[-1], 500)
    for kind in ("pdf", "cdf"):
        acc = np.zeros(500)
        kernels._add(acc, grid, values, weights, 0.7, kind)
        d = (grid[None] - values[:, None]) / 0.7
        whole = np_norm_cdf(d) if kind == "cdf" else np.exp(-0.5 * d * d) / (0.7 * math.sqrt(2 * math.pi))
        assert np.allclose(acc, weights @ whole, rtol=1e-12, atol=0)
        assert ((acc > 0) == (weights @ whole > 0)).all()


def test_a_family_that_does_not_apply_gives_way_to_the_uniform(spark):
    flat = np.linspace(0, 1, 200)
    cells = stage(cells_of(spark, {"flat": np.round(np.where(flat < 0.5, flat**4, 1 - (1 - flat) ** 4), 4)}))
    families = spark.createDataFrame([("flat", "truncnorm")], "feature string, family string")
    model = copula.fit_model(cells, families)
    assert model.first()["family"] == "uniform"
    drawn = [r["value"] for r in copula.sample(cells, model, 400, 3).collect()]
    assert 0.3 < np.mean(drawn) < 0.7 and 0 <= min(drawn) and max(drawn) <= 1


def test_locations_are_searched(spark):
    rng = np.random.default_rng(31)
    x = {"gamma": rng.gamma(3.0, 2.0, 6000) - 40, "lognorm": np.exp(rng.normal(1.0, 0.4, 6000)) + 70, "flat": np.full(50, 3.0)}
    cells = stage(cells_of(spark, x))
    fits = {r["feature"]: r for r in marginals.fit(cells, ["gamma", "lognorm"], locate=["gamma", "lognorm"]).collect()}
    g, log = fits["gamma"]["gamma"], fits["lognorm"]["lognorm"]
    assert g["loc"] == pytest.approx(-40, abs=0.5) and g["a"] == pytest.approx(3, rel=0.2) and g["scale"] == pytest.approx(2, rel=0.1)
    assert log["loc"] == pytest.approx(70, abs=0.3) and log["s"] == pytest.approx(0.4, rel=0.15)
    assert fits["flat"]["gamma"] is None and fits["flat"]["lognorm"] is None
    y = x["gamma"] - g["loc"]
    for near in (0.97, 1.03):  # no better place close by
        z = x["gamma"] - (x["gamma"].min() - near * (x["gamma"].min() - g["loc"]))
        likelihood = lambda v: (lambda t: (lambda a: (a - 1) * np.log(v).mean() - a - a * math.log(t) - math.lgamma(a))(v.mean() / t))(np.cov(v, np.log(v), bias=True)[0, 1])
        assert likelihood(y) >= likelihood(z) - 1e-4
    families = spark.createDataFrame([("gamma", "gamma"), ("lognorm", "lognorm")], "feature string, family string")
    model = copula.fit_model(cells.filter("feature <> 'flat'"), families, locate=["gamma", "lognorm"])
    drawn = copula.sample(cells.filter("feature <> 'flat'"), model, 4000, 2).toPandas()
    for f in ("gamma", "lognorm"):
        assert drawn[drawn.feature == f]["value"].mean() == pytest.approx(x[f].mean(), abs=0.2)
    assert marginals.select_family(cells, ["norm", "gamma"], "aic", locate=["gamma"]).filter("feature = 'gamma'").first()["family"] == "gamma"
    with pytest.raises(ValueError, match="searched for"):
        marginals.fit(cells, ["norm"], locate=["norm"])


def sequential_best(order, kl, p):
    """The rule as a plain walk over the tied replicates."""
    best = order[0]
    for d in order[1:]:
        if sum(a < b for a, b in zip(kl[d], kl[best])) / p > 0.5:
            best = d
    return best


@pytest.mark.parametrize("round_size", [1000, 3])
def test_best_replicate_matches_a_plain_walk(spark, monkeypatch, round_size):
    monkeypatch.setattr(bs, "ROUND", round_size)
    rng = random.Random(2)
    for trial in range(3):
        order = sorted(rng.sample(range(50), 9))
        kl = {d: [rng.random() for _ in range(5)] for d in order}
        kl[order[4]][2] = float("nan")
        rows = [(d, f"f{i}", v) for d in order for i, v in enumerate(kl[d])]
        table = spark.createDataFrame(rows, "draw bigint, feature string, kl_divergence double")
        tied = spark.createDataFrame([(d,) for d in order], "draw bigint")
        assert bs.select_best(tied, table, 5) == sequential_best(order, kl, 5)


def test_scores_truncate_to_three_decimals(spark):
    distances = spark.createDataFrame(
        [(0, f"f{i}", 20, 20, 0.9 if i < 2 else 0.1) for i in range(3)] + [(1, f"f{i}", 20, 20, 0.1) for i in range(3)],
        "draw bigint, feature string, n1 bigint, n2 bigint, ks double",
    )
    got = {r["draw"]: r["ks"] for r in bs.replicate_scores(distances, 3, 1).collect()}
    assert got == {0: 0.666, 1: 0.0}
    with pytest.raises(ValueError, match="no feature"):
        bs.replicate_scores(distances, 0, 1)


def test_constraint(spark):
    rule = copula.Inequality("lo", "hi")
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 3.0), (3, 5.0, 9.5)], "id bigint, lo double, hi double")
    assert copula.count_violations(df, rule).first() == (3, 1)
    assert copula.count_violations(df, copula.Inequality("lo", "hi", strict=False)).first() == (3, 0)
    back = copula.close_constraint(copula.open_constraint(df, rule), rule, digits=1)
    assert [r["hi"] for r in back.orderBy("id").collect()] == [2.0, 3.1, 9.5]



CHAINS = [
    [("a", "b"), ("b", "c")],
    [("b", "c"), ("a", "b")],
    [("a", "c"), ("b", "c")],
    [("a", "b"), ("a", "c"), ("c", "d"), ("b", "d")],
]


@pytest.mark.parametrize("pairs", CHAINS)
@pytest.mark.parametrize("strict", [True, False])
def test_chained_rules_hold_after_independent_draws(spark, pairs, strict):
    rules = [copula.Inequality(a, b, strict) for a, b in pairs]
    rng = np.random.default_rng(5)
    low = rng.integers(0, 50, (300, 4)) + np.cumsum(rng.integers(1, 40, (300, 4)), axis=1) * 50
    if pairs == CHAINS[2]:
        low[:, 1] = rng.integers(0, 100, 300)
    rows = [(k, float(a) / 7, float(b), float(c) / 10, float(d)) for k, (a, b, c, d) in enumerate(np.sort(low, axis=1).tolist())]
    rows = [(k, a, max(b, a + 1), max(c, b, a) + 101, max(d, c, b, a) + 202) for k, a, b, c, d in rows]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double")
    df = df.withColumn("b", F.ceil("b").cast("double")).withColumn("d", F.ceil("d").cast("double"))
    broken = lambda t: [r for r in rules if t.filter(~r.holds()).count()]
    assert not broken(df)
    digits = {"b": 0, "c": 1, "d": 0}
    opened = copula.open_constraints(df, rules).orderBy("id").toPandas()
    same = copula.close_constraints(spark.createDataFrame(opened), rules, 9).orderBy("id").toPandas()
    assert np.allclose(same, df.orderBy("id").toPandas(), rtol=1e-9, atol=1e-8)
    for column in "abcd":  # each column from rows of its own
        opened[column] = rng.permutation(opened[column].to_numpy()) if column != "a" else opened[column]
    closed = copula.close_constraints(spark.createDataFrame(opened), rules, digits)
    assert not broken(closed)
    assert closed.filter(F.col("b") != F.floor("b")).count() == 0


def test_rules_in_a_circle_are_an_error():
    circle = [copula.Inequality("a", "b"), copula.Inequality("b", "c"), copula.Inequality("c", "a")]
    with pytest.raises(ValueError, match="circle"):
        copula.ordered_rules(circle)
    with pytest.raises(ValueError, match="circle"):
        copula.ordered_rules([copula.Inequality("a", "a")])


def test_heavy_tails_are_fitted(spark):
    rng = np.random.default_rng(12)
    cells = stage(cells_of(spark, {"cauchy": rng.standard_cauchy(8000) * 3 + 7, "normal": rng.normal(5, 2, 8000)}))
    fits = {r["feature"]: r["t"] for r in mg.fit(cells, ["t"]).collect()}
    assert fits["cauchy"]["df"] == pytest.approx(1.0, rel=0.1)
    assert fits["cauchy"]["scale"] == pytest.approx(3.0, rel=0.1) and fits["cauchy"]["loc"] == pytest.approx(7.0, abs=0.3)
    assert fits["normal"]["df"] > 15 and fits["normal"]["scale"] == pytest.approx(2.0, rel=0.05)


def test_polygamma_values():
    y = np.array([0.5, 1.0, 3.0])
    assert np.allclose(mg.digamma(y), [-1.9635100260214235, -0.5772156649015329, 0.9227843350984671], atol=1e-9)
    assert np.allclose(mg.trigamma(y), [math.pi**2 / 2, math.pi**2 / 6, math.pi**2 / 6 - 1.25], atol=1e-9)
    assert np.allclose(mg.tetragamma(y), [-16.8287966442, -2.4041138063, -0.1541138063], atol=1e-8)


def test_kde_alone_by_information(simulated):
    got = mg.select_family(simulated, ["gaussian_kde"], "aic").collect()
    assert {r["family"] for r in got} == {"gaussian_kde"} and {r["score"] for r in got} == {None}


def test_fine_decimals_survive(spark):
    df = spark.createDataFrame([(1e-9, 3e-9), (5.0, 5.00000001), (1e15, 2e15)], "low double, high double")
    rule = copula.Inequality("low", "high")
    digits = df.agg(F.max(copula.decimals(F.col("high")))).first()[0]
    assert digits == 9
    back = copula.close_constraint(copula.open_constraint(df, rule), rule, digits)
    assert back.filter(~rule.holds()).count() == 0
    value = copula.clip_round(F.lit(0.123456784), F.lit(0.0), F.lit(1.0), F.lit(8))
    assert spark.range(1).select(value.alias("v")).first()["v"] == pytest.approx(0.12345678, abs=1e-15)


def test_mixing_is_never_chosen_from_the_data(spark, correlated):
    cells, _ = correlated
    families = spark.createDataFrame([(f"x{j}", "norm") for j in range(3)], "feature string, family string")
    model = copula.fit_model(cells, families)
    with pytest.raises(ValueError, match="mixing"):
        copula.sample(cells, model, 5, 1, mixing="auto")
    same = [sorted(map(tuple, copula.sample(cells, model, 5, 1, **how).collect()), key=str) for how in ({}, {"mixing": "rows"})]
    assert same[0] == same[1]


def test_a_family_of_your_own(spark):
    """A Laplace family, registered here, is fitted, selected, scored and drawn."""

    def fit():
        b = F.col("sd") / F.sqrt(F.lit(2.0))
        return F.col("sd") > 0, {"loc": F.col("mean"), "scale": b}, -F.ln(2.0 * b)

    def table(p, low, high):
        x = np.linspace(p["loc"] - 40 * p["scale"], p["loc"] + 40 * p["scale"], 20001)
        y = (x - p["loc"]) / p["scale"]
        return x, np.where(y < 0, 0.5 * np.exp(np.minimum(y, 0)), 1 - 0.5 * np.exp(-np.maximum(y, 0)))

    laplace = mg.Family(("loc", "scale"), lambda x, p: p("c0") - F.abs(x - p("loc")) / p("scale"), fit=fit, table=table)
    mg.register_family("laplace", laplace)
    try:
        x = np.random.default_rng(4).laplace(20, 2, 4000)
        cells = stage(cells_of(spark, {"peaked": x}))
        assert {r["family"] for r in mg.select_family(cells, ["norm", "laplace", "lognorm"], "aic").collect()} == {"laplace"}
        families = spark.createDataFrame([("peaked", "laplace")], "feature string, family string")
        model = copula.fit_model(cells, families)
        drawn = np.array([r["value"] for r in copula.sample(cells, model, 3000, 1).collect()])
        assert np.mean(np.abs(drawn - 20)) == pytest.approx(2.0, rel=0.1) and np.median(drawn) == pytest.approx(20, abs=0.3)
    finally:
        del mg.REGISTRY["laplace"]
    with pytest.raises(ValueError, match="needs"):
        mg.register_family("half", mg.Family(("loc",), None))


def test_groups_mixed_by_reduced_rows(spark):
    """Overlapping ids, a constant feature, and the covariance of each group's own rows."""
    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([5, 9], [[1, 0.7], [0.7, 1]], 900)
    y = rng.multivariate_normal([5, 9], [[1, -0.6], [-0.6, 1]], 500)
    rows = [(i, f"{part}{copula.PART_MARK}f{j}", float(v)) for part, own in enumerate((x, y)) for i, r in enumerate(own) for j, v in enumerate([*r, 3.0])]
    cells = stage(spark.createDataFrame(rows, "id bigint, feature string, value double"))
    model = copula.fit_model(cells, cells.select("feature").distinct().withColumn("family", F.lit("norm")))
    drawn = copula.sample_parts(cells, model, [(0, 9000), (9000, 14000)], 3, mixing="factor").toPandas()
    assert len(drawn) == 3 * 14000
    for part, own, span in ((0, x, range(0, 9000)), (1, y, range(9000, 14000))):
        wide = drawn[drawn["feature"].str.startswith(f"{part}{copula.PART_MARK}")].pivot(index="synth", columns="feature", values="value")
        assert sorted(wide.index) == list(span)
        a, b, c = (wide[f"{part}{copula.PART_MARK}f{j}"] for j in range(3))
        assert a.corr(b) == pytest.approx(np.corrcoef(own.T)[0, 1], abs=0.04) and set(c) == {3.0}
        assert a.mean() == pytest.approx(own[:, 0].mean(), abs=0.06)


def test_mixing_does_not_copy_tiles_for_each_stretch(spark, monkeypatch):
    """Rows of scores travel at most a few times, however many synthetic rows are drawn from them."""
    monkeypatch.setattr(copula, "SYNTH_TILE", 16)
    monkeypatch.setattr(copula, "ROW_TILE", 4)
    monkeypatch.setattr(copula, "HELD_SUMS", 8)
    scores = spark.range(64).select("id", F.lit("f").alias("feature"), F.lit(1.0).alias("z"))
    met = []
    spread = copula._spread_tiles
    monkeypatch.setattr(copula, "_spread_tiles", lambda tiles, *keys: (met.append(tiles.count()), spread(tiles, *keys))[1])
    z = [r["z"] for r in copula.mix_rows(scores, 1000, 7, 64, 1, 64).orderBy("synth").collect()]
    e = np_norm_ppf(counter.uniform_grid(7, np.arange(1000), np.arange(64)))
    assert met == [64] and np.allclose(z, e.sum(1) / 8, atol=1e-12)


@pytest.mark.parametrize("few", [True, False])
def test_drawn_distances_make_no_sample_rows(spark, monkeypatch, few):
    """Counted by value or swept, draws have the distances of their samples and their weighted cells; seeds may be shared."""
    if not few:
        monkeypatch.setattr(bs, "COUNT_VALUES", 0)
    monkeypatch.setattr(bs, "SEED_RANGE", 5)
    rng = np.random.default_rng(31)
    made = {"whole": rng.integers(0, 4, 700).astype(float), "zeros": np.where(rng.random(700) < 0.7, 0.0, 2.5)}
    rows = [(3 * k + 1, f, None if f == "zeros" and k % 9 == 0 else float(v)) for f, own in made.items() for k, v in enumerate(own)]
    synthetic = stage(spark.createDataFrame(rows, "id bigint, feature string, value double").repartition(3))
    original = stage(cells_of(spark, {"whole": rng.integers(0, 6, 80).astype(float), "zeros": rng.integers(0, 2, 80) * 2.5}))
    ids = synthetic.select("id").distinct()
    assert bs._counted(bs.numbered(ids), 700, 200, [1], synthetic, original) is not None or not few
    samples = stage(bs.draw_samples(ids, 200, 12, 42))
    assert samples.groupBy("draw").agg(F.count_distinct("id").alias("n")).filter("n = 200").count() == 12
    want = {(r["draw"], r["feature"]): r for r in bs.replicate_distances(samples, synthetic, original).collect()}
    monkeypatch.setattr(bs, "draw_samples", None)
    drawn = bs.drawn_distances(ids, 200, 12, 42, synthetic, original)
    got = {(r["draw"], r["feature"]): r for r in drawn.distances.collect()}
    assert got.keys() == want.keys() and len(got) == 24
    for key, r in got.items():
        assert (r["n1"], r["n2"]) == (want[key]["n1"], want[key]["n2"]) and r["ks"] == pytest.approx(want[key]["ks"], abs=1e-12)
    some = stage(samples.select("draw", "seed").distinct().filter("draw % 4 = 1"))
    plain = stage(some.select("draw").join(samples, "draw").join(synthetic, "id").select("draw", "feature", "value"))
    cells = stage(drawn.cells(some))
    assert cells.agg(F.sum("weight")).first()[0] == plain.filter("value is not null").count()
    kl = lambda df: {(r["draw"], r["feature"]): r["kl_divergence"] for r in evaluate.kl_divergence(df, original, draws=["draw"], nan_policy="zero").collect()}
    one, two = kl(plain), kl(cells)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)


def test_counting_shuffles_no_product_of_cells_and_draws():
    """Copies of lines and vectors together stay near the root of their product, whatever the number of cells; vectors held are bounded."""
    for copies, seeds in ((1, 200), (10, 1900), (60, 7200), (600, 10_000)):
        n = 54_000 * copies
        lines, vectors = 4 * 25 * n + 16 * n, 4 * 5_500 * seeds
        chunks, blocks = bs._dealt(n * seeds, lines, vectors, seeds, 12)
        assert chunks * blocks <= 2 * 4 * 12
        assert chunks * vectors + blocks * lines < 30e6 * copies * 16
        assert vectors / blocks <= bs.COUNT_BYTES
    assert bs._dealt(10**12, 1 << 20, 1 << 32, 10_000, 1)[1] >= 64
    assert bs._dealt(100, 0, 0, 3, 8) == (1, 1)


@pytest.mark.parametrize("cells", [60, 1 << 22])
def test_units_of_ids_and_seeds_add_up(spark, monkeypatch, cells):
    """Units, slices, words of seeds and stretches beyond 255 ids count what the samples' rows hold; bits meet cells without copies."""
    monkeypatch.setattr(bs, "COUNT_PAIRS", 40)
    monkeypatch.setattr(bs, "UNIT_CELLS", cells)
    on = []
    plain = bs.attach
    monkeypatch.setattr(bs, "attach", lambda big, small, keys, **more: on.append(keys) or plain(big, small, keys, **more))
    rng = np.random.default_rng(8)
    made = {"hot": np.where(rng.random(2000) < 0.9, 0.0, 1.0), "few": rng.integers(0, 5, 2000).astype(float)}
    rows = [(k * 7, f, float(v)) for f, own in made.items() for k, v in enumerate(own) if f == "hot" or k % 3]
    synthetic = stage(spark.createDataFrame(rows, "id bigint, feature string, value double").repartition(5))
    original = stage(cells_of(spark, {"hot": np.zeros(9), "few": rng.integers(0, 7, 9).astype(float)}))
    ids = synthetic.select("id").distinct()
    samples = stage(bs.draw_samples(ids, 900, 21, 42))
    drawn = bs.drawn_distances(ids, 900, 21, 42, synthetic, original)
    got = {(r["draw"], r["feature"], r["value"]): r["weight"] for r in drawn.cells(samples.select("draw", "seed").distinct()).collect()}
    want = samples.join(synthetic, "id").groupBy("draw", "feature", "value").count().collect()
    assert got == {(r["draw"], r["feature"], r["value"]): r["count"] for r in want}
    swept = {(r["draw"], r["feature"]): r["ks"] for r in bs.replicate_distances(samples, synthetic, original).collect()}
    assert swept == pytest.approx({(r["draw"], r["feature"]): r["ks"] for r in drawn.distances.collect()}, abs=1e-12)
    assert on and ["id"] not in on


def test_rows_are_dealt_evenly_before_they_are_reduced(spark, monkeypatch):
    """Scores that come in one part are read by several tasks, with whole ids and about as many rows each."""
    scores = spark.range(600).select(F.explode(F.array(*[F.struct("id", F.lit(f"x{j}").alias("feature"), F.sin(F.col("id") * (j + 1)).alias("z")) for j in range(4)])).alias("c")).select("c.*")
    seen = []
    tiles = copula._cross_tiles
    monkeypatch.setattr(copula, "_cross_tiles", lambda df, *more: seen.append(df) or tiles(df, *more))
    reduced = copula.reduce_rows(scores.coalesce(1), 600, 4, 2)
    per = [r["count"] for r in seen[0].groupBy(F.input_file_name().alias("file")).count().collect()]
    assert len(per) > 1 and sum(per) == 2400 and max(per) < 2400 * 2 / len(per) and all(n % 4 == 0 for n in per)
    gram = lambda df: {(r["a"], r["b"]): r["s"] for r in df.alias("l").join(df.alias("r"), "id").groupBy(F.col("l.feature").alias("a"), F.col("r.feature").alias("b")).agg(F.sum(F.col("l.z") * F.col("r.z")).alias("s")).collect()}
    assert gram(reduced) == pytest.approx(gram(scores), abs=1e-6)


def test_mixing_deals_tiles_evenly(spark, monkeypatch):
    """No task has two tiles more than another."""
    monkeypatch.setattr(copula, "ROW_TILE", 4)
    dealt = []
    spread = copula._spread_tiles

    def watched(tiles, *keys):
        grouped = spread(tiles, *keys)
        own = grouped.applyInPandas(lambda pdf: pdf[["rc", "fb", "turn"]].head(1).assign(p=TaskContext.get().partitionId()), "rc int, fb int, turn int, p int")
        dealt.extend(r["p"] for r in own.collect())
        return grouped

    monkeypatch.setattr(copula, "_spread_tiles", watched)
    scores = spark.range(400).select("id", F.lit("f").alias("feature"), F.lit(1.0).alias("z"))
    z = [r["z"] for r in copula.mix_rows(scores, 20, 7, 400, 1, 400).orderBy("synth").collect()]
    e = np_norm_ppf(counter.uniform_grid(7, np.arange(20), np.arange(400)))
    assert np.allclose(z, e.sum(1) / 20, atol=1e-12)
    hits = np.bincount(dealt, minlength=4)
    assert len(dealt) > 90 and hits.max() - hits.min() < 5


def test_cells_meet_their_tables_without_null_arrays(spark, monkeypatch):
    """A null array makes Spark go through all nulls before it in the batch, for each row."""
    sent = []
    plain = type(spark.range(1)).mapInArrow

    def watched(df, *args):
        sent.append(df.filter(F.col("table").isNull()).count())
        return plain(df, *args)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", watched)
    rows = spark.range(50).select("id", F.lit("f").alias("feature"), (F.col("id") / 49.0).alias("x"))
    tables = spark.range(1).select(F.lit("f").alias("feature"), F.expr("transform(sequence(0, 10), k -> k * 3D)").alias("t"), F.lit(0.0).alias("first"), F.lit(1.0).alias("last"))
    found = {r["id"]: r["y"] for r in copula._looked_up(rows, tables, "id", "x", "t", 3).collect()}
    assert sent == [0] and len(found) == 50
    assert all(y == pytest.approx(30.0 * k / 49.0) for k, y in found.items())
