import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.functions import counter, kolmogorov, normal, permutation


def test_counter_agrees_between_columns_and_numpy(spark):
    df = spark.range(500).select((F.col("id") % 9).alias("s"), (F.col("id") * 7_919_000_003 - 40).alias("i"))
    rows = counter.with_uniform(df, "u", 3, "s", "i").collect()
    for r in rows[::25]:
        assert counter.uniform_grid(3, [r["s"]], [r["i"]])[0, 0] == r["u"]
    u = np.array([r["u"] for r in rows])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05


def test_counter_is_uniform_and_uncorrelated():
    u = counter.uniform_grid(1, np.arange(300), np.arange(300))
    counts, _ = np.histogram(u, bins=50, range=(0, 1))
    assert abs(counts - 1800).max() < 6 * math.sqrt(1800)
    rows = np.corrcoef(u)
    assert abs(rows[np.triu_indices(300, 1)]).max() < 0.32
    assert len(np.unique(u)) == u.size


def test_counter_does_not_depend_on_partitioning(spark):
    df = spark.range(200)
    a = counter.with_uniform(df.repartition(1), "u", 5, "id").orderBy("id").collect()
    b = counter.with_uniform(df.repartition(7), "u", 5, "id").orderBy("id").collect()
    assert a == b


def test_filter_on_uniform_stays_small(spark):
    plan = counter.with_uniform(spark.range(10), "u", 5, "id", "id").filter("u < 0.5")
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_normal_functions(spark):
    nd = statistics.NormalDist()
    u = [1e-12, 1e-6, 0.01, 0.074, 0.3, 0.5, 0.7, 0.93, 0.999999, 1 - 1e-12]
    df = normal.with_norm_ppf(spark.createDataFrame([(v,) for v in u], "u double"), "u", "z")
    for r in df.withColumn("c", normal.norm_cdf("z")).collect():
        assert r["z"] == pytest.approx(nd.inv_cdf(r["u"]), rel=1e-12, abs=1e-14)
        assert r["c"] == pytest.approx(r["u"], rel=1e-9)
    x = np.linspace(-9, 9, 101)
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in x]
    assert np.allclose(normal.np_norm_cdf(x), want, rtol=1e-8, atol=1e-15)


def test_ln_gamma(spark):
    xs = [0.01, 0.3, 0.5, 1.0, 2.5, 17.0, 250.0, 1e5]
    df = spark.createDataFrame([(v,) for v in xs], "x double")
    for r in df.withColumn("g", normal.ln_gamma("x")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-11, abs=1e-12)


def brute_force_ks(n1, n2, steps):
    """Share of all orders of the pooled sample whose distance reaches steps / lcm."""
    from itertools import combinations

    lcm = math.lcm(n1, n2)
    hit = total = 0
    for first in combinations(range(n1 + n2), n1):
        chosen, i, j, worst = set(first), 0, 0, 0
        for k in range(n1 + n2):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            worst = max(worst, abs(i * (lcm // n1) - j * (lcm // n2)))
        hit += worst >= steps
        total += 1
    return hit / total


@pytest.mark.parametrize("n1,n2", [(3, 3), (4, 5), (6, 4), (7, 2)])
def test_exact_ks_matches_enumeration(n1, n2):
    for steps in range(0, math.lcm(n1, n2) + 1, 3):
        assert kolmogorov.exact_sf(n1, n2, steps) == pytest.approx(brute_force_ks(n1, n2, steps), abs=1e-12)


def test_ks_limit_and_critical_distance(spark):
    # known value of the limit distribution
    assert kolmogorov.np_limit_sf(1.3580986) == pytest.approx(0.05, abs=1e-6)
    ts = [0.2, 0.5, 0.99, 1.0, 1.01, 1.36, 2.5]
    df = spark.createDataFrame([(t,) for t in ts], "t double").withColumn("p", kolmogorov.limit_sf(F.col("t")))
    for r in df.collect():
        assert r["p"] == pytest.approx(kolmogorov.np_limit_sf(r["t"]), abs=1e-12)
    for n1, n2 in [(20, 30), (50, 50)]:
        d = kolmogorov.critical_distance(n1, n2, 0.05)
        lcm = math.lcm(n1, n2)
        assert kolmogorov.two_sample_p(n1, n2, d) < 0.05 <= kolmogorov.two_sample_p(n1, n2, d - 1 / lcm)
    # both methods agree for large samples
    assert kolmogorov.two_sample_p(2000, 3000, 0.04, "exact") == pytest.approx(
        kolmogorov.two_sample_p(2000, 3000, 0.04, "asymptotic"), abs=2e-3
    )


def test_pairs_equal_the_grid():
    outer, inner = np.array([3, -7, 2**40]), np.array([0, 5, 2**45 + 1])
    grid = counter.uniform_grid(9, outer, inner)
    assert counter.uniform_pairs(9, outer, inner).tolist() == np.diag(grid).tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1024, 1025, 5000])
def test_permutations_are_one_to_one(n):
    a, b = permutation.digits(n)
    assert a * b >= n and (a - 1) ** 2 < n
    seeds = np.full(n, 77)
    out = permutation.permuted(5, seeds, np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    some = permutation.permuted(5, seeds[: n // 2], np.arange(n)[n // 2 :][: n // 2], n)
    assert some.tolist() == out[n // 2 :][: n // 2].tolist()


def test_permutations_pick_every_id_alike():
    n, size, draws = 60, 15, 4000
    seeds, places = np.repeat(np.arange(draws), size), np.tile(np.arange(size), draws)
    hits = np.bincount(permutation.permuted(7_001, seeds, places, n), minlength=n)
    assert abs(hits - draws * size / n).max() < 5 * math.sqrt(draws * size / n)
    first = np.bincount(permutation.permuted(7_001, np.arange(draws), np.zeros(draws, int), n), minlength=n)
    assert abs(first - draws / n).max() < 5 * math.sqrt(draws / n)


def test_normal_grid_equals_the_plain_one():
    outer, inner = np.array([0, 1, 5, 2**33 + 3]), np.r_[np.arange(-40, 3000) * 977, 2**41 + np.arange(60)]
    whole = normal.np_norm_ppf(counter.uniform_grid(77, outer, inner))
    for block in (64, 16384):
        assert np.array_equal(normal.np_normal_grid(77, outer, inner, block), whole)


def test_permutations_read_backwards():
    for n in (1, 2, 7, 1000, 1025):
        back = permutation.Backwards(5, np.arange(n), n)
        for seed in (0, 9):
            forth = permutation.permuted(5, np.full(n, seed), np.arange(n), n)
            assert np.array_equal(back.places(seed)[forth], np.arange(n))


def test_normal_products_equal_those_of_the_grid():
    outer = np.r_[np.arange(60), 2**33 + 3]
    for inner in (np.arange(5), np.r_[np.arange(-40, 3000) * 977, 2**41 + np.arange(60)]):
        whole = normal.np_normal_grid(77, outer, inner)
        assert len(inner) < 6 or (np.abs(whole) > normal.REACH).any()
        for block, held in ((64, 64), (1000, 9001), (32768, 1 << 18)):
            made = normal.np_normal_products(77, outer, inner, np.eye(len(inner)), block, held) - whole
            assert np.abs(made).max() < 3e-12 and np.sqrt((made**2).mean()) < 2e-13
    assert normal.np_normal_products(77, outer, inner[:0], np.zeros((0, 3))).tolist() == [[0.0] * 3] * len(outer)


def test_normal_expansions_serve_every_place_of_their_segments():
    middles, slopes, last = normal._segments()
    inside = np.flatnonzero(slopes <= last)
    for d in (-(2.0**31), -1e9, 0.5, 1.3e9, 2.0**31 - 1):
        t = slopes[inside] * d
        made = (middles[inside] + t / (1.0 - middles[inside] * t)) * math.sqrt(2.0)
        u = (inside + 0.5 + 2.0**-33 + d * 2.0**-32) / normal.SEGMENTS
        assert np.abs(made - normal.np_norm_ppf(u)).max() < 3e-12
