import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import COLONIES, COLONY_IDS, COLONY_ROWS, KEY, SPORE_ROWS, STRAIN_ZEROS, STRAINS
from twinloom.operators import ordered, prep
from twinloom.operators.prep import Cohort
from twinloom.sources import matrices, tables
from twinloom.staging import attach, stage

MEANS = {name: sum(r[j + 1] for r in SPORE_ROWS) / COLONIES for j, name in enumerate(STRAINS)}


def test_load_cohort(cohort):
    assert "" not in cohort.clinical.columns and "_c0" not in cohort.clinical.columns
    assert cohort.clinical.schema["id"].dataType.simpleString() == "bigint"
    assert sorted(r["id"] for r in cohort.clinical.collect()) == COLONY_IDS
    assert cohort.features.count() == COLONIES * len(STRAINS)
    assert sorted(r["id"] for r in cohort.features.select("id").distinct().collect()) == COLONY_IDS


def test_duplicate_keys_after_truncation_are_an_error(spark, tmp_path, fixture_files):
    path = tmp_path / "f.csv"
    path.write_text(f"{KEY},s1\n31000,1.0\n31001,2.0\n")
    with pytest.raises(ValueError, match="share one key"):
        tables.load_cohort(spark, fixture_files[0], str(path), KEY)
    kept = tables.load_cohort(spark, fixture_files[0], str(path), KEY, on_duplicate="keep")
    assert kept.features.count() == 2


def test_key_types(spark):
    for value, kind in (("a", "string"), (True, "boolean")):
        with pytest.raises(ValueError, match="numeric key"):
            prep.normalise_key(spark.createDataFrame([(value, 1.0)], f"k {kind}, v double"), "k")
    assert prep.normalise_key(spark.createDataFrame([(7900, 1.0)], "k int, v double"), "k", 1000).first()["id"] == 7


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_table(spark, str(tmp_path / "absent"))


def test_zero_share_and_means(cohort):
    for r in prep.missing_fraction(cohort.features).collect():
        assert r["n_missing"] == STRAIN_ZEROS[r["feature"]] and r["n"] == COLONIES
    for r in prep.low_count_stats(cohort.features, -1.0, 10).collect():
        assert r["mean"] == pytest.approx(MEANS[r["feature"]], abs=1e-9)


def test_sparsity_split_is_inclusive(cohort):
    low = {r["feature"] for r in prep.sparsity_split(cohort.features, 0.7).filter("not modelled").collect()}
    assert low == {"s10", "s11", "s12"}
    edge = prep.sparsity_split(cohort.features, 11 / 14).filter("modelled")
    assert "s10" in {r["feature"] for r in edge.collect()}


@pytest.mark.parametrize("n", [10, 15, 28])
def test_low_count_zero_numbers(cohort, n):
    got = {r["feature"]: r["n_zero"] for r in prep.low_count_stats(cohort.features, 0.7, n).collect()}
    assert got == {s: int((1.0 - (COLONIES - STRAIN_ZEROS[s]) / COLONIES) * n) for s in ("s10", "s11", "s12")}


def test_filters_and_guards(cohort):
    c = cohort.clinical
    region, low, visits = 3, 5, 7
    assert prep.filter_rows(c, {"region": ("==", 1)}).count() == sum(r[region] == 1 for r in COLONY_ROWS)
    both = {"region": 1, "visits": (">", 40)}
    assert prep.filter_rows(c, both).count() == sum(r[region] == 1 and r[visits] > 40 for r in COLONY_ROWS)
    middle = sorted(r[low] for r in COLONY_ROWS)[6]
    assert prep.filter_rows(c, {"trap, low": ("<=", middle)}).count() == sum(r[low] <= middle for r in COLONY_ROWS)
    for bad in ({"nope": 1}, {"visits": ("=", 1)}, {"visits": (">", 1, 2)}):
        with pytest.raises(ValueError):
            prep.filter_rows(c, bad)
    with pytest.raises(ValueError, match="no row"):
        prep.filter_rows(c, {"visits": (">", 1000)}, require_rows=True)


def test_complete_cases(spark, cohort):
    clinical = cohort.clinical.withColumn("yield", F.when(F.col("id") != 33, F.col("yield")))
    features = cohort.features.withColumn("value", F.when((F.col("id") != 37) | (F.col("feature") != "s3"), F.col("value")))
    features = features.filter("not (id = 41 and feature = 's9')")  # an absent cell is null too
    whole = prep.complete_cases(Cohort(clinical, features))
    expected = set(COLONY_IDS) - {33, 37, 41}
    assert {r["id"] for r in whole.clinical.collect()} == expected
    assert {r["id"] for r in whole.features.select("id").distinct().collect()} == expected


def test_first_patients(spark, cohort):
    small = prep.first_patients(cohort, 4)
    assert sorted(r["id"] for r in small.clinical.collect()) == COLONY_IDS[:4]
    assert small.features.count() == 4 * len(STRAINS)
    assert prep.first_patients(cohort, 1000).clinical.count() == COLONIES
    # n counts distinct keys; a chosen key keeps all its rows
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "id bigint, x string")
    kept = prep.first_patients(Cohort(twice, cohort.features), 2)
    assert sorted(r["id"] for r in kept.clinical.collect()) == [1, 1, 2]


def test_smallest_k_with_negative_keys(spark):
    ids = spark.range(-500, 500)
    assert {r["id"] for r in ordered.smallest_k(ids, "id", 510).collect()} == set(range(-500, 10))


def test_running_totals_match_a_plain_sum(spark):
    import random

    rng = random.Random(1)
    values = sorted({round(rng.lognormvariate(0, 3) * rng.choice([-1, 1]), 3) for _ in range(400)} | {0.0})
    df = spark.createDataFrame([("a", v, i % 5 + 1) for i, v in enumerate(values)], "g string, v double, n int")
    out = ordered.running_totals(df, ["g"], "v", ["n"]).orderBy("v").collect()
    total = 0
    for i, r in enumerate(out):
        total += i % 5 + 1
        assert r["run_n"] == total
    assert {r["all_n"] for r in out} == {total}


def test_a_narrow_range_of_values_is_cut_too(spark):
    rows = spark.range(100_000).select(F.lit("g").alias("g"), (1000 + F.col("id") / 50_000).alias("v"))
    sizes = [r["count"] for r in ordered.ranged(rows, ["g"], ["v"]).groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_choose_smallest_is_exact_per_group(spark):
    from twinloom.functions.counter import with_uniform

    rows = spark.range(3000).withColumn("g", F.when(F.col("id") < 2500, "big").when(F.col("id") < 2990, "mid").otherwise("none"))
    k = stage(spark.createDataFrame([("big", 700), ("mid", 490), ("none", 0)], "g string, k int"))
    out = ordered.choose_smallest(with_uniform(rows, "u", 1, "id"), ["g"], "u", "id", k, buckets=16).collect()
    assert len(out) == 3000
    for group, want in (("big", 700), ("mid", 490), ("none", 0)):
        mine = sorted((r["u"], r["id"], r["chosen"]) for r in out if r["g"] == group)
        assert [c for *_, c in mine] == [True] * want + [False] * (len(mine) - want)


def test_attach_salted_equals_broadcast(spark):
    big = spark.range(2000).withColumn("feature", F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 7)))
    small = stage(big.groupBy("feature").agg(F.count("*").alias("n")))
    a = attach(big, small, ["feature"])
    b = attach(big, small, ["feature"], limit=0)
    assert "Broadcast" not in b._jdf.queryExecution().optimizedPlan().toString().replace("broadcastTimeout", "")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_melt_and_pivot_are_inverse(spark, cohort):
    wide = prep.pivot_features(cohort.features, STRAINS)
    assert wide.columns == ["id", *STRAINS]
    got = {r["id"]: tuple(r)[1:] for r in wide.collect()}
    assert got == {r[0] // 1000: tuple(float(v) for v in r[1:]) for r in SPORE_ROWS}


def test_infer_roles(cohort):
    roles = {r["column"]: r["role"] for r in prep.infer_roles(cohort.clinical, "id", {"wintered": "numerical"}).collect()}
    assert roles["id"] == "id" and roles["region"] == "categorical"
    assert roles["weight kg"] == "numerical" and roles["wintered"] == "numerical"


def test_cohort_assembly(spark, tmp_path):
    """Matrices with different features, an absent file, and flagged ids inside an unflagged file."""
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.csv").write_text("exported\nname,1000,2000\nx,1.5,2.5\ny,3.5,\n")
    (folder / "b.csv").write_text("exported\nname,3000,4000\nx,5,6\nz,7,8\n")
    (folder / "other.csv").write_text("exported\nname,9000\nx,1\n")
    manifest = spark.createDataFrame(
        [("a.csv", "calm_1"), ("b.csv", "calm_2"), ("gone.csv", "calm_2"), ("a.csv", "calm_1"), ("other.csv", "storm")],
        "file string, grp string",
    )
    names = [r["file"] for r in prep.manifest_files(manifest, ["calm_1", "calm_2"], "grp", "file").collect()]
    assert sorted(names) == ["a.csv", "b.csv", "gone.csv"]
    cells = matrices.read_matrices(spark, str(folder), names).select("id", "feature", "value")
    got = {(r["id"], r["feature"]): r["value"] for r in cells.collect()}
    assert got == {
        (1000, "x"): 1.5, (2000, "x"): 2.5, (1000, "y"): 3.5, (2000, "y"): None,
        (3000, "x"): 5.0, (4000, "x"): 6.0, (3000, "z"): 7.0, (4000, "z"): 8.0,
    }
    wide = {r["id"]: (r["x"], r["y"], r["z"]) for r in prep.pivot_features(cells, ["x", "y", "z"]).collect()}
    assert wide[1000] == (1.5, 3.5, None) and wide[3000] == (5.0, None, 7.0)
    master = spark.createDataFrame(
        [(1, 0, 1, 0, 9.0), (3, 1, 0, 0, 8.0), (4, 0, 0, 0, 7.0)],
        "id bigint, `wind.flag` int, `rain.flag` int, `hail.flag` int, `days (to rain or last visit)` double",
    )
    flags = ["wind.flag", "rain.flag", "hail.flag"]
    parts = prep.split_clinical(master, {
        "rain": ({"rain.flag": 1}, flags),
        "wind": ({"wind.flag": 1}, [*flags, "days (to rain or last visit)"]),
        "none": ({f: 0 for f in flags}, flags),
    })
    assert parts["wind"].columns == ["id"] and [r["id"] for r in parts["none"].collect()] == [4]
    inside, outside = prep.split_features(cells, parts["rain"].select("id"), scale=1000)
    assert {r["id"] for r in inside.collect()} == {1000}
    assert {r["id"] for r in outside.collect()} == {2000, 3000, 4000}
    assert prep.drop_columns(master, positions=[1, 2]).columns[:2] == ["id", "hail.flag"]
    tables.write_cohorts(parts, {"rain": inside, "none": outside}, str(tmp_path / "out"))
    assert tables.read_table(spark, str(tmp_path / "out" / "none_features")).count() == 6
    assert tables.read_table(spark, str(tmp_path / "out" / "wind_clinical")).columns == ["id"]


def test_distinct_values_are_counted_exactly(spark):
    rows = [(k, k % 3, k % 10 if k < 900 else (10 if k == 950 and k % 3 == 2 else 0), float(k % 2) * -0.0, None) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, part int, x int, z double, none int").repartition(5)
    whole = prep.few_distinct(df.withColumn("g", F.lit("all")), ["x", "z", "none", "id"], ["g"], ["dx", "dz", "dn", "di"]).first()
    assert tuple(whole) == ("all", 11, 1, 0, 11)
    parts = {r["part"]: r["dx"] for r in prep.few_distinct(df, ["x"], ["part"], ["dx"]).collect()}
    assert parts == {0: 10, 1: 10, 2: 11}
    roles = {r["part"]: r["role"] for r in prep.infer_roles(df.select("id", "part", "x"), "id", by=["part"]).filter("column = 'x'").collect()}
    assert roles == {0: "categorical", 1: "categorical", 2: "numerical"}
    empty = prep.infer_roles(df.select("id", "x").limit(0), "id").collect()
    assert empty == []


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_quantiles_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(9)
    values = {"a": [rng.gauss(0, 1) for _ in range(4001)], "b": [float(rng.randrange(5)) for _ in range(300)], "c": [7.0]}
    df = spark.createDataFrame([(g, v) for g, own in values.items() for v in own], "g string, v double").repartition(partitions)
    counts = df.groupBy("g", "v").agg(F.count("*").alias("w"))
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {(r["g"], r["share"]): r["v"] for r in ordered.quantiles(counts, ["g"], "v", "w", shares).collect()}
    for g, own in values.items():
        for p in shares:
            assert got[g, p] == sorted(own)[max(math.ceil(p * len(own)), 1) - 1]
    assert len(got) == 15
    assert ordered.quantiles(counts.limit(0), ["g"], "v", "w", shares).count() == 0


def test_cells_are_made_in_more_tasks_as_lines_grow(spark, tmp_path, monkeypatch):
    """No step between the lines and their cells has fewer partitions than their number asks for."""
    from contract import tables

    monkeypatch.setattr(tables, "LINES", 10)
    n = 120
    spark.range(n).selectExpr("id % 7 as l_orderkey", "id % 3 as l_partkey", "double(id) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id as o_orderkey", "id % 5 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).selectExpr("id as p_partkey", "concat('Brand#', id % 2) as p_brand", "'x' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(6).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    cells = tables.cells(spark, str(tmp_path))
    want = {(c, f"Brand#{b}"): 0.0 for c in range(6) for b in range(2)}
    for i in range(n):
        want[i % 7 % 5, f"Brand#{i % 3 % 2}"] += i
    assert {(r["id"], r["feature"]): r["value"] for r in cells.collect()} == want
    plan = tables.wide(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 12") >= 3 and "RepartitionByExpression [o_custkey" in plan.replace("id#", "o_custkey#")
