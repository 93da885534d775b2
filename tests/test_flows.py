import pytest
from pyspark.sql import functions as F

from tests.conftest import COLONIES, STRAIN_ZEROS, STRAINS
from twinloom.operators.copula import Inequality, sample_parts
from twinloom.operators.prep import Cohort
from twinloom.plans import synthesis
from twinloom.plans.evaluation import REPORT_COLUMNS, bootstrap, write_bootstrap
from twinloom.plans.synthesis import Group, Settings, synthesize, write_synthetic
from twinloom.sources.tables import read_table
from twinloom.staging import stage

RULE = Inequality("trap, low", "trap, high")
GROUPS = [Group({"region": ("==", 1)}, 10), Group({"region": ("==", 0)}, 15)]


@pytest.fixture(scope="module")
def made(spark, cohort):
    settings = Settings(estimate_clinical=["yield"], constraints=[RULE])
    out = synthesize(cohort, GROUPS, settings)
    return Cohort(stage(out.clinical), stage(out.features))


def test_synthetic_tables(cohort, made):
    assert made.clinical.columns == cohort.clinical.columns
    assert made.clinical.dtypes == cohort.clinical.dtypes
    ids = {r["id"] for r in made.clinical.collect()}
    assert len(ids) == 25 and ids == set(range(min(ids), min(ids) + 25))
    assert {r["id"] for r in made.features.select("id").distinct().collect()} == ids
    assert made.features.count() == 25 * len(STRAINS)
    assert made.features.filter("value is null").count() == 0
    assert made.clinical.filter(F.col("region") == 1).count() == 10
    assert made.clinical.filter(~RULE.holds()).count() == 0


def test_low_count_features_keep_their_zero_numbers(made):
    first = made.features.filter(F.col("id") < made.features.agg(F.min("id")).first()[0] + 10)
    zeros = {r["feature"]: r["z"] for r in first.groupBy("feature").agg(F.count_if(F.col("value") == 0).alias("z")).collect()}
    for s in ("s10", "s11", "s12"):
        assert zeros[s] == int((1.0 - (COLONIES - STRAIN_ZEROS[s]) / COLONIES) * 10)


def test_synthesis_repeats(cohort, made):
    settings = Settings(estimate_clinical=["yield"], constraints=[RULE])
    again = synthesize(cohort, GROUPS, settings)
    assert sorted(map(tuple, again.clinical.collect())) == sorted(map(tuple, made.clinical.collect()))


def test_group_scope_and_unknown_scope(cohort):
    settings = Settings(feature_scope="group", max_patients=9)
    out = synthesize(cohort, GROUPS[:1], settings)
    assert out.features.count() == 10 * len(STRAINS)
    with pytest.raises(ValueError, match="feature_scope"):
        synthesize(cohort, GROUPS, Settings(feature_scope="some"))
    with pytest.raises(ValueError, match="no row"):
        synthesize(cohort, [Group({"visits": (">", 500)}, 5)], Settings())


def test_broken_constraint_is_reported(cohort):
    bad = Settings(constraints=[Inequality("trap, high", "trap, low")])
    with pytest.raises(ValueError, match="break"):
        synthesize(cohort, GROUPS[:1], bad)


def test_bootstrap_and_sinks(spark, cohort, made, tmp_path):
    result = bootstrap(made, cohort.features, sample_size=8, iterations=12, zero_share=0.6)
    assert result.report.columns == list(REPORT_COLUMNS)
    assert {r[0] for r in result.report.collect()} == {s for s, zeros in STRAIN_ZEROS.items() if zeros < 0.6 * COLONIES}
    assert result.clinical.count() == 8 and result.features.count() == 8 * len(STRAINS)
    assert {r["ks"] for r in result.scores.collect()} >= {min(r["ks"] for r in result.scores.collect())}
    with pytest.raises(ValueError, match="cannot draw"):
        bootstrap(made, cohort.features, sample_size=26)
    with pytest.raises(ValueError, match="no feature"):
        bootstrap(made, cohort.features, sample_size=5, zero_share=0.0)
    out = str(tmp_path / "out")
    write_synthetic(made, out, STRAINS)
    write_bootstrap(result, out)
    wide = read_table(spark, f"{out}/features")
    assert wide.columns == ["id", *STRAINS] and wide.count() == 25
    assert read_table(spark, f"{out}/clinical").columns == made.clinical.columns
    assert read_table(spark, f"{out}/feature_statistics").columns == list(REPORT_COLUMNS)


def test_wide_features_are_made_in_partitions_of_bounded_cells(spark, made, tmp_path, monkeypatch):
    seen, pivot = [], synthesis.prep.pivot_features

    def kept(*args, **named):
        seen.append(pivot(*args, **named))
        return seen[-1]

    monkeypatch.setattr(synthesis, "CELLS", 20, raising=False)
    monkeypatch.setattr(synthesis.prep, "pivot_features", kept)
    write_synthetic(made, str(tmp_path / "wide"), STRAINS)
    cells = made.features.count()
    assert seen[0].rdd.getNumPartitions() >= cells / 20 > 4  # the session has 4
    wide = read_table(spark, str(tmp_path / "wide" / "features"))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, pivot(made.features, STRAINS).collect()))


def test_user_preparation_step(cohort):
    def busy(c: Cohort) -> Cohort:
        return Cohort(c.clinical.filter("visits >= 30"), c.features, c.n_features)

    out = synthesize(cohort, [Group({}, 7)], Settings(roles={"region": "numerical"}), prepare=busy)
    assert out.clinical.count() == 7
    assert out.clinical.agg(F.min("visits")).first()[0] >= 30


def test_rows_without_a_partner_take_no_part(cohort):
    half = cohort.features.filter("id < 45")
    part = Cohort(cohort.clinical, half)
    inside = Cohort(cohort.clinical.filter("id < 45"), half)
    made = [
        sorted(map(str, synthesize(c, [Group({}, 6)], Settings(), prepare=lambda c: c, offset=0).clinical.collect()))
        for c in (part, inside)
    ]
    assert made[0] == made[1]


def test_overlapping_groups_and_an_own_sampler(cohort):
    seen = []

    def sampler(cells, model, spans, seed, **options):
        seen.append((spans, options["mixing"]))
        return sample_parts(cells, model, spans, seed, **options)

    groups = [Group({}, 5), Group({"region": 1}, 4), Group({"region": 1, "visits": (">", 0)}, 3)]
    out = synthesize(cohort, groups, Settings(), sampler=sampler, offset=100)
    assert seen == [([(0, 5), (5, 9), (9, 12)], "rows")]
    rows = {r["id"]: r["region"] for r in out.clinical.collect()}
    assert set(rows) == set(range(101, 113)) and {rows[i] for i in range(106, 113)} == {1}
    assert out.features.count() == 12 * len(STRAINS)
