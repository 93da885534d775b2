"""Whole flows with tables written out and read back, and steps of one's own."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from contract import tables as tb
from contract.evaluate import BEST_SQL, DISTANCE_SQL, DRAWS_SQL, PER_DRAW, PER_ROW, ROOT, SIDES_SQL, sides
from contract.registry import query
from contract.sqltext import name_key
from contract.tables import CLINICAL_SQL, DENSE_SQL
from twinloom.operators import marginals as mg
from twinloom.operators import prep
from twinloom.operators.copula import Inequality, part_of
from twinloom.operators.prep import Cohort
from twinloom.plans.evaluation import bootstrap, write_bootstrap
from twinloom.plans.synthesis import Group, Settings, synthesize, write_synthetic
from twinloom.sources.tables import read_table, write_cohorts
from twinloom.staging import new_folder, stage

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "cohorts_written",
    f"""with {CLINICAL_SQL}, {DENSE_SQL}
    select segment, count(distinct c.id)::bigint as n_rows, count(*)::bigint as cells, round(sum(value), 3) as total,
      round(max(balance), 2) as top from clinical c join cells f on f.id = c.id group by segment""",
)
def cohorts_written(spark, sf):
    """Each segment is a cohort of its own: two CSV tables written, read back and joined."""
    folder = new_folder(spark, "written")
    rows, cells = stage(tb.clinical(spark, sf)), stage(tb.cells(spark, sf))
    own = {s: prep.filter_rows(rows, {"segment": s}) for s in SEGMENTS}
    write_cohorts(own, {s: cells.join(r.select("id"), "id", "left_semi") for s, r in own.items()}, folder)
    out = None
    for s in SEGMENTS:
        read = prep.join_cohort(
            read_table(spark, f"{folder}/{s}_clinical", schema=rows.schema), read_table(spark, f"{folder}/{s}_features", schema=cells.schema)
        )
        part = read.groupBy("segment").agg(
            F.count_distinct("id").alias("n_rows"),
            F.count("*").alias("cells"),
            F.round(F.sum("value"), 3).alias("total"),
            F.round(F.max("balance"), 2).alias("top"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "bootstrap_written",
    f"""with recursive {SIDES_SQL},{CLINICAL_SQL},{DRAWS_SQL},{DISTANCE_SQL},{BEST_SQL},
    chosen as (select id from samples where draw = (select draw from winner))
    select 'report' as file, k.feature as name, round(k.kl_divergence, 7) as one, round(p.ks_p, 9) as two
      from kl k join winner w on w.draw = k.draw join r_p p on p.draw = k.draw and p.feature = k.feature
    union all select 'clinical', segment, count(*)::double, round(sum(balance), 2) from clinical where id in (select id from chosen) group by segment
    union all select 'features', feature, count(*)::double, round(sum(value), 2) from synth where id in (select id from chosen) group by feature""",
)
def bootstrap_written(spark, sf):
    """The best sub-sample's two tables and its report, as they lie on disk."""
    synthetic, original = sides(spark, sf)
    rows = tb.clinical(spark, sf).join(synthetic.select("id").distinct(), "id", "left_semi")
    n = synthetic.select("id").distinct().count()
    best = bootstrap(
        Cohort(stage(rows), synthetic), original, n // PER_ROW, 2 + n // PER_DRAW, zero_share=1.0, root_seed=ROOT, method="asymptotic", nan_policy="zero"
    )
    folder = new_folder(spark, "written")
    write_bootstrap(best, folder)
    report = read_table(spark, f"{folder}/feature_statistics", schema=best.report.schema)
    clinical = read_table(spark, f"{folder}/clinical_bootstrapped", schema=best.clinical.schema)
    features = read_table(spark, f"{folder}/features_bootstrapped", schema=best.features.schema)
    count = F.count("*").cast("double").alias("one")
    parts = [
        report.select(F.lit("report").alias("file"), F.col("Peptide_id").alias("name"), F.round("kl_divergence", 7).alias("one"), F.round("ks_p-value", 9).alias("two")),
        clinical.groupBy(F.col("segment").alias("name")).agg(count, F.round(F.sum("balance"), 2).alias("two")).select(F.lit("clinical").alias("file"), "name", "one", "two"),
        features.groupBy(F.col("feature").alias("name")).agg(count, F.round(F.sum("value"), 2).alias("two")).select(F.lit("features").alias("file"), "name", "one", "two"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# the first of a categorical column's levels, by the hash that lays them out
OWN_SQL = f"""{CLINICAL_SQL}, {DENSE_SQL},
whole as (select * from clinical where low is not null and balance > 0),
sizes as (select segment, count(*)::bigint as n from whole group by 1),
least as (select w.segment, feature, coalesce(min(nullif(value, 0)), 0) as value from whole w join cells c on c.id = w.id group by 1, 2),
bounds as (select segment, min(balance) as balance, min(low) as low, min(high - low) as gap from whole group by 1),
nations as (select segment, arg_min(nation, {name_key('nation::varchar')}) as nation from (select distinct segment, nation from whole) group by 1),
clinical_facts as (
  select segment, 'balance' as name, balance as value from bounds
  union all select segment, 'low', low from bounds
  union all select segment, 'high', greatest(floor((low + gap) * 100 + 0.5::double) / 100, low) from bounds
  union all select segment, 'nation', nation::double from nations)"""


def _least(cells, model, spans, seed, mixing, batch):
    """A sampler without chance: every synthetic value is the least one observed."""
    limits = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in spans])
    span = F.get(limits, part_of(F.col("feature")))
    rows = model.select("feature", F.col("low").alias("value"), F.explode(F.sequence(span["a"], span["b"] - 1)).alias("synth"))
    return rows.select("synth", "feature", "value")


@query(
    "own_steps",
    f"""with {OWN_SQL}
    select s.segment, l.feature as name, s.n, l.value from sizes s join least l on l.segment = s.segment
    union all select s.segment, f.name, s.n, f.value from sizes s join clinical_facts f on f.segment = s.segment""",
)
def own_steps(spark, sf):
    """Synthesis with a preparation and a sampler of one's own: complete rows in the black, least values."""

    def prepare(cohort):
        whole = prep.complete_cases(cohort)
        return Cohort(whole.clinical.filter("balance > 0"), whole.features, whole.n_features)

    cohort = Cohort(stage(tb.clinical(spark, sf)), stage(tb.cells(spark, sf)))
    known = cohort.clinical.filter("low is not null and balance > 0").groupBy("segment").count().orderBy("segment")
    groups = [Group({"segment": ("==", r["segment"])}, r["count"]) for r in known.collect()]
    settings = Settings(
        estimate_clinical=["balance"], constraints=[Inequality("low", "high", strict=False)], roles={"nation": "categorical", "segment": "categorical"}, missing_threshold=1.0
    )
    made = synthesize(cohort, groups, settings, prepare=prepare, sampler=_least)
    clinical = stage(made.clinical)
    numbers = prep.melt_features(clinical.select("id", "balance", "low", "high", F.col("nation").cast("double").alias("nation")))
    cells = made.features.select("id", "feature", "value").unionByName(numbers)
    named = cells.join(clinical.select("id", "segment"), "id").groupBy("segment", F.col("feature").alias("name"))
    same = F.when(F.min("value") == F.max("value"), F.min("value"))
    return named.agg(F.count("*").alias("n"), same.alias("value"))


@query(
    "synthetic_written",
    f"""with {OWN_SQL}, names as (select feature, row_number() over (order by feature) as place from (select distinct feature from cells))
    select place::int as place, feature as name, (select sum(n) from sizes)::bigint as n, round(sum(s.n * l.value), 2) as total
    from least l join names using (feature) join sizes s on s.segment = l.segment group by 1, 2""",
)
def synthetic_written(spark, sf):
    """The wide feature table on disk: its columns in the order of the original ones, their rows and sums."""
    cohort = Cohort(stage(tb.clinical(spark, sf)), stage(tb.cells(spark, sf)))
    names = sorted(r[0] for r in cohort.features.select("feature").distinct().collect())
    known = cohort.clinical.filter("low is not null and balance > 0").groupBy("segment").count().orderBy("segment")
    groups = [Group({"segment": ("==", r["segment"])}, r["count"]) for r in known.collect()]
    whole = Cohort(cohort.clinical.filter("balance > 0"), cohort.features)
    settings = Settings(estimate_clinical=["balance"], roles={"nation": "categorical", "segment": "categorical"}, missing_threshold=1.0)
    made = synthesize(whole, groups, settings, sampler=_least)
    folder = new_folder(spark, "written")
    write_synthetic(made, folder, names)
    wide = read_table(spark, f"{folder}/features")
    columns = [c for c in wide.columns if c != "id"]
    places = F.array(*[F.struct(F.lit(k + 1).alias("place"), F.lit(c).alias("name")) for k, c in enumerate(columns)])
    cells = prep.melt_features(wide).groupBy(F.col("feature").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return spark.range(1).select(F.inline(places)).join(cells, "name")


def _laplace() -> mg.Family:
    def fit():
        b = F.col("sd") / F.sqrt(F.lit(2.0))
        return F.col("sd") > 0, {"loc": F.col("mean"), "scale": b}, -F.ln(2.0 * b)

    def table(p, low, high):
        x = np.linspace(p["loc"] - 40 * p["scale"], p["loc"] + 40 * p["scale"], 20001)
        y = (x - p["loc"]) / p["scale"]
        return x, np.where(y < 0, 0.5 * np.exp(np.minimum(y, 0)), 1 - 0.5 * np.exp(-np.maximum(y, 0)))

    return mg.Family(("loc", "scale"), lambda x, p: p("c0") - F.abs(x - p("loc")) / p("scale"), fit=fit, table=table)


@query(
    "own_family",
    f"""with {DENSE_SQL}, v as (select feature, value as x from cells where value <> 0),
    m as (select feature, avg(x) as mean, stddev_pop(x) as sd, count(*) as n from v group by 1),
    ll as (select v.feature, any_value(mean) as mean, any_value(sd) as sd, any_value(n) as n,
        sum(-ln(2 * sd / {math.sqrt(2)!r}::double) - abs(x - mean) / (sd / {math.sqrt(2)!r}::double)) as own,
        sum(-ln(sd) - {0.5 * math.log(2 * math.pi)!r}::double - 0.5 * pow((x - mean) / sd, 2)) as normal
      from v join m using (feature) group by 1)
    select feature, case when own > normal then 'laplace' else 'norm' end as family, round(4 - 2 * greatest(own, normal), 4) as score,
      round(mean, 6) as loc, round(sd / {math.sqrt(2)!r}::double, 6) as scale from ll""",
)
def own_family(spark, sf):
    """A family of one's own is fitted and stands against the normal distribution by AIC."""
    mg.register_family("laplace", _laplace())
    try:
        cells = stage(tb.cells(spark, sf))
        chosen = mg.select_family(cells, ["norm", "laplace"], "aic")
        fits = mg.fit(mg.nonzero(cells), ["laplace"])
        return stage(
            chosen.join(fits, "feature").select(
                "feature", "family", F.round("score", 4).alias("score"), F.round("laplace.loc", 6).alias("loc"), F.round("laplace.scale", 6).alias("scale")
            )
        )
    finally:
        del mg.REGISTRY["laplace"]
