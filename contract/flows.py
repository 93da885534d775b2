"""Whole flows over the driver tables, and what of their result follows without chance."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables as tb
from contract.prep import THRESHOLD
from contract.registry import query
from contract.tables import BOTH_SQL, CLINICAL_SQL
from twinloom.operators.copula import Inequality, count_violations
from twinloom.operators.prep import Cohort
from twinloom.plans.evaluation import bootstrap
from twinloom.plans.synthesis import Group, Settings, synthesize
from twinloom.staging import stage

RULE = Inequality("low", "high", strict=False)


def _cohort(spark, sf, kind):
    return Cohort(stage(tb.clinical(spark, sf)), stage(tb.cells(spark, sf, kind)))


def _synthetic(spark, sf, kind="both"):
    """All segments, each with as many synthetic rows as it has customers with orders."""
    cohort = _cohort(spark, sf, kind)
    known = cohort.clinical.filter("low is not null").groupBy("segment").count().orderBy("segment")
    groups = [Group({"segment": ("==", r["segment"])}, r["count"]) for r in known.collect()]
    # as many rows are drawn as there are: mixed from all rows, that takes the square of their number
    settings = Settings(estimate_clinical=["balance"], constraints=[RULE], roles={"nation": "categorical"}, mixing="factor")
    return cohort, synthesize(cohort, groups, settings)


@query("synthesize")
def synthesized(spark, sf):
    """All groups' synthetic tables joined: one row per synthetic cell."""
    _, made = _synthetic(spark, sf)
    return made.clinical.join(made.features, "id")


@query(
    "synthesize_facts",
    f"""with {CLINICAL_SQL}, {BOTH_SQL}, whole as (select * from clinical where low is not null),
    sizes as (select segment, count(*) as n from whole group by 1),
    used as (select c.* from cells c join whole w on w.id = c.id),
    low as (select feature, count(*) filter (value <> 0) as nonzero, count(*) as n from used group by 1
            having count(*) filter (value = 0) / count(*)::double > {THRESHOLD}),
    zeros as (select feature, sum(floor((1.0::double - l.nonzero::double / l.n::double) * s.n))::bigint as z from low l, sizes s group by 1)
    select 'rows' as fact, segment as name, n::bigint as number from sizes
    union all select 'keys', 'distinct', sum(n)::bigint from sizes
    union all select 'keys', 'range', sum(n)::bigint from sizes
    union all select 'cells', 'all', (sum(n) * (select count(distinct feature) from cells))::bigint from sizes
    union all select 'broken', 'low <= high', 0
    union all select 'outside', 'balance', 0
    union all select 'zeros', feature, z from zeros""",
)
def synthesize_facts(spark, sf):
    """Rows per group, keys, cells, broken rules, values out of range, zeros of unmodelled features."""
    cohort, made = _synthetic(spark, sf)
    made = Cohort(stage(made.clinical), stage(made.features))
    seen = cohort.clinical.filter("low is not null").groupBy("segment").agg(
        F.min("balance").alias("least"), F.max("balance").alias("most")
    )
    low = stage(cohort.features.join(cohort.clinical.filter("low is not null").select("id"), "id"))
    low = low.groupBy("feature").agg((F.count_if(F.col("value") == 0) / F.count("*")).alias("share")).filter(F.col("share") > THRESHOLD)
    zeros = made.features.join(low.select("feature"), "feature").groupBy("feature").agg(F.count_if(F.col("value") == 0).alias("z"))

    def fact(name, label, number):
        return [F.lit(name).alias("fact"), label.alias("name"), number.cast("bigint").alias("number")]

    keys = made.features.agg(F.count_distinct("id").alias("n"), (F.max("id") - F.min("id") + 1).alias("r"), F.count("*").alias("c"))
    outside = made.clinical.join(seen, "segment").agg(F.count_if(~F.col("balance").between(F.col("least"), F.col("most"))).alias("n"))
    tables = [
        made.clinical.groupBy("segment").count().select(fact("rows", F.col("segment"), F.col("count"))),
        keys.select(fact("keys", F.lit("distinct"), F.col("n"))),
        keys.select(fact("keys", F.lit("range"), F.col("r"))),
        keys.select(fact("cells", F.lit("all"), F.col("c"))),
        count_violations(made.clinical, RULE).select(fact("broken", F.lit("low <= high"), F.col("violations"))),
        outside.select(fact("outside", F.lit("balance"), F.col("n"))),
        zeros.select(fact("zeros", F.col("feature"), F.col("z"))),
    ]
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


@query("synthesize_and_bootstrap")
def synthesize_and_bootstrap(spark, sf):
    """The report of the best of 20 sub-samples of the synthetic cohort."""
    cohort, made = _synthetic(spark, sf, "dense")
    made = Cohort(stage(made.clinical), stage(made.features))
    size = made.clinical.count() // 3
    return bootstrap(made, cohort.features, size, iterations=20, nan_policy="zero").report
