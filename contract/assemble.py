"""Assembly queries: low-count fill, table split, merge and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables as tb
from contract.prep import THRESHOLD
from contract.registry import query
from contract.sqltext import name_key, uniform
from contract.tables import BOTH_SQL, CLINICAL_SQL, DENSE_SQL
from twinloom.operators import assemble as am
from twinloom.operators import prep
from twinloom.staging import stage

SEED = 42


def _fill(spark, sf, n_synth):
    stats = prep.low_count_stats(tb.cells(spark, sf, "both"), THRESHOLD, n_synth)
    return am.low_count_fill(stage(stats), n_synth, SEED)


# as many synthetic rows as there are customers
FILL_SQL = f"""{BOTH_SQL},
size as (select count(*)::bigint as n_synth from customer),
low as (select feature, avg(value) as mean, floor((1.0::double - count(*) filter (value <> 0) / count(*)::double)
          * any_value(n_synth))::bigint as n_zero from cells, size group by feature
        having count(*) filter (value = 0) / count(*)::double > {THRESHOLD}),
grid as (select feature, mean, n_zero, s.synth, {name_key('feature')} as nk from low
         cross join (select unnest(range((select n_synth from size))) as synth) s),
rolled as (select * from {uniform("grid", "feature, mean, n_zero, synth, nk", "u", SEED + am.FILL_STREAM, "synth", "nk")}),
fill as (select synth::bigint as synth, feature,
  case when row_number() over (partition by feature order by u, synth) <= n_zero then 0.0 else mean end as value from rolled)"""


@query("low_count_fill", f"with {FILL_SQL} select synth, feature, round(value, 6) as value from fill")
def low_count_fill(spark, sf):
    n = tb.table(spark, sf, "customer").count()
    return _fill(spark, sf, n).withColumn("value", F.round("value", 6))


@query(
    "synth_tables",
    """select c_custkey as synth, c_mktsegment as segment, c_nationkey as nation, c_acctbal as balance from customer""",
)
def synth_tables(spark, sf):
    """Long synthetic clinical cells back to a typed wide table in the original order."""
    source = tb.clinical(spark, sf).select(F.col("id").alias("synth"), "segment", "nation", "balance")
    numbers = prep.melt_features(source, "synth", ["nation", "balance"]).withColumnRenamed("id", "synth")
    levels = source.select("synth", F.lit("segment").alias("feature"), F.col("segment").alias("level"))
    return am.clinical_table(
        numbers,
        levels,
        ["segment", "nation", "balance"],
        {"segment": "string", "nation": "int", "balance": "double"},
        ["segment"],
    )


GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PLACE = "list_position([" + ", ".join(f"'{g}'" for g in GROUPS) + "], segment)"


@query(
    "merge_groups",
    f"""with {CLINICAL_SQL}, {DENSE_SQL} select ({PLACE} - 1)::int as part, c.id as synth, c.feature, c.value
    from clinical p join cells c on c.id = p.id""",
)
def merge_groups(spark, sf):
    rows = tb.clinical(spark, sf).select("id", "segment", "balance")
    features = prep.zero_to_null(tb.cells(spark, sf))
    parts = [prep.filter_rows(rows, {"segment": g}) for g in GROUPS]
    cells = [p.select("id").join(features, "id").withColumnRenamed("id", "synth") for p in parts]
    return am.merge_pairs([p.select("id", "balance") for p in parts], cells)[1]


# each group gets as many synthetic rows as it has customers
@query(
    "surrogate_key",
    f"""with g as (select c_mktsegment as segment, count(*) as n, max(c_acctbal) as top from customer group by 1),
    rows_ as (select segment, top, unnest(range(n)) as synth from g),
    k as (select floor(u * {am.KEY_RANGE})::bigint as shift from {uniform("(select 0::bigint as id)", "id", "u", SEED + am.KEY_STREAM, "id")})
    select (shift + 1 + coalesce((select sum(n) from g where g.segment < rows_.segment), 0) + synth)::bigint as id,
      segment, top from rows_, k""",
)
def surrogate_key(spark, sf):
    stats = stage(
        tb.clinical(spark, sf).groupBy("segment").agg(F.count("*").alias("n"), F.max("balance").alias("top"))
    )
    sizes = {r["segment"]: r["n"] for r in stats.collect()}
    parts = [am.synth_index(stats.filter(F.col("segment") == g).select("segment", "top"), sizes[g]) for g in GROUPS]
    return am.surrogate_key(am.merge_groups(parts), [sizes[g] for g in GROUPS], am.key_offset(spark, SEED))
