"""Preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract import tables as tb
from contract.registry import query
from contract.tables import BOTH_SQL, CLINICAL_SQL, DENSE_SQL
from twinloom.operators import prep
from twinloom.operators.prep import Cohort
from twinloom.sources import tables
from twinloom.sources.matrices import melt_arrays, read_matrices, unite
from twinloom.staging import new_folder, stage

R6 = 6
THRESHOLD = 0.7
BRANDS = [f"Brand#{k}" for k in range(1, 26)]


def six(name: str):
    return F.round(F.col(name), R6).alias(name)


def delivered(spark, sf):
    """The measurement table as delivered: its keys are 1000 times the clinical key and more."""
    return tb.wide(spark, sf).withColumn("id", F.col("id") * 1000 + F.pmod(F.col("id"), F.lit(7)))


def raw_cohort(spark, sf):
    wide = delivered(spark, sf)
    features = prep.null_to_zero(prep.melt_features(prep.normalise_key(wide, "id", scale=1000)))
    return Cohort(prep.normalise_key(tb.clinical(spark, sf), "id"), features, len(wide.columns) - 1)


@query(
    "load_cohort",
    f"""with {CLINICAL_SQL}, {DENSE_SQL}
    select c.id, c.segment, count(*)::bigint as n_features, round(sum(value), 6) as total
    from clinical c join cells f on f.id = c.id where c.low is not null group by 1, 2""",
)
def load_cohort(spark, sf):
    """Both tables are delivered as CSV files and read back with the reader."""
    folder = new_folder(spark, "delivered")
    clinical, wide = tb.clinical(spark, sf), delivered(spark, sf)
    # the clinical table comes with a numbering that has no name
    tables.write_table(clinical.select(F.col("id").alias(""), "*"), f"{folder}/clinical")
    clinical_schema = T.StructType([T.StructField("_c0", T.LongType()), *clinical.schema])
    tables.write_table(wide, f"{folder}/features")
    read = tables.load_cohort(
        spark, f"{folder}/clinical", f"{folder}/features", "id", clinical_schema=clinical_schema, features_schema=wide.schema
    )
    whole = prep.complete_cases(Cohort(read.clinical, prep.null_to_zero(read.features), read.n_features))
    return (
        prep.join_cohort(whole.clinical, whole.features)
        .groupBy("id", "segment")
        .agg(F.count("*").alias("n_features"), F.round(F.sum("value"), R6).alias("total"))
    )


@query(
    "normalise_keys",
    f"""with {DENSE_SQL} select id, feature, value from (
      select trunc((id * 1000 + id % 7) / 1000)::bigint as id, feature, value from cells)""",
)
def normalise_keys(spark, sf):
    return raw_cohort(spark, sf).features


@query("melt_features", f"with {DENSE_SQL} select id, feature, value from cells")
def melt_features(spark, sf):
    return prep.null_to_zero(prep.melt_features(tb.wide(spark, sf)))


@query(
    "pivot_features",
    f"""with {DENSE_SQL} select id, {', '.join(f"max(value) filter (feature = '{b}') as {chr(34)}{b}{chr(34)}" for b in BRANDS)} from cells group by id""",
)
def pivot_features(spark, sf):
    return prep.pivot_features(tb.cells(spark, sf), BRANDS)


@query("zero_to_null", f"with {DENSE_SQL} select id, feature, nullif(value, 0) as value from cells")
def zero_to_null(spark, sf):
    return prep.zero_to_null(tb.cells(spark, sf))


@query(
    "filter_ops",
    f"""with {CLINICAL_SQL} select id, segment, balance, 'eq' as rule from clinical where segment = 'BUILDING'
    union all select id, segment, balance, 'gt' from clinical where balance > 5000
    union all select id, segment, balance, 'lt' from clinical where balance < 0
    union all select id, segment, balance, 'ge' from clinical where nation >= 20
    union all select id, segment, balance, 'le' from clinical where nation <= 3
    union all select id, segment, balance, 'bare' from clinical where nation = 7""",
)
def filter_ops(spark, sf):
    rules = {
        "eq": {"segment": ("==", "BUILDING")},
        "gt": {"balance": (">", 5000)},
        "lt": {"balance": ("<", 0)},
        "ge": {"nation": (">=", 20)},
        "le": {"nation": ("<=", 3)},
        "bare": {"nation": 7},
    }
    c = tb.clinical(spark, sf)
    return unite([
        prep.filter_rows(c, spec).select("id", "segment", "balance", F.lit(name).alias("rule"))
        for name, spec in rules.items()
    ])


@query(
    "filter_conjunction",
    f"""with {CLINICAL_SQL} select id, segment, nation, balance from clinical
    where segment = 'MACHINERY' and balance >= 0 and nation < 20""",
)
def filter_conjunction(spark, sf):
    spec = {"segment": "MACHINERY", "balance": (">=", 0), "nation": ("<", 20)}
    return prep.filter_rows(tb.clinical(spark, sf), spec).select("id", "segment", "nation", "balance")


# clinical rows without a balance above zero and cells of one brand are made incomplete
@query(
    "complete_cases",
    f"""with {CLINICAL_SQL}, {DENSE_SQL},
    c as (select id, segment, case when balance > 0 then balance end as balance, low from clinical),
    f as (select id, feature, case when feature <> 'Brand#3' or value > 20 then value end as value from cells),
    ok as (select id from c where balance is not null and low is not null intersect
           select id from f group by id having count(*) = count(value))
    select c.id, c.segment, round(c.balance, 6) as balance, f.feature, f.value
    from c join ok on ok.id = c.id join f on f.id = c.id""",
)
def complete_cases(spark, sf):
    base = tb.cohort(spark, sf)
    clinical = base.clinical.select(
        "id", "segment", F.when(F.col("balance") > 0, F.col("balance")).alias("balance"), "low"
    )
    features = base.features.withColumn(
        "value", F.when((F.col("feature") != "Brand#3") | (F.col("value") > 20), F.col("value"))
    )
    whole = prep.complete_cases(Cohort(clinical, features))
    return prep.join_cohort(whole.clinical, whole.features).select("id", "segment", six("balance"), "feature", "value")


@query(
    "top_n_patients",
    f"""with {CLINICAL_SQL}, {DENSE_SQL} select f.id, f.feature, f.value
    from cells f where f.id in (select id from clinical order by id limit 200)""",
)
def top_n_patients(spark, sf):
    return prep.first_patients(tb.cohort(spark, sf), 200).features


@query(
    "first_keys_keep_their_rows",
    "select o_custkey as id, o_orderkey from orders where o_custkey in (select distinct o_custkey from orders order by 1 limit 700)",
)
def first_keys_keep_their_rows(spark, sf):
    """The limit counts distinct keys; every order of a chosen customer stays."""
    orders = tb.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return prep.first_patients(Cohort(orders, orders.select("id")), 700).clinical


@query(
    "join_cohort",
    f"""with {CLINICAL_SQL}, {DENSE_SQL} select c.id, c.segment, f.feature, nullif(f.value, 0) as value
    from clinical c join cells f on f.id = c.id where c.segment = 'FURNITURE'""",
)
def join_cohort(spark, sf):
    group = prep.filter_rows(tb.clinical(spark, sf), {"segment": "FURNITURE"})
    return prep.zero_to_null(prep.join_cohort(group.select("id", "segment"), tb.cells(spark, sf)))


@query("drop_columns", "select o_orderkey, o_orderstatus from orders")
def drop_columns(spark, sf):
    return prep.drop_columns(
        tb.table(spark, sf, "orders"), names=["o_custkey", "o_totalprice"], positions=[4, 5]
    )


@query(
    "cohort_split_clinical",
    f"""with {CLINICAL_SQL} select 'event' as cohort, id, balance from clinical where segment = 'BUILDING'
    union all select 'other', id, balance from clinical where nation = 3
    union all select 'none', id, balance from clinical where segment = 'FURNITURE' and nation >= 4 and balance > 0""",
)
def cohort_split_clinical(spark, sf):
    parts = prep.split_clinical(
        tb.clinical(spark, sf),
        {
            "event": ({"segment": "BUILDING"}, ["nation", "low", "high"]),
            "other": ({"nation": 3}, ["segment", "low", "high"]),
            "none": ({"segment": "FURNITURE", "nation": (">=", 4), "balance": (">", 0)}, ["low", "high"]),
        },
    )
    return unite([df.select(F.lit(name).alias("cohort"), "id", "balance") for name, df in parts.items()])


@query(
    "cohort_split_features",
    f"""with {CLINICAL_SQL}, {DENSE_SQL}
    select id * 1000 as id, feature, value,
           case when id in (select id from clinical where segment = 'AUTOMOBILE') then 'event' else 'rest' end as part
    from cells""",
)
def cohort_split_features(spark, sf):
    features = tb.cells(spark, sf).withColumn("id", F.col("id") * 1000)
    ids = prep.filter_rows(tb.clinical(spark, sf), {"segment": "AUTOMOBILE"}).select("id")
    inside, outside = prep.split_features(features, ids, scale=1000)
    return unite([inside.withColumn("part", F.lit("event")), outside.withColumn("part", F.lit("rest"))])


@query(
    "manifest_files",
    "select distinct source as file from documents where lang in ('en', 'de')",
)
def manifest_files(spark, sf):
    return prep.manifest_files(tb.table(spark, sf, "documents"), ["en", "de"], "lang", "source")


PER_MATRIX = 200  # vectors
LEAST_PEAK = 0.25  # a matrix lists the features that reach this in one of its vectors


@query(
    "matrix_ingest",
    f"""with e as (select vec_id as id, vec_id // {PER_MATRIX} as part, 'v' || (i - 1) as feature, embedding[i]::double as value
                 from embeddings, unnest(range(1, len(embedding) + 1)) t(i)),
    listed as (select part, feature from e group by 1, 2 having max(value) > {LEAST_PEAK}),
    u as (select e.* from e join listed using (part, feature)),
    n as (select count(distinct id) as n from u)
    select feature, count(value)::bigint as present, (max(n.n) - count(value))::bigint as absent,
           round(sum(value), 5) as total from u, n group by feature""",
)
def matrix_ingest(spark, sf):
    """Vectors are written as delimited matrices, features in rows, and read with the matrix reader."""
    folder = new_folder(spark, "matrices")
    cells = melt_arrays(tb.table(spark, sf, "embeddings"), "vec_id", "embedding", "v")
    cells = cells.withColumn("part", F.floor(F.col("id") / PER_MATRIX))

    def line(first, place):
        ordered = F.sort_array(F.collect_list(F.struct("id", "value")))
        return F.concat_ws(",", first, F.transform(ordered, lambda c: c[place].cast("string"))).alias("line")

    body = cells.groupBy("part", "feature").agg(line(F.first("feature"), "value"), F.max("value").alias("peak"))
    body = body.filter(F.col("peak") > LEAST_PEAK).select("part", F.lit(1).alias("place"), "line")
    header = cells.select("part", "id", F.lit(0).alias("value")).distinct().groupBy("part").agg(line(F.lit("name"), "id"))
    lines = header.select("part", F.lit(0).alias("place"), "line").unionByName(body)
    # a line of its own comes before the header of every file
    lines = lines.unionByName(header.select("part", F.lit(-1).alias("place"), F.concat(F.lit("export "), "part").alias("line")))
    lines.repartition("part").sortWithinPartitions("part", "place").select("line", "part").write.partitionBy("part").text(folder)
    names = [r[0] for r in spark.read.text(folder).select("_metadata.file_name").distinct().collect()]
    united = stage(read_matrices(spark, folder, [*names, "absent.csv"], skip=1))
    n_ids = united.select("id").distinct().count()
    return united.groupBy("feature").agg(
        F.count("value").alias("present"),
        (F.lit(n_ids).cast("bigint") - F.count("value")).alias("absent"),
        F.round(F.sum("value"), 5).alias("total"),
    )


@query(
    "missing_fraction",
    f"""with {BOTH_SQL} select feature, count(*)::bigint as n, count(*) filter (value = 0)::bigint as n_missing,
    round(count(*) filter (value = 0) / count(*)::double, 6) as missing_fraction from cells group by feature""",
)
def missing_fraction(spark, sf):
    out = prep.missing_fraction(tb.cells(spark, sf, "both"))
    return out.select("feature", "n", "n_missing", six("missing_fraction"))


@query(
    "sparsity_split",
    f"""with {BOTH_SQL}, m as (select feature, count(*) filter (value = 0) / count(*)::double as f
                               from cells group by feature)
    select c.id, c.feature, nullif(c.value, 0) as value from cells c join m using (feature) where m.f <= {THRESHOLD}""",
)
def sparsity_split(spark, sf):
    cells = stage(tb.cells(spark, sf, "both"))
    return prep.modelled_cells(cells, prep.stage_split(cells, THRESHOLD))


@query(
    "low_count_stats",
    f"""with {BOTH_SQL}, s as (
      select feature, avg(value) as mean, count(*)::bigint as n, count(*) filter (value <> 0)::bigint as n_nonzero
      from cells group by feature having count(*) filter (value = 0) / count(*)::double > {THRESHOLD})
    select feature, round(mean, 6) as mean, n, n_nonzero,
      floor((1.0::double - n_nonzero::double / n::double) * 5000)::bigint as n_zero,
      (5000 - floor((1.0::double - n_nonzero::double / n::double) * 5000))::bigint as n_fill from s""",
)
def low_count_stats(spark, sf):
    out = prep.low_count_stats(tb.cells(spark, sf, "both"), THRESHOLD, 5000)
    return out.select("feature", six("mean"), "n", "n_nonzero", "n_zero", "n_fill")


@query(
    "infer_roles",
    """with c as (select count(*) as n, count(distinct c_nationkey) as d2, count(distinct c_acctbal) as d3 from customer)
    select 0 as position, 'c_custkey' as "column", 'id' as role
    union all select 1, 'c_name', 'unknown'
    union all select 2, 'c_nationkey', case when d2 <= greatest(2, least(10, round(n * 0.1))) then 'categorical' else 'numerical' end from c
    union all select 3, 'c_acctbal', case when d3 <= greatest(2, least(10, round(n * 0.1))) then 'categorical' else 'numerical' end from c
    union all select 4, 'c_mktsegment', 'categorical'""",
)
def infer_roles(spark, sf):
    return prep.infer_roles(tb.table(spark, sf, "customer"), "c_custkey", {"c_name": "unknown"})
