"""Copula queries. Features take one of all eight families by the number in their name."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from contract import tables as tb
from contract.marginals import BETA_SQL, LOGNORM_SQL, MOMENTS_SQL, T_SQL, _truncnorm_sql
from contract.registry import query
from contract.sqltext import name_key, norm_cdf, norm_ppf, uniform
from contract.tables import CLINICAL_SQL, DENSE_SQL
from twinloom.functions.normal import U_CLIP
from twinloom.operators import copula as cp
from twinloom.operators.prep import zero_to_null
from twinloom.staging import stage

# customers for each synthetic row
PER_ROW = 20
SEED = 42
FAMILIES = ("norm", "lognorm", "uniform", "truncnorm", "beta", "gamma", "t", "gaussian_kde")
RULE = cp.Inequality("low", "high", strict=True)


def families(cells):
    number = F.pmod(F.regexp_extract("feature", r"(\d+)$", 1).cast("int"), F.lit(len(FAMILIES)))
    names = F.element_at(F.array(*[F.lit(n) for n in FAMILIES]), number + 1)
    return cells.select("feature").distinct().withColumn("family", names)


def n_synth(spark, sf):
    return 10 + tb.table(spark, sf, "customer").count() // PER_ROW


def prepared(spark, sf):
    cells = stage(zero_to_null(tb.cells(spark, sf)))
    return cells, cp.fit_model(cells, families(cells))


def scores(spark, sf):
    cells, model = prepared(spark, sf)
    return model, stage(cp.normal_scores(cells, model))


# mean-imputed cells, their fits, and the clipped normal scores
MODEL_SQL = (
    MOMENTS_SQL.replace(
        "values_ as (select feature, value as x from cells where value <> 0)",
        """observed as (select feature, avg(nullif(value, 0)) as fill, min(nullif(value, 0)) as lo, max(nullif(value, 0)) as hi,
              count(*) filter (value = 0) / count(*)::double as missing from cells group by feature),
values_ as (select c.id, c.feature, case when c.value = 0 then o.fill else c.value end as x
            from cells c join observed o using (feature))""",
    )
    + ","
    + LOGNORM_SQL
    + ","
    + _truncnorm_sql()
    + ","
    + BETA_SQL
    + ","
    + T_SQL
    + f""",
model as (
  select m.feature, {list(FAMILIES)!r}[(regexp_extract(m.feature, '(\\d+)$', 1)::int % {len(FAMILIES)}) + 1] as family,
    m.n, m.mn, m.mx, m.mean, m.sd, l.p.s as ls, l.p.loc as lloc, l.p.scale as lscale,
    t.loc as tloc, t.scale as tscale, t.a as ta, t.b as tb, o.fill, o.lo, o.hi, o.missing,
    b.a as ba, b.b as bb, b.loc as bloc, b.scale as bscale, s.df as sdf, s.loc as sloc, s.scale as sscale,
    m.mean / (m.mean_xln - m.mean_ln * m.mean) as ga, m.mean_xln - m.mean_ln * m.mean as gscale,
    m.sd * sqrt(m.n / (m.n - 1.0::double)) * pow(m.n::double, -0.2) as h
  from moments m join lognorm l using (feature) join truncnorm t using (feature) join observed o using (feature)
    join beta b using (feature) join t s using (feature))"""
)
HALF = f"{math.pi / 2!r}::double"
REACH = f"(case when sdf < 30 then {HALF} else atan(60.0::double / sqrt(sdf)) end)"
TOP = "(ga + 40.0::double * sqrt(ga) + 60.0::double)"


def _interpolated(grid: str, points: str, at: str, x: str, y: str, out: str) -> str:
    """``y`` over increasing ``x`` of ``points`` (feature, k, ..), read at ``at`` of ``grid``; ends are held."""
    return f"""
  select g.*, case when p.{x} is null then f.{y} when p.nx is null then p.{y}
      else p.{y} + (p.ny - p.{y}) / (p.nx - p.{x}) * (g.{at} - p.{x}) end as {out}
  from {grid} g join (select feature, arg_min({y}, k) as {y} from {points} group by 1) f using (feature)
  asof left join (select *, lead({x}) over w as nx, lead({y}) over w as ny
      from (select * from {points} qualify row_number() over (partition by feature, {x} order by k desc) = 1)
      window w as (partition by feature order by {x})) p
    on p.feature = g.feature and g.{at} >= p.{x}"""


# distribution functions on fine grids, and tables of 1024 even points read off them
TABLE_SQL = f"""
parts as (select *, unnest(range({cp.FINE_POINTS})) as k from model where family in ('beta', 'gamma', 't')),
middles as (select *, (k + 0.5::double) / {cp.FINE_POINTS}.0::double as mid from parts),
density as (select feature, k, case family
    when 'beta' then (2 * ba - 1) * ln(sin(mid * {HALF})) + (2 * bb - 1) * ln(cos(mid * {HALF}))
    when 'gamma' then (ga - least(ga, 1)) * ln(pow(mid * pow({TOP}, least(ga, 1)), 1 / least(ga, 1))) - pow(mid * pow({TOP}, least(ga, 1)), 1 / least(ga, 1))
    else (sdf - 1) * ln(cos((2 * mid - 1) * {REACH})) end as lp from middles),
mass as (select feature, k, exp(lp - max(lp) over (partition by feature)) as w from density),
cumulated as (
  select feature, 0 as k, 0.0::double as u from model where family in ('beta', 'gamma', 't')
  union all select feature, k + 1, sum(w) over (partition by feature order by k) / sum(w) over (partition by feature) from mass),
edges as (select c.*, m.* exclude (feature), c.k / {cp.FINE_POINTS}.0::double as e from cumulated c join model m using (feature)),
smooth_at as (select *, (lo - 6 * h) + k * (((hi + 6 * h) - (lo - 6 * h)) / {cp.GRID_POINTS - 1}.0::double) as x
  from (select *, unnest(range({cp.GRID_POINTS})) as k from model where family = 'gaussian_kde')),
counted as (select feature, x as v, count(*) as w from values_ group by all),
smooth as (select s.feature, s.k, any_value(s.x) as x, sum(w * {norm_cdf("((s.x - v) / h)")}) / any_value(n) as u
  from smooth_at s join counted c on c.feature = s.feature group by all),
fine as (
  select feature, k, u, case family
    when 'beta' then bloc + bscale * pow(sin(e * {HALF}), 2)
    when 'gamma' then gscale * pow(e * pow({TOP}, least(ga, 1)), 1 / least(ga, 1))
    else sloc + sscale * sqrt(sdf) * tan(least(greatest((2 * e - 1) * {REACH}, {-math.pi / 2 + 1e-9!r}::double), {math.pi / 2 - 1e-9!r}::double)) end as x
  from edges
  union all select feature, k, u, x from smooth),
clipped_u as (select *, least(greatest(u, {U_CLIP!r}::double), {1 - U_CLIP!r}::double) as cu from fine),
scored_fine as (select *, {norm_ppf('cu')} as z from clipped_u),
even as (select feature, i, lo + i * ((hi - lo) / {cp.GRID_POINTS - 1}.0::double) as ex,
    -({cp.Z_MAX!r}::double) + i * ({2 * cp.Z_MAX!r}::double / {cp.GRID_POINTS - 1}.0::double) as ez
  from (select *, unnest(range({cp.GRID_POINTS})) as i from model where family in ('beta', 'gamma', 't', 'gaussian_kde'))),
even_u as (select *, {norm_cdf('ez')} as eu from even),
z_table as ({_interpolated('even', 'scored_fine', 'ex', 'x', 'z', 'zt')}),
x_table as ({_interpolated('even_u', 'scored_fine', 'eu', 'u', 'x', 'xt')}),
z_lists as (select feature, list(zt order by i) as z_at from z_table group by 1),
x_lists as (select feature, list(xt order by i) as x_at from x_table group by 1)"""


def _read(table: str, place: str) -> str:
    low = f"least(greatest(floor({place}), 0), {cp.GRID_POINTS - 2})::int"
    return f"({table}[{low} + 1] + ({table}[{low} + 2] - {table}[{low} + 1]) * ({place} - {low}))"


SCORE_SQL = f"""{MODEL_SQL},{TABLE_SQL},
uniforms as (select v.id, v.feature, x, m.*exclude (feature), (x - tloc) / tscale as y from values_ v join model m using (feature)),
clipped as (select *, least(greatest(case family when 'uniform' then (x - mn) / (mx - mn)
    when 'truncnorm' then ({norm_cdf('y')} - {norm_cdf('ta')}) / ({norm_cdf('tb')} - {norm_cdf('ta')}) else 0.5 end,
    {U_CLIP!r}::double), {1 - U_CLIP!r}::double) as u, (x - lo) / (hi - lo) * {cp.GRID_POINTS - 1}.0::double as place from uniforms),
scores as (select id, feature, least(greatest(case when family = 'norm' then (x - mean) / sd
    when family = 'lognorm' then (ln(x - lloc) - ln(lscale)) / ls
    when z_at is not null then {_read('z_at', 'place')}
    else {norm_ppf('u')} end, {-cp.Z_MAX!r}::double), {cp.Z_MAX!r}::double) as z from clipped left join z_lists using (feature)),
score_stats as (select feature, avg(z) as zm, stddev_pop(z) as zs from scores group by feature),
standard as (select s.id, s.feature, (z - zm) / zs as z from scores s join score_stats using (feature))"""


@query("normal_scores", f"with recursive {SCORE_SQL} select id, feature, round(z, 6) as z from scores")
def normal_scores(spark, sf):
    return scores(spark, sf)[1].withColumn("z", F.round("z", 6))


CORRELATION_SQL = f"""with recursive {SCORE_SQL} select a.feature as feature_a, b.feature as feature_b,
  round(sum(a.z * b.z) / count(*), 7) as correlation
  from standard a join standard b on a.id = b.id and a.feature <= b.feature group by 1, 2"""


def _sizes(model):
    return int(model.agg(F.max("n")).first()[0]), model.count()


@query("latent_correlation", CORRELATION_SQL)
def latent_correlation(spark, sf):
    model, z = scores(spark, sf)
    out = cp.correlation(cp.standardise(z), *_sizes(model))
    return out.withColumn("correlation", F.round("correlation", 7))


@query("latent_row_reduction", CORRELATION_SQL)
def latent_row_reduction(spark, sf):
    """The reduced rows keep every cross product, hence the whole correlation. Blocks are small here."""
    model, z = scores(spark, sf)
    n, p = _sizes(model)
    reduced = cp.correlation(stage(cp.reduce_rows(cp.standardise(z), n, p, block=8)), min(n, p), p)
    return reduced.withColumn("correlation", F.round(F.col("correlation") * min(n, p) / n, 7))


LATENT_SQL = f"""{SCORE_SQL},
noise as (select s, id, {norm_ppf('u')} as e from
  {uniform(f"(select s, id from (select distinct id from standard) cross join (select unnest(range((select 10 + count(*) // {PER_ROW} from customer))) as s))", "s, id", "u", SEED + cp.LATENT_STREAM, "s", "id")}),
latent as (select s as synth, feature, sum(e * z) / sqrt(count(*)) as z from noise join standard using (id) group by 1, 2)"""


def _latent(model, z, rows):
    return cp.latent_draws(cp.standardise(z), rows, SEED + cp.LATENT_STREAM, *_sizes(model), mixing="rows")


@query("copula_latent", f"with recursive {LATENT_SQL} select synth::bigint as synth, feature, round(z, 6) as z from latent")
def copula_latent(spark, sf):
    return _latent(*scores(spark, sf), n_synth(spark, sf)).withColumn("z", F.round("z", 6))


# quantities are whole numbers, so values are rounded to none
SAMPLE_SQL = f"""{LATENT_SQL},
placed as (select l.synth, l.feature, l.z, m.* exclude (feature), x_at,
    (least(greatest(l.z, {-cp.Z_MAX!r}::double), {cp.Z_MAX!r}::double) + {cp.Z_MAX!r}::double) / {2 * cp.Z_MAX!r}::double * {cp.GRID_POINTS - 1}.0::double as xp,
    least(greatest(({norm_cdf('ta')}) + ({norm_cdf('l.z')}) * (({norm_cdf('tb')}) - ({norm_cdf('ta')})), 1e-16), 1 - 1e-16) as tu
  from latent l join model m using (feature) left join x_lists using (feature)),
drawn as (select synth, feature, missing, floor(least(greatest(case family
    when 'norm' then mean + sd * z when 'lognorm' then lloc + lscale * exp(ls * z)
    when 'uniform' then mn + (mx - mn) * {norm_cdf('z')}
    when 'truncnorm' then tloc + tscale * {norm_ppf('tu')}
    else {_read('x_at', 'xp')} end, lo), hi) + 0.5) as value from placed),
rolled as (select * from {uniform(f"(select *, {name_key('feature')} as nk from drawn)", "synth, feature, missing, value, nk", "m", SEED + cp.MASK_STREAM, "synth", "nk")})"""


@query(
    "copula_sample",
    f"""with recursive {SAMPLE_SQL} select synth::bigint as synth, feature,
    case when m >= missing then value end as value from rolled""",
)
def copula_sample(spark, sf):
    cells, model = prepared(spark, sf)
    return cp.sample(cells, model, n_synth(spark, sf), SEED, mixing="rows")


@query(
    "missing_mask",
    f"""with {DENSE_SQL}, o as (select feature, count(*) filter (value = 0) / count(*)::double as missing from cells group by feature),
    c as (select id as synth, feature, value, missing, {name_key('feature')} as nk from cells join o using (feature))
    select synth, feature, case when m >= missing then value end as value
    from {uniform("c", "synth, feature, missing, value, nk", "m", SEED + cp.MASK_STREAM, "synth", "nk")}""",
)
def missing_mask(spark, sf):
    cells = stage(tb.cells(spark, sf))
    rates = stage(cp.observed(zero_to_null(cells)).select("feature", "missing", "name_id"))
    draws = cp.attach(cells.withColumnRenamed("id", "synth"), rates, ["feature"], row_bytes=64)
    return cp.missing_mask(draws, SEED)


@query(
    "clip_round",
    """with seen as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer where c_mktsegment = 'BUILDING')
    select c_custkey as id, floor(least(greatest(c_acctbal * 1.37, lo), hi) * 100.0 + 0.5) / 100.0 as value from customer, seen""",
)
def clip_round(spark, sf):
    customer = tb.table(spark, sf, "customer")
    seen = customer.filter("c_mktsegment = 'BUILDING'").agg(
        F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.max(cp.decimals(F.col("c_acctbal"))).alias("digits")
    ).first()
    value = cp.clip_round(F.col("c_acctbal") * 1.37, F.lit(seen["lo"]), F.lit(seen["hi"]), F.lit(seen["digits"]))
    return customer.select(F.col("c_custkey").alias("id"), value.alias("value"))


@query(
    "clip_round_fine",
    """with v as (select c_custkey as id, round(c_acctbal / 1000000, 8) as x from customer), seen as (select min(x) as lo, max(x) as hi from v)
    select id, floor(least(greatest(x * 0.777, lo), hi) * 100000000.0 + 0.5) / 100000000.0 as value from v, seen""",
)
def clip_round_fine(spark, sf):
    """Eight decimals are kept as eight decimals."""
    values = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 1000000, 8).alias("x"))
    seen = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max(cp.decimals(F.col("x"))).alias("digits")).first()
    value = cp.clip_round(F.col("x") * 0.777, F.lit(seen["lo"]), F.lit(seen["hi"]), F.lit(seen["digits"]))
    return values.select("id", value.alias("value"))


@query(
    "constraint_check",
    f"""with {CLINICAL_SQL} select count(low)::bigint as checked, count(*) filter (not low < high)::bigint as violations
    from clinical""",
)
def constraint_check(spark, sf):
    return cp.count_violations(tb.clinical(spark, sf), RULE)


@query(
    "constraint_roundtrip",
    f"""with {CLINICAL_SQL} select id, low, round(ln(high - low + 1), 6) as opened,
      greatest(high, low + 0.01) as high from clinical where low is not null""",
)
def constraint_roundtrip(spark, sf):
    rows = tb.clinical(spark, sf).filter("low is not null")
    opened = cp.open_constraint(rows, RULE).withColumn("opened", F.col("high"))
    closed = cp.close_constraint(opened, RULE, digits=2)
    return closed.select("id", "low", F.round("opened", 6).alias("opened"), "high")


# least, greatest even-numbered and greatest order, and the sum of least and greatest: rules that share columns
CHAIN = [cp.Inequality("most", "total", strict=True), cp.Inequality("least", "even", strict=False), cp.Inequality("even", "most", strict=False), cp.Inequality("least", "most", strict=False)]
CHAIN_SQL = """
spent as (select o_custkey as id, min(o_totalprice) as least, max(o_totalprice) filter (o_orderkey % 2 = 0) as even,
    max(o_totalprice) as most, max(o_totalprice) + min(o_totalprice) as total from orders group by 1),
whole as (select *, row_number() over (order by id) as k from spent where even is not null)"""


@query(
    "constraint_chain",
    f"""with {CHAIN_SQL.lstrip()},
    drawn as (select a.id, a.least, b.even - b.least as d1, c.most - greatest(c.even, c.least) as d2, d.total - d.most as d3
      from whole a join whole b on b.k = a.k + 1 join whole c on c.k = a.k + 2 join whole d on d.k = a.k + 3),
    first as (select *, floor((least + d1) * 100 + 0.5::double) / 100 as even from drawn),
    second as (select *, floor((even + d2) * 100 + 0.5::double) / 100 as most from first),
    third as (select *, floor((most + d3) * 100 + 0.5::double) / 100 as total from second)
    select id, least, greatest(even, least) as even, greatest(most, even) as most,
      greatest(total, most + 0.01) as total, 0 as broken from third""",
)
def constraint_chain(spark, sf):
    """Columns of different rows are put together, as independent draws would be, and closed."""
    even = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))
    spent = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("o_totalprice").alias("least"),
        F.max(even).alias("even"),
        F.max("o_totalprice").alias("most"),
        (F.max("o_totalprice") + F.min("o_totalprice")).alias("total"),
    )
    one = spent.filter("even is not null").withColumn("one", F.lit(1).cast("bigint")).withColumn("all", F.lit(0))
    rows = stage(cp.running_totals(one, ["all"], "id", ["one"]).withColumnRenamed("run_one", "k"))
    opened = stage(cp.open_constraints(rows, CHAIN))
    drawn = opened.select("id", "least", "k")
    for shift, column in ((1, "even"), (2, "most"), (3, "total")):
        drawn = drawn.join(opened.select((F.col("k") - shift).alias("k"), column), "k")
    closed = cp.close_constraints(drawn, CHAIN, 2)
    broken = sum((F.when(~r.holds(), 1).otherwise(0) for r in CHAIN), F.lit(0))
    return closed.select("id", "least", "even", "most", "total", broken.alias("broken"))


CATEGORY_SQL = f"""{CLINICAL_SQL},
long_ as (select id, 'segment' as feature, segment as level from clinical union all select id, 'nation', nation::varchar from clinical),
hits as (select feature, level, count(*) as h from long_ group by 1, 2),
levels as (select feature, level, (sum(h) over w - h) / (sum(h) over a)::double as lo, sum(h) over w / (sum(h) over a)::double as hi
  from hits window w as (partition by feature order by {name_key('level')}), a as (partition by feature))"""


@query(
    "category_scores",
    f"with {CATEGORY_SQL} select id, feature, round((lo + hi) / 2, 9) as value from long_ join levels using (feature, level)",
)
def category_scores(spark, sf):
    rows = tb.clinical(spark, sf)
    levels = cp.category_levels(rows, ["segment", "nation"])
    return cp.encode_categories(rows, ["segment", "nation"], levels).withColumn("value", F.round("value", 9))


@query(
    "category_decode",
    f"""with {CATEGORY_SQL}, draws as (select * from {uniform("(select id, feature, case feature when 'segment' then 1 else 2 end as f from long_)", "id, feature, f", "u", 5, "id", "f")})
    select d.id, d.feature, l.level from draws d join levels l on l.feature = d.feature and d.u >= l.lo and d.u < l.hi""",
)
def category_decode(spark, sf):
    rows = tb.clinical(spark, sf)
    levels = cp.category_levels(rows, ["segment", "nation"])
    cells = cp._category_values(rows, ["segment", "nation"], "id").withColumn(
        "f", F.when(F.col("feature") == "segment", 1).otherwise(2)
    )
    draws = cp.with_uniform(cells.select("id", "feature", "f"), "value", 5, "id", "f")
    return cp.decode_categories(draws, levels).select("id", "feature", "level")
