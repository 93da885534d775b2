"""Marginal fitting queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from contract import tables as tb
from contract.registry import query
from contract.sqltext import norm_cdf
from contract.tables import CLINICAL_SQL, DENSE_SQL
from twinloom.functions.normal import LOG_SQRT_2PI
from twinloom.operators import marginals as mg
from twinloom.operators.prep import join_cohort, melt_features
from twinloom.staging import stage

LS = f"{LOG_SQRT_2PI!r}::double"
PARAMETRIC = ["norm", "uniform", "gamma", "lognorm", "beta", "t", "truncnorm"]

# moments of the non-zero cells; population kurtosis written out
MOMENTS_SQL = f"""{DENSE_SQL},
values_ as (select feature, value as x from cells where value <> 0),
centre as (select feature, avg(x) as mean from values_ group by feature),
moments as (
  select v.feature, count(*)::bigint as n, min(x) as mn, max(x) as mx, max(c.mean) as mean,
         stddev_pop(x) as sd,
         (sum(pow(x - c.mean, 4)) / count(*)) / pow(sum(pow(x - c.mean, 2)) / count(*), 2) - 3 as kurt,
         avg(ln(x)) as mean_ln, avg(x * ln(x)) as mean_xln
  from values_ v join centre c using (feature) group by v.feature)"""

LOGNORM_SQL = """
shifts as (select * from (values (0, null::double), (1, 0.001), (2, 0.01), (3, 0.1), (4, 1.0)) t(i, c)),
places as (select feature, n, i, case when i = 0 then (case when mn > 0 then 0.0::double end)
                  else mn - c::double * (mx - mn) end as loc from moments, shifts),
logs as (select v.feature, i, max(n) as n, max(loc) as loc, avg(ln(x - loc)) as m, stddev_pop(ln(x - loc)) as s
         from values_ v join places p using (feature) where loc is not null group by 1, 2),
lognorm as (select feature, arg_max(struct_pack(s := s, loc := loc, scale := exp(m)),
              -n * (ln(s) + m + 0.5 + %s)) as p from logs group by feature)""" % LS


def _truncnorm_sql() -> str:
    phi = lambda v: f"(exp(-0.5::double * {v} * {v}) / {math.sqrt(2 * math.pi)!r}::double)"
    return f"""
solve as (
  select feature, 0 as step, mn, mx, mean, sd, mean as mu, sd as sg from moments
  union all
  select feature, step + 1, mn, mx, mean, sd,
    least(greatest(mean - sg * ((fa - fb) / z), mn), mx),
    least(sd / sqrt(1 + (a * fa - b * fb) / z - ((fa - fb) / z) * ((fa - fb) / z)), {mg.FLAT} * (mx - mn))
  from (select *, {phi('a')} as fa, {phi('b')} as fb, {norm_cdf('b')} - {norm_cdf('a')} as z
        from (select *, (mn - mu) / sg as a, (mx - mu) / sg as b from solve where step < {mg.TRUNCNORM_STEPS}))),
truncnorm as (select feature, mu as loc, sg as scale, (mn - mu) / sg as a, (mx - mu) / sg as b
              from solve where step = {mg.TRUNCNORM_STEPS})"""


BETA_SQL = f"""
scaled as (select *, mn - {mg.BETA_PAD} * (mx - mn) as loc, (mx - mn) * (1 + 2 * {mg.BETA_PAD}) as scale from moments),
unit as (select *, (mean - loc) / scale as m, sd * sd / (scale * scale) as v from scaled),
beta as (select feature, loc, scale, m * (m * (1 - m) / v - 1) as a,
                (1 - m) * (m * (1 - m) / v - 1) as b from unit)"""

def _sum(term: str, y: str) -> str:
    return " + ".join(term.format(y=f"({y} + {k})") for k in range(8))


def _t_sql() -> str:
    """Median, log moments about it, and Newton steps for trigamma(df / 2)."""
    z = "(y + 8.0::double)"
    tri = lambda y, z: (
        f"(1 / {z} + 0.5 / pow({z}, 2) + 1 / (6 * pow({z}, 3)) - 1 / (30 * pow({z}, 5)) + 1 / (42 * pow({z}, 7))"
        f" + {_sum('1 / pow({y}, 2)', y)})"
    )
    tetra = (
        f"(-1 / pow({z}, 2) - 1 / pow({z}, 3) - 0.5 / pow({z}, 4) + 1 / (6 * pow({z}, 6)) - 1 / (6 * pow({z}, 8))"
        f" - ({_sum('2 / pow({y}, 3)', 'y')}))"
    )
    di = lambda y: (
        f"(ln({y} + 8) - 0.5 / ({y} + 8) - 1 / (12 * pow({y} + 8, 2)) + 1 / (120 * pow({y} + 8, 4))"
        f" - 1 / (252 * pow({y} + 8, 6)) - ({_sum('1 / {y}', y)}))"
    )
    top = f"{mg.T_MAX_DF / 2}::double"
    return f"""
middle as (select feature, quantile_disc(x, 0.5) as loc from values_ group by feature),
logged as (select v.feature, any_value(loc) as loc, avg(ln(abs(x - loc))) as m, var_pop(ln(abs(x - loc))) as v
           from values_ v join middle using (feature) where x <> loc group by 1),
wanted as (select *, greatest(4 * v - pi() * pi() / 2, {tri(top, f"({top} + 8)")}) as w from logged),
newton as (select feature, 0 as step, w, 0.5::double + 1 / w as y from wanted
  union all select feature, step + 1, w, y + tg * (1 - tg / w) / {tetra}
  from (select *, {tri('y', z)} as tg from newton where step < {mg.T_STEPS})),
degrees as (select l.*, least(2 * y, {mg.T_MAX_DF}::double) as df from newton n join logged l using (feature) where step = {mg.T_STEPS}),
t as (select feature, df, loc, exp(m - 0.5 * ({di('0.5::double')} - {di('(df / 2)')} + ln(df))) as scale from degrees)"""


T_SQL = _t_sql()


def _fit_query(family: str, body: str):
    names = mg.REGISTRY[family].params
    shown = ", ".join(f"round({p}, 6) as {p}" for p in names)

    @query(f"fit_{family.replace('gaussian_', '')}", f"with recursive {MOMENTS_SQL}{body.format(shown=shown)}")
    def run(spark, sf):
        cells = tb.cells(spark, sf)
        fits = mg.fit(mg.nonzero(stage(cells) if family == "lognorm" else cells), [family])
        return fits.select("feature", *[F.round(F.col(family)[p], 6).alias(p) for p in names])


_fit_query("norm", " select feature, round(mean, 6) as loc, round(sd, 6) as scale from moments")
_fit_query("uniform", " select feature, round(mn, 6) as loc, round(mx - mn, 6) as scale from moments")
_fit_query(
    "gamma",
    " select feature, round(mean / (mean_xln - mean_ln * mean), 6) as a, 0.0::double as loc,"
    " round(mean_xln - mean_ln * mean, 6) as scale from moments",
)
_fit_query(
    "lognorm",
    "," + LOGNORM_SQL + " select feature, round(p.s, 6) as s, round(p.loc, 6) as loc, round(p.scale, 6) as scale from lognorm",
)
_fit_query("beta", "," + BETA_SQL + " select feature, {shown} from beta")
_fit_query("t", "," + T_SQL + " select feature, {shown} from t")


@query(
    "fit_t_heavy",
    f"""with recursive values_ as (select c_mktsegment as feature, c_acctbal / (c_nationkey - 12.5::double) as x from customer),
    {T_SQL.lstrip()} select feature, round(df, 6) as df, round(loc, 6) as loc, round(scale, 6) as scale from t""",
)
def fit_t_heavy(spark, sf):
    """Quotients, whose tails are far heavier than a normal distribution's."""
    value = (F.col("c_acctbal") / (F.col("c_nationkey") - 12.5)).alias("value")
    cells = tb.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("feature"), value)
    out = mg.fit(stage(cells), ["t"])
    return out.select("feature", *[F.round(F.col("t")[p], 6).alias(p) for p in ("df", "loc", "scale")])


@query(
    "fit_t_fine",
    f"""with recursive values_ as (select l_returnflag || l_linestatus as feature, l_extendedprice::double as x from lineitem),
    {T_SQL.lstrip()} select feature, round(df, 6) as df, round(loc, 6) as loc, round(scale, 6) as scale from t""",
)
def fit_t_fine(spark, sf):
    """Tens of thousands of different values a feature, whose median is exact all the same."""
    name = F.concat("l_returnflag", "l_linestatus").alias("feature")
    cells = tb.table(spark, sf, "lineitem").select(name, F.col("l_extendedprice").cast("double").alias("value"))
    out = mg.fit(stage(cells), ["t"])
    return out.select("feature", *[F.round(F.col("t")[p], 6).alias(p) for p in ("df", "loc", "scale")])


_fit_query("truncnorm", "," + _truncnorm_sql().replace("{", "{{").replace("}", "}}") + " select feature, {shown} from truncnorm")
_fit_query(
    "gaussian_kde",
    " select feature, round(sd * sqrt(n / (n - 1.0::double)) * pow(n::double, -0.2), 6) as bandwidth from moments",
)


def _located_sql(family: str) -> str:
    """Rounds of candidates, each narrowed to the neighbours of the best one before; ends in located(feature, j, loc, m, v)."""
    last = f"{mg.POINTS - 1}.0::double"
    second = "stddev_pop(ln(x - loc))" if family == "lognorm" else "covar_pop(x, ln(x - loc))"
    gain = f"-(ln(v) + m + 0.5 + {LS})" if family == "lognorm" else "(mean - loc) / v * (m - 1 - ln(v)) - m - lgamma((mean - loc) / v)"
    ctes = [
        f"bracket0 as (select feature, min(x) as mn, max(x) as mx, avg(x) as mean, {math.log(mg.NEAREST)!r}::double as lo, {math.log(mg.FARTHEST)!r}::double as hi from values_ group by 1)"
    ]
    step, k = math.log(mg.FARTHEST / mg.NEAREST) / (mg.POINTS - 1), 0
    while True:
        ctes += [
            f"places{k} as (select *, mn - exp(lo + (hi - lo) * (j / {last})) * (mx - mn) as loc from (select *, unnest(range({mg.POINTS})) as j from bracket{k}))",
            f"""tried{k} as (select feature, j, any_value(loc) as loc, any_value(mean) as mean, any_value(lo) as lo, any_value(hi) as hi,
              any_value(mn) as mn, any_value(mx) as mx, avg(ln(x - loc)) as m, {second} as v
              from values_ join places{k} using (feature) group by 1, 2)""",
            f"best{k} as (select * from tried{k} qualify row_number() over (partition by feature order by {gain} desc, j desc) = 1)",
        ]
        if step < math.log(mg.SETTLED):
            return ",\n".join([*ctes, f"located as (select * from best{k})"])
        ctes.append(
            f"bracket{k + 1} as (select feature, mn, mx, mean, lo + (hi - lo) * greatest(j - 1, 0) / {last} as lo, lo + (hi - lo) * least(j + 1, {mg.POINTS - 1}) / {last} as hi from best{k})"
        )
        step, k = 2 * step / (mg.POINTS - 1), k + 1


# skewed functions of prices and balances, shifted far from zero or below it
SHIFTED_SQL = """values_ as (
  select 'price ' || l_returnflag as feature, exp(l_extendedprice::double / 30000) + 100 as x from lineitem
  union all select 'sum ' || c_mktsegment, exp(c_acctbal / 4000) - 500 from customer)"""


def _shifted(spark, sf):
    price = tb.table(spark, sf, "lineitem").select(
        F.concat(F.lit("price "), "l_returnflag").alias("feature"), (F.exp(F.col("l_extendedprice").cast("double") / 30000) + 100).alias("value")
    )
    root = tb.table(spark, sf, "customer").select(
        F.concat(F.lit("sum "), "c_mktsegment").alias("feature"), (F.exp(F.col("c_acctbal") / 4000) - 500).alias("value")
    )
    return stage(price.unionByName(root))


def _located_query(family: str, shown: str):
    names = mg.REGISTRY[family].params

    @query(f"fit_{family}_located", f"with {SHIFTED_SQL},\n{_located_sql(family)} select feature, {shown} from located")
    def run(spark, sf):
        fits = mg.fit(_shifted(spark, sf), [family], locate=[family])
        return fits.select("feature", *[F.round(F.col(family)[p], 5).alias(p) for p in names])


_located_query("lognorm", "round(v, 5) as s, round(loc, 5) as loc, round(exp(m), 5) as scale")
_located_query("gamma", "round((mean - loc) / v, 5) as a, round(loc, 5) as loc, round(v, 5) as scale")


@query(
    "feature_profile",
    f"""with {MOMENTS_SQL} select feature, n, round(mn, 6) as mn, round(mx, 6) as mx, round(mean, 6) as mean,
    round(sd, 6) as sd, round(kurt, 6) as kurt, mn = mx as constant from moments""",
)
def feature_profile(spark, sf):
    out = mg.profile(mg.nonzero(tb.cells(spark, sf)))
    return out.select(
        "feature", "n", *[F.round(F.col(c), 6).alias(c) for c in ("mn", "mx", "mean", "sd", "kurt")], "constant"
    )


@query(
    "fit_marginals",
    f"""with {MOMENTS_SQL},{LOGNORM_SQL}
    select feature, 'norm' as family, round(mean, 6) as loc, round(sd, 6) as scale, null::double as s from moments
    union all select feature, 'lognorm', round(p.loc, 6), round(p.scale, 6), round(p.s, 6) from lognorm
    union all select feature, 'gamma', 0.0, round(mean_xln - mean_ln * mean, 6), null from moments""",
)
def fit_marginals(spark, sf):
    families = ["norm", "lognorm", "gamma"]
    fits = mg.fit(mg.nonzero(stage(tb.cells(spark, sf))), families)
    return mg.params_long(fits, families).select(
        "feature", "family", *[F.round(F.col("params")[p], 6).alias(p) for p in ("loc", "scale", "s")]
    )


# log density of each family at x, joined with its parameters
DENSITY_SQL = f"""{MOMENTS_SQL},{LOGNORM_SQL},{BETA_SQL},{T_SQL},{_truncnorm_sql()},
points as (%s),
density as (
  select pt.*, 'norm' as family, 2 as k, 0 as position, -ln(sd) - {LS} - 0.5 * pow((x - mean) / sd, 2) as lp
    from points pt join moments using (feature)
  union all select pt.*, 'gamma', 2, 2, (mean / th - 1) * ln(x) - x / th - (mean / th) * ln(th) - lgamma(mean / th)
    from points pt join (select feature, mean, mean_xln - mean_ln * mean as th from moments) g using (feature)
  union all select pt.*, 'lognorm', 3, 3,
      -ln(p.s) - {LS} - ln(x - p.loc) - 0.5 * pow((ln(x - p.loc) - ln(p.scale)) / p.s, 2)
    from points pt join lognorm using (feature)
  union all select pt.*, 'beta', 4, 4, lgamma(a + b) - lgamma(a) - lgamma(b) - ln(scale)
      + (a - 1) * ln((x - loc) / scale) + (b - 1) * ln(1 - (x - loc) / scale)
    from points pt join beta using (feature)
  union all select pt.*, 't', 3, 5, lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - ln(scale)
      - (df + 1) / 2 * ln(1 + pow((x - loc) / scale, 2) / df)
    from points pt join t using (feature)
  union all select pt.*, 'truncnorm', 4, 6, -ln(scale) - {LS} - ln({norm_cdf('b')} - {norm_cdf('a')})
      - 0.5 * pow((x - loc) / scale, 2)
    from points pt join truncnorm using (feature)
  union all select pt.*, 'uniform', 2, 1, -ln(mx - mn)
    from points pt join moments using (feature))"""

SCAN_SQL = DENSITY_SQL % "select feature, x from values_"
BIN_SQL = (
    DENSITY_SQL
    % """select m.feature, b.bin, mn + (b.bin + 0.5) * ((mx - mn) / 100.0) as x,
         coalesce(h.hits, 0) / (n * ((mx - mn) / 100.0)) as y
       from moments m cross join (select unnest(range(100)) as bin) b
       left join (select v.feature, least(99, floor((x - mn) / (mx - mn) * 100.0))::int as bin, count(*) as hits
                  from values_ v join moments m using (feature) group by 1, 2) h
         on h.feature = m.feature and h.bin = b.bin"""
)


@query(
    "score_sse",
    f"with recursive {BIN_SQL} select feature, family, round(sum(pow(exp(lp) - y, 2)), 8) as score from density group by 1, 2",
)
def score_sse(spark, sf):
    values = mg.nonzero(stage(tb.cells(spark, sf)))
    out = mg.score(values, mg.fit(values, PARAMETRIC), PARAMETRIC)
    return out.select("feature", "family", F.round("score", 8).alias("score"))


def _information(name: str, penalty: str):
    @query(
        f"score_{name}",
        f"""with recursive {SCAN_SQL} select feature, family, round({penalty} - 2 * sum(lp), 4) as score
        from density group by 1, 2""",
    )
    def run(spark, sf):
        values = mg.nonzero(stage(tb.cells(spark, sf)))
        out = mg.score(values, mg.fit(values, PARAMETRIC), PARAMETRIC, name)
        return out.select("feature", "family", F.round("score", 4).alias("score"))


_information("aic", "2 * max(k)")
_information("bic", "max(k) * ln(count(*))")


@query(
    "score_kde",
    f"""with {MOMENTS_SQL}, bins as (
      select m.feature, b.bin, n, mn + (b.bin + 0.5) * ((mx - mn) / 100.0) as g,
        sd * sqrt(n / (n - 1.0::double)) * pow(n::double, -0.2) as h,
        coalesce(c.hits, 0) / (n * ((mx - mn) / 100.0)) as y
      from moments m cross join (select unnest(range(100)) as bin) b
      left join (select v.feature, least(99, floor((x - mn) / (mx - mn) * 100.0))::int as bin, count(*) as hits
                 from values_ v join moments m using (feature) group by 1, 2) c
        on c.feature = m.feature and c.bin = b.bin),
    smooth as (select b.feature, b.bin, max(y) as y,
        sum(exp(-0.5 * pow((g - x) / h, 2)) / (h * {math.sqrt(2 * math.pi)!r}::double)) / max(n) as d
      from bins b join values_ v on v.feature = b.feature group by 1, 2)
    select feature, 'gaussian_kde' as family, round(sum(pow(d - y, 2)), 8) as score from smooth group by 1""",
)
def score_kde(spark, sf):
    values = mg.nonzero(stage(tb.cells(spark, sf)))
    out = mg.score(values, mg.fit(values, ["gaussian_kde"]), ["gaussian_kde"])
    return out.select("feature", "family", F.round("score", 8).alias("score"))


SELECT_LIST = ["lognorm", "norm", "gamma", "beta"]


def _with_clinical(spark, sf):
    """Dense features plus the clinical balance, to be modelled alike."""
    clinical = melt_features(tb.clinical(spark, sf).select("id", "balance"), names=["balance"])
    return tb.cells(spark, sf).unionByName(clinical)


@query(
    "select_family",
    f"""with recursive {BIN_SQL.replace("values_ as (select feature, value as x from cells where value <> 0)",
      "values_ as (select feature, value as x from (select feature, value from cells union all select 'balance', c_acctbal from customer) where value <> 0)")},
    scored as (select feature, family, sum(pow(exp(lp) - y, 2)) as score from density
      where family in ('lognorm', 'norm', 'gamma', 'beta') and (feature <> 'balance' or family <> 'gamma') group by 1, 2)
    select feature, arg_min(family, score) as family, round(min(score), 8) as score from scored group by feature""",
)
def select_family(spark, sf):
    out = mg.select_family(stage(_with_clinical(spark, sf)), SELECT_LIST)
    return out.select("feature", "family", F.round("score", 8).alias("score"))


@query(
    "grouped_marginals",
    f"""with {CLINICAL_SQL}, {DENSE_SQL},
    v as (select c.segment, f.feature, f.value as x from clinical c join cells f on f.id = c.id where f.value <> 0)
    select segment, feature, count(*)::bigint as n, round(avg(x), 6) as norm_loc, round(stddev_pop(x), 6) as norm_scale,
      round(avg(x) / (avg(x * ln(x)) - avg(ln(x)) * avg(x)), 6) as gamma_a,
      round(avg(x * ln(x)) - avg(ln(x)) * avg(x), 6) as gamma_scale
    from v group by 1, 2""",
)
def grouped_marginals(spark, sf):
    joined = join_cohort(tb.clinical(spark, sf).select("id", "segment"), tb.cells(spark, sf))
    fits = mg.fit(mg.nonzero(joined), ["norm", "gamma"], keys=["segment", "feature"])
    return fits.select(
        "segment", "feature", "n",
        F.round("norm.loc", 6).alias("norm_loc"), F.round("norm.scale", 6).alias("norm_scale"),
        F.round("gamma.a", 6).alias("gamma_a"), F.round("gamma.scale", 6).alias("gamma_scale"),
    )
