"""Evaluation and bootstrap queries.

Stand-ins: customers of three segments play the synthetic table, those of the other two
the original one.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from contract import tables as tb
from contract.registry import query
from contract.sqltext import permutation, uniform
from contract.tables import BOTH_SQL, CLINICAL_SQL, DENSE_SQL
from twinloom.operators import bootstrap as bs
from twinloom.operators import evaluate as ev
from twinloom.staging import at_most, stage

SYNTH = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]
# the synthetic side's rows for each draw and for each sampled row
PER_DRAW, PER_ROW, ROOT = 250, 3, 42
ZERO_SHARE = 0.6


def sides(spark, sf, kind="dense"):
    cells = tb.cells(spark, sf, kind)
    segment = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    named = stage(cells.join(segment, "id"))  # every evaluation scans both sides more than once
    synthetic = F.col("c_mktsegment").isin(SYNTH)
    return (
        named.filter(synthetic).select("id", "feature", "value"),
        named.filter(~synthetic).select("id", "feature", "value"),
    )


SIDES_SQL = f"""{DENSE_SQL},
sided as (select c.*, m.c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') as synth
          from cells c join customer m on m.c_custkey = c.id),
synth as (select id, feature, value from sided where synth),
orig as (select id, feature, value from sided where not synth)"""

KS_SQL = """
pool as (select feature, value, sum(s) as s, sum(o) as o from (
    select feature, value, 1 as s, 0 as o from synth union all select feature, value, 0, 1 from orig) group by 1, 2),
walk as (select feature, sum(s) over w as rs, sum(o) over w as ro, sum(s) over a as ns, sum(o) over a as no
         from pool window w as (partition by feature order by value), a as (partition by feature)),
ks as (select feature, max(ns)::bigint as n1, max(no)::bigint as n2,
              max(abs(rs / ns::double - ro / no::double)) as ks from walk group by feature)"""


def limit_sql(t: str) -> str:
    upper = " + ".join(f"({2 if k % 2 else -2} * exp(-2.0::double * {k * k} * {t} * {t}))" for k in range(1, 9))
    lower = " + ".join(f"exp({-((k * math.pi) ** 2) / 8.0!r}::double / ({t} * {t}))" for k in range(1, 9, 2))
    return (
        f"greatest(0, least(1, case when {t} <= 1e-8 then 1 when {t} < 1 "
        f"then 1 - {math.sqrt(2 * math.pi)!r}::double / {t} * ({lower}) else {upper} end))"
    )


@query(
    "eval_feature_filter",
    f"""with {BOTH_SQL} select feature, count(*) filter (value = 0)::bigint as zeros, count(*)::bigint as n
    from cells group by feature having count(*) filter (value = 0) < {ZERO_SHARE}::double * count(*)""",
)
def eval_feature_filter(spark, sf):
    return ev.dense_features(tb.cells(spark, sf, "both"), ZERO_SHARE)


@query("ks_statistic", f"with {SIDES_SQL},{KS_SQL} select feature, n1, n2, round(ks, 9) as ks from ks")
def ks_statistic(spark, sf):
    out = ev.ks_statistic(*sides(spark, sf))
    return out.select("feature", "n1", "n2", F.round("ks", 9).alias("ks"))


@query(
    "ks_pvalue",
    f"""with {SIDES_SQL},{KS_SQL}, scaled as (select *, sqrt(n1::double * n2::double / (n1 + n2)::double) as e from ks),
    timed as (select feature, n1, n2, ks, (e + 0.12::double + 0.11::double / e) * ks as t from scaled)
    select feature, n1, n2, round(ks, 9) as ks, round({limit_sql('t')}, 9) as ks_p from timed""",
)
def ks_pvalue(spark, sf):
    out = ev.ks_test(*sides(spark, sf), method="asymptotic")
    return out.select("feature", "n1", "n2", F.round("ks", 9).alias("ks"), F.round("ks_p", 9).alias("ks_p"))


# the pooled sample is drawn one by one; mass that reaches the distance is moved out
EXACT_SQL = """
cases as (select distinct n1, n2, ks, n1 // gcd(n1, n2) * n2 as lcm, round(ks * (n1 // gcd(n1, n2) * n2)) as steps from ks),
path as (
  select n1, n2, ks, lcm, steps, 0 as drawn, 0.0::double as hit,
    list_transform(range(n1 + 1), lambda i: case when i = 0 then 1.0::double else 0.0::double end) as mass from cases
  union all
  select n1, n2, ks, lcm, steps, drawn + 1,
    hit + list_sum(list_transform(range(n1 + 1), lambda i: case when abs(i * (lcm // n1) - (drawn + 1 - i) * (lcm // n2)) >= steps then moved[i + 1] else 0 end)),
    list_transform(range(n1 + 1), lambda i: case when abs(i * (lcm // n1) - (drawn + 1 - i) * (lcm // n2)) >= steps then 0 else moved[i + 1] end)
  from (select *, list_transform(range(n1 + 1), lambda i: mass[i + 1] - mass[i + 1] * (n1 - i) / (n1 + n2 - drawn)::double
          + case when i > 0 then mass[i] * (n1 - i + 1) / (n1 + n2 - drawn)::double else 0 end) as moved
        from path where drawn < n1 + n2)),
exact as (select n1, n2, ks, least(1, greatest(0, hit)) as ks_p from path where drawn = n1 + n2)"""


@query(
    "ks_pvalue_exact",
    f"""with recursive {SIDES_SQL},{KS_SQL},{EXACT_SQL}
    select feature, n1, n2, round(ks, 9) as ks, round(ks_p, 9) as ks_p from ks join exact using (n1, n2, ks)""",
)
def ks_pvalue_exact(spark, sf):
    """The default for samples of these sizes: exact probabilities."""
    out = ev.ks_test(*sides(spark, sf))
    return out.select("feature", "n1", "n2", F.round("ks", 9).alias("ks"), F.round("ks_p", 9).alias("ks_p"))


def kl_sql(sample: str, extra: str = "") -> str:
    """CTEs ending in kl(<extra>, feature, kl_divergence); ``sample`` has (<extra>, feature, value)."""
    e = f"{extra}, " if extra else ""
    on = f"and k.{extra} = g.{extra}" if extra else ""
    ge = f"g.{extra}, " if extra else ""
    return f"""
s_stats as (select {e}feature, count(*) as n, min(value) as mn, max(value) as mx,
    stddev_samp(value) * pow(count(*)::double, -0.2) as h from {sample} group by all),
o_stats as (select feature, count(*) as n, min(value) as mn, max(value) as mx,
    stddev_samp(value) * pow(count(*)::double, -0.2) as h from orig group by feature),
grid as (select {'s.' + e if e else ''}s.feature, g.i, s.n as sn, o.n as n_o, s.h as sh, o.h as oh,
    least(s.mn, o.mn) + g.i * ((greatest(s.mx, o.mx) - least(s.mn, o.mn)) / 999.0::double) as x
  from s_stats s join o_stats o using (feature) cross join (select unnest(range(1000)) as i) g),
s_counts as (select {e}feature, value, count(*) as w from {sample} group by all),
o_counts as (select feature, value, count(*) as w from orig group by all),
q as (select {ge}g.feature, g.i, sum(w * exp(-0.5 * pow((x - value) / sh, 2))) / (any_value(sn) * any_value(sh) * sqrt(2 * pi())) as q
  from grid g join s_counts k on k.feature = g.feature {on} group by all),
p as (select {ge}g.feature, g.i, sum(w * exp(-0.5 * pow((x - value) / oh, 2))) / (any_value(n_o) * any_value(oh) * sqrt(2 * pi())) as p
  from grid g join o_counts k on k.feature = g.feature group by all),
kl as (select {e}feature, sum(case when q > 0 and p > 0 then p * ln(p / q) else 0 end) as kl_divergence
  from p join q using ({e}feature, i) group by all)"""


@query("kl_divergence", f"with {SIDES_SQL},{kl_sql('synth')} select feature, round(kl_divergence, 7) as kl_divergence from kl")
def kl_divergence(spark, sf):
    out = ev.kl_divergence(*sides(spark, sf), nan_policy="zero")
    return out.select("feature", F.round("kl_divergence", 7).alias("kl_divergence"))


@query(
    "kl_propagate",
    f"""with {SIDES_SQL},{kl_sql('synth')}, lost as (select feature, bool_or(q > 0 and not p > 0) as undefined from p join q using (feature, i) group by 1)
    select feature, undefined, case when not undefined then round(kl_divergence, 7) end as kl_divergence from kl join lost using (feature)""",
)
def kl_propagate(spark, sf):
    """The default rule: 0 * ln 0 makes the sum undefined."""
    out = ev.kl_divergence(*sides(spark, sf))
    undefined = F.isnan("kl_divergence")
    return out.select(
        "feature", undefined.alias("undefined"), F.when(~undefined, F.round("kl_divergence", 7)).alias("kl_divergence")
    )


DRAWS_SQL = f"""
n_ids as (select count(distinct id)::bigint as n from synth),
numbers as (select n, 2 + n // {PER_DRAW} as draws, n // {PER_ROW} as size, ceil(sqrt(n))::bigint as a from n_ids),
drawn as (select draw, floor(v * 10000)::bigint as seed from
  {uniform("(select unnest(range(draws)) as draw from numbers)", "draw", "v", ROOT, "draw")}),
places as (select draw, seed, unnest(range(size)) as x, n, a, (n + a - 1) // a as b from drawn, numbers),
walk as (
  select draw, seed, x, n, a, b, 0 as step from places
  union all
  {permutation("(select * from walk where step = 0 or x >= n)", "draw, seed", bs.SAMPLE_STREAM)}),
places_of as (select id, row_number() over (order by id) - 1 as spot from (select distinct id from synth)),
samples as (select draw, seed, id from walk join places_of on spot = x where step > 0 and x < n),
picked as (select s.draw, s.seed, c.feature, c.value from samples s join synth c on c.id = s.id)"""


def _numbers(synthetic):
    """The ids, staged, size and draws: both numbers grow with the synthetic side."""
    ids = stage(synthetic.select("id").distinct())
    n = at_most(ids)
    return ids, n // PER_ROW, 2 + n // PER_DRAW


def _samples(synthetic):
    return bs.draw_samples(*_numbers(synthetic), ROOT)


@query("bootstrap_sample", f"with recursive {SIDES_SQL},{DRAWS_SQL} select draw, seed, id from samples")
def bootstrap_sample(spark, sf):
    return _samples(sides(spark, sf)[0])


# distance of each replicate; p-values through the exact test's critical distance
DISTANCE_SQL = f"""
r_pool as (select draw, feature, value, sum(s) as s, sum(o) as o from (
    select draw, feature, value, 1 as s, 0 as o from picked
    union all select d.draw, o.feature, o.value, 0, 1 from orig o cross join drawn d) group by 1, 2, 3),
r_walk as (select draw, feature, sum(s) over w as rs, sum(o) over w as ro, sum(s) over a as ns, sum(o) over a as no
  from r_pool window w as (partition by draw, feature order by value), a as (partition by draw, feature)),
r_ks as (select draw, feature, max(ns) as n1, max(no) as n2, max(abs(rs / ns::double - ro / no::double)) as ks
  from r_walk group by 1, 2),
r_p as (select draw, feature, ks, {limit_sql('t')} as ks_p from (
  select *, (e + 0.12::double + 0.11::double / e) * ks as t from (
    select *, sqrt(n1::double * n2::double / (n1 + n2)::double) as e from r_ks))),
scored as (select draw, count(*) filter (ks_p < 0.05)::bigint as failed,
  floor(count(*) filter (ks_p < 0.05) / count(*)::double * 1000) / 1000.0::double as ks from r_p group by draw),
scores as (select s.draw, d.seed, s.failed, s.ks from scored s join drawn d using (draw))"""


@query("bootstrap_distances", f"with recursive {SIDES_SQL},{DRAWS_SQL},{DISTANCE_SQL} select draw, feature, round(ks, 9) as ks from r_ks")
def bootstrap_distances(spark, sf):
    synthetic, original = sides(spark, sf)
    out = bs.drawn_distances(*_numbers(synthetic), ROOT, synthetic, original).distances
    return out.select("draw", "feature", F.round("ks", 9).alias("ks"))


def _scores(spark, sf):
    synthetic, original = sides(spark, sf)
    drawn = bs.drawn_distances(*_numbers(synthetic), ROOT, synthetic, original)
    distances = drawn.distances
    n = distances.select("feature").distinct().count()
    scores = stage(bs.replicate_scores(distances, n, ROOT, method="asymptotic"))
    return synthetic, original, drawn, scores, n


@query("bootstrap_scores", f"with recursive {SIDES_SQL},{DRAWS_SQL},{DISTANCE_SQL} select draw, seed, failed, round(ks, 6) as ks from scores")
def bootstrap_scores(spark, sf):
    return _scores(spark, sf)[3].withColumn("ks", F.round("ks", 6))


BEST_SQL = f"""
tied as (select draw, seed, ks, row_number() over (order by draw) as place from scores where ks = (select min(ks) from scores)),
t_cells as (select p.draw, p.feature, p.value from picked p join tied using (draw)),
{kl_sql('t_cells', 'draw').lstrip()},
beats as (select b.place as place, a.place as rival from tied a join tied b on b.place > a.place
  join kl ka on ka.draw = a.draw join kl kb on kb.draw = b.draw and kb.feature = ka.feature
  group by 1, 2 having count(*) filter (kb.kl_divergence < ka.kl_divergence) > count(*) / 2.0),
fold as (select 1::bigint as step, 1::bigint as best
  union all select step + 1, case when exists (select 1 from beats where place = step + 1 and rival = best) then step + 1 else best end
  from fold where step < (select count(*) from tied)),
winner as (select t.draw, t.seed, t.ks from tied t where place = (select best from fold order by step desc limit 1))"""


def _best(spark, sf):
    synthetic, original, drawn, scores, n = _scores(spark, sf)
    tied = stage(bs.tied_best(scores))
    kl = stage(ev.kl_divergence(stage(drawn.cells(tied)), original, draws=["draw"], nan_policy="zero"))
    draw = bs.select_best(tied, kl, n)
    return synthetic, original, tied.filter(F.col("draw") == draw)


@query("bootstrap_best", f"with recursive {SIDES_SQL},{DRAWS_SQL},{DISTANCE_SQL},{BEST_SQL} select draw, seed, round(ks, 6) as ks from winner")
def bootstrap_best(spark, sf):
    return _best(spark, sf)[2].select("draw", "seed", F.round("ks", 6).alias("ks"))


@query(
    "bootstrap_clinical",
    f"""with recursive {SIDES_SQL},{CLINICAL_SQL},{DRAWS_SQL},{DISTANCE_SQL},{BEST_SQL}
    select c.id, c.segment, c.balance from clinical c
    where c.id in (select id from samples s where s.draw = (select draw from winner))""",
)
def bootstrap_clinical(spark, sf):
    synthetic, _, winner = _best(spark, sf)
    ids = bs.sample_by_seed(*_numbers(synthetic)[:2], winner.first()["seed"])
    return tb.clinical(spark, sf).join(ids, "id", "left_semi").select("id", "segment", "balance")


@query(
    "bootstrap_statistics",
    f"""with recursive {SIDES_SQL},{DRAWS_SQL},{DISTANCE_SQL},{BEST_SQL}
    select k.feature as "Peptide_id", round(k.kl_divergence, 7) as kl_divergence, round(p.ks_p, 9) as "ks_p-value"
    from kl k join winner w on w.draw = k.draw join r_p p on p.draw = k.draw and p.feature = k.feature""",
)
def bootstrap_statistics(spark, sf):
    synthetic, original, winner = _best(spark, sf)
    ids = bs.sample_by_seed(*_numbers(synthetic)[:2], winner.first()["seed"])
    chosen = synthetic.join(ids, "id", "left_semi")
    out = bs.statistics(chosen, original, method="asymptotic", nan_policy="zero")
    return out.select(
        F.col("feature").alias("Peptide_id"),
        F.round("kl_divergence", 7).alias("kl_divergence"),
        F.round("ks_p", 9).alias("ks_p-value"),
    )
