"""Marginal families: fitting, scoring and selection, one row per feature.

All estimators are closed forms of aggregates (two scans at most), so a feature of any
size is reduced map-side. They stand in for iterative maximum likelihood:

norm        mean, population standard deviation
uniform     min, max - min
gamma       location 0, closed form from mean, mean log, mean x*log x
lognorm     best of a fixed set of locations below the minimum, by likelihood
            (both: location searched by profile likelihood where ``locate`` names them)
beta        moments on the range padded by ``BETA_PAD`` of its width; no fit where the variance
            is that of two points or more
t           location median; degrees of freedom and scale from mean and variance of
            ln|x - median|, which exist for any tail
truncnorm   bounds min and max, moment equations iterated to a tolerance; no fit if
            they do not settle or the deviation reaches ``FLAT`` widths
gaussian_kde  Scott bandwidth
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.names import div, ref
from twinloom.functions.normal import LOG_SQRT_2PI, ln_gamma, np_norm_cdf
from twinloom.operators.kernels import kernel_sums
from twinloom.operators.ordered import quantiles
from twinloom.staging import attach, stage

# The selectable families and selection methods.
SELECTABLE = ("norm", "beta", "lognorm", "truncnorm", "gamma", "t", "gaussian_kde")
METHODS = ("sumsquare_error", "aic", "bic")
LOGNORM_SHIFTS = (1e-3, 1e-2, 1e-1, 1.0)
BETA_PAD = 1e-3
# Families whose location can be searched, and the search: distances in widths, candidates per scan, ratio to stop at.
LOCATED = ("lognorm", "gamma")
NEAREST, FARTHEST = 1e-3, 100.0
POINTS = 9
SETTLED = 1.01
# Beyond this the t is a normal distribution to six digits.
T_MAX_DF = 1e6
T_STEPS = 60
TRUNCNORM_STEPS = 2000
TOLERANCE = 1e-10
# A truncated normal this many widths wide is a uniform distribution to two digits.
FLAT = 2.0
BINS = 100


@dataclass(frozen=True)
class Family:
    """Parameter names (in the usual order), the log density as a Column of x, and how many
    parameters are free (a fixed location is not).

    A family of your own (``register_family``) also has ``fit``, which gives from the columns
    n, mn, mx, mean, sd, kurt, mean_ln and mean_xln of a feature where the family applies,
    its parameters and the log normaliser ``c0``; and ``table``, which gives from the
    parameters and the observed range increasing x and their distribution function as numpy
    arrays. Scores and draws are read off that table.
    """

    params: tuple[str, ...]
    logpdf: Callable[[Column, Callable[[str], Column]], Column] | None
    fixed: int = 0
    fit: Callable[[], tuple[Column, dict[str, Column], Column]] | None = None
    table: Callable[[dict[str, float], float, float], tuple[np.ndarray, np.ndarray]] | None = None

    @property
    def free(self) -> int:
        return len(self.params) - self.fixed


def _half_square(x: Column) -> Column:
    return x * x * F.lit(-0.5)


REGISTRY: dict[str, Family] = {
    "norm": Family(("loc", "scale"), lambda x, p: p("c0") + _half_square(div(x - p("loc"), p("scale")))),
    "lognorm": Family(
        ("s", "loc", "scale"),
        lambda x, p: p("c0")
        - F.ln(x - p("loc"))
        + _half_square(div(F.ln(x - p("loc")) - F.ln(p("scale")), p("s"))),
    ),
    "gamma": Family(
        ("a", "loc", "scale"),
        lambda x, p: p("c0") + (p("a") - 1.0) * F.ln(x - p("loc")) - div(x - p("loc"), p("scale")),
        fixed=1,
    ),
    "beta": Family(
        ("a", "b", "loc", "scale"),
        lambda x, p: p("c0")
        + (p("a") - 1.0) * F.ln(div(x - p("loc"), p("scale")))
        + (p("b") - 1.0) * F.ln(F.lit(1.0) - div(x - p("loc"), p("scale"))),
    ),
    "truncnorm": Family(
        ("a", "b", "loc", "scale"), lambda x, p: p("c0") + _half_square(div(x - p("loc"), p("scale")))
    ),
    "t": Family(
        ("df", "loc", "scale"),
        lambda x, p: p("c0")
        - (p("df") + 1.0)
        / 2.0
        * F.ln(F.lit(1.0) + div(x - p("loc"), p("scale")) * (div(x - p("loc"), p("scale"))) / p("df")),
    ),
    "uniform": Family(("loc", "scale"), lambda x, p: p("c0") + x * 0.0),
    "gaussian_kde": Family(("bandwidth",), None),
}


def register_family(name: str, family: Family) -> None:
    """Make a family of your own known to fitting, selection, scores and draws."""
    if family.fit is None or family.table is None or family.logpdf is None:
        raise ValueError("a family needs logpdf, fit and table")
    REGISTRY[name] = family


def own_families() -> dict[str, Family]:
    return {name: f for name, f in REGISTRY.items() if f.table is not None}


def check_families(families: Sequence[str], method: str = "sumsquare_error") -> None:
    if method not in METHODS:
        raise ValueError(f"selection by '{method}' is unknown; known are {', '.join(METHODS)}")
    for family in families:
        known = [*SELECTABLE, *own_families()]
        if family not in known:
            raise ValueError(f"family '{family}' cannot be selected; known are {', '.join(known)}")


def nonzero(cells: DataFrame) -> DataFrame:
    """Cells that take part in family selection: neither null nor zero."""
    return cells.filter(F.col("value") != 0)


def profile(cells: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Per-feature moments of the non-null values, with the constant-feature flag."""
    x = F.col("value")
    log = F.when(x > 0, F.ln(x))
    return (
        cells.filter(x.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.min(x).alias("mn"),
            F.max(x).alias("mx"),
            F.avg(x).alias("mean"),
            F.stddev_pop(x).alias("sd"),
            F.kurtosis(x).alias("kurt"),
            F.avg(log).alias("mean_ln"),
            F.avg(x * log).alias("mean_xln"),
        )
        .withColumn("constant", F.col("mn") == F.col("mx"))
    )


def _lognorm_locations() -> list[Column]:
    width = F.col("mx") - F.col("mn")
    return [F.when(F.col("mn") > 0, F.lit(0.0)), *[F.col("mn") - F.lit(c) * width for c in LOGNORM_SHIFTS]]


def _lognorm_moments(cells: DataFrame, moments: DataFrame, keys: list[str]) -> DataFrame:
    """Second scan: mean and deviation of ln(x - loc) for each candidate location."""
    bounds = moments.filter(~F.col("constant")).select(*keys, "mn", "mx")
    x = F.col("value")
    named = attach(cells.filter(x.isNotNull()).select(*keys, "value"), bounds, keys, row_bytes=128)
    aggs = []
    for i, loc in enumerate(_lognorm_locations()):
        log = F.when(x > loc, F.ln(x - loc))
        aggs += [F.avg(log).alias(f"ln_mean{i}"), F.stddev_pop(log).alias(f"ln_sd{i}")]
    return named.groupBy(*keys).agg(*aggs)


def _truncnorm_solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moment equations of the truncated normal, iterated for a batch of features at once."""
    for batch in batches:
        mn, mx, mean, sd = (batch[c].to_numpy(dtype=np.float64) for c in ("mn", "mx", "mean", "sd"))
        width = mx - mn
        with np.errstate(all="ignore"):
            mu, sg = mean.copy(), sd.copy()
            for _ in range(TRUNCNORM_STEPS):
                old_mu, old_sg = mu, sg
                a, b = (mn - mu) / sg, (mx - mu) / sg
                z = np_norm_cdf(b) - np_norm_cdf(a)
                fa, fb = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi), np.exp(-0.5 * b * b) / math.sqrt(2 * math.pi)
                shift = (fa - fb) / z
                spread = 1.0 + (a * fa - b * fb) / z - shift * shift
                mu = np.clip(mean - sg * shift, mn, mx)
                sg = np.minimum(sd / np.sqrt(spread), FLAT * width)
                moved = np.abs(mu - old_mu) + np.abs(sg - old_sg)
                if not (moved > TOLERANCE * width).any():
                    break
            # as flat as a uniform distribution, or not settled: no fit
            sg = np.where((moved <= 1e3 * TOLERANCE * width) & (sg < FLAT * width), sg, np.nan)
            a, b = (mn - mu) / sg, (mx - mu) / sg
            z = np_norm_cdf(b) - np_norm_cdf(a)
        yield batch.assign(tn_loc=mu, tn_scale=sg, tn_a=a, tn_b=b, tn_lnz=np.log(z))


def _log_moments(cells: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Two scans: the median, then mean and variance of ln|x - median|; solved for the t."""
    values = cells.filter(F.col("value").isNotNull()).select(*keys, "value")
    counts = values.groupBy(*keys, "value").agg(F.count("*").alias("weight"))
    middle = stage(quantiles(counts, keys, "value", "weight", [0.5]).select(*keys, F.col("value").alias("t_loc")))
    named = attach(values, middle, keys, row_bytes=64)
    log = F.when(F.col("value") != F.col("t_loc"), F.ln(F.abs(F.col("value") - F.col("t_loc"))))
    logs = named.groupBy(*keys).agg(F.first("t_loc").alias("t_loc"), F.avg(log).alias("t_m"), F.var_pop(log).alias("t_v"))
    joined = stats.join(logs, keys, "left")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields]
    return joined.mapInPandas(_t_solve, ", ".join([*fields, "t_df double", "t_scale double"]))


def digamma(y: np.ndarray) -> np.ndarray:
    z = y + 8.0
    return np.log(z) - 0.5 / z - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - sum(1 / (y + k) for k in range(8))


def trigamma(y: np.ndarray) -> np.ndarray:
    z = y + 8.0
    return 1 / z + 0.5 / z**2 + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) + sum(1 / (y + k) ** 2 for k in range(8))


def tetragamma(y: np.ndarray) -> np.ndarray:
    z = y + 8.0
    return -1 / z**2 - 1 / z**3 - 0.5 / z**4 + 1 / (6 * z**6) - 1 / (6 * z**8) - sum(2 / (y + k) ** 3 for k in range(8))


def _t_solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """ln|T| has variance (trigamma(1/2) + trigamma(df/2)) / 4 for a standard t."""
    for batch in batches:
        mean, var = batch["t_m"].to_numpy(dtype=np.float64), batch["t_v"].to_numpy(dtype=np.float64)
        with np.errstate(all="ignore"):
            excess = 4.0 * var - math.pi**2 / 2.0
            wanted = np.maximum(excess, trigamma(np.array(T_MAX_DF / 2.0)))
            y = 0.5 + 1.0 / wanted
            for _ in range(T_STEPS):
                at = trigamma(y)
                y = y + at * (1.0 - at / wanted) / tetragamma(y)
            df = np.minimum(2.0 * y, T_MAX_DF)
            scale = np.exp(mean - 0.5 * (digamma(np.array(0.5)) - digamma(df / 2.0) + np.log(df)))
        yield batch.assign(t_df=df, t_scale=scale)


def _candidates(family: str) -> list[Column]:
    """Locations below the minimum, evenly spaced in the log of their distance in widths."""
    low, high = F.col(f"{family}_lo"), F.col(f"{family}_hi")
    width = F.col("mx") - F.col("mn")
    return [F.col("mn") - F.exp(low + (high - low) * F.lit(j / (POINTS - 1.0))) * width for j in range(POINTS)]


def _profile_gain(family: str, j: int) -> Column:
    """Mean log likelihood at candidate ``j`` with the other parameters at their estimates there."""
    m, v = F.col(f"{family}_m{j}"), F.col(f"{family}_v{j}")
    if family == "lognorm":
        return -(F.ln(v) + m + 0.5 + LOG_SQRT_2PI)
    a = F.col(f"gamma_a{j}")
    return (a - 1.0) * m - a - a * F.ln(v) - F.col(f"gamma_lg{j}")


def search_locations(cells: DataFrame, families: Sequence[str], keys: Sequence[str] = ("feature",)) -> DataFrame:
    """The best location of each family named (``LOCATED``) by profile likelihood; staged, one row per key.

    A bracket of distances below the minimum, from ``NEAREST`` to ``FARTHEST`` widths, is cut by
    ``POINTS`` candidates. One scan scores all candidates of all features and families; the bracket
    narrows to the neighbours of the best one, until neighbours differ by less than
    ``SETTLED`` in their distance. Columns: keys and a struct (loc, m, v) per family: mean of
    ln(x - loc), and its deviation (lognorm) or the scale (gamma).
    """
    keys = list(keys)
    values = cells.filter(F.col("value").isNotNull()).select(*keys, "value")
    brackets = profile(cells, keys).filter(~F.col("constant")).select(*keys, "mn", "mx", "mean")
    for f in families:
        brackets = brackets.withColumns({f"{f}_lo": F.lit(math.log(NEAREST)), f"{f}_hi": F.lit(math.log(FARTHEST))})
    brackets = stage(brackets)
    step = math.log(FARTHEST / NEAREST) / (POINTS - 1)
    while True:
        aggs = []
        for f in families:
            for j, loc in enumerate(_candidates(f)):
                y = F.col("value") - loc
                second = F.stddev_pop(F.ln(y)) if f == "lognorm" else F.covar_pop(F.col("value"), F.ln(y))
                aggs += [F.avg(F.ln(y)).alias(f"{f}_m{j}"), second.alias(f"{f}_v{j}")]
        named = attach(values, brackets, keys, row_bytes=64 + 16 * len(families))
        found = named.groupBy(*keys).agg(*aggs).join(brackets, keys)
        for f in families:
            found = found.withColumns({f"{f}_at{j}": loc for j, loc in enumerate(_candidates(f))})
            if f == "gamma":
                found = found.withColumns({f"gamma_a{j}": div(F.col("mean") - F.col(f"gamma_at{j}"), F.col(f"gamma_v{j}")) for j in range(POINTS)})
                found = found.withColumns({f"gamma_lg{j}": ln_gamma(f"gamma_a{j}") for j in range(POINTS)})
            entries = F.array(
                *[
                    F.struct(
                        _profile_gain(f, j).alias("gain"), F.lit(j).alias("j"), F.col(f"{f}_at{j}").alias("loc"), F.col(f"{f}_m{j}").alias("m"), F.col(f"{f}_v{j}").alias("v")
                    )
                    for j in range(POINTS)
                ]
            )
            found = found.withColumn(f"{f}_best", F.array_max(entries))
        if step < math.log(SETTLED):
            return stage(found.select(*keys, *[F.col(f"{f}_best").alias(f) for f in families]))
        narrowed = {}
        for f in families:
            low, width, j = F.col(f"{f}_lo"), F.col(f"{f}_hi") - F.col(f"{f}_lo"), F.col(f"{f}_best.j")
            narrowed[f"{f}_lo"] = low + width * F.greatest(j - 1, F.lit(0)) / F.lit(POINTS - 1.0)
            narrowed[f"{f}_hi"] = low + width * F.least(j + 1, F.lit(POINTS - 1)) / F.lit(POINTS - 1.0)
        kept = [*keys, "mn", "mx", "mean"]
        brackets = stage(found.select(*kept, *[c.alias(n) for n, c in narrowed.items()]))
        step = 2 * step / (POINTS - 1)


def fit(
    cells: DataFrame, families: Sequence[str], keys: Sequence[str] = ("feature",), locate: Sequence[str] = ()
) -> DataFrame:
    """Fit ``families`` to the non-null cells; staged, one row per key.

    Columns: keys, n, mn, mx, mean, sd, constant, and one struct per family with its
    parameters and ``c0``, the log normaliser. A struct is null where the family does
    not apply (a constant feature, or gamma on values <= 0). Families named in ``locate``
    have their location searched (``search_locations``), so gamma takes any values then.
    """
    keys = list(keys)
    for family in families:
        if family not in REGISTRY:
            raise ValueError(f"family '{family}' is not registered")
    stats = stage(profile(cells, keys))
    if "lognorm" in families:
        stats = stats.join(_lognorm_moments(cells, stats, keys), keys, "left")
    if "truncnorm" in families:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields]
        added = [f"{c} double" for c in ("tn_loc", "tn_scale", "tn_a", "tn_b", "tn_lnz")]
        stats = stats.mapInPandas(_truncnorm_solve, ", ".join([*fields, *added]))
    if "t" in families:
        stats = _log_moments(cells, stats, keys)
    searched = [f for f in families if f in locate]
    if set(locate) - set(LOCATED):
        raise ValueError(f"locations are searched for {', '.join(LOCATED)}")
    if searched:
        places = search_locations(cells, searched, keys)
        stats = stats.join(places.select(*keys, *[F.col(f).alias(f"{f}_place") for f in searched]), keys, "left")
        if "gamma" in searched:
            stats = stats.withColumn("gl_a", div(F.col("mean") - F.col("gamma_place.loc"), F.col("gamma_place.v")))
            stats = stats.withColumn("gl_lg", ln_gamma("gl_a"))
    for step in _derived(families):
        stats = stats.withColumns(step)
    varied = ~F.col("constant")
    out = stats.select(
        *[ref(k) for k in keys],
        *["n", "mn", "mx", "mean", "sd", "constant"],
        *[F.when(varied & ok, value).alias(name) for name, (ok, value) in (_structs(families) | _located(searched)).items()],
    )
    # without a second scan this is a projection of the staged moments
    return stage(out) if {"lognorm", "truncnorm", "t"} & set(families) or searched else out


def _located(families: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    """Structs of the families whose location was searched."""
    built: dict[str, tuple[Column, Column]] = {}
    if "lognorm" in families:
        place = F.col("lognorm_place")
        c0 = -F.ln(place["v"]) - LOG_SQRT_2PI
        built["lognorm"] = (place["v"] > 0, F.struct(place["v"].alias("s"), place["loc"].alias("loc"), F.exp(place["m"]).alias("scale"), c0.alias("c0")))
    if "gamma" in families:
        place, a = F.col("gamma_place"), F.col("gl_a")
        c0 = -a * F.ln(place["v"]) - F.col("gl_lg")
        built["gamma"] = (place["v"] > 0, F.struct(a.alias("a"), place["loc"].alias("loc"), place["v"].alias("scale"), c0.alias("c0")))
    return built


def _derived(families: Sequence[str]) -> list[dict[str, Column]]:
    """Shape parameters, then their log-gamma values, as columns of their own.

    Later expressions use each of them many times; as columns they are computed once.
    """
    mean, sd = F.col("mean"), F.col("sd")
    width = F.col("mx") - F.col("mn")
    steps: list[dict[str, Column]] = []
    if "gamma" in families:
        steps += [
            {"g_scale": F.col("mean_xln") - F.col("mean_ln") * mean},
            {"g_a": div(mean, F.col("g_scale"))},
            {"g_lg": ln_gamma("g_a")},
        ]
    if "beta" in families:
        steps += [
            {"b_loc": F.col("mn") - BETA_PAD * width, "b_scale": width * (1.0 + 2.0 * BETA_PAD)},
            {"b_m": div(mean - F.col("b_loc"), F.col("b_scale")), "b_v": div(sd * sd, F.col("b_scale") * F.col("b_scale"))},
            {"b_c": div(F.col("b_m") * (1.0 - F.col("b_m")), F.col("b_v")) - 1.0},
            {"b_a": F.col("b_m") * F.col("b_c"), "b_b": (1.0 - F.col("b_m")) * F.col("b_c")},
            {"b_lga": ln_gamma("b_a")},
            {"b_lgb": ln_gamma("b_b")},
            {"b_lgc": ln_gamma("b_c")},
        ]
    if "t" in families:
        steps += [
            {"t_half": F.col("t_df") / 2.0, "t_next": (F.col("t_df") + 1.0) / 2.0},
            {"t_lg0": ln_gamma("t_half")},
            {"t_lg1": ln_gamma("t_next")},
        ]
    return steps


def _structs(families: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    n, mn, mx, mean, sd = (F.col(c) for c in ("n", "mn", "mx", "mean", "sd"))
    width = mx - mn
    always = F.lit(True)

    def packed(c0: Column, **params: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in params.items()], c0.alias("c0"))

    built: dict[str, tuple[Column, Column]] = {}
    for family in families:
        if family == "norm":
            built[family] = (always, packed(-F.ln(sd) - LOG_SQRT_2PI, loc=mean, scale=sd))
        elif family == "uniform":
            built[family] = (always, packed(-F.ln(width), loc=mn, scale=width))
        elif family == "gamma":
            a, scale = F.col("g_a"), F.col("g_scale")
            built[family] = (mn > 0, packed(-a * F.ln(scale) - F.col("g_lg"), a=a, loc=F.lit(0.0), scale=scale))
        elif family == "beta":
            loc, scale = F.col("b_loc"), F.col("b_scale")
            c0 = F.col("b_lgc") - F.col("b_lga") - F.col("b_lgb") - F.ln(scale)
            built[family] = (F.col("b_c") > 0, packed(c0, a=F.col("b_a"), b=F.col("b_b"), loc=loc, scale=scale))
        elif family == "t":
            df, scale = F.col("t_df"), F.col("t_scale")
            c0 = F.col("t_lg1") - F.col("t_lg0") - 0.5 * F.ln(df * math.pi) - F.ln(scale)
            built[family] = (scale > 0, packed(c0, df=df, loc=F.col("t_loc"), scale=scale))
        elif family == "truncnorm":
            loc, scale = F.col("tn_loc"), F.col("tn_scale")
            c0 = -F.ln(scale) - LOG_SQRT_2PI - F.col("tn_lnz")
            built[family] = (scale.isNotNull() & ~F.isnan(scale), packed(c0, a=F.col("tn_a"), b=F.col("tn_b"), loc=loc, scale=scale))
        elif family == "lognorm":
            tried = []
            for i, loc in enumerate(_lognorm_locations()):
                s, m = F.col(f"ln_sd{i}"), F.col(f"ln_mean{i}")
                gain = -n * (F.ln(s) + m + 0.5 + LOG_SQRT_2PI)
                entry = F.struct(gain.alias("gain"), s.alias("s"), loc.alias("loc"), F.exp(m).alias("scale"))
                tried.append(F.when(loc.isNotNull() & (s > 0), entry))
            best = F.array_max(F.array_compact(F.array(*tried)))
            c0 = -F.ln(best["s"]) - LOG_SQRT_2PI
            built[family] = (always, packed(c0, s=best["s"], loc=best["loc"], scale=best["scale"]))
        elif REGISTRY[family].fit is not None:
            ok, own, c0 = REGISTRY[family].fit()
            built[family] = (ok, packed(c0, **own))
        elif family == "gaussian_kde":
            h = sd * F.sqrt(div(n, n - 1.0)) * F.pow(n.cast("double"), F.lit(-0.2))
            built[family] = (n > 1, packed(F.lit(0.0), bandwidth=h))
    return built


def params_long(fits: DataFrame, families: Sequence[str], keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Rows (keys, family, params MAP<STRING, DOUBLE>) of the families that apply."""
    entries = []
    for family in families:
        pairs = []
        for p in REGISTRY[family].params:
            pairs += [F.lit(p), F.col(family)[p]]
        entries.append(
            F.when(F.col(family).isNotNull(), F.struct(F.lit(family).alias("family"), F.create_map(*pairs).alias("params")))
        )
    return fits.select(*keys, F.inline(F.array_compact(F.array(*entries))))


def _scored(families: Sequence[str], score: Callable[[str], Column]) -> Column:
    return F.array(
        *[
            F.struct(score(f).alias("score"), F.lit(i).alias("position"), F.lit(f).alias("family"))
            for i, f in enumerate(families)
        ]
    )


def score_sse(
    cells: DataFrame, fits: DataFrame, families: Sequence[str], keys: Sequence[str] = ("feature",)
) -> DataFrame:
    """Sum over 100 equal bins of (density at the bin centre - histogram density) squared."""
    keys = list(keys)
    usable = fits.filter(~F.col("constant"))
    step = (F.col("mx") - F.col("mn")) / F.lit(float(BINS))
    values = cells.filter(F.col("value").isNotNull()).select(*keys, "value")
    bounded = attach(values, usable.select(*keys, "mn", "mx"), keys, row_bytes=128)
    place = F.floor(div(F.col("value") - F.col("mn"), F.col("mx") - F.col("mn")) * F.lit(float(BINS)))
    counts = (
        bounded.withColumn("bin", F.least(F.lit(BINS - 1), place).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("hits"))
    )
    grid = usable.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    rows = grid.join(counts, [*keys, "bin"], "left")
    if "gaussian_kde" in families:
        centres = usable.select(
            *keys,
            (F.col("mn") + 0.5 * step).alias("first"),
            (F.col("mx") - 0.5 * step).alias("last"),
            F.col("gaussian_kde.bandwidth").alias("bandwidth"),
        )
        weighted = values.groupBy(*keys, "value").agg(F.count("*").alias("weight"))
        kde = kernel_sums(weighted, stage(centres), keys, BINS, "pdf")
        rows = rows.join(kde.select(*keys, F.col("point").alias("bin"), "total"), [*keys, "bin"], "left")
    centre = F.col("mn") + (F.col("bin") + 0.5) * step
    observed = div(F.coalesce(F.col("hits"), F.lit(0)), F.col("n") * step)
    sums = []
    for f in families:
        if REGISTRY[f].logpdf is None:
            density = F.col("total") / F.col("n")
        else:
            density = F.exp(REGISTRY[f].logpdf(centre, lambda p, f=f: F.col(f)[p]))
        error = density - observed
        sums.append(F.sum(error * error).alias(f"score_{f}"))
    return _long_scores(rows.groupBy(*keys).agg(*sums), families, keys)


def score_information(
    cells: DataFrame,
    fits: DataFrame,
    families: Sequence[str],
    method: str,
    keys: Sequence[str] = ("feature",),
) -> DataFrame:
    """AIC (2k - 2 log L) or BIC (k ln n - 2 log L) from one scan, k free parameters.

    The KDE has no k and gets no score, so it is chosen only if it is listed first and
    nothing else has one.
    """
    keys = list(keys)
    counted = [f for f in families if REGISTRY[f].logpdf is not None]
    if not counted:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("position", "int"), ("family", "string"))]
        return fits.select(*keys, *none).filter(F.lit(False))
    usable = fits.filter(~F.col("constant")).select(*keys, *counted)
    values = cells.filter(F.col("value").isNotNull()).select(*keys, "value")
    named = attach(values, usable, keys, row_bytes=64 * (1 + len(counted)))
    sums = [
        F.sum(REGISTRY[f].logpdf(F.col("value"), lambda p, f=f: F.col(f)[p])).alias(f"ll_{f}") for f in counted
    ]
    likelihood = named.groupBy(*keys).agg(F.count("*").alias("__n"), *sums)
    scored = likelihood.select(
        *keys,
        *[
            (
                (F.lit(2.0 * REGISTRY[f].free) if method == "aic" else F.lit(float(REGISTRY[f].free)) * F.ln("__n"))
                - 2.0 * F.col(f"ll_{f}")
            ).alias(f"score_{f}")
            for f in counted
        ],
    )
    return _long_scores(scored, counted, keys)


def _long_scores(wide: DataFrame, families: Sequence[str], keys: list[str]) -> DataFrame:
    """Rows (keys, position, family, score); families without a finite score are left out."""
    entries = _scored(families, lambda f: F.col(f"score_{f}"))
    long = wide.select(*keys, F.inline(entries))
    return long.filter(F.col("score").isNotNull() & ~F.isnan("score"))


def score(
    cells: DataFrame,
    fits: DataFrame,
    families: Sequence[str],
    method: str = "sumsquare_error",
    keys: Sequence[str] = ("feature",),
) -> DataFrame:
    if method == "sumsquare_error":
        return score_sse(cells, fits, families, keys)
    return score_information(cells, fits, families, method, keys)


def choose(scores: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """The family with the lowest score per key; earlier in the list wins a tie."""
    best = F.min(F.struct("score", "position", "family"))
    return scores.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.family").alias("family"), F.col("best.score").alias("score")
    )


def select_family(
    cells: DataFrame,
    families: Sequence[str],
    method: str = "sumsquare_error",
    keys: Sequence[str] = ("feature",),
    locate: Sequence[str] = (),
) -> DataFrame:
    """Best family of each feature over its non-zero values; constant features take the first."""
    check_families(families, method)
    values = nonzero(cells)
    fits = fit(values, families, keys, locate)
    best = choose(score(values, fits, families, method, keys), keys)
    named = fits.select(*keys, "constant").join(best, list(keys), "left")
    return named.select(*keys, F.coalesce("family", F.lit(families[0])).alias("family"), "score")
