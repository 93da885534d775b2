"""Gaussian copula over long cells: scores, correlation, latent draws, inverse marginals.

The model is a table with one row per feature. Latent draws need no p x p factorisation:
a random linear combination of the n score rows, z* = (1/sqrt n) sum_i e_i z_i with
independent normal e_i, has exactly the sample covariance. Where rows far outnumber
features they can first be reduced to at most p rows with the same cross products, by
blocks of features.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.counter import name_key, with_uniform
from twinloom.functions.names import div, ref
from twinloom.functions.normal import (
    U_CLIP,
    norm_cdf,
    np_norm_cdf,
    np_norm_ppf,
    np_normal_products,
    with_norm_ppf,
)
from twinloom.operators import marginals as mg
from twinloom.operators.kernels import kernel_sums
from twinloom.operators.ordered import running_totals
from twinloom.staging import attach, stage, tasks

CATEGORY = "category"
SUBSTITUTE = "uniform"
_GRID_FAMILIES = ("beta", "gamma", "t", "gaussian_kde")
GRID_POINTS = 1024
FINE_POINTS = 8192
Z_MAX = float(np_norm_ppf(np.array([1.0 - U_CLIP]))[0])
# decimal digits that a double holds
MAX_DIGITS = 15
_WHOLE = float(2**53)

# A tile arrives as long rows, so its size is kept to a few million cells.
ROW_TILE = 4096
FEATURE_TILE = 256
TILE_CELLS = 2_000_000
SYNTH_TILE = 8192
# Cells that share one copy of their feature's table.
LOOKUP_CELLS = 1 << 16
NOISE_ROWS = 256
# Numbers of noise that a task holds.
NOISE_HELD = 1 << 18
# Numbers of partial sums that a task holds.
HELD_SUMS = 1 << 24
# Features of one block of the row reduction; a task holds three tiles of its square.
FACTOR_BLOCK = 512

LATENT_STREAM = 11
MASK_STREAM = 12


def grid_families() -> list[str]:
    """Families whose scores and draws are read off a table: without closed form, or a user's own."""
    return [*_GRID_FAMILIES, *mg.own_families()]


# ---- categories and constraints ------------------------------------------------------


@dataclass(frozen=True)
class Inequality:
    """``low`` < ``high`` (or <= when not strict)."""

    low: str
    high: str
    strict: bool = True

    def holds(self) -> Column:
        return ref(self.low) < ref(self.high) if self.strict else ref(self.low) <= ref(self.high)


def count_violations(df: DataFrame, rule: Inequality) -> DataFrame:
    """One row: rows checked and rows that break the rule (nulls are not checked)."""
    known = ref(rule.low).isNotNull() & ref(rule.high).isNotNull()
    return df.agg(F.count_if(known).alias("checked"), F.count_if(known & ~rule.holds()).alias("violations"))


def ordered_rules(rules: Sequence[Inequality]) -> list[tuple[str, list[Inequality]]]:
    """Each upper column with its rules, after all columns that bound it from below.

    Rules may share columns in any way but a circle.
    """
    above: dict[str, list[Inequality]] = {}
    for rule in rules:
        above.setdefault(rule.high, []).append(rule)
    out: list[tuple[str, list[Inequality]]] = []
    done: set[str] = set()
    while len(out) < len(above):
        ready = [c for c, own in above.items() if c not in done and not any(r.low in above and r.low not in done for r in own)]
        if not ready:
            left = ", ".join(sorted(c for c in above if c not in done))
            raise ValueError(f"rules go round in a circle through {left}")
        out += [(c, above[c]) for c in ready]
        done.update(ready)
    return out


def _lower(rules: Sequence[Inequality]) -> Column:
    bounds = [ref(r.low) for r in rules]
    return F.greatest(*bounds) if len(bounds) > 1 else bounds[0]


def open_constraints(df: DataFrame, rules: Sequence[Inequality]) -> DataFrame:
    """Replace every upper column by ln(high - greatest lower column + 1), which any draw from 0 on satisfies.

    All differences are taken between original values.
    """
    return df.withColumns({c: F.ln(ref(c) - _lower(own) + F.lit(1.0)) for c, own in ordered_rules(rules)})


def close_constraints(df: DataFrame, rules: Sequence[Inequality], digits: dict[str, int] | int = MAX_DIGITS) -> DataFrame:
    """Inverse of ``open_constraints``; rounding never undoes a rule.

    Columns are closed from the lowest up, so each lower column has its final value. An upper
    column is a number of its own decimals (``digits``): at least the lower one and, where the
    rule is strict, the next such number or the next larger double above it.
    """
    for column, own in ordered_rules(rules):
        scale = 10.0 ** (digits if isinstance(digits, int) else digits[column])
        high = _lower(own) + F.greatest(F.exp(ref(column)) - F.lit(1.0), F.lit(0.0))
        floors = [_least_above(ref(r.low), r.strict, scale) for r in own]
        df = df.withColumn(column, F.greatest(round_half_up(high, F.lit(scale)), *floors))
    return df


def _least_above(low: Column, strict: bool, scale: float) -> Column:
    """The least multiple of 1 / ``scale`` that ``low`` allows; a larger double where there is none."""
    step = F.greatest(F.lit(1.0 / scale), F.abs(low) * F.lit(2.0**-52))
    on_grid = low + (step if strict else F.lit(0.0))
    up = F.ceil(low * F.lit(scale)) / F.lit(scale)
    off_grid = F.when(up > low, up).otherwise(on_grid)
    fits = (F.abs(low) * F.lit(scale) >= F.lit(_WHOLE)) | (round_half_up(low, F.lit(scale)) == low)
    return F.when(fits, on_grid).otherwise(off_grid)


def open_constraint(df: DataFrame, rule: Inequality) -> DataFrame:
    """``open_constraints`` of one rule."""
    return open_constraints(df, [rule])


def close_constraint(df: DataFrame, rule: Inequality, digits: int = MAX_DIGITS) -> DataFrame:
    """``close_constraints`` of one rule."""
    return close_constraints(df, [rule], digits)


def round_half_up(value: Column, scale: Column) -> Column:
    """Round to multiples of 1 / ``scale``; a double too large to have such decimals stays."""
    return F.when(F.abs(value) * scale < _WHOLE, F.floor(value * scale + F.lit(0.5)) / scale).otherwise(value)


def _category_values(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("feature"), ref(c).cast("string").alias("level")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def category_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``levels_of`` the named columns of a wide table."""
    return levels_of(_category_values(df, columns))


def levels_of(values: DataFrame) -> DataFrame:
    """From long ``(feature, level)``: rows (feature, level, lo, hi): each level's share as an interval of [0, 1].

    Levels are laid out in the order of a hash of their name, which spreads any number of
    levels evenly over buckets. Staged, one row per level.
    """
    counts = (
        values.filter(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(F.count("*").alias("hits"))
        .withColumn("place", name_key(F.col("level")) / F.lit(float(2**52)))
    )
    run = running_totals(counts, ["feature"], "place", ["hits"])
    return stage(
        run.select(
            "feature",
            "level",
            ((F.col("run_hits") - F.col("hits")) / F.col("all_hits")).alias("lo"),
            (F.col("run_hits") / F.col("all_hits")).alias("hi"),
        )
    )


def encode_categories(df: DataFrame, columns: Sequence[str], levels: DataFrame) -> DataFrame:
    """Cells (id, feature, value): the midpoint of the level's interval."""
    return encode_levels(_category_values(df, columns, "id"), levels)


def encode_levels(values: DataFrame, levels: DataFrame) -> DataFrame:
    """The same for long values (id, feature, level)."""
    named = attach(values, levels, ["feature", "level"], row_bytes=128)
    return named.select("id", "feature", ((F.col("lo") + F.col("hi")) / 2.0).alias("value"))


def decode_categories(draws: DataFrame, levels: DataFrame) -> DataFrame:
    """Add ``level``: the level whose interval holds the uniform ``value``.

    Both sides are cut into cells of [0, 1], so the lookup is an equi-join and a check.
    """
    cells = max(256, levels.count())
    cell = lambda c: F.floor(c * F.lit(float(cells))).cast("bigint")
    last = F.greatest(cell(F.col("lo")), F.ceil(F.col("hi") * F.lit(float(cells))).cast("bigint") - 1)
    spans = stage(levels.withColumn("__cell", F.explode(F.sequence(cell(F.col("lo")), last))))
    inside = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0 - 2.0**-52))
    placed = draws.withColumn("__u", inside).withColumn("__cell", cell(F.col("__u")))
    joined = attach(placed, spans, ["feature", "__cell"], row_bytes=128)
    return joined.filter((F.col("lo") <= F.col("__u")) & (F.col("__u") < F.col("hi"))).select(
        *[ref(c) for c in draws.columns], "level"
    )


# ---- model ---------------------------------------------------------------------------


def decimals(value: Column) -> Column:
    """Decimal places of a double, up to ``MAX_DIGITS``."""
    out = F.lit(MAX_DIGITS)
    for d in reversed(range(MAX_DIGITS)):
        out = F.when(F.round(value, d) == value, F.lit(d)).otherwise(out)
    return out


def observed(cells: DataFrame) -> DataFrame:
    """Per feature: observed range, decimal places, share of missing cells and their mean."""
    return cells.groupBy("feature").agg(
        F.count("*").alias("cells"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.max(F.when(F.col("value").isNotNull(), decimals(F.col("value")))).alias("digits"),
        (F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing"),
        F.avg("value").alias("fill"),
    ).withColumn("name_id", name_key(F.col("feature")))


def impute_mean(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Replace null values by the feature's mean; ``stats`` is staged and holds ``fill``."""
    filled = attach(cells, stats.select("feature", "fill"), ["feature"], row_bytes=64)
    return filled.select("id", "feature", F.coalesce("value", "fill").alias("value"))


def fit_model(cells: DataFrame, families: DataFrame, locate: Sequence[str] = ()) -> DataFrame:
    """Fit the named family of every feature on mean-imputed cells; staged, one row per feature.

    ``families`` holds (feature, family); ``category`` features hold uniform scores already. A
    feature to which its family does not apply takes the uniform one. ``locate`` as in ``marginals.fit``.
    """
    families = stage(families.select("feature", "family"))
    names = sorted(r[0] for r in families.select("family").distinct().collect())
    fitted = sorted({n for n in names if n != CATEGORY} | {SUBSTITUTE})
    stats = stage(observed(cells))
    filled = impute_mean(cells, stats)
    fits = mg.fit(filled, fitted, locate=[f for f in locate if f in fitted])
    # a feature without any observed value has no fit: it behaves as a constant null
    rows = stats.join(families, "feature").join(fits.select("feature", "constant", *fitted), "feature", "left")
    lacking = reduce(operator.or_, [(F.col("family") == f) & F.col(f).isNull() for f in fitted]) & ~F.coalesce("constant", F.lit(True))
    rows = rows.withColumn("family", F.when(lacking, F.lit(SUBSTITUTE)).otherwise(F.col("family")))

    def param(name: str, default: dict[str, float] | None = None) -> Column:
        out = F.lit((default or {}).get(CATEGORY)).cast("double")
        for f in fitted:
            if name in mg.REGISTRY[f].params:
                out = F.when(F.col("family") == f, F.col(f)[name]).otherwise(out)
        return out

    own = F.lit(None).cast("map<string,double>")
    for f in fitted:
        if f in mg.own_families():
            pairs = [x for p in mg.REGISTRY[f].params for x in (F.lit(p), F.col(f)[p].cast("double"))]
            own = F.when(F.col("family") == f, F.create_map(*pairs)).otherwise(own)
    category = F.col("family") == CATEGORY
    model = rows.select(
        "feature",
        "family",
        F.col("cells").alias("n"),
        F.coalesce("constant", F.lit(True)).alias("constant"),
        F.when(category, F.lit(0.0)).otherwise(F.col("low")).alias("low"),
        F.when(category, F.lit(1.0)).otherwise(F.col("high")).alias("high"),
        F.when(category, F.lit(None)).otherwise(F.col("digits")).cast("int").alias("digits"),
        "missing",
        "fill",
        "name_id",
        param("loc", {CATEGORY: 0.0}).alias("loc"),
        param("scale", {CATEGORY: 1.0}).alias("scale"),
        *[param(p).alias(p) for p in ("s", "a", "b", "df", "bandwidth")],
        own.alias("own"),
    )
    truncated = F.col("family") == "truncnorm"
    model = model.withColumn("ca", F.when(truncated, norm_cdf("a"))).withColumn("cb", F.when(truncated, norm_cdf("b")))
    if not any(n in grid_families() for n in names):
        empty = F.lit(None).cast("array<double>")
        return stage(model.withColumn("z_at", empty).withColumn("x_at", empty))
    return stage(_with_grids(stage(model), filled, "gaussian_kde" in names))


def _with_grids(model: DataFrame, filled: DataFrame, smooth: bool) -> DataFrame:
    """Add z at even x (``z_at``) and x at even z (``x_at``) for families without a closed form."""
    joined = model.withColumn("kx", F.lit(None).cast("array<double>")).withColumn("kt", F.col("kx"))
    if smooth:
        kde = model.filter((F.col("family") == "gaussian_kde") & ~F.col("constant"))
        span = 6.0 * F.col("bandwidth")
        grids = stage(
            kde.select("feature", (F.col("low") - span).alias("first"), (F.col("high") + span).alias("last"), "bandwidth")
        )
        weighted = filled.groupBy("feature", "value").agg(F.count("*").alias("weight"))
        sums = kernel_sums(weighted, grids, ["feature"], GRID_POINTS, "cdf")
        tables = sums.groupBy("feature").agg(
            F.sort_array(F.collect_list(F.struct("x", "total"))).alias("__kde")
        ).select("feature", F.col("__kde.x").alias("kx"), F.col("__kde.total").alias("kt"))
        joined = model.join(tables, "feature", "left")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in model.schema.fields]
    columns = model.columns
    gridded = grid_families()
    tables = {name: f.table for name, f in mg.own_families().items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z_at, x_at = [], []
            for row in batch.itertuples(index=False):
                if row.family in gridded and not row.constant:
                    if row.family in tables:
                        x, u = tables[row.family](dict(row.own), row.low, row.high)
                    else:
                        x, u = _cdf_table(row)
                    z = np_norm_ppf(np.clip(u, U_CLIP, 1.0 - U_CLIP))
                    even_x = np.linspace(row.low, row.high, GRID_POINTS)
                    even_u = np_norm_cdf(np.linspace(-Z_MAX, Z_MAX, GRID_POINTS))
                    z_at.append(np.interp(even_x, x, z).tolist())
                    x_at.append(np.interp(even_u, u, x).tolist())
                else:
                    z_at.append(None)
                    x_at.append(None)
            yield batch[columns].assign(z_at=z_at, x_at=x_at)

    joined = joined.repartition(tasks(model.sparkSession))  # a table per feature is costly to build
    return joined.mapInPandas(run, ", ".join([*fields, "z_at array<double>", "x_at array<double>"]))


def _cdf_table(row) -> tuple[np.ndarray, np.ndarray]:
    """(x, cdf) of one feature on a fine grid, by the midpoint rule in a variable that
    removes the end-point singularities of the density."""
    if row.family == "gaussian_kde":
        return np.asarray(row.kx), np.maximum.accumulate(np.asarray(row.kt)) / row.n
    edges = np.linspace(0.0, 1.0, FINE_POINTS + 1)
    mid = (edges[1:] + edges[:-1]) / 2.0
    if row.family == "beta":
        angle = mid * (math.pi / 2.0)
        log = (2 * row.a - 1) * np.log(np.sin(angle)) + (2 * row.b - 1) * np.log(np.cos(angle))
        x = row.loc + row.scale * np.sin(edges * (math.pi / 2.0)) ** 2
    elif row.family == "gamma":
        top = row.a + 40.0 * math.sqrt(row.a) + 60.0
        power = min(row.a, 1.0)
        y = mid * top**power
        w = y ** (1.0 / power)
        log = (row.a - power) * np.log(w) - w
        x = row.loc + row.scale * (edges * top**power) ** (1.0 / power)
    else:
        # with many degrees of freedom all mass lies within sixty scales
        reach = math.pi / 2 if row.df < 30 else math.atan(60.0 / math.sqrt(row.df))
        angle = (2.0 * mid - 1.0) * reach
        log = (row.df - 1.0) * np.log(np.cos(angle))
        tangent = np.tan(np.clip((2.0 * edges - 1.0) * reach, -math.pi / 2 + 1e-9, math.pi / 2 - 1e-9))
        x = row.loc + row.scale * math.sqrt(row.df) * tangent
    mass = np.exp(log - log.max())
    return x, np.concatenate([[0.0], np.cumsum(mass)]) / mass.sum()


def _looked_up(rows: DataFrame, grids: DataFrame, key: str, x: str, table: str, copies: DataFrame | int) -> DataFrame:
    """(key, feature, x) -> (key, feature, y): ``x`` looked up in the feature's table of even points.

    ``grids`` holds feature, ``table`` (an array), and the ``first`` and ``last`` x. The rows
    of a feature are dealt over its copies, about ``LOOKUP_CELLS`` rows each; every copy's rows meet
    its table in one task, behind one another, so a table travels once per copy and not
    once per row. ``copies`` is one number, or a table (feature, copies).
    """
    if isinstance(copies, DataFrame):
        placed, spread = attach(rows, copies, ["feature"], row_bytes=64), attach(grids, copies, ["feature"], row_bytes=64)
    else:
        placed, spread = rows.withColumn("copies", F.lit(copies)), grids.withColumn("copies", F.lit(copies))
    kind = rows.schema[key].dataType.simpleString()
    # no null tables: on the way to Python each row would go through all nulls before it in its batch
    cells = placed.select(
        "feature", F.pmod(F.xxhash64(ref(key)), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("turn"),
        ref(key).alias("key"), ref(x).alias("x"), F.array().cast("array<double>").alias("table"),
        F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("last"),
    )
    heads = spread.select(
        "feature", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"), F.lit(0).alias("turn"),
        F.lit(None).cast(kind).alias("key"), F.lit(None).cast("double").alias("x"), ref(table).alias("table"), "first", "last",
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, first, last = None, None, 0.0, 0.0
        for batch in batches:
            names = batch.column("feature").to_numpy(zero_copy_only=False)
            turn = batch.column("turn").to_numpy()
            x = batch.column("x").to_numpy(zero_copy_only=False)
            y = np.full(batch.num_rows, np.nan)
            edges = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (turn[1:] != turn[:-1]), True]) if len(names) else []
            for low, high in zip(edges[:-1], edges[1:]):
                if not turn[low]:  # the table of the rows behind it; several copies of it may follow each other
                    now, points = names[low], batch.column("table")[int(low)].values.to_numpy()
                    first, last = batch.column("first")[int(low)].as_py(), batch.column("last")[int(low)].as_py()
                elif names[low] == now:
                    place = (x[low:high] - first) / (last - first) * (len(points) - 1.0)
                    left = np.clip(np.floor(np.nan_to_num(place)), 0, len(points) - 2).astype(np.int64)
                    y[low:high] = points[left] + (points[left + 1] - points[left]) * (place - left)
            wanted = turn == 1
            if wanted.any():
                keep = pa.array(wanted)
                yield pa.RecordBatch.from_pydict(
                    {key: batch.column("key").filter(keep), "feature": batch.column("feature").filter(keep), "y": y[wanted]}
                )

    order = ["feature", "copy", "turn"]
    met = cells.unionByName(heads).repartition(tasks(rows.sparkSession), "feature", "copy").sortWithinPartitions(*order)
    return met.mapInArrow(read, f"`{key}` {kind}, feature string, y double")


def _gridded(model: DataFrame) -> DataFrame | None:
    """The part of a staged model that is read off tables, if there is any."""
    part = model.filter(F.col("z_at").isNotNull())
    return None if part.isEmpty() else part


_SMALL = ("x_at", "z_at", "own")


def normal_scores(cells: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (id, feature, z) of mean-imputed cells, z clipped to the usable range.

    Families with a closed form are scored where the cells are; the others' cells meet the
    tables of their features (``_looked_up``). ``model`` is staged.
    """
    small = model.drop(*_SMALL)
    grids = _gridded(model)
    named = attach(cells, small, ["feature"], row_bytes=256)
    x = F.coalesce("value", "fill")
    family = F.col("family")
    usable = family.isin(*grid_families()) & ~F.col("constant")
    first = named.filter(~usable).select(
        "id",
        "feature",
        "family",
        "constant",
        "scale",
        "s",
        "ca",
        "cb",
        div(x - F.col("loc"), F.col("scale")).alias("y"),
        F.when(family == "lognorm", F.ln(x - F.col("loc"))).alias("log"),
    )
    y, ca, cb = F.col("y"), F.col("ca"), F.col("cb")
    inner = F.when(family == "truncnorm", div(norm_cdf("y") - ca, cb - ca)).when(
        family.isin("uniform", CATEGORY), y
    )
    second = first.withColumn("u", F.least(F.greatest(inner, F.lit(U_CLIP)), F.lit(1.0 - U_CLIP)))
    third = with_norm_ppf(second, "u", "zu")
    z = (
        F.when(F.col("constant"), F.lit(0.0))
        .when(family == "norm", y)
        .when(family == "lognorm", div(F.col("log") - F.ln("scale"), F.col("s")))
        .otherwise(F.col("zu"))
    )
    scored = third.select("id", "feature", z.alias("z"))
    if grids is not None:
        values = named.filter(usable).select("id", "feature", x.alias("x"))
        tables = grids.select("feature", "z_at", F.col("low").alias("first"), F.col("high").alias("last"))
        copies = grids.select("feature", F.ceil(F.col("n") / LOOKUP_CELLS).cast("bigint").alias("copies"))
        scored = scored.unionByName(_looked_up(values, tables, "id", "x", "z_at", copies).withColumnRenamed("y", "z"))
    return scored.select("id", "feature", F.least(F.greatest(F.col("z"), F.lit(-Z_MAX)), F.lit(Z_MAX)).alias("z"))


def standardise(scores: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Scores with mean 0 and deviation 1 per feature; a feature without spread becomes 0."""
    stats = stats or stage(
        scores.groupBy("feature").agg(F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_sd"))
    )
    named = attach(scores, stats, ["feature"], row_bytes=64)
    z = F.when(F.col("z_sd") > 1e-12, div(F.col("z") - F.col("z_mean"), F.col("z_sd"))).otherwise(0.0)
    return named.select("id", "feature", z.alias("z"))


# ---- matrix work on tiles ------------------------------------------------------------


def _tile(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, feature names and the dense matrix of a long tile (absent cells are 0)."""
    row, ids = pd.factorize(pdf["id"], sort=True)
    col, names = pd.factorize(pdf["feature"], sort=True)
    z = np.zeros((len(ids), len(names)))
    z[row, col] = pdf["z"].to_numpy()
    return ids.to_numpy(), names.to_numpy(), z


def _buckets(column: str, size: int, total: int) -> tuple[Column, int]:
    n = max(1, -(-total // size))
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int"), n


def _spread_tiles(tiles: DataFrame, *keys: str):
    """Group by tile; each tile is costly, so tiles are not merged into fewer tasks.

    With ``task`` as the first key, a tile goes to the task of that number.
    """
    n = tasks(tiles.sparkSession)
    spread = tiles.repartitionById(n, F.col("task")) if keys[0] == "task" else tiles.repartition(n, *keys)
    return spread.groupBy(*keys)


def _gram(pdf: pd.DataFrame) -> pd.DataFrame:
    _, names, z = _tile(pdf)
    products = z.T @ z
    side = pdf.drop_duplicates("feature").set_index("feature")["fb"].loc[names].to_numpy()
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    i, j = np.triu_indices(len(names))
    if lo != hi:  # inside products belong to the diagonal tiles
        keep = side[i] != side[j]
        i, j = i[keep], j[keep]
    return pd.DataFrame({"feature_a": names[i], "feature_b": names[j], "total": products[i, j]})


def correlation(scores: DataFrame, n_rows: int, n_features: int) -> DataFrame:
    """Rows (feature_a <= feature_b, correlation) of standardised scores.

    The cross product is split into row chunks and pairs of feature blocks; a task
    multiplies one dense tile and the products are summed over the row chunks.
    """
    rows, _ = _buckets("id", ROW_TILE, n_rows)
    block, nb = _buckets("feature", FEATURE_TILE, n_features)
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(nb - 1)),
        lambda o: F.struct(F.least(o, F.col("fb")).alias("lo"), F.greatest(o, F.col("fb")).alias("hi")),
    )
    tiles = scores.select("id", "feature", "z", rows.alias("rc"), block.alias("fb"))
    spread = tiles.select("id", "feature", "z", "rc", "fb", F.inline(pairs))
    products = _spread_tiles(spread, "rc", "lo", "hi").applyInPandas(
        _gram, "feature_a string, feature_b string, total double"
    )
    return products.groupBy("feature_a", "feature_b").agg(
        (F.sum("total") / F.lit(float(n_rows))).alias("correlation")
    )


def _block_names(scores: DataFrame, n_features: int, block: int) -> tuple[Column, list[list[str]]]:
    """The block of each feature and the sorted names in every block."""
    number, n = _buckets("feature", block, n_features)
    names: list[list[str]] = [[] for _ in range(n)]
    for r in scores.select("feature").distinct().select("feature", number.alias("block")).collect():  # the width of the table
        names[r["block"]].append(r["feature"])
    return number, [sorted(own) for own in names]


_TILE = "i int, j int, m binary"


def _cross_tiles(scores: DataFrame, n_rows: int, number: Column, names: list[list[str]]) -> DataFrame:
    """Tiles (i <= j, m) of the cross products of all features, as 64-bit floats."""
    rows, _ = _buckets("id", ROW_TILE, n_rows)
    others = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda o: F.struct(F.least(o, F.col("fb")).alias("i"), F.greatest(o, F.col("fb")).alias("j")),
    )
    tiles = scores.select("id", "feature", "z", rows.alias("rc"), number.alias("fb"))
    spread = tiles.select("id", "feature", "z", "rc", "fb", F.inline(others))

    def side(ids: pd.Series, pdf: pd.DataFrame, block: int) -> np.ndarray:
        own = pdf[pdf["fb"] == block]
        place = {name: k for k, name in enumerate(names[block])}
        z = np.zeros((len(ids), len(place)))
        z[ids.get_indexer(own["id"]), own["feature"].map(place)] = own["z"].to_numpy()
        return z

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        ids = pd.Index(pdf["id"].unique())
        left = side(ids, pdf, i)
        right = left if i == j else side(ids, pdf, j)
        return pd.DataFrame([(i, j, (left.T @ right).tobytes())], columns=["i", "j", "m"])

    parts = _spread_tiles(spread, "rc", "i", "j").applyInPandas(products, _TILE)
    return _added_tiles(parts)


def _added_tiles(parts: DataFrame) -> DataFrame:
    """Tiles of one place added up: at most a running sum per place in a task."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            for i, j, m in batch[["i", "j", "m"]].itertuples(index=False):
                m = np.frombuffer(m)
                if now == (i, j):
                    held = held + m
                    continue
                if now is not None:
                    yield pd.DataFrame([(*now, held.tobytes())], columns=["i", "j", "m"])
                now, held = (i, j), m
        if now is not None:
            yield pd.DataFrame([(*now, held.tobytes())], columns=["i", "j", "m"])

    spread = parts.repartition(tasks(parts.sparkSession), "i", "j").sortWithinPartitions("i", "j")
    return spread.mapInPandas(add, _TILE)


def _root(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """F with F'F = ``tile`` (positive semidefinite) in triangular form with positive pivots, and M
    with M'T = the rows that F has beside a tile T of the same rows.

    Columns that depend on those before them have no pivot and give no row.
    """
    left = (tile + tile.T) / 2.0
    least = np.diag(left).max(initial=0.0) * len(tile) * 1e-14
    rows, pivots = [], []
    for k in range(len(tile)):
        if left[k, k] > least:
            row = left[k] / math.sqrt(left[k, k])
            row[:k] = 0.0
            rows.append(row)
            pivots.append(k)
            left = left - np.outer(row, row)
    root = np.array(rows).reshape(len(rows), len(tile))
    inverse = np.zeros((len(tile), len(rows)))
    if rows:
        inverse[pivots] = np.linalg.inv(root[:, pivots])
    return root, inverse


def reduce_rows(scores: DataFrame, n_rows: int, n_features: int, block: int = FACTOR_BLOCK) -> DataFrame:
    """At most p rows (id, feature, z) with the same cross products as all ``scores``.

    The cross products are cut into tiles of ``block`` features and factored block by block: the
    triangular root of a diagonal tile gives the next rows, its inverse brings the tiles
    beside it to those rows, and their products are taken off the tiles that are left. A task
    holds three tiles and the driver one, so the width may exceed what one task could hold. Features that
    depend on others (or more features than rows) give fewer rows.
    """
    # dealt by id: files are read by their bytes, and how many rows these hold differs with the family of a feature
    scores = stage(scores.repartition(tasks(scores.sparkSession), "id"))
    number, names = _block_names(scores, n_features, block)
    left = stage(_cross_tiles(scores, n_rows, number, names))
    rows, base = [], 0
    for k in range(len(names)):
        if not names[k]:
            continue
        width = len(names[k])
        corner = left.filter((F.col("i") == k) & (F.col("j") == k)).first()  # one tile
        root, inverse = _root(np.frombuffer(corner["m"]).reshape(width, width))
        if not len(root):  # a block of zeros; rows above it, if there are any, hold its columns
            if not base:
                rows.append(scores.sparkSession.createDataFrame([(0, n, 0.0) for n in names[k]], "id bigint, feature string, z double"))
            continue
        panel = stage(_panel(left.filter(F.col("i") == k), inverse, width))
        rows.append(_panel_rows(panel, names, base, len(root)))
        base += len(root)
        if k + 1 < len(names):
            left = stage(_taken_off(left.filter(F.col("i") > k), panel.filter(F.col("j") > k), len(root)))
    if not rows:
        return scores.select(F.col("id").cast("bigint"), "feature", "z").limit(0)
    return reduce(DataFrame.unionByName, rows)


def _panel(tiles: DataFrame, inverse: np.ndarray, width: int) -> DataFrame:
    """The tiles of one block row times the transposed inverse of its root: rows of the factor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(inverse.T @ np.frombuffer(m).reshape(width, -1)).tobytes() for m in batch["m"]]
            yield batch.assign(m=done)

    return tiles.repartition(tasks(tiles.sparkSession), "j").mapInPandas(run, _TILE)


def _panel_rows(panel: DataFrame, names: list[list[str]], base: int, height: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for j, m in batch[["j", "m"]].itertuples(index=False):
                own = names[j]
                z = np.frombuffer(m).reshape(height, -1)
                ids = np.repeat(np.arange(base, base + height), len(own))
                yield pd.DataFrame({"id": ids, "feature": own * height, "z": z.reshape(-1)})

    return panel.mapInPandas(run, "id bigint, feature string, z double")


def _taken_off(tiles: DataFrame, panel: DataFrame, height: int) -> DataFrame:
    """Each tile less the product of the two panel tiles of its block row and column."""
    one = panel.select(F.col("j").alias("i"), F.col("m").alias("a"))
    two = panel.select("j", F.col("m").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for m, a, b in batch[["m", "a", "b"]].itertuples(index=False):
                a, b = np.frombuffer(a).reshape(height, -1), np.frombuffer(b).reshape(height, -1)
                done.append((np.frombuffer(m).reshape(a.shape[1], -1) - a.T @ b).tobytes())
            yield batch[["i", "j"]].assign(m=done)

    return tiles.join(one, "i").join(two, "j").select("i", "j", "m", "a", "b").mapInPandas(run, _TILE)


def _sum_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Element-wise sums of z per (feature, sc); a task hands on what it holds beyond ``HELD_SUMS`` numbers."""
    sums: dict[tuple, np.ndarray] = {}
    size = 0
    for batch in batches:
        for name, sc, z in batch[["feature", "sc", "z"]].itertuples(index=False):
            if (name, sc) in sums:
                sums[name, sc] += z
            else:
                sums[name, sc] = np.array(z)
                size += len(z)
        if size > HELD_SUMS:
            yield _array_rows(sums)
            sums, size = {}, 0
    if sums:
        yield _array_rows(sums)


def _added_up(parts: DataFrame) -> DataFrame:
    """One row per (feature, sc): partial sums meet sorted, and a task holds one running sum."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            for name, sc, z in batch[["feature", "sc", "z"]].itertuples(index=False):
                if now == (name, sc):
                    held += z
                    continue
                if now is not None:
                    yield _array_rows({now: held})
                now, held = (name, sc), np.array(z)
        if now is not None:
            yield _array_rows({now: held})

    met = parts.repartition(tasks(parts.sparkSession), "feature", "sc").sortWithinPartitions("feature", "sc")
    return met.mapInPandas(add, _MIXED)


def _array_rows(sums: dict[tuple, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame([(n, sc, z) for (n, sc), z in sums.items()], columns=["feature", "sc", "z"])


def _mix(pdf: pd.DataFrame, seed: int, start: int, stop: int, size: int, turn: int, turns: int, norm: int, batch: int) -> pd.DataFrame:
    """The synthetic rows ``start`` to ``stop`` of one tile of scores, of every ``turns``-th stretch of ``size`` rows."""
    ids, names, z = _tile(pdf)
    rows = []
    for sc in range(start // size, -(-stop // size)):
        if sc % turns != turn:
            continue
        low, high = max(start, sc * size), min(stop, (sc + 1) * size)
        out = np_normal_products(seed, np.arange(low, high), ids, z, held=min(NOISE_HELD, batch * len(ids)))
        out /= math.sqrt(norm)
        rows += [(name, sc, np.ascontiguousarray(v)) for name, v in zip(names, out.T)]
    return pd.DataFrame(rows, columns=["feature", "sc", "z"])


def _turns(spark, tiles: int, stretches: int) -> int:
    """Tasks that share the synthetic rows of one tile: several only where tiles are fewer than tasks.

    A tile of scores travels once for each of them, so copies don't grow with the rows.
    """
    return max(1, min(stretches, -(-2 * tasks(spark) // max(tiles, 1))))


_MIXED = "feature string, sc bigint, z array<double>"


def mix_parts(
    scores: DataFrame, spans: Sequence[tuple[int, int]], sizes: DataFrame, n_features: int, seed: int, batch: int = NOISE_ROWS
) -> DataFrame:
    """Rows (synth, feature, z) of several groups in one plan.

    ``scores`` has part, id, feature, z, and a feature belongs to one part; ``sizes`` (staged,
    one row per part) has part and n, the rows of the part, and may have ``held``, the score rows that stand for
    them. Part k gets the synthetic rows ``spans[k]``, and combines its own score rows only.
    """
    limits = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in spans])
    block, nb = _buckets("feature", FEATURE_TILE, n_features)
    if "held" not in sizes.columns:
        sizes = sizes.withColumn("held", F.col("n"))
    named = attach(scores, sizes.select("part", "n", "held"), ["part"], row_bytes=32).withColumn("__span", F.get(limits, F.col("part")))
    named = named.filter(F.col("__span.b") > F.col("__span.a"))
    rows = F.pmod(F.xxhash64("id"), F.ceil(F.col("held") / ROW_TILE)).cast("int")
    size = SYNTH_TILE
    tiles = nb * sum(-(-r["held"] // ROW_TILE) for r in sizes.select("held").collect())  # one row per group
    turns = _turns(scores.sparkSession, tiles, max(-(-(b - a) // size) for a, b in spans) + 1)
    spread = named.select(
        "part", "id", "feature", "z", "n", rows.alias("rc"), block.alias("fb"), "__span.a", "__span.b",
        F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"),
    )

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        start, stop, n, turn = (int(pdf[c].iloc[0]) for c in ("a", "b", "n", "turn"))
        return _mix(pdf, seed, start, stop, size, turn, turns, n, batch)

    parts = _spread_tiles(spread, "part", "rc", "fb", "turn").applyInPandas(kernel, _MIXED).mapInPandas(_sum_arrays, _MIXED)
    parts = _added_up(parts)
    begin = F.get(limits, part_of(F.col("feature")))["a"]
    return parts.select("feature", "sc", F.posexplode("z").alias("pos", "z")).select(
        (F.greatest(begin, F.col("sc") * size) + F.col("pos")).alias("synth"), "feature", "z"
    )


PART_MARK = "\x1f"


def part_name(part: Column, feature: Column) -> Column:
    """One name for a feature of one group."""
    return F.concat(part.cast("string"), F.lit(PART_MARK), feature)


def part_of(name: Column) -> Column:
    return F.substring_index(name, PART_MARK, 1).cast("int")


def plain_name(name: Column) -> Column:
    return F.substring(name, F.instr(name, PART_MARK) + 1, F.length(name))


def sample_parts(
    cells: DataFrame,
    model: DataFrame,
    spans: Sequence[tuple[int, int]],
    seed: int,
    mixing: str = "rows",
    batch: int = NOISE_ROWS,
) -> DataFrame:
    """``sample`` for several groups at once: features carry ``part_name`` names."""
    if mixing not in ("rows", "factor"):
        raise ValueError("mixing is 'rows' or 'factor'")
    n_features = model.count()
    scores = stage(standardise(stage(normal_scores(cells, model))).withColumn("part", part_of(F.col("feature"))))
    sizes = stage(model.groupBy(part_of(F.col("feature")).alias("part")).agg(F.max("n").alias("n"), (F.count("*") + 1).alias("held")))
    if mixing == "rows":
        sizes = sizes.select("part", "n")
    else:
        scores = _reduced_parts(scores, model, sizes, n_features)
    latent = mix_parts(scores, spans, sizes, n_features, seed + LATENT_STREAM, batch)
    return missing_mask(inverse_marginals(latent, model, max(b - a for a, b in spans)), seed)


def _reduced_parts(scores: DataFrame, model: DataFrame, sizes: DataFrame, n_features: int) -> DataFrame:
    """Scores of each part reduced to at most as many rows as it has features.

    No row has cells of two parts once ids are told apart by part, so cross products between parts are
    0 and a reduced row belongs to one part as well. Zeros go, but for one row that names every feature.
    """
    parts = sizes.count()
    apart = scores.select((F.col("id") * F.lit(parts) + F.col("part")).alias("id"), "feature", "z")
    n_rows = int(sizes.agg(F.sum("n")).first()[0])
    reduced = stage(reduce_rows(apart, n_rows, n_features))
    named = model.select(F.lit(-1).cast("bigint").alias("id"), "feature", F.lit(0.0).alias("z"))
    return reduced.filter(F.col("z") != 0.0).unionByName(named).withColumn("part", part_of(F.col("feature")))


def mix_rows(
    scores: DataFrame, n_synth: int, seed: int, n_rows: int, n_features: int, norm: int, batch: int = NOISE_ROWS
) -> DataFrame:
    """Rows (synth, feature, z): random combinations of the score rows.

    A task holds one tile of scores and makes the noise it needs from the counter, so the
    same noise meets every feature block without being shuffled.
    """
    rows, nr = _buckets("id", ROW_TILE, n_rows)
    block, nb = _buckets("feature", FEATURE_TILE, n_features)
    size = SYNTH_TILE
    turns = _turns(scores.sparkSession, nr * nb, -(-n_synth // size))
    tiles = scores.select(
        "id", "feature", "z", rows.alias("rc"), block.alias("fb"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    )
    # tiles are few and cost alike: dealt by a hash, some tasks would get twice as many as others
    number = F.col("rc") + F.lit(nr) * (F.col("fb") + F.lit(nb) * F.col("turn"))
    tiles = tiles.withColumn("task", F.pmod(number, F.lit(tasks(scores.sparkSession))).cast("int"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return _mix(pdf, seed, 0, n_synth, size, int(pdf["turn"].iloc[0]), turns, norm, batch)

    parts = _spread_tiles(tiles, "task", "rc", "fb", "turn").applyInPandas(kernel, _MIXED)
    if nr > 1:
        # arrays are added as arrays, in each task and then across tasks
        parts = _added_up(parts.mapInPandas(_sum_arrays, _MIXED))
    long = parts.select("feature", "sc", F.posexplode("z").alias("pos", "z")).select(
        (F.col("sc") * F.lit(size) + F.col("pos")).alias("synth"), "feature", "z"
    )
    return long


def latent_draws(
    scores: DataFrame,
    n_synth: int,
    seed: int,
    n_rows: int,
    n_features: int,
    mixing: str = "rows",
    batch: int = NOISE_ROWS,
    block: int = FACTOR_BLOCK,
) -> DataFrame:
    """Latent normal draws with the correlation of the standardised ``scores``.

    ``mixing``: "rows" combines all rows. "factor" combines rows reduced to as many as there
    are features first (``reduce_rows``), for many more rows than features. The two give
    different draws, so the choice is never made from the data.
    """
    if mixing not in ("rows", "factor"):
        raise ValueError("mixing is 'rows' or 'factor'")
    if mixing == "rows":
        return mix_rows(scores, n_synth, seed, n_rows, n_features, n_rows, batch)
    reduced = stage(reduce_rows(scores, n_rows, n_features, block))
    return mix_rows(reduced, n_synth, seed, min(n_rows, n_features), n_features, n_rows, batch)


# ---- back to data --------------------------------------------------------------------


def clip_round(value: Column, low: Column, high: Column, digits: Column) -> Column:
    """Limit to the observed range, then round half up to the observed decimals."""
    held = F.least(F.greatest(value, low), high)
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    return F.when(digits.isNull() | (digits >= MAX_DIGITS), held).otherwise(round_half_up(held, scale))


def inverse_marginals(latent: DataFrame, model: DataFrame, n_synth: int = LOOKUP_CELLS) -> DataFrame:
    """Latent (synth, feature, z) to values in data units, clipped and rounded.

    ``n_synth``: about how many rows a feature has; tables travel once for ``LOOKUP_CELLS`` of them.
    """
    small = model.drop(*_SMALL)
    grids = _gridded(model)
    named = attach(latent, small, ["feature"], row_bytes=256)
    family, z = F.col("family"), F.col("z")
    usable = family.isin(*grid_families()) & ~F.col("constant")
    ca, cb = F.col("ca"), F.col("cb")
    u = norm_cdf("z")
    first = named.filter(~usable).withColumn(
        "u",
        F.when(family == "truncnorm", ca + u * (cb - ca)).when(
            family.isin("uniform", CATEGORY), u
        ),
    ).withColumn("__u", F.when(family == "truncnorm", F.least(F.greatest("u", F.lit(1e-16)), F.lit(1.0 - 1e-16))))
    second = with_norm_ppf(first, "__u", "zt")
    x = (
        F.when(F.col("constant"), F.col("low"))
        .when(family == "norm", F.col("loc") + F.col("scale") * z)
        .when(family == "lognorm", F.col("loc") + F.col("scale") * F.exp(F.col("s") * z))
        .when(family == "truncnorm", F.col("loc") + F.col("scale") * F.col("zt"))
        .otherwise(F.col("loc") + F.col("scale") * F.col("u"))
    )
    kept = ["low", "high", "digits", "missing", "name_id"]
    drawn = second.select("synth", "feature", *kept, x.alias("__x"))
    if grids is not None:
        held = F.least(F.greatest(z, F.lit(-Z_MAX)), F.lit(Z_MAX))
        tables = grids.select("feature", "x_at", F.lit(-Z_MAX).alias("first"), F.lit(Z_MAX).alias("last"))
        values = named.filter(usable).select("synth", "feature", held.alias("z"))
        found = _looked_up(values, tables, "synth", "z", "x_at", max(1, -(-n_synth // LOOKUP_CELLS)))
        drawn = drawn.unionByName(
            attach(found, small.select("feature", *kept), ["feature"], row_bytes=128).select("synth", "feature", *kept, F.col("y").alias("__x"))
        )
    return drawn.select(
        "synth",
        "feature",
        clip_round(F.col("__x"), F.col("low"), F.col("high"), F.col("digits")).alias("value"),
        "missing",
        "name_id",
    )


def missing_mask(draws: DataFrame, seed: int) -> DataFrame:
    """Null out values independently at the feature's observed rate.

    ``draws`` carries ``missing`` (the rate) and ``name_id`` (the feature's counter key).
    """
    rolled = with_uniform(draws, "__m", seed + MASK_STREAM, "synth", "name_id")
    value = F.when(F.col("__m") >= F.col("missing"), F.col("value"))
    return rolled.select("synth", "feature", value.alias("value"))


def sample(
    cells: DataFrame,
    model: DataFrame,
    n_synth: int,
    seed: int,
    mixing: str = "rows",
    batch: int = NOISE_ROWS,
) -> DataFrame:
    """Synthetic cells (synth, feature, value) with nulls at the observed rate."""
    n_features, n_rows = model.agg(F.count("*"), F.max("n")).first()
    scores = stage(normal_scores(cells, model))
    latent = latent_draws(
        standardise(scores), n_synth, seed + LATENT_STREAM, n_rows, n_features, mixing, batch
    )
    return missing_mask(inverse_marginals(latent, model, n_synth), seed)
