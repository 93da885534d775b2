"""Synthetic cohorts: prepare, fit, sample and assemble all groups in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.operators import assemble, copula, marginals, prep
from twinloom.operators.prep import Cohort
from twinloom.sources.tables import write_table
from twinloom.staging import stage, tasks

# Cells that meet in one task of the wide table.
CELLS = 1 << 20


@dataclass(frozen=True)
class Group:
    """A patient group: a conjunction of conditions and its number of synthetic rows."""

    condition: Mapping[str, Any]
    n_synth: int


@dataclass(frozen=True)
class Settings:
    missing_threshold: float = 0.7
    families: Sequence[str] = ("lognorm", "norm")
    method: str = "sumsquare_error"
    max_patients: int | None = None
    estimate_clinical: Sequence[str] = ()
    constraints: Sequence[copula.Inequality] = ()
    roles: Mapping[str, str] = field(default_factory=dict)
    other_family: str = "beta"
    feature_scope: str = "all"
    seed: int = 42
    batch_size: int = copula.NOISE_ROWS
    mixing: str = "rows"
    locate: Sequence[str] = ()  # families whose location is searched


def synthesize(
    cohort: Cohort,
    groups: Sequence[Group],
    settings: Settings = Settings(),
    prepare: Callable[[Cohort], Cohort] = prep.complete_cases,
    sampler: Callable[..., DataFrame] = copula.sample_parts,
    offset: int | None = None,
) -> Cohort:
    """Synthetic (clinical wide, features long) for all groups under one surrogate key.

    The row limit comes before the group filter, and with ``feature_scope="all"`` the
    sparsity split, the families and the fill values use all prepared patients; "group"
    restricts them to the group.

    Rows are tagged with the number of each group they belong to, and a feature of a group
    goes by the name ``part_name(group, feature)``; so one set of jobs models all groups,
    however many there are. ``sampler(cells, model, spans, seed, mixing=, batch=)`` draws
    the synthetic rows ``spans[k]`` of group k.
    """
    marginals.check_families(settings.families, settings.method)
    if settings.feature_scope not in ("all", "group"):
        raise ValueError("feature_scope must be 'all' or 'group'")
    spark = cohort.clinical.sparkSession
    whole = prep.first_patients(cohort.then(prepare), settings.max_patients)
    # every later step scans the prepared tables, so they are written once
    whole = Cohort(stage(whole.clinical), stage(whole.features))
    # rows of either table without a partner in the other take no part
    whole = Cohort(
        stage(whole.clinical.join(whole.features.select("id").distinct(), "id", "left_semi")),
        stage(whole.features.join(whole.clinical.select("id").distinct(), "id", "left_semi")),
    )
    rows = _tagged(whole.clinical, groups)
    stops = list(accumulate(g.n_synth for g in groups))
    spans = [(stop - g.n_synth, stop) for g, stop in zip(groups, stops)]
    size = _of_part([g.n_synth for g in groups])

    columns = [c for c in whole.clinical.columns if c != "id"]
    types = {c: whole.clinical.schema[c].dataType.simpleString() for c in columns}
    roles = prep.infer_roles(rows, "id", settings.roles, by=["part"]).filter(F.col("column").isin(columns)).collect()
    categorical = [(r["part"], r["column"]) for r in roles if r["role"] in ("categorical", "boolean")]
    numeric = [(r["part"], r["column"]) for r in roles if r["role"] not in ("categorical", "boolean")]
    digits = _checked_constraints(rows, settings.constraints, categorical)
    opened = copula.open_constraints(rows, settings.constraints)

    measured = stage(whole.features.join(rows.select("id", "part"), "id"))
    split, chosen, low = _feature_plan(whole.features, measured, settings, size, len(groups))
    cells = prep.modelled_cells(measured, split, ["part", "feature"]).select("id", _name(), "value")
    families = chosen.select(_name(), "family")
    if numeric:
        numbers = _melt(opened, columns, numeric).select("id", "feature", F.col("text").cast("double").alias("value"))
        cells = cells.unionByName(numbers)
        families = families.unionByName(_clinical_families(rows, numeric, settings))
    levels = None
    if categorical:
        values = _melt(rows, columns, categorical).withColumnRenamed("text", "level")
        levels = copula.levels_of(values)
        cells = cells.unionByName(copula.encode_levels(values, levels))
        families = families.unionByName(_literal_families(spark, [(k, c, copula.CATEGORY) for k, c in categorical]))
    cells = stage(cells)
    model = copula.fit_model(cells, families, settings.locate)
    drawn = stage(sampler(cells, model, spans, settings.seed, mixing=settings.mixing, batch=settings.batch_size))

    plain = copula.plain_name(F.col("feature"))
    clinical, texts = drawn.filter(plain.isin(columns)), None
    if categorical:
        names = [_label(k, c) for k, c in categorical]
        texts = copula.decode_categories(drawn.filter(F.col("feature").isin(names)), levels).withColumn("feature", plain)
        clinical = clinical.filter(~F.col("feature").isin(names))
    only_text = [c for c in columns if not any(n == c for _, n in numeric)]
    wide = assemble.clinical_table(clinical.withColumn("feature", plain), texts, columns, types, only_text)
    wide = copula.close_constraints(wide, settings.constraints, digits)
    wide = wide.select("synth", *[ref(c).cast(types[c]).alias(c) for c in columns])

    fill = assemble.low_count_fill(low.select(_name(), "mean", "n_zero"), F.element_at(F.array(*[F.lit(g.n_synth) for g in groups]), copula.part_of(F.col("feature")) + 1), settings.seed)
    begin = F.element_at(F.array(*[F.lit(a).cast("bigint") for a, _ in spans]), copula.part_of(F.col("feature")) + 1)
    features = drawn.filter(~plain.isin(columns)).unionByName(fill.withColumn("synth", F.col("synth") + begin))
    features = prep.null_to_zero(features.withColumn("feature", plain))
    start = assemble.key_offset(spark, settings.seed) if offset is None else offset
    key = (F.lit(start + 1) + F.col("synth")).alias("id")
    return Cohort(wide.select(key, *[ref(c) for c in columns]), features.select(key, "feature", "value"))


def _tagged(clinical: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """Staged rows with the number of each group they are in as ``part``; no group may be empty."""
    inside = [F.when(prep.condition(clinical, g.condition), F.lit(k)) for k, g in enumerate(groups)]
    rows = stage(clinical.withColumn("part", F.explode(F.array_compact(F.array(*inside)))))
    found = {r["part"] for r in rows.select("part").distinct().collect()}
    for k, group in enumerate(groups):
        if k not in found:
            raise ValueError(f"no row meets {dict(group.condition)!r}")
    return rows


def _of_part(values: Sequence[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("part") + 1)


def _name() -> Column:
    return copula.part_name(F.col("part"), F.col("feature")).alias("feature")


def _label(part: int, column: str) -> str:
    return f"{part}{copula.PART_MARK}{column}"


def _melt(rows: DataFrame, columns: Sequence[str], wanted: Sequence[tuple[int, str]]) -> DataFrame:
    """(id, feature, text) of the named columns of each part."""
    pairs = [F.struct(F.lit(c).alias("feature"), ref(c).cast("string").alias("text")) for c in columns]
    long = rows.select("id", "part", F.inline(F.array(*pairs))).select("id", _name(), "text")
    return long.filter(F.col("feature").isin([_label(k, c) for k, c in wanted]))


def _feature_plan(
    features: DataFrame, measured: DataFrame, settings: Settings, size: Column, parts: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per (part, feature), staged: is it modelled; its family; fill statistics of the others."""
    keys = ["part", "feature"]
    threshold = settings.missing_threshold
    if settings.feature_scope == "group":
        split = stage(prep.sparsity_split(measured, threshold, keys))
        chosen = marginals.select_family(prep.modelled_cells(measured, split, keys), settings.families, settings.method, keys, settings.locate)
        low = prep.low_count_stats(measured, threshold, size, keys)
        return split, stage(chosen.select(*keys, "family")), stage(low)
    every = F.explode(F.array(*[F.lit(k) for k in range(parts)])).alias("part")
    split = prep.stage_split(features, threshold)
    chosen = marginals.select_family(prep.modelled_cells(features, split), settings.families, settings.method, locate=settings.locate)
    # the zero number of a group follows from shared counts and its own size
    low = prep.low_count_stats(features, threshold, 0).select("feature", "mean", "n", "n_nonzero", every)
    zeros = F.floor((F.lit(1.0) - F.col("n_nonzero") / F.col("n")) * size).cast("bigint")
    return (
        stage(split.select("feature", "modelled", every)),
        stage(chosen.select("feature", "family", every)),
        stage(low.withColumn("n_zero", zeros)),
    )


def _checked_constraints(
    rows: DataFrame, rules: Sequence[copula.Inequality], categorical: Sequence[tuple[int, str]]
) -> dict[str, int]:
    """Decimal places of each constrained column; an error where the data break a rule."""
    if not rules:
        return {}
    for rule in rules:
        for name in (rule.low, rule.high):
            if name not in rows.columns or any(c == name for _, c in categorical):
                raise ValueError("constraints apply to numerical clinical columns")
    row = rows.agg(
        *[F.max(copula.decimals(ref(r.high))).alias(f"digits{i}") for i, r in enumerate(rules)],
        *[F.count_if(~r.holds()).alias(f"bad{i}") for i, r in enumerate(rules)],
    ).first()
    for i, rule in enumerate(rules):
        if row[f"bad{i}"]:
            raise ValueError(f"{row[f'bad{i}']} rows break {rule.low} < {rule.high}")
    return {rule.high: row[f"digits{i}"] for i, rule in enumerate(rules)}


def _literal_families(spark, entries: Sequence[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame([(_label(k, c), f) for k, c, f in entries], "feature string, family string")


def _clinical_families(rows: DataFrame, numeric: Sequence[tuple[int, str]], settings: Settings) -> DataFrame:
    """Families of the numeric clinical columns: estimated where named, else the default."""
    estimated = [(k, c) for k, c in numeric if c in settings.estimate_clinical]
    rest = [(k, c, settings.other_family) for k, c in numeric if (k, c) not in estimated]
    out = _literal_families(rows.sparkSession, rest)
    if estimated:
        named = _melt(rows, sorted({c for _, c in estimated}), estimated)
        values = named.select("id", "feature", F.col("text").cast("double").alias("value"))
        chosen = marginals.select_family(values, settings.families, settings.method, locate=settings.locate)
        out = out.unionByName(chosen.select("feature", "family"))
    return out


def write_synthetic(result: Cohort, path: str, feature_names: Sequence[str] | None = None, fmt: str = "csv") -> None:
    """Write both tables; with ``feature_names`` the features go out wide in that order."""
    features = result.features
    if feature_names is not None:
        # as in the cohort's own tables: a task holds a group for each id and feature
        parts = max(tasks(features.sparkSession), -(-features.count() // CELLS))
        features = prep.pivot_features(features, feature_names, parts=parts)
    write_table(result.clinical, f"{path}/clinical", fmt)
    write_table(features, f"{path}/features", fmt)
