"""Preparation: keys, filters, complete cases, sparsity split, cohort split.

A cohort is a wide ``clinical`` table and a long ``features`` table
``(id BIGINT, feature STRING, value DOUBLE)``. In features a value of 0 means
"not measured"; NULL or an absent cell means the record is incomplete.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.names import ref
from twinloom.operators.ordered import smallest_k
from twinloom.staging import attach, stage

# Numeric columns with more different values than this are numerical.
MAX_LEVELS = 10

COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "==": operator.eq,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}


@dataclass(frozen=True)
class Cohort:
    clinical: DataFrame
    features: DataFrame
    n_features: int | None = None  # known width of the measurement table, if any

    def then(self, step: Callable[["Cohort"], "Cohort"]) -> "Cohort":
        """Apply a user-supplied preparation step."""
        return step(self)


# ---- keys and layout ---------------------------------------------------------------


def normalise_key(df: DataFrame, key: str, scale: int | None = None, out: str = "id") -> DataFrame:
    """Cast the key to BIGINT as column ``out``; with ``scale``, divide and truncate first.

    Keys are numbers: draws and ranks are functions of them.
    """
    kind = df.schema[key].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"key column '{key}' is {kind.simpleString()}; a numeric key is needed")
    value = ref(key) if scale is None else ref(key) / F.lit(scale)
    rest = [ref(c) for c in df.columns if c != key]
    return df.select(value.cast("bigint").alias(out), *rest)


def duplicate_keys(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys held by more than one row, e.g. after a truncating rescale."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def melt_features(wide: DataFrame, key: str = "id", names: Sequence[str] | None = None) -> DataFrame:
    """Wide measurement table to long cells; every column becomes a DOUBLE value.

    One generator over an array, so the plan does not grow with the number of columns.
    """
    names = [c for c in wide.columns if c != key] if names is None else list(names)
    labels = F.array(*[F.lit(n) for n in names])
    values = F.array(*[ref(n).cast("double") for n in names])
    exploded = wide.select(ref(key).alias("id"), F.posexplode(values).alias("pos", "value"))
    return exploded.select("id", F.element_at(labels, F.col("pos") + 1).alias("feature"), "value")


def pivot_features(cells: DataFrame, names: Sequence[str], key: str = "id", parts: int | None = None) -> DataFrame:
    """Long cells to a wide table with exactly the columns ``names``, in that order.

    With ``parts`` the cells are first dealt by key into so many partitions and are not shuffled again, so
    that the cells which meet in a task are those of its own keys.
    """
    if parts is not None:
        cells = cells.repartition(parts, ref(key))
    return cells.groupBy(key).pivot("feature", list(names)).agg(F.max("value"))


def zero_to_null(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))


def null_to_zero(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))


def drop_columns(df: DataFrame, names: Sequence[str] = (), positions: Sequence[int] = ()) -> DataFrame:
    """Drop columns by name and by position in the original order."""
    gone = set(names) | {df.columns[i] for i in positions}
    return df.select(*[ref(c) for c in df.columns if c not in gone])


# ---- filters -----------------------------------------------------------------------


def condition(df: DataFrame, spec: Mapping[str, Any]) -> Column:
    """Conjunction of ``{column: value}`` or ``{column: (operator, value)}`` entries."""
    parts = []
    for name, rule in spec.items():
        if name not in df.columns:
            raise ValueError(f"no column named '{name}' to filter by")
        if not isinstance(rule, (tuple, list)):
            parts.append(ref(name) == rule)
            continue
        if len(rule) != 2:
            raise ValueError(f"a rule for '{name}' is a value or a pair (operator, value), not {rule!r}")
        symbol, value = rule
        if symbol not in COMPARISONS:
            raise ValueError(f"'{symbol}' cannot compare '{name}'; known are {sorted(COMPARISONS)}")
        parts.append(COMPARISONS[symbol](ref(name), value))
    return reduce(operator.and_, parts, F.lit(True))


def filter_rows(df: DataFrame, spec: Mapping[str, Any], require_rows: bool = False) -> DataFrame:
    out = df.filter(condition(df, spec))
    if require_rows and out.isEmpty():
        raise ValueError(f"no row meets {dict(spec)!r}")
    return out


def complete_feature_ids(features: DataFrame, n_features: int | None = None) -> DataFrame:
    """Ids with a non-null value in every feature. An absent cell counts as null."""
    if n_features is None:
        n_features = features.select("feature").distinct().count()
    per_id = features.groupBy("id").agg(
        F.count("value").alias("present"), F.count("*").alias("cells")
    )
    return per_id.filter(
        (F.col("present") >= n_features) & (F.col("present") == F.col("cells"))
    ).select("id")


def complete_cases(cohort: Cohort) -> Cohort:
    """Keep patients that are complete in both tables."""
    clinical_ids = cohort.clinical.dropna("any").select("id")
    ids = clinical_ids.intersect(complete_feature_ids(cohort.features, cohort.n_features))
    return Cohort(
        cohort.clinical.join(ids, "id", "left_semi"),
        cohort.features.join(ids, "id", "left_semi"),
        cohort.n_features,
    )


def first_patients(cohort: Cohort, n: int | None) -> Cohort:
    """The ``n`` smallest distinct keys of each table, taken independently; a key keeps all its rows."""
    if n is None:
        return cohort
    feature_ids = smallest_k(cohort.features.select("id"), "id", n)
    clinical_ids = smallest_k(cohort.clinical.select("id"), "id", n)
    return Cohort(
        cohort.clinical.join(clinical_ids, "id", "left_semi"),
        cohort.features.join(feature_ids, "id", "left_semi"),
        cohort.n_features,
    )


# ---- sparsity ----------------------------------------------------------------------


def missing_fraction(cells: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Share of null cells per feature; zeros count as null."""
    absent = F.count_if(F.coalesce(F.col("value"), F.lit(0.0)) == 0)
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n"),
        absent.alias("n_missing"),
        (absent / F.count("*")).alias("missing_fraction"),
    )


def sparsity_split(cells: DataFrame, threshold: float, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """One row per feature with ``modelled``: missing share <= threshold (inclusive)."""
    return missing_fraction(cells, keys).withColumn(
        "modelled", F.col("missing_fraction") <= F.lit(threshold)
    )


def modelled_cells(cells: DataFrame, split: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Cells of modelled features with zeros as null. ``split`` should be staged."""
    chosen = split.filter("modelled").select(*keys)
    return zero_to_null(attach(cells, chosen, list(keys), row_bytes=64))


def low_count_stats(
    cells: DataFrame, threshold: float, n_synth: int | Column, keys: Sequence[str] = ("feature",)
) -> DataFrame:
    """Features above the threshold: mean over all cells and the exact number of zeros to draw.

    The zero count truncates ``(1 - nonzero/n) * n_synth`` in double arithmetic.
    """
    nonzero = F.count_if(F.col("value") != 0)
    n_synth = n_synth if isinstance(n_synth, Column) else F.lit(n_synth)
    stats = cells.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.count("*").alias("n"),
        nonzero.alias("n_nonzero"),
        (F.count_if(F.coalesce(F.col("value"), F.lit(0.0)) == 0) / F.count("*")).alias("__missing"),
    )
    zeros = F.floor((F.lit(1.0) - F.col("n_nonzero") / F.col("n")) * n_synth).cast("bigint")
    return (
        stats.filter(F.col("__missing") > F.lit(threshold))
        .withColumn("n_zero", zeros)
        .withColumn("n_fill", n_synth.cast("bigint") - F.col("n_zero"))
        .drop("__missing")
    )


# ---- cohort assembly ---------------------------------------------------------------


def manifest_files(manifest: DataFrame, groups: Sequence[str], group_col: str, file_col: str) -> DataFrame:
    """Distinct file names of the given manifest groups."""
    return manifest.filter(ref(group_col).isin(list(groups))).select(ref(file_col).alias("file")).distinct()


def split_clinical(
    master: DataFrame, cohorts: Mapping[str, tuple[Mapping[str, Any], Sequence[str]]]
) -> dict[str, DataFrame]:
    """Named cohorts of a clinical master table: (filter spec, columns to drop) each."""
    return {
        name: drop_columns(filter_rows(master, spec), names) for name, (spec, names) in cohorts.items()
    }


def split_features(
    features: DataFrame, ids: DataFrame, key: str = "id", scale: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(cells whose key is in ``ids`` * scale, all other cells)."""
    scaled = ids.select((ref(key) * F.lit(scale)).alias(key)).distinct()
    return features.join(scaled, key, "left_semi"), features.join(scaled, key, "left_anti")


def join_cohort(clinical: DataFrame, features: DataFrame) -> DataFrame:
    """Inner join of clinical rows with their feature cells."""
    return clinical.join(features, "id", "inner")


def few_distinct(df: DataFrame, columns: Sequence[str], by: Sequence[str], names: Sequence[str], limit: int = MAX_LEVELS) -> DataFrame:
    """One row per group with the number of distinct values of each column, or ``limit`` + 1 where it is more.

    Each task keeps at most ``limit`` + 1 values of a column and group, so the sets that meet
    in the end are small however many values there are.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in by]
    held = df.select(*[ref(c).alias(f"__by{k}") for k, c in enumerate(by)], *[ref(c).alias(f"__c{k}") for k, c in enumerate(columns)])
    groups = [f"__by{k}" for k in range(len(by))]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, set] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for k in range(len(columns)):
                wanted = table.select([*groups, f"__c{k}"])
                for row in wanted.group_by([*groups, f"__c{k}"]).aggregate([]).to_pylist():
                    value = row.pop(f"__c{k}")
                    own = seen.setdefault((k, *row.values()), set())
                    if value is not None and len(own) <= limit:
                        own.add(repr(value + 0))  # -0.0 is 0.0
        rows = [{**dict(zip(groups, key[1:])), "k": key[0], "value": v} for key, own in seen.items() for v in (own or {None})]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*[batch.schema.field(g) for g in groups], ("k", pa.int32()), ("value", pa.string())]))

    shape = ", ".join([*[f"`{g}` {kind}" for g, kind in zip(groups, kinds)], "k int", "value string"])
    kept = held.mapInArrow(keep, shape)
    counts = [
        F.least(F.count_distinct(F.when(F.col("k") == k, F.col("value"))), F.lit(limit + 1)).alias(name)
        for k, name in enumerate(names)
    ]
    out = kept.groupBy(*groups).agg(*counts)
    return out.select(*[ref(g).alias(c) for g, c in zip(groups, by)], *names)


def infer_roles(
    df: DataFrame,
    key: str,
    overrides: Mapping[str, str] | None = None,
    max_levels: float = 0.1,
    by: Sequence[str] = (),
) -> DataFrame:
    """Statistical role of each clinical column: id, numerical, categorical or unknown.

    ``by`` names columns that split the rows into groups with roles of their own.

    Numeric columns with few distinct values (at most ``max_levels`` of the rows and of
    the non-null count) are categorical, text is categorical, booleans are boolean.
    """
    overrides = dict(overrides or {})
    names = [c for c in df.columns if c not in by]
    groups = list(by) or ["__all"]
    df = df if by else df.withColumn("__all", F.lit(0))
    counts = df.groupBy(*groups).agg(F.count("*").alias("__n"))
    judged = [
        i for i, c in enumerate(names)
        if c not in overrides and c != key and isinstance(df.schema[c].dataType, T.NumericType)
    ]
    if judged:
        distinct = few_distinct(df, [names[i] for i in judged], groups, [f"d{i}" for i in judged])
        counts = counts.join(distinct, groups)
    rows = []
    for i, c in enumerate(names):
        kind = df.schema[c].dataType
        if c in overrides:
            role = F.lit(overrides[c])
        elif c == key:
            role = F.lit("id")
        elif isinstance(kind, T.BooleanType):
            role = F.lit("boolean")
        elif isinstance(kind, T.NumericType):
            few = F.col(f"d{i}") <= F.greatest(F.lit(2.0), F.least(F.lit(float(MAX_LEVELS)), F.round(F.col("__n") * max_levels)))
            role = F.when(few, F.lit("categorical")).otherwise(F.lit("numerical"))
        elif isinstance(kind, T.StringType):
            role = F.lit("categorical")
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            role = F.lit("datetime")
        else:
            role = F.lit("unknown")
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), role.alias("role")))
    return counts.select(*by, F.inline(F.array(*rows)))


def stage_split(cells: DataFrame, threshold: float) -> DataFrame:
    return stage(sparsity_split(cells, threshold))
