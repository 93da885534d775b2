"""Bootstrap evaluation: best sub-sample of a synthetic cohort and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.kolmogorov import EXACT_LIMIT
from twinloom.operators import bootstrap as bs
from twinloom.operators import evaluate as ev
from twinloom.operators.prep import Cohort
from twinloom.sources.tables import write_table
from twinloom.staging import attach, stage

# Column names of the report.
REPORT_COLUMNS = ("Peptide_id", "kl_divergence", "ks_p-value")


@dataclass(frozen=True)
class Bootstrap:
    seed: int
    clinical: DataFrame
    features: DataFrame
    report: DataFrame
    scores: DataFrame


def bootstrap(
    synthetic: Cohort,
    original: DataFrame,
    sample_size: int,
    iterations: int = 500,
    zero_share: float = 0.6,
    root_seed: int = 42,
    method: str = "auto",
    nan_policy: str = "propagate",
    exact_limit: int = EXACT_LIMIT,
) -> Bootstrap:
    """Draw ``iterations`` sub-samples and keep the one closest to ``original``.

    ``original`` is the unfiltered long measurement table. Features that are zero too
    often there are not scored. KL is computed only for replicates that share the lowest
    KS share, since no other replicate can win. p-values are exact for samples up to
    ``exact_limit`` with ``method="auto"``.
    """
    ids = stage(synthetic.features.select("id").distinct())
    available = ids.count()
    if sample_size > available:
        raise ValueError(f"cannot draw {sample_size} of {available} synthetic rows")
    names = stage(ev.dense_features(original, zero_share).select("feature"))
    n_features = names.count()
    if n_features == 0:
        raise ValueError("no feature passes the zero-share filter")
    real = stage(attach(original, names, ["feature"], row_bytes=64))
    made = stage(attach(synthetic.features, names, ["feature"], row_bytes=64))
    drawn = bs.drawn_distances(ids, sample_size, iterations, root_seed, made, real)
    scores = stage(bs.replicate_scores(drawn.distances, n_features, root_seed, method, exact_limit))
    tied = stage(bs.tied_best(scores))
    winner = tied.first()["draw"]
    if tied.count() > 1:
        kl = stage(ev.kl_divergence(stage(drawn.cells(tied)), real, draws=["draw"], nan_policy=nan_policy))
        winner = bs.select_best(tied, kl, n_features)
    seed = int(scores.filter(F.col("draw") == winner).first()["seed"])
    chosen = stage(bs.sample_by_seed(ids, sample_size, seed))
    report = bs.statistics(made.join(chosen, "id", "left_semi"), real, method, nan_policy, exact_limit)
    return Bootstrap(
        seed,
        synthetic.clinical.join(chosen, "id", "left_semi"),
        synthetic.features.join(chosen, "id", "left_semi"),
        report.toDF(*REPORT_COLUMNS),
        scores,
    )


def write_bootstrap(result: Bootstrap, path: str, fmt: str = "csv") -> None:
    write_table(result.features, f"{path}/features_bootstrapped", fmt)
    write_table(result.clinical, f"{path}/clinical_bootstrapped", fmt)
    write_table(result.report, f"{path}/feature_statistics", fmt)
