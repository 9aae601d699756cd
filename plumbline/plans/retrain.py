"""Retraining: merge, train, evaluate, version, promote, record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.fingerprint import table_fingerprint
from plumbline.operators.ledger import (
    ARCHIVED,
    DEVELOPMENT,
    PRODUCTION,
    current_stages,
    last_id,
    refusals,
)
from plumbline.operators.promotion import PRIMARY_METRIC, should_promote
from plumbline.operators.quantiles import fit_baseline
from plumbline.operators.training import merge_training_data
from plumbline.plans.models import (
    TREE_ROUNDS,
    batch_scores,
    load_model,
    save_model,
    train_and_evaluate,
)
from plumbline.sources.baselines import baseline_frame, save_baseline
from plumbline.sources.shared import is_missing, written
from plumbline.sources.tables import append_rows
from plumbline.spec import FeatureSpec

# Columns of the ledgers.
_EXPERIMENT = (
    "id bigint, name string, created_at timestamp, params map<string,string>, "
    "metrics map<string,double>, scenario string, notes string, git_sha string"
)
_MODEL = (
    "id bigint, dataset string, version_num bigint, experiment_id bigint, artifact_path string, "
    "stage string, created_at timestamp, metrics map<string,double>, notes string"
)
_DATASET = (
    "id bigint, name string, kind string, source_path string, content_hash string, "
    "row_count bigint, columns array<string>, created_at timestamp, notes string"
)
_BASELINE = (
    "id bigint, name string, artifact_path string, content_hash string, "
    "dataset_version_id bigint, summary map<string,string>, created_at timestamp, notes string"
)
_STAGE = (
    "id bigint, dataset string, version_num bigint, stage string, created_at timestamp, notes string"
)
_PROVENANCE = (
    "id bigint, experiment_id bigint, model_version_num bigint, dataset_version_id bigint, "
    "baseline_snapshot_id bigint, git_sha string, extra map<string,string>, created_at timestamp"
)


# Columns that name a row, and the ledger rows that others must point to.
_UNIQUE = {
    "experiments": ("id",),
    "models": ("id", "version_num"),
    "stages": ("id",),
    "datasets": ("id", "content_hash"),
    "baselines": ("id", "content_hash"),
    "provenance": ("id",),
}
_PARENTS = {
    "models": {"experiment_id": ("experiments", "id")},
    "stages": {"version_num": ("models", "version_num")},
    "baselines": {"dataset_version_id": ("datasets", "id")},
    "provenance": {
        "experiment_id": ("experiments", "id"),
        "model_version_num": ("models", "version_num"),
        "dataset_version_id": ("datasets", "id"),
        "baseline_snapshot_id": ("baselines", "id"),
    },
}
# Refusals named in an error.
_NAMED = 5


class LedgerError(ValueError):
    """A row breaks a rule of its ledger."""


@dataclass(frozen=True)
class RetrainResult:
    version: int
    artifact_path: str
    metrics: dict[str, float]
    promoted: bool
    reason: str


class Ledgers:
    """The ledger tables of a project, one folder each."""

    SCHEMAS = {
        "experiments": _EXPERIMENT,
        "models": _MODEL,
        "stages": _STAGE,
        "datasets": _DATASET,
        "baselines": _BASELINE,
        "provenance": _PROVENANCE,
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMAS[name]).parquet(self.path(name))
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], self.SCHEMAS[name])

    def append(self, ledger: str, **values) -> None:
        """One row, if the ledger's rules allow it."""
        self.append_batch(ledger, self.spark.createDataFrame([values], self.SCHEMAS[ledger]))

    def append_batch(self, ledger: str, rows: DataFrame) -> None:
        """All rows of a batch, or a ``LedgerError`` and none of them: unique columns must
        be new, and references must point to rows of the other ledgers. Columns the batch
        lacks are NULL; ``created_at`` is the time of the append."""
        fields = self.spark.createDataFrame([], self.SCHEMAS[ledger]).schema
        rows = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in fields
            ]
        )
        parents = {
            reference: (self.read(table), key)
            for reference, (table, key) in _PARENTS.get(ledger, {}).items()
        }
        refused = refusals(rows, self.read(ledger), _UNIQUE[ledger], parents).take(_NAMED)
        if refused:
            said = "; ".join(f"{r['reference']} {r['key']}: {r['rule']}" for r in refused)
            raise LedgerError(f"{ledger}: {said}")
        append_rows(rows.withColumn("created_at", F.current_timestamp()), self.path(ledger))

    def move(self, dataset: str, version: int, stage: str, notes: str) -> None:
        """One event of a model's life."""
        number = last_id(self.read("stages")) + 1
        self.append(
            "stages", id=number, dataset=dataset, version_num=version, stage=stage, notes=notes
        )

    def models(self) -> DataFrame:
        """All models with the stage their last event says."""
        now = current_stages(self.read("stages"), "version_num", "created_at", "id")
        return self.read("models").drop("stage").join(
            now.select("version_num", "stage"), "version_num", "left"
        )


def champion_metric(models: DataFrame, dataset: str, metric: str) -> float | None:
    """Metric of the dataset's champion, its model in production."""
    row = (
        models.where((F.col("dataset") == dataset) & (F.col("stage") == PRODUCTION))
        .agg(F.max_by(F.struct("metrics"), "version_num").alias("best"))
        .first()
    )
    if row["best"] is None:
        return None
    return float((row["best"]["metrics"] or {}).get(metric, 0.0))


def production_model(models: DataFrame, dataset: str) -> dict:
    """Ledger row of the dataset's model in production."""
    row = _serving(models, dataset)
    if row is None:
        raise LookupError(f"Dataset {dataset!r} has no model in production")
    return row.asDict()


def _serving(models: DataFrame, dataset: str):
    return (
        models.where((F.col("dataset") == dataset) & (F.col("stage") == PRODUCTION))
        .agg(F.max_by(F.struct("id", "version_num", "artifact_path"), "version_num").alias("row"))
        .first()["row"]
    )


def score_with_production(
    rows: DataFrame,
    spec: FeatureSpec,
    root: str,
    dataset: str,
    class_names: tuple[str, str],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Score rows with the model in production; each row says which version that was."""
    entry = production_model(Ledgers(rows.sparkSession, root).models(), dataset)
    scored = batch_scores(rows, load_model(entry["artifact_path"]), spec, class_names, keep)
    return scored.withColumn("model_version", F.lit(entry["version_num"]).cast("bigint"))


def run_retrain(
    reference: DataFrame,
    current: DataFrame,
    spec: FeatureSpec,
    key: str,
    root: str,
    dataset: str,
    scenario: str = "retrain",
    needle: str | None = None,
    margin: float = 0.0,
    fraction: float = 0.2,
    seed: int = 42,
    rounds: int = TREE_ROUNDS,
    metric: str = PRIMARY_METRIC,
    git_sha: str | None = None,
    psi_bins: int = 10,
) -> RetrainResult:
    """The whole flow. Every dataset has its own champion; versions are shared.

    A promoted model goes to production and the one before it to the archive, as stage
    events. The reference's baseline is stored as a snapshot of the training data.
    """
    spark = reference.sparkSession
    ledgers = Ledgers(spark, root)
    # Training and fingerprint both read the deduplicated rows.
    merged = written(merge_training_data(reference, current, spec.target), "merged")
    trained = train_and_evaluate(merged, spec, key, needle, fraction, seed, rounds)

    models = ledgers.models()
    version = last_id(models, "version_num") + 1
    artifact = f"{root}/artifacts/model_v{version}"
    save_model(trained.model, artifact)
    champion = champion_metric(models, dataset, metric)
    promoted, reason = should_promote(trained.metrics.get(metric), champion, margin, metric)

    experiment_id = last_id(ledgers.read("experiments")) + 1
    ledgers.append(
        "experiments",
        id=experiment_id,
        name=f"retrain_v{version}_{scenario}",
        params={
            "test_size": str(fraction),
            "random_state": str(seed),
            "primary_metric": metric,
            "dataset": dataset,
        },
        metrics=trained.metrics,
        scenario=scenario,
        notes=reason,
        git_sha=git_sha,
    )
    ledgers.append(
        "models",
        id=last_id(models) + 1,
        dataset=dataset,
        version_num=version,
        experiment_id=experiment_id,
        artifact_path=artifact,
        stage=PRODUCTION if promoted else DEVELOPMENT,
        metrics=trained.metrics,
        notes=reason,
    )
    serving = _serving(models, dataset)
    if promoted and serving is not None:
        ledgers.move(dataset, serving["version_num"], ARCHIVED, f"replaced by version {version}")
    ledgers.move(dataset, version, PRODUCTION if promoted else DEVELOPMENT, reason)

    content = table_fingerprint(merged).first()
    datasets = ledgers.read("datasets")
    known = datasets.where(F.col("content_hash") == content["content_hash"]).agg(F.min("id")).first()[0]
    dataset_id = known if known is not None else last_id(datasets) + 1
    if known is None:
        ledgers.append(
            "datasets",
            id=dataset_id,
            name=f"merged_training_{scenario}_v{version}",
            kind="merged_labeled",
            content_hash=content["content_hash"],
            row_count=content["row_count"],
            columns=merged.columns,
            notes="deduplicated union of both samples",
        )
    snapshot_id = _snapshot(ledgers, reference, spec, psi_bins, dataset_id, scenario)
    ledgers.append(
        "provenance",
        id=last_id(ledgers.read("provenance")) + 1,
        experiment_id=experiment_id,
        model_version_num=version,
        dataset_version_id=dataset_id,
        baseline_snapshot_id=snapshot_id,
        git_sha=git_sha,
        extra={"scenario": scenario, "promoted": str(promoted).lower()},
    )
    return RetrainResult(version, artifact, trained.metrics, promoted, reason)


def _snapshot(
    ledgers: Ledgers, reference: DataFrame, spec: FeatureSpec, psi_bins: int, dataset_id: int, scenario: str
) -> int:
    """Id of the reference's baseline, stored and registered unless its content is known."""
    spark = reference.sparkSession
    baseline = fit_baseline(reference, spec.numeric, spec.categorical, psi_bins)
    content = table_fingerprint(
        baseline_frame(spark, baseline).select("feature", "kind", F.to_json("edges").alias("edges"))
    ).first()["content_hash"]
    known = ledgers.read("baselines")
    number = known.where(F.col("content_hash") == content).agg(F.min("id")).first()[0]
    if number is not None:
        return number
    number = last_id(known) + 1
    path = f"{ledgers.root}/baselines/snapshot_{number}"
    save_baseline(spark, baseline, path)
    ledgers.append(
        "baselines",
        id=number,
        name=f"baseline_{scenario}_{number}",
        artifact_path=path,
        content_hash=content,
        dataset_version_id=dataset_id,
        summary={
            "numeric_features": str(len(baseline.numeric)),
            "categorical_features": str(len(baseline.categorical)),
            "psi_bins": str(baseline.psi_bins),
        },
        notes="fitted on the reference sample",
    )
    return number
