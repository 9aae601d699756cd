"""Ledgers as append-only tables, and the state read from them.

Batches are registered whole: many datasets, runs and models at once. Ids continue
the ledger's numbering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.frames import one_row
from plumbline.operators.sequence import latest_per_key, number_rows, previous_row

# Stages of a model and the moves allowed between them.
DEVELOPMENT = "development"
STAGING = "staging"
PRODUCTION = "production"
ARCHIVED = "archived"
TRANSITIONS = {
    DEVELOPMENT: (STAGING, PRODUCTION),
    STAGING: (PRODUCTION, ARCHIVED),
    PRODUCTION: (ARCHIVED,),
    ARCHIVED: (),
}


def last_id(ledger: DataFrame | None, column: str = "id") -> int:
    """Largest id of a ledger, 0 if it is empty."""
    if ledger is None:
        return 0
    return int(ledger.agg(F.coalesce(F.max(column), F.lit(0))).first()[0])


def assign_ids(
    batch: DataFrame, order: str, tie: str, ledger: DataFrame | None = None, name: str = "id", **ranges
) -> DataFrame:
    """Ids (or version numbers) max + 1, max + 2, ... in batch order."""
    start = last_id(ledger, name)
    return number_rows(batch, order, tie, name, **ranges).withColumn(
        name, F.col(name) + F.lit(start)
    )


def register_new(
    batch: DataFrame,
    content_hash: str,
    order: str,
    tie: str,
    ledger: DataFrame | None = None,
    **ranges,
) -> DataFrame:
    """Rows of a batch whose content the ledger does not hold yet, with fresh ids.

    The first row of each hash wins; a hash the ledger knows keeps its id there. The
    first is taken by aggregation, so a hash with many copies is combined before the
    shuffle. A row without hash has no content to register and is left out.
    """
    rest = [c for c in batch.columns if c != content_hash]
    first = F.min_by(F.struct(*[col(c) for c in rest]), F.struct(col(order), col(tie)))
    fresh = (
        batch.where(col(content_hash).isNotNull())
        .groupBy(col(content_hash).alias(content_hash))
        .agg(first.alias("_row"))
        .select(col(content_hash), *[F.col("_row").getField(c).alias(c) for c in rest])
    )
    if ledger is not None:
        fresh = fresh.join(ledger.select(col(content_hash)), content_hash, "left_anti")
    return assign_ids(fresh, order, tie, ledger, derived=True, **ranges)


def resolve_ids(batch: DataFrame, content_hash: str, ledger: DataFrame) -> DataFrame:
    """The ledger id of every row of a batch, by content."""
    return batch.join(ledger.select(col(content_hash), "id"), content_hash, "left")


def experiment_rows(
    runs: DataFrame,
    order: str,
    tie: str,
    name: Column,
    params: dict[str, Column],
    metrics: dict[str, Column],
    scenario: Column,
    notes: Column,
    git_sha: Column | None = None,
    ledger: DataFrame | None = None,
    **ranges,
) -> DataFrame:
    """Experiment rows of a batch of training runs; parameters and metrics as maps."""

    def as_map(entries: dict[str, Column], kind: str) -> Column:
        pairs = [x for k, v in entries.items() for x in (F.lit(k), v.cast(kind))]
        return F.create_map(*pairs)

    numbered = assign_ids(runs, order, tie, ledger, derived=True, **ranges)
    return numbered.select(
        "id",
        name.alias("name"),
        as_map(params, "string").alias("params"),
        as_map(metrics, "double").alias("metrics"),
        scenario.alias("scenario"),
        notes.alias("notes"),
        (git_sha if git_sha is not None else F.lit(None).cast("string")).alias("git_sha"),
        col(tie).alias("run_key"),
    )


def model_rows(
    experiments: DataFrame,
    promoted: DataFrame,
    key: str,
    artifact: Column,
    ledger: DataFrame | None = None,
    **ranges,
) -> DataFrame:
    """Model rows linked to experiments: promoted runs start in production, the rest
    in development. ``promoted`` holds ``key`` and a boolean ``promoted``. Ids and version
    numbers both go on from the largest of the ledger."""
    start, first = last_id(ledger, "version_num"), last_id(ledger)
    joined = experiments.join(
        promoted.select(col(key).alias("run_key"), "promoted"), "run_key", "left"
    )
    numbered = number_rows(joined, "id", "run_key", "_no", derived=True, **ranges)
    return numbered.select(
        (F.col("_no") + F.lit(first)).alias("id"),
        (F.col("_no") + F.lit(start)).alias("version_num"),
        F.col("id").alias("experiment_id"),
        artifact.alias("artifact_path"),
        F.when(F.col("promoted"), PRODUCTION).otherwise(DEVELOPMENT).alias("stage"),
        "metrics",
        "notes",
    )


def duplicate_versions(models: DataFrame, version: str = "version_num") -> DataFrame:
    """Version numbers used more than once."""
    return (
        models.groupBy(col(version).alias(version))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def lineage(provenance: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Provenance rows with each parent's columns. ``parents`` maps a reference column
    to (table, its key); what has no match stays with NULLs."""
    out = provenance
    for reference, (table, key) in parents.items():
        out = out.join(table, out[reference] == table[key], "left")
    return out


def orphans(provenance: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """References that point nowhere: ``reference, missing_key, n``. A NULL reference
    is allowed."""
    found = None
    for reference, (table, key) in parents.items():
        wanted = provenance.where(col(reference).isNotNull()).groupBy(
            col(reference).cast("string").alias("missing_key")
        ).agg(F.count("*").alias("n"))
        known = table.select(col(key).cast("string").alias("missing_key"))
        part = wanted.join(known, "missing_key", "left_anti").select(
            F.lit(reference).alias("reference"), "missing_key", "n"
        )
        found = part if found is None else found.unionByName(part)
    return found


def refusals(
    batch: DataFrame,
    ledger: DataFrame | None = None,
    unique: tuple[str, ...] = (),
    parents: dict[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """Why rows of a batch may not be appended to a ledger: ``rule, reference, key, n``.

    ``repeated``: a value of a unique column that the batch holds n times; ``taken``: one
    that the ledger has already; ``no_parent``: a reference that points nowhere. NULLs
    break no rule. No rows mean that the batch is fine.
    """
    parts = []
    for name in unique:
        seen = batch.where(col(name).isNotNull()).groupBy(col(name).alias("_key")).agg(
            F.count("*").alias("n")
        )
        rules = [("repeated", seen.where(F.col("n") > 1))]
        if ledger is not None:
            taken = ledger.select(col(name).alias("_key"))
            rules.append(("taken", seen.join(taken, "_key", "left_semi")))
        parts += [
            found.select(
                F.lit(rule).alias("rule"), F.lit(name).alias("reference"),
                F.col("_key").cast("string").alias("key"), "n",
            )
            for rule, found in rules
        ]
    if parents:
        parts.append(
            orphans(batch, parents).select(
                F.lit("no_parent").alias("rule"), "reference", F.col("missing_key").alias("key"), "n"
            )
        )
    if not parts:
        raise ValueError("nothing to check: no unique columns and no parents")
    return reduce(DataFrame.unionByName, parts)


def stage_moves(
    events: DataFrame, model: str, order: str, tie: str, stage: str = "stage",
    initial: str | None = DEVELOPMENT, **ranges,
) -> DataFrame:
    """Every stage event with the stage before it: adds ``from_stage``, ``is_legal``
    and ``allowed``.

    A model starts in ``initial``. With None its first event is a registration, legal
    in any stage.
    """
    moves = previous_row(events, [model], order, tie, col(stage), "from_stage", **ranges)
    start = F.coalesce("from_stage", F.lit(initial).cast("string"))
    return moves.withColumn("from_stage", start).withColumns(_judged("from_stage", stage))


def _judged(before: str, after: str) -> dict[str, Column]:
    """Is the move allowed, and which are? Without a stage before, any stage is."""
    allowed = F.array().cast("array<string>")
    for stage, following in TRANSITIONS.items():
        names = F.array(*[F.lit(a) for a in following]).cast("array<string>")
        allowed = F.when(col(before) == stage, names).otherwise(allowed)
    return {
        "is_legal": col(before).isNull() | F.array_contains(allowed, col(after)),
        "allowed": F.when(F.size(allowed) > 0, F.array_join(allowed, ", ")).otherwise("none"),
    }


def validated_moves(
    requests: DataFrame, current: DataFrame, model: str, order: str, tie: str, stage: str = "stage"
) -> DataFrame:
    """Requested moves against the current stages, one per model: adds ``from_stage``,
    ``is_legal`` and ``allowed``.

    ``current`` has ``model`` and ``stage``; a model it lacks is in development. Of several
    requests for a model the first counts. Legal rows can be appended as events, the others
    say what would have been allowed.
    """
    rest = [c for c in requests.columns if c != model]
    first = F.min_by(F.struct(*[col(c) for c in rest]), F.struct(col(order), col(tie)))
    asked = (
        requests.groupBy(col(model).alias(model))
        .agg(first.alias("_row"))
        .select(col(model), *[F.col("_row").getField(c).alias(c) for c in rest])
    )
    known = current.select(col(model).alias(model), col(stage).alias("from_stage"))
    return (
        asked.join(known, model, "left")
        .withColumn("from_stage", F.coalesce("from_stage", F.lit(DEVELOPMENT)))
        .withColumns(_judged("from_stage", stage))
    )


def stage_violations(moves: DataFrame) -> DataFrame:
    return moves.where(~F.col("is_legal"))


def production_history(
    events: DataFrame, dataset: str | None, model: str, order: str, tie: str, stage: str = "stage", **ranges
) -> DataFrame:
    """Spans in production: ``model, since, until, is_current`` plus the dataset.

    A production event archives the model of the event before it; setting the same
    model again changes nothing. The current pointer is the open span.
    """
    key = [dataset] if dataset else []
    hits = events.where(col(stage) == PRODUCTION).select(
        *[col(k) for k in key], col(model).alias("model"), col(order).alias("since"), col(tie).alias("_tie")
    )
    changed = previous_row(hits, key, "since", "_tie", F.col("model"), "_before", **ranges).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("model"))
    )
    spans = previous_row(
        changed.drop("_before"), key, "since", "_tie", F.col("since"), "until",
        following=True, derived=True, **ranges,
    )
    return spans.withColumn("is_current", F.col("until").isNull()).drop("_tie")


def current_stages(
    events: DataFrame, model: str, order: str, tie: str, stage: str = "stage"
) -> DataFrame:
    """Stage of each model after its last event."""
    return latest_per_key(events.select(col(model), col(order), col(tie), col(stage)), [model], order, tie)


def models_in_stage(models: DataFrame, stage: str | None = None) -> DataFrame:
    """Models, newest version first."""
    kept = models if stage is None else models.where(F.col("stage") == stage)
    return kept.orderBy(F.desc("version_num"))


def model_by_id(models: DataFrame, model_id: int) -> DataFrame:
    return models.where(F.col("id") == model_id)


def newest(ledger: DataFrame, limit: int, *order: str) -> DataFrame:
    """The newest rows of a ledger; a bounded heap per task, no full sort."""
    return ledger.orderBy(*[F.desc(o) for o in (order or ("id",))]).limit(limit)


def run_stats(runs: DataFrame, triggered: Column) -> DataFrame:
    """Run counters and trigger rate."""
    counts = runs.agg(
        F.count("*").alias("total_runs"), F.count_if(triggered).alias("triggered_runs")
    )
    rate = F.col("triggered_runs") / F.nullif(F.col("total_runs"), F.lit(0))
    return counts.withColumns(
        {
            "ok_runs": F.col("total_runs") - F.col("triggered_runs"),
            "trigger_rate": F.round(F.coalesce(rate, F.lit(0.0)), 4),
        }
    )


def overview(
    runs: DataFrame,
    models: DataFrame,
    experiments: DataFrame,
    datasets: DataFrame,
    baselines: DataFrame,
    production: DataFrame,
) -> DataFrame:
    """One row over all ledgers: sizes, newest entries and the production version.

    ``runs`` need id and policy_triggered, ``models`` id and version_num, the other
    ledgers id; ``production`` holds at most one row with the model ``id``.
    """

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    pointer = production.select(F.col("id").alias("_pid")).limit(1)
    served = models.join(F.broadcast(pointer), F.col("id") == F.col("_pid")).agg(
        F.max("id").alias("production_model_id"),
        F.max("version_num").alias("production_model_version"),
    )
    parts = [
        runs.agg(
            F.count("*").alias("n_runs"),
            F.max("id").alias("last_run_id"),
            F.max_by("policy_triggered", "id").alias("last_run_policy_triggered"),
        ),
        models.agg(
            F.count("*").alias("n_models"), F.max("version_num").alias("latest_model_version")
        ),
        experiments.agg(
            F.count("*").alias("n_experiments"), F.max("id").alias("latest_experiment_id")
        ),
        size(datasets, "n_datasets"),
        size(baselines, "n_baselines"),
        served,
    ]
    return one_row(*parts)
