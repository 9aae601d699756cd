"""Feature pipelines, training, evaluation and scoring with Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    Bucketizer,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, hash_order, positive_label, to_category, to_numeric
from plumbline.operators.categories import (
    add_positions,
    category_index,
    sparse_vector,
    vocabulary_sizes,
)
from plumbline.operators.frames import spread_evenly
from plumbline.operators.metrics import evaluation, macro_metrics
from plumbline.operators.quantiles import quantile_edges
from plumbline.operators.split import stratified_holdout
from plumbline.operators.training import balanced_weights
from plumbline.sources.shared import counted, new_folder, short_lived, written
from plumbline.spec import FeatureSpec

# Settings of the boosted trees and names of the two classes.
TREE_DEPTH = 6
TREE_STEP = 0.08
TREE_ROUNDS = 200
TREE_BINS = 255
TREE_MIN_ROWS = 20
# Rows up to which Spark takes the candidates of its splits from all of them.
TREE_SAMPLE = TREE_BINS**2
# Bins whose square is still an int of Spark's.
MOST_TREE_BINS = 46_340
# Early stopping: share of the rows held back, and the least relative gain of a round.
STOP_FRACTION = 0.1
STOP_TOLERANCE = 1e-4
CLASS_NAMES = {"census": ("<=50K", ">50K"), "card_fraud": ("legit", "fraud")}

LABEL = "label"
FEATURES = "features"
# Marks rows held back for early stopping; number of rows that share a cell.
HELD = "_validation"
CELL_ROWS = "rows"


def model_frame(
    df: DataFrame, spec: FeatureSpec, needle: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Columns a model reads under names without dots, plus the label where there is one."""
    missing = [c for c in spec.features if c not in df.columns]
    if missing:
        raise ValueError(f"Feature columns not found: {', '.join(missing)}")
    columns = [to_numeric(col(c)).alias(f"n{i}") for i, c in enumerate(spec.numeric)]
    columns += [to_category(col(c)).alias(f"k{i}") for i, c in enumerate(spec.categorical)]
    if spec.target and spec.target in df.columns:
        columns.append(positive_label(col(spec.target), needle).cast("double").alias(LABEL))
    return df.select(*[col(k) for k in keep], *columns)


def feature_stages(spec: FeatureSpec) -> list:
    """Numbers pass through, categories become one-hot; a category not seen in
    training (or NULL) is all zeros, and no seen category is dropped."""
    numeric = [f"n{i}" for i in range(len(spec.numeric))]
    raw = [f"k{i}" for i in range(len(spec.categorical))]
    index = [f"{c}_i" for c in raw]
    hot = [f"{c}_h" for c in raw]
    stages = []
    if raw:
        # "keep" gives unknowns the last index, which dropLast maps to zeros.
        stages.append(StringIndexer(inputCols=raw, outputCols=index, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
    stages.append(
        VectorAssembler(inputCols=numeric + hot, outputCol=FEATURES, handleInvalid="keep")
    )
    return stages


def boosted_trees(
    spec: FeatureSpec,
    rounds: int = TREE_ROUNDS,
    depth: int = TREE_DEPTH,
    seed: int = 42,
    validation: str | None = None,
) -> Pipeline:
    """Features and boosted trees; with a boolean ``validation`` column the rounds end where
    the rows it marks gain no more."""
    stopping = {"validationIndicatorCol": validation, "validationTol": STOP_TOLERANCE}
    trees = GBTClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        maxIter=rounds,
        maxDepth=depth,
        stepSize=TREE_STEP,
        maxBins=TREE_BINS,
        minInstancesPerNode=TREE_MIN_ROWS,
        seed=seed,
        **(stopping if validation else {}),
    )
    return Pipeline(stages=[*feature_stages(spec), trees])


def fit_trees(
    frame: DataFrame,
    spec: FeatureSpec,
    rounds: int = TREE_ROUNDS,
    seed: int = 42,
    early_stopping: bool = False,
) -> PipelineModel:
    """Boosted trees. With ``early_stopping`` a tenth of the rows, by a hash of their values
    and so with all their copies, is held back, and no more trees are kept than lower the
    loss over it. From more rows than Spark would take its split candidates from, the trees
    grow over cells of equal bins, see ``_trees_over_cells``."""
    validation = None
    if early_stopping:
        content = F.xxhash64(F.lit(seed), *[col(c) for c in frame.columns])
        held = F.pmod(content, F.lit(10_000)) < int(STOP_FRACTION * 10_000)
        # Rows of either kind may be missing from a very small table.
        marked = frame.withColumn(HELD, held)
        kinds = marked.agg(F.bool_or(HELD), F.bool_or(~F.col(HELD))).first()
        if all(kinds):
            frame, validation = marked, HELD
    stopping = {"validation": validation} if validation else {}
    pipeline = boosted_trees(spec, rounds, seed=seed, **stopping)
    numbers = [f"n{i}" for i in range(len(spec.numeric))]
    training = frame.where(~F.col(validation)) if validation else frame
    n_rows = training.count()
    if n_rows <= TREE_SAMPLE or not numbers:
        return pipeline.fit(frame)
    limits = bin_limits(training, numbers)
    # Numbers that are missing or infinite are for the trees to refuse.
    if limits is None:
        return pipeline.fit(frame)
    return _trees_over_cells(frame, spec, pipeline, limits, n_rows)


def bin_limits(rows: DataFrame, numbers: list[str]) -> dict[str, list[float]] | None:
    """Upper limits of at most ``TREE_BINS`` bins of each number, without that of the last
    bin: half-way between the values where there are as few, else exact quantiles of all
    rows. None if a number is missing or infinite."""
    finite = [F.bool_and(F.coalesce(F.abs(c) < math.inf, F.lit(False))).alias(c) for c in numbers]
    kinds = [F.approx_count_distinct(c).alias(f"{c}_kinds") for c in numbers]
    known = rows.agg(*finite, *kinds).first()
    if not all(known[c] for c in numbers):
        return None
    limits = {}
    for c in numbers:
        if known[f"{c}_kinds"] > 2 * TREE_BINS:
            continue
        values = sorted(r[0] for r in rows.select(c).distinct().limit(TREE_BINS + 1).collect())
        if len(values) <= TREE_BINS:
            limits[c] = [_between(*pair) for pair in zip(values, values[1:])]
    many = [c for c in numbers if c not in limits]
    # The smallest value has a bin of its own, as it may be that of most rows.
    edges = quantile_edges(rows, many, TREE_BINS - 1, widen_constant=False) if many else {}
    return limits | {c: found[:-1] for c, found in edges.items()}


def _between(low: float, high: float) -> float:
    middle = (low + high) / 2
    return middle if low <= middle < high else low


def _trees_over_cells(
    frame: DataFrame,
    spec: FeatureSpec,
    pipeline: Pipeline,
    limits: dict[str, list[float]],
    n_rows: int,
) -> PipelineModel:
    """The pipeline fitted to one row for all that fall into the same bins, with their number
    as its weight.

    Trees see of a number no more than its bin, so they are those of all rows. Where hardly
    two rows share their bins there are as many cells as rows, and no less work.
    """
    *categories, assembler, trees = pipeline.getStages()
    bins = {c: f"{c}_b" for c in limits}
    buckets = Bucketizer(
        inputCols=list(bins),
        outputCols=[f"{c}_r" for c in bins],
        # A bucket has its lower end, a bin its upper one. One bucket needs a limit too.
        splitsArray=[
            [-math.inf, *([math.nextafter(x, math.inf) for x in found] or [0.0]), math.inf]
            for found in limits.values()
        ],
        handleInvalid="keep",
    )
    # Buckets come marked as categories, whose order the trees would choose themselves.
    ordered = ", ".join(f"{c}_r + 0D AS {b}" for c, b in bins.items())
    binned = [buckets, SQLTransformer(statement=f"SELECT *, {ordered} FROM __THIS__")]
    # Categories are put in order by their rows, not by their cells.
    known = Pipeline(stages=categories).fit(frame).stages
    inputs = [bins.get(c, c) for c in assembler.getInputCols()]
    assembled = assembler.copy({assembler.inputCols: inputs})
    cells, n_cells = counted(_cells(frame, spec, binned), "cells")
    trees = trees.copy(
        {
            trees.weightCol: CELL_ROWS,
            # The least rows of a node, now by weight; halves keep clear of rounding.
            trees.minInstancesPerNode: 1,
            trees.minWeightFractionPerNode: (trees.getMinInstancesPerNode() - 0.5) / n_rows,
            # Spark reads the bins of all cells, not of a sample, for as many as its square.
            trees.maxBins: min(max(trees.getMaxBins(), math.isqrt(n_cells) + 1), MOST_TREE_BINS),
        }
    )
    prepared = PipelineModel([*known, assembled]).transform(spread_evenly(cells, n_cells))
    return PipelineModel([*binned, *known, assembled, trees.fit(prepared)])


def _cells(frame: DataFrame, spec: FeatureSpec, binned: list[Transformer]) -> DataFrame:
    """One row for all rows of the same bins, categories and label, with their number."""
    keys = [f"n{i}_b" for i in range(len(spec.numeric))]
    keys += [f"k{i}" for i in range(len(spec.categorical))]
    keys += [c for c in (LABEL, HELD) if c in frame.columns]
    cells = PipelineModel(binned).transform(frame).groupBy(*keys)
    return cells.agg(F.count("*").alias(CELL_ROWS))


def count_scores(
    model: PipelineModel, rows: DataFrame, spec: FeatureSpec, n_rows: int
) -> DataFrame:
    """Scored rows with ``CELL_ROWS``, how many of the rows each stands for. A model over bins
    scores a cell once, any other model every row."""
    if not isinstance(model.stages[0], Bucketizer):
        return model.transform(spread_evenly(rows, n_rows)).withColumn(CELL_ROWS, F.lit(1))
    cells, n_cells = counted(_cells(rows, spec, model.stages[:2]), "cells")
    return PipelineModel(model.stages[2:]).transform(spread_evenly(cells, n_cells))


def fit_logistic(frame: DataFrame, spec: FeatureSpec, max_iter: int = 2000) -> PipelineModel:
    """Scaled, class-balanced logistic regression with a unit L2 penalty.

    The penalty counts the weighted rows once, hence the division by their sum. Every
    class has the same summed weight, so that sum is the row count.
    """
    weighted = balanced_weights(frame, LABEL)
    n_rows = max(1, frame.count())
    scaler = StandardScaler(
        inputCol=FEATURES, outputCol="scaled", withMean=True, withStd=True
    )
    stages = [*feature_stages(spec), scaler, _logistic(n_rows, max_iter)]
    return Pipeline(stages=stages).fit(weighted)


def _logistic(n_rows: int, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="scaled",
        labelCol=LABEL,
        weightCol="weight",
        maxIter=max_iter,
        regParam=1.0 / n_rows,
        elasticNetParam=0.0,
        standardization=False,
    )


@dataclass(frozen=True)
class WideModel:
    """A logistic model whose categories are rows of a table, ``index``."""

    spec: FeatureSpec
    index: DataFrame
    sizes: dict[str, int]
    model: PipelineModel

    def transform(self, frame: DataFrame) -> DataFrame:
        return self.model.transform(wide_frame(frame, self.spec, self.index, self.sizes))


def wide_frame(
    frame: DataFrame, spec: FeatureSpec, index: DataFrame, sizes: dict[str, int]
) -> DataFrame:
    """A model frame with its features as sparse vectors, made by joins with a category
    index instead of a vocabulary that every task holds."""
    raw = [f"k{i}" for i in range(len(spec.categorical))]
    numbers = [f"n{i}" for i in range(len(spec.numeric))]
    rows = add_positions(frame, index, {c: f"{c}_i" for c in raw}, sizes)
    vector = sparse_vector(
        [F.col(c) for c in numbers], [(F.col(f"{c}_i"), sizes.get(c, 0)) for c in raw]
    )
    kept = [c for c in frame.columns if c not in {*raw, *numbers}]
    # Fields written as a struct are read back as a vector, without a row in Python.
    path = new_folder(frame.sparkSession, "vectors")
    rows.select(*[col(c) for c in kept], vector.alias(FEATURES)).write.parquet(path)
    fields = [f for f in frame.schema if f.name in kept]
    schema = T.StructType([*fields, T.StructField(FEATURES, VectorUDT())])
    return frame.sparkSession.read.schema(schema).parquet(path)


def fit_logistic_wide(frame: DataFrame, spec: FeatureSpec, max_iter: int = 2000) -> WideModel:
    """``fit_logistic`` for vocabularies of any size.

    Vectors stay sparse, as features are scaled but not centred: the penalty leaves the
    intercept alone, so coefficients and probabilities are the same. Of the vocabulary the
    driver sees its size; the coefficients are one dense vector, as in any model.
    """
    raw = tuple(f"k{i}" for i in range(len(spec.categorical)))
    index = written(category_index(frame, raw), "index")
    sizes = vocabulary_sizes(index)
    wide = wide_frame(balanced_weights(frame, LABEL), spec, index, sizes)
    scaler = StandardScaler(inputCol=FEATURES, outputCol="scaled", withMean=False, withStd=True)
    fitted = Pipeline(stages=[scaler, _logistic(max(1, frame.count()), max_iter)]).fit(wide)
    return WideModel(spec, index, sizes, fitted)


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    metrics: dict[str, float]


def train_and_evaluate(
    labeled: DataFrame,
    spec: FeatureSpec,
    key: str,
    needle: str | None = None,
    fraction: float = 0.2,
    seed: int = 42,
    rounds: int = TREE_ROUNDS,
    early_stopping: bool = False,
) -> Trained:
    """Stratified split, boosted trees on the train side, metrics on the holdout.

    The split and the fit take several passes, so the rows are written before and after the
    split, with the order that it goes by.
    """
    rows = model_frame(labeled, spec, needle, keep=(key,))
    rows = rows.withColumn("_order", hash_order(col(key), seed))
    with short_lived(rows, "frame") as rows:
        split = stratified_holdout(rows, LABEL, key, fraction, seed, hashed_as="_order")
        # Only what is held back for early stopping depends on the key.
        frame = written(split if early_stopping else split.drop(key), "split")
    train = frame.where(~F.col("is_holdout")).drop("is_holdout")
    test = frame.where("is_holdout").drop("is_holdout")
    n_train, n_test = train.count(), test.count()
    # More rows are read a few times only, and a shuffle would be repeated each time.
    train = spread_evenly(train, n_train) if n_train <= TREE_SAMPLE else train
    model = fit_trees(train, spec, rounds, seed, early_stopping)
    scored = count_scores(model, test, spec, n_test)
    row = macro_metrics(scored, LABEL, "prediction", CELL_ROWS).first()
    metrics = {c: float(row[c]) for c in ("accuracy", "f1_macro", "precision_macro", "recall_macro")}
    metrics["n_train"] = float(n_train)
    metrics["n_test"] = float(row["n_test"] or 0)
    return Trained(model, metrics)


def positive_score(scored: DataFrame, name: str = "score") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def forward_evaluation(
    windows: DataFrame, spec: FeatureSpec, window: str = "window", max_iter: int = 2000
) -> DataFrame:
    """Logistic models trained on D1 and on D1+D2, tested on later windows:
    ``model, eval_set`` and the metrics of each."""
    frame = model_frame(windows, spec, keep=(window,))
    first = fit_logistic(frame.where(col(window) == "D1"), spec, max_iter)
    both = fit_logistic(frame.where(col(window).isin("D1", "D2")), spec, max_iter)

    def scored(model: Transformer, name: str, eval_windows: tuple[str, ...]) -> DataFrame:
        rows = positive_score(model.transform(frame.where(col(window).isin(*eval_windows))))
        return rows.select(F.lit(name).alias("model"), col(window).alias("eval_set"), LABEL, "score")

    rows = scored(first, "trained_D1", ("D2", "D3")).unionByName(
        scored(both, "trained_D1+D2", ("D3",))
    )
    # The models run once, though the metrics take several passes.
    return evaluation(written(rows, "scores"), LABEL, "score", ["model", "eval_set"])


def metric_delta(
    results: DataFrame, metric: str = "pr_auc", eval_set: str = "D3",
    base: str = "trained_D1", adapted: str = "trained_D1+D2",
) -> DataFrame:
    """Gain of the adapted model over the base model on one window."""

    def of(model: str):
        return F.max(F.when(F.col("model") == model, F.col(metric)))

    return results.where(F.col("eval_set") == eval_set).agg(
        of(base).alias("base"), of(adapted).alias("adapted"), (of(adapted) - of(base)).alias("delta")
    )


def batch_scores(
    rows: DataFrame,
    model: PipelineModel,
    spec: FeatureSpec,
    class_names: tuple[str, str],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Class, probability of the positive class and its name for every row."""
    scored = positive_score(model.transform(model_frame(rows, spec, keep=keep)), "positive_probability")
    predicted = F.col("prediction").cast("int")
    return scored.select(
        *[col(k) for k in keep],
        predicted.alias("prediction"),
        "positive_probability",
        F.when(predicted == 1, class_names[1]).otherwise(class_names[0]).alias("predicted_class"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
