"""Tree models on features, recursive generation, and model tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer,
    ImputerModel,
    OneHotEncoder,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import rng
from driftloom.functions.scalars import numeric_columns, sql_text, text_columns
from driftloom.operators.series import SeriesKey, lags as lagged_columns, newest
from driftloom.session import cut_lineage, fresh_path


def default_features(df: DataFrame, targets: Sequence[str]) -> list[str]:
    """All numeric columns that are not targets; text features are named by the caller, as their categories reach the driver."""
    usable = set(numeric_columns(df))
    return [c for c in df.columns if c in usable and c not in targets]


def train_forest(
    df: DataFrame,
    targets: Sequence[str],
    features: Sequence[str] | None = None,
    trees: int = 100,
    depth: int = 5,
    seed: int = 42,
) -> dict[str, PipelineModel]:
    """One forest per target; numbers are standardised, text is one-hot encoded.

    A missing number counts as the mean of the training rows, so that every row gets a prediction.
    A category unknown to the training rows gives all zeros.  The model of a target predicts the
    target itself, in its own unit.
    """
    features = list(features or default_features(df, targets))
    numeric = [c for c in features if c in numeric_columns(df)]
    text = [c for c in features if c in text_columns(df)]
    stages = [
        Imputer(inputCols=numeric, outputCols=[f"_filled_{c}" for c in numeric]),
        VectorAssembler(inputCols=[f"_filled_{c}" for c in numeric], outputCol="_numbers", handleInvalid="keep"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True),
    ] if numeric else []
    inputs = ["_scaled"] if numeric else []
    for c in text:
        stages += [
            StringIndexer(inputCol=c, outputCol=f"_index_{c}", handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"_index_{c}"], outputCols=[f"_hot_{c}"], dropLast=True),
        ]
        inputs.append(f"_hot_{c}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    models = {}
    df = cut_lineage(df)  # every stage of the pipeline reads the training rows again
    for target in targets:
        forest = RandomForestRegressor(
            featuresCol="_features", labelCol=target, predictionCol=f"predicted_{target}",
            numTrees=trees, maxDepth=depth, seed=seed, bootstrap=trees > 1,
        )
        rows = df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double"))
        models[target] = Pipeline(stages=[*stages, forest]).fit(rows)
    return models


def predict_forest(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Adds ``predicted_<target>`` for every target."""
    out = df
    for target, model in models.items():
        names = [*out.columns, f"predicted_{target}"]
        out = model.transform(out).select(*names)
    return out


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for target, model in models.items():
        model.write().overwrite().save(f"{path}/{target}")


def load_models(targets: Sequence[str], path: str) -> dict[str, PipelineModel]:
    return {target: PipelineModel.load(f"{path}/{target}") for target in targets}


# --- forests as expressions ----------------------------------------------------


def forest_nodes(model: PipelineModel) -> DataFrame:
    """Nodes of the forest, one row each: ``tree``, ``id``, ``prediction``, ``low``, ``high`` (its children, -1 for a leaf),
    ``feature``, and ``bound`` (largest value, or the categories, that go to ``low``)."""
    forest, path = model.stages[-1], fresh_path(SparkSession.active(), "nodes")
    forest.write().save(path)
    nodes = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return nodes.select(
        F.col("treeID").alias("tree"),
        "id",
        "prediction",
        F.col("leftChild").alias("low"),
        F.col("rightChild").alias("high"),
        F.col("split.featureIndex").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("bound"),
        (F.col("split.numCategories") >= 0).alias("categorical"),
    )


@dataclass(frozen=True)
class Compiled:
    """A fitted forest as SQL text.

    ``numbers`` holds (column, value of a missing one, mean, factor) and ``labels`` the known categories of
    each text column, both in the order of the features.
    """

    numbers: list[tuple[str, float, float, float]]
    labels: dict[str, list[str]]
    nodes: list[dict[int, Row]]

    def position(self, column: str) -> str:
        """1-based position of the category of a text column; 0 for a missing or unknown one."""
        known = ", ".join(sql_text(v) for v in self.labels[column])
        return f"coalesce(array_position(array({known}), cast(`{column}` as string)), 0)" if known else "0"

    def scaled(self, inputs: dict[str, str]) -> str:
        """Array of the standardised numbers; ``inputs`` gives the SQL of a column where it is not the column itself."""
        items = []
        for c, missing, mean, factor in self.numbers:
            x = f"nanvl(cast({inputs.get(c, f'`{c}`')} as double), cast(null as double))"
            items.append(f"(coalesce({x}, {missing!r}D) - {mean!r}D) * {factor!r}D")
        return f"array({', '.join(items)})"

    def trees(self, number: Callable[[int], str], positions: dict[str, str]) -> list[str]:
        """One CASE expression per tree, over the SQL of the standardised numbers and of the category positions."""
        hot = [f"{positions[c]} = {i + 1}" for c, known in self.labels.items() for i in range(len(known))]

        def branch(tree: dict[int, Row], at: int) -> str:
            node = tree[at]
            if node.low < 0:
                return f"{node.prediction!r}D"
            low, high = branch(tree, node.low), branch(tree, node.high)
            if node.feature < len(self.numbers):
                return f"IF({number(node.feature)} <= {node.bound[0]!r}D, {low}, {high})"
            # A category takes part as 0 or 1, whether the split is by categories or by a threshold.
            inside = 0.0 in node.bound if node.categorical else node.bound[0] < 1.0
            yes, no = (high, low) if inside else (low, high)
            return f"IF({hot[node.feature - len(self.numbers)]}, {yes}, {no})"

        return [branch(tree, 0) for tree in self.nodes]

    def sql(self, inputs: dict[str, str], positions: dict[str, str]) -> str:
        """The whole prediction as one expression, for use inside a lambda; numbers are standardised once."""
        summed = " + ".join(self.trees(lambda i: f"_s[{i}]", positions))
        return f"(transform(array({self.scaled(inputs)}), _s -> {summed})[0] / {len(self.nodes)}.0D)"


def compiled(model: PipelineModel) -> Compiled:
    """The expression form of a fitted pipeline of :func:`train_forest`.

    What reaches the driver is the model itself: at most ``trees * 2 ** (depth + 1)`` nodes, and the
    categories that its indexers hold already.
    """
    numbers, labels, columns, missing = [], {}, [], {}
    for stage in model.stages:
        if isinstance(stage, ImputerModel):
            columns, missing = stage.getInputCols(), stage.surrogateDF.first().asDict()
        elif isinstance(stage, StandardScalerModel):
            factors = [1.0 / s if s != 0.0 else 0.0 for s in stage.std.toArray().tolist()]
            numbers = [(c, float(missing[c]), m, k) for c, m, k in zip(columns, stage.mean.toArray().tolist(), factors)]
        elif isinstance(stage, StringIndexerModel):
            labels[stage.getInputCol()] = list(stage.labels)
    nodes: list[dict[int, Row]] = [{} for _ in range(model.stages[-1].getNumTrees)]
    for row in forest_nodes(model).collect():
        nodes[row.tree][row.id] = row
    return Compiled(numbers, labels, nodes)


def predict_compiled(models: dict[str, Compiled], df: DataFrame) -> DataFrame:
    """``predict_forest`` by one expression per target, for plans that a transform of the ML library does not fit.

    The trees stand inside a lambda, which Spark interprets: as generated code, a hundred trees would pass the
    64 KB that a Java method may have.  For a plain batch, ``predict_forest`` is the faster of the two.
    """
    out = df
    for target, trees in models.items():
        placed = out.withColumns({f"_pos_{c}": F.expr(trees.position(c)) for c in trees.labels})
        predicted = F.expr(trees.sql({}, {c: f"`_pos_{c}`" for c in trees.labels})).alias(f"predicted_{target}")
        out = placed.select(*out.columns, predicted)
    return out


# --- recursive generation ----------------------------------------------------


def lag_frame(df: DataFrame, key: SeriesKey, value: str, lags: int) -> DataFrame:
    """Training rows with ``lag_1 .. lag_n``."""
    framed = lagged_columns(df, key, {f"lag_{i}": (value, i) for i in range(1, lags + 1)})
    return framed.where(F.col(f"lag_{lags}").isNotNull())


def last_lags(df: DataFrame, key: SeriesKey, value: str, lags: int) -> DataFrame:
    """One row per series: its last time and its last values as ``lag_1`` (newest) onwards."""
    recent = newest(df, key, lags, rank="_recency")
    picked = [F.max(F.when(F.col("_recency") == i, F.col(value))).alias(f"lag_{i}") for i in range(1, lags + 1)]
    return recent.groupBy(*key.keys).agg(F.max(key.ts).alias("last_ts"), *picked)


def generate_recursively(
    model: PipelineModel,
    state: DataFrame,
    keys: Sequence[str],
    value: str,
    lags: int,
    steps: int,
    step_seconds: int,
    seed: int,
    series_id: str,
    noise_level: float = 0.1,
) -> DataFrame:
    """Forecast step by step, feeding each prediction back as the newest lag.

    The state has one row per series.  The forest is an expression (:func:`compiled`), so all steps are
    one fold over an array inside one projection: no transform per step, no written table, and a plan
    whose size does not depend on the steps.  Noise is N(0, level * |prediction| * 0.1); a factor has
    that distribution and mentions the prediction once.
    """
    trees = compiled(model)
    lagged = {f"lag_{i}": f"element_at(_h, -{i})" for i in range(1, lags + 1)}
    rest = {c: f"`_pos_{c}`" for c in trees.labels}
    draws = f"transform(sequence(1, {steps}), _step -> {rng.normal_sql(seed, value, 'recursive', series_id, '_step')})"
    placed = state.withColumns({"_z": F.expr(draws), **{f"_pos_{c}": F.expr(trees.position(c)) for c in trees.labels}})
    following = f"{trees.sql(lagged, rest)} * (1.0D + {noise_level * 0.1!r}D * element_at(_z, _step))"
    start = ", ".join(f"cast(lag_{i} as double)" for i in range(lags, 0, -1))
    path = f"slice(aggregate(sequence(1, {steps}), array({start}), (_h, _step) -> concat(_h, array({following}))), {lags + 1}, {steps})"
    exploded = placed.select(*keys, "last_ts", F.posexplode(F.expr(path)).alias("_at", "generated"))
    exploded = exploded.withColumn("step", F.col("_at") + 1)
    micros = F.col("step").cast("long") * F.lit(step_seconds * 1_000_000).cast("long")
    return exploded.select(
        *keys, "step", F.timestamp_add("MICROSECOND", micros, F.col("last_ts")).alias("ts"), "generated"
    )


# --- versioned coefficient tables ---------------------------------------------


def save_coefficients(coefficients: DataFrame, path: str, version: int) -> None:
    """Write one version of a coefficient table; writing a version again replaces just that one."""
    coefficients.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_coefficients(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every series."""
    table = spark.read.parquet(path)
    rest = [c for c in table.columns if c not in keys]
    best = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
    return best.select(*keys, "_row.*")


def retrain(
    history: DataFrame,
    key: SeriesKey,
    fit: Callable[[DataFrame], DataFrame],
    path: str,
    version: int,
    rows: int = 1000,
) -> None:
    """Scheduled refit: fit on the last ``rows`` of every series and store a new version."""
    save_coefficients(fit(newest(history, key, rows)), path, version)
