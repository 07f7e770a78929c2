"""Classifiers on window features: train, score, save, load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.functions.dimensions import activity_label
from strideflow.operators.features import BASIC_FEATURES, LOCATION_AWARE_FEATURES

# Classifier names and parameters.
DECISION_TREE = "decisiontree"
RANDOM_FOREST = "randomforest"
NAIVE_BAYES = "naivebayes"
MAX_BINS = 32
TREE_DEPTH = 10
FOREST_TREES = 10
FOREST_DEPTH = 20
FOREST_SEED = 12345
SMOOTHING = 1.0

VARIANTS = [(aware, hand) for aware in (False, True) for hand in (False, True)]


def feature_columns(location_aware: bool) -> list[str]:
    return LOCATION_AWARE_FEATURES if location_aware else BASIC_FEATURES


def assembler(location_aware: bool) -> VectorAssembler:
    return VectorAssembler(inputCols=feature_columns(location_aware), outputCol="features")


def train_decision_tree(train: DataFrame, location_aware: bool) -> PipelineModel:
    tree = DecisionTreeClassifier(impurity="gini", maxDepth=TREE_DEPTH, maxBins=MAX_BINS)
    return Pipeline(stages=[assembler(location_aware), tree]).fit(train)


def train_random_forest(train: DataFrame, location_aware: bool) -> PipelineModel:
    forest = RandomForestClassifier(
        numTrees=FOREST_TREES, featureSubsetStrategy="auto", impurity="gini", maxDepth=FOREST_DEPTH,
        maxBins=MAX_BINS, seed=FOREST_SEED,
    )
    return Pipeline(stages=[assembler(location_aware), forest]).fit(train)


def unit_scaler(train: DataFrame, columns: Sequence[str]) -> tuple[SQLTransformer, list[str]]:
    """Scale columns to 0…1 over the training rows; later rows below that range count as 0."""
    names = [f"unit_{c}" for c in columns]
    ranges = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = []
    for column, name in zip(columns, names):
        lo, hi = ranges[f"lo_{column}"] or 0.0, ranges[f"hi_{column}"] or 0.0
        width = hi - lo
        # As text, for a bound may be infinite or not a number.
        value = f"greatest(({column} - CAST('{lo!r}' AS DOUBLE)) / CAST('{width!r}' AS DOUBLE), 0D)" if width > 0 else "0D"
        scaled.append(f"{value} AS {name}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"), names


def train_naive_bayes(train: DataFrame, location_aware: bool) -> PipelineModel:
    """Multinomial Bayes takes no negative values, so the features are scaled first.

    It numbers the classes it saw without gaps; the last stage turns those numbers into labels.
    """
    scaler, names = unit_scaler(train, feature_columns(location_aware))
    labels = sorted(r["label"] for r in train.select("label").distinct().collect())
    known = F.array(*[F.lit(v) for v in labels])
    numbered = train.withColumn("class_number", (F.array_position(known, F.col("label")) - 1).cast("double"))
    bayes = NaiveBayes(smoothing=SMOOTHING, labelCol="class_number", predictionCol="class_prediction")
    fitted = Pipeline(stages=[scaler, VectorAssembler(inputCols=names, outputCol="features"), bayes]).fit(numbered)
    listed = ", ".join(f"{v!r}D" for v in labels)
    back = SQLTransformer(
        statement=f"SELECT *, element_at(array({listed}), CAST(class_prediction AS INT) + 1) AS prediction FROM __THIS__"
    )
    return PipelineModel(stages=[*fitted.stages, back])


TRAINERS = {
    DECISION_TREE: train_decision_tree,
    RANDOM_FOREST: train_random_forest,
    NAIVE_BAYES: train_naive_bayes,
}


def predict_activity(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Add ``prediction`` and the ``predicted`` activity label."""
    scored = model.transform(features)
    kept = [*features.columns, "prediction"]
    return scored.select(*kept, activity_label(F.col("prediction")).alias("predicted"))


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = (F.col("prediction") == F.col("label")).cast("double")
    return predictions.groupBy(*by).agg(F.count("*").alias("n_test"), F.avg(right).alias("accuracy"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def model_path(base: str, algorithm: str, location_aware: bool, dominanthand: bool) -> str:
    """Folder of one of the four variants of a model."""
    return f"{base}/{algorithm}/locaware={str(location_aware).lower()}/dhand={str(dominanthand).lower()}"


def save_model(model: PipelineModel, path: str, overwrite: bool = True) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def stored_variants(spark: SparkSession, base: str, algorithm: str = RANDOM_FOREST) -> dict[tuple[bool, bool], str]:
    """Paths of the variants that were trained, keyed ``(location_aware, dominanthand)``; none at all is an error."""
    paths = {v: model_path(base, algorithm, *v) for v in VARIANTS}
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = {v: p for v, p in paths.items() if hadoop(p).getFileSystem(conf).exists(hadoop(f"{p}/metadata"))}
    if not found:
        raise FileNotFoundError(f"no {algorithm} model below {base}")
    return found


def load_models(base: str, algorithm: str = RANDOM_FOREST) -> dict[tuple[bool, bool], PipelineModel]:
    """The trained variants, keyed ``(location_aware, dominanthand)``."""
    spark = SparkSession.getActiveSession()
    return {v: load_model(path) for v, path in stored_variants(spark, base, algorithm).items()}


# More nodes than this are not broadcast: some tens of megabytes.
MOST_NODES = 500_000


def compiled_trees(spark: SparkSession, base: str, algorithm: str = RANDOM_FOREST) -> DataFrame:
    """Trees as data: a row per trained variant with ``locationaware``, ``dominanthand`` and ``trees``.

    A tree is an array of nodes, a node's place is its id; each has the feature and threshold it splits at, its
    children (-1 for a leaf) and the shares of the classes among its training rows.
    """
    out = None
    for (aware, hand), path in stored_variants(spark, base, algorithm).items():
        nodes = spark.read.parquet(f"{path}/stages/1_*/data")
        nodes = nodes.select("treeID", "nodeData.*") if "treeID" in nodes.columns else nodes.withColumn("treeID", F.lit(0))
        total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
        node = F.struct(
            "id", F.col("split.featureIndex").alias("feature"), F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
            F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
            F.transform("impurityStats", lambda x: x / total).alias("shares"),
        )
        trees = nodes.groupBy("treeID").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
        row = trees.agg(F.array_sort(F.collect_list(F.struct("treeID", "nodes"))).alias("trees")).select(
            F.lit(aware).alias("locationaware"), F.lit(hand).alias("dominanthand"), F.col("trees.nodes").alias("trees")
        )
        out = row if out is None else out.union(row)
    return out


def predict_compiled(features: DataFrame, trees: DataFrame, kinds: Sequence[bool] = (False, True)) -> DataFrame:
    """``features`` with ``prediction`` and ``predicted`` from the trees of their variant.

    ``features`` has ``dominanthand``, ``locationaware`` and the columns of the kinds in use; rows of a variant that was
    not trained are left out. One plan scores all variants: each row walks the arrays of its own trees, one step a level.
    """
    small = sum(r["n"] for r in trees.select(F.aggregate("trees", F.lit(0), lambda a, t: a + F.size(t)).alias("n")).collect()) <= MOST_NODES
    names = {aware: F.array(*[F.col(c).cast("double") for c in feature_columns(aware)]) for aware in kinds}
    x = names[kinds[0]] if len(kinds) == 1 else F.when(F.col("locationaware"), names[True]).otherwise(names[False])
    keyed = features.withColumn("_x", x)
    own = trees.select("locationaware", "dominanthand", F.col("trees").alias("_trees"))
    joined = keyed.join(F.broadcast(own) if small else own, ["locationaware", "dominanthand"])
    levels = F.sequence(F.lit(1), F.lit(max(TREE_DEPTH, FOREST_DEPTH)))

    def leaf(nodes):
        def down(at, _):
            node = F.get(nodes, at)
            left = F.get(F.col("_x"), node["feature"]) <= node["threshold"]
            return F.when(node["left"] < 0, at).when(left, node["left"]).otherwise(node["right"])

        return F.get(nodes, F.aggregate(levels, F.lit(0), down))["shares"]

    def add(votes, shares):
        return F.when(F.size(votes) == 0, shares).otherwise(F.zip_with(votes, shares, lambda a, b: a + b))

    votes = F.aggregate(F.transform("_trees", leaf), F.array().cast("array<double>"), add)
    scored = joined.withColumn("_votes", votes)
    prediction = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
    return scored.select(*features.columns, prediction.alias("prediction")).withColumn("predicted", activity_label(F.col("prediction")))
