"""Every operator as a named query over the given tables: ``name -> callable(spark, sf_dir)``.

All queries run over all rows of the appointment table (``propensity.appointments``). Where an operator needs
input the tables lack, such as NULLs, NaN or unseen categories, it is planted by a rule on the row key.
Doubles that come out of arithmetic are rounded, and dates are given as text, so that results compare across
engines.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity import operators as op
from propensity import sources
from propensity.appointments import appointments, raw_appointments
from propensity.functions import date_part, days_between, linear_score, literal_map, vector_elements
from propensity.functions.dates import PERIODS
from propensity.functions.keyhash import key_hash
from propensity.plans import (
    PreparedData,
    coefficient_table,
    compare_models,
    cross_validate,
    feature_names,
    feature_stages,
    fit_learners,
    full_logistic_grid,
    gradient_boosted_trees,
    leaderboard,
    logistic_regression,
    needed_columns,
    poisson_draw,
    prepare,
    random_forest,
    search_logistic_grid,
    search_table,
    training_pipeline,
)
from propensity.plans.forests import tree_hash
from propensity.schema import (
    BASE_COLUMNS,
    CLEAN_NAMES,
    DATE_COLUMNS,
    DATE_PREFIXES,
    HIGH_CARDINALITY,
    ID_COLUMNS,
    LABEL,
    LOW_CARDINALITY,
    ROW_KEY,
    WEIGHT,
)
from propensity.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A hand-set linear model, so that scoring and metrics can be checked without a learner.
LINEAR_INTERCEPT = 0.8
LINEAR_COEFFICIENTS = {
    "age": -0.004,
    "date_diff": -0.03,
    "sms_received": 0.5,
    "scholarship": -0.3,
    "hypertension": 0.1,
}

# Segment -> code; one segment has none.
SEGMENT_CODES = {"AUTOMOBILE": 0.1, "BUILDING": 0.2, "FURNITURE": 0.3, "MACHINERY": 0.4}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def key_is(divisor: int, remainder: int) -> Column:
    """Condition on the row key by which test values are planted."""
    return F.pmod(F.col(ROW_KEY), F.lit(divisor)) == remainder


def rounded(columns: list[str], digits: int = 9) -> list[Column]:
    """Columns rounded half up, in plain arithmetic: ``F.round`` goes through decimals, row by row."""
    scale = float(10**digits)
    return [(F.floor(F.col(name) * scale + 0.5) / scale).alias(name) for name in columns]


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.drop_null_labels(appointments(spark, sf_dir), LABEL)


def training_rows(df: DataFrame) -> DataFrame:
    return op.train_test_split(df, ROW_KEY)[0]


# --- sources ---------------------------------------------------------------------------------------------


@query
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "appointments-csv")
    file_names = {"Neighborhood": "Neighbourhood", "Hypertension": "Hipertension"}
    sources.write_csv(op.rename_columns(raw_appointments(spark, sf_dir), file_names), path)
    scanned = op.rename_columns(sources.scan_csv(spark, path), CLEAN_NAMES)
    flags = ["scholarship", "hypertension", "diabetes", "alcoholism", "handicap", "sms_received", LABEL]
    return scanned.select(
        *ID_COLUMNS,
        "gender",
        *[text(name) for name in DATE_COLUMNS],
        F.col("age").cast("double").alias("age"),
        "neighborhood",
        *[F.col(name).cast("double").alias(name) for name in flags],
        F.col("date_diff").cast("bigint").alias("date_diff"),
    )


@query
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a name of its own for each call; what calls before it in this application registered is dropped
    prefix = "propensity_appointments_" + re.sub("[^a-z0-9]", "_", spark.sparkContext.applicationId.lower())
    for old in spark.catalog.listTables():
        if old.name.startswith(prefix):
            spark.sql(f"DROP TABLE IF EXISTS `{old.name}`")
    table = f"{prefix}_{uuid.uuid4().hex}"
    sources.write_table(
        op.with_split(appointments(spark, sf_dir), ROW_KEY),
        table,
        partition_by=["split"],
        path=scratch_path(spark, table),
    )
    return sources.read_table(spark, table).select(ROW_KEY, "split", "neighborhood", "date_diff", "sms_received")


@query
def scan_csv_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that do not parse, planted by key: the cell is NULL and the row is kept apart; other spellings of NULL and dates are fine."""
    path = scratch_path(spark, "bad-csv")
    cells = raw_appointments(spark, sf_dir)
    cells = cells.select(*(F.col(f"`{name}`").cast("string").alias(name) for name in cells.columns))
    key = F.pmod(F.col("AppointmentID").cast("bigint"), F.lit(50))
    planted = {
        "PatientId": F.when(key == 1, "29872499824296.0").otherwise(F.col("PatientId")),
        "Age": F.when(key == 2, "12x").when(key == 5, "").otherwise(F.col("Age")),
        "Showed_up": F.when(key == 3, "1").when(key == 6, F.upper("Showed_up")).otherwise(F.col("Showed_up")),
        "ScheduledDay": F.when(key == 4, F.concat("ScheduledDay", F.lit("T18:38:08Z"))).otherwise(F.col("ScheduledDay")),
    }
    sources.write_csv(cells.withColumns(planted), path, empty_token="")
    good, bad = sources.quarantine(sources.scan_csv(spark, path, corrupt_column="bad_row"), "bad_row")

    def kept(rows: DataFrame, is_bad: bool) -> DataFrame:
        renamed = op.rename_columns(rows, CLEAN_NAMES)
        return renamed.select(
            ROW_KEY, *(F.col(name).cast("double").alias(name) for name in ("patient_id", "age")), text("scheduled_day"), F.col(LABEL).cast("double").alias(LABEL), F.lit(int(is_bad)).alias("is_bad")
        )

    return kept(good, False).union(kept(bad, True))


# --- projections and cleaning ----------------------------------------------------------------------------


@query
def rename_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = op.cast_to_double(op.rename_columns(raw_appointments(spark, sf_dir), CLEAN_NAMES))
    return clean.select(
        *[text(name) if name in DATE_COLUMNS else F.col(name) for name in CLEAN_NAMES.values()]
    )


@query
def drop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = appointments(spark, sf_dir).drop(*ID_COLUMNS, "not_a_column")
    return kept.select(
        "gender",
        *[text(name) for name in DATE_COLUMNS],
        "neighborhood",
        *BASE_COLUMNS,
        F.col(LABEL).alias("label"),
    )


@query
def drop_sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = appointments(spark, sf_dir)
    others = [name for name in full.columns if name != ROW_KEY]
    # the first (key mod 15) of the other columns are emptied
    emptied = F.pmod(F.col(ROW_KEY), F.lit(len(full.columns)))
    sparse = full.select(
        ROW_KEY, *[F.when(emptied <= i, F.col(name)).alias(name) for i, name in enumerate(others)]
    )
    kept = op.cast_to_double(op.drop_sparse_rows(sparse, 80), ["patient_id"])
    return kept.select(ROW_KEY, *[text(name) if name in DATE_COLUMNS else F.col(name) for name in others])


@query
def drop_sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = appointments(spark, sf_dir).select(
        ROW_KEY,
        "gender",
        "age",
        F.when(key_is(10, 0), F.col("date_diff")).alias("mostly_missing"),
        F.when(key_is(2, 0), F.col("date_diff")).alias("half_missing"),
        F.lit(None).cast("double").alias("all_missing"),
    )
    return op.drop_sparse_columns(sparse, 80)


@query
def drop_null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(ROW_KEY, LABEL)


@query
def skip_invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = appointments(spark, sf_dir).withColumn(
        "age", F.when(key_is(83, 3), F.lit(float("nan"))).otherwise(F.col("age"))
    )
    return op.skip_invalid_rows(holed, BASE_COLUMNS).select(ROW_KEY, *BASE_COLUMNS)


# --- profiling -------------------------------------------------------------------------------------------


@query
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.missing_report(appointments(spark, sf_dir))


@query
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.class_balance(labelled(spark, sf_dir), LABEL)


@query
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sample_rows(appointments(spark, sf_dir), ROW_KEY, 5).select(ROW_KEY, "neighborhood", "date_diff")


# --- splits ----------------------------------------------------------------------------------------------


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_split(appointments(spark, sf_dir), ROW_KEY).select(ROW_KEY, "bucket", "split")


@query
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_sizes(op.with_split(appointments(spark, sf_dir), ROW_KEY))


@query
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = op.with_fold(appointments(spark, sf_dir), ROW_KEY, 3)
    return folded.select(ROW_KEY, F.col("fold").cast("bigint").alias("fold"))


# --- scalar features -------------------------------------------------------------------------------------


@query
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appointments(spark, sf_dir).select(
        ROW_KEY,
        *[
            date_part(part, F.col(column)).cast("bigint").alias(f"{prefix}_{part}")
            for column, prefix in zip(DATE_COLUMNS, DATE_PREFIXES)
            for part in PERIODS
        ],
    )


@query
def cyclical_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = op.CyclicalDateTransformer(inputCols=DATE_COLUMNS, prefixes=DATE_PREFIXES, parts=list(PERIODS))
    encoded = encoder.transform(appointments(spark, sf_dir))
    return encoded.select(ROW_KEY, *rounded(encoder.output_columns()))


@query
def date_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = days_between(F.col("scheduled_day"), F.col("appointment_day"))
    return appointments(spark, sf_dir).select(ROW_KEY, days.cast("bigint").alias("lead_days"))


@query
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appointments(spark, sf_dir).select(
        ROW_KEY, "gender", literal_map(SEGMENT_CODES, F.col("gender")).alias("code")
    )


@query
def map_lookup_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of more keys than an expression holds."""
    mapping = {key: float(key * 37 % 1009) for key in range(7000)}
    rows = appointments(spark, sf_dir).select(ROW_KEY, F.pmod(ROW_KEY, F.lit(9000)).cast("bigint").alias("code_key"))
    return op.map_values(rows, mapping, "code_key", "code")


# --- feature transformers --------------------------------------------------------------------------------


@query
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    assembler = VectorAssembler(inputCols=BASE_COLUMNS, outputCol="features", handleInvalid="skip")
    vectors = assembler.transform(appointments(spark, sf_dir))
    return vectors.select(ROW_KEY, *vector_elements("features", BASE_COLUMNS))


@query
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("constant", F.lit(7.0))
    inputs = [*BASE_COLUMNS, "constant"]
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip"),
        MinMaxScaler(inputCol="features", outputCol="scaled_features"),
    ]
    scaled = Pipeline(stages=stages).fit(training_rows(rows)).transform(rows)
    names = [f"{name}_scaled" for name in inputs]
    return scaled.select(ROW_KEY, *vector_elements("scaled_features", names)).select(ROW_KEY, *rounded(names))


@query
def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.with_split(appointments(spark, sf_dir), ROW_KEY).withColumn(
        LOW_CARDINALITY,
        F.when((F.col("split") == "test") & key_is(71, 3), F.lit("UNSEEN")).otherwise(F.col(LOW_CARDINALITY)),
    )
    indexer = StringIndexer(inputCol=LOW_CARDINALITY, outputCol="gender_index", handleInvalid="skip")
    model = indexer.fit(rows.filter("split = 'train'"))
    return model.transform(rows).select(ROW_KEY, LOW_CARDINALITY, "gender_index")


@query
def string_index_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the number of their orders on the training side; those without any there are dropped."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    rows = op.with_split(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), "o_orderkey")
    indexer = op.FrequencyIndexer(inputCol="c_name", outputCol="name_index", handleInvalid="skip")
    model = indexer.fit(rows.filter("split = 'train'"))
    return model.transform(rows.select("o_orderkey", "c_name"))


@query
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins fitted on the training side, applied to both."""
    names = ["age", "date_diff"]
    rows = op.skip_invalid_rows(labelled(spark, sf_dir), names)
    model = op.QuantileBins(inputCols=names, outputCols=[f"{name}_bin" for name in names]).fit(training_rows(rows))
    return model.transform(rows).select(ROW_KEY, *names, *(f"{name}_bin" for name in names))


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = appointments(spark, sf_dir)
    stages = [
        StringIndexer(inputCol=LOW_CARDINALITY, outputCol="gender_index", handleInvalid="skip"),
        OneHotEncoder(inputCol="gender_index", outputCol="gender_vec"),
    ]
    model = Pipeline(stages=stages).fit(rows)
    width = model.stages[-1].categorySizes[0] - 1
    return model.transform(rows).select(
        ROW_KEY, *vector_elements("gender_vec", [f"gender_vec_{i}" for i in range(width)])
    )


def neighborhoods_with_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and all rows, with some neighborhoods NULL and one that only the test side has."""
    rows = op.with_split(labelled(spark, sf_dir), ROW_KEY).withColumn(
        HIGH_CARDINALITY,
        F.when(key_is(79, 11), F.lit(None))
        .when((F.col("split") == "test") & key_is(71, 3), F.lit("opened later"))
        .otherwise(F.col(HIGH_CARDINALITY)),
    )
    return rows.filter(F.col("split") == "train"), rows


def neighborhood_encoder(smoothing: str | float) -> op.AutoTargetEncoder:
    return op.AutoTargetEncoder(
        inputCol=HIGH_CARDINALITY, outputCol="neighborhood_te", labelCol=LABEL, smoothing=smoothing
    )


@query
def target_encode_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = neighborhood_encoder("auto").fit(training_rows(labelled(spark, sf_dir)))
    return model.encodings.withColumnRenamed("category", HIGH_CARDINALITY).select(
        HIGH_CARDINALITY, "n", *rounded(["mean", "encoding"])
    )


@query
def target_encode_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = neighborhoods_with_gaps(spark, sf_dir)
    encoded = neighborhood_encoder("auto").fit(train).transform(rows)
    return encoded.select(ROW_KEY, HIGH_CARDINALITY, *rounded(["neighborhood_te"]))


@query
def target_encode_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, rows = neighborhoods_with_gaps(spark, sf_dir)
    encoded = neighborhood_encoder(10.0).fit(train).transform(rows)
    return encoded.select(ROW_KEY, HIGH_CARDINALITY, *rounded(["neighborhood_te"]))


@query
def target_encode_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = neighborhoods_with_gaps(spark, sf_dir)
    folded = op.with_fold(train, ROW_KEY, 3)
    encoded = op.out_of_fold_encode(folded, HIGH_CARDINALITY, LABEL, "fold", "neighborhood_te", folds=3)
    return encoded.select(ROW_KEY, F.col("fold").cast("bigint").alias("fold"), *rounded(["neighborhood_te"]))


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = sources.stage_split(labelled(spark, sf_dir), ROW_KEY, columns=[LABEL, *needed_columns("full")])
    encoded = Pipeline(stages=feature_stages("full")).fit(train).transform(train.unionByName(test))
    names = feature_names(encoded)
    # which genders get an indicator depends on their frequencies, so these are numbered
    genders = [name for name in names if name.startswith("gender_vec")]
    names = [f"gender_vec_{genders.index(name)}" if name in genders else name for name in names]
    return encoded.select(ROW_KEY, *vector_elements("features", names)).select(ROW_KEY, *rounded(names))


# --- weights ---------------------------------------------------------------------------------------------


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = training_rows(labelled(spark, sf_dir))
    return op.with_class_weights(train, LABEL).select(ROW_KEY, LABEL, WEIGHT)


@query
def class_weights_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = training_rows(labelled(spark, sf_dir))
    return op.with_balanced_weights(train, LABEL).select(ROW_KEY, LABEL, *rounded([WEIGHT]))


# --- scoring with given coefficients, and metrics --------------------------------------------------------


def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.skip_invalid_rows(labelled(spark, sf_dir), list(LINEAR_COEFFICIENTS))
    return rows.withColumns(linear_score(LINEAR_COEFFICIENTS, LINEAR_INTERCEPT))


@query
def score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_scores(spark, sf_dir).select(
        ROW_KEY, LABEL, *rounded(["margin", "probability"]), "prediction"
    )


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.confusion_matrix(linear_scores(spark, sf_dir), LABEL)


@query
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = op.per_class_metrics(op.confusion_matrix(linear_scores(spark, sf_dir), LABEL))
    return metrics.select(
        "class", "support", "predicted", "hits", *rounded(["precision", "recall", "f1"])
    )


@query
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = op.weighted_metrics(op.confusion_matrix(linear_scores(spark, sf_dir), LABEL))
    return metrics.select("n", *rounded([name for name in metrics.columns if name != "n"]))


@query
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("sms_received") * 80 - F.col("date_diff") * 3 - F.col("age")
    rows = op.skip_invalid_rows(labelled(spark, sf_dir), BASE_COLUMNS).withColumn("score", score)
    return op.area_under_roc(rows, LABEL, "score").select("positives", "negatives", *rounded(["auc"]))


@query
def roc_by_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of one score in every nation, all curves at once."""
    score = F.col("sms_received") * 80 - F.col("date_diff") * 3 - F.col("age")
    rows = op.skip_invalid_rows(labelled(spark, sf_dir), BASE_COLUMNS)
    counts = rows.groupBy(F.split_part("neighborhood", F.lit("-"), F.lit(1)).cast("int").alias("curve"), score.alias("score")).agg(
        F.count_if(F.col(LABEL) == 1).alias("pos"), F.count_if(F.col(LABEL) == 0).alias("neg")
    )
    return op.curve_areas(counts).select("curve", "positives", "negatives", *rounded(["auc"]))


@query
def score_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table after one model's full run, a repeated run of two batches, and another model's run of one batch."""
    path = scratch_path(spark, "scores")
    rows = linear_scores(spark, sf_dir).withColumn("part", F.pmod(ROW_KEY, F.lit(4)).cast("int"))
    scored = rows.select(ROW_KEY, *rounded(["probability"]), "prediction", "part")
    sources.write_scores(scored, path, "linear-1", "part")
    sources.write_scores(scored.filter("part in (1, 2)"), path, "linear-1", "part")
    sources.write_scores(scored.filter("part = 3").withColumn("prediction", 1 - F.col("prediction")), path, "linear-2", "part")
    return sources.read_scores(spark, path).select("model", F.col("batch").cast("int").alias("batch"), ROW_KEY, "probability", "prediction")


# --- learners --------------------------------------------------------------------------------------------


def prepared(spark: SparkSession, sf_dir: str, feature_set: str = "full", columns: list[str] = ()) -> PreparedData:
    return prepare(appointments(spark, sf_dir), columns=needed_columns(feature_set, columns))


#: inputs with the values 0 and 1 only
FLAGS = ["scholarship", "hypertension", "diabetes", "alcoholism", "handicap", "sms_received"]


def predictions(model, test: DataFrame) -> DataFrame:
    return model.transform(test).select(
        ROW_KEY,
        LABEL,
        vector_elements("probability", ["not_shown", "probability"])[1],
        "prediction",
    ).withColumns({"probability": rounded(["probability"], 6)[0]})


@query
def lr_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    return predictions(training_pipeline(logistic_regression()).fit(data.train), data.test)


@query
def lr_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    model = training_pipeline(logistic_regression()).fit(data.train)
    return coefficient_table(spark, model, feature_names(model.transform(data.test)))


@query
def lr_unregularized(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir, "backup17")
    learner = logistic_regression(reg_param=0.0)
    return predictions(training_pipeline(learner, "backup17").fit(data.train), data.test)


@query
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    return predictions(training_pipeline(random_forest()).fit(data.train), data.test)


@query
def gbt_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    return predictions(training_pipeline(gradient_boosted_trees()).fit(data.train), data.test)


@query
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the test side with whether each kind of loaded pipeline scores them like the fitted one."""
    data = prepared(spark, sf_dir)
    learners = {"lr": logistic_regression(), "rf": random_forest(), "gbt": gradient_boosted_trees()}
    scored = data.test.withColumn("given", F.struct(*data.test.columns))
    kept = [ROW_KEY]
    for name, learner in learners.items():
        model = training_pipeline(learner, scale=True).fit(data.train)
        path = scratch_path(spark, "model")
        sources.save_pipeline(model, path)
        before = model.transform(scored.select("given", "given.*", *kept[1:])).select(
            "given", "given.*", *kept[1:], F.col("probability").alias("p_before"), F.col("prediction").alias("y_before")
        )
        same = (F.col("probability") == F.col("p_before")) & (F.col("prediction") == F.col("y_before"))
        kept.append(f"same_{name}")
        scored = sources.load_pipeline(path).transform(before).withColumn(kept[-1], same.cast("bigint"))
    return scored.select(*kept)


@query
def model_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    learners = {
        "logistic regression": logistic_regression(),
        "random forest": random_forest(),
        "gradient-boosted trees": gradient_boosted_trees(),
    }
    fitted = fit_learners(learners, prepared(spark, sf_dir))
    return compare_models(fitted.models, fitted.held_out)


@query
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each row occurs in the samples of a forest's first three trees."""
    hashed = appointments(spark, sf_dir).select(ROW_KEY, key_hash(F.col(ROW_KEY)).alias("row_hash"))
    drawn = hashed.withColumns({f"h{tree}": tree_hash(F.col("row_hash"), tree) for tree in range(3)})
    return drawn.select(ROW_KEY, *(poisson_draw(F.col(f"h{tree}")).cast("int").alias(f"tree_{tree}") for tree in range(3)))


# --- learners with a closed form -------------------------------------------------------------------------


@query
def lr_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one binary input, intercept and slope are log odds of weighted counts."""
    inputs = ["sms_received"]
    data = prepared(spark, sf_dir, "columns", inputs)
    learner = logistic_regression(reg_param=0.0, max_iter=200, tolerance=1e-12)
    model = training_pipeline(learner, "columns", columns=inputs).fit(data.train)
    return coefficient_table(spark, model, inputs).select("feature", *rounded(["coefficient"], 5))


@query
def tree_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree with one split: the flag with the best weighted Gini gain, and the weighted shares on its sides."""
    data = prepared(spark, sf_dir, "columns", FLAGS)
    learner = random_forest(trees=1, depth=1, bootstrap=False, columns_per_split="all")
    return predictions(training_pipeline(learner, "columns", columns=FLAGS).fit(data.train), data.test)


@query
def gbt_first_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of boosting: a leaf is the weighted mean of 2y - 1, half the log odds of the score."""
    data = prepared(spark, sf_dir, "columns", FLAGS)
    learner = gradient_boosted_trees(iterations=1, depth=1)
    return predictions(training_pipeline(learner, "columns", columns=FLAGS).fit(data.train), data.test)


@query
def cv_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one input, the area of any logistic regression is the rank statistic of that input, fold by fold."""
    learner = logistic_regression()
    grid = ParamGridBuilder().addGrid(learner.regParam, [0.01, 0.1]).build()
    data = prepared(spark, sf_dir, "columns", ["date_diff"])
    search = cross_validate(training_pipeline(learner, "columns", columns=["date_diff"]), grid, data.train)
    return search_table(spark, search).select("params", *rounded(["avg_metric"]))


@query
def leaderboard_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three linear scores with given coefficients, compared like fitted models."""
    rows = op.skip_invalid_rows(labelled(spark, sf_dir), list(LINEAR_COEFFICIENTS))
    fixed = linear_score(LINEAR_COEFFICIENTS, LINEAR_INTERCEPT)["margin"]

    def scored(margin: Column) -> DataFrame:
        raw = array_to_vector(F.array(-margin, margin))
        return rows.select(LABEL, raw.alias("rawPrediction"), (margin > 0).cast("double").alias("prediction"))

    models = {"fixed": fixed, "inverted": -fixed, "one input": 15.5 - F.col("date_diff")}
    board = leaderboard({name: scored(margin) for name, margin in models.items()})
    return board.select("rank", "model", "metric", *rounded(["value"]))


# --- searches --------------------------------------------------------------------------------------------


@query
def cv_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    learner = logistic_regression()
    grid = (
        ParamGridBuilder()
        .addGrid(learner.regParam, [0.01, 0.1])
        .addGrid(learner.elasticNetParam, [0.0, 0.5])
        .build()
    )
    data = prepared(spark, sf_dir)
    return search_table(spark, cross_validate(training_pipeline(learner), grid, data.train))


@query
def cv_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    learner = random_forest()
    grid = ParamGridBuilder().addGrid(learner.numTrees, [20, 50]).addGrid(learner.maxDepth, [3, 5]).build()
    data = prepared(spark, sf_dir)
    return search_table(spark, cross_validate(training_pipeline(learner), grid, data.train))


@query
def cv_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    learner = gradient_boosted_trees()
    grid = ParamGridBuilder().addGrid(learner.maxDepth, [3, 5]).addGrid(learner.maxIter, [20, 50]).build()
    data = prepared(spark, sf_dir)
    return search_table(spark, cross_validate(training_pipeline(learner), grid, data.train))


@query
def cv_lr_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete grid of the logistic search, 244 points."""
    learner = logistic_regression()
    data = prepared(spark, sf_dir)
    return search_table(spark, search_logistic_grid(training_pipeline(learner), full_logistic_grid(learner), data.train))


@query
def cv_lr_full_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete grid with one input: the rank statistic of that input by fold, or a half where the penalty leaves nothing of it."""
    learner = logistic_regression()
    data = prepared(spark, sf_dir, "columns", ["date_diff"])
    pipeline = training_pipeline(learner, "columns", columns=["date_diff"])
    search = search_logistic_grid(pipeline, full_logistic_grid(learner), data.train)
    return search_table(spark, search).select("params", *rounded(["avg_metric"]))
