"""

Queries and SQL read the same tables. Results that the operators leave
unrounded are rounded here, on both sides, so that the last bits of floating
sums do not matter.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml.functions import vector_to_array  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T  # noqa: E402

from vistrata.functions.columns import col  # noqa: E402
from vistrata.operators import (  # noqa: E402
    association, chartdata, clean, encode, evaluate, features, information, knn, models, profile,
    quantiles, split, transform,
)
from vistrata.plans.session import scratch_path  # noqa: E402
from vistrata.sources import files, modelstore, report  # noqa: E402

try:  # the corpus operators may be absent as a whole
    import corpus_pipeline  # noqa: E402
    from vistrata.llm import queries as corpus_queries  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "vistrata.llm"):
        raise
    corpus_pipeline = corpus_queries = None

Query = Callable[[SparkSession, str], DataFrame]

# lineitem with missing values, outliers, a boolean and categories; runs in both engines.
MESSY = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS quantity,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN l_extendedprice * 50
            ELSE l_extendedprice END AS price,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_discount + CAST(0 AS DOUBLE) END AS discount,
       l_tax + CAST(0 AS DOUBLE) AS tax,
       CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE l_returnflag END AS flag,
       l_linestatus AS status,
       l_quantity > 25 AS is_bulk,
       l_shipdate AS shipdate
FROM {lineitem}
"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
           "quantity", "price", "discount", "tax"]
MEASURES = ["quantity", "price", "discount", "tax"]
DTYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "quantity": "double", "price": "double", "discount": "double", "tax": "double",
    "flag": "string", "status": "string", "is_bulk": "boolean", "shipdate": "timestamp_ntz",
}
COLUMNS = list(DTYPES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSY, lineitem=table(spark, sf_dir, "lineitem"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(col(c), digits) for c in doubles})


def on_messy(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(messy(spark, sf_dir))


def on_table(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


def with_sql(body: str, ctes: str = "") -> str:
    """SQL over ``messy``."""
    return f"WITH messy AS ({MESSY.format(lineitem='lineitem')}){ctes} {body}"


def union_sql(parts) -> str:
    return " UNION ALL ".join(parts)


def keyed(*columns: str) -> list[str]:
    return [*KEYS, *columns]


KEY_SQL = ", ".join(KEYS)


def entry(spark: SparkSession) -> DataFrame:
    """Descriptive statistics of every numeric column of the smallest lineitem."""
    return profile.describe_numeric(table(spark, "/root/testdata/sf0.001", "lineitem"))


# ---------------------------------------------------------------------------- queries


def _profile_queries() -> dict[str, Query]:
    def doubled(df: DataFrame) -> DataFrame:
        return profile.duplicate_rows(df.unionAll(df.filter("flag = 'A'")))

    return {
        "overview": on_messy(profile.overview),
        "dataset_info": on_messy(report.dataset_info),
        "missing_by_column": on_messy(profile.missing_by_column),
        "missing_totals": on_messy(profile.missing_totals),
        "missing_matrix": on_messy(lambda d: profile.missing_matrix(d, KEYS)),
        "missing_patterns": on_messy(profile.missing_patterns),
        "duplicate_rows": on_messy(doubled),
        "approx_size": on_table("documents", profile.approx_size),
        "describe_numeric": on_messy(profile.describe_numeric),
        "describe_part": on_table("part", profile.describe_numeric),
        "categorical_top5": on_messy(profile.top_values),
        "categorical_top5_documents": on_table(
            "documents", lambda d: profile.top_values(d, ["lang", "source", "text"])),
        "value_counts": on_messy(lambda d: profile.value_counts(d, "flag")),
        "value_counts_brand": on_table("part", lambda d: profile.value_counts(d, "p_brand")),
        "categorical_stats": on_messy(lambda d: profile.categorical_stats(d, "flag")),
        "skewness": on_messy(profile.skewness),
        "skewed_columns": on_messy(profile.skewed_columns),
        "quality_summary": on_messy(profile.quality_summary),
        "correlation_matrix": on_messy(profile.correlation_matrix),
        "histogram_numeric": on_messy(lambda d: rounded(profile.histogram(d, "price"))),
        "histogram_events": on_table("events", lambda d: rounded(profile.histogram(d, "value"))),
        "distribution_stats": on_messy(lambda d: profile.distribution_stats(d, "price")),
        "outliers_iqr": on_messy(lambda d: profile.outliers_iqr(d, MEASURES)),
        "quantiles": on_messy(lambda d: rounded(
            quantiles.quantiles(d, MEASURES, [0.05, 0.25, 0.5, 0.9, 0.99]))),
        "grid_page": on_messy(lambda d: profile.grid_page(
            d, "flag = 'A' AND quantity > 10", [F.desc("price")], KEYS, page=2)),
        "csv_roundtrip": _csv_roundtrip,
        "profile_report": on_messy(report.profile_report),
        "report_sink": _report_sink,
    }


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    messy(spark, sf_dir).write.option("header", True).csv(path)
    return files.load(spark, path).withColumn("shipdate", F.col("shipdate").cast("timestamp_ntz"))


def _report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report") + ".json"
    report.write_report(messy(spark, sf_dir), path)
    return files.load(spark, path, "section string, column string, stat string, value double")


def _association_queries() -> dict[str, Query]:
    def gross(df: DataFrame) -> DataFrame:
        return df.select("price", "discount", "tax", (F.col("price") * (1 - F.col("discount"))).alias("gross"))

    pairs = [("price", "quantity"), ("price", "flag"), ("flag", "status"), ("is_bulk", "status")]
    return {
        "bivariate_dispatch": on_messy(lambda d: association.bivariate_summary(d, pairs)),
        "pearson_pair": on_messy(
            lambda d: association.pearson_pair(d, "price", "quantity").drop("pearson_p")),
        "spearman_pair": on_messy(
            lambda d: association.spearman_pair(d, "price", "quantity").drop("spearman_p")),
        "pearson_pair_p": on_messy(lambda d: association.pearson_pair(d, "price", "quantity")),
        "spearman_pair_p": on_messy(lambda d: association.spearman_pair(d, "price", "quantity")),
        "group_stats": on_messy(lambda d: association.group_stats(d, "price", "flag")),
        "anova": on_table(
            "orders", lambda d: association.anova(d, "o_totalprice", "o_orderstatus")),
        "crosstab": on_messy(lambda d: association.crosstab(d, "flag", "status", ["F", "O"])),
        "crosstab_all_parts": lambda spark, sf_dir: association.crosstab(
            table(spark, sf_dir, "lineitem"), "l_linenumber", "l_partkey",
            table(spark, sf_dir, "part").select("p_partkey")),
        "crosstab_observed": on_table(
            "lineitem", lambda d: association.crosstab(d, "l_partkey", "l_suppkey")),
        "chi2": on_messy(lambda d: association.chi_square(d, "flag", "status")),
        "chi2_yates": on_messy(
            lambda d: association.chi_square(d, "is_bulk", "status").drop("chi2_p")),
        "chi2_yates_p": on_messy(lambda d: association.chi_square(d, "is_bulk", "status")),
        "vif_approx": on_messy(lambda d: association.vif_approx(d.select(*MEASURES))),
        "vif_flags": on_messy(lambda d: association.vif_flags(gross(d))),
        "eigen_scree": on_messy(
            lambda d: association.eigen_scree(d.select("price", "tax"))),
        "eigen_scree_all": on_messy(association.eigen_scree),
        "eigen_leading": on_messy(
            lambda d: association.leading_eigenvalues(d.select("price", "tax"))),
    }


def _clean_queries() -> dict[str, Query]:
    filled = keyed("quantity", "discount", "flag")

    def impute(strategy: str, **how) -> Query:
        return on_messy(lambda d: rounded(
            clean.impute_missing(d, strategy=strategy, **how)[0].select(*filled)))

    def treated(columns: list[str], *args, **how) -> Query:
        return on_messy(lambda d: rounded(clean.treat_outliers(d, *args, **how)[0].select(*columns)))

    return {
        "impute_mean": impute("mean"),
        "impute_median": impute("median"),
        "impute_mode": impute("mode"),
        "impute_constant": impute("constant", columns=["quantity", "discount"], fill_value=0),
        "impute_drop": impute("drop"),
        "impute_summary": on_messy(lambda d: clean.impute_missing(d, strategy="mean")[1]),
        "missing_change": on_messy(lambda d: clean.missing_change(
            d, clean.impute_missing(d, ["quantity"], "median")[0])),
        "outlier_cap_iqr": treated(keyed("price"), "price", "iqr", "cap"),
        "outlier_cap_zscore": treated(keyed("price"), "price", "zscore", "cap"),
        "outlier_remove": treated(keyed("quantity"), "quantity", "zscore", "remove",
                                  z_threshold=1.5),
        "outlier_flag": treated(keyed("price_outlier"), "price", "iqr", "flag"),
        "outlier_summary": on_messy(lambda d: clean.treat_outliers(d, "price", "iqr", "remove")[1]),
        "zscore_bounds": on_messy(lambda d: clean.treat_outliers(
            d, "quantity", "zscore", "flag", 1.5)[1].select("column", "lower", "upper")),
    }


def _transform_queries() -> dict[str, Query]:
    def tf(name: str, column: str = "value", **how) -> Query:
        def run(df: DataFrame) -> DataFrame:
            shifted = df.withColumn("centred", F.col("value") - 5)
            out, _ = transform.transform_column(shifted, column, name, "out", **how)
            return rounded(out.select("event_id", "out"))
        return on_table("events", run)

    def skews(df: DataFrame) -> DataFrame:
        parts = [transform.transform_column(df, "value", t)[1] for t in ("log1p", "sqrt", "square")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("power")

    return {
        "tf_log1p": tf("log1p"),
        "tf_sqrt": tf("sqrt", "centred"),
        "tf_square": tf("square"),
        "tf_standardize": tf("standardize"),
        "tf_normalize": tf("normalize"),
        "tf_boxcox_fixed": tf("boxcox", power=0.3),
        "tf_yeojohnson_fixed": tf("yeojohnson", "centred", power=0.3),
        "tf_boxcox": tf("boxcox"),
        "tf_yeojohnson": tf("yeojohnson", "centred"),
        "transform_skew_report": on_table("events", skews),
    }


def _encode_queries() -> dict[str, Query]:
    def coded(columns: list[str], *args, **how) -> Query:
        return on_messy(lambda d: rounded(
            encode.encode_categorical(d, *args, **how)[0].select(*columns)))

    return {
        "encode_label": coded(keyed("flag_encoded"), "flag", "label"),
        "encode_onehot": coded(keyed("flag_A", "flag_N", "flag_R"), "flag", "onehot"),
        "encode_onehot_sparse": on_messy(lambda d: encode.encode_categorical(
            d, "flag", "onehot_sparse")[0].select(*KEYS, F.concat_ws(",", F.transform(
                vector_to_array("flag_onehot"), lambda v: v.cast("int").cast("string"))).alias(
                    "flags"))),
        "encode_ordinal": coded(keyed("flag_ordinal"), "flag", "ordinal",
                                ordinal_order=["R", "A"]),
        "encode_ordinal_sorted": coded(keyed("flag_ordinal"), "flag", "ordinal"),
        "encode_frequency": coded(keyed("flag_freq"), "flag", "frequency"),
        "encode_summary": on_messy(lambda d: encode.encode_categorical(d, "flag", "onehot")[1]
                                   .withColumn("new_columns", F.concat_ws(",", "new_columns"))),
    }


def _feature_queries() -> dict[str, Query]:
    def on_measures(run) -> Query:
        return on_messy(lambda d: run(d.select(*MEASURES)))

    def by_flag(df: DataFrame) -> DataFrame:
        return features.select_k_best(df.select(*MEASURES, "flag"), "flag", 2, "classification")

    def interactions(df: DataFrame) -> DataFrame:
        out, names = df, []
        for operation in features.OPERATIONS:
            out, name = features.create_interaction_feature(out, "price", "discount", operation)
            names.append(name)
        return rounded(out.select(*KEYS, *names))

    def polynomial(df: DataFrame) -> DataFrame:
        out, names = features.create_polynomial_features(df, ["quantity", "tax"], 3)
        return rounded(out.select(*KEYS, *[col(c) for c in names]), 8)

    return {
        "feature_pearson": on_measures(lambda d: features.feature_pearson(d, "price")),
        "feature_spearman": on_measures(lambda d: features.feature_spearman(d, "price")),
        "feature_mutual_info": on_measures(
            lambda d: features.feature_mutual_information(d, "price")),
        "feature_mutual_info_class": on_messy(lambda d: features.feature_mutual_information(
            d.select(*MEASURES, "flag"), "flag", "classification")),
        "feature_target_stats": on_measures(lambda d: features.feature_target_stats(d, "price")),
        "feature_target_top": on_measures(lambda d: features.feature_target_stats(
            d, "price", limit=features.TOP_FEATURES)),
        "neighbour_mutual_info": on_table("customer", lambda d:
            information.neighbour_mutual_information(
                d.select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal")),
        "neighbour_mutual_info_class": on_table("customer", lambda d:
            information.neighbour_mutual_information(
                d.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_mktsegment",
                "classification")),
        "variance_selection": on_messy(lambda d: features.select_by_variance(
            d.select("quantity", "discount", "tax", "l_linenumber"), 0.001)),
        "select_k_best_regression": on_measures(
            lambda d: features.select_k_best(d, "price", 2).drop("p_value")),
        "select_k_best_regression_p": on_measures(
            lambda d: features.select_k_best(d, "price", 2)),
        "select_k_best_classification": on_messy(lambda d: by_flag(d)),
        "interaction_features": on_messy(interactions),
        "polynomial_features": on_messy(polynomial),
    }


def _evaluation_queries() -> dict[str, Query]:
    def scored(run) -> Query:
        return on_table("labels", lambda d: run(
            d.withColumn("score", (F.col("doc_id") % 20) / F.lit(20.0))))

    def predicted(run) -> Query:
        return on_messy(lambda d: run(
            d.na.drop(subset=MEASURES).withColumn("thousands", F.col("price") / 1000)
            .withColumn("guess", F.col("quantity") * 1.5)))

    return {
        "eval_classification": on_table(
            "labels", lambda d: evaluate.eval_classification(d, "quality", "toxic")),
        "eval_classification_flags": on_messy(lambda d: evaluate.eval_classification(
            d.withColumn("guess", F.when(F.col("status") == "F", "A").otherwise("N")),
            "flag", "guess")),
        "confusion_matrix": on_messy(lambda d: evaluate.confusion_matrix(
            d.withColumn("guess", F.when(F.col("status") == "F", "A").otherwise("N")),
            "flag", "guess", ["A", "N", "R"])),
        "roc_points": scored(lambda d: rounded(evaluate.roc_points(d, "quality", "score"))),
        "roc_auc": scored(lambda d: evaluate.roc_auc(d, "quality", "score")),
        "roc_auc_bulk": on_messy(lambda d: evaluate.roc_auc(d, "is_bulk", "price")),
        "eval_regression": predicted(lambda d: evaluate.eval_regression(d, "thousands", "guess")),
        "residuals": predicted(
            lambda d: rounded(evaluate.residuals(d, "thousands", "guess", KEYS))),
        "identity_bounds": predicted(
            lambda d: rounded(evaluate.identity_bounds(d, "thousands", "guess"))),
    }


def _chart_queries() -> dict[str, Query]:
    return {
        "missing_bar": on_messy(chartdata.missing_bar),
        "distribution_bars": on_messy(
            lambda d: rounded(chartdata.distribution_bars(d, "quantity"))),
        "distribution_bars_category": on_table(
            "part", lambda d: chartdata.distribution_bars(d, "p_brand")),
        "scatter_bins": on_messy(lambda d: chartdata.scatter_bins(d, "quantity", "price", 10)),
        "scatter_points": on_messy(
            lambda d: rounded(chartdata.scatter_points(d, "quantity", "price", "flag"))),
        "trendline": on_messy(lambda d: chartdata.trendline(d, "quantity", "price", "flag")),
        "box_stats": on_messy(lambda d: chartdata.box_stats(d, "price", "flag")),
        "box_stats_all": on_messy(lambda d: chartdata.box_stats(d, "price")),
        "outlier_points": on_messy(
            lambda d: rounded(chartdata.outlier_points(d, "price", KEYS))),
        "time_series": on_table("events", lambda d: chartdata.time_series(d, "ts", "value")),
        "crosstab_long": on_messy(lambda d: association.crosstab(
            d, "is_bulk", "flag", ["A", "N", "R"])),
    }


REGRESSORS = {
    "linear_regression": "Linear Regression", "ridge": "Ridge", "lasso": "Lasso",
    "random_forest_regressor": "Random Forest", "gradient_boosting_regressor": "Gradient Boosting",
    "decision_tree_regressor": "Decision Tree", "knn_regressor": "KNN", "svr": "SVR",
}
CLASSIFIERS = {
    "logistic_regression": "Logistic Regression", "random_forest_classifier": "Random Forest",
    "gradient_boosting_classifier": "Gradient Boosting",
    "decision_tree_classifier": "Decision Tree", "knn_classifier": "KNN", "svm": "SVM",
}
INPUTS = ["quantity", "discount", "tax"]


def _with_targets(df: DataFrame) -> DataFrame:
    """A numeric and a two-class target that depend on the features."""
    revenue = F.col("quantity") * (1 - F.col("discount"))
    return df.withColumn("revenue", revenue).withColumn(
        "tier", F.when(revenue > 24, "high").when(revenue <= 24, "low"))


def _model_queries() -> dict[str, Query]:
    def trained(name: str, kind: str) -> Query:
        target = "revenue" if kind == "regression" else "tier"

        def run(df: DataFrame) -> DataFrame:
            model = models.train_model(
                _with_targets(df), target, name, kind, feature_cols=INPUTS)
            cv = model.cv_scores
            rows = [("train_samples", float(model.train_samples)),
                    ("test_samples", float(model.test_samples)), *model.metrics.items(),
                    ("cv_mean", cv["mean"]), ("cv_std", cv["std"]),
                    *((f"cv_fold_{i}", s) for i, s in enumerate(cv["scores"]))]
            return df.sparkSession.createDataFrame(rows, "metric string, value double")
        return on_messy(run)

    def simple(name: str) -> Query:
        def run(df: DataFrame) -> DataFrame:
            model = models.fit_all(_with_targets(df), "revenue", name, feature_cols=["quantity"])
            return rounded(models.coefficients(model, df.sparkSession), 4)
        return on_messy(run)

    def predict_linear(df: DataFrame) -> DataFrame:
        model = models.fit_all(
            _with_targets(df), "revenue", "Linear Regression", feature_cols=["quantity"])
        return rounded(model.predict(df).select(*KEYS, "prediction"))

    def vectors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        vec = F.col("embedding").cast("array<double>").alias("vec")
        return (df.select(F.col("vec_id").alias("id"), vec, "label"),
                df.select(F.col("vec_id").alias("qid"), vec))

    def knn_regress(df: DataFrame) -> DataFrame:
        return rounded(knn.average(knn.nearest_neighbours(*vectors(df), k=5)))

    def prepared(df: DataFrame) -> DataFrame:
        data = split.prepare(_with_targets(df), "tier", "classification", INPUTS)
        return rounded(data.rows.groupBy("label").agg(
            F.count("*").alias("n"), *[F.sum(c).alias(n) for c, n in zip(data.inputs, INPUTS)]), 2)

    def split_sizes(df: DataFrame) -> DataFrame:
        source = _with_targets(df)
        by_class = split.mark_test(split.prepare(source, "tier", "classification", INPUTS))
        whole = split.mark_test(split.prepare(source, "revenue", "regression", INPUTS))
        counts = [F.count("*").alias("n"), F.count_if("_test").alias("n_test")]
        return by_class.groupBy(F.col("label").cast("int").alias("label")).agg(*counts).unionByName(
            whole.agg(F.lit(-1).alias("label"), *counts))

    def split_members(df: DataFrame) -> DataFrame:
        data = split.prepare(_with_targets(df), "revenue", "regression", INPUTS)
        return rounded(split.mark_test(data).filter("_test").groupBy(*data.inputs).agg(
            F.count("*").alias("n")).withColumnsRenamed(dict(zip(data.inputs, INPUTS))))

    def cv_scores(df: DataFrame) -> DataFrame:
        data = split.prepare(_with_targets(df), "revenue", "regression", INPUTS)
        found = models.cross_validate(data, "Linear Regression", 5)
        rows = [(i, s, found["mean"], found["std"]) for i, s in enumerate(found["scores"])]
        return df.sparkSession.createDataFrame(
            rows, "fold int, score double, mean double, std double")

    def linear_folds(df: DataFrame) -> DataFrame:
        data = split.prepare(_with_targets(df), "revenue", "regression", ["quantity"])
        rows = [(name, i, score) for name in models.LINEAR_MODELS
                for i, score in enumerate(models.cross_validate(data, name, 5)["scores"])]
        return df.sparkSession.createDataFrame(rows, "model string, fold int, r2 double")

    def test_residuals(df: DataFrame) -> DataFrame:
        model = models.train_model(_with_targets(df), "revenue", "Linear Regression",
                                   feature_cols=["quantity"], cv_folds=0)
        return rounded(model.residuals())

    def test_roc(df: DataFrame) -> DataFrame:
        model = models.train_model(_with_targets(df), "tier", "Logistic Regression",
                                   "classification", feature_cols=INPUTS, cv_folds=0)
        return model.roc()

    def all_confusions(df: DataFrame) -> DataFrame:
        names = ["Logistic Regression", "Random Forest", "Gradient Boosting", "Decision Tree"]
        found = models.train_many(_with_targets(df), "tier", names, "classification",
                                  feature_cols=INPUTS, cv_folds=0)
        return models.compared_rows(found, "confusion")

    def compared(df: DataFrame) -> DataFrame:
        return models.compare_models(
            _with_targets(df), "revenue", models.available_models("regression"),
            feature_cols=INPUTS)

    def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _with_targets(messy(spark, sf_dir))
        model = models.fit_all(df, "tier", "Decision Tree", "classification", INPUTS)
        path = scratch_path(spark, "model")
        modelstore.save_model(model, spark, path)
        again = modelstore.load_model(spark, path)
        first = model.predict(df).select(*KEYS, F.col("prediction_label").alias("before"))
        return again.predict(df).select(
            F.col("prediction_label").alias("after")).groupBy("after").count().join(
            first.groupBy(F.col("before").alias("after")).agg(F.count("*").alias("before")), "after")

    def preview(df: DataFrame) -> DataFrame:
        model = models.fit_all(
            _with_targets(df), "tier", "Logistic Regression", "classification", INPUTS)
        return model.predict(df).select(*KEYS, *INPUTS, "prediction_label").orderBy(
            *KEYS).limit(500)

    def confusion(df: DataFrame) -> DataFrame:
        model = models.train_model(_with_targets(df), "tier", "Decision Tree", "classification",
                                   feature_cols=INPUTS)
        return model.confusion()

    def importances(df: DataFrame) -> DataFrame:
        source = _with_targets(df).select(*INPUTS, "revenue")
        return models.rf_feature_importance(source, "revenue")

    return {
        "prepare_features": on_messy(prepared),
        "split_sizes": on_messy(split_sizes),
        "split_members": on_messy(split_members),
        "linreg_simple": simple("Linear Regression"),
        "ridge_simple": simple("Ridge"),
        "lasso_simple": simple("Lasso"),
        "predict_linear": on_messy(predict_linear),
        "knn_neighbours": on_table(
            "embeddings", lambda d: knn.nearest_neighbours(*vectors(d), k=5)
            .select("qid", "id", "rank")),
        "knn_classify": on_table("embeddings", lambda d: knn.vote(
            knn.nearest_neighbours(*vectors(d), k=5)).drop("votes")),
        "knn_regress": on_table("embeddings", knn_regress),
        "cv_scores": on_messy(cv_scores),
        "linear_folds": on_messy(linear_folds),
        "test_residuals": on_messy(test_residuals),
        "test_roc": on_messy(test_roc),
        "compared_confusions": on_messy(all_confusions),
        "compare_models": on_messy(compared),
        "model_comparison": on_messy(lambda d: chartdata.model_comparison(compared(d), "r2")),
        "model_roundtrip": roundtrip,
        "prediction_preview": on_messy(preview),
        "test_confusion": on_messy(confusion),
        "rf_importance": on_messy(importances),
        "importance_bars": on_messy(lambda d: chartdata.importance_bars(importances(d))),
        **{f"model_{key}": trained(name, "regression") for key, name in REGRESSORS.items()},
        **{f"model_{key}": trained(name, "classification") for key, name in CLASSIFIERS.items()},
    }


def _corpus_queries() -> dict[str, Query]:
    if corpus_queries is None:
        return {}
    return {"pipeline": corpus_pipeline.run, **corpus_queries.QUERIES}


def queries() -> dict[str, Query]:
    return {
        **_profile_queries(), **_association_queries(), **_clean_queries(),
        **_transform_queries(), **_encode_queries(), **_feature_queries(),
        **_evaluation_queries(), **_chart_queries(), **_model_queries(),
        **_corpus_queries(),
    }


# ---------------------------------------------------------------------------- SQL checks


def _missing_sql() -> str:
    return union_sql(
        f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype,"
        f" count(*) - count({c}) AS missing_count,"
        f" round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM messy"
        for i, (c, t) in enumerate(DTYPES.items())
    )


def _describe_sql(columns: list[str], source: str) -> str:
    return union_sql(
        f"SELECT '{c}' AS \"column\", {i} AS position, count({c}) AS \"count\","
        f" round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,"
        f" round(min({c})::DOUBLE, 4) AS min,"
        f" round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25,"
        f" round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50,"
        f" round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75,"
        f" round(max({c})::DOUBLE, 4) AS max FROM {source}"
        for i, c in enumerate(columns)
    )


def _top5_sql(columns: list[str], source: str) -> str:
    # Equal counts are ordered by value.
    return union_sql(
        f"SELECT '{c}' AS \"column\", value, n, rank FROM (SELECT *, row_number() OVER"
        f" (ORDER BY n DESC, value) AS rank FROM (SELECT CAST({c} AS VARCHAR) AS value,"
        f" count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= 5"
        for c in columns
    )


def _skewness_sql() -> str:
    return union_sql(
        f"SELECT '{c}' AS \"column\", {i} AS position, round(skewness({c}), 4) AS skewness"
        f" FROM messy" for i, c in enumerate(NUMERIC)
    )


def _quality_sql() -> str:
    def part(i: int, c: str) -> str:
        kind = "numeric" if c in NUMERIC else "non_numeric"
        skew = f"round(skewness({c}), 4)" if c in NUMERIC else "NULL::DOUBLE"
        distinct = "NULL::BIGINT" if c in NUMERIC else f"count(DISTINCT {c})"
        return (
            f"SELECT '{c}' AS \"column\", {i} AS position, '{kind}' AS kind, count(*) AS n_rows,"
            f" count(*) - count({c}) AS missing_count,"
            f" round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,"
            f" {skew} AS skewness, {distinct} AS cardinality FROM messy"
        )
    return union_sql(part(i, c) for i, c in enumerate(COLUMNS))


def _correlation_sql() -> str:
    return union_sql(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y,"
        f" round(corr({a}::DOUBLE, {b}::DOUBLE), 4) AS r FROM messy"
        for a in NUMERIC for b in NUMERIC
    )


_OVERVIEW_SQL = (
    "SELECT count(*) AS n_rows, 12 AS n_columns, CAST(sum("
    + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in COLUMNS)
    + ") AS BIGINT) AS missing_cells,"
    " count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS duplicate_rows,"
    " round((count(*) * 69 + sum(coalesce(strlen(flag), 0)) + sum(coalesce(strlen(status), 0)))"
    " / 1048576.0::DOUBLE, 4) AS approx_size_mb FROM messy"
)


def _histogram_sql(column: str, source: str, bins: int = 30) -> str:
    return f"""
    s AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
    bins AS (SELECT i AS bin, lo + i * ((hi - lo) / {bins}) AS low,
                    CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END
                    AS high
             FROM s, range({bins}) AS t(i)),
    filled AS (SELECT bin, low, high, count({column}) AS n
               FROM bins LEFT JOIN {source} ON {column} >= low
                    AND ({column} < high OR (bin = {bins - 1} AND {column} <= high))
               GROUP BY bin, low, high)"""


def _melt(row_sql: str, section: str, key: str, stats: list[str]) -> str:
    return union_sql(
        f"SELECT '{section}' AS section, {key} AS \"column\", '{s}' AS stat,"
        f" CAST(\"{s}\" AS DOUBLE) AS value FROM {row_sql}" for s in stats
    )


def _report_sql() -> str:
    ctes = (
        f", ov AS ({_OVERVIEW_SQL}), mi AS ({_missing_sql()}),"
        f" de AS ({_describe_sql(NUMERIC, 'messy')}),"
        f" tp AS ({_top5_sql(['flag', 'status', 'is_bulk'], 'messy')}),"
        f" co AS ({_correlation_sql()}), qu AS ({_quality_sql()})"
    )
    key = '"column"'
    body = union_sql([
        _melt("ov", "overview", "''", ["n_rows", "n_columns", "missing_cells", "duplicate_rows",
                                       "approx_size_mb"]),
        _melt("mi", "overview", key, ["missing_count", "missing_pct"]),
        _melt("de", "summary", key, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
        "SELECT 'summary', \"column\", 'top:' || value, CAST(n AS DOUBLE) FROM tp",
        "SELECT 'correlation', column_x, column_y, r FROM co",
        "SELECT * FROM (" + _melt("qu", "quality", key, [
            "missing_count", "missing_pct", "skewness", "cardinality"]) + ") WHERE value IS NOT NULL",
    ])
    return with_sql(body, ctes)


def _info_sql() -> str:
    ctes = f", ov AS ({_OVERVIEW_SQL}), mi AS ({_missing_sql()})"
    names = ["n_rows", "n_columns", "duplicate_rows", "missing_cells", "approx_size_mb"]
    return with_sql(union_sql([
        *[f"SELECT '{n}' AS item, NULL::VARCHAR AS detail, CAST({n} AS DOUBLE) AS value FROM ov"
          for n in names],
        "SELECT 'missing_count:' || \"column\", dtype, CAST(missing_count AS DOUBLE) FROM mi",
        "SELECT 'missing_pct:' || \"column\", dtype, missing_pct FROM mi",
    ]), ctes)


def _bounds(column: str, source: str = "messy") -> str:
    return (
        f"q AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3"
        f" FROM {source}), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower,"
        f" q3 + 1.5 * (q3 - q1) AS upper FROM q)"
    )


def _outliers_sql() -> str:
    ctes = "".join(
        f", b_{c} AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper"
        f" FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM messy))"
        for c in MEASURES
    )
    return with_sql(union_sql(
        f"SELECT '{c}' AS \"column\", {i} AS position, round(max(q1), 4) AS q1,"
        f" round(max(q3), 4) AS q3, round(max(q3 - q1), 4) AS iqr, round(max(lower), 4) AS lower,"
        f" round(max(upper), 4) AS upper,"
        f" count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS outlier_count,"
        f" round(count(*) FILTER (WHERE {c} < lower OR {c} > upper) * 100.0::DOUBLE / count({c}), 2)"
        f" AS outlier_pct FROM messy, b_{c}"
        for i, c in enumerate(MEASURES)
    ), ctes)


def _profile_sql() -> dict[str, str]:
    total = "count(*) * 12"
    cells = " + ".join(f"(count(*) - count({c}))" for c in COLUMNS)
    flags = [c for c in COLUMNS if c not in KEYS]
    isnull = ", ".join(f"{c} IS NULL AS {c}" for c in flags)
    patterns = ", ".join(f"{c} IS NULL AS {c}" for c in COLUMNS)
    return {
        "overview": with_sql(_OVERVIEW_SQL),
        "dataset_info": _info_sql(),
        "missing_by_column": with_sql(_missing_sql()),
        "missing_totals": with_sql(
            f"SELECT {cells} AS missing_cells, round(({cells}) * 100.0::DOUBLE / ({total}), 2)"
            f" AS missing_pct, round(({cells}) * 100.0::DOUBLE / ({total}), 2) > 5.0 AS alert"
            " FROM messy"),
        "missing_matrix": with_sql(f"SELECT {KEY_SQL}, {isnull} FROM messy"),
        "missing_patterns": with_sql(
            f"SELECT *, count(*) AS row_count FROM (SELECT {patterns} FROM messy) GROUP BY ALL"),
        "duplicate_rows": with_sql(
            "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM doubled))"
            " AS duplicate_rows FROM doubled",
            ", doubled AS (SELECT * FROM messy UNION ALL SELECT * FROM messy WHERE flag = 'A')"),
        "approx_size": "SELECT round((sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source))"
                       " + count(*) * 16) / 1048576.0::DOUBLE, 4) AS approx_size_mb FROM documents",
        "describe_numeric": with_sql(_describe_sql(NUMERIC, "messy")),
        "describe_part": _describe_sql(["p_partkey", "p_size", "p_retailprice"], "part"),
        "categorical_top5": with_sql(_top5_sql(["flag", "status", "is_bulk"], "messy")),
        "categorical_top5_documents": _top5_sql(["lang", "source", "text"], "documents"),
        "value_counts": with_sql(
            "SELECT flag AS value, count(*) AS n FROM messy WHERE flag IS NOT NULL GROUP BY flag"),
        "value_counts_brand": "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand",
        "categorical_stats": with_sql(
            "SELECT count(*) AS unique_values, first(flag ORDER BY n DESC, flag) AS top FROM"
            " (SELECT flag, count(*) AS n FROM messy WHERE flag IS NOT NULL GROUP BY flag)"),
        "skewness": with_sql(_skewness_sql()),
        "skewed_columns": with_sql(f"SELECT * FROM ({_skewness_sql()}) WHERE abs(skewness) > 1"),
        "quality_summary": with_sql(_quality_sql()),
        "correlation_matrix": with_sql(_correlation_sql()),
        "histogram_numeric": with_sql(
            "SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n FROM filled",
            "," + _histogram_sql("price", "messy")),
        "histogram_events": f"WITH {_histogram_sql('value', 'events')} SELECT bin,"
                            " round(low, 6) AS low, round(high, 6) AS high, n FROM filled",
        "distribution_stats": with_sql(
            "SELECT round(avg(price), 4) AS mean, round(quantile_cont(price, 0.5), 4) AS median,"
            " round(stddev_samp(price), 4) AS std, round(min(price), 4) AS min,"
            " round(max(price), 4) AS max FROM messy"),
        "outliers_iqr": _outliers_sql(),
        "quantiles": with_sql(union_sql(
            f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS probability,"
            f" round(quantile_cont({c}, {p}), 6) AS value FROM messy"
            for c in MEASURES for p in (0.05, 0.25, 0.5, 0.9, 0.99))),
        "grid_page": with_sql(
            f"SELECT * FROM messy WHERE flag = 'A' AND quantity > 10"
            f" ORDER BY price DESC, {KEY_SQL} LIMIT 50 OFFSET 100"),
        "csv_roundtrip": with_sql("SELECT * FROM messy"),
        "profile_report": _report_sql(),
        "report_sink": _report_sql(),
    }


def _ranked(column: str) -> str:
    return (f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"
            f" AS {column}")


def _anova_terms(value: str, group: str, source: str) -> str:
    return (
        f"g AS (SELECT {group} AS g, count(*) AS n, avg({value}) AS m, var_pop({value}) AS v"
        f" FROM {source} GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n,"
        f" sum(n * m) / sum(n) AS mean FROM g), f AS (SELECT t.k, t.n,"
        f" (sum(g.n * (g.m - t.mean) ** 2) / (t.k - 1)) / (sum(g.n * g.v) / (t.n - t.k)) AS f"
        f" FROM g, t GROUP BY t.k, t.n)"
    )


def _crosstab_sql(x: str, y: str) -> str:
    return with_sql(
        "SELECT CAST(xs.x AS VARCHAR) AS x, CAST(ys.y AS VARCHAR) AS y, coalesce(n, 0) AS n"
        " FROM xs CROSS JOIN ys LEFT JOIN c ON c.x = xs.x AND c.y = ys.y",
        _cells_sql(x, y))


def _cells_sql(x: str, y: str) -> str:
    return (
        f", c AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM messy WHERE {x} IS NOT NULL"
        f" AND {y} IS NOT NULL GROUP BY ALL), xs AS (SELECT x, sum(n) AS nx FROM c GROUP BY x),"
        f" ys AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), total AS (SELECT sum(n) AS n FROM c),"
        f" e AS (SELECT coalesce(c.n, 0) AS o, nx * ny / total.n::DOUBLE AS e FROM xs CROSS JOIN ys"
        f" CROSS JOIN total LEFT JOIN c ON c.x = xs.x AND c.y = ys.y)"
    )


def _vif_sql(columns: list[str], source: str, extra: str = "") -> str:
    def strongest(c: str) -> str:
        others = [f"abs(corr({c}, {o}))" for o in columns if o != c]
        return f"greatest({', '.join(others)})" if len(others) > 1 else others[0]
    return union_sql(
        f"SELECT \"column\", CASE WHEN r * r < 1 THEN round(1 / (1 - r * r), 4)"
        f" ELSE 'inf'::DOUBLE END AS vif{extra} FROM"
        f" (SELECT '{c}' AS \"column\", {strongest(c)} AS r FROM {source})" for c in columns
    )


def _association_sql() -> dict[str, str]:
    complete = ", complete AS (SELECT * FROM messy WHERE {})"
    measures = complete.format(" AND ".join(f"{c} IS NOT NULL" for c in MEASURES))
    gross = (", gross AS (SELECT price, discount, tax, price * (1 - discount) AS gross FROM messy"
             " WHERE discount IS NOT NULL)")
    eig = ("SELECT pc, round(v, 4) AS eigenvalue, round(v / 2 * 100, 2) AS explained_pct,"
           " round(sum(round(v / 2 * 100, 2)) OVER (ORDER BY pc), 2) AS cumulative_pct FROM"
           " (SELECT 1 AS pc, 1 + abs(corr(price, tax)) AS v FROM messy UNION ALL"
           " SELECT 2, 1 - abs(corr(price, tax)) FROM messy)")
    return {
        "pearson_pair": with_sql(
            "SELECT count(*) AS n, round(corr(price, quantity), 4) AS pearson_r FROM messy"
            " WHERE price IS NOT NULL AND quantity IS NOT NULL"),
        "spearman_pair": with_sql(
            "SELECT count(*) AS n, round(corr(price, quantity), 4) AS spearman_r FROM"
            f" (SELECT {_ranked('price')}, {_ranked('quantity')} FROM messy"
            " WHERE quantity IS NOT NULL)"),
        "group_stats": with_sql(
            "SELECT flag AS category, count(*) AS n, round(avg(price), 4) AS mean,"
            " round(quantile_cont(price, 0.5), 4) AS median, round(stddev_samp(price), 4) AS std"
            " FROM messy WHERE flag IS NOT NULL GROUP BY flag"),
        "anova": f"WITH {_anova_terms('o_totalprice', 'o_orderstatus', 'orders')}"
                 " SELECT k AS groups, CAST(n AS BIGINT) AS n, round(f, 4) AS anova_f,"
                 " round((1 + 2 * f / (n - k)) ** (-(n - k) / 2.0), 6) AS anova_p FROM f",
        "crosstab": _crosstab_sql("flag", "status"),
        "crosstab_all_parts": "SELECT CAST(a.x AS VARCHAR) AS x, CAST(b.y AS VARCHAR) AS y,"
                              " coalesce(n, 0) AS n FROM (SELECT DISTINCT l_linenumber AS x FROM"
                              " lineitem) a CROSS JOIN (SELECT DISTINCT p_partkey AS y FROM part) b"
                              " LEFT JOIN (SELECT l_linenumber AS x, l_partkey AS y, count(*) AS n"
                              " FROM lineitem GROUP BY ALL) c ON c.x = a.x AND c.y = b.y",
        "crosstab_observed": "SELECT CAST(l_partkey AS VARCHAR) AS x, CAST(l_suppkey AS VARCHAR)"
                             " AS y, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey",
        "crosstab_long": _crosstab_sql("is_bulk", "flag"),
        "chi2": with_sql(
            "SELECT CAST(sum(o) AS BIGINT) AS n, 2 AS dof, round(sum((o - e) ** 2 / e), 4) AS chi2,"
            " round(exp(-sum((o - e) ** 2 / e) / 2), 6) AS chi2_p FROM e",
            _cells_sql("flag", "status")),
        "chi2_yates": with_sql(
            "SELECT CAST(sum(o) AS BIGINT) AS n, 1 AS dof,"
            " round(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e), 4) AS chi2 FROM e",
            _cells_sql("is_bulk", "status")),
        "vif_approx": with_sql(_vif_sql(MEASURES, "complete"), measures),
        "vif_flags": with_sql(
            f"SELECT *, vif > 5 AS multicollinear FROM"
            f" ({_vif_sql(['price', 'discount', 'tax', 'gross'], 'gross')})", gross),
        "eigen_scree": with_sql(eig),
        "eigen_leading": with_sql(f"SELECT pc, eigenvalue, explained_pct FROM ({eig})"),
    }


def _clean_sql() -> dict[str, str]:
    def fill(quantity: str, discount: str, flag: str = "flag") -> str:
        return with_sql(f"SELECT {KEY_SQL}, round(coalesce(quantity, {quantity}), 6) AS quantity,"
                        f" round(coalesce(discount, {discount}), 6) AS discount,"
                        f" {flag} AS flag FROM messy")

    def one(expr: str) -> str:
        return f"(SELECT {expr} FROM messy)"

    def top(c: str) -> str:
        return (f"(SELECT {c} FROM messy WHERE {c} IS NOT NULL GROUP BY {c}"
                f" ORDER BY count(*) DESC, {c} LIMIT 1)")

    z = ("b AS (SELECT avg({c}) - {t} * stddev_samp({c}) AS lower,"
         " avg({c}) + {t} * stddev_samp({c}) AS upper FROM messy)")
    capped = (f"SELECT {KEY_SQL}, round(CASE WHEN price < lower THEN lower WHEN price > upper"
              " THEN upper ELSE price END, 6) AS price FROM messy, b")
    missing = union_sql(
        f"SELECT '{c}' AS \"column\", 'mean' AS strategy, count(*) - count({c}) AS missing_before,"
        f" {after} AS missing_after FROM messy"
        for c, after in (("quantity", "0"), ("discount", "0"), ("flag", "count(*) - count(flag)")))
    change = union_sql(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_before,"
        f" {after} AS missing_after FROM messy"
        for c, after in (("quantity", "0"), ("discount", "count(*) - count(discount)"),
                         ("flag", "count(*) - count(flag)")))
    return {
        "impute_mean": fill(one("avg(quantity)"), one("avg(discount)")),
        "impute_median": fill(one("median(quantity)"), one("median(discount)")),
        "impute_mode": fill(top("quantity"), top("discount"), f"coalesce(flag, {top('flag')})"),
        "impute_constant": fill("0", "0"),
        "impute_drop": with_sql(
            f"SELECT {KEY_SQL}, round(quantity, 6) AS quantity, round(discount, 6) AS discount,"
            " flag FROM messy WHERE quantity IS NOT NULL AND discount IS NOT NULL"
            " AND flag IS NOT NULL"),
        "impute_summary": with_sql(missing),
        "missing_change": with_sql(change),
        "outlier_cap_iqr": with_sql(capped, "," + _bounds("price")),
        "outlier_cap_zscore": with_sql(capped, "," + z.format(c="price", t="3")),
        "outlier_remove": with_sql(
            f"SELECT {KEY_SQL}, round(quantity, 6) AS quantity FROM messy, b"
            " WHERE quantity IS NULL OR (quantity >= lower AND quantity <= upper)",
            "," + z.format(c="quantity", t="1.5")),
        "outlier_flag": with_sql(
            f"SELECT {KEY_SQL}, CASE WHEN price < lower OR price > upper THEN 1 ELSE 0 END"
            " AS price_outlier FROM messy, b", "," + _bounds("price")),
        "outlier_summary": with_sql(
            "SELECT 'price' AS \"column\", 'iqr' AS method, 'remove' AS action,"
            " round(max(lower), 4) AS lower, round(max(upper), 4) AS upper,"
            " count(*) FILTER (WHERE price < lower OR price > upper) AS outliers_found,"
            " count(*) FILTER (WHERE NOT (price < lower OR price > upper)) AS rows_after"
            " FROM messy, b", "," + _bounds("price")),
        "zscore_bounds": with_sql(
            "SELECT 'quantity' AS \"column\", round(lower, 4) AS lower, round(upper, 4) AS upper"
            " FROM b", "," + z.format(c="quantity", t="1.5")),
    }


def _transform_sql() -> dict[str, str]:
    def tf(expr: str) -> str:
        return (f"WITH e AS (SELECT event_id, value, value - 5 AS x FROM events), s AS (SELECT"
                " avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi"
                f" FROM events) SELECT event_id, round({expr}, 6) AS out FROM e, s")

    formulas = {"log1p": "ln(1 + value)", "sqrt": "sqrt(value)", "square": "value * value"}
    return {
        "tf_log1p": tf("ln(1 + value)"),
        "tf_sqrt": tf("sqrt(CASE WHEN x < 0 THEN 0 ELSE x END)"),
        "tf_square": tf("value * value"),
        "tf_standardize": tf("(value - m) / sd"),
        "tf_normalize": tf("(value - lo) / (hi - lo)"),
        "tf_boxcox_fixed": tf("CASE WHEN value > 0 THEN (value ** 0.3 - 1) / 0.3 END"),
        "tf_yeojohnson_fixed": tf(
            "CASE WHEN x >= 0 THEN ((x + 1) ** 0.3 - 1) / 0.3"
            " ELSE -((1 - x) ** 1.7 - 1) / 1.7 END"),
        "transform_skew_report": union_sql(
            f"SELECT 'value' AS \"column\", 'value_{t}' AS output_column, '{t}' AS transformation,"
            f" round(skewness(value), 4) AS skew_before, round(skewness({e}), 4) AS skew_after"
            " FROM events" for t, e in formulas.items()),
    }


def _encode_sql() -> dict[str, str]:
    codes = ", codes AS (SELECT flag, row_number() OVER (ORDER BY flag) - 1 AS code FROM (SELECT"
    codes += " DISTINCT flag FROM messy WHERE flag IS NOT NULL))"
    shares = (", shares AS (SELECT flag, count(*) / (SELECT count(flag) FROM messy)::DOUBLE AS share"
              " FROM messy WHERE flag IS NOT NULL GROUP BY flag)")
    hot = ", ".join(f"CASE WHEN flag = '{v}' THEN 1 ELSE 0 END AS flag_{v}" for v in "ANR")
    return {
        "encode_label": with_sql(
            f"SELECT {KEY_SQL}, coalesce(code, -1) AS flag_encoded FROM messy LEFT JOIN codes"
            " USING (flag)", codes),
        "encode_onehot": with_sql(f"SELECT {KEY_SQL}, {hot} FROM messy"),
        "encode_onehot_sparse": with_sql(
            f"SELECT {KEY_SQL}, concat_ws(',', flag_A, flag_N, flag_R) AS flags FROM"
            f" (SELECT {KEY_SQL}, {hot} FROM messy)"),
        "encode_ordinal": with_sql(
            f"SELECT {KEY_SQL}, CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END AS flag_ordinal"
            " FROM messy"),
        "encode_ordinal_sorted": with_sql(
            f"SELECT {KEY_SQL}, code AS flag_ordinal FROM messy LEFT JOIN codes USING (flag)",
            codes),
        "encode_frequency": with_sql(
            f"SELECT {KEY_SQL}, round(share, 6) AS flag_freq FROM messy LEFT JOIN shares"
            " USING (flag)", shares),
        "encode_summary": with_sql(
            "SELECT 'flag' AS \"column\", 'onehot' AS method, 'flag_A,flag_N,flag_R' AS new_columns,"
            " count(DISTINCT flag) AS unique_values FROM messy"),
    }


def _information_sql(target: str, target_bin: str, names: list[str], source: str) -> str:
    edges = "[" + ", ".join(str(i / 20) for i in range(1, 20)) + "]"

    def bin_of(c: str) -> str:
        return (f"len(list_filter((SELECT list_distinct(quantile_cont({c}, {edges})) FROM {source}),"
                f" lambda z: z < {c}))")
    parts = []
    for i, c in enumerate(names):
        y = bin_of(target) if target_bin == "binned" else target
        parts.append(
            f"SELECT '{c}' AS feature, {i} AS position, round(sum(n / t * ln(n * t / (nx * ny))), 4)"
            f" AS mutual_info FROM (SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t,"
            f" sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE"
            f" AS ny FROM (SELECT {bin_of(c)} AS x, {y} AS y, count(*) AS n FROM {source}"
            f" GROUP BY 1, 2))")
    return union_sql(parts)


def _feature_sql() -> dict[str, str]:
    names = ["quantity", "discount", "tax"]
    complete = (", complete AS (SELECT quantity, price, discount, tax FROM messy WHERE quantity"
                " IS NOT NULL AND discount IS NOT NULL)")
    flagged = (", flagged AS (SELECT quantity, price, discount, tax, flag FROM messy WHERE quantity"
               " IS NOT NULL AND discount IS NOT NULL AND flag IS NOT NULL)")
    ranks = ", ranks AS (SELECT " + ", ".join(_ranked(c) for c in MEASURES) + " FROM complete)"

    def scores(stat: str, source: str) -> str:
        return union_sql(
            f"SELECT '{c}' AS feature, {i} AS position, round(corr({c}, price), 4) AS {stat}"
            f" FROM {source}" for i, c in enumerate(names))

    regression = (
        "SELECT feature, position, round(r * r / (1 - r * r) * (n - 2), 4) AS score,"
        " row_number() OVER (ORDER BY r * r DESC, position) <= 2 AS selected FROM ("
        + union_sql(f"SELECT '{c}' AS feature, {i} AS position, corr({c}, price) AS r,"
                    f" count(*) AS n FROM complete" for i, c in enumerate(names)) + ")")
    by_class = ("SELECT feature, position, round(f, 4) AS score,"
                " round((1 + 2 * f / (n - k)) ** (-(n - k) / 2.0), 6) AS p_value,"
                " row_number() OVER (ORDER BY f DESC, position) <= 2 AS selected FROM ("
                + union_sql(
                    f"SELECT '{c}' AS feature, {i} AS position, k, n, f FROM"
                    f" (WITH {_anova_terms(c, 'flag', 'flagged')} SELECT * FROM f)"
                    for i, c in enumerate(MEASURES)) + ")")
    variance = union_sql(
        f"SELECT '{c}' AS \"column\", {i} AS position, round(var_samp({c}), 4) AS variance,"
        f" round(var_pop(coalesce({c}, 0)), 4) AS tested_variance,"
        f" var_pop(coalesce({c}, 0)) > 0.001 AS selected FROM messy"
        for i, c in enumerate(["quantity", "discount", "tax", "l_linenumber"]))
    polynomial = ", ".join(
        f'round({c} ** {d}, 8) AS "{c}^{d}"' for c in ("quantity", "tax") for d in (2, 3))
    information = _information_sql("price", "binned", names, "complete")
    return {
        "feature_pearson": with_sql(scores("pearson", "complete"), complete),
        "feature_spearman": with_sql(scores("spearman", "ranks"), complete + ranks),
        "feature_mutual_info": with_sql(information, complete),
        "feature_mutual_info_class": with_sql(
            _information_sql("flag", "class", MEASURES, "flagged"), flagged),
        "feature_target_stats": with_sql(
            f"SELECT feature, p.position, pearson, spearman, mutual_info FROM"
            f" ({scores('pearson', 'complete')}) p JOIN ({scores('spearman', 'ranks')}) s"
            f" USING (feature) JOIN ({information}) i USING (feature)", complete + ranks),
        "feature_target_top": with_sql(
            f"SELECT feature, p.position, pearson, spearman, mutual_info FROM"
            f" ({scores('pearson', 'complete')}) p JOIN ({scores('spearman', 'ranks')}) s"
            f" USING (feature) JOIN ({information}) i USING (feature)"
            f" ORDER BY abs(pearson) DESC, feature LIMIT {features.TOP_FEATURES}", complete + ranks),
        "variance_selection": with_sql(variance),
        "select_k_best_regression": with_sql(regression, complete),
        "select_k_best_classification": with_sql(by_class, flagged),
        "interaction_features": with_sql(
            f"SELECT {KEY_SQL}, round(price * discount, 6) AS price_multiply_discount,"
            " round(price / nullif(discount, 0), 6) AS price_divide_discount,"
            " round(price + discount, 6) AS price_add_discount,"
            " round(price - discount, 6) AS price_subtract_discount FROM messy"),
        "polynomial_features": with_sql(
            f'SELECT {KEY_SQL}, {polynomial}, round(quantity * tax, 8) AS "quantity*tax"'
            " FROM messy"),
    }


def _class_sql(source: str) -> str:
    return f"""WITH p AS ({source}), c AS (SELECT y AS c FROM p UNION SELECT g FROM p),
    k AS (SELECT c.c, (SELECT count(*) FROM p WHERE y = c.c) AS support,
                 (SELECT count(*) FROM p WHERE g = c.c) AS predicted,
                 (SELECT count(*) FROM p WHERE y = c.c AND g = c.c) AS hits FROM c),
    s AS (SELECT *, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS prec,
                 coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS rec FROM k)
    SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support)::DOUBLE, 4) AS accuracy,
           round(sum(prec * support) / sum(support), 4) AS precision_weighted,
           round(sum(rec * support) / sum(support), 4) AS recall_weighted,
           round(sum(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) * support)
                 / sum(support), 4) AS f1_weighted FROM s"""


def _evaluation_sql() -> dict[str, str]:
    flags = (f"SELECT flag AS y, CASE WHEN status = 'F' THEN 'A' ELSE 'N' END AS g FROM"
             f" ({MESSY.format(lineitem='lineitem')}) WHERE flag IS NOT NULL")
    steps = """WITH r AS (SELECT (doc_id % 20) / 20.0::DOUBLE AS score, quality FROM labels),
    g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS pos,
                 count(*) FILTER (WHERE quality = 0) AS neg FROM r GROUP BY score),
    w AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, lead(pos) OVER d AS np,
                 lead(neg) OVER d AS nn, row_number() OVER d AS i, sum(pos) OVER () AS allp,
                 sum(neg) OVER () AS alln FROM g WINDOW d AS (ORDER BY score DESC))"""
    auc = """, g AS (SELECT score, count(*) FILTER (WHERE hit) AS pos,
                            count(*) FILTER (WHERE NOT hit) AS neg FROM r GROUP BY score),
    w AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING), 0) AS above FROM g)
    SELECT round(CAST(sum(neg * (above + pos / 2.0::DOUBLE)) AS DOUBLE)
           / (sum(pos) * sum(neg))::DOUBLE, 4) AS roc_auc FROM w"""
    complete = (", p AS (SELECT *, price / 1000 AS y, 1.5::DOUBLE * quantity AS g FROM messy"
                " WHERE quantity IS NOT NULL AND discount IS NOT NULL)")
    return {
        "eval_classification": _class_sql("SELECT quality AS y, toxic AS g FROM labels"),
        "eval_classification_flags": _class_sql(flags),
        "confusion_matrix": f"""WITH p AS ({flags}), c AS (SELECT y AS c FROM p UNION
            SELECT g FROM p) SELECT a.c AS actual, b.c AS predicted,
            (SELECT count(*) FROM p WHERE y = a.c AND g = b.c) AS n FROM c a CROSS JOIN c b""",
        "roc_points": steps + """ SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr,
            0.0::DOUBLE AS tpr UNION ALL SELECT score, round(fp / alln::DOUBLE, 6),
            round(tp / allp::DOUBLE, 6) FROM w WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg""",
        "roc_auc": "WITH r AS (SELECT (doc_id % 20) / 20.0::DOUBLE AS score, quality = 1 AS hit"
                   " FROM labels)" + auc,
        "roc_auc_bulk": f"WITH r AS (SELECT price AS score, is_bulk AS hit FROM"
                        f" ({MESSY.format(lineitem='lineitem')}))" + auc,
        "eval_regression": with_sql(
            "SELECT count(*) AS n, round(avg(abs(y - g)), 4) AS mae,"
            " round(avg((y - g) ** 2), 4) AS mse, round(sqrt(avg((y - g) ** 2)), 4) AS rmse,"
            " round(1 - sum((y - g) ** 2) / (var_pop(y) * count(*)), 4) AS r2,"
            " round(avg(abs((y - g) / CASE WHEN y = 0 THEN 1 ELSE y END)) * 100, 4) AS mape FROM p",
            complete),
        "residuals": with_sql(
            f"SELECT {KEY_SQL}, round(y, 6) AS y_test, round(g, 6) AS y_pred,"
            " round(y - g, 6) AS residual FROM p", complete),
        "identity_bounds": with_sql(
            "SELECT round(least(min(y), min(g)), 6) AS low, round(greatest(max(y), max(g)), 6)"
            " AS high FROM p", complete),
    }


def _chart_sql() -> dict[str, str]:
    grid = """, s AS (SELECT min(quantity) AS lx, max(quantity) AS hx, min(price) AS ly,
        max(price) AS hy FROM messy WHERE quantity IS NOT NULL),
    e AS (SELECT list_transform(range(1, 10), lambda i: lx + i * ((hx - lx) / 10)) AS ex,
                 list_transform(range(1, 10), lambda i: ly + i * ((hy - ly) / 10)) AS ey FROM s)"""
    box = """, q AS (SELECT {g} AS g, quantile_cont(price, 0.25) AS q1,
        quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM messy {w} GROUP BY 1),
    f AS (SELECT messy.price, q.*, price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)
          AS inside FROM messy JOIN q ON q.g = {g})"""
    stats = ("count(*) AS n, round(min(price) FILTER (WHERE inside), 4) AS whisker_low,"
             " round(max(q1), 4) AS q1, round(max(q2), 4) AS median, round(max(q3), 4) AS q3,"
             " round(max(price) FILTER (WHERE inside), 4) AS whisker_high,"
             " count(*) FILTER (WHERE NOT inside) AS outliers FROM f")
    return {
        "missing_bar": with_sql(
            f'SELECT "column", missing_pct FROM ({_missing_sql()}) WHERE missing_pct > 0'),
        "distribution_bars": with_sql(
            "SELECT bin, round((low + high) / 2, 6) AS midpoint, n FROM filled",
            "," + _histogram_sql("quantity", "messy")),
        "distribution_bars_category": "SELECT p_brand AS value, count(*) AS n FROM part"
                                      " GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
        "scatter_bins": with_sql(
            "SELECT len(list_filter(ex, lambda z: z <= quantity)) AS x_bin,"
            " len(list_filter(ey, lambda z: z <= price)) AS y_bin, count(*) AS n FROM messy, e"
            " WHERE quantity IS NOT NULL GROUP BY 1, 2", grid),
        "scatter_points": with_sql(
            "SELECT round(quantity, 6) AS quantity, round(price, 6) AS price, flag FROM messy"
            " WHERE quantity IS NOT NULL"),
        "trendline": with_sql(
            "SELECT flag AS color, count(*) AS n, round(regr_slope(price, quantity), 4) AS slope,"
            " round(regr_intercept(price, quantity), 4) AS intercept,"
            " round(regr_r2(price, quantity), 4) AS r2 FROM messy"
            " WHERE quantity IS NOT NULL GROUP BY flag"),
        "box_stats": with_sql(f'SELECT g AS "group", {stats} GROUP BY g',
                              box.format(g="flag", w="WHERE flag IS NOT NULL")),
        "box_stats_all": with_sql(f"SELECT {stats}", box.format(g="1", w="")),
        "outlier_points": with_sql(
            f"SELECT {KEY_SQL}, round(price, 6) AS value, CASE WHEN price > upper THEN 'above'"
            " ELSE 'below' END AS side FROM messy, b WHERE price < lower OR price > upper",
            "," + _bounds("price")),
        "time_series": "SELECT date_trunc('day', ts) AS x, round(avg(value), 4) AS y,"
                       " count(value) AS n FROM events GROUP BY 1",
    }


def _model_sql() -> dict[str, str]:
    complete = """, p AS (SELECT *, quantity * (1 - discount) AS revenue,
        CASE WHEN quantity * (1 - discount) > 24 THEN 0 ELSE 1 END AS tier FROM messy
        WHERE quantity IS NOT NULL AND discount IS NOT NULL),
    s AS (SELECT avg(quantity) AS mx, avg(revenue) AS my, count(*) AS n,
                 regr_sxy(revenue, quantity) AS sxy, regr_sxx(revenue, quantity) AS sxx FROM p)"""

    def line(slope: str) -> str:
        return with_sql(f"SELECT 'intercept' AS term, round(my - {slope} * mx, 4) AS value FROM s"
                        f" UNION ALL SELECT 'quantity', round({slope}, 4) FROM s", complete)

    near = """WITH d AS (SELECT q.vec_id AS qid, t.vec_id AS id, t.label,
        round(sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], t.embedding::DOUBLE[]),
              lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS distance
        FROM embeddings q CROSS JOIN embeddings t),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d),
    n AS (SELECT * FROM r WHERE rank <= 5)"""
    sizes = """, c AS (SELECT tier AS label, count(*) AS n FROM p GROUP BY tier),
    t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS want
          FROM c),
    f AS (SELECT label, c.n, floor(t.want * c.n / t.n::DOUBLE) AS base,
                 t.want * c.n / t.n::DOUBLE - floor(t.want * c.n / t.n::DOUBLE) AS rest FROM c, t),
    o AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS i FROM f)
    SELECT label, n, CAST(base + CASE WHEN i <= (SELECT want FROM t) - (SELECT sum(base) FROM f)
           THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM o
    UNION ALL SELECT -1, n, want FROM t"""
    members = """, k AS (SELECT quantity, discount, tax, concat_ws('|', quantity, discount, tax,
        revenue, row_number() OVER (PARTITION BY quantity, discount, tax, revenue)) AS key FROM p),
    i AS (SELECT *, CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) AS id FROM k),
    h AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY
          CAST('0x' || substr(md5('42:' || id), 1, 13) AS BIGINT)) AS place FROM i)"""
    # Rows of the one feature with their fold and their place in the split.
    alone = """, k AS (SELECT quantity AS x, revenue AS y, concat_ws('|', quantity, revenue,
        row_number() OVER (PARTITION BY quantity, revenue)) AS key FROM p),
    i AS (SELECT *, CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) AS id FROM k),
    h AS (SELECT *, CAST('0x' || substr(md5('43:' || id), 1, 13) AS BIGINT) % 5 AS fold,
          row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || id), 1, 13) AS BIGINT))
            <= ceil(count(*) OVER () * 0.2::DOUBLE) AS test FROM i)"""
    slopes = " UNION ALL ".join(
        f"SELECT '{name}' AS model, f AS fold, mx, my, {slope} AS b FROM t" for name, slope in (
            ("Linear Regression", "sxy / sxx"), ("Ridge", "sxy / (sxx + 1)"),
            ("Lasso", "sign(sxy) * greatest(abs(sxy) / n - 1, 0) / (sxx / n)")))
    folds = alone + f""", t AS (SELECT f, avg(x) AS mx, avg(y) AS my, count(*) AS n,
        regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx
        FROM h, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY f),
    l AS ({slopes})"""
    return {
        "linear_folds": with_sql(
            "SELECT model, CAST(l.fold AS INT) AS fold, round(1 - sum((y - my - b * (x - mx)) ** 2)"
            " / (var_pop(y) * count(*)), 4) AS r2 FROM h JOIN l ON l.fold = h.fold"
            " GROUP BY model, l.fold", complete + folds),
        "test_residuals": with_sql(
            "SELECT round(y, 6) AS y_test, round(my + b * (x - mx), 6) AS y_pred,"
            " round(y - my - b * (x - mx), 6) AS residual FROM h, (SELECT avg(x) AS mx, avg(y) AS my,"
            " regr_slope(y, x) AS b FROM h WHERE NOT test) WHERE test", complete + alone),
        "prepare_features": with_sql(
            "SELECT CAST(tier AS DOUBLE) AS label, count(*) AS n, round(sum(quantity), 2)"
            " AS quantity, round(sum(discount), 2) AS discount, round(sum(tax), 2) AS tax FROM p"
            " GROUP BY tier", complete),
        "split_sizes": with_sql("", complete + sizes),
        "split_members": with_sql(
            "SELECT round(quantity, 6) AS quantity, round(discount, 6) AS discount,"
            " round(tax, 6) AS tax, count(*) AS n FROM h WHERE place <= ceil(total * 0.2::DOUBLE)"
            " GROUP BY 1, 2, 3", complete + members),
        "linreg_simple": line("sxy / sxx"),
        "ridge_simple": line("sxy / (sxx + 1)"),
        "lasso_simple": line("sign(sxy) * greatest(abs(sxy) / n - 1, 0) / (sxx / n)"),
        "predict_linear": with_sql(
            f"SELECT {KEY_SQL}, round(my - sxy / sxx * mx + sxy / sxx * coalesce(quantity, 0), 6)"
            " AS prediction FROM messy, s", complete),
        "knn_neighbours": near + " SELECT qid, id, rank FROM n",
        "knn_classify": near + """, v AS (SELECT qid, label, count(*) AS votes FROM n GROUP BY ALL)
            SELECT qid, CAST(first(label ORDER BY votes DESC, label) AS DOUBLE) AS prediction
            FROM v GROUP BY qid""",
        "knn_regress": near + " SELECT qid, round(avg(label), 6) AS prediction FROM n GROUP BY qid",
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_model_sql(),
        **_profile_sql(), **_association_sql(), **_clean_sql(), **_transform_sql(),
        **_encode_sql(), **_feature_sql(), **_evaluation_sql(), **_chart_sql(),
        **(corpus_queries.SQL if corpus_queries else {}),
    }
