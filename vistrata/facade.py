"""One object per table: every operator as a method, cleaning steps chain."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from vistrata.operators import (
    association, chartdata, clean, encode, features, information, models, profile, transform,
)
from vistrata.sources import files, report


class Profile:
    """An immutable wrapper around a DataFrame.

    Statistics come back as DataFrames (or dictionaries of DataFrames); cleaning
    methods return a new ``Profile`` over the changed table.
    """

    def __init__(self, df: DataFrame) -> None:
        self._df = df

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, **options) -> Profile:
        return cls(files.load(spark, path, **options))

    @classmethod
    def from_pandas(cls, spark: SparkSession, frame) -> Profile:
        return cls(files.from_pandas(spark, frame))

    @property
    def df(self) -> DataFrame:
        return self._df

    # -- statistics -------------------------------------------------------------

    def overview(self) -> DataFrame:
        return profile.overview(self._df)

    def missing(self) -> DataFrame:
        return profile.missing_by_column(self._df)

    def missing_matrix(self) -> DataFrame:
        return profile.missing_matrix(self._df)

    def missing_patterns(self) -> DataFrame:
        return profile.missing_patterns(self._df)

    def summary_stats(self) -> dict[str, DataFrame]:
        return {"numeric": profile.describe_numeric(self._df),
                "categorical": profile.top_values(self._df)}

    def correlation(self) -> DataFrame:
        return profile.correlation_matrix(self._df)

    def column_analysis(self, column: str) -> dict[str, DataFrame]:
        return profile.column_distribution(self._df, column)

    def outliers(self, column: str) -> DataFrame:
        return profile.outliers_iqr(self._df, column)

    def bivariate(self, x: str, y: str) -> dict[str, Any]:
        return association.bivariate(self._df, x, y)

    def multivariate_summary(self) -> dict[str, DataFrame]:
        return {"vif": association.vif_flags(self._df),
                "scree": association.eigen_scree(self._df)}

    def preprocessing_summary(self) -> DataFrame:
        return profile.quality_summary(self._df)

    def page(self, **how) -> DataFrame:
        return profile.grid_page(self._df, **how)

    # -- cleaning ---------------------------------------------------------------

    def impute(
        self, columns: list[str] | None = None, strategy: str = "mean", fill_value: Any = 0
    ) -> Profile:
        return Profile(clean.impute_missing(self._df, columns, strategy, fill_value)[0])

    def treat_outliers(
        self, column: str, method: str = "iqr", action: str = "cap", z_threshold: float = 3.0
    ) -> Profile:
        return Profile(clean.treat_outliers(self._df, column, method, action, z_threshold)[0])

    def transform(
        self, column: str, transformation: str, output_column: str | None = None
    ) -> Profile:
        return Profile(
            transform.transform_column(self._df, column, transformation, output_column)[0])

    def encode(
        self, column: str, method: str = "label", ordinal_order: list | None = None,
        drop_original: bool = True,
    ) -> Profile:
        return Profile(
            encode.encode_categorical(self._df, column, method, ordinal_order, drop_original)[0])

    def polynomial(
        self, columns: list[str], degree: int = 2, include_interaction: bool = True
    ) -> Profile:
        return Profile(features.create_polynomial_features(
            self._df, columns, degree, include_interaction)[0])

    def interaction(self, col1: str, col2: str, operation: str = "multiply") -> Profile:
        return Profile(features.create_interaction_feature(self._df, col1, col2, operation)[0])

    # -- features and models ----------------------------------------------------

    def feature_target_stats(self, target: str, problem_type: str = "regression") -> DataFrame:
        return features.feature_target_stats(self._df, target, problem_type)

    def neighbour_information(self, target: str, problem_type: str = "regression") -> DataFrame:
        return information.neighbour_mutual_information(self._df, target, problem_type)

    def select_by_variance(
        self, threshold: float = 0.0, exclude: list[str] | None = None
    ) -> DataFrame:
        return features.select_by_variance(self._df, threshold, exclude)

    def select_features(
        self, target: str, k: int = 10, problem_type: str = "regression"
    ) -> DataFrame:
        return features.select_k_best(self._df, target, k, problem_type)

    def feature_importance(self, target: str, problem_type: str = "regression") -> DataFrame:
        return models.rf_feature_importance(self._df, target, problem_type)

    def train(
        self, target: str, model_name: str, problem_type: str = "regression", **how
    ) -> models.TrainedModel:
        return models.train_model(self._df, target, model_name, problem_type, **how)

    def compare(
        self, target: str, model_names: list[str], problem_type: str = "regression", **how
    ) -> DataFrame:
        return models.compare_models(self._df, target, model_names, problem_type, **how)

    # -- charts and reports -----------------------------------------------------

    def chart(self, kind: str, *args, **how) -> DataFrame:
        """The table behind a chart, by the name of a ``chartdata`` function."""
        return getattr(chartdata, kind)(self._df, *args, **how)

    def report(self) -> DataFrame:
        return report.profile_report(self._df)

    def to_report(self, output_path: str) -> None:
        report.save_document(self._df, output_path)
