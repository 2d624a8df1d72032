"""Labelled rows to a training table, and training itself."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.functions.text import joined_text, normalise_label, record_key
from trendlens.operators.classifier import fit_classifier, fit_text_features, score, with_class_weights
from trendlens.operators.dedupe import keep_first
from trendlens.operators.sampling import resample_class, stratified_split
from trendlens.session import settle


def training_rows(labelled: DataFrame, order: list[str]) -> DataFrame:
    """First row per trimmed (video, title, tags), normalised label, joined text. Null labels are an error."""
    keyed = labelled.withColumn("merge_key", record_key())
    label = F.coalesce(normalise_label("label"), F.raise_error(F.lit("null label")).cast("string"))
    return keep_first(keyed, ["merge_key"], order).withColumns(
        {"label": label, "text": joined_text(["title", "tags", "description"])}
    )


def train_text_classifier(
    rows: DataFrame, key: list[str], rare: str = "olympic", target: int = 400, split_first: bool = False,
    test_fraction: float = 0.2, seed: int = 42, max_iter: int = 10_000,
) -> tuple[PipelineModel, PipelineModel, DataFrame]:
    """Fitted features, fitted classifier, and the scored validation rows.

    By default the rare class is resampled and the features are fitted before
    the split, so copies of a row can be on both sides; ``split_first`` keeps
    validation rows out of both. The classifier says whether it has ``converged``.
    """
    if split_first:
        parts = stratified_split(rows, "label", key, test_fraction, seed)
        train = settle(resample_class(parts.filter(~F.col("is_test")), "label", rare, key, target, seed))
        features = fit_text_features(train)
        valid = parts.filter("is_test")
    else:
        grown = settle(resample_class(rows, "label", rare, key, target, seed))
        features = fit_text_features(grown)
        parts = stratified_split(grown, "label", [*key, "draw"], test_fraction, seed)
        train, valid = parts.filter(~F.col("is_test")), parts.filter("is_test")
    weighted = with_class_weights(features.transform(train))
    model = fit_classifier(weighted, weight="weight", max_iter=max_iter)
    return features, model, score(valid, features, model)
