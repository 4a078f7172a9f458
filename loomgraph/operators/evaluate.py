"""Evaluation of predictions: accuracies, matrices, coverage, bands and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.text import answer_contained, answer_matches, valid_prediction

FORMATS = ["origin", "edgetable", "nodesequence", "code", "syntaxtree", "naturallanguage"]

#: Accuracy bands (from, up to, name, order); the first one includes its end.
BANDS = [(0.9, 1.0, "Excellent (90-100%)", 1), (0.8, 0.9, "Good (80-90%)", 2), (0.7, 0.8, "Fair (70-80%)", 3), (0.6, 0.7, "Poor (60-70%)", 4), (0.0, 0.6, "Very Poor (0-60%)", 5)]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def long_predictions(wide: DataFrame, formats: list[str] = FORMATS) -> DataFrame:
    """``dataset, id, answer, prediction_format, prediction`` from a wide result table; formats without a column are skipped."""
    have = [f for f in formats if f"{f}_prediction" in wide.columns]
    return wide.select("dataset", "id", "answer", F.explode(F.array(*[F.struct(F.lit(f).alias("prediction_format"), F.col(f"{f}_prediction").alias("prediction")) for f in have])).alias("x")).select("dataset", "id", "answer", "x.*")


def accuracy(predictions: DataFrame, strict: bool = False) -> DataFrame:
    """``dataset, prediction_format, correct_count, valid_total, total_samples, accuracy``.

    Only valid predictions can be correct. strict: the answer must occur in the prediction as it is.
    """
    valid = valid_prediction(F.col("prediction"), any_case=not strict)
    right = (answer_contained if strict else answer_matches)(F.col("answer"), F.col("prediction"))
    counted = predictions.groupBy("dataset", "prediction_format").agg(F.count_if(valid & right).alias("correct_count"), F.count_if(valid).alias("valid_total"), F.count("*").alias("total_samples"))
    return counted.withColumn("accuracy", ratio(F.col("correct_count"), F.col("valid_total")))


def overall(cells: DataFrame) -> DataFrame:
    """Micro-accuracy for each format, over the datasets that have it, with its rank."""
    sums = cells.groupBy("prediction_format").agg(F.sum("correct_count").alias("total_correct"), F.sum("valid_total").alias("total_valid"), F.sum("total_samples").alias("total_samples"))
    return ranked(sums.withColumn("overall_accuracy", ratio(F.col("total_correct"), F.col("total_valid"))), F.desc("overall_accuracy"), F.col("prediction_format"))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """With ranks from 1 in an order; for report tables of a few rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def dataset_summary(cells: DataFrame, formats: list[str] = FORMATS) -> DataFrame:
    """Per dataset: unweighted mean over its formats, samples, and the formats in their fixed order."""
    place = F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("prediction_format"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col("prediction_format").alias("f")))), lambda x: x["f"]), ", ")
    return cells.groupBy("dataset").agg(F.avg("accuracy").alias("average_accuracy"), F.max("total_samples").alias("total_samples"), listed.alias("available_formats"))


def accuracy_matrix(cells: DataFrame, formats: list[str] = FORMATS) -> DataFrame:
    """One row a dataset, one column a format; null where a dataset lacks the format."""
    return cells.groupBy("dataset").pivot("prediction_format", formats).agg(F.first("accuracy"))


def format_coverage(cells: DataFrame, formats: list[str] = FORMATS) -> DataFrame:
    """Per format: datasets that have it, of all, in per cent; formats that no dataset has show 0."""
    names = cells.sparkSession.createDataFrame([(f,) for f in formats], "prediction_format string")
    total = cells.agg(F.count_distinct("dataset").alias("total_datasets"))
    have = cells.groupBy("prediction_format").agg(F.count_distinct("dataset").alias("datasets_with_format"))
    out = names.join(have, "prediction_format", "left").join(F.broadcast(total)).withColumn("datasets_with_format", F.coalesce("datasets_with_format", F.lit(0)))
    return out.withColumn("coverage_percentage", ratio(F.col("datasets_with_format"), F.col("total_datasets")) * 100)


def dataset_type(cells: DataFrame) -> DataFrame:
    """``mixed``, ``qa_only`` or ``knowledge_only``, by the formats a dataset has."""
    has = cells.groupBy("dataset").agg(F.bool_or(F.col("prediction_format") == "origin").alias("qa"), F.bool_or(F.col("prediction_format") != "origin").alias("kg"))
    return has.select("dataset", F.when(F.col("qa") & F.col("kg"), "mixed").when(F.col("qa"), "qa_only").otherwise("knowledge_only").alias("dataset_type"))


def band(x: Column) -> Column:
    return F.when(x >= 0.9, BANDS[0][2]).when(x >= 0.8, BANDS[1][2]).when(x >= 0.7, BANDS[2][2]).when(x >= 0.6, BANDS[3][2]).otherwise(BANDS[4][2])


def accuracy_bands(cells: DataFrame) -> DataFrame:
    """``accuracy_range, dataset_count, datasets`` (the first ten names); bands without a dataset show 0."""
    dim = cells.sparkSession.createDataFrame([(name, i) for _, _, name, i in BANDS], "accuracy_range string, ord int")
    rank = F.row_number().over(Window.partitionBy("accuracy_range").orderBy("dataset"))
    found = cells.select(band(F.col("accuracy")).alias("accuracy_range"), "dataset").withColumn("rank", rank)
    grouped = found.groupBy("accuracy_range").agg(F.count("*").alias("dataset_count"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.col("dataset")))), ", ").alias("datasets"))
    return dim.join(grouped, "accuracy_range", "left").select("accuracy_range", F.coalesce("dataset_count", F.lit(0)).alias("dataset_count"), F.coalesce("datasets", F.lit("")).alias("datasets"), "ord")


def best_and_worst(cells: DataFrame, n: int = 10) -> DataFrame:
    """The n best and n worst datasets, with ``side`` and ``rank``."""
    best = ranked(cells.orderBy(F.desc("accuracy"), "dataset").limit(n), F.desc("accuracy"), F.col("dataset")).withColumn("side", F.lit("best"))
    worst = ranked(cells.orderBy("accuracy", "dataset").limit(n), F.col("accuracy"), F.col("dataset")).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def coverage(cells: DataFrame) -> DataFrame:
    """Valid of all samples."""
    return cells.withColumn("coverage", ratio(F.col("valid_total"), F.col("total_samples")))


def matrix_ranking(matrix: DataFrame, columns: list[str], page: int = 10) -> DataFrame:
    """Row means over the columns that aren't null, ranks, and pages of ``page`` consecutive ranks."""
    values = F.filter(F.array(*columns), lambda x: x.isNotNull())
    mean = ratio(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values))
    out = ranked(matrix.withColumn("row_mean", mean), F.desc("row_mean"), F.col("dataset"))
    return out.withColumn("page", F.floor((F.col("rank") - 1) / page).cast("int"))


def matrix_of(spark, accuracies: dict[str, dict[str, float | None]]) -> DataFrame:
    """A matrix ``dataset, <formats>`` from figures given in code, for :func:`matrix_ranking`; formats in the order of the first dataset's, missing ones null."""
    formats = list(dict.fromkeys(f for row in accuracies.values() for f in row))
    rows = [(name, *[row.get(f) for f in formats]) for name, row in accuracies.items()]
    return spark.createDataFrame(rows, ", ".join(["dataset string", *[f"`{f}` double" for f in formats]]))
