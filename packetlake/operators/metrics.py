"""Label statistics, class numbers, and the quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_histogram(packets: DataFrame) -> DataFrame:
    return packets.groupBy("AttackLabel").agg(F.count(F.lit(1)).alias("count"))


def distinct_values(packets: DataFrame, *columns: str) -> DataFrame:
    return packets.select(*columns).distinct()


def class_dictionary(packets: DataFrame, category: str = "proto_hierarchy") -> DataFrame:
    """Categories numbered in sorted order, with their one-hot vectors."""
    values = distinct_values(packets, category)
    by_value = Window.orderBy(category)
    numbered = values.withColumns(
        {"class_index": F.row_number().over(by_value) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy())}
    )
    one_hot = F.transform(
        F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")), lambda i: (i == F.col("class_index")).cast("float")
    )
    return numbered.withColumn("one_hot", one_hot).drop("__n")


def with_class_index(packets: DataFrame, classes: DataFrame, category: str = "proto_hierarchy") -> DataFrame:
    """Adds the class number; Spark broadcasts the dictionary where it is small enough."""
    return packets.join(classes.select(category, "class_index"), category, "left")


def predicted_class(logits: Column) -> Column:
    """0-based position of the largest logit, the first of equals."""
    return F.array_position(logits, F.array_max(logits)) - 1


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log-probability of the target class."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.log(total) + (top - F.element_at(logits, (target + 1).cast("int")))


def accuracy(predictions: DataFrame, predicted: str = "predicted", actual: str = "label") -> DataFrame:
    hit = F.when(F.col(predicted) == F.col(actual), 1).otherwise(0)
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("accuracy"))


def weighted_loss(predictions: DataFrame, alpha_class: float = 4.0, alpha_reconstruction: float = 1.0) -> DataFrame:
    """Mean class and reconstruction cross-entropy, and their weighted sum."""
    losses = predictions.agg(
        F.avg(cross_entropy(F.col("class_logits"), F.col("class_label"))).alias("class_loss"),
        F.avg(cross_entropy(F.col("token_logits"), F.col("token_label"))).alias("reconstruction_loss"),
    )
    total = F.col("class_loss") * alpha_class + F.col("reconstruction_loss") * alpha_reconstruction
    return losses.withColumn("total_loss", total)


def masked_positions(predictions: DataFrame, logits: str, targets: str, masked: str, *keep: str) -> DataFrame:
    """One row per masked position: ``keep``, ``pos``, ``hit`` and its cross-entropy ``loss``.

    ``logits`` holds one array of class scores per position, ``targets`` the class
    numbers, ``masked`` true where the position counts. Positions that are not
    masked are left out before anything is unfolded. So are those without a
    target among their scores: there is nothing to compare.
    """
    places = F.filter(
        F.sequence(F.lit(0), F.size(masked) - 1),
        lambda i: F.coalesce(F.get(masked, i), F.lit(False)) & F.get(targets, i).between(0, F.size(F.get(logits, i)) - 1),
    )
    entries = F.transform(places, lambda i: F.struct(i.alias("pos"), F.get(logits, i).alias("scores"), F.get(targets, i).alias("target")))
    some = predictions.filter(F.size(masked) > 0).select(*keep, F.explode(entries).alias("at"))
    scores, target = F.col("at.scores"), F.col("at.target")
    return some.select(
        *keep, "at.pos", (predicted_class(scores) == target).alias("hit"), cross_entropy(scores, target).alias("loss")
    )


def position_quality(positions: DataFrame, *by: str) -> DataFrame:
    """Accuracy and mean loss over the rows of ``masked_positions``, per value of ``by``.

    Losses are summed as decimals of 15 places: such sums are exact, so neither
    their order nor the partitioning changes the mean, and they combine before
    the shuffle. ``unbounded`` counts losses that are infinite, not a number or
    above 1e12; they stay out of the mean.
    """
    bounded = F.abs("loss") <= 1e12
    hit = F.when(F.col("hit"), 1).otherwise(0)
    sums = positions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hit).alias("hits"),
        F.sum(F.when(bounded, F.col("loss").cast("decimal(28,15)"))).alias("__loss"),
        F.count(F.when(bounded, True)).alias("__bounded"),
    )
    return sums.select(
        *by,
        "n",
        "hits",
        (F.col("hits") / F.col("n")).alias("accuracy"),
        (F.col("__loss").cast("double") / F.nullif(F.col("__bounded"), F.lit(0))).alias("loss"),
        (F.col("n") - F.col("__bounded")).alias("unbounded"),
    )
