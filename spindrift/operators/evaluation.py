"""Labelled pairs against predictions: confusion, per-class and macro metrics, severity of errors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import replace_file
from ..schema import DUPLICATE_TYPES

EXACT_OR_ACOUSTIC = ("EXACT_HASH", "EXACT_AUDIO", "ACOUSTIC_DUPLICATE")


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def hydrate(manifest: DataFrame, tracks: DataFrame) -> DataFrame:
    """Manifest rows with both paths, joined to their tracks; ``error`` names the side that is missing."""
    m = manifest.filter((F.trim("track_a_path") != "") & (F.trim("track_b_path") != ""))
    t = tracks.select("filepath", "id")
    j = m.join(t.select(F.col("filepath").alias("track_a_path"), F.col("id").alias("id_a")), "track_a_path", "left").join(t.select(F.col("filepath").alias("track_b_path"), F.col("id").alias("id_b")), "track_b_path", "left")
    bad = F.when(~F.col("expected_category").isin(*DUPLICATE_TYPES) | F.col("expected_category").isNull(), "label").when(F.col("id_a").isNull(), "track_a").when(F.col("id_b").isNull(), "track_b")
    return j.withColumn("error", bad)


def confusion(pairs: DataFrame) -> DataFrame:
    """expected by predicted, all seven classes, zeros filled."""
    grid = pairs.groupBy("expected").pivot("predicted", list(DUPLICATE_TYPES)).count()
    rows = pairs.sparkSession.createDataFrame([(c,) for c in DUPLICATE_TYPES], "expected string")
    return rows.join(grid, "expected", "left").na.fill(0)


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Per class: tp, fp, fn, tn, precision, recall, f1, fpr, fnr. One aggregate over the pairs, then one row per class."""
    counts = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    cls = F.explode(F.array(*map(F.lit, DUPLICATE_TYPES))).alias("class")
    e, p = F.col("expected") == F.col("class"), F.col("predicted") == F.col("class")
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    m = counts.select("*", cls).groupBy("class").agg(s(e & p).alias("tp"), s(~e & p).alias("fp"), s(e & ~p).alias("fn"), s(~e & ~p).alias("tn"))
    m = m.withColumns({"precision": _share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _share(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": _share(F.col("fp"), F.col("fp") + F.col("tn")), "fnr": _share(F.col("fn"), F.col("fn") + F.col("tp"))})
    return m.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(metrics: DataFrame) -> DataFrame:
    """Averages over the classes that occur."""
    used = metrics.filter(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return used.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def error_severity(expected: str = "expected", predicted: str = "predicted") -> Column:
    e, p = F.col(expected), F.col(predicted)
    moderate = (e.isin(*EXACT_OR_ACOUSTIC) & p.isin("POSSIBLE_DUPLICATE", "NO_MATCH", "UNCERTAIN")) | ((e == "POSSIBLE_DUPLICATE") & p.isin(*EXACT_OR_ACOUSTIC))
    return F.when(e == p, None).when((e == "NO_MATCH") & p.isin(*EXACT_OR_ACOUSTIC, "POSSIBLE_DUPLICATE"), "CRITICAL").when(moderate, "MODERATE").otherwise("LOW")


def pair_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found and truth: distinct (a, b). One row: true_positives, missed, extra, recall, precision."""
    both = found.select("a", "b", F.lit(1).alias("f")).join(truth.select("a", "b", F.lit(1).alias("t")), ["a", "b"], "full")
    n = both.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("true_positives"), F.count_if(F.col("f").isNull()).alias("missed"), F.count_if(F.col("t").isNull()).alias("extra"))
    return n.withColumns({"recall": _share(F.col("true_positives"), F.col("true_positives") + F.col("missed")), "precision": _share(F.col("true_positives"), F.col("true_positives") + F.col("extra"))})


def accuracy(pairs: DataFrame) -> DataFrame:
    """One row: labelled pairs, those with a prediction, right and wrong ones, and the share that is right (0 for none)."""
    e, p = F.col("expected"), F.col("predicted")
    n = pairs.agg(F.count("*").alias("pairs"), F.count_if(e.isNotNull() & p.isNotNull()).alias("evaluated"), F.count_if(e == p).alias("right"), F.count_if(e != p).alias("errors"))
    return n.withColumn("accuracy", _share(F.col("right"), F.col("evaluated")))


def label_distribution(pairs: DataFrame, label: str = "expected") -> DataFrame:
    return pairs.groupBy(F.coalesce(label, F.lit("")).alias("label")).agg(F.count("*").alias("pairs"))


def pair_sets(found: DataFrame, truth: DataFrame) -> DataFrame:
    """a, b, part: 'both', 'extra' (found only) and 'missed' (true only) pairs, each once."""
    f, t = found.select("a", "b"), truth.select("a", "b")
    mark = lambda df, part: df.withColumn("part", F.lit(part))
    return mark(f.intersect(t), "both").unionByName(mark(f.subtract(t), "extra")).unionByName(mark(t.subtract(f), "missed"))


def write_report(spark, pairs: DataFrame, path: str) -> None:
    """The evaluation as one JSON document of a few rows, and the scores of all pairs beside it as CSV with two decimals."""
    one = lambda df: df.first().asDict()
    doc = one(accuracy(pairs)) | one(macro(class_metrics(pairs))) | {"classes": {r["class"]: {k: v for k, v in r.asDict().items() if k != "class"} for r in class_metrics(pairs).collect()}}
    replace_file(f"{path}.json", lambda f: json.dump(doc, f, indent=2))
    scores = pairs.select("a", "b", "expected", "predicted", F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0)).cast("double")).alias("confidence"))
    scores.write.mode("overwrite").option("header", True).csv(f"{path}_scores")


def same_folder_pairs(files: DataFrame) -> DataFrame:
    """All pairs of files of one folder: parent, track_a_path < track_b_path. A report of the pairs themselves; for samples of large folders use ``folder_pairs``."""
    a, b = files.select("parent", F.col("filepath").alias("track_a_path")), files.select("parent", F.col("filepath").alias("track_b_path"))
    return a.join(b, "parent").filter("track_a_path < track_b_path")


def folder_pairs(files: DataFrame, per_folder: int = 5, seed: int = 42) -> DataFrame:
    """Up to ``per_folder`` pairs of files of one folder, drawn by a seeded hash: each file meets its successor in hash order only, never the whole folder."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("parent").orderBy(F.md5(F.concat(F.lit(f"{seed}/"), "filepath")), "filepath")
    nxt = files.select("parent", "filepath", F.lead("filepath").over(order).alias("other"), F.row_number().over(order).alias("n"))
    return nxt.filter(F.col("other").isNotNull() & (F.col("n") <= per_folder)).select("parent", F.least("filepath", "other").alias("track_a_path"), F.greatest("filepath", "other").alias("track_b_path"))
