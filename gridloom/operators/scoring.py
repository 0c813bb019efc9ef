"""From class scores to decisions: softmax, best classes, category scores, selections, detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import names
from gridloom.operators.sampling import first_per_group

# Coarse categories and the words that mark a label as theirs.
KEYWORDS = {
    "bus": ["bus", "minibus", "trolleybus"],
    "car": ["car", "cab", "taxi", "limousine", "jeep", "minivan", "pickup", "sports car", "racer", "ambulance", "police van"],
    "traffic_light": ["traffic light"],
    "bicycle": ["bicycle", "mountain bike", "tandem"],
    "fire_hydrant": ["fire hydrant", "hydrant"],
}

# Other names of the categories.
ALIASES = {"バス": "bus", "車": "car", "自動車": "car", "信号": "traffic_light", "信号機": "traffic_light", "自転車": "bicycle", "消火栓": "fire_hydrant"}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: as the variable of a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of scores, in time that grows with its length: largest score and sum are evaluated once."""
    scores = F.struct(logits.alias("x"), F.array_max(logits).cast("double").alias("most"))
    powers = _bound(scores, lambda s: F.transform(s["x"], lambda x: F.exp(x.cast("double") - s["most"])))
    summed = _bound(powers, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("sum")))
    return _bound(summed, lambda s: F.transform(s["e"], lambda x: x / s["sum"]))


def best(scores: Column) -> Column:
    """0-based place of the largest, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def best_classes(probabilities: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The k largest rows of each group with `rank`, from 1; equal ones by class. probabilities: by, class_idx, p."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    d = first_per_group(probabilities, by, k, F.col("p").desc(), F.col("class_idx"))
    w = F.row_number().over(Window.partitionBy(by).orderBy(F.col("p").desc(), "class_idx"))
    return d.withColumn("rank", w)


def normal_target(target: Column, aliases: dict[str, str] | None = None) -> Column:
    """Stripped, lower-cased and, if it is an alias, the category's name."""
    plain = F.lower(names.stripped(target))
    known = F.create_map(*(F.lit(x) for pair in (ALIASES if aliases is None else aliases).items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), plain)


def coarse(label: Column, keywords: dict[str, list[str]] | None = None, whole_words: bool = False) -> Column:
    """Sorted array of the categories one of whose words is in the label (anywhere, or as whole words)."""
    low = F.lower(label)

    def has(word: str) -> Column:
        return low.rlike(rf"\b\Q{word}\E\b") if whole_words else low.contains(word)

    found = []
    for category, words in (KEYWORDS if keywords is None else keywords).items():
        test = has(words[0])
        for word in words[1:]:
            test = test | has(word)
        found.append(F.when(test, F.lit(category)))
    return F.array_sort(F.array_compact(F.array(*found)))


def matching_classes(vocabulary: DataFrame, target: Column, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """class_idx of labels that contain the target or belong to its category; the empty target is in every label.

    Made once from the vocabulary (class_idx, label), which does not grow with the images.
    """
    t = normal_target(target)
    return vocabulary.filter(F.array_contains(coarse(F.col("label"), keywords), t) | F.lower("label").contains(t)).select("class_idx")


def target_scores(probabilities: DataFrame, vocabulary: DataFrame, by: str, target: Column, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """by, score: the summed probability of the matching classes, 0 if none. probabilities: by, class_idx, p."""
    match = matching_classes(vocabulary, target, keywords).withColumn("hit", F.lit(True))
    p = F.when(F.col("hit"), F.col("p").cast("double")).otherwise(0.0)
    return probabilities.join(match, "class_idx", "left").groupBy(by).agg(F.sum(p).alias("score"))


def selected(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Rows whose score is the threshold or more."""
    return scores.filter(F.col("score") >= F.lit(threshold))


def detections(found: DataFrame, by: str, least: float = 0.1) -> DataFrame:
    """by, labels: the labels found with confidence `least` or more, the surest first, repeats kept. found: by, label, conf, pos."""
    d = found.filter(F.col("conf") >= F.lit(least))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "pos", "label")))
    return d.groupBy(by).agg(F.transform(ordered, lambda x: x["label"]).alias("labels"))


def categories_of_best(best_rows: DataFrame, vocabulary: DataFrame, by: str) -> DataFrame:
    """by, categories: sorted, distinct coarse categories of the best classes of each group; empty if these have no names or no category."""
    named = vocabulary.select("class_idx", coarse(F.col("label")).alias("some"))
    every = F.flatten(F.collect_list("some"))
    return best_rows.join(named, "class_idx", "left").groupBy(by).agg(F.array_sort(F.array_distinct(every)).alias("categories"))
