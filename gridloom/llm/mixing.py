"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells (source, language, topic, or other dimensions). Raking scales the cells so that their
sums meet each target marginal in turn, until all hold within `tolerance` of the total, or for `rounds`
rounds: targets that cells without tokens rule out never hold, which is warned of with the residual. Documents
are then sampled with the calibrated probability min(1, c * raked / actual tokens) of their cell, c such that the
expected tokens are the budget, by a hash of their id, so that a rerun takes the same documents.

Targets are weights for each label (`targets`), or powers of the actual shares (`powers`).

Cells follow the number of distinct labels, not of rows: up to `max_cells` they are raked in
memory, beyond that as Spark tables, with the same results.

Defined results: a null label is a label of its own, `(none)`; a null text has no tokens and is
sampled like others of its cell; a cell without tokens gets probability 1; rows with equal ids
are taken or left together; an empty table gives an empty one. A label with a target but no tokens is an
error; a label with tokens that `targets` does not name has target 0, and its documents are not taken.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rows

DIMS = ("source", "lang", "topic")
NONE = "(none)"


def lexical_topic(text: Column) -> Column:
    """A coarse topic from the text alone: table, markup, short or prose."""
    return F.when(text.contains("|"), "table").when(text.rlike("[#<>]"), "markup").when(F.char_length(text) < 500, "short").otherwise("prose")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _shares(targets: dict[str, float], dim: str, has_tokens: set[str]) -> dict[str, float]:
    """The targets' weights as shares of one; raises where they cannot be met."""
    missing = sorted(k for k, w in targets.items() if w > 0 and k not in has_tokens)
    if missing:
        raise ValueError(f"no tokens for the targets of {dim}: {missing}")
    if any(w < 0 for w in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError(f"the targets of {dim} must be weights of 0 or more, not all 0")
    whole = sum(targets.values())
    return {k: w / whole for k, w in targets.items()}


def _rake_in_memory(cells: pd.DataFrame, powers: dict[str, float], targets: dict[str, dict[str, float]], rounds: int, tolerance: float) -> tuple[pd.DataFrame, float]:
    total, wanted = float(cells["tokens"].sum()), {}
    for dim in (*powers, *targets):
        actual = cells.groupby(dim)["tokens"].sum().astype(float)
        if dim in targets:
            share = actual.index.map(_shares(targets[dim], dim, set(actual.index[actual > 0]))).to_numpy(dtype=float, na_value=0.0) if total else np.zeros(len(actual))
        else:
            raised = np.where(actual > 0, actual ** powers[dim], 0.0)
            share = raised / max(raised.sum(), 1e-300)
        wanted[dim] = cells[dim].map(dict(zip(actual.index, share * total, strict=True))).to_numpy(dtype=float)
    raked, residual = cells["tokens"].astype(float), 0.0
    now = lambda dim: raked.groupby(cells[dim]).transform("sum").to_numpy()
    for _ in range(rounds):
        for dim, target in wanted.items():
            have = now(dim)
            raked = raked * np.where(have > 0, target / np.where(have > 0, have, 1), 0.0)
        residual = max((float(np.abs(now(d) - t).max(initial=0)) for d, t in wanted.items()), default=0.0) / max(total, 1.0)
        if residual <= tolerance:
            break
    return cells.assign(raked=raked), residual


def _rake_in_spark(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict[str, float]], rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    total, wanted = cells.agg(F.sum("tokens")).first()[0] or 0, {}
    for dim in (*powers, *targets):
        actual = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens"))
        if dim in targets:
            named = [dim_row[0] for dim_row in actual.filter(F.col("tokens") > 0).filter(F.col(dim).isin(list(targets[dim]))).select(dim).collect()]
            shares = _shares(targets[dim], dim, set(named)) if total else {}
            given = cells.sparkSession.createDataFrame(list(shares.items()), f"`{dim}` string, share double")
            actual = actual.join(given, dim, "left").select(dim, (F.coalesce("share", F.lit(0.0)) * total).alias("target"))
        else:
            actual = actual.withColumn("target", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(powers[dim]))).otherwise(0.0)).drop("tokens")
            whole = actual.agg(F.sum("target")).first()[0] or 1.0
            actual = actual.withColumn("target", F.col("target") * total / whole)
        wanted[dim] = rows.written(actual, f"target-{dim}")
    cells, residual = cells.withColumn("raked", F.col("tokens").cast("double")), 0.0
    now = lambda dim: cells.groupBy(dim).agg(F.sum("raked").alias("now")).join(wanted[dim], dim)
    for _ in range(rounds):
        for dim in wanted:
            cells = cells.join(now(dim), dim).withColumn("raked", F.when(F.col("now") > 0, F.col("raked") * F.col("target") / F.col("now")).otherwise(0.0)).drop("now", "target")
        cells = rows.written(cells, "cells")
        residual = max((now(d).agg(F.max(F.abs(F.col("now") - F.col("target")))).first()[0] or 0.0 for d in wanted), default=0.0) / max(total, 1)
        if residual <= tolerance:
            break
    return cells, residual


def _scale_in_memory(cells: pd.DataFrame, budget: float) -> float:
    """c with sum(tokens * min(1, c * ratio)) = budget tokens."""
    c = cells[(cells["tokens"] > 0) & (cells["raked"] > 0)]
    ratio = (c["raked"] / c["tokens"]).to_numpy()
    order = np.argsort(-ratio)
    ratio, tokens, raked = ratio[order], c["tokens"].to_numpy(dtype=float)[order], c["raked"].to_numpy()[order]
    full, rest = np.concatenate([[0.0], np.cumsum(tokens)]), np.concatenate([np.cumsum(raked[::-1])[::-1], [0.0]])
    for k in range(len(ratio)):  # the first k cells are taken whole
        scale = (budget - full[k]) / rest[k]
        if scale * ratio[k] <= 1:
            return max(scale, 0.0)
    return 1.0 / max(ratio.min(initial=1.0), 1e-300)


def _scale_in_spark(cells: DataFrame, budget: float) -> float:
    """The same c by bisection, which needs sums only."""
    c = cells.filter("tokens > 0").select("tokens", (F.col("raked") / F.col("tokens")).alias("ratio"))
    low, high = 0.0, 1.0 / max(c.filter("ratio > 0").agg(F.min("ratio")).first()[0] or 1.0, 1e-300)
    for _ in range(60):
        mid = (low + high) / 2
        got = c.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * mid))).first()[0] or 0.0
        low, high = (mid, high) if got < budget else (low, mid)
    return high


def mixed(
    docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, rounds: int = 200, tolerance: float = 1e-12, seed: str = "mix", max_cells: int = 200_000, id_col: str = "doc_id", tokens_col: str = "n_tokens"
) -> DataFrame:
    """docs (with a column of tokens and one for each dimension) with weight, probability and taken, which replace columns of these names.

    targets: for each dimension, the weight of each label; a null label is named `(none)`.
    powers: for each other dimension, the power its token shares are raised to for its target (1: as they are);
    where neither is given, 0.5 for source, lang and topic.
    weight: raked tokens over actual tokens of the document's cell.
    """
    targets = targets or {}
    powers = {d: p for d, p in (powers or ({} if targets else dict.fromkeys(DIMS, 0.5))).items() if d not in targets}
    dims = (*powers, *targets)
    docs = docs.drop("weight", "probability", "taken")
    labelled = docs.withColumns({f"__label_{d}": F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in dims})
    cells = rows.written(labelled.groupBy(*(F.col(f"__label_{d}").alias(d) for d in dims)).agg(F.coalesce(F.sum(tokens_col), F.lit(0)).alias("tokens")), "cells")
    if cells.count() <= max_cells:
        local, residual = _rake_in_memory(cells.orderBy(*dims).toPandas(), powers, targets, rounds, tolerance)
        scale = _scale_in_memory(local, budget_share * float(local["tokens"].sum()))
        raked = docs.sparkSession.createDataFrame(local, schema=", ".join([*(f"`{d}` string" for d in dims), "tokens long, raked double"]))
        raked = F.broadcast(raked)
    else:
        raked, residual = _rake_in_spark(cells, powers, targets, rounds, tolerance)
        scale = _scale_in_spark(raked, budget_share * float(cells.agg(F.sum("tokens")).first()[0] or 0))
    if residual > tolerance:
        warnings.warn(f"targets are missed by up to {residual:.2e} of all tokens after {rounds} rounds", stacklevel=2)
    weights = raked.select(*(F.col(d).alias(f"__cell_{d}") for d in dims), F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).alias("weight"))
    joined = labelled.join(weights, [labelled[f"__label_{d}"] == weights[f"__cell_{d}"] for d in dims])
    chance = F.when(F.col("weight").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return joined.withColumn("probability", chance).withColumn("taken", draw < F.col("probability")).select(*docs.columns, "weight", "probability", "taken")
