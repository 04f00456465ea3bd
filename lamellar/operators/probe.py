"""Linear probes: one small fit for each (model, task), all at once as grouped tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.operators.metrics import auroc_multiclass, metric_bundle
from lamellar.operators.selection import stratified_split

PREDICTIONS = "model string, task string, item_id string, y int, pred int, prob array<double>, reason string"


def fit_probe(x, y, classes: int, epochs: int = 100, rate: float = 1e-3, decay: float = 1e-4, seed: int = 0):
    """Full-batch AdamW on softmax cross-entropy: weights [classes, d] and bias."""
    import numpy as np

    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(x.shape[1])
    p = [rng.uniform(-bound, bound, (classes, x.shape[1])), rng.uniform(-bound, bound, classes)]
    m, v, hot = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], np.eye(classes)[y]
    for t in range(1, epochs + 1):
        z = x @ p[0].T + p[1]
        q = np.exp(z - z.max(1, keepdims=True))
        g = (q / q.sum(1, keepdims=True) - hot) / len(y)
        for i, d in enumerate((g.T @ x, g.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            p[i] = p[i] * (1 - rate * decay) - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def run_grid(embeddings: DataFrame, labels: DataFrame, val_share: float = 0.2, epochs: int = 100, rate: float = 1e-3, least: int = 10, seed: int = 0) -> DataFrame:
    """PREDICTIONS on the validation rows of every (model, task); skipped cells give one row with a reason.

    A cell is one group in one task, as the fit needs all its rows (one vector for each item; the largest cell has the items of a corpus).
    """
    rows = embeddings.join(labels, "item_id").withColumn("cell", F.concat_ws("\u0001", "model", "task", F.col("label").cast("string")))
    rows = stratified_split(rows, "cell", F.col("item_id"), val_share, seed).drop("cell")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        model, task = frame["model"].iloc[0], frame["task"].iloc[0]
        skip = lambda why: pd.DataFrame([(model, task, None, None, None, None, why)], columns=[c.split()[0] for c in PREDICTIONS.split(", ")])
        names = sorted(frame["label"].unique())
        if len(frame) < least:
            return skip("too few rows")
        if len(names) < 2:
            return skip("one class")
        val = frame["is_val"].to_numpy()
        if val.all() or not val.any():
            return skip("empty split")
        x, y = np.stack(frame["embedding"]).astype(float), frame["label"].to_numpy()
        mean, dev = x[~val].mean(0), np.maximum(x[~val].std(0, ddof=1) if (~val).sum() > 1 else np.zeros(x.shape[1]), 1e-6)
        x = (x - mean) / dev
        w, b = fit_probe(x[~val], y[~val], int(max(names)) + 1, epochs, rate, seed=seed)
        z = x[val] @ w.T + b
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        return pd.DataFrame({"model": model, "task": task, "item_id": frame["item_id"][val].astype(str), "y": y[val], "pred": q.argmax(1), "prob": list(q), "reason": None})

    return rows.groupBy("model", "task").applyInPandas(fit, PREDICTIONS)


def results(predictions: DataFrame, classes: int) -> DataFrame:
    """One row of metrics for each (model, task) that was fitted."""
    done = predictions.where("reason is null")
    return metric_bundle(done, ["model", "task"], classes).join(auroc_multiclass(done, ["model", "task"]), ["model", "task"], "left").withColumn("n_classes", F.lit(classes))


def single(embeddings: DataFrame, labels: DataFrame, path: str = "path", epochs: int = 100, rate: float = 1e-3, val_share: float = 0.2, seed: int = 0) -> DataFrame:
    """One probe from a label table (path or base name, label, split): metrics of its validation rows.

    A split column, where any row has one, decides; else a random split. Labels may be any text: classes are their sorted values.
    """
    from lamellar.operators.lookups import exact_or_base
    from lamellar.operators.selection import random_split

    rows = exact_or_base(embeddings.select(path, "embedding"), labels, path, "path", "label").where(F.col("label").isNotNull())
    if "split" in labels.columns:
        rows = exact_or_base(rows, labels, path, "path", "split")
    names = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    numbered = rows.withColumn("y", F.array_position(F.array(*map(F.lit, names)), F.col("label")).cast("int") - 1)
    if "split" in labels.columns and rows.where("coalesce(split, '') <> ''").limit(1).count():
        numbered = numbered.where(F.col("split").isin("train", "val", "valid", "test")).withColumn("is_val", F.col("split") != "train")
    else:
        numbered = random_split(numbered, path, val_share, seed)
    classes = len(names)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        val, y, x = frame["is_val"].to_numpy(), frame["y"].to_numpy(), np.stack(frame["embedding"]).astype(float)
        mean, dev = x[~val].mean(0), np.maximum(x[~val].std(0, ddof=1), 1e-6)
        x = (x - mean) / dev
        w, b = fit_probe(x[~val], y[~val], classes, epochs, rate, seed=seed)
        q = np.exp(x[val] @ w.T + b - (x[val] @ w.T + b).max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        return pd.DataFrame({"model": "single", "task": "single", "item_id": frame[path][val].astype(str), "y": y[val], "pred": q.argmax(1), "prob": list(q), "reason": None})

    return results(numbered.withColumn("cell", F.lit("single")).groupBy("cell").applyInPandas(fit, PREDICTIONS), classes)


def logistic(df: DataFrame, features: str, label: str, decay: float = 1e-4):
    """The idiomatic head for data that doesn't fit a task: distributed multinomial regression; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    return Pipeline(stages=[StandardScaler(inputCol=features, outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, regParam=decay, family="multinomial")]).fit(df)
