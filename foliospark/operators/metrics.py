"""Evaluation of predicted pages against true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import similarity as sim


def page_metrics(pairs: DataFrame, pred: str = "pred", truth: str = "truth", bleu: bool = False) -> DataFrame:
    """edit_dist, precision, recall, f_measure (and bleu) of every pair; null where a text is too short."""
    p, t = F.col(pred), F.col(truth)
    s = sim.set_scores(p, t)
    out = pairs.withColumns({"edit_dist": sim.edit_distance_share(p, t), "precision": s["precision"], "recall": s["recall"], "f_measure": s["f_measure"]})
    return out.withColumn("bleu", sim.bleu(p, t)) if bleu else out


def summarise(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over the pairs that have each metric."""
    names = [c for c in ("edit_dist", "precision", "recall", "f_measure", "bleu") if c in metrics.columns]
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def by_modality(pairs: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """One row for each pair and modality (text, math, tables), to be measured like pages."""
    p, t = sim.modalities(F.col(pred)), sim.modalities(F.col(truth))
    rows = F.array(*(F.struct(F.lit(m).alias("modality"), p[m].alias(pred), t[m].alias(truth)) for m in ("text", "math", "tables")))
    others = [c for c in pairs.columns if c not in (pred, truth)]
    return pairs.select(*others, F.explode(rows).alias("_m")).select(*others, "_m.*")
