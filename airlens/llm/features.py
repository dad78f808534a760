"""Bounded training samples whose features are computed on executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_per_class(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows of each label, chosen by a hash of doc_id: ``doc_id`` and ``label``.

    A hash threshold from the counts per label thins each label to about 1.3 times the bound before any ranking, so no
    label's rows meet in one place.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.3 * most + 100) / F.col("n"))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    below = F.broadcast(counts.select(label, (share * (1 << 30)).cast("long").alias("below")))  # a row a class, as the model has
    thinned = rows.join(below, label).withColumn("spread", spread).where("spread < below")
    nth = F.row_number().over(Window.partitionBy(label).orderBy("spread", "doc_id"))
    return thinned.withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", label)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
