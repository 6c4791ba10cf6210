"""Frequent itemsets over baskets (op 40), with Spark ML's parallel FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: minimum support 0.1 and 200
# partitions for the FP-growth run.
MIN_SUPPORT = 0.1
FP_PARTITIONS = 200


def basket_item_arrays(members: DataFrame, keys=("trade_date", "fund", "side")) -> DataFrame:
    """One de-duplicated account array per basket (the FP-growth input)."""
    return members.groupBy(*keys).agg(F.array_sort(F.collect_set("acct_key")).alias("items"))


def frequent_itemsets(members: DataFrame, min_support: float = MIN_SUPPORT,
                      num_partitions: int | None = FP_PARTITIONS) -> DataFrame:
    """Itemsets in at least ceil(min_support * #baskets) baskets.

    Returns (items, itemset_size, freq); the reference keeps (length, freq).
    """
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(basket_item_arrays(members))
    fi = model.freqItemsets
    return fi.select(F.array_sort("items").alias("items"), F.size("items").alias("itemset_size"),
                     F.col("freq"))
