"""Array-set algebra on basket columns (op 20).

For small per-row arrays only; set comparisons between many baskets run as
exploded joins on the account column (see ``operators.baskets``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def set_intersection(a, b) -> Column:
    return F.array_intersect(_col(a), _col(b))


def set_difference(a, b) -> Column:
    return F.array_except(_col(a), _col(b))


def overlap_coefficient(a, b) -> Column:
    """|A n B| / min(|A|, |B|) = max(|A n B|/|A|, |A n B|/|B|) (op 31); 0 for an empty side."""
    a, b = F.array_distinct(_col(a)), F.array_distinct(_col(b))
    n = F.size(F.array_intersect(a, b))
    m = F.least(F.size(a), F.size(b))
    return F.when(m > 0, n / m).otherwise(F.lit(0.0))
