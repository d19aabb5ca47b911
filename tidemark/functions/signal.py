"""Energy of sampled sound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(samples: Column) -> Column:
    """Root of the mean square; 0 for no samples."""
    n = F.size(samples)
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.when(n > 0, F.sqrt(total / n)).otherwise(0.0)
