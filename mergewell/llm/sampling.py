"""Bounded, repeatable samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30
#: Label values that train.
MOST_LABELS = 256


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's text modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def stratified(rows: DataFrame, label: str, id_col: str, per_label: int, total: int, labels: int = MOST_LABELS) -> DataFrame:
    """About min(count, per_label, a share of total) rows of each label, chosen by a hash of the id. The
    shares are equal, but that rare labels leave what they lack to the others.

    Only the `labels` most frequent values (of equally frequent ones the smallest) train, and never
    more than `total` of them; these and their counts come to the driver, rows and other values
    don't. Sampling is a filter on the scan, so no label is gathered in one task. The expected size
    is at most `total` whatever the input.
    """
    most = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(min(labels, total))
    counts = {r[0]: r[1] for r in most.collect()}
    if not counts:
        return rows.limit(0)
    left, cap = total, per_label
    for i, n in enumerate(sorted(counts.values())):  # what rare values leave goes to the frequent ones
        if n * (len(counts) - i) > left:
            cap = min(per_label, left // (len(counts) - i))
            break
        left -= min(n, per_label)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(_SCALE, _SCALE * cap // n + 1))])
    return rows.where(F.col(label).isNotNull() & (F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(_SCALE)) < rate[F.col(label)]))
