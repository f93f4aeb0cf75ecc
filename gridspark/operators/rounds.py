"""Work on whole groups in rounds, so that what is shuffled at a time has a bounded share of the table.

A round holds the groups whose key hashes to its number, null keys too. Every round scans the table, which is therefore a
stored one; the rounds are few, so the scans stay in proportion to the table. A group is never cut: one that is larger than a
round makes its round larger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.session import shuffle_files_removed

#: Rows of a round, about.
ROUND_ROWS = 1 << 24
#: Most rounds; larger tables have larger rounds.
MOST_ROUNDS = 16


def number_of_rounds(df: DataFrame) -> int:
    """For a stored table the count reads the footers of its files alone."""
    with shuffle_files_removed(df.sparkSession):
        return max(1, min(MOST_ROUNDS, -(-df.count() // ROUND_ROWS)))


def in_round(keys: Sequence[Column], i: int, n: int) -> Column:
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(*keys), F.lit(n)) == i


def rounds(df: DataFrame, keys: Sequence[str]) -> Iterator[DataFrame]:
    """Parts of ``df`` with whole groups, which together have every row once.

    One part if there are no keys, or if keys are collated: strings that differ may then be equal, while their hashes differ.
    """
    hashed = keys and not any("collate" in kind for c, kind in df.dtypes if c in keys)
    n = number_of_rounds(df) if hashed else 1
    for i in range(n):
        yield df.filter(in_round([F.col(k) for k in keys], i, n))
