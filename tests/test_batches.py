"""Batches of an exact size, and a scorer that fails."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batches


@pytest.mark.parametrize("n", [0, 1, 19, 20, 41, 333])
def test_all_batches_but_the_last_are_full(spark, n):
    rows = spark.range(n).select((F.col("id") * 7 - 50).alias("o"), F.col("id").cast("string").alias("t")).repartition(5)
    got = sorted((r["batch"], r["place"], r["o"]) for r in batches.numbered(rows, "o", 20, 6).collect())
    assert got == [(i // 20, i % 20, i * 7 - 50) for i in range(n)]


def test_a_failing_batch_is_halved(spark):
    rows = spark.range(50).select(F.col("id").alias("o"), F.concat(F.lit("text "), "id").alias("t"))

    def score(texts):
        if "text 23" in texts:
            raise RuntimeError("no")
        if "text 44" in texts:
            return [1.0]  # too few, unless it is alone
        return [float(x.split()[1]) for x in texts]

    got = {r["o"]: (r["score"], r["error"], r["calls"]) for r in batches.scored(batches.numbered(rows, "o", 20, 4), "o", "t", score).collect()}
    assert len(got) == 50 and got[23][:2] == (None, "RuntimeError: no") and got[44][:2] == (1.0, None)
    assert all(got[i][:2] == (float(i), None) for i in range(50) if i not in (23, 44))
    assert {got[i][2] for i in range(20)} == {1} and 5 <= got[23][2] <= 6 and got[20][2] <= 6
