"""Top-k search against sorting all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm.top_k import top_k


def brute(rows, asked, k):
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in fine]
    out = []
    for a, (query, u) in enumerate(whole):
        if asked(query):
            scores = sorted((-sum(x * y for x, y in zip(u, v, strict=False)), c) for b, (c, v) in enumerate(whole) if a != b)
            out += [(query, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,dims,k", [(0, 4, 3), (1, 4, 3), (15, 3, 20), (400, 19, 7), (300, 64, 20)])
def test_against_sorting(spark, n, dims, k):
    draw = np.random.default_rng(n)
    rows = [(i, draw.normal(0, 0.3, dims).round(1).tolist()) for i in range(n)]
    if n > 100:
        rows[50:90] = [(i, rows[3][1]) for i in range(50, 90)]
        rows += [(None, rows[0][1]), (20, None), (40, [float("nan")] * dims), (60, [float("inf")] + [0.0] * (dims - 1)), (80, [None] * dims)]
        rows += [(20, rows[20][1]), (100, []), (120, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(map(tuple, top_k(table, F.col("vec_id") % 20 == 0, k).collect()))
    assert got == brute(rows, lambda i: i % 20 == 0, k)
