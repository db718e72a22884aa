"""Operators against brute force on small rows."""

import random

from triskele.operators import frontier


def test_pareto_of_three_measures(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(12), rng.randrange(12), rng.randrange(12)) for i in range(400)]
    no_worse = lambda q, p: q[1] >= p[1] and q[2] >= p[2] and q[3] <= p[3]
    want = {p[0] for p in rows if not any(no_worse(q, p) and q[1:] != p[1:] for q in rows)}
    points = spark.createDataFrame(rows, "id int, a int, b int, c int").repartition(4)
    assert {r.id for r in frontier.pareto(points, ["a", "b"], ["c"], "id").collect()} == want
