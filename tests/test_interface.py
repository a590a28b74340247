"""Edges of fields that run beside each other: least distance, direction and the length that lies within reach."""

import pytest

from furrow.operators import geometry as G

EDGES = "field long, id long, seq int, x0 double, y0 double, x1 double, y1 double"


def test_stays_of_edges_are_told_and_joined(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.0, 0.0, 100.0, 0.0), (1, 11, 1, 0.0, 500.0, 0.0, 600.0), (2, 12, 1, 200.0, 0.0, 300.0, 0.0), (3, 13, 1, 50.0, 1.0, 50.0, 1.0), (None, 14, 1, 0.0, 2.0, None, 2.0)], EDGES)
    # two stays on one edge that overlap, one apart from them, one within reach but not within tol, one edge that is a point
    b = spark.createDataFrame([(7, 20, 1, 10.0, 3.0, 30.0, 3.0), (7, 21, 1, 25.0, 3.0, 40.0, 3.0), (7, 22, 1, 80.0, 3.0, 80.0, 3.0), (8, 23, 1, 200.0, 10.0, 300.0, 10.0), (8, 24, 1, 4.0, 503.0, 4.0, 503.0)], EDGES)
    got = {(r["a_field"], r["b_field"]): tuple(r)[2:] for r in G.interface(a, b, 20.0, 5.0).collect()}
    # the rim of a capsule of 5 is 4 beside an end 3 away
    assert got == {
        (1, 7): (3.0, 10, 20, 0.0, pytest.approx(4 + 30 + 4 + 4 + 4)), (1, 8): (4.0, 11, 24, 90.0, pytest.approx(6.0)), (2, 8): (10.0, 12, 23, 0.0, 0.0), (3, 7): (pytest.approx(10.198039027), 13, 21, 0.0, 0.0),
    }
