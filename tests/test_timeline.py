"""As-of joins by cases."""

from studylake.operators import timeline


def test_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 1.0), (3, None, 9.0), (4, "a", None), (5, "b", 9.0), (6, "a", 5.0)], "row int, k string, t double")
    right = spark.createDataFrame([("a", 5.0, 1), ("a", 5.0, 2), ("a", 2.0, 7), (None, 3.0, 8), ("a", None, 9)], "k string, t double, v int")
    got = {r["row"]: r["last_v"] for r in timeline.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {1: 2, 2: None, 3: 8, 4: None, 5: None, 6: 2}
    near = {r["row"]: r["last_v"] for r in timeline.as_of(left, right, ["k"], "t", ["v"], 3).collect()}
    assert near == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: 2}


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", 5.0)], "row int, k string, t double"), spark.createDataFrame([], "k string, t double, v int")
    assert [tuple(r) for r in timeline.as_of(left, right, ["k"], "t", ["v"]).collect()] == [(1, "a", 5.0, None)]
    assert timeline.as_of(left.limit(0), right, ["k"], "t", ["v"]).collect() == []
