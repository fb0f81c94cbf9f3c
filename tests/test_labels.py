from pyspark.sql import functions as F

from jestframe.operators import labels as L


def _votes(spark, rows):
    return spark.createDataFrame(
        [(i, f"t{i}", h, *v) for i, (h, v) in enumerate(rows)],
        "id long, text string, is_humor int, votes_1 int, votes_2 int, votes_3 int, votes_4 int, votes_5 int",
    )


def test_vote_resolution_cases(spark):
    rows = [
        (1, (1, 1, 1, 1, 1)),  # no share >= 0.25 -> 0
        (1, (2, 2, 0, 0, 0)),  # highest with >= 0.25 -> 2
        (1, (3, 1, 0, 0, 0)),  # majority -> 1
        (1, (0, 1, 1, 1, 1)),  # quarter each -> highest = 5
        (1, (0, 0, 0, 0, 0)),  # no votes -> 0
        (0, (0, 0, 0, 5, 0)),  # not humour -> 0
        (None, (0, 0, 0, 5, 0)),  # null is_humor counts as humour -> 4
    ]
    out = {r.id: r.score for r in L.resolve_votes(_votes(spark, rows)).collect()}
    assert [out[i] for i in range(len(rows))] == [0, 2, 1, 5, 0, 0, 4]


def _annot(spark, groups):
    data = [(gid, f"g{gid}", s) for gid, vals in groups.items() for s in vals]
    return spark.createDataFrame(data, "id long, text string, sentiment int")


def test_annotation_detection(spark):
    groups = {1: [0, 0, 1], 2: [0, 0, 1, 1], 3: [0, 0, 0, 1], 4: [None, 0, 0, 1]}
    s = L.annotation_summary(_annot(spark, groups))
    out = {r.id: r.score for r in L.detection_from_summary(s).collect()}
    assert out == {2: 1, 3: 0, 4: 1}


def test_annotation_classification(spark):
    groups = {1: [0, 0, 1, 3], 2: [0, 2, 2, 5], 3: [0, 0, 0, 5]}
    s = L.annotation_summary(_annot(spark, groups))
    out = {r.id: r.score for r in L.classification_from_summary(s).collect()}
    assert out == {1: 2, 2: 1}


def test_annotation_edge_cases(spark):
    """A null id is no group, the first text follows the order, any rating level counts."""
    rows = [(None, "n", 1, i) for i in range(5)]
    rows += [(1, "z", 6, 0), (1, "b", 6, 1), (1, "b", 6, 2), (1, "b", 7, 3)]
    rows += [(2, None, 9, 0), (2, "y", 9, 1), (2, "x", 8, 2), (2, "x", 0, 3)]
    df = spark.createDataFrame(rows, "id long, text string, sentiment int, ord int")
    out = {r.id: (r.text, r.rating) for r in L.annotation_summary(df, order_col="ord").collect()}
    assert out == {1: ("z", 6), 2: ("y", 9)}


def test_rated_items(spark):
    rows = [(1, "a", 2.5), (2, "b", 3.5), (3, "c", 2.4), (4, "c", 2.1), (5, "d", 3.0), (6, "d", 3.0),
            (7, "", 1.0), (8, "x" * 512, 1.0), (9, "y" * 513, 1.0)]
    df = spark.createDataFrame(rows, "id long, body string, rating double")
    out = {r.text[:3]: (r.id, r.score) for r in L.rated_items(df).collect()}
    assert out == {"a": (1, 2), "b": (2, 4), "d": (5, 3), "xxx": (8, 1)}


def test_views(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", None), ("d", 5)], "text string, score int")
    det = {r.text: r.score for r in L.to_detection(df).collect()}
    assert det == {"a": 0, "b": 1, "c": 1, "d": 1}
    cls = {r.text: r.score for r in L.to_classification(df).collect()}
    assert cls == {"b": 2, "d": 4}
