"""Small graphs by hand."""

from graphloom.graph import Graph


def social(spark):
    """People who know each other (directed, with a self-loop and a parallel edge) and who are friends (undirected)."""
    people = spark.createDataFrame([(1, "Ann", 30), (2, "Bob", None), (3, "Cid", 25), (4, "Dee", 41)], "id long, name string, age int")
    places = spark.createDataFrame([(1, "Here"), (2, "There")], "id long, name string")
    knows = spark.createDataFrame([(1, 1, 2, 5), (2, 1, 2, 3), (3, 2, 3, 1), (4, 3, 1, 1), (5, 1, 3, 9), (6, 4, 4, 2)], "eid long, a long, b long, w int")
    friends = spark.createDataFrame([(1, 1, 4), (2, 2, 2)], "eid long, a long, b long")
    lives = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 2)], "eid long, a long, b long")
    bare = spark.createDataFrame([(1, 4, 1)], "eid long, a long, b long")
    g = Graph().with_vertices("Person", people, "id").with_vertices(("Place", "Spot"), places, "id", name="Place")
    g = g.with_edges("KNOWS", knows, ("Person", "a"), ("Person", "b"), ["w"], "eid")
    g = g.with_edges("FRIEND", friends, ("Person", "a"), ("Person", "b"), [], "eid", directed=False)
    g = g.with_edges("LIVES", lives, ("Person", "a"), ("Place", "b"), [], "eid")
    return g.with_edges(None, bare, ("Person", "a"), ("Place", "b"), [], "eid", name="bare")


def diamond(spark):
    """1 -> 2,3 -> 4 (two equal ways, one doubled), 1 -> 5 -> 6 -> 4, and a dear short way 1 -> 4."""
    v = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    e = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 3, 1.0), (3, 2, 4, 1.0), (4, 3, 4, 1.0), (5, 3, 4, 1.0), (6, 1, 5, 0.5), (7, 5, 6, 0.5), (8, 6, 4, 0.5), (9, 1, 4, 9.0), (10, 4, 1, 1.0)], "eid long, a long, b long, w double")
    return Graph().with_vertices("N", v, "id").with_edges("E", e, ("N", "a"), ("N", "b"), ["w"], "eid")
