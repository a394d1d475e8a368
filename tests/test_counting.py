"""Queries that only count: the same as by making every pair, without making it."""

import random

import pytest

from graphloom.graph import Graph
from graphloom.plans.counting import Counting
from graphloom.session import Engine


@pytest.fixture(scope="module")
def eng(spark):
    r = random.Random(7)
    some = lambda: r.choice([None, -1.0, 0.0, -0.0, 0.5, 1.0, 2.0, 2.0, float("nan")])
    a = spark.createDataFrame([(i, some(), r.choice("xy")) for i in range(40)], "id long, v double, s string")
    b = spark.createDataFrame([(i, some(), r.choice("xyz")) for i in range(30)], "id long, v double, s string")
    n = spark.createDataFrame([(i, f"n{i % 3}", float(i)) for i in range(6)], "id long, name string, v double")
    an = spark.createDataFrame([(k, i, r.randrange(5)) for k, i in enumerate([*range(40), *range(0, 40, 3)])], "e long, a long, b long")
    bn = spark.createDataFrame([(k, r.randrange(30), r.randrange(1, 6)) for k in range(45)], "e long, a long, b long")
    nb = spark.createDataFrame([(k, r.randrange(6), r.randrange(30)) for k in range(20)], "e long, a long, b long")
    g = Graph().with_vertices("A", a, "id").with_vertices("B", b, "id").with_vertices("N", n, "id")
    g = g.with_edges("AN", an, ("A", "a"), ("N", "b"), ["e"], "e").with_edges("BN", bn, ("B", "a"), ("N", "b"), ["e"], "e")
    return Engine(spark, g.with_edges("NB", nb, ("N", "a"), ("B", "b"), ["e"], "e"))


def rows(e, text):
    return sorted((tuple(map(str, r)) for r in e.gql(text).collect()))


QUERIES = [
    "MATCH (a:A)-[:AN]->(n:N) MATCH (b:B)-[:BN]->(n) RETURN n.name AS n, COUNT(*) AS c GROUP BY n.name",
    "MATCH (a:A)-[:AN]->(n:N) MATCH (b:B)-[:BN]->(n) RETURN COUNT(*) AS c, COUNT(a) AS a, COUNT(DISTINCT b) AS b, MAX(n.v) AS m",
    "MATCH (a:A)-[e:AN]->(n:N)<-[:BN]-(b:B WHERE b.v > 0) WHERE a.v >= 0 AND n.v < 4 RETURN COUNT(*) AS c, MIN(b.v) AS m",
    "MATCH (a:A)-[:AN]->()<-[:BN]-(b:B) RETURN b.s AS s, COUNT(*) AS c GROUP BY b.s ORDER BY c DESC, s LIMIT 2",
    "MATCH (a:A)-[:AN]->(n:N), (b:B)-[:BN]->(n), (n)-[:NB]->(x:B) WHERE x.v > b.v RETURN COUNT(*) AS c, COUNT(x.v) FILTER (WHERE x.s = 'x') AS f",
    "MATCH (a:A)-[:AN]->(n:N)<-[:AN]-(o:A)-[:AN]->(m:N)<-[:BN]-(b:B) RETURN m.name AS n, COUNT(*) AS c GROUP BY m.name HAVING COUNT(*) > 3",
    "MATCH (a:A)-[:AN]-(n:N) MATCH (n)-[:BN]-(b:B) OPTIONAL MATCH (n)-[:NB]->(x) RETURN COUNT(*) AS c, COUNT(x) AS x, COUNT(n) AS n",
    "MATCH (a:A)-[:AN]->(n:N) OPTIONAL MATCH (n)-[e:NB]->(x:B) RETURN n.name AS n, COUNT(*) AS c, COUNT(e) AS e, COUNT(x) + 1 AS x GROUP BY n.name",
    "MATCH (a:A)-[:AN]->(n:N) MATCH (n)<-[:BN]-(b:B) OPTIONAL MATCH (n)-[:NB]->(x:B) WHERE x.s = b.s OR x.v IS NULL RETURN COUNT(*) AS c, COUNT(x) AS x",
    "MATCH (a:A) OPTIONAL MATCH (a)-[:AN]->(n:N {name: 'n1'}) RETURN a.id AS a, COUNT(n) AS n GROUP BY a.id",
    "MATCH (n:N) OPTIONAL MATCH (n)<-[:BN]-(b:B) MATCH (n)<-[:AN]-(a:A) RETURN n.id AS n, COUNT(b) AS b, COUNT(*) AS c GROUP BY n.id",
    "MATCH (n:N)<-[:AN]-(a:A), (n)<-[:AN]-(z:A) RETURN n.name AS n, COUNT(DISTINCT a.s) AS s, COUNT(*) AS c GROUP BY n.name",
    "MATCH (a:A)-[:AN]->(n:N) WHERE a.v > 100 MATCH (b:B)-[:BN]->(n) RETURN COUNT(*) AS c, COUNT(n) AS n",
    *(f"MATCH (a:A)-[:AN]->(n:N) OPTIONAL MATCH (n)<-[:BN]-(b:B) WHERE {x} RETURN COUNT(*) AS c, COUNT(b) AS b" for x in ("b.v > a.v", "b.v < a.v", "a.v <= b.v", "a.v >= b.v", "b.s < a.s", "b.v > n.v", "b.v > a.id")),
    "MATCH (a:A)-[:AN]->(n:N) OPTIONAL MATCH (n)<-[:BN]-(b:B) WHERE b.v > a.v RETURN a.id AS a, n.id AS n, COUNT(*) AS c, COUNT(b) AS b GROUP BY a.id, n.id",
]


@pytest.mark.parametrize("text", QUERIES)
def test_same_as_by_pairs(eng, text, monkeypatch):
    got = rows(eng, text)
    monkeypatch.setattr(Counting, "only_counts", lambda *a: False)
    assert got == rows(eng, text) and got


def _most_rows(df):
    """The largest number of rows that any step of the plan gave out."""
    df.collect()

    def nodes(p):
        yield p
        kids = p.children()
        inner = [p.executedPlan()] if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [p.plan()] if p.getClass().getSimpleName().endswith("QueryStageExec") else []
        for x in [*(kids.apply(i) for i in range(kids.size())), *inner]:
            yield from nodes(x)

    found = [m.get().value() for p in nodes(df._jdf.queryExecution().executedPlan()) if (m := p.metrics().get("numOutputRows")).isDefined()]
    assert found
    return max(found)


@pytest.fixture(scope="module")
def hub(spark):
    """700 and 500 vertices at one node: 350,000 pairs."""
    ids = lambda n: spark.range(n).selectExpr("id", "CAST(id AS DOUBLE) AS v")
    g = Graph().with_vertices("A", ids(700), "id").with_vertices("B", ids(500), "id").with_vertices("N", spark.range(1).selectExpr("id", "'hub' AS name"), "id")
    to = lambda n: spark.range(n).selectExpr("id AS e", "id AS a", "0L AS b")
    return Engine(spark, g.with_edges("AN", to(700), ("A", "a"), ("N", "b"), [], "e").with_edges("BN", to(500), ("B", "a"), ("N", "b"), [], "e"))


@pytest.mark.parametrize("text", ["MATCH (a:A)-[:AN]->(n:N) MATCH (b:B)-[:BN]->(n) RETURN n.name AS n, COUNT(*) AS c GROUP BY n.name", "MATCH (a:A)-[:AN]->(n:N)<-[:BN]-(b:B) RETURN n.name AS n, COUNT(*) AS c GROUP BY n.name"])
def test_two_sides_of_a_node_are_not_paired(hub, text):
    df = hub.gql(text)
    assert [tuple(r) for r in df.collect()] == [("hub", 350_000)]
    assert _most_rows(hub.gql(text)) < 5_000


def test_optional_inequality_makes_no_pairs(hub):
    text = "MATCH (a:A)-[:AN]->(n:N) OPTIONAL MATCH (n)<-[:BN]-(b:B) WHERE b.v > a.v RETURN COUNT(*) AS c, COUNT(b) AS b"
    hits = sum(b > a for a in range(700) for b in range(500))
    assert tuple(hub.gql(text).first()) == (hits + sum(all(b <= a for b in range(500)) for a in range(700)), hits)
    assert _most_rows(hub.gql(text)) < 5_000
