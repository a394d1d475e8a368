"""Statements that change graphs, the catalog and the session; prepared queries."""

import pytest
from graphs import social

from graphloom.plans.scope import GraphQueryError
from graphloom.session import Engine


@pytest.fixture
def eng(spark):
    return Engine(spark, social(spark))


def rows(e, text, **params):
    return sorted((tuple(r) for r in e.gql(text, params).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_insert(eng):
    before = eng.graph
    eng.execute("INSERT (:Person {name: 'Eve', age: 1})-[:KNOWS {w: 7}]->(:Person {name: 'Fay'})")
    assert rows(eng, "MATCH (a {name: 'Eve'})-[e:KNOWS]->(b) RETURN e.w AS w, b.name AS b") == [(7, "Fay")]
    assert rows(eng, "MATCH (a:Person) RETURN COUNT(*) AS n") == [(6,)]
    assert Engine(eng.spark, before).gql("MATCH (a:Person) RETURN COUNT(*) AS n").first()[0] == 4


def test_insert_for_each_match(eng):
    out = eng.execute("MATCH (a:Person)-[:LIVES]->(p:Place {name: 'Here'}) INSERT (a)-[:VISITS {n: a.age}]->(:Trip {by: a.name})<-[:OF]-(p) RETURN a.name AS n")
    assert sorted(r["n"] for r in out.collect()) == ["Ann", "Bob"]
    assert rows(eng, "MATCH (a)-[e:VISITS]->(t:Trip)<-[:OF]-(p) RETURN a.name AS n, e.n AS x, t.by AS t, p.name AS p") == [("Ann", 30, "Ann", "Here"), ("Bob", None, "Bob", "Here")]


def test_insert_undirected_between_bound(eng):
    eng.execute("MATCH (a:Person {name: 'Bob'}), (b:Person {name: 'Cid'}) INSERT (a)~[:PAL]~(b)")
    assert rows(eng, "MATCH (a)~[:PAL]~(b) RETURN a.name AS a, b.name AS b") == [("Bob", "Cid"), ("Cid", "Bob")]


def test_set_and_remove(eng):
    eng.execute("MATCH (a:Person) WHERE a.age > 26 SET a.age = a.age + 1, a.old = TRUE")
    assert rows(eng, "MATCH (a:Person) RETURN a.name AS n, a.age AS x, a.old AS o") == [("Ann", 31, True), ("Bob", None, None), ("Cid", 25, None), ("Dee", 42, True)]
    eng.execute("MATCH (a:Person {name: 'Ann'}) SET a = {name: 'Anna'}")
    assert rows(eng, "MATCH (a:Person) WHERE a.name STARTS WITH 'Ann' RETURN a.name AS n, a.age AS x") == [("Anna", None)]
    eng.execute("MATCH (a:Person {name: 'Dee'}) REMOVE a.age")
    assert rows(eng, "MATCH (a:Person) RETURN COUNT(a.age) AS n") == [(1,)]
    eng.execute("MATCH ()-[e:KNOWS]->() WHERE e.w = 9 SET e.w = 90")
    assert rows(eng, "MATCH ()-[e:KNOWS]->() RETURN MAX(e.w) AS w") == [(90,)]


def test_labels_change(eng):
    eng.execute("MATCH (a:Person {name: 'Ann'}) SET a IS Boss")
    assert rows(eng, "MATCH (a:Boss&Person) RETURN a.name AS n, LABELS(a) AS l") == [("Ann", ["Boss", "Person"])]
    assert rows(eng, "MATCH (a:Boss)-[:KNOWS]->(b:!Boss) RETURN COUNT(*) AS n") == [(3,)]
    eng.execute("MATCH (a:Boss) REMOVE a IS Person")
    assert rows(eng, "MATCH (a:Person) RETURN COUNT(*) AS n") == [(3,)]


def test_delete(eng):
    eng.execute("MATCH ()-[e:KNOWS]->() WHERE e.w < 3 DELETE e")
    assert rows(eng, "MATCH ()-[e:KNOWS]->() RETURN COUNT(*) AS n") == [(3,)]
    with pytest.raises(GraphQueryError, match="DETACH"):
        eng.execute("MATCH (a:Person {name: 'Ann'}) DELETE a")
    eng.execute("MATCH (a:Person {name: 'Ann'}) DETACH DELETE a")
    assert rows(eng, "MATCH (a:Person) RETURN COUNT(*) AS n") == [(3,)]
    assert rows(eng, "MATCH ()-[e:KNOWS]->() RETURN COUNT(*) AS n") == [(0,)]


def test_gql_refuses_changes(eng):
    with pytest.raises(GraphQueryError):
        eng.gql("MATCH (a) DETACH DELETE a")


def test_transactions(eng):
    eng.execute("START TRANSACTION; MATCH (a) DETACH DELETE a; ROLLBACK")
    assert rows(eng, "MATCH (a:Person) RETURN COUNT(*) AS n") == [(4,)]


def test_constraint(eng):
    eng.execute("CREATE CONSTRAINT c FOR (p:Person) REQUIRE p.name IS UNIQUE")
    with pytest.raises(GraphQueryError, match="unique"):
        eng.execute("INSERT (:Person {name: 'Ann'})")
    eng.execute("DROP CONSTRAINT c")
    eng.execute("INSERT (:Person {name: 'Ann'})")
    with pytest.raises(GraphQueryError, match="unique"):
        eng.execute("CREATE CONSTRAINT c FOR (p:Person) REQUIRE p.name IS UNIQUE")


def test_catalog(eng):
    eng.execute("CREATE GRAPH TYPE t AS { (:User {id INT64, name STRING}), (:User)-[:F]->(:User) }; CREATE GRAPH g TYPED t; SESSION SET GRAPH g")
    assert rows(eng, "MATCH (u:User) RETURN u.name AS n") == []
    eng.execute("INSERT (:User {id: 1, name: 'x'})")
    assert rows(eng, "MATCH (u:User) RETURN u.name AS n") == [("x",)]
    with pytest.raises(GraphQueryError, match="exists"):
        eng.execute("CREATE GRAPH g")
    eng.execute("CREATE GRAPH IF NOT EXISTS g; CREATE SCHEMA s; DROP SCHEMA s; CREATE INDEX i FOR (u:User) ON (u.id); DROP INDEX i; SESSION SET GRAPH default; DROP GRAPH g")
    with pytest.raises(GraphQueryError, match="doesn't exist"):
        eng.execute("DROP GRAPH g")
    eng.execute("DROP GRAPH IF EXISTS g")


def test_session_parameters(eng):
    eng.execute("SESSION SET VALUE $n = 'Ann'")
    assert rows(eng, "MATCH (a:Person {name: $n}) RETURN a.age AS x") == [(30,)]
    eng.execute("SESSION RESET PARAMETERS")
    with pytest.raises(GraphQueryError):
        eng.gql("MATCH (a:Person {name: $n}) RETURN a")


def test_use_other_graph(eng):
    eng.execute("CREATE GRAPH other LIKE default; SESSION SET GRAPH other; MATCH (a:Person) WHERE a.age > 26 DETACH DELETE a; SESSION SET GRAPH default")
    assert rows(eng, "MATCH (a:Person) RETURN COUNT(*) AS n UNION ALL USE other MATCH (a:Person) RETURN COUNT(*) AS n") == [(2,), (4,)]


def test_prepared(eng):
    eng.prepare("q", "MATCH (a:Person) WHERE a.age >= $min RETURN a.name AS n ORDER BY n", ["n DESC"])
    assert [r["n"] for r in eng.run("q", {"min": 26}).collect()] == ["Ann", "Dee"]
    assert [r["n"] for r in eng.run("q", {"min": 26}, "n DESC").collect()] == ["Dee", "Ann"]
    with pytest.raises(GraphQueryError):
        eng.run("q", {"min": 1}, "a.age")
    assert eng.list_prepared() == ["q"]
    eng.drop_prepared("q")
    with pytest.raises(KeyError):
        eng.run("q")


def test_functions_and_procedures(eng):
    from pyspark.sql import functions as F

    eng.register("twice", lambda x: x * 2)
    eng.register_procedure("numbers", lambda c, n: c.spark.range(n).select((F.col("id") + 1).alias("i")))
    assert rows(eng, "CALL numbers(3) YIELD i AS k RETURN TWICE(k) AS x") == [(2,), (4,), (6,)]


def test_explain(eng):
    text = eng.explain("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS n")
    assert "Expand right" in text and "Return: " in text
