"""Operators on small graphs, against hand-made results and a brute-force path search."""

import itertools
import random

import pytest
from graphs import diamond, social

from graphloom.graph import Graph
from graphloom.plans.scope import GraphQueryError
from graphloom.session import Engine


@pytest.fixture(scope="module")
def eng(spark):
    return Engine(spark, social(spark))


@pytest.fixture(scope="module")
def dia(spark):
    return Engine(spark, diamond(spark))


def rows(e, text, **params):
    return sorted((tuple(r) for r in e.gql(text, params).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_directions(eng):
    n = lambda arrow: rows(eng, f"MATCH (a:Person){arrow}(b:Person) RETURN COUNT(*) AS n")[0][0]
    assert n("-[:KNOWS]->") == 6
    assert n("<-[:KNOWS]-") == 6
    assert n("<-[:KNOWS]->") == 12  # a directed loop is met from both sides
    assert n("~[:FRIEND]~") == 3  # an undirected loop once
    assert n("-[:KNOWS|FRIEND]-") == 15
    assert n("~[:KNOWS|FRIEND]~>") == 9
    assert n("<~[:KNOWS|FRIEND]~") == 9


def test_labels(eng):
    assert rows(eng, "MATCH (p:Place&Spot) RETURN COUNT(*) AS n") == [(2,)]
    assert rows(eng, "MATCH (p:!Person) RETURN p.name AS n") == [("Here",), ("There",)]
    assert rows(eng, "MATCH (p:%) RETURN COUNT(*) AS n") == [(6,)]
    assert rows(eng, "MATCH ()-[e:!KNOWS&!FRIEND]->(p) RETURN TYPE(e) AS t, COUNT(*) AS n GROUP BY TYPE(e)") == [(None, 1), ("LIVES", 3)]
    assert rows(eng, "MATCH (p:Place) RETURN DISTINCT LABELS(p) AS l") == [(["Place", "Spot"],)]
    with pytest.raises(Exception, match="exactly one label"):
        rows(eng, "MATCH (p:Place) RETURN LABEL(p) AS l")


def test_fixed_hops_repeat_edges(eng):
    assert rows(eng, "MATCH (a {name: 'Dee'})-[x:KNOWS]->(b)-[y:KNOWS]->(c) RETURN COUNT(*) AS n") == [(1,)]
    assert rows(eng, "MATCH DIFFERENT EDGES (a {name: 'Dee'})-[x:KNOWS]->(b)-[y:KNOWS]->(c) RETURN COUNT(*) AS n") == [(0,)]


def test_loop_pattern(eng):
    assert rows(eng, "MATCH (a)-[e:KNOWS]->(a) RETURN a.name AS n, e.w AS w") == [("Dee", 2)]
    assert rows(eng, "MATCH (a:Person), (a)-[:KNOWS]->(a) RETURN a.name AS n") == [("Dee",)]


def test_missing_property_and_null(eng):
    assert rows(eng, "MATCH (a:Person) WHERE a.age IS NULL RETURN a.name AS n, a.nothing AS x") == [("Bob", None)]
    assert rows(eng, "MATCH (a:Person) WHERE a.age > 26 RETURN COUNT(*) AS n") == [(2,)]
    assert rows(eng, "MATCH (a:Person) WHERE NOT (a.age > 26) RETURN a.name AS n") == [("Cid",)]


def test_optional(eng):
    got = rows(eng, "MATCH (a:Person) OPTIONAL MATCH (a)-[e:LIVES]->(p) RETURN a.name AS n, p.name AS p, e IS NULL AS miss")
    assert got == [("Ann", "Here", False), ("Bob", "Here", False), ("Cid", "There", False), ("Dee", None, True)]
    assert rows(eng, "MATCH (a:Person {name: 'Dee'}) OPTIONAL MATCH (a)-[:LIVES]->(p) OPTIONAL MATCH (p)<-[:LIVES]-(q) RETURN a.name AS n, q.name AS q") == [("Dee", None)]
    assert rows(eng, "MATCH (a:Person {name: 'Dee'}) OPTIONAL MATCH (a)-[:LIVES]->(p) RETURN p IS LABELED Place AS l") == [(False,)]


def test_optional_block(eng):
    got = rows(eng, "MATCH (a:Person) OPTIONAL { MATCH (a)-[:LIVES]->(p) MATCH (p)<-[:LIVES]-(b:Person) WHERE b.name <> a.name } RETURN a.name AS n, b.name AS b")
    assert got == [("Ann", "Bob"), ("Bob", "Ann"), ("Cid", None), ("Dee", None)]


def test_exists_in_or(eng):
    assert rows(eng, "MATCH (a:Person) WHERE EXISTS { (a)-[:LIVES]->(:Place {name: 'There'}) } OR a.age > 40 RETURN a.name AS n") == [("Cid",), ("Dee",)]
    assert rows(eng, "MATCH (a:Person) RETURN a.name AS n, EXISTS { MATCH (a)-[e:KNOWS]->(b) WHERE e.w > a.age - 30 } AS x") == [("Ann", True), ("Bob", False), ("Cid", True), ("Dee", False)]


def test_value(eng):
    assert rows(eng, "MATCH (a:Person) RETURN a.name AS n, VALUE { MATCH (a)-[e:KNOWS]->() RETURN SUM(e.w) AS s } AS s") == [("Ann", 17), ("Bob", 1), ("Cid", 1), ("Dee", 2)]
    with pytest.raises(Exception, match="more than one"):
        rows(eng, "MATCH (a:Person) RETURN VALUE { MATCH (a)-[e:KNOWS]->() RETURN e.w AS w } AS w")


def test_call(eng):
    got = rows(eng, "MATCH (a:Person) CALL (a) { MATCH (a)-[e:KNOWS]->(b) RETURN b.name AS b, e.w AS w ORDER BY w DESC LIMIT 1 } RETURN a.name AS n, b, w")
    assert got == [("Ann", "Cid", 9), ("Bob", "Cid", 1), ("Cid", "Ann", 1), ("Dee", "Dee", 2)]
    assert rows(eng, "MATCH (a:Place) CALL () { MATCH (b:Person) RETURN COUNT(*) AS n } RETURN a.name AS a, n") == [("Here", 4), ("There", 4)]


def test_implicit_group_is_one_row(eng):
    assert len(rows(eng, "MATCH (a:Person) RETURN COUNT(*) AS n, a.name AS some")) == 1
    assert rows(eng, "MATCH (a:Person WHERE a.age > 99) RETURN COUNT(*) AS n, SUM(a.age) AS s") == [(0, None)]


def test_group_by_rules(eng):
    with pytest.raises(GraphQueryError, match="grouped"):
        eng.gql("MATCH (a:Person) RETURN a.name AS n, COUNT(*) AS c GROUP BY a.age")
    with pytest.raises(GraphQueryError, match="two columns"):
        eng.gql("MATCH (a:Person) RETURN a.name AS n, a.age AS n")
    with pytest.raises(GraphQueryError, match="aggregates"):
        eng.gql("MATCH (a:Person) FILTER COUNT(*) > 1 RETURN a")


def test_collect_keeps_nulls(eng):
    assert rows(eng, "MATCH (a:Person) RETURN COLLECT_LIST(a.age ORDER BY a.name) AS l") == [([30, None, 25, 41],)]


def test_null_order(eng):
    q = "MATCH (a:Person) RETURN a.name AS n ORDER BY a.age {}"
    first = lambda s: [r["n"] for r in eng.gql(q.format(s)).collect()]
    assert first("") == ["Cid", "Ann", "Dee", "Bob"]
    assert first("DESC") == ["Bob", "Dee", "Ann", "Cid"]
    assert first("DESC NULLS LAST") == ["Dee", "Ann", "Cid", "Bob"]


def test_set_operations_by_name(eng):
    assert rows(eng, "RETURN 1 AS a, 2 AS b UNION ALL RETURN 3 AS b, 4 AS a") == [(1, 2), (4, 3)]
    with pytest.raises(GraphQueryError, match="same columns"):
        eng.gql("RETURN 1 AS a UNION RETURN 1 AS b")
    assert rows(eng, "FOR x IN [1,1,2] RETURN x EXCEPT ALL FOR x IN [1] RETURN x") == [(1,), (2,)]
    assert rows(eng, "FOR x IN [1,1,2] RETURN x INTERSECT ALL FOR x IN [1,1,1] RETURN x") == [(1,), (1,)]
    assert rows(eng, "FOR x IN [1] FILTER x > 1 RETURN x OTHERWISE RETURN 9 AS x") == [(9,)]
    assert rows(eng, "FOR x IN [1] RETURN x OTHERWISE RETURN 9 AS x") == [(1,)]


def test_for_null_and_empty(eng):
    assert rows(eng, "FOR x IN CAST(NULL AS LIST<INT64>) RETURN x") == []
    assert rows(eng, "MATCH (a:Person {name: 'Ann'}) FOR x IN [a.age, 1] WITH ORDINALITY i RETURN x, i") == [(1, 2), (30, 1)]


def test_expressions(eng):
    assert rows(eng, "RETURN [1,2,3][0] AS a, [1,2,3][-1] AS b, [1,2,3][7] AS c, [1,2,3,4][1..3] AS d, 'a' + 'b' AS e, NULL IS NULL AS f, UNKNOWN IS UNKNOWN AS g") == [(1, 3, None, [2, 3], "ab", True, True)]
    assert rows(eng, "RETURN TRUE XOR NULL AS a, FALSE AND NULL AS b, TRUE OR NULL AS c") == [(None, False, True)]
    assert rows(eng, "RETURN DURATION('P1Y2M3DT4H') AS d, DURATION_BETWEEN(DATE '2020-01-01', DATE '2021-03-01') YEAR TO MONTH AS m")[0][0] == (14, (3 * 24 + 4) * 3600 * 10**9)
    assert rows(eng, "RETURN NORMALIZE('e\\u0301', NFC) AS n, 'é' IS NFC NORMALIZED AS y, ROUND(LOG(2, 8), 6) AS l, COT(1.0) > 0 AS c") == [("é", True, 3.0, True)]
    assert rows(eng, "RETURN TRIM([1,2,3], 1) AS a, SIZE([1,2]) AS s, CARDINALITY(CAST(NULL AS LIST<INT64>)) AS n") == [([1, 2], 2, None)]
    assert rows(eng, "RETURN X'4142' || X'43' AS b")[0][0] == bytearray(b"ABC")


@pytest.mark.parametrize("bad", ["RETURN 1 / 0 AS x", "RETURN CAST('x' AS INT64) AS x", "RETURN DATE 'nope' AS x", "RETURN LN(0.0) AS x", "RETURN CAST(300 AS UINT8) AS x"])
def test_errors_not_nulls(eng, bad):
    with pytest.raises(Exception):  # noqa: B017
        eng.gql(bad).collect()


@pytest.mark.parametrize("bad", ["MATCH (a:Person) RETURN b", "RETURN $p AS x", "RETURN NOFUNC(1) AS x", "MATCH (a:Person) RETURN a LIMIT -1", "CALL nothing() RETURN 1 AS x"])
def test_query_errors(eng, bad):
    with pytest.raises(GraphQueryError):
        eng.gql(bad)


def test_whole_elements(eng):
    v = eng.gql("MATCH (a:Person {name: 'Ann'}) RETURN a").first()["a"]
    assert v["id"] == "Person:1" and v["labels"] == ["Person"] and v["properties"]["age"] == 30
    e = eng.gql("MATCH ()-[e:KNOWS WHERE e.w = 9]->() RETURN e").first()["e"]
    assert (e["src"], e["dst"], e["label"], e["undirected"], e["properties"]["w"]) == ("Person:1", "Person:3", "KNOWS", False, 9)


def test_element_predicates(eng):
    assert rows(eng, "MATCH (a)-[e:FRIEND]-(b) RETURN DISTINCT e IS DIRECTED AS d") == [(False,)]
    assert rows(eng, "MATCH (a:Person {name: 'Ann'})-[e:KNOWS]->(b) WHERE a IS SOURCE OF e AND b IS NOT SOURCE OF e AND b IS DESTINATION OF e RETURN COUNT(*) AS n") == [(3,)]
    assert rows(eng, "MATCH (a:Person)-[:KNOWS]->(b) WHERE a = b RETURN a.name AS n") == [("Dee",)]


def test_var_length_modes(eng):
    n = lambda mode, q: rows(eng, f"MATCH {mode} (a:Person {{name: 'Ann'}})-[:KNOWS]->{q}(b) RETURN COUNT(*) AS n")[0][0]
    assert n("", "{1,3}") == n("ACYCLIC", "{1,3}") == 5  # 1-2 twice, 1-2-3 twice, 1-3
    assert n("TRAIL", "{1,3}") == 3 + 3 + 4
    assert n("", "{0,1}") == 4
    assert n("", "*") == 6
    assert n("SIMPLE", "{3,3}") == 2
    assert n("WALK", "{2,2}") == 3
    with pytest.raises(GraphQueryError, match="never ends"):
        eng.gql("MATCH WALK (a:Person)-[:KNOWS]->*(b) RETURN a")


def test_group_variables(eng):
    got = rows(eng, "MATCH (a:Person {name: 'Ann'}) ((u)-[e:KNOWS]->(v) WHERE e.w < 6){2} (b) RETURN u.name AS us, v.name AS vs, e.w AS ws, SUM(e.w) AS s")
    assert got == [(["Ann", "Bob"], ["Bob", "Cid"], [3, 1], 4), (["Ann", "Bob"], ["Bob", "Cid"], [5, 1], 6)]
    assert rows(eng, "MATCH (a:Person {name: 'Ann'})-[e:KNOWS]->{0,0}(b) RETURN CARDINALITY(e) AS n, b.name AS b") == [(0, "Ann")]


def test_multi_hop_group(eng):
    assert rows(eng, "MATCH (a:Person {name: 'Ann'}) (-[:KNOWS]->()-[:KNOWS]->()){1} (b) RETURN b.name AS b") == [("Cid",), ("Cid",)]


def test_path_variables(dia):
    got = rows(dia, "MATCH p = (a {id: 1})-[:E]->{1,2}(b {id: 4}) RETURN PATH_LENGTH(p) AS n, NODES(p) AS v")
    assert got == [(1, ["N:1", "N:4"]), (2, ["N:1", "N:2", "N:4"]), (2, ["N:1", "N:3", "N:4"]), (2, ["N:1", "N:3", "N:4"])]
    assert rows(dia, "MATCH p = (a {id: 5})-[:E]->(b) RETURN ELEMENTS(p) AS x") == [(["N:5", "E:7", "N:6"],)]


def test_shortest(dia):
    one = lambda s: rows(dia, f"MATCH p = {s} (a {{id: 1}})-[:E]->{{1,5}}(b {{id: 4}}) RETURN PATH_LENGTH(p) AS n")
    assert one("ANY SHORTEST") == [(1,)]
    assert one("SHORTEST 3") == [(1,), (2,), (2,)]
    assert one("ALL SHORTEST") == [(1,)]
    assert rows(dia, "MATCH p = ALL SHORTEST (a {id: 2})-[:E]->*(b {id: 3}) RETURN PATH_LENGTH(p) AS n") == [(3,)]
    assert rows(dia, "MATCH p = ANY SHORTEST (a {id: 1})-[:E]->+(b {id: 1}) RETURN p") == []
    assert rows(dia, "MATCH p = ANY SHORTEST (a {id: 1})-[:E]->*(b {id: 1}) RETURN PATH_LENGTH(p) AS n") == [(0,)]
    assert rows(dia, "MATCH p = SHORTEST 2 GROUP (a {id: 1})-[:E]->{1,5}(b {id: 4}) RETURN CARDINALITY(p) AS n") == [(2,)]


def test_weighted(dia):
    best = rows(dia, "MATCH p = ANY SHORTEST (a {id: 1})-[e:E]->*(b {id: 4}) COST BY e.w RETURN PATH_LENGTH(p) AS n, SUM(e.w) AS w")
    assert best == [(3, 1.5)]
    got = rows(dia, "MATCH p = SHORTEST 3 (a {id: 1})-[e:E]->{1,2}(b {id: 4}) COST BY e.w RETURN SUM(e.w) AS w")
    assert got == [(2.0,), (2.0,), (2.0,)]
    assert len(rows(dia, "MATCH p = ALL SHORTEST (a {id: 1})-[e:E]->{1,2}(b {id: 4}) COST BY e.w RETURN PATH_LENGTH(p) AS n")) == 3
    assert rows(dia, "MATCH p = ANY SHORTEST (a {id: 1})-[e:E]->*(b {id: 4}) COST BY 1 RETURN PATH_LENGTH(p) AS n") == [(1,)]
    with pytest.raises(Exception, match="cost"):
        rows(dia, "MATCH p = ANY SHORTEST (a {id: 1})-[e:E]->*(b) COST BY e.w - 5 RETURN p")


def test_bound_far_end_goes_backwards(dia):
    assert rows(dia, "MATCH (b {id: 4}) MATCH p = ANY SHORTEST (a {id: 1})-[e:E]->{1,5}(b) COST BY e.w RETURN NODES(p) AS v") == [(["N:1", "N:5", "N:6", "N:4"],)]
    assert rows(dia, "MATCH (b {id: 4}) MATCH (a {id: 1})-[:E]->{3}(b) RETURN a.id AS a, b.id AS b") == [(1, 4)]


def brute(edges, start, low, high):
    """All acyclic paths of low to high edges."""
    out, todo = [], [(start, [start], [])]
    while todo:
        at, seen, used = todo.pop()
        if low <= len(used) <= high:
            out.append((at, tuple(used)))
        if len(used) < high:
            todo += [(b, [*seen, b], [*used, i]) for i, (a, b, _) in enumerate(edges) if a == at and b not in seen]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_digraphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(6), r.randrange(6), r.randrange(1, 9)) for _ in range(14)]
    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = spark.createDataFrame([(i, a, b, w) for i, (a, b, w) in enumerate(edges)], "eid long, a long, b long, w long")
    eng = Engine(spark, Graph().with_vertices("N", v, "id").with_edges("E", e, ("N", "a"), ("N", "b"), ["w"], "eid"))
    got = rows(eng, "MATCH (a:N)-[:E]->{1,3}(b:N) RETURN a.id AS a, b.id AS b, COUNT(*) AS n GROUP BY a.id, b.id")
    want = {}
    for s in range(6):
        for at, _ in brute(edges, s, 1, 3):
            want[s, at] = want.get((s, at), 0) + 1
    assert {(a, b): n for a, b, n in got} == want
    got = rows(eng, "MATCH p = ALL SHORTEST (a:N)-[:E]->{1,4}(b:N) RETURN a.id AS a, b.id AS b, PATH_LENGTH(p) AS l, COUNT(*) AS n GROUP BY a.id, b.id, PATH_LENGTH(p)")
    want = {}
    for s in range(6):
        found = brute(edges, s, 1, 4)
        for b in {x for x, _ in found}:
            least = min(len(u) for x, u in found if x == b)
            want[s, b] = (least, sum(1 for x, u in found if x == b and len(u) == least))
    assert {(a, b): (n, c) for a, b, n, c in got} == want
    got = rows(eng, "MATCH p = ANY SHORTEST (a:N)-[e:E]->{1,4}(b:N) COST BY e.w RETURN a.id AS a, b.id AS b, SUM(e.w) AS w")
    want = {}
    for s in range(6):
        for b, u in brute(edges, s, 1, 4):
            c = sum(edges[i][2] for i in u)
            want[s, b] = min(want.get((s, b), c), c)
    assert {(a, b): w for a, b, w in got} == want


def test_triangles(spark):
    r = random.Random(7)
    pairs = {(r.randrange(8), r.randrange(8)) for _ in range(30)}
    v = spark.createDataFrame([(i,) for i in range(8)], "id long")
    e = spark.createDataFrame(sorted(pairs), "a long, b long")
    eng = Engine(spark, Graph().with_vertices("N", v, "id").with_edges("E", e, ("N", "a"), ("N", "b")))
    want = sum((a, b) in pairs and (b, c) in pairs and (c, a) in pairs for a, b, c in itertools.product(range(8), repeat=3))
    assert rows(eng, "MATCH (a)-[:E]->(b)-[:E]->(c)-[:E]->(a) RETURN COUNT(*) AS n") == [(want,)]


def test_alternation(eng):
    assert rows(eng, "MATCH (a:Person {name: 'Ann'})-[:KNOWS]->(b) | (a:Person {name: 'Ann'})-[:LIVES]->(b) RETURN COUNT(*) AS n") == [(4,)]
    assert rows(eng, "MATCH (a:Person WHERE a.age > 28) |+| (a:Person WHERE a.age > 28) RETURN COUNT(*) AS n") == [(4,)]
    assert rows(eng, "MATCH (a:Person WHERE a.age > 28) | (a:Person WHERE a.age > 28) RETURN COUNT(*) AS n") == [(2,)]


def test_any_k(eng):
    assert rows(eng, "MATCH ANY 1 (a {name: 'Ann'})-[e:KNOWS]->(b {name: 'Bob'}) RETURN COUNT(*) AS n") == [(1,)]


def test_select_and_next(eng):
    assert rows(eng, "SELECT p.name AS n FROM MATCH (p:Person) WHERE p.age > 26 ORDER BY n LIMIT 1") == [("Ann",)]
    assert rows(eng, "MATCH (a:Person) RETURN a NEXT MATCH (a)-[:LIVES]->(p) RETURN a.name AS n, p.name AS p") == [("Ann", "Here"), ("Bob", "Here"), ("Cid", "There")]


def test_search(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], 2), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [-1.0, 0.0], 2)], "id long, e array<double>, c int")
    eng = Engine(spark, Graph().with_vertices("V", v, "id"))
    eng.execute("CREATE VECTOR INDEX l FOR (v:V) ON (v.e) OPTIONS {dims: 2, metric: 'l2'}; CREATE VECTOR INDEX c FOR (v:V) ON (v.e) OPTIONS {metric: 'cosine'}")
    assert rows(eng, "SEARCH v IN (VECTOR INDEX l FOR $q LIMIT 3) DISTANCE AS d RETURN v.id AS i, d", q=[0.0, 0.0]) == [(1, 0.0), (2, 1.0), (6, 1.0)]
    assert rows(eng, "SEARCH v IN (VECTOR INDEX l FOR [0.0, 0.0] WHERE v.c = 2 LIMIT 1) DISTANCE AS d RETURN v.id AS i") == [(6,)]
    assert rows(eng, "SEARCH v IN (VECTOR INDEX c FOR [1.0, 0.0] LIMIT 2) SCORE AS s RETURN v.id AS i, s") == [(2, 1.0), (3, 0.0)]
    assert rows(eng, "MATCH (v:V {id: 3}) SEARCH v IN (VECTOR INDEX l FOR [0.0, 0.0] LIMIT 2) DISTANCE AS d RETURN v.id AS i") == []
    assert eng.vector_search("l", [0.0, 0.0], 1).collect()[0]["id"] == "V:1"
    eng.execute("CREATE VECTOR INDEX b FOR (v:V) ON (v.e) OPTIONS {metric: 'l2', encoding: 'i8'}; CREATE VECTOR INDEX bc FOR (v:V) ON (v.e) OPTIONS {metric: 'cosine', encoding: 'i8'}")
    assert rows(eng, "SEARCH v IN (VECTOR INDEX b FOR [1.0, 0.5] LIMIT 1) DISTANCE AS d RETURN v.id AS i, d") == [(2, 0.25)]
    assert rows(eng, "SEARCH v IN (VECTOR INDEX bc FOR [2.0, 0.0] LIMIT 1) SCORE AS s RETURN v.id AS i, s") == [(2, 1.0)]
    for bad in ("SEARCH v IN (VECTOR INDEX l FOR [0.0, 0.0] LIMIT 0) DISTANCE AS d RETURN d", "SEARCH v IN (VECTOR INDEX l FOR [0.0, 0.0] LIMIT 1) SCORE AS d RETURN d", "SEARCH v IN (VECTOR INDEX l FOR [0.0] LIMIT 1) DISTANCE AS d RETURN d", "SEARCH v IN (VECTOR INDEX c FOR [0.0, 0.0] LIMIT 1) SCORE AS d RETURN d"):
        with pytest.raises(ValueError):
            eng.gql(bad)


def test_plan_pushes_filters_and_columns(spark, tmp_path):
    people = spark.createDataFrame([(i, f"n{i}", i % 7, "x" * 50) for i in range(100)], "id long, name string, age int, blob string")
    people.write.parquet(str(tmp_path / "p"))
    eng = Engine(spark, Graph().with_vertices("P", spark.read.parquet(str(tmp_path / "p")), "id"))
    plan = eng.explain("MATCH (p:P) WHERE p.age = $a RETURN p.name AS n", {"a": 3})
    assert "PushedFilters: [IsNotNull(age), EqualTo(age,3)]" in plan and "blob" not in plan.split("Physical Plan")[-1]


def test_ends_are_not_read(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "v"))
    e = spark.createDataFrame([(1, 2)], "a long, b long")
    eng = Engine(spark, Graph().with_vertices("P", spark.read.parquet(str(tmp_path / "v")), "id").with_edges("E", e, ("P", "a"), ("P", "b")))
    df = eng.gql("MATCH (a:P)-[:E]->(b:P) RETURN COUNT(*) AS n")
    assert "parquet" not in df._jdf.queryExecution().toString().lower() and df.first()[0] == 1


def test_match_modes_and_counted_paths(spark):
    d = Engine(spark, diamond(spark))
    q = "MATCH {} (a:N {{id: 1}})-[:E]->{{2}}(b) RETURN COUNT(*) AS n"
    assert rows(d, q.format("")) == [(4,)]
    assert rows(d, q.format("REPEATABLE ELEMENTS")) == [(5,)]
    assert rows(d, q.format("REPEATABLE ELEMENTS ACYCLIC")) == [(4,)]
    assert rows(d, "MATCH p = COUNT PATHS (a:N {id: 1})-[:E]->{1,2}(b:N) RETURN b.id AS b, p AS n") == [(2, 1), (3, 1), (4, 4), (5, 1), (6, 1)]
    assert rows(d, "MATCH (a:N {id: 1}) MATCH COUNT PATHS (a)-[:E]->{2}(b:N {id: 4}) RETURN a.id AS a, b.id AS b") == [(1, 4)]
    with pytest.raises(GraphQueryError):
        d.gql("MATCH REPEATABLE ELEMENTS (a:N)-[:E]->*(b) RETURN COUNT(*) AS n")


def test_paths_without_turns_come_first(spark, eng):
    """Pairs of all who live in one place are made only if nothing joins them otherwise."""
    q = "MATCH (a:Person)-[:LIVES]->(p)<-[:LIVES]-(b:Person), (a)-[k:KNOWS]->(b) RETURN a.name AS a, b.name AS b, k.w AS w"
    assert rows(eng, q) == [("Ann", "Bob", 3), ("Ann", "Bob", 5)]
    assert rows(eng, "MATCH (a:Person)-[:LIVES]->(p)<-[:LIVES]-(b:Person WHERE b.age IS NULL), (c:Person WHERE c.id > a.id)-[:KNOWS]->(b) RETURN a.name AS a, c.name AS c") == []


def test_rollback_takes_all_back(spark):
    e = Engine(spark, social(spark))
    e.execute("START TRANSACTION")
    e.execute("CREATE INDEX by_age FOR (p:Person) ON (p.age)")
    e.execute("CREATE GRAPH other LIKE default")
    e.execute("MATCH (p:Person) SET p.name = 'x'")
    e.execute("ROLLBACK")
    assert not e.catalog.indexes and list(e.catalog.graphs) == ["default"] and ("Ann",) in rows(e, "MATCH (p:Person) RETURN p.name AS n")
