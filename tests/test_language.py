"""The grammar: what parses, what doesn't, and that formatting gives an equal tree."""

import pytest

from graphloom.gql import ParseError, format_program, parse
from graphloom.gql import ast as A
from graphloom.gql.lexer import tokenize
from graphloom.tpch_queries import QUERIES

GOOD = [
    "RETURN 1",
    "MATCH (a)-[e:K|L&!M {x: 1} WHERE e.y > 2]->(b:P&Q) RETURN a, e, b",
    "MATCH (a)<-[e]-(b), (c)~[]~(d), (e1)<-[]->(f), (g)~[]~>(h), (i)<~[]~(j), (k)-[]-(l), (m)<~[]~>(n) RETURN *",
    "MATCH (a)->(b)<-(c)~(d)-(e) RETURN a",
    "MATCH p = TRAIL (a)-[:K]->{2,5}(b)-[:L]->+(c)-[:M]->?(d)-[:N]->*(e)-[:O]->{3}(f)-[:P]->{,4}(g)-[:Q]->{1,}(h) RETURN p",
    "MATCH ALL SHORTEST (a)-[:K]->*(b) RETURN a",
    "MATCH SHORTEST 3 GROUPS (a)-[:K]->*(b) RETURN a",
    "MATCH ANY 2 (a)-[:K]->(b) RETURN a",
    "MATCH (a)-/K|L/->(b), (a)-/K L/->(c), (a)~/K/~(d), (a)-/(K L)+/->(e) RETURN a",
    "MATCH ((u)-[e:K]->(v) WHERE u.x < v.x){1,3} (z) RETURN e",
    "MATCH (a) WHERE a:X AND a IS NOT LABELED Y|Z RETURN a",
    "MATCH (a) OPTIONAL MATCH (a)->(b) OPTIONAL { MATCH (b)->(c) } RETURN a",
    "MATCH (a) CALL { MATCH (b) RETURN b } OPTIONAL CALL (a) { RETURN a.x AS y } RETURN y",
    "MATCH (a) RETURN a.x AS x, COUNT(DISTINCT a.y) AS n GROUP BY a.x HAVING COUNT(*) > 1 ORDER BY n DESC NULLS LAST, x OFFSET 2 LIMIT 3",
    "MATCH (a) RETURN PERCENTILE_CONT(a.x, 0.5) AS p, COLLECT_LIST(a.x ORDER BY a.y DESC) AS l",
    "FOR x IN [1, 2.5, 'z', NULL, TRUE] WITH OFFSET i RETURN x, i NEXT YIELD x RETURN x",
    "LET a = 1, b = 'it''s', c = X'ff00', d = 0x1F, e = 1_000, f = 1.5M, g = 2e3 RETURN a",
    "RETURN CASE WHEN 1 = 1 THEN 'a' END AS x, CASE 1 WHEN 1, 2 THEN 3 ELSE 4 END AS y",
    "RETURN {a: 1, b: [1, 2]}.b[0] AS x, [1,2,3][1..] AS y, 'a' || 'b' AS z",
    "RETURN CAST('1' AS INT64) AS a, DATE '2020-01-02' AS b, DURATION('P1DT2H') AS c",
    "RETURN 1 < -2 AS a, 1 <- 2 AS b, - - 3 AS c",
    "MATCH (a) WHERE EXISTS { (a)->() } AND NOT EXISTS { MATCH (a)->(b) RETURN b } RETURN VALUE { RETURN 1 AS x } AS v",
    "USE g MATCH (a) RETURN a UNION ALL MATCH (b) RETURN b AS a EXCEPT MATCH (c) RETURN c AS a OTHERWISE RETURN 1 AS a",
    'MATCH ("odd name":`an other`) RETURN "odd name"."p q" AS "r s"',
    "// line\nRETURN /* nested /* deep */ */ 1 AS x -- end",
    "INSERT (a:P {x: 1})-[:K]->(b), (b)~[:L]~(c)",
    "MATCH (a) SET a.x = 1, a = {y: 2}, a IS L REMOVE a.z, a:M",
    "MATCH (a) DETACH DELETE a",
    "SEARCH v IN (VECTOR INDEX i FOR [1.0, 2.0] WHERE v.x = 1 LIMIT 3) SCORE AS s RETURN s",
    "SELECT DISTINCT a.x AS x FROM MATCH (a) WHERE a.x > 1 ORDER BY x LIMIT 1",
    "FINISH",
    "MATCH DIFFERENT EDGES (a)-[x]->(b)-[y]->(c) KEEP ANY SHORTEST WHERE x.w = 1 RETURN a",
]
BAD = ["", "MATCH (a", "MATCH (a)-[->(b) RETURN a", "RETURN", "RETURN 1 +", "MATCH (a) RETURN a LIMIT", "FOR x [1] RETURN x", "RETURN 'open", "RETURN /* open", "MATCH (a)-[e]~>(b) RETURN a", "RETURN CASE END", "RETURN CAST(1)", "MATCH (a)-[:K]->{3,1}(b) RETURN a", "RETURN $", "CREATE NOTHING x", "RETURN 'a\\q'", "LET x RETURN x"]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    tree = parse(text)
    assert tree


@pytest.mark.parametrize("text", GOOD + [q[0] for q in QUERIES.values() if isinstance(q[0], str)])
def test_format_round_trip(text):
    tree = parse(text)
    assert parse(format_program(tree)) == tree


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    with pytest.raises(ParseError):
        parse(text)


def test_error_says_where():
    with pytest.raises(ParseError, match="line 2, column 8"):
        parse("MATCH (a)\nRETURN ")


def test_tokens():
    kinds = [(t.kind, t.value) for t in tokenize("a 'x' $p 1.5 0b101 [1..2] X'00' @'\\n'")][:-1]
    assert kinds == [("name", "a"), ("string", "x"), ("param", "p"), ("number", 1.5), ("number", 5), ("op", "["), ("number", 1), ("op", ".."), ("number", 2), ("op", "]"), ("bytes", b"\x00"), ("string", "\\n")]


def test_precedence():
    e = parse("RETURN NOT a = 1 AND b OR c + 2 * 3 < 4")[0].statements[0].first.clauses[0].items[0][0]
    assert e.kind == "or" and e.args[0].kind == "and" and e.args[0].args[0].kind == "not"
    assert e.args[1].args[0].args[1].data == "*"


def test_catalog_statements():
    s = parse("CREATE GRAPH TYPE IF NOT EXISTS t AS { (User :User {id STRING NOT NULL, n INT}), (:User)-[:FOLLOWS {w FLOAT64}]->(:User) }")[0].statements[0]
    assert isinstance(s, A.Catalog) and s.action == "create_graph_type" and len(s.data["elements"]) == 2
    assert parse("DROP GRAPH IF EXISTS g")[0].statements[0].data["if_exists"]
    v = parse("CREATE VECTOR INDEX i FOR (v:Doc) ON (v.emb) OPTIONS {dims: 4, metric: 'cosine'}")[0].statements[0]
    assert v.data["props"] == ["emb"] and v.data["options"] == {"dims": 4, "metric": "cosine"}
    assert [s.statements[0].action for s in parse("SESSION SET GRAPH g; SESSION SET VALUE $x = 1; SESSION RESET; START TRANSACTION; COMMIT; ROLLBACK; SESSION CLOSE")] == ["session_graph", "session_param", "session_reset", "start_transaction", "commit", "rollback", "session_close"]
