"""name: (query in the graph language or a function of the engine, the same in SQL)."""

from __future__ import annotations

from .plans.scope import GraphQueryError

_TURNS = "turns AS (SELECT conv_id*1000+turn AS k, conv_id, turn, role, CAST(length(text) AS BIGINT) AS n FROM conversations)"
_TRADES = "trades AS (SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, count(*) AS trade_count, CAST(round(sum(l_extendedprice),0) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2)"
_NEAR = "near AS (SELECT n_nationkey AS a, (n_nationkey*7+3)%25 AS b FROM nation), und AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near WHERE a<>b)"
_DIST = "list_sum(list_transform(range(1,65), lambda i: (CAST(x.embedding[i] AS DOUBLE)-CAST(y.embedding[i] AS DOUBLE))*(CAST(x.embedding[i] AS DOUBLE)-CAST(y.embedding[i] AS DOUBLE))))"


def _params(text: str, **params):
    return lambda e: e.gql(text, params)


def _vector(e):
    q = e.gql("MATCH (v:Vec {vec_id: 0}) RETURN v.embedding AS q").first()["q"]
    return e.gql("SEARCH v IN (VECTOR INDEX vec_l2 FOR $q LIMIT 10) DISTANCE AS d RETURN v.vec_id AS vec_id, ROUND(d, 4) AS d", {"q": list(q)})


def _cosine(e):
    q = e.gql("MATCH (v:Vec {vec_id: 3}) RETURN v.embedding AS q").first()["q"]
    return e.gql("SEARCH v IN (VECTOR INDEX vec_cos FOR $q WHERE v.label >= 1 LIMIT 5) SCORE AS s RETURN v.vec_id AS vec_id, ROUND(s, 4) AS s", {"q": list(q)})


def _search_join(e):
    q = e.gql("MATCH (v:Vec {vec_id: 0}) RETURN v.embedding AS q").first()["q"]
    return e.gql("MATCH (v:Vec) WHERE v.label = 1 SEARCH v IN (VECTOR INDEX vec_l2 FOR $q LIMIT 40) DISTANCE AS d RETURN v.vec_id AS vec_id", {"q": list(q)})


def _changed(*statements: str):
    """Changing statements over the graph without its large tables, then a query."""

    def run(e):
        for s in statements[:-1]:
            e.execute(s)
        return e.gql(statements[-1])

    return run


def _prepared(e):
    e.prepare("by_segment", "MATCH (c:Customer {c_mktsegment: $seg}) RETURN c.c_custkey AS k, c.c_acctbal AS bal ORDER BY bal DESC, k LIMIT 20", ["bal ASC, k"])
    return e.run("by_segment", {"seg": "BUILDING"}, "bal ASC, k")


def _two_graphs(e):
    e.execute("CREATE GRAPH other LIKE default")
    return e.gql("MATCH (n:Nation) WHERE n.n_nationkey < 5 CALL (n) { USE other MATCH (m:Nation)-[:NATION_IN]->(r) WHERE m.n_nationkey = n.n_nationkey RETURN r.r_name AS region } RETURN n.n_name AS nation, region")


def _two_graphs_all(e):
    e.execute("CREATE GRAPH other LIKE default")
    return e.gql("MATCH (n:Nation) CALL (n) { USE other MATCH (m:Nation)-[:NATION_IN]->(r) WHERE m.n_nationkey = n.n_nationkey RETURN r.r_name AS region } RETURN n.n_name AS nation, region")


def _bytes(e):
    """An index of signed bytes finds what is near: the query itself first, all distances in order."""
    e.execute("CREATE VECTOR INDEX vec_i8 FOR (v:Vec) ON (v.embedding) OPTIONS {dims: 64, metric: 'l2', encoding: 'i8'}")
    q = list(e.gql("MATCH (v:Vec {vec_id: 0}) RETURN v.embedding AS q").first()["q"])
    hits = e.gql("SEARCH v IN (VECTOR INDEX vec_i8 FOR $q LIMIT 10) DISTANCE AS d RETURN v.vec_id AS vec_id, d AS d", {"q": q})
    return hits.selectExpr("min_by(vec_id, d) = 0 AS near", "min(d) >= 0 AS ordered", "count(*) AS n") if hits else None


def _many(e):
    q = list(e.gql("MATCH (v:Vec {vec_id: 0}) RETURN v.embedding AS q").first()["q"])
    return e.gql("SEARCH v IN (VECTOR INDEX vec_l2 FOR $q LIMIT 1024) DISTANCE AS d RETURN COUNT(*) AS n", {"q": q})


def _refused(e, text: str):
    """All regions, if the change is refused; else none."""
    try:
        e.execute(text)
    except GraphQueryError:
        return e.gql("MATCH (r:Region) RETURN r.r_name AS r")
    return e.gql("MATCH (r:Region {r_name: 'accepted'}) RETURN r.r_name AS r")


def _constrained(e):
    """How many regions there are after a second one of a unique name is refused."""
    e.execute("CREATE CONSTRAINT one_name FOR (r:Region) REQUIRE r.r_name IS UNIQUE")
    try:
        e.execute("INSERT (:Region {r_regionkey: 77, r_name: 'ASIA'})")
    except GraphQueryError:
        pass
    return e.gql("MATCH (r:Region) RETURN COUNT(*) AS n")


QUERIES: dict[str, tuple] = {
    "flagship": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:NATION_IN]->(r:Region) WHERE r.r_name='ASIA' RETURN n.n_name AS nation, COUNT(*) AS customers GROUP BY n.n_name ORDER BY customers DESC, nation LIMIT 10",
        "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    # scans
    "node_scan": ("MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.s_name AS name, s.s_acctbal AS bal", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier"),
    "index_scan_eq": (_params("MATCH (c:Customer {c_mktsegment: $s}) RETURN c.c_custkey AS k", s="BUILDING"), "SELECT c_custkey AS k FROM customer WHERE c_mktsegment='BUILDING'"),
    "index_scan_range": (_params("MATCH (o:Order) WHERE o.o_totalprice >= $a AND o.o_totalprice < $b RETURN o.o_orderkey AS k", a=1000.0, b=50000.0), "SELECT o_orderkey AS k FROM orders WHERE o_totalprice>=1000 AND o_totalprice<50000"),
    "index_scan_null": (_params("MATCH (c:Customer {c_mktsegment: $s}) RETURN c.c_custkey AS k", s=None), "SELECT c_custkey AS k FROM customer WHERE FALSE"),
    "edge_index_scan": ("MATCH -[e:CONTAINS {l_returnflag: 'R', l_linenumber: 1}]-> RETURN e.l_orderkey AS o, e.l_partkey AS p", "SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag='R' AND l_linenumber=1"),
    "edge_bind_endpoints": ("MATCH (a)-[e:PLACED]->(b) WHERE e IS DIRECTED AND a IS SOURCE OF e AND b IS DESTINATION OF e RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM orders"),
    "conditional_scan_on": (_params("MATCH (c:Customer) WHERE $s IS NULL OR c.c_mktsegment = $s RETURN COUNT(*) AS n", s="MACHINERY"), "SELECT count(*) AS n FROM customer WHERE c_mktsegment='MACHINERY'"),
    "conditional_scan_off": (_params("MATCH (c:Customer) WHERE $s IS NULL OR c.c_mktsegment = $s RETURN COUNT(*) AS n", s=None), "SELECT count(*) AS n FROM customer"),
    "index_intersection": (lambda e: e.gql("MATCH (p:Part {p_size: 10, p_brand: 'Brand#11'}) RETURN p.p_partkey AS k"), "SELECT p_partkey AS k FROM part WHERE p_size=10 AND p_brand='Brand#11'"),
    "count_by_value": (lambda e: e.count_by_value("Order", "o_orderpriority"), "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1"),
    "lookup_range": (lambda e: e.gql("MATCH (v:Part) WHERE v.p_size >= 5 AND v.p_size < 9 RETURN v.p_partkey AS k"), "SELECT p_partkey AS k FROM part WHERE p_size>=5 AND p_size<9"),
    "filter_hits_by_equal": (lambda e: e.filter_hits(e.gql("MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN ELEMENT_ID(c) AS id"), "Customer", "c_mktsegment", "BUILDING"), "SELECT 'Customer:'||c_custkey AS id FROM customer WHERE c_acctbal>5000 AND c_mktsegment='BUILDING'"),
    "lookup_edge_equal": (lambda e: e.gql("MATCH ()-[e:CONTAINS WHERE e.l_quantity = 7]->() RETURN COUNT(e) AS n"), "SELECT count(*) AS n FROM lineitem WHERE l_quantity=7"),
    "unit_row": ("RETURN 1 + 2 AS three, 'a' || 'b' AS ab", "SELECT 3 AS three, 'ab' AS ab"),
    "limit_prefix": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN COUNT(*) AS n LIMIT 1", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey"),
    # filters, projections
    "filter_clause": ("MATCH (p:Part) FILTER WHERE p.p_size > 40 AND p.p_retailprice < 1500 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size>40 AND p_retailprice<1500"),
    "project_distinct": ("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "next_yield": ("MATCH (c:Customer) RETURN c.c_nationkey AS n, SUM(c.c_acctbal) AS total GROUP BY c.c_nationkey NEXT YIELD n, total FILTER total > 0 RETURN n, ROUND(total, 2) AS total", "SELECT n, round(total,2) AS total FROM (SELECT c_nationkey AS n, sum(c_acctbal) AS total FROM customer GROUP BY 1) WHERE total>0"),
    "let_clause": ("MATCH (p:Part) LET gross = p.p_retailprice * 1.25, big = gross > 1500 FILTER big RETURN p.p_partkey AS k, ROUND(gross, 4) AS gross", "SELECT p_partkey AS k, round(p_retailprice*1.25,4) AS gross FROM part WHERE p_retailprice*1.25>1500"),
    "for_unnest": ("MATCH (r:Region) FOR x IN [10, 20, 30] WITH ORDINALITY i RETURN r.r_name AS r, x, i", "SELECT r_name AS r, x, i FROM region, (VALUES (10, CAST(1 AS BIGINT)), (20, 2), (30, 3)) v(x, i)"),
    "for_offset": ("FOR x IN ['a', 'b'] WITH OFFSET i RETURN x, i", "SELECT x, i FROM (VALUES ('a', CAST(0 AS BIGINT)), ('b', 1)) v(x, i)"),
    "finish": ("MATCH (r:Region) RETURN r.r_name AS n NEXT FILTER n = 'nowhere' RETURN n", "SELECT r_name AS n FROM region WHERE FALSE"),
    "select_from": ("SELECT c.c_custkey AS k, n.n_name AS nation FROM default MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.c_acctbal < 0 ORDER BY k LIMIT 50", "SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_acctbal<0 ORDER BY 1 LIMIT 50"),
    "use_graph": (_two_graphs, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey<5"),
    "use_graph_all": (_two_graphs_all, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "call_correlated": ("MATCH (n:Nation) CALL (n) { MATCH (n)<-[:LIVES_IN]-(c:Customer) RETURN COUNT(*) AS customers, MAX(c.c_acctbal) AS top } RETURN n.n_name AS nation, customers, top", "SELECT n_name AS nation, count(*) AS customers, max(c_acctbal) AS top FROM nation JOIN customer ON c_nationkey=n_nationkey GROUP BY n_nationkey, n_name"),
    "call_top_per_row": ("MATCH (n:Nation) CALL (n) { MATCH (n)<-[:LIVES_IN]-(c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_acctbal DESC, k LIMIT 2 } RETURN n.n_nationkey AS n, k", "SELECT n, k FROM (SELECT c_nationkey AS n, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r<=2"),
    "optional_call": ("MATCH (r:Region) OPTIONAL CALL (r) { MATCH (r)<-[:NATION_IN]-(n:Nation) WHERE n.n_name STARTS WITH 'I' RETURN n.n_name AS nation } RETURN r.r_name AS region, nation", "SELECT r_name AS region, n_name AS nation FROM region LEFT JOIN nation ON n_regionkey=r_regionkey AND n_name LIKE 'I%'"),
    # traversal
    "expand_right": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, COUNT(o) AS n GROUP BY c.c_custkey", "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1"),
    "expand_left": ("MATCH (s:Supplier)<-[e:SUPPLIED_BY]-(o:Order) RETURN s.s_suppkey AS s, ROUND(SUM(e.l_extendedprice), 2) AS total GROUP BY s.s_suppkey", "SELECT s_suppkey AS s, round(sum(l_extendedprice),2) AS total FROM supplier JOIN lineitem ON l_suppkey=s_suppkey GROUP BY 1"),
    "expand_filter": ("MATCH (o:Order)-[e:CONTAINS]->(p:Part WHERE p.p_size = 1) WHERE e.l_discount > 0.05 RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey WHERE p_size=1 AND l_discount>0.05"),
    "expand_undirected": ("MATCH (a:Nation)~[:NEAR]~(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH {_NEAR} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM und"),
    "expand_left_or_right": ("MATCH (a:Nation {n_nationkey: 3})<-[:TRADES]->(b:Nation) RETURN b.n_nationkey AS b, COUNT(*) AS n GROUP BY b.n_nationkey", f"WITH {_TRADES} SELECT x AS b, count(*) AS n FROM (SELECT b AS x FROM trades WHERE a=3 UNION ALL SELECT a FROM trades WHERE b=3) GROUP BY 1"),
    "expand_any": ("MATCH (a:Nation {n_nationkey: 3})-[e]-(b:Nation) RETURN TYPE(e) AS t, COUNT(*) AS n GROUP BY TYPE(e)", f"WITH {_TRADES}, {_NEAR} SELECT 'TRADES' AS t, (SELECT count(*) FROM trades WHERE a=3)+(SELECT count(*) FROM trades WHERE b=3) AS n UNION ALL SELECT 'NEAR', (SELECT count(*) FROM und WHERE a=3)"),
    "expand_undirected_or_right": ("MATCH (a:Nation {n_nationkey: 3})~[e]~>(b:Nation) RETURN COUNT(*) AS n", f"WITH {_TRADES}, {_NEAR} SELECT (SELECT count(*) FROM trades WHERE a=3)+(SELECT count(*) FROM und WHERE a=3) AS n"),
    "expand_left_or_undirected": ("MATCH (a:Nation {n_nationkey: 3})<~[e]~(b:Nation) RETURN COUNT(*) AS n", f"WITH {_TRADES}, {_NEAR} SELECT (SELECT count(*) FROM trades WHERE b=3)+(SELECT count(*) FROM und WHERE a=3) AS n"),
    "edge_label_expression": ("MATCH (a)-[e:LIVES_IN|BASED_IN&!PLACED]->(n:Nation) RETURN n.n_nationkey AS n, COUNT(*) AS c GROUP BY n.n_nationkey", "SELECT CAST(k AS BIGINT) AS n, count(*) AS c FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "node_label_expression": ("MATCH (x:Customer|Supplier) RETURN LABEL(x) AS l, COUNT(*) AS n GROUP BY LABEL(x)", "SELECT 'Customer' AS l, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier"),
    "node_label_negation": ("MATCH (x:!Customer&!Order)-[:BASED_IN]->(n) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM supplier"),
    "edge_property_equality": ("MATCH (o:Order)-[e:CONTAINS {l_linenumber: 2}]->(p:Part) RETURN COUNT(*) AS n, SUM(e.l_quantity) AS q", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber=2"),
    "prebound_destination": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey=s_nationkey JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey AND l_suppkey=s_suppkey"),
    "var_length": ("MATCH (a:Turn {turn_no: 0})-[:NEXT]->{1,3}(b:Turn) RETURN a.turn_key AS a, b.turn_key AS b", f"WITH {_TURNS} SELECT a.k AS a, b.k AS b FROM turns a JOIN turns b ON a.conv_id=b.conv_id AND b.turn BETWEEN a.turn+1 AND a.turn+3 WHERE a.turn=0 AND (SELECT count(*) FROM turns t WHERE t.conv_id=a.conv_id AND t.turn>a.turn AND t.turn<=b.turn)=b.turn-a.turn"),
    "var_length_zero": ("MATCH (a:Turn {turn_no: 0})-[:NEXT]->{0,1}(b:Turn) RETURN COUNT(*) AS n", f"WITH {_TURNS} SELECT count(*) AS n FROM turns a JOIN turns b ON a.conv_id=b.conv_id AND b.turn IN (a.turn, a.turn+1) WHERE a.turn=0"),
    "var_length_star": ("MATCH (a:Turn {turn_no: 0})-[:NEXT]->*(b:Turn) RETURN COUNT(*) AS n", f"WITH RECURSIVE {_TURNS}, r AS (SELECT k AS a, k AS b FROM turns WHERE turn=0 UNION ALL SELECT r.a, t.k FROM r JOIN turns t ON t.k=r.b+1 AND t.turn>0) SELECT count(*) AS n FROM r"),
    "var_length_acyclic": ("MATCH (a:Nation {n_nationkey: 0})-[:TRADES WHERE 1 = 1]->{2}(b:Nation) RETURN b.n_nationkey AS b, COUNT(*) AS n GROUP BY b.n_nationkey", f"WITH {_TRADES} SELECT y.b AS b, count(*) AS n FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=0 AND x.b<>0 AND y.b<>0 AND y.b<>x.b GROUP BY 1"),
    "trail_mode": ("MATCH TRAIL (a:Nation {n_nationkey: 0})-[:TRADES]->{2}(b:Nation) RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=0 AND NOT (x.a=y.a AND x.b=y.b)"),
    "walk_mode": ("MATCH WALK (a:Nation {n_nationkey: 0})-[:TRADES]->{2}(b:Nation) RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=0"),
    "group_variables": ("MATCH (a:Turn {turn_no: 0}) ((u)-[e:NEXT]->(v)){2,2} (b:Turn) RETURN a.turn_key AS a, CARDINALITY(e) AS hops, u.turn_no AS us, v.turn_no AS vs", f"WITH {_TURNS} SELECT a.k AS a, CAST(2 AS BIGINT) AS hops, [CAST(0 AS BIGINT), CAST(1 AS BIGINT)] AS us, [CAST(1 AS BIGINT), CAST(2 AS BIGINT)] AS vs FROM turns a JOIN turns m ON m.k=a.k+1 AND m.conv_id=a.conv_id JOIN turns b ON b.k=a.k+2 AND b.conv_id=a.conv_id WHERE a.turn=0"),
    "group_sum": ("MATCH (a:Nation {n_nationkey: 1})-[e:TRADES]->{2}(b:Nation {n_nationkey: 2}) RETURN SUM(e.weight) AS w", f"WITH {_TRADES} SELECT CAST(x.weight+y.weight AS BIGINT) AS w FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=1 AND y.b=2 AND x.b NOT IN (1,2)"),
    "path_variable": ("MATCH p = (a:Turn {turn_no: 0})-[:NEXT]->{1,2}(b:Turn) RETURN PATH_LENGTH(p) AS len, COUNT(*) AS n GROUP BY PATH_LENGTH(p)", f"WITH {_TURNS} SELECT CAST(b.turn AS BIGINT) AS len, count(*) AS n FROM turns a JOIN turns b ON a.conv_id=b.conv_id AND b.turn IN (1,2) WHERE a.turn=0 GROUP BY 1"),
    "any_shortest": ("MATCH p = ANY SHORTEST (a:Turn {turn_no: 0})-[:NEXT]->{1,6}(b:Turn) RETURN b.turn_key AS b, PATH_LENGTH(p) AS len", f"WITH {_TURNS} SELECT b.k AS b, CAST(b.turn AS BIGINT) AS len FROM turns a JOIN turns b ON a.conv_id=b.conv_id AND b.turn BETWEEN 1 AND 6 WHERE a.turn=0"),
    "all_shortest": ("MATCH p = ALL SHORTEST (a:Nation {n_nationkey: 0})~[:NEAR]~{1,6}(b:Nation) RETURN b.n_nationkey AS b, PATH_LENGTH(p) AS len, COUNT(*) AS n GROUP BY b.n_nationkey, PATH_LENGTH(p)", f"WITH RECURSIVE {_NEAR}, r AS (SELECT 0 AS b, 0 AS len, [0] AS v UNION ALL SELECT und.b, r.len+1, list_append(r.v, und.b) FROM r JOIN und ON und.a=r.b WHERE r.len<6 AND NOT list_contains(r.v, und.b)), m AS (SELECT b, min(len) AS len FROM r WHERE len>0 GROUP BY b) SELECT CAST(r.b AS BIGINT) AS b, CAST(r.len AS BIGINT) AS len, count(*) AS n FROM r JOIN m ON r.b=m.b AND r.len=m.len GROUP BY 1,2"),
    "shortest_k": ("MATCH p = SHORTEST 3 (a:Nation {n_nationkey: 0})-[:TRADES]->{1,2}(b:Nation) RETURN b.n_nationkey AS b, PATH_LENGTH(p) AS len, COUNT(*) AS n GROUP BY b.n_nationkey, PATH_LENGTH(p)", f"WITH {_TRADES}, p AS (SELECT b, 1 AS len FROM trades WHERE a=0 AND b<>0 UNION ALL SELECT y.b, 2 FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=0 AND x.b<>0 AND y.b<>0 AND y.b<>x.b), q AS (SELECT b, len, row_number() OVER (PARTITION BY b ORDER BY len) AS r FROM p) SELECT b, CAST(len AS BIGINT) AS len, count(*) AS n FROM q WHERE r<=3 GROUP BY 1,2"),
    "shortest_k_group": ("MATCH p = SHORTEST 3 GROUP (a:Nation {n_nationkey: 0})-[:TRADES]->{1,2}(b:Nation) RETURN b.n_nationkey AS b, CARDINALITY(p) AS n", f"WITH {_TRADES}, p AS (SELECT b FROM trades WHERE a=0 AND b<>0 UNION ALL SELECT y.b FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=0 AND x.b<>0 AND y.b<>0 AND y.b<>x.b) SELECT b, CAST(least(count(*),3) AS BIGINT) AS n FROM p GROUP BY 1"),
    "weighted_shortest": ("MATCH p = ANY SHORTEST (a:Nation {n_nationkey: 0})-[e:TRADES]->{1,3}(b:Nation) COST BY e.weight RETURN b.n_nationkey AS b, SUM(e.weight) AS cost", f"WITH {_TRADES}, p AS (SELECT b, weight AS w FROM trades WHERE a=0 AND b<>0 UNION ALL SELECT y.b, x.weight+y.weight FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=0 AND x.b<>0 AND y.b<>0 AND y.b<>x.b UNION ALL SELECT z.b, x.weight+y.weight+z.weight FROM trades x JOIN trades y ON x.b=y.a JOIN trades z ON y.b=z.a WHERE x.a=0 AND x.b<>0 AND y.b NOT IN (0,x.b) AND z.b NOT IN (0,x.b,y.b)) SELECT b, CAST(min(w) AS BIGINT) AS cost FROM p GROUP BY 1"),
    "triangle": ("MATCH (a:Nation)-[:TRADES]->(b:Nation)-[:TRADES]->(c:Nation)-[:TRADES]->(a) WHERE a.n_regionkey = 1 RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades x JOIN trades y ON x.b=y.a JOIN trades z ON y.b=z.a AND z.b=x.a JOIN nation ON n_nationkey=x.a WHERE n_regionkey=1"),
    "triangle_all": ("MATCH (a:Nation)-[:TRADES]->(b:Nation)-[:TRADES]->(c:Nation)-[:TRADES]->(a) RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades x JOIN trades y ON x.b=y.a JOIN trades z ON y.b=z.a AND z.b=x.a"),
    "simplified_path": ("MATCH (x)-/LIVES_IN|BASED_IN/->(n:Nation) RETURN n.n_nationkey AS n, COUNT(*) AS c GROUP BY n.n_nationkey", "SELECT CAST(k AS BIGINT) AS n, count(*) AS c FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "simplified_concatenation": ("MATCH (c:Customer)-/LIVES_IN NATION_IN/->(r:Region) RETURN r.r_name AS r, COUNT(*) AS c GROUP BY r.r_name", "SELECT r_name AS r, count(*) AS c FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "alternation_union": ("MATCH (n:Nation)<-[:LIVES_IN]-(x:Customer) | (n:Nation)<-[:BASED_IN]-(x:Supplier) RETURN n.n_nationkey AS n, COUNT(*) AS c GROUP BY n.n_nationkey", "SELECT CAST(k AS BIGINT) AS n, count(*) AS c FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "alternation_multiset": ("MATCH (n:Nation WHERE n.n_nationkey < 3) |+| (n:Nation WHERE n.n_nationkey < 2) RETURN n.n_nationkey AS n", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation WHERE n_nationkey<3 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey<2"),
    "order_by_insertion": ("MATCH (o:Order {o_orderkey: 1})-[e:CONTAINS]->(p) ORDER BY INSERTION(e) RETURN COLLECT_LIST(e.l_linenumber ORDER BY e.l_linenumber) AS l", "SELECT list(l_linenumber ORDER BY l_linenumber) AS l FROM lineitem WHERE l_orderkey=1"),
    "order_by_insertion_all": ("MATCH (o:Order)-[e:CONTAINS]->(p) ORDER BY INSERTION(e) RETURN o.o_orderkey AS k, e.l_linenumber AS l", "SELECT l_orderkey AS k, l_linenumber AS l FROM lineitem JOIN orders ON l_orderkey=o_orderkey ORDER BY l_orderkey, l_linenumber"),
    "different_edges": ("MATCH DIFFERENT EDGES (a:Nation {n_nationkey: 1})-[x:TRADES]->(b:Nation)-[y:TRADES]->(c:Nation {n_nationkey: 1}) RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades x JOIN trades y ON x.b=y.a AND y.b=x.a WHERE x.a=1 AND NOT (x.a=y.a AND x.b=y.b)"),
    # joins
    "cartesian": ("MATCH (r:Region), (n:Nation) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM region, nation"),
    "two_matches": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS n, COUNT(*) AS pairs GROUP BY n.n_name", "SELECT n_name AS n, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey=s_nationkey JOIN nation ON n_nationkey=c_nationkey GROUP BY 1"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order WHERE o.o_totalprice > 300000) RETURN c.c_custkey AS c, COUNT(o) AS n GROUP BY c.c_custkey", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>300000 GROUP BY 1"),
    "optional_outer_where": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > c.c_acctbal RETURN COUNT(*) AS n, COUNT(s) AS hits", "SELECT count(*) AS n, count(s_suppkey) AS hits FROM customer LEFT JOIN supplier ON s_nationkey=c_nationkey AND s_acctbal>c_acctbal"),
    "expand_from_null": ("MATCH (r:Region) OPTIONAL MATCH (r)<-[:NATION_IN]-(n:Nation WHERE n.n_name = 'none') MATCH (n)<-[:LIVES_IN]-(c) RETURN COUNT(*) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "exists": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order WHERE o.o_totalprice > 400000) } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000)"),
    "not_exists": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->() } OR c.c_acctbal < -900 RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey) OR c_acctbal<-900"),
    "value_subquery": ("MATCH (n:Nation) RETURN n.n_name AS n, VALUE { MATCH (n)<-[:BASED_IN]-(s:Supplier) RETURN MAX(s.s_acctbal) AS m } AS top", "SELECT n_name AS n, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey=n_nationkey) AS top FROM nation"),
    "theta_join": ("MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<b.n_nationkey"),
    # aggregates
    "aggregates": ("MATCH (c:Customer) RETURN COUNT(*) AS n, COUNT(DISTINCT c.c_mktsegment) AS segs, ROUND(SUM(c.c_acctbal), 2) AS s, ROUND(AVG(c.c_acctbal), 6) AS a, MIN(c.c_acctbal) AS lo, MAX(c.c_acctbal) AS hi", "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segs, round(sum(c_acctbal),2) AS s, round(avg(c_acctbal),6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer"),
    "aggregate_empty": ("MATCH (c:Customer) WHERE c.c_acctbal > 1e12 RETURN COUNT(*) AS n, SUM(c.c_acctbal) AS s, CARDINALITY(COLLECT_LIST(c.c_custkey)) AS l", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS s, CAST(0 AS BIGINT) AS l"),
    "stddev": ("MATCH (p:Part) RETURN p.p_brand AS b, ROUND(STDDEV_SAMP(p.p_retailprice), 5) AS s, ROUND(STDDEV_POP(p.p_size), 5) AS q GROUP BY p.p_brand", "SELECT p_brand AS b, round(stddev_samp(p_retailprice),5) AS s, round(stddev_pop(p_size),5) AS q FROM part GROUP BY 1"),
    "percentiles": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, ROUND(PERCENTILE_CONT(o.o_totalprice, 0.25), 4) AS c, PERCENTILE_DISC(o.o_totalprice, 0.5) AS d GROUP BY o.o_orderstatus", "SELECT o_orderstatus AS s, round(quantile_cont(o_totalprice,0.25),4) AS c, quantile_disc(o_totalprice,0.5) AS d FROM orders GROUP BY 1"),
    "collect_list": ("MATCH (r:Region)<-[:NATION_IN]-(n:Nation) RETURN r.r_name AS r, COLLECT_LIST(n.n_name ORDER BY n.n_name DESC) AS names GROUP BY r.r_name", "SELECT r_name AS r, list(n_name ORDER BY n_name DESC) AS names FROM region JOIN nation ON n_regionkey=r_regionkey GROUP BY 1"),
    "collect_nulls": ("MATCH (r:Region) RETURN COLLECT_LIST(NULLIF(r.r_name, 'ASIA') ORDER BY r.r_name) AS names", "SELECT list(nullif(r_name,'ASIA') ORDER BY r_name) AS names FROM region"),
    "having": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS n, COUNT(*) AS c GROUP BY n.n_name HAVING COUNT(*) > 55", "SELECT n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1 HAVING count(*)>55"),
    "agg_filter": ("MATCH (o:Order) RETURN o.o_orderpriority AS p, COUNT(*) FILTER (WHERE o.o_orderstatus = 'F') AS f, COUNT(*) AS n GROUP BY o.o_orderpriority", "SELECT o_orderpriority AS p, count(*) FILTER (WHERE o_orderstatus='F') AS f, count(*) AS n FROM orders GROUP BY 1"),
    "group_by_vertex": ("MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN n.n_name AS n, SUM(c.c_acctbal) AS s GROUP BY n NEXT RETURN n, ROUND(s, 2) AS s", "SELECT n_name AS n, round(sum(c_acctbal),2) AS s FROM nation JOIN customer ON c_nationkey=n_nationkey GROUP BY n_nationkey, n_name"),
    # sort, limit, set operations
    "sort_top_k": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k ASC LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 25"),
    "offset_limit": ("MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY k OFFSET 100 LIMIT 10", "SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 10 OFFSET 100"),
    "null_order": ("MATCH (r:Region) LET x = NULLIF(r.r_regionkey, 2) RETURN r.r_name AS n ORDER BY x DESC, n LIMIT 2", "SELECT r_name AS n FROM region ORDER BY nullif(r_regionkey,2) DESC NULLS FIRST, 1 LIMIT 2"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "except_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS n EXCEPT ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "except_distinct": ("MATCH (n:Nation) RETURN n.n_regionkey AS n EXCEPT MATCH (r:Region) WHERE r.r_name <> 'ASIA' RETURN CAST(r.r_regionkey AS INT32) AS n", "SELECT n_regionkey AS n FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_name<>'ASIA'"),
    "intersect_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS n INTERSECT MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "intersect_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS n INTERSECT ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "otherwise": ("MATCH (r:Region) WHERE r.r_name = 'X' RETURN r.r_name AS n OTHERWISE MATCH (n:Nation) WHERE n.n_nationkey < 2 RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey<2"),
    # expressions
    "arithmetic": ("MATCH (p:Part) RETURN p.p_partkey AS k, -p.p_size + 3 * 2 AS a, ROUND(p.p_retailprice / 7, 6) AS b, MOD(p.p_size, 5) AS m, ABS(-p.p_size) AS ab", "SELECT p_partkey AS k, -p_size+6 AS a, round(p_retailprice/7,6) AS b, p_size%5 AS m, abs(-p_size) AS ab FROM part"),
    "boolean_logic": ("MATCH (r:Region) LET x = NULLIF(r.r_regionkey, 1) > 2 RETURN r.r_name AS n, x AND TRUE AS a, x OR TRUE AS o, x XOR TRUE AS e, NOT x AS t, x IS TRUE AS i, x IS NOT UNKNOWN AS u", "SELECT r_name AS n, x AND TRUE AS a, x OR TRUE AS o, x<>TRUE AS e, NOT x AS t, x IS TRUE AS i, x IS NOT NULL AS u FROM (SELECT r_name, nullif(r_regionkey,1)>2 AS x FROM region)"),
    "comparisons_and_lists": ("MATCH (n:Nation) WHERE n.n_regionkey IN (1, 3) AND n.n_name NOT IN ('JAPAN') RETURN n.n_name AS n, [n.n_nationkey, 7][-1] AS last, [1, 2, 3, 4][1..3] AS mid, [1,2][5] AS out", "SELECT n_name AS n, CAST(7 AS BIGINT) AS last, [2,3] AS mid, CAST(NULL AS INTEGER) AS out FROM nation WHERE n_regionkey IN (1,3) AND n_name<>'JAPAN'"),
    "string_predicates": ("MATCH (n:Nation) WHERE n.n_name STARTS WITH 'I' OR n.n_name ENDS WITH 'A' OR n.n_name CONTAINS 'UN' OR n.n_name ILIKE 'j%' RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_name LIKE 'I%' OR n_name LIKE '%A' OR n_name LIKE '%UN%' OR n_name ILIKE 'j%'"),
    "string_functions": ("MATCH (n:Nation) RETURN UPPER(n.n_name) AS u, LOWER(n.n_name) AS l, LEFT(n.n_name, 2) AS a, RIGHT(n.n_name, 2) AS b, CHAR_LENGTH(n.n_name) AS c, TRIM(BOTH 'A' FROM n.n_name) AS t, OCTET_LENGTH(n.n_name) AS o", "SELECT upper(n_name) AS u, lower(n_name) AS l, left(n_name,2) AS a, right(n_name,2) AS b, CAST(length(n_name) AS INTEGER) AS c, trim(n_name,'A') AS t, CAST(strlen(n_name) AS INTEGER) AS o FROM nation"),
    "math_functions": ("MATCH (n:Nation) LET x = n.n_nationkey + 1 RETURN x, ROUND(SQRT(x), 6) AS s, ROUND(LN(x), 6) AS l, ROUND(LOG10(x), 6) AS t, ROUND(LOG(2, x), 6) AS g, ROUND(POWER(x, 2), 2) AS p, ROUND(SIN(x), 6) AS si, ROUND(COS(x), 6) AS co, ROUND(TAN(x), 5) AS ta, ROUND(ATAN(x), 6) AS at, ROUND(DEGREES(x), 5) AS d, ROUND(RADIANS(x), 6) AS r, ROUND(EXP(x / 10.0), 5) AS e", "SELECT x, round(sqrt(x),6) AS s, round(ln(x),6) AS l, round(log10(x),6) AS t, round(ln(x)/ln(2),6) AS g, round(pow(x,2),2) AS p, round(sin(x),6) AS si, round(cos(x),6) AS co, round(tan(x),5) AS ta, round(atan(x),6) AS at, round(degrees(x),5) AS d, round(radians(x),6) AS r, round(exp(x/10.0),5) AS e FROM (SELECT CAST(n_nationkey+1 AS BIGINT) AS x FROM nation)"),
    "case_expressions": ("MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o.o_totalprice > 200000 THEN 1 ELSE 0 END AS big, COALESCE(NULLIF(o.o_orderpriority, '1-URGENT'), 'urgent') AS p", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o_totalprice>200000 THEN 1 ELSE 0 END AS big, coalesce(nullif(o_orderpriority,'1-URGENT'),'urgent') AS p FROM orders"),
    "casts": ("MATCH (n:Nation) RETURN CAST(n.n_nationkey AS STRING) AS s, CAST(CAST(n.n_nationkey AS STRING) AS INT64) AS i, CAST(n.n_regionkey AS FLOAT64) AS f", "SELECT CAST(n_nationkey AS VARCHAR) AS s, CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS DOUBLE) AS f FROM nation"),
    "temporal": ("MATCH (o:Order) WHERE o.o_orderdate >= LOCAL_DATETIME '1995-01-01T00:00:00' AND o.o_orderdate < LOCAL_DATETIME '1995-02-01T00:00:00' RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate>=TIMESTAMP '1995-01-01' AND o_orderdate<TIMESTAMP '1995-02-01'"),
    "duration_between": ("MATCH (o:Order {o_orderkey: 1})-[e:CONTAINS]->(p) LET d = DURATION_BETWEEN(o.o_orderdate, e.l_shipdate) RETURN e.l_linenumber AS l, d.nanos AS nanos", "SELECT l_linenumber AS l, CAST((epoch_us(l_shipdate)-epoch_us(o_orderdate))*1000 AS BIGINT) AS nanos FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_orderkey=1"),
    "duration_between_all": ("MATCH (o:Order)-[e:CONTAINS]->(p) LET d = DURATION_BETWEEN(o.o_orderdate, e.l_shipdate) RETURN o.o_orderkey AS k, e.l_linenumber AS l, d.nanos AS nanos", "SELECT o_orderkey AS k, l_linenumber AS l, CAST((epoch_us(l_shipdate)-epoch_us(o_orderdate))*1000 AS BIGINT) AS nanos FROM lineitem JOIN orders ON l_orderkey=o_orderkey"),
    "records": ("MATCH (r:Region) LET x = {name: r.r_name, key: r.r_regionkey} RETURN x.name AS n, x.key AS k", "SELECT r_name AS n, CAST(r_regionkey AS BIGINT) AS k FROM region"),
    "element_functions": ("MATCH (c:Customer {c_custkey: 1})-[e:LIVES_IN]->(n) RETURN ELEMENT_ID(c) AS id, LABELS(n) AS labels, TYPE(e) AS t, e IS LABELED LIVES_IN AS l, n IS LABELED Customer AS m, SOURCE(e) AS src, SAME(c, c) AS same, ALL_DIFFERENT(c, n) AS diff, PROPERTY_EXISTS(c, c_name) AS p", "SELECT 'Customer:1' AS id, ['Nation'] AS labels, 'LIVES_IN' AS t, TRUE AS l, FALSE AS m, 'Customer:1' AS src, TRUE AS same, TRUE AS diff, TRUE AS p"),
    "type_predicate": ("MATCH (r:Region) RETURN r.r_name IS TYPED STRING AS s, r.r_name IS TYPED INT64 AS i", "SELECT TRUE AS s, FALSE AS i FROM region"),
    "let_in": ("MATCH (r:Region) RETURN LET a = r.r_regionkey, b = 2 IN a * b END AS x", "SELECT CAST(r_regionkey*2 AS BIGINT) AS x FROM region"),
    "events_graph": ("MATCH (u:User)-[:DID]->(e:Event {event_type: 'click'}) RETURN u.user_id AS u, COUNT(*) AS n GROUP BY u.user_id", "SELECT user_id AS u, count(*) AS n FROM events WHERE event_type='click' GROUP BY 1"),
    # vectors
    "search_l2": (_vector, f"SELECT y.vec_id AS vec_id, round({_DIST},4) AS d FROM embeddings x, embeddings y WHERE x.vec_id=0 ORDER BY {_DIST}, y.vec_id LIMIT 10"),
    "search_cosine_where": (_cosine, "SELECT y.vec_id AS vec_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]),CAST(y.embedding AS DOUBLE[])),4) AS s FROM embeddings x, embeddings y WHERE x.vec_id=3 AND y.label>=1 ORDER BY list_cosine_similarity(CAST(x.embedding AS DOUBLE[]),CAST(y.embedding AS DOUBLE[])) DESC, y.vec_id LIMIT 5"),
    "search_join": (_search_join, f"SELECT vec_id FROM (SELECT y.vec_id, y.label FROM embeddings x, embeddings y WHERE x.vec_id=0 ORDER BY {_DIST}, y.vec_id LIMIT 40) WHERE label=1"),
    "vector_functions": ("MATCH (a:Vec {vec_id: 0}), (b:Vec) WHERE VECTOR.L2_SQUARED(a.embedding, b.embedding) < 100 RETURN b.vec_id AS b, ROUND(VECTOR.DOT(a.embedding, b.embedding), 3) AS d", f"SELECT y.vec_id AS b, round(list_sum(list_transform(range(1,65), lambda i: CAST(x.embedding[i] AS DOUBLE)*CAST(y.embedding[i] AS DOUBLE))),3) AS d FROM embeddings x, embeddings y WHERE x.vec_id=0 AND {_DIST}<100"),
    # changes
    "insert": (_changed("INSERT (:Region {r_regionkey: 99, r_name: 'ATLANTIS'})<-[:NATION_IN]-(:Nation {n_name: 'X', n_nationkey: 77})", "MATCH (n:Nation)-[:NATION_IN]->(r:Region) RETURN n.n_name AS n, r.r_name AS r"), "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey=r_regionkey UNION ALL SELECT 'X', 'ATLANTIS'"),
    "set_properties": (_changed("MATCH (n:Nation)-[:NATION_IN]->(r:Region {r_name: 'ASIA'}) SET n.n_name = n.n_name || '!'", "MATCH (n:Nation) RETURN n.n_name AS n"), "SELECT CASE WHEN r_name='ASIA' THEN n_name||'!' ELSE n_name END AS n FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "set_label": (_changed("MATCH (n:Nation) WHERE n.n_nationkey < 4 SET n IS Small", "MATCH (n:Small) RETURN n.n_name AS n"), "SELECT n_name AS n FROM nation WHERE n_nationkey<4"),
    "remove_property": (_changed("MATCH (n:Nation {n_nationkey: 1}) REMOVE n.n_name", "MATCH (n:Nation) WHERE n.n_name IS NULL RETURN n.n_nationkey AS k"), "SELECT CAST(1 AS BIGINT) AS k"),
    "delete_edge": (_changed("MATCH (n:Nation)-[e:NATION_IN]->(r:Region {r_name: 'ASIA'}) DELETE e", "MATCH (n:Nation)-[:NATION_IN]->(r:Region) RETURN r.r_name AS r, COUNT(*) AS n GROUP BY r.r_name"), "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'ASIA' GROUP BY 1"),
    "detach_delete": (_changed("MATCH (r:Region {r_name: 'ASIA'}) DETACH DELETE r", "MATCH (n:Nation) OPTIONAL MATCH (n)-[:NATION_IN]->(r:Region) RETURN n.n_name AS n, r.r_name AS r"), "SELECT n_name AS n, nullif(r_name,'ASIA') AS r FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "prepared": (_prepared, "SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_mktsegment='BUILDING' ORDER BY 2, 1 LIMIT 20"),
    # constructs by themselves, with rows on both sides
    "let_rows": ("MATCH (p:Part) LET gross = p.p_retailprice * 2, big = gross > 1500 FILTER big RETURN p.p_partkey AS k, ROUND(gross, 4) AS gross", "SELECT p_partkey AS k, round(p_retailprice*2,4) AS gross FROM part WHERE p_retailprice*2>1500"),
    "string_predicate_rows": ("MATCH (n:Nation) WHERE n.n_name STARTS WITH 'NATION_2' OR n.n_name ENDS WITH '7' OR n.n_name CONTAINS '_1' OR n.n_name ILIKE 'nation__' RETURN n.n_name AS n, n.n_name NOT STARTS WITH 'NATION_2' AS a, n.n_name CONTAINS 'X' AS b", "SELECT n_name AS n, NOT starts_with(n_name,'NATION_2') AS a, contains(n_name,'X') AS b FROM nation WHERE starts_with(n_name,'NATION_2') OR suffix(n_name,'7') OR contains(n_name,'_1') OR n_name ILIKE 'nation__'"),
    "finish_clause": (lambda e: e.execute("MATCH (r:Region) FINISH").selectExpr("1 AS x").groupBy().count().withColumnRenamed("count", "n"), "SELECT CAST(0 AS BIGINT) AS n"),
    "no_bindings": (lambda e: e.gql("MATCH (n:Nation)-[:NATION_IN]->(r) RETURN NO BINDINGS").groupBy().count().withColumnRenamed("count", "n"), "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "limit_rows": (lambda e: e.gql("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o LIMIT 40").join(e.gql("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o"), ["c", "o"]).groupBy().count().withColumnRenamed("count", "n"), "SELECT least(40, count(*)) AS n FROM orders JOIN customer ON o_custkey=c_custkey"),
    "lookup_equal_method": (lambda e: e.lookup_equal("Part", "p_size", 10).selectExpr("v.id AS id", "v.properties.p_name AS name"), "SELECT 'Part:'||p_partkey AS id, p_name AS name FROM part WHERE p_size=10"),
    "lookup_range_method": (lambda e: e.lookup_range("Part", "p_size", 5, 9).selectExpr("v.id AS id"), "SELECT 'Part:'||p_partkey AS id FROM part WHERE p_size>=5 AND p_size<9"),
    "lookup_range_open": (lambda e: e.lookup_range("Part", "p_size", None, 3).selectExpr("v.id AS id"), "SELECT 'Part:'||p_partkey AS id FROM part WHERE p_size<3"),
    "lookup_intersection_method": (lambda e: e.lookup_intersection("Part", p_size=10, p_type="ECONOMY").selectExpr("v.id AS id"), "SELECT 'Part:'||p_partkey AS id FROM part WHERE p_size=10 AND p_type='ECONOMY'"),
    "lookup_edge_equal_method": (lambda e: e.lookup_edge_equal("CONTAINS", "l_quantity", 7).selectExpr("e.src AS src", "e.dst AS dst", "e.properties.l_linenumber AS l"), "SELECT 'Order:'||l_orderkey AS src, 'Part:'||l_partkey AS dst, l_linenumber AS l FROM lineitem WHERE l_quantity=7"),
    "default_bounds": ("MATCH (a:Nation)-[:TRADES]->(b:Nation) RETURN COUNT(*) AS n UNION ALL MATCH ANY SHORTEST (a:Nation)-[:TRADES]->(b:Nation) RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades UNION ALL SELECT count(*) FROM trades WHERE a<>b"),
    "repeatable_elements": ("MATCH REPEATABLE ELEMENTS (a:Nation {n_nationkey: 1})-[:TRADES]->{3}(b:Nation) RETURN b.n_nationkey AS b, COUNT(*) AS n GROUP BY b.n_nationkey", f"WITH {_TRADES} SELECT z.b AS b, count(*) AS n FROM trades x JOIN trades y ON x.b=y.a JOIN trades z ON y.b=z.a WHERE x.a=1 GROUP BY 1"),
    "count_paths": ("MATCH p = COUNT PATHS (a:Nation {n_regionkey: 2})-[:TRADES]->{1,2}(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, p AS n", f"WITH {_TRADES}, w AS (SELECT a, b FROM trades WHERE a<>b UNION ALL SELECT x.a, y.b FROM trades x JOIN trades y ON x.b=y.a WHERE x.a<>x.b AND x.a<>y.b AND x.b<>y.b) SELECT a, b, count(*) AS n FROM w JOIN nation ON n_nationkey=a WHERE n_regionkey=2 GROUP BY 1, 2"),
    "any_k": ("MATCH ANY 2 (a:Nation {n_nationkey: 1})-[:TRADES]->{1,2}(b:Nation) RETURN b.n_nationkey AS b, COUNT(*) AS n GROUP BY b.n_nationkey", f"WITH {_TRADES}, w AS (SELECT b FROM trades WHERE a=1 AND b<>1 UNION ALL SELECT y.b FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=1 AND x.b<>1 AND y.b<>1 AND x.b<>y.b) SELECT b, least(2, count(*)) AS n FROM w GROUP BY 1"),
    "simple_mode": ("MATCH SIMPLE (a:Nation {n_nationkey: 2})-[:TRADES]->{2}(b:Nation) RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=2 AND x.b<>2 AND x.b<>y.b"),
    "keep_mode": ("MATCH (a:Nation {n_nationkey: 2})-[:TRADES]->{2}(b:Nation) KEEP TRAIL RETURN COUNT(*) AS n", f"WITH {_TRADES} SELECT count(*) AS n FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=2 AND NOT (x.a=y.a AND x.b=y.b)"),
    "cost_of_hops": ("MATCH p = ANY SHORTEST (a:Nation {n_nationkey: 3})-[e:TRADES]->{1,2}(b:Nation) COST BY 1 RETURN b.n_nationkey AS b, PATH_LENGTH(p) AS n", f"WITH {_TRADES}, w AS (SELECT b, 1 AS n FROM trades WHERE a=3 AND b<>3 UNION ALL SELECT y.b, 2 FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=3 AND x.b<>3 AND y.b<>3 AND x.b<>y.b) SELECT b, CAST(min(n) AS BIGINT) AS n FROM w GROUP BY 1"),
    "weighted_k": ("MATCH SHORTEST 2 (a:Nation {n_nationkey: 4})-[e:TRADES]->{1,2}(b:Nation) COST BY e.weight RETURN b.n_nationkey AS b, SUM(e.weight) AS w", f"WITH {_TRADES}, w AS (SELECT b, weight AS w FROM trades WHERE a=4 AND b<>4 UNION ALL SELECT y.b, x.weight+y.weight FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=4 AND x.b<>4 AND y.b<>4 AND x.b<>y.b), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY w) AS k FROM w) SELECT b, w FROM r WHERE k<=2"),
    "weighted_all": ("MATCH ALL SHORTEST (a:Nation {n_nationkey: 5})-[e:TRADES]->{1,2}(b:Nation) COST BY e.trade_count RETURN b.n_nationkey AS b, SUM(e.trade_count) AS w", f"WITH {_TRADES}, w AS (SELECT b, trade_count AS w FROM trades WHERE a=5 AND b<>5 UNION ALL SELECT y.b, x.trade_count+y.trade_count FROM trades x JOIN trades y ON x.b=y.a WHERE x.a=5 AND x.b<>5 AND y.b<>5 AND x.b<>y.b) SELECT b, w FROM w WHERE w=(SELECT min(w) FROM w v WHERE v.b=w.b)"),
    "three_paths": ("MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer), (c)-[:PLACED]->(o:Order), (o)-[:CONTAINS]->(p:Part {p_size: 10}) RETURN n.n_name AS n, COUNT(*) AS c GROUP BY n.n_name", "SELECT n_name AS n, count(*) AS c FROM nation JOIN customer ON c_nationkey=n_nationkey JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey WHERE p_size=10 GROUP BY 1"),
    "set_chain": ("MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n EXCEPT MATCH (m:Nation) WHERE m.n_nationkey < 5 RETURN CAST(m.n_nationkey AS INT32) AS n", "(SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey<5"),
    "sum_distinct": ("MATCH (p:Part) RETURN p.p_brand AS b, SUM(DISTINCT p.p_size) AS s, AVG(DISTINCT p.p_size) AS a, COUNT(DISTINCT p.p_size) AS n GROUP BY p.p_brand", "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, avg(DISTINCT p_size) AS a, count(DISTINCT p_size) AS n FROM part GROUP BY 1"),
    "distinct_spread": ("MATCH (p:Part) RETURN p.p_brand AS b, ROUND(STDDEV_SAMP(DISTINCT p.p_size), 5) AS s, PERCENTILE_DISC(DISTINCT p.p_size, 0.5) AS d, PERCENTILE_CONT(DISTINCT p.p_size, 0.5) AS c GROUP BY p.p_brand", "SELECT p_brand AS b, round(stddev_samp(DISTINCT p_size),5) AS s, quantile_disc(DISTINCT p_size,0.5) AS d, quantile_cont(DISTINCT p_size,0.5) AS c FROM part GROUP BY 1"),
    "percentile_of_keys": ("MATCH (o:Order) RETURN o.o_orderpriority AS p, PERCENTILE_DISC(o.o_orderkey, 0.9) AS k, PERCENTILE_DISC(o.o_orderstatus, 0.5) AS s GROUP BY o.o_orderpriority", "SELECT o_orderpriority AS p, quantile_disc(o_orderkey,0.9) AS k, quantile_disc(o_orderstatus,0.5) AS s FROM orders GROUP BY 1"),
    "collect_distinct": ("MATCH (p:Part) RETURN p.p_type AS t, COLLECT_LIST(DISTINCT p.p_size ORDER BY p.p_size) AS l GROUP BY p.p_type", "SELECT p_type AS t, list(DISTINCT p_size ORDER BY p_size) AS l FROM part GROUP BY 1"),
    "numeric_functions": ("MATCH (p:Part) LET x = p.p_retailprice / 7 - 100 RETURN p.p_partkey AS k, FLOOR(x) AS f, CEIL(x) AS c, SIGN(x) AS s, TRUNC(x) AS t, ROUND(ATAN2(x, 2.0), 6) AS a, ROUND(EXP(x / 1000), 6) AS e, POWER(2, MOD(p.p_size, 10)) AS w", "SELECT p_partkey AS k, CAST(floor(x) AS BIGINT) AS f, CAST(ceil(x) AS BIGINT) AS c, CAST(sign(x) AS DOUBLE) AS s, trunc(x) AS t, round(atan2(x,2),6) AS a, round(exp(x/1000),6) AS e, pow(2,p_size%10) AS w FROM (SELECT p_partkey, p_size, p_retailprice/7-100 AS x FROM part)"),
    "trigonometry": ("MATCH (n:Nation) LET x = (n.n_nationkey + 1) / 30.0 RETURN n.n_nationkey AS k, ROUND(ASIN(x), 6) AS a, ROUND(ACOS(x), 6) AS b, ROUND(COT(x), 5) AS c, ROUND(SINH(x), 6) AS d, ROUND(COSH(x), 6) AS e, ROUND(TANH(x), 6) AS f", "SELECT CAST(n_nationkey AS BIGINT) AS k, round(asin(x),6) AS a, round(acos(x),6) AS b, round(cot(x),5) AS c, round(sinh(x),6) AS d, round(cosh(x),6) AS e, round(tanh(x),6) AS f FROM (SELECT n_nationkey, (n_nationkey+1)/30.0 AS x FROM nation)"),
    "list_trim": ("MATCH (n:Nation)-[:NATION_IN]->(r:Region) RETURN r.r_name AS r, TRIM(COLLECT_LIST(n.n_nationkey ORDER BY n.n_nationkey), 2) AS l GROUP BY r.r_name", "SELECT r_name AS r, list_slice(l, 1, len(l)-2) AS l FROM (SELECT r_name, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey) AS l FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1)"),
    "property_exists": ("MATCH (n:Nation) LET x = n.n_name RETURN n.n_nationkey AS k, PROPERTY_EXISTS(n, n_name) AS a, PROPERTY_EXISTS(n, nothing) AS b", "SELECT CAST(n_nationkey AS BIGINT) AS k, TRUE AS a, FALSE AS b FROM nation"),
    "normalized_text": ("MATCH (t:Doc) RETURN t.doc_id AS d, NORMALIZE(t.source || 'e\u0301', NFC) AS s, t.source IS NFC NORMALIZED AS y, NORMALIZE(t.lang, NFD) AS l", "SELECT doc_id AS d, nfc_normalize(source||'e'||chr(769)) AS s, TRUE AS y, lang AS l FROM documents"),
    "session_values": (lambda e: e.gql("MATCH (r:Region) RETURN r.r_name AS r, SESSION_USER IS NULL AS u, CURRENT_DATE IS NOT NULL AS d, CURRENT_TIMESTAMP IS NOT NULL AS t, LOCAL_TIMESTAMP IS NOT NULL AS l"), "SELECT r_name AS r, TRUE AS u, TRUE AS d, TRUE AS t, TRUE AS l FROM region"),
    "temporal_values": ("MATCH (o:Order) LET d = CAST(o.o_orderdate AS DATE) RETURN o.o_orderkey AS k, d >= DATE '1997-01-01' AS a, o.o_orderdate < LOCAL_DATETIME '1998-06-01T12:00:00' AS b, DURATION 'P1Y2M' = DURATION('P14M') AS c, (DURATION_BETWEEN(LOCAL_DATETIME '1995-01-15T00:00:00', o.o_orderdate) YEAR TO MONTH).months AS m", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE)>=DATE '1997-01-01' AS a, o_orderdate<TIMESTAMP '1998-06-01 12:00:00' AS b, TRUE AS c, CAST(CASE WHEN o_orderdate>=TIMESTAMP '1995-01-15' THEN datesub('month', TIMESTAMP '1995-01-15', o_orderdate) ELSE -datesub('month', o_orderdate, TIMESTAMP '1995-01-15') END AS INTEGER) AS m FROM orders"),
    "path_functions": ("MATCH p = (a:Turn {turn_no: 0})-[:NEXT]->{2}(b:Turn) RETURN a.turn_key AS a, SIZE(NODES(p)) AS n, SIZE(EDGES(p)) AS e, SIZE(ELEMENTS(p)) AS x, NODES(p)[0] AS first, NODES(p)[-1] AS last", f"WITH {_TURNS} SELECT a.k AS a, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS e, CAST(5 AS BIGINT) AS x, 'Turn:'||a.k AS first, 'Turn:'||(a.k+2) AS last FROM turns a JOIN turns b ON b.k=a.k+2 AND b.conv_id=a.conv_id JOIN turns c ON c.k=a.k+1 WHERE a.turn=0"),
    "path_constructor": ("MATCH (c:Customer)-[e:LIVES_IN]->(n:Nation {n_nationkey: 3}) LET p = PATH[c, e, n] RETURN c.c_custkey AS k, PATH_LENGTH(p) AS l, NODES(p)[1] AS n", "SELECT c_custkey AS k, CAST(1 AS BIGINT) AS l, 'Nation:3' AS n FROM customer WHERE c_nationkey=3"),
    "search_bytes": (lambda e: _bytes(e), "SELECT TRUE AS near, TRUE AS ordered, CAST(10 AS BIGINT) AS n"),
    "vector_method": (lambda e: e.vector_search("vec_l2", list(e.gql("MATCH (v:Vec {vec_id: 5}) RETURN v.embedding AS q").first()["q"]), 7).selectExpr("id", "round(d, 4) AS d"), f"SELECT 'Vec:'||y.vec_id AS id, round({_DIST},4) AS d FROM embeddings x, embeddings y WHERE x.vec_id=5 ORDER BY {_DIST}, y.vec_id LIMIT 7"),
    "search_many": (lambda e: _many(e), "SELECT least(1024, count(*)) AS n FROM embeddings"),
    "maintenance_call": ("MATCH (r:Region) CALL admin.DRAIN_DEFERRED() YIELD done RETURN r.r_name AS r, done", "SELECT r_name AS r, CAST(0 AS BIGINT) AS done FROM region"),
    "remove_property_rows": (_changed("MATCH (n:Nation) WHERE n.n_regionkey = 2 REMOVE n.n_name", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS n"), "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_regionkey<>2 THEN n_name END AS n FROM nation"),
    "type_predicates_by_row": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice IS TYPED FLOAT64 AS f, o.o_orderstatus IS NOT TYPED INT64 AS s", "SELECT o_orderkey AS k, TRUE AS f, TRUE AS s FROM orders"),
    "delete_refused": (lambda e: _refused(e, "MATCH (r:Region {r_name: 'ASIA'}) DELETE r"), "SELECT r_name AS r FROM region"),
    "delete_vertices": (_changed("MATCH (d:Doc) WHERE d.lang = 'en' DELETE d", "MATCH (d:Doc) RETURN d.lang AS lang, COUNT(*) AS n GROUP BY d.lang"), "SELECT lang, count(*) AS n FROM documents WHERE lang<>'en' GROUP BY 1"),
    "constraint_refused": (lambda e: _constrained(e), "SELECT count(*) AS n FROM region"),
    "graph_ddl": (_changed("CREATE GRAPH TYPE places { (:Town {name STRING}) }", "CREATE GRAPH towns TYPED places", "DROP GRAPH towns", "CREATE GRAPH copied LIKE default", "MATCH (n:Nation) RETURN n.n_name AS n"), "SELECT n_name AS n FROM nation"),
    "index_ddl": (_changed("CREATE INDEX by_size FOR (p:Part) ON (p.p_size)", "DROP INDEX by_size", "MATCH (p:Part {p_size: 4}) RETURN p.p_partkey AS k"), "SELECT p_partkey AS k FROM part WHERE p_size=4"),
    "rollback": (_changed("START TRANSACTION", "MATCH (n:Nation) SET n.n_name = 'gone'", "CREATE INDEX lost FOR (p:Part) ON (p.p_size)", "ROLLBACK", "CREATE INDEX lost FOR (p:Part) ON (p.p_size)", "MATCH (n:Nation) RETURN n.n_name AS n"), "SELECT n_name AS n FROM nation"),
    "insertion_order_first": (lambda e: e.gql("MATCH (c:Customer)-[e:PLACED]->(o) ORDER BY INSERTION(e) RETURN o.o_orderkey AS k").limit(30), "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey=c_custkey ORDER BY o_orderkey LIMIT 30"),
}
