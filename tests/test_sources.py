"""Loaders, storing and streams."""

import json

import pytest

from graphloom.session import Engine
from graphloom.sources import BulkLoad, load_document, load_lines, read_graph, write_graph
from graphloom.streaming import follow

V = [{"source_id": "a", "labels": ["P"], "properties": {"name": {"Text": "A"}, "n": {"Int64": 4}, "day": {"Date": 1}}}, {"source_id": "b", "labels": ["P"], "properties": {"name": {"Text": "B"}}}, {"source_id": "c", "labels": ["Q", "P"], "properties": {"name": {"Text": "C"}, "n": {"Null": None}}}]
E = [{"source": "a", "target": "b", "label": "K", "properties": {"w": {"Float64": 1.5}}}, {"source": "b", "target": "c", "label": "K", "directed": False}, {"source": "c", "target": "a", "label": "L"}]


def lines(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def names(e, text):
    return sorted(tuple(r) for r in e.gql(text).collect())


def check(g, spark):
    e = Engine(spark, g)
    assert names(e, "MATCH (a)-[e:K]->(b) RETURN a.name AS a, b.name AS b, e.w AS w") == [("A", "B", 1.5)]
    assert names(e, "MATCH (a)~[:K]~(b) RETURN a.name AS a, b.name AS b") == [("B", "C"), ("C", "B")]
    assert names(e, "MATCH (a:P&Q)-[:L]->(b) RETURN b.n AS n") == [(4,)]
    assert str(e.gql("MATCH (a {name: 'A'}) RETURN a.day AS d").first()[0]) == "1970-01-02"


def test_lines_and_store(spark, tmp_path):
    g = load_lines(spark, lines(tmp_path / "v", V), lines(tmp_path / "e", E))
    check(g, spark)
    write_graph(g, str(tmp_path / "g"), spark)
    check(read_graph(spark, str(tmp_path / "g")), spark)


def test_document(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"format_version": 1, "vertices": V, "edges": E}))
    check(load_document(spark, str(p)), spark)
    p.write_text(json.dumps({"format_version": 2, "vertices": []}))
    with pytest.raises(ValueError, match="format_version"):
        load_document(spark, str(p))


def test_ends_by_property(spark, tmp_path):
    ends = [{"source": {"label": "P", "property": "name", "value": {"Text": "A"}}, "target": {"label": "Q", "property": "name", "value": {"Text": "C"}}, "label": "K"}]
    g = load_lines(spark, lines(tmp_path / "v", V), lines(tmp_path / "e", ends))
    assert names(Engine(spark, g), "MATCH (a)-[:K]->(b) RETURN a.name AS a, b.name AS b") == [("A", "C")]


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="occurs 2 times"):
        load_lines(spark, lines(tmp_path / "v", [*V, V[0]]))
    with pytest.raises(ValueError, match="no vertex"):
        load_lines(spark, lines(tmp_path / "v2", V), lines(tmp_path / "e", [{"source": "a", "target": "z", "label": "K"}]))


def test_bulk(spark, tmp_path):
    load = BulkLoad(spark, str(tmp_path / "bulk"))
    v, e = spark.read.json(lines(tmp_path / "v", V)), spark.read.json(lines(tmp_path / "e", E))
    load.add("vertices", 0, v)
    load.add("vertices", 0, v)  # again
    load.add("edges", 0, e)
    assert load.status() == {"state": "started", "vertices": 1, "edges": 1}
    check(load.finalize(), spark)
    with pytest.raises(ValueError):
        load.add("edges", 1, e)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "1.json", V)
    load = BulkLoad(spark, str(tmp_path / "bulk"))
    stream = spark.readStream.schema(spark.read.json(str(tmp_path / "in")).schema).json(str(tmp_path / "in"))
    follow(load, "vertices", stream, str(tmp_path / "cp"), once=True).awaitTermination()
    load.add("edges", 0, spark.read.json(lines(tmp_path / "e", E)))
    check(load.finalize(), spark)
