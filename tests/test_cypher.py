"""The language on small graphs that queries build themselves."""

import math
import os

import pytest

from arbora.operators.schema import ConstraintViolation
from arbora.plans.lower import CypherError
from arbora.plans.parser import CypherSyntaxError, parse
from arbora.sources.graph import Graph


@pytest.fixture
def social(spark):
    g = Graph(spark)
    g.cypher("""CREATE (a:Person {name: 'Ada', age: 37})-[:KNOWS {since: 2018}]->(b:Person {name: 'Alan', age: 41})-[:KNOWS]->(c:Person {name: 'Grace', age: 85}),
                (a)-[:WORKS_AT]->(k:Company {name: 'Analytics'}), (b)-[:LIKES]->(a)""")
    return g


@pytest.fixture(scope="module")
def frozen(spark):
    g = Graph(spark)
    g.cypher("CREATE (a:Link {name: 'a'})-[:N]->(b:Link {name: 'b'})-[:N]->(c:Link {name: 'c'})-[:N]->(d:Link {name: 'd'}), (d)-[:N]->(a), (b)-[:LOOP]->(b)")
    return g


def rows(g, q, **params):
    return [tuple(r) for r in g.cypher(q, **params).collect()]


def test_hops(social):
    assert rows(social, "MATCH (a:Person)-[r]->(b) RETURN a.name, type(r) AS t, b.name ORDER BY a.name, t, b.name") == [("Ada", "KNOWS", "Alan"), ("Ada", "WORKS_AT", "Analytics"), ("Alan", "KNOWS", "Grace"), ("Alan", "LIKES", "Ada")]
    assert rows(social, "MATCH (a {name: 'Ada'})-[:KNOWS]-(b) RETURN b.name AS n") == [("Alan",)]
    assert rows(social, "MATCH (a {name: 'Ada'})--(b) RETURN count(*) AS n") == [(3,)]
    assert rows(social, "MATCH (a:Person) WHERE NOT (a)-[:KNOWS]->() RETURN a.name AS n") == [("Grace",)]
    assert rows(social, "MATCH (a:Person) OPTIONAL MATCH (a)-[:LIKES]->(b) RETURN a.name AS a, b.name AS b ORDER BY a") == [("Ada", None), ("Alan", "Ada"), ("Grace", None)]
    assert rows(social, "MATCH (a:Person {name: 'Ada'})-[r:KNOWS]->(b) RETURN startNode(r).name AS s, endNode(r).name AS e, r.since AS y") == [("Ada", "Alan", 2018)]
    assert rows(social, "MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN [a.name, b.name, c.name] AS l") == [(["Ada", "Alan", "Grace"],)]
    assert rows(social, "MATCH (n) WHERE n:Company OR n.age > 80 RETURN n.name AS n ORDER BY n") == [("Analytics",), ("Grace",)]


def test_uniqueness_and_loops(frozen):
    assert rows(frozen, "MATCH (b {name: 'b'})-[r:LOOP]-(x) RETURN count(*) AS n") == [(1,)]
    assert rows(frozen, "MATCH (a)-[x]->(b)<-[y]-(c) RETURN count(*) AS n") == [(2,)]  # N into b and LOOP into b, either order


def test_trails(frozen):
    assert rows(frozen, "MATCH (a {name: 'a'})-[:N*1..3]->(x) RETURN x.name AS n ORDER BY n") == [("b",), ("c",), ("d",)]
    assert rows(frozen, "MATCH (a {name: 'a'})-[r:N*]->(x) RETURN x.name AS n, size(r) AS k ORDER BY k") == [("b", 1), ("c", 2), ("d", 3), ("a", 4)]
    assert rows(frozen, "MATCH p = (a {name: 'a'})-[:N*2]->(x) RETURN [n IN nodes(p) | n.name] AS l, length(p) AS k") == [(["a", "b", "c"], 2)]
    assert rows(frozen, "MATCH (a {name: 'a'})-[:N*0..1]->(x) RETURN x.name AS n ORDER BY n") == [("a",), ("b",)]
    assert rows(frozen, "MATCH (a {name: 'a'}), (d {name: 'd'}) MATCH p = shortestPath((a)-[:N*..5]-(d)) RETURN length(p) AS k") == [(1,)]
    assert len(rows(frozen, "MATCH (a {name: 'a'}), (c {name: 'c'}) MATCH p = allShortestPaths((a)-[:N*..5]-(c)) RETURN p")) == 2
    assert rows(frozen, "MATCH (a {name: 'a'}), (x {name: 'a'}) MATCH p = shortestPath((a)-[:N*..5]->(x)) RETURN length(p) AS k") == [(0,)]
    assert rows(frozen, "MATCH (a {name: 'a'})-[r:N*2]->(x) MATCH (a)-[r*]->(y) RETURN y.name AS n") == [("c",)]
    frozen.max_hops = 2
    with pytest.raises(CypherError):
        rows(frozen, "MATCH (a {name: 'a'})-[:N*]->(x) RETURN x")
    frozen.max_hops = 64


def test_path_procedures(frozen):
    q = "MATCH (a {name: 'a'}) CALL apoc.path.%s(a, {relationshipFilter: 'N>', maxLevel: 2}) YIELD %s "
    assert rows(frozen, q % ("subgraphNodes", "node") + "RETURN node.name AS n ORDER BY n") == [("a",), ("b",), ("c",)]
    assert rows(frozen, q % ("spanningTree", "path") + "RETURN length(path) AS k ORDER BY k") == [(0,), (1,), (2,)]
    assert rows(frozen, q % ("expandConfig", "path") + "RETURN length(path) AS k ORDER BY k") == [(1,), (2,)]
    assert rows(frozen, q % ("subgraphAll", "nodes, relationships") + "RETURN size(nodes) AS n, size(relationships) AS r") == [(3, 2)]
    assert rows(frozen, "MATCH (a {name: 'a'}) CALL apoc.path.expand(a, 'N>', '', 1, 1) YIELD path RETURN length(path) AS k") == [(1,)]


def test_path_node_lists(frozen):
    q = "MATCH (a {name: 'a'}), (b {name: 'b'}), (c {name: 'c'}), (d {name: 'd'}) CALL apoc.path.%s(a, {relationshipFilter: 'N%s', %s}) YIELD %s "
    ends = "RETURN nodes(path)[-1].name AS n ORDER BY n"
    names = lambda *a: [n for n, in rows(frozen, q % a)]
    assert names("expandConfig", ">", "blacklistNodes: [c]", "path " + ends) == ["b"]
    assert names("expandConfig", "", "blacklistNodes: [c]", "path " + ends) == ["b", "d"]
    assert names("expandConfig", ">", "whitelistNodes: [b, c]", "path " + ends) == ["b", "c"]
    assert names("expandConfig", ">", "endNodes: [c, d], blacklistNodes: null", "path " + ends) == ["c", "d"]
    assert names("expandConfig", ">", "whitelistNodes: []", "path " + ends) == []
    assert names("subgraphNodes", ">", "blacklistNodes: c", "node RETURN node.name AS n ORDER BY n") == ["a", "b"]
    assert names("spanningTree", ">", "minLevel: 0, filterStartNode: true, whitelistNodes: [b]", "path " + ends) == ["b"]
    assert rows(frozen, "MATCH (x) WHERE x.name IN ['c', 'd'] WITH collect(x) AS l MATCH (a {name: 'a'}) CALL apoc.path.expandConfig(a, {relationshipFilter: 'N>', endNodes: l}) YIELD path " + ends) == [("c",), ("d",)]
    per_row = "MATCH (a {name: 'a'}), (x) WHERE x.name IN ['b', 'd'] CALL apoc.path.subgraphNodes(a, {relationshipFilter: 'N>', blacklistNodes: [x]}) YIELD node RETURN x.name AS x, count(*) AS n ORDER BY x"
    assert rows(frozen, per_row) == [("b", 1), ("d", 3)]
    with pytest.raises(CypherError):
        rows(frozen, q % ("expandConfig", ">", "endNodes: ['c']", "path RETURN path"))


def expanded(edges, start, mode, most):
    """How many paths of each length a walk over ``edges`` in both directions finds."""
    out, level, nodes, used = {}, [((), (start,))], {start}, set()
    for depth in range(1, most + 1):
        here_n, here_r, now = ({start} if depth == 1 else set()), set(), []
        for rs, ns in level:
            for r, (x, y) in enumerate(edges):
                for far in {y} if x == ns[-1] == y else {y} if x == ns[-1] else {x} if y == ns[-1] else ():
                    taken = {"NODE_GLOBAL": far in nodes, "NODE_LEVEL": far in here_n, "NODE_PATH": far in ns, "RELATIONSHIP_GLOBAL": r in used, "RELATIONSHIP_LEVEL": r in here_r, "RELATIONSHIP_PATH": r in rs, "NONE": False}[mode]
                    if not taken:
                        nodes.add(far), here_n.add(far), used.add(r), here_r.add(r)
                        now.append(((*rs, r), (*ns, far)))
        level = now
        if level:
            out[depth] = len(level)
    return out


@pytest.mark.parametrize("mode", ["NODE_GLOBAL", "NODE_LEVEL", "NODE_PATH", "RELATIONSHIP_GLOBAL", "RELATIONSHIP_LEVEL", "RELATIONSHIP_PATH", "NONE", None])
def test_path_uniqueness(frozen, mode):
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 1)]  # the N in a ring, LOOP at b
    config = "{maxLevel: 4}" if mode is None else f"{{maxLevel: 4, uniqueness: '{mode.lower()}'}}"
    got = rows(frozen, f"MATCH (a {{name: 'a'}}) CALL apoc.path.expandConfig(a, {config}) YIELD path RETURN length(path) AS k, count(*) AS n")
    assert dict(got) == expanded(edges, 0, mode or "NODE_GLOBAL", 4)
    with pytest.raises(CypherError):
        rows(frozen, "MATCH (a {name: 'a'}) CALL apoc.path.expandConfig(a, {uniqueness: 'NODES'}) YIELD path RETURN path")


def test_subqueries(social):
    assert rows(social, "MATCH (a:Person) RETURN a.name AS n, EXISTS { (a)-[:LIKES]->() } AS e, COUNT { (a)--() } AS c, COLLECT { MATCH (a)-[:KNOWS]->(b) RETURN b.name } AS l ORDER BY n") == [("Ada", False, 3, ["Alan"]), ("Alan", True, 3, ["Grace"]), ("Grace", False, 1, [])]
    assert rows(social, "MATCH (a:Person) CALL { WITH a MATCH (a)-[:KNOWS]->(b) RETURN count(b) AS k } RETURN a.name AS n, k ORDER BY n") == [("Ada", 1), ("Alan", 1), ("Grace", 0)]
    assert rows(social, "MATCH (a:Person) CALL { WITH a MATCH (a)-[r]->(b) RETURN b.name AS b ORDER BY b DESC LIMIT 1 } RETURN a.name AS a, b ORDER BY a") == [("Ada", "Analytics"), ("Alan", "Grace")]
    assert rows(social, "MATCH (a:Person) WHERE COUNT { (a)-[:KNOWS]->() } > 0 AND a.age < 40 RETURN a.name AS n") == [("Ada",)]
    assert rows(social, "MATCH (a:Person) RETURN a.name AS n, [(a)-[:KNOWS]->(b) WHERE b.age > 40 | b.name] AS l ORDER BY n") == [("Ada", ["Alan"]), ("Alan", ["Grace"]), ("Grace", [])]


def test_order_sensitive_aggregates(social):
    assert rows(social, "MATCH (p:Person) WITH p ORDER BY p.age DESC RETURN collect(p.name) AS l") == [(["Grace", "Alan", "Ada"],)]
    assert rows(social, "MATCH (p:Person) WITH p.name AS n, p.age AS a ORDER BY a WITH n RETURN apoc.agg.first(n) AS f, apoc.agg.last(n) AS l, apoc.agg.nth(n, 1) AS m") == [("Ada", "Grace", "Alan")]
    assert rows(social, "UNWIND range(1, 50) AS x WITH x ORDER BY -x RETURN x % 2 AS k, collect(x)[0] AS top ORDER BY k") == [(0, 50), (1, 49)]
    assert rows(social, "UNWIND [3, 1, 2, 3] AS x WITH x ORDER BY x LIMIT 3 RETURN collect(DISTINCT x) AS l") == [([1, 2, 3],)]


def test_writes(social):
    assert rows(social, "MERGE (p:Person {name: 'Ada'}) ON MATCH SET p.seen = true ON CREATE SET p.seen = false RETURN p.seen AS s") == [(True,)]
    assert rows(social, "UNWIND ['X', 'Y', 'X'] AS n MERGE (p:Person {name: n}) ON CREATE SET p.age = 1 RETURN count(*) AS c") == [(3,)]
    assert rows(social, "MATCH (p:Person) RETURN count(*) AS c") == [(5,)]
    assert rows(social, "MATCH (p:Person {name: 'X'}) SET p:Robot, p.age = 5, p += {k: 'v'} RETURN labels(p) AS l, p.k AS k, p.age AS a") == [(["Person", "Robot"], "v", 5)]
    assert rows(social, "MATCH (p:Robot) REMOVE p:Robot, p.k RETURN labels(p) AS l, p.k AS k") == [(["Person"], None)]
    assert rows(social, "MATCH (a:Person {name: 'Ada'}), (b:Person {name: 'X'}) MERGE (a)-[r:KNOWS]->(b) ON CREATE SET r.since = 2020 RETURN r.since AS s") == [(2020,)]
    with pytest.raises(CypherError):
        rows(social, "MATCH (p:Person {name: 'X'}) DELETE p")
    rows(social, "MATCH (p:Person {name: 'X'}) DETACH DELETE p")
    rows(social, "MATCH (p:Person {name: 'Y'}) DELETE p")
    assert rows(social, "MATCH ()-[r:KNOWS]->() RETURN count(r) AS n") == [(2,)]
    rows(social, "MATCH (p:Person {name: 'Ada'}) FOREACH (x IN [1, 2] | SET p.score = x)")
    assert rows(social, "MATCH (p:Person {name: 'Ada'}) RETURN p.score AS s, keys(p) AS k") == [(2, ["age", "name", "score", "seen"])]
    rows(social, "MATCH (p:Person {name: 'Ada'}) SET p = {name: 'Ada'}")
    assert rows(social, "MATCH (p:Person {name: 'Ada'}) RETURN p.age AS a, p.score AS s") == [(None, None)]


def test_constraints_and_indexes(social):
    rows(social, "CREATE CONSTRAINT pn FOR (p:Person) REQUIRE p.name IS UNIQUE")
    with pytest.raises(ConstraintViolation):
        rows(social, "CREATE (:Person {name: 'Ada'})")
    assert rows(social, "MATCH (p:Person) RETURN count(*) AS n") == [(3,)]
    assert rows(social, "SHOW CONSTRAINTS")[0][0] == "pn"
    rows(social, "DROP CONSTRAINT pn")
    rows(social, "CREATE INDEX FOR (p:Person) ON (p.name, p.age)")
    rows(social, "CREATE POINT INDEX FOR (p:Person) ON (p.at)")
    assert len(rows(social, "SHOW INDEXES")) == 1 and len(rows(social, "SHOW POINT INDEXES")) == 1
    with pytest.raises(ConstraintViolation):
        rows(social, "CREATE CONSTRAINT FOR (c:Company) REQUIRE c.age IS NOT NULL")


def test_batches_and_procedures(social):
    rows(social, "UNWIND range(1, 5) AS i CALL { WITH i CREATE (:T {i: i}) } IN TRANSACTIONS OF 2 ROWS")
    assert rows(social, "MATCH (t:T) RETURN count(*) AS c, sum(t.i) AS s") == [(5, 15)]
    assert rows(social, "CALL apoc.periodic.iterate('MATCH (t:T) RETURN t', 'SET t.d = t.i * 2', {batchSize: 2}) YIELD batches, total RETURN batches, total") == [(3, 5)]
    assert rows(social, "MATCH (t:T) RETURN sum(t.d) AS s") == [(30,)]
    assert ("KNOWS",) in rows(social, "CALL db.relationshipTypes()")
    assert rows(social, "CALL apoc.meta.schema() YIELD value RETURN value['Person'].count AS n") == [(3,)]
    assert rows(social, "CALL apoc.cypher.run('MATCH (c:Company) RETURN c.name AS n', {}) YIELD value RETURN value.n AS n") == [("Analytics",)]
    rows(social, "CALL apoc.trigger.install('log', 'CREATE (:Log)', {phase: 'after'})")
    rows(social, "CREATE (:T {i: 9})")
    assert rows(social, "MATCH (l:Log) RETURN count(*) AS n") == [(1,)]
    assert rows(social, "CALL apoc.trigger.drop('log') YIELD name RETURN name") == [("log",)]
    assert "Scan" in rows(social, "EXPLAIN MATCH (n:Person) RETURN n.name AS n")[0][0]
    assert rows(social, "PROFILE MATCH (n:Person) RETURN n.name AS n")[0][1] == 3


def test_transactions(social):
    from arbora.sources.transactions import rollback, transaction

    with transaction(social) as t:
        t.cypher("CREATE (:Temp)")
        assert rows(t, "MATCH (x:Temp) RETURN count(*) AS n") == [(1,)]
        rollback(t)
    assert rows(social, "MATCH (x:Temp) RETURN count(*) AS n") == [(0,)]
    with transaction(social) as t:
        t.cypher("CREATE (:Temp)")
    assert rows(social, "MATCH (x:Temp) RETURN count(*) AS n") == [(1,)]


def test_files(spark, social, tmp_path):
    (tmp_path / "a.csv").write_text('name,age\nAda, 37\n"B, C",5\n')
    (tmp_path / "a.json").write_text('[{"x": 1, "y": {"z": "q"}}, {"x": 2}]')
    with pytest.raises(CypherError):
        rows(social, "LOAD CSV FROM 'a.csv' AS l RETURN l")
    social.import_root = str(tmp_path)
    with pytest.raises(CypherError):
        rows(social, "LOAD CSV FROM '../x.csv' AS l RETURN l")
    assert rows(social, "LOAD CSV WITH HEADERS FROM 'a.csv' AS l RETURN l.name AS n, toInteger(l.age) AS a ORDER BY a") == [("B, C", 5), ("Ada", 37)]
    assert rows(social, "CALL apoc.load.csv('a.csv', {}) YIELD lineNo, map RETURN lineNo, map['name'] AS n ORDER BY lineNo") == [(1, "Ada"), (2, "B, C")]
    assert rows(social, "CALL apoc.load.json('a.json') YIELD value RETURN value.x AS x, value.y.z AS z ORDER BY x") == [(1, "q"), (2, None)]
    assert rows(social, "CALL apoc.export.cypher.query('MATCH (a:Person)-[r:KNOWS]->(b) RETURN a, r, b', 'out-q') YIELD rows RETURN rows") == [(5,)]
    for what in ("csv", "json", "cypher"):
        assert rows(social, f"CALL apoc.export.{what}.all('out-{what}') YIELD nodes, relationships RETURN nodes, relationships") == [(4, 4)]
        assert any(f.startswith("part-") for f in os.listdir(tmp_path / f"out-{what}"))


def test_json_pointer_and_trigger_lists(social, tmp_path):
    social.import_root = str(tmp_path)
    (tmp_path / "o.json").write_text('{"meta": {"n": 3}, "a/b": [{"x": 1, "l": ["p", "q"]}, {"x": 2, "l": []}], "0": "zero"}')
    (tmp_path / "l.json").write_text(' [{"k": {"x": 7}}, {"k": {"x": 8}}]')
    (tmp_path / "one.json").write_text('[{"k": {"x": 9}}]')
    load = lambda f, p, what="value": rows(social, f"CALL apoc.load.json('{f}', '{p}') YIELD value RETURN {what} AS v ORDER BY v")
    assert load("o.json", "/a~1b", "value.x") == [(1,), (2,)]
    assert load("o.json", "/a~1b/1", "value.x") == [(2,)]
    assert load("o.json", "/a~1b/0/l") == [("p",), ("q",)]
    assert load("o.json", "/meta/n") == [(3,)] and load("o.json", "/0") == [("zero",)] and load("o.json", "", "value.meta.n") == [(3,)]
    assert load("l.json", "/1/k/x") == [(8,)] and load("one.json", "/0/k", "value.x") == [(9,)]
    for f, p in (("o.json", "/nothing"), ("o.json", "meta"), ("l.json", "/2"), ("l.json", "/k"), ("one.json", "/k")):
        with pytest.raises(CypherError):
            load(f, p)
    with pytest.raises(Exception, match="leads nowhere"):
        load("o.json", "/a~1b/2", "value.x")
    with pytest.raises(CypherError, match="phase"):
        rows(social, "CALL apoc.trigger.install('t', 'RETURN 1', {phase: 'whenever'})")


def test_trigger_lists(social):
    rows(social, "CALL apoc.trigger.install('t', 'UNWIND $createdNodes AS n WITH n WHERE n:Person SET n.seen = size($createdNodes)', {phase: 'before'})")
    rows(social, "UNWIND [1, 2] AS i CREATE (:Person {name: 'N' + toString(i)})")
    assert rows(social, "MATCH (p:Person) RETURN p.name AS n, p.seen AS s ORDER BY n") == [("Ada", None), ("Alan", None), ("Grace", None), ("N1", 2), ("N2", 2)]
    rows(social, "CALL apoc.trigger.install('t', 'UNWIND $removedNodeProperties AS c CREATE (:Log {key: c.key, old: toString(c.old), of: c.node.name})', {phase: 'after'})")
    rows(social, "CALL apoc.trigger.install('u', 'UNWIND $assignedLabels AS c CREATE (:Log {key: c.label, of: c.node.name})', {phase: 'after'})")
    rows(social, "MATCH (p:Person {name: 'Ada'}) REMOVE p.age SET p:Hero")
    rows(social, "CALL apoc.trigger.install('t', 'UNWIND $deletedRelationships AS c CREATE (:Log {key: type(c)})', {phase: 'afterAsync'})")
    rows(social, "MATCH ()-[r:LIKES]->() DELETE r")
    assert rows(social, "MATCH (l:Log) RETURN l.key AS k, l.old AS o, l.of AS f ORDER BY k") == [("Hero", None, "Ada"), ("LIKES", None, None), ("age", "37", "Ada")]
    rows(social, "CALL apoc.trigger.install('t', 'CREATE (:Log {bad: 1 / 0})', {phase: 'after'})")
    with pytest.warns(UserWarning, match="trigger t failed"):
        rows(social, "CREATE (:Person {name: 'late'})")
    assert rows(social, "MATCH (p:Person {name: 'late'}) RETURN count(*) AS n") == [(1,)]


def test_unions_of_kinds(social):
    assert rows(social, "MATCH (a:Person) CALL { WITH a MATCH (a)-[:KNOWS]->(b) RETURN b.name AS x UNION ALL WITH a MATCH (a)-[:LIKES]->(b) RETURN b.name AS x } RETURN a.name AS a, x ORDER BY a, x") == [("Ada", "Alan"), ("Alan", "Ada"), ("Alan", "Grace")]
    assert rows(social, "MATCH (a:Person {name: 'Ada'}) CALL { WITH a RETURN a.age AS x UNION MATCH (c:Company) RETURN c.name AS x } RETURN x ORDER BY x") == [("37",), ("Analytics",)]
    assert sorted(rows(social, "MATCH (n:Company) RETURN n.name AS x UNION RETURN 1 AS x")) == [("1",), ("Analytics",)]
    assert rows(social, "CALL { MATCH (x:Company) RETURN x UNION ALL MATCH (x:Person) RETURN x } RETURN x.name AS n, x.age AS a ORDER BY n") == [("Ada", 37), ("Alan", 41), ("Analytics", None), ("Grace", 85)]


def test_subqueries_in_lists(social):
    assert rows(social, "MATCH (a:Person) RETURN a.name AS n, [x IN [1, 2] | size([(a)-[:KNOWS]->(m) | m.name]) + x] AS l ORDER BY n") == [("Ada", [2, 3]), ("Alan", [2, 3]), ("Grace", [1, 2])]
    assert rows(social, "MATCH (a:Person) WITH collect(a) AS l RETURN [x IN l WHERE (x)-[:LIKES]->() | x.name] AS l, all(x IN l WHERE (x)--()) AS b, any(x IN l WHERE COUNT { (x)-[:KNOWS]->() } > 1) AS c") == [(["Alan"], True, False)]
    assert rows(social, "MATCH (n:Person) CALL apoc.cypher.run('MATCH (m {name: $x})-[:KNOWS]->(o) RETURN o.name AS o', {x: n.name}) YIELD value RETURN n.name AS n, value.o AS o ORDER BY n") == [("Ada", "Alan"), ("Alan", "Grace")]


def test_paths_and_types(social):
    assert rows(social, "MATCH p = (a:Person {name: 'Ada'})-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN [x IN apoc.path.elements(p) | coalesce(x.name, type(x))] AS l") == [(["Ada", "KNOWS", "Alan", "KNOWS", "Grace"],)]
    assert rows(social, "MATCH (a:Person {name: 'Ada'})-[r:KNOWS]->(b)-[s:KNOWS]->(c) RETURN [n IN nodes(apoc.path.create(a, [r, s])) | n.name] AS l, nodes(apoc.path.create(c, []))[0].name AS m") == [(["Ada", "Alan", "Grace"], "Grace")]
    assert rows(social, "CALL apoc.create.node(['Temp'], {k: 1}) YIELD node AS t RETURN t.k AS k") == [(1,)]
    with pytest.raises(ConstraintViolation):
        rows(social, "CREATE CONSTRAINT FOR (p:Person) REQUIRE p.age IS :: DATE")
    rows(social, "CREATE CONSTRAINT FOR (p:Person) REQUIRE p.age IS :: INTEGER")


def test_stream(spark, social, tmp_path):
    from arbora.streaming import write_stream

    spark.createDataFrame([("S1",), ("S2",)], "name string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    q = write_stream(social, stream, "MERGE (:Seen {name: name})", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(social, "MATCH (s:Seen) RETURN s.name AS n ORDER BY n") == [("S1",), ("S2",)]


EXPRESSIONS = [
    ("1 + 2 * 3 - 4 / 3", 6), ("-7 / 2", -3), ("-7 % 3", -1), ("2 ^ 3", 8.0), ("7.0 / 0", math.inf), ("0x1F + 0o17", 46), ("null = null", None), ("1 = 1.0", True), ("1 = 'a'", False), ("1 < 'a'", None),
    ("[1, 2] = [1, null]", None), ("[1, 2] = [1]", False), ("[1, 2] < [1, 3]", True), ("3 IN [1, null]", None), ("3 IN [3, null]", True), ("null IN []", False), ("1 < 2 < 3", True), ("true XOR null", None), ("NOT false AND true", True),
    ("'a' + 'b'", "ab"), ("[1] + [2] + 3", [1, 2, 3]), ("[1, 2, 3][-1]", 3), ("[1, 2, 3][5]", None), ("[1, 2, 3, 4][1..-1]", [2, 3]), ("{a: 1, b: 'x'}.b", "x"), ("'abc' =~ 'a.c'", True), ("'abc' STARTS WITH 1", None),
    ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE WHEN null THEN 1 ELSE 2.5 END", 2.5), ("[x IN range(1, 6) WHERE x % 2 = 0 | x * x]", [4, 16, 36]), ("reduce(s = '', x IN ['a', 'b'] | s + x)", "ab"),
    ("[x IN [1, 2] | [y IN [10, 20] | x + y]]", [[11, 21], [12, 22]]), ("any(x IN null WHERE x = 1)", False), ("single(x IN [1, 1] WHERE x = 1)", False), ("all(x IN [] WHERE x = 1)", True), ("none(x IN [1, null] WHERE x = 2)", None),
    ("size('é漢')", 2), ("toString(1e20)", "100000000000000000000.0"), ("toString(2.0)", "2.0"), ("toInteger('3.9')", 3), ("toInteger('x')", None), ("toFloat(' 1.5 ')", 1.5), ("toBoolean('yes')", None), ("split('a,b,', ',')", ["a", "b", ""]),
    ("substring('hello', 1, 3)", "ell"), ("left('hello', 2)", "he"), ("trim('\\t x ')", "x"), ("reverse([1, 2])", [2, 1]), ("range(5, 1, -2)", [5, 3, 1]), ("range(1, 0)", []), ("head([])", None), ("last([1, 2])", 2), ("tail([1, 2, 3])", [2, 3]),
    ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(3.14159, 2)", 3.14), ("round(2.5, 0, 'HALF_EVEN')", 2.0), ("sign(-3)", -1), ("ln(0)", -math.inf), ("coalesce(null, 2)", 2), ("valueType([1])", "LIST<INTEGER> NOT NULL"), ("isEmpty([])", True),
    ("toStringList([1, 2])", ["1", "2"]), ("keys({b: 1, a: 2})", ["a", "b"]), ("point({x: 1, y: 2}).y", 2.0), ("point.distance(point({x: 0, y: 0}), point({x: 3, y: 4}))", 5.0), ("point({x: 1, y: 2}).crs", "cartesian"),
    ("toString(date('2020-W10-1'))", "2020-03-02"), ("toString(date('2020060'))", "2020-02-29"), ("toString(date({year: 2020, month: 2}))", "2020-02-01"), ("date('2020-05-05').dayOfQuarter", 35), ("date('2021-01-03').weekYear", 2020),
    ("toString(date('2020-01-31') + duration('P1M'))", "2020-02-29"), ("toString(duration('P1Y2M3DT4H5.5S'))", "P1Y2M3DT4H5.5S"), ("toString(duration({days: 1.5}))", "P1DT12H"), ("duration({hours: 25, minutes: 61}).hours", 26),
    ("toString(duration.between(date('2020-01-31'), date('2021-03-01')))", "P1Y1M1D"), ("duration.inDays(date('2020-01-01'), date('2020-03-01')).days", 60), ("toString(datetime('2020-01-01T10:00:00+02:00'))", "2020-01-01T08:00Z"),
    ("toString(localdatetime('2020-01-01T10:00:01.5'))", "2020-01-01T10:00:01.5"), ("localtime('10:20:30').minute", 20), ("toString(time('10:20:30Z'))", "10:20:30Z"), ("toString(time('10:00+01:00') + duration('PT2H'))", "12:00+01:00"), ("time('10:00-02:30').offsetMinutes", -150), ("toString(time({hour: 3, timezone: '-02:30'}))", "03:00-02:30"),
    ("apoc.convert.fromJsonList('[1, 2]')", [1, 2]), ("apoc.convert.fromJsonMap('{\"a\": [true]}').a", [True]), ("toString(date.truncate('decade', date('2027-05-05')))", "2020-01-01"),
    ("toString(localdatetime.truncate('hour', localdatetime('2020-01-01T10:20')))", "2020-01-01T10:00"), ("toString(date.truncate('week', date('2020-01-01')))", "2019-12-30"),
    ("apoc.text.camelCase('foo bar_baz')", "fooBarBaz"), ("apoc.text.snakeCase('fooBar baz')", "foo_bar_baz"), ("apoc.text.join(['a', null, 'b'], '-')", "a--b"), ("apoc.text.lpad('abc', 5, '.')", "..abc"), ("apoc.text.lpad('abc', 2, '.')", "abc"),
    ("apoc.text.indexOf('hello', 'l')", 2), ("apoc.text.regexGroups('ab12', '([a-z]+)(\\\\d+)')", [["ab12", "ab", "12"]]), ("apoc.text.urlencode('a b*')", "a%20b%2A"), ("apoc.text.swapCase('aB')", "Ab"), ("apoc.text.base64Decode(apoc.text.base64Encode('x'))", "x"),
    ("apoc.coll.toSet([1, 2, 1])", [1, 2]), ("apoc.coll.sum([1, 2, null])", 3), ("apoc.coll.avg([1, 2])", 1.5), ("apoc.coll.zip([1, 2], [3])", [[1, 3]]), ("apoc.coll.indexOf([1, 2], 3)", -1), ("apoc.coll.flatten([[1], [2]])", [1, 2]), ("apoc.coll.subtract([1, 2], [2])", [1]),
    ("apoc.map.merge({a: 1}, {b: 2}).b", 2), ("apoc.map.values({a: 1, b: 2}, ['b'])", [2]), ("apoc.map.setKey({a: 1}, 'a', 3).a", 3), ("apoc.number.arabicToRoman(1994)", "MCMXCIV"), ("apoc.number.romanToArabic('MCMXCIV')", 1994), ("apoc.number.parseInt('ff', 16)", 255),
    ("apoc.util.md5(['a', 'b'])", "187ef4436122d1cc2f40dc2b92f0eba0"), ("apoc.convert.toJson([1, null])", "[1,null]"), ("apoc.convert.fromJsonMap('{\"a\": \"x\"}').a", "x"), ("apoc.meta.type(1.5)", "FLOAT"), ("apoc.date.convert(120, 's', 'm')", 2), ("apoc.date.add(1000, 'ms', 1, 's')", 2000),
]


def test_expressions(spark):
    g = Graph(spark)
    chunk = 12
    for first in range(0, len(EXPRESSIONS), chunk):
        part = EXPRESSIONS[first:first + chunk]
        got = rows(g, "RETURN " + ", ".join(f"{e} AS x{i}" for i, (e, _) in enumerate(part)))[0]
        for (e, want), x in zip(part, got):
            assert x == want or (x is None and want is None), (e, x, want)


@pytest.mark.parametrize("q", [
    "MATCH (n RETURN n", "RETURN 1 AS a, 2 AS a", "MATCH (n) WITH n.x RETURN 1", "RETURN 1 UNION RETURN 2 UNION ALL RETURN 3", "RETURN 'a\\q'", "MATCH (n) RETURN", "FOO (n)",
])
def test_syntax_errors(q):
    with pytest.raises(CypherSyntaxError):
        parse(q)


@pytest.mark.parametrize("q", ["RETURN x", "RETURN foo(1)", "MATCH (n) WHERE 1 RETURN n", "RETURN 1 + 'a'", "RETURN 1 AS a LIMIT -1", "UNWIND 3 AS x RETURN x", "RETURN count(count(1))", "RETURN 1 AS a UNION RETURN 1 AS b", "MATCH (n) RETURN $p", "CALL no.such()", "MATCH (n)"])
def test_meaning_errors(spark, q):
    with pytest.raises(CypherError):
        rows(Graph(spark), q)


def test_replay_walks_the_list(frozen):
    frozen.max_hops = 1  # no trail is looked for, so a list may be longer
    walk = "MATCH (:Link {name: 'a'})-[r:N*3]->(x) "
    assert rows(frozen, walk + "MATCH (p)-[r*]->(q) RETURN p.name AS p, q.name AS q") == [("a", "d")]
    assert rows(frozen, walk + "MATCH (p)<-[r*]-(q) RETURN p.name AS p") == []
    assert rows(frozen, walk + "WITH reverse(r) AS l MATCH (p)<-[l*]-(q) RETURN p.name AS p, q.name AS q") == [("d", "a")]
    assert rows(frozen, walk + "MATCH (p)-[r*]-(q) RETURN p.name AS p, q.name AS q") == [("a", "d")]
    assert rows(frozen, walk + "MATCH (p)-[r*]->(x) RETURN p.name AS p") == [("a",)]
    assert rows(frozen, walk + "WITH x, reverse(r) AS l MATCH (x)<-[l*]-(p) RETURN p.name AS p") == [("a",)]
    assert rows(frozen, walk + "MATCH (x)<-[r*]-(p) RETURN p.name AS p") == []
    assert rows(frozen, walk + "MATCH (p)-[r:N*2..3]->(q:Link {name: 'd'}) RETURN p.name AS p") == [("a",)]
    assert rows(frozen, walk + "MATCH (p)-[r*1..2]->(q) RETURN p.name AS p") == []
    assert rows(frozen, walk + "MATCH (p)-[r:LOOP*]->(q) RETURN p.name AS p") == []
    assert rows(frozen, walk + "MATCH (y)-[s]->(p)-[r*]->(q) RETURN y.name AS y, q.name AS q") == [("d", "d")]
    assert rows(frozen, walk + "MATCH (p)-[r*]->(q), (q)<-[s]-(y) RETURN y.name AS y") == []  # s is on the list
    assert rows(frozen, walk + "MATCH z = (p)-[r*]->()-[s:N]->(y) RETURN [n IN nodes(z) | n.name] AS l, length(z) AS k") == [(["a", "b", "c", "d", "a"], 4)]
    assert rows(frozen, walk + "MATCH z = (p)-[r*]->(x) RETURN [n IN nodes(z) | n.name] AS l") == [(["a", "b", "c", "d"],)]
    assert rows(frozen, walk + "OPTIONAL MATCH (p)-[r*]->(x) RETURN x.name AS x, p.name AS p") == [("d", "a")]
    assert rows(frozen, walk + "OPTIONAL MATCH (x)-[r*]->(p) RETURN x.name AS x, p.name AS p") == [("d", None)]


def test_replay_of_lists(spark):
    g = Graph(spark)
    g.cypher("CREATE (a:A {name: 'a'})-[:Y {k: 1}]->(b:B {name: 'b'})-[:Y {k: 2}]->(c:C {name: 'c'}), (b)-[:Z {k: 1}]->(a)")
    two = "MATCH ()-[x {k: 1}]->()-[y {k: 2}]->() "
    assert rows(g, two + "WITH [x, y] AS l MATCH (p)-[l*]->(q) RETURN p.name AS p, q.name AS q") == [("a", "c")]
    assert rows(g, two + "WITH [y, x] AS l MATCH (p)-[l*]-(q) RETURN p.name AS p, q.name AS q") == [("c", "a")]
    assert rows(g, two + "WITH [x, x] AS l MATCH (p)-[l*]-(q) RETURN p.name AS p") == []
    assert rows(g, "MATCH (:A)-[x:Y]->(), (:B)-[z:Z]->() WITH [x, z] AS l MATCH (p)-[l*]-(q) RETURN p.name AS p, q.name AS q ORDER BY p") == [("a", "a"), ("b", "b")]
    assert rows(g, two + "WITH [x, y] AS l MATCH (p)-[l* {k: 1}]->(q) RETURN p.name AS p") == []
    assert rows(g, "MATCH (:A)-[x*1..1]->() MATCH (p)-[x* {k: 1}]->(q) RETURN q.name AS q") == [("b",)]
    assert rows(g, "MATCH (:A)-[x*0..1]->() MATCH (p)-[x*0..]->(q) RETURN size(x) AS k, p.name AS p, q.name AS q ORDER BY k, p") == [(0, "a", "a"), (0, "b", "b"), (0, "c", "c"), (1, "a", "b")]
    assert rows(g, "WITH null AS l MATCH (p)-[l*]->(q) RETURN p.name AS p") == []
    with pytest.raises(CypherError):
        rows(g, "MATCH (p)-[x]->() MATCH (p)-[x*]->(q) RETURN q.name AS q")
    # What a statement changes itself is seen.
    assert rows(g, "MATCH (:A)-[l*2..2]->(c:C) MATCH ()-[x:Y {k: 1}]->() SET x.k = 2 WITH l MATCH (p)-[l* {k: 2}]->(q) RETURN p.name AS p, q.name AS q") == [("a", "c")]
    assert rows(g, "MATCH (:A)-[l*2..2]->(c:C) MATCH (c)<-[x]-() DELETE x WITH l MATCH (p)-[l*]->(q) RETURN p.name AS p") == []
