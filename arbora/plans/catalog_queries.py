"""Named queries over the star-schema graph, each with the SQL that gives the same rows.

The registry has one entry per operator or group of functions; ``QUERIES`` maps
names to callables of (spark, folder), ``ORACLES`` to SQL over the tables.
"""

from __future__ import annotations

from arbora.sources.graph import tables_graph

_PLACED = "orders o JOIN customer c ON o.o_custkey = c.c_custkey"

#: name: (query, SQL or None where SQL does not express it)
CATALOG: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.name AS nation, count(o) AS orders, round(sum(o.totalprice), 2) AS total ORDER BY total DESC LIMIT 10",
        f"SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {_PLACED} JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY total DESC LIMIT 10"),
    # scans and filters
    "scan_label": ("MATCH (c:Customer) RETURN c.name AS name, c.mktsegment AS segment", "SELECT c_name AS name, c_mktsegment AS segment FROM customer"),
    "scan_all_count": ("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", """SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
        UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events
        UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Page', count(*) FROM pages"""),
    "filter_eq": ("MATCH (c:Customer {mktsegment: 'BUILDING'}) WHERE c.acctbal > 5000 RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    "filter_3vl": ("MATCH (c:Customer) WHERE NOT (c.missing = 1) OR c.acctbal < 0 XOR c.name ENDS WITH '7' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE (c_acctbal < 0) <> (c_name LIKE '%7')"),
    "seek_label_property": ("MATCH (o:Order) WHERE o.priority IN ['1-URGENT', '2-HIGH'] AND o.status = 'F' RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'"),
    "edge_seek": ("MATCH ()-[l:CONTAINS {returnflag: 'R'}]->() WHERE l.quantity > 45 RETURN count(l) AS n, sum(l.linenumber) AS s", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"),
    "point_seek": ("MATCH (c:Customer) WITH c, point({x: c.acctbal, y: 0.0}) AS p WHERE point.withinBBox(p, point({x: 0.0, y: 0.0}), point({x: 1000.0, y: 1.0})) AND point.distance(p, point({x: 500.0, y: 0.0})) < 300 RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE abs(c_acctbal - 500) < 300"),
    # hops
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name, count(*) AS n, max(o.totalprice) AS m", f"SELECT c_name AS name, count(*) AS n, max(o_totalprice) AS m FROM {_PLACED} GROUP BY c_name"),
    "expand_in": ("MATCH (p:Part)<-[l:CONTAINS]-(:Order) RETURN p.brand AS brand, round(sum(l.quantity), 2) AS q", "SELECT p_brand AS brand, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"),
    "expand_both": ("MATCH (n:Nation)-[:IN_REGION]-(r) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "expand_multi_type": ("MATCH (n:Nation)-[r:IN_REGION|IN_NATION]-(x) RETURN n.name AS n, type(r) AS t, count(*) AS k", """SELECT n_name AS n, 'IN_REGION' AS t, count(*) AS k FROM nation GROUP BY 1 UNION ALL
        SELECT n_name, 'IN_NATION', count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1"""),
    "expand_edge_props": ("MATCH (o:Order)-[l:CONTAINS {linestatus: 'O'}]->(p:Part {brand: 'Brand#11'}) RETURN o.priority AS priority, count(l) AS n", "SELECT o_orderpriority AS priority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' AND p_brand = 'Brand#11' GROUP BY 1"),
    "two_hop_unique": ("MATCH (a:Part)<-[x:CONTAINS]-(o:Order)-[y:CONTAINS]->(b:Part) WHERE o.status = 'F' RETURN count(*) AS n", "SELECT count(*) AS n FROM (SELECT *, row_number() OVER () AS i FROM lineitem) x JOIN (SELECT *, row_number() OVER () AS i FROM lineitem) y ON x.l_orderkey = y.l_orderkey JOIN orders ON x.l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND NOT (x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey AND x.l_linenumber = y.l_linenumber AND x.l_quantity = y.l_quantity AND x.l_extendedprice = y.l_extendedprice AND x.l_shipdate = y.l_shipdate AND x.l_discount = y.l_discount AND x.l_tax = y.l_tax)"),
    "rebind": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 MATCH (c)-[:IN_NATION]->(n) RETURN n.name AS n, count(DISTINCT c) AS c", f"SELECT n_name AS n, count(DISTINCT c_custkey) AS c FROM {_PLACED} JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 GROUP BY 1"),
    "comma_pattern": ("MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS n, count(*) AS k", "SELECT n_name AS n, count(*) AS k FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "cartesian_theta": ("MATCH (a:Region), (b:Region) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name"),
    "join_on_property": ("MATCH (s:Supplier), (c:Customer) WHERE s.name = c.name RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier JOIN customer ON s_name = c_name"),
    # optional and correlated
    "optional_single": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.name AS name, count(o) AS n", "SELECT c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name"),
    "optional_multi": ("MATCH (s:Supplier) OPTIONAL MATCH (s)-[:SUPPLIES]->(p:Part)<-[l:CONTAINS]-(o:Order) WHERE p.size > 48 AND o.status = 'P' RETURN s.name AS name, count(p) AS n", """SELECT s_name AS name, count(k) AS n FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) ON sk = s_suppkey AND pk IN (SELECT p_partkey FROM part WHERE p_size > 48)
        LEFT JOIN (SELECT l_partkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') ON k = pk GROUP BY 1"""),
    "optional_bare": ("OPTIONAL MATCH (n:Nowhere) RETURN n.name AS name", "SELECT CAST(NULL AS VARCHAR) AS name"),
    "semi_pattern": ("MATCH (p:Part) WHERE (p)<-[:CONTAINS {returnflag: 'R'}]-() RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"),
    "anti_pattern": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {priority: '1-URGENT'}) RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "exists_sub": ("MATCH (n:Nation) WHERE EXISTS { MATCH (n)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal > 9900 } RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    "count_sub": ("MATCH (n:Nation) RETURN n.name AS name, COUNT { (n)<-[:IN_NATION]-(:Supplier) } AS suppliers", "SELECT n_name AS name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "collect_sub": ("MATCH (r:Region) WITH r, COLLECT { MATCH (r)<-[:IN_REGION]-(n) RETURN n.name } AS names RETURN r.name AS name, apoc.text.join(apoc.coll.sort(names), ',') AS names", "SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "pattern_comp": ("MATCH (n:Nation) RETURN n.name AS name, size([(n)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal < 0 | c.name]) AS debtors", "SELECT n_name AS name, count(c_custkey) AS debtors FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY 1"),
    "call_sub": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN max(c.acctbal) AS best } RETURN n.name AS name, best", "SELECT n_name AS name, max(c_acctbal) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "call_sub_free": ("MATCH (r:Region) CALL { MATCH (n:Nation) RETURN count(*) AS n } RETURN r.name AS name, n", "SELECT r_name AS name, (SELECT count(*) FROM nation) AS n FROM region"),
    "call_sub_union": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal > 9000 RETURN c.name AS x UNION ALL WITH n MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 5000 RETURN s.name AS x UNION ALL WITH n MATCH (n)-[:IN_REGION]->(r) RETURN r.name AS x } RETURN n.name AS name, x", """SELECT n_name AS name, c_name AS x FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION ALL SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000
        UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "list_subquery": ("MATCH (r:Region) MATCH (r)<-[:IN_REGION]-(n) WITH r, collect(n) AS l RETURN r.name AS name, reduce(s = 0, x IN [n IN l | size([(n)<-[:IN_NATION]-(c:Customer) | c.name])] | s + x) AS customers, all(n IN l WHERE (n)<-[:IN_NATION]-(:Supplier)) AS a, size([n IN l WHERE EXISTS { (n)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal > 9500 }]) AS rich", """SELECT r_name AS name, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS customers,
        (SELECT bool_and(n_nationkey IN (SELECT s_nationkey FROM supplier)) FROM nation WHERE n_regionkey = r_regionkey) AS a, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)) AS rich FROM region"""),
    "repeated_node": ("MATCH (o:Order)-[x:CONTAINS]->(p:Part)<-[y:CONTAINS]-(o) RETURN o.status AS s, count(*) AS n", "SELECT o_orderstatus AS s, count(*) AS n FROM (SELECT *, row_number() OVER () AS i FROM lineitem) x JOIN (SELECT *, row_number() OVER () AS i FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_partkey = y.l_partkey AND x.i <> y.i JOIN orders ON x.l_orderkey = o_orderkey GROUP BY 1"),
    "optional_target_bound": ("MATCH (r:Region) OPTIONAL MATCH (n:Nation)-[:IN_REGION]->(r) WHERE n.name < 'F' RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name < 'F'"),
    "edge_point_seek": ("MATCH ()-[l:CONTAINS]->() WITH point({x: l.quantity, y: l.discount}) AS p WHERE point.withinBBox(p, point({x: 10.0, y: 0.02}), point({x: 20.0, y: 0.05})) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05"),
    # paths
    "path_functions": ("MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) WHERE c.acctbal > 9000 RETURN [x IN apoc.path.elements(p) | coalesce(x.name, type(x))][4] AS last, [x IN apoc.path.elements(p) | type(x)][1] AS t, length(apoc.path.slice(p, 1, 1)) AS s, nodes(apoc.path.slice(p, 1, 1))[0].name AS m, length(apoc.path.combine(apoc.path.slice(p, 0, 1), apoc.path.slice(p, 1, 1))) AS l, nodes(apoc.path.create(c, relationships(p)))[2].name AS z", "SELECT r_name AS last, 'IN_NATION' AS t, 1::BIGINT AS s, n_name AS m, 2::BIGINT AS l, r_name AS z FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000"),
    "varlen_replay": ("MATCH (c:Customer)-[l:IN_NATION|IN_REGION*2..2]->(r) WHERE c.acctbal > 9800 MATCH (a)-[l*]->(b) RETURN a.name AS a, b.name AS b, size(l) AS n", "SELECT c_name AS a, r_name AS b, 2::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9800"),
    "path_expand_config": ("MATCH (r:Region) CALL apoc.path.expandConfig(r, {relationshipFilter: '<IN_REGION|<IN_NATION', labelFilter: '-Supplier', minLevel: 1, maxLevel: 2, uniqueness: 'NODE_PATH'}) YIELD path RETURN r.name AS r, length(path) AS l, count(*) AS n", "SELECT r_name AS r, 1::BIGINT AS l, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name, 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "path_expand_plain": ("MATCH (n:Nation) CALL apoc.path.expand(n, 'IN_REGION>', '+Region', 1, 1) YIELD path AS p RETURN n.name AS n, nodes(p)[1].name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "path_spanning": ("MATCH (r:Region {name: 'ASIA'}) CALL apoc.path.spanningTree(r, {relationshipFilter: '<IN_REGION|<IN_NATION'}) YIELD path RETURN length(path) AS l, count(*) AS n", "SELECT 0::BIGINT AS l, 1::BIGINT AS n UNION ALL SELECT 1, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 2, count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "path_subgraph_all": ("MATCH (r:Region) CALL apoc.path.subgraphAll(r, {relationshipFilter: '<IN_REGION'}) YIELD nodes, relationships RETURN r.name AS r, size(nodes) AS n, size(relationships) AS e", "SELECT r_name AS r, 1 + count(*) AS n, count(*) AS e FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "varlen_1_3": ("MATCH (c:Customer)-[:IN_NATION|IN_REGION*1..3]->(x) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Region', count(*) FROM customer"),
    "varlen_unbounded": ("MATCH (s:Supplier)-[:IN_NATION|IN_REGION*]->(r:Region) RETURN r.name AS name, count(*) AS n", "SELECT r_name AS name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "varlen_zero": ("MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM nation"),
    "shortest_path": ("MATCH (a:Nation), (b:Nation) WHERE a.name < b.name MATCH p = shortestPath((a)-[:IN_REGION*..2]-(b)) RETURN a.name AS a, b.name AS b, length(p) AS hops", "SELECT a.n_name AS a, b.n_name AS b, 2::BIGINT AS hops FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"),
    "all_shortest": ("MATCH (a:Region {name: 'ASIA'}), (c:Customer) WHERE c.acctbal > 9000 MATCH p = allShortestPaths((a)-[:IN_REGION|IN_NATION*..2]-(c)) RETURN c.name AS name, length(p) AS hops", "SELECT c_name AS name, 2::BIGINT AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 9000"),
    "bind_path": ("MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) WHERE c.acctbal > 9500 RETURN [x IN nodes(p) | x.name][0] AS first, nodes(p)[2].name AS last, length(p) AS hops, type(relationships(p)[1]) AS t", "SELECT c_name AS first, r_name AS last, 2::BIGINT AS hops, 'IN_REGION' AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9500"),
    "path_expand": ("MATCH (r:Region {name: 'EUROPE'}) CALL apoc.path.subgraphNodes(r, {relationshipFilter: '<IN_REGION|<IN_NATION', maxLevel: 2}) YIELD node RETURN labels(node)[0] AS label, count(*) AS n", """SELECT 'Region' AS label, 1::BIGINT AS n UNION ALL SELECT 'Nation', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'
        UNION ALL SELECT 'Customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'
        UNION ALL SELECT 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"""),
    # projection and flow
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c.mktsegment AS segment, count(*) AS n, avg(o.totalprice) AS a WHERE n > 10 RETURN segment, n, round(a, 2) AS a", f"SELECT c_mktsegment AS segment, count(*) AS n, round(avg(o_totalprice), 2) AS a FROM {_PLACED} GROUP BY 1 HAVING count(*) > 10"),
    "unwind": ("MATCH (r:Region) UNWIND split(r.name, ' ') AS word RETURN word, count(*) AS n", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(r_name, ' ')) AS w FROM region) GROUP BY 1"),
    "union_mixed": ("MATCH (n:Nation) RETURN n.name AS x UNION MATCH (p:Part) RETURN p.size AS x", "SELECT n_name AS x FROM nation UNION SELECT CAST(p_size AS VARCHAR) FROM part"),
    "union_nodes": ("CALL { MATCH (x:Region) RETURN x UNION ALL MATCH (x:Nation) RETURN x } RETURN labels(x)[0] AS l, x.name AS name", "SELECT 'Region' AS l, r_name AS name FROM region UNION ALL SELECT 'Nation', n_name FROM nation"),
    "project_all": ("MATCH (r:Region) WITH r.name AS name, size(r.name) AS n WITH * WHERE n > 4 RETURN *", "SELECT r_name AS name, length(r_name) AS n FROM region WHERE length(r_name) > 4"),
    "unwind_range": ("UNWIND range(1, 1000) AS x WITH x WHERE x % 7 = 0 RETURN count(*) AS n, sum(x) AS s", "SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM range(1, 1001) t(x) WHERE x % 7 = 0"),
    "distinct": ("MATCH (o:Order) RETURN DISTINCT o.status AS status, o.priority AS priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders"),
    "distinct_nodes": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 WITH DISTINCT c RETURN c.name AS name", f"SELECT DISTINCT c_name AS name FROM {_PLACED} WHERE o_totalprice > 200000"),
    "union": ("MATCH (c:Customer) RETURN c.mktsegment AS x UNION MATCH (r:Region) RETURN r.name AS x", "SELECT c_mktsegment AS x FROM customer UNION SELECT r_name FROM region"),
    "union_all": ("MATCH (n:Nation) RETURN n.name AS x UNION ALL MATCH (r:Region) RETURN r.name AS x", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region"),
    "orderby_nulls": ("UNWIND [3, null, 1, 2] AS x RETURN x ORDER BY x DESC LIMIT 2", "SELECT x FROM (VALUES (3::BIGINT), (NULL), (1), (2)) t(x) ORDER BY x DESC NULLS FIRST LIMIT 2"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS b ORDER BY b DESC, name SKIP 10 LIMIT 15", "SELECT c_name AS name, c_acctbal AS b FROM customer ORDER BY b DESC, name LIMIT 15 OFFSET 10"),
    "orderby_hidden": ("MATCH (p:Part) RETURN p.name AS name ORDER BY p.retailprice DESC, p.name LIMIT 5", "SELECT p_name AS name FROM part ORDER BY p_retailprice DESC, p_name LIMIT 5"),
    "reduce_list": ("UNWIND range(1, 20) AS x RETURN x, reduce(a = 1, i IN range(1, x) | a * i % 1000) AS r, [i IN range(1, x) WHERE i % 3 = 0 | i * i][-1] AS last", "WITH RECURSIVE f(x, r) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT x + 1, (r * (x + 1)) % 1000 FROM f WHERE x < 20) SELECT x, r, CASE WHEN x < 3 THEN NULL ELSE ((x // 3) * 3) * ((x // 3) * 3) END AS last FROM f"),
    "quantifiers": ("UNWIND range(1, 12) AS x WITH x, [i IN range(1, x) WHERE x % i = 0] AS d RETURN x, all(i IN d WHERE i > 0) AS a, any(i IN d WHERE i = 4) AS b, none(i IN d WHERE i = 5) AS c, single(i IN d WHERE i = 3) AS e", "SELECT x, true AS a, x % 4 = 0 AS b, x % 5 <> 0 AS c, x % 3 = 0 AS e FROM range(1, 13) t(x)"),
    "case_expr": ("MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'low' ELSE 'high' END AS class, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, count(*) AS n FROM customer GROUP BY 1"),
    # aggregates
    "agg_count": ("MATCH (o:Order) RETURN o.status AS status, count(*) AS n, count(o.missing) AS none, count(DISTINCT o.priority) AS p", "SELECT o_orderstatus AS status, count(*) AS n, 0::BIGINT AS none, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1"),
    "agg_sum_avg": ("MATCH (p:Part) RETURN p.brand AS brand, sum(p.size) AS s, round(avg(p.retailprice), 3) AS a", "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_retailprice), 3) AS a FROM part GROUP BY 1"),
    "agg_empty": ("MATCH (n:Nowhere) RETURN count(*) AS c, sum(n.x) AS s, size(collect(n.x)) AS l", "SELECT 0::BIGINT AS c, 0::DOUBLE AS s, 0::BIGINT AS l"),
    "agg_min_max": ("MATCH (o:Order) RETURN o.priority AS p, min(o.orderdate) AS a, max(o.orderdate) AS b", "SELECT o_orderpriority AS p, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1"),
    "agg_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH r.name AS r, n.name AS n ORDER BY n RETURN r, size(collect(n)) AS k, apoc.text.join(apoc.coll.sort(collect(DISTINCT n)), ';') AS names", "SELECT r_name AS r, count(*) AS k, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_stdev": ("MATCH (c:Customer) RETURN c.mktsegment AS s, round(stDev(c.acctbal), 4) AS sd, round(stDevP(c.acctbal), 4) AS sp", "SELECT c_mktsegment AS s, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sp FROM customer GROUP BY 1"),
    "agg_percentile": ("MATCH (c:Customer) RETURN c.mktsegment AS s, percentileDisc(c.acctbal, 0.5) AS d, round(percentileCont(c.acctbal, 0.9), 4) AS q, round(apoc.agg.median(c.acctbal), 4) AS m", "SELECT c_mktsegment AS s, quantile_disc(c_acctbal, 0.5) AS d, round(quantile_cont(c_acctbal, 0.9), 4) AS q, round(median(c_acctbal), 4) AS m FROM customer GROUP BY 1"),
    "agg_product": ("UNWIND range(1, 10) AS x RETURN x % 2 AS k, apoc.agg.product(x) AS p", "SELECT k, p FROM (VALUES (0::BIGINT, 3840::BIGINT), (1, 945)) t(k, p)"),
    "agg_ordered": ("MATCH (o:Order) WITH o ORDER BY o.totalprice, o.orderdate RETURN o.status AS s, apoc.agg.first(o.totalprice) AS f, apoc.agg.last(o.totalprice) AS l, apoc.agg.nth(o.totalprice, 2) AS n", "SELECT o_orderstatus AS s, min(o_totalprice) AS f, max(o_totalprice) AS l, list_sort(list(o_totalprice))[3] AS n FROM orders GROUP BY 1"),
    "agg_percentile_of": ("MATCH (p:Part) RETURN p.brand AS b, percentileDisc(p.size, 1.0 / 2) AS d, round(percentileCont(p.retailprice, 0.25 * 3), 4) AS c", "SELECT p_brand AS b, CAST(quantile_disc(p_size, 0.5) AS BIGINT) AS d, round(quantile_cont(p_retailprice, 0.75), 4) AS c FROM part GROUP BY 1"),
    "agg_nested": ("MATCH (o:Order) RETURN o.status AS s, 1 + count(*) * 2 AS n, round(sum(o.totalprice) / count(*), 2) AS a", "SELECT o_orderstatus AS s, 1 + count(*) * 2 AS n, round(sum(o_totalprice) / count(*), 2) AS a FROM orders GROUP BY 1"),
    # functions
    "str_basic": ("MATCH (c:Customer) RETURN toUpper(left(c.name, 4)) AS a, toLower(right(c.name, 3)) AS b, substring(c.name, 2, 3) AS c, replace(c.name, '0', 'o') AS d, reverse(c.name) AS e, size(c.name) AS f, trim('  x ') AS g", "SELECT upper(left(c_name, 4)) AS a, lower(right(c_name, 3)) AS b, substr(c_name, 3, 3) AS c, replace(c_name, '0', 'o') AS d, reverse(c_name) AS e, length(c_name) AS f, 'x' AS g FROM customer"),
    "str_match": ("MATCH (c:Customer) WHERE c.mktsegment STARTS WITH 'B' AND c.name CONTAINS '1' AND c.name =~ '.*[02468]' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment LIKE 'B%' AND c_name LIKE '%1%' AND regexp_full_match(c_name, '.*[02468]')"),
    "regex_match": ("MATCH (d:Document) WHERE d.text =~ '(?s).*[0-9]{3}.*' RETURN d.lang AS lang, count(*) AS n", "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '[0-9]{3}') GROUP BY lang"),
    "is_null": ("MATCH (x) WHERE x:Customer OR x:Supplier RETURN x.mktsegment IS NULL AS a, x.acctbal IS NOT NULL AS b, count(*) AS n", "SELECT false AS a, true AS b, count(*) AS n FROM customer UNION ALL SELECT true, true, count(*) FROM supplier"),
    "label_test": ("MATCH (x)-[:IN_NATION]->(n) RETURN x:Customer AS c, count(*) AS n", "SELECT true AS c, count(*) AS n FROM customer UNION ALL SELECT false, count(*) FROM supplier"),
    "str_concat": ("MATCH (n:Nation) RETURN n.name + '-' + toString(size(n.name)) AS a, [n.name] + ['x'] + 'y' AS l", "SELECT n_name || '-' || CAST(length(n_name) AS VARCHAR) AS a, [n_name, 'x', 'y'] AS l FROM nation"),
    "coalesce_empty": ("MATCH (x) WHERE x:Customer OR x:Supplier RETURN coalesce(x.mktsegment, 'none') AS s, isEmpty(x.name) AS e, isEmpty([]) AS f, exists(x.mktsegment) AS h, count(*) AS n", "SELECT s, false AS e, true AS f, s <> 'none' AS h, count(*) AS n FROM (SELECT c_mktsegment AS s FROM customer UNION ALL SELECT 'none' FROM supplier) GROUP BY s"),
    "conv_or_null": ("MATCH (p:Part) WITH split(p.brand, '#') AS b, p RETURN toIntegerOrNull(b[1]) AS i, toFloatOrNull(b[0]) AS f, toBooleanOrNull('x') IS NULL AS t, toStringOrNull(p.size) AS s, toIntegerList(['1', 'z', toString(p.size)])[2] AS l, valueType(p.size) AS v, count(*) AS n", "SELECT CAST(substr(p_brand, 7) AS BIGINT) AS i, NULL::DOUBLE AS f, true AS t, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS BIGINT) AS l, 'INTEGER NOT NULL' AS v, count(*) AS n FROM part GROUP BY p_brand, p_size"),
    "ids_and_ends": ("MATCH (a)-[r:IN_REGION]->(b) WHERE id(startNode(r)) = id(a) AND elementId(endNode(r)) = elementId(b) RETURN startNode(r).name AS s, endNode(r).name AS e, id(a) <> id(b) AS d", "SELECT n_name AS s, r_name AS e, true AS d FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "get_by_id": ("MATCH (r:Region {name: 'ASIA'}) WITH id(r) AS i MATCH (x) WHERE id(x) = i RETURN x.name AS name, labels(x)[0] AS label", "SELECT 'ASIA' AS name, 'Region' AS label"),
    "text_apoc_more": ("MATCH (r:Region) RETURN apoc.text.repeat(left(r.name, 2), 3) AS a, apoc.text.reverse(r.name) AS b, apoc.text.urlencode(r.name) AS c, apoc.text.urldecode(apoc.text.urlencode(r.name)) AS d, apoc.text.base64Encode(r.name) AS e, apoc.text.base64Decode(apoc.text.base64Encode(r.name)) AS f, apoc.text.hexValue(size(r.name)) AS g, apoc.text.clean(r.name) AS h", """SELECT repeat(left(r_name, 2), 3) AS a, reverse(r_name) AS b, replace(r_name, ' ', '%20') AS c, r_name AS d,
        to_base64(encode(r_name)) AS e, r_name AS f, upper(to_hex(length(r_name))) AS g, replace(lower(r_name), ' ', '') AS h FROM region"""),
    "regex_groups": ("MATCH (p:Part) RETURN apoc.text.regexGroups(p.brand, '([A-Z])[a-z]+#(\\\\d)')[0][2] AS g, count(*) AS n", "SELECT substr(p_brand, 7, 1) AS g, count(*) AS n FROM part GROUP BY 1"),
    "map_apoc_more": ("MATCH (r:Region) WITH {name: r.name, n: size(r.name)} AS m RETURN apoc.map.setKey(m, 'z', 1).z AS a, size(keys(apoc.map.removeKey(m, 'n'))) AS b, m['name'] AS c, apoc.map.values(m, ['name'])[0] AS d, apoc.map.submap(m, ['n']).n AS e, apoc.map.fromPairs([['k', m.name]]).k AS f", "SELECT 1::BIGINT AS a, 1::BIGINT AS b, r_name AS c, r_name AS d, length(r_name) AS e, r_name AS f FROM region"),
    "json_convert": ("MATCH (r:Region) RETURN apoc.convert.toJson({a: r.name, b: [1, 2]}) AS j, apoc.convert.fromJsonMap('{\"k\": 7, \"l\": [1, 2]}').k AS k", """SELECT '{"a":"' || r_name || '","b":[1,2]}' AS j, 7::BIGINT AS k FROM region"""),
    "json_list": ("MATCH (r:Region) UNWIND apoc.convert.fromJsonList('[1, 2, 4]') AS x RETURN r.name AS name, sum(x) AS s", "SELECT r_name AS name, 7::BIGINT AS s FROM region"),
    "number_apoc": ("MATCH (n:Nation) RETURN apoc.number.arabicToRoman(size(n.name)) AS r, apoc.number.romanToArabic(apoc.number.arabicToRoman(size(n.name))) AS a, apoc.number.parseInt(toString(size(n.name))) AS i, apoc.number.parseFloat('1.5') AS f", """SELECT list_extract(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'], CAST(length(n_name) AS INTEGER)) AS r, length(n_name) AS a,
        length(n_name) AS i, 1.5::DOUBLE AS f FROM nation"""),
    "date_apoc": ("MATCH (p:Part) RETURN apoc.date.convert(p.size, 'h', 'm') AS a, apoc.date.add(p.size, 's', 2, 'm') AS b, apoc.date.toISO8601(p.size * 1000, 'ms') AS c, apoc.date.fromISO8601('1970-01-01T00:00:01.000Z') AS d, count(*) AS n", "SELECT CAST(p_size AS BIGINT) * 60 AS a, CAST(p_size AS BIGINT) + 120 AS b, strftime(TIMESTAMP '1970-01-01' + to_seconds(p_size), '%Y-%m-%dT%H:%M:%S.000Z') AS c, 1000::BIGINT AS d, count(*) AS n FROM part GROUP BY p_size"),
    "uuids": ("MATCH (r:Region) WITH collect(apoc.create.uuid()) AS u, collect(randomUUID()) AS w, collect(rand()) AS x RETURN size(apoc.coll.toSet(u)) AS a, size(w[0]) AS b, all(y IN x WHERE y >= 0 AND y < 1) AS c, apoc.create.uuidBase64ToHex(apoc.create.uuidHexToBase64(u[0])) = u[0] AS d, timestamp() > 1600000000000 AS e", "SELECT count(*) AS a, 36::BIGINT AS b, true AS c, true AS d, true AS e FROM region"),
    "meta_types": ("MATCH (p:Part) RETURN apoc.meta.type(p.size) AS a, apoc.meta.isType(p.name, 'STRING') AS b, apoc.meta.types({x: p.retailprice}).x AS c, apoc.meta.type(p) AS d, count(*) AS n", "SELECT 'INTEGER' AS a, true AS b, 'FLOAT' AS c, 'NODE' AS d, count(*) AS n FROM part"),
    "math_trig": ("MATCH (p:Part) RETURN p.size AS x, round(cos(p.size), 6) AS a, round(tan(p.size), 6) AS b, round(asin(1.0 / p.size), 6) AS c, round(acos(1.0 / p.size), 6) AS d, round(cot(p.size), 6) AS e, round(radians(p.size), 6) AS f, round(haversin(p.size), 6) AS g, round(log10(p.size), 6) AS h, round(pi() + e(), 6) AS i, count(*) AS n", """SELECT CAST(p_size AS BIGINT) AS x, round(cos(p_size), 6) AS a, round(tan(p_size), 6) AS b, round(asin(1.0 / p_size), 6) AS c, round(acos(1.0 / p_size), 6) AS d, round(1 / tan(p_size), 6) AS e,
        round(radians(p_size), 6) AS f, round((1 - cos(p_size)) / 2, 6) AS g, round(log10(p_size), 6) AS h, round(pi() + exp(1), 6) AS i, count(*) AS n FROM part GROUP BY p_size"""),
    "round_modes": ("MATCH (p:Part) WITH DISTINCT p.size + 0.5 AS x RETURN x, round(x, 0, 'UP') AS a, round(x, 0, 'DOWN') AS b, round(x, 0, 'CEILING') AS c, round(x, 0, 'FLOOR') AS d, round(x, 0, 'HALF_DOWN') AS e, round(x, 0, 'HALF_EVEN') AS f", "SELECT DISTINCT p_size + 0.5::DOUBLE AS x, p_size + 1.0::DOUBLE AS a, p_size::DOUBLE AS b, p_size + 1.0::DOUBLE AS c, p_size::DOUBLE AS d, p_size::DOUBLE AS e, p_size + p_size % 2.0::DOUBLE AS f FROM part"),
    "math_basic": ("MATCH (c:Customer) RETURN round(abs(c.acctbal), 2) AS a, sign(c.acctbal) AS b, floor(c.acctbal) AS c, ceil(c.acctbal) AS d, round(sqrt(abs(c.acctbal)), 6) AS e, 7 / 2 AS f, -7 % 3 AS g, 2 ^ 10 AS h", "SELECT round(abs(c_acctbal), 2) AS a, CAST(sign(c_acctbal) AS BIGINT) AS b, floor(c_acctbal) AS c, ceil(c_acctbal) AS d, round(sqrt(abs(c_acctbal)), 6) AS e, 3::BIGINT AS f, -1::BIGINT AS g, 1024.0::DOUBLE AS h FROM customer"),
    "math_float": ("UNWIND [1.0, 0.0, -1.0] AS x RETURN x, round(exp(x), 6) AS e, round(sin(x), 6) AS s, round(atan2(x, 2), 6) AS t, round(degrees(x), 6) AS d, isNaN(x) AS n", "SELECT x::DOUBLE AS x, round(exp(x), 6) AS e, round(sin(x), 6) AS s, round(atan2(x, 2), 6) AS t, round(degrees(x), 6) AS d, false AS n FROM (VALUES (1.0::DOUBLE), (0.0), (-1.0)) t(x)"),
    "conv": ("UNWIND ['1', ' 2 ', '3.7', 'x'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean('TRUE') AS b, toString(2.0) AS t", "SELECT s, i::BIGINT AS i, f::DOUBLE AS f, true AS b, '2.0' AS t FROM (VALUES ('1', 1, 1.0), (' 2 ', 2, 2.0), ('3.7', 3, 3.7), ('x', NULL, NULL)) t(s, i, f)"),
    "list_functions": ("UNWIND range(3, 6) AS n WITH n, range(1, n) AS l RETURN n, head(l) AS h, last(l) AS z, size(tail(l)) AS t, l[1..3][1] AS s, l[-2] AS m, 3 IN l AS i, apoc.coll.sum(l) AS u", "SELECT n, 1::BIGINT AS h, n AS z, n - 1 AS t, 3::BIGINT AS s, n - 1 AS m, true AS i, n * (n + 1) // 2 AS u FROM range(3, 7) t(n)"),
    "map_functions": ("MATCH (r:Region) WITH r {.name, n: size(r.name)} AS m RETURN m.name AS name, m['n'] AS n, apoc.map.merge(m, {x: 1}).x AS x, size(keys(m)) AS k", "SELECT r_name AS name, length(r_name) AS n, 1::BIGINT AS x, 2::BIGINT AS k FROM region"),
    "time_parts": ("MATCH (o:Order) RETURN o.orderdate.year AS y, o.orderdate.quarter AS q, o.orderdate.month AS m, count(*) AS n", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "time_week": ("MATCH (o:Order) RETURN o.orderdate.week AS w, o.orderdate.weekYear AS wy, o.orderdate.dayOfWeek AS d, count(*) AS n", "SELECT weekofyear(o_orderdate) AS w, isoyear(o_orderdate) AS wy, isodow(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "time_truncate": ("MATCH (o:Order) RETURN toString(date.truncate('month', o.orderdate)) AS m, count(*) AS n", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, count(*) AS n FROM orders GROUP BY 1"),
    "date_make": ("MATCH (o:Order) RETURN date({year: o.orderdate.year, month: o.orderdate.month, day: 1}) AS d, toString(date('2020-W10-1')) AS w, count(*) AS n", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, '2020-03-02' AS w, count(*) AS n FROM orders GROUP BY 1"),
    "datetime_make": ("MATCH (o:Order) RETURN toString(localdatetime({year: o.orderdate.year, month: 2, day: 3, hour: 4})) AS l, datetime('2020-01-01T10:00:00+02:00').epochSeconds AS e, datetime.fromEpoch(60, 0).minute AS m, datetime.fromEpochMillis(1000).second AS s, count(*) AS n", "SELECT CAST(year(o_orderdate) AS VARCHAR) || '-02-03T04:00' AS l, 1577865600::BIGINT AS e, 1::BIGINT AS m, 1::BIGINT AS s, count(*) AS n FROM orders GROUP BY 1"),
    "time_offset": ("MATCH (p:Part) WITH p, time({hour: p.size % 24, minute: 30, timezone: '+01:00'}) AS t RETURN toString(t) AS t, toString(t + duration('PT1H')) AS u, t.offset AS o, t.offsetSeconds AS s, localtime({hour: p.size % 24}).hour AS h, count(*) AS n", """SELECT lpad(CAST(h AS VARCHAR), 2, '0') || ':30+01:00' AS t, lpad(CAST((h + 1) % 24 AS VARCHAR), 2, '0') || ':30+01:00' AS u, '+01:00' AS o, 3600::BIGINT AS s, h, count(*) AS n FROM (SELECT CAST(p_size % 24 AS BIGINT) AS h FROM part) GROUP BY h"""),
    "duration_parts": ("MATCH (p:Part) WITH DISTINCT duration({days: p.size, hours: 30}) AS d RETURN toString(d) AS t, d.days AS a, d.hours AS b, d.weeks AS c, toString(d * 2) AS e", "SELECT DISTINCT 'P' || CAST(p_size AS VARCHAR) || 'DT30H' AS t, CAST(p_size AS BIGINT) AS a, 30::BIGINT AS b, CAST(p_size // 7 AS BIGINT) AS c, 'P' || CAST(2 * p_size AS VARCHAR) || 'DT60H' AS e FROM part"),
    "duration_between": ("MATCH (o:Order) WITH o.orderdate AS d, localdatetime('2000-01-01T00:00') AS e RETURN duration.inMonths(d, e).months AS m, duration.inSeconds(d, e).seconds AS s, count(*) AS n", "SELECT datesub('month', o_orderdate, TIMESTAMP '2000-01-01') AS m, datesub('second', o_orderdate, TIMESTAMP '2000-01-01') AS s, count(*) AS n FROM orders GROUP BY 1, 2"),
    "clocks": ("MATCH (r:Region) RETURN date.transaction() = date.statement() AS a, datetime.realtime() > datetime('2020-01-01T00:00Z') AS b, localdatetime() > localdatetime('2020-01-01T00:00') AS c, count(*) AS n", "SELECT true AS a, true AS b, true AS c, count(*) AS n FROM region"),
    "time_truncate_units": ("MATCH (o:Order) RETURN toString(date.truncate('week', o.orderdate)) AS w, toString(date.truncate('quarter', o.orderdate)) AS q, toString(date.truncate('decade', o.orderdate)) AS d, count(*) AS n", "SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS w, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q, strftime(date_trunc('decade', o_orderdate), '%Y-%m-%d') AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "time_arith": ("MATCH (o:Order) WHERE o.orderdate + duration({months: 1, days: 2}) < localdatetime('1996-03-01T00:00') RETURN count(*) AS n, max(duration.inDays(o.orderdate, localdatetime('1996-03-01T00:00')).days) AS d", "SELECT count(*) AS n, max(date_diff('day', o_orderdate, TIMESTAMP '1996-03-01')) AS d FROM orders WHERE o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY < TIMESTAMP '1996-03-01'"),
    "geo_distance": ("MATCH (c:Customer) WITH point({longitude: 10.0, latitude: 50.0}) AS a, point({longitude: 11.0, latitude: 51.0}) AS b, c RETURN round(point.distance(a, b) / 1000) AS km, count(*) AS n", "SELECT 132.0::DOUBLE AS km, count(*) AS n FROM customer"),
    "apoc_text": ("MATCH (r:Region) RETURN apoc.text.capitalize(toLower(r.name)) AS a, apoc.text.lpad(r.name, 14, '.') AS b, apoc.text.snakeCase(r.name) AS c, apoc.util.md5([r.name]) AS d, apoc.text.levenshteinDistance(r.name, 'ASIA') AS e", "SELECT upper(left(lower(r_name), 1)) || substr(lower(r_name), 2) AS a, lpad(r_name, 14, '.') AS b, replace(lower(r_name), ' ', '_') AS c, md5(r_name) AS d, levenshtein(r_name, 'ASIA') AS e FROM region"),
    "apoc_coll": ("UNWIND range(1, 5) AS n WITH n, [n, 3, n, 5] AS l RETURN n, size(apoc.coll.toSet(l)) AS s, apoc.coll.max(l) AS m, apoc.coll.indexOf(l, 3) AS i, apoc.coll.occurrences(l, n) AS o, size(apoc.coll.subtract(l, [5])) AS d", "SELECT n, len(list_distinct([n, 3, n, 5])) AS s, greatest(n, 5) AS m, CASE WHEN n = 3 THEN 0 ELSE 1 END::BIGINT AS i, len(list_filter([n, 3, n, 5], lambda x: x = n)) AS o, len(list_distinct(list_filter([n, 3, n, 5], lambda x: x <> 5))) AS d FROM range(1, 6) t(n)"),
    # procedures
    "db_labels": ("CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order', 'User', 'Event', 'Document', 'Page']) AS label"),
    "db_relationship_types": ("CALL db.relationshipTypes()", "SELECT unnest(['IN_REGION', 'IN_NATION', 'PLACED', 'CONTAINS', 'SUPPLIES', 'DID']) AS \"relationshipType\""),
    "meta_schema": ("CALL apoc.meta.schema() YIELD value RETURN size(keys(value)) AS n", "SELECT 16::BIGINT AS n"),
    "cypher_run": ("CALL apoc.cypher.run('MATCH (r:Region) RETURN r.name AS name', {}) YIELD value RETURN value.name AS name", "SELECT r_name AS name FROM region"),
    "cypher_run_rows": ("MATCH (r:Region) CALL apoc.cypher.run('MATCH (n:Nation)-[:IN_REGION]->(x {name: $name}) RETURN count(n) AS k', {name: r.name}) YIELD value RETURN r.name AS name, value.k AS k", "SELECT r_name AS name, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "property_keys": ("CALL db.propertyKeys() YIELD propertyKey WITH propertyKey AS k WHERE k IN ['name', 'totalprice', 'quantity', 'nothing'] RETURN k", "SELECT unnest(['name', 'totalprice', 'quantity']) AS k"),
    "events_by_user": ("MATCH (u:User)-[:DID]->(e:Event) WHERE e.event_type IN ['click', 'purchase'] RETURN u.user_id AS u, e.event_type AS t, count(*) AS n, round(sum(e.value), 3) AS v", "SELECT user_id AS u, event_type AS t, count(*) AS n, round(sum(value), 3) AS v FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2"),
}


def _query(text: str):
    return lambda spark, sf_dir: tables_graph(spark, sf_dir).cypher(text)


def _small_graph(spark, sf_dir: str):
    """Regions and nations alone: the write queries need no other tables."""
    g = tables_graph(spark, sf_dir)
    g.nodes = [t for t in g.nodes if t.labels[0] in ("Region", "Nation")]
    g.rels = [t for t in g.rels if t.type == "IN_REGION"]
    return g


def _write_cycle(spark, sf_dir: str):
    """Writes on a copy of the graph: create, merge, set, remove, delete; then what is left."""
    g = tables_graph(spark, sf_dir)
    g.cypher("MATCH (r:Region) CREATE (r)<-[:SERVES {since: 2020}]-(:Depot {code: toLower(left(r.name, 2)), size: size(r.name)})")
    g.cypher("MATCH (r:Region) MERGE (d:Depot {code: toLower(left(r.name, 2))}) ON MATCH SET d.seen = 1 ON CREATE SET d.seen = 0")
    g.cypher("MATCH (d:Depot) WHERE d.size > 6 SET d:Large, d.size = d.size * 10")
    g.cypher("MATCH (d:Depot {code: 'mi'}) DETACH DELETE d")
    return g.cypher("MATCH (d:Depot) OPTIONAL MATCH (d)-[s:SERVES]->(r) RETURN d.code AS code, d.size AS size, d.seen AS seen, size(labels(d)) AS labels, r.name AS region, s.since AS since")


_WRITE_SQL = """SELECT lower(left(r_name, 2)) AS code, CASE WHEN length(r_name) > 6 THEN length(r_name) * 10 ELSE length(r_name) END AS size, 1::BIGINT AS seen,
    CASE WHEN length(r_name) > 6 THEN 2 ELSE 1 END::BIGINT AS labels, r_name AS region, 2020::BIGINT AS since FROM region WHERE r_name <> 'MIDDLE EAST'"""



def _merge_and_foreach(spark, sf_dir: str):
    """MERGE of relationships, FOREACH and REMOVE on a copy of the graph."""
    g = _small_graph(spark, sf_dir)
    g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r) MERGE (r)-[h:HAS]->(n) ON CREATE SET h.made = 1")
    g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r {name: 'ASIA'}) MERGE (r)-[h:HAS]->(n) ON MATCH SET h.made = h.made + 1")
    g.cypher("MATCH (r:Region) FOREACH (x IN [1, 2, 3] | SET r.score = x)")
    g.cypher("MATCH (r:Region {name: 'EUROPE'}) SET r:Old REMOVE r.score")
    g.cypher("MATCH (r:Old) REMOVE r:Old")
    return g.cypher("MATCH (r:Region)-[h:HAS]->(n) RETURN r.name AS r, r.score AS score, size(labels(r)) AS l, sum(h.made) AS made")


def _batches(spark, sf_dir: str):
    """CALL in transactions and periodic iteration."""
    g = _small_graph(spark, sf_dir)
    g.cypher("MATCH (n:Nation) CALL { WITH n CREATE (:Copy {name: n.name, k: size(n.name)}) } IN TRANSACTIONS OF 10 ROWS")
    done = g.cypher("CALL apoc.periodic.iterate('MATCH (c:Copy) RETURN c', 'SET c.k = c.k * 2', {batchSize: 10}) YIELD batches, total, operations RETURN batches, total, operations.committed AS done").first()
    return g.cypher("MATCH (c:Copy) RETURN c.name AS name, c.k AS k, $b AS batches, $t AS total, $d AS done", b=done.batches, t=done.total, d=done.done)


def _elements_made(spark, sf_dir: str):
    """Procedures that create and change nodes and relationships."""
    g = _small_graph(spark, sf_dir)
    g.cypher("MATCH (r:Region) CALL apoc.create.node(['Tag', 'New'], {of: r.name}) YIELD node AS t CALL apoc.create.relationship(r, 'TAGGED', {w: 1}, t) YIELD rel RETURN count(*) AS n").collect()
    g.cypher("MATCH (t:Tag {of: 'ASIA'}) CALL apoc.create.addLabels(t, ['Far']) YIELD node RETURN node").collect()
    g.cypher("MATCH (t:Tag {of: 'EUROPE'}) CALL apoc.create.removeLabels(t, ['New']) YIELD node RETURN node").collect()
    g.cypher("MATCH (t:Tag {of: 'AFRICA'}) CALL apoc.create.setLabels(t, ['Tag']) YIELD node RETURN node").collect()
    g.cypher("MATCH (t:Tag) CALL apoc.create.setProperty(t, 'n', size(t.of)) YIELD node RETURN node").collect()
    g.cypher("MATCH (:Region {name: 'AMERICA'})-[x:TAGGED]->() CALL apoc.refactor.setType(x, 'MARKED') YIELD rel RETURN rel").collect()
    return g.cypher("MATCH (r:Region)-[x]->(t:Tag) RETURN r.name AS r, type(x) AS x, x.w AS w, apoc.text.join(apoc.coll.sort(labels(t)), ',') AS l, t.n AS n")


def _schema_objects(spark, sf_dir: str):
    """Indexes and constraints: created, shown and dropped; a violation is refused."""
    from arbora.operators.schema import ConstraintViolation

    g = tables_graph(spark, sf_dir)
    for text in ("CREATE INDEX FOR (n:Nation) ON (n.name)", "CREATE INDEX FOR ()-[r:CONTAINS]-() ON (r.quantity)", "CREATE POINT INDEX FOR (n:Nation) ON (n.at)", "CREATE CONSTRAINT one FOR (r:Region) REQUIRE r.name IS UNIQUE",
                 "CREATE CONSTRAINT two FOR (r:Region) REQUIRE r.name IS NOT NULL", "CREATE CONSTRAINT three FOR (o:Order) REQUIRE o.totalprice IS :: FLOAT", "DROP CONSTRAINT two", "DROP INDEX FOR (n:Nation) ON (n.name)"):
        g.cypher(text)
    refused = 0
    for text in ("CREATE (:Region {name: 'ASIA'})", "CREATE CONSTRAINT FOR (o:Order) REQUIRE o.status IS UNIQUE", "CREATE CONSTRAINT FOR (o:Order) REQUIRE o.status IS :: DATE"):
        try:
            g.cypher(text)
        except ConstraintViolation:
            refused += 1
    shown = g.cypher("SHOW CONSTRAINTS").selectExpr("name", "type")
    shown = shown.union(g.cypher("SHOW INDEXES").selectExpr("label as name", "type")).union(g.cypher("SHOW POINT INDEXES").selectExpr("label as name", "type"))
    listed = g.cypher("CALL db.constraints() YIELD name RETURN count(name) AS c").first().c
    return shown.selectExpr("name", "type", f"{refused}L as refused", f"{listed}L as constraints", f"{g.cypher('MATCH (r:Region) RETURN count(*) AS n').first().n}L as regions")


def _trigger_rows_of(spark, sf_dir: str):
    """Triggers that log what each commit created and deleted."""
    g = _small_graph(spark, sf_dir)
    g.cypher("CALL apoc.trigger.install('made', 'UNWIND $createdNodes AS n WITH n WHERE n:Copy CREATE (:Log {what: \\'made\\', name: n.name})', {phase: 'before'})")
    g.cypher("CALL apoc.trigger.install('gone', 'UNWIND $deletedNodes AS n CREATE (:Log {what: \\'gone\\', name: n.name})', {phase: 'after'})")
    g.cypher("MATCH (r:Region) CREATE (:Copy {name: r.name, n: 1})")
    g.cypher("MATCH (c:Copy {name: 'EUROPE'}) DETACH DELETE c")
    return g.cypher("MATCH (l:Log) RETURN l.what AS what, l.name AS name")


def _transactions(spark, sf_dir: str):
    """One transaction is undone, one stays."""
    from arbora.sources.transactions import rollback, transaction

    g = _small_graph(spark, sf_dir)
    for name, keep in (("undone", False), ("kept", True)):
        with transaction(g) as t:
            t.cypher("MATCH (r:Region) CREATE (:Mark {of: r.name, by: $by})", by=name)
            t.cypher("CALL apoc.trigger.install($n, 'RETURN 1', {phase: 'after'})", n=name)
            if not keep:
                rollback(t)
    return g.cypher("MATCH (m:Mark) CALL apoc.trigger.list() YIELD name RETURN m.of AS of, m.by AS by, name AS trigger")


def _files(spark, sf_dir: str):
    """Exports, read again by LOAD CSV, apoc.load.csv and apoc.load.json."""
    from arbora.operators.staging import folder

    g = tables_graph(spark, sf_dir)
    g.import_root = folder(spark, "files")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey").coalesce(1).write.option("header", True).csv(f"{g.import_root}/nations")
    spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("to_json(collect_list(struct(r_name, r_regionkey))) as value").write.text(f"{g.import_root}/regions")
    out = g.cypher("CALL apoc.export.json.query('MATCH (n:Nation)-[i:IN_REGION]->(r) RETURN n, i, r', 'graph') YIELD rows RETURN rows").first().rows
    return g.cypher("""LOAD CSV WITH HEADERS FROM 'nations' AS l CALL apoc.load.json('regions') YIELD value WITH l, value WHERE toInteger(l.n_regionkey) = value.r_regionkey
        RETURN value.r_name AS r, count(*) AS n, min(l.n_name) AS first, $rows AS exported""", rows=out)


def _explained(spark, sf_dir: str):
    """EXPLAIN gives a plan and runs nothing; PROFILE counts the rows."""
    g = tables_graph(spark, sf_dir)
    plan = g.cypher("EXPLAIN MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.name AS n, count(*) AS k").first().plan
    return g.cypher("PROFILE MATCH (n:Nation) RETURN n.name AS n").selectExpr("rows", f"{str('customer' in plan and 'Exchange' in plan).lower()} as planned")


WRITES = {
    "write_cycle": (_write_cycle, _WRITE_SQL),
    "write_merge_foreach": (_merge_and_foreach, """SELECT r_name AS r, CASE WHEN r_name <> 'EUROPE' THEN 3::BIGINT END AS score, 1::BIGINT AS l, CAST(sum(CASE WHEN r_name = 'ASIA' THEN 2 ELSE 1 END) AS BIGINT) AS made FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"""),
    "write_batches": (_batches, "SELECT n_name AS name, 2 * length(n_name) AS k, (SELECT CAST(ceil(count(*) / 10) AS BIGINT) FROM nation) AS batches, (SELECT count(*) FROM nation) AS total, (SELECT count(*) FROM nation) AS done FROM nation"),
    "write_elements": (_elements_made, """SELECT r_name AS r, CASE WHEN r_name = 'AMERICA' THEN 'MARKED' ELSE 'TAGGED' END AS x, 1::BIGINT AS w, CASE r_name WHEN 'ASIA' THEN 'Far,New,Tag' WHEN 'EUROPE' THEN 'Tag' WHEN 'AFRICA' THEN 'Tag' ELSE 'New,Tag' END AS l, length(r_name) AS n FROM region"""),
    "schema_objects": (_schema_objects, """SELECT name, type, 3::BIGINT AS refused, 2::BIGINT AS constraints, (SELECT count(*) FROM region) AS regions FROM (VALUES ('one', 'UNIQUE'), ('three', 'IS :: FLOAT'), ('CONTAINS', 'RANGE'), ('Nation', 'POINT')) t(name, type)"""),
    "triggers": (_trigger_rows_of, "SELECT 'made' AS what, r_name AS name FROM region UNION ALL SELECT 'gone', 'EUROPE'"),
    "transactions": (_transactions, "SELECT r_name AS of, 'kept' AS by, 'kept' AS trigger FROM region"),
    "files": (_files, "SELECT r_name AS r, count(*) AS n, min(n_name) AS first, (SELECT count(*) FROM nation) AS exported FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "explain_profile": (_explained, "SELECT count(*) AS rows, true AS planned FROM nation"),
}
QUERIES = {name: _query(text) for name, (text, _) in CATALOG.items()} | {name: run for name, (run, _) in WRITES.items()}
ORACLES = {name: sql for name, (_, sql) in CATALOG.items() if sql} | {name: sql for name, (_, sql) in WRITES.items()}
