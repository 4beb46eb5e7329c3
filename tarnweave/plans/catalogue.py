"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import media, text
from tarnweave.operators import history
from tarnweave.operators.match import Match, degrees, has_labels, low_confidence, matches, name_like
from tarnweave.sources.graph import NODE_OWN, PROVENANCE, REL_OWN, Graph, all_properties, from_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The graph of the order tables in DuckDB.
GRAPH_SQL = """
WITH RECURSIVE nodes AS (
  SELECT 'r:' || r_regionkey AS id, ['Region'] AS labels, r_name AS name, NULL::BIGINT AS community FROM region
  UNION ALL SELECT 'n:' || n_nationkey, ['Nation'], n_name, n_regionkey FROM nation
  UNION ALL SELECT 'c:' || c_custkey, ['Customer', 'Party'], c_name, c_nationkey % 5 FROM customer
  UNION ALL SELECT 's:' || s_suppkey, ['Supplier', 'Party'], s_name, s_nationkey % 5 FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, ['Part'], p_name, p_size % 5 FROM part
  UNION ALL SELECT 'o:' || o_orderkey, ['Order'], NULL, NULL FROM orders),
rels AS (
  SELECT 'nr:' || n_nationkey AS id, 'IN_REGION' AS type, 'n:' || n_nationkey AS s, 'r:' || n_regionkey AS e, NULL AS evidence,
         'nation.parquet' AS source_file, NULL AS chunk_id, 1.0::DOUBLE AS confidence, 'fk' AS run_id FROM nation
  UNION ALL SELECT 'cn:' || c_custkey, 'IN_NATION', 'c:' || c_custkey, 'n:' || c_nationkey, NULL, 'customer.parquet', NULL, 1.0, 'fk' FROM customer
  UNION ALL SELECT 'sn:' || s_suppkey, 'IN_NATION', 's:' || s_suppkey, 'n:' || s_nationkey, NULL, 'supplier.parquet', NULL, 1.0, 'fk' FROM supplier
  UNION ALL SELECT 'co:' || o_orderkey, 'PLACED', 'c:' || o_custkey, 'o:' || o_orderkey, NULL, 'orders.parquet', NULL, 1.0, 'fk' FROM orders
  UNION ALL SELECT 'op:' || concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT,
                   round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, strftime(l_shipdate, '%Y%m%d')),
         'CONTAINS', 'o:' || l_orderkey, 'p:' || l_partkey, l_returnflag || l_linestatus, 'lineitem.parquet', l_suppkey::VARCHAR,
         round(1.0 - l_discount, 2), year(l_shipdate)::VARCHAR FROM lineitem
  UNION ALL SELECT DISTINCT 'ps:' || l_partkey || '-' || l_suppkey, 'SUPPLIED_BY', 'p:' || l_partkey, 's:' || l_suppkey, NULL, 'lineitem.parquet', NULL, NULL, NULL FROM lineitem),
und AS (
  SELECT * FROM rels UNION ALL SELECT id, type, e, s, evidence, source_file, chunk_id, confidence, run_id FROM rels WHERE s <> e)
"""
_P = "r.evidence, r.source_file, r.chunk_id, r.confidence"
_PAIRS = """
WITH spoken AS (
  SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
  SELECT conv_id, turn, text AS user, t2 AS assistant FROM spoken WHERE role = 'user' AND r2 = 'assistant')
"""
#: Short relationships between places and parties, for trails.
STRUCTURE = ("IN_REGION", "IN_NATION")


def query(sql: str | None = None, graph: bool = True, over_graph: bool | None = None) -> Callable:
    """Registers a query, of the graph or of the tables; `sql` follows the graph's definition if it is over the graph."""
    prefix = GRAPH_SQL if (graph if over_graph is None else over_graph) else ""

    def add(f: Callable) -> Callable:
        if graph:
            QUERIES[f.__name__] = lambda spark, sf_dir: f(from_tables(spark, sf_dir))
        else:
            QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLE_SQL[f.__name__] = prefix + sql
        return f

    return add


def c(name: str, alias: str) -> F.Column:
    return F.col(name).alias(alias)


@query(f"SELECT a.name AS condition, r.type AS relation, b.name AS metabolite, b.id AS target_id, r.evidence, r.source_file, r.chunk_id FROM nodes a JOIN und r ON r.s = a.id JOIN nodes b ON r.e = b.id WHERE list_contains(a.labels, 'Customer') AND list_contains(b.labels, 'Order') AND regexp_full_match(a.name, '(?i).*customer#00000001.*')")
def e1_label_regex(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a", "Customer", where=name_like("a", "(?i).*customer#00000001.*")).both("r", "b", "Order")
    return m.returns(c("a_name", "condition"), c("r_type", "relation"), c("b_name", "metabolite"), c("b_id", "target_id"), c("r_evidence", "evidence"), c("r_source_file", "source_file"), c("r_chunk_id", "chunk_id"))


_TRAILS = """, steps AS (SELECT * FROM und WHERE type IN ('IN_REGION', 'IN_NATION')),
trail AS (
  SELECT a.id AS first, a.id AS last, [a.name] AS names, []::VARCHAR[] AS ids, []::VARCHAR[] AS types, 0 AS length FROM nodes a WHERE list_contains(a.labels, 'Supplier') AND {start}
  UNION ALL SELECT first, r.e, list_append(names, n.name), list_append(ids, r.id), list_append(types, r.type), length + 1
  FROM trail t JOIN steps r ON r.s = t.last JOIN nodes n ON n.id = r.e WHERE length < 3 AND NOT list_contains(ids, r.id))
"""


@query(_TRAILS.format(start="true") + "SELECT first AS source_id, array_to_string(names, '>') AS path_nodes, array_to_string(types, '>') AS path_rels, length::INT AS length FROM trail JOIN nodes z ON z.id = last WHERE length >= 1 AND list_contains(z.labels, 'Region')")
def e2_paths_1_3(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a", "Supplier").trails("z", "Region", least=1, most=3, types=STRUCTURE)
    return m.returns(c("a_id", "source_id"), F.array_join("path_nodes", ">").alias("path_nodes"), F.array_join(F.transform("path_rels", lambda r: r["type"]), ">").alias("path_rels"), "length")


@query(f"SELECT a.name AS source, r.type AS relation, b.name AS target, b.id AS target_id, {_P} FROM nodes a JOIN und r ON r.s = a.id JOIN nodes b ON r.e = b.id WHERE regexp_full_match(a.name, '(?i).*nation_7.*')")
def e3_undirected_name(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a", where=name_like("a", "(?i).*nation_7.*")).both("r", "b")
    return m.returns(c("a_name", "source"), c("r_type", "relation"), c("b_name", "target"), c("b_id", "target_id"), rel="r")


@query(f"SELECT a.name AS source, b.name AS target, r.type AS relation, {_P} FROM nodes a JOIN und r ON r.s = a.id JOIN nodes b ON r.e = b.id WHERE r.confidence > 0.95 AND r.type = 'CONTAINS'")
def e4_confidence(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a").both("r", "b", types=["CONTAINS"], where=F.col("r_confidence") > 0.95)
    return m.returns(c("a_name", "source"), c("b_name", "target"), c("r_type", "relation"), rel="r")


@query("SELECT a.name AS source, r.type AS relation, b.name AS target, r.evidence, r.source_file, r.chunk_id, r.run_id FROM nodes a JOIN rels r ON r.s = a.id JOIN nodes b ON r.e = b.id WHERE r.run_id = 'fk' AND a.community = 4 AND b.community = 4")
def e5_run_community(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a", where=F.col("a_leiden_community") == 4).out("r", "b", where=(F.col("r_run_id") == "fk") & (F.col("b_leiden_community") == 4))
    return m.returns(c("a_name", "source"), c("r_type", "relation"), c("b_name", "target"), c("r_evidence", "evidence"), c("r_source_file", "source_file"), c("r_chunk_id", "chunk_id"), c("r_run_id", "run_id"))


@query("SELECT a.id AS node_id, a.name AS node, x.type AS relation, x.name AS connected, x.evidence, x.source_file, x.chunk_id FROM nodes a LEFT JOIN (SELECT r.*, b.name FROM rels r JOIN nodes b ON r.e = b.id) x ON x.s = a.id")
def e6_optional_overview(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a").optional_out("r", "b")
    return m.returns(c("a_id", "node_id"), c("a_name", "node"), c("r_type", "relation"), c("b_name", "connected"), c("r_evidence", "evidence"), c("r_source_file", "source_file"), c("r_chunk_id", "chunk_id"))


def _json(**values: str) -> str:
    """SQL for the object that an export has: names in their order, without nulls. A value in {} is text."""
    parts = ["'\"" + k + "\":" + ("\"' || " + v[1:-1] + " || '\"'" if v[0] == "{" else "' || (" + v + ")::VARCHAR") for k, v in sorted(values.items())]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_NODES = {
    "region": ("r:", "r_regionkey", "Region", "r_name", "NULL::BIGINT", _json(name="{r_name}")),
    "nation": ("n:", "n_nationkey", "Nation", "n_name", "n_regionkey", _json(name="{n_name}", leiden_community="n_regionkey")),
    "customer": ("c:", "c_custkey", "Customer,Party", "c_name", "c_nationkey % 5", _json(name="{c_name}", leiden_community="c_nationkey % 5", segment="{c_mktsegment}", balance="c_acctbal")),
    "supplier": ("s:", "s_suppkey", "Supplier,Party", "s_name", "s_nationkey % 5", _json(name="{s_name}", leiden_community="s_nationkey % 5", balance="s_acctbal")),
    "part": ("p:", "p_partkey", "Part", "p_name", "p_size % 5", _json(name="{p_name}", leiden_community="p_size % 5", brand="{p_brand}", size="p_size")),
    "orders": ("o:", "o_orderkey", "Order", "NULL", "NULL", _json(status="{o_orderstatus}", priority="{o_orderpriority}")),
}


@query(" UNION ALL ".join(f"SELECT '{p}' || {k} AS id, '{labels}' AS labels, {name} AS name, ({community})::BIGINT AS community, {json} AS properties FROM {t}" for t, (p, k, labels, name, community, json) in _NODES.items()), over_graph=False)
def dump_nodes(g: Graph) -> DataFrame:
    """With all properties, those that have columns too, as JSON."""
    return g.nodes.select("id", F.array_join("labels", ",").alias("labels"), "name", c("leiden_community", "community"), F.to_json(all_properties(NODE_OWN)).alias("properties"))


_REL_JSON = _json(evidence="{evidence}", source_file="{source_file}", chunk_id="{chunk_id}", confidence="confidence", run_id="{run_id}", quantity="l_quantity", line="l_linenumber", returned="CASE WHEN type = 'CONTAINS' THEN evidence LIKE 'R%' END")
_LINE_ID = """'op:' || concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, strftime(l_shipdate, '%Y%m%d'))"""


@query(f", opened AS (SELECT {_LINE_ID} AS id, l_quantity, l_linenumber FROM lineitem) SELECT id, type, s AS start_id, e AS end_id, evidence, source_file, chunk_id, confidence, run_id, {_REL_JSON} AS properties FROM rels LEFT JOIN opened USING (id)")
def dump_rels(g: Graph) -> DataFrame:
    own = F.to_json(all_properties(REL_OWN)).alias("properties")
    return g.rels.select("id", "type", c("start", "start_id"), c("end", "end_id"), "evidence", "source_file", "chunk_id", "confidence", "run_id", own)


@query("SELECT label, count(*)::BIGINT AS n FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY label")
def catalog_labels(g: Graph) -> DataFrame:
    return g.labels()


@query("SELECT type, count(*)::BIGINT AS n, count(evidence)::BIGINT AS n_evidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM rels GROUP BY type")
def catalog_rel_types(g: Graph) -> DataFrame:
    return g.rel_types()


@query("""SELECT kind, key, count(*)::BIGINT AS n FROM (
  SELECT 'Customer' AS kind, unnest(['segment', 'balance']) AS key FROM customer UNION ALL SELECT 'Party', unnest(['segment', 'balance']) FROM customer
  UNION ALL SELECT 'Supplier', 'balance' FROM supplier UNION ALL SELECT 'Party', 'balance' FROM supplier
  UNION ALL SELECT 'Part', unnest(['brand', 'size']) FROM part UNION ALL SELECT 'Order', unnest(['status', 'priority']) FROM orders
  UNION ALL SELECT 'CONTAINS', unnest(['quantity', 'line', 'returned']) FROM lineitem) GROUP BY ALL""")
def catalog_property_keys(g: Graph) -> DataFrame:
    return g.property_keys()


_TYPED = {
    "Region": "name:STRING", "Nation": "name:STRING leiden_community:INTEGER", "Customer": "name:STRING leiden_community:INTEGER segment:STRING balance:FLOAT", "Supplier": "name:STRING leiden_community:INTEGER balance:FLOAT",
    "Part": "name:STRING leiden_community:INTEGER brand:STRING size:INTEGER", "Order": "status:STRING priority:STRING", "CONTAINS": "quantity:FLOAT line:INTEGER returned:BOOLEAN",
}
_TYPED_ROWS = ", ".join(f"('{kind}', '{x.split(':')[0]}', '{x.split(':')[1]}')" for kind, all_of in _TYPED.items() for x in all_of.split())
_COLUMNS = {"evidence": "STRING", "source_file": "STRING", "chunk_id": "STRING", "confidence": "FLOAT", "run_id": "STRING"}


@query(f""", kinds AS (SELECT unnest(labels) AS kind, name, community FROM nodes),
named AS (SELECT * FROM (VALUES {_TYPED_ROWS}) v(kind, key, type) UNION ALL SELECT 'Party', key, type FROM (VALUES {_TYPED_ROWS}) v(kind, key, type) WHERE kind = 'Supplier')
SELECT kind, key, type, count(*)::BIGINT AS n FROM kinds JOIN named USING (kind) GROUP BY ALL
UNION ALL SELECT 'Party', 'segment', 'STRING', count(*)::BIGINT FROM customer
UNION ALL SELECT n.kind, n.key, n.type, count(*)::BIGINT FROM rels r JOIN named n ON n.kind = r.type GROUP BY ALL
{" ".join(f"UNION ALL SELECT type, '{k}', '{t}', count({k})::BIGINT FROM rels GROUP BY type HAVING count({k}) > 0" for k, t in _COLUMNS.items())}""")
def catalog_property_types(g: Graph) -> DataFrame:
    """All properties of each label and relationship type, with the types of their values."""
    return g.property_types()


@query("SELECT b.labels[1] AS label, r.type AS relation, count(*)::BIGINT AS n FROM nodes a JOIN rels r ON r.s = a.id JOIN nodes b ON r.e = b.id GROUP BY ALL")
def directed_expand(g: Graph) -> DataFrame:
    return Match.nodes(g, "a").out("r", "b").frame.groupBy(F.col("b_labels")[0].alias("label"), c("r_type", "relation")).agg(F.count("*").alias("n"))


@query("SELECT a.id AS customer_id, b.id AS order_id FROM nodes a JOIN rels r ON r.s = a.id AND r.type = 'PLACED' JOIN nodes b ON r.e = b.id WHERE list_contains(a.labels, 'Customer')")
def typed_expand(g: Graph) -> DataFrame:
    return Match.nodes(g, "a", "Customer").out("r", "b", types=["PLACED"]).returns(c("a_id", "customer_id"), c("b_id", "order_id"))


@query("SELECT a.name AS nation, b.id AS party_id FROM nodes a JOIN rels r ON r.e = a.id JOIN nodes b ON r.s = b.id WHERE list_contains(a.labels, 'Nation') AND list_contains(b.labels, 'Party')")
def reverse_expand(g: Graph) -> DataFrame:
    return Match.nodes(g, "a", "Nation").into("r", "b", "Party").returns(c("a_name", "nation"), c("b_id", "party_id"))


@query("SELECT id, name FROM nodes WHERE list_contains(labels, 'Party')")
def multi_label_scan(g: Graph) -> DataFrame:
    return g.nodes.filter(has_labels(F.col("labels"), ["Party"])).select("id", "name")


@query("SELECT id, name FROM nodes WHERE list_contains(labels, 'Party') AND list_contains(labels, 'Supplier')")
def label_intersection(g: Graph) -> DataFrame:
    return Match.nodes(g, "a", "Party", "Supplier").returns(c("a_id", "id"), c("a_name", "name"))


@query("SELECT type, count(*)::BIGINT AS n, count(*) FILTER (confidence > 0.9)::BIGINT AS above, count(*) FILTER (NOT (confidence > 0.9))::BIGINT AS not_above, count(*) FILTER ((confidence > 0.9) IS NULL)::BIGINT AS unknown FROM rels GROUP BY type")
def null_property_3vl(g: Graph) -> DataFrame:
    above = F.col("confidence") > 0.9
    return g.rels.groupBy("type").agg(F.count("*").alias("n"), F.count_if(above).alias("above"), F.count_if(~above).alias("not_above"), F.count_if(above.isNull()).alias("unknown"))


@query("SELECT id, type FROM rels WHERE run_id = '1995' AND evidence = 'RF'")
def equality_filter(g: Graph) -> DataFrame:
    return g.rels.filter((F.col("run_id") == "1995") & (F.col("evidence") == "RF")).select("id", "type")


@query(_TRAILS.format(start="true") + "SELECT first AS source_id, array_to_string(ids, ',') AS path_ids, array_to_string(list_transform(names, lambda x: upper(x)), ',') AS upper_names FROM trail WHERE length BETWEEN 1 AND 2")
def list_comprehension(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a", "Supplier").trails("z", least=1, most=2, types=STRUCTURE, names=F.upper)
    return m.returns(c("a_id", "source_id"), F.array_join("path_ids", ",").alias("path_ids"), F.array_join("path_nodes", ",").alias("upper_names"))


@query("SELECT id, type || ' ' || coalesce(evidence, '') || ' ' || source_file || ' ' || coalesce(chunk_id, '') AS projected FROM rels WHERE type IN ('CONTAINS', 'IN_REGION')")
def map_projection(g: Graph) -> DataFrame:
    m = F.struct("type", "evidence", "source_file", "chunk_id")
    rows = g.rels.filter(F.col("type").isin("CONTAINS", "IN_REGION")).select("id", m.alias("m"))
    parts = [F.coalesce(F.col("m")[k], F.lit("")) for k in ("type", "evidence", "source_file", "chunk_id")]
    return rows.select("id", F.concat_ws(" ", *parts).alias("projected"))


@query(_TRAILS.format(start="true") + "SELECT length::INT AS length, count(*)::BIGINT AS n FROM trail JOIN nodes z ON z.id = last WHERE length >= 1 AND (list_contains(z.labels, 'Region') OR list_contains(z.labels, 'Nation')) GROUP BY length")
def path_length_hist(g: Graph) -> DataFrame:
    ends = has_labels(F.col("z_labels"), ["Region"]) | has_labels(F.col("z_labels"), ["Nation"])
    m = Match.nodes(g, "a", "Supplier").trails("z", least=1, most=3, types=STRUCTURE, names=False, where=ends)
    return m.frame.groupBy("length").agg(F.count("*").alias("n"))


@query("SELECT a.s AS order_id, a.e AS part_id, count(*)::BIGINT AS n FROM rels a JOIN rels b ON a.e = b.e AND a.s = b.s AND a.id <> b.id WHERE a.type = 'CONTAINS' AND b.type = 'CONTAINS' GROUP BY ALL")
def trail_vs_parallel_edges(g: Graph) -> DataFrame:
    """Trails of two steps from an order back to it: their relationships are different, so they are parallel ones. n
    parallel relationships make n * (n - 1) such trails, which takes no join."""
    parallel = g.rels.filter("type = 'CONTAINS'").groupBy(c("start", "order_id"), c("end", "part_id")).agg(F.count("*").alias("_n")).filter("_n > 1")
    return parallel.select("order_id", "part_id", (F.col("_n") * (F.col("_n") - 1)).alias("n"))


@query(f"SELECT a.id AS order_id, b.id AS part_id, {_P} FROM nodes a JOIN rels r ON r.s = a.id AND r.type = 'CONTAINS' JOIN nodes b ON r.e = b.id WHERE r.run_id = '1996'")
def provenance_projection(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a").out("r", "b", types=["CONTAINS"], where=F.col("r_run_id") == "1996")
    return m.returns(c("a_id", "order_id"), c("b_id", "part_id"), rel="r")


@query("SELECT type, coalesce(confidence < 0.93, false) AS low, count(*)::BIGINT AS n FROM rels GROUP BY ALL")
def low_confidence_flag(g: Graph) -> DataFrame:
    return g.rels.groupBy("type", low_confidence(F.col("confidence"), 0.93).alias("low")).agg(F.count("*").alias("n"))


@query("SELECT type, CASE WHEN trim(coalesce(evidence, '')) = '' THEN source_file ELSE '\"' || trim(evidence) || '\" (' || source_file || ')' END AS cited, count(*)::BIGINT AS n FROM rels GROUP BY ALL")
def empty_evidence_fallback(g: Graph) -> DataFrame:
    return g.rels.groupBy("type", text.cited(F.col("evidence"), F.col("source_file")).alias("cited")).agg(F.count("*").alias("n"))


@query("SELECT id, confidence FROM rels WHERE type = 'CONTAINS' ORDER BY confidence DESC, id LIMIT 20")
def limit_topk_ordered(g: Graph) -> DataFrame:
    return g.rels.filter("type = 'CONTAINS'").select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(20)


@query("SELECT id, name FROM nodes a WHERE list_contains(labels, 'Customer') AND EXISTS (SELECT 1 FROM rels r WHERE r.s = a.id AND r.type = 'PLACED')")
def semi_exists(g: Graph) -> DataFrame:
    return Match.nodes(g, "a", "Customer").exists(["PLACED"], undirected=False).returns(c("a_id", "id"), c("a_name", "name"))


@query("SELECT id FROM nodes a WHERE list_contains(labels, 'Order') AND NOT EXISTS (SELECT 1 FROM rels r WHERE r.s = a.id)")
def anti_no_rel(g: Graph) -> DataFrame:
    return Match.nodes(g, "a", "Order").missing(undirected=False).returns(c("a_id", "id"))


@query("SELECT n.id, (SELECT 0) + coalesce(o.k, 0)::BIGINT AS n_out, coalesce(i.k, 0)::BIGINT AS n_in, coalesce(b.k, 0)::BIGINT AS n_neighbors FROM nodes n LEFT JOIN (SELECT s, count(*) AS k FROM rels GROUP BY s) o ON o.s = n.id LEFT JOIN (SELECT e, count(*) AS k FROM rels GROUP BY e) i ON i.e = n.id LEFT JOIN (SELECT s, count(DISTINCT e) AS k FROM (SELECT s, e FROM rels UNION ALL SELECT e, s FROM rels) GROUP BY s) b ON b.s = n.id")
def degree_aggregate(g: Graph) -> DataFrame:
    return degrees(g)


@query("SELECT DISTINCT a.id AS customer_id, b.e AS part_id FROM nodes a JOIN rels r ON r.s = a.id AND r.type = 'PLACED' JOIN rels b ON b.s = r.e AND b.type = 'CONTAINS'")
def distinct_neighbors(g: Graph) -> DataFrame:
    m = Match.nodes(g, "a", "Customer").out("r", "o", types=["PLACED"]).out("q", "p", types=["CONTAINS"])
    return m.returns(c("a_id", "customer_id"), c("p_id", "part_id")).distinct()


@query("SELECT a.id AS id, 'nation' AS how FROM nodes a JOIN rels r ON r.s = a.id AND r.e = 'n:3' UNION SELECT a.id, 'supplies' FROM nodes a JOIN rels r ON r.e = a.id AND r.type = 'SUPPLIED_BY'")
def union_of_patterns(g: Graph) -> DataFrame:
    one = Match.nodes(g, "a").out("r", "b", where=F.col("b_id") == "n:3").returns(c("a_id", "id"), F.lit("nation").alias("how"))
    two = Match.nodes(g, "a").into("r", "b", types=["SUPPLIED_BY"]).returns(c("a_id", "id"), F.lit("supplies").alias("how"))
    return one.union(two).distinct()


@query("SELECT id, unnest(labels) AS label FROM nodes")
def unwind_labels(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.explode("labels").alias("label"))


@query("SELECT n.name AS nation, count(*)::BIGINT AS n, count(DISTINCT p.community)::BIGINT AS n_communities, min(p.name) AS first, max(p.name) AS last FROM nodes n JOIN rels r ON r.e = n.id JOIN nodes p ON p.id = r.s WHERE list_contains(n.labels, 'Nation') GROUP BY n.name HAVING count(*) > 5 ORDER BY n DESC, nation OFFSET 2 LIMIT 15")
def aggregate_having_page(g: Graph) -> DataFrame:
    m = Match.nodes(g, "n", "Nation").into("r", "p")
    table = m.frame.groupBy(c("n_name", "nation")).agg(F.count("*").alias("n"), F.countDistinct("p_leiden_community").alias("n_communities"), F.min("p_name").alias("first"), F.max("p_name").alias("last"))
    return table.filter("n > 5").orderBy(F.desc("n"), "nation").offset(2).limit(15)


@query("SELECT s.name AS supplier, len(list(DISTINCT r.s))::INT AS n_parts FROM nodes s JOIN rels r ON r.e = s.id AND r.type = 'SUPPLIED_BY' GROUP BY s.name")
def collect_parts(g: Graph) -> DataFrame:
    return Match.nodes(g, "s", "Supplier").into("r", "p", types=["SUPPLIED_BY"]).frame.groupBy(c("s_name", "supplier")).agg(F.size(F.collect_set("p_id")).alias("n_parts"))


@query("SELECT id, concat('{\"id\":\"', id, '\",\"name\":', CASE WHEN name IS NULL THEN 'null' ELSE '\"' || name || '\"' END, ',\"leiden_community\":', coalesce(community::VARCHAR, 'null'), '}') AS row FROM nodes")
def json_rows(g: Graph) -> DataFrame:
    return g.nodes.select("id", text.json_row("id", "name", "leiden_community").alias("row"))


@query("SELECT id, name FROM nodes WHERE regexp_full_match(name, '(?i).*supplier#00000001.*')")
def retry_regex_fallback(g: Graph) -> DataFrame:
    """What the second attempt looks for after a name that no node has."""
    exact = g.nodes.filter(F.col("name") == "supplier#00000001").select("id", "name")
    loose = g.nodes.filter(matches(F.col("name"), "(?i).*supplier#00000001.*")).select("id", "name")
    return exact.union(loose.filter(~exact.exists()))


@query(_PAIRS + "SELECT conv_id, turn, user, assistant, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS seq FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2)", graph=False)
def history_last_n(table: Callable) -> DataFrame:
    return history.last(history.pairs(table("conversations")), 2)


@query(_PAIRS + ", kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2)) SELECT conv_id, (2 * k - 1)::INT AS seq, 'user' AS role, user AS content FROM kept UNION ALL SELECT conv_id, (2 * k)::INT, 'assistant', assistant FROM kept", graph=False)
def history_messages(table: Callable) -> DataFrame:
    return history.messages(history.last(history.pairs(table("conversations")), 2))


@query(_PAIRS + "SELECT conv_id, count(*)::BIGINT AS n FROM pairs WHERE trim(user) <> '' AND trim(assistant) <> '' AND NOT starts_with(trim(assistant), 'Ошибка:') GROUP BY conv_id", graph=False)
def history_admission(table: Callable) -> DataFrame:
    return history.admitted(history.pairs(table("conversations"))).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id", graph=False)
def segment_join(table: Callable) -> DataFrame:
    return text.joined(table("conversations"), "conv_id", "turn", "text")


@query("SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS query_md5 FROM documents", graph=False)
def fence_extract(table: Callable) -> DataFrame:
    """Texts put into a fence and taken out again."""
    fence = F.concat(F.lit("Before.\n```QUERY\n"), "text", F.lit("\n```\nAfter."))
    return table("documents").select("doc_id", F.md5(text.fenced(fence, "query").cast("binary")).alias("query_md5"))


@query("SELECT conv_id, turn, trim(text) AS text FROM conversations", graph=False)
def think_strip(table: Callable) -> DataFrame:
    thought = F.concat(F.lit(" <think>a\nb</think>"), "text", F.lit("<think></think>\n"))
    return table("conversations").select("conv_id", "turn", text.without_thoughts(thought).alias("text"))


@query("SELECT page_id, url_encode(url) AS encoded, url AS decoded FROM pages", graph=False)
def url_encode(table: Callable) -> DataFrame:
    encoded = text.percent_encoded(F.col("url"))
    return table("pages").select("page_id", encoded.alias("encoded"), text.percent_decoded(encoded).alias("decoded"))


@query("SELECT vec_id, (k)::INT AS chunk, len(list_slice(embedding, 10 * k + 1, 10 * k + 10))::INT AS n, round(list_sum(list_transform(list_slice(embedding, 10 * k + 1, 10 * k + 10), lambda x: x::DOUBLE)), 6) AS total FROM embeddings, (SELECT unnest(range(7)) AS k)", graph=False)
def chunk_fixed(table: Callable) -> DataFrame:
    cut = table("embeddings").select("vec_id", F.posexplode(media.chunks(F.col("embedding"), 10)).alias("chunk", "v"))
    return cut.select("vec_id", "chunk", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x::DOUBLE)) * 32767)))::BIGINT AS total, len(embedding)::INT AS n FROM embeddings", graph=False)
def pcm_roundtrip(table: Callable) -> DataFrame:
    samples = media.to_int16(media.to_float(media.to_int16(F.col("embedding"))))
    first = media.to_int16(F.col("embedding"))
    return table("embeddings").select("vec_id", F.aggregate(first, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size(samples).alias("n"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq FROM events", graph=False)
def cumsum_window(table: Callable) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table("events").select("user_id", "event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.row_number().over(w).alias("seq"))


#: Names that whole queries had while shorter ones were registered beside them.
for _name in ("e2_paths_1_3", "list_comprehension", "distinct_neighbors"):
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]
