"""Registered queries of the column functions, of aggregates and of path functions, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import dates, lists, media, text
from tarnweave.operators import history, silence
from tarnweave.operators.match import Match, prop
from tarnweave.operators.ranges import overlapping
from tarnweave.operators.shortest import reached
from tarnweave.plans import metrics
from tarnweave.plans.ask import regression
from tarnweave.plans.catalogue import _NODES, _PAIRS, _TRAILS, STRUCTURE, c, query
from tarnweave.plans.named import Registry
from tarnweave.sources.adjacency import adjacent
from tarnweave.sources.graph import NODE_OWN, Graph, all_properties


@query(_PAIRS + """, kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2))
SELECT conv_id, 'Before:' || chr(10) || string_agg('Question: ' || user || chr(10) || 'Answer: ' || assistant, chr(10) ORDER BY k) AS prompt FROM kept GROUP BY conv_id""", graph=False)
def history_prompt(table: Callable) -> DataFrame:
    return history.prompt(history.last(history.pairs(table("conversations")), 2), "Before:")


@query("SELECT page_id, 'data:image/jpeg;base64,' || base64(encode(url)) AS uri FROM pages", graph=False)
def data_uri(table: Callable) -> DataFrame:
    return table("pages").select("page_id", text.data_uri(F.col("url").cast("binary")).alias("uri"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{}' AS fallback FROM events", graph=False)
def json_fallback(table: Callable) -> DataFrame:
    """Arguments as JSON; text that is none becomes an empty object."""
    parsed, broken = text.json_object(F.col("props")), text.json_object(F.concat(F.lit("{"), "event_type"))
    return table("events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"), F.to_json(broken).alias("fallback"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages", graph=False)
def html_escape(table: Callable) -> DataFrame:
    return table("pages").select("page_id", F.md5(text.html_escaped(F.col("html")).cast("binary")).alias("escaped_md5"))


@query("SELECT doc_id, NOT regexp_matches(regexp_replace(text, '\\p{Latin}', '', 'g'), '\\p{L}') AS latin FROM documents UNION ALL SELECT -1 - doc_id, false FROM documents", graph=False)
def latin_literals(table: Callable) -> DataFrame:
    """Whether all letters of a literal are Latin; the second half has a Cyrillic word put in."""
    docs = table("documents")
    mixed = docs.select((-1 - F.col("doc_id")).alias("doc_id"), text.latin_only(F.concat("text", F.lit(" слово"))).alias("latin"))
    return docs.select("doc_id", text.latin_only(F.col("text")).alias("latin")).union(mixed)


@query("SELECT event_id, event_id % 3 <> 0 AS reads FROM events", graph=False)
def read_only_guard(table: Callable) -> DataFrame:
    """Query texts that only read; a word that writes doesn't count inside a quoted string."""
    kind = F.col("event_id") % 3
    q = F.when(kind == 0, F.concat(F.lit("MATCH (n {name: '"), "event_type", F.lit("'}) SET n.x = 1"))).when(kind == 1, F.lit("MATCH (n {name: 'delete'}) RETURN n")).otherwise(F.lit("match (n) return n"))
    return table("events").select("event_id", text.read_only(q).alias("reads"))


@query("SELECT c_custkey, 'Dear ' || c_name || ' of ' || coalesce(c_mktsegment, '') || '!' AS filled FROM customer", graph=False)
def template_fill(table: Callable) -> DataFrame:
    filled = text.filled("Dear {name} of {segment}!", name=F.col("c_name"), segment=F.col("c_mktsegment"))
    return table("customer").select("c_custkey", filled.alias("filled"))


@query("SELECT conv_id, turn, 'You are ' || role || chr(10) || chr(10) || trim(text) AS prompt FROM conversations", graph=False)
def prompt_concat(table: Callable) -> DataFrame:
    """Parts of a prompt, blank ones left out."""
    return table("conversations").select("conv_id", "turn", text.prompt(F.concat(F.lit("You are "), "role"), F.lit(" "), F.lit(None).cast("string"), F.col("text")).alias("prompt"))


@query("""SELECT i::INT AS i, round(0.3 * sin(2 * pi() * ((i + 1) * 400.0 + (400.0 / 1599) * i * (i + 1) / 2) / 16000) * least(1.0::DOUBLE, i / 160, (1599 - i) / 160), 6) AS sample
FROM (SELECT unnest(range(1600)) AS i)""", graph=False)
def tone_sweep(table: Callable) -> DataFrame:
    one = table("region").filter("r_regionkey = 0")
    return one.select(F.posexplode(media.sweep(400.0, 800.0, 0.1)).alias("i", "sample")).select("i", F.round("sample", 6).alias("sample"))


@query("""SELECT vec_id, ceil(len(embedding) * 2 / 3)::INT AS n, round(list_sum(list_transform(range(ceil(len(embedding) * 2 / 3)::INT), lambda i: embedding[(floor(i * 1.5) + 1)::INT]::DOUBLE
  + (embedding[(least(floor(i * 1.5) + 1, len(embedding) - 1) + 1)::INT]::DOUBLE - embedding[(floor(i * 1.5) + 1)::INT]::DOUBLE) * (i * 1.5 - floor(i * 1.5)))), 5) AS total FROM embeddings WHERE len(embedding) > 0""", graph=False)
def resample(table: Callable) -> DataFrame:
    out = media.resampled(F.col("embedding"), 24_000)
    return table("embeddings").filter(F.size("embedding") > 0).select("vec_id", F.size(out).alias("n"), F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT vec_id, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[len(embedding)]::DOUBLE, 6) AS last FROM embeddings WHERE len(embedding) > 0", graph=False)
def chunks_joined(table: Callable) -> DataFrame:
    """Arrays cut into chunks, and the chunks put together again in their order."""
    cut = table("embeddings").select("vec_id", F.posexplode(media.chunks(F.col("embedding"), 10)).alias("seq", "part"))
    whole = media.flat(cut, "vec_id", "seq", "part")
    return whole.select("vec_id", F.size("part").alias("n"), F.round(F.element_at("part", 1).cast("double"), 6).alias("first"), F.round(F.element_at("part", -1).cast("double"), 6).alias("last"))


@query("SELECT doc_id, ceil(strlen(text) / 100)::INT AS n_chunks, strlen(text)::BIGINT AS n_bytes FROM documents WHERE strlen(text) > 0", graph=False)
def byte_chunks(table: Callable) -> DataFrame:
    cut = media.byte_chunks(F.col("text").cast("binary"), 100)
    docs = table("documents").filter(F.octet_length("text") > 0).select("doc_id", cut.alias("cut"))
    return docs.select("doc_id", F.size("cut").alias("n_chunks"), F.aggregate("cut", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x)).alias("n_bytes"))


@query("SELECT doc_id, (strlen(text) // 2 * 2)::BIGINT AS n_bytes, md5(substr(hex(encode(text)), 1, 4 * (strlen(text) // 2))) AS hex_md5 FROM documents WHERE strlen(text) > 0", graph=False)
def byte_carry(table: Callable) -> DataFrame:
    """Chunks of an odd number of bytes made into whole samples of two, the odd byte carried over; and put together again."""
    docs = table("documents").filter(F.octet_length("text") > 0)
    cut = docs.select("doc_id", F.posexplode(media.byte_chunks(F.col("text").cast("binary"), 1023)).alias("seq", "pcm"))
    whole = text.joined(media.aligned(cut, "doc_id", "seq", "pcm").select("doc_id", "seq", F.hex("aligned").alias("hex")), "doc_id", "seq", "hex", "")
    return whole.select("doc_id", (F.length("hex") / 2).cast("bigint").alias("n_bytes"), F.md5(F.col("hex").cast("binary")).alias("hex_md5"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS came, value AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, came + 0.05 AS begins, came + 0.05 + d AS upto FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN s.upto >= e.came THEN s.upto ELSE e.came + 0.05 END, CASE WHEN s.upto >= e.came THEN s.upto ELSE e.came + 0.05 END + e.d FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, round(begins, 3) AS begins FROM s""", graph=False)
def playback_schedule(table: Callable) -> DataFrame:
    """Events as chunks of sound that play one after the other."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    chunks = table("events").select("user_id", "event_id", at.alias("at"), F.col("value").alias("d"))
    return media.schedule(chunks, "user_id", "event_id", "at", "d").withColumn("begins", F.round("begins", 3))


@query(_PAIRS + ", actual AS (SELECT conv_id, min(assistant) AS actual FROM pairs GROUP BY conv_id) SELECT c.conv_id AS case_id, c.text AS question, a.actual FROM (SELECT conv_id, text FROM conversations WHERE turn = 0) c LEFT JOIN actual a USING (conv_id)", graph=False)
def expected_and_actual(table: Callable) -> DataFrame:
    """Cases with their actual answers; cases without one stay."""
    turns = table("conversations")
    cases = turns.filter("turn = 0").select(c("conv_id", "case_id"), c("text", "question"), F.lit("").alias("expected"))
    actual = history.pairs(turns).groupBy(c("conv_id", "case_id")).agg(F.min("assistant").alias("actual")).withColumn("seconds", F.lit(0.0))
    return regression(cases, actual).select("case_id", "question", "actual")


@query("SELECT a.id AS customer_id, u.c_mktsegment AS segment, u.c_acctbal > 5000 AS rich FROM nodes a JOIN customer u ON a.id = 'c:' || u.c_custkey WHERE u.c_mktsegment = 'BUILDING'")
def property_access(g: Graph) -> DataFrame:
    """Open properties: one compared as text, one as a number, which is null where it is none."""
    m = Match.nodes(g, "a", "Customer", where=prop("a", "segment") == "BUILDING")
    return m.returns(c("a_id", "customer_id"), prop("a", "segment").alias("segment"), (prop("a", "balance", "double") > 5000).alias("rich"))


@query("SELECT evidence, count(*)::BIGINT AS n, round(sum(confidence), 4) AS total, round(avg(confidence), 6) AS mean, round(stddev_samp(confidence), 6) AS spread, round(stddev_pop(confidence), 6) AS spread_all, round(quantile_cont(confidence, 0.5), 6) AS middle, quantile_disc(confidence, 0.9) AS high FROM rels WHERE type = 'CONTAINS' GROUP BY evidence")
def aggregate_numbers(g: Graph) -> DataFrame:
    x = F.col("confidence")
    return g.rels.filter("type = 'CONTAINS'").groupBy("evidence").agg(
        F.count("*").alias("n"), F.round(F.sum(x), 4).alias("total"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("spread"), F.round(F.stddev_pop(x), 6).alias("spread_all"),
        F.round(F.percentile(x, 0.5), 6).alias("middle"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY confidence)").alias("high"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'middle' ELSE 'low' END AS band, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days, round(sqrt(abs(o_totalprice)), 4) AS root, round(ln(o_totalprice + 1), 6) AS log, (o_orderkey % 7)::BIGINT AS rest, floor(o_totalprice / 100)::BIGINT AS hundreds FROM orders""", graph=False)
def case_dates_math(table: Callable) -> DataFrame:
    p, day = F.col("o_totalprice"), F.col("o_orderdate")
    return table("orders").select(
        "o_orderkey", F.when(p > 100000, "high").when(p > 10000, "middle").otherwise("low").alias("band"), F.year(day).alias("y"), F.month(day).alias("m"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days"),
        F.round(F.sqrt(F.abs(p)), 4).alias("root"), F.round(F.log(p + 1), 6).alias("log"), (F.col("o_orderkey") % 7).alias("rest"), F.floor(p / 100).alias("hundreds"),
    )


@query("SELECT id, lower(name) AS small, substr(name, 1, 3) AS head, reverse(name) AS back, replace(name, '#', '-') AS dashed, length(name)::INT AS n, split_part(name, '#', 2) AS tail, name LIKE '%7' AS seven, name LIKE 'S%' AS s, coalesce(name, '?') AS shown FROM nodes WHERE list_contains(labels, 'Party') OR name IN ('AFRICA', 'EUROPE')")
def string_functions(g: Graph) -> DataFrame:
    x = F.col("name")
    rows = g.nodes.filter(F.array_contains("labels", "Party") | x.isin("AFRICA", "EUROPE"))
    return rows.select("id", F.lower(x).alias("small"), F.substring(x, 1, 3).alias("head"), F.reverse(x).alias("back"), F.replace(x, F.lit("#"), F.lit("-")).alias("dashed"), F.length(x).alias("n"), F.split_part(x, F.lit("#"), F.lit(2)).alias("tail"), x.endswith("7").alias("seven"), x.startswith("S").alias("s"), F.coalesce(x, F.lit("?")).alias("shown"))


@query(_TRAILS.format(start="true") + """, reached AS (SELECT first, last, types, length, rank() OVER (PARTITION BY first, last ORDER BY length) AS k FROM trail WHERE length >= 1 AND first <> last)
SELECT first AS start_id, last AS end_id, min(length)::INT AS length, count(*)::BIGINT AS n FROM reached JOIN nodes z ON z.id = last AND (list_contains(z.labels, 'Region') OR list_contains(z.labels, 'Supplier')) WHERE k = 1 GROUP BY ALL""")
def shortest_paths(g: Graph) -> DataFrame:
    """From suppliers to suppliers and regions, three relationships away at most: length and number of the shortest paths."""
    ends = F.array_contains("z_labels", "Region") | F.array_contains("z_labels", "Supplier")
    m = Match.nodes(g, "a", "Supplier").nearest("z", types=STRUCTURE, most=3, where=ends)
    return m.returns(c("a_id", "start_id"), c("z_id", "end_id"), "length", F.col("n_paths").cast("bigint").alias("n"))


@query("""SELECT 'r:' || r_regionkey AS start_id, 'c:' || c_custkey AS end_id, 2::INT AS length, 1::BIGINT AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT 'r:' || r_regionkey, 'o:' || o_orderkey, 3, 1 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT 'r:' || r_regionkey, 'p:' || l_partkey, 4, count(*)::BIGINT FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL (WITH far AS (SELECT r_regionkey AS r, b.sup AS s, count(*)::BIGINT AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS sup FROM lineitem) b ON b.p = a.l_partkey GROUP BY ALL)
SELECT 'r:' || r, 's:' || s, 5, n FROM far)""", graph=False)
def shortest_paths_far(table: Callable) -> DataFrame:
    """Along the directions from regions down to suppliers, five relationships away, with the number of shortest paths: nations,
    customers, orders, parts, suppliers. The graph has no such directions of its own, so the keys are turned round."""
    parts = [
        table("nation").selectExpr("concat('r:', n_regionkey) AS start", "concat('n:', n_nationkey) AS end"),
        table("customer").selectExpr("concat('n:', c_nationkey)", "concat('c:', c_custkey)"),
        table("orders").selectExpr("concat('c:', o_custkey)", "concat('o:', o_orderkey)"),
        table("lineitem").selectExpr("concat('o:', l_orderkey)", "concat('p:', l_partkey)"),
        table("lineitem").selectExpr("concat('p:', l_partkey)", "concat('s:', l_suppkey)").distinct(),
    ]
    rels = reduce(DataFrame.union, parts).selectExpr("uuid() AS id", "'DOWN' AS type", "start", "end")
    regions = table("region").selectExpr("concat('r:', r_regionkey) AS id")
    found = reached(Graph(regions, rels), regions, directed=True)
    return found.filter("length > 1").select("start_id", F.col("node_id").alias("end_id"), "length", F.col("n_paths").cast("bigint").alias("n"))


@query("""SELECT b.id AS part_id, r.type AS relation, a.labels[1] AS label, count(*)::BIGINT AS n, min(r.confidence) AS least FROM nodes b JOIN und r ON r.s = b.id JOIN nodes a ON a.id = r.e WHERE list_contains(b.labels, 'Part') GROUP BY ALL""")
def adjacency_expand(g: Graph) -> DataFrame:
    """What is next to each part, in both directions, through adjacency lists of what is asked for."""
    m = Match.nodes(adjacent(g, kept=("confidence",), of_nodes=("id", "labels")), "b", "Part").both("r", "a")
    return m.frame.groupBy(c("b_id", "part_id"), c("r_type", "relation"), F.col("a_labels")[0].alias("label")).agg(F.count("*").alias("n"), F.min("r_confidence").alias("least"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 20 AND s_acctbal + 20 AND c_nationkey <> s_nationkey", graph=False)
def theta_range(table: Callable) -> DataFrame:
    """Customers and suppliers of other nations whose balances are at most 20 apart: patterns that nothing connects."""
    left = table("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    right = table("supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") - 20).alias("s_low"), (F.col("s_acctbal") + 20).alias("s_high"))
    pairs = overlapping(left, right, ("c_acctbal", "c_acctbal"), ("s_low", "s_high"), condition=F.col("c_nationkey") != F.col("s_nationkey"))
    return pairs.select("c_custkey", "s_suppkey")


@query("""SELECT a.l_orderkey, a.l_partkey AS part, b.l_partkey AS other, count(*)::BIGINT AS n FROM (SELECT *, l_shipdate AS t FROM lineitem) a JOIN lineitem b ON a.l_orderkey <> b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linestatus = 'O' AND b.l_linestatus = 'F'
  AND abs(date_diff('day', a.l_shipdate::DATE, b.l_shipdate::DATE)) <= 3 AND a.l_quantity > 40 AND b.l_quantity > 40 GROUP BY ALL""", graph=False)
def theta_dates(table: Callable) -> DataFrame:
    """Large open lines, and large finished ones of the same supplier that were shipped three days apart at most."""
    lines = table("lineitem").filter("l_quantity > 40").withColumn("day", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")))
    left = lines.filter("l_linestatus = 'O'").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s"), "day")
    right = lines.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("other"), F.col("l_suppkey").alias("t"), (F.col("day") - 3).alias("low"), (F.col("day") + 3).alias("high"))
    pairs = overlapping(left, right, ("day", "day"), ("low", "high"), condition=(F.col("s") == F.col("t")) & (F.col("l_orderkey") != F.col("o")))
    return pairs.groupBy("l_orderkey", "part", "other").agg(F.count("*").alias("n"))


@query("""SELECT c_name AS customer, 'o:' || o_orderkey AS order_id, 'p:' || l_partkey AS part_id, 'orders.parquet' AS r_source_file, 1.0::DOUBLE AS r_confidence, NULL AS r_evidence, NULL AS r_chunk_id,
  'lineitem.parquet' AS q_source_file, round(1.0 - l_discount, 2) AS q_confidence, l_returnflag || l_linestatus AS q_evidence, l_suppkey::VARCHAR AS q_chunk_id
FROM (SELECT * FROM lineitem WHERE round(1.0 - l_discount, 2) > 0.98) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey""", over_graph=False)
def provenance_of_every_rel(g: Graph) -> DataFrame:
    """Provenance of each relationship of a pattern, under its own name."""
    m = Match.nodes(g, "a", "Customer").out("r", "b", types=["PLACED"]).out("q", "p", types=["CONTAINS"], where=F.col("q_confidence") > 0.98)
    return m.returns(c("a_name", "customer"), c("b_id", "order_id"), c("p_id", "part_id"), rel=("r", "q"))


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'customer#0000000') OR NOT (list_contains(labels, 'Party') OR list_contains(labels, 'Order') OR name LIKE 'P%')")
def where_words(g: Graph) -> DataFrame:
    """OR, NOT, contains and begins-with."""
    from tarnweave.operators.match import contains_word, has_labels

    labels = F.col("a_labels")
    others = ~(has_labels(labels, ["Party"]) | has_labels(labels, ["Order"]) | F.col("a_name").startswith("P"))
    return Match.nodes(g, "a", where=contains_word("a", "Customer#0000000") | others).returns(c("a_id", "id"), c("a_name", "name"))


@query("SELECT a.name AS source, r.type AS relation, b.name AS target, b.id AS target_id, r.evidence, r.source_file, r.chunk_id, r.confidence FROM nodes a JOIN und r ON r.s = a.id JOIN nodes b ON b.id = r.e WHERE a.name = 'NATION_7'")
def named_query(g: Graph) -> DataFrame:
    """A named question, called as an SQL table function."""
    return Registry(g).ask("connected_to", who="NATION_7")


@query("""SELECT 's:' || s_suppkey AS call_id, NULL AS relation, NULL AS target, 'unknown question: forget' AS error FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 's:' || s_suppkey, NULL, NULL, 'missing: least' FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT 's:' || s_suppkey, 'IN_NATION', n_name, NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 = 2
UNION ALL SELECT 's:' || s_suppkey, 'SUPPLIED_BY', p_name, NULL FROM supplier JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE s_suppkey % 4 = 2
UNION ALL SELECT 's:' || s_suppkey, 'IN_NATION', 'n:' || s_nationkey, NULL FROM supplier WHERE s_suppkey % 4 = 3""", over_graph=False)
def dispatch_errors(g: Graph) -> DataFrame:
    """A call for each supplier: some name no question, some lack an argument, the others are answered."""
    suppliers = g.nodes.filter(F.array_contains("labels", "Supplier"))
    kind = F.split("id", ":")[1].cast("bigint") % 4
    name = F.when(kind == 0, "forget").when(kind == 2, "connected_to").otherwise("statements_of")
    least = F.when(kind == 3, "0.9").when(kind == 1, "much")
    calls = suppliers.select(F.col("id").alias("call_id"), name.alias("name"), F.create_map(F.lit("who"), F.col("name"), F.lit("node"), F.col("id"), F.lit("least"), least).alias("arguments"))
    rows = Registry(g).dispatch(calls)
    of = lambda k: F.get_json_object("row", f"$.{k}")
    return rows.select("call_id", of("relation").alias("relation"), F.coalesce(of("target"), of("target_id")).alias("target"), "error")


_SPEECH = """WITH s AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT label, vec_id, CASE WHEN v IS NULL OR isnan(v) THEN 0.0::DOUBLE ELSE v END AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS place FROM s),
f AS (SELECT label, place // 24 AS frame, sum(x * x) / count(*) AS energy FROM p GROUP BY ALL),
m AS (SELECT *, last_value(CASE WHEN energy >= 0.018 THEN true WHEN energy < 0.012 THEN false END IGNORE NULLS) OVER (PARTITION BY label ORDER BY frame) AS loud FROM f),
o AS (SELECT label, frame, coalesce((frame - lag(frame) OVER (PARTITION BY label ORDER BY frame) - 1 >= 2)::INT, 1) AS opens FROM m WHERE loud),
g AS (SELECT label, frame, sum(opens) OVER (PARTITION BY label ORDER BY frame) AS segment FROM o),
speech AS (SELECT label, min(frame)::BIGINT AS first_frame, (max(frame) - min(frame) + 1)::BIGINT AS n_frames FROM g GROUP BY label, segment HAVING max(frame) - min(frame) + 1 >= 3)
"""
_GATE = silence.Gate(size=24, high=0.018, low=0.012, least_speech=3, least_gap=2)


@query(_SPEECH + "SELECT * FROM speech", graph=False)
def speech_segments(table: Callable) -> DataFrame:
    """Vectors of one label as the chunks of one recording: its segments of speech, in frames that run across chunks."""
    return silence.segments(table("embeddings"), "label", "vec_id", "embedding", _GATE)


@query(_SPEECH + "SELECT label, vec_id, count(*)::BIGINT AS n, round(sum(x), 5) AS total FROM p JOIN speech USING (label) WHERE place >= first_frame * 24 AND place < (first_frame + n_frames) * 24 GROUP BY ALL", graph=False)
def silence_left_out(table: Callable) -> DataFrame:
    """What is left of each chunk without its silence."""
    left = silence.without_silence(table("embeddings"), "label", "vec_id", "embedding", _GATE)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return left.groupBy("label", "vec_id").agg(F.sum(F.size("embedding")).alias("n"), F.round(F.sum(total), 5).alias("total"))


@query("SELECT 'nodes' AS name, 'rows' AS status, count(*)::BIGINT AS rows FROM nodes UNION ALL SELECT 'relationships', 'rows', count(*) FROM rels UNION ALL SELECT 'placed', 'rows', count(*) FROM rels WHERE type = 'PLACED' UNION ALL SELECT 'unsure', 'empty', count(*) FROM rels WHERE confidence < 0")
def observed_spans(g: Graph) -> DataFrame:
    """Spans of jobs over the graph, with the rows that each observed as it ran."""
    spans: list[metrics.Span] = []
    placed = Match.nodes(g, "a", "Customer").out("r", "b", types=["PLACED"]).frame
    for name, frame in {"nodes": g.nodes, "relationships": g.rels, "placed": placed, "unsure": g.rels.filter("confidence < 0")}.items():
        metrics.measured(frame, lambda df: df.write.format("noop").mode("overwrite").save(), spans, name)
    return metrics.span_table(g.nodes.sparkSession, spans).select("name", "status", "rows")


@query(_PAIRS + """, actual AS (SELECT conv_id, min(assistant) AS answer FROM pairs GROUP BY conv_id), turns AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, concat('ВОПРОС ', conv_id, ':', chr(10), text, chr(10), chr(10), 'ОТВЕТ ТЕКУЩИЙ:', chr(10), CASE WHEN coalesce(answer, '') = '' THEN 'ОТВЕТ НЕ ПОЛУЧЕН (пусто)' ELSE answer END, chr(10), chr(10), 'ПРАВИЛЬНЫЙ ОТВЕТ:', chr(10), text, chr(10), chr(10), 'ВРЕМЯ ОТВЕТА:', chr(10), printf('%.2f', n * 0.25), ' сек', chr(10), chr(10), repeat('-', 40), chr(10)) AS report
FROM (SELECT conv_id, text FROM conversations WHERE turn = 0) JOIN turns USING (conv_id) LEFT JOIN actual USING (conv_id)""", graph=False)
def report_cases(table: Callable) -> DataFrame:
    """A report of conversations as cases: the first turn stands for question and expected answer, a quarter of a second for each turn."""
    turns = table("conversations")
    cases = turns.filter("turn = 0").select("conv_id", "text").join(turns.groupBy("conv_id").agg((F.count("*") * 0.25).alias("seconds")), "conv_id")
    actual = history.pairs(turns).groupBy("conv_id").agg(F.min("assistant").alias("answer"))
    report = metrics.rendered(F.col("conv_id"), F.col("text"), F.col("answer"), F.col("text"), F.col("seconds"))
    return cases.join(actual, "conv_id", "left").select("conv_id", report.alias("report"))


@query(_TRAILS.format(start="true") + """SELECT first AS source_id, array_to_string(ids, ',') AS path_ids, len(list_filter(names, lambda x: NOT starts_with(x, 'A'))) = len(names) AS without_a, len(list_filter(names, lambda x: x = 'EUROPE')) > 0 AS european,
  len(list_filter(types, lambda x: x = 'IN_REGION')) = 0 AS inside, len(list_filter(names, lambda x: starts_with(x, 'NATION'))) = 1 AS one_nation, list_sum(list_transform(names, lambda x: length(x)))::BIGINT AS letters, array_to_string(range(length, -1, -2), ',') AS places
FROM trail JOIN nodes z ON z.id = last WHERE length >= 1 AND (list_contains(z.labels, 'Region') OR list_contains(z.labels, 'Nation'))""")
def list_predicates(g: Graph) -> DataFrame:
    """All, any, none or a single one of a path's members; a sum over them, and their places counted down by two."""
    ends = F.array_contains("z_labels", "Region") | F.array_contains("z_labels", "Nation")
    m = Match.nodes(g, "a", "Supplier").trails("z", least=1, most=3, types=STRUCTURE, where=ends)
    names = F.col("path_nodes")
    return m.returns(
        c("a_id", "source_id"), F.array_join("path_ids", ",").alias("path_ids"),
        lists.every(names, lambda x: ~x.startswith("A")).alias("without_a"), lists.some(names, lambda x: x == "EUROPE").alias("european"),
        lists.none(F.col("path_rels"), lambda r: r["type"] == "IN_REGION").alias("inside"), lists.single(names, lambda x: x.startswith("NATION")).alias("one_nation"),
        F.aggregate(names, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("letters"), F.array_join(lists.span(F.col("length"), F.lit(0), -2).cast("array<string>"), ",").alias("places"),
    )


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS a, l_shipdate::DATE AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN b < a THEN -1 ELSE 1 END AS sign FROM d),
m AS (SELECT *, ((year(hi) - year(lo)) * 12 + month(hi) - month(lo))::INT AS k FROM s),
n AS (SELECT *, k - CASE WHEN (lo + to_months(k))::DATE > hi THEN 1 ELSE 0 END AS whole FROM m)
SELECT whole * sign AS months, (date_diff('day', (lo + to_months(whole::INT))::DATE, hi) * sign)::INT AS days, count(*)::BIGINT AS n, min((b + INTERVAL 3 MONTH)::DATE + 10) AS due FROM n GROUP BY ALL""", graph=False)
def durations(table: Callable) -> DataFrame:
    """How long lines took from order to shipment, in months and days, and the earliest date three months and ten days later."""
    orders = table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"))
    lines = table("lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("shipped"))
    took = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("shipped", dates.between(F.col("ordered"), F.col("shipped")).alias("took"))
    return took.groupBy(c("took.months", "months"), c("took.days", "days")).agg(F.count("*").alias("n"), F.min(dates.plus(F.col("shipped"), 3, 10)).alias("due"))


@query(" UNION ALL ".join(f"SELECT '{p}' || {k} AS id, array_to_string(json_keys({json}), ',') AS keys FROM {t}" for t, (p, k, _, _, _, json) in _NODES.items()), over_graph=False)
def node_keys(g: Graph) -> DataFrame:
    """The names of each node's properties, in their order."""
    keys = F.json_object_keys(F.to_json(all_properties(NODE_OWN)))
    return g.nodes.select("id", F.array_join(F.array_sort(keys), ",").alias("keys"))


@query("SELECT n.name AS nation, r.type AS relation, r.s = n.id AS leaves, x.id AS start_id, y.id AS end_id FROM rels r JOIN nodes n ON n.id IN (r.s, r.e) AND list_contains(n.labels, 'Nation') JOIN nodes x ON x.id = r.s JOIN nodes y ON y.id = r.e WHERE r.type IN ('IN_REGION', 'IN_NATION')")
def relationship_ends(g: Graph) -> DataFrame:
    """What is next to nations, whichever way it points, with each relationship's own start and end."""
    m = Match.nodes(g, "n", "Nation").both("r", "b", types=STRUCTURE, ends=True)
    return m.returns(c("n_name", "nation"), c("r_type", "relation"), (F.col("r_own_start") == F.col("n_id")).alias("leaves"), c("r_own_start", "start_id"), c("r_own_end", "end_id"))


@query("""SELECT vec_id, CASE WHEN embedding IS NOT NULL THEN 16000 END::INT AS rate, len(embedding)::INT AS n,
  round(list_sum(list_transform(embedding, lambda x: trunc(CASE WHEN x IS NULL OR isnan(x) THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x::DOUBLE)) END * 32767) / 32768)), 6) AS total,
  round(list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0.0::DOUBLE ELSE x::FLOAT::DOUBLE END)), 6) AS total_floating FROM embeddings""", graph=False)
def wav_files(table: Callable) -> DataFrame:
    """Vectors as WAV files, of 16-bit samples and of floats, and read again."""
    files = table("embeddings").select("vec_id", media.wav(F.col("embedding")).alias("content"), media.wav(F.col("embedding"), floating=True).alias("other"))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6)
    read = media.decode_wav(files).select("vec_id", "other", "rate", F.size("samples").alias("n"), total(F.col("samples")).alias("total"))
    again = media.decode_wav(read.drop("rate"), "other")
    return again.select("vec_id", "rate", "n", "total", total(F.col("samples")).alias("total_floating"))
