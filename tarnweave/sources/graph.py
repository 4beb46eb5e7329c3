"""The property graph: two DataFrames, and where they come from and go to.

nodes: id, labels, name, leiden_community, properties
rels:  id, type, start, end, evidence, source_file, chunk_id, confidence, run_id, properties

Properties are open: a VARIANT object, whose values keep their types (numbers, booleans, texts, lists, objects). Those that have
a column of their own are kept there; exports put all together. A null property is none. Ids are strings. A node may have several labels; two nodes may have any number of relationships, and a relationship
may begin and end at one node.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = ("id", "labels", "name", "leiden_community", "properties")
REL = ("id", "type", "start", "end", "evidence", "source_file", "chunk_id", "confidence", "run_id", "properties")
#: The ends of a relationship as it is stored, beside those that it is walked by.
OWN_ENDS = ("own_start", "own_end")
PROVENANCE = ("evidence", "source_file", "chunk_id", "confidence")
NODE_DUMP = "id string, labels array<string>, properties variant"
REL_DUMP = "id string, type string, properties variant, start string, end string"
#: Columns that hold properties, with their types.
NODE_OWN = {"name": "string", "leiden_community": "bigint"}
REL_OWN = {"evidence": "string", "source_file": "string", "chunk_id": "string", "confidence": "double", "run_id": "string"}
#: Families of value types, by how their names begin.
FAMILIES = {"ARRAY": "LIST", "OBJECT": "MAP", "BIGINT": "INTEGER", "DECIMAL": "FLOAT", "DOUBLE": "FLOAT", "FLOAT": "FLOAT", "BOOLEAN": "BOOLEAN", "STRING": "STRING"}


@dataclass(frozen=True)
class Graph:
    """first: nodes that patterns begin at; all by default."""

    nodes: DataFrame
    rels: DataFrame
    first: DataFrame | None = field(default=None, kw_only=True)

    def undirected(self, ends: bool = False) -> DataFrame:
        """Each relationship in both directions; a loop once. One scan; filters on other columns than the ends still reach it.
        ends: with the relationship's own ends too, in own_start and own_end."""
        own = [F.col(x).alias(f"own_{x}") for x in ("start", "end")] if ends else []
        way = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"), *own)
        both = F.when(F.col("start") == F.col("end"), F.array(way("start", "end"))).otherwise(F.array(way("start", "end"), way("end", "start")))
        others = [c for c in REL if c not in ("start", "end")]
        return self.rels.select(*others, F.inline(both)).select(*REL, *(OWN_ENDS if ends else ()))

    def labels(self) -> DataFrame:
        """(label, n): the nodes of each label."""
        return self.nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))

    def rel_types(self) -> DataFrame:
        """(type, n, n_evidence, min_confidence, max_confidence)"""
        return self.rels.groupBy("type").agg(F.count("*").alias("n"), F.count("evidence").alias("n_evidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))

    def property_keys(self) -> DataFrame:
        """(kind, key, n): the names of open properties in use, of nodes by label and of relationships by type."""
        return self._open().groupBy("kind", "key").agg(F.count("*").alias("n"))

    def property_types(self) -> DataFrame:
        """(kind, key, type, n): all properties in use, open ones and those with columns, by the types of their values: STRING,
        INTEGER, FLOAT, BOOLEAN, LIST, MAP, or the value's own type where it is another."""
        kind = F.schema_of_variant("value")
        family = F.when(F.lit(False), kind)
        for begins, name in FAMILIES.items():
            family = family.when(kind.startswith(begins), name)
        every = self._open(all_properties(NODE_OWN), all_properties(REL_OWN))
        return every.select("kind", "key", family.otherwise(kind).alias("type")).groupBy("kind", "key", "type").agg(F.count("*").alias("n"))

    def property_schemas(self) -> DataFrame:
        """(kind, schema): what all open properties of a label or type have in common, as an OBJECT type."""
        nodes = self.nodes.select(F.explode("labels").alias("kind"), "properties")
        every = nodes.union(self.rels.select("type", "properties"))
        return every.groupBy("kind").agg(F.schema_of_variant_agg("properties").alias("schema"))

    def _open(self, of_node: Column | None = None, of_rel: Column | None = None) -> DataFrame:
        """(kind, key, value) of properties that are not null."""
        nodes = self.nodes.select(F.explode("labels").alias("kind"), as_map(of_node if of_node is not None else F.col("properties")).alias("p"))
        rels = self.rels.select(F.col("type").alias("kind"), as_map(of_rel if of_rel is not None else F.col("properties")).alias("p"))
        return nodes.union(rels).select("kind", F.explode("p").alias("key", "value"))

    def require(self, labels: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> None:
        """Raises ValueError for labels or types that the graph doesn't have. Reads the catalogue, a row for each."""
        for what, wanted, known in (("label", labels, self.labels), ("type", types, self.rel_types)):
            if wanted:
                missing = set(wanted) - {r[0] for r in known().collect()}
                if missing:
                    raise ValueError(f"unknown {what}: {', '.join(sorted(missing))}")

    def write(self, folder: str) -> None:
        """As Parquet: relationships by type, so that typed expansions read their folders only."""
        self.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        self.rels.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/rels")

    def dump_nodes(self) -> DataFrame:
        """(value): a JSON object for each node, for a text sink of any size."""
        return self.nodes.select(F.to_json(F.struct("id", "labels", all_properties(NODE_OWN).alias("properties"))).alias("value"))

    def dump_rels(self) -> DataFrame:
        return self.rels.select(F.to_json(F.struct("id", "type", all_properties(REL_OWN).alias("properties"), "start", "end")).alias("value"))

    def dump(self, folder: str) -> None:
        """JSON lines, nodes and relationships apart: the whole graph never meets in one task."""
        self.dump_nodes().write.mode("overwrite").text(f"{folder}/nodes")
        self.dump_rels().write.mode("overwrite").text(f"{folder}/rels")


def as_map(properties: Column) -> Column:
    """The properties that are not null, by name."""
    return F.map_filter(F.try_variant_get(properties, "$", "map<string,variant>"), lambda _, v: v.isNotNull() & ~F.is_variant_null(v))


def all_properties(own: dict[str, str]) -> Column:
    """The open properties and those of the columns, as one object. A column stands before an open property of its name."""
    columns = F.create_map(*[x for n in own for x in (F.lit(n), F.col(n).cast("variant"))])
    rest = F.coalesce(F.map_filter(as_map(F.col("properties")), lambda k, _: ~k.isin(*own)), F.create_map().cast("map<string,variant>"))
    return F.to_variant_object(F.map_concat(rest, F.map_filter(columns, lambda _, v: v.isNotNull())))


def open_object(properties: Column) -> Column:
    """Properties given as a struct or as a map of one type, as an object."""
    return F.to_variant_object(properties)


def _typed(raw: DataFrame, own: dict[str, str], others: tuple[str, ...]) -> DataFrame:
    """What all_properties() put together, apart again."""
    named = [F.try_variant_get("properties", f"$.{n}", kind).alias(n) for n, kind in own.items()]
    rest = F.coalesce(F.map_filter(as_map(F.col("properties")), lambda k, _: ~k.isin(*own)), F.create_map().cast("map<string,variant>"))
    return raw.select(*others, *named, F.to_variant_object(rest).alias("properties"))


def read(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes").select(*NODE), spark.read.parquet(f"{folder}/rels").select(*REL))


def load_dump(spark: SparkSession, folder: str) -> Graph:
    """What dump() wrote."""
    return loaded(spark.read.schema(NODE_DUMP).json(f"{folder}/nodes"), spark.read.schema(REL_DUMP).json(f"{folder}/rels"))


def loaded(nodes: DataFrame, rels: DataFrame) -> Graph:
    """The graph of dumped nodes and relationships, whose properties are all in one object."""
    return Graph(_typed(nodes, NODE_OWN, ("id", "labels")).select(*NODE), _typed(rels, REL_OWN, ("id", "type", "start", "end")).select(*REL))


def _node(df: DataFrame, prefix: str, key: str, labels: tuple[str, ...], name: Column, community: Column, **properties: str) -> DataFrame:
    own = F.struct(*[F.col(c).alias(k) for k, c in properties.items()]) if properties else F.create_map().cast("map<string,string>")
    return df.select(
        F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"),
        F.array(*map(F.lit, labels)).alias("labels"),
        name.alias("name"),
        community.cast("bigint").alias("leiden_community"),
        open_object(own).alias("properties"),
    )


def _rel(df: DataFrame, prefix: str, key: Column, kind: str, start: tuple[str, str], end: tuple[str, str], properties: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    own = F.struct(*[v.alias(k) for k, v in properties.items()]) if properties else F.create_map().cast("map<string,string>")
    text, id_of = F.lit(None).cast("string"), lambda x: F.concat(F.lit(f"{x[0]}:"), F.col(x[1]).cast("string"))
    kinds = {"confidence": "double"}
    return df.select(
        F.concat(F.lit(f"{prefix}:"), key.cast("string")).alias("id"),
        F.lit(kind).alias("type"),
        id_of(start).alias("start"),
        id_of(end).alias("end"),
        *[columns.get(c, text).cast(kinds.get(c, "string")).alias(c) for c in ("evidence", "source_file", "chunk_id", "confidence", "run_id")],
        open_object(own).alias("properties"),
    )


def from_tables(spark: SparkSession, folder: str) -> Graph:
    """The graph of the order tables: regions, nations, customers, suppliers, parts and orders, their keys as
    relationships, and the order lines between orders and parts as relationships with provenance."""
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    c, five = F.col, F.lit(5)
    nodes = [
        _node(t["region"], "r", "r_regionkey", ("Region",), c("r_name"), F.lit(None)),
        _node(t["nation"], "n", "n_nationkey", ("Nation",), c("n_name"), c("n_regionkey")),
        _node(t["customer"], "c", "c_custkey", ("Customer", "Party"), c("c_name"), c("c_nationkey") % five, segment="c_mktsegment", balance="c_acctbal"),
        _node(t["supplier"], "s", "s_suppkey", ("Supplier", "Party"), c("s_name"), c("s_nationkey") % five, balance="s_acctbal"),
        _node(t["part"], "p", "p_partkey", ("Part",), c("p_name"), c("p_size") % five, brand="p_brand", size="p_size"),
        _node(t["orders"], "o", "o_orderkey", ("Order",), F.lit(None).cast("string"), F.lit(None), status="o_orderstatus", priority="o_orderpriority"),
    ]
    key = {"confidence": F.lit(1.0), "run_id": F.lit("fk")}
    cents = lambda x: F.round(c(x) * 100).cast("bigint")
    line = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", c("l_quantity").cast("bigint"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), F.date_format("l_shipdate", "yyyyMMdd"))
    rels = [
        _rel(t["nation"], "nr", c("n_nationkey"), "IN_REGION", ("n", "n_nationkey"), ("r", "n_regionkey"), source_file=F.lit("nation.parquet"), **key),
        _rel(t["customer"], "cn", c("c_custkey"), "IN_NATION", ("c", "c_custkey"), ("n", "c_nationkey"), source_file=F.lit("customer.parquet"), **key),
        _rel(t["supplier"], "sn", c("s_suppkey"), "IN_NATION", ("s", "s_suppkey"), ("n", "s_nationkey"), source_file=F.lit("supplier.parquet"), **key),
        _rel(t["orders"], "co", c("o_orderkey"), "PLACED", ("c", "o_custkey"), ("o", "o_orderkey"), source_file=F.lit("orders.parquet"), **key),
        _rel(
            t["lineitem"], "op", line, "CONTAINS", ("o", "l_orderkey"), ("p", "l_partkey"), evidence=F.concat("l_returnflag", "l_linestatus"),
            source_file=F.lit("lineitem.parquet"), chunk_id=c("l_suppkey"), properties={"quantity": c("l_quantity"), "line": c("l_linenumber"), "returned": c("l_returnflag") == "R"}, confidence=F.round(1.0 - c("l_discount"), 2), run_id=F.year("l_shipdate"),
        ),
        _rel(t["lineitem"].select("l_partkey", "l_suppkey").distinct(), "ps", F.concat_ws("-", "l_partkey", "l_suppkey"), "SUPPLIED_BY", ("p", "l_partkey"), ("s", "l_suppkey"), source_file=F.lit("lineitem.parquet")),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, rels))
