"""Adjacency lists: the relationships of each node, stored with it.

lists: a row for a node, direction and type, with an array of the relationships and their far ends, bucketed by the node's id.
hubs:  the same for nodes that have more than `most` relationships of a direction and type, in several rows of up to `most` each,
       which are spread over all files: a bucket would hold a whole hub.
nodes: as in the graph, bucketed like the lists.

Rows that come from a scan of the nodes meet the lists in place: nothing is exchanged below the expansion. Rows that come from
another step are exchanged by id; the lists never are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.sources.graph import NODE, REL, Graph
from tarnweave.sources.shared import shuffles_once, stash, stash_dir

#: Relationships in one row at most.
MOST = 4096
#: What a list holds of each relationship, beside the far end, unless told otherwise.
KEPT = tuple(c for c in REL if c not in ("type", "start", "end"))


@dataclass(frozen=True)
class AdjacentGraph(Graph):
    lists: DataFrame
    hubs: DataFrame | None

    def meet(self, frame: DataFrame, key: str, rel: str, way: str, types: Sequence[str]) -> DataFrame:
        """frame, each row with each relationship of the node `key` as `<rel>_...` columns. way: out, in or both; of both, a
        loop comes once, and start is the near end."""
        found = self._met(frame, self.lists, key, rel, way, types)
        return found if self.hubs is None else found.unionByName(self._met(frame, self.hubs, key, rel, way, types))

    def _met(self, frame: DataFrame, lists: DataFrame, key: str, rel: str, way: str, types: Sequence[str]) -> DataFrame:
        lists = lists.filter(F.col("type").isin(*types)) if types else lists
        lists = lists if way == "both" else lists.filter(F.col("way") == way)
        rows = lists.select(F.col("id").alias("_near"), F.col("way").alias("_way"), F.col("type").alias("_type"), F.col("ends").alias("_ends"))
        met = frame.join(rows, F.col(key) == F.col("_near"))
        each = met.select(*frame.columns, "_near", "_way", "_type", F.explode("_ends").alias("_r"))
        if way == "both":
            each = each.filter((F.col("_way") == "out") | (F.col("_r.far") != F.col("_near")))
        near, far = (F.col("_near"), F.col("_r.far")) if way != "in" else (F.col("_r.far"), F.col("_near"))
        own = {"type": F.col("_type"), "start": near, "end": far}
        kept = [f.name for f in self.lists.schema["ends"].dataType.elementType.fields]
        return each.select(*frame.columns, *[own.get(c, F.col(f"_r.{c}")).alias(f"{rel}_{c}") for c in REL if c in own or c in kept])


def write(graph: Graph, folder: str, name: str, buckets: int | None = None, most: int = MOST, kept: Sequence[str] = KEPT, of_nodes: Sequence[str] = NODE) -> AdjacentGraph:
    """Writes the tables <name>_nodes and <name>_lists, and the hubs as files, below the folder. Relationships without a
    start or end belong to no list. kept: what a list holds of each relationship, beside its type and far end; of_nodes: what
    the nodes keep, ids among it; expansions have no other columns.

    Relationships go once to the tasks of their buckets, which make and write the lists. What was exchanged goes when that is done."""
    spark = graph.nodes.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = lambda near, way, far: F.struct(F.col(near).alias("id"), F.lit(way).alias("way"), F.struct(F.col(far).alias("far"), *kept).alias("r"))
    ends = graph.rels.filter("start IS NOT NULL AND end IS NOT NULL").select("type", F.xxhash64("id").alias("_h"), F.inline(F.array(end("start", "out", "end"), end("end", "in", "start"))))
    with shuffles_once(spark):
        hubs = _write_lists(graph, ends, folder, name, buckets, most, of_nodes)
    return read(spark, folder, name, graph.rels, hubs)


def _write_lists(graph: Graph, ends: DataFrame, folder: str, name: str, buckets: int, most: int, of_nodes: Sequence[str]) -> bool:
    """Whether there are hubs."""
    key = ["id", "way", "type"]
    many = stash(ends.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most), "hubs")
    hubs = not many.isEmpty()
    dealt = ends.join(many, key, "left") if hubs else ends
    lists = (dealt.filter("_n IS NULL") if hubs else dealt).repartition(buckets, "id").groupBy(*key).agg(F.collect_list("r").alias("ends"))
    _bucketed(lists, f"{folder}/lists", f"{name}_lists", buckets)
    _bucketed(graph.nodes.select(*of_nodes).repartition(buckets, "id"), f"{folder}/nodes", f"{name}_nodes", buckets)
    if hubs:
        part = F.pmod("_h", F.ceil(2 * F.col("_n") / most))
        parts = dealt.filter("_n IS NOT NULL").groupBy(*key, part.alias("_part")).agg(F.collect_list("r").alias("ends"))
        starts = F.sequence(F.lit(1), F.size("ends"), F.lit(most))
        cut = parts.select(*key, F.explode(F.transform(starts, lambda k: F.slice("ends", k, F.lit(most)))).alias("ends"))
        cut.write.mode("overwrite").parquet(f"{folder}/hubs")
    return hubs


def _bucketed(df: DataFrame, path: str, table: str, buckets: int) -> None:
    """df is dealt by id to so many partitions already."""
    df.sortWithinPartitions("id").write.bucketBy(buckets, "id").sortBy("id").option("path", path).mode("overwrite").saveAsTable(table)


def read(spark: SparkSession, folder: str, name: str, rels: DataFrame, hubs: bool) -> AdjacentGraph:
    return AdjacentGraph(spark.table(f"{name}_nodes"), rels, spark.table(f"{name}_lists"), spark.read.parquet(f"{folder}/hubs") if hubs else None)


def adjacent(graph: Graph, most: int = MOST, kept: Sequence[str] = KEPT, of_nodes: Sequence[str] = NODE) -> AdjacentGraph:
    """The graph with lists that last as long as the session; see write()."""
    name = f"adjacent_{uuid.uuid4().hex}"
    return write(graph, f"{stash_dir(graph.nodes.sparkSession)}/{name}", name, most=most, kept=kept, of_nodes=of_nodes)
