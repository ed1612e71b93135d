"""Entities: mentions, summaries, co-occurrence network, ego networks, communities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions import counting
from murmurlake.functions import louvain as modularity
from murmurlake.functions.shared import SENT_BYTES, importable, written


def capitalised(messages: DataFrame) -> DataFrame:
    """Capitalised words of four letters or more as mentions: a stand-in where no extractor is given."""
    return messages.select("message_id", "timestamp", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Z][a-z]{3,})"), F.lit(1))).alias("surface")).withColumn("entity", F.lower("surface"))


def summary(mentions: DataFrame, top_surfaces: int = 5) -> DataFrame:
    """Each entity's messages, mentions, distinct surface forms, and the commonest of them."""
    forms = mentions.groupBy("entity", "surface").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "surface"))
    best = F.array_sort(F.collect_list(F.when(F.col("p") <= top_surfaces, F.struct("p", "surface"))))
    named = forms.withColumn("p", place).groupBy("entity").agg(F.sum("n").alias("mentions"), F.count("*").alias("surfaces"), F.array_join(F.transform(best, lambda x: x["surface"]), ", ").alias("top_surfaces"))
    df = mentions.groupBy("entity").agg(F.countDistinct("message_id").alias("messages"))
    return df.join(named, "entity")


def numbered(names: DataFrame) -> DataFrame:
    """Adds ``id`` to different names (``entity``), from 0 in their order, and writes them; names are far fewer than what
    they occur in."""
    place = F.row_number().over(Window.orderBy("entity")) - 1
    return written(names.withColumn("id", place), "names")


def _sendable(names: DataFrame) -> DataFrame:
    """``names`` marked to be sent to all executors where they are small."""
    size = names.agg(F.sum(F.octet_length("entity") + 24)).first()[0] or 0
    return F.broadcast(names) if size <= SENT_BYTES else names


def _named(table: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Puts names in place of the numbers in ``columns``; both of a pair of numbers were given by name's order."""
    sent = _sendable(names.select("entity", "id"))
    for c in columns:
        table = table.withColumnRenamed(c, "__id").join(sent.withColumnsRenamed({"entity": c, "id": "__id"}), "__id").drop("__id")
    return table


def _pairs(mentions: DataFrame, least_messages: int, times: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b`` of numbers, and the names of these.

    Each message sends, for each of its entities, the numbers of those that occur in more messages than it, as one
    array to where that entity's pairs are counted: four bytes a pair move, no row, and a common entity, which would
    have the most pairs, has the fewest others to send. They are counted there by sorting, a bounded number at once."""
    spark = mentions.sparkSession
    distinct = written(mentions.groupBy("message_id", "entity").agg(F.min("timestamp").alias("timestamp")), "mentions")
    known = numbered(distinct.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= least_messages))
    listed = distinct.join(_sendable(known), "entity").groupBy("message_id", "timestamp").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("es"))
    listed = listed.where(F.size("es") > 1).select("timestamp", F.col("es.id").alias("es"))
    own = ["timestamp"] if times else []
    each = listed.select(*own, "es", F.posexplode("es").alias("i", "x")).where(F.col("i") < F.size("es") - 1)
    tails = each.select(*own, "x", F.slice("es", F.col("i") + 2, F.size("es")).alias("ys"))
    met = tails.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x").sortWithinPartitions("x")
    importable(spark)
    counted = met.mapInArrow(lambda batches: counting.met(batches, times), "a int, b int, weight bigint" + ", first_at timestamp_ntz, last_at timestamp_ntz" * times)
    return counted, known


def pairs(mentions: DataFrame, least_messages: int = 3) -> DataFrame:
    """Messages, first and last time of each pair of entities that share messages, of entities in ``least_messages``
    messages at least: rarer ones are no nodes of the network."""
    counted, names = _pairs(mentions, least_messages, True)
    return _named(counted, names, "a", "b").select("a", "b", "weight", "first_at", "last_at")


def edges(mentions: DataFrame, least_messages: int = 3, least_weight: int = 2) -> DataFrame:
    """Pairs of ``least_weight`` messages at least; written, as networks read them more than once."""
    counted, names = _pairs(mentions, least_messages, False)
    heavy = written(counted.where(F.col("weight") >= least_weight), "edges")
    return _named(heavy, names, "a", "b").select("a", "b", "weight")


def both_ways(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "weight"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))).alias("e")).select("e.*")


def nodes(edges_: DataFrame, links: int = 5) -> DataFrame:
    """Degree, weighted degree and strongest links of each entity of the network."""
    near = both_ways(edges_).withColumn("p", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("weight"), "y")))
    best = F.array_sort(F.collect_list(F.when(F.col("p") <= links, F.struct("p", "y"))))
    return near.groupBy(F.col("x").alias("entity")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"), F.array_join(F.transform(best, lambda z: z["y"]), ", ").alias("strongest"))


def ego(edges_: DataFrame, centres: int = 4, k: int = 10) -> DataFrame:
    """The strongest neighbours of the entities of greatest weighted degree."""
    near = both_ways(edges_)
    top = near.groupBy(F.col("x").alias("centre")).agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "centre").limit(centres).select("centre")
    place = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("weight"), "neighbour"))
    return near.withColumnsRenamed({"x": "centre", "y": "neighbour"}).join(F.broadcast(top), "centre").withColumn("place", place.cast("bigint")).where(F.col("place") <= k).select("centre", "place", "neighbour", "weight")


def louvain(a: list[str], b: list[str], weight: list[float]) -> dict[str, int]:
    """Communities by moving nodes to where modularity gains most, then joining them; nodes in order of name, so the
    same graph gives the same communities. Numbered by size, then by least name."""
    names = sorted({*a, *b})
    place = {n: i for i, n in enumerate(names)}
    graph: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for x, y, w in zip(a, b, weight):
        graph[place[x]][place[y]] += w
        graph[place[y]][place[x]] += w
    found = modularity.communities(((i, np.array([*near]), np.array([*near.values()])) for i, near in graph.items()), len(names))
    return dict(zip(names, found.tolist()))


def communities(edges_: DataFrame) -> DataFrame:
    """``entity, community`` of the thresholded network, by ``louvain``.

    Nodes move one after the other, each seeing the moves before, so one task does that; it holds a few numbers a node
    and has the links on its disk. Names, numbers and each node's list of links are made by all."""
    spark = edges_.sparkSession
    own = written(edges_, "edges")
    names = numbered(own.select(F.explode(F.array("a", "b")).alias("entity")).distinct())
    sent = _sendable(names)
    for end in ("a", "b"):
        own = own.join(sent.withColumnsRenamed({"entity": end, "id": f"id_{end}"}), end)
    both = both_ways(own.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("weight").cast("double").alias("weight")))
    lists = both.repartitionByRange("x").groupBy("x").agg(F.collect_list(F.struct("y", "weight")).alias("near"))
    near = written(lists.select("x", F.col("near.y").alias("ys"), F.col("near.weight").alias("weights")), "links")
    nodes = names.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ys, weights = batch.column("ys"), batch.column("weights")
                for k, x in enumerate(batch.column("x").to_pylist()):
                    yield x, ys[k].values.to_numpy(), weights[k].values.to_numpy()

        found = modularity.communities(rows(), nodes)
        yield from counting.pieces([np.arange(nodes), found], pa.schema([("id", pa.int32()), ("community", pa.int64())]))

    importable(spark)
    found = near.coalesce(1).mapInArrow(run, "id int, community bigint")
    return _named(found.withColumnRenamed("id", "entity"), names, "entity").select("entity", "community")


def community_rollup(communities_: DataFrame, nodes_: DataFrame, exemplars: int = 5) -> DataFrame:
    """Nodes, weight and the foremost members of each community."""
    joined = communities_.join(nodes_, "entity").withColumn("p", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weighted_degree"), "entity")))
    best = F.array_sort(F.collect_list(F.when(F.col("p") <= exemplars, F.struct("p", "entity"))))
    return joined.groupBy("community").agg(F.count("*").alias("nodes"), F.sum("weighted_degree").alias("weight"), F.array_join(F.transform(best, lambda z: z["entity"]), ", ").alias("exemplars"))
