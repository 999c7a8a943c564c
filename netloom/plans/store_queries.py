"""Round trips through the sinks and loaders, with their SQL over the tables that went in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..sources import stores
from ..sources.tables import shared_folder, table
from .netlist_queries import netlist
from .netlist_sql import sql

VERSION = 9


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"


def circuit_json_nodes(spark, sf_dir) -> DataFrame:
    n, path = netlist(spark, sf_dir), _path(spark, "circuits")
    stores.circuits_to_json(n.nodes, n.edges).select(F.col("json").alias("value")).write.text(path)
    return stores.circuits_from_json(spark.read.text(path), "value")[0]


def circuit_json_edges(spark, sf_dir):
    n, path = netlist(spark, sf_dir), _path(spark, "circuits")
    stores.circuits_to_json(n.nodes, n.edges).select(F.col("json").alias("value")).write.text(path)
    return stores.circuits_from_json(spark.read.text(path), "value")[1]


def dataset_store(spark, sf_dir):
    """Node counts by source, stored with a schema version; a load that asks for another version finds nothing."""
    path = _path(spark, "dataset")
    rows = netlist(spark, sf_dir).nodes.groupBy("circuit_id").agg(F.count("*").alias("nodes")).withColumn("source_base", F.concat(F.lit("s"), (F.col("circuit_id") % 4).cast("string")))
    stores.save_dataset(rows, path, "source_base", VERSION)
    if stores.load_dataset(spark, path, VERSION + 1) is not None:
        raise ValueError("a dataset of another version was loaded")
    return stores.load_dataset(spark, path, VERSION)


def stats_json(spark, sf_dir):
    path, li = _path(spark, "stats"), table(spark, sf_dir, "lineitem")
    stores.save_json(li.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.max("l_quantity").alias("most"), F.lit("x").alias("unknown")), path)
    return stores.load_json(spark, path, "n long, mean double, most double")


def jsonl_by_role(spark, sf_dir):
    path = _path(spark, "turns")
    stores.save_by_role(table(spark, sf_dir, "conversations"), path)
    return spark.read.schema("conv_id long, turn long, text string, role string").json(path).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def kg_upsert(spark, sf_dir):
    """Customers merged with newer rows of some of them and with new ones."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("name"), F.col("c_name").alias("label"))
    new = old.where("name % 10 = 0").select((F.col("name") + F.when(F.col("name") % 20 == 0, 0).otherwise(10_000_000)).alias("name"), F.concat(F.lit("new "), "label").alias("label"))
    return stores.upsert(old, new.unionByName(new), ["name"])


def vector_store(spark, sf_dir):
    path = _path(spark, "vectors")
    e = table(spark, sf_dir, "embeddings")
    e.withColumn("bucket", F.col("label") % 4).write.partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).select("vec_id", F.col("label").cast("long").alias("label"), F.size("embedding").cast("long").alias("dims"), F.col("bucket").cast("long").alias("bucket"))


def corpus_scan(spark, sf_dir):
    path = _path(spark, "corpus")
    docs = table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 4).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("item_id", "text")).alias("entries"))).alias("value"))
    docs.select("value").repartition(4).write.text(path)
    return stores.load_corpus(spark, path, "item_id:bigint,text:string").select("item_id", F.md5("text").alias("text_md5"))


def report_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    rows = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("nation"), "customers")
    return stores.filled("| {nation} | {customers} |", rows, ["nation", "customers"])


QUERIES = {f.__name__: f for f in (circuit_json_nodes, circuit_json_edges, dataset_store, stats_json, jsonl_by_role, kg_upsert, vector_store, corpus_scan, report_lines)}
_CUSTOMERS = "old AS (SELECT c_custkey::BIGINT AS name, c_name AS label FROM customer), new AS (SELECT CASE WHEN name % 20 = 0 THEN name ELSE name + 10000000 END AS name, 'new ' || label AS label FROM old WHERE name % 10 = 0)"
ORACLE_SQL = {
    "circuit_json_nodes": sql("SELECT circuit_id, idx, role, node_type, x, y FROM nodes"),
    "circuit_json_edges": sql("SELECT circuit_id, drv, snk FROM edges"),
    "dataset_store": sql("SELECT circuit_id, count(*) AS nodes, 's' || (circuit_id % 4) AS source_base FROM nodes GROUP BY circuit_id"),
    "stats_json": "SELECT count(*) AS n, round(avg(l_quantity), 4) AS mean, max(l_quantity)::DOUBLE AS most FROM lineitem",
    "jsonl_by_role": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
    "kg_upsert": f"WITH {_CUSTOMERS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE name NOT IN (SELECT name FROM new)",
    "vector_store": "SELECT vec_id, label::BIGINT AS label, len(embedding) AS dims, (label % 4)::BIGINT AS bucket FROM embeddings",
    "corpus_scan": "SELECT item_id, md5(text) AS text_md5 FROM benchmark",
    "report_lines": "SELECT n_name AS nation, customers, '| ' || n_name || ' | ' || coalesce(customers::VARCHAR, '-') || ' |' AS line FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON n_nationkey = c_nationkey",
}
