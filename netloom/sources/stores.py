"""Sinks and loaders: circuits as JSON, datasets with a schema version, small JSON facts, JSON lines by role, upserts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

CIRCUIT = "circuit_id long, nodes array<struct<idx:long,role:string,node_type:string,x:long,y:long>>, edges array<struct<drv:long,snk:long>>"


def circuits_to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(circuit_id, json): each circuit as one document, its nodes and edges in order."""
    n = nodes.groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct("idx", "role", "node_type", "x", "y"))).alias("nodes"))
    e = edges.groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct("drv", "snk"))).alias("edges"))
    return n.join(e, "circuit_id", "left").select("circuit_id", F.to_json(F.struct("circuit_id", "nodes", F.coalesce("edges", F.array().cast("array<struct<drv:long,snk:long>>")).alias("edges"))).alias("json"))


def circuits_from_json(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of such documents; fields that the schema does not name are dropped."""
    c = rows.select(F.from_json(column, CIRCUIT).alias("c"))
    return tuple(c.select("c.circuit_id", F.explode(f"c.{part}").alias("x")).select("circuit_id", "x.*") for part in ("nodes", "edges"))


def save_dataset(rows: DataFrame, path: str, by: str, version: int) -> None:
    """Parquet folders by the values of `by`, and the schema version beside them, written last."""
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{path}/rows")
    save_json(rows.sparkSession.createDataFrame([(version,)], "schema_version long"), f"{path}/meta")


def load_dataset(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The rows, or None if there are none or they have another schema version, so that the caller builds them anew."""
    try:
        found = load_json(spark, f"{path}/meta", "schema_version long").first()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/rows") if found and found[0] == version else None


def save_json(facts: DataFrame, path: str) -> None:
    """A few rows of statistics, metrics or history as one file of JSON lines."""
    facts.coalesce(1).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; unknown fields are dropped, missing ones null."""
    return spark.read.schema(schema).json(path)


def save_by_role(rows: DataFrame, path: str, role: str = "role") -> None:
    """JSON lines in a folder for each role."""
    rows.write.mode("overwrite").partitionBy(role).json(path)


def load_corpus(spark: SparkSession, path: str, entry: str, field: str = "entries") -> DataFrame:
    """The entries of JSON documents that hold them as an array; entry is the schema of one."""
    docs = spark.read.schema(f"{field} array<struct<{entry}>>").option("multiLine", True).json(path)
    return docs.select(F.explode(field).alias("e")).select("e.*")


GRAPH = "library string, nodes array<struct<name:string,label:string,props:map<string,string>>>, relations array<struct<seq:long,type:string,src:string,dst:string,props:map<string,string>>>"


def graph_to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(library, json): the property graph of each library as one document; nodes have library, name, label, props, edges
    library, seq, type, src, dst, props (maps of strings, null for none)."""
    n = nodes.groupBy("library").agg(F.sort_array(F.collect_list(F.struct("name", "label", F.to_json("props").alias("p")))).alias("n"))
    e = edges.groupBy("library").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "src", "dst", F.to_json("props").alias("p")))).alias("e"))
    props = lambda x: F.from_json(x["p"], "map<string,string>").alias("props")
    both = n.join(e, "library", "left").select("library", F.transform("n", lambda x: F.struct(x["name"].alias("name"), x["label"].alias("label"), props(x))).alias("nodes"), F.transform("e", lambda x: F.struct(x["seq"].alias("seq"), x["type"].alias("type"), x["src"].alias("src"), x["dst"].alias("dst"), props(x))).alias("relations"))
    return both.select("library", F.to_json(F.struct("library", "nodes", "relations")).alias("json"))


def graph_from_json(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of such documents. A document that is no JSON gives nothing; relations without both ends are left out."""
    g = rows.select(F.from_json(column, GRAPH).alias("g")).where("g.library IS NOT NULL")
    nodes = g.select("g.library", F.explode("g.nodes").alias("x")).select("library", "x.*").where("name IS NOT NULL")
    edges = g.select("g.library", F.explode("g.relations").alias("x")).select("library", "x.*")
    return nodes, edges.where("src IS NOT NULL AND dst IS NOT NULL")


def upsert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by library and name, relations by their ends and type: properties of both are united, a new value
    replacing an old one of that name; a new label replaces an old one. Doing it twice changes nothing."""

    def merged(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        rows = old.select(*keys, *values, F.to_json("props").alias("p"), F.lit(0).alias("turn")).unionByName(new.select(*keys, *values, F.to_json("props").alias("p"), F.lit(1).alias("turn")))
        last = rows.groupBy(*keys).agg(*(F.max(F.struct("turn", c)).alias(f"m_{c}") for c in values), F.max(F.when(F.col("turn") == 0, F.col("p"))).alias("before"), F.max(F.when(F.col("turn") == 1, F.col("p"))).alias("after"))
        as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
        before, after = as_map("before"), as_map("after")
        props = F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k)), after)
        return last.select(*keys, *(F.col(f"m_{c}.{c}").alias(c) for c in values), F.when(F.size(props) > 0, props).alias("props"))

    return merged(nodes, new_nodes, ["library", "name"], ["label"]), merged(edges, new_edges, ["library", "type", "src", "dst"], ["seq"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new: a key in both has the new row, a key twice in one table one of its rows (the greatest)."""
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, *values, F.lit(0).alias("__turn")).unionByName(new.select(*keys, *values, F.lit(1).alias("__turn")))
    last = both.groupBy(*keys).agg(F.max(F.struct("__turn", *values)).alias("last"))
    return last.select(*keys, *(f"last.{c}" for c in values))


def filled(template: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): the template for each row, with {column} replaced by the row's value."""
    line = F.lit(template)
    for c in columns:
        line = F.replace(line, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return rows.select(*columns, line.alias("line"))
