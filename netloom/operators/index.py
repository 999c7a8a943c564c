"""A stored vector index: centres and inverted lists as Parquet under a manifest, with rows added at any time.

`path` holds numbered manifests, `centres` of each build, and segments. A segment is a Parquet folder partitioned by cell:
the first one is the build's, each add() appends one, compact() makes one of all. A manifest names the schema tag, the
segments in the order of writing and how many cells a search looks into; it is written last, so a job that dies leaves
the state before it. A row that is added under an id that is there already replaces it: the segment's number decides.
Cells and probes are fitted on a bounded sample (the rows of least hash); every row is indexed. A search reads the cells
that its queries look into and no others.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import checkpointed
from .attention import matrix
from .vectors import _best, _probes, _ranked, _units, dot

#: Cells at most: their centres are sent to every task.
CELLS = 16_384
#: Scores of rows against centres that a task holds at once.
SCORES = 1 << 20
ROW = "vec_id long, embedding array<double>, number int, cell int"


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, by the file system that the path belongs to; none if there is no such folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


class VectorIndex:
    """One state of a stored index."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.centres = np.array([r.centre for r in spark.read.parquet(f"{path}/{manifest['centres']}").orderBy("cell").collect()])  # CELLS at most

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex | None:
        """The last whole state, or None where there is none."""
        done = [n for n in _children(spark, path) if n.startswith("manifest-") and "_SUCCESS" in _children(spark, f"{path}/{n}")]
        if not done:
            return None
        return VectorIndex(spark, path, json.loads(spark.read.text(f"{path}/{max(done)}").first()[0]))

    @staticmethod
    def build(rows: DataFrame, path: str, tag: str, force: bool = False, sample: int = 20_000, recall: float = 0.97, k: int = 10) -> VectorIndex:
        """The index of rows (vec_id, embedding). One that is there already stays, unless it is empty, has another tag, or `force`."""
        spark, there = rows.sparkSession, VectorIndex.open(rows.sparkSession, path)
        if there and there.manifest["tag"] == tag and there.manifest["rows"] and not force:
            return there
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = rows.count()
        unit = F.transform("embedding", lambda x: x / F.greatest(F.sqrt(dot("embedding", "embedding")), F.lit(1e-12)))
        part = checkpointed(rows.orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding", array_to_vector(unit).alias("f")))
        cells = max(1, min(CELLS, int(math.sqrt(n)), sample // 20 or 1))
        if cells > 1:
            centres = np.array(KMeans(k=cells, seed=1, maxIter=5, featuresCol="f").fit(part.select("f")).clusterCenters())
            probes = _probes(_units(matrix(part.select("embedding").toArrow().column(0))), centres, k, recall)  # `sample` vectors at most
        else:  # all in one cell
            centres, probes = np.zeros((1, part.select(F.max(F.size("embedding"))).first()[0] or 1)), 1
        name = f"centres-{uuid.uuid4().hex}"
        spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/{name}")
        generation = there.manifest["generation"] if there else 0
        fresh = VectorIndex(spark, path, {"tag": tag, "centres": name, "probes": int(probes), "segments": [], "rows": 0, "number": 0, "generation": generation})
        return fresh.add(rows)

    def _cells(self, rows: DataFrame, count: int) -> DataFrame:
        """rows with the `count` nearest cells, nearest first."""
        centres = self.centres

        strip = max(1, SCORES // len(centres))

        def run(batches):
            for whole in batches:
                for batch in (whole.slice(at, strip) for at in range(0, whole.num_rows, strip)):
                    v = _units(matrix(batch.column("embedding")))
                    score = v @ centres.T - (centres**2).sum(1) / 2 if len(centres) > 1 else np.zeros((len(v), 1))  # one cell takes all
                    near = np.argsort(-score, axis=1, kind="stable")[:, :count].astype(np.int32)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), cells], ["vec_id", "embedding", "cells"])

        rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(run, "vec_id long, embedding array<double>, cells array<int>")

    def _commit(self, **changes) -> VectorIndex:
        manifest = self.manifest | changes | {"generation": self.manifest["generation"] + 1}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{manifest['generation']:08d}")
        return VectorIndex(self.spark, self.path, manifest)

    def _write(self, rows: DataFrame) -> str:
        """A segment of rows (vec_id, embedding, number, cell)."""
        name = f"segment-{uuid.uuid4().hex}"
        rows.repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/{name}")
        return name

    def add(self, rows: DataFrame) -> VectorIndex:
        """The state with these rows too; of rows with one id in `rows` the one of greatest vector counts, and it replaces an older one."""
        number = self.manifest["number"] + 1
        new = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("vec_id").agg(F.max(F.col("embedding").cast("array<double>")).alias("embedding"))
        placed = self._cells(new, 1).select("vec_id", "embedding", F.lit(number).alias("number"), F.col("cells")[0].alias("cell"))
        segments = [*self.manifest["segments"], self._write(placed)]
        state = VectorIndex(self.spark, self.path, self.manifest | {"segments": segments, "number": number})
        return state._commit(rows=state.rows().count())

    def _stored(self) -> DataFrame:
        paths = [f"{self.path}/{s}" for s in self.manifest["segments"]]
        found = [self.spark.read.schema(ROW).parquet(p) for p in paths if any(n.startswith("cell=") for n in _children(self.spark, p))]
        if not found:
            return self.spark.createDataFrame([], ROW)
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def _last(self) -> DataFrame | None:
        """(vec_id, last) of ids that stand in several segments; None if there is one segment."""
        if len(self.manifest["segments"]) < 2:
            return None
        again = self._stored().groupBy("vec_id").agg(F.count("*").alias("n"), F.max("number").alias("last"))
        return again.where("n > 1").select("vec_id", "last")

    def _live(self, stored: DataFrame) -> DataFrame:
        last = self._last()
        return stored if last is None else stored.join(last, "vec_id", "left").where("last IS NULL OR number = last").drop("last")

    def rows(self) -> DataFrame:
        """All rows as they are now: (vec_id, embedding, number, cell)."""
        return self._live(self._stored())

    def compact(self) -> VectorIndex:
        """The same rows in one segment. Older segments stay until remove_old()."""
        return self._commit(segments=[self._write(self.rows())])

    def remove_old(self) -> None:
        """Removes manifests, segments and centres that this state does not name; call it when nobody reads older states."""
        keep = {*self.manifest["segments"], self.manifest["centres"], f"manifest-{self.manifest['generation']:08d}"}
        for name in _children(self.spark, self.path):
            if name not in keep and name.split("-")[0] in ("manifest", "segment", "centres"):
                folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def candidates(self, queries: DataFrame, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(queries by cell, live rows of the cells that any query looks into)."""
        asked = self._cells(queries, min(probes or self.manifest["probes"], len(self.centres))).select("vec_id", "embedding", F.explode("cells").alias("cell"))
        asked = checkpointed(asked)
        cells = [r.cell for r in asked.select("cell").distinct().collect()]  # CELLS at most
        return asked, self._live(self._stored().where(F.col("cell").isin(cells)))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, block: int = 2048) -> DataFrame:
        """(query_id, rank, vec_id, similarity) of the k most similar other rows in the cells nearest to each query."""
        asked, held = self.candidates(queries, probes)
        blocks = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("of")))  # a row for each cell
        asked = asked.join(blocks, "cell").select("vec_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("j"))
        held = held.join(blocks, "cell").select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), F.col("of")).cast("int").alias("j"))
        met = asked.groupBy("cell", "j").cogroup(held.groupBy("cell", "j"))
        return _ranked(met.applyInArrow(_best(k), "query_id long, vec_id long, similarity double"), k)

    def stats(self) -> DataFrame:
        """(segment, rows) in the order of writing, replaced rows included."""
        per = self._stored().groupBy("number").agg(F.count("*").alias("rows"))
        return per.select(F.col("number").cast("long").alias("segment"), "rows")


def hashed_vectors(texts: DataFrame, key: str, text: str = "text", size: int = 64) -> DataFrame:
    """(vec_id, embedding): lower-case tokens hashed into `size` places with signs; a vector for every text with a token."""
    from .retrieval import tokens

    return vectors_of_tokens(tokens(texts, key, text), key, size)


def vectors_of_tokens(counts: DataFrame, key: str, size: int = 64) -> DataFrame:
    """hashed_vectors() of token counts (key, token, tf)."""
    each = counts.withColumn("h", F.xxhash64("token"))
    sums = each.groupBy(F.col(key).alias("vec_id"), F.pmod("h", F.lit(size)).cast("int").alias("at")).agg(F.sum(F.when(F.col("h") % 3 == 0, -F.sqrt("tf")).otherwise(F.sqrt("tf"))).alias("w"))
    one = sums.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))  # `size` entries at most
    return one.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


class TextStore:
    """Texts that can be searched by vector or by keyword, and grow: texts and tokens as Parquet, vectors in an index.

    Each add() appends a part; a key that is there already keeps its first text.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str) -> DataFrame:
        parts = [n for n in _children(self.spark, self.path) if n.startswith(f"{what}-") and "_SUCCESS" in _children(self.spark, f"{self.path}/{n}")]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def texts(self) -> DataFrame:
        return self._read("texts", "key long, text string")

    def add(self, texts: DataFrame, tag: str = "1") -> TextStore:
        """Texts (key, text); keys that are stored already and null keys are left out."""
        from .retrieval import tokens

        new = texts.where("key IS NOT NULL AND text IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))
        new = checkpointed(new.join(self.texts(), "key", "left_anti"))
        part = uuid.uuid4().hex
        tokens(new, "key").write.parquet(f"{self.path}/tokens-{part}")
        own, there = self.spark.read.schema("key long, token string, tf long").parquet(f"{self.path}/tokens-{part}"), VectorIndex.open(self.spark, f"{self.path}/vectors")
        if there and there.manifest["tag"] == tag and there.manifest["rows"]:
            there.add(vectors_of_tokens(own, "key"))
        else:  # a build reads its vectors several times
            every = vectors_of_tokens(own, "key") if not there else hashed_vectors(self.texts().unionByName(new.select("key", "text")), "key")
            every = checkpointed(every)
            VectorIndex.build(every, f"{self.path}/vectors", tag)
        new.select("key", "text").write.parquet(f"{self.path}/texts-{part}")  # last: a text is there when all of it is
        return self

    def search(self, queries: DataFrame, k: int, method: str = "vector") -> DataFrame:
        """(query_id, rank, key, score) for queries (query_id, text): by cosine of hashed tokens, or by shared tokens; by
        keyword too where the store has no vectors."""
        from .retrieval import keyword_topk, tokens

        index = VectorIndex.open(self.spark, f"{self.path}/vectors") if method == "vector" else None
        if index and index.manifest["rows"]:
            shift = hashed_vectors(queries, "query_id").withColumn("vec_id", -1 - F.col("vec_id"))  # no query is taken for a stored row
            found = index.search(shift, k)
            return found.select((-1 - F.col("query_id")).alias("query_id"), "rank", F.col("vec_id").alias("key"), F.col("similarity").alias("score"))
        stored = self._read("tokens", "key long, token string, tf long").join(self.texts().select("key"), "key", "left_semi")
        hits = keyword_topk(tokens(queries, "query_id"), stored, "query_id", "key", k)
        return hits.select("query_id", "rank", "key", F.col("score").cast("double").alias("score"))

