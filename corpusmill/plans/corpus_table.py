"""The corpus as Parquet tables: chunks with their indices, only ever appended, and a small log of generation states.

A generation becomes visible when its ``active`` row is in the log, so a publish is
one small write. Every write of chunks has an id, which the log names before the chunks
come: chunks of a write that was broken off or overtaken are read by no one, and no read
has to drop duplicates. There is one writer at a time (:func:`single_writer`).

A version is a folder of chunks, of their postings by token and by sparse index, of cells of
their dense vectors, and of the states that held when it was made. The newest file in
``snapshots`` names the version and its number; the log since is in the folder of that
number. So what holds is the version's states, less those of which the log says more, and
the log's tail: its cost follows the tail. ``gc`` makes a new version and removes all but
it and the one before, which readers may still be at.

    snapshots/<number>-<version>   log/epoch=<number>/   rejected/
    <version>/chunks|tokens|weights|cells|cell_stats/unit=<write>/   <version>/pivots|states/
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as cell_index
from ..operators import visibility
from ..operators.postings import Postings, blocks_of, sliced, sparse_terms, text_terms, write_blocks
from ..schemas import CHUNK, GENERATION_STATE
from .checks import chunk_flaw
from .corpus_index import CorpusIndex

#: The fields of a generation, and of one write of it.
KEY = ["document_id", "ingest_generation"]
WRITE = [*KEY, "write_id"]
#: What views and filters of vectors need.
CARRY = (*WRITE, "source_id", "source_type", "document_path", "ingested_at", "tags")
ENTRY = f"{CHUNK}, write_id string, slice string, local int"
BLOCK = "slice string, n int, low float, top float, locals array<int>, weights array<float>, unit string, bucket int"
CELL = "cell int, key string, vector array<float>, document_id string, ingest_generation int, write_id string, source_id string, source_type string, document_path string, ingested_at timestamp, tags array<string>"
STATE = "document_id string, ingest_generation int, ingest_state string, write_id string, document_sha256 string"


class CorpusTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self) -> tuple[object, Callable[[str], object]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = lambda p: hadoop.Path(f"{self.path}/{p}")
        return at("x").getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(at(folder))) if fs.exists(at(folder)) else []

    def _snapshot(self) -> tuple[int, str]:
        """Number and folder of the newest version."""
        names = self._names("snapshots")
        return (int(names[-1].split("-", 1)[0]), names[-1].split("-", 1)[1]) if names else (0, "v-0")

    def _read(self, path: str, schema: str) -> DataFrame:
        fs, at = self._fs()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{path}") if fs.exists(at(path)) else self.spark.createDataFrame([], schema)

    def ensure(self, dense_dim: int, sparse_dim: int) -> bool:
        """Fix the table's dimensions; whether it is new. A table of other dimensions is refused with ValueError."""
        there = self._read("collection", "dense_dim int, sparse_dim int").collect()  # one row
        if not there:
            self.spark.createDataFrame([(dense_dim, sparse_dim)], "dense_dim int, sparse_dim int").coalesce(1).write.mode("append").parquet(f"{self.path}/collection")
        elif tuple(there[0]) != (dense_dim, sparse_dim):
            raise ValueError(f"the table has dimensions {tuple(there[0])}, not {(dense_dim, sparse_dim)}")
        return not there

    def exists(self) -> bool:
        return bool(self._names("collection") or self._names("log"))

    def log(self) -> DataFrame:
        """The tail: what has been logged since the newest version was made."""
        number, _ = self._snapshot()
        return self._read(f"log/epoch={number}", GENERATION_STATE)

    def states(self) -> DataFrame:
        """document_id, ingest_generation, ingest_state, write_id, document_sha256: what holds of every generation."""
        newest = F.max_by(F.struct("state", "write_id", "document_sha256"), F.col("seq"))
        held = self.log().groupBy(*KEY).agg(newest.alias("~held"))
        tail = held.select(*KEY, F.col("~held.state").alias("ingest_state"), F.col("~held.write_id").alias("write_id"), F.col("~held.document_sha256").alias("document_sha256"))
        base = self._read(f"{self._snapshot()[1]}/states", STATE)
        return base.join(tail.select(*KEY), KEY, "left_anti").unionByName(tail)

    def entries(self) -> DataFrame:
        """Chunks of all writes, with their place in the index."""
        return self._read(f"{self._snapshot()[1]}/chunks", ENTRY)

    def _rows(self, states: DataFrame) -> DataFrame:
        """Chunks of the writes that ``states`` names, with their state."""
        return self.entries().join(states.drop("document_sha256"), WRITE).select(*_names(CHUNK), "ingest_state")

    def chunks(self) -> DataFrame:
        """All chunks with the state of their generation, but for retired ones."""
        return self._rows(self.states().where("ingest_state <> 'retired'"))

    def heads(self) -> DataFrame:
        """As :meth:`states`, of the highest active generation of each document, from the log alone."""
        newest = F.max_by(F.struct("ingest_generation", "ingest_state", "write_id", "document_sha256"), F.col("ingest_generation"))
        return self.states().where("ingest_state = 'active'").groupBy("document_id").agg(newest.alias("~head")).select("document_id", "~head.*")

    def visible(self) -> DataFrame:
        """What readers see: chunks joined with the heads, which come from the small log."""
        return self._rows(self.heads())

    def view(self, states: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """A view of the index: rows of the writes that ``states`` names."""
        return lambda rows: rows.join(states.select(*WRITE), WRITE, "left_semi")

    def append(self, chunks: DataFrame, write_id: str, strict: bool = False) -> dict[str, int]:
        """Add chunks of a write that the log has announced, with their indices; counts of rows accepted and refused.

        Rows with a flaw go to ``rejected`` with its name, counted in the write that computes
        the rows; with ``strict`` a flaw raises ValueError, and nothing is added.
        """
        dims = self._read("collection", "dense_dim int, sparse_dim int").collect() or [(None, None)]  # one row
        path = f"{self.path}/work/{uuid.uuid4().hex}"
        checked, seen = chunks.select(*_names(CHUNK), F.lit(write_id).alias("write_id")).withColumn("flaw", chunk_flaw(*dims[0])), Observation()
        checked.observe(seen, F.count("*").alias("all"), F.count("flaw").alias("refused")).write.parquet(path)
        counts = {"accepted": seen.get["all"] - seen.get["refused"], "refused": seen.get["refused"]}
        rows = self.spark.read.schema(checked.schema).parquet(path)
        if counts["refused"]:
            bad = rows.where("flaw IS NOT NULL")
            bad.write.mode("append").parquet(f"{self.path}/rejected")
            if strict:
                raise ValueError(f"{counts['refused']} rows are flawed, such as: {bad.select('flaw').first()[0]}")
        if counts["accepted"]:
            self._add(self._snapshot()[1], rows.where("flaw IS NULL").drop("flaw"), write_id)
        fs, at = self._fs()
        fs.delete(at(f"work/{path.rsplit('/', 1)[1]}"), True)
        return counts

    def rejected(self) -> DataFrame:
        return self._read("rejected", f"{CHUNK}, write_id string, flaw string")

    def _add(self, version: str, rows: DataFrame, unit: str) -> None:
        """Write rows (CHUNK, write_id) and their indices to a version."""
        place = f"{self.path}/{version}"
        sliced(rows, "point_id", unit).sortWithinPartitions("slice", "local").withColumn("unit", F.lit(unit)).write.partitionBy("unit").mode("append").parquet(f"{place}/chunks")
        own = self._read(f"{version}/chunks", f"{ENTRY}, unit string").where(F.col("unit") == unit)
        for name, terms in (("tokens", text_terms(F.col("text"))), ("weights", sparse_terms(F.col("sparse")))):
            write_blocks(blocks_of(own, terms), f"{place}/{name}", unit=unit)
        slim = cell_index.slim_rows(own, "dense", "point_id", CARRY)
        centres = self._pivots(version)
        if not len(centres):
            centres = cell_index.centres_of(slim)
            if not len(centres):
                return
            pivots = [(i, c.tolist()) for i, c in enumerate(centres)]
            self.spark.createDataFrame(pivots, "cell int, vector array<double>").coalesce(1).write.mode("append").parquet(f"{place}/pivots")
        cell_index.laid_out(cell_index.dealt(slim, centres)).withColumn("unit", F.lit(unit)).write.partitionBy("unit").mode("append").parquet(f"{place}/cells")
        kept = self._read(f"{version}/cells", f"{CELL}, angle double, unit string").where(F.col("unit") == unit)
        cell_index.cell_stats(kept).coalesce(1).withColumn("unit", F.lit(unit)).write.partitionBy("unit").mode("append").parquet(f"{place}/cell_stats")

    def _pivots(self, version: str) -> np.ndarray:
        rows = self._read(f"{version}/pivots", "cell int, vector array<double>").orderBy("cell").collect()  # at most cells.PIVOTS
        return np.array([r.vector for r in rows]) if rows else np.zeros((0, 1))

    def index(self) -> CorpusIndex:
        """All chunks with their indices; read it through a :meth:`view`."""
        _, version = self._snapshot()
        entries = self.entries()
        tokens, weights = self._read(f"{version}/tokens", f"term string, {BLOCK}"), self._read(f"{version}/weights", f"term int, {BLOCK}")
        stats = self._read(f"{version}/cell_stats", "cell int, n bigint, near double, far double")
        cells = cell_index.cells_of(self._read(f"{version}/cells", CELL), "point_id", self._pivots(version), stats)
        return CorpusIndex(entries, Postings(entries, tokens), Postings(entries, weights), cells)

    def set_states(self, generations: DataFrame, state: str, write_id: str | None = None) -> int:
        """Log a state for each (document_id, ingest_generation); returns how many.

        With ``write_id`` they are announced, with their ``document_sha256`` if there is one.
        Without, they keep the write that the log has for them; those that it does not know are left out.
        """
        rows = generations.select("document_id", F.col("ingest_generation").cast("int"), *([F.col("document_sha256")] if "document_sha256" in generations.columns else [F.lit(None).cast("string").alias("document_sha256")])).distinct()
        known = self.states().select(*WRITE, F.col("document_sha256").alias("~sha"))
        rows = rows.join(known, KEY, "left").withColumn("document_sha256", F.coalesce("document_sha256", "~sha")).drop("~sha")
        rows = rows.withColumn("write_id", F.lit(write_id)) if write_id is not None else rows.where("write_id IS NOT NULL")
        number, _ = self._snapshot()
        seq, seen = (self.log().agg(F.max("seq")).first()[0] or 0) + 1, Observation()
        logged = rows.select(*KEY, F.lit(state).alias("state"), F.lit(seq).cast("bigint").alias("seq"), F.current_timestamp().alias("at"), "write_id", "document_sha256")
        logged.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(f"{self.path}/log/epoch={number}")
        return seen.get["n"]

    def generation(self, document_id: str, number: int) -> DataFrame:
        """The active chunks of one generation, in order."""
        return self.chunks().where((F.col("document_id") == document_id) & (F.col("ingest_generation") == number) & (F.col("ingest_state") == "active")).orderBy("chunk_index")

    def _chosen(self, document_id: str, where: object) -> tuple[DataFrame, int]:
        """Generations of a document, and how many chunks they have."""
        chosen = self.states().where((F.col("document_id") == document_id) & (F.col("ingest_state") != "retired") & where)
        return chosen, self.entries().where(F.col("document_id") == document_id).join(chosen, WRITE, "left_semi").count()

    def promote_generation(self, document_id: str, number: int) -> int:
        """Make a pending generation active; the count of its chunks (none pending: 0)."""
        chosen, n = self._chosen(document_id, (F.col("ingest_generation") == number) & (F.col("ingest_state") == "pending"))
        if n:
            self.set_states(chosen, "active")
        return n

    def delete_generations(self, document_id: str, states: list[str] | None = None, generation: int | None = None, max_generation: int | None = None) -> int:
        """Take generations of a document from all reads; the count of their chunks. ``generation`` goes before ``max_generation``."""
        where = F.lit(True)
        if states is not None:
            where &= F.col("ingest_state").isin(states)
        if generation is not None:
            where &= F.col("ingest_generation") == generation
        elif max_generation is not None:
            where &= F.col("ingest_generation") <= max_generation
        chosen, n = self._chosen(document_id, where)
        self.set_states(chosen, "retired")
        return n

    def max_active_generation(self, document_id: str) -> int | None:
        return self.states().where((F.col("document_id") == document_id) & (F.col("ingest_state") == "active")).agg(F.max("ingest_generation")).first()[0]

    def status(self) -> DataFrame:
        """One row: whether the table is there, its rows and what readers see, and whether they can see it: the log and the chunks agree."""
        seen, heads = self.visible(), self.heads()
        empty = heads.join(seen.select("document_id").distinct(), "document_id", "left_anti").agg(F.count("*").alias("documents_without_chunks"))
        told = visibility.status(self.chunks()).crossJoin(empty).crossJoin(self.rejected().agg(F.count("*").alias("rejected_count")))  # one row each
        return told.withColumn("table_exists", F.lit(self.exists())).withColumn("healthy", F.col("table_exists") & (F.col("documents_without_chunks") == 0))

    def gc(self) -> dict[str, int]:
        """Make a new version of the chunks that readers see; the counts of what went. Older versions but one are removed."""
        with single_writer(self.spark, self.path):
            counts = visibility.gc_counts(self.chunks()).first().asDict()
            number, before = self._snapshot()
            version, heads = f"v-{uuid.uuid4().hex}", self.heads()
            heads.select("document_id", "ingest_generation", "ingest_state", "write_id", "document_sha256").repartitionByRange("document_id").sortWithinPartitions("document_id").write.parquet(f"{self.path}/{version}/states")
            kept = self._read(f"{version}/states", STATE)
            rows = self.entries().join(kept.select(*WRITE), WRITE, "left_semi").select(*_names(CHUNK), "write_id")
            if not rows.isEmpty():
                self._add(version, rows, version)
            fs, at = self._fs()
            fs.create(at(f"snapshots/{number + 1:08d}-{version}"), False).close()
            for name in self._names(""):
                if name == "work" or (name.startswith("v-") and name not in (version, before)):
                    fs.delete(at(name), True)
            for name in self._names("log"):
                if int(name.split("=")[1]) < number:
                    fs.delete(at(f"log/{name}"), True)
            return counts


def _names(ddl: str) -> list[str]:
    """The names of a schema string's fields; commas inside brackets do not part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].split()[0])
            start = i + 1
    return out


@contextmanager
def single_writer(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold the table's lock file; a second writer fails with FileExistsError. A crashed writer's file is removed by hand."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    lock = hadoop.Path(f"{path.rstrip('/')}/writer.lock")
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(lock.getParent())
    if not fs.createNewFile(lock):
        raise FileExistsError(str(lock))
    try:
        yield
    finally:
        fs.delete(lock, False)
