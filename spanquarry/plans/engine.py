"""A facade over a document collection: open, inspect, count, locate, retrieve, prove.

Status codes and the ``complete`` flag follow one convention: a refused pattern never runs, a bounded answer
says that it is bounded.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanquarry.functions.binary import hex_status
from spanquarry.operators import identity, index, match
from spanquarry.sources import corpus as sources


class Collection:
    def __init__(self, spark: SparkSession, corpus: DataFrame):
        self.spark, self.corpus = spark, corpus

    @classmethod
    def from_directory(cls, spark: SparkSession, root: str) -> Collection:
        return cls(spark, sources.from_directory(spark, root))

    @classmethod
    def from_table(cls, table: DataFrame, id_col: str, text_col: str) -> Collection:
        return cls(table.sparkSession, sources.from_table(table, id_col, text_col))

    def info(self) -> dict:
        row = self.corpus.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes")).first()
        return row.asDict()

    def document(self, doc_id: int) -> dict | None:
        row = sources.manifest(self.corpus.filter(F.col("doc_id") == doc_id)).first()
        return row.asDict() if row else None

    def patterns(self, hexes: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(hexes)), "query_id bigint, hex string")
        return rows.withColumn("status", hex_status(F.col("hex"))).withColumn("pattern", F.when(F.col("status") == "OK", F.unhex("hex")))

    def query(self, hexes: list[str], most: int = 100) -> DataFrame:
        """A row a pattern with status, counts and the bounded, complete flags; refused patterns have no counts."""
        given = self.patterns(hexes)
        found = match.query_result(self.corpus, given.filter("status = 'OK'"), most)
        return given.select("query_id", "hex", "status").join(found, "query_id", "left")

    def locate(self, hexes: list[str], most: int = 100) -> DataFrame:
        return match.locate_bounded(self.corpus, self.patterns(hexes).filter("status = 'OK'"), most)

    def lines(self, hexes: list[str], most: int = 100) -> list[str]:
        """Answers in the line protocol: OK, total, returned, bounded and offsets, or ERR and the reason."""
        offsets = self.locate(hexes, most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "doc_offset"))).alias("at"))
        rows = self.query(hexes, most).join(offsets, "query_id", "left").orderBy("query_id").collect()
        out = []
        for r in rows:
            if r["status"] != "OK":
                out.append(f"ERR\t{r['status']}")
            else:
                at = ",".join(f"{x['doc_id']}:{x['doc_offset']}" for x in r["at"] or [])
                out.append(f"OK\t{r['match_count']}\t{r['returned_count']}\t{int(r['bounded'])}\t{at}")
        return out

    def json(self, hexes: list[str], most: int = 100) -> str:
        rows = self.query(hexes, most).orderBy("query_id").collect()
        return json.dumps({"results": [r.asDict() for r in rows]}, sort_keys=True, separators=(",", ":"))

    def build(self, path: str, step: int = 32) -> dict[str, DataFrame]:
        from spanquarry.sources.containers import read_index, write_index

        tables = index.build(self.corpus, step)
        write_index(tables, path)
        return read_index(self.spark, path, list(tables))

    def run(self, hexes: list[str], out: str, most: int = 100) -> dict:
        """Snapshot, query, evidence and replay in one go; the evidence is written, then checked from what was written."""
        records = sources.manifest(self.corpus)
        records.write.parquet(f"{out}/manifest")
        wanted = self.patterns(hexes).filter("status = 'OK'")
        found = match.locate(self.corpus, wanted)
        identity.evidence(self.corpus, wanted, found).write.parquet(f"{out}/evidence")
        kept = self.spark.read.parquet(f"{out}/evidence")
        problems = identity.replay(self.corpus, wanted, kept).count()
        changed = sources.verify(self.corpus, self.spark.read.parquet(f"{out}/manifest")).count()
        return {"identity": identity.corpus_identity(self.corpus).first()["identity"], "rows": kept.count(), "problems": problems, "changed": changed, "complete": problems == 0 and changed == 0}
