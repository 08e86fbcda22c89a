"""Token counts kept as additive totals under inserts, deletes and revised counts.

A store is a folder with tables cut by batch: ``ledger`` (what a batch says of each document and
tokenizer version, in parts by a hash of doc_id), ``deltas`` (signed sums by source, language and tokenizer version) and ``commits``
(a marker per batch). A commit reads only the ledger's parts that its documents fall in, and only what came after the last
``snapshot``, which ``compact`` makes of the state of all live documents, with a marker of its own. A batch's deltas retract what the ledger last said of its documents and add what
the batch says. Totals are the sums of the committed deltas, so reading them never touches documents. A
batch without a marker doesn't count: if its commit is cut short, committing it again overwrites its
files; committing a batch that has its marker changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


class RollupStore:
    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        """``parts``: of the ledger, fixed for a store; as many as the tasks that are to write a batch at once."""
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _marks(self, kind: str) -> tuple[object, object]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def _marked(self, kind: str) -> list[int]:
        fs, root = self._marks(kind)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(root)) if fs.exists(root) else []

    def committed(self) -> list[int]:
        """Ids of the committed batches, ascending."""
        return self._marked("commits")

    def _mark(self, batch: int, kind: str = "commits") -> None:
        fs, root = self._marks(kind)
        fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, str(batch)), True).close()

    def _read(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        kind = T.StructType.fromDDL(f"{schema}, batch long")
        if not batches:
            return self.spark.createDataFrame([], kind)
        parts = [f"{self.path}/{table}/batch={b}" for b in batches]
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/{table}").parquet(*parts)

    def _ledger(self) -> DataFrame:
        """What the committed batches say, from the last snapshot on."""
        last = self._marked("compacted")[-1:]
        later = self._read("ledger", f"{LEDGER}, part int", [b for b in self.committed() if not last or b > last[0]])
        return self._read("snapshot", f"{LEDGER}, part int", last).unionByName(later) if last else later

    def _write_ledger(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        where = f"{self.path}/{table}/batch={batch}"
        part = F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")
        rows.withColumn("part", part).repartitionById(self.parts, F.col("part")).write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(f"{LEDGER}, part int").parquet(where)

    def compact(self) -> None:
        """Write the live documents' state as a snapshot. Totals don't change; later commits read no batch before it. Doing it again changes nothing."""
        done, last = self.committed(), self._marked("compacted")[-1:]
        if done and done[-1:] != last:
            state = F.struct("live", "n_tokens", "source", "lang")
            rows = self._ledger().groupBy("doc_id", "tokenizer").agg(F.max_by(state, "batch").alias("s")).where("s.live")
            self._write_ledger(rows.select("doc_id", "tokenizer", "s.source", "s.lang", "s.n_tokens", "s.live"), "snapshot", done[-1])
            self._mark(done[-1], "compacted")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch: rows (doc_id, tokenizer, source, lang, n_tokens, op), op 'put' (insert or revise) or 'delete'. Other columns are ignored.

        Returns whether anything was done: a batch that is committed already is left alone. Batches are
        numbered upwards; an older number than the last committed is refused. A delete of what isn't there
        changes nothing. A null n_tokens counts as 0; null sources, languages and tokenizers are groups of
        their own. Of rows that repeat doc_id and tokenizer in a batch one counts: a delete before a put,
        then the greatest count. Rows with a null doc_id are added each, and can't be revised or deleted.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        said = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), (F.col("op") != "delete").alias("live"))
        known = said.where("doc_id IS NOT NULL")
        state = F.struct("live", "n_tokens", "source", "lang")
        rank = F.struct((~F.col("live")).alias("gone"), F.col("n_tokens").alias("n_tokens"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
        now = known.groupBy("doc_id", "tokenizer").agg(F.max_by(state, rank).alias("s")).select("doc_id", "tokenizer", "s.source", "s.lang", "s.n_tokens", "s.live")
        now = self._write_ledger(now, "ledger", batch)
        signed = now.where("live").select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))
        if done:
            touched = [r.part for r in now.select("part").distinct().collect()]  # at most ``parts`` numbers
            old, new = self._ledger().where(F.col("part").isin(touched)).alias("l"), now.select("doc_id", "tokenizer").alias("n")
            met = old.join(new, (F.col("l.doc_id") == F.col("n.doc_id")) & F.col("l.tokenizer").eqNullSafe(F.col("n.tokenizer")), "left_semi")
            last = met.groupBy("doc_id", "tokenizer").agg(F.max_by(state, "batch").alias("s")).where("s.live")
            signed = signed.unionByName(last.select("s.source", "s.lang", "tokenizer", F.lit(-1).cast("long").alias("docs"), (-F.col("s.n_tokens")).alias("tokens")))
        loose = said.where("doc_id IS NULL AND live").select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))
        deltas = signed.unionByName(loose).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        deltas.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/deltas/batch={batch}")
        self._mark(batch)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of the documents that are live; groups without documents are left out."""
        sums = self._read("deltas", DELTAS, self.committed()).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")


def spaced_words(text: str) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plain_words(text: str) -> Column:
    """Number of runs of ASCII letters and digits; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[A-Za-z0-9]+")), F.lit(0)).cast("long")
