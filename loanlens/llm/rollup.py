"""Token totals kept up by deltas.

Totals by source, language and tokenizer version are sums, so a change of documents is
a batch of signed rows: +1 document and +n tokens for what is there now, -1 and -n for
what was there before. A batch is summed and written to a folder of its own, and counts
from the moment on at which an entry in the ledger names that folder. The entry is made
by one rename, so a writer that is lost has changed nothing, and a batch that is
delivered again finds its entry, also after it has been folded into another one, and
counts once. Totals are the sum over the folders that the ledger names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def counted(df: DataFrame, tokenizer: str, count: Column, *, key: str = "doc_id") -> DataFrame:
    """One light row per document: key, source, lang, tokenizer, n_tokens. Null texts count 0."""
    return df.select(
        F.col(key).alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("bigint").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Takes back what was counted: the counts are those of the time of insertion."""
    return counts.select(*GROUP, F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """From old counts to new ones, of the same or another tokenizer version."""
    return deletes(before).unionByName(inserts(after))


@dataclass
class Rollup:
    """Stored batches of deltas under ``path``, a folder of the shared store.

    ``ledger/<batch>.json`` names the folder of a batch, the digest of its rows, and with
    ``folds`` the batches that a compacted one stands for, by their digests. Batches are
    committed by one writer at a time for each identifier; the ledger is as long as there
    are batches since the last compaction.
    """

    spark: SparkSession
    path: str

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def entries(self) -> dict[str, dict]:
        """Entries of the ledger by batch, without those that another one stands for."""
        system, folder = self._hadoop("ledger")
        if not system.exists(folder) or not any(s.getPath().getName().endswith(".json") for s in system.listStatus(folder)):
            return {}
        lines = self.spark.read.text(f"{self.path.rstrip('/')}/ledger/*.json").collect()
        found = {e["batch"]: e for e in (json.loads(r.value) for r in lines)}
        folded = {b for e in found.values() for b in e["folds"]}
        return {b: e for b, e in found.items() if b not in folded}

    def _publish(self, entry: dict) -> None:
        system, folder = self._hadoop("ledger")
        system.mkdirs(folder)
        _, draft = self._hadoop(f"ledger/.{uuid.uuid4().hex}")
        _, final = self._hadoop(f"ledger/{entry['batch']}.json")
        out = system.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise ValueError(f"batch {entry['batch']} has been committed by another writer")

    def _stored(self, batch: str, deltas: DataFrame) -> tuple[str, str]:
        """Folder and digest of the summed rows, which are not counted yet."""
        if not batch or batch.startswith((".", "_")) or any(c in batch for c in "/=\\*?{}[]"):
            raise ValueError("a batch needs a name that can be that of a file")
        summed = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        path = f"{self.path.rstrip('/')}/{folder}"
        summed.where("n_docs != 0 OR n_tokens != 0").write.parquet(path)
        rows = self.spark.read.schema(DELTA).parquet(path)
        facts = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
        return folder, f"{facts[0]}:{facts[1] or 0}"

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Stores a batch of signed rows, summed by group, under its identifier; False if it
        was there already, with equal rows. Other rows under a known identifier are an error.

        Hot groups are summed map-side. Groups whose changes cancel out are not kept.
        """
        folder, digest = self._stored(batch, deltas)
        entries = self.entries()
        known = {b: d for e in entries.values() for b, d in e["folds"].items()} | {b: e["digest"] for b, e in entries.items()}
        if batch not in known:
            self._publish({"batch": batch, "folder": folder, "digest": digest, "folds": {}})
            return True
        system, path = self._hadoop(folder)
        system.delete(path, True)
        if known[batch] != digest:
            raise ValueError(f"batch {batch} is stored with other rows")
        return False

    def batches(self) -> DataFrame:
        """All stored deltas that count, with their batch; none for an empty store."""
        parts = [
            self.spark.read.schema(DELTA).parquet(f"{self.path.rstrip('/')}/{e['folder']}").withColumn("batch", F.lit(b))
            for b, e in sorted(self.entries().items())
        ]
        none = self.spark.createDataFrame([], f"{DELTA}, batch string")
        return reduce(DataFrame.unionByName, parts) if parts else none

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens. Nulls of source and lang are groups;
        groups without any document left are not reported."""
        return (
            self.batches()
            .groupBy(*GROUP)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs != 0 OR n_tokens != 0")
        )

    def compact(self, batch: str) -> None:
        """Puts the totals in one batch, whose entry stands for all there are now. They stay
        known, so that a later delivery of one of them counts no more."""
        entries = self.entries()
        folds = {b: d for e in entries.values() for b, d in e["folds"].items()} | {b: e["digest"] for b, e in entries.items()}
        if batch in folds:
            raise ValueError(f"batch {batch} is known already")
        folder, digest = self._stored(batch, self.totals())
        self._publish({"batch": batch, "folder": folder, "digest": digest, "folds": folds})
