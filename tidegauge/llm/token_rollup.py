"""Token counts kept as totals that signed changes maintain.

Changes come in numbered batches. A batch turns into signed ledger rows: an insert adds a document's
tokens, a delete takes back what it had, a revision takes back the old count and adds the new one,
under the tokenizer version that made it. Totals by source, language and version are sums of the
batches' own sums, so no batch recounts what it does not touch.

Every batch is written to folders of its number and counts once its commit is written. A batch that
is sent again after its commit changes nothing; one that failed half way replaces what it left.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm.tables import numbered, spelled

KEYS = ("source", "lang", "version")
LEDGER = "doc_id long, sign int, source string, lang string, version string, tokens long"
BROADCAST_ROWS = 1 << 20
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"

Counter = Callable[[], Callable[[str], int]]


def byte_pair_counter(ranks_path: str, pattern: str) -> Counter:
    """A counter of tokens by the byte-pair ranks in a file that every worker can open."""
    def make() -> Callable[[str], int]:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks,
                                     special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return make


class TokenRollup:
    """Totals in a folder that all executors share.

    Changes have the columns doc_id, seq, op (insert, revise or delete), source, lang, version, text;
    others are not read. Of several changes of one document in a batch the one with the largest seq
    counts (ties: the largest op, source, language, version and number of tokens, in this order). An insert of a known document is a revision, a delete
    of an unknown one does nothing. A NULL id is one document; NULL sources, languages and versions
    are groups of their own; a NULL or empty text has 0 tokens but is a document. An empty batch
    commits. Batches are committed in rising order.
    """

    def __init__(self, spark: SparkSession, root: str, counters: Mapping[str, Counter]) -> None:
        self.spark = spark
        self.root = root
        self.counters = dict(counters)
        spark.createDataFrame([], "batch long").write.mode("ignore").parquet(f"{root}/commits/none")

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/{batch:012d}"

    def committed(self) -> list[int]:
        """Numbers of the batches that count: as many as there were batches, whatever their size."""
        commits = (self.spark.read.schema("batch long").option("recursiveFileLookup", "true")
                   .parquet(f"{self.root}/commits"))
        return sorted(r.batch for r in commits.distinct().collect())

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [self._folder(kind, b) for b in self.committed()]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def live(self, touched: DataFrame | None = None) -> DataFrame:
        """The documents that count now, with their tokens; or only those ``touched (changed)``.

        The ledger's rows are picked before they are grouped, so a commit regroups what it changes.
        """
        rows = self._read("ledger", LEDGER)
        if touched is not None:
            if touched.count() <= BROADCAST_ROWS:
                touched = F.broadcast(touched)
            rows = rows.join(touched, F.col("doc_id").eqNullSafe(F.col("changed")), "left_semi")
        rows = rows.groupBy("doc_id", *KEYS, "tokens")
        return rows.agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version, where any are left."""
        rows = self._read("sums", SUMS).groupBy(*KEYS)
        return (rows.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .filter("n_docs <> 0 OR n_tokens <> 0"))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        self._signed(changes, batch).write.mode("overwrite").parquet(self._folder("ledger", batch))
        rows = self.spark.read.schema(LEDGER).parquet(self._folder("ledger", batch))
        sums = rows.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("n_docs"),
            F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        sums.write.mode("overwrite").parquet(self._folder("sums", batch))
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode(
            "overwrite").parquet(self._folder("commits", batch))
        return True

    def _signed(self, changes: DataFrame, batch: int) -> DataFrame:
        counted = self._counted(changes)
        # Narrow rows only: the texts have been counted where they were read.
        counted.groupBy("doc_id").agg(
            F.max_by(F.struct("op", *KEYS, "tokens"), F.struct("seq", "op", *KEYS, "tokens")).alias("c")
        ).write.mode("overwrite").parquet(self._folder("changes", batch))
        last = self.spark.read.parquet(self._folder("changes", batch))
        new = last.filter("c.op <> 'delete'").select(
            "doc_id", F.lit(1).alias("sign"), *[f"c.{k}" for k in KEYS], "c.tokens")
        if not self.committed():
            return new
        old = self.live(last.select(F.col("doc_id").alias("changed")))
        return old.select("doc_id", F.lit(-1).alias("sign"), *KEYS, "tokens").unionByName(new)

    def _counted(self, changes: DataFrame) -> DataFrame:
        counters = self.counters

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made: dict[str, Callable[[str], int]] = {}

            def tokens(version: str, text: str | None) -> int:
                if not text:
                    return 0
                if version not in made:
                    made[version] = counters[version]()
                return made[version](text)

            for batch in batches:
                batch["tokens"] = [0 if o == "delete" else tokens(v, t) for o, v, t in
                                   zip(batch["op"], batch["version"], batch["text"])]
                yield batch.drop(columns="text")

        narrow = changes.select(
            spelled("doc_id")[0].alias("doc_id"), spelled("seq")[0].alias("seq"),
            F.coalesce("op", F.lit("insert")).alias("op"), *KEYS,
            F.when(F.col("op") == "delete", None).otherwise(F.col("text")).alias("text"))
        return numbered(narrow.mapInPandas(
            rows, "doc_id string, seq string, op string, source string, lang string, version string, "
                  "tokens long"), "doc_id", "seq")
