"""An index of prompts: postings with positions in partitions by word, kept up by segments.

A search for a phrase is exact on letters (see search.contains): its first word may be the end of a prompt's word,
its last one the beginning, a single one any part. The index finds the prompts whose words stand next to each other
like that; `contains` on these prompts decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery import storage
from loomery.operators.search import contains

_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


class PromptIndex:
    """Below path: postings/segment=S/bucket=B (word, id, positions), words/segment=S (word, bucket), gone/segment=S (id).

    A segment holds the prompts that were added together; ids in gone of a segment are no longer those of earlier
    ones. An id is a string; an asset without a prompt is in no posting.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def segments(self) -> int:
        n = 0
        while storage._exists(self.spark, f"{self.path}/words/segment={n}/_SUCCESS"):
            n += 1
        return n

    def add(self, rows: DataFrame, row_id: str, prompt: str) -> None:
        """Adds assets, or replaces those that are there; the list of words comes last and makes the segment count."""
        s = self.segments()
        rows = rows.select(F.col(row_id).cast("string").alias("id"), F.col(prompt).cast("string").alias("prompt"))
        rows.select("id").write.mode("overwrite").parquet(f"{self.path}/gone/segment={s}")
        found = rows.select("id", F.posexplode(_words(F.col("prompt"))).alias("at", "word"))
        postings = found.groupBy("word", "id").agg(F.sort_array(F.collect_list("at")).alias("positions"))  # as many as the prompt's words
        postings = postings.withColumn("bucket", self._bucket(F.col("word")))
        dealt = postings.repartition("bucket").sortWithinPartitions("word")
        dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings/segment={s}")
        words = self.spark.read.schema("word string, bucket int").parquet(f"{self.path}/postings/segment={s}").distinct()
        words.write.mode("overwrite").parquet(f"{self.path}/words/segment={s}")

    def remove(self, ids: DataFrame, row_id: str) -> None:
        self.add(ids.select(row_id, F.lit(None).cast("string").alias("__none")), row_id, "__none")

    def _read(self, table: str, schema: str) -> DataFrame:
        n = self.segments()
        paths = [f"{self.path}/{table}/segment={s}" for s in range(n)]
        return self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def postings(self, match: Column, exact: str | None = None) -> DataFrame:
        """(id, positions, segment) of the words that match. Only the partitions of such words are read: that of one exact
        word, which is known when the query is planned, or those that the list of words names."""
        rows = self._read("postings", "word string, id string, positions array<int>, bucket int")
        if exact is not None:
            rows = rows.where(F.col("bucket") == self._bucket(F.lit(exact)))
        else:
            words = self._read("words", "word string, bucket int").where(match).select("bucket").distinct()
            rows = rows.where(F.col("bucket").isin(sorted(r.bucket for r in words.collect())))  # at most as many as there are
        return rows.where(match).select("id", "positions", "segment")

    def candidates(self, phrase: str) -> DataFrame | None:
        """(id) of the prompts that have the phrase's words next to each other; None if it has no word."""
        low = phrase.lower()
        words = re.findall(_WORD, low)
        if not words:
            return None
        found = None
        for i, word in enumerate(words):
            # at an edge of the phrase a word goes on unless a separator stands there
            begins = i > 0 or not low.startswith(word)
            ends = i < len(words) - 1 or not low.endswith(word)
            column = F.col("word")
            match = (column == word) if begins and ends else column.startswith(word) if begins else column.endswith(word) if ends else F.contains(column, F.lit(word))
            at = self.postings(match, word if begins and ends else None).select("id", "segment", F.explode("positions").alias("at")).select("id", "segment", (F.col("at") - i).alias("start")).distinct()
            found = at if found is None else found.join(at, ["id", "segment", "start"])
        gone = self._read("gone", "id string").groupBy("id").agg(F.max("segment").alias("last"))
        return found.select("id", "segment").distinct().join(gone, "id").where("segment >= last").select("id").distinct()

    def search(self, assets: DataFrame, row_id: str, prompt: str, phrase: str) -> DataFrame:
        """assets whose prompt contains the phrase; without a word in it all prompts are looked at."""
        ids = self.candidates(phrase)
        some = assets if ids is None else assets.join(ids.select(F.col("id").alias("__id")), F.col(row_id).cast("string") == F.col("__id"), "left_semi")
        return some.where(contains(F.col(prompt), phrase))
