"""Which of many keywords a text contains, by an inverted index of their rarest letter runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import storage

#: Letters of a run; shorter keywords are runs of their own length.
RUN = 4


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of size letters; the pattern is empty and looks ahead, so runs overlap."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def _text_runs(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, run) of texts (key, low)."""
    return texts.select("key", F.explode(F.flatten(F.array(*[_runs(F.col("low"), n) for n in sizes]))).alias("run"))


def _normal(keyword: str) -> Column:
    return F.lower(F.trim(keyword))


def containing(rows: DataFrame, text: str, keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """rows with keywords: the sorted distinct keywords that the text contains anywhere, whatever the case.

    Any number of keywords, which never leave the executors. Of each keyword's runs of RUN letters the one that the
    fewest texts hold is looked up, by an equi join; `contains` decides on what it finds. Equal texts are looked up
    once. Null and blank keywords match nothing, null texts hold nothing; a column keywords is replaced.
    """
    words = keywords.select(_normal(keyword).alias("keyword")).where("keyword <> ''").distinct()
    words = storage.saved(words.withColumn("size", F.least(F.length("keyword"), F.lit(RUN))), "keywords")
    sizes = sorted(r["size"] for r in words.select("size").distinct().collect())  # at most RUN
    kept = rows.drop("keywords")
    low = F.lower(F.col(text).cast("string"))
    if not sizes:
        return kept.withColumn("keywords", F.array().cast("array<string>"))
    texts = kept.select(F.md5(low).alias("key"), low.alias("low")).where("low <> ''")
    runs = words.select("keyword", F.explode(F.array_distinct(F.regexp_extract_all("keyword", F.concat(F.lit("(?s)(?=(.{"), F.col("size").cast("string"), F.lit("}))")), F.lit(1)))).alias("run"))
    held = _text_runs(texts, sizes).join(runs.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("uses"))
    rarest = runs.join(held, "run", "left").groupBy("keyword").agg(F.min_by(F.struct("run", "uses"), F.struct(F.coalesce("uses", F.lit(0)), "run")).alias("r"))
    index = storage.saved(rarest.where("r.uses > 0").select("keyword", "r.run"), "keyword-index")  # a keyword with a run that no text has is in none
    once = texts.groupBy("key").agg(F.any_value("low").alias("low"))
    pairs = _text_runs(once, sizes).join(index, "run").groupBy("key").agg(F.collect_set("keyword").alias("candidates"))
    sure = once.join(pairs, "key").select("key", F.array_sort(F.filter("candidates", lambda k: F.contains(F.col("low"), k))).alias("keywords")).where(F.size("keywords") > 0)
    sure = storage.saved(sure, "keyword-hits").withColumnRenamed("keywords", "__keywords")
    both = kept.withColumn("__key", F.md5(low)).join(sure, F.col("__key") == F.col("key"), "left")
    return both.select(*[F.col(f"`{c}`") for c in kept.columns], F.coalesce("__keywords", F.array().cast("array<string>")).alias("keywords"))
