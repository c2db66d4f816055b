"""Pages, counts, statistics, keyword counts, ranges and timelines over a scoped asset table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery import storage
from loomery.functions import dates, text
from loomery.operators.keywords import containing


def _keys(sort: str, row_id: str, descending: bool, pinned: str | None) -> list[tuple[str, Column, bool]]:
    """(name, column, whether it goes down) of the keys of a page order."""
    first = [(pinned, F.coalesce(F.col(pinned).cast("boolean"), F.lit(False)), True)] if pinned else []
    return first + [(c, F.col(c), descending) for c in (sort, row_id)]


def _ordered(rows: DataFrame, keys: list[tuple[str, Column, bool]]) -> DataFrame:
    return rows.orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_first() for _, c, down in keys])


def page(rows: DataFrame, sort: str, row_id: str, *, descending: bool = True, pinned: str | None = None, cursor: dict | None = None, limit: int = 1000) -> DataFrame:
    """One keyset page ordered by (pinned desc,) sort, id. cursor is the last row of the page before.

    Null sort values come last in descending and first in ascending order, and a cursor may hold
    one: every row is on one page. The cursor is a filter and the order a top-k, so no page is
    sorted whole or skipped over.
    """
    keys = _keys(sort, row_id, descending, pinned)
    if cursor is not None:
        after, same = F.lit(False), F.lit(True)
        for name, column, down in keys:
            value = bool(cursor[name]) if name == pinned else cursor[name]
            if value is None:
                beyond, equal = F.lit(False) if down else column.isNotNull(), column.isNull()
            else:
                held = dates.moment(value) if isinstance(value, datetime) else F.lit(value)
                beyond = (column < held) | column.isNull() if down else column > held
                equal = column == held
            after = after | (same & F.coalesce(beyond, F.lit(False)))
            same = same & F.coalesce(equal, F.lit(False))
        rows = rows.filter(after)
    return _ordered(rows, keys).limit(limit)


def pages(rows: DataFrame, sort: str, row_id: str, limit: int, **options) -> Iterator[list[Row]]:
    """All pages one after the other."""
    cursor = None
    while found := page(rows, sort, row_id, cursor=cursor, limit=limit, **options).collect():  # one page
        yield found
        cursor = found[-1].asDict()


def paged(rows: DataFrame, sort: str, row_id: str, limit: int, *, descending: bool = True, pinned: str | None = None) -> DataFrame:
    """rows with page and place, both from 0: all pages of the walk at once, without a scan for each and without the driver.

    Rows are sorted range by range and saved; the place of a row is the count of the ranges before and that
    within its range.
    """
    order = _ordered(rows, _keys(sort, row_id, descending, pinned))
    order = storage.saved(order.withColumn("__place", F.monotonically_increasing_id()), "paged")
    part = F.shiftright("__place", 33)
    sizes = order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r.part, before))
        before += r.n
    parts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part long, __before long"))
    n = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1)
    return order.join(parts, part == F.col("__part")).select(*rows.columns, ((n - n % limit) / limit).cast("long").alias("page"), (n % limit).cast("int").alias("place"))


def media_stats(rows: DataFrame, conditions: dict[str, Column], size: str, row_id: str | None = None) -> DataFrame:
    """One row: total, the count under each condition, and the sum of size (0 if there are no rows). With row_id an
    asset that a join brought several times counts once."""
    if row_id is not None:
        rows = rows.dropDuplicates([row_id])
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return rows.agg(F.count("*").alias("total"), *counts, F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))


def mean_positive(rows: DataFrame, column: str) -> DataFrame:
    """Rounded half up mean of the positive values, 0 if there are none."""
    return rows.filter(F.col(column) > 0).agg(F.coalesce(text.half_up(F.avg(column)), F.lit(0)).cast("long").alias("mean"))


def histogram(rows: DataFrame, name: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(name, F.lit("Unknown")).alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")


def keyword_counts(rows: DataFrame, prompt: str, top: int = 40) -> DataFrame:
    """The most frequent words of over three letters, without stop words and numbers; ties by word."""
    words = F.split(F.regexp_replace(F.lower(prompt), r"[^a-z0-9\s]", ""), r"\s+")
    # words are counted first: stop words and numbers are then looked for once for each distinct word
    counts = rows.select(F.explode(words).alias("text")).filter(F.length("text") > 3).groupBy("text").agg(F.count("*").alias("value"))
    return counts.filter(~F.col("text").isin(text.STOP_WORDS) & ~F.col("text").rlike("^[0-9]+$")).orderBy(F.desc("value"), "text").limit(top)


def ranges(rows: DataFrame, columns: list[str]) -> DataFrame:
    """min_x and max_x of every column, whatever filters apply elsewhere."""
    return rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value) of the distinct non-empty values of every column, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.*").filter("value is not null and value <> ''").distinct().orderBy("field", "value")


def counters(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """All conditional counts in one scan, as one row."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def counts_long(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(name, count) of many predicates from a single scan."""
    wide = counters(rows, {f"c{i}": c for i, c in enumerate(conditions.values())})
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("count")) for i, n in enumerate(conditions)]))
    return wide.select(pairs.alias("p")).select("p.*")


def timeline(rows: DataFrame, stamp: str, now: datetime) -> DataFrame:
    """(bucket, start, count): days for the last 30, months before; newest first."""
    midnight = datetime(now.year, now.month, now.day)
    recent = F.col(stamp) >= dates.moment(midnight - timedelta(days=30))
    start = F.when(recent, F.date_trunc("day", stamp)).otherwise(F.date_trunc("month", stamp))
    label = F.when(start == dates.moment(midnight), "today").when(recent & (start == dates.moment(midnight - timedelta(days=1))), "yesterday").when(recent, F.date_format(start, "yyyy-MM-dd")).otherwise(F.date_format(start, "yyyy-MM"))
    return rows.groupBy(label.alias("bucket"), start.alias("start")).agg(F.count("*").alias("count")).orderBy(F.desc("start"))


def best_key(rows: DataFrame, order: list[tuple[str, bool]]) -> Column:
    """A struct that is smallest in the first row of an order of (column, descending): for min_by, which is
    combined before the shuffle, where a ranking window would bring all rows of a key into one task.

    Nulls come last in descending and first in ascending order. Strings can only ascend.
    """
    parts = []
    for name, down in order:
        column, kind = F.col(name), rows.schema[name].dataType
        if down:
            parts.append(column.isNull())
            if isinstance(kind, T.BooleanType):
                column = ~column
            elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
                column = -F.unix_micros(column.cast("timestamp"))
            elif isinstance(kind, T.DateType):
                column = -F.unix_date(column)
            elif isinstance(kind, T.NumericType):
                column = -column
            else:
                raise ValueError(f"{name} cannot be sorted down")
        parts.append(column)
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def first_by(rows: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """The first row of every key; order should end in a unique column."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), best_key(rows, order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in others])


def token_matches(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """names with flagged: whether the name holds any keyword (a table of one column keyword), whatever the case."""
    found = containing(names, "name", keywords)
    return found.select(*names.columns, (F.size("keywords") > 0).alias("flagged"))


def prefix_count(rows: DataFrame, path: str, folder: str) -> DataFrame:
    """How many paths lie below a folder, with either kind of slash; its name is literal, whatever the case."""
    bare = folder.rstrip("/\\").lower()
    low = F.lower(path)
    return rows.agg(F.count_if(low.startswith(f"{bare}/") | low.startswith(f"{bare}\\")).alias("count"))
