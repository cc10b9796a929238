"""Ordered scans: windows, prefixes, cursors, reverse, pages, continuation tokens."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.keys import decode_token, encode_token, prefix_successor

PAGE, LARGEST_PAGE = 1000, 1000


@dataclass(frozen=True)
class ScanQuery:
    """start <= key < end, and prefix; after is exclusive in the direction of the scan; limit <= 0 stands for 1000."""

    prefix: str = ""
    start: str | None = None
    end: str | None = None
    after: str | None = None
    reverse: bool = False
    limit: int = 0

    @property
    def size(self) -> int:
        return self.limit if self.limit > 0 else PAGE

    def predicate(self, key: str = "key") -> Column:
        """Comparisons alone, which the Parquet scan takes as filters. The prefix is a range as well where its successor
        is text, so that files sorted by key are skipped from both ends."""
        k, out = F.col(key), F.lit(True)
        lows, ends = [x for x in (self.start,) if x is not None], [x for x in (self.end,) if x is not None]
        if self.prefix:
            out &= F.startswith(k, F.lit(self.prefix))
            lows.append(self.prefix)
            above = prefix_successor(self.prefix.encode())
            try:
                ends += [above.decode()] if above else []
            except UnicodeDecodeError:
                pass
        if lows:
            out &= k >= max(lows, key=str.encode)
        if ends:
            out &= k < min(ends, key=str.encode)
        if self.after is not None:
            out &= (k < self.after) if self.reverse else (k > self.after)
        return out


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next: str | None  # last key returned, if one more live row remains


def scan(view: DataFrame, query: ScanQuery, key: str = "key") -> DataFrame:
    """All rows of the window in order, without a limit."""
    return view.where(query.predicate(key)).orderBy(F.col(key).desc() if query.reverse else F.col(key).asc())


def bounded(view: DataFrame, query: ScanQuery, key: str = "key") -> DataFrame:
    """The page as a DataFrame: each task keeps its first rows, one merges them."""
    return scan(view, query, key).limit(query.size)


def page(view: DataFrame, query: ScanQuery, key: str = "key") -> Page:
    """One page on the driver, with a look ahead of one row."""
    rows = scan(view, query, key).limit(query.size + 1).collect()
    more = len(rows) > query.size
    rows = rows[: query.size]
    return Page(rows, rows[-1][key] if more else None)


def pages(view: DataFrame, query: ScanQuery, key: str = "key"):
    """All pages, one after the other."""
    while True:
        got = page(view, query, key)
        yield got
        if got.next is None:
            return
        query = replace(query, after=got.next)


def paged(view: DataFrame, size: int, key: str = "key") -> DataFrame:
    """view with page (from 1): all pages of so many rows in order of key, as one plan. Ranges of keys are numbered each
    by itself and shifted by the rows before them, a row a range."""
    ranges = view.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    sized = ranges.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    n = sized.groupBy("_part").agg(F.count("*").alias("_n"))
    before = n.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = sized.join(F.broadcast(before.drop("_n")), "_part")
    return out.withColumn("page", F.ceil((F.col("_b") + F.col("_r")) / size)).drop("_part", "_r", "_b")


def clamped(text: Column, uploads: bool = False) -> Column:
    """Page size of each request: 1000 if missing, kept within 1 .. 1000. No number: 1000, or null (an error) for upload
    listings, where less than 1 is 1000 too."""
    n = text.try_cast("int")
    if uploads:
        return F.when(text.isNull(), PAGE).when(n.isNotNull(), F.when(n < 1, PAGE).otherwise(F.least(n, F.lit(LARGEST_PAGE))))
    return F.when(text.isNull() | n.isNull(), PAGE).otherwise(F.greatest(F.least(n, F.lit(LARGEST_PAGE)), F.lit(1)))


def dashboard_clamped(n: Column) -> Column:
    """Page size of the dashboard: 100 outside 1 .. 1000."""
    return F.when((n >= 1) & (n <= LARGEST_PAGE), n).otherwise(100)


def page_size(text: str | None) -> int:
    """Page size of a request: 1000 if missing or no number, kept within 1 .. 1000."""
    try:
        return min(max(int(text or PAGE), 1), LARGEST_PAGE)
    except ValueError:
        return PAGE


def dashboard_size(n: int) -> int:
    return n if 1 <= n <= LARGEST_PAGE else 100


def resume(start_after: str | None = None, token: str | None = None) -> str | None:
    """Where a listing goes on: the token beats start_after."""
    return decode_token(token) if token else start_after


def token(got: Page) -> str | None:
    return encode_token(got.next) if got.next is not None else None


def sorted_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By any column, nulls last in both directions."""
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last())
