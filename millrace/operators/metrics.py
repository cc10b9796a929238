"""Metric samples: text exposition in and out, last-N windows, series merged by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import escape_label, unescape_label

KEEP = 60
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?$"
LABEL = r'([^=,{}\s]+)\s*=\s*"((?:[^"\\]|\\.)*+)"'


def parse(lines: Column) -> Column:
    """struct<name, labels, v> of a line of text exposition; null for comments, blanks, malformed and non-finite lines.
    A time stamp behind the value is left out."""
    t = F.trim(F.regexp_replace(lines, r"^\s+|\s+$", ""))
    name = F.regexp_extract(t, r"^([^ \t{]+)", 1)
    braces = F.substring(t, F.length(name) + 1, F.lit(1)) == "{"
    inside = F.regexp_extract(t, r"^[^ \t{]+\{([^}]*)\}", 1)
    closed = t.rlike(r"^[^ \t{]+\{[^}]*\}")
    rest = F.when(braces, F.regexp_replace(t, r"^[^ \t{]+\{[^}]*\}", "")).otherwise(F.substring(t, F.length(name) + 1, F.length(t)))
    token = F.regexp_extract(rest, r"^\s*(\S+)", 1)
    value = F.when(token.rlike(NUMBER), F.regexp_replace(token, "[dDfF]$", "").try_cast("double"))
    keys, values = F.regexp_extract_all(inside, F.lit(LABEL), F.lit(1)), F.regexp_extract_all(inside, F.lit(LABEL), F.lit(2))
    # of a repeated label the last counts
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("i")), lambda x: x["k"].isNotNull())
    last = F.filter(last, lambda x: ~F.exists(F.slice(keys, x["i"] + 1, F.size(keys)), lambda k: k == x["k"]))
    labels = F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: unescape_label(x["v"])))
    fine = (t != "") & ~F.startswith(t, F.lit("#")) & (name != "") & (~braces | closed) & value.isNotNull() & (F.abs(value) < float("inf"))
    return F.when(fine, F.struct(name.alias("name"), F.when(braces, labels).otherwise(F.create_map().cast("map<string,string>")).alias("labels"), value.alias("v")))


def samples(texts: DataFrame) -> DataFrame:
    """t, target, name, labels, v from (target, t, body): every sample takes the time of its scrape."""
    each = texts.select("t", "target", F.explode(F.split("body", "\n")).alias("line")).select("t", "target", parse(F.col("line")).alias("s"))
    return each.where("s is not null").select("t", "target", "s.*")


def exposition(rows: DataFrame, name: Column, labels: list[str], value: Column) -> DataFrame:
    """line: name{label="value",...} value."""
    pairs = [F.concat(F.lit(f'{c}="'), escape_label(F.col(c).cast("string")), F.lit('"')) for c in labels]
    return rows.select(F.concat(name, F.lit("{"), F.concat_ws(",", *pairs), F.lit("} "), value.cast("string")).alias("line"))


def last_n(rows: DataFrame, series: list[str], order: list[str], n: int = KEEP) -> DataFrame:
    """The newest n rows of each series, with place: 1 is the oldest kept."""
    w = Window.partitionBy(*series)
    newest = rows.withColumn("_r", F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_r") <= n)
    return newest.withColumn("place", F.row_number().over(w.orderBy(*order))).drop("_r")


def window_seconds(n: int, interval_millis: int) -> float:
    return n * interval_millis / 1000


def series_for(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named metrics; a name without samples is one row of nulls."""
    asked = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(names)], "name string")
    return F.broadcast(asked).join(rows.where(F.col("name").isin(names)), "name", "left")


def merged(rows: DataFrame) -> DataFrame:
    """All label sets of a name as one line, by time: name, t, v."""
    return rows.select("name", "t", "v").orderBy("name", "t")
