"""Bytes of objects: chunks with checksums, byte ranges, multipart parts and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import crc32c_fast

CHUNK = 1 << 20
MIN_PART, MAX_PARTS = 5 << 20, 10_000


def chunks(objects: DataFrame, blob: str, data: str, size: int = CHUNK, checksums: bool = True) -> DataFrame:
    """blob, entry_id, data, crc: fixed chunks of a binary column; an empty object has none."""
    octets = F.col(data).cast("binary")
    n = F.ceil(F.octet_length(octets) / size).cast("int")
    some = objects.where(F.octet_length(octets) > 0).select(F.col(blob).alias("blob"), octets.alias("_b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("entry_id"))
    out = some.select("blob", "entry_id", F.substring("_b", F.col("entry_id") * size + 1, F.lit(size)).alias("data"))
    return out.withColumn("crc", crc32c_fast(F.col("data"))) if checksums else out


def chunk_layout(objects: DataFrame, blob: str, length: Column, size: int) -> DataFrame:
    """blob, entry_id, at, len of the chunks, from lengths alone."""
    some = objects.select(F.col(blob).alias("blob"), length.cast("bigint").alias("_n")).where("_n > 0")
    each = some.select("blob", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / size))).alias("entry_id"))
    return each.select("blob", "entry_id", (F.col("entry_id") * size).alias("at"), F.least(F.lit(size).cast("bigint"), F.col("_n") - F.col("entry_id") * size).alias("len"))


def segments(stored: DataFrame, per_blob: int) -> DataFrame:
    """Rolls chunks (blob, entry_id) into blob files of so many entries: blob, segment, first, last."""
    return stored.groupBy("blob", F.floor(F.col("entry_id") / per_blob).alias("segment")).agg(F.min("entry_id").alias("first"), F.max("entry_id").alias("last"))


def read_segments(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """refs (object, seq, blob, first, last) joined with their chunks: an equi join, the entries exploded."""
    each = refs.withColumn("entry_id", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return each.join(stored, ["blob", "entry_id"])


def reassemble(stored: DataFrame, by: str | tuple[str, ...] = "blob", order: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """by, data: the chunks of each object in order. An object is one row, as it is wherever it is read."""
    keys = [by] if isinstance(by, str) else list(by)
    return stored.groupBy(*keys).agg(F.expr(f"listagg(data, X'') WITHIN GROUP (ORDER BY {', '.join(order)})").alias("data"))


def damaged(stored: DataFrame) -> DataFrame:
    """Chunks whose checksum is not that of their bytes."""
    return stored.where(crc32c_fast(F.col("data")) != F.col("crc").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def sound(data: Column, crc: Column, expected: Column) -> Column:
    """The bytes of a chunk; an error if it is missing, of another length than expected, or damaged."""
    wrong = F.when(data.isNull(), "missing chunk").when(F.octet_length(data) != expected, "chunk of a wrong length").when(crc32c_fast(data) != crc, "damaged chunk")
    return F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(data)


def audit(parts: DataFrame, stored: DataFrame) -> DataFrame:
    """blob, part_number, status of each part (blob, part_number, len, chunk, crc) held against the chunks stored: ok,
    missing (a chunk is not there), length, chunk (a chunk's checksum is not that of its bytes) or part (the part's)."""
    n = F.greatest(F.ceil(F.col("len") / F.col("chunk")), F.lit(0)).cast("bigint")
    want = parts.where("len > 0").withColumn("entry_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    got = stored.select("blob", F.col("entry_id").cast("bigint").alias("entry_id"), "data", F.col("crc").alias("chunk_crc"))
    both = want.join(got, ["blob", "entry_id"], "left")
    length = F.least(F.col("chunk").cast("bigint"), F.col("len") - F.col("entry_id") * F.col("chunk"))
    keys = ["blob", "part_number"]
    found = both.groupBy(*keys).agg(
        F.bool_or(F.col("data").isNull()).alias("missing"), F.bool_or(F.octet_length("data") != length).alias("length"), F.bool_or(crc32c_fast(F.col("data")) != F.col("chunk_crc")).alias("chunk"),
        F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY entry_id)").alias("whole"), F.first("crc").alias("crc"),
    )
    status = F.when(F.col("missing"), "missing").when(F.col("length"), "length").when(F.col("chunk"), "chunk").when(crc32c_fast(F.col("whole")) != F.col("crc"), "part").otherwise("ok")
    empty = parts.where("len = 0").select(*keys, F.when(F.col("crc") == 0, "ok").otherwise("part").alias("status"))
    return found.select(*keys, status.alias("status")).union(empty)


def resolve_range(first: Column, last: Column, total: Column) -> tuple[Column, Column]:
    """Inclusive (from, to) of a request: last < 0 is open-ended, first < 0 the last so many bytes (in last); overhang is
    clamped; both null if the range cannot be satisfied."""
    suffix = first < 0
    low = F.when(suffix, F.greatest(F.lit(0).cast("bigint"), total - last)).otherwise(first)
    high = F.when(suffix | (last < 0), total - 1).otherwise(F.least(last, total - 1))
    fine = (total > 0) & (low < total) & ~(suffix & (last <= 0))
    return F.when(fine, low), F.when(fine, high)


def parse_range(header: Column) -> Column:
    """struct<status, first, last> of a Range header. status: range, full (not understood), multiple (501), invalid (416)."""
    v = F.trim(header)
    spec = F.trim(F.substring(v, F.lit(7), F.length(v)))
    left, right = F.trim(F.regexp_extract(spec, "^([^-]*)-", 1)), F.trim(F.regexp_extract(spec, "^[^-]*-(.*)$", 1))
    number = "^\\+?[0-9]{1,18}$"
    a, b = left.try_cast("bigint"), right.try_cast("bigint")
    shaped = (
        F.when(v.isNull() | ~F.startswith(F.lower(v), F.lit("bytes=")), "full")
        .when(F.instr(spec, ",") > 0, "multiple")
        .when((F.instr(spec, "-") == 0) | ((left == "") & (right == "")), "full")
        .when(((left != "") & ~left.rlike(number)) | ((right != "") & ~right.rlike(number)), "full")
        .when((left == "") & (b <= 0), "invalid")
        .when((left != "") & (right != "") & (b < a), "invalid")
        .otherwise("range")
    )
    fine = shaped == "range"
    first = F.when(fine, F.when(left == "", F.lit(-1).cast("bigint")).otherwise(a))
    last = F.when(fine, F.when(right == "", F.lit(-1).cast("bigint")).otherwise(b))
    return F.struct(shaped.alias("status"), first.alias("first"), last.alias("last"))


def read_range(stored: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (blob, from, to inclusive): blob, data. Only the chunks the range touches are read; the edges are trimmed."""
    touched = wanted.withColumn("entry_id", F.explode(F.sequence(F.floor(F.col("from") / size), F.floor(F.col("to") / size))))
    each = touched.select("blob", "from", "to", F.col("entry_id").cast("bigint").alias("entry_id")).join(stored.select("blob", F.col("entry_id").cast("bigint").alias("entry_id"), "data"), ["blob", "entry_id"])
    base = F.col("entry_id") * size
    low = F.greatest(F.lit(0).cast("bigint"), F.col("from") - base)
    high = F.least(F.lit(size - 1).cast("bigint"), F.col("to") - base)
    return reassemble(each.withColumn("data", F.substring("data", (low + 1).cast("int"), (high - low + 1).cast("int"))))


def latest_parts(parts: DataFrame, seq: str = "seq") -> DataFrame:
    """Per upload and number the part written last."""
    rest = [c for c in parts.columns if c not in ("upload_id", "part_number", seq)]
    best = parts.groupBy("upload_id", "part_number").agg(F.max(F.struct(seq, *rest)).alias("_w"))
    return best.select("upload_id", "part_number", *[F.col("_w")[c].alias(c) for c in (seq, *rest)])


def part_offsets(parts: DataFrame) -> DataFrame:
    """Each part with the bytes before it (at) in its upload; at most 10,000 parts an upload are one window."""
    w = Window.partitionBy("upload_id").orderBy("part_number").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("at", F.coalesce(F.sum("len").over(w), F.lit(0)).cast("bigint"))


def part_slices(parts: DataFrame, first: Column, last: Column) -> DataFrame:
    """The bytes of each part that lie in [first, last]: upload_id, part_number, skip, take."""
    o = part_offsets(parts)
    low, high = F.greatest(first, F.col("at")), F.least(last, F.col("at") + F.col("len") - 1)
    return o.where(low <= high).select("upload_id", "part_number", (low - F.col("at")).alias("skip"), (high - low + 1).alias("take"))


def complete(listed: DataFrame, recorded: DataFrame, minimum: int = MIN_PART) -> DataFrame:
    """upload_id, status, n_parts, length for each completion list (upload_id, ord, part_number, crc).

    Listed numbers must ascend, be recorded with the same checksum, and be no smaller than the minimum but for the last.
    A list may leave recorded parts out.
    """
    w = Window.partitionBy("upload_id").orderBy("ord")
    ordered = listed.withColumns({"_prev": F.lag("part_number").over(w), "_last": F.lead("ord").over(w).isNull()})
    r = recorded.select("upload_id", "part_number", F.col("crc").alias("_crc"), F.col("len").alias("_len"))
    both = ordered.join(r, ["upload_id", "part_number"], "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    got = both.groupBy("upload_id").agg(
        some(F.col("_prev") >= F.col("part_number")).alias("order"), some(F.col("_len").isNull()).alias("unknown"), some(F.col("crc") != F.col("_crc")).alias("crc"),
        some(~F.col("_last") & (F.col("_len") < minimum)).alias("small"), F.count("*").alias("n_parts"), F.sum("_len").alias("length"),
    )
    status = F.when(F.col("order"), "order").when(F.col("unknown"), "unknown part").when(F.col("crc"), "checksum").when(F.col("small"), "too small").when(F.col("n_parts") > MAX_PARTS, "too many").otherwise("ok")
    return got.select("upload_id", status.alias("status"), "n_parts", F.when(status == "ok", F.col("length")).alias("length"))


def assemble(listed: DataFrame, recorded: DataFrame) -> DataFrame:
    """upload_id, parts: one array of structs in list order, as the finished object holds it."""
    rest = [c for c in recorded.columns if c not in ("upload_id", "part_number")]
    both = listed.select("upload_id", "ord", "part_number").join(recorded, ["upload_id", "part_number"])
    whole = F.array_sort(F.collect_list(F.struct("ord", "part_number", *rest)))
    return both.groupBy("upload_id").agg(F.transform(whole, lambda x: x.dropFields("ord")).alias("parts"))


def object_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x["len"])


def head(live: DataFrame) -> DataFrame:
    """Head rows of objects with a parts array: length is the sum, the checksum the first part's."""
    return live.withColumns({"length": object_length(F.col("parts")), "crc": F.get("parts", F.lit(0))["crc"], "entries": F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, x: s + F.ceil(x["len"] / x["chunk"]))})
