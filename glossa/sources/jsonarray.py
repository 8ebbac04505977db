"""Large JSON files that hold one array of objects, read by many tasks.

A file is read as pieces that end with a closing brace, by byte ranges like any text, so neither a file without line ends nor a
long one is one task's work. What a piece changes is told from the piece alone: whether it flips between inside and outside of strings (by its
quotes, without those behind a backslash), and by how much it opens brackets, in either case. Each block of a file is summed up for both
cases at once, whether it begins inside of a string or outside, and what the blocks before it come to selects the case. A piece that closes a
brace down to the array's depth ends a record, and a running count of those ends numbers the records.

Pieces and records are each written once (spark.checkpoint.dir) and read by the steps that follow, so a file is read once. What is broadcast has
a row for each block of a file or each file, which the driver lists anyway.

What stands outside of the records is kept as the file's frame. Files must be valid JSON, and elements of the array objects or plain
values, which are no records; arrays of other names are none either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.sources.scratch import stored

#: Text outside of strings up to the first opening brace, and the rest.
_HEAD = r'(?s)^((?:[^"{]|"(?:[^"\\]|\\.)*+")*+)(.*)$'


def _opened(text: Column) -> Column:
    """How many more brackets of any kind a text opens than it closes (closing braces end pieces)."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))


def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block, at, piece, inside (a string), depth at the start of each piece, and whether its brace closes something (closes)."""
    raw = spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    # Every other part between quotes lies outside of strings: which ones depends on the state at the start.
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"')
    odd = lambda r: F.array_join(F.filter(parts, lambda p, i: i % 2 == r), " ")
    told = raw.select("*", (F.size(parts) - 1).alias("_quotes"), _opened(odd(0)).alias("_out"), _opened(odd(1)).alias("_in"))
    upto = _in_block().rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("_q", F.sum("_quotes").over(upto))
    # Where the block begins outside of a string; inside of one, it is the other way round.
    odd_at, closed = (F.col("_q") - F.col("_quotes")) % 2 == 1, F.col("_q") % 2 == 0
    told = told.select("file", "block", "at", "piece", "_q", odd_at.alias("_odd"), closed.alias("_closed"), (F.when(odd_at, F.col("_in")).otherwise(F.col("_out")) - closed.cast("int")).alias("_step0"), (F.when(odd_at, F.col("_out")).otherwise(F.col("_in")) - (~closed).cast("int")).alias("_step1"))
    told = stored(told.withColumns({"_sum0": F.sum("_step0").over(upto), "_sum1": F.sum("_step1").over(upto)}), "pieces")
    sums = told.groupBy("file", "block").agg(F.max_by(F.struct("_q", "_sum0", "_sum1"), "at").alias("s"))
    flipped = sums.withColumn("_flip", _before(F.col("s._q")) % 2 == 1)
    starts = flipped.select("file", "block", "_flip", _before(F.when(F.col("_flip"), F.col("s._sum1")).otherwise(F.col("s._sum0"))).alias("_start"))
    of = lambda name: F.when(F.col("_flip"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    met = told.join(F.broadcast(starts), ["file", "block"]).withColumn("after", F.col("_start") + of("_sum"))
    return met.select("file", "block", "at", "piece", (F.col("_odd") != F.col("_flip")).alias("inside"), (F.col("_closed") != F.col("_flip")).alias("closes"), (F.col("after") - of("_step")).alias("depth"), "after")


def _in_block():
    return Window.partitionBy("file", "block").orderBy("at")


def _before(value: Column) -> Column:
    """The sum of value over a file's blocks before this one, of which there is a row each."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def records(spark: SparkSession, paths: str | list[str], key: str | None = "results") -> DataFrame:
    """file, ordinal, record (JSON text, null for the last row of a file), frame (text before the record that is no record).

    key: the array is the root object's field of this name; None: the array is the file's root."""
    depth = 2 if key else 1
    ends = pieces(spark, paths).withColumn("_end", (F.col("closes") & (F.col("after") == depth)).cast("int"))
    ahead = ends.groupBy("file", "block").agg(F.sum("_end").alias("_n")).select("file", "block", _before(F.col("_n")).alias("_ahead"))
    own = F.coalesce(F.sum("_end").over(_in_block().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ends.withColumn("_own", own).join(F.broadcast(ahead), ["file", "block"]).withColumn("group", F.col("_ahead") + F.col("_own"))
    rows = numbered.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("block", "at", "piece", "depth", "inside", "after"))).alias("p"), (F.max("_end") == 1).alias("ended"))
    # A record begins in the last piece that begins no deeper than its array, behind the array's opening or a comma.
    rows = rows.withColumn("k", F.coalesce(F.array_max(F.transform(F.col("p"), lambda x, i: F.when(x["depth"] <= depth, i))), F.lit(0)))
    text = lambda a: F.array_join(F.transform(a, lambda x: x["piece"]), "}")
    start = F.get(F.col("p"), F.col("k"))
    # In a piece that begins outside of the root object its brace comes first, in one that begins inside a string the string's end.
    ahead = F.when(start["inside"], F.regexp_extract(start["piece"], r'(?s)^(?:[^"\\]|\\.)*+"', 0))
    root = ahead.when((start["depth"] == 0) & F.lit(bool(key)), F.regexp_extract(start["piece"], r"(?s)^[^{]*\{", 0)).otherwise("")
    body = F.substring(start["piece"], F.length(root) + 1, F.length(start["piece"]))
    rest = F.slice("p", F.col("k") + 2, F.size("p"))
    head, own = F.regexp_extract(body, _HEAD, 1), F.regexp_extract(body, _HEAD, 2)
    record = F.concat(F.array_join(F.concat(F.array(own), F.transform(rest, lambda x: x["piece"])), "}"), F.lit("}"))
    before = F.when(F.col("k") > 0, F.concat(text(F.slice("p", 1, F.greatest("k", F.lit(1)))), F.lit("}"))).otherwise("")
    opens = F.concat(root, head).rlike(rf'"{key}"\s*:\s*\[\s*$') if key else F.lit(True)
    out = rows.select("file", "group", "ended", (F.element_at("p", -1)["after"] == 0).alias("last"), head.rlike(r"\[\s*$").alias("first"), opens.alias("opens"), record.alias("record"), F.concat(before, root, head).alias("frame"), text(F.col("p")).alias("whole"))
    out = stored(out, "records")
    if key:  # arrays are numbered by their first records, to drop those of other names
        arrays = out.where("first and ended").select(F.col("file").alias("_f"), F.col("group").alias("_g"), F.col("opens").alias("_o"))
        arrays = arrays.groupBy("_f").agg(F.sort_array(F.collect_list(F.struct("_g", "_o"))).alias("arrays"))
        out = out.join(F.broadcast(arrays), F.col("file") == F.col("_f"), "left")
        own_array = F.element_at(F.filter("arrays", lambda a: a["_g"] <= F.col("group")), -1)["_o"]
        mine = F.col("ended") & F.coalesce(own_array, F.lit(False))
    else:
        mine = F.col("ended")
    whole = F.when(F.col("ended") | F.col("last"), F.concat("whole", F.lit("}"))).otherwise(F.col("whole"))  # white space may stand behind the file's last brace
    return out.select("file", F.col("group").alias("ordinal"), F.when(mine, F.col("record")).alias("record"), F.when(mine, F.col("frame")).otherwise(whole).alias("frame"))


def elements(spark: SparkSession, paths: str | list[str], schema: str, key: str | None = "results") -> DataFrame:
    """file, ordinal and r (of the schema) of each object in the array of each file."""
    return parsed(records(spark, paths, key), schema)


def frames(spark: SparkSession, paths: str | list[str], schema: str, key: str = "results") -> DataFrame:
    """file and r (of the schema): what a file's root object holds besides the array. Pieces of a file's frame are few, for records are left out."""
    return framed(records(spark, paths, key), schema)


def parsed(found: DataFrame, schema: str) -> DataFrame:
    """elements() of records()."""
    return found.where("record is not null").select("file", "ordinal", F.from_json("record", schema).alias("r"))


def framed(found: DataFrame, schema: str) -> DataFrame:
    """frames() of records()."""
    kept = found.where(F.col("record").isNull() | F.col("frame").rlike(r"[^\s,]"))
    whole = kept.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ordinal", "frame"))).alias("p"))
    return whole.select("file", F.from_json(F.array_join(F.transform("p", lambda x: x["frame"]), ""), schema).alias("r"))


META = "ranAt string, seed long, maxChars long, promptVersion string, mode string, sweep boolean, totals struct<wallSec: double>"


def merged_frame(dumps: DataFrame) -> DataFrame:
    """One row of several dumps' frames (file, r of META): the first ranAt, the settings of the first file, by name, that states a promptVersion, and the summed times."""
    first = F.min(F.when(F.coalesce("r.promptVersion", F.lit("")) != "", F.struct("file", "r"))).alias("f")
    got = dumps.agg(F.min("r.ranAt").alias("ran_at"), first, F.coalesce(F.sum("r.totals.wallSec"), F.lit(0.0)).alias("wall_s"), F.count("*").alias("files"))
    return got.select("ran_at", "f.r.seed", F.col("f.r.maxChars").alias("max_chars"), F.col("f.r.promptVersion").alias("prompt_version"), "f.r.mode", "f.r.sweep", "wall_s", "files")


def disagreements(dumps: DataFrame) -> DataFrame:
    """file, field, value, first: later files whose promptVersion or seed is another than that of the first file that states a promptVersion."""
    first = dumps.where("coalesce(r.promptVersion, '') <> ''").agg(F.min(F.struct("file", "r")).alias("f")).select(F.col("f.file").alias("_file"), F.col("f.r.promptVersion").alias("_version"), F.col("f.r.seed").alias("_seed"))
    met = dumps.join(F.broadcast(first), F.col("file") > F.col("_file"))  # one row
    pair = lambda field, value, first: F.when(value.isNotNull() & ~value.eqNullSafe(first), F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), first.cast("string").alias("first")))
    said = F.array_compact(F.array(pair("promptVersion", F.nullif(F.col("r.promptVersion"), F.lit("")), F.col("_version")), pair("seed", F.col("r.seed"), F.col("_seed"))))
    return met.select("file", F.explode(said).alias("x")).select("file", "x.*")
