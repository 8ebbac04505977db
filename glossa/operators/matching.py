"""Terms of a vocabulary in the texts of its contents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A word to be shown and pressed, with its apostrophes; and what stands between two of them.
SHOWN, BETWEEN = r"[\p{L}\p{N}]+(?:['’]\p{L}+)*", r"[^\p{L}\p{N}]+"
#: A run of letters and digits with what stands behind it, or what stands at the start.
_RUN, _WORD = r"[\p{L}\p{N}]+[^\p{L}\p{N}]*|[^\p{L}\p{N}]+", r"^[\p{L}\p{N}]*"


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, at, segment, is_word: a text as words and what stands between them; is_word: it holds a letter."""
    out = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"{SHOWN}|{BETWEEN}"), 0)).alias("at", "segment"))
    return out.withColumn("is_word", F.col("segment").rlike(r"\p{L}"))


def word_places(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start (characters before it), w: the runs of letters and digits of each text, in lower case.

    Texts are dealt by key before they are cut, so what is summed up lies together and the runs aren't shuffled."""
    dealt = docs.select(key, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    runs = dealt.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_RUN), 0)).alias("at", "run"))
    before = F.sum(F.length("run")).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return runs.select(key, F.coalesce(before, F.lit(0)).cast("int").alias("start"), F.lower(F.regexp_extract("run", _WORD, 0)).alias("w")).where("w <> ''")


def highlights(contents: DataFrame, terms: DataFrame) -> DataFrame:
    """content_id, start, end, vocab_id: where terms (content_id, vocab_id, ordinal, term) stand in their content's text (id, text).

    A term of two characters or more belongs to the entry that has it first, by ordinal. It counts where no letter or digit
    touches it, whatever its case. Of what begins at one place the longest counts, and places don't overlap, from the left. Terms
    meet the text's words by their first word, then the text itself; a term without letters and digits is nowhere."""
    low = F.lower("term")
    first = terms.groupBy("content_id", low.alias("term")).agg(F.min_by("vocab_id", F.struct("ordinal", "vocab_id")).alias("vocab_id"))
    # Tested in an array: tests of the term itself are moved below the grouping, to every word that the terms come from.
    part = lambda i: F.regexp_extract("term", r"^([^\p{L}\p{N}]*)([\p{L}\p{N}]+)", i)
    cut = F.filter(F.array(F.struct(part(1).alias("lead"), part(2).alias("head"))), lambda x: (x["head"] != "") & (F.length("term") >= 2))
    parts = first.select("content_id", "term", "vocab_id", F.explode(cut).alias("p")).select("content_id", "term", "vocab_id", "p.*")
    words = word_places(contents.select(F.col("id").alias("c"), "text"), "c")
    met = words.join(parts.hint("shuffle_hash"), (F.col("c") == F.col("content_id")) & (F.col("w") == F.col("head")))
    met = met.select("c", "vocab_id", "term", (F.col("start") - F.length("lead")).alias("start"), (F.col("start") - F.length("lead") + F.length("term")).alias("end"), (F.col("term") == F.col("head")).alias("whole")).where("start >= 0")
    # Terms of one word fit where their word stands; the others meet the text.
    alone = met.where("whole")
    longer = met.where("not whole").join(contents.select("id", "text"), F.col("c") == F.col("id"))
    letter = lambda at: F.substring("text", at, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    fits = (F.lower(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))) == F.col("term")) & ~((F.col("start") > 0) & letter(F.col("start"))) & ~letter(F.col("end") + 1)
    every = alone.select("c", "start", "end", "vocab_id").unionAll(longer.where(fits).select("c", "start", "end", "vocab_id"))

    def greedy(batches):
        content, done = None, 0
        for batch in batches:
            keep = []
            for c, s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if c != content:
                    content, done = c, 0
                keep.append(s >= done)
                done = e if keep[-1] else done
            yield batch.filter(pa.array(keep))

    kind = lambda c: every.schema[c].dataType.simpleString()
    rows = every.repartition("c").sortWithinPartitions("c", "start", F.desc("end"))
    return rows.mapInArrow(greedy, f"c {kind('c')}, start int, end int, vocab_id {kind('vocab_id')}").withColumnRenamed("c", "content_id")
