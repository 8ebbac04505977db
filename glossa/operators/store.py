"""Tables of a learning store as pure functions from DataFrames to DataFrames: inserts, upserts, deletes, gates, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import lex, model


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of new that enter: of each key the first by order, unless the key exists."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, that with the greatest seq."""
    rows = existing.unionByName(new, allowMissingColumns=True)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("row"))
    return best.select("row.*")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """parents without the keys in gone, and children without theirs."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def with_counts(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """parents with the number of their children, which are counted before they are joined."""
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").fillna(0, [name])


def zero_filled(df: DataFrame, value: str, lo: int, hi: int, name: str = "n") -> DataFrame:
    """Counts of value for each of lo..hi."""
    every = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast(df.schema[value].dataType).alias(value))
    return F.broadcast(every).join(df.groupBy(value).agg(F.count("*").alias(name)), value, "left").fillna(0, [name])


def not_expired(rows: DataFrame, created: str, now_ms: int, ttl_ms: int = K.FALLBACK_TTL_MS) -> DataFrame:
    return rows.where(F.lit(now_ms) - F.col(created) <= ttl_ms)


def within_quota(rows: DataFrame, who: str, at: Column, order: list[str], quota: int = K.DAILY_QUOTA) -> DataFrame:
    """The first quota rows of each owner and day."""
    w = Window.partitionBy(who, F.to_date(at)).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= quota)


def statistics(cards: DataFrame, now_ms: int) -> DataFrame:
    """One row: cards, known ones, those learnt today and this week, due ones."""
    midnight = now_ms - now_ms % K.DAY_MS
    last, n = F.col("last_reviewed"), F.count("*")
    known = F.when(n == 0, 0).otherwise(model.half_up(100 * F.count_if(F.col("leitner_box") >= 4) / n))
    return cards.agg(n.alias("total"), known.cast("long").alias("known_pct"), F.count_if(last >= midnight).alias("learned_today"), F.count_if(last >= midnight - 6 * K.DAY_MS).alias("learned_week"), F.count_if(model.due(F.col("leitner_box"), last, now_ms)).alias("due"))


def select_round(cards: DataFrame, n: int = 20) -> DataFrame:
    """The next n cards: low boxes and long-unseen ones first, then as they came."""
    return cards.orderBy("leitner_box", F.coalesce("last_reviewed", F.lit(0)), "created_at", "id").limit(n)


def review_fold(events: DataFrame) -> DataFrame:
    """card, box, correct, incorrect, last_ts after all reviews: a wrong answer sends a card to box 1, each right one lifts it to 5 at most."""
    pos = Window.partitionBy("card").orderBy("ts", "event_id")
    wrong = F.max(F.when(~F.col("correct"), F.col("nth"))).over(Window.partitionBy("card"))
    e = events.withColumn("nth", F.row_number().over(pos)).withColumn("last_wrong", F.coalesce(wrong, F.lit(0)))
    return e.groupBy("card").agg(F.least(F.lit(5), 1 + F.count_if(F.col("nth") > F.col("last_wrong"))).cast("int").alias("box"), F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("incorrect"), F.max("ts").alias("last_ts"))


def streaks(days: DataFrame, who: str, day: str, today: str) -> DataFrame:
    """who, best (longest run of days in a row), current (the run that holds today, else 0)."""
    d = days.select(who, F.col(day).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(who).orderBy("day")))
    runs = d.withColumn("island", island).groupBy(who, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy(who).agg(F.max("n").alias("best"), F.coalesce(F.max(F.when(F.col("last") == F.lit(today).cast("date"), F.col("n"))), F.lit(0)).alias("current"))


def searched(cards: DataFrame, text: str) -> DataFrame:
    """Cards that hold a text in either language, whatever the case; all of them for a blank text."""
    low = text.lower()
    return cards.where(F.lower("original").contains(low) | F.lower("translation").contains(low)) if text.strip() else cards


def looked_up(asked: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """asked with the value of its key in table, null where it is absent."""
    return asked.join(table.select(key, value), key, "left")


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with those columns that changes (one row a key) give another value; others, and rows without a change, stay."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    met = rows.join(new, F.col(key) == F.col("_key"), "left")
    return met.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*rows.columns)


def with_days(days: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """Days with new ones, each once, in order."""
    return days.select(day).unionAll(new.select(day)).distinct().orderBy(day)


#: The direction in which a sort begins: newest first, the others from the least.
DIRECTIONS = {"date": "desc", "alphabetical": "asc", "level": "asc", "box": "asc"}


def toggled(direction: str) -> str:
    return "asc" if direction == "desc" else "desc"


def sort_columns(by: str, direction: str | None = None) -> list[Column]:
    """What cards are ordered by; cards that are equal in it stay in the order of their ids."""
    key = {"date": F.col("created_at"), "alphabetical": lex.sort_key(F.col("original")), "level": lex.level_rank(F.col("level")), "box": F.col("leitner_box")}[by]
    return [F.desc(key) if (direction or DIRECTIONS[by]) == "desc" else F.asc(key), F.asc("id")]


def practice_round(cards: DataFrame, seed: int, n: int = 20) -> DataFrame:
    """The next n cards, those of one box and day in an order that looks random."""
    return cards.orderBy("leitner_box", F.coalesce("last_reviewed", F.lit(0)), F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def settings_in_use(stored: DataFrame, device: str = "en") -> DataFrame:
    """native, learning, direction and the other settings in use: unsupported codes become en, missing ones go by the device, and a missing language to learn is another than the native one."""
    ok = lambda c: F.when(F.col(c).isin(*K.LANGUAGES), F.col(c)).when(F.col(c).isNotNull(), "en")
    native = F.coalesce(ok("native"), F.lit(device if device in K.LANGUAGES else "en"))
    learning = F.coalesce(ok("learning"), F.when(native != "en", "en").otherwise(next(x for x in K.LANGUAGES if x != "en")))
    side = F.when(F.col("direction") == "native-to-learning", "translation").when(F.col("direction") == "learning-to-native", "original").otherwise("either")
    return stored.select("owner", native.alias("native"), learning.alias("learning"), side.alias("side"), F.coalesce("level", F.lit("A2")).alias("level"), F.coalesce("cards", F.lit("20")).cast("int").alias("cards"))
