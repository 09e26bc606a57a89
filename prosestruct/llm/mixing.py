"""Mixing sources to target weights with DataFrame functions only.

A document's size is its number of words, maximal runs of characters other than ASCII white space. Sources in code
point order, null last, take the weights WEIGHTS in turn and share BUDGET of all words; a target stops at MOST times
its source's words and the excess is shared again by weight. With sources ordered by size / weight, those that stop are
the first ones, so running sums give the level at which the others settle.

A source takes every document floor(target / words) times, and once more those whose hash lies below a threshold. To
find it, words are summed by source and hash bucket; running sums over the buckets give the bucket in which the rest of
the target ends. Only that bucket is split into buckets by the next bits, and so on, until a bucket holds one hash or
the bits end. No rows are sorted; thresholds for more copies lie above those for fewer, so smaller mixes are nested in
larger ones. The hash is of doc_id alone, so reruns agree, and rows with one id are taken or left together. The
boundary document is taken if that comes nearer to the target.

Null and empty texts have size 0. Null ids hash as an empty id. Repeated rows count each. Other columns are ignored by
mix() and kept by draw(). An empty table gives an empty result. What reaches the driver is at most two rows a source,
and only if there are no more than MAX_SOURCES; with more, thresholds are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Bits a level of buckets takes, and the bits of the hash.
BITS, HASH_BITS = 10, 60
#: Sources whose thresholds are broadcast: some 100 bytes each.
MAX_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the id's digest."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """source, source_size -> with target. One row a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighted = totals.withColumn("w", weight).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    by_fill = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (BUDGET * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    settled = weighted.withColumn("level", level).withColumn("stops", F.col("w") * F.col("level") >= F.col("cap"))
    common = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)  # levels fall after the first that settles
    return settled.withColumn("common", common).select(
        "source", "source_size", F.when(F.col("stops") | F.col("common").isNull(), F.col("cap")).otherwise(F.col("w") * F.col("common")).alias("target")
    )


def _split(sized: DataFrame, goals: DataFrame, shift: int, spread: bool) -> DataFrame:
    """One level: goals (source, prefix, left) -> with the bucket in which `left` ends, what lies below it, its size and hashes.

    prefix is the hash's leading bits so far; left is what the bucket's documents have still to give.
    """
    inside = sized.join(F.broadcast(goals) if spread else goals, (sized.source_key == goals.source_key) & (F.shiftright(sized.hash, shift + BITS) == goals.prefix))
    bucket = F.shiftright(sized.hash, shift)
    sums = inside.groupBy(sized.source_key, bucket.alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("most"), F.first("left").alias("left")
    )
    order = W.partitionBy("source_key").orderBy("bucket")
    running = sums.withColumn("upto", F.sum("words").over(order)).withColumn("below", F.col("upto") - F.col("words"))
    here = (F.col("below") <= F.col("left")) & (F.col("left") < F.col("upto"))
    return running.where(here).select("source_key", "bucket", "words", "least", "most", (F.col("left") - F.col("below")).alias("left"))


def thresholds(sized: DataFrame) -> tuple[DataFrame, bool]:
    """source_key, source_size, target, copies, below (hashes below it are taken once more); and whether it may be broadcast.

    sized has source, source_key, size and hash, and is read a few times, so it should be kept.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    wanted = targets(totals).withColumn("source_key", key_of(F.col("source")))
    wanted = wanted.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    wanted = checkpointed(wanted.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    spread = wanted.count() <= MAX_SOURCES
    goals = wanted.where("rest > 0").select("source_key", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    found = []
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        at = checkpointed(_split(sized, goals, shift, spread))
        alone = (F.col("least") == F.col("most")) if shift else F.lit(True)
        # Taken if that is nearer: the document's words less what is left, against what is left.
        done = F.when(F.col("words") - F.col("left") < F.col("left"), F.col("most") + 1).otherwise(F.col("least"))
        found.append(at.where(alone).select("source_key", done.alias("below")))
        goals = at.where(~alone).select("source_key", F.col("bucket").alias("prefix"), "left")
        if shift and goals.isEmpty():
            break
    below = found[0]
    for more in found[1:]:
        below = below.unionByName(more)
    out = wanted.join(below, "source_key", "left").select(
        "source_key", "source_size", "target", "copies", F.coalesce("below", F.lit(0).cast("long")).alias("below")
    )
    if spread:  # as plain rows, so that each later use costs nothing
        out = spark.createDataFrame(out.collect(), out.schema)
    return out, spread


def key_of(source: Column) -> Column:
    """A source as a join key that is never null: nulls and names can't meet."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def compact(documents: DataFrame) -> DataFrame:
    """doc_id, source, source_key, size and hash, written once so that each later level reads no text."""
    return checkpointed(
        documents.select("doc_id", "source", key_of(F.col("source")).alias("source_key"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash"))
    )


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each row."""
    sized = compact(documents)
    found, spread = thresholds(sized)
    joined = sized.join(F.broadcast(found) if spread else found, "source_key")
    copies = F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(MOST)).cast("long").alias("copies"))


def draw(documents: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns it came with, whatever their names."""
    found, spread = thresholds(compact(documents))
    rows = documents.select(F.struct("*").alias("row")).withColumn("key", key_of(F.col("row.source"))).withColumn("hash", hash_of(F.col("row.doc_id")))
    joined = rows.join(F.broadcast(found) if spread else found, F.col("key") == F.col("source_key"))
    taken = F.least(F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0), F.lit(MOST)).cast("int")
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(0), taken))).select("row.*")
