"""Document fingerprints: sketches of all word-shingle hashes below a fixed fraction.

DataFrame operations only. A text's shingles are its runs of five words; a
text with fewer words is one run. A hash of 64 bits stands for each, and the
sketch keeps every hash among the lowest ``FRACTION`` of all possible ones
(and the smallest one where there is none, so that only a text without words
has an empty sketch). Its size follows the text's, so

* the sketch of two documents together is the sketch of their union, without
  reading them again (:func:`merged`);
* the part of one document that another holds can be estimated however
  unequal they are (:func:`containment`), since both keep the same hashes.

The next document of each, by ascending id, is found by ranges: ids are dealt
by range, each range looks ahead in itself, and one row a range tells where
the next begins. Texts are shuffled by id once, and of the next text only the
part that is asked for travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm.common import materialise

#: Words of a shingle.
WORDS = 5
#: Share of the 64-bit hashes that a sketch keeps.
FRACTION = 1 / 4
#: ASCII white space, at which words end.
BLANKS = " \t\n\x0b\x0c\r"
SKETCH = "array<bigint>"


def word_list(text: str) -> Column:
    """Words of a text in lower case; none for a null or blank text."""
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS))
    return F.filter(F.split(trimmed, "[ \\t-\\r]+"), lambda w: w != "")


def shingle_hashes(words: str, k: int = WORDS) -> Column:
    """A signed 64-bit hash for each run of k words: xxHash64 over the words in turn, each seeded by the hash so far (42 at first)."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))).otherwise(F.array().cast(SKETCH))


def kept(hashes: str, fraction: float = FRACTION) -> Column:
    """The sketch of a list of hashes: the distinct ones below the fraction in order, or else the smallest one."""
    below = F.filter(hashes, lambda h: h < int(fraction * 2**64) - 2**63)
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return F.sort_array(F.array_distinct(F.when(F.size(below) > 0, below).otherwise(least)))


def with_sketch(df: DataFrame, text: str = "text", name: str = "sketch", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the sketch of a text column; null texts count as empty, a column of that name is replaced."""
    words, hashes = "__words", "__hashes"
    return df.withColumn(words, word_list(text)).withColumn(hashes, shingle_hashes(words, k)).withColumn(name, kept(hashes, fraction)).drop(words, hashes)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(1.0)


def likeness(a: str, b: str) -> Column:
    """Estimated shingles of both by shingles of either; 1 where the sketches are equal, empty ones too."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(1.0)


def merged(sketches: DataFrame, keys: list[str], sketch: str = "sketch", fraction: float = FRACTION) -> DataFrame:
    """The sketch of all documents of each key together, one row (keys, hash) for each hash of it.

    Hashes are made distinct before they are shuffled, by key and hash, so a
    key with very many documents is no hot one. Hashes above the fraction
    count only for keys that have none below it, and there the smallest does.
    """
    each = sketches.select(*keys, F.explode(sketch).alias("hash")).distinct()
    low = F.col("hash") < int(fraction * 2**64) - 2**63
    smallest = each.groupBy(*keys).agg(F.min("hash").alias("__least"))
    return each.join(smallest, keys).where(low | (F.col("hash") == F.col("__least"))).select(*keys, "hash")


def as_text(sketch: str) -> Column:
    """A sketch as text: its hashes as 16 hex digits each, two's complement."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def followers(lengths: DataFrame) -> DataFrame:
    """For each id of ``lengths`` (doc_id, half, chosen; unique ids), whom it follows: doc_id, chosen, follows and its half.

    The first id follows the last.
    """
    spark = lengths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(lengths.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "fingerprint-order")
    # At most one row a range.
    last = ranged.groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.max_by("half", "doc_id").alias("half"))
    ends = last.select("part", F.struct("doc_id", "half").alias("end"))
    order = W.orderBy("part")
    before = ends.select("part", F.coalesce(F.lag("end").over(order), F.last("end").over(order.rowsBetween(0, W.unboundedFollowing))).alias("before"))
    inside = F.lag(F.struct("doc_id", "half")).over(W.partitionBy("part").orderBy("doc_id"))
    told = ranged.withColumn("inside", inside).join(F.broadcast(before), "part")
    return told.select("doc_id", "chosen", F.coalesce("inside", "before").alias("p")).select("doc_id", "chosen", F.col("p.doc_id").alias("follows"), F.col("p.half").alias("wanted"))


def fingerprints(docs: DataFrame, k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every whole text of ``docs`` (doc_id, text) and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document's. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (likeness), held_by_edited and held_by_next (containment of the
    document in the other), one row for each input row. Other columns are
    ignored; null texts count as empty.

    The next document has the next greater id, the first where there is none
    (so a single id follows itself). Where an id has several rows, each has
    the same next document, and as a next document the row whose text has
    the smallest 64-bit hash counts. A row without id has no next document,
    which is as if that were empty, and is next to none.
    """
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = src.where(F.col("doc_id").isNotNull())
    half = F.floor(F.length("text") / 2).cast("int")
    lengths = named.groupBy("doc_id").agg(F.max(half).alias("half"), F.min(F.xxhash64("text")).alias("chosen"))
    # Written with an xor, so that the text's hash is no key and texts are dealt by id alone, once for both joins.
    is_chosen = F.xxhash64("text").bitwiseXOR(F.col("chosen")) == 0
    asked = named.join(followers(lengths), "doc_id").where(is_chosen).select("follows", F.expr("left(text, wanted)").alias("tail"), "text")
    sent = with_sketch(asked, "text", "next_sketch", k, fraction).groupBy(F.col("follows").alias("doc_id")).agg(F.first(F.struct("tail", "next_sketch")).alias("next"))
    paired = named.join(sent, "doc_id", "left").select("doc_id", "text", "next.tail", "next.next_sketch")
    alone = src.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit("").alias("tail"), F.array().cast(SKETCH).alias("next_sketch"))
    whole = paired.unionByName(alone).select("doc_id", "text", "next_sketch", F.expr("concat(left(text, length(text) - floor(length(text) / 2)), left(tail, floor(length(text) / 2)))").alias("edited"))
    done = with_sketch(with_sketch(whole, "text", "sketch", k, fraction), "edited", "edited_sketch", k, fraction)
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("held_by_edited"),
        containment("sketch", "next_sketch").alias("held_by_next"),
    )
