"""Filter interaction audit: what each filter removes in every order, from one pass over a stream.

All files are read as micro-batches until none is left. The filters that look at one text alone give
a mask; identity with a smaller id depends on what else has come. So every text keeps a state: its
least id so far and who holds it. A row's mask is counted as it stands when it comes, and when a
smaller id comes later, the masks counted for the earlier holders are taken back and counted again.
What the stream leaves is a table of counters per part and mask, from which all orders follow.

The state is a table in the shared folder, one narrow row per text, part and labels of a micro-batch:
an operator that calls Python once per text costs milliseconds a text, and this one none. A micro-batch
shuffles that table with its own rows, so a text's state is read once per micro-batch and not once
per row; with few micro-batches that is a small share of reading the texts.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm.common import BROADCAST_ROWS, durable
from traceloom.session import ensure_checkpoint_dir

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = "[#$%&*|]"
BATCHES = 4
_COPY = 1 << FILTERS.index("E")
_SALTS = 32
#: Rows of one id in a micro-batch beyond which they are spread over salts.
_HOT_ROWS = 10_000
_STATE = "key binary, part string, mask int, good boolean, toxic boolean, low long, n_low long, n long"
_CHANGE = "part string, mask int, good boolean, toxic boolean, n long"


def text_mask(text: str, words: str) -> Column:
    """Bits of the filters that one text alone decides: A, B, C and D from the lowest bit up."""
    whole = F.col(text)
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.regexp_count(whole, F.lit("[A-Z]")).cast("long")
    fails = [
        count < LEAST_WORDS,
        distinct.cast("long") * 100 < count.cast("long") * LEAST_DISTINCT,
        upper * 100 > F.length(whole).cast("long") * MOST_UPPER,
        whole.rlike(SIGNS),
    ]
    bits = [F.when(fail, 1 << place).otherwise(0) for place, fail in enumerate(fails)]
    return sum(bits[1:], bits[0]).cast("int")


def label_bits(labels: DataFrame) -> DataFrame:
    """One row per id that any label row calls good or toxic; a null id has no labels."""
    named = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return named.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    ).filter("good OR toxic")


def facts(docs: DataFrame, named: DataFrame, few: bool) -> DataFrame:
    """One narrow row per document: text digest, part, mask, label bits and doc_id.

    Null texts are empty ones and null languages the empty part. ``few`` labelled ids are broadcast;
    more are shuffled once, by id. Only an id or null that many rows carry is spread by (id, salt of the
    text), and only such ids are repeated for it. Spark estimates the labels from their file and would
    send them all to the driver to broadcast them, hence the hint.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), text_mask("text", "words").alias("mask")
    )
    if few:
        joined = rows.join(F.broadcast(named), "doc_id", "left")
    else:
        hot = F.broadcast(durable(
            docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
            .filter((F.col("count") > _HOT_ROWS) & F.col("doc_id").isNotNull())
            .select("doc_id", F.lit(True).alias("hot"))
        ))
        salt = F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int")
        spread = F.when(F.col("hot") | F.col("doc_id").isNull(), salt).otherwise(0)
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
        salted = named.join(hot, "doc_id", "left").withColumn("salt", F.explode(salts)).drop("hot")
        joined = rows.join(hot, "doc_id", "left").withColumn("salt", spread).join(
            salted.hint("merge"), ["doc_id", "salt"], "left"
        )
    return joined.select(
        "key", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "doc_id",
    )


def fold(rows: DataFrame) -> DataFrame:
    """Facts folded to a row per text, part and labels: least id, rows of that id, all rows.

    Rows of one id are counted first, which spreads the copies of a text over all tasks; the second
    sum is combined before its shuffle, so a text sends one row per task at most. Rows without an id
    have no least id and stay a row of their own.
    """
    alike = ["key", "part", "mask", "good", "toxic"]
    each = rows.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("doc_id").isNull()
    least = F.min(F.struct("doc_id", "n"))
    return each.groupBy(*alike, blank.alias("blank")).agg(least.alias("least"), F.sum("n").alias("n")).select(
        *alike, F.col("least.doc_id").alias("low"), F.col("least.n").alias("n_low"), "n"
    )


def retractions(state: DataFrame, number: int) -> DataFrame:
    """Counter changes of micro-batch ``number``, given the state rows up to it with their ``batch``.

    A new row counts its least id's rows with the mask as it is if no smaller id is known, all others
    as copies. Where the new rows bring a smaller id than the state held, the masks counted for the
    earlier holders are taken back and counted again as copies.
    """
    text = Window.partitionBy("key")
    fresh = F.col("batch") == number
    seen = state.withColumns({
        "now": F.min("low").over(text),
        "before": F.min(F.when(~fresh, F.col("low"))).over(text),
    })
    first = (F.col("low") == F.col("now")) | F.col("low").isNull()
    counted = F.when(F.col("low").isNull(), F.col("n")).when(first, F.col("n_low")).otherwise(0)
    lost = ~fresh & (F.col("low") == F.col("before")) & (F.col("now") < F.col("before"))
    copy = F.col("mask").bitwiseOR(F.lit(_COPY))
    moves = F.when(fresh, F.array(
        F.struct(F.col("mask").alias("mask"), counted.cast("long").alias("n")),
        F.struct(copy.alias("mask"), (F.col("n") - counted).cast("long").alias("n")),
    )).when(lost, F.array(
        F.struct(F.col("mask").alias("mask"), (-F.col("n_low")).alias("n")),
        F.struct(copy.alias("mask"), F.col("n_low").alias("n")),
    ))
    each = seen.select("part", "good", "toxic", F.explode(moves).alias("move"))
    return each.groupBy("part", "move.mask", "good", "toxic").agg(F.sum("move.n").alias("n"))


def stream_counters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counters (part, mask, good, toxic, n) after all that a stream of documents holds now.

    A micro-batch writes its state rows and its counter changes to folders of its own number, and
    reads only the state of smaller numbers, so one that runs again replaces what it wrote.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/audit-{uuid.uuid4().hex}"
    named = durable(label_bits(labels))
    few = named.count() <= BROADCAST_ROWS

    def settle(batch: DataFrame, number: int) -> None:
        fold(facts(batch, named, few)).write.mode("overwrite").parquet(f"{home}/state/batch={number}")
        state = batch.sparkSession.read.schema(f"{_STATE}, batch long").parquet(f"{home}/state")
        sums = retractions(state.filter(F.col("batch") <= number), number)
        sums.write.mode("overwrite").parquet(f"{home}/counters/batch={number}")

    docs.writeStream.foreachBatch(settle).option("checkpointLocation", f"{home}/stream").trigger(
        availableNow=True
    ).start().awaitTermination()
    spark.createDataFrame([], _CHANGE).write.parquet(f"{home}/counters/batch=-1")
    kept = spark.read.schema(f"{_CHANGE}, batch long").parquet(f"{home}/counters")
    return kept.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def orders(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters of masks.

    A counter is one row per part, mask and labels, so 600 rows of every counter is a fixed factor.
    """
    every = ["".join(order) for order in permutations(FILTERS)]
    at = counters.withColumn("filter_order", F.explode(F.lit(every))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    places = [F.locate(letter, F.col("filter_order")) for letter in FILTERS]
    own, earlier = (
        sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))
        for tests in ([p == F.col("step") for p in places], [p < F.col("step") for p in places])
    )
    at = at.withColumns({"own": own, "earlier": earlier})
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    here = fails & ~gone
    # The filter is the first of the mask's bits in one order out of as many as there are bits.
    orders_first = F.lit(len(every)) / F.greatest(F.bit_count("mask"), F.lit(1))

    def total(which: Column, weight: Column | None = None) -> Column:
        n = F.col("n") if weight is None else F.col("n") * weight
        return F.coalesce(F.sum(F.when(which, n.cast("long"))), F.lit(0)).cast("long")

    return at.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
        total(fails, orders_first).alias("shapley"),
    )


def read_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """A table's files as a stream of about ``batches`` micro-batches.

    A stream takes a folder or a pattern, but not a single file, so the path's last letter is written
    as a pattern that only itself matches.
    """
    table = spark.read.parquet(path)
    files = max(1, -(-len(table.inputFiles()) // batches))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    path = path.rstrip("/")
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of a stream of documents (doc_id, text, lang) against labels (doc_id, quality, toxic).

    Null and empty texts are the same text. Rows that repeat id and text are no copies of each other,
    as no id is smaller; a row without an id is never a copy and makes none. Extra columns are not
    read; an empty table gives no part and so no row; long texts are one row each.
    """
    return orders(stream_counters(docs, labels))
