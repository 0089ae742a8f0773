"""Message state and full-text index in one, kept by batches of changes, and BM25 over the visible messages.

Four tables of a run (see ``sources.runs``): ``state``, a row for each message that the run's batches
touch, whole; ``postings``, a row for each place of a term in the texts that became visible in it, in
files of some texts each, in order of a hash of the term; ``gone``, the texts of earlier runs that are no longer to be found
(edited, hidden, deleted); ``stats``, one row with what the run adds to the number of visible texts
and of their terms.  A text is known by its message and the batch that indexed it, so that the same
words can be hidden and come back.

The places of a text are sorted where the text is and never shuffled; texts are dealt to as many tasks
as keep their places in memory.  A search reads the pages of its own terms (Parquet keeps the least and
greatest hash of each page), leaves out what is gone, and takes its statistics from the runs' single
rows; it reads no table of all messages.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.text import query_tokens
from palaver.operators.changes import FACTS, deleted_by, hidden_by, merged_facts, message_facts, state_of
from palaver.operators.retrieval import joined_terms, ranked, term_score, terms_of
from palaver.sources.runs import BEGIN, Run, Runs

#: Changes whenever tables of an older form can't be read.
FORMAT = 4
#: Bytes of text whose places a task sorts, about (a place takes some 20 times its share of the text).
TASK_BYTES = 24 << 20
#: A place is its field times this and the number of the term in the field.
FIELD_STEP = 1 << 32
#: The searched fields; the first is the content, without which there is no message.
FIELDS = ["content", "author_name", "attachment_summary"]
#: Characters of a field that are kept.
KEPT = {"author_name": 120}
#: Rows of ``gone``, or keys of a batch, up to which they are sent to all tasks (16 bytes each).
BROADCAST_ROWS = 500_000

_GIVEN = "struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">"
_FACTS = f"born bigint, given {_GIVEN}, updated_seq bigint, last_hide boolean, hide_seq bigint, deleted_seq bigint"
_PLACE = "struct<batch: bigint, terms: int, digest: bigint>"
STATE = f"key bigint, {_FACTS}, place {_PLACE}"
POSTINGS = "digest bigint, term string, key bigint, batch bigint, place bigint, terms int"
GONE = "key bigint, batch bigint, terms int"
STATS = "texts bigint, terms bigint, gone bigint"
TABLES = ["state", "postings", "gone", "stats"]


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Sent to all tasks if that is small; else joined by a shuffle."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def newest_state(runs: Runs, live: list[Run]) -> DataFrame:
    """The state rows as of the last run, one a message.

    The oldest run has one row a message by itself; it gives those that later runs don't touch, so
    that only the later ones are grouped.
    """
    if len(live) < 2:
        return runs.read("state", STATE, live).drop("upto")
    later = runs.read("state", STATE, live[1:]).groupBy("key").agg(F.max_by(F.struct(*FACTS, "place"), "upto").alias("s")).select("key", "s.*")
    base = runs.read("state", STATE, live[:1]).drop("upto")
    return base.join(later.select("key"), "key", "left_anti").unionByName(later)


def apply_changes(changes: DataFrame, path: str, batch: int, key: str = "message_id", source: str = "events") -> None:
    """Bring a batch of events (seq, op, key, *FIELDS) into state and index; a batch that is committed is left alone.

    Fields that the events don't have count as null.  The batches of a source are numbered and come in order.
    Only the state rows of the batch's messages are read, in the range of their keys.
    """
    spark = changes.sparkSession
    runs = Runs(spark, path)
    run = runs.next(source, batch)
    if run is None:
        return
    live = runs.live()
    given = lambda f: F.col(f) if f in changes.columns else F.lit(None).cast("string")
    fields = [(F.left(given(f), F.lit(KEPT[f])) if f in KEPT else given(f)).alias(f) for f in FIELDS]
    facts = message_facts(changes.select("seq", "op", F.col(key).cast("bigint").alias("key"), *fields), "key", FIELDS).persist(StorageLevel.DISK_ONLY)
    try:
        length = sum((F.coalesce(F.octet_length(F.col("given").getField(f)), F.lit(0)) for f in FIELDS), F.lit(0).cast("bigint"))
        size = F.coalesce(F.sum(length), F.lit(0))
        n, low, high, texts = facts.agg(F.count(F.lit(1)), F.min("key"), F.max("key"), size).first()
        merged = facts.withColumn("was", F.lit(None).cast(_PLACE))
        if live and n:
            known = runs.read("state", STATE, live).where(F.col("key").between(low, high)).join(_small(facts.select("key"), n), "key", "left_semi")
            texts += known.agg(size).first()[0]
            touched = facts.withColumn("place", F.lit(None).cast(_PLACE)).withColumn("upto", F.lit(run.upto).cast("bigint")).unionByName(known)
            merged = touched.groupBy("key").agg(*merged_facts(), F.max_by("place", F.when(F.col("upto") < run.upto, F.col("upto"))).alias("was"))
        digest = F.xxhash64(*[F.col("given").getField(f) for f in FIELDS])
        shown = F.col("born").isNotNull() & ~hidden_by() & ~deleted_by()
        dealt = merged.repartitionByRange(-(-texts // TASK_BYTES) or 1, "key").sortWithinPartitions("key")
        dealt = dealt.withColumn("stays", F.coalesce(shown & (F.col("was.digest") == digest), F.lit(False))).withColumn("fresh", shown & ~F.col("stays"))
        seen = dealt.select("*", *[F.when(F.col("fresh"), joined_terms(F.coalesce(F.col("given").getField(f), F.lit("")))).alias(f"_{i}") for i, f in enumerate(FIELDS)])
        count = lambda c: F.when(F.col(c) == "", 0).otherwise(F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) + 1)
        terms = sum((count(f"_{i}") for i in range(len(FIELDS))), F.lit(0))
        fresh = F.when(F.col("fresh"), F.struct(F.lit(run.upto).cast("bigint").alias("batch"), terms.alias("terms"), digest.alias("digest")))
        decided = seen.withColumn("place", F.when(F.col("stays"), F.col("was")).otherwise(fresh)).persist(StorageLevel.DISK_ONLY)
        try:
            _write(runs, run, decided)
        finally:
            decided.unpersist()
    finally:
        facts.unpersist()
    runs.commit(run, source, batch)


def _write(runs: Runs, run: Run, decided: DataFrame) -> None:
    runs.write(run, "state", decided.select("key", *FACTS, "place"))
    gone = decided.where("was IS NOT NULL AND NOT stays").select("key", "was.batch", "was.terms")
    runs.write(run, "gone", gone if run.start > BEGIN else runs.spark.createDataFrame([], GONE))
    each = F.array(*[F.struct(F.lit(i * FIELD_STEP).alias("field"), F.col(f"_{i}").alias("words")) for i in range(len(FIELDS))])
    by_field = decided.where("fresh").select("key", "place.terms", F.inline(each)).where("words <> ''")
    places = by_field.select("key", "terms", "field", F.posexplode(F.split("words", " ")).alias("at", "term"))
    filed = _in_order(places.select("term", "key", (F.col("field") + F.col("at")).alias("place"), "terms"))
    runs.write(run, "postings", filed.withColumn("batch", F.lit(run.upto).cast("bigint")), compression="zstd")
    # both tables are written: the row is their difference
    less = runs.read("gone", GONE, [run]).agg(F.count(F.lit(1)).alias("gone"), F.coalesce(F.sum("terms"), F.lit(0)).alias("less"))
    more = runs.read("state", STATE, [run]).where(F.col("place.batch") == run.upto).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("place.terms"), F.lit(0)).alias("more"))
    (n, added), (dead, lost) = more.first(), less.first()
    runs.write(run, "stats", runs.spark.createDataFrame([(n - dead, added - lost, dead)], STATS).coalesce(1))


def _in_order(postings: DataFrame) -> DataFrame:
    """Each task's rows in order of the terms' hashes: a file of its own."""
    return postings.withColumn("digest", F.xxhash64("term")).sortWithinPartitions("digest")


def merge(spark: SparkSession, path: str, which: list[Run] | None = None) -> None:
    """Write runs that follow each other (all live ones, if none are given) as one; what is gone within them is left out.

    Marks of texts that older runs hold are kept, so that a merge of all runs has none.
    """
    runs = Runs(spark, path)
    group = runs.live() if which is None else which
    if len(group) < 2:
        return
    run = Run(group[0].start, group[-1].upto)
    newest = runs.read("state", STATE, group).groupBy("key").agg(F.max_by(F.struct(*FACTS, "place"), "upto").alias("s")).select("key", "s.*")
    runs.write(run, "state", newest.repartitionByRange("key").sortWithinPartitions("key"))
    gone = runs.read("gone", GONE, group).drop("upto")
    stats = runs.read("stats", STATS, group)
    texts, terms, dead = stats.agg(F.sum("texts"), F.sum("terms"), F.sum("gone")).first()
    postings = runs.read("postings", POSTINGS, group).drop("upto")
    kept = postings.join(_small(gone.select("key", "batch"), dead), ["key", "batch"], "left_anti")
    runs.write(run, "postings", _in_order(kept), compression="zstd")
    runs.write(run, "gone", gone.where(F.col("batch") <= run.start))
    older = runs.read("gone", GONE, [run]).count()
    runs.write(run, "stats", spark.createDataFrame([(texts, terms, older)], STATS).coalesce(1))
    runs.commit(run)


def keep_up(changes: DataFrame, path: str, batch: int, key: str = "message_id", source: str = "events") -> None:
    """apply_changes(), then a merge of the newest runs where there are many of one size."""
    apply_changes(changes, path, batch, key, source)
    crowd = Runs(changes.sparkSession, path).crowded()
    if crowd:
        merge(changes.sparkSession, path, crowd)


def current_state(spark: SparkSession, path: str, key: str = "message_id") -> DataFrame:
    """(key, content_text, the other fields, content_hash, updated_seq, hidden, deleted) of every message."""
    runs = Runs(spark, path)
    return state_of(newest_state(runs, runs.live()), "key", FIELDS).withColumnRenamed("key", key)


def index_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: visible texts, their terms, and marks of texts that searches must leave out."""
    runs = Runs(spark, path)
    return runs.read("stats", STATS, runs.live()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("texts", "terms", "gone")])


def phrases_of(query: str, spark: SparkSession) -> list[list[str]]:
    """The query's tokens as runs of terms."""
    row = spark.range(1).select(F.transform(query_tokens(F.lit(query)), terms_of).alias("p")).first()
    return [p for p in row["p"] if p]


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _count(phrase: list[str]) -> Column:
    """How often a phrase stands in a text, by its terms' places; one that overlaps itself counts once."""
    if len(phrase) == 1:
        return F.col(f"n_{phrase[0]}")
    starts = reduce(F.array_intersect, [_moved(F.col(f"p_{w}"), i) for i, w in enumerate(phrase)])
    first = F.struct(F.lit(-len(phrase)).cast("bigint").alias("last"), F.lit(0).alias("n"))
    walked = F.aggregate(F.array_sort(starts), first, lambda s, x: F.when(x >= s["last"] + len(phrase), F.struct(x.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s))
    return walked["n"]


def search(spark: SparkSession, path: str, query: str, most: int, scope: DataFrame | None = None, fields: list[str] = FIELDS) -> DataFrame:
    """(key, score, rank) of visible messages that hold any phrase of the query in any of the fields, best first.

    ``scope``: the keys that may be found (one column), if not all; it is applied before the best
    are taken.  Statistics cover all visible messages; the phrases'
    document frequencies are a subquery over the same rows, one a text.
    """
    phrases = phrases_of(query, spark)
    words = sorted({w for p in phrases for w in p})
    runs = Runs(spark, path)
    live = runs.live()
    n, terms, dead = runs.read("stats", STATS, live).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("texts", "terms", "gone")]).first()
    if not words or not n:
        return runs.read("state", STATE, []).select("key", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    wanted = reduce(or_, [(F.col("digest") == F.xxhash64(F.lit(w))) & (F.col("term") == w) for w in words])
    rows = runs.read("postings", POSTINGS, live).where(wanted)
    if set(fields) != set(FIELDS):
        rows = rows.where(F.floor(F.col("place") / FIELD_STEP).isin([FIELDS.index(f) for f in fields]))
    if dead:
        rows = rows.join(_small(runs.read("gone", GONE, live).select("key", "batch"), dead), ["key", "batch"], "left_anti")
    counts = [F.count_if(F.col("term") == p[0]).alias(f"n_{p[0]}") for p in phrases if len(p) == 1]
    places = [F.collect_list(F.when(F.col("term") == w, F.col("place"))).alias(f"p_{w}") for w in words if any(w in p for p in phrases if len(p) > 1)]
    held = rows.groupBy("key", "terms").agg(*counts, *places)
    counted = held.select("key", "terms", *[_count(p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    every = counted.agg(F.struct(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]).alias("df")).scalar()
    hits = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(phrases)))).withColumn("df", every)
    if scope is not None:
        hits = hits.join(scope.toDF("key"), "key", "left_semi")
    score = sum((term_score(F.col(f"tf{i}"), F.col(f"df.df{i}"), n, F.col("terms"), terms / n) for i in range(len(phrases))), F.lit(0.0))
    return ranked(hits.select("key", F.round(score, 6).alias("score")), [F.desc("score"), F.asc("key")], most)
