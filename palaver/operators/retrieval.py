"""Full-text and vector search, rank fusion with time decay, and packing into a bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import folded, query_tokens
from palaver.session import checkpoint

K1, B = 1.2, 0.75
#: Weight of a rank by source, in the order in which ties are listed.
WEIGHTS = {"recent": 0.7, "lexical": 2.0, "semantic": 2.0}
HALF_LIFE_HOURS, RECENCY_WEIGHT = 72.0, 0.2
#: Messages in the packed context by complexity; what isn't known counts as low.
TIERS = {"low": 4, "medium": 8, "high": 12}


def terms_of(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case and without diacritics."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def joined_terms(text: Column) -> Column:
    """The terms of a text with a space between them."""
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " "))


def spaced(text: Column) -> Column:
    """The terms of a text, each between spaces of its own; empty without terms."""
    inner = F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "  "))
    return F.when(inner == "", inner).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def occurrences(spaced_text: str, phrase: list[str]) -> Column:
    """How often a phrase stands in a spaced text; one that overlaps itself counts once."""
    wanted = "".join(f" {w} " for w in phrase)
    without = F.replace(F.col(spaced_text), F.lit(wanted), F.lit(""))
    return ((F.length(spaced_text) - F.length(without)) / len(wanted)).cast("int")


def term_score(tf: Column, df: int | Column, n: int, length: Column, mean: float | None) -> Column:
    """A term's part of a document's score: Robertson and Zaragoza, with a least weight for terms of most documents."""
    df = (df if isinstance(df, Column) else F.lit(df)).cast("double")
    idf = F.greatest(F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(mean or 1))))


def bm25(docs: DataFrame, key: str, text: str, query: str, most: int) -> DataFrame:
    """(key, score, rank) of documents that hold any phrase of the query, best first, without an index.

    For one query over a table that isn't indexed (see fulltext).  Statistics (documents, mean
    length, document frequencies) cover all of ``docs``; scopes are applied by the caller
    afterwards.  Texts are read once: a row of counts a document is kept, from which statistics and
    the best come (over texts, a filter on counts would be computed with each of its terms anew).
    """
    spark = docs.sparkSession
    tokens = spark.range(1).select(query_tokens(F.lit(query)).alias("t")).first()["t"]
    phrases = [p for p in (spark.range(1).select(terms_of(F.lit(t)).alias("t")).first()["t"] for t in tokens) if p]
    if not phrases:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    # a term has two spaces of its own
    length = ((F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(" "), F.lit("")))) / 2).cast("int").alias("length")
    counted = docs.select(key, spaced(F.coalesce(F.col(text), F.lit(""))).alias("spaced")).select(key, length, *[occurrences("spaced", p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    counted = checkpoint(counted)
    n, mean, *frequencies = counted.agg(F.count(F.lit(1)), F.avg("length"), *[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(phrases))]).first()
    score = sum((term_score(F.col(f"tf{i}"), df, n, F.col("length"), mean) for i, df in enumerate(frequencies)), F.lit(0.0))
    hits = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(phrases)))).select(key, F.round(score, 6).alias("score"))
    return ranked(hits, [F.desc("score"), F.asc(key)], most)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for empty arrays, unequal lengths and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], most: int) -> DataFrame:
    """(key, score, rank) by cosine with the query vector; only positive ones."""
    scored = vectors.select(key, F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return ranked(scored.where("score > 0"), [F.desc("score"), F.asc(key)], most)


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows with their rank from 1: top-k first, so that only ``most`` rows are numbered."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def recency_boost(at: Column, as_of: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    age = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 3600.0, F.lit(0.0))
    return F.pow(F.lit(0.5), age / max(1.0, half_life)) * RECENCY_WEIGHT


def fuse(lists: dict[str, DataFrame], key: str, at: str, as_of: Column, most: int) -> DataFrame:
    """Add up rank weights and recency over ranked lists (key, at, rank), one for each source.

    Ties go to the source listed first, then to the better rank there.  Returns key, score,
    sources ('+'-joined), reasons (at most four) and rank.
    """
    parts = [
        rows.select(key, F.lit(order).alias("ord"), F.lit(name).alias("source"), "rank", (F.lit(WEIGHTS[name]) / F.col("rank") + recency_boost(F.col(at), as_of)).alias("part"))
        for order, (name, rows) in enumerate(lists.items())
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    reason = F.struct("ord", F.concat("source", F.lit("#"), F.col("rank").cast("string")).alias("text"))
    fused = union.groupBy(key).agg(
        F.round(F.sum("part"), 6).alias("score"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(reason)), 1, 4), lambda r: r["text"]), "; ").alias("reasons"),
        F.min(F.struct("ord", "rank")).alias("first"),
    )
    order = [F.desc("score"), F.asc("first.ord"), F.asc("first.rank"), F.asc(key)]
    return ranked(fused, order, most).select(key, "score", "sources", "reasons", "rank")


def pack(pins: DataFrame, retrieved: DataFrame, key: str, position: str, most: int) -> DataFrame:
    """Pins first, then what was retrieved, each key once, at most ``most``; both keep their order.

    Both inputs: (key, position).  Returns key, part (pin or retrieved) and slot from 1.
    """
    most = max(1, most)
    both = pins.orderBy(position).limit(most).select(key, F.lit(0).alias("bucket"), F.col(position).alias("pos")).unionByName(retrieved.select(key, F.lit(1).alias("bucket"), F.col(position).alias("pos")))
    once = both.groupBy(key).agg(F.min(F.struct("bucket", "pos")).alias("first"))
    order = [F.asc("first.bucket"), F.asc("first.pos"), F.asc(key)]
    top = once.orderBy(*order).limit(most)
    return top.select(key, F.when(F.col("first.bucket") == 0, "pin").otherwise("retrieved").alias("part"), F.row_number().over(Window.orderBy(*order)).alias("slot"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; as an aggregate, so that copies are reduced before the shuffle."""
    named = [f"o{i}" for i in range(len(order))]
    whole = rows.select(*[F.col(k) for k in keys], F.struct(*[o.alias(n) for o, n in zip(order, named, strict=True)]).alias("o"), F.struct(*rows.columns).alias("row"))
    return whole.groupBy(*keys).agg(F.min_by("row", "o").alias("row")).select("row.*")


def select_and_anchor(context: DataFrame, chosen: DataFrame, anchors: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Known chosen keys once, anchors after them; of too many the last ``most``; in order of time.

    ``chosen`` and ``anchors`` have a key and a position; keys of one position count in order of key.
    """
    ordered = keep_first(chosen.select(key, "position", F.lit(0).alias("bucket")).unionByName(anchors.select(key, "position", F.lit(1).alias("bucket"))), [key], [F.col("bucket"), F.col("position")])
    last = context.join(ordered, key).orderBy(F.desc("bucket"), F.desc("position"), F.desc(key)).limit(most)
    return last.orderBy(at, key).drop("bucket", "position")


def prompt_order(rows: DataFrame, by: list[str], pinned: Column, anchor: Column, position: Column, score: Column, at: Column, key: Column) -> DataFrame:
    """Rows with their ``slot`` from 1 in the prompt: pins by position, anchors by time, the others with the best last."""
    bucket = F.when(pinned, 0).when(anchor, 1).otherwise(2)
    order = [bucket, F.when(bucket == 0, position), F.when(bucket == 2, F.coalesce(score, F.lit(0.0))), F.when(bucket > 0, at), key]
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


#: Candidates by source, and those that are ranked again.
LEXICAL, SEMANTIC, RERANK = 40, 40, 30


def budgets(most: int, lexical: int = LEXICAL, semantic: int = SEMANTIC, rerank: int = RERANK) -> dict[str, int]:
    """How many candidates each source may give, and how many the fused pool holds."""
    return {"recent": max(most, lexical // 2), "lexical": lexical, "semantic": semantic, "pool": max(most, rerank)}


#: Messages in a context without an index, by complexity.
PLAIN_TIERS = {"low": 10, "medium": 30, "high": 50}


def tier_limit(tier: str, tiers: dict[str, int] = TIERS) -> int:
    return tiers.get(tier, tiers["low"])
