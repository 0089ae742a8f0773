"""The training-data queries over the driver's tables, thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import doc_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The public tokenizer's file; part of the installation on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.simhash import near_duplicate_groups

    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.quality import SAMPLE_DOCS, score_quality
    from palaver.llm.samples import labelled_sample

    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", doc_bucket(F.col("doc_id"), 4) != 2, SAMPLE_DOCS)
    held_out = F.coalesce(doc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return score_quality(docs, sample).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.substrings import remove_repeats

    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc.doc_id",
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.language import SAMPLE_DOCS, label_languages
    from palaver.llm.samples import labelled_sample

    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, docs, "lang", doc_bucket(F.col("doc_id"), 3) != 1, SAMPLE_DOCS)
    held_out = F.coalesce(doc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return label_languages(docs, sample, with_spans=False).select("doc_id", held_out, "lang_pred", "score")


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.sharding import hilbert_shards

    placed = hilbert_shards(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"], "doc_id")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.token_store import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    held_out = F.coalesce(doc_bucket(F.col("doc.doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc.doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from palaver.llm.samples import labelled_sample
    from palaver.llm.toxicity import SAMPLE_DOCS, score_toxicity

    learn = doc_bucket(F.col("doc_id"), 5) != 0
    sample = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", learn, SAMPLE_DOCS)
    return score_toxicity(docs, sample)


def op11_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.credentials import BASE, find_credentials

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    found = find_credentials(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", *[of_kind(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.dialogue import damaged, repair_conversations

    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palaver.llm.vector_codes import compress

    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_token_files": op8_token_files,
    "op9_embeddings": op9_embeddings,
    "op10_toxicity": op10_toxicity,
    "op11_credentials": op11_credentials,
    "op12_conversations": op12_conversations,
    "op13_vector_codes": op13_vector_codes,
}

def _codebook_sql(rounds: int = 4) -> str:
    """Operator 13 in SQL: each round of codebooks (b) and assignments (a) is a table of its own."""
    assign = """a{r} AS MATERIALIZED (SELECT p.row, p.part, p.w, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d FROM (
  SELECT p.row, p.part, p.w, b.entry, list_sum(list_transform(range(1, len(p.w) + 1), lambda i: (p.w[i] - b.c[i]) * (p.w[i] - b.c[i]))) AS d FROM p JOIN b{r} b ON p.part = b.part) p JOIN b{r} b ON p.part = b.part AND p.entry = b.entry GROUP BY p.row, p.part, p.w)"""
    update = """b{s} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, entry, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, w, unnest(range(1, len(w) + 1)) AS i FROM a{r}) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))"""
    steps = [x for r in range(rounds) for x in (assign.format(r=r), update.format(r=r, s=r + 1))]
    return (
        """
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, v[len(v) // 4 * part + 1 : len(v) // 4 * (part + 1)] AS w FROM k, range(4) parts(part)),
b0 AS (SELECT part, row AS entry, w AS c FROM p WHERE row < 256),
"""
        + ",\n".join([*steps, assign.format(r=rounds)])
        + f""",
coded AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN k USING (row) GROUP BY row, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM coded"""
    )


#: The operators whose results SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, CAST(2 * i + 1 AS BIGINT), 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY g) > 1),
m AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS begins FROM r)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM m GROUP BY doc_id, run),
pieces AS (SELECT doc_id, a, b, substring(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)) AS piece FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) JOIN d USING (doc_id)),
cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substring(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT))))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
    "op5_decontamination": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN grams ON runs.gram = grams.gram AND runs.n = grams.n),
under AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN under USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op9_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN degrees USING (vec_id)""",
    "op12_conversations": r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
dealt AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(key)), lambda i: (ascii(substring(key, i // 8 + 1, 1)) >> CAST(i % 8 AS INT)) & 1)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT) % 20 AS deal FROM keyed),
here AS (SELECT conv_id, turn, CASE deal WHEN 4 THEN 'user' ELSE role END AS role, CASE deal WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE deal WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM here),
r AS MATERIALIZED (SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS y,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
f AS (SELECT DISTINCT conv_id, n + 1 AS p, [0, 4, 2, 0] AS f FROM r UNION ALL
  SELECT conv_id, p, [least(g[1], 2 + least(g[3], 2 + g[4])), least(g[2], 2 + least(g[3], 2 + g[4])), least(g[3], 2 + g[4]), least(g[4], 2 + g[3])] FROM (
    SELECT r.conv_id, r.p, CASE WHEN fault IN ('blank', 'duplicate') THEN [f[1] + 3, f[2] + 3, f[3] + 3, f[4] + 3] ELSE [
      least(f[1] + 3, f[3] + 2 + t, CASE x WHEN 's' THEN f[2] + t WHEN 'u' THEN f[3] + t ELSE 99999999 END),
      least(f[2] + 3, f[3] + 2 + t, CASE x WHEN 'u' THEN f[3] + t ELSE 99999999 END),
      least(f[3] + 3, f[4] + 2 + t, CASE x WHEN 'a' THEN f[4] + t ELSE 99999999 END),
      least(f[4] + 3, f[3] + 2 + t, CASE x WHEN 'u' THEN f[3] + t ELSE 99999999 END)] END AS g
    FROM f JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS t FROM r) r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.p = f.p - 1)),
arcs AS MATERIALIZED (SELECT a.conv_id, a.p, q, CASE WHEN r.p IS NOT NULL AND a.f[q] = 3 + b.f[q] THEN 'D' WHEN a.f[q] = 2 + a.f[nx] THEN 'I' WHEN fault IN ('', 'truncated') AND a.f[q] = t + b.f[kept] THEN 'K' WHEN fault IN ('', 'truncated') AND a.f[q] = t + 2 + b.f[nx] THEN 'R' END AS letter, nx, kept, CASE nx WHEN 3 THEN 'user' ELSE 'assistant' END AS fresh, role, text
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS q FROM f) a LEFT JOIN f b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.p = a.p + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.p = a.p,
  LATERAL (SELECT CASE q WHEN 3 THEN 4 ELSE 3 END AS nx, CASE WHEN x = 's' AND q = 1 THEN 2 WHEN x = 'u' AND q <> 3 THEN 3 WHEN x = 'a' AND q = 3 THEN 4 END AS kept, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS t)),
walk AS (SELECT conv_id, 0 AS step, 1::BIGINT AS p, 1 AS q, '' AS letter, CAST(NULL AS VARCHAR) AS line FROM (SELECT DISTINCT conv_id FROM r) UNION ALL
  SELECT w.conv_id, step + 1, CASE arcs.letter WHEN 'I' THEN w.p ELSE w.p + 1 END, CASE arcs.letter WHEN 'D' THEN w.q WHEN 'K' THEN kept ELSE nx END, arcs.letter, CASE arcs.letter WHEN 'K' THEN concat(role, ':', text) WHEN 'R' THEN concat(fresh, ':', text) WHEN 'I' THEN concat(fresh, ':') END
  FROM walk w JOIN arcs ON arcs.conv_id IS NOT DISTINCT FROM w.conv_id AND arcs.p = w.p AND arcs.q = w.q WHERE arcs.letter IS NOT NULL),
repaired AS (SELECT conv_id, string_agg(letter, '' ORDER BY step) AS audit, string_agg(line, chr(10) ORDER BY step) AS lines FROM walk GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p > 1 AND concat(y, x) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(f.f[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.p = 1""",
    "op13_vector_codes": _codebook_sql(),
}
