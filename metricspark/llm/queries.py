"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricspark.llm import encode, exact_dedup, hard_negatives, kmeans_tree, language, neighbours, packing, pii, quality, repair, set_join, token_counts, toxicity
from metricspark.llm.bpe import tokenizer_path
from metricspark.llm.common import bucket, labelled_sample, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is one id, rows that repeat an id are examples of their own."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "n_loss",
    )


#: Answers of a conversation fill a sequence before its tokens do.
TALK = packing.Limits(tokens=2048, segments=64, loss=1024)


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: every assistant turn with the turn before it as its prompt, which bears no loss, packed under all three limits.

    A turn is ``conv:turn``. A first turn and one after a null text have an empty prompt; rows of one turn come by role and text.
    """
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", before.alias("prompt"))
    own = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    examples = turns.filter("role = 'assistant'").select(own.alias("doc_id"), "prompt", "text")
    pieces = packing.pack(examples, tokenizer_path("word_bpe_49k.json"), TALK, prompt_col="prompt")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "n_loss")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document; null and empty texts have no ids. One row for each row, whatever its id."""
    rows = encode.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; null counts as empty, and rows that share the staying id stay with it."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), g AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked vectors and their components; what is null, zero or not finite is linked with nothing."""
    return neighbours.near_dedup(table(spark, sf_dir, "embeddings"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Ranking | None:
    """Learned from at most about 20,000 labelled rows of the learning part."""
    labels = table(spark, sf_dir, "labels")
    sample = labelled_sample(labels, bucket(F.col("doc_id"), 4) != 2, "quality", max_rows=20_000)
    return quality.fit(table(spark, sf_dir, "documents"), sample)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null and empty texts have the score of no text at all."""
    rows = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return rows.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; ``und`` for a null text or one without letters."""
    documents = table(spark, sf_dir, "documents")
    profiles = language.fit(documents, bucket(F.col("doc_id"), 5) != 0, max_rows=20_000)
    rows = language.predict(documents, profiles)
    return rows.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; null and empty texts have none."""
    rows = pii.find(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of linked documents; a text without words and a null id are linked with nothing."""
    return set_join.jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null and empty texts have the constant's score."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(labels, bucket(F.col("doc_id"), 5) != 0, "toxic", max_rows=16_000)
    rows = toxicity.score(documents, toxicity.fit(documents, sample))
    return rows.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every section; null and empty texts have one empty section or none, as the operator says."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth id; every seventh id has the next label. What has no label or no finite vector takes no part."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.q, c.q)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


def op12_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every fiftieth id among all rows; what is null, zero or not finite takes no part."""
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, stripped of their ends, repeated or set to one role, by a hash of conversation and turn."""
    blank = F.lit(" ")
    own = F.concat(*(F.coalesce(F.col(c).cast("string"), blank) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(own), F.lit(20)).alias("kind")
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits and repaired forms of all damaged conversations; one of which no row is left has nothing but the digest of no text."""
    original = table(spark, sf_dir, "conversations")
    audits, repaired = repair.repair(damaged(original))
    found = audits.join(repair.digests(repaired), "key", "left")
    rows = original.select("conv_id").distinct().withColumn("key", repair.key_of(F.col("conv_id"))).join(found, "key", "left")
    counts = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


#: The cheapest edits are carried from the last row to the first, for each of four states: nothing yet, after a system, user, assistant row.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)) AS codes
  FROM conversations
), h AS (
  SELECT b.* EXCLUDE (codes), xor(list_reduce(codes, lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM b, t
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
         before IS NOT NULL AND coalesce(nullif(left(before, 1), ''), ' ') || initial NOT IN ('su', 'ua', 'au') AS bad
  FROM o
), edges(s, z, ins, lines) AS (
  VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
         (3, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, 'II', ['user:', 'assistant:'])
), moves(z, initial, e) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), steps AS (
  SELECT f.conv_id, f.i, edges.s, m.e, 3 * length(ins) + m.cost AS cost, ins || m.edit AS audit, lines || m.line AS lines
  FROM f, edges, LATERAL (
    SELECT z AS e, 4 AS cost, 'D' AS edit, CAST([] AS VARCHAR[]) AS line WHERE z = z
    UNION ALL SELECT e, 3 * cut::INT, 'K', [f.role || ':' || f.text] FROM moves WHERE moves.z = edges.z AND moves.initial = f.initial AND NOT blank AND NOT dup
    UNION ALL SELECT CASE WHEN edges.z = 2 THEN 3 ELSE 2 END, 3 + 3 * cut::INT, 'R', [CASE WHEN edges.z = 2 THEN 'assistant:' ELSE 'user:' END || f.text] WHERE NOT blank AND NOT dup
  ) m
), back AS (
  SELECT n.conv_id, n.i, edges.s, {'cost': 3 * length(ins), 'audit': ins, 'lines': lines} AS best
  FROM (SELECT conv_id, max(i) + 1 AS i FROM f GROUP BY conv_id) n, edges WHERE z IN (0, 3)
  UNION ALL
  SELECT steps.conv_id, steps.i, steps.s, min({'cost': steps.cost + best.cost, 'audit': steps.audit || best.audit, 'lines': steps.lines || best.lines})
  FROM back JOIN steps ON steps.conv_id IS NOT DISTINCT FROM back.conv_id AND steps.i = back.i - 1 AND steps.e = back.s
  GROUP BY steps.conv_id, steps.i, steps.s
), solved AS (
  SELECT conv_id, min(best) AS best FROM back WHERE i = 1 AND s = 0 GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal
  FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM c.conv_id
"""


QUERIES = {
    "op1_packing": op1_packing,
    "packed_conversations": packed_conversations,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_neighbours": op4_neighbours,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_kmeans_tree": op12_kmeans_tree,
    "op13_repair": op13_repair,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op13_repair": OP13_SQL}
