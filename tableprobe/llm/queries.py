"""The registered queries of this package and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_hits, contaminated
from .fingerprints import fingerprinted
from .lines import repeated_lines
from .negatives import mine_hard_negatives
from .pieces import load, segmented
from .preferences import conversations_of, format_preferences, mismatched
from .quality import score_quality, train_quality
from .sharding import interleave
from .simhash import near_groups
from .substring import deduplicate_substrings
from .tokencount import load as load_bpe
from .tokencount import token_counts
from .toxicity import score_toxicity, train_toxicity
from .whitening import whiten

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents; labels whose crc32 remainder by 3 is 1 are held out."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(remainder(3) != 1)
    scored = score_quality(documents, train_quality(documents, labels), columns=["doc_id"])
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that lie inside windows of benchmark items, and the items."""
    found = benchmark_hits(table(spark, folder, "documents").select("doc_id", "text"),
                           table(spark, folder, "benchmark"), columns=["doc_id"])
    return found.select(
        "row.doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


WORDS_SQL = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
ORACLES["op6_benchmark_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS k,
        array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS gram
      FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
            FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT doc_id, s.k, i, item FROM s JOIN g ON s.gram = g.gram AND s.k = g.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document, and the positions (from 0) of those that an earlier line repeats."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    gone = repeated_lines(documents).groupBy(F.col("doc").alias("gone_doc")).agg(F.sort_array(F.collect_set(
        F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("bigint"))).alias("gone"))
    counted = documents.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    gone_lines = F.coalesce("gone", F.array().cast("array<bigint>"))
    return counted.join(gone, F.col("doc_id") == F.col("gone_doc"), "left").select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size(gone_lines).cast("bigint").alias("n_removed"),
        F.array_join(gone_lines, ",").alias("removed_lines"))


@query
def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint of each document and the smallest id among those its links reach."""
    found = near_groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_sentencepiece_nbest(spark: SparkSession, folder: str) -> DataFrame:
    """The best segmentation of each text, its score and those of the next three, and the way back."""
    found = segmented(table(spark, folder, "documents").select("doc_id", "text"),
                      load(tokenizer("piece_bpe_32k.model")), columns=["doc_id"])
    return found.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "ids_sha256",
                        "nbest_scores", "restored")


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of each text, and whether the tokens exceed 1024."""
    found = token_counts(table(spark, folder, "documents").select("doc_id", "text"),
                         load_bpe(tokenizer("byte_bpe_50k.json")), columns=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document, how many of them repeat an earlier document's windows, and what is kept."""
    found = deduplicate_substrings(table(spark, folder, "documents").select("doc_id", "text"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op1_substring_dedup"] = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT gram, min(doc_id) AS least FROM s GROUP BY gram),
h AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p
      FROM s JOIN f USING (gram) WHERE doc_id > least),
r AS (SELECT doc_id, list(p) AS gone FROM h GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
        CASE WHEN gone IS NULL THEN w ELSE
          list_transform(list_filter(generate_series(1, len(w)), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END AS kept
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents; labels whose crc32 remainder by 5 is 0 are held out."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(remainder(5) != 0)
    scored = score_toxicity(documents, train_toxicity(documents, labels), columns=["doc_id"])
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"),
                         (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of each text and its edited text, and their likeness and that to the next document."""
    found = fingerprinted(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op5_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation against itself with another's last answer: prompt, completions, masks."""
    found = format_preferences(mismatched(conversations_of(table(spark, folder, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s.start, s.stop)), ",")
    return found.select(F.col("conv").alias("conv_id"), F.col("prompt_turns").cast("bigint").alias("prompt_turns"), "prompt",
                        "chosen", "rejected", spans("chosen_trained").alias("chosen_trained"),
                        spans("rejected_trained").alias("rejected_trained"))


ORACLES["op5_preference_format"] = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS last, max(i) AS n FROM t GROUP BY conv_id),
a AS (SELECT t.conv_id, t.text AS answer,
        coalesce(lead(t.text) OVER (ORDER BY t.conv_id), first_value(t.text) OVER (ORDER BY t.conv_id)) AS other
      FROM t JOIN l ON t.conv_id = l.conv_id AND t.i = l.last),
k AS (SELECT l.conv_id, l.last, answer, other,
        CASE WHEN last IS NULL THEN n WHEN answer = other THEN last ELSE last - 1 END AS shared
      FROM l LEFT JOIN a USING (conv_id))
SELECT k.conv_id, CAST(shared AS BIGINT) AS prompt_turns,
  coalesce((SELECT string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i)
            FROM t WHERE t.conv_id = k.conv_id AND i <= shared), '') AS prompt,
  CASE WHEN shared < last THEN '<|assistant|>' || chr(10) || answer || '<|end|>' || chr(10) ELSE '' END AS chosen,
  CASE WHEN shared < last THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE '' END AS rejected,
  CASE WHEN shared < last THEN '14-' || CAST(22 + length(answer) AS VARCHAR) ELSE '' END AS chosen_trained,
  CASE WHEN shared < last THEN '14-' || CAST(22 + length(other) AS VARCHAR) ELSE '' END AS rejected_trained
FROM k
"""


@query
def op11_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards with the mixture of sources, of equal counts, and each document's slot in its shard."""
    text = F.coalesce("text", F.lit(""))
    documents = table(spark, folder, "documents").select(
        "doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(documents, 16, keys=("doc_id", "size", "text_crc32")).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row.source", "place")


ORACLES["op11_stratified_shards"] = """
WITH steps AS (SELECT list(list_reduce(generate_series(0, 7), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) AS crc
               FROM range(256) AS bytes(b)),
h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS digits FROM documents),
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum,
        length(digits) // 2 + 1 AS size,
        xor(list_reduce(list_transform(regexp_extract_all(digits, '..'), lambda x: CAST('0x' || x AS BIGINT)),
          lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM h, steps),
m AS (SELECT *, md5(concat('11:', doc_id, ':', size, ':', text_crc32)) AS draw FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM m),
f AS (SELECT *, (k + CAST('0x' || substr(md5('11:' || stratum), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) / n AS place FROM r),
g AS (SELECT *, row_number() OVER (ORDER BY place, stratum, k) - 1 AS pos, count(*) OVER () AS total FROM f),
s AS (SELECT *, pos * 16 // total AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, pos - (shard * total + 15) // 16 AS slot,
  CAST(NULL AS INT) AS grown_shard, source, place
FROM s
"""


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """For anchors and their first five positives, three negatives of 0.5 to 0.95 of the positive's score."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    found = mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT * FROM (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score
    AND 100 * score <= 95 * positive_score)
WHERE rank <= 3
"""


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector on the sixteen principal components of the distinct vectors, scaled to variance one."""
    found = whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"), columns=["vec_id"])
    return found.select(
        "row.vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error",
        F.posexplode("whitened").alias("at", "whitened"),
    ).select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
             F.col("explained")[F.col("at")].alias("explained"), "identity_error")
