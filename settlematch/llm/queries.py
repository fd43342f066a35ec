"""The registered queries of the operators: each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlematch.llm import iblt, infill, jaccard, mpeg, packing, pii, quality, segmentations, sharding, sitetree, token_files, toxicity, whitening
from settlematch.llm.common import table, text_of
from settlematch.storage import new_path, written


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    raw = text_of().cast("binary")
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(slim, 24, key=F.xxhash64("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG frames, read back and probed."""
    return mpeg.probe_column(written(mpeg.store_text(table(spark, sf_dir, "documents"))))


def op3_nearest_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored for quality by its labelled neighbours."""
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")), 0.3)


def op4_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph sketches of every text and its edited version."""
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents linked by 85 % of their 4-word shingles."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    import public_tokenizers

    drawn = segmentations.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return drawn.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "log_prob", "inclusion", "log_inclusion", "decodes")


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored for toxicity by its maximum-scoring segments."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")), 0.5)


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op9_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids in sequences of at most 1024."""
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
    return packing.pack(pieces, 1024)


def op10_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in every text, plain and disguised, with source spans."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 16 principal components of the distinct ones."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as byte-level BPE ids in Parquet lists, checked from the files."""
    import public_tokenizers

    path = new_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return token_files.checksums(spark, path)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at two of its lines and put in another order, and put back."""
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output).alias("output_sha256"), digest(infill.restored(output, form)).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_hypergeometric_shards, op2_mpeg_audio, op3_nearest_neighbour_quality, op4_iblt_fingerprints, op5_ngram_jaccard, op6_gumbel_segmentations, op7_toxic_segments, op8_site_style_tree, op9_large_item_packing, op10_pii_deobfuscation, op11_bit_sliced_whitening, op12_token_lists, op13_fill_in_middle)}

FILL_IN_MIDDLE_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed
),
placed AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut
),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

# all pairs that share a shingle, and everything that links reach
JACCARD_SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled),
linked AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM one x JOIN one y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p WHERE 100 * k >= 85 * (na + nb - k)),
reached AS (SELECT doc_id, doc_id AS root FROM shingled UNION SELECT l.b, r.root FROM reached r JOIN linked l ON l.a = r.doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(root) FROM reached r WHERE r.doc_id = d.doc_id) AS component_id FROM shingled d
"""

ORACLE_SQL: dict[str, str] = {"op5_ngram_jaccard": JACCARD_SQL, "op13_fill_in_middle": FILL_IN_MIDDLE_SQL}
