"""The ``opN_*`` queries and their SQL, added to the registry of ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    """All documents in eight shards of near-equal bytes."""
    from tabulens.llm.sharding import shard_documents
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op4_warc")
def op4_warc(spark, sf_dir):
    """Every page through ARC and WARC archives and back."""
    from tabulens.llm.warc import archive_pages
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_packing")
def op9_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    from tabulens.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


@query("op1_html_extract")
def op1_html_extract(spark, sf_dir):
    """Main text of every page."""
    from tabulens.llm.html_extract import extract_main_text
    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    """Base statistics and the adaptive verdict of every document."""
    from tabulens.llm.quality_rules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    from tabulens.llm.toxicity import score_toxicity
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_minhash_dedup")
def op5_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    from tabulens.llm.minhash import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op6_prefix_forest")
def op6_prefix_forest(spark, sf_dir):
    """The 20 nearest embeddings of every row whose id is divisible by 20."""
    from tabulens.llm.prefix_forest import nearest_neighbours
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"), k=20)


@query("op8_kneser_ney")
def op8_kneser_ney(spark, sf_dir):
    """Log10 probabilities of all documents under a model of six sevenths of them."""
    from tabulens.llm.language_model import language_model_scores
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    out = language_model_scores(table(spark, sf_dir, "documents"), fold != 2)
    return out.select("doc_id", (~F.col("is_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


#: Shares of the tokens by language after mixing.
LANGUAGE_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


@query("op2_mixing")
def op2_mixing(spark, sf_dir):
    """Memberships, rates and copies of all documents."""
    from tabulens.llm.mixing import labelled_languages, mix_documents
    docs = table(spark, sf_dir, "documents")
    return mix_documents(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGE_TARGETS)


def _field_sql(*columns):
    """DuckDB: the fields of a leaf, each with its UTF-8 length."""
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || "
                       f"CAST({c} AS VARCHAR) END" for c in columns)


#: DuckDB: CRC-32 of the decimal id, byte by byte and bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"""

MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || source, '0') AS k, sha256({_field_sql('doc_id', 'source', 'lang', 'n_chars', 'text')}) AS leaf,
    sha256({_field_sql('doc_id', 'source', 'lang', 'n_chars', "replace(text, chr(10), '')")}) AS odd_leaf,
    coalesce({_CRC_SQL} % 2 = 0, false) AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY k) AS n FROM d),
inner_up AS (SELECT k, 0 AS level, idx, leaf AS digest, n FROM leaves UNION ALL
  SELECT k, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM inner_up WHERE n > 1
  GROUP BY k, level, idx // 3, n),
subroots AS (SELECT k, digest, row_number() OVER (ORDER BY encode(k)) - 1 AS place, count(*) OVER () AS n FROM inner_up WHERE n = 1),
top_up AS (SELECT 0 AS level, place AS idx, digest, n FROM subroots UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM top_up WHERE n > 1
  GROUP BY level, idx // 3, n),
top_path AS (SELECT k, list(l || '|' || r ORDER BY level) AS path FROM (
  SELECT s.k, u.level, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < s.place // CAST(pow(3, u.level) AS BIGINT)), '') AS l,
    coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > s.place // CAST(pow(3, u.level) AS BIGINT)), '') AS r
  FROM subroots s JOIN top_up u ON u.n > 1 AND u.idx // 3 = s.place // CAST(pow(3, u.level + 1) AS BIGINT)
  GROUP BY s.k, s.place, u.level) GROUP BY k),
leaf_path AS (SELECT k, idx, list(l || '|' || r ORDER BY level) AS path FROM (
  SELECT s.k, s.idx, u.level, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < s.idx // CAST(pow(3, u.level) AS BIGINT)), '') AS l,
    coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > s.idx // CAST(pow(3, u.level) AS BIGINT)), '') AS r
  FROM leaves s JOIN inner_up u ON u.k = s.k AND u.n > 1 AND u.idx // 3 = s.idx // CAST(pow(3, u.level + 1) AS BIGINT)
  GROUP BY s.k, s.idx, u.level) GROUP BY k, idx),
proofs AS (SELECT l.*, s.digest AS subroot, (SELECT digest FROM top_up WHERE n = 1) AS root,
    list_concat(coalesce(p.path, []), coalesce(t.path, [])) AS path
  FROM leaves l JOIN subroots s USING (k) LEFT JOIN leaf_path p USING (k, idx) LEFT JOIN top_path t USING (k)),
folded AS (SELECT *, list_reduce(list_prepend(CASE WHEN changed THEN odd_leaf ELSE leaf END, path),
    lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM folded"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark, sf_dir):
    """Octopus proof and verdict of every document, half of them tampered with."""
    from tabulens.llm.merkle import document_manifest, prove
    proofs = prove(document_manifest(table(spark, sf_dir, "documents")), claimed="tampered")
    return proofs.withColumnRenamed("row_id", "doc_id")


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizers over every document, with corpus-wide counts of the linked pairs."""
    from tabulens.llm.token_alignment import align_documents
    return align_documents(table(spark, sf_dir, "documents"))


#: DuckDB: every 200-byte string of the texts (as hex digits), the bytes that repeated ones cover, and the rest.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS s FROM (SELECT r, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
steps AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM rep),
marked AS (SELECT r, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM steps),
runs AS (SELECT r, run, min(i) AS lo, max(i) + 200 AS hi FROM marked GROUP BY r, run),
kept AS (SELECT r, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS gone, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN spans IS NULL THEN sha256(unhex(h)) ELSE sha256(unhex(array_to_string(list_transform(range(len(los) + 1),
    lambda j: substr(h, CAST(2 * (CASE WHEN j = 0 THEN 0 ELSE his[j] END) + 1 AS BIGINT),
      CAST(2 * ((CASE WHEN j = len(los) THEN len(h) // 2 ELSE los[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE his[j] END)) AS BIGINT))), ''))) END AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


@query("op12_suffix_dedup", REPEATS_SQL)
def op12_suffix_dedup(spark, sf_dir):
    """Bytes of every document outside 200-byte strings that also start elsewhere."""
    from tabulens.llm.repeats import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), length=200)
