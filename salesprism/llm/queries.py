"""Queries over the corpus tables, one for each operator, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm.common import fold
from salesprism.llm.decontamination import find_contamination
from salesprism.llm.languages import identify_languages, train_languages
from salesprism.llm.licenses import license_sql, scan_licenses
from salesprism.llm.linededup import drop_shared_lines
from salesprism.llm.merkle import build_manifest
from salesprism.llm.mixing import mix_sources
from salesprism.llm.neardup import jaccard_join
from salesprism.llm.ppm import score_documents
from salesprism.llm.resampling import resample
from salesprism.llm.secrets import scan_secrets
from salesprism.llm.topk import top_k
from salesprism.llm.toxicity import score_toxicity, train_toxicity
from salesprism.llm.warc import build_derivatives, pages_as_responses


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, md5(coalesce(text, '')) AS tk, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
nodes AS (SELECT tk, any_value(w) AS w, count(*) AS copies, min(doc_id) AS first_id FROM texts WHERE len(w) > 0 GROUP BY tk),
shingles AS (SELECT DISTINCT tk, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT tk, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM nodes)),
sizes AS (SELECT tk, count(*) AS n FROM shingles GROUP BY tk),
shared AS (SELECT a.tk AS u, b.tk AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.tk <> b.tk GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.tk = u JOIN sizes y ON y.tk = v WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT tk AS u, tk AS v FROM nodes UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
classes AS (SELECT u AS tk, min(first_id) AS class_id FROM reach JOIN nodes ON nodes.tk = v GROUP BY u),
counted AS (SELECT u AS tk, sum(copies) AS linked FROM links JOIN nodes ON nodes.tk = v GROUP BY u)
SELECT t.doc_id, coalesce(c.class_id, t.doc_id) AS class_id, coalesce(n.copies - 1 + coalesce(x.linked, 0), 0)::BIGINT AS n_links
FROM texts t LEFT JOIN nodes n USING (tk) LEFT JOIN classes c USING (tk) LEFT JOIN counted x USING (tk)"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(_table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"), fold("label_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_offending", "worst_start", "worst_end")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify_languages(docs, train_languages(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(pages_as_responses(_table(spark, sf_dir, "pages")), carry=("page_id",))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a crc32 divisible by 7 are checked as if they had one character more."""
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return build_manifest(_table(spark, sf_dir, "documents"), fold("doc_id", 7) == 0, more)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM texts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND doc_id IS DISTINCT FROM holder AS gone FROM keyed LEFT JOIN shared ON shared.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id"""


def crc32_sql(value: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes, bit by bit, lowest bits of a byte first; not for empty strings."""
    bits = f"list_transform(range(8 * octet_length(encode({value}))), lambda i: substr(encode({value})::BIT::VARCHAR, (i - i % 8 + 8 - i % 8)::BIGINT, 1)::BIGINT)"
    step = "lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295)"


MERKLE_SQL = f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
  concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
hashed AS (SELECT rid, doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other FROM rows),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
  coalesce({crc32_sql("doc_id::VARCHAR")} % 7 = 0, false) AS forged FROM hashed),
nodes AS (SELECT lang, 0 AS level, i, leaf AS d, n FROM leaves
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
subroots AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, t AS i, subroot AS d, m AS n FROM subroots
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, i // 2),
steps AS (SELECT rid, o.level, (a.i >> o.level) % 2 AS place, s.d FROM leaves a JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) o ON a.lang IS NOT DISTINCT FROM o.lang
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM a.lang AND s.level = o.level AND s.i = xor(a.i >> o.level, 1)
  UNION ALL SELECT rid, 100 + o.level, (t >> o.level) % 2, s.d FROM leaves a JOIN subroots b ON a.lang IS NOT DISTINCT FROM b.lang CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) o
    LEFT JOIN tops s ON s.level = o.level AND s.i = xor(t >> o.level, 1)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k FROM steps),
folds AS (SELECT rid, 0 AS k, CASE WHEN forged THEN other ELSE leaf END AS d FROM leaves
  UNION ALL SELECT f.rid, o.k, sha256(CASE WHEN o.place = 0 THEN f.d || coalesce(o.d, '') ELSE o.d || f.d END) FROM folds f JOIN ordered o ON o.rid = f.rid AND o.k = f.k + 1),
proofs AS (SELECT rid, sha256(coalesce(string_agg(d, '' ORDER BY k), '')) AS p FROM ordered GROUP BY rid),
roots AS (SELECT d AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM leaves a JOIN subroots b ON a.lang IS NOT DISTINCT FROM b.lang CROSS JOIN roots LEFT JOIN proofs USING (rid) JOIN (SELECT rid, arg_max(d, k) AS d FROM folds GROUP BY rid) f USING (rid)"""

RESAMPLING_SQL = rf"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
dictionary AS (SELECT f, {crc32_sql("f")} % 10000 AS bucket, sum(s) AS s, sum(t) AS t
  FROM (SELECT unnest(w) AS f, 1 AS s, 0 AS t FROM words UNION ALL SELECT f, 0, 1 FROM aims) GROUP BY f),
buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM dictionary GROUP BY bucket),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM buckets, whole),
totals AS (SELECT rid, sum(gain)::BIGINT AS total, count(*) AS n FROM (SELECT rid, unnest(w) AS f FROM words) JOIN dictionary USING (f) JOIN gains USING (bucket) GROUP BY rid),
weighed AS (SELECT rid, doc_id, coalesce(n, 0) AS n_features, len(w) AS n_words, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM words LEFT JOIN totals USING (rid)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (rid)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": JACCARD_SQL, "op3_license_scan": license_sql(), "op9_top_k": TOP_K_SQL, "op11_line_dedup": LINE_DEDUP_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_resampling": RESAMPLING_SQL}
