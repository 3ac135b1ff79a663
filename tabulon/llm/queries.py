"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table
from .decontam import find_benchmark
from .line_dedup import drop_shared_lines
from .packing import pack_texts
from .quality import BOILERPLATE, ENDINGS, NAVIGATION, clean_lines
from .simhash import near_duplicates
from .surrogates import replace_personal_data
from .token_spans import count_line_tokens
from .tokens import vocabulary_path
from .toxicity import THRESHOLD, score_toxicity, train
from .warc import read_archives, write_archives
from .wrapper import extract_main_text


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    r = read_archives(spark, folder, with_payload=False)
    return r.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_decontaminate, op3_simhash, op4_packing, op9_warc, op10_main_text)}

LINES = """
  SELECT doc_id, k, line, lower_az AS key, length(lower_az) AS chars FROM (
    SELECT doc_id, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"""

ORACLE = {
    "op1_line_dedup": f"""
WITH lines AS ({LINES}),
shared AS (SELECT key, max(doc_id) AS keep FROM lines WHERE chars >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.k, l.line, coalesce(l.doc_id <> s.keep, false) AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key AND l.chars >= 40)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op2_decontaminate": r"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, pos, pos + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS pos FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS pos FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.pos, p.size, x.item_id FROM places p JOIN wins x ON x.size = p.size AND x.win = p.win),
words AS (SELECT doc_id, count(DISTINCT pos + j) AS n_hit FROM (SELECT DISTINCT doc_id, pos, unnest(range(size)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS keep FROM p GROUP BY hex),
bits AS (SELECT DISTINCT hex, array_to_string(list_transform(string_split_regex(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS b FROM firsts),
codes AS (SELECT hex, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(list_sum(list_transform(range(5), lambda j: CASE WHEN b[i * 5 + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END)) + 1)::BIGINT]), '') AS digest FROM bits)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN firsts USING (hex) JOIN codes USING (hex)""",
}


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.sha2("clean_text", 256).alias("clean_sha256"))


QUERIES["op5_line_quality"] = op5_line_quality
_FAILS = " OR ".join(
    [
        f"NOT regexp_matches(line, '{ENDINGS.replace(chr(39), chr(39) * 2)}')",
        f"regexp_matches(line, '{NAVIGATION}')",
        "5 * length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) > len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))",
        "2 * length(regexp_replace(line, '[^!]+', '', 'g')) > len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))",
        *(f"contains(lower(line), '{p}')" for p in BOILERPLATE),
    ]
)
ORACLE["op5_line_quality"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
raw AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM d)),
lines AS (SELECT doc_id, k, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, regexp_matches(line, '[^\x20\x09-\x0D]') AND ({_FAILS}) AS bad FROM raw),
per AS (SELECT doc_id, count(*) FILTER (WHERE worded) - count(DISTINCT line) FILTER (WHERE worded) AS n_dup_lines,
  coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE bad), 0) AS lost,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT bad), '')) AS clean_sha256 FROM lines GROUP BY doc_id),
wins AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 4), ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS pos FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + j) AS n_repeat_words FROM (SELECT doc_id, pos, unnest(range(5)) AS j FROM again) GROUP BY doc_id),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost, clean_sha256 FROM d LEFT JOIN per USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * word_chars AS kept, clean_sha256 FROM base"""


def usable_labels():
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"), usable=usable_labels())
    out = score_toxicity(docs, net)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op7_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_line_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "n_crossing", "section_tokens")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return out.select("doc_id", "text", "n_entities", "entity_kinds")


#: Of the registered query only; a deployment passes its own secret.
SURROGATE_KEY = "example key"
QUERIES |= {f.__name__: f for f in (op6_toxicity, op7_token_spans, op8_surrogates)}
