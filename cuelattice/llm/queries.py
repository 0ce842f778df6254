"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitpack import token_files
from .common import read_table
from .langid import fit, identify, training_fold
from .media import fingerprint_media, store_media
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .quality import RULES, STOP_WORDS, judge_quality
from .secrets import scan_secrets
from .sharding import shard_documents
from .urls import filter_urls

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3, similarity=(85, 100))


OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), r AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _mix_sql(passes: int) -> str:
    """The mix by running sums over documents in the order of their hashes."""
    steps = ["""p0 AS (SELECT *, CASE WHEN base >= 3 THEN 0 ELSE budget END AS room, false AS got FROM d)"""]
    for k in range(passes):
        steps.append(f"""c{k} AS (SELECT *, sum(CASE WHEN NOT got AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) AS cum FROM p{k})""")
        steps.append(f"""g{k} AS (SELECT * EXCLUDE (cum, got), got OR (room > 0 AND size <= room AND cum <= room) AS got, NOT got AND room > 0 AND size <= room AND cum <= room AS fresh FROM c{k})""")
        steps.append(f"""p{k + 1} AS (SELECT * EXCLUDE (room, fresh), room - coalesce(sum(size) FILTER (WHERE fresh) OVER (PARTITION BY source), 0) AS room FROM g{k})""")
    return f"""
WITH w AS (
  SELECT doc_id, source, substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY source
), r AS (
  SELECT *, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 3.0::DOUBLE AS cap FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    (sum(source_size) OVER ())::DOUBLE AS total FROM r
), l AS (SELECT *, (total - full_) / rest AS level FROM o
), t AS (SELECT source, source_size, least(cap, (SELECT min({{'a': cap / w, 'b': level}}).b FROM l WHERE level <= cap / w) * w) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM t
), d AS (
  SELECT w.*, b.source_size, b.target, b.base, floor(b.target - b.base * b.source_size)::BIGINT AS budget
  FROM w JOIN b ON w.source IS NOT DISTINCT FROM b.source
), {", ".join(steps)}
SELECT doc_id, size, source_size, target, ((base + CASE WHEN got THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p{passes}
"""


OP1_SQL = _mix_sql(3)


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, read_table(spark, sf_dir, "labels"), URL_RULES).drop("n_rules")


def _url_sql(support: float = 0.002, confidence: float = 0.5) -> str:
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)(.*)$'"
    given = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in given]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, given, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, given, strict=True)) + " END"
    return f"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), {parts}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), {parts}, 2) AS path, regexp_extract(coalesce(url, ''), {parts}, 3) AS rest FROM pages
), k AS (
  SELECT rid, page_id, list_distinct(list_filter(list_concat(list_concat(
    list_transform(string_split(host, '.'), lambda x: 'h:' || x),
    list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))),
    list_transform(regexp_extract_all(rest, '[?&]([^=&#]+)', 1), lambda x: 'q:' || x)), lambda x: length(x) > 2)) AS tokens FROM u
), b AS (
  SELECT rid, quality = 0 OR toxic = 1 AS bad, tokens FROM k JOIN labels ON page_id = doc_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL
), n AS (SELECT count(*) AS n FROM b WHERE bad OR len(tokens) > 0
), l AS (SELECT x, count(*) FILTER (WHERE bad) AS g FROM (SELECT bad, unnest(tokens) AS x FROM b) GROUP BY x
), o AS (SELECT coalesce(list(x), []) AS xs FROM l, n WHERE g >= ceil({support} * n)
), q AS (SELECT rid, bad, list_sort(list_intersect(tokens, xs)) AS tokens FROM b, o
), s AS (
  SELECT rid, bad, tokens, []::VARCHAR[] AS held, 0 AS j FROM q
  UNION ALL SELECT rid, bad, tokens, list_append(held, tokens[i]), i FROM (SELECT *, unnest(range(j + 1, len(tokens) + 1)) AS i FROM s)
), c AS (SELECT held, count(*) AS f, count(*) FILTER (WHERE bad) AS g FROM s WHERE len(held) > 0 GROUP BY held
), r AS (SELECT held FROM c, n WHERE g >= ceil({support} * n) AND g >= {confidence} * f AND g > 0
), v AS (SELECT DISTINCT tokens FROM k
), m AS (
  SELECT DISTINCT rid FROM k JOIN (SELECT DISTINCT tokens FROM v, r WHERE list_has_all(tokens, held)) USING (tokens)
)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN m.rid IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN m USING (rid)
"""


OP2_SQL = _url_sql()


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = training_fold(F.col("doc_id"))
    model = fit(docs.where(~held), key=F.col("doc_id"))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_media(store_media(read_table(spark, sf_dir, "documents")))
    codes = F.sha2(F.concat_ws(";", F.array_join("codes", ","), F.array_join("times", ",")), 256)
    feature = F.concat_ws(":", F.size("codes").cast("string"), codes)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codes", "times")


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=24)


def word_bpe() -> str:
    """The tokenizer file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), word_bpe(), sequence_length=2048, end_id=0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    fails = " OR ".join(f"100 * {r.part} {'<' if r.below else '>'} {r.percent} * {r.whole}" for r in RULES)
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), l AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), t AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), r AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM t) GROUP BY rid
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_echo_words, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN r USING (rid)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept FROM b
"""


OP5_SQL = _quality_sql()


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), word_bpe(), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_token_files": op7_token_files,
    "op8_media_fingerprints": op8_media_fingerprints,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_minhash_dedup": op10_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op10_minhash_dedup": OP10_SQL,
}
