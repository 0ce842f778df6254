"""Queries over neighbours and runs, and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions.vocab import LATIN
from cuelattice.operators import islands as W
from cuelattice.operators import rules as R
from cuelattice.operators import scoring as A
from cuelattice.plans.adapters import clauses, jobs, segments, table, timeline, with_tables, words
from cuelattice.plans.join_queries import _RUNS, merged
from cuelattice.plans.registry import query
from cuelattice.plans.text_queries import SPEECH, flagged

_TL = with_tables("timeline")


@query(SPEECH + """, n AS (SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY job) AS total, opening IS NOT NULL OR regexp_matches(t, '^(?:this|that|these|those|it|elle|die|das)\\b') AS p,
  ending IS NOT NULL AS q, "end" - start > 5000 AS long_one FROM rejected)
SELECT job, id, 'utterance-' || lpad(k::VARCHAR, 6, '0') || ':0' AS atom_id, p AS requires_previous, q AS requires_next, NOT (p OR q) AS safe_standalone, long_one AS long_complete_utterance,
  array_to_string(list_filter([CASE WHEN p AND k > 0 THEN 'utterance-' || lpad((k - 1)::VARCHAR, 6, '0') || ':0' END, CASE WHEN q AND k + 1 < total THEN 'utterance-' || lpad((k + 1)::VARCHAR, 6, '0') || ':0' END], lambda x: x IS NOT NULL), ',') AS required FROM n""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: what each clause requires of its neighbours."""
    c = clauses(spark, sf_dir)
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    before = R.dependent_start(t, LATIN).isNotNull() | t.rlike(LATIN.leading_reference)
    out = W.neighbour_context(c, "job", "id", before, R.dangling_end(t, LATIN).isNotNull(), long_after=5000, duration=F.col("end") - F.col("start"))
    return out.select("job", "id", "atom_id", "requires_previous", "requires_next", "safe_standalone", "long_complete_utterance", F.array_join("required_atom_ids", ",").alias("required"))


@query(_TL + """, f AS (SELECT *, CASE WHEN lag(src) OVER w IS NULL THEN 0 WHEN src = lag(src) OVER w AND start - lag("end") OVER w BETWEEN -50 AND 600 THEN 0 ELSE 1 END AS brk FROM timeline WINDOW w AS (PARTITION BY job ORDER BY pos)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY job ORDER BY pos) AS island FROM f)
SELECT job, min(pos) AS first, max(pos) AS last, sum("end" - start)::BIGINT AS length, CASE WHEN sum("end" - start) > 10000 THEN 'error' WHEN sum("end" - start) > 5500 THEN 'warning' ELSE 'ok' END AS level FROM i GROUP BY job, island""")
def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2: unbroken runs of one source; over 10 s an error, over 5.5 s a warning."""
    runs = W.source_runs(timeline(spark, sf_dir), "job", "pos", "src", "start", "end", low=-50, high=600)
    level = F.when(F.col("length") > 10_000, "error").when(F.col("length") > 5500, "warning").otherwise("ok")
    return runs.select("job", "first", "last", "length", level.alias("level"))


_ROLE_RUNS = """, f AS (SELECT *, CASE WHEN {v} IS DISTINCT FROM lag({v}) OVER w THEN 1 ELSE 0 END AS brk FROM timeline WINDOW w AS (PARTITION BY job ORDER BY pos)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY job ORDER BY pos) AS island FROM f)"""


@query(_TL + _ROLE_RUNS.format(v="product") + """SELECT job, min(product) AS product, min(pos) AS first, max(pos) AS last, sum("end" - start)::BIGINT AS length FROM i GROUP BY job, island HAVING count(*) > 2 AND sum("end" - start) > 8000""")
def role_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3: runs of one value of more than two rows and 8 s."""
    runs = W.value_runs(timeline(spark, sf_dir), "job", "pos", "product", F.col("end") - F.col("start"))
    return runs.where("n > 2 and length > 8000").select("job", "product", "first", "last", "length")


@query(_TL + _ROLE_RUNS.format(v="role") + """SELECT job, lpad(row_number() OVER (PARTITION BY job ORDER BY min(pos))::VARCHAR, 2, '0') || '.mp4' AS name, min(role) AS role, count(*) AS n FROM i GROUP BY job, island""")
def export_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4, RSH21: neighbouring rows of one value as numbered files."""
    runs = W.value_runs(timeline(spark, sf_dir), "job", "pos", "role", F.lit(0))
    k = F.row_number().over(Window.partitionBy("job").orderBy("first"))
    return runs.select("job", F.concat(F.lpad(k.cast("string"), 2, "0"), F.lit(".mp4")).alias("name"), "role", "n")


@query(SPEECH + ", " + _RUNS + """SELECT job, id, md5(text) AS text_hash, start, "end", array_to_string(members, ',') AS members FROM merged""")
def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5: usable neighbours of one unit as one candidate."""
    return merged(spark, sf_dir).select("job", "id", F.md5("text").alias("text_hash"), "start", "end", F.array_join("members", ",").alias("members"))


@query(with_tables("clauses", "words") + """, f AS (SELECT *, CASE WHEN lag(w) OVER o IS NULL THEN 0 WHEN regexp_matches(lag(w) OVER o, '[.!?]$') OR s - lag(e) OVER o >= 300 THEN 1 ELSE 0 END AS brk FROM words WINDOW o AS (PARTITION BY job ORDER BY pos)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY job ORDER BY pos) AS grp FROM f) SELECT job, grp::BIGINT AS "group", count(*) AS n, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2""")
def token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9, RSH2: words in groups that end at final marks or silences."""
    w = words(spark, sf_dir)
    silence = F.col("s") - F.lag("e").over(Window.partitionBy("job").orderBy("pos")) >= 300
    out = W.token_groups(w, "job", "pos", F.col("w").rlike("[.!?]$"), gap=silence)
    return out.groupBy("job", "group").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))


@query(_TL + """, r AS (SELECT job, pos, role, lag(role) OVER (PARTITION BY job ORDER BY pos) AS was FROM timeline), s AS (SELECT *, row_number() OVER (PARTITION BY job, role ORDER BY pos) AS rn FROM r WHERE was IS DISTINCT FROM role)
SELECT job, pos, role FROM s WHERE rn > 1""")
def value_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN18, WIN19: a value comes back after another."""
    return W.value_returns(timeline(spark, sf_dir), ["job"], "pos", "role").select("job", "pos", "role")


@query(_TL + """, b AS (SELECT *, sum("end" - start) OVER (PARTITION BY job ORDER BY pos) - ("end" - start) AS before FROM timeline) SELECT job, count(*) AS n, sum("end" - start)::BIGINT AS length FROM b WHERE before < 5000 GROUP BY job""")
def opening_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN20: rows of the first 5 s, with the one that crosses."""
    rows = W.opening_rows(timeline(spark, sf_dir), "job", "pos", F.col("end") - F.col("start"), 5000)
    return rows.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("length"))


@query(_TL + """, p AS (SELECT *, unnest(range(0, ("end" - start + 2999) // 3000)) AS piece FROM timeline WHERE "end" > start)
SELECT job, pos, piece::BIGINT AS piece, start + piece * 3000 AS piece_start, least(start + (piece + 1) * 3000, "end") AS piece_end FROM p""")
def piece_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN23: intervals in pieces of 3 s at most."""
    return W.split_pieces(timeline(spark, sf_dir), "start", "end", 3000).select("job", "pos", F.col("piece").cast("long").alias("piece"), "piece_start", "piece_end")


@query(_TL + """, c AS (SELECT *, sum("end" - start) OVER (PARTITION BY job ORDER BY pos) AS hi, "end" - start AS len FROM timeline)
SELECT job, pos, greatest(1, (hi * 30 + 500) // 1000 - ((hi - len) * 30 + 500) // 1000)::BIGINT AS frames FROM c""")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN22: frames at 30 a second without drift."""
    return W.frame_counts(timeline(spark, sf_dir), "job", "pos", F.col("end") - F.col("start"), 30).select("job", "pos", "frames")


@query(_TL + """SELECT job, pos, (sum("end" - start) OVER (PARTITION BY job ORDER BY pos) - ("end" - start))::BIGINT AS "offset" FROM timeline""")
def concat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9, WIN21: where each row begins when all are laid end to end."""
    return W.prefix_offsets(timeline(spark, sf_dir), ["job"], "pos", F.col("end") - F.col("start")).select("job", "pos", "offset")


@query(_TL + """, g AS (SELECT job, pos, start - lag("end") OVER (PARTITION BY job ORDER BY pos) AS gap FROM timeline) SELECT * FROM g WHERE abs(gap) > 2""")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN27: rows that don't begin where the one before ended."""
    return W.gaps(timeline(spark, sf_dir), "job", "pos", "start", "end", 2).select("job", "pos", "gap")


@query("""WITH q AS (SELECT user_id AS job, event_id AS k, value, value < 30 AS quiet, lag(value) OVER w AS before, lead(value) OVER w AS after,
  CASE WHEN row_number() OVER w = 1 OR (value < 30) = lag(value < 30) OVER w THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY job ORDER BY k) AS island FROM q)
SELECT job, min(k) AS first, max(k) AS last, count(*) AS n, arg_min(k, {'v': value, 'k': k}) AS core FROM i WHERE quiet GROUP BY job, island
HAVING count(*) >= 2 AND (coalesce(arg_min(coalesce(before, -1), k) >= 60, false) OR coalesce(arg_max(coalesce(after, -1), k) >= 60, false))""")
def silence_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN15: quiet runs with a loud neighbour, and their quietest frame."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("k"), "value")
    return W.quiet_cores(e, "job", "k", "value", threshold=30, least=2, flank=60)


@query(with_tables("clauses") + """, n AS (SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY id) - 1 AS k FROM clauses), b AS (SELECT DISTINCT job, k // 4 AS batch FROM n)
SELECT n.job, b.batch, n.id, n.k // 4 = b.batch AS own FROM b JOIN n ON n.job = b.job AND n.k BETWEEN b.batch * 4 - 2 AND b.batch * 4 + 5""")
def context_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN26: batches of 4 with 2 rows of context around."""
    return W.context_batches(clauses(spark, sf_dir), "job", "id", 4, 2).select("job", "batch", "id", "own")


@query("""SELECT job, count(*) AS n, sum(e - s)::DOUBLE AS total FROM (SELECT l_orderkey AS job, l_partkey % 100 + 0.5 AS e, l_partkey % 100 + 0.5 - l_linenumber AS s FROM lineitem WHERE l_linenumber > 0) GROUP BY 1""")
def log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN16: spans read from detector logs; the first opening of each log is missing."""
    x = table(spark, sf_dir, "lineitem").where("l_linenumber > 0").select(F.col("l_orderkey").alias("job"), (F.col("l_partkey") % 100 + 0.5).alias("e"), F.col("l_linenumber").alias("d"))
    line = F.concat(F.lit("silence_end: "), F.col("e").cast("string"), F.lit(" | silence_duration: "), F.col("d").cast("string"))
    logs = x.groupBy("job").agg(F.array_join(F.collect_list(line), "\n").alias("log"))
    spans = logs.select("job", F.explode(W.pair_marks(F.col("log"), r"silence_start: ([0-9.]+)", r"silence_end: ([0-9.]+) \| silence_duration: ([0-9.]+)")).alias("s"))
    return spans.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("total"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'codec' END, CASE WHEN p_brand <> 'Brand#11' AND p_size % 2 = 0 THEN 'resolution' END, CASE WHEN abs(p_retailprice - p_size * 20) / 1000 > 0.5 THEN 'av_length' END], lambda x: x IS NOT NULL), ',') AS problems FROM part""")
def stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN17: gates over stream metadata."""
    gate = lambda c, name: F.when(c, F.lit(name))
    problems = F.array_compact(F.array(gate(F.col("p_size") < 10, "codec"), gate((F.col("p_brand") != "Brand#11") & (F.col("p_size") % 2 == 0), "resolution"), gate(F.abs(F.col("p_retailprice") - F.col("p_size") * 20) / 1000 > 0.5, "av_length")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(problems, ",").alias("problems"))


@query(with_tables("jobs") + """, t AS (SELECT * FROM jobs ORDER BY created DESC, id DESC LIMIT 100), c AS (SELECT status, count(*) AS n FROM t GROUP BY 1)
SELECT status, n, sum(CASE WHEN status IN ('queued', 'running') THEN n ELSE 0 END) OVER ()::BIGINT AS active, sum(n) OVER ()::BIGINT AS total FROM c""")
def status_dashboard_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, TOPK1, AGG11: statuses of the newest 100 jobs."""
    return A.status_counts(jobs(spark, sf_dir), newest=100)


@query(_TL + """, m AS (SELECT job, CASE WHEN role = 'hook' THEN 'hook_' || product ELSE 'body' END AS module, "end" - start AS len FROM timeline), g AS (SELECT job, module, count(*) AS n, sum(len)::BIGINT AS length FROM m GROUP BY 1, 2)
SELECT job, module, n, length, CASE WHEN module LIKE 'hook%' THEN length + sum(CASE WHEN module = 'body' THEN length ELSE 0 END) OVER (PARTITION BY job)::BIGINT ELSE length END AS with_body FROM g""")
def landing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3, RSH5, SNK8: rows and length by module, hooks with the body."""
    t = timeline(spark, sf_dir).withColumn("module", F.when(F.col("role") == "hook", F.concat(F.lit("hook_"), "product")).otherwise("body"))
    return A.landing(t, "job", "module", F.col("end") - F.col("start"))


@query("""SELECT left(p_type, 10) AS reason, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def top_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: the five most frequent reasons."""
    return A.top_reasons(table(spark, sf_dir, "part").select(F.col("p_type").alias("reason")), "reason", most=5, chars=10)


_ISSUES = """issues AS (SELECT job, pos, 'segment_too_long' AS code, CASE WHEN "end" - start > 7000 THEN 'error' ELSE 'warning' END AS level FROM timeline WHERE "end" - start > 5000
  UNION ALL SELECT job, pos, 'segment_too_short', NULL FROM timeline WHERE "end" - start < 1200)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).withColumn("len", F.col("end") - F.col("start"))
    long = t.where("len > 5000").select("job", "pos", F.lit("segment_too_long").alias("code"), F.when(F.col("len") > 7000, "error").otherwise("warning").alias("level"))
    return long.unionByName(t.where("len < 1200").select("job", "pos", F.lit("segment_too_short").alias("code"), F.lit(None).cast("string").alias("level")))


@query(_TL + ", " + _ISSUES + """, c AS (SELECT job, code, count(*) AS n, count(*) FILTER (WHERE coalesce(level, 'error') = 'error') AS e, count(*) FILTER (WHERE level = 'warning') AS w FROM issues GROUP BY 1, 2)
SELECT job, sum(e)::BIGINT AS error_count, sum(w)::BIGINT AS warning_count, string_agg(code || '=' || n, ',' ORDER BY code) AS by_type FROM c GROUP BY job""")
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4, PIPE10."""
    out = A.issue_rollup(_issues(spark, sf_dir), "job")
    return out.select("job", "error_count", "warning_count", F.array_join(F.transform("by_type", lambda x: F.concat(x["code"], F.lit("="), x["n"].cast("string"))), ",").alias("by_type"))


@query(_TL + ", " + _ISSUES + """, e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos, code) AS place, count(*) OVER (PARTITION BY job) AS all_errors FROM issues WHERE coalesce(level, 'error') = 'error')
SELECT job, pos, code, all_errors FROM e WHERE place <= 2""")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5."""
    return A.first_issues(_issues(spark, sf_dir), "job", ["pos", "code"], most=2).select("job", "pos", "code", "all_errors")


_UNITS = "units AS (SELECT job, pos, value % 5 AS claim, product AS topic, (value % 10) / 10.0::DOUBLE AS strength, (value % 7) / 7.0::DOUBLE AS relevance, (value % 4) / 4.0::DOUBLE AS hook FROM timeline)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return timeline(spark, sf_dir).select("job", "pos", (v % 5).alias("claim"), F.col("product").alias("topic"), (v % 10 / 10).alias("strength"), (v % 7 / 7).alias("relevance"), (v % 4 / 4).alias("hook"), "start", "end", "role")


@query(_TL + ", " + _UNITS + """, j AS (SELECT *, CASE WHEN lag(topic) OVER (PARTITION BY job ORDER BY pos) <> topic THEN 1 ELSE 0 END AS jump FROM units),
g AS (SELECT job, count(*) AS n, 1 - count(DISTINCT claim) / count(*) AS repetition, sum(jump) / greatest(1, count(*) - 1) AS topic_jump_rate, avg(strength) AS density, avg(relevance) AS consistency, arg_min(hook, pos) AS opening FROM j GROUP BY job)
SELECT job, n, round(density, 9) AS density, round(consistency, 9) AS consistency, opening, round(repetition, 9) AS repetition, round(topic_jump_rate, 9) AS topic_jump_rate,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, opening * 0.25::DOUBLE + density * 0.35::DOUBLE + consistency * 0.25::DOUBLE + (1 - topic_jump_rate) * 0.15::DOUBLE - repetition)), 6) AS predicted_retention FROM g""")
def film_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6."""
    g = A.film_metrics(units(spark, sf_dir), "job", "pos")
    r = lambda c, k=9: F.round(c, k).alias(c)
    return g.select("job", "n", r("density"), r("consistency"), "opening", r("repetition"), r("topic_jump_rate"), r("predicted_retention", 6))


def _hits(words_: tuple[str, ...], text: str) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words_)


_LABELS = "[" + ", ".join(f"{{'s': {_hits(ws, 'text')}, 'l': '{k}'}}" for k, ws in LATIN.categories.items()) + "]"
_QUALITY = f"""(CASE WHEN "end" - start BETWEEN 1200 AND 6500 THEN 3 ELSE 0 END + CASE WHEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) BETWEEN 8 AND 42 THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[。！？!?.]$') THEN 2 ELSE 0 END + {" + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for ws in LATIN.categories.values() for w in ws)}
  + CASE WHEN contains(text, 'with') THEN 2 ELSE 0 END - CASE WHEN opening0 IS NOT NULL THEN 2 ELSE 0 END
  - CASE WHEN starts_with(trim(text), 'Th') AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) < 18 THEN 5 ELSE 0 END - CASE WHEN ending0 IS NOT NULL THEN 4 ELSE 0 END)::BIGINT"""


def _score() -> F.Column:
    return A.quality_score(F.col("text"), F.col("end") - F.col("start"), LATIN, bonus=("with",), low_information=("Th",))


_SCORED = f""", scored AS (SELECT job, id, text, start, "end", CASE WHEN list_max({_LABELS}).s > 0 THEN list_max({_LABELS}).l ELSE 'other' END AS category, {_QUALITY} AS quality FROM (
  SELECT *, nullif(regexp_extract(regexp_replace(text, '^[\\s。！？!?…，,；;：:]+', ''), '^(?:and|but|so|because|of|et|de|und|que|y)\\b', 0), '') AS opening0,
  nullif(regexp_extract(regexp_replace(text, '[\\s。！？!?…，,；;：:]+$', ''), '(?:\\b(?:and|but|because|if|or|of|the|et|de|que|la|und|der|y))$', 0), '') AS ending0 FROM clauses))"""


@query(with_tables("clauses") + _SCORED + "SELECT job, id, category, quality FROM scored")
def category_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9, AGG10: the label of most keyword hits, and the additive score."""
    return clauses(spark, sf_dir).select("job", "id", A.best_label(F.col("text"), LATIN.categories, "other").alias("category"), _score().alias("quality"))


@query(with_tables("clauses") + _SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY job, category ORDER BY id) AS rn, list_position(['hook', 'result', 'pain', 'material', 'color', 'fit', 'scene', 'proof', 'close'], category) AS ord FROM scored WHERE category <> 'other'),
p AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY rn, ord) AS place FROM r) SELECT job, id, category FROM p WHERE place <= 4""")
def digest_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK2: candidates taken from the categories in turn."""
    from cuelattice.operators.select import round_robin

    c = clauses(spark, sf_dir).withColumn("category", A.best_label(F.col("text"), LATIN.categories, "other"))
    return round_robin(c.where("category <> 'other'"), "job", "id", "category", list(LATIN.categories), most=4).select("job", "id", "category")


TOPICS = {"fit": ("ly", "eux"), "color": ("en", "eau"), "fabric": ("ness", "ment"), "scene": ("dans", "with")}
HOOKS = {"contrast": ("but", "mais"), "result": ("tion",), "feeling": ("he",)}
_TOPIC_LIST = ", ".join(f"{{'n': {_hits(ws, 't')}, 'k': {-k}, 'l': '{name}'}}" for k, (name, ws) in enumerate(TOPICS.items()))
_HOOK_LIST = "[" + ", ".join(f"{{'s': {_hits(ws, 's1')}, 'l': '{k}'}}" for k, ws in HOOKS.items()) + "]"


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), s AS (
  SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '[。！？!?；;.\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM t),
h AS (SELECT *, [{_TOPIC_LIST}] AS hits, ss[1] AS s1 FROM s WHERE len(ss) > 0), g AS (SELECT *, list_max(hits) AS best, greatest(1, list_sum(list_transform(hits, lambda x: x.n)))::BIGINT AS total FROM h)
SELECT doc_id, sha256(t) AS source_hash, CASE WHEN list_max({_HOOK_LIST}).s > 0 THEN list_max({_HOOK_LIST}).l ELSE 'plain' END AS hook, CASE WHEN best.n > 0 THEN best.l ELSE 'mixed' END AS primary_focus,
  array_to_string(list_transform(list_slice(list_reverse_sort(list_transform(list_filter(hits, lambda x: x.n > 0), lambda x: {{'v': round(x.n / total, 3), 'l': x.l}})), 1, 3), lambda x: x.l), ',') AS top_topics,
  len(ss)::BIGINT AS sentence_count, len(regexp_extract_all(t, '[？?]'))::BIGINT AS question_count, len(regexp_extract_all(t, '[！!]'))::BIGINT AS exclamation_count, ({_hits(("the", "la"), "t")})::BIGINT AS colloquial_markers FROM g""")
def transcript_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8, TOPK7, PIPE13: a transcript's hook, focus, topics, rhythm and style."""
    p = A.transcript_profile(table(spark, sf_dir, "documents"), "doc_id", "text", TOPICS, HOOKS, products=("ing",), colloquial=("the", "la"), default_hook="plain", default_topic="none", default_focus="mixed")
    top = F.array_join(F.transform(A.top_shares(F.col("distribution"), 3), lambda x: x["topic"]), ",")
    return p.select("doc_id", "source_hash", "hook", "primary_focus", top.alias("top_topics"), "sentence_count", "question_count", "exclamation_count", "colloquial_markers")


@query(_TL + """SELECT job, sum("end" - start)::BIGINT AS total, (sum(greatest(0, "end" - start - 6000)) + 16000)::BIGINT AS "limit", sum("end" - start) <= sum(greatest(0, "end" - start - 6000)) + 16000 AS fits FROM timeline GROUP BY job""")
def duration_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17: long units may exceed the budget by what they are over 6 s."""
    return A.duration_budget(timeline(spark, sf_dir), "job", F.col("end") - F.col("start"), high=15_000, tolerance=1000, long_unit=6000)


@query(_TL + """, f AS (SELECT job, pos, product, list_sort(list_distinct([role, color])) AS s, "end" - start AS len FROM timeline)
SELECT job, product, array_to_string(s, '|') AS fact_set, arg_min(pos, {'l': len, 'p': pos}) AS pos, count(*) AS n FROM f GROUP BY job, product, s""")
def equivalent_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: of rows that say the same the shortest."""
    t = timeline(spark, sf_dir).withColumn("facts", F.array("role", "color"))
    return A.equivalent_units(t, "job", "pos", "product", "facts", F.col("end") - F.col("start"))


@query(_TL + """, g AS (SELECT DISTINCT role AS fact, left(role, 1) AS grp FROM timeline), m AS (SELECT fact, min(fact) OVER (PARTITION BY grp) AS canonical FROM g)
SELECT job, product, array_to_string(list_sort(list(DISTINCT canonical)), ',') AS facts FROM timeline JOIN m ON fact = role GROUP BY 1, 2""")
def fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20: facts by the least name of their group."""
    t = timeline(spark, sf_dir)
    groups = t.select(F.col("role").alias("fact"), F.substring("role", 1, 1).alias("group")).distinct()
    out = A.fact_keys(t.select("job", "product", F.col("role").alias("fact")), groups, "job", "product")
    return out.select("job", "product", F.array_join("facts", ",").alias("facts"))


@query(_TL + """, c AS (SELECT job, role, count(*) AS n, min(pos) AS f FROM timeline WHERE role IN ('result', 'material') GROUP BY 1, 2) SELECT j.job, coalesce(arg_max(c.role, {'n': n, 'f': -f}), 'mixed') AS focus
  FROM (SELECT DISTINCT job FROM timeline) j LEFT JOIN c ON c.job = j.job GROUP BY j.job""")
def focus_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: the most frequent role of those that may lead."""
    return A.mode_of(timeline(spark, sf_dir), "job", "pos", "role", ["result", "material"], "mixed")


@query(with_tables("segments") + """, f AS (SELECT job, speed_pct, min(seg) AS f FROM segments GROUP BY 1, 2), s AS (SELECT job, string_agg(speed_pct::VARCHAR, ',' ORDER BY f) AS speeds FROM f GROUP BY job)
SELECT g.job, max(t_end) AS total_duration, sum((t_end - t_start) * speed_pct)::BIGINT AS source_duration, count(*) AS segments, any_value(speeds) AS speeds FROM segments g JOIN s ON s.job = g.job GROUP BY g.job""")
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, SRC11: lengths on both clocks and distinct speeds in order (source length times 100)."""
    out = A.timeline_summary(segments(spark, sf_dir), "job", "seg", "t_start", "t_end", (F.col("t_end") - F.col("t_start")) * F.col("speed_pct"), "speed_pct")
    return out.select("job", "total_duration", "source_duration", "segments", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("speeds"))


@query(SPEECH + """SELECT job, count(*) FILTER (WHERE reason = '') AS s2, count(*) FILTER (WHERE reason <> '') AS s2rej, count(*) AS "all" FROM flagged GROUP BY job""")
def facet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13."""
    rows = flagged(spark, sf_dir)
    n = lambda k: F.count_if(R.facet(k, F.col("usable"), F.col("reason"))).alias(k)
    return rows.groupBy("job").agg(n("s2"), n("s2rej"), n("all"))


@query("""SELECT o_orderkey, CASE WHEN m <= 15 THEN 'short' WHEN m <= 35 THEN 'middle' ELSE 'long' END AS size, greatest(1, m) AS minutes FROM (SELECT o_orderkey, round(o_totalprice / 6000)::BIGINT AS m FROM orders)""")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK8, RSH14: lengths in minutes and their class."""
    m = F.round(F.col("o_totalprice") / 6000).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(m <= 15, "short").when(m <= 35, "middle").otherwise("long").alias("size"), F.greatest(F.lit(1), m).alias("minutes"))
