"""Queries over gates, verdicts and record shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.operators import records as C
from cuelattice.plans.adapters import atoms, clauses, jobs, table, timeline, with_tables, words
from cuelattice.plans.registry import query


@query("""SELECT doc_id, replace(translate(text, 'éèê', 'eee'), 'ç', 'ss') AS mapped, translate(lower(regexp_replace(text, '[^一-鿿A-Za-z0-9]+', '', 'g')), '0123456789', '') AS bare FROM documents""")
def character_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6, STR7, STR11: characters by a table; keys without numerals."""
    return table(spark, sf_dir, "documents").select("doc_id", C.mapped_characters(F.col("text"), {"é": "e", "è": "e", "ê": "e", "ç": "ss"}).alias("mapped"), C.without_numerals(T.normal_key(F.col("text"))).alias("bare"))


@query("""SELECT event_id, CASE WHEN value / 100 < 0.5 THEN 'not_found' WHEN (event_id % 10) / 10 < 0.86 THEN 'text_differs' ELSE 'fine' END AS state,
  CASE WHEN value / 100 >= 0.6 THEN event_type <> 'error' END AS usable, least(100, event_id % 6 * 25)::BIGINT AS score FROM events""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR12, SCL17: figures and external answers as verdicts."""
    e = table(spark, sf_dir, "events").withColumn("v", C.verdict(F.col("event_type") != "error", F.col("value") / 100, F.col("event_id") % 6))
    return e.select("event_id", C.diagnosis(F.col("value") / 100, F.col("event_id") % 10 / 10).alias("state"), "v.usable", "v.score")


@query("""SELECT event_id, k::VARCHAR AS k, try_cast(k AS BIGINT) AS n FROM (SELECT event_id, props ->> '$.k' AS k FROM events)""")
def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL7, SCL9: answers of the wanted types."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("a")).withColumn("a", F.map_filter("a", lambda k, _: k == "k"))
    both = F.map_concat("a", F.map_from_arrays(F.transform(F.map_keys("a"), lambda _: F.lit("n")), F.map_values("a")))
    return e.select("event_id", C.typed_answers(both, {"k": "string", "n": "bigint"}).alias("t")).select("event_id", "t.k", "t.n")


@query("""SELECT o_orderkey, greatest(0, o_totalprice - 50000) AS seek, o_totalprice - greatest(0, o_totalprice - 50000) AS inner_start, (floor(w * s / 2) * 2)::BIGINT AS width, (floor(h * s / 2) * 2)::BIGINT AS height
  FROM (SELECT *, least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(w, h)) AS s FROM (SELECT *, 640 + o_custkey % 2000 AS w, 480 + o_orderkey % 1500 AS h FROM orders))""")
def cut_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL14."""
    o = table(spark, sf_dir, "orders")
    seek, inner = C.cut_window(F.col("o_totalprice"), F.col("o_totalprice"), 50_000)
    w, h = C.even_size(640 + F.col("o_custkey") % 2000, 480 + F.col("o_orderkey") % 1500, 1280)
    return o.select("o_orderkey", seek.alias("seek"), inner.alias("inner_start"), w.alias("width"), h.alias("height"))


@query("""SELECT user_id AS job, event_type AS kind, min(value) AS least_sharp, round(avg(value), 6) AS mean_light, string_agg(DISTINCT (event_id % 3)::VARCHAR, ',' ORDER BY (event_id % 3)::VARCHAR) AS flags FROM events GROUP BY 1, 2""")
def sample_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL15: measures of samples rolled up."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("kind"), "value", (F.col("event_id") % 3).cast("string").alias("flag"))
    out = C.quality_rollup(e, ["job", "kind"], sharp="value", light="value")
    return out.select("job", "kind", "least_sharp", F.round("mean_light", 6).alias("mean_light"), F.array_join("flags", ",").alias("flags"))


@query(with_tables("timeline") + """, k AS (SELECT *, count(*) FILTER (WHERE role = 'hook' AND pos % 4 > 0) OVER (PARTITION BY job ORDER BY pos) AS hk FROM timeline), m AS (
  SELECT *, CASE WHEN pos % 4 = 0 THEN 'body' WHEN role = 'hook' THEN 'hook_' || chr(64 + hk::INT) ELSE 'body' END AS module FROM k), w AS (
  SELECT *, (SELECT count(DISTINCT module) FROM m x WHERE x.job = m.job AND x.module LIKE 'hook%') AS hooks, (SELECT bool_or(module = 'body') FROM m x WHERE x.job = m.job) AS body FROM m)
SELECT job, pos, module, array_to_string(list_filter([CASE WHEN src <> 1 THEN 'source' END, CASE WHEN role = 'proof' THEN 'role' END, CASE WHEN "end" - start < 1200 OR "end" - start > 8000 THEN 'length' END, CASE WHEN hooks > 2 THEN 'too_many_hooks' END,
  CASE WHEN NOT body THEN 'no_body' END], lambda x: x IS NOT NULL), ',') AS problems FROM w""")
def pick_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH4: picks with modules and problems."""
    t = timeline(spark, sf_dir).withColumns({"module": F.when(F.col("pos") % 4 == 0, "body"), "text": F.lit("x")})
    out = C.pick_problems(t, "job", "pos", least=1200, most=8000, roles=["hook", "result", "demo", "material", "close"], most_hooks=2)
    return out.select("job", "pos", "module", F.array_join("problems", ",").alias("problems"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(source) = 'src1' THEN 'title' END, CASE WHEN length(trim(text)) < 200 THEN 'transcript' END, CASE WHEN doc_id % 7 - 1 < 0 THEN 'likes' END, CASE WHEN n_chars - 900 <= 0 THEN 'duration' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents""")
def input_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH13."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src1", " ").otherwise(F.col("source")).alias("title"), "text", (F.col("doc_id") % 7 - 1).alias("likes"), (F.col("n_chars") - 900).alias("seconds"))
    return C.input_problems(d, title="title", transcript="text", likes="likes", duration="seconds", least_chars=200).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query(with_tables("timeline") + """SELECT job, coalesce(min(pos) FILTER (WHERE value % 10 >= 7), arg_max(pos, {'v': value % 10, 'p': -pos})) AS pos FROM timeline GROUP BY job""")
def window_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH16: the first good window, else the best."""
    return C.best_window(timeline(spark, sf_dir).withColumn("score", F.col("value") % 10), ["job"], "pos", "score", least=7)


@query(with_tables("clauses", "words") + """SELECT w.job, w.id, string_agg(w.w, '' ORDER BY w.pos) AS w FROM words w JOIN clauses c ON c.job = w.job AND c.id = w.id WHERE w.s BETWEEN c.start + 200 AND c.start + 1500 GROUP BY 1, 2""")
def said_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH17, JOIN9."""
    c = clauses(spark, sf_dir).select("job", "id", (F.col("start") + 200).alias("lo"), (F.col("start") + 1500).alias("hi"))
    return C.text_between(words(spark, sf_dir).join(c, ["job", "id"]), ["job", "id"], "pos", "s", "w", "lo", "hi")


@query(with_tables("clauses", "words") + """, r AS (SELECT job, id * 10000 AS f, id * 10000 + 9 - id % 3 AS l FROM clauses), x AS (SELECT r.job, r.f, r.l, min(s) AS start, max(e) AS "end", string_agg(w, '' ORDER BY pos) AS text FROM words w JOIN r ON r.job = w.job AND w.pos BETWEEN r.f AND r.l GROUP BY 1, 2, 3)
SELECT job, f AS first, l AS last, start, "end", text, coalesce(f = lag(l) OVER (PARTITION BY job ORDER BY f) + 1, true) AS contiguous FROM x""")
def sentence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT8: sentences from ranges of word numbers."""
    r = clauses(spark, sf_dir).select("job", (F.col("id") * 10_000).alias("first"), (F.col("id") * 10_000 + 9 - F.col("id") % 3).alias("last"))
    return C.restored_sentences(words(spark, sf_dir), r)


@query(with_tables("timeline") + """, p AS (SELECT job, min(pos) AS pos, sum(CASE WHEN value % 13 = 0 THEN 0 ELSE "end" - start END)::BIGINT AS s, sum("end" - start) AS t FROM timeline GROUP BY job) SELECT job FROM p WHERE abs(s - t) > 5""")
def uncovered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH19: jobs whose pieces don't cover them."""
    t = timeline(spark, sf_dir).withColumn("len", F.col("end") - F.col("start"))
    whole = t.groupBy("job").agg(F.sum("len").alias("total"))
    return C.uncovered(whole, t.where("value % 13 > 0"), ["job"], F.col("total"), F.col("len"), tolerance=5)


@query("""WITH r AS (SELECT l_orderkey AS job, l_linenumber::BIGINT AS attempt, max(l_partkey) % 3 = 0 AS passed, (max(l_partkey) % 2)::VARCHAR AS digest FROM lineitem GROUP BY 1, 2), l AS (SELECT job, max(attempt) AS attempt, arg_max(passed, attempt) AS passed, arg_max(digest, attempt) AS digest FROM r GROUP BY 1)
SELECT o_orderkey AS job, CASE WHEN l.digest = (o_orderkey % 2)::VARCHAR AND passed THEN 'passed' WHEN l.digest = (o_orderkey % 2)::VARCHAR AND attempt >= 3 THEN 'limit_released' ELSE 'held' END AS state FROM orders LEFT JOIN l ON l.job = o_orderkey""")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT6, PIPE3: plans that a review of the same content has released."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("attempt")).agg(F.max("l_partkey").alias("p"))
    reviews = r.select("job", "attempt", (F.col("p") % 3 == 0).alias("passed"), (F.col("p") % 2).cast("string").alias("digest"))
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 2).cast("string").alias("digest"))
    return C.released(plans, reviews, "job", "digest").select("job", "state")


@query(with_tables("clauses", "atoms") + """, p AS (SELECT job, id, 't' || id // 3 % 2 AS topic, id % 4 AS fact, needs, lag(id) OVER (PARTITION BY job ORDER BY id) AS prev, lag(id // 3 % 2) OVER (PARTITION BY job ORDER BY id) AS pt FROM atoms),
x AS (SELECT job, id, 'topic_returns' AS problem FROM (SELECT *, row_number() OVER (PARTITION BY job, topic ORDER BY id) AS k FROM p WHERE pt IS NULL OR pt <> id // 3 % 2) WHERE k > 1
  UNION ALL SELECT job, id, 'fact_repeated' FROM (SELECT *, row_number() OVER (PARTITION BY job, fact ORDER BY id) AS k FROM p) WHERE k > 1 UNION ALL SELECT job, id, 'need_apart' FROM p WHERE len(needs) > 0 AND NOT coalesce(list_contains(needs, prev), false))
SELECT DISTINCT * FROM x""")
def plan_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH5, WIN19: constraints of an ordered plan."""
    p = atoms(spark, sf_dir).select("job", "id", F.concat(F.lit("t"), (F.floor(F.col("id") / 3) % 2).cast("string")).alias("topic"), F.array(F.col("id") % 4).alias("facts"), "needs")
    return C.plan_topics(p, "job", "id")


@query(with_tables("jobs") + """SELECT owner, arg_max(id, {'d': created, 'i': id}) AS recommended, count(DISTINCT status) AS statuses FROM jobs GROUP BY owner""")
def recommended_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK6, SRC12, DUP14: the greatest row of each owner, and its distinct statuses."""
    return jobs(spark, sf_dir).groupBy("owner").agg(F.max_by("id", F.struct("created", "id")).alias("recommended"), F.count_distinct("status").alias("statuses"))


@query(with_tables("clauses") + """SELECT job AS j, sum(length(text))::BIGINT AS chars, count(*) AS clause_count FROM clauses GROUP BY job""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18, SCL13, RSH12: sessions with their number of clauses in place of the clauses."""
    c = clauses(spark, sf_dir).groupBy("job").agg(F.to_json(F.collect_list(F.struct("id", "text"))).alias("clauses_json"))
    x = c.withColumn("c", F.from_json("clauses_json", "array<struct<id:bigint,text:string>>"))
    x = x.select("job", F.aggregate("c", F.lit(0).cast("long"), lambda a, r: a + F.length(r["text"])).alias("chars"), F.size("c").cast("long").alias("clause_count"))
    return C.compact(x, {"job": "j", "chars": "chars", "clause_count": "clause_count"})
