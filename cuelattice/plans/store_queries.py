"""Queries over sets, stores and dependency graphs, and small reshaping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as T
from cuelattice.operators import graph as G
from cuelattice.operators import rules as R
from cuelattice.operators import select as P
from cuelattice.operators import sets as S
from cuelattice.plans.adapters import atoms, clauses, job_events, jobs, table, timeline, with_tables, words
from cuelattice.plans.registry import query


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP1: the first document of each normal key."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.letters_key(F.col("text")), 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(with_tables("clauses") + """, t AS (SELECT job, id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM clauses), s AS (
  SELECT job, id, list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, i, 2))) AS ps FROM t WHERE length(k) >= 6)
SELECT x.job, x.id AS a, y.id AS b, round(len(list_intersect(x.ps, y.ps)) / (len(x.ps) + len(y.ps) - len(list_intersect(x.ps, y.ps))), 9) AS similarity FROM s x JOIN s y ON x.job = y.job AND x.id < y.id
WHERE len(list_intersect(x.ps, y.ps)) / (len(x.ps) + len(y.ps) - len(list_intersect(x.ps, y.ps))) >= 0.3""")
def bigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP4, JOIN23: pairs of a job with similar sets of character pairs."""
    rows = clauses(spark, sf_dir).select("job", "id", T.letters_key(F.col("text")).alias("k"))
    return S.pair_similarity(rows, "job", "id", "k", least=0.3).select("job", "a", "b", F.round("similarity", 9).alias("similarity"))


@query("""WITH s AS (SELECT l_orderkey AS job, l_linenumber AS id, count(*) AS n FROM lineitem WHERE l_partkey % 11 > 0 GROUP BY 1, 2), e AS (SELECT o_orderkey AS job, unnest([1, 2, 3, 4]) AS id FROM orders)
SELECT coalesce(e.job, s.job) AS job, coalesce(e.id, s.id)::BIGINT AS id, CASE WHEN n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unknown' ELSE 'repeated' END AS problem
FROM e FULL JOIN s ON e.job = s.job AND e.id = s.id WHERE n IS NULL OR e.id IS NULL OR n > 1""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP6, DUP7, SCL12: expected ids that are missing or seen twice, and unknown ones."""
    seen = table(spark, sf_dir, "lineitem").where("l_partkey % 11 > 0").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("id"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4)])).alias("id"))
    return S.coverage(expected, seen, "job", "id")


@query(with_tables("timeline") + """, p AS (SELECT job, list(CASE WHEN value % 9 = 0 THEN 1 ELSE pos END ORDER BY pos) FILTER (WHERE value % 4 > 0) AS o, list(pos ORDER BY pos) FILTER (WHERE value % 4 = 0) AS x, list(pos ORDER BY pos) AS a FROM timeline GROUP BY job),
q AS (SELECT job, coalesce(o, []) AS o, coalesce(x, []) AS x, a FROM p)
SELECT job, array_to_string(list_filter([CASE WHEN len(o) <> len(list_distinct(o)) THEN 'repeated' END, CASE WHEN len(list_filter(o, lambda i: NOT list_contains(a, i))) > 0 THEN 'unknown' END, CASE WHEN len(list_intersect(o, x)) > 0 THEN 'not_disjoint' END,
  CASE WHEN len(list_filter(a, lambda i: NOT list_contains(o, i) AND NOT list_contains(x, i))) > 0 THEN 'not_covered' END], lambda i: i IS NOT NULL), ',') AS problems FROM q""")
def plan_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP8, DUP9: does a plan cover all ids once, apart from those set aside?"""
    t = timeline(spark, sf_dir)
    own = F.struct("pos", F.when(F.col("value") % 9 == 0, F.lit(1).cast("long")).otherwise(F.col("pos")).alias("v"))
    g = t.groupBy("job").agg(F.sort_array(F.collect_list(F.when(F.col("value") % 4 > 0, own))).alias("o"), F.sort_array(F.collect_list(F.when(F.col("value") % 4 == 0, F.col("pos")))).alias("x"), F.sort_array(F.collect_list("pos")).alias("a"))
    ordered = F.transform("o", lambda s: s["v"])
    return g.select("job", F.array_join(S.plan_problems(ordered, F.array(ordered), F.col("a"), F.col("x")), ",").alias("problems"))


_LISTS = """l AS (SELECT l_orderkey AS job, list(DISTINCT l_partkey % 20) AS base, list(DISTINCT l_suppkey % 20) AS adds, list(DISTINCT l_linenumber::BIGINT) AS removes FROM lineitem GROUP BY 1)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_orderkey").alias("job")).agg(F.collect_set(F.col("l_partkey") % 20).alias("base"), F.collect_set(F.col("l_suppkey") % 20).alias("adds"), F.collect_set(F.col("l_linenumber").cast("long")).alias("removes"))


@query("WITH " + _LISTS + """SELECT job, array_to_string(list_sort(list_distinct(list_concat(list_filter(base, lambda x: NOT list_contains(removes, x)), adds))), ',') AS layered FROM l""")
def vocab_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP10, EXT7: a base without what a layer removes, with what it adds."""
    out = S.layered_list(F.col("base"), F.col("adds"), F.col("removes"))
    return _lists(spark, sf_dir).select("job", F.array_join(F.array_sort(out), ",").alias("layered"))


@query("WITH " + _LISTS + """SELECT job, array_to_string(list_sort(list_filter(list_distinct(list_concat(base, adds)), lambda x: NOT list_contains(removes, x))), ',') AS merged FROM l""")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP11: removal wins."""
    return _lists(spark, sf_dir).select("job", F.array_join(S.patched_list(F.col("base"), F.col("adds"), F.col("removes")), ",").alias("merged"))


@query(with_tables("clauses", "words") + """SELECT job, pos, w FROM (SELECT *, row_number() OVER (PARTITION BY job, s // 2000, w ORDER BY pos) AS rn FROM words) WHERE rn = 1""")
def token_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP12: the first of equal words at one rounded time."""
    return S.first_of(words(spark, sf_dir), ["job", F.floor(F.col("s") / 2000), "w"], ["pos"]).select("job", "pos", "w")


@query(with_tables("timeline") + """, p AS (SELECT job, pos, start - value % 7 * 400 AS a, "end" AS b, lag(start) OVER w AS c, lag("end") OVER w AS d FROM timeline WINDOW w AS (PARTITION BY job ORDER BY pos))
SELECT job, pos, round(greatest(0, least(b, d) - greatest(a, c)) / least(b - a, d - c), 9) AS ratio FROM p WHERE c IS NOT NULL""")
def overlap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP13: shared length of a row and the one before over the shorter."""
    w = Window.partitionBy("job").orderBy("pos")
    t = timeline(spark, sf_dir).select("job", "pos", (F.col("start") - F.col("value") % 7 * 400).alias("a"), F.col("end").alias("b"), F.lag("start").over(w).alias("c"), F.lag("end").over(w).alias("d")).where("c is not null")
    return t.select("job", "pos", F.round(S.overlap_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 9).alias("ratio"))


@query(with_tables("jobs") + "SELECT id, title, created FROM jobs ORDER BY created DESC, id DESC LIMIT 50")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK1, RSH11, SNK11: the newest 50 (the limit is the feature)."""
    return jobs(spark, sf_dir).select("id", "title", "created").orderBy(F.col("created").desc(), F.col("id").desc()).limit(50)


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, SNK4, RSH12: new rows in place of old ones of equal key, and beside them."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    changed = old.where("id % 3 = 0").withColumn("balance", F.col("balance") + 1)
    return S.upsert(old, changed.unionByName(changed.withColumn("id", F.col("id") + 1_000_000)), ["id"])


@query("""SELECT 'jobs' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT 'stages', count(*) FROM lineitem WHERE l_orderkey % 5 > 0""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: parents and their children without the deleted keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    left = S.cascade_delete(o, {"stages": (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")}, o.where("id % 5 = 0"), "id")
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(left["parent"], "jobs").unionByName(n(left["stages"], "stages"))


@query("""SELECT l_orderkey AS job, l_linenumber::BIGINT AS position, l_partkey AS part, CASE WHEN l_linenumber >= l_orderkey % 4 + 2 THEN 'pending' ELSE l_returnflag END AS status FROM lineitem""")
def stage_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5, SNK6, PIPE2: stages from a position on are reset, earlier ones stay."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("position"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("status"))
    return S.rerun_from(x, "position", F.col("job") % 4 + 2, {"status": F.lit("pending")})


@query(with_tables("jobs") + """, w AS (SELECT DISTINCT 'draft-' || c_custkey AS title FROM customer), u AS (SELECT DISTINCT lower(title) AS t FROM jobs WHERE id % 3 > 0),
c AS (SELECT w.title, k, CASE WHEN k = 0 THEN w.title ELSE w.title || '-' || k END AS name FROM w, range(0, 12) r(k))
SELECT title, arg_min(name, k) AS free_name FROM c WHERE lower(name) NOT IN (SELECT t FROM u) GROUP BY title""")
def first_free_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: the first name that nobody uses."""
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("draft-"), F.col("c_custkey").cast("string")).alias("title"))
    return S.free_suffix(wanted, jobs(spark, sf_dir).where("id % 3 > 0").select("title"), "title")


@query(with_tables("timeline") + """, b AS (SELECT job, sum("end" - start)::BIGINT AS body, min(color) AS sig FROM timeline WHERE role <> 'hook' GROUP BY job)
SELECT h.job, h.pos AS hook, h."end" - h.start + b.body AS combined, h.color = b.sig AS same_stream FROM timeline h JOIN b ON b.job = h.job WHERE h.role = 'hook'""")
def hook_body_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: each hook with the body of its job."""
    t = timeline(spark, sf_dir)
    body = t.where("role <> 'hook'").groupBy("job").agg(F.sum(F.col("end") - F.col("start")).alias("body"), F.min("color").alias("sig"))
    return t.where("role = 'hook'").join(body, "job").select("job", F.col("pos").alias("hook"), (F.col("end") - F.col("start") + F.col("body")).alias("combined"), (F.col("color") == F.col("sig")).alias("same_stream"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, 'nder|eur') AND regexp_matches(text, 'tion') AND NOT contains(text, 'license')""")
def second_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12."""
    return table(spark, sf_dir, "documents").where(R.second_product(F.col("text"), "nder|eur", "tion", ["license"])).select("doc_id")


@query(with_tables("timeline") + """, b AS (SELECT job, list(start + 700 ORDER BY pos) AS bs FROM timeline GROUP BY job)
SELECT t.job, t.pos, len(list_filter(bs[2:len(bs) - 1], lambda x: x > t.start + 120 AND x < t."end" - 120)) > 0 AS crosses FROM timeline t JOIN b ON b.job = t.job""")
def scene_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11: rows that a scene boundary cuts."""
    t = timeline(spark, sf_dir)
    b = t.groupBy("job").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "start"))), lambda x: x["start"] + 700).alias("bs"))
    return t.join(b, "job").select("job", "pos", R.crosses_boundary(F.col("start"), F.col("end"), F.col("bs"), 120).alias("crosses"))


@query("""SELECT o_orderkey, k::BIGINT AS point, k * o_totalprice / 6 AS "at" FROM orders, range(0, 6) r(k)""")
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH15: points at even steps."""
    return P.sample_points(table(spark, sf_dir, "orders"), F.col("o_totalprice"), 6).select("o_orderkey", F.col("point").cast("long").alias("point"), "at")


@query(with_tables("clauses", "words") + """, c AS (SELECT job, pos, s, e, string_split(w, '') AS cs FROM words), x AS (SELECT *, len(cs) AS n, unnest(range(0, len(cs))) AS k FROM c)
SELECT job, pos, k AS i, lower(cs[k + 1]) AS ch, s + (e - s) * k / n AS cs_start, s + (e - s) * (k + 1) / n AS cs_end FROM x WHERE regexp_matches(cs[k + 1], '[\\p{L}\\p{N}]')""")
def character_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH1: words as characters with times between; marks take time but give no row."""
    w = words(spark, sf_dir).withColumn("cs", F.filter(F.split("w", ""), lambda c: c != "")).withColumn("n", F.size("cs"))
    x = w.select("job", "pos", "s", "e", "n", F.posexplode("cs").alias("k", "ch")).where(F.col("ch").rlike(r"[\p{L}\p{N}]"))
    at = lambda k: F.col("s") + (F.col("e") - F.col("s")) * k / F.col("n")
    return x.select("job", "pos", F.col("k").cast("long").alias("i"), F.lower("ch").alias("ch"), at(F.col("k")).alias("cs_start"), at(F.col("k") + 1).alias("cs_end"))


@query(with_tables("jobs") + """SELECT j.id, s.name, s.k AS position, CASE WHEN j.status = 'done' THEN 'done' WHEN s.k = 1 THEN 'running' ELSE 'pending' END AS state
FROM jobs j, (VALUES ('asr', 1), ('filter', 2), ('judge', 3), ('order', 4), ('review', 5), ('render', 6)) s(name, k) WHERE NOT (j.id % 4 = 0 AND s.name = 'review')""")
def stage_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH9: a row for each stage of a job; one kind of job has no review."""
    stages = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("position")) for k, n in enumerate(("asr", "filter", "judge", "order", "review", "render"), 1)])
    x = jobs(spark, sf_dir).select("id", "status", F.inline(stages)).where("not (id % 4 = 0 and name = 'review')")
    return x.select("id", "name", "position", F.when(F.col("status") == "done", "done").when(F.col("position") == 1, "running").otherwise("pending").alias("state"))


@query(with_tables("job_events") + """, s AS (SELECT *, max(id) FILTER (WHERE kind = 'purchase') OVER (PARTITION BY job) AS m FROM job_events) SELECT job, count(*) AS n, max(value) AS best FROM s WHERE m IS NULL OR id > m GROUP BY job""")
def events_after_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, RSH10: events of a job since its last of one kind."""
    e = job_events(spark, sf_dir)
    last = F.max(F.when(F.col("kind") == "purchase", F.col("id"))).over(Window.partitionBy("job"))
    return e.withColumn("m", last).where("m is null or id > m").groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))


@query(with_tables("timeline") + """, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY job) AS n FROM timeline)
SELECT job, pos FROM n WHERE n <= 3 OR k IN (0, n // 3, 2 * n // 3)""")
def stride_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK3: three rows of a job at even steps."""
    return P.stride_sample(timeline(spark, sf_dir), "job", "pos", 3).select("job", "pos")


_PATHS = with_tables("clauses", "atoms").replace("WITH ", "WITH RECURSIVE ", 1) + """, edges AS (SELECT job, id, unnest(needs) AS need FROM atoms), paths AS (
  SELECT job, id, need FROM edges UNION SELECT p.job, p.id, e.need FROM paths p JOIN edges e ON e.job = p.job AND e.id = p.need),
states AS (SELECT a.job, a.id, CASE WHEN EXISTS (FROM paths p WHERE p.job = a.job AND p.id = a.id AND NOT EXISTS (FROM atoms b WHERE b.job = p.job AND b.id = p.need)) THEN 'missing'
  WHEN EXISTS (FROM paths p JOIN paths c ON c.job = p.job AND c.id = p.need AND c.id = c.need WHERE p.job = a.job AND p.id = a.id) THEN 'cycle' ELSE 'valid' END AS state FROM atoms a)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(spark, sf_dir).select("job", "id", F.explode("needs").alias("need"))


@query(_PATHS + "SELECT job, id, need FROM paths")
def closure_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH1: everything a row needs."""
    return G.reachable(_edges(spark, sf_dir), "job")


@query(_PATHS + "SELECT job, id, state FROM states")
def invalid_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH1, GRAPH2: rows whose needs are missing or circular."""
    return G.dependency_states(atoms(spark, sf_dir), _edges(spark, sf_dir), "job")


@query(_PATHS + """, rows_ AS (SELECT *, 't' || job % 2 || (id // 6) AS topic, ['f' || id % 9] AS facts FROM atoms), m AS (SELECT job, id AS root, need AS id FROM paths UNION SELECT job, id, id FROM atoms),
b AS (SELECT m.job, m.root, list(r.id ORDER BY r.id) AS members, count(DISTINCT topic) AS topics, bool_and(r.id % 8 <> 5) AS ok, count(*) AS nf, count(DISTINCT facts[1]) AS df, min(r.start) AS start, max(r."end") AS "end", sum(r."end" - r.start)::BIGINT AS length
  FROM m JOIN states s ON s.job = m.job AND s.id = m.root AND s.state = 'valid' JOIN rows_ r ON r.job = m.job AND r.id = m.id GROUP BY 1, 2)
SELECT job, root, array_to_string(members, ',') AS members, start, "end", length FROM b WHERE topics = 1 AND ok AND nf = df""")
def dependency_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH3: whole closures of one topic without a fact twice."""
    rows = atoms(spark, sf_dir).withColumns({"topic": F.concat(F.lit("t"), (F.col("job") % 2).cast("string"), F.floor(F.col("id") / 6).cast("string")), "facts": F.array(F.concat(F.lit("f"), (F.col("id") % 9).cast("string")))})
    out = G.dependency_blocks(rows, _edges(spark, sf_dir), "job", usable=F.col("id") % 8 != 5)
    return out.select("job", "root", F.array_join("members", ",").alias("members"), "start", "end", "length")
