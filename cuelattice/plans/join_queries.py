"""Queries that join over time, by key, or by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.operators import intervals as I
from cuelattice.operators import sets as S
from cuelattice.operators.islands import merge_runs
from cuelattice.operators.scoring import facet_counts
from cuelattice.plans.adapters import atoms, clauses, job_events, jobs, segments, table, timeline, with_tables, words
from cuelattice.plans.registry import query
from cuelattice.plans.text_queries import SPEECH, flagged

MS = 10_000  # width of a time bucket in milliseconds


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to map onto the segments of the job of their number."""
    return clauses(spark, sf_dir).select("job", "id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))


_PIECES = with_tables("clauses", "segments") + """, pieces AS (
  SELECT c.job, c.id, s.seg, greatest(c.start, s.t_start) AS piece_start, least(c."end", s.t_end) AS piece_end,
    s.src_start + (greatest(c.start, s.t_start) - s.t_start) * s.speed_pct / 100 AS source_from,
    s.src_start + (least(c."end", s.t_end) - s.t_start) * s.speed_pct / 100 AS source_to
  FROM clauses c JOIN segments s ON s.job = c.job AND c.start < s.t_end AND c."end" > s.t_start)"""


def _pieces(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    pairs = I.overlap_join(_asked(spark, sf_dir), segments(spark, sf_dir), ["job"], ("c_start", "c_end"), ("t_start", "t_end"), bucket=MS, how=how)
    return I.map_range(pairs, ("c_start", "c_end"), ("t_start", "t_end"), "src_start", F.col("speed_pct") / 100)


@query(_PIECES + "SELECT job, id, seg, piece_start, piece_end, source_from::DOUBLE AS source_from, source_to::DOUBLE AS source_to FROM pieces")
def interval_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN1, JOIN3, FLT10: spans mapped through the segments they overlap, on both clocks."""
    return _pieces(spark, sf_dir).select("job", "id", "seg", "piece_start", "piece_end", F.col("source_from").cast("double"), F.col("source_to").cast("double"))


@query(_PIECES + """SELECT c.job, c.id, count(p.seg) AS n_slices, min(p.seg) AS first_seg, CASE WHEN count(p.seg) = 0 THEN '未知片段' ELSE '' END AS note
  FROM clauses c LEFT JOIN pieces p ON p.job = c.job AND p.id = c.id GROUP BY 1, 2""")
def interval_map_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN2: each span with its first slice, or marked as unknown."""
    out = I.first_slice(_pieces(spark, sf_dir, "left"), ["job", "id"], ["seg"], ["source_from", "source_to"])
    return out.select("job", "id", F.col("n_slices").cast("long").alias("n_slices"), F.col("primary.seg").alias("first_seg"), "note")


@query(with_tables("clauses", "words") + """SELECT w.job, w.pos, min(c.id) AS owner FROM words w LEFT JOIN clauses c ON c.job = w.job AND (w.s + w.e) / 2 BETWEEN c.start AND c."end" - 200
  GROUP BY 1, 2""")
def midpoint_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN4: words by the clause that holds their midpoint; the last 200 ms of a clause hold none."""
    spans = clauses(spark, sf_dir).select("job", F.col("id").alias("owner_id"), "start", (F.col("end") - 200).alias("stop"))
    out = I.owner_join(words(spark, sf_dir), spans, ["job"], (F.col("s") + F.col("e")) / 2, ("start", "stop"), "owner_id", bucket=MS, slack=0)
    return out.select("job", "pos", "owner")


_BASED = """based AS (
  SELECT job, id, base, base + len AS base_end, id = max(id) OVER (PARTITION BY job) AS is_last FROM (
    SELECT job, id, "end" - start AS len, (sum("end" - start) OVER (PARTITION BY job ORDER BY id) - ("end" - start))::BIGINT AS base FROM clauses))"""


@query(with_tables("clauses", "words") + ", " + _BASED + """SELECT b.job, b.id, count(*) AS n, string_agg(w.w, '' ORDER BY w.pos) AS text
  FROM based b JOIN words w ON w.job = b.job AND (w.s + w.e) / 2 >= b.base AND ((w.s + w.e) / 2 < b.base_end OR b.is_last AND (w.s + w.e) / 2 <= b.base_end) GROUP BY 1, 2""")
def rebased_clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN5: texts of clips on the clock of their concatenation; intervals are half open but for the last."""
    based = I.rebase(clauses(spark, sf_dir).select("job", "id", "start", "end"), "job", "id", ("start", "end"))
    mid = words(spark, sf_dir).select("job", "pos", "w", ((F.col("s") + F.col("e")) / 2).alias("m")).withColumn("m2", F.col("m"))
    pairs = I.overlap_join(mid, based.drop("start", "end"), ["job"], ("m", "m2"), ("base", "base_end"), bucket=MS, slack=-0.5)
    held = pairs.where((F.col("m") >= F.col("base")) & ((F.col("m") < F.col("base_end")) | (F.col("is_last") & (F.col("m") <= F.col("base_end")))))
    items = F.sort_array(F.collect_list(F.struct("pos", "w")))
    return held.groupBy("job", "id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(items, lambda x: x["w"]), "").alias("text"))


_SHIFTED = """shifted AS (SELECT job, pos, s + 350 AS s, e + 350 AS e FROM words), near AS (
  SELECT x.job, x.pos, c.id, least(x.e, c."end") - greatest(x.s, c.start) AS over, abs((x.s + x.e) / 2 - (c.start + c."end") / 2) AS far
  FROM shifted x JOIN clauses c ON c.job = x.job)"""


@query(with_tables("clauses", "words") + ", " + _SHIFTED + """SELECT job, pos, coalesce(arg_max(id, {'o': over, 'i': -id}) FILTER (WHERE over > 0), arg_min(id, {'f': far, 'i': id})) AS segment,
  bool_or(over > 0) AS overlaps FROM near GROUP BY 1, 2""")
def max_overlap_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN6: words shifted in time, assigned to the clause they overlap most, else to the nearest."""
    items = words(spark, sf_dir).select("job", "pos", (F.col("s") + 350).alias("s"), (F.col("e") + 350).alias("e"))
    spans = clauses(spark, sf_dir).select("job", F.col("id").alias("seg"), "start", "end")
    return I.greatest_overlap(items, spans, ["job"], "pos", ("s", "e"), ("start", "end"), "seg", bucket=MS).select("job", "pos", "segment", "overlaps")


@query(with_tables("clauses", "words") + """, c AS (SELECT job, id, start + 120 AS a, "end" - 80 AS b FROM clauses)
SELECT c.job, c.id, count(w.pos) AS n, count(*) FILTER (WHERE w.s < c.a - 5) AS cut_head, count(*) FILTER (WHERE w.e > c.b + 5) AS cut_tail,
  CASE WHEN count(w.pos) = 0 THEN 'no_words' ELSE 'ok' END AS state
FROM c LEFT JOIN words w ON w.job = c.job AND w.e > c.a AND w.s < c.b GROUP BY 1, 2""")
def boundary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN8: words within shortened clauses, and those that the bounds cut."""
    c = clauses(spark, sf_dir).select("job", "id", (F.col("start") + 120).alias("a"), (F.col("end") - 80).alias("b"))
    w = words(spark, sf_dir).select("job", "pos", "s", "e")
    out = I.overlap_join(c, w, ["job"], ("a", "b"), ("s", "e"), bucket=MS, how="left").groupBy("job", "id")
    cut = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = out.agg(F.count("pos").alias("n"), cut(F.col("s") < F.col("a") - 5).alias("cut_head"), cut(F.col("e") > F.col("b") + 5).alias("cut_tail"))
    return out.withColumn("state", F.when(F.col("n") == 0, "no_words").otherwise("ok"))


@query(with_tables("clauses") + """SELECT a.job, a.id, min(b.id) AS matched FROM clauses a LEFT JOIN clauses b ON b.job = a.job + 1 AND abs(a.start - b.start) < 700 GROUP BY 1, 2""")
def tolerance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN10: clauses with the first clause of the next job that starts at nearly the same time."""
    a = clauses(spark, sf_dir).select("job", "id", "start").withColumn("key", F.col("job") + 1)
    b = clauses(spark, sf_dir).select(F.col("job").alias("key"), F.col("id").alias("other"), F.col("start").alias("at"))
    return I.tolerance_join(a, b, ["key"], "start", "at", "other", within=700).select("job", "id", "matched")


@query(with_tables("clauses") + """, n AS (SELECT a.job, a.id, b.id AS other, abs(a.start - b.start) AS far FROM clauses a JOIN clauses b ON b.job = a.job + 1 AND abs(a.start - b.start) <= 15000)
SELECT c.job, c.id, arg_min(n.other, {'f': far, 'o': n.other}) AS nearest, min(far) AS distance FROM clauses c LEFT JOIN n ON n.job = c.job AND n.id = c.id GROUP BY 1, 2""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN11, TOPK9: the nearest start within 15 s."""
    a = clauses(spark, sf_dir).select("job", "id", "start").withColumn("key", F.col("job") + 1)
    b = clauses(spark, sf_dir).select(F.col("job").alias("key"), F.col("id").alias("other"), F.col("start").alias("at"))
    return I.nearest_join(a, b, ["key"], "start", "at", "other", within=15_000).select("job", "id", "nearest", "distance")


@query(with_tables("timeline") + """, c AS (
  SELECT b.job, b.pos, c.pos AS candidate, abs(b.start - c.start) AS distance, row_number() OVER (PARTITION BY b.job, b.pos ORDER BY abs(b.start - c.start), c.pos) AS place
  FROM timeline b JOIN timeline c ON c.job = b.job AND (b.product = 'N' OR c.product = b.product) WHERE b.role = 'hook')
SELECT job, pos, candidate, distance, place FROM c WHERE place <= 6""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN12: for each hook the six rows nearest in time, of its product unless that is open."""
    t = timeline(spark, sf_dir)
    blocks = t.where("role = 'hook'").select("job", "pos", "start", F.when(F.col("product") == "N", "").otherwise(F.col("product")).alias("product"))
    found = t.select("job", F.col("pos").alias("cand"), F.col("start").alias("at"), "product")
    out = I.top_by_distance(blocks, found, ["job", "product"], "pos", "start", "at", "cand", most=6)
    return out.select("job", "pos", "candidate", "distance", F.col("place").cast("long").alias("place"))


@query(SPEECH + """SELECT job, count(*) AS total, count(*) FILTER (WHERE reason = '') AS s2_passed, count(*) FILTER (WHERE reason <> '') AS s2_rejected,
  count(*) FILTER (WHERE reason = '' AND id % 3 > 0) AS usable, greatest(0, count(*) FILTER (WHERE reason = '') - count(*) FILTER (WHERE reason = '' AND id % 3 > 0)) AS rejected_by_s3 FROM flagged GROUP BY job""")
def verdict_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN14, AGG2, FLT13: rule verdicts joined with later decisions, counted."""
    rows = flagged(spark, sf_dir)
    later = clauses(spark, sf_dir).where("id % 3 > 0").select("job", "id", F.lit(True).alias("kept"))
    both = rows.join(later, ["job", "id"], "left").withColumn("ok", F.col("usable") & F.coalesce("kept", F.lit(False)))
    return facet_counts(both, "job", F.col("reason") == "", F.col("ok"))


@query(with_tables("job_events") + """SELECT job, kind, id, value FROM (SELECT *, row_number() OVER (PARTITION BY job, kind ORDER BY ts DESC, id DESC) AS rn FROM job_events) WHERE rn = 1""")
def latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN15, JOIN16, RSH10, SNK4: the latest row of each job and kind."""
    return S.latest(job_events(spark, sf_dir), ["job", "kind"], ["ts", "id"]).select("job", "kind", "id", "value")


@query("""SELECT c.c_custkey AS job, x.k AS place, o.o_orderkey AS id, o.o_orderstatus AS status
  FROM customer c, LATERAL (SELECT unnest(range(0, 4)) AS k) x JOIN orders o ON o.o_orderkey = c.c_custkey * 7 + x.k * 3""")
def id_array_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN17: a JSON array of ids looked up, order kept, missing ones dropped."""
    ids = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("c_custkey") * 7 + k * 3))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), ids.alias("ids_json"))
    each = rows.select("job", F.posexplode(F.from_json("ids_json", "array<bigint>")).alias("p", "id")).withColumn("place", F.col("p").cast("long"))
    return each.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "id").select("job", "place", "id", "status")


_RUNS = """runs AS (
  SELECT *, sum(brk) OVER (PARTITION BY job ORDER BY id) AS island FROM (
    SELECT job, id, text, start, "end", id // 3 AS unit, reason = '' AS usable,
      CASE WHEN row_number() OVER w = 1 THEN 0 WHEN id // 3 <> lag(id // 3) OVER w OR (reason = '') <> lag(reason = '') OVER w THEN 1 ELSE 0 END AS brk
    FROM flagged WINDOW w AS (PARTITION BY job ORDER BY id))), merged AS (
  SELECT job, min(id) AS id, string_agg(text, '' ORDER BY id) AS text, min(start) AS start, max("end") AS "end", list(id ORDER BY id) AS members FROM runs WHERE usable GROUP BY job, island)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_runs(flagged(spark, sf_dir).withColumn("unit", F.floor(F.col("id") / 3)), "job", "id", "unit", "usable")


@query(SPEECH + ", " + _RUNS + """, p AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY "end" - start DESC, id) AS place FROM merged)
SELECT job, unnest(members) AS clause, id AS candidate, CASE WHEN place <= 3 THEN place END AS position FROM p""")
def member_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN20: clause to candidate to place in the order; null for candidates that aren't chosen."""
    rows = merged(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("job").orderBy((F.col("end") - F.col("start")).desc(), "id"))
    ordered = rows.withColumn("position", place.cast("long")).where("position <= 3").select("job", F.col("id").alias("candidate"), "position")
    each = rows.select("job", F.explode("members").alias("clause"), F.col("id").alias("candidate"))
    return each.join(ordered, ["job", "candidate"], "left").select("job", "clause", "candidate", "position")




@query("""WITH v AS (SELECT d.doc_id, regexp_matches(text, '(?i)license|password') AS rejected, quality = 0 AS bad, list_filter(string_split(lower(text), ' '), lambda x: length(x) >= 9) AS tokens
  FROM documents d JOIN labels USING (doc_id)), m AS (SELECT * FROM v WHERE rejected <> bad),
a AS (SELECT CASE WHEN len(tokens) = 0 THEN 'unresolved' WHEN bad THEN 'hard_add' ELSE 'hard_remove' END AS action, unnest(CASE WHEN len(tokens) = 0 THEN ['doc ' || doc_id] ELSE tokens END) AS token FROM m)
SELECT action, token, count(*) AS n FROM a GROUP BY 1, 2""")
def rule_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN21, PIPE15: where a human verdict differs from the rule's, the words to add or remove; without words it stays unresolved."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    tokens = F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) >= 9)
    v = d.select("doc_id", F.col("text").rlike("(?i)license|password").alias("rejected"), (F.col("quality") == 0).alias("bad"), tokens.alias("tokens")).where("rejected <> bad")
    none = F.size("tokens") == 0
    action = F.when(none, "unresolved").when(F.col("bad"), "hard_add").otherwise("hard_remove")
    each = v.select(action.alias("action"), F.explode(F.when(none, F.array(F.concat(F.lit("doc "), F.col("doc_id").cast("string")))).otherwise(F.col("tokens"))).alias("token"))
    return each.groupBy("action", "token").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("clauses", "atoms") + """SELECT a.job, a.id, n.need FROM (SELECT job, id, unnest(needs) AS need FROM atoms) n JOIN atoms a ON a.job = n.job AND a.id = n.id
  LEFT JOIN atoms d ON d.job = n.job AND d.id = n.need WHERE d.id IS NULL OR d.id >= a.id""")
def missing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN22: required rows that have not been played yet."""
    rows = atoms(spark, sf_dir)
    needs = rows.select("job", "id", F.explode("needs").alias("need"))
    have = rows.select("job", F.col("id").alias("need"), F.lit(True).alias("there"))
    return needs.join(have, ["job", "need"], "left").where("there is null or need >= id").select("job", "id", "need")


@query(with_tables("jobs", "job_events") + """, e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY id DESC) AS rn FROM job_events),
g AS (SELECT job, count(*) AS n_events, max(id) AS newest FROM e WHERE rn <= 5 GROUP BY job), o AS (SELECT owner, count(*) AS n_jobs FROM jobs GROUP BY owner)
SELECT c_custkey AS job, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_events, 0) AS n_events, newest FROM customer LEFT JOIN o ON owner = c_custkey LEFT JOIN g ON g.job = c_custkey""")
def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN18: a parent with child aggregates, of events the newest five."""
    e = job_events(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("job").orderBy(F.col("id").desc()))).where("k <= 5")
    g = e.groupBy("job").agg(F.count(F.lit(1)).alias("n_events"), F.max("id").alias("newest"))
    o = jobs(spark, sf_dir).groupBy(F.col("owner").alias("job")).agg(F.count(F.lit(1)).alias("n_jobs"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"))
    return p.join(o, "job", "left").join(g, "job", "left").select("job", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), F.coalesce("n_events", F.lit(0)).alias("n_events"), "newest")


@query(with_tables("clauses", "words") + """, b AS (SELECT c.job, c.id, min(w.s) AS head, max(w.e) AS tail FROM clauses c JOIN words w ON w.job = c.job AND w.s < c."end" AND w.e > c.start GROUP BY 1, 2),
j AS (SELECT job, id, head - lag(tail) OVER (PARTITION BY job ORDER BY id) AS pause FROM b)
SELECT job, id, pause, CASE WHEN pause > 650 THEN 'long_pause' WHEN pause < -20 THEN 'overlap' ELSE 'ok' END AS state FROM j WHERE pause IS NOT NULL""")
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN7: pauses between the spoken parts of neighbouring clauses."""
    c = clauses(spark, sf_dir).select("job", "id", "start", "end")
    b = I.overlap_join(c, words(spark, sf_dir).select("job", "pos", "s", "e"), ["job"], ("start", "end"), ("s", "e"), bucket=MS).groupBy("job", "id").agg(F.min("s").alias("head"), F.max("e").alias("tail"))
    pause = F.col("head") - F.lag("tail").over(Window.partitionBy("job").orderBy("id"))
    out = b.withColumn("pause", pause).where("pause is not null")
    return out.select("job", "id", "pause", F.when(F.col("pause") > 650, "long_pause").when(F.col("pause") < -20, "overlap").otherwise("ok").alias("state"))


@query(with_tables("timeline") + """, t AS (SELECT job, src, pos, start - value % 7 * 400 AS a, "end" AS b FROM timeline)
SELECT x.job, x.src, x.pos, min(y.pos) AS earlier FROM t x JOIN t y ON y.job = x.job AND y.src = x.src AND y.pos < x.pos AND least(x.b, y.b) - greatest(x.a, y.a) > 200 GROUP BY 1, 2, 3""")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN24, JOIN25: rows whose source range overlaps an earlier row's."""
    t = timeline(spark, sf_dir).select("job", "src", "pos", (F.col("start") - F.col("value") % 7 * 400).alias("a"), F.col("end").alias("b"))
    return I.self_overlap(t, ["job", "src"], "pos", ("a", "b"), bucket=MS, least=200).select("job", "src", "pos", "earlier")


@query("""SELECT doc_id, lang, coalesce(quality, -1) AS quality, text LIKE '%license%' AS named FROM documents LEFT JOIN labels USING (doc_id)""")
def profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN19: units with their profiles, the right side's columns winning."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(-1).alias("quality"), F.col("text").contains("license").alias("named"))
    p = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q"))
    return d.join(p, "doc_id", "left").select("doc_id", "lang", F.coalesce("q", "quality").alias("quality"), "named")


@query("""SELECT r.r_name AS base, count(*) AS active FROM region r JOIN (SELECT CASE o_orderkey % 3 WHEN 0 THEN r_name WHEN 1 THEN lower(r_name) || '-' || (o_orderkey % 9) ELSE r_name || 'x' END AS title
  FROM orders JOIN region ON o_orderkey % 5 = r_regionkey WHERE o_orderstatus IN ('O', 'P')) t ON regexp_full_match(lower(t.title), lower(r.r_name) || '(-[0-9]+)?') GROUP BY 1""")
def title_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT14, FLT15: active jobs whose title is a base or a base and a number, case aside."""
    r = table(spark, sf_dir, "region")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).join(r, F.col("o_orderkey") % 5 == F.col("r_regionkey"))
    k = F.col("o_orderkey")
    title = F.when(k % 3 == 0, F.col("r_name")).when(k % 3 == 1, F.concat(F.lower("r_name"), F.lit("-"), (k % 9).cast("string"))).otherwise(F.concat("r_name", F.lit("x")))
    base = F.regexp_extract(F.lower(title), r"^(.*?)(?:-[0-9]+)?$", 1)
    counts = o.select(base.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("active"))
    return r.select(F.col("r_name").alias("base"), F.lower("r_name").alias("key")).join(counts, "key").select("base", "active")



