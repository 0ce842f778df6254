"""The tables at hand in the shapes that the operators take; times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, id, role, text, start, end: turns of a conversation laid end to end with gaps."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("id"), "role", "text")
    c = c.withColumns({"dur": (300 + F.length("text") % 80 * 100).cast("long"), "gap": (F.col("job") * 7 + F.col("id") * 13) % 10 * 100})
    before = Window.partitionBy("job").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("start", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)))
    return c.select("job", "id", "role", "text", "start", (F.col("start") + F.col("dur")).alias("end"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, id, pos, s, e, w: the words of a clause, evenly spread over its time."""
    c = clauses(spark, sf_dir).withColumn("ws", F.filter(F.split("text", " "), lambda w: w != "")).withColumn("n", F.size("ws"))
    w = c.select("job", "id", "start", "end", "n", F.posexplode("ws").alias("k", "w"))
    at = lambda k: F.col("start") + F.floor((F.col("end") - F.col("start")) * k / F.col("n")).cast("long")
    return w.select("job", "id", (F.col("id") * 10000 + F.col("k")).cast("long").alias("pos"), at(F.col("k")).alias("s"), at(F.col("k") + 1).alias("e"), "w")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, seg, t_start, t_end, src_start, speed_pct: orders of a customer as intervals of an edit timeline."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seg"))
    o = o.withColumns({"dur": (1000 + F.col("seg") % 40 * 100).cast("long"), "speed_pct": F.element_at(F.array(F.lit(100), F.lit(130), F.lit(200)), (F.col("seg") % 3 + 1).cast("int")).cast("long")})
    before = Window.partitionBy("job").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    o = o.withColumn("t_start", F.coalesce(F.sum("dur").over(before), F.lit(0)))
    return o.select("job", "seg", "t_start", (F.col("t_start") + F.col("dur")).alias("t_end"), (F.col("seg") % 7 * 1000).alias("src_start"), "speed_pct")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, id, needs: dependency edges between turns of a conversation; some turns need one that does not exist."""
    c = clauses(spark, sf_dir)
    needs = F.array_compact(F.array(F.when((F.col("id") % 5 == 2) & (F.col("id") > 0), F.col("id") - 1), F.when(F.col("id") % 7 == 3, F.col("id") + 1), F.when((F.col("job") % 6 == 1) & (F.col("id") == 4), F.col("id") - 1), F.when((F.col("job") % 6 == 1) & (F.col("id") == 3), F.lit(4).cast("long"))))
    return c.select("job", "id", "text", "start", "end", F.array_distinct(needs).alias("needs"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, pos, src, start, end, role, product, color, value: line items of an order as a cut list."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey"), F.col("l_quantity"), "l_returnflag", "l_linestatus")
    x = x.groupBy("job", "pos").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("st"))
    roles = F.array(*[F.lit(r) for r in ("hook", "result", "demo", "material", "close", "proof")])
    x = x.withColumns({"dur": (F.col("q").cast("long") % 9 * 1000 + 500), "src": F.col("l_partkey") % 2 + 1, "role": F.element_at(roles, (F.col("l_partkey") % 6 + 1).cast("int"))})
    x = x.withColumn("gap", F.col("l_partkey") % 5 * 200)
    before = Window.partitionBy("job").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("start", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)))
    return x.select("job", "pos", "src", "start", (F.col("start") + F.col("dur")).alias("end"), "role", F.col("f").alias("product"), F.col("st").alias("color"), F.col("l_partkey").alias("value"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, status, created: orders as jobs."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("draft-"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("-"), (F.col("o_orderkey") % 4).cast("string"))).otherwise("")).alias("title"), status.alias("status"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("owner"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, job, kind, value, k, ts: events of a job."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").alias("k"), "ts")


#: The same shapes as DuckDB common table expressions, for the comparison queries.
SQL = {
    "clauses": """clauses AS (
  SELECT job, id, role, text, (sum(dur + gap) OVER (PARTITION BY job ORDER BY id) - dur - gap)::BIGINT AS start,
    (sum(dur + gap) OVER (PARTITION BY job ORDER BY id) - gap)::BIGINT AS "end"
  FROM (SELECT conv_id AS job, turn AS id, role, text, 300 + length(text) % 80 * 100 AS dur, (conv_id * 7 + turn * 13) % 10 * 100 AS gap FROM conversations))""",
    "words": """words AS (
  SELECT job, id, (id * 10000 + k)::BIGINT AS pos, (start + ("end" - start) * k // n)::BIGINT AS s, (start + ("end" - start) * (k + 1) // n)::BIGINT AS e, ws[k + 1] AS w
  FROM (SELECT *, len(ws) AS n, unnest(range(0, len(ws))) AS k FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM clauses)))""",
    "segments": """segments AS (
  SELECT job, seg, (sum(dur) OVER (PARTITION BY job ORDER BY seg) - dur)::BIGINT AS t_start, (sum(dur) OVER (PARTITION BY job ORDER BY seg))::BIGINT AS t_end,
    seg % 7 * 1000 AS src_start, speed_pct
  FROM (SELECT o_custkey AS job, o_orderkey AS seg, 1000 + o_orderkey % 40 * 100 AS dur, [100, 130, 200][o_orderkey % 3 + 1]::BIGINT AS speed_pct FROM orders))""",
    "atoms": """atoms AS (
  SELECT job, id, text, start, "end", list_distinct(list_filter([CASE WHEN id % 5 = 2 AND id > 0 THEN id - 1 END, CASE WHEN id % 7 = 3 THEN id + 1 END,
    CASE WHEN job % 6 = 1 AND id = 4 THEN id - 1 END, CASE WHEN job % 6 = 1 AND id = 3 THEN 4 END], lambda x: x IS NOT NULL)) AS needs FROM clauses)""",
    "timeline": """timeline AS (
  SELECT job, pos, src, (sum(dur + gap) OVER w - dur - gap)::BIGINT AS start, (sum(dur + gap) OVER w - gap)::BIGINT AS "end", role, product, color, value
  FROM (SELECT l_orderkey AS job, l_linenumber::BIGINT AS pos, min(l_partkey) % 2 + 1 AS src, min(l_quantity)::BIGINT % 9 * 1000 + 500 AS dur, min(l_partkey) % 5 * 200 AS gap,
    ['hook', 'result', 'demo', 'material', 'close', 'proof'][min(l_partkey) % 6 + 1] AS role, min(l_returnflag) AS product, min(l_linestatus) AS color, min(l_partkey) AS value FROM lineitem GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY job ORDER BY pos))""",
    "jobs": """jobs AS (
  SELECT o_orderkey AS id, 'draft-' || (o_custkey % 50) || CASE WHEN o_orderkey % 4 > 0 THEN '-' || (o_orderkey % 4) ELSE '' END AS title,
    CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderdate AS created, o_custkey AS owner FROM orders)""",
    "job_events": """job_events AS (SELECT event_id AS id, user_id AS job, event_type AS kind, value, props ->> '$.k' AS k, ts FROM events)""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
