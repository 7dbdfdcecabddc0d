"""Every operator as a query over the synthetic tables, with the same query as SQL.

Doubles are rounded to 6 digits and flags are integers on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chimerant.config import NULL_TOKENS
from chimerant.functions import text as tx
from chimerant.functions import vectors as vec
from chimerant.operators import graph, joins, packing, ranges, sets, shuffling, windows
from chimerant.operators import vectors as search_ops
from chimerant.operators.storage import stored
from chimerant.plans import scoring
from chimerant.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


# The order of an order's lines; full rows are unique, (l_orderkey, l_linenumber) is not.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_SQL = ", ".join(LINE_ORDER)
R6 = lambda c: F.round(c, 6)


def segments(t: Tables) -> DataFrame:
    """An order's lines as the segments of a transcript: running lengths make 1-based bounds."""
    li = t.lineitem.select("l_orderkey", *LINE_ORDER, F.col("l_quantity").cast("bigint").alias("length"))
    li = windows.running_sum(li, ["l_orderkey"], [F.col(c) for c in LINE_ORDER], "length", "cumulative_length")
    return li.select(F.col("l_orderkey").alias("transcript_id"), (F.col("cumulative_length") - F.col("length") + 1).alias("start"), F.col("cumulative_length").alias("end"), "length", "cumulative_length")


SEGMENTS_SQL = f"""segments AS (SELECT l_orderkey AS transcript_id, cum - len + 1 AS start_, cum AS end_, len, cum FROM (
  SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS len, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM lineitem))"""


@query(f"""WITH {SEGMENTS_SQL}, o AS (SELECT o_orderkey, o_orderkey % 60 + 1 AS bp, repeat(o_orderpriority || o_orderstatus, 6) AS seq FROM orders)
SELECT o_orderkey, bp, CAST((cum - len + (bp - start_)) // 3 AS BIGINT) AS aa, substr(seq, 1, CAST((cum - len + (bp - start_)) // 3 + 1 AS INT)) AS retained, substr(seq, CAST((cum - len + (bp - start_)) // 3 + 2 AS INT)) AS lost
FROM o JOIN segments ON o_orderkey = transcript_id AND start_ <= bp AND end_ >= bp""")
def interval_split(spark, sf_dir):
    """JN-02, WIN-01, MTH-01, STR-03, DOM-02: breakpoints meet segments, the sequence is split at the residue."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", (F.col("o_orderkey") % 60 + 1).alias("bp"), F.repeat(F.concat("o_orderpriority", "o_orderstatus"), 6).alias("seq"))
    hit = joins.interval(o, segments(t), "o_orderkey", "bp", ["length", "cumulative_length"], "inner")
    hit = hit.withColumn("aa", tx.codon(F.col("_cumulative_length") - F.col("_length") + F.col("bp") - F.col("_start")))
    return hit.select("o_orderkey", "bp", "aa", tx.prefix(F.col("seq"), F.col("aa")).alias("retained"), tx.suffix(F.col("seq"), F.col("aa")).alias("lost"))


@query(f"SELECT l_orderkey, {LINE_SQL}, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS cum, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) // 3 AS cum_aa FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINE_SQL} ROWS UNBOUNDED PRECEDING)")
def running_cumulative(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", *LINE_ORDER, F.col("l_quantity").cast("bigint").alias("q"))
    return windows.running_sum(li, ["l_orderkey"], [F.col(c) for c in LINE_ORDER], "q", "cum").drop("q").withColumn("cum_aa", tx.codon(F.col("cum")))


@query("SELECT * FROM (SELECT user_id, event_id, event_type, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_id IS NOT NULL")
def next_neighbor(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ev = windows.next_neighbour(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], {"event_id": "next_id", "event_type": "next_type"})
    return ev.dropna(subset=["next_id"]).select("user_id", "event_id", "event_type", "next_id", "next_type")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS side, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END) AS next_key FROM orders) WHERE next_key IS NOT NULL")
def next_neighbor_signed(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 2).alias("side"))
    return windows.next_neighbour(o, ["o_custkey", "side"], [windows.signed(F.col("o_orderkey"), F.col("side"), 0)], {"o_orderkey": "next_key"}).dropna(subset=["next_key"])


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def top1_preferred(spark, sf_dir):
    p = F.col("o_orderpriority")
    return windows.first_per_key(Tables(spark, sf_dir).orders, ["o_custkey"], [F.when(p.startswith("1"), 0).when(p.startswith("2"), 1).otherwise(2), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS rn FROM lineitem) WHERE rn = 1")
def first_per_key(spark, sf_dir):
    return windows.first_per_key(Tables(spark, sf_dir).lineitem, ["l_orderkey"], [F.col(c) for c in LINE_ORDER]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, coalesce(s.s_name, '.') AS s_name, coalesce(c.c_name, '.') AS c_name FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0")
def lookup_both_sides(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = joins.lookup(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), t.orders, "l_orderkey", "o_orderkey", {"o_custkey": "o_custkey"})
    li = joins.lookup(li, t.supplier.filter("s_acctbal > 0"), "l_suppkey", "s_suppkey", {"s_name": "s_name"}, ".")
    return joins.lookup(li, t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey", {"c_name": "c_name"}, ".").drop("o_custkey")


@query("SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, a.n, a.q FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_quantity > 10 GROUP BY ALL) a USING (l_orderkey, l_partkey, l_suppkey, l_linenumber)")
def multikey_left(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    agg = li.filter("l_quantity > 10").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    return li.select(*keys).join(agg, keys, "left")


@query("SELECT o_orderkey, CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_shipdate > o_orderdate) AS INT) AS flag FROM orders")
def exists_flag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate")
    hit = joins.exists(o, t.lineitem.filter("l_quantity > 45"), (F.col("id") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")))
    return joins.mark(o, hit.select("id"), "flag").select(F.col("id").alias("o_orderkey"), "flag")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_children(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.missing(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_orderkey, min(CASE WHEN l_returnflag = 'N' AND l_quantity >= 5 THEN 1 ELSE 0 END) AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def min_over_group_flag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kids = t.lineitem.groupBy("l_orderkey").agg(F.min(F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") >= 5), 1).otherwise(0)).alias("k"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return joins.lookup(t.orders.select("o_orderkey"), kids, "o_orderkey", "l_orderkey", {"k": "k", "lo": "lo", "hi": "hi"}).withColumn("k", F.coalesce("k", F.lit(0)))


@query("SELECT event_id, CAST(coalesce(nt = event_type AND abs(nv - value) <= 20, false) AS INT) AS flag FROM (SELECT *, lead(event_type) OVER w AS nt, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def adjacency_strict(spark, sf_dir):
    ev = windows.next_neighbour(Tables(spark, sf_dir).events, ["user_id"], [F.col("ts"), F.col("event_id")], {"event_type": "nt", "value": "nv"})
    return ev.select("event_id", F.coalesce((F.col("nt") == F.col("event_type")) & (F.abs(F.col("nv") - F.col("value")) <= 20), F.lit(False)).cast("int").alias("flag"))


@query("WITH a AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), j AS (SELECT event_id, value, m, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nv FROM events JOIN a USING (user_id)) SELECT event_id, CAST(coalesce(value BETWEEN m - 15 AND m + 15 AND nv BETWEEN m - 15 AND m + 15, false) AS INT) AS loose FROM j")
def adjacency_loose(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    exact = lambda c: F.col(c).cast("decimal(18,4)")  # noqa: E731 - a sum of doubles depends on its order, which decides for values at a bound
    a = ev.groupBy("user_id").agg(F.sum(exact("value")).alias("s"), F.count("value").alias("n"))
    j = windows.next_neighbour(ev.join(a, "user_id"), ["user_id"], [F.col("ts"), F.col("event_id")], {"value": "nv"})
    near = lambda c: F.abs(exact(c) * F.col("n") - F.col("s")) <= 15 * F.col("n")
    return j.select("event_id", F.coalesce(near("value") & near("nv"), F.lit(False)).cast("int").alias("loose"))


@query("""WITH s AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS ship FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), ship) AS d FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT o_orderkey, CAST(coalesce(d > 0 AND d <= 10, false) AS INT) AS w10, CAST(coalesce(d > 0 AND d <= 30, false) AS INT) AS w30, CAST(coalesce(d > 0 AND d <= 60, false) OR coalesce(d BETWEEN -60 AND 0, false) AS INT) AS either FROM j""")
def promoter_windows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = t.lineitem.groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("ship"))
    j = joins.lookup(t.orders.select("o_orderkey", "o_orderdate"), s, "o_orderkey", "l_orderkey", {"ship": "ship"}).withColumn("d", F.datediff("ship", F.to_date("o_orderdate")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    d = F.col("d")
    return j.select("o_orderkey", flag((d > 0) & (d <= 10)).alias("w10"), flag((d > 0) & (d <= 30)).alias("w30"), flag(((d > 0) & (d <= 60)) | d.between(-60, 0)).alias("either"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag <> l_linestatus THEN 1 ELSE 0 END AS code, count(*) AS n FROM lineitem GROUP BY ALL")
def strand_codes(spark, sf_dir):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return Tables(spark, sf_dir).lineitem.groupBy(a, b, F.when(a == "R", 2).when(a != b, 1).otherwise(0).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEGMENTS_SQL} SELECT o_orderkey, CAST(EXISTS (SELECT 1 FROM segments WHERE transcript_id = o_orderkey AND ((o_orderstatus = 'O' AND o_orderkey % 60 + 1 < start_) OR (o_orderstatus <> 'O' AND o_orderkey % 60 + 1 > start_))) AS INT) AS truncated FROM orders")
def truncation_any(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = segments(t).groupBy("transcript_id").agg(F.max("start").alias("hi"), F.min("start").alias("lo"))
    j = joins.lookup(t.orders.select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 60 + 1).alias("bp")), b, "o_orderkey", "transcript_id", {"hi": "hi", "lo": "lo"})
    plus = F.col("o_orderstatus") == "O"
    return j.select("o_orderkey", F.when((plus & (F.col("bp") < F.col("hi"))) | (~plus & (F.col("bp") > F.col("lo"))), 1).otherwise(0).alias("truncated"))


@query(f"""WITH {SEGMENTS_SQL}, f AS (SELECT o_orderkey, max(CASE WHEN start_ <= o_orderkey % 60 + 1 AND end_ >= o_orderkey % 60 + 1 THEN (cum - len + o_orderkey % 60 + 1 - start_) % 3 END) AS f1, max(CASE WHEN start_ <= o_custkey % 90 + 1 AND end_ >= o_custkey % 90 + 1 THEN (cum - len + o_custkey % 90 + 1 - start_) % 3 END) AS f2 FROM orders LEFT JOIN segments ON o_orderkey = transcript_id GROUP BY o_orderkey)
SELECT o_orderkey, f1 AS frame1, f2 AS frame2, CASE WHEN f1 IS NULL THEN 2 WHEN f2 IS NULL THEN 2 WHEN f1 <> f2 THEN 1 ELSE 0 END AS out_of_frame1, CASE WHEN f1 IS NULL OR f2 IS NULL THEN 2 WHEN f1 <> f2 THEN 1 ELSE 0 END AS out_of_frame2 FROM f""")
def frame_pair(spark, sf_dir):
    from chimerant.plans.features import frames

    t = Tables(spark, sf_dir)
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("transcript_id1"), F.col("o_orderkey").alias("transcript_id2"), (F.col("o_orderkey") % 60 + 1).alias("breakpoint1"), (F.col("o_custkey") % 90 + 1).alias("breakpoint2"))
    return frames(o, segments(t)).select(F.col("id").alias("o_orderkey"), "frame1", "frame2", "out_of_frame1", "out_of_frame2")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CAST(coalesce(s_nationkey = c_nationkey, false) AS INT) AS same, CAST(coalesce(s_nationkey = c_nationkey AND l_returnflag <> 'N', false) AS INT) AS same_lost FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def same_key_flags(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = joins.lookup(t.lineitem, t.orders, "l_orderkey", "o_orderkey", {"o_custkey": "o_custkey"})
    j = joins.lookup(j, t.customer, "o_custkey", "c_custkey", {"c_nationkey": "cn"})
    j = joins.lookup(j, t.supplier, "l_suppkey", "s_suppkey", {"s_nationkey": "sn"})
    same = F.coalesce(F.col("cn") == F.col("sn"), F.lit(False))
    return j.select("l_orderkey", "l_linenumber", "l_suppkey", same.cast("int").alias("same"), (same & (F.col("l_returnflag") != "N")).cast("int").alias("same_lost"))


@query("SELECT o_orderkey, " + ", ".join(f'CAST(o_totalprice > {t} * 100000 AND o_orderstatus <> \'F\' AS INT) AS "v_{t}"' for t in (1.5, 2.0, 3.0)) + " FROM orders")
def threshold_flags(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", *(((F.col("o_totalprice") > v * 100000) & (F.col("o_orderstatus") != "F")).cast("int").alias(f"v_{v}") for v in (1.5, 2.0, 3.0)))


@query("""WITH f AS (SELECT event_type = 'click' AS a, value > 50 AS b, user_id % 2 = 0 AS c FROM events)
SELECT 'click' AS type, count(*) FILTER (WHERE a) AS n FROM f UNION ALL SELECT 'large', count(*) FILTER (WHERE b) FROM f UNION ALL SELECT 'even', count(*) FILTER (WHERE c) FROM f UNION ALL SELECT 'none', count(*) FILTER (WHERE NOT (coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false))) FROM f""")
def category_counts(spark, sf_dir):
    flags = {"click": F.col("event_type") == "click", "large": F.col("value") > 50, "even": F.col("user_id") % 2 == 0}
    one = Tables(spark, sf_dir).events.agg(*(F.count_if(c).alias(k) for k, c in flags.items()), F.count_if(~sets.any_of([F.coalesce(c, F.lit(False)) for c in flags.values()])).alias("none"))
    return one.unpivot([], list(one.columns), "type", "n")


@query("SELECT doc_id, CAST(regexp_matches(coalesce(text, ''), '(the of)|(de la)|(und der)') AS INT) AS cls, CAST(coalesce(regexp_matches(source, '(?i)SRC1'), false) AS INT) AS role FROM documents")
def regex_class_flags(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", tx.any_pattern(F.col("text"), ["the of", "de la", "und der"]).cast("int").alias("cls"), F.coalesce(F.col("source").rlike("(?i)SRC1"), F.lit(False)).cast("int").alias("role"))


@query("SELECT o.o_orderkey AS id, o.o_orderstatus AS status, o.o_totalprice AS price, n.items FROM orders o LEFT JOIN (SELECT l_orderkey AS id, count(*) AS items FROM lineitem GROUP BY 1) n ON o.o_orderkey = n.id")
def additive_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    base = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    more = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("items"), F.max("l_returnflag").alias("status"))
    return joins.additive(base, more)


@query("SELECT DISTINCT nation, seg FROM (SELECT c_nationkey AS nation, c_mktsegment AS seg FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier)")
def union_dedup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sets.union_all(t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg")), t.supplier.select(F.col("s_nationkey").alias("nation"))).distinct()


@query("SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY 1, 2")
def ordered_distinct(spark, sf_dir):
    return sets.ordered_distinct(Tables(spark, sf_dir).events.select("user_id", "event_type", F.col("event_id").alias("place")), "place")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k > 1")
def duplicate_keys(spark, sf_dir):
    return sets.duplicated(Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys FROM lineitem")
def key_counts(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("l_orderkey").alias("n_keys"))


PAIRED_SQL = """p AS (SELECT u.user_id, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b FROM (SELECT DISTINCT user_id FROM events) u
 LEFT JOIN (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE value > 50 GROUP BY 1) a USING (user_id) LEFT JOIN (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE event_id % 3 = 0 GROUP BY 1) b USING (user_id)),
m AS (SELECT user_id, len(a) AS n_a, len(b) AS n_b, len(list_intersect(a, b)) AS n_intersection, len(a) + len(b) - len(list_intersect(a, b)) AS n_union FROM p),
s AS (SELECT *, CASE WHEN n_b > 0 THEN n_intersection / CAST(n_b AS DOUBLE) ELSE 0.0 END AS precision_, CASE WHEN n_a > 0 THEN n_intersection / CAST(n_a AS DOUBLE) ELSE 0.0 END AS recall_, CASE WHEN n_union > 0 THEN n_intersection / CAST(n_union AS DOUBLE) ELSE 0.0 END AS jaccard_ FROM m)"""


def _paired(t: Tables) -> DataFrame:
    ev = t.events
    both = ev.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("b"))
    return both.select("user_id", *(v.alias(k) for k, v in sets.overlap(F.col("a"), F.col("b")).items()))


@query(f"WITH {PAIRED_SQL} SELECT user_id, CAST(n_a AS INT) AS n_a, CAST(n_b AS INT) AS n_b, CAST(n_intersection AS INT) AS n_intersection, CAST(n_union AS INT) AS n_union, round(precision_, 6) AS prec, round(recall_, 6) AS rec, round(CASE WHEN n_intersection > 0 THEN 2 * precision_ * recall_ / (precision_ + recall_) ELSE 0.0 END, 6) AS f1, round(jaccard_, 6) AS jaccard FROM s")
def set_similarity(spark, sf_dir):
    p = _paired(Tables(spark, sf_dir))
    return p.select("user_id", "n_a", "n_b", "n_intersection", "n_union", R6("precision").alias("prec"), R6("recall").alias("rec"), R6("f1").alias("f1"), R6("jaccard").alias("jaccard"))


@query(f"WITH {PAIRED_SQL} SELECT coalesce(CAST(n_a AS VARCHAR), 'ALL') AS grp, count(*) AS n_rows, count(*) FILTER (WHERE n_intersection = n_a) AS n_full, round(avg(precision_), 6) AS prec, round(avg(jaccard_), 6) AS jaccard FROM s GROUP BY ROLLUP (n_a)")
def set_similarity_stats(spark, sf_dir):
    p = _paired(Tables(spark, sf_dir))
    g = p.rollup("n_a").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_intersection") == F.col("n_a")).alias("n_full"), R6(F.avg("precision")).alias("prec"), R6(F.avg("jaccard")).alias("jaccard"))
    return g.select(F.coalesce(F.col("n_a").cast("string"), F.lit("ALL")).alias("grp"), "n_rows", "n_full", "prec", "jaccard")


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY t0, first_id) AS event_types FROM (SELECT user_id, event_type, min(ts) AS t0, arg_min(event_id, ts) AS first_id FROM (SELECT * FROM events ORDER BY event_id) GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_agg(spark, sf_dir):
    return sets.ordered_distinct_cell(Tables(spark, sf_dir).events, ["user_id"], "event_type", ["ts", "event_id"])


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n_words, CASE WHEN trim(coalesce(text, '')) IN ('', '.') THEN 0 ELSE len(list_filter(string_split(text, '|'), lambda x: trim(x) <> '')) END AS n_cells, CASE WHEN trim(coalesce(source, '')) IN ('', '.') THEN '' ELSE 'r1:' || replace(source, ' ', '_') END AS token FROM documents")
def token_count(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", F.size(tx.words(F.col("text"))).cast("bigint").alias("n_words"), tx.count_tokens(F.col("text")).cast("bigint").alias("n_cells"), F.coalesce(F.try_element_at(tx.side_tokens({"r1": F.col("source")}), F.lit(1)), F.lit("")).alias("token"))


@query("SELECT doc_id, format('{}:{}-{}:{}', doc_id, 40, 80, lang) AS window_id, greatest(1, 8) AS lo, CAST(least(length(text), 112) AS INT) AS hi, substr(text, 8, CAST(least(length(text), 112) - 8 + 1 AS INT)) AS part FROM documents WHERE length(text) >= 80")
def context_window(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.filter(F.length("text") >= 80)
    low, high, part = tx.context(F.col("text"), F.lit(40), F.lit(80), 32, 32)
    return d.select("doc_id", F.format_string("%d:%d-%d:%s", "doc_id", F.lit(40), F.lit(80), "lang").alias("window_id"), low.alias("lo"), high.alias("hi"), part.alias("part"))


@query("SELECT doc_id, i AS pos, length(substr(text, i * 800 + 1, 1200)) AS n, md5(substr(text, i * 800 + 1, 1200)) AS h FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) > 1500 THEN range(0, CAST(ceil((length(text) - 1200) / 800.0) AS BIGINT) + 1) ELSE [0] END) AS i FROM documents WHERE length(text) > 1500)")
def sliding_windows(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.filter(F.length("text") > 1500)
    w = d.select("doc_id", F.posexplode(tx.sliding(F.col("text"), 1200, 800, 1500)).alias("pos", "part"))
    return w.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("part").cast("bigint").alias("n"), F.md5(F.col("part").cast("binary")).alias("h"))


@query("SELECT p_partkey AS id, 'p_name' AS col, '>' || p_partkey || '|side=p_name|len=' || length(p_name) || chr(10) || p_name AS value FROM part WHERE coalesce(p_name, '') NOT IN ('', '.') UNION ALL SELECT p_partkey, 'p_brand', '>' || p_partkey || '|side=p_brand|len=' || length(p_brand) || chr(10) || p_brand FROM part WHERE coalesce(p_brand, '') NOT IN ('', '.')")
def fasta_export(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    return writers.fasta_records(p, ["p_name", "p_brand"])


@query("SELECT p_partkey, CAST(least((row_number() OVER (ORDER BY p_partkey) - 1) // CAST(ceil((SELECT count(*) FROM part) / 32.0) AS BIGINT), 31) AS INT) AS chunk FROM part")
def chunk_assignment(spark, sf_dir):
    return writers.chunked(Tables(spark, sf_dir).part.select("p_partkey"), ["p_partkey"], 32)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract_all(url, '([0-9]+)', 1) AS numbers, split_part(url, '.', 1) AS stem FROM pages")
def attr_parse(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract_all("url", F.lit("([0-9]+)"), 1).alias("numbers"), tx.unversioned(F.col("url")).alias("stem"))


@query("SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS event_type, TRY_CAST(event_type AS BIGINT) AS as_int FROM events")
def null_tokens(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", tx.nulls(F.col("event_type"), [*NULL_TOKENS, "error", "view"]).alias("event_type"), F.col("event_type").try_cast("bigint").alias("as_int"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS n, round(CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 1e-12), 6) AS first FROM embeddings")
def l2_normalize(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return e.select("vec_id", R6(vec.norm(F.col("embedding"))).alias("n"), R6(F.element_at(vec.normalised(F.col("embedding")), 1)).alias("first"))


DOUBLES = "CAST(embedding AS DOUBLE[])"
HITS_SQL = f"""e AS (SELECT vec_id, label, {DOUBLES} AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
hits AS (SELECT * FROM (SELECT q.vec_id AS query, e.vec_id AS item, e.label, round(list_inner_product(q.v, e.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, e.v), 6) DESC, e.vec_id) AS rank FROM q, e) WHERE rank <= 20)"""


def _hits(t: Tables, k: int = 20, metric: str = "ip") -> DataFrame:
    e = t.embeddings
    return search_ops.search(e.filter("vec_id % 100 = 0"), e, k, "vec_id", "vec_id", "embedding", "embedding", metric)


@query(f"WITH {HITS_SQL} SELECT query, item, score, CAST(rank AS INT) AS rank FROM hits")
def dot_topk(spark, sf_dir):
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return _hits(Tables(spark, sf_dir))


@query(f"WITH e AS (SELECT vec_id, {DOUBLES} AS v FROM embeddings) SELECT * FROM (SELECT q.vec_id AS query, e.vec_id AS item, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(-(list_distance(q.v, e.v) ** 2), 6) DESC, e.vec_id) AS INT) AS rank FROM e q, e WHERE q.vec_id % 100 = 0) WHERE rank <= 20")
def l2_topk(spark, sf_dir):
    return _hits(Tables(spark, sf_dir), metric="l2").drop("score")


@query(f"WITH {HITS_SQL}, b AS (SELECT query, label, max(score) AS best, min(rank) AS f FROM hits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY f) AS place FROM b) SELECT query, string_agg(CAST(label AS VARCHAR), '|' ORDER BY best DESC, place) AS labels FROM r WHERE place <= 8 GROUP BY 1")
def dedup_topk_labels(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = _hits(t).join(t.embeddings.select(F.col("vec_id").alias("item"), "label"), "item")
    best = search_ops.first_unique(named, "label", 8)
    return best.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("s"), "place", F.col("label").cast("string").alias("l")))), lambda x: x["l"]), "|").alias("labels"))


@query("SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def vector_group_mean(spark, sf_dir):
    return search_ops.group_mean(Tables(spark, sf_dir).embeddings, "label", "embedding").withColumn("value", R6("value"))


TFIDF_SQL = r"""tok AS (SELECT item_id AS row_, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS token FROM benchmark), tf AS (SELECT row_, token, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT row_, token, tf * (ln((1 + (SELECT count(DISTINCT row_) FROM tok)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (token)), tfidf AS (SELECT row_, token, w / sqrt(sum(w * w) OVER (PARTITION BY row_)) AS weight FROM w)"""


def _tfidf(t: Tables) -> DataFrame:
    return scoring.tfidf(t.benchmark.select(F.col("item_id").alias("row"), F.explode(tx.words(F.lower("text"))).alias("token")))


@query(f"WITH {TFIDF_SQL} SELECT row_ AS item_id, token, round(weight, 6) AS weight FROM tfidf")
def tfidf(spark, sf_dir):
    return _tfidf(Tables(spark, sf_dir)).select(F.col("row").alias("item_id"), "token", R6("weight").alias("weight"))


@query("SELECT doc_id, CAST(coalesce(quality, 2) AS DOUBLE) AS of1, CAST(CASE WHEN coalesce(quality, 2) = 2 THEN 1 ELSE 0 END AS DOUBLE) AS nc1, CAST(CASE WHEN trim(coalesce(text, '')) IN ('', '.') THEN 0 ELSE len(list_filter(string_split(text, '|'), lambda x: trim(x) <> '')) END AS DOUBLE) AS r1 FROM documents LEFT JOIN labels USING (doc_id)")
def numeric_block(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.col("quality").cast("string").alias("out_of_frame1"), F.lit(None).cast("string").alias("out_of_frame2"), F.col("text").alias("retained_domains1"), *(F.lit(".").alias(c) for c in ("lost_domains1", "retained_domains2", "lost_domains2")))
    n = scoring.numeric(d)
    return d.select("doc_id", n["of1"].alias("of1"), n["nc1"].alias("nc1"), n["r1"].alias("r1"))


GRAPH_SQL = f"""e AS (SELECT vec_id, label, list_transform({DOUBLES}, lambda x: x / greatest(sqrt(list_inner_product({DOUBLES}, {DOUBLES})), 1e-12)) AS v FROM embeddings),
near AS (SELECT src, dst, s FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.v, b.v), 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 6) DESC, b.vec_id) AS r FROM e a, e b) WHERE r <= 20),
half AS (SELECT src, dst, greatest(s, 0.0) / 2 AS w FROM near), adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM half UNION ALL SELECT dst, src, w FROM half) WHERE src <> dst GROUP BY 1, 2 HAVING sum(w) > 0),
p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM adj)"""


def _graph(t: Tables) -> DataFrame:
    return graph.knn_graph(t.embeddings, 20, "vec_id", "embedding")


@query(f"WITH {GRAPH_SQL} SELECT src, dst, round(w + 1e-9, 5) AS w FROM adj")
def knn_graph(spark, sf_dir):
    return _graph(Tables(spark, sf_dir)).withColumn("w", F.round(F.col("w") + 1e-9, 5))


@query(f"WITH {GRAPH_SQL} SELECT src, dst, round(w, 5) AS w FROM p")
def row_stochastic(spark, sf_dir):
    return graph.row_stochastic(_graph(Tables(spark, sf_dir))).withColumn("w", F.round("w", 5))


STEPS_SQL = GRAPH_SQL + ", s0 AS (SELECT vec_id AS node, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM embeddings)" + "".join(f", s{i + 1} AS (SELECT a.node, a.y, 0.9::DOUBLE * coalesce(x.v, 0) + 0.1::DOUBLE * a.y AS s FROM s{i} a LEFT JOIN (SELECT src, sum(w * s) AS v FROM p JOIN s{i} ON dst = node GROUP BY 1) x ON a.node = x.src)" for i in range(3))


def _diffused(t: Tables) -> DataFrame:
    y = (F.col("label") == 1).cast("double")
    s = t.embeddings.select(F.col("vec_id").alias("node"), y.alias("y"), y.alias("s"))
    p = stored(graph.row_stochastic(_graph(t)), "graph")  # once, not once for each step
    for _ in range(3):
        s = graph.step(p, s, 0.9)
    return s


@query(f"WITH {STEPS_SQL} SELECT node, round(s, 5) AS s FROM s3")
def diffusion_fixed(spark, sf_dir):
    return _diffused(Tables(spark, sf_dir)).select("node", F.round("s", 5).alias("s"))


@query(f"WITH {STEPS_SQL} SELECT node, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 4) AS score FROM s3")
def minmax_scores(spark, sf_dir):
    return graph.rescale(_diffused(Tables(spark, sf_dir))).select("node", F.round("score", 4).alias("score"))


def until_converged(p: str, seeds: str, alpha: str, tolerance: str, most: int = 100) -> str:
    """SQL of a diffusion: each round of the recursion is a step, until the change of the one before is below the tolerance."""
    return f"""it AS (SELECT 0 AS i, node, y, y AS s, CAST(1e9 AS DOUBLE) AS change FROM {seeds} UNION ALL
SELECT i, node, y, s, sum(abs(s - old)) OVER () AS change FROM (SELECT a.i + 1 AS i, a.node, a.y, CAST({alpha} AS DOUBLE) * coalesce(x.v, 0) + (1 - CAST({alpha} AS DOUBLE)) * a.y AS s, a.s AS old
FROM it a LEFT JOIN (SELECT src, sum(w * b.s) AS v FROM {p} JOIN it b ON dst = b.node GROUP BY 1) x ON a.node = x.src WHERE a.change >= {tolerance} AND a.i < {most}))"""


@query(f"WITH RECURSIVE {GRAPH_SQL}, y AS (SELECT vec_id AS node, CAST(CASE WHEN label = 1 THEN 1 ELSE 0 END AS DOUBLE) AS y FROM embeddings), {until_converged('p', 'y', '0.9', '1e-4')} SELECT node, round(s, 5) AS s FROM it WHERE i = (SELECT max(i) FROM it)")
def diffusion_converged(spark, sf_dir):
    """ML-10 to its tolerance."""
    t = Tables(spark, sf_dir)
    seeds = t.embeddings.select(F.col("vec_id").alias("node"), (F.col("label") == 1).cast("double").alias("y"))
    return graph.diffuse(graph.row_stochastic(_graph(t)), seeds, tolerance=1e-4).select("node", F.round("s", 5).alias("s"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, y AS (SELECT vec_id AS node, CAST(CASE WHEN label = 1 THEN 1 ELSE 0 END AS DOUBLE) AS y FROM embeddings), {until_converged('p', 'y', '0.5', '1e-3', 12)} SELECT node, round(s, 5) AS s FROM it WHERE i = (SELECT max(i) FROM it)")
def diffusion_bucketed(spark, sf_dir):
    """ML-10 by steps over a bucketed edge table, as at sizes that the driver can't hold."""
    t = Tables(spark, sf_dir)
    seeds = t.embeddings.select(F.col("vec_id").alias("node"), (F.col("label") == 1).cast("double").alias("y"))
    return graph.diffuse_bucketed(graph.row_stochastic(_graph(t)), seeds, 0.5, 12, 1e-3).select("node", F.round("s", 5).alias("s"))


def shuffled_sql(row: str, n: str, seed: int) -> str:
    """SQL of shuffling.place() by chained steps: (row_, place)."""
    steps = [f"z AS (SELECT CAST(1 << CAST(greatest(1, (bits + 1) // 2) AS INT) AS BIGINT) AS size FROM (SELECT length(bin(greatest(1, {n} - 1))) AS bits))", f"h0 AS (SELECT row_, row_ // size AS l, row_ % size AS r, size FROM (SELECT {row} AS row_ FROM numbered), z)"]
    steps += [f"h{i + 1} AS (SELECT row_, r AS l, xor(l, (r * {a} + {b}) % {shuffling.PRIME} % size) AS r, size FROM h{i})" for i, (a, b) in enumerate(shuffling.keys(seed))]
    return ", ".join(steps) + f", placed AS (SELECT row_, l * size + r AS place FROM h{shuffling.ROUNDS})"


@query(f"WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row FROM labels), {shuffled_sql('row - 1', '(SELECT count(*) FROM labels)', 34)} SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY place) <= greatest(1, CAST(floor((SELECT count(*) FROM labels) * (1 - 0.2::DOUBLE)) AS BIGINT)) THEN 'train' ELSE 'holdout' END AS part FROM numbered JOIN placed ON row - 1 = row_")
def seed_split(spark, sf_dir):
    """ML-12: a seeded order of row numbers, none of which the driver holds."""
    return shuffling.split(Tables(spark, sf_dir).labels.select("doc_id"), ["doc_id"], 0.2, 34).select("doc_id", "part")


@query("""WITH RECURSIVE r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS i FROM documents),
b AS (SELECT doc_id, lang, i, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held, n_chars AS load FROM r WHERE i = 1 UNION ALL
SELECT r.doc_id, r.lang, r.i, CASE WHEN held >= 32 OR load + r.n_chars > 20000 THEN batch + 1 ELSE batch END, CASE WHEN held >= 32 OR load + r.n_chars > 20000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 32 OR load + r.n_chars > 20000 THEN r.n_chars ELSE load + r.n_chars END FROM b JOIN r ON r.lang = b.lang AND r.i = b.i + 1)
SELECT doc_id, lang, batch FROM b""")
def budgeted_packing(spark, sf_dir):
    """WIN-10: the batch of each row, longest first, of 32 rows and a budget of length at most."""
    return packing.packed(Tables(spark, sf_dir).documents.select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", 32, 20_000, "doc_id").select("doc_id", "lang", "batch")


RANKED_SQL = """r AS (SELECT doc_id, n_chars AS score, coalesce(quality, 0) AS relevant, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)), c AS (SELECT count(*) AS n, sum(relevant) AS pos FROM r), k AS (SELECT unnest([10, 50, 100]) AS k),
ap AS (SELECT sum(tp / CAST(pos AS DOUBLE) * cum / seen) AS ap FROM (SELECT tp, seen, sum(tp) OVER (ORDER BY score DESC) AS cum FROM (SELECT score, sum(relevant) AS tp, max(rank) AS seen FROM r GROUP BY 1)), c)"""


@query(f"""WITH {RANKED_SQL} SELECT CAST(k AS INT) AS k, round(sum(relevant) FILTER (WHERE rank <= k) / CAST(any_value(pos) AS DOUBLE), 6) AS recall_at_k, round((sum(relevant) FILTER (WHERE rank <= k) / CAST(k AS DOUBLE)) / (any_value(pos) / CAST(any_value(n) AS DOUBLE)), 6) AS ef_at_k,
round(sum(relevant / log2(rank + 1)) FILTER (WHERE rank <= k) / sum(CASE WHEN rank <= least(k, pos) THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_at_k, round(any_value(ap), 6) AS average_precision FROM r, c, k, ap GROUP BY k""")
def ranking_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    best = t.labels.groupBy("doc_id").agg(F.max("quality").alias("q"))
    d = t.documents.join(best, "doc_id", "left").select("doc_id", F.col("n_chars").alias("score"), F.coalesce("q", F.lit(0)).alias("relevant"))
    m = graph.ranking_metrics(graph.ranked(d, "score", "doc_id"), [10, 50, 100])
    return m.select("k", *(R6(c).alias(c) for c in ("recall_at_k", "ef_at_k", "ndcg_at_k", "average_precision")))


@query("""WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS st FROM events), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS med FROM r GROUP BY user_id, run""")
def islands(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = windows.runs(ev.withColumn("before", F.lag("event_type").over(w)), ["user_id"], [F.col("ts"), F.col("event_id")], ~F.coalesce(F.col("event_type") == F.col("before"), F.lit(False)))
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), R6(F.avg("value")).alias("mean"), R6(F.median("value")).alias("med"))


@query("""WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS st FROM events), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM s),
g AS (SELECT user_id, run, count(*) AS length, min(pos) AS start FROM r GROUP BY 1, 2) SELECT user_id, CAST(length AS BIGINT) AS length, CAST(start AS BIGINT) AS start FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS k FROM g) WHERE k = 1""")
def longest_run(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ev.withColumn("before", F.lag("event_type").over(w)).withColumn("pos", F.row_number().over(w).cast("bigint"))
    r = windows.runs(ev, ["user_id"], [F.col("ts"), F.col("event_id")], ~F.coalesce(F.col("event_type") == F.col("before"), F.lit(False)))
    return windows.longest_run(r, ["user_id"], "run", "pos").select("user_id", "length", "start")


@query("SELECT event_type, round(coalesce(avg(value) FILTER (WHERE user_id % 2 = 0), 0), 6) AS retained, round(coalesce(avg(value) FILTER (WHERE user_id % 2 = 1), 0), 6) AS lost, CASE WHEN avg(value) FILTER (WHERE user_id % 2 = 1) <> 0 THEN round(coalesce(avg(value) FILTER (WHERE user_id % 2 = 0), 0) / avg(value) FILTER (WHERE user_id % 2 = 1), 6) ELSE 0.0 END AS ratio FROM events GROUP BY 1")
def coverage_ratio(spark, sf_dir):
    even = F.col("user_id") % 2 == 0
    g = Tables(spark, sf_dir).events.groupBy("event_type").agg(F.coalesce(F.avg(F.when(even, F.col("value"))), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(~even, F.col("value"))), F.lit(0.0)).alias("b"))
    return g.select("event_type", R6("a").alias("retained"), R6("b").alias("lost"), R6(tx.ratio(F.col("a"), F.col("b"))).alias("ratio"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf_dir):
    """ST-01/02: the table as a file stream, counted in complete mode."""
    import uuid

    from chimerant.streaming import intake

    ev = Tables(spark, sf_dir).events
    path = f"{sf_dir}/events.parquet"
    folder = path if not path.endswith(".parquet") or _is_folder(spark, path) else f"{sf_dir}/event[s].parquet"
    return intake.drain(intake.running_counts(intake.table_stream(spark, folder, ev.schema), "event_type"), f"counts_{uuid.uuid4().hex[:8]}")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("""SELECT c_custkey AS id, 'customer' AS src, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier""")
def tagged_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sets.union_all(t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src"), F.col("c_acctbal").alias("bal")), t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src"), F.col("s_acctbal").alias("bal")))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id, o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def sequential_id(spark, sf_dir):
    """PRJ-07, with columns besides the order's."""
    return ranges.numbered(Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS customers, sum(floor(o_totalprice) * 0.25::DOUBLE) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS quarters FROM orders")
def running_totals(spark, sf_dir):
    """AGG-14: sums over the whole table in one order, by ranges."""
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate", "o_custkey", (F.floor("o_totalprice") * F.lit(0.25)).alias("q"))  # quarters add up without rounding
    return ranges.running_totals(orders, ["o_orderdate", "o_orderkey"], {"customers": "o_custkey", "quarters": "q"}).select("o_orderkey", "customers", "quarters")


@query("SELECT l_orderkey, l_linenumber, l_quantity, n FROM (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, l_partkey FROM lineitem)")
def global_rank(spark, sf_dir):
    """WIN-09, SRT-05: ranks over a column of few values."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tie"))
    return graph.ranked(li, "l_quantity", "tie", "n").drop("tie")
