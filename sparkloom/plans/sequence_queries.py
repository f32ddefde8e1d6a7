"""Sequence, sorting and text operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as q
from ..operators import sorting
from ..sources.tables import events, table
from .graph_queries import one

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
S = "s AS (SELECT event_id AS idx, value, user_id, event_type FROM events)"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = f"WITH {S} {oracle}"
        return f

    return register


def seq(spark, sf_dir):
    return events(spark, sf_dir).select("idx", "value")


def ints(spark, sf_dir):
    return events(spark, sf_dir).select("idx", F.floor("value").cast("long").alias("value"))


@query("SELECT range AS idx, range * range AS value FROM range(1000)")
def tabulate(spark, sf_dir):
    return q.tabulate(spark, 1000, F.col("idx") * F.col("idx"))


@query("SELECT range AS idx, range AS value FROM range(500)")
def iota(spark, sf_dir):
    return q.iota(spark, 500)


@query("SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, value FROM s WHERE value > 20")
def pack_filter(spark, sf_dir):
    return q.pack(seq(spark, sf_dir), F.col("value") > 20)


@query("SELECT idx FROM s WHERE value < 2")
def pack_index(spark, sf_dir):
    return q.pack_index(seq(spark, sf_dir), F.col("value") < 2)


@query("SELECT idx, value * 2 AS value FROM s WHERE event_type = 'click'")
def map_maybe(spark, sf_dir):
    return q.map_maybe(events(spark, sf_dir), F.when(F.col("event_type") == "click", F.col("value") * 2))


@query("SELECT a.idx, a.value + b.user_id AS value FROM s a JOIN s b USING (idx)")
def zip_with(spark, sf_dir):
    return q.zip_with(seq(spark, sf_dir), events(spark, sf_dir).select("idx", F.col("user_id").alias("value")), F.col("value") + F.col("other"))


@query("SELECT (SELECT count(*) FROM s) - 1 - idx AS idx, value FROM s")
def reverse(spark, sf_dir):
    return q.reverse(seq(spark, sf_dir))


@query("SELECT (idx - 137 + (SELECT count(*) FROM s)) % (SELECT count(*) FROM s) AS idx, value FROM s")
def rotate(spark, sf_dir):
    return q.rotate(seq(spark, sf_dir), 137)


@query("SELECT idx, value FROM s UNION ALL SELECT idx + (SELECT count(*) FROM s), -value FROM s")
def append(spark, sf_dir):
    s = seq(spark, sf_dir)
    return q.append(s, s.select("idx", (-F.col("value")).alias("value")))


@query("SELECT row_number() OVER (ORDER BY idx, j) - 1 AS idx, value FROM (SELECT idx, j, value + j AS value FROM s, range(3) r(j))")
def flatten(spark, sf_dir):
    v = F.col("value")
    return q.flatten(seq(spark, sf_dir).select("idx", F.array(v, v + 1, v + 2).alias("values")))


@query("SELECT row_number() OVER (ORDER BY value <= 10, idx) - 1 AS idx, value FROM s")
def stable_partition(spark, sf_dir):
    return q.partition(seq(spark, sf_dir), F.col("value") > 10)


@query("SELECT sum(v)::BIGINT AS total, min(v) AS low, max(v) AS high, bit_xor(v) AS mixed, bool_and(v >= 0) AS all_of, bool_or(v > 90) AS any_of, count(*) FILTER (v % 2 = 0) AS even FROM (SELECT floor(value)::BIGINT AS v FROM s)")
def reduce_monoids(spark, sf_dir):
    v = F.col("value")
    return ints(spark, sf_dir).agg(F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.bit_xor(v).alias("mixed"), F.bool_and(v >= 0).alias("all_of"), F.bool_or(v > 90).alias("any_of"), F.count_if(v % 2 == 0).alias("even"))


@query("SELECT arg_min(idx, (value, idx)) AS min_at, min(value) AS min, arg_min(idx, (-value, idx)) AS max_at, max(value) AS max FROM s")
def minmax_element(spark, sf_dir):
    return q.extremes(seq(spark, sf_dir))


@query("SELECT min(idx) AS at FROM s WHERE value > 60")
def find_if(spark, sf_dir):
    return q.find_if(seq(spark, sf_dir), F.col("value") > 60)


@query("SELECT min(idx) AS at FROM (SELECT idx, floor(value) = lead(floor(value)) OVER (ORDER BY idx) AS f FROM s) WHERE f")
def adjacent_find(spark, sf_dir):
    return q.adjacent_find(ints(spark, sf_dir))


@query("SELECT min(idx) AS at FROM s WHERE value <> CASE WHEN value > 50 THEN 0 ELSE value END")
def mismatch(spark, sf_dir):
    s = seq(spark, sf_dir)
    return q.mismatch(s, s.select("idx", F.when(F.col("value") > 50, 0.0).otherwise(F.col("value")).alias("value")))


@query("SELECT false AS less")
def lexicographical_compare(spark, sf_dir):
    s = seq(spark, sf_dir)
    return q.lexicographical_less(s, s.select("idx", F.when(F.col("value") > 50, 0.0).otherwise(F.col("value")).alias("value")))


@query("SELECT idx FROM (SELECT idx, floor(value) AS a, lead(floor(value)) OVER (ORDER BY idx) AS b FROM s) WHERE a = 1 AND b = 3")
def search(spark, sf_dir):
    return q.search(ints(spark, sf_dir), [1, 3])


@query("SELECT event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY event_type")
def reduce_by_key(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id AS key, array_to_string(list(idx ORDER BY idx), ',') AS values FROM s GROUP BY user_id")
def group_by_key_ordered(spark, sf_dir):
    pairs = events(spark, sf_dir).select(F.col("user_id").alias("key"), "idx", F.col("idx").alias("value"))
    return q.group_by_key(pairs).select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("values"))


@query("SELECT r.range AS key, count(s.idx) AS result FROM range(200) r LEFT JOIN s ON s.user_id = r.range GROUP BY r.range")
def histogram_by_index(spark, sf_dir):
    return q.by_index(events(spark, sf_dir).withColumnRenamed("user_id", "key"), 200, F.count("*"), F.lit(0).cast("long"))


@query("SELECT r.range AS key, coalesce(max(s.value), 0) AS result FROM range(200) r LEFT JOIN s ON s.user_id = r.range GROUP BY r.range")
def reduce_by_index(spark, sf_dir):
    return q.by_index(events(spark, sf_dir).withColumnRenamed("user_id", "key"), 200, F.max("value"), F.lit(0.0))


@query("SELECT idx, v AS value FROM (SELECT idx, floor(value)::BIGINT AS v, lag(floor(value)::BIGINT) OVER (ORDER BY idx) AS b FROM s) WHERE b IS NULL OR v <> b")
def unique(spark, sf_dir):
    return q.unique(ints(spark, sf_dir))


@query("SELECT DISTINCT floor(value)::BIGINT AS value FROM s")
def remove_duplicates(spark, sf_dir):
    return ints(spark, sf_dir).select("value").distinct()


@query("SELECT idx, floor(value)::BIGINT AS value, (sum(floor(value)) OVER (ORDER BY idx) - floor(value))::BIGINT AS scan FROM s")
def scan_exclusive(spark, sf_dir):
    return q.scan(ints(spark, sf_dir))


@query("SELECT idx, floor(value)::BIGINT AS value, sum(floor(value)) OVER (ORDER BY idx)::BIGINT AS scan FROM s")
def scan_inclusive(spark, sf_dir):
    return q.scan(ints(spark, sf_dir), True)


@query("SELECT idx, value, max(value) OVER (ORDER BY idx) AS scan FROM s")
def scan_max(spark, sf_dir):
    return q.scan_max(seq(spark, sf_dir))


@query("SELECT idx, row_number() OVER (ORDER BY value, idx) - 1 AS rank FROM s")
def rank(spark, sf_dir):
    return q.rank(seq(spark, sf_dir))


@query("SELECT count(*) = 0 AS sorted, coalesce(min(idx), (SELECT count(*) FROM s)) AS until FROM (SELECT idx, value < lag(value) OVER (ORDER BY idx) AS bad FROM s) WHERE bad")
def is_sorted(spark, sf_dir):
    return q.is_sorted(seq(spark, sf_dir))


@query("SELECT false AS partitioned")
def is_partitioned(spark, sf_dir):
    return q.is_partitioned(seq(spark, sf_dir), F.col("value") > 10)


@query("SELECT row_number() OVER (ORDER BY value, idx) - 1 AS idx, value FROM s")
def parallel_sort(spark, sf_dir):
    return sorting.sort(seq(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY user_id, idx) - 1 AS idx, user_id AS value FROM s")
def counting_sort(spark, sf_dir):
    return sorting.counting_sort(events(spark, sf_dir).select("idx", F.col("user_id").alias("value")), 150)


@query("SELECT true AS sorted, 0 AS differ")
def verify_sort(spark, sf_dir):
    s = seq(spark, sf_dir)
    return sorting.verify(s, sorting.sort(s))


@query("SELECT row_number() OVER (ORDER BY value, side, old) - 1 AS idx, value FROM (SELECT value, 0 AS side, row_number() OVER (ORDER BY value, idx) AS old FROM s WHERE idx % 2 = 0 UNION ALL SELECT value, 1, row_number() OVER (ORDER BY value, idx) FROM s WHERE idx % 2 = 1)")
def merge_sorted(spark, sf_dir):
    s = seq(spark, sf_dir)
    return sorting.merge(sorting.sort(s.filter("idx % 2 = 0")), sorting.sort(s.filter("idx % 2 = 1")))


@query("SELECT least(floor((t - v) * 8 / (SELECT sum(floor(value)) FROM s)), 7)::INT AS part, count(*) AS n FROM (SELECT floor(value) AS v, sum(floor(value)) OVER (ORDER BY idx) AS t FROM s) GROUP BY 1")
def weighted_partition(spark, sf_dir):
    return sorting.weighted_parts(ints(spark, sf_dir), "value", 8).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT value FROM s ORDER BY value OFFSET 100 LIMIT 1")
def kth_smallest(spark, sf_dir):
    return q.kth_smallest(seq(spark, sf_dir), 100)


@query("SELECT event_type, idx, value FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, idx) <= 5")
def top_k(spark, sf_dir):
    return q.top_k(events(spark, sf_dir).select("event_type", "idx", "value"), ["event_type"], [F.desc("value"), F.col("idx")], 5)


@query("SELECT event_type, idx, floor(value)::BIGINT AS value FROM s QUALIFY rank() OVER (PARTITION BY event_type ORDER BY floor(value) DESC) <= 3")
def top_k_with_ties(spark, sf_dir):
    d = events(spark, sf_dir).select("event_type", "idx", F.floor("value").cast("long").alias("value"))
    return q.top_k(d, ["event_type"], [F.desc("value")], 3, ties=True)


@query("SELECT count(*) AS n, sum(idx)::BIGINT AS places, round(sum(value), 4) AS total FROM s")
def random_shuffle(spark, sf_dir):
    return q.shuffle(seq(spark, sf_dir)).agg(F.count("*").alias("n"), F.sum("idx").alias("places"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT share, value FROM (SELECT value, row_number() OVER (ORDER BY value, idx) - 1 AS r, count(*) OVER () AS n FROM s), (VALUES (0.9), (0.99), (0.999)) t(share) WHERE r = floor(share * n)")
def tail_statistics(spark, sf_dir):
    return q.tail(seq(spark, sf_dir), [0.9, 0.99, 0.999])


@query("SELECT idx, value, coalesce(sum((value > 40)::BIGINT) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM s")
def split_at(spark, sf_dir):
    return q.split_at(seq(spark, sf_dir), F.col("value") > 40)


@query("SELECT round(greatest(max(t - m), 0), 6) AS best FROM (SELECT t, least(0, min(t) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS m FROM (SELECT idx, sum(floor(value) - 10) OVER (ORDER BY idx) AS t FROM s))")
def max_contiguous_sum(spark, sf_dir):
    return q.max_contiguous_sum(seq(spark, sf_dir).select("idx", (F.floor("value") - 10).cast("double").alias("value"))).select(F.round("best", 6).alias("best"))


@query("SELECT round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept, round(regr_slope(o_totalprice, o_custkey), 6) AS slope FROM orders")
def line_fit(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return q.line_fit(p).select(F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


@query("SELECT range AS prime FROM range(2, 5001) r WHERE NOT EXISTS (SELECT 1 FROM range(2, 71) p WHERE p.range < r.range AND r.range % p.range = 0)")
def primes(spark, sf_dir):
    return q.primes(spark, 5000)


@query()
def cycle_count(spark, sf_dir):
    p = q.tabulate(spark, 3001, F.pmod(F.col("idx") * 7, F.lit(3001)))
    return one(spark, cycles=q.cycle_count(p))


@query("SELECT floor(value)::BIGINT AS value FROM s WHERE event_type = 'click' INTERSECT SELECT floor(value)::BIGINT FROM s WHERE event_type = 'view'")
def set_intersection(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", F.floor("value").cast("long").alias("value"))
    return e.filter("event_type = 'click'").select("value").intersect(e.filter("event_type = 'view'").select("value"))


@query("SELECT DISTINCT user_id FROM s WHERE event_type = 'error' AND value > 30 AND user_id NOT IN (SELECT user_id FROM s WHERE event_type = 'view' AND value > 30)")
def set_difference(spark, sf_dir):
    e = events(spark, sf_dir).filter("value > 30")
    return e.filter("event_type = 'error'").select("user_id").distinct().join(e.filter("event_type = 'view'"), "user_id", "left_anti")


@query("SELECT DISTINCT user_id FROM s WHERE value > 45")
def set_union(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter("value > 45 and event_type = 'click'").select("user_id").union(e.filter("value > 45 and event_type <> 'click'").select("user_id")).distinct()
