"""Queries over records: joins, windows, assemblies, trees, streams' batch forms, geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import geometry, records, relational
from .registry import query



@query("latest_revision", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_revision(read, spark):
    """Newest wins, as one aggregation rather than a sort by user."""
    newest = read("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    return newest.select("user_id", "r.event_id", "r.value")


@query("revision_asof", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15') WHERE n = 1")
def revision_asof(read, spark):
    before = read("events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    return before.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("r")).select("user_id", "r.event_id", "r.value")


@query(
    "revision_list",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events WHERE event_type = 'signup'",
)
def revision_list(read, spark):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read("events").where("event_type = 'signup'").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("revision"))


@query(
    "revision_diff",
    """WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 0),
            new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0)
       SELECT coalesce(old.k, new.k) AS o_orderkey, CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM old FULL JOIN new ON old.k = new.k WHERE old.k IS NULL OR new.k IS NULL OR old.s <> new.s OR old.p <> new.p""",
)
def revision_diff(read, spark):
    orders = read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return relational.revision_diff(orders.where("o_orderkey % 7 <> 0"), new, "o_orderkey")


@query(
    "upsert_merge",
    """WITH base AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 4 = 0)
       SELECT coalesce(c.o_orderkey, base.o_orderkey) AS o_orderkey, coalesce(c.o_totalprice, base.o_totalprice) AS o_totalprice FROM base FULL JOIN c ON base.o_orderkey = c.o_orderkey""",
)
def upsert_merge(read, spark):
    orders = read("orders").select("o_orderkey", "o_totalprice")
    changes = orders.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return relational.upsert(orders.where("o_orderkey % 3 <> 0"), changes, "o_orderkey")


@query("field_import", "SELECT count(*) FILTER (WHERE c_custkey IS NOT NULL) AS applied, count(*) FILTER (WHERE c_custkey IS NULL) AS skipped FROM (SELECT o_custkey + 700 AS k FROM orders) o LEFT JOIN customer ON k = c_custkey")
def field_import(read, spark):
    fields = read("orders").select((F.col("o_custkey") + 700).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = fields.join(read("customer").select("c_custkey"), F.col("k") == F.col("c_custkey"), "left")
    known = F.col("c_custkey").isNotNull()
    return joined.agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("applied"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("skipped"))


@query("unknown_keys", "SELECT key, count(*) AS found FROM (SELECT unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('a', 'b') GROUP BY key")
def unknown_keys(read, spark):
    keys = read("events").select(F.explode(F.json_object_keys("props")).alias("key"))
    known = spark.createDataFrame([("a",), ("b",)], "key string")
    return keys.join(F.broadcast(known), "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("found"))


@query("thread_replies", "SELECT a.conv_id, a.turn, b.turn AS parent_turn, b.role AS parent_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def thread_replies(read, spark):
    turns = read("conversations").select("conv_id", "turn", "role")
    parents = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("parent_turn"), F.col("role").alias("parent_role"))
    return turns.join(parents, ["conv_id", "turn"], "left").drop("role")


@query("comment_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')")
def comment_filter(read, spark):
    return read("conversations").where((F.col("role") == "user") & T.fold(F.col("text")).contains("the")).select("conv_id", "turn")


@query("comment_sort", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, user_id, event_id) AS place FROM events")
def comment_sort(read, spark):
    rows = read("events").select("event_id", "ts", "user_id")
    order = [F.col("ts").desc_nulls_last(), F.col("user_id").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    return relational.numbered(rows, order, "place").select("event_id", (F.col("place") + 1).alias("place"))


@query("comment_types", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def comment_types(read, spark):
    return read("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"))


@query("distinct_authors", "SELECT lower(c_name) AS folded, min(c_name) AS author FROM customer GROUP BY 1")
def distinct_authors(read, spark):
    return read("customer").groupBy(F.lower("c_name").alias("folded")).agg(F.min("c_name").alias("author"))


LABEL_RANGES = "(VALUES (0, 'r', 1), (5, 'D', 1), (120, 'D', 200), (9000, 'A', 1)) r(start_at, style, first_number)"


def _ranges(spark):
    return spark.createDataFrame([(0, "r", 1), (5, "D", 1), (120, "D", 200), (9000, "A", 1)], "start_at long, style string, first_number long")


@query("label_asof", f"SELECT o_orderkey, start_at, style FROM orders ASOF JOIN (SELECT * FROM {LABEL_RANGES}) r ON o_orderkey >= start_at")
def label_asof(read, spark):
    """The ranges are few and fixed, so a range join with their next starts needs no order over the rows."""
    ranges = records.with_ends(_ranges(spark), "start_at")
    return records.in_range(read("orders").select("o_orderkey"), "o_orderkey", ranges, "start_at").select("o_orderkey", "start_at", "style")


@query("label_number", f"SELECT o_orderkey, o_orderkey - start_at + first_number AS number FROM orders ASOF JOIN (SELECT * FROM {LABEL_RANGES}) r ON o_orderkey >= start_at")
def label_number(read, spark):
    ranges = records.with_ends(_ranges(spark), "start_at")
    rows = records.in_range(read("orders").select("o_orderkey"), "o_orderkey", ranges, "start_at")
    return rows.select("o_orderkey", (F.col("o_orderkey") - F.col("start_at") + F.col("first_number")).alias("number"))


@query("label_asof_by_user", "SELECT e.event_id, s.event_id AS signup_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type = 'purchase'")
def label_asof_by_user(read, spark):
    events = read("events")
    signups = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"))
    return relational.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), "ts", signups, "signup_ts", by="user_id").select("event_id", "signup_id")


@query("split_by_outline", "WITH s AS (SELECT DISTINCT min(o_orderkey) AS first_page FROM orders GROUP BY year(o_orderdate)), a AS (SELECT first_page FROM s UNION SELECT 0) SELECT first_page, lead(first_page, 1, (SELECT max(o_orderkey) + 1 FROM orders)) OVER (ORDER BY first_page) - first_page AS page_count FROM a")
def split_by_outline(read, spark):
    orders = read("orders")
    starts = orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.min("o_orderkey").alias("first"))
    total = orders.agg((F.max("o_orderkey") + 1).alias("n")).first()["n"]
    return relational.split_parts(starts, "first", total)


@query("split_by_count", "SELECT o_orderkey // 500 AS part, min(o_orderkey) AS first_page, count(*) AS page_count FROM orders GROUP BY 1")
def split_by_count(read, spark):
    return read("orders").groupBy(F.expr("o_orderkey div 500").alias("part")).agg(F.min("o_orderkey").alias("first_page"), F.count(F.lit(1)).alias("page_count"))


@query("collate_concat", "SELECT source, key, row_number() OVER (ORDER BY source, key) - 1 AS place FROM (SELECT 0 AS source, CAST(n_nationkey AS BIGINT) AS key FROM nation UNION ALL SELECT 1, r_regionkey FROM region)")
def collate_concat(read, spark):
    sources = [read("nation").select(F.col("n_nationkey").cast("long").alias("k")), read("region").select(F.col("r_regionkey").cast("long").alias("k"))]
    return relational.concatenate(sources, "k").withColumn("place", F.col("place").cast("long"))


@query(
    "collate_interleave",
    """WITH a AS (SELECT 0 AS source, CAST(s_suppkey AS BIGINT) AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS page FROM supplier UNION ALL SELECT 1, c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 FROM customer)
       SELECT source, key, row_number() OVER (ORDER BY page // 3, source, page) - 1 AS place FROM a""",
)
def collate_interleave(read, spark):
    sources = [read("supplier").select(F.col("s_suppkey").cast("long").alias("k")), read("customer").select(F.col("c_custkey").cast("long").alias("k"))]
    return relational.interleave(sources, "k", 3).withColumn("place", F.col("place").cast("long"))


@query(
    "page_ranges",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 14 AS a, o_custkey % 14 AS b, o_orderkey % 5 AS c, o_orderstatus = 'F' AS open_end FROM orders),
       v AS (SELECT *, CASE WHEN open_end THEN 12 ELSE b END AS upto FROM o WHERE a BETWEEN 1 AND 12 AND c BETWEEN 1 AND 12 AND (open_end OR b BETWEEN a AND 12))
       SELECT DISTINCT o_orderkey, page FROM (SELECT o_orderkey, CAST(unnest(range(a, upto + 1)) - 1 AS INTEGER) AS page FROM v UNION ALL SELECT o_orderkey, CAST(c - 1 AS INTEGER) FROM v)""",
)
def page_ranges(read, spark):
    """Pages that a text of ranges from each order's keys names, open at the end for some; wrong texts name none."""
    key, last = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "").otherwise((F.col("o_custkey") % 14).cast("string"))
    spec = F.concat((key % 14).cast("string"), F.lit("-"), last, F.lit(", "), (key % 5).cast("string"))
    return relational.page_ranges(read("orders").select("o_orderkey", spec.alias("spec")), "spec", 12).select("o_orderkey", "page")


@query(
    "booklet",
    """WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS page, (count(*) OVER () + 3) // 4 * 4 AS padded FROM customer)
       SELECT c_custkey, CASE WHEN page < padded // 2 THEN page // 2 * 4 + 1 + page % 2 ELSE (padded - 1 - page) // 2 * 4 + CASE WHEN (padded - 1 - page) % 2 = 0 THEN 0 ELSE 3 END END AS place FROM n""",
)
def booklet(read, spark):
    """Where each customer's page comes in a booklet of sheets folded in the middle."""
    return relational.booklet(read("customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "place")


@query("overlay_cycle", "SELECT p_partkey, n_name FROM part JOIN nation ON p_partkey % 25 = n_nationkey")
def overlay_cycle(read, spark):
    overlay = read("nation").select(F.col("n_nationkey").alias("_at"), "n_name")
    return read("part").select("p_partkey").join(overlay, F.col("p_partkey") % 25 == F.col("_at")).select("p_partkey", "n_name")


@query("watermark_rows", "SELECT o_orderkey, r_name AS stamp FROM orders, region WHERE r_regionkey = 1 AND o_orderstatus = 'F'")
def watermark_rows(read, spark):
    """One stamp for each selected page: the stamp is a scalar subquery, so nothing is joined."""
    stamp = read("region").where("r_regionkey = 1").select(F.max("r_name")).scalar()
    return read("orders").where("o_orderstatus = 'F'").select("o_orderkey", stamp.alias("stamp"))


@query("extract_pages", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)")
def extract_pages(read, spark):
    chosen = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(chosen, "l_orderkey", "left_semi")


@query("delete_pages", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)")
def delete_pages(read, spark):
    chosen = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(chosen, "l_orderkey", "left_anti")


@query("move_pages", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END, c_custkey) AS place FROM customer")
def move_pages(read, spark):
    order = Window.partitionBy("c_nationkey").orderBy((F.col("c_custkey") % 10 == 0).cast("int"), "c_custkey")
    return read("customer").select("c_custkey", F.row_number().over(order).cast("long").alias("place"))


@query("runs_compaction", "SELECT l_orderkey, min(l_linenumber) AS first, count(*) AS count FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber - dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM lineitem) GROUP BY l_orderkey, g")
def runs_compaction(read, spark):
    return relational.consecutive_runs(read("lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(read, spark):
    both = read("customer").select(F.col("c_nationkey").alias("k")).intersect(read("supplier").select("s_nationkey"))
    return both.subtract(read("nation").where("n_regionkey = 0").select("n_nationkey"))


@query("bounds_union", "SELECT l_orderkey, min(l_discount) AS left_edge, min(l_tax) AS bottom_edge, max(l_discount) AS right_edge, max(l_tax) AS top_edge FROM lineitem GROUP BY 1")
def bounds_union(read, spark):
    return read("lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("left_edge"), F.min("l_tax").alias("bottom_edge"), F.max("l_discount").alias("right_edge"), F.max("l_tax").alias("top_edge"))


@query(
    "polyline_length",
    "SELECT user_id, round(coalesce(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 0), 4) AS length FROM (SELECT user_id, epoch(ts) / 3600 AS x, value AS y, lag(epoch(ts) / 3600) OVER w AS px, lag(value) OVER w AS py FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1",
)
def polyline_length(read, spark):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000
    return geometry.polyline_length(read("events"), "user_id", ["ts", "event_id"], x, F.col("value")).withColumn("length", F.round("length", 4))


@query(
    "polygon_area",
    "SELECT user_id, round(abs(sum(x * ny - nx * y)) / 2, 3) AS area FROM (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM (SELECT user_id, ts, event_id, (epoch(ts) - 1704067200) / 3600 AS x, value AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1",
)
def polygon_area(read, spark):
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 3_600_000_000
    return geometry.polygon_area(read("events"), "user_id", ["ts", "event_id"], x, F.col("value")).withColumn("area", F.round("area", 3))


@query("angle", "SELECT event_id, round((degrees(atan2(0 - value, 10 - event_id % 20)) + 360) % 360, 6) AS angle FROM events")
def angle(read, spark):
    return read("events").select("event_id", F.round(geometry.angle(F.lit(0.0), F.lit(0.0), F.lit(10) - F.col("event_id") % 20, F.col("value")), 6).alias("angle"))


@query(
    "affine_fit",
    """WITH s AS (SELECT l_returnflag, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xt, covar_pop(l_discount, l_extendedprice) AS yt, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mt FROM lineitem GROUP BY 1),
       f AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS a, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS b FROM s)
       SELECT l_returnflag, round(a, 4) AS a, round(b, 2) AS b, round(mt - a * mx - b * my, 2) AS c FROM f""",
)
def affine_fit(read, spark):
    return geometry.affine_fit(read("lineitem"), "l_returnflag", "l_quantity", "l_discount", "l_extendedprice").select("l_returnflag", F.round("a", 4).alias("a"), F.round("b", 2).alias("b"), F.round("c", 2).alias("c"))


@query(
    "hit_test_nearest",
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
       b AS (SELECT i * 20 + j AS box, i * 0.1 - 1.0 AS l, j * 0.1 - 1.0 AS b, i * 0.1 - 0.95 AS r, j * 0.1 - 0.95 AS t FROM range(20) x(i), range(20) y(j)),
       d AS (SELECT vec_id, box, greatest(l - x, 0, x - r) AS dx, greatest(b - y, 0, y - t) AS dy FROM p, b)
       SELECT vec_id, arg_min(box, {'d': sqrt(dx * dx + dy * dy), 'b': box}) AS box FROM d WHERE dx <= 0.04 AND dy <= 0.04 GROUP BY vec_id""",
)
def hit_test_nearest(read, spark):
    points = read("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    i, j = F.expr("id div 20"), F.col("id") % 20
    boxes = spark.range(400).select(F.col("id").alias("box"), (i * 0.1 - 1.0).alias("left"), (j * 0.1 - 1.0).alias("bottom"), (i * 0.1 - 0.95).alias("right"), (j * 0.1 - 0.95).alias("top"))
    return geometry.hit_test(points, "vec_id", boxes, "box", 0.04, 0.1).select("vec_id", "box")


@query("point_in_box", "SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.05 AND 0.05 AND embedding[2] BETWEEN -0.05 AND 0.05")
def point_in_box(read, spark):
    return read("embeddings").where(F.col("embedding")[0].between(-0.05, 0.05) & F.col("embedding")[1].between(-0.05, 0.05)).select("vec_id")


@query("reachability", "WITH RECURSIVE e AS (SELECT o_orderkey AS src, unnest([o_orderkey * 2 + 1, o_orderkey * 3 + 2]) AS dst FROM orders), r AS (SELECT 0 AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT CAST(node AS BIGINT) AS node, min(depth) AS depth FROM r GROUP BY 1")
def reachability(read, spark):
    k = F.col("o_orderkey")
    edges = read("orders").select(k.alias("src"), F.explode(F.array(k * 2 + 1, k * 3 + 2)).alias("dst"))
    return records.reachable(edges, spark.range(1).select(F.col("id").alias("node")))


TREE = "SELECT CAST(100 + r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_regionkey AS ord FROM region UNION ALL SELECT n_nationkey, 100 + n_regionkey, n_nationkey FROM nation"


@query("tree_flatten", f"WITH RECURSIVE n AS ({TREE}), t AS (SELECT id, 0 AS depth, lpad(CAST(ord AS VARCHAR), 6, '0') AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || lpad(CAST(n.ord AS VARCHAR), 6, '0') FROM t JOIN n ON n.parent_id = t.id) SELECT id, depth, path FROM t")
def tree_flatten(read, spark):
    tops = read("region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"))
    leaves = read("nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 100).cast("long").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord"))
    return relational.flatten_tree(tops.unionByName(leaves), 8)


@query("json_extract", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY 1")
def json_extract(read, spark):
    return read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("variant_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def variant_extract(read, spark):
    return read("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")).where("k > 90")


@query("map_lookup", "SELECT event_id, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT), -1) AS v FROM events")
def map_lookup(read, spark):
    m = F.from_json("props", "map<string,bigint>")
    return read("events").withColumn("m", m).select("event_id", F.coalesce(F.try_element_at("m", F.lit("missing")), F.try_element_at("m", F.lit("k")), F.lit(-1)).cast("long").alias("v"))


@query("deep_equality", "SELECT count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.props = b.props AND a.event_id < b.event_id")
def deep_equality(read, spark):
    groups = read("events").groupBy("user_id", "props").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


@query("alias_flatten", "WITH RECURSIVE a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey ELSE o_orderkey - 1 END AS next FROM orders), r AS (SELECT id, next FROM a UNION SELECT r.id, a.next FROM r JOIN a ON a.id = r.next) SELECT id, min(next) AS canonical FROM r GROUP BY id")
def alias_flatten(read, spark):
    k = F.col("o_orderkey")
    links = read("orders").select(k.alias("id"), F.when(k % 10 == 0, k).otherwise(k - 1).alias("next"))
    return records.flatten_aliases(links)


@query(
    "stream_settle",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS events FROM s GROUP BY user_id, session",
)
def stream_settle(read, spark):
    grouped = read("events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
    return grouped.agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("events")).select("user_id", "first_ts", "events")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(read, spark):
    return read("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start")
def stream_sliding(read, spark):
    return read("events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("stream_incremental_search", "SELECT event_id, ts FROM events WHERE contains(lower(event_type), 'err') AND value > 50")
def stream_incremental_search(read, spark):
    return read("events").where(F.lower("event_type").contains("err") & (F.col("value") > 50)).select("event_id", "ts")


@query(
    "flatten_union",
    "SELECT 'kept' AS outcome, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' UNION ALL SELECT 'pending', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' UNION ALL SELECT 'no order', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey",
)
def flatten_union(read, spark):
    """Lines that become part of their orders, and the reasons why others don't."""
    rows = read("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(read("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    outcome = F.when(F.col("o_orderkey").isNull(), "no order").when(F.col("o_orderstatus") == "P", "pending").otherwise("kept")
    counted = rows.groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([("kept",), ("pending",), ("no order",)], "outcome string")
    return every.join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


@query("rename_prefix", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'small') AND NOT ('tiny' || substr(p_name, 6) IN (SELECT p_name FROM part)) THEN 'tiny' || substr(p_name, 6) ELSE p_name END AS p_name FROM part")
def rename_prefix(read, spark):
    return records.rename_prefix(read("part").select("p_partkey", "p_name"), "p_name", "small", "tiny")


@query("permission_check", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice < 100000 WHEN o_orderstatus = 'O' THEN true ELSE false END AS permitted FROM orders")
def permission_check(read, spark):
    table = spark.createDataFrame([("F", 100_000.0), ("O", float("inf"))], "status string, ceiling double")
    rows = read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(F.broadcast(table), F.col("o_orderstatus") == F.col("status"), "left")
    return rows.select("o_orderkey", F.coalesce(F.col("o_totalprice") < F.col("ceiling"), F.lit(False)).alias("permitted"))


@query("layer_zoom_class", "SELECT p_partkey, CAST((p_size >= 5)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT AS INTEGER) AS class FROM part")
def layer_zoom_class(read, spark):
    limits = F.array(*[F.lit(x) for x in (5, 20, 40)])
    return read("part").select("p_partkey", F.size(F.filter(limits, lambda x: x <= F.col("p_size"))).alias("class"))


@query("byte_range_check", "SELECT event_id, CASE WHEN k IS NULL THEN 'shape' WHEN k < 30 THEN 'order' WHEN k < 60 THEN 'partial' ELSE 'whole' END AS status FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def byte_range_check(read, spark):
    k = F.get_json_object("props", "$.k").cast("long")
    return read("events").select("event_id", F.when(k.isNull(), "shape").when(k < 30, "order").when(k < 60, "partial").otherwise("whole").alias("status"))


@query("portfolio_pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def portfolio_pivot(read, spark):
    pivoted = read("events").where(F.col("event_type").isin("click", "view")).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1)))
    return pivoted.fillna(0, ["click", "view"])


@query("layer_pages", "SELECT DISTINCT event_type, user_id FROM events WHERE value > 100")
def layer_pages(read, spark):
    return read("events").where("value > 100").select("event_type", "user_id").distinct()


@query("change_kinds", "SELECT user_id, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 4 WHEN 'purchase' THEN 8 ELSE 16 END) AS kinds FROM events GROUP BY 1")
def change_kinds(read, spark):
    kind = F.col("event_type")
    bit = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "error", 4).when(kind == "purchase", 8).otherwise(16)
    return read("events").groupBy("user_id").agg(F.bit_or(bit).alias("kinds"))


@query("grouping_sets_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_sets_cube(read, spark):
    return read("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("savings_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS before, round(sum(l_extendedprice * (1 - l_discount)), 2) AS after FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def savings_rollup(read, spark):
    price = F.col("l_extendedprice")
    return read("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum(price), 2).alias("before"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("after"))


@query("interval_join", "SELECT a.user_id, a.event_id AS first_key, b.event_id AS second_key FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 3600 SECOND")
def interval_join(read, spark):
    return relational.interval_pairs(read("events"), "user_id", "event_id", "ts", 3600)


@query("priority_queue", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def priority_queue(read, spark):
    return read("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("reset_fields", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def reset_fields(read, spark):
    return read("customer").select("c_custkey", F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query("table_headers", "SELECT l.l_orderkey, l.l_linenumber, h.l_linenumber AS header FROM lineitem l JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) h ON l.l_orderkey = h.l_orderkey AND l.l_linenumber > h.l_linenumber")
def table_headers(read, spark):
    """Data cells with the header of their table: a window over the group instead of a join with itself."""
    header = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return read("lineitem").select("l_orderkey", "l_linenumber", header.alias("header")).where("l_linenumber > header")


@query("role_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'H1' WHEN '2-HIGH' THEN 'H1' WHEN '3-MEDIUM' THEN 'P' ELSE 'Span' END AS role FROM orders")
def role_map(read, spark):
    """A custom type resolves to a standard one through a chain of at most eight links."""
    chain = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("2-HIGH", "H1"), ("3-MEDIUM", "P"), ("4-NOT SPECIFIED", "5-LOW"), ("5-LOW", "Span")], "custom string, standard string")
    return records.resolve_chain(read("orders").select("o_orderkey", F.col("o_orderpriority").alias("role")), "role", chain, 8)


@query("nearest_above", "SELECT a.o_orderkey, max(b.o_orderkey) AS above FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey GROUP BY 1")
def nearest_above(read, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("above")).where("above is not null")
