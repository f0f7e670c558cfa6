"""Queries over structure: trees as intervals, tagged content, captions, merged objects, assemblies, sets along graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import assembly, layout, objects, records, relational, trees
from .registry import query

#: Ids of regions, nations, customers and orders in one tree: the level times this, and the key.
LEVEL = 10**12
TREE = f"""t AS (
  SELECT r_regionkey AS id, r_regionkey AS r, NULL AS n, NULL AS c, NULL AS o, 0 AS depth FROM region
  UNION ALL SELECT {LEVEL} + n_nationkey, n_regionkey, n_nationkey, NULL, NULL, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {2 * LEVEL} + c_custkey, n_regionkey, n_nationkey, c_custkey, NULL, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {3 * LEVEL} + o_orderkey, n_regionkey, n_nationkey, c_custkey, o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def _tree(read):
    """Elements (id, parent, ord): regions, their nations, these nations' customers, and their orders."""
    level = lambda k, c: (F.lit(k * LEVEL) + F.col(c)).cast("long")
    node = lambda t, k, own, parent: read(t).select(level(k, own).alias("id"), (level(k - 1, parent) if parent else F.lit(None).cast("long")).alias("parent"), F.col(own).cast("long").alias("ord"))
    parts = [node("region", 0, "r_regionkey", None), node("nation", 1, "n_nationkey", "n_regionkey"), node("customer", 2, "c_custkey", "c_nationkey"), node("orders", 3, "o_orderkey", "o_custkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "tagged_content",
    f"""WITH {TREE}, own AS (SELECT {3 * LEVEL} + l_orderkey AS id, count(*) AS own FROM lineitem GROUP BY 1),
        p AS (SELECT t.*, row_number() OVER (ORDER BY r, n NULLS FIRST, c NULLS FIRST, o NULLS FIRST) - 1 AS first, coalesce(own, 0) AS own FROM t LEFT JOIN own USING (id)),
        s AS (SELECT *, CASE depth WHEN 0 THEN [max(first) OVER (PARTITION BY r), sum(own) OVER (PARTITION BY r)] WHEN 1 THEN [max(first) OVER (PARTITION BY r, n), sum(own) OVER (PARTITION BY r, n)]
               WHEN 2 THEN [max(first) OVER (PARTITION BY r, n, c), sum(own) OVER (PARTITION BY r, n, c)] ELSE [first, own] END AS x FROM p)
        SELECT id, depth, first, CAST(x[1] AS BIGINT) AS last, CAST(own AS BIGINT) AS own, CAST(x[2] AS BIGINT) AS below FROM s""",
)
def tagged_content(read, spark):
    """Content of each element and of all below it, by intervals of the depth-first order."""
    labels = trees.interval_labels(_tree(read))
    content = read("lineitem").select((F.lit(3 * LEVEL) + F.col("l_orderkey")).alias("element"))
    return trees.content_counts(labels, content, "element").withColumn("first", F.col("first").cast("long")).withColumn("last", F.col("last").cast("long"))


@query("content_of_nations", f"WITH {TREE} SELECT {LEVEL} + n AS root, l_orderkey, l_linenumber FROM lineitem JOIN t ON t.o = l_orderkey")
def content_of_nations(read, spark):
    """All content under each nation, as a range of places."""
    labels = trees.interval_labels(_tree(read))
    content = read("lineitem").select((F.lit(3 * LEVEL) + F.col("l_orderkey")).alias("element"), "l_orderkey", "l_linenumber")
    roots = read("nation").select((F.lit(LEVEL) + F.col("n_nationkey")).alias("id"))
    return trees.content_under(labels, content, "element", roots).drop("element")


@query(
    "refused_moves",
    f"""WITH {TREE}, m AS (
          SELECT {2 * LEVEL} + c_custkey AS id, {3 * LEVEL} + o_orderkey AS parent FROM orders JOIN customer ON o_orderkey % 7 = c_custkey % 7 AND o_custkey BETWEEN c_custkey AND c_custkey + 1
          UNION ALL SELECT {3 * LEVEL} + o_orderkey, {2 * LEVEL} + o_custkey + 1 FROM orders)
        SELECT m.id, m.parent, coalesce(a.depth = 2 AND b.c = a.c, false) AS refused FROM m JOIN t a ON a.id = m.id LEFT JOIN t b ON b.id = m.parent""",
)
def refused_moves(read, spark):
    """Moves of customers below orders, which are refused if the order is their own, and of orders to other customers."""
    labels = trees.interval_labels(_tree(read))
    custkey, orderkey = F.col("c_custkey"), F.col("o_orderkey")
    orders = read("orders").select("o_orderkey", F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") - 1)).alias("c_custkey"))
    down = orders.join(read("customer").select("c_custkey"), "c_custkey").where(orderkey % 7 == custkey % 7).select((F.lit(2 * LEVEL) + custkey).alias("id"), (F.lit(3 * LEVEL) + orderkey).alias("parent"))
    aside = read("orders").select((F.lit(3 * LEVEL) + orderkey).alias("id"), (F.lit(2 * LEVEL) + F.col("o_custkey") + 1).alias("parent"))
    return trees.refused_moves(labels, down.unionByName(aside))


@query(
    "label_ranges",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS position FROM lineitem), r AS (SELECT o_orderkey * 7 + o_custkey % 5 AS start_at, o_orderpriority AS style, o_custkey AS first_number FROM orders)
       SELECT l_orderkey, l_linenumber, style, position - start_at + first_number AS number FROM p ASOF LEFT JOIN r ON position >= start_at""",
)
def label_ranges(read, spark):
    """As many label ranges as orders: each line has the label of the latest range, wherever it began."""
    lines = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("position"))
    ranges = read("orders").select((F.col("o_orderkey") * 7 + F.col("o_custkey") % 5).alias("start_at"), F.col("o_orderpriority").alias("style"), F.col("o_custkey").alias("first_number"))
    found = records.as_of_ranges(lines, "position", ranges, "start_at")
    return found.select("l_orderkey", "l_linenumber", "style", (F.col("position") - F.col("start_at") + F.col("first_number")).alias("number"))


@query(
    "captions_of_figures",
    """WITH RECURSIVE f AS (SELECT p_partkey AS figure, p_partkey % 97 AS page, p_partkey * 37 % 500 AS x0, p_partkey * 37 % 500 + 60 + p_size AS x1, p_partkey * 53 % 700 AS y0, p_partkey * 53 % 700 + 30 AS y1 FROM part),
       c AS (SELECT c_custkey AS caption, c_custkey % 97 AS page, c_custkey * 41 % 500 AS x0, c_custkey * 41 % 500 + 50 AS x1, c_custkey * 59 % 700 AS y0, c_custkey * 59 % 700 + 10 AS y1 FROM customer),
       g AS (SELECT page, figure, caption, CASE WHEN c.y0 >= f.y1 THEN 'below' ELSE 'above' END AS side, CASE WHEN c.y0 >= f.y1 THEN c.y0 - f.y1 ELSE f.y0 - c.y1 END AS gap, least(f.x1, c.x1) - greatest(f.x0, c.x0) AS shared, least(f.x1 - f.x0, c.x1 - c.x0) AS narrow
             FROM f JOIN c USING (page)),
       w AS (
         SELECT page, figure, caption, side, CAST(gap AS DOUBLE) AS gap, false AS mutual FROM g WHERE gap BETWEEN 0 AND 40 AND shared > 0 AND shared >= 0.3 * narrow
         UNION ALL
         SELECT page, figure, caption, side, gap, mutual FROM (
           SELECT *, max(mutual) OVER (PARTITION BY page, figure) OR max(mutual) OVER (PARTITION BY page, caption) AS used FROM (
             SELECT page, figure, caption, side, gap, row_number() OVER (PARTITION BY page, figure ORDER BY gap, figure, caption) = 1 AND row_number() OVER (PARTITION BY page, caption ORDER BY gap, figure, caption) = 1 AS mutual
             FROM w WHERE NOT mutual))
         WHERE mutual OR NOT used)
       SELECT page, figure, caption, side, gap FROM w WHERE mutual""",
)
def captions_of_figures(read, spark):
    """Captions (customers) and figures (parts) laid out on pages by their keys: mutual nearest neighbours."""
    part, cust = F.col("p_partkey"), F.col("c_custkey")
    edges = lambda k, a, b, width, height: [((k * a) % 500).cast("double").alias("x0"), ((k * a) % 500 + width).cast("double").alias("x1"), ((k * b) % 700).cast("double").alias("y0"), ((k * b) % 700 + height).cast("double").alias("y1")]
    figures = read("part").select((part % 97).alias("page"), part.alias("figure"), *edges(part, 37, 53, F.col("p_size") + 60, 30))
    captions = read("customer").select((cust % 97).alias("page"), cust.alias("caption"), *edges(cust, 41, 59, 50, 10))
    return layout.attach_captions(figures, captions, 40.0)


@query(
    "merge_objects",
    f"""WITH l AS (SELECT {LEVEL} + l_orderkey * 8 + l_linenumber AS id, l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS content FROM lineitem GROUP BY l_orderkey, l_linenumber),
       l1 AS (SELECT *, min(id) OVER (PARTITION BY content) AS rep FROM l),
       lo AS (SELECT l_orderkey, list([l_linenumber, rep] ORDER BY l_linenumber) AS parts FROM l1 WHERE l_linenumber <= 2 GROUP BY 1),
       o AS (SELECT {2 * LEVEL} + o_orderkey AS id, o_orderkey, o_custkey, o_orderpriority AS content, coalesce(parts, []) AS parts, o_orderstatus <> 'P' AS may FROM orders LEFT JOIN lo ON l_orderkey = o_orderkey),
       o1 AS (SELECT *, CASE WHEN may THEN min(id) FILTER (may) OVER (PARTITION BY content, parts) ELSE id END AS rep FROM o),
       f AS (SELECT o_custkey, arg_min(rep, o_orderkey) AS rep FROM o1 GROUP BY 1),
       c AS (SELECT {3 * LEVEL} + c_custkey AS id, min({3 * LEVEL} + c_custkey) OVER (PARTITION BY c_mktsegment, f.rep) AS rep FROM customer LEFT JOIN f ON o_custkey = c_custkey)
       SELECT id, rep AS representative FROM l1 UNION ALL SELECT id, rep FROM o1 UNION ALL SELECT id, rep FROM c""",
)
def merge_objects(read, spark):
    """Lines that look alike, then orders of such lines, then customers of such first orders; pending orders stay as they are."""
    line, order, cust = (F.lit(LEVEL) + F.col("l_orderkey") * 8 + F.col("l_linenumber")), F.lit(2 * LEVEL) + F.col("o_orderkey"), F.lit(3 * LEVEL) + F.col("c_custkey")
    lines = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("content"))
    orders = read("orders")
    own = lines.select(line.alias("id"), "content", F.lit(True).alias("mergeable"))
    own = own.unionByName(orders.select(order.alias("id"), F.concat(F.lit("o"), "o_orderpriority").alias("content"), (F.col("o_orderstatus") != "P").alias("mergeable")))
    own = own.unionByName(read("customer").select(cust.alias("id"), F.concat(F.lit("c"), "c_mktsegment").alias("content"), F.lit(True).alias("mergeable")))
    refs = lines.where("l_linenumber <= 2").select((F.lit(2 * LEVEL) + F.col("l_orderkey")).alias("id"), F.col("l_linenumber").cast("long").alias("place"), line.alias("target"))
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    refs = refs.unionByName(first.select((F.lit(3 * LEVEL) + F.col("o_custkey")).alias("id"), F.lit(0).cast("long").alias("place"), order.alias("target")))
    return objects.merge_identical(own, refs).select("id", "representative")


PICKED = "picked AS (SELECT row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) - 1 AS place, o_custkey AS source, o_orderkey AS page FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _picked(read):
    """Pages (orders) of documents (customers) in the order of the parts, so reordered and with repeats."""
    lines = read("lineitem").join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.select("l_partkey", "l_linenumber", F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("page"))
    return relational.numbered(rows, ["l_partkey", "page", "l_linenumber"], "place").select(F.col("place").cast("long").alias("place"), "source", "page")


@query(
    "assemble_labels",
    f"""WITH {PICKED}, ranges AS (SELECT o_custkey AS source, o_orderkey AS start, o_orderstatus AS style, o_orderkey % 10 + 1 AS first FROM orders WHERE o_orderpriority = '1-URGENT'),
       e AS (SELECT place, style, coalesce(page - start + first, page + 1) AS number FROM picked p ASOF LEFT JOIN ranges r ON p.source = r.source AND p.page >= r.start),
       b AS (SELECT *, place > 0 AND style IS NOT DISTINCT FROM lag(style) OVER (ORDER BY place) AND number = lag(number) OVER (ORDER BY place) + 1 AS goes_on FROM e)
       SELECT place AS start, style, number AS first FROM b WHERE NOT coalesce(goes_on, false)""",
)
def assemble_labels(read, spark):
    orders = read("orders").where("o_orderpriority = '1-URGENT'")
    ranges = orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("start"), F.col("o_orderstatus").alias("style"), (F.col("o_orderkey") % 10 + 1).alias("first"))
    return assembly.assemble_labels(_picked(read), ranges)


@query(
    "assemble_outlines",
    f"""WITH {PICKED}, chosen AS (SELECT * FROM picked WHERE page % 3 <> 0), target AS (SELECT source, page, min(place) AS target FROM chosen GROUP BY ALL), src AS (SELECT source, min(place) AS at_place FROM chosen GROUP BY 1),
       e AS (SELECT {LEVEL} + o_custkey AS id, 0 AS level, o_custkey AS source, min(o_orderkey) AS page, o_custkey AS k FROM orders GROUP BY o_custkey
             UNION ALL SELECT {2 * LEVEL} + o_orderkey, 1, o_custkey, o_orderkey, o_orderkey FROM orders
             UNION ALL SELECT DISTINCT {3 * LEVEL} + l_orderkey * 8 + l_linenumber, 2, o_custkey, o_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 2),
       k AS (SELECT e.*, target, at_place FROM e JOIN target USING (source, page) JOIN src USING (source)),
       h AS (SELECT k.*, CASE WHEN level > 0 AND top.id IS NOT NULL THEN top.id END AS top, CASE WHEN level = 2 THEN o.id END AS own,
                    CASE level WHEN 0 THEN [at_place, k.source] WHEN 1 THEN [at_place, k.source, k.k] ELSE [at_place, k.source, k.page, k.k] END AS ord
             FROM k LEFT JOIN (SELECT id, source FROM k WHERE level = 0) top ON top.source = k.source LEFT JOIN (SELECT id, page FROM k WHERE level = 1) o ON o.page = k.page)
       SELECT id, coalesce(own, top) AS parent, (CASE WHEN own IS NULL THEN 0 ELSE 1 END) + (CASE WHEN top IS NULL THEN 0 ELSE 1 END) AS depth, list_transform(ord, lambda x: CAST(x AS BIGINT)) AS ord, target FROM h""",
)
def assemble_outlines(read, spark):
    """Outlines of customers, their orders and these orders' first lines, spliced for the picked pages."""
    orders = read("orders")
    picked = _picked(read).where("page % 3 <> 0")
    entry = lambda i, parent, k, page, source: [i.cast("long").alias("id"), parent.cast("long").alias("parent"), k.cast("long").alias("ord"), page.alias("page"), source.alias("source")]
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    tops = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select(*entry(LEVEL + cust, F.lit(None), cust, order, cust))
    middle = orders.select(*entry(2 * LEVEL + order, LEVEL + cust, order, order, cust))
    lines = read("lineitem").where("l_linenumber <= 2").join(orders, F.col("l_orderkey") == order).select("o_orderkey", "l_linenumber", "o_custkey").distinct()
    low = lines.select(*entry(3 * LEVEL + order * 8 + F.col("l_linenumber"), 2 * LEVEL + order, F.col("l_linenumber"), order, cust))
    return assembly.splice_outlines(tops.unionByName(middle).unionByName(low), picked)


@query(
    "colorants_of_parts",
    f"""WITH RECURSIVE own AS (SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS value FROM part), uses AS (
         SELECT DISTINCT l_partkey AS node, {LEVEL} + l_suppkey AS part FROM lineitem WHERE l_linenumber = 1
         UNION ALL SELECT {LEVEL} + s_suppkey, s_suppkey * 3 % 50 + 1 FROM supplier),
       reach AS (SELECT node, value FROM own UNION SELECT uses.node, reach.value FROM reach JOIN uses ON uses.part = reach.node)
       SELECT node, value FROM reach""",
)
def colorants_of_parts(read, spark):
    """Colorants (sizes) of parts and of all that they use through suppliers, with shared suppliers and cycles."""
    own = read("part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("value"))
    uses = read("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("node"), (F.lit(LEVEL) + F.col("l_suppkey")).alias("part")).distinct()
    uses = uses.unionByName(read("supplier").select((F.lit(LEVEL) + F.col("s_suppkey")).alias("node"), (F.col("s_suppkey") * 3 % 50 + 1).alias("part")))
    return trees.set_values(trees.flowing_sets(own, uses))


@query(
    "edited_bookmarks",
    """WITH RECURSIVE o AS (SELECT *, lag(o_orderkey) OVER w AS before, min(o_orderkey) OVER (PARTITION BY o_custkey) AS head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
       raw AS (SELECT o_custkey, o_orderkey AS k, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'insert' WHEN '2' THEN 'move' WHEN '3' THEN 'remove' WHEN '4' THEN 'insert' ELSE 'move' END AS op,
                      CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '4') THEN -o_orderkey ELSE o_orderkey END AS id,
                      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN o_orderkey WHEN '4' THEN -before WHEN '2' THEN head ELSE before END AS anchor FROM o),
       e AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS seq FROM raw),
       s AS (
         SELECT o_custkey, CAST(0 AS BIGINT) AS seq, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey
         UNION ALL
         SELECT s.o_custkey, e.seq, CASE
           WHEN op = 'remove' THEN list_filter(ids, lambda x: x <> e.id)
           WHEN list_contains(ids, anchor) AND op = 'insert' AND NOT list_contains(ids, e.id) THEN list_concat(ids[:list_position(ids, anchor)], [e.id], ids[list_position(ids, anchor) + 1:])
           WHEN list_contains(ids, anchor) AND op = 'move' AND list_contains(ids, e.id) AND e.id <> anchor THEN list_concat(list_filter(ids[:list_position(ids, anchor)], lambda x: x <> e.id), [e.id], list_filter(ids[list_position(ids, anchor) + 1:], lambda x: x <> e.id))
           ELSE ids END
         FROM s JOIN e ON e.o_custkey = s.o_custkey AND e.seq = s.seq + 1),
       last AS (SELECT o_custkey, arg_max(ids, seq) AS ids FROM s GROUP BY 1)
       SELECT o_custkey, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM last""",
)
def edited_bookmarks(read, spark):
    """Bookmarks (orders) of each customer after inserts, moves and removals in turn; the keys' order equals a full renumbering."""
    own = Window.partitionBy("o_custkey")
    orders = read("orders").withColumn("_before", F.lag("o_orderkey").over(own.orderBy("o_orderkey"))).withColumn("_head", F.min("o_orderkey").over(own))
    kind, key = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey")
    op = F.when(kind.isin("1", "4"), "insert").when(kind == "3", "remove").otherwise("move")
    anchor = F.when(kind == "1", key).when(kind == "4", -F.col("_before")).when(kind == "2", F.col("_head")).otherwise(F.col("_before"))
    edits = orders.select("o_custkey", F.row_number().over(own.orderBy("o_orderkey")).alias("seq"), op.alias("op"), F.when(kind.isin("1", "4"), -key).otherwise(key).alias("id"), anchor.alias("anchor"))
    rows = read("orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("place"))
    found = trees.edited_order(rows, edits, "o_custkey")
    return found.select("o_custkey", "id", F.row_number().over(own.orderBy("key")).cast("long").alias("place"))


#: Regions as documents, their customers as pages, orders as annotations, order lines as other objects, parts as structure.
FILES = """owner AS (
  SELECT CAST(s_nationkey % 5 AS BIGINT) AS doc, 1 AS part, CAST(NULL AS BIGINT) AS page, 1 AS kind, s_suppkey AS position, s_suppkey AS spec FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT c_nationkey % 5, 2, c_custkey, 2, 0, c_custkey % 40 FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_nationkey % 5, 2, c_custkey, 3, o_orderkey, o_orderkey % 700 FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT c_nationkey % 5, 2, c_custkey, 4, l_orderkey * 10 + l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT p_partkey % 5, 3, NULL, 5, p_partkey, p_partkey + p_size FROM part
), spec AS (SELECT p_partkey AS spec, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Source' ELSE 'Data' END AS relationship, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS content FROM part)"""


@query(
    "associated_files",
    f"""WITH {FILES}, first AS (SELECT *, row_number() OVER (PARTITION BY doc, spec ORDER BY part, page NULLS FIRST, kind, position) AS n FROM owner)
        SELECT doc, spec, ['Document', 'Page', 'Annotation', 'XObject', 'StructureElement'][kind] AS kind, page, coalesce(relationship, 'Unspecified') AS relationship, coalesce(name, '') AS name, content
        FROM first JOIN spec USING (spec) WHERE n = 1""",
)
def associated_files(read, spark):
    """Each file that a document's objects name, with the first that names it."""
    doc = lambda c: (F.col(c) % 5).cast("long").alias("doc")
    owner = lambda df, d, kind, page, position, spec: df.select(doc(d), F.lit(kind).alias("kind"), page.cast("long").alias("page"), position.cast("long").alias("position"), F.array(spec.cast("long")).alias("files"))
    none, col = F.lit(None), F.col
    customers = read("customer").select("c_custkey", "c_nationkey")
    orders = read("orders").select("o_orderkey", "o_custkey").join(customers, col("o_custkey") == col("c_custkey"))
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(orders, col("l_orderkey") == col("o_orderkey"))
    owners = [
        owner(read("supplier").where("s_suppkey % 3 = 0"), "s_nationkey", "Document", none, col("s_suppkey"), col("s_suppkey")),
        owner(customers.where("c_custkey % 2 = 0"), "c_nationkey", "Page", col("c_custkey"), F.lit(0), col("c_custkey") % 40),
        owner(orders, "c_nationkey", "Annotation", col("c_custkey"), col("o_orderkey"), col("o_orderkey") % 700),
        owner(lines, "c_nationkey", "XObject", col("c_custkey"), col("l_orderkey") * 10 + col("l_linenumber"), col("l_partkey")),
        owner(read("part"), "p_partkey", "StructureElement", none, col("p_partkey"), col("p_partkey") + col("p_size")),
    ]
    key = col("p_partkey")
    told = [F.when(key % 3 == 1, "Source").when(key % 3 == 2, "Data").alias("relationship"), F.when(key % 4 != 0, col("p_name")).alias("name"), F.when(key % 7 != 0, col("p_brand")).alias("content")]
    specs = read("part").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("doc"), key.alias("spec"), *told)
    return objects.associated_files(reduce(DataFrame.unionByName, owners), specs, "doc", "spec")
