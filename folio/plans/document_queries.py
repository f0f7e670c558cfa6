"""Queries over document facets: attributes, actions, functions, codecs, layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import relational, search
from .registry import query

LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS line_text FROM documents"


@query("inherit_attributes", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, r_name) AS title FROM nation JOIN region ON n_regionkey = r_regionkey")
def inherit_attributes(read, spark):
    """A page's own attribute, else its parent's."""
    own = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))
    return read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.coalesce(own, "r_name").alias("title"))


@query("box_normalise", "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS left_edge, greatest(l_discount, l_tax) AS right_edge FROM lineitem")
def box_normalise(read, spark):
    box = V.normal_box(F.col("l_discount"), F.lit(0.0), F.col("l_tax"), F.lit(1.0))
    return read("lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", F.col("b.left").alias("left_edge"), F.col("b.right").alias("right_edge"))


@query("transform_boxes", "SELECT vec_id, 2 * x - y + 1 AS tx, 0.5 * x + y - 3 AS ty FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)")
def transform_boxes(read, spark):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    tx, ty = V.affine((2.0, 0.5, -1.0, 1.0, 1.0, -3.0), x, y)
    return read("embeddings").select("vec_id", tx.alias("tx"), ty.alias("ty"))


POLYGON = [(-0.1, -0.1), (0.12, -0.08), (0.05, 0.02), (0.1, 0.11), (-0.09, 0.1)]


def _polygon_sql() -> str:
    edges = zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True)
    return " + ".join(f"(CASE WHEN (({b} > y) <> ({d} > y)) AND x < ({c} - {a}) * (y - {b}) / ({d} - {b}) + {a} THEN 1 ELSE 0 END)" for (a, b), (c, d) in edges)


@query("point_in_polygon", f"SELECT vec_id FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) WHERE ({_polygon_sql()}) % 2 = 1")
def point_in_polygon(read, spark):
    return read("embeddings").where(V.in_polygon(POLYGON, F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))).select("vec_id")


@query("link_targets", r"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages)""")
def link_targets(read, spark):
    """Links from the root, with the scheme and host of their page."""
    links = F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1)))
    return read("pages").select("page_id", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("root"), links.alias("link")).select("page_id", F.concat("root", "link").alias("target"))


@query("capability_match", "SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'met' WHEN event_type = 'error' THEN 'refused' ELSE 'unknown' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def capability_match(read, spark):
    known = spark.createDataFrame([("click", "met"), ("view", "met"), ("error", "refused")], "capability string, answer string")
    counted = read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(known), F.col("event_type") == F.col("capability"), "left").select("event_type", F.coalesce("answer", F.lit("unknown")).alias("outcome"), "n")


@query("tab_order", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 10), l_extendedprice, l_linenumber, l_partkey) AS tab FROM lineitem")
def tab_order(read, spark):
    """Fields by row, then by column."""
    order = Window.partitionBy("l_orderkey").orderBy(F.floor(F.col("l_quantity") / 10), "l_extendedprice", "l_linenumber", "l_partkey")
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(order).cast("long").alias("tab"))


@query("record_codec", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS INTEGER) AS size, CAST(NULL AS VARCHAR) AS missing FROM part")
def record_codec(read, spark):
    """key=value records, written and read again; escapes keep separators inside values."""
    written = V.write_record({"brand": F.col("p_brand"), "size": F.col("p_size").cast("string")})
    fields = V.read_record(written)
    return read("part").select("p_partkey", fields.alias("r")).select("p_partkey", F.try_element_at("r", F.lit("brand")).alias("brand"), F.try_element_at("r", F.lit("size")).cast("int").alias("size"), F.try_element_at("r", F.lit("missing")).alias("missing"))


@query("hex_round_trip", "SELECT doc_id, hex(encode(text)) AS digits, octet_length(encode(text)) AS bytes FROM documents")
def hex_round_trip(read, spark):
    from ..functions.filters import ascii_hex

    data = ascii_hex(F.concat(F.hex(F.encode("text", "UTF-8")), F.lit(">")))
    return read("documents").select("doc_id", F.hex(data).alias("digits"), F.octet_length(data).cast("long").alias("bytes"))


@query("byte_search", "SELECT doc_id, instr(text, 'tion') - 1 AS first_at FROM documents WHERE contains(text, 'tion')")
def byte_search(read, spark):
    return read("documents").where(F.col("text").contains("tion")).select("doc_id", (F.instr("text", "tion") - 1).cast("long").alias("first_at"))


@query("exponential_function", "SELECT p_partkey, 0.2 + power(least(p_size / 50.0, 1), 1.5) * (0.9 - 0.2) AS y FROM part")
def exponential_function(read, spark):
    return read("part").select("p_partkey", V.exponential(F.least(F.col("p_size") / F.lit(50.0), F.lit(1.0)), 0.2, 0.9, 1.5).alias("y"))


@query("stitching_function", "SELECT p_partkey, CASE WHEN x < 0.3 THEN x / 0.3 WHEN x < 0.6 THEN 1 - (x - 0.3) / 0.3 ELSE 0.5 * (x - 0.6) / 0.4 END AS y FROM (SELECT p_partkey, least(p_size / 50.0, 1) AS x FROM part)")
def stitching_function(read, spark):
    x = F.least(F.col("p_size") / F.lit(50.0), F.lit(1.0))
    pieces = [lambda t: t, lambda t: 1 - t, lambda t: 0.5 * t]
    return read("part").select("p_partkey", V.stitched(x, [0.0, 0.3, 0.6, 1.0], pieces).alias("y"))


@query("sampled_function", "SELECT p_partkey, s[CAST(floor(x) AS INTEGER) + 1] + (x - floor(x)) * (s[CAST(least(floor(x) + 1, 4) AS INTEGER) + 1] - s[CAST(floor(x) AS INTEGER) + 1]) AS y FROM (SELECT p_partkey, least(p_size / 50.0, 1) * 4 AS x, [0.0, 1.0, 0.5, 0.25, 2.0] AS s FROM part)")
def sampled_function(read, spark):
    return read("part").select("p_partkey", V.sampled(F.least(F.col("p_size") / F.lit(50.0), F.lit(1.0)), [0.0, 1.0, 0.5, 0.25, 2.0]).alias("y"))


@query("scale_parse", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_size * 2.5) / (p_size + 1) END AS ratio, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'm' END AS unit FROM part")
def scale_parse(read, spark):
    """``1 cm = 2 m``; what doesn't read as a scale is null."""
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("no scale")).otherwise(F.concat((F.col("p_size") + 1).cast("string"), F.lit(" cm = "), (F.col("p_size") * 2.5).cast("string"), F.lit(" m")))
    scale = V.parse_scale(text)
    return read("part").select("p_partkey", scale.alias("s")).select("p_partkey", F.col("s.ratio").alias("ratio"), F.col("s.unit").alias("unit"))


@query("partial_dates", "SELECT o_orderkey, o_orderkey % 4 <> 3 AS valid FROM orders")
def partial_dates(read, spark):
    kind, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(kind == 0, F.date_format(day, "yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM")).when(kind == 2, F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm"), F.lit("+01:00"))).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return read("orders").select("o_orderkey", V.is_partial_date(text).alias("valid"))


@query("separation_groups", "SELECT o_custkey AS group_id, list(o_orderkey ORDER BY o_orderkey) AS pages, count(DISTINCT o_orderstatus) AS colorants FROM orders GROUP BY 1")
def separation_groups(read, spark):
    rows = read("orders").groupBy(F.col("o_custkey").alias("group_id"))
    return rows.agg(F.array_sort(F.collect_list("o_orderkey")).alias("pages"), F.countDistinct("o_orderstatus").alias("colorants"))


@query("outline_pages", "SELECT o_custkey, min(o_orderkey) AS page, arg_min(o_orderstatus, o_orderkey) AS title FROM orders GROUP BY 1")
def outline_pages(read, spark):
    """The first bookmark of each page stays."""
    return read("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("page"), F.min_by("o_orderstatus", "o_orderkey").alias("title"))


@query("calculation_order", "SELECT c.c_custkey, o.ord FROM customer c JOIN (SELECT 'BUILDING' AS segment, 0 AS ord UNION ALL SELECT 'MACHINERY', 1 UNION ALL SELECT 'HOUSEHOLD', 2) o ON c.c_mktsegment = o.segment")
def calculation_order(read, spark):
    order = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in ("BUILDING", "MACHINERY", "HOUSEHOLD")])).alias("ord", "segment"))
    return read("customer").join(F.broadcast(order), F.col("c_mktsegment") == F.col("segment")).select("c_custkey", "ord")


@query("field_create", "SELECT s_suppkey, 'Supplier#' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 9, '0') AS name, EXISTS (SELECT 1 FROM supplier t WHERE t.s_name = 'Supplier#' || lpad(CAST(supplier.s_suppkey * 2 AS VARCHAR), 9, '0')) AS clashes FROM supplier")
def field_create(read, spark):
    """New names, with whether they are taken."""
    names = read("supplier").select("s_suppkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0")).alias("name"))
    taken = read("supplier").select(F.col("s_name").alias("taken")).distinct()
    return names.join(taken, F.col("name") == F.col("taken"), "left").select("s_suppkey", "name", F.col("taken").isNotNull().alias("clashes"))


@query("notice_groups", f"SELECT doc_id, line, last_value(CASE WHEN length(line_text) BETWEEN 1 AND 40 THEN line_text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM ({LINES})")
def notice_groups(read, spark):
    """Lines under the last short line above them."""
    above = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    short = F.when(F.length("line_text").between(1, 40), F.col("line_text"))
    return search.lines_of(read("documents"), "doc_id").select("doc_id", "line", F.last(short, ignorenulls=True).over(above).alias("heading"))


@query("mostly_right_to_left", r"SELECT doc_id, 2 * len(regexp_extract_all(text, '[\x{0590}-\x{08FF}]')) > len(regexp_extract_all(text, '\p{L}')) AS rtl FROM documents")
def mostly_right_to_left(read, spark):
    letters, rtl = F.regexp_count("text", F.lit(r"\p{L}")), F.regexp_count("text", F.lit(r"[\x{0590}-\x{08FF}]"))
    return read("documents").select("doc_id", (rtl * 2 > letters).alias("rtl"))


@query("first_page_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_orderkey = 500 THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders")
def first_page_first(read, spark):
    """Numbered over all rows and then from each status's first: the groups are few and large."""
    rows = read("orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") != 500).cast("int").alias("later"))
    rows = relational.numbered(rows, ["o_orderstatus", "later", "o_orderkey"], "at")
    first = rows.groupBy("o_orderstatus").agg(F.min("at").alias("first"))
    return rows.join(first, "o_orderstatus").select("o_orderkey", (F.col("at") - F.col("first") + 1).alias("place"))


@query("save_report", "SELECT 'added' AS action, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'kept', count(*) FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3 UNION ALL SELECT 'dropped', count(*) FROM orders WHERE o_orderkey % 5 = 4")
def save_report(read, spark):
    k = F.col("o_orderkey") % 5
    return read("orders").groupBy(F.when(k == 0, "added").when(k == 4, "dropped").otherwise("kept").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("wrapped_lines", None)
def wrapped_lines(read, spark):
    """Texts as lines of at most 80 characters."""
    return read("documents").select("doc_id", F.posexplode(V.wrap(80)(F.col("text"))).alias("line", "line_text"))


@query("recompressed", None)
def recompressed(read, spark):
    """Bytes before and after compression, which is kept only where it is smaller."""
    size = V.deflated_size(F.col("text"))
    before = F.octet_length("text").cast("long")
    return read("documents").select("doc_id", before.alias("bytes_before"), F.least(before, size).alias("bytes_after"))


@query("sentence_split", None)
def sentence_split(read, spark):
    from ..functions.sentences import sentences

    return sentences(read("documents"), "doc_id")
