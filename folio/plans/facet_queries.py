"""Queries over what documents say of themselves: strings, packets, claims, files, layers, destinations, forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import facets as A
from ..functions import filters
from ..operators import records, relational
from .registry import query


@query("text_string_decode", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '˘•€' || c_name ELSE c_name || 'é€漢' END AS name FROM customer")
def text_string_decode(read, spark):
    text, kind = F.concat("c_name", F.lit("é€漢")), F.col("c_custkey") % 4
    mark = lambda digits: F.unhex(F.lit(digits))
    data = (
        F.when(kind == 0, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
        .when(kind == 1, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")))
        .when(kind == 2, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")))
        .otherwise(F.concat(mark("1880A0"), F.encode("c_name", "UTF-8")))
    )
    return read("customer").select("c_custkey", A.text_string(data).alias("name"))


@query(
    "packet_properties",
    """SELECT p_partkey, p_name AS title, p_brand || ' & co' AS tool, CASE p_partkey % 4 WHEN 0 THEN '2B' WHEN 1 THEN '4' WHEN 2 THEN NULL ELSE NULL END AS level, 2 AS subjects FROM part""",
)
def packet_properties(read, spark):
    """Title, tool, claimed level and number of subjects, read from metadata packets."""
    kind = F.col("p_partkey") % 4
    claim = F.when(kind == 0, F.lit(' pdfaid:part="2" pdfaid:conformance="B"')).when(kind == 1, F.lit(' pdfaid:part="4"')).when(kind == 2, F.lit(' pdfaid:part="9"')).otherwise(F.lit(""))
    packet = F.concat(
        F.lit('<x:xmpmeta><rdf:RDF xmlns:rdf="r"><rdf:Description rdf:about="" xmlns:dc="d"'), claim, F.lit('><dc:title><rdf:Alt><rdf:li xml:lang="x-default">'), F.col("p_name"),
        F.lit("</rdf:li></rdf:Alt></dc:title><xmp:CreatorTool>"), F.col("p_brand"), F.lit(" &amp; co</xmp:CreatorTool><dc:subject><rdf:Bag><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    first = lambda name: F.element_at(F.try_element_at("p", F.lit(name)), 1)
    # Packets are long to parse and their rows short, so a file that is one split is dealt over tasks first.
    parts = read("part").select("p_partkey", "p_name", "p_brand").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    found = parts.select("p_partkey", A.packet_properties(packet).alias("p"))
    return found.select("p_partkey", first("dc:title").alias("title"), first("xmp:CreatorTool").alias("tool"), A.claimed_level(F.col("p")).alias("level"), F.size(F.try_element_at("p", F.lit("dc:subject"))).alias("subjects"))


@query("runnable_files", "SELECT p_partkey FROM part WHERE p_partkey % 5 IN (0, 1, 4)")
def runnable_files(read, spark):
    endings = F.array(*[F.lit(x) for x in (".EXE", "", ".pdf", ".txt", ".tar.sh")])
    path = F.concat(F.lit("a.b/part"), F.col("p_partkey").cast("string"), endings[F.col("p_partkey") % 5])
    return read("part").where(A.is_runnable(path)).select("p_partkey")


@query("carried_annotations", "SELECT event_id, event_type = 'view' OR event_type = 'click' AS carried FROM events")
def carried_annotations(read, spark):
    subtype = F.when(F.col("event_type") == "view", "Highlight").when(F.col("event_type") == "click", "Stamp").otherwise(F.col("event_type"))
    return read("events").select("event_id", A.is_carried(subtype).alias("carried"))


@query("cjk_join", "SELECT n_nationkey, '漢字仮名 ' || n_name || ' かな。次' AS joined FROM nation")
def cjk_join(read, spark):
    text = F.concat(F.lit("漢字\n仮名\n"), F.col("n_name"), F.lit("\nかな。\n次"))
    return read("nation").select("n_nationkey", A.join_lines(text).alias("joined"))


@query(
    "word_at",
    r"""WITH w AS (SELECT doc_id, text, length(regexp_extract(substr(text, 1, 25), '([\p{L}\p{N}_\p{Mn}\p{Mc}]*)$', 1)) AS l, length(regexp_extract(substr(text, 26), '^([\p{L}\p{N}_\p{Mn}\p{Mc}]*)', 1)) AS r FROM documents WHERE length(text) >= 25)
        SELECT doc_id, CAST(25 - l AS INTEGER) AS start, CAST(l + r AS INTEGER) AS length FROM w""",
)
def word_at(read, spark):
    found = read("documents").select("doc_id", A.word_at(F.col("text"), F.lit(25)).alias("w"))
    return found.where("w is not null").select("doc_id", F.col("w.start").cast("int").alias("start"), F.col("w.length").cast("int").alias("length"))


@query("document_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN -p_size * 1.0 WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 0.25 ELSE NULL END AS x FROM part")
def document_numbers(read, spark):
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("-"), size, F.lit("."))).when(kind == 1, F.concat(F.lit(" +"), size, F.lit(".5E3"))).when(kind == 2, F.lit(".25")).otherwise(F.lit("x1"))
    return read("part").select("p_partkey", A.document_number(text).alias("x"))


@query("layer_visibility", "SELECT o_orderkey, o_orderkey % 3 <> 0 OR o_custkey % 3 <> 0 AS any_on, o_orderkey % 3 <> 0 AND o_custkey % 3 <> 0 AS all_on, o_orderkey % 3 = 0 OR o_custkey % 3 = 0 AS any_off, o_orderkey % 3 = 0 AND o_custkey % 3 = 0 AS all_off FROM orders")
def layer_visibility(read, spark):
    layers, hidden = F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 3).cast("int")), F.array(F.lit(0), F.lit(7))
    shown = [A.is_visible(layers, hidden, p).alias(n) for p, n in (("AnyOn", "any_on"), ("AllOn", "all_on"), ("AnyOff", "any_off"), ("AllOff", "all_off"))]
    return read("orders").select("o_orderkey", *shown)


@query("named_destinations", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 <> 0 THEN p_size END AS page FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def named_destinations(read, spark):
    """Links with the page of the destination they name; null where there is none."""
    named = read("part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("dest"), F.col("p_size").alias("page"))
    links = read("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("dest"))
    return links.join(named, "dest", "left").select("l_orderkey", "l_linenumber", "page")


@query("edit_destinations", "SELECT p_partkey AS dest, CASE WHEN p_partkey % 4 = 0 THEN p_size + 100 ELSE p_size END AS page FROM part WHERE p_partkey % 5 <> 0")
def edit_destinations(read, spark):
    """Named destinations set, replaced and removed: a change without a page removes its name."""
    base = read("part").where("p_partkey % 4 <> 0 or p_partkey % 8 = 0").select(F.col("p_partkey").alias("dest"), F.col("p_size").alias("page"))
    changes = read("part").where("p_partkey % 4 = 0 or p_partkey % 5 = 0").select(F.col("p_partkey").alias("dest"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") + 100).alias("page"))
    return records.edited(base, changes, "dest", "page")


@query("edit_attachments", "SELECT s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS content FROM supplier WHERE s_suppkey % 7 <> 0")
def edit_attachments(read, spark):
    """Attachments added, updated and removed by name."""
    base = read("supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("name"), F.lit("old").alias("content"))
    changes = read("supplier").where("s_suppkey % 2 = 0 or s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 7 != 0, F.lit("new")).alias("content"))
    return records.edited(base, changes, "name", "content")


@query("form_submission", "SELECT c_mktsegment || '.' || c_custkey AS name, c_acctbal AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def form_submission(read, spark):
    """Fields to send: all but those listed or under a listed one."""
    fields = read("customer").select(F.concat_ws(".", "c_mktsegment", F.col("c_custkey").cast("string")).alias("name"), F.col("c_acctbal").alias("value"))
    return records.submitted(fields, "name", ["BUILDING", "MACHINERY"], exclude=True)


@query("script_count", "SELECT count(*) FILTER (WHERE contains(html, '<script')) AS pages, CAST(sum(len(regexp_extract_all(html, '<script'))) AS BIGINT) AS scripts FROM pages")
def script_count(read, spark):
    return read("pages").agg(F.count_if(F.contains("html", F.lit("<script"))).alias("pages"), F.coalesce(F.sum(F.regexp_count("html", F.lit("<script"))), F.lit(0)).cast("long").alias("scripts"))


@query("merged_labels", "SELECT source, page, label FROM (SELECT 0 AS source, CAST(n_nationkey AS BIGINT) AS page, 'a' || (n_nationkey + 1) AS label FROM nation UNION ALL SELECT 1, (SELECT count(*) FROM nation) + r_regionkey, 'b' || (r_regionkey + 7) FROM region)")
def merged_labels(read, spark):
    """Pages of two documents in one, each with the label it had: the second's labels go on from their own first number."""
    sources = [read("nation").select(F.col("n_nationkey").cast("long").alias("k")), read("region").select(F.col("r_regionkey").cast("long").alias("k"))]
    rows = relational.concatenate(sources, "k")
    label = F.when(F.col("source") == 0, F.concat(F.lit("a"), (F.col("key") + 1).cast("string"))).otherwise(F.concat(F.lit("b"), (F.col("key") + 7).cast("string")))
    return rows.select("source", F.col("place").cast("long").alias("page"), label.alias("label"))


@query("flate_round_trip", None)
def flate_round_trip(read, spark):
    """Bytes of a text after compression and decompression, both in one Python process of a task."""
    import zlib

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress((t or "").encode()))

    return read("documents").select("doc_id", F.decode(filters.flate(packed("text")), "UTF-8").alias("text"))
