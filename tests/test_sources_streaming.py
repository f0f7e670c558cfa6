from pyspark.sql import functions as F

from folio.operators import search
from folio.sources import xfdf
from folio.streaming import events as E

XML = """<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields><field name="a"><value>1</value><value>2</value></field>
<field name="b"><field name="c"><value>x &amp; y</value></field></field></fields>
<annots><text page="3" name="n" title="me"><contents>hi</contents></text></annots></xfdf>"""


def test_xfdf(spark, tmp_path):
    (tmp_path / "one.xfdf").write_text(XML)
    (tmp_path / "two.xfdf").write_text("<!DOCTYPE x>" + XML)
    fields = xfdf.read_fields(spark, str(tmp_path))
    assert {(r["name"], tuple(r["values"])) for r in fields.collect()} == {("a", ("1", "2")), ("b.c", ("x & y",))}
    again = xfdf.fields_of(xfdf.to_xml(fields, "path"))
    assert {(r["name"], tuple(r["values"])) for r in again.collect()} == {("a", ("1", "2")), ("b.c", ("x & y",))}
    files = spark.createDataFrame([("p", XML)], "path string, xml string")
    assert [tuple(r) for r in xfdf.annotations_of(files).collect()] == [("p", "text", 3, "n", "me", "hi")]


def test_folder(spark, tmp_path):
    for name in ("b.pdf", "A.pdf", ".hidden.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = [r["path"].rsplit("/", 1)[1] for r in search.folder_documents(spark, str(tmp_path), "*.pdf").collect()]
    assert got == ["A.pdf", "b.pdf"]


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _events(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    src.repartitionByRange(3, "ts").write.parquet(path)
    return src, E.read_stream(spark, path, src.schema)


def test_stateless_search(spark, data, tmp_path):
    src, stream = _events(spark, data, tmp_path)
    got = _run(E.incremental_search(stream, "event_type", "ERR"), "found")
    assert got.count() == src.where("event_type = 'error'").count() > 0


def test_windows_match_batch(spark, data, tmp_path):
    src, stream = _events(spark, data, tmp_path)
    got = {(r["start"], r["event_type"]): r["n"] for r in _run(E.tumbling_counts(stream, "ts", "event_type", "1 hour", "90 days"), "counts", "complete").collect()}
    want = {(r["w"]["start"], r["event_type"]): r["count"] for r in src.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().collect()}
    assert got == want


def test_settled_sessions(spark, data, tmp_path):
    src, stream = _events(spark, data, tmp_path)
    got = _run(E.settled(stream, "ts", "user_id", "6 hours", "90 days"), "bursts", "complete")
    assert got.agg(F.sum("events")).first()[0] == src.count()


def test_newest_generation(spark, tmp_path):
    path = str(tmp_path / "g")
    spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, "d")], "client long, gen long, what string").coalesce(1).write.parquet(path)
    stream = E.read_stream(spark, path, spark.read.parquet(path).schema)
    got = _run(E.newest_generation(stream, "client", "gen", "client long, gen long, what string"), "fresh")
    assert {r["what"] for r in got.collect()} == {"a", "b", "d"}


def test_history(spark):
    log = spark.createDataFrame([(1, i, a) for i, a in enumerate(["edit", "edit", "undo", "redo", "undo", "edit", "redo"])], "doc long, at long, action string")
    got = [r["position"] for r in E.history_positions(log, "doc", "at", "action").orderBy("at").collect()]
    assert got == [1, 2, 1, 2, 1, 2, 2]
