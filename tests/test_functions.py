import datetime

import pytest
from pyspark.sql import functions as F

from folio.functions import dates as D
from folio.functions import facets, filters, sentences
from folio.functions import numbers as N
from folio.functions import text as T
from folio.operators import language, quality, records, relational, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("$1,234.50", 1234.5), ("1.234,50 €", 1234.5), ("(42)", -42.0), ("-3", -3.0), ("1,234", 1234.0), ("1.234", 1.234), ("12,5", 12.5), ("1,234,567", 1234567.0), ("", None), ("abc", None), (None, None)],
)
def test_parse_number(spark, text, expected):
    assert one(spark, N.parse_number(F.lit(text).cast("string"))) == expected


def test_format_number(spark):
    assert one(spark, N.format_number(F.lit(1234.5), 2, 0, 0, "$")) == "$1,234.50"
    assert one(spark, N.format_number(F.lit(1234.5), 2, 2, 0, " €", False)) == "1.234,50 €"
    assert one(spark, N.format_number(F.lit(-42.0), 0, 1, 2)) == "(42)"
    assert one(spark, N.format_number(F.lit(-0.001), 2)) == "0.00"
    assert one(spark, N.format_number(F.lit(2.5), 0)) == "3"
    assert one(spark, N.format_percent(F.lit(0.256), 1)) == "25.6%"


def test_masks(spark):
    assert one(spark, N.mask(F.lit("0412345678"), "phone")) == "(041) 234-5678"
    assert one(spark, N.mask(F.lit("123456789"), "ssn")) == "123-45-6789"
    assert one(spark, N.mask(F.lit("1234"), "zip")) == "1234"


def test_expressions(spark):
    df = spark.createDataFrame([(12.5, 4.0, None)], "price double, quantity double, unit_cost double")
    run = lambda e, f: df.select(N.evaluate(e, f).alias("x")).first()["x"]
    assert run("(Price - 2.5) * Quantity / 2", {"Price": "price", "Quantity": "quantity"}) == 20
    assert run(r"Unit\ Cost * -Quantity", {"Unit Cost": "unit_cost", "Quantity": "quantity"}) == 0
    assert run("Price / (Quantity - 4)", {"Price": "price", "Quantity": "quantity"}) is None
    with pytest.raises(ValueError):
        N.evaluate("a; drop", {"a": "price", "drop": "price"})


def test_labels(spark):
    got = [one(spark, N.label(F.lit(n), s)) for n, s in ((4, "r"), (1999, "R"), (27, "a"), (53, "A"), (7, "D"), (100_001, "r"))]
    assert got == ["iv", "MCMXCIX", "aa", "AAA", "7", "100001"]
    assert one(spark, N.label(F.lit(3), None, "cover")) == "cover"


def test_roman_labels_beyond_the_usual_bound(spark):
    assert [one(spark, N.label(F.lit(n), "r", most_roman=None)) for n in (100_001, 0)] == ["m" * 100 + "i", "0"]


def test_a_word_does_not_reach_over_a_line_end(spark):
    got = spark.createDataFrame([("ab\ncd",), ("ab cd",)], "t string").select(facets.word_at(F.col("t"), F.lit(3)).alias("w")).collect()
    assert [tuple(r["w"]) for r in got] == [(3, 2), (3, 2)]
    assert tuple(spark.createDataFrame([("ab\n-",)], "t string").select(facets.word_at(F.col("t"), F.lit(3)).alias("w")).first()["w"]) == (3, 0)


def test_document_dates(spark):
    utc = lambda *a: datetime.datetime(*a)
    for text, expected in (("D:2026", utc(2026, 1, 1)), ("D:20260307", utc(2026, 3, 7)), ("D:20260307120000+02'00'", utc(2026, 3, 7, 10)), ("D:20260307120000Z", utc(2026, 3, 7, 12)), ("D:20261307", None), ("x", None)):
        assert one(spark, D.parse_document_date(F.lit(text)).cast("timestamp_ntz")) == expected


def test_form_dates(spark):
    day = F.lit("2026-03-07 13:45:09").cast("timestamp")
    shown = {"dd/mm/yyyy": "07/03/2026", "mmm d, yyyy": "Mar 7, 2026", D.indexed_format(2): "03/07/26", D.indexed_format(6): "07-Mar-26", D.indexed_format(11): "March 7, 2026", "HH:MM:ss": "13:45:09", D.indexed_format(1, True): "1:45 PM"}
    for form, expected in shown.items():
        assert one(spark, D.format_date(day, form)) == expected
    assert D.indexed_format(99) == "m/d"


def test_search_semantics(spark):
    docs = spark.createDataFrame([(1, "Hello  world, hello\nWORLD"), (2, "shelloworld"), (3, "naïve café ﬁn"), (4, None), (5, "a+x b")], "id int, text string")
    count = lambda q, **o: {r["id"]: r["matches"] for r in search.count_matches(docs, q, **o).collect()}
    assert count("  hello   world ") == {1: 2}
    assert count("hello") == {1: 2, 2: 1}
    assert count("hello", whole_word=True) == {1: 2}
    assert count("cafe", ignore_diacritics=True) == {3: 1}
    assert count("+x", whole_word=True) == {5: 1}
    assert count("   ") == {}
    assert count("Hello", match_case=True) == {1: 1}


def test_mail_and_predicates(spark):
    assert one(spark, T.emails(F.lit("write user.name+tag@mail.example.co.uk! a..b@c.org x@y"))) == ["user.name+tag@mail.example.co.uk", "b@c.org"]
    for text, expected in (("12", True), ("Page 3 of 9", True), ("- 4 -", True), ("xiv", True), ("page", False), ("chapter 1", False), ("", False)):
        assert one(spark, T.is_page_number(F.lit(text))) is expected
    for text, expected in (("Figure 3 shows", True), ("table A. x", True), ("figured out", False)):
        assert one(spark, T.is_caption(F.lit(text))) is expected
    for text, expected in (("• item", True), ("1. item", True), ("(a) item", True), ("1234. no", False), ("no", False)):
        assert one(spark, T.starts_item(F.lit(text))) is expected
    assert one(spark, T.join_hyphens(F.lit("exam-\nple and well-\nKnown"))) == "example and well-\nKnown"
    assert one(spark, T.fold(F.lit("Ｆｕｌｌ “x” – y"), compatibility=True)) == 'full "x" - y'


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "Dr. Smith came. He left! Why?\n\nA heading\nThe text goes on."), (2, None), (3, ""), (4, "word " * 200)], "id int, text string")
    got = {}
    for r in sentences.sentences(docs, "id").orderBy("id", "ordinal").collect():
        got.setdefault(r["id"], []).append(r["sentence"])
    assert got[1] == ["Dr. Smith came.", "He left!", "Why?", "A heading", "The text goes on."]
    assert 2 not in got and 3 not in got
    assert all(len(s) <= 305 for s in got[4]) and " ".join(got[4]) == ("word " * 200).strip()


def test_filters(spark):
    import base64
    import zlib

    df = spark.createDataFrame([(bytearray(zlib.compress(b"hello" * 99)), bytearray(base64.a85encode(b"hello") + b"~>"), bytearray(b"\x02abc\xfed\x80"))], "z binary, a binary, r binary")
    row = df.select(filters.decode(F.col("z"), ["FlateDecode"]).alias("z"), filters.decode(F.col("a"), ["ASCII85Decode"]).alias("a"), filters.decode(F.col("r"), ["RunLengthDecode"]).alias("r"), filters.ascii_hex(F.lit("68 65 6C6c 7>")).alias("h"), filters.decode(F.col("z"), ["Unknown"]).alias("u")).first()
    assert (bytes(row["z"]), bytes(row["a"]), bytes(row["r"]), bytes(row["h"]), row["u"]) == (b"hello" * 99, b"hello", b"abcddd", b"hellp", None)
    data = spark.createDataFrame([(bytearray([1, 1, 1, 1, 2, 1, 1, 1]),)], "d binary")
    assert bytes(data.select(filters.png_up(3)("d")).first()[0]) == bytes([1, 2, 3, 2, 3, 4])


@pytest.mark.parametrize(("spec", "expected"), [("3", [2]), ("1-3, 7", [0, 1, 2, 6]), ("10-", [9, 10, 11]), ("5;2 2-3", [1, 2, 4]), ("0", []), ("13", []), ("4-2", []), ("two", []), ("", []), ("1-3, x", [])])
def test_page_ranges(spark, spec, expected):
    df = spark.createDataFrame([(spec,)], "spec string")
    assert [r["page"] for r in relational.page_ranges(df, "spec", 12).orderBy("page").collect()] == expected


def test_relational_edges(spark):
    empty = spark.createDataFrame([], "k long, v string")
    some = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert relational.upsert(empty, some, "k").count() == 2
    assert {(r["k"], r["change"]) for r in relational.revision_diff(some, empty, "k").collect()} == {(1, "removed"), (2, "removed")}
    assert relational.revision_diff(some, some, "k").count() == 0
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "P")], "custom string, standard string")
    df = spark.createDataFrame([("a",), ("z",), (None,)], "role string")
    assert sorted(str(r["role"]) for r in records.resolve_chain(df, "role", chain, 8).collect()) == ["None", "P", "z"]
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert {(r["node"], r["depth"]) for r in records.reachable(edges, roots).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_language_guess(spark):
    rows = [(1, "the cat and the dog of it"), (2, "короткий текст на русском языке"), (3, "short"), (4, None), (5, "これは日本語の文章です漢字")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert {r["id"]: r["guess"] for r in language.guess_language(df).collect()} == {1: "en", 2: "ru", 3: None, 4: None, 5: "ja"}


def test_rule_report(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    got = {r["rule"]: (r["failures"], r["first_context"], r["status"]) for r in quality.rule_report(df, "k", {"set": F.col("v").isNotNull(), "key": F.col("k") > 0}).collect()}
    assert got == {"set": (1, 2, "failed"), "key": (0, None, "passed")}


def test_phrases_of_every_length(spark):
    docs = spark.createDataFrame([(1, "foo bar baz"), (2, "xfoo  bar baz"), (3, None), (4, ""), (5, "one two three four")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "foo ba"), (2, "oo"), (3, "two three fo"), (4, None), (5, "wo three four"), (6, "two  three four"), (7, "bar")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in search.phrase_hits(docs, phrases, "doc_id", "item_id").collect()}
    want = {(d["doc_id"], p["item_id"]) for d in docs.collect() for p in phrases.collect() if d["text"] is not None and p["text"] is not None and p["text"] in d["text"]}
    assert got == want and (1, 1) in got and (1, 2) in got
    with pytest.raises(ValueError):
        search.phrase_hits(docs, phrases, "doc_id", "item_id", most_short=2)


def test_rows_are_numbered_over_all(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 617, F.lit(1000)).alias("k")).repartition(7)
    assert all(r["k"] == r["place"] for r in relational.numbered(rows, ["k"], "place").collect())
    assert relational.numbered(rows.limit(0), ["k"], "place").count() == 0
    sources = [spark.range(7).select(F.col("id").alias("k")), spark.range(2).select(F.col("id").alias("k")), spark.range(4).select(F.col("id").alias("k"))]
    got = [(r["source"], r["key"]) for r in relational.interleave(sources, "k", 3).orderBy("place").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (0, 3), (0, 4), (0, 5), (2, 3), (0, 6)]


def test_starts_of_rows_that_repeat_a_key(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (1, "x ab")], "doc_id long, text string")
    assert sorted(r["start"] for r in search.match_starts(docs, "ab", "doc_id").collect()) == [1, 3, 4]


def test_packet_properties(spark):
    packet = """<x><rdf:RDF xmlns:rdf="http://r/"><rdf:Description rdf:about="" xmlns:dc="http://p.org/dc/" pdfaid:part="2" tool:name='a > "b"'>
    <dc:title xmlns:q="http://q/"><rdf:Alt><rdf:li xml:lang="x-default">One &amp;lt; two</rdf:li></rdf:Alt></dc:title><dc:empty/><dc:blank> </dc:blank>
    <!-- <dc:hidden>no</dc:hidden> --><dc:link rdf:resource="http://l/x"/><pdfaid:part>3</pdfaid:part><dc:text a:b="c/d"> plain </dc:text ></rdf:Description>
    <rdf:Description tool:more="yes"/></rdf:RDF></x>"""
    rows = spark.createDataFrame([(packet,), ("no packet",), (None,)], "p string").select(facets.packet_properties(F.col("p")).alias("m")).collect()
    want = {"pdfaid:part": ["3"], "tool:name": ['a > "b"'], "tool:more": ["yes"], "dc:title": ["One &lt; two"], "dc:link": ["http://l/x"], "dc:text": ["plain"]}
    assert [r["m"] for r in rows] == [want, {}, None]


def test_packets_are_parsed_once(spark):
    # Each name and each use had the whole packet parsed again.
    df = spark.createDataFrame([("x",)], "p string").select(facets.packet_properties(F.col("p")).alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(p#") == 1


def test_times_of_forms(spark):
    cases = [("14:05", "HH:MM", 50700), ("2:05 pm", "HH:MM", 50700), ("2:05PM", "HH:MM", 50700), (" 9:07:03 ", "h:MM tt", 32823), ("12:00 am", "h:MM tt", 0), ("25:00", "HH:MM", None), ("noon", "HH:MM", None), ("", "HH:MM", None), (None, "HH:MM", None), ("3/4/21 5:06 am", "m/d/yy h:MM tt", 18360)]
    for text, form, want in cases:
        df = spark.createDataFrame([(text,)], "x string")
        assert df.select(D.parse_time(F.col("x"), form)).first()[0] == want, (text, form)


def test_places_are_those_of_the_text_itself(spark):
    texts = ["İİİ The end", "the", "no", "", None, "a\U0001f600b THE", "t.he"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    at = lambda query: [r[0] for r in df.select(T.first_place(F.col("x"), query)).collect()]
    assert at("the") == [5, 1, 0, 0, None, 5, 0]
    assert at("t.h") == [0, 0, 0, 0, None, 0, 1] and at("") == [0, 0, 0, 0, None, 0, 0]
    snippets = search.first_snippets(df, "THE", "x", text="x", around=2).collect()
    assert {r["x"]: r["snippet"] for r in snippets} == {texts[0]: "İ The e", "the": "the", texts[5]: "b THE"}


def test_lines_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "the\nno\nthe the"), (1, "x"), (2, None), (None, "")], "id long, text string")
    counted = search.line_values(F.col("text"), lambda x: search.match_count(x, "the"), lambda n: n > 0)
    got = sorted((str(r["id"]), r["v"] and [tuple(v) for v in r["v"]]) for r in df.select("id", counted.alias("v")).collect())
    assert got == [("1", []), ("1", [(0, 1), (2, 2)]), ("2", None), ("None", [])]
    assert df.select(search.match_count(F.col("text"), " ")).distinct().collect()[0][0] == 0
