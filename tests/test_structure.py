import random

import pytest
from pyspark.sql import functions as F

from folio.operators import assembly, layout, objects, records, trees


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(4)
    nodes = [(0, None, 0), (1, None, 1)] + [(i, rng.randrange(max(0, i - 8), i), rng.randint(0, 3)) for i in range(2, 120)]
    cycle = [(900, 901, 0), (901, 900, 0)]
    return nodes, spark.createDataFrame(nodes + cycle, "id long, parent long, ord long")


def walk(nodes):
    children = {}
    for i, parent, ord_ in sorted(nodes, key=lambda n: (n[2], n[0])):
        children.setdefault(parent, []).append(i)
    out, at = {}, [0]

    def visit(i, depth):
        first = at[0]
        at[0] += 1
        for c in children.get(i, []):
            visit(c, depth + 1)
        out[i] = (depth, first, at[0] - 1)

    for r in children[None]:
        visit(r, 0)
    return out


def test_intervals_and_content(spark, tree):
    nodes, df = tree
    want, labels = walk(nodes), trees.interval_labels(df).cache()
    assert {r["id"]: (r["depth"], r["first"], r["last"]) for r in labels.collect()} == want
    rng = random.Random(5)
    held = [(rng.choice([7, *range(120), 5000]), k) for k in range(600)]
    content = spark.createDataFrame(held, "element long, k long")
    first = {i: w[1] for i, w in want.items()}
    inside = lambda e, i: e in first and want[i][1] <= first[e] <= want[i][2]
    got = {r["id"]: (r["own"], r["below"]) for r in trees.content_counts(labels, content, "element", bucket=7).collect()}
    assert got == {i: (sum(e == i for e, _ in held), sum(inside(e, i) for e, _ in held)) for i in want}
    under = trees.content_under(labels, content, "element", spark.createDataFrame([(0,), (5,), (40,), (5000,)], "id long"), size=8)
    assert rows(under, "root", "element", "k") == sorted(((i, e, k) for i in (0, 5, 40) for e, k in held if inside(e, i)), key=str)
    moves = [(a, b) for a in (0, 3, 60) for b in (None, a, *range(0, 120, 11))]
    judged = trees.refused_moves(labels, spark.createDataFrame(moves, "id long, parent long"))
    assert rows(judged, "id", "parent", "refused") == sorted(((a, b, b is not None and inside(b, a)) for a, b in moves), key=str)


def test_a_tree_that_is_too_deep_raises(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(12)], "id long, parent long, ord long")
    assert trees.tree_paths(chain, 12).count() == 12
    with pytest.raises(ValueError):
        trees.tree_paths(chain, 5)
    assert trees.interval_labels(chain.limit(0)).collect() == []


def edited_brute(base, edits):
    out = []
    for by in {b for b, _, _ in base} | {e[0] for e in edits}:
        ids = [i for b, i, _ in sorted(base, key=lambda r: r[2]) if b == by]
        spots = [(i, True) for i in ids]  # what moved or went leaves its spot behind
        at = lambda x: next((n for n, s in enumerate(spots) if s == (x, True)), None)  # noqa: B023, E731
        for _, _, op, i, anchor in sorted((e for e in edits if e[0] == by), key=lambda e: e[1]):
            own, behind = at(i), at(anchor)
            if op == "remove" and own is not None:
                spots[own] = (i, False)
            elif op == "insert" and own is None and behind is not None:
                spots.insert(behind + 1, (i, True))
            elif op == "move" and own is not None and behind is not None and i != anchor:
                spots[own] = (i, False)
                spots.insert(behind + 1, (i, True))
        out += [(by, i, n) for n, i in enumerate(i for i, there in spots if there)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_edits_equal_a_list_that_is_edited(spark, seed):
    rng = random.Random(seed)
    base = [(b, i, i * 10) for b in (1, 2) for i in range(6)]
    edits = [(b, n, rng.choice(["insert", "insert", "move", "remove"]), rng.randint(0, 14), rng.choice([None, *range(15)])) for b in (1, 2, 3) for n in range(1, 40)]
    found = trees.edited_order(spark.createDataFrame(base, "doc long, id long, place long"), spark.createDataFrame(edits, "doc long, seq long, op string, id long, anchor long"), "doc")
    got, n = [], {}
    for r in sorted(found.collect(), key=lambda r: (r["doc"], list(r["key"]))):
        n[r["doc"]] = n.get(r["doc"], -1) + 1
        got.append((r["doc"], r["id"], n[r["doc"]]))
    assert sorted(got, key=str) == edited_brute(base, edits)


def test_edits_are_read_once_however_they_depend_on_each_other(spark):
    base = spark.createDataFrame([(1, 1, 0), (None, 1, 5)], "doc long, id long, place long")
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda i: read.add(1) or i, "long").asNondeterministic()
    edits = [(doc, n, "insert", n + 10, n + 9 if n > 1 else 1) for doc in (1, None) for n in range(1, 9)]
    # Inserts without effect don't make a chain, whether their anchor is missing or they are there.
    edits += [(1, n, "insert", 50 if n % 2 else 12, 99 if n % 2 else 1) for n in range(9, 49)] + [(1, 49, "insert", 60, 12), (1, 50, "insert", 61, 50), (1, 51, "remove", 60, None), (1, 52, "move", 60, 1)]
    found = trees.edited_order(base, spark.createDataFrame(edits, "doc long, seq long, op string, id long, anchor long").withColumn("id", counted("id")), "doc", 12)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["key"]):
        got.setdefault(r["doc"], []).append(r["id"])
    assert got == {1: [1, *range(11, 19)], None: [1, *range(11, 19)]}
    assert read.value == len(edits)


def test_a_node_is_written_until_it_is_reached(spark, monkeypatch):
    kept, real = [], trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: kept.append(real(df, name)) or kept[-1])
    nodes = spark.createDataFrame([(i, i - 1 if i % 5 else None, i) for i in range(20)] + [(30, 31, 0), (31, 30, 0)], "id long, parent long, ord long")
    assert sorted((r["id"], r["depth"], r["lineage"][0]) for r in trees.tree_paths(nodes).collect()) == [(i, i % 5, i - i % 5) for i in range(20)]
    assert [k.count() for k in kept] == [4, 18, 14, 10, 6, 2]


def test_sets_flow_through_a_diamond_and_a_cycle(spark):
    own = spark.createDataFrame([("d", 5), ("d", 40_000), ("e", 7), ("x", 1), ("y", 2)], "node string, value long")
    parts = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("x", "y"), ("y", "x"), ("z", "nothing")], "node string, part string")
    want = {"a": {5, 40_000, 7}, "b": {5, 40_000}, "c": {5, 40_000, 7}, "d": {5, 40_000}, "e": {7}, "x": {1, 2}, "y": {1, 2}}
    got = {}
    for r in trees.set_values(trees.flowing_sets(own, parts)).collect():
        got.setdefault(r["node"], set()).add(r["value"])
    assert got == want


def test_a_set_is_as_long_as_its_numbers(spark):
    # A bitmap of 32,768 numbers a node took 4 kB, whatever it held.
    values = [0, 1, 62, 63, 64, -1, -64, -65, 2**40, 2**63 - 1, -(2**63)]
    own = spark.createDataFrame([("a", v) for v in values] + [("c", None)], "node string, value long")
    sets = trees.flowing_sets(own, spark.createDataFrame([("b", "a"), ("b", "c"), ("b", None)], "node string, part string"))
    assert {t for _, t in sets.dtypes} <= {"string", "bigint"}
    assert rows(trees.set_values(sets), "node", "value") == sorted(((n, v) for n in "ab" for v in values), key=str)


def test_as_of_ranges(spark):
    rng = random.Random(9)
    left = [(i, rng.choice([None, 50, 50, 50, rng.randint(0, 100)])) for i in range(500)]
    ranges = [(s, f"r{s}") for s in (10, 11, 50, 97)] + [(50, "r0"), (None, "never")]
    df, at = spark.createDataFrame(left, "id long, at long").repartition(5), spark.createDataFrame(ranges, "start long, label string")
    got = rows(records.as_of_ranges(df, "at", at, "start"), "id", "at", "start", "label")
    best = lambda x: max(((s, r) for s, r in ranges if s is not None and x is not None and s <= x), default=(None, None))
    assert got == sorted(((i, x, *best(x)) for i, x in left), key=str)
    assert records.as_of_ranges(df.limit(0), "at", at, "start").collect() == []
    assert all(r["label"] is None for r in records.as_of_ranges(df, "at", at.limit(0), "start").collect())


def captions_brute(figures, captions, most_gap, least_overlap):
    pairs = []
    for p, f, x0, x1, y0, y1 in figures:
        for q, c, a0, a1, b0, b1 in captions:
            shared = min(x1, a1) - max(x0, a0)
            if p == q and shared > 0 and shared >= least_overlap * min(x1 - x0, a1 - a0):
                pairs += [(g, f, c, p, side) for g, side in ((y0 - b1, "above"), (b0 - y1, "below")) if 0 <= g <= most_gap]
    out, used = [], set()
    for g, f, c, p, side in sorted(pairs):
        if ("f", p, f) not in used and ("c", p, c) not in used:
            used |= {("f", p, f), ("c", p, c)}
            out.append((p, f, c, side, g))
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [40, 400])
def test_captions_by_all_pairs(spark, spread):
    rng = random.Random(spread)
    box = lambda p, i, w, h: (p, i, x := float(rng.randint(-50, spread)), x + w, y := float(rng.randint(-50, spread)), y + h)
    figures = [box(rng.randint(1, 2), i, rng.choice([20.0, 250.0]), 15.0) for i in range(60)]
    captions = [box(rng.randint(1, 2), i, 40.0, 5.0) for i in range(60)]
    schema = "page long, {} long, x0 double, x1 double, y0 double, y1 double"
    found = layout.attach_captions(spark.createDataFrame(figures, schema.format("figure")), spark.createDataFrame(captions, schema.format("caption")), 12.0, cell=30.0)
    assert rows(found, "page", "figure", "caption", "side", "gap") == captions_brute(figures, captions, 12.0, 0.3)


def test_captions_that_tie_need_no_rounds(spark):
    # Each tie took a round of its own, with jobs and a plan that grew with the rounds.
    figures = spark.range(600).selectExpr("0L AS page", "id AS figure", "0D AS x0", "50D AS x1", "0D AS y0", "30D AS y1")
    captions = spark.range(500).selectExpr("0L AS page", "id AS caption", "0D AS x0", "50D AS x1", "CASE WHEN id % 2 = 0 THEN 32D ELSE -12D END AS y0", "CASE WHEN id % 2 = 0 THEN 42D ELSE -2D END AS y1")
    found = layout.attach_captions(figures, captions, 40.0)
    assert rows(found, "figure", "caption", "side", "gap") == sorted(((i, i, ("below", "above")[i % 2], 2.0) for i in range(500)), key=str)
    odd = captions.selectExpr("IF(caption = 1, NULL, page) AS page", "caption", "IF(caption = 2, NULL, x0) AS x0", "x1", "IF(caption = 3, double('NaN'), y0) AS y0", "IF(caption = 3, double('NaN'), y1) AS y1").where("caption < 6")
    assert rows(layout.attach_captions(figures, odd, 40.0), "figure", "caption") == [(0, 0), (1, 4), (2, 5)]
    assert layout.attach_captions(figures, captions.limit(0), 40.0).count() == 0


def test_objects_merge_with_their_references(spark):
    own = [(1, "leaf", True), (2, "leaf", True), (3, "mid", True), (4, "mid", True), (5, "top", True), (6, "top", True), (7, "leaf", False), (8, None, True), (9, None, True), (10, "ring", True), (11, "ring", True), (12, "mid", True)]
    refs = [(3, 0, 1), (4, 0, 2), (5, 0, 3), (6, 0, 4), (10, 0, 11), (11, 0, 10), (12, 1, 1), (5, 1, 99), (6, 1, 99)]
    o, r = spark.createDataFrame(own, "id long, content string, mergeable boolean"), spark.createDataFrame(refs, "id long, place long, target long")
    got = {x["id"]: (x["representative"], x["merged_in"]) for x in objects.merge_identical(o, r).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (3, 0), 4: (3, 2), 5: (5, 0), 6: (5, 3), 7: (7, 0), 8: (8, 0), 9: (8, 1), 10: (10, 0), 11: (11, 0), 12: (12, 0)}
    two = {x["id"]: x["representative"] for x in objects.merge_identical(o, r, most_passes=2).collect()}
    assert two[4] == 3 and two[6] == 6
    assert objects.merge_identical(o.limit(0), r.limit(0)).collect() == []


def test_references_are_read_once_for_all_passes(spark):
    own = spark.range(6).selectExpr("id", "'x' AS content", "true AS mergeable")
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda i: read.add(1) or i - 2, "long").asNondeterministic()
    refs = spark.range(2, 6).select("id", F.lit(0).alias("place"), counted("id").alias("target"))
    got = {r["id"]: (r["representative"], r["merged_in"]) for r in objects.merge_identical(own, refs).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 0), 3: (2, 2), 4: (4, 0), 5: (4, 3)}
    assert read.value == 4


def test_labels_and_outlines_of_an_assembly(spark):
    picked = spark.createDataFrame([(0, "a", 3), (1, "a", 4), (2, "a", 5), (3, "b", 0), (4, "a", 4), (5, "a", 5), (6, "b", 1)], "place long, source string, page long")
    ranges = spark.createDataFrame([("a", 0, "r", 1), ("a", 4, "D", 1)], "source string, start long, style string, first long")
    assert rows(assembly.assemble_labels(picked, ranges), "start", "style", "first") == sorted([(0, "r", 4), (1, "D", 1), (3, None, 1), (4, "D", 1), (6, None, 2)], key=str)
    outlines = spark.createDataFrame([("a", 1, None, 0, 9), ("a", 2, 1, 0, 3), ("a", 3, 2, 0, 8), ("a", 4, 3, 1, 5), ("b", 5, None, 0, 1), ("c", 6, None, 0, 0)], "source string, id long, parent long, ord long, page long")
    got = rows(assembly.splice_outlines(outlines, picked), "id", "parent", "depth", "target")
    assert got == sorted([(2, None, 0, 0), (4, 2, 1, 2), (5, None, 0, 6)], key=str)


def test_outlines_are_read_once_for_all_levels(spark):
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda i: read.add(1) or i, "long").asNondeterministic()
    outlines = [("a", i, i - 1 if i % 4 else None, i % 4, i) for i in range(12)] + [("a", 20, 21, 0, 1), ("a", 21, 20, 0, 1), (None, 30, None, 0, 1), ("b", 31, 8, 5, 7)]
    picked = spark.createDataFrame([(4, "a", 1), (2, "a", 3), (9, "a", 3), (5, "a", 6), (1, "b", 7), (0, None, 1)], "place long, source string, page long")
    df = spark.createDataFrame(outlines, "source string, id long, parent long, ord long, page long").withColumn("ord", counted("ord"))
    got = rows(assembly.splice_outlines(df, picked), "id", "parent", "depth", "ord", "target")
    assert got == sorted([(1, None, 0, [2, 0, 1], 4), (3, 1, 1, [2, 0, 1, 2, 3], 2), (6, None, 0, [2, 0, 1, 2], 5), (31, None, 0, [1, 0, 5], 1)], key=str)
    assert read.value == len(outlines)


def test_associated_files_against_a_walk(spark):
    rng = random.Random(11)
    owners = []
    for doc in (1, 2, None):
        owners += [(doc, "Document", None, 0, [rng.randrange(9) for _ in range(2)])]
        owners += [(doc, kind, page, at, [rng.choice([None, *range(9, 60)]) for _ in range(rng.randrange(3))]) for page in range(6) for kind in ("XObject", "Annotation", "Page") for at in range(3)]
        owners += [(doc, "StructureElement", None, at, [rng.randrange(80)]) for at in range(40)]
    owners += [(1, "Font", 0, 0, [70]), (1, "Page", 3, 9, None), (1, "Page", 3, 10, [])]
    specs = [(doc, n, None if n % 3 else f"r{n}", None if n % 4 else f"n{n}", None if n % 5 else f"c{n}") for doc in (1, 2) for n in range(75)]
    rank = {k: i for i, k in enumerate(objects.FILE_OWNERS)}
    walked, seen, known = [], set(), {s[:2]: s[2:] for s in specs}
    for doc, kind, page, _, files in sorted((o for o in owners if o[1] in rank), key=lambda o: (str(o[0]), {"Document": 0, "StructureElement": 2}.get(o[1], 1), o[2] or 0, rank[o[1]], o[3])):
        for f in files or []:
            if (doc, f) in known and (doc, f) not in seen:
                seen.add((doc, f))
                relationship, name, content = known[doc, f]
                walked.append((doc, f, kind, page, relationship or "Unspecified", name or "", content))
    told = spark.createDataFrame(owners, "doc long, kind string, page long, position long, files array<long>")
    specs = spark.createDataFrame(specs, "doc long, spec long, relationship string, name string, content string")
    got = objects.associated_files(told.repartition(5), specs, "doc", "spec")
    assert got.columns == ["doc", "spec", "kind", "page", "relationship", "name", "content"]
    assert rows(got, *got.columns) == sorted(walked, key=str) and {w[2] for w in walked} == set(rank)
    assert objects.associated_files(told.limit(0), specs, "doc", "spec").count() == 0


def test_owners_of_files_combine_without_sorting(spark):
    owners = spark.createDataFrame([(1, "Page", None, 5, [7]), (1, "XObject", -3, 0, [7, 8]), (1, "Annotation", -3, 9, [8]), (1, "StructureElement", 0, 0, [9]), (1, "Page", 2, 0, [9])], "doc long, kind string, page long, position long, files array<long>")
    specs = spark.createDataFrame([(1, n, None, None, None) for n in (7, 8, 9)], "doc long, spec long, relationship string, name string, content string")
    got = objects.associated_files(owners, specs, "doc", "spec")
    assert rows(got, "spec", "kind", "page") == [(7, "Page", None), (8, "Annotation", -3), (9, "Page", 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
