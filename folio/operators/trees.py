"""Trees of records: depth-first intervals instead of recursion, content under elements, edits of an order, sets along a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import removed, written
from .relational import numbered


def followed(level: DataFrame, rest: DataFrame, links: dict[str, str], grown: dict[str, Column], most_depth: int, depth: str) -> DataFrame:
    """``level`` and the rows of ``rest`` that it leads to, level by level, with the columns of ``level``.

    ``links`` names columns of ``rest`` and what they equal in the row above. ``grown`` gives what a row has from the row
    above, whose columns have a ``_`` before their names. A level is joined with the rows that none before it led to, so a
    row is written until it is reached and no longer; what is never reached is left out.
    """
    levels = [level]
    while True:
        above = level.select(F.lit(True).alias("_met"), *[F.col(c).alias(f"_{c}") for c in level.columns])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{a}")) for c, a in links.items()])
        met = written(rest.join(above, same, "left").select(*rest.columns, "_met", *[c.alias(n) for n, c in grown.items()]), "tree-level")
        level, rest = met.where("_met").select(*level.columns), met.where("_met is null").select(*rest.columns)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        if len(levels) >= most_depth:
            raise ValueError(depth)
        levels.append(level)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def tree_paths(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """id, depth, path and lineage of the nodes (id, parent, ord) that a root (without parent) leads to.

    ``path`` holds (ord, id) from the root down, so it sorts depth first, and ``lineage`` the ids from the root to the node
    itself. One join a level, of the level found last with the nodes that are left; deeper trees than ``most_depth`` raise,
    and nodes of a cycle, which no root leads to, are left out.
    """
    step = F.array(F.struct("ord", "id"))
    roots = written(nodes.where("parent is null").select("id", F.lit(0).alias("depth"), step.alias("path")), "tree-level")
    rest = nodes.where("parent is not null").select("id", "parent", "ord")
    found = followed(roots, rest, {"parent": "id"}, {"depth": F.col("_depth") + 1, "path": F.concat("_path", step)}, most_depth, f"the tree is deeper than {most_depth} levels")
    return found.withColumn("lineage", F.transform("path", lambda s: s["id"]))


def interval_labels(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """id, depth, first and last: a node's place in depth-first order (from 0), and that of the last node below it.

    A node lies below another exactly if its first is within the other's first and last, so a subtree is a range. The
    order is numbered by ranges of rows; the last places are maxima over lineages, which combine before they are shuffled.
    """
    placed = numbered(tree_paths(nodes, most_depth), ["path"], "first")
    last = placed.select("first", F.explode("lineage").alias("id")).groupBy("id").agg(F.max("first").alias("last"))
    return placed.select("id", "depth", "first").join(last, "id")


def content_counts(labels: DataFrame, content: DataFrame, element: str, bucket: int = 1 << 16) -> DataFrame:
    """``labels`` with own and below: how many rows of ``content`` each element holds itself, and with all below it.

    Content is counted by element once. Running sums over the depth-first order, in buckets of places that go on from a
    sum for each bucket before, turn each subtree's count into the difference of two of them.
    """
    counted = content.groupBy(F.col(element).alias("id")).agg(F.count(F.lit(1)).alias("own"))
    held = written(labels.join(counted, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("_bucket", F.expr(f"first div {bucket}")), "content")
    sums = held.groupBy("_bucket").agg(F.sum("own").alias("_sum"))
    before = sums.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    upto = F.sum("own").over(Window.partitionBy("_bucket").orderBy("first")) + F.col("_before")
    running = held.join(before, "_bucket").withColumn("_upto", upto)
    ends = running.select(F.col("first").alias("last"), F.col("_upto").alias("_end"))
    out = running.join(ends, "last")
    return out.select(*labels.columns, "own", (F.col("_end") - F.col("_upto") + F.col("own")).alias("below"))


def content_under(labels: DataFrame, content: DataFrame, element: str, roots: DataFrame, size: int = 1 << 12) -> DataFrame:
    """A row for each root (id) and each row of ``content`` of an element below it or its own: root, and the content's columns.

    Places fall into cells of ``size``; a root meets whole cells within its range by the cell and the cells at its ends by
    the place, so a root of a large subtree is spread over cells.
    """
    placed = content.join(labels.select(F.col("id").alias("_id"), F.col("first").alias("_place")), F.col(element) == F.col("_id")).withColumn("_cell", F.expr(f"_place div {size}"))
    spans = labels.join(roots.select("id").distinct(), "id").select(F.col("id").alias("root"), "first", "last", F.explode(F.sequence(F.expr(f"first div {size}"), F.expr(f"last div {size}"))).alias("_cell"))
    inside = F.col("_place").between(F.col("first"), F.col("last"))
    return placed.join(spans, "_cell").where(inside).select("root", *content.columns)


def refused_moves(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (id, parent) with ``refused``: the new parent is the node itself or lies below it, so that a cycle would form.

    Each move is judged by itself on the tree as it stands; a null parent makes a node a root and is never refused.
    """
    own = labels.select("id", "first", "last")
    target = labels.select(F.col("id").alias("parent"), F.col("first").alias("_target"))
    judged = moves.join(own, "id").join(target, "parent", "left")
    return judged.select(*moves.columns, F.coalesce(F.col("_target").between(F.col("first"), F.col("last")), F.lit(False)).alias("refused"))


def edited_order(rows: DataFrame, edits: DataFrame, by: str, most_depth: int = 64) -> DataFrame:
    """by, id and key: the rows in the order that inserts, moves and removals leave, as keys that sort.

    ``rows`` has by, id and place; ``edits`` has by, seq, op, id and anchor, and holds one after another by seq (whole
    numbers from 1, distinct within ``by``). ``insert`` puts a new id after the anchor, ``move`` a present one, ``remove`` takes
    one away. A row that moves or goes leaves its spot behind, where others may have been anchored. Edits of ids or anchors
    that aren't there at their time do nothing, nor does a move after itself.

    A key is the anchor's own key with one part more, and later edits sort before earlier ones behind the same anchor. So
    an edit writes one key, no others change, and there is always room between neighbours. Parts follow anchors level by
    level: chains of rows each inserted behind the last are as deep as they are long, and raise beyond ``most_depth``.
    """
    kind, seq = F.col("kind"), F.col("seq")
    before = lambda c: F.max(c).over(Window.partitionBy(by, "item").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    code = F.when(F.col("op") == "insert", 1).when(F.col("op") == "move", 2).when(F.col("op") == "remove", 3)
    able = (kind == 3) | ((kind == 1) & ~F.col("id").eqNullSafe(F.col("anchor"))) | ((kind == 2) & (F.col("id") != F.col("anchor")))
    edits = edits.select(by, seq.cast("long").alias("seq"), code.cast("byte").alias("kind"), "id", "anchor").where(able)
    # An edit stands in the history of its id, and asks for its anchor in that one's.
    asks = F.explode(F.when(kind == 3, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("asks")
    item = F.when(F.col("asks"), F.col("anchor")).otherwise(F.col("id")).alias("item")
    own = lambda c: F.when(~F.col("asks"), F.col(c)).alias(c)
    base = rows.select(by, F.col("id").alias("item"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("asks"), F.lit(0).cast("byte").alias("kind"), F.col("place").cast("long").alias("place"))
    history = base.drop("place").unionByName(edits.select("*", asks).select(by, item, "seq", "asks", own("kind"), own("id"), own("anchor")), allowMissingColumns=True)
    # -1 if it is there for sure. Else the removal after which (0: none) an insert may have put it there, null if none may.
    removed_at, inserted_at = F.coalesce(before(F.when(kind == 3, seq)), F.lit(0)), before(F.when(kind == 1, seq))
    state = F.when(before(F.when(kind == 0, 1)).isNotNull() & (removed_at == 0), -1).when(~F.col("asks") | (inserted_at > removed_at), removed_at).cast("long")
    told = history.select("*", state.alias("state")).where("asks or kind > 0")
    own, asked = F.when(~F.col("asks"), F.col("state")), F.when(F.col("asks"), F.col("state"))
    told = written(told.groupBy(by, "seq").agg(*[F.max(c).alias(c) for c in ("kind", "id", "anchor")], F.max(own).alias("own"), F.max(asked).alias("asked")), "edits")
    # An item absent at a removal is there from the first insert behind a present anchor on, until the next removal. Inserts
    # whose anchor was itself inserted wait for it, and only these go through rounds.
    inserts = told.where("kind = 1 and own >= 0")
    fresh, waiting = inserts.where("asked = -1").select(by, "id", "own", "seq", "anchor"), inserts.where("asked >= 0").select(by, "id", "own", "seq", "anchor", "asked")
    founds, rounds = [fresh], []
    for _ in range(most_depth + 1):
        first = fresh.groupBy(F.col(by).alias("_by"), F.col("id").alias("_id"), F.col("own").alias("_own")).agg(F.min("seq").alias("_since"))
        same = F.col(by).eqNullSafe(F.col("_by")) & F.col("anchor").eqNullSafe(F.col("_id")) & (F.col("asked") == F.col("_own"))
        rounds.append(written(waiting.join(first, same, "left").select(*waiting.columns, F.coalesce(F.col("_since") < seq, F.lit(False)).alias("_met")), "waiting"))
        fresh, waiting = rounds[-1].where("_met").drop("_met", "asked"), rounds[-1].where("not _met").drop("_met")
        if fresh.isEmpty():
            break
        founds.append(fresh)
    else:
        raise ValueError(f"edits depend on each other over more than {most_depth} steps")
    since = written(reduce(DataFrame.unionByName, founds).groupBy(by, "id", "own").agg(F.min("seq").alias("seq"), F.min_by("anchor", "seq").alias("anchor")), "inserts")
    removed(*rounds)
    moves, there = told.where("kind = 2 and asked is not null"), (F.col("own") == -1) & (F.col("asked") == -1)
    unsure = moves.where(~there)
    for i, at, known in (("id", "own", "_own_since"), ("anchor", "asked", "_asked_since")):
        put = since.select(F.col(by).alias("_by"), F.col("id").alias("_id"), F.col("own").alias("_own"), F.col("seq").alias(known))
        same = F.col(by).eqNullSafe(F.col("_by")) & F.col(i).eqNullSafe(F.col("_id")) & (F.col(at) == F.col("_own"))
        unsure = unsure.join(put, same, "left").where((F.col(at) == -1) | (F.col(known) < seq)).drop("_by", "_id", "_own")
    names = [by, "seq", "kind", "id", "anchor"]
    done = reduce(DataFrame.unionByName, [since.withColumn("kind", F.lit(1).cast("byte")).select(*names), moves.where(there).select(*names), unsure.select(*names), told.where("kind = 3").select(*names)])
    # Which placement of its anchor a placement stands behind, and which of an item's is the last.
    history = base.unionByName(done.select("*", asks).select(by, item, "seq", "asks", "kind"), allowMissingColumns=True)
    version, last = before(F.when(~F.col("asks"), seq)).alias("version"), F.max(F.when(~F.col("asks"), seq)).over(Window.partitionBy(by, "item")).alias("last")
    spots = history.select(by, "item", "seq", "asks", "kind", F.when(F.col("asks"), before("place")).otherwise(F.col("place")).alias("place"), version, last)
    spots = written(spots.where("asks or (seq = last and kind < 3)").select(by, "item", "seq", "asks", "place", "version"), "spots")
    removed(told, since)
    nodes = spots.where("asks").select(by, "seq", "place", "version")
    level = nodes.where("version = 0").select(by, "seq", F.array("place", -seq).alias("key"))
    deep = f"edits stand behind each other over more than {most_depth} steps"
    keys = followed(level, nodes.where("version > 0").select(by, "seq", "version"), {by: by, "version": "seq"}, {"key": F.concat("_key", F.array(-seq))}, most_depth - 1, deep)
    still = spots.where("not asks and seq = 0").select(by, F.col("item").alias("id"), F.array("place").alias("key"))
    newest = spots.where("not asks and seq > 0").select(by, "seq", F.col("item").alias("id"))
    keys = keys.select(F.col(by).alias("_by"), F.col("seq").alias("_seq"), "key")
    return still.unionByName(newest.join(keys, F.col(by).eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq"))).select(by, "id", "key"))


def flowing_sets(own: DataFrame, parts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node, bucket and bits: the numbers (own: node, value) of each node and of all that its parts (node, part) lead to.

    Sets are words of 64 numbers, as many a node as its numbers need, so a row is never longer than a number and unions
    combine before the shuffle. Each round passes on only the words that the last one changed; shared parts are
    passed once, and cycles end when nothing changes. The parts are written once, for all rounds.
    """
    union, one = F.bit_or("bits").alias("bits"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("value").bitwiseAND(63)).cast("int"))
    numbers = own.where("value is not null").select("node", F.shiftright(F.col("value").cast("long"), 6).alias("bucket"), one.alias("bits"))
    sets = written(numbers.groupBy("node", "bucket").agg(union).withColumn("changed", F.lit(True)), "sets")
    parts = written(parts.select("node", "part"), "parts")
    for _ in range(most_rounds):
        fresh = sets.where("changed").select(F.col("node").alias("part"), "bucket", "bits")
        passed = parts.join(fresh, "part").select("node", "bucket", "bits", F.lit(0).cast("long").alias("_had"))
        both = sets.select("node", "bucket", "bits", F.col("bits").alias("_had")).unionByName(passed)
        merged = both.groupBy("node", "bucket").agg(union, F.bit_or("_had").alias("_had"))
        now = written(merged.select("node", "bucket", "bits", (F.col("bits") != F.col("_had")).alias("changed")), "sets")
        removed(sets)
        sets = now
        if not sets.where("changed").limit(1).count():
            removed(parts)
            return sets.drop("changed")
    raise ValueError(f"sets still change after {most_rounds} rounds")


def set_values(sets: DataFrame) -> DataFrame:
    """node and value: the numbers in the words."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return sets.select("node", "bucket", F.explode(bits).alias("bit")).select("node", (F.shiftleft("bucket", 6) + F.col("bit")).alias("value"))
