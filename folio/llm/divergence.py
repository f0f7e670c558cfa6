"""How far the sources of a language differ: exact sums over terms by a heavy-light split.

Terms that many sources of a language share are heavy: they are laid out as dense tiles of numpy, sources by terms. All
others are light: a sum starts from what two sources' shares of unseen terms differ by, and sparse postings correct
it, first a source's own terms against the other's share of unseen ones, then the terms that both have. Heavy and light
partial sums are integers and are added exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Bytes of UTF-8 that terms consist of stay, A to Z become small, all others separate terms.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: A task hands on its counts when it holds so many terms, and in batches of so many.
MOST_HELD, BATCH = 400_000, 50_000
SCALE, SMOOTH = 1_000_000_000, 5
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def _counted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        words = [b"", *counts]  # the empty term says that the group occurs
        for i in range(0, len(words), BATCH):
            part = words[i : i + BATCH]
            columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64()), pa.array([docs[w] for w in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            counts, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            words = text.as_py().translate(TERM_BYTES).split()
            counts.update(words)
            docs.update(set(words))
        if sum(len(c) for c, _ in held.values()) > MOST_HELD:
            yield from _counted(held)
            held = {}
    yield from _counted(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences) and docs (documents with it); a row with an empty term for each lang and source.

    Null lang, source and text are empty strings. Tasks count first, so what is shuffled grows with distinct terms.
    """
    given = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    tallied = given.mapInArrow(_tally, "lang string, source string, term string, count long, docs long")
    return tallied.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)) in decimals, which hold counts of any corpus; null without terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", top, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1)


def _sums(tile: int):
    """The function that adds up, for one chunk of terms and two blocks of sources, what terms add for each pair of sources."""

    def sums(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lang, _, a, b = key
        head = frame[frame["slot"] < 0].sort_values("group")
        group, unseen = head["group"].to_numpy(), head["p"].to_numpy()
        n, terms = len(head), int(head["count"].iloc[0]) if len(head) else 0
        apart = np.abs(unseen[:, None] - unseen[None, :])
        out = terms * apart
        seen = frame[frame["slot"] >= 0]
        at, slot, p, heavy = np.searchsorted(group, seen["group"].to_numpy()), seen["slot"].to_numpy(), seen["p"].to_numpy(), seen["count"].to_numpy() > 0
        columns, place = np.unique(slot[heavy], return_inverse=True)
        if len(columns):  # dense: a row of shares for each source, that of unseen terms where it has none
            dense = np.repeat(unseen[:, None], len(columns), axis=1)
            dense[at[heavy], place] = p[heavy]
            for i in range(n - 1):
                out[i, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(axis=1) - len(columns) * apart[i, i + 1 :]
        at, slot, p = at[~heavy], slot[~heavy], p[~heavy]
        own = np.zeros((n, n), np.int64)
        order = np.lexsort((p, at))
        for i, rows in enumerate(np.split(order, np.searchsorted(at[order], np.arange(1, n)))):
            if len(rows):  # a source's light terms against what others have for unseen ones
                ps = p[rows]
                upto = np.concatenate([[0], np.cumsum(ps)])
                below = np.searchsorted(ps, unseen)
                own[i] = unseen * below - upto[below] + (upto[-1] - upto[below]) - unseen * (len(ps) - below) - len(ps) * apart[i]
        out += own + own.T
        order = np.lexsort((at, slot))
        at, slot, p = at[order], slot[order], p[order]
        for d in range(1, int(np.unique(slot, return_counts=True)[1].max(initial=0))):  # light terms that both have
            x = np.flatnonzero(slot[:-d] == slot[d:])
            y = x + d
            i, j = at[x], at[y]
            np.add.at(out, (i, j), np.abs(p[x] - p[y]) - np.abs(p[x] - unseen[j]) - np.abs(p[y] - unseen[i]) + apart[i, j])
        i, j = np.triu_indices(n, 1)
        if a != b:
            across = (group[i] // tile == a) & (group[j] // tile == b)
            i, j = i[across], j[across]
        return pd.DataFrame({"lang": lang, "group": group[i], "other": group[j], "part": out[i, j]})

    return sums


def audit_sources(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, light_share: int = 16, most_light: int = 256, tile: int = 128, chunk: int = 4096) -> DataFrame:
    """lang, source, part, item, value and rank: how far each other source is, and the terms that stand out in a source.

    A language keeps terms that ``least_docs`` of its documents have. Part ``pair`` has each other source of the
    language with the sum over all kept terms of how far the two shares lie apart (0 without kept terms); part ``term``
    has up to ``most_terms`` terms whose share in the source is above that in the language. A term is light if at
    most one in ``light_share`` of the language's sources have it (two may always), and never more than ``most_light``;
    so sparse pairs of one term are bounded. A task sums about ``chunk`` terms of two blocks of ``tile`` sources.

    Null lang, source and text count as empty strings; repeated rows count as often as they stand there, whatever their
    ids. Ties rank by item in order of UTF-8. A source without terms has only pairs, a language with one source no
    pairs, and an empty table gives no rows. Other columns of ``docs`` play no part.
    """
    counts = materialize(term_counts(docs), "terms")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("sources")).where(F.col("docs") >= least_docs)
    langs = counts.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    langs = langs.join(sizes, "lang", "left").select("lang", "n_groups", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    langs = langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk)))
    langs = materialize(langs, "languages")
    kept = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    heavy = F.col("sources") > F.least(F.lit(most_light), F.greatest(F.lit(2), F.floor(F.col("n_groups") / light_share)))
    kept = kept.select("lang", "term", "chunk", heavy.alias("heavy"), _share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q"), F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")).alias("slot"))
    postings = materialize(counts.where("term <> ''").join(kept, ["lang", "term"]), "postings")
    groups = counts.where("term = ''").select("lang", "source").join(postings.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = groups.withColumn("group", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialize(groups.select("lang", "source", "group", "n_groups", "terms", "chunks", "total", _share(F.lit(0), F.col("total"), F.col("terms")).alias("unseen")), "groups")
    release(counts)

    seen = postings.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("total"), F.col("terms")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_groups") - 1) / tile)))
    own = F.floor(F.col("group") / tile)
    # A chunk's terms, and a first row for each source with what it has for unseen terms; the first chunk counts all terms.
    first = groups.where("terms > 0").select("lang", "group", "n_groups", F.lit(-1).alias("slot"), F.col("unseen").alias("p"), "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"))
    first = first.withColumn("count", F.when(F.col("chunk") == 0, F.col("terms")).otherwise(0)).drop("terms")
    rows = seen.select("lang", "group", "n_groups", "slot", "p", F.col("chunk").cast("long").alias("chunk"), F.col("heavy").cast("long").alias("count")).unionByName(first)
    dealt = rows.withColumn("block", blocks).select("lang", "chunk", F.least(own, "block").alias("a"), F.greatest(own, "block").alias("b"), F.col("group").cast("long").alias("group"), F.col("slot").cast("long").alias("slot"), "p", "count")
    added = dealt.groupBy("lang", "chunk", "a", "b").applyInPandas(_sums(tile), "lang string, group long, other long, part long").groupBy("lang", "group", "other").agg(F.sum("part").alias("value"))
    added = materialize(added, "divergence")
    names = groups.select("lang", "source", F.col("group").cast("long").alias("group"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("group").cast("long").alias("other"))
    both = added.unionByName(added.select("lang", F.col("other").alias("group"), F.col("group").alias("other"), "value"))
    pairs = both.join(names, ["lang", "group"]).join(others, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    # Where a language keeps no term, all its sources are alike.
    bare = groups.where("terms = 0").select("lang", "source")
    pairs = pairs.unionByName(bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = seen.where("count > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= most_terms))
