"""Exact components of documents whose word-shingle sets have a Jaccard similarity of at least a threshold.

Shingles travel packed: a batch of documents sends each hash bucket one row of fingerprints, the bucket answers with
those that at least two documents have, and the batch puts its documents together again. Shingles of one document
alone can't match, but hold the first places of a document's rare-first order: a document of which more than the
prefix is such has nothing to join with.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, split_words
from .graph import components

WIDTH = 5
#: The similarity as a fraction, in whole numbers: links need DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Shingles of a batch, documents of a batch.
BATCH_GRAMS, BATCH_DOCS = 400_000, 60_000
#: Characters of text for each bucket: about a million shingles.
BUCKET_CHARS = 8_000_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: The document number of a shingle that several documents of a batch have, which travels once, with their number.
MANY = 0xFFFF
PACKED = "part long, batch long, kind int, a binary, b binary, c binary, d binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
DOCUMENTS = "node long, doc_id long, text_key long, n long, digest binary, alone long, take int, low long, high long, grams array<long>"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of all words if there are fewer; empty without words."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= BASE
        out += h[i : i + n]
    # A short text's sequence is no shingle of another length's.
    out += np.uint64(k)
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Sets of this size that reach the threshold share one of so many of their rarest members."""
    return n - -(-num * n // den) + 1


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], NAMES)


def _pack(buckets: int, width: int):
    """Documents to packed rows: kind 0 for a bucket, kinds 1 (documents) and 2 (shingles of several of its documents) for the batch itself.

    A shingle goes to its bucket once for each batch, so one that all documents have is as many rows there as batches.
    """

    def flush(batch: int, ids: list, keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
        nulls = np.array([i is None for i in ids])
        out = [(-1 - batch, batch, 1, np.array([[i or 0 for i in ids], keys], np.int64).tobytes(), nulls.tobytes(), sizes.tobytes(), digests)]
        if sizes.sum():
            grams, docs = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(grams, kind="stable")
            grams, docs = grams[order], docs[order]
            first = np.append(True, grams[1:] != grams[:-1])
            start = np.flatnonzero(first)
            count = np.diff(np.append(start, len(grams)))
            weight = np.repeat(count, count)
            common = weight > 1
            if common.any():
                out.append((-1 - batch, batch, 2, grams[common].tobytes(), docs[common].tobytes(), b"", b""))
                grams, weight, docs = grams[first], weight[first], np.where(common, MANY, docs)[first].astype(np.uint16)
            bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(grams)], strict=True):
                g, d = grams[a:b], docs[a:b]
                out.append((int(bucket[a]), batch, 0, _planes(g), b"", d.tobytes(), weight[a:b][d == MANY].astype(np.uint32).tobytes()))
        return _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, ids, keys, sets, grams = TaskContext.get().partitionId() << 20, [], [], [], 0
        for rows in batches:
            for doc_id, key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                found = shingles(text.as_py(), width)
                ids.append(doc_id)
                keys.append(key)
                sets.append(found)
                grams += len(found)
                if grams >= BATCH_GRAMS or len(ids) >= BATCH_DOCS:
                    yield flush(batch, ids, keys, sets)
                    batch, ids, keys, sets, grams = batch + 1, [], [], [], 0
        if ids:
            yield flush(batch, ids, keys, sets)

    return run


def _planes(grams: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, all their highest bytes first: runs of equal bytes, which a shuffle's compression takes well."""
    return grams.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _count(rows: pa.Table) -> pa.Table:
    """A bucket's shingles that at least two documents have, with their number, by batch; other kinds pass."""
    held = rows.to_pylist()
    if held[0]["kind"]:
        return rows
    part = held[0]["part"]
    grams = np.concatenate([_from_planes(r["a"]) for r in held])
    docs = np.concatenate([np.frombuffer(r["c"], np.uint16) for r in held])
    sizes = [len(r["c"]) // 2 for r in held]
    weight = np.ones(len(grams), np.int64)
    weight[docs == MANY] = np.concatenate([np.frombuffer(r["d"], np.uint32) for r in held])
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    total = np.add.reduceat(weight[order], start)
    df = np.empty(len(grams), np.uint32)
    df[order] = np.repeat(np.minimum(total, 2**32 - 1), np.diff(np.append(start, len(grams)))).astype(np.uint32)
    out, at = [], 0
    for r, n in zip(held, sizes, strict=True):
        keep = df[at : at + n] >= 2
        if keep.any():
            out.append((part, r["batch"], 0, grams[at : at + n][keep].tobytes(), b"", docs[at : at + n][keep].tobytes(), df[at : at + n][keep].tobytes()))
        at += n
    return pa.Table.from_batches([_rows(out)])


def _assemble(num: int, den: int):
    """A batch's documents with their shared shingles, rarest first."""

    def run(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        meta = next(r for r in held if r["kind"] == 1)
        (ids, keys), nulls, sizes = np.frombuffer(meta["a"], np.int64).reshape(2, -1), np.frombuffer(meta["b"], np.bool_), np.frombuffer(meta["c"], np.int64)
        cat = lambda kind, name, dtype: np.concatenate([np.empty(0, dtype), *[np.frombuffer(r[name], dtype) for r in held if r["kind"] == kind]])
        grams, docs, df = cat(0, "a", np.uint64), cat(0, "c", np.uint16), cat(0, "d", np.uint32)
        many = docs == MANY
        if many.any():
            known, counts = grams[many], df[many]
            order = np.argsort(known)
            own, own_docs = cat(2, "a", np.uint64), cat(2, "b", np.uint16)
            grams, docs, df = (np.concatenate([x[~many], y]) for x, y in ((grams, own), (docs, own_docs), (df, counts[order][np.searchsorted(known[order], own)])))
        order = np.lexsort((grams, df, docs))
        grams, docs = grams[order].view(np.int64), docs[order]
        shared = np.bincount(docs, minlength=len(ids))
        alone = sizes - shared
        take = np.array([prefix_length(n, num, den) if n else 0 for n in sizes.tolist()], np.int64) - alone
        take = np.clip(take, 0, shared)
        ends = np.cumsum(shared)
        lists, sigs = [], []
        for n, (end, size, t) in enumerate(zip(ends.tolist(), shared.tolist(), take.tolist(), strict=True)):
            g = grams[end - size : end] if t else grams[:0]
            lists.append(g)
            sigs.append(_signature(g))
        nodes = (meta["batch"] << 16) + np.arange(len(ids))
        digests = [meta["d"][16 * i : 16 * i + 16] for i in range(len(ids))]
        made = [pa.array(nodes), pa.array(ids, mask=nulls), pa.array(keys), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(alone), pa.array(take, pa.int32()), *(pa.array([x[i] for x in sigs], pa.int64()) for i in (0, 1)), pa.array(lists, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(made, [x.split()[0] for x in DOCUMENTS.replace("array<long>", "a").split(", ")])

    return run


def _signature(grams: np.ndarray) -> tuple[int, int]:
    """For each of 128 parts of all shingles whether an odd number of these falls into it, as the bits of two words.

    Every member of two sets' symmetric difference turns one bit, so the bits that differ are at most as many as it has.
    """
    odd = np.bincount(grams & 127, minlength=128) & 1
    low, high = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()
    return low, high


def shared_shingles(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row for each document: node, doc_id, text_key (xxhash64 of the text), n (set size), digest of the set, how many of its shingles it has alone,
    how many of the others belong to its prefix (``take``), and these others, rarest first, if ``take`` isn't 0."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(chars / BUCKET_CHARS))
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_pack(buckets, width), PACKED)
    counted = packed.groupBy("part").applyInArrow(_count, PACKED)
    return materialize(counted.groupBy("batch").applyInArrow(_assemble(num, den), DOCUMENTS), "shingles")


def _enough(overlap: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """den * overlap >= num * (a + b - overlap)."""
    return overlap * (den + num) >= (a + b) * num


def _could_match(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and suffix filters for two postings of one shingle, as prefixes of column names.

    The suffix filter bounds the symmetric difference of what both sets share with any others from below.
    """
    c = lambda side, name: F.col(f"{side}_{name}")
    length = (F.least(c(a, "n"), c(b, "n")) * den >= F.greatest(c(a, "n"), c(b, "n")) * num) & (c(a, "node") != c(b, "node"))
    # At the first shingle that two sets share, only what follows it on both sides can be shared besides.
    position = F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos"))
    apart = sum((F.bit_count(c(a, w).bitwiseXOR(c(b, w))) for w in ("low", "high")), F.lit(0))
    shared = c(a, "n") - c(a, "alone") + c(b, "n") - c(b, "alone") - apart
    return length & _enough(position, c(a, "n"), c(b, "n"), num, den) & _enough(shared / 2, c(a, "n"), c(b, "n"), num, den)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those that reach the threshold. Shingles that only one of all documents has can't be shared."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("grams").alias(f"{s}_grams"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_enough(F.size(F.array_intersect("a_grams", "b_grams")), F.col("a_n"), F.col("b_n"), num, den)).select("a", "b")


def _band(n: Column, num: int, den: int) -> Column:
    """Sizes that differ by no more than the threshold allows are in the same band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / (math.log(den / num) * (1 + 1e-6) if den > num else 1e-6))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def similar_sets(sets: DataFrame, num: int = NUM, den: int = DEN, rounds: int = 6, leaders: int = 4) -> DataFrame:
    """node and component of the sets that a chain of links joins to another; ``sets`` has distinct sets.

    Rounds of stars come first: within the documents of a prefix shingle only a few leaders meet the others that
    are not yet in their component, so a group of near copies costs rows in proportion to its size. When a round
    finds nothing more, or after ``rounds``, all pairs of different components that share a prefix shingle
    are compared within bands of sizes, but for pairs within the largest component of a shingle, which are joined
    already. That last pass makes the result exact whatever the rounds found.
    """
    sets = sets.where("take > 0")
    postings = materialize(
        sets.select("node", "n", "alone", "low", "high", F.posexplode(F.slice("grams", 1, F.col("take"))).alias("i", "gram")).select("gram", "node", "n", "alone", "low", "high", (F.col("alone") + F.col("i")).alias("pos")),
        "postings",
    )
    fields = ["node", "n", "alone", "low", "high", "pos", "component"]
    side = lambda df, s: df.select("gram", *[F.col(f).alias(f"{s}_{f}") for f in fields])
    placed, seen, made = None, None, [postings]

    def known() -> DataFrame:
        if placed is None:
            return postings.withColumn("component", F.col("node"))
        return postings.join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def accept(found: DataFrame) -> int:
        nonlocal placed
        found = materialize(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        made.append(found)
        count = found.count()
        if count:
            # What the rounds before have joined comes as one link from each node to its component.
            old = placed
            placed = components(found if old is None else found.unionByName(old.select(F.col("node").alias("u"), F.col("component").alias("v"))))
            release(old)
        return count

    for turn in range(rounds):
        now = known()
        # The first leader is the set with the fewest shingles of its own, which near copies are nearest to; others are drawn.
        key = lambda i, turn=turn: F.struct((F.lit(0) if i else F.col("alone")).cast("long").alias("rank"), F.xxhash64(F.lit(turn * leaders + i), "node").alias("hash"))
        chosen = now.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.array(*[F.min(F.struct(key(i).alias("key"), *fields)) for i in range(leaders)]).alias("chosen"))
        chosen = chosen.where("m > 1 and c1 <> c2").select("gram", F.explode(F.array_distinct(F.transform("chosen", lambda x: F.struct(*[x[f].alias(f) for f in fields])))).alias("x")).select("gram", *[F.col(f"x.{f}").alias(f"x_{f}") for f in fields])
        met = side(now, "y").join(chosen, "gram").where((F.col("x_component") != F.col("y_component")) & _could_match("x", "y", num, den))
        fresh = _pairs(met) if seen is None else _pairs(met).join(seen, ["a", "b"], "left_anti")
        fresh = materialize(fresh, "pairs")
        made.append(fresh)
        seen = fresh if seen is None else seen.unionByName(fresh)
        if not accept(_verify(fresh, sets, num, den)):
            break

    now = known()
    by = now.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = by.groupBy("gram").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("gram", F.col("top.component").alias("top"))
    open_postings = materialize(now.join(largest, "gram"), "open")
    minor = side(open_postings.where("component <> top"), "x").withColumn("band", F.explode(F.array(*[_band(F.col("x_n"), num, den) + i for i in (-1, 0, 1)])))
    major = side(open_postings, "y").withColumn("band", _band(F.col("y_n"), num, den))
    met = minor.join(major, ["gram", "band"]).where((F.col("x_component") != F.col("y_component")) & _could_match("x", "y", num, den))
    accept(_verify(_pairs(met).join(seen, ["a", "b"], "left_anti"), sets, num, den))
    release(open_postings, *made)
    if placed is None:
        return sets.sparkSession.createDataFrame([], "node long, component long")
    return placed


def near_duplicates(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """node, doc_id, text_key, n_shingles, component_id and component (a node) for each row of ``docs`` (doc_id, text).

    Two documents link if den * intersection >= num * union of their shingle sets; component_id is the smallest
    doc_id that links reach. Documents with equal sets are joined first, by digest, and one stands for all. Null
    texts and texts without words are empty sets, linked with nothing, their own component. Repeated rows link
    with each other; null ids take part and are never the smallest. Other columns are not read.

    A shingle is known by a 64-bit hash of its words. Of a corpus of N distinct shingles one in 2^64 / N is taken for
    another (at 30 GB one in some billions); that matters where both documents of a pair hold one of the two and their
    similarity is within one shingle of the threshold.
    """
    found = shared_shingles(docs, width, num, den)
    rows = materialize(found.select("node", "doc_id", "text_key", "n", "digest"), "rows")
    some = rows.where("n > 0")
    classes = materialize(some.groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id")), "classes")
    sets = materialize(found.where("take > 0").join(classes.select("node"), "node", "left_semi"), "sets")
    release(found)
    placed = similar_sets(sets, num, den)
    joined = classes.join(placed, "node", "left").select("digest", "least_id", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_digest = joined.join(least, "component").select("digest", "component_id", "component")
    out = (
        some.select("node", "doc_id", "text_key", "n", "digest")
        .join(by_digest, "digest")
        .select("node", "doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "component")
        .unionByName(rows.where("n = 0").select("node", "doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("node").alias("component")))
    )
    out = materialize(out, "near-duplicates")
    release(rows, classes, sets, placed)
    return out


def keep_one(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: that with the smallest doc_id.

    Null ids come last. Of rows that repeat id and text one stays, by the order of a hash of their other columns, so
    reruns agree. A text without words is a component of its own.
    Texts are shuffled once, by id and hash, to meet the keys of the rows that stay.
    """
    found = near_duplicates(docs, width, num, den)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "node")
    kept = found.groupBy("component").agg(F.min_by(F.struct("doc_id", "text_key"), first).alias("kept"))
    key = lambda doc_id, text_key: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_key.cast("string"))
    stay = kept.select(key(F.col("kept.doc_id"), F.col("kept.text_key")).alias("key")).distinct()
    # The row travels as one value, so its columns may have any names.
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns])
    keyed = docs.select(key(F.col("doc_id"), F.xxhash64("text")).alias("key"), whole.alias("whole")).join(stay, "key", "left_semi")
    others = [F.col(f"whole.`{n}`").alias(f"c{i}") for i, n in enumerate(docs.columns) if n not in ("doc_id", "text")]
    once = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(1)))
    return keyed.withColumn("once", once).where("once = 1").select("whole.*")
