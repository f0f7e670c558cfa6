"""Exact inner-product top-k: norm-sorted blocks, rotated partial sums and Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a candidate block, queries in a query block, vectors between two updates of the thresholds.
BLOCK, QUERIES, STEP = 8192, 1024, 1024
PACKED = "size int, longest double, uids binary, ids binary, nulls binary, matrix binary"
FOUND = "qb long, q_uid long, uid long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """uid, vec_id and the components floor(scale * x) of usable vectors: not null, without null or non-finite components."""
    x = F.col("embedding")
    usable = vectors.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    v = usable.select("vec_id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return v.withColumn("norm", norm).withColumn("uid", F.monotonically_increasing_id())


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to ``width``."""
    column = batch.column(batch.schema.get_field_index(name))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows, strongest first: the eigenvectors of the summed width x width products."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch, "v", width).astype(float)
            total += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "x"])

    gram = np.zeros((width, width))
    for row in vectors.select("v").mapInArrow(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[row["i"], row["j"]] = row["x"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _pack(width: int, most: int):
    """Rows of a partition, which is a range of lengths, as matrices of at most ``most`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            uids, ids, nulls, m = (np.concatenate([h[i] for h in held]) for i in range(4))
            longest = float(np.sqrt((m.astype(float) ** 2).sum(1).max(initial=0)))
            row = [pa.array([len(uids)], pa.int32()), pa.array([longest]), *(pa.array([x.tobytes()], pa.binary()) for x in (uids, ids, nulls, m))]
            return pa.RecordBatch.from_arrays(row, ["size", "longest", "uids", "ids", "nulls", "matrix"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - count)
                at, count = at + part.num_rows, count + part.num_rows
                ids, uids = (part.column(part.schema.get_field_index(n)) for n in ("vec_id", "uid"))
                held.append((uids.to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), _matrix(part, "v", width)))
                if count == most:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def search(q: np.ndarray, q_uids: np.ndarray, floors: np.ndarray, x: np.ndarray, x_uids: np.ndarray, x_ids: np.ndarray, x_nulls: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores of its k best rows of ``x`` with scores of at least its floor.

    Rows are taken by descending length, STEP at a time. A first partial sum over the leading quarter of the
    rotated dimensions, plus the product of what is left of both lengths, bounds a score from above; rows whose
    bound is under the query's current k-th score are never scored. Survivors get exact integer scores.
    """
    length = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    head = max(1, x.shape[1] // 4)
    rq, rx = q.astype(float) @ turn, x.astype(float) @ turn
    rest = lambda m: np.sqrt((m[:, head:] ** 2).sum(1))
    left_q, left_x = rest(rq), rest(rx)
    q_length = np.sqrt((q.astype(float) ** 2).sum(1))
    wide = np.float64 if q_length.max(initial=0) * length.max(initial=0) < 2**52 else np.int64
    qx, xx = q.astype(wide), x.astype(wide)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q]
    floors = floors.copy()
    for at in range(0, len(order), STEP):
        rows = order[at : at + STEP]
        live = np.flatnonzero(q_length * length[rows[0]] * (1 + 1e-9) + 1 >= floors)
        if not len(live):
            break
        bound = rq[live, :head] @ rx[rows, :head].T + np.outer(left_q[live], left_x[rows])
        slack = 1e-9 * q_length[live] * length[rows[0]] + 1
        mask = bound + slack[:, None] >= floors[live, None]
        mask &= q_uids[live, None] != x_uids[None, rows]
        columns = np.flatnonzero(mask.any(0))
        if not len(columns):
            continue
        scores = (qx[live] @ xx[rows[columns]].T).astype(np.int64)
        for i, n in enumerate(live):
            met = np.flatnonzero(mask[i, columns] & (scores[i] >= floors[n]))
            if not len(met):
                continue
            places = np.concatenate([best[n][0], rows[columns[met]]])
            values = np.concatenate([best[n][1], scores[i, met]])
            first = np.lexsort((x_uids[places], x_ids[places], x_nulls[places], -values))[:k]
            best[n] = places[first], values[first]
            if len(first) == k:
                floors[n] = max(floors[n], values[first[-1]])
    return best


def _score(width: int, turn: np.ndarray, k: int):
    """Rows of a query block, a candidate block and the floors known for some of the queries, to the rows found."""

    def unpack(row: dict, side: str) -> tuple[np.ndarray, ...]:
        get = lambda name, kind: np.frombuffer(row[side + name], kind)
        return get("uids", np.int64), get("ids", np.int64), get("nulls", np.bool_), get("matrix", np.int64).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_uids, _, _, q = unpack(row, "q_")
                uids, ids, nulls, x = unpack(row, "x_")
                known = {f["q_uid"]: f["score"] for f in row["kth"] or []}
                floors = np.array([known.get(u, -np.inf) for u in q_uids.tolist()])
                found = search(q, q_uids, floors, x, uids, ids, nulls, turn, k)
                sizes = [len(p) for p, _ in found]
                places = np.concatenate([p for p, _ in found])
                made = [pa.array(np.full(len(places), row["qb"])), pa.array(np.repeat(q_uids, sizes)), pa.array(uids[places]), pa.array(ids[places], mask=nulls[places]), pa.array(np.concatenate([s for _, s in found]))]
                yield pa.RecordBatch.from_arrays(made, ["qb", "q_uid", "uid", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; the window's limit works on both sides of its shuffle."""
    order = Window.partitionBy("q_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best other rows of each query row by exact integer inner product: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is over vec_id. Null vectors and vectors with null or
    non-finite components take no part. Shorter vectors count as padded with zeros. Equal scores go to the smaller
    vec_id, null last. A row never meets itself, but rows that repeat an id are rows of their own. Components and
    scores must fit 64 bits. Without queries the result is empty; other columns are not read.

    Rows are sorted by length into blocks (equal lengths are split freely). The queries, in blocks, first meet the
    block of the longest vectors; the k-th scores found there are floors, and then a query block meets only blocks
    whose longest vector can reach its lowest floor. Pairs are made of block summaries and fetch the blocks by
    key. The rotation comes from the products of all rows, summed in the tasks and then by cell.
    """
    held = materialize(integer_vectors(vectors.select("vec_id", "embedding"), scale), "vectors")
    width = max(1, held.agg(F.max(F.size("v"))).first()[0] or 0)
    turn = rotation(held, width)

    def packed(rows: DataFrame, most: int, side: str) -> DataFrame:
        parts = max(1, -(-rows.count() // most))
        ranged = rows.repartitionByRange(parts, F.col("norm").desc(), F.col("uid")).sortWithinPartitions(F.col("norm").desc(), "uid")
        made = ranged.select("vec_id", "uid", "v").mapInArrow(_pack(width, most), PACKED)
        return materialize(made.select(F.monotonically_increasing_id().alias(f"{side}b"), *[F.col(c).alias(f"{side}_{c}") for c in made.columns]), f"{side}-blocks")

    queries, blocks = packed(held.where(is_query), QUERIES, "q"), packed(held, BLOCK, "x")
    first = blocks.select("xb", "x_longest", "x_size").orderBy((F.col("x_size") > k).desc(), F.col("x_longest").desc(), "xb").limit(1).collect()
    first = first[0]["xb"] if first else -1

    def meet(pairs: DataFrame) -> DataFrame:
        both = pairs.join(queries, "qb").repartition("qb", "xb").join(blocks, "xb")
        return both.select("qb", "kth", "q_uids", "q_ids", "q_nulls", "q_matrix", "x_uids", "x_ids", "x_nulls", "x_matrix").mapInArrow(_score(width, turn, k), FOUND)

    none = F.expr("cast(null as array<struct<q_uid:bigint,score:bigint>>)")
    start = materialize(_best(meet(queries.select("qb", F.lit(first).cast("long").alias("xb"), none.alias("kth"))), k), "found")
    kth = start.where(F.col("rank") == k).groupBy("qb").agg(F.collect_list(F.struct("q_uid", "score")).alias("kth"), F.min("score").alias("lowest"), F.count(F.lit(1)).alias("known"))
    open_blocks = queries.select("qb", "q_longest", "q_size").join(kth, "qb", "left")
    rest = blocks.select("xb", "x_longest").where(F.col("xb") != first)
    reach = (F.coalesce("known", F.lit(0)) < F.col("q_size")) | (F.col("q_longest") * F.col("x_longest") * (1 + 1e-9) + 1 >= F.col("lowest"))
    more = meet(open_blocks.join(rest, reach).select("qb", "xb", "kth"))
    ranked = _best(start.drop("rank").unionByName(more), k).join(held.select(F.col("uid").alias("q_uid"), F.col("vec_id").alias("query_id")), "q_uid")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
