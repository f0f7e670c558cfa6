import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folio.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def paths(nodes):
    """The root and each leaf's siblings, level by level, by whole levels."""
    proofs, where = [[] for _ in nodes], [*range(len(nodes))]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = at - at % 3
            proofs[i].append((nodes[run:at], nodes[at + 1 : run + 3]))
        where = [at // 3 for at in where]
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute(rows):
    by = {}
    for doc_id, text, lang, source, n_chars, _ in rows:
        by.setdefault(source, []).append((doc_id, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, text.replace("\n", ""), lang, source, n_chars) if text is not None and zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 2 == 0 else None))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    found = {s: (ls := sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), paths([x[1] for x in ls])) for s in order}
    root, above = paths([found[s][1][0] for s in order])
    out = []
    for s, up in zip(order, above):
        ls, (subroot, proofs) = found[s]
        for (doc_id, own, altered), proof in zip(ls, proofs):
            node = altered or own
            for before, after in proof + up:
                node = h(*before, node, *after)
            out.append((str(doc_id), own, subroot, root, h(*(x for b, a in proof + up for x in b + a)), node, node == root))
    return sorted(out)


def judged(df):
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle.manifest(df, tampered)
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = found.select(F.col("doc_id").cast("string"), "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))), folded, folded == F.col("root"))
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


@pytest.mark.parametrize("count", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 82, 243, 400, 728, 729])
def test_traversal_gives_every_path(count):
    leaves = [h(str(i)) for i in range(count)]
    root, proofs = paths(leaves)
    levels = merkle.levels_of(count)
    assert merkle.tree_root(leaves, levels) == root
    assert [[("".join(b), "".join(a)) for b, a in p] for p in proofs] == list(merkle.traverse(leaves, levels))


def test_a_short_block_goes_all_levels_up():
    leaves = [h(str(i)) for i in range(4)]
    node = merkle.tree_root(leaves, merkle.LEVELS)
    for own, path in zip(leaves, merkle.traverse(leaves, merkle.LEVELS), strict=True):
        for before, after in path:
            own = h(before, own, after)
        assert own == node


def test_equal_to_whole_levels(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 4000), rng.choice(["a\nb", "é\n", "", None, "plain"]), rng.choice(["en", None]), "hot" if rng.random() < 0.6 else rng.choice(["a", "é", "", None, "z"]), rng.choice([1, None]), "x") for _ in range(4000)]
    rows += [(None, None, None, "hot", None, "x")] * 50 + [(5, "lone", "en", "only", 4, "x")]
    assert judged(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_sources(spark):
    rows = [(i, f"t\n{i}", "en", f"s{i}", i, "x") for i in range(1500)]
    assert judged(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(1, "a\n" * 100_000, "en", None, 3, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert judged(df) == brute(rows)
    assert judged(df.limit(0)) == []
