import random
import re
from collections import Counter, defaultdict

import pytest

from folio.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank int"


def brute(rows, least_docs, most_terms=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}], "term": [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < most_terms]
    return sorted(out)


def rows_of(seed, n, sources, vocabulary):
    rng = random.Random(seed)
    words = [w + x for w in ("tar", "Äpfel", "日", "one", "Two") for x in map(chr, range(97, 97 + vocabulary))]
    rows = []
    for i in range(n):
        s = int(rng.random() ** 2 * sources)
        text = " ".join(rng.choice(words[: 5 + 3 * s] if rng.random() < 0.7 else words) + rng.choice(["", ".", "-3 ", "_"]) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None]), rng.choice([f"s{s}", f"é{s}", None]), 7))
    return rows + rows[:5]


@pytest.mark.parametrize("options", [{}, {"tile": 2, "chunk": 5}, {"tile": 3, "chunk": 7, "most_light": 0}, {"tile": 4, "light_share": 1, "most_light": 9}])
def test_equal_to_all_pairs(spark, options):
    rows = rows_of(3, 300, 6, 8)
    got = divergence.audit_sources(spark.createDataFrame(rows, SCHEMA), least_docs=4, most_terms=5, **options)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, 4, 5)


def test_no_terms_one_source_and_no_rows(spark):
    rows = [(1, "alone", "xx", "a", 0), (2, None, "yy", "a", 0), (3, "12 3", "yy", None, 0), (3, "12 3", "yy", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence.audit_sources(df, least_docs=1).collect())) == brute(rows, 1)
    assert divergence.audit_sources(df.limit(0)).collect() == []
    with_none = [tuple(r) for r in divergence.audit_sources(df).collect()]
    assert sorted(with_none) == brute(rows, 30) and all(r[4] == 0 for r in with_none)


def test_a_very_long_text(spark):
    rows = [(i, "word other " * 60_000 if i == 0 else "word", "en", f"s{i}", 0) for i in range(3)]
    got = divergence.audit_sources(spark.createDataFrame(rows, SCHEMA), least_docs=1)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1)
