import random
import re

import numpy as np
import pandas as pd
from lanepulse.llm import minhash, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(docs):
    """(doc_id, component) per row by comparing all pairs of rows."""
    sets, of = [plain_set(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= 85 * (len(x) + len(sets[j]) - both):
                of[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(top(i), []).append(d)
    return [(d, min((x for x in least[top(i)] if x is not None), default=None) if sets[i] else d)
            for i, (d, _) in enumerate(docs)]


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(plain_components(docs), key=str)


def test_sets_and_edges(spark):
    texts = [None, "", " \t\n", "a", "A b", "a  b\tc d É x y z", "ÀB cd e f g " * 9, "x" * 300_000 + " y z w v u"]
    for t in texts:
        assert len(minhash.shingle_set(t)) == len(plain_set(t))
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (5, "a b c d e f"), (9, None), (8, ""), (None, "q r s t u v"),
            (None, None), (None, "Q r s t u v"), (4, "one two"), (2, "one  two"), (1, "x y z " * 30_000)]
    check(spark, rows)
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, n int, h1 string")
    assert {r.doc_id: r.kept for r in minhash.near_duplicates(df).collect() if r.doc_id in (2, 3, 4, 9)} == {
        2: True, 3: True, 4: False, 9: True}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 20:
            del words[at]
    return words


def test_dense_groups_lose_no_link(spark):
    """Groups of near copies around a base, some about the threshold from all others, chains of
    edits, and a passage that many unlike texts share."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for size in (6, 7, 30, 100, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        variant = edited(rng, base, max(1, size // 30), vocabulary)
        for k in range(60):
            docs.append(edited(rng, base if k % 2 else variant, rng.randrange(1 + size // 20), vocabulary))
        step = base
        for _ in range(20):
            step = edited(rng, step, max(1, size // 80), vocabulary)
            docs.append(step)
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60]))]
        docs.append(passage + own)
        docs.append(own)
    rng.shuffle(docs)
    check(spark, [(1000 - i, " ".join(w)) for i, w in enumerate(docs)])


def test_pigeonhole_of_signatures():
    """Two signatures that differ in 15 of 32 minima share a key; three errors a chunk may hide them."""
    import pandas as pd

    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(0, 1 << 16, 32).astype(np.uint16)
        y = x.copy()
        y[rng.choice(32, 15, replace=False)] += 1
        frame = pd.DataFrame({"node": [1, 2], "signature": [x.tobytes(), y.tobytes()]})
        keys = pd.concat(minhash._keys(iter([frame])))
        assert len(keys) == 64 and (keys.groupby("key").node.nunique() == 2).any()


def test_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_components(docs)
    got = [(r.doc_id, r.component_id) for r in queries.op11_minhash(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    assert any(d != c for d, c in want)


def test_a_batch_is_measured_in_parts():
    """Ten texts of 300,000 characters and odd ones: no part holds more than about `PART`."""
    texts = pd.Series([None, "", *["word " * 60_000] * 10, "a" * 3_000_000, None, "x"], dtype=object)
    parts = list(minhash._parts(texts))
    assert pd.concat(parts).equals(texts) and len(parts) > 3
    assert all(sum(len(t or "") for t in p) <= minhash.PART + 300_000 or max(len(t or "") for t in p) > minhash.PART for p in parts)
    assert sum(map(len, minhash._parts(texts.iloc[:0]))) == 0
