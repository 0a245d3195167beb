import random
import re

import numpy as np
import pandas as pd
import xxhash
from lanepulse.llm import simhash
from lanepulse.llm.links import components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id reachable by links of at most three bits; prints: (id, fingerprint)."""
    root = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, x in prints:
            for j, y in prints:
                if (x ^ y).bit_count() <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def as_long(value):
    return int(np.uint64(value).view(np.int64))


def test_fingerprint_edges():
    texts = [None, "", " \t\n", "a", "A b", "a  b\tc d É x y z", "ÀB cd " * 40, "x" * 300_000 + " y z w"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_print(t)


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (200, 202), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _grouped(spark, prints):
    df = spark.createDataFrame([(as_long(p),) for p in prints], "fp long").distinct()
    nodes = components(simhash.fingerprint_links(df))
    found = dict(nodes.collect())
    return {p: found.get(as_long(p), as_long(p)) for p in prints}


def test_every_link_is_found(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(4):
            prints.add(base)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                base ^= 1 << b
    prints = sorted(prints)
    want, got = plain_components([(p, p) for p in prints]), _grouped(spark, prints)
    for p in prints:
        for q in prints:
            assert (want[p] == want[q]) == (got[p] == got[q])


def test_large_groups_are_cut_not_dropped(spark, monkeypatch):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(150):
        value = base
        for b in rng.sample(range(64), rng.choice([2, 3, 5, 6])):
            value ^= 1 << b
        prints.add(value)
    prints = sorted(prints)
    want = plain_components([(p, p) for p in prints])
    monkeypatch.setattr(simhash, "LIMIT", 3)
    left = simhash._compare(iter(_sorted_keys(prints)))
    out = pd.concat(left)
    links = list(out[out.cut < 0][["a", "b"]].itertuples(index=False, name=None))
    finer = out[out.cut >= 0].sort_values(["slot", "key", "cut", "b"])
    for frame in simhash._compare_cut(iter([finer.iloc[k : k + 101] for k in range(0, len(finer), 101)])):
        links += list(frame[["a", "b"]].itertuples(index=False, name=None))
    assert len(finer) and all((x ^ y) % (1 << 64) for x, y in links)
    root = {as_long(p): as_long(p) for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[top(a)] = top(b)
    for p in prints:
        for q in prints:
            assert (want[p] == want[q]) == (top(as_long(p)) == top(as_long(q)))


def _sorted_keys(prints):
    frame = pd.DataFrame({"fp": np.array(prints, np.uint64).view(np.int64)})
    keyed = pd.concat(simhash._keys(iter([frame]))).sort_values(["slot", "key"], ignore_index=True)
    return [keyed.iloc[k : k + 37] for k in range(0, len(keyed), 37)]


def test_rows_and_edges(spark):
    rows = [(5, "a b c d e"), (3, "A b c d e"), (5, "a b c d e"), (9, None), (8, ""), (None, "q r s t u"), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (5, 3), (9, 8), (8, 8), (None, None), (None, 8)], key=str)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plain = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    want = plain_components(plain)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (as_long(p), want[i]) for i, p in plain}


def test_one_row_of_each_group_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    component = plain_components([(r.doc_id, plain_print(r.text)) for r in docs.collect()])
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(i for i, head in component.items() if i == head) and len(kept) < len(component)


def test_repeated_rows_and_rows_without_id(spark):
    text = "one two three four five six"
    rows = [(4, text, "a"), (4, text, "b"), (4, text.upper(), "c"), (2, "other words stand in this row", "d"), (None, text, "e"),
            (None, "none has an id in here", "f"), (None, "none has an id in here", "g"), (8, None, "h"), (6, "", "i"), (6, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect())
    assert groups == [(0, "none has an id in here"), (2, "other words stand in this row"), (4, text), (6, "")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_finer_keys_come_one_at_a_time():
    fps = np.arange(4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    frames = list(simhash._cut(5, fps))
    assert len(frames) == 56 and all(len(f) == 4096 for f in frames)
    assert [f["cut"].iloc[0] for f in frames] == list(range(56))
