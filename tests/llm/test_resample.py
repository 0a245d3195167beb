import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pandas as pd
from lanepulse.llm import queries, resample

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_buckets(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i: i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, target, percent=5):
    """doc_id -> (n_features, weight, score, rank) row by row."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_buckets(text)[1])
    for text in target:
        t.update(plain_buckets(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows, able = [], []
    for d, text in docs:
        n, buckets = plain_buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
                     for b in buckets)
        h = int(sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(buckets), weight, score, None])
        if n >= 20:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def test_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = queries.op12_resample(spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target)


def test_blocks_do_not_mix_documents(monkeypatch):
    texts = pd.Series([None, "", "a b", "C d\x00e", "é À ß.x", "1 2 3 " * 500, "x" * 100, "\x00", " one",
                       f"a {'y' * 63} b {'z' * 64} {'u' * 65} c d {'é' * 40}"])
    for limit in (1, 40, 1 << 20):
        monkeypatch.setattr(resample, "BLOCK_BYTES", limit)
        at, found = 0, {}
        for block in resample._blocks(texts):
            words, owners, buckets = resample.features(block)
            for i, n in enumerate(words.tolist()):
                found[at + i] = (n, sorted(buckets[owners == i].tolist()))
            at += len(block)
        assert found == {i: (n, sorted(b)) for i, (n, b) in enumerate(map(plain_buckets, texts))}


def test_edges(spark):
    long = " ".join(f"w{i % 50}" for i in range(60_000))
    texts = [None, "", "short text", long, "alpha beta " * 15, "Alpha BETA " * 15, "gamma delta " * 15, "é " * 19, "é " * 20]
    docs = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (None, texts[6]), (None, None)]
    target = ["alpha beta", None, ""]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, rank int, _id string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, aim, percent=50)
    assert got.columns == ["doc_id", "text", "_id", "n_features", "weight", "score", "rank"]
    rows = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    assert rows == plain(docs, target, 50)
    assert resample.resample(df.limit(0), aim).count() == 0
    none = resample.resample(df, aim.limit(0), keep=["doc_id"])
    assert sorted(map(tuple, none.collect()), key=str) == plain(docs, [])
