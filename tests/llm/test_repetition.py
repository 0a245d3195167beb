import random
import re
from collections import Counter

from lanepulse.llm import repetition


def plain(text):
    text = text or ""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [text[a:b] for a, b in spans]
    covered = []
    for n in repetition.NGRAMS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        many = Counter(grams)
        covered.append({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(n)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    shares = [sum(len(words[i]) for i in c) / chars if chars else 0.0 for c in covered]
    failed = len(words) < 10 or 100 * len(covered[0]) > 20 * len(words)
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered[0]), shares, failed)


def test_against_plain_counting(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for r in repetition.repetition_rules(docs).collect():
        n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered, r.base_failed)
        assert n == plain(r.text)
        assert not (r.base_failed and r.kept)


def test_edges():
    rng = random.Random(1)
    texts = [None, "", "\n \t", "a " * 9, "a " * 10, "ab c d\x1fe  f\n" * 3, "#*$%&|<> x", "x" * 100_000,
             " ".join(rng.choice("ab") for _ in range(400)), "é ü 😀 " * 50, "one\none\n one\n\n\n"]
    for t in texts:
        assert repetition.measure(t)[:6] + repetition.measure(t)[7:8] == plain(t)


def test_equal_hashes_do_not_count():
    import numpy as np

    words = b"a b c d e f g h i j".split()
    flat = np.zeros(len(words), np.uint64)  # every window hashes alike
    assert len(repetition.repeated_starts(words, flat, 5, None)) == 0


def test_rows_tables_and_clashing_names(spark):
    rows = [(1, None, "keep", 7), (1, None, "keep", 7), (None, "a b c d e f g h i j k", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n.x` string, kept int")
    out = repetition.repetition_rules(docs)
    assert out.columns[:3] == ["doc_id", "text", "n.x"] and dict(out.dtypes)["kept"] == "boolean"
    assert sorted(str((r.doc_id, r.kept)) for r in out.collect()) == ["(1, False)", "(1, False)", "(None, True)"]
    assert repetition.repetition_rules(docs.limit(0)).count() == 0


def test_long_repeats_are_rejected():
    body = " ".join(f"w{i}" for i in range(400))
    assert repetition.measure(body)[8]
    assert not repetition.measure(body + "\n" + body)[8]
