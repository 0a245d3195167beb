import random
import re

from lanepulse.llm import lines

LAST = lines.LAST_ID


def plain(docs):
    """(d, line) of every line with an earlier match, over all pairs; docs: (doc_id, text)."""
    every = []
    for doc_id, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            if words:
                every.append((LAST if doc_id is None else doc_id, at, words))
    every.sort(key=lambda x: x[:2])
    return sorted((d, at) for i, (d, at, w) in enumerate(every)
                  if any((d, at) > (e, b) and 9 * len(w & v) >= 4 * (len(w) + len(v)) for e, b, v in every[:i]))


def found(spark, docs, **schema):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.d, r.line) for r in lines.removed_lines(df).collect())


def test_random_lines_against_all_pairs(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(12)]
    docs = []
    for i in range(120):
        out = []
        for _ in range(rng.randrange(1, 5)):
            if docs and rng.random() < 0.6:  # a changed copy of an earlier line
                line = rng.choice((rng.choice(docs)[1] or "x").split("\n")).split(" ")
                for _ in range(rng.randrange(4)):
                    line[rng.randrange(len(line))] = rng.choice([*common, f"n{rng.randrange(10**6)}"])
            else:
                line = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(30))]
            out.append(" ".join(line))
        docs.append((i, "\n".join(out)))
    rng.shuffle(docs)
    want = plain(docs)
    assert len(want) > 60 and found(spark, docs) == want


def test_chain_and_dense_group(spark):
    base = [f"w{i}" for i in range(20)]
    dense = [(i, " ".join([*base[: i % 20], f"new{i}", *base[i % 20 + 1 :]])) for i in range(60)]
    chain = [(100 + i, " ".join(f"k{j}" for j in range(i, i + 20))) for i in range(40)]
    docs = [*dense, *chain, (None, " ".join(base)), (7, None), (8, ""), (9, " \t\n \n"), (200, "a b c"), (201, "c b a a"),
            (202, "x\x0by\x0cz"), (203, "x y z")]
    assert found(spark, docs) == plain(docs)


def test_texts(spark):
    docs = spark.createDataFrame(
        [("one two\n\nthree four five\n", 1, 5), ("three four five\nsix", 2, 6), (None, 3, 7), ("six", None, 8), ("six", None, 8)],
        "text string, doc_id long, line int")
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
        ("one two\n\nthree four five\n", 1, 5), ("six", 2, 6), (None, 3, 7), ("", None, 8), ("", None, 8)]))
    assert lines.removed_lines(docs.limit(0)).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted((r.d, r.line) for r in lines.removed_lines(docs).collect())
    assert got == plain([tuple(r) for r in docs.collect()])


def test_words_with_and_without_other_white_space(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b", "é", "\x85", "\xa0", " ", " ", "\t", "\x0b", "\x0c", "\r", "\x1c", "|"][: rng.choice([6, 13])])
                     for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines._words(lines.F.col("t")).alias("w"))
    for r in df.collect():
        assert r.w == list(dict.fromkeys(w for w in re.split(r"[\x20\x09-\x0D]+", r.t) if w))


def test_lines_are_split_once(spark, capsys):
    docs = spark.createDataFrame([(1, "a b c\nd e"), (2, " \t\n")], "doc_id long, text string")
    sets = lines.line_sets(docs)
    assert sets.count() == 2
    sets.explain()
    plan = capsys.readouterr().out
    assert plan.count("array_distinct(") == 1


def test_near_copies_share_leads(spark):
    base = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(30)]
    rows = lines.line_sets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(len(r.bands) == len(set(r.bands)) == len(lines.LEAD_MASKS) for r in rows)
    first = rows[0].bands
    assert sum(any(a == b for a, b in zip(first, r.bands, strict=True)) for r in rows) >= 25


def test_sets_are_small_numbers_whose_parities_bound_the_difference(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = ["\n".join(" ".join(rng.sample(words, rng.randrange(1, 40))) for _ in range(8)) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = lines.line_sets(df)
    assert sets.schema["bands"].dataType.elementType.simpleString() == "int"
    of = {(i, k): set(line.split(" ")) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))}
    rows = [(of[r.d, r.place >> 31], r) for r in sets.collect()]
    assert len(rows) == 64 and all(len(w) == r.n for w, r in rows)
    for a, x in rows:
        for b, y in rows:
            low, high = ((x[side] ^ y[side]) & (1 << 64) - 1 for side in ("low", "high"))
            assert (low ^ high).bit_count() + high.bit_count() <= len(a ^ b)
