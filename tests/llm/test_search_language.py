import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lanepulse.llm import languages, neighbours, substrings


def nearest(rows, query_ids, k):
    out = {}
    for q in query_ids:
        v = next(np.array(x) for i, x in rows if i == q)
        score = sorted({(-float((np.array(x) * v).sum()), i) for i, x in rows if i != q})
        out[q] = [i for _, i in score[:k]]
    return out


def test_recall_and_order(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    got = defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    want = nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    hits = sum(len(set(want[q]) & {v for *_, v in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[1], x[2])) and q not in {v for *_, v in found}


def test_vectors_that_take_no_part_ties_and_norms(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 4)).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (2080, [1.0] * 5), (None, [1.0] * 8),
           (2100, [float("inf")] * 8), rows[20]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = neighbours.search(df, df.where("vec_id % 20 = 0"), block=16, probes=1.0).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert got == nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("probes", [1.0, 0.5])
def test_several_vectors_of_one_id(spark, probes):
    rng = np.random.default_rng(8)
    rows = [(i // 5 if i < 400 else 7 if i < 600 else i, rng.normal(size=8).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    best = defaultdict(dict)
    for q, a in rows:
        for i, b in rows if q % 20 == 0 else ():
            if i != q:
                best[q][i] = max(best[q].get(i, -1e9), float(np.dot(a, b)))
    found = neighbours.search(df, df.where("vec_id % 20 = 0"), block=64, probes=probes).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    want = {q: [(i, round(s, 9)) for i, s in sorted(m.items(), key=lambda m: (-m[1], m[0]))[:20]] for q, m in best.items()}
    assert all(len(got[q]) == 20 and len({i for i, _ in got[q]}) == 20 for q in want)
    right = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert right == 20 * len(want) if probes == 1 else right >= 18 * len(want)


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text", "lang").collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    df = spark.createDataFrame([r for r in docs if not out(r.doc_id)], "doc_id long, text string, lang string")
    model = languages.fit(df, per_language=100)
    rest = [r for r in docs if out(r.doc_id) and r.lang]
    right = sum(languages.Model.predict(model, languages.features(r.text))[0] == r.lang for r in rest)
    assert right >= 0.98 * len(rest) > 50
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "123 !?", 3), (4, "der die und", 3), (4, "der die und", 3)],
                                "doc_id long, text string, score int")
    got = languages.identify(odd, model)
    assert Counter(r.lang_pred == "und" for r in got.collect()) == {True: 3, False: 2}
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert languages.fit(df.limit(0)) is None
    assert {r.lang_pred for r in languages.identify(odd, None).collect()} == {"und"}
    assert languages.family_of("xx") == "xx"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    rows, planted = [], set()
    passage, line = prose(rng, 55), prose(rng, 10)
    for i in range(80):
        text = f"{line}\n{prose(rng, rng.randrange(20, 300))}"
        if i % 4 == 0:  # shifted each time by what stands in front
            text = f"{text} {passage} {prose(rng, 40)}"
            planted.add(i)
        rows.append((i, text, "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, "short", "x"), (None, prose(rng, 60) + passage, "x"), (103, "ü" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    spans = substrings.repeated_spans(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    assert {s.doc_id for s in spans} & set(range(200)) == planted
    assert all(texts[s.doc_id][s.start : s.stop] in passage for s in spans if s.doc_id in planted)
    assert [s.doc_id for s in spans if s.is_first] == [min(planted)]
    cut = substrings.remove_repeats(docs)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and left[0] == texts[0] and left[1] == texts[1] and left[100] is None
    assert all(len(left[i]) < len(texts[i]) - 100 for i in planted - {0})
    assert substrings.repeated_spans(docs.limit(0)).count() == 0


def test_insertions_move_few_cuts():
    rng = random.Random(6)
    text = prose(rng, 400)
    digests = lambda t: set(substrings.chunks(t)[3].tolist())
    before, after = digests(text), digests(text[:900] + "XYZ" + text[900:])
    assert len(before - after) <= 4
    start, stop, words, _ = substrings.chunks("é " * 500)
    assert start[0] == 0 and stop[-1] == 1000 and (start[1:] == stop[:-1]).all() and words.sum() == 500


def share_found(spark, rows, queries, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.search(df, df.where(df.vec_id.isin(queries)), k=k).collect():
        got[r.query_id].add(r.vec_id)
    v = np.array([x for _, x in rows])
    hits, total, least = 0, 0, 1.0
    for q in queries:
        score = v @ v[q]
        score[q] = -np.inf
        want = set(np.argsort(-score)[: min(k, len(rows) - 1)].tolist())
        hits, total, least = hits + len(want & got[q]), total + len(want), min(least, len(want & got[q]) / len(want))
        assert len(got[q]) == len(want)
    return hits / total, least


def test_few_rows_and_norms_of_any_kind_at_the_default_probes(spark):
    rng = np.random.default_rng(4)
    few = [(i, rng.normal(size=64).tolist()) for i in range(18)]
    assert share_found(spark, few, list(range(18))) == (1.0, 1.0)
    unit = rng.normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    queries = list(range(0, 2000, 20))
    outlier, spread = np.ones(2000), np.exp(rng.normal(size=2000))
    outlier[7] = 1000.0
    shares = [share_found(spark, list(enumerate((unit * n[:, None]).tolist())), queries) for n in (outlier, spread)]
    assert min(mean for mean, _ in shares) >= 0.95 and min(least for _, least in shares) >= 0.6, shares


def test_passages_of_51_short_words_and_periodic_ones_are_all_found_and_50_are_not(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    filler = lambda: " ".join(word(rng.randrange(3, 9)) for _ in range(rng.randrange(5, 90)))
    short = lambda n: " ".join(word(rng.randrange(1, 5)) for _ in range(n))
    passages = [short(51) for _ in range(400)] + [("0 " * 51).strip(), ("1 2 " * 30).strip(), ("| - " * 26).strip()]
    near = [short(50) for _ in range(100)]
    rows, want = [], {}
    for i, passage in enumerate(passages + near):
        for j in (2 * i, 2 * i + 1):
            before = filler() + " "
            rows.append((j, f"{before}{passage} {filler()}"))
            if i < len(passages):
                want[j] = (len(before), len(before) + len(passage))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeated_spans(docs).collect()
    assert {r.doc_id: (r.start, r.stop) for r in found} == want and len(found) == len(want)
    assert all(r.n_words > 50 and r.n_chunks > 0 for r in found)


def test_texts_without_letters_are_und():
    for text in (None, "", "½", "²", "①", "123 _ ٣", "😀 !"):
        assert languages.features(text) is None
    for text in ("a", "é", "ß 1", "字", "ª"):
        assert languages.features(text) is not None


def test_copies_without_an_id(spark):
    rng = random.Random(12)
    shared, other = prose(rng, 80), prose(rng, 70)
    rows = [(None, shared), (None, shared), (None, shared), (7, shared), (None, other), (None, other), (3, prose(rng, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.is_first) for r in substrings.repeated_spans(docs).collect()}
    assert got == {(None, 7, False), (7, 7, True)}
    left = sorted((r.doc_id or 0, len(r.text)) for r in substrings.remove_repeats(docs).collect())
    assert left == sorted([(0, 0)] * 3 + [(7, len(shared)), (0, len(other)), (0, len(other)), (3, len(rows[-1][1]))])


def test_few_windows_of_copies_are_compared_one_by_one_and_spans_equal_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(words, k=n)
    docs = []
    for i in range(12):
        passage, periodic = text(300), text(rng.randrange(1, 30)) * 10
        docs += [passage, passage, [*text(20), *passage[:140], "new", *passage[141:], *text(20)], [*text(5), *passage[100:151]],
                 [*text(9), *passage[100:150], *text(9)], periodic, [*text(3), *periodic[1:-1]], [*passage[40:], *passage[:200]]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    holders = {}
    for i, d in enumerate(docs):
        for no in range(len(d) - 50):
            holders.setdefault(tuple(d[no : no + 51]), set()).add(i)
    want = set()
    for i, d in enumerate(docs):
        run = []
        for no in range(len(d) - 49):
            found = holders.get(tuple(d[no : no + 51]), ()) if no < len(d) - 50 else ()
            if len(found) > 1:
                run.append((no, min(found)))
            elif run:
                first, last, least = run[0][0], run[-1][0] + 51, min(r[1] for r in run)
                start = sum(len(w) + 1 for w in d[:first])
                want.add((i, start, start + len(" ".join(d[first:last])), last - first, least, least >= i))
                run = []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.repeated_spans(df).collect()
    assert {(r.doc_id, r.start, r.stop, r.n_words, r.first_doc_id, r.is_first) for r in got} == want and len(got) == len(want)
    copies = spark.createDataFrame([(i, " ".join(docs[0])) for i in range(50)], "doc_id long, text string")
    table = substrings.piece_table(substrings._known(copies, "text", "doc_id"), 51).collect()
    assert len(table) == 50 and {(r.no, r.last, r.least) for r in table} == {(0, 249, 0)}


def test_texts_joined_for_numpy_give_the_windows_of_each_alone(monkeypatch):
    rng = random.Random(9)
    texts = ["", " ", "x " * 50, "x " * 51, "0 " * 300, "é 中 🙂 " * 60, " é" * 51]
    texts += [" ".join(rng.choice(["a", "b", "ÿ"]) for _ in range(rng.randrange(45, 200))) for _ in range(60)]
    rng.shuffle(texts)

    def found(several):
        rows = set()
        for at, joined in substrings.joined(several):
            own, first, last, core, extent = substrings.groups(joined)
            least = np.where(first % 3 == 0, -1, first % 5)
            some = substrings.pieces(joined, own, first << 32 | last - first, least)
            rows |= {(texts.index(several[at + i]), *x) for i, *x in zip(*(c.tolist() for c in (own, first, last, core, extent)))}
            rows |= {(texts.index(several[at + i]), *x) for i, *x in zip(*(c.tolist() for c in some))}
        return rows

    alone = set().union(*(found([t]) for t in texts))
    assert found(texts) == alone
    monkeypatch.setattr(substrings, "TOGETHER", 1000)
    assert found(texts) == alone


def test_windows_are_grouped_in_one_pass_over_the_texts(spark):
    docs = spark.createDataFrame([(1, "a " * 60), (2, "a " * 70)], "doc_id long, text string")
    plan = substrings.piece_table(substrings._known(docs, "text", "doc_id"), 51)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
