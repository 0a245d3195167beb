import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from lanepulse.llm import bpe, packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(library):
    rng, own = random.Random(2), bpe.codec(PATH)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "É", "ß", "中", "🙂", "\x85", "\x1c", "1", "٣", "_", "-", ".",
             "<|endoftext|>", "<|endo", "the", " the", "́", "\x00", "　", "AbC"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text
    ids = [rng.randrange(50257) for _ in range(300)]
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged(own, piece):
    """Plain merging: the earliest merge, leftmost first, until none applies."""
    tokens = [own.shorter_of[bytes([b])] for b in piece]
    while True:
        ready = [(own.made[pair], i) for i, pair in enumerate(zip(tokens, tokens[1:])) if pair in own.made]
        if not ready:
            return tokens
        token, i = min(ready)
        tokens[i : i + 2] = [token]


def test_pair_rule_equals_merging():
    own, rng = bpe.codec(PATH), random.Random(4)
    own.shorter_of = {bytes([b]): own.longest.get(chr(b)) for b in range(256)}
    data = {}

    def text(token):
        if token not in data:
            a, b = own.halves[token]
            data[token] = text(a) + text(b) if (a, b) != (token, token) else next(
                k for k, v in own.shorter_of.items() if v == token)
        return data[token]

    seen = set()
    for _ in range(6000):
        left, right = rng.randrange(3000), rng.randrange(3000)
        if rng.random() < 0.5:  # tokens that meet in some token are the hard cases
            left, right = rng.choice(own.halves[256:6000])
            right = rng.choice([right, *own.halves[right]])
            left = rng.choice([left, *own.halves[left]])
        both = merged(own, text(left) + text(right)) == [left, right]
        assert own.compatible(left, right) == both
        seen.add(both)
    assert seen == {True, False}


def test_one_very_long_word(library):
    rng = random.Random(3)
    text = "".join(rng.choice("aeinthsrou") for _ in range(30_000))
    assert bpe.codec(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables_that_overflow_change_nothing(monkeypatch):
    for name in ("MAX_WORDS", "MAX_PIECES", "MAX_PAIRS"):
        monkeypatch.setattr(bpe, name, 4)
    small, texts = bpe.Codec(PATH), ["one two three, four five six.", "six five four"] * 3
    assert [small.encode(t).tolist() for t in texts] == [bpe.codec(PATH).encode(t).tolist() for t in texts]


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()


def test_rows_and_edges(spark):
    rows = [(1, None, 5), (1, None, 5), (2, "", 5), (None, "the cat", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got.collect()) == [
        ("1", [], ""), ("1", [], ""), ("2", [], ""), ("None", [1169, 3797], "the cat")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def check_packing(rows, ids_of, capacity=1024):
    """rows: packed pieces; ids_of: ids with the end token per doc_id, repeated rows apart."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in ids_of.items():
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert all(a.start + a.length == b.start for a, b in zip(own[:-1], own[1:], strict=True))
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.length == len(part) // 4 and r.ids_crc32 == zlib.crc32(part)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packed_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids_of = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    used = check_packing(packing.pack(docs, PATH).collect(), ids_of)
    least = -(-sum(map(len, ids_of.values())) // 1024)
    assert least <= used <= 1.02 * least + 1


def test_pack_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 1500), (4, "a"), (4, "a")], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 2, 4: 2}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("low, high, n", [(1, 1025, 3), (1, 1025, 4000), (300, 520, 4000), (340, 345, 500), (1024, 1025, 50)])
def test_plans_hold_every_length(low, high, n):
    counts = Counter(np.random.default_rng(n).integers(low, high, n).tolist())
    found, kinds = Counter(), packing.plan(counts)
    for kind, copies in kinds.items():
        assert sum(kind) <= 1024
        for length in kind:
            found[length] += copies
    assert found == counts
    alone = packing.best_fit(Counter(), sorted(counts.items(), reverse=True), 1024)
    assert sum(kinds.values()) <= sum(alone.values())


def test_many_texts_at_once_equal_the_library(library, monkeypatch):
    rng, own = random.Random(5), bpe.Codec(PATH)
    letters = "aeinthsrouABC'.,-\n\t\x1c\x85éß中🙂1٣_"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    words += ["w" * n for n in (39, 40, 41, 63, 64, 65, 300)] + ["<|endoftext|>", "x<|endoftext|>y", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(1500)] + [None, "", " ", "a "]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "MOST_CHARACTERS", 5000)
    for _ in range(2):
        assert [np.frombuffer(p, "<u4").tolist() for p in own.packed_all(texts)] == want


def test_new_words_are_encoded_together(monkeypatch):
    own, rng = bpe.Codec(PATH), random.Random(6)
    texts = [" ".join("".join(rng.choice("aeinthsrou") for _ in range(9)) for _ in range(50)) for _ in range(40)]
    want = [own.packed(t) for t in texts]
    alone, calls = bpe.Codec(PATH), []
    plain = alone.encode_piece
    monkeypatch.setattr(alone, "encode_piece", lambda piece: calls.append(piece) or plain(piece))
    assert list(alone.packed_all(texts)) == want and len(calls) <= len(texts)
    pieces = ["".join(rng.choice("aeinthsrou '.") for _ in range(rng.randrange(1, 60))).encode() for _ in range(500)]
    assert own.encode_pieces(pieces) == [np.array(own.encode_piece(p), "<u4").tobytes() for p in pieces]


def test_packing_holds_small_tables_and_few_texts(spark, library):
    own = bpe.codec(PATH, packing.MAX_WORDS, packing.MAX_PIECES)
    assert own is not bpe.codec(PATH)
    texts = [" ".join(f"w{i * 1000 + k:x}q" for k in range(1000)) for i in range(700)]
    packed = [*own.packed_all(texts)]
    for i in (0, 350, 699):
        assert np.frombuffer(packed[i], "<u4").tolist() == library.encode(texts[i], add_special_tokens=False).ids
    group = bpe.MOST_CHARACTERS // 5
    for table, limit in ((own.words, packing.MAX_WORDS), (own.pieces_known, packing.MAX_PIECES)):
        assert len(table.young) + len(table.old) <= 2 * (limit + group)
    batch = pa.array(["a", None, "", *map(str, range(3 * packing.ROWS))])
    assert [*packing.texts_of(batch.slice(1))] == batch.to_pylist()[1:]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert [r["length"] for r in packing.token_pieces(docs, PATH).orderBy("doc_id").collect()] == [1, 1, 3]
