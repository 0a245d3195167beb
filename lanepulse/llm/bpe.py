"""Byte-level BPE by backtracking, with an offset table for decoding.

A text is cut where no token can cross: at added tokens and in front of a space that begins a
word. What lies between is split by the tokenizer's pattern into pieces, and a piece is
encoded without running merges: an Aho-Corasick automaton over the reversed tokens gives the
longest token at every start, and a token may follow another only if merging would have left
that border alone, which the pair table answers. Where no token fits, the last one is taken
back and its end marked as a dead end, so each position is settled once and a piece costs
time linear in its length, however long it is.

Many texts at once (`packed_all`, which packing uses) first gather the words that no table holds
and encode those together: short pieces are columns of a matrix in which numpy makes the earliest
merge of every column, round by round, with the pairs in a table of open addressing. Ids are those
of the single encoder.

Decoding copies bytes out of one buffer that holds all tokens, by an offset per token.

Each worker keeps what it has encoded in tables of bounded size, emptied when full; results
do not depend on them. One text is one row, nothing is shuffled.

Defined results: a null text is encoded like an empty one: no ids. Repeated rows are encoded
each. Columns of the documents pass through; the added columns replace equally named ones.
"""

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE splits a text; white space is Unicode's.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Entries in the young half of a worker's tables; an entry takes some 400 bytes.
MAX_WORDS, MAX_PIECES, MAX_PAIRS = 550_000, 250_000, 300_000
LONGEST_ENTRY = 64
#: Pieces up to this many bytes are merged side by side; texts are taken together up to so many characters.
LONGEST_COLUMN, MOST_CHARACTERS = 40, 500_000
#: Slots of the pair table (a power of two), the value of a pair that never merges, the hash's factor.
PAIR_BITS, NEVER, FACTOR = 18, 1 << 16, np.uint64(0x9E3779B97F4A7C15)
#: A space that may not begin a token of its own: more white space, or the end, follows.
UNSAFE = re.compile(r" (?=\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand
    for themselves, the rest are numbered from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Recent:
    """A table of the entries used of late: when the young half is full, the old one goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def put_all(self, entries: dict) -> None:
        """Many at once; the young half may hold so many more than its limit."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young.update(entries)


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, max_words: int | None = None, max_pieces: int | None = None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(SPLIT).findall
        # Tokens are numbered by the order in which merges make them, which the pair rule needs.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        bases = [t for t in vocab if len(t) == 1 and t in letters]
        names = bases + [a + b for a, b in merges]
        rank = {name: i for i, name in enumerate(names)}
        self.ids = [vocab[n] for n in names]
        self.size = [len(n) for n in names]
        self.halves = [(i, i) for i in range(len(bases))] + [(rank[a], rank[b]) for a, b in merges]
        self.made = {pair: len(bases) + i for i, pair in enumerate(self.halves[len(bases) :])}
        tokens = [raw(n).decode("latin-1") for n in names]
        self.longest = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.longest.add_word(t[::-1], i)
        self.longest.make_automaton()
        whole = {t: i for i, t in enumerate(tokens)}
        self.shorter = [
            next((whole[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in whole), -1) for t in tokens
        ]
        self.fits: dict[int, bool] = {}
        stored = {i: raw(t) for t, i in vocab.items() if t not in self.added} | {
            i: t.encode() for t, i in self.added.items()}
        parts = [stored.get(i, b"") for i in range(max(stored) + 1)]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        self.decimal = list(map(str, range(len(parts))))
        self.words, self.pieces_known = Recent(max_words or MAX_WORDS), Recent(max_pieces or MAX_PIECES)
        self._number_pairs([letters[t] for t in bases])

    def _number_pairs(self, bytes_of: list[int]) -> None:
        """The pair table as arrays: a pair lies in the first free slot from its hash on."""
        pairs = np.array(list(self.made), np.int64).reshape(-1, 2)
        keys, made = pairs[:, 0] << 16 | pairs[:, 1], np.fromiter(self.made.values(), np.int32)
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_made = np.full(1 << PAIR_BITS, NEVER, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.pair_keys[slots] < 0)
            first = free[np.unique(slots[free], return_index=True)[1]]
            self.pair_keys[slots[first]], self.pair_made[slots[first]] = keys[first], made[first]
            rest = np.delete(np.arange(len(keys)), first)
            keys, made, slots = keys[rest], made[rest], (slots[rest] + 1) & ((1 << PAIR_BITS) - 1)
        self.token_of_byte = np.zeros(256, np.int32)
        self.token_of_byte[bytes_of] = np.arange(len(bytes_of))
        self.id_of_token = np.array(self.ids, "<u4")

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * FACTOR >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _pair_made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, or `NEVER`."""
        keys = left.astype(np.int64) << 16 | right
        slots = self._slots(keys)
        seen = self.pair_keys[slots]
        out = np.where(seen == keys, self.pair_made[slots], np.int32(NEVER))
        again = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(again):
            slots[again] = (slots[again] + 1) & ((1 << PAIR_BITS) - 1)
            seen = self.pair_keys[slots[again]]
            hit = seen == keys[again]
            out[again[hit]] = self.pair_made[slots[again[hit]]]
            again = again[~hit & (seen >= 0)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pieces by merging. Every column that is not done loses one token a
        round, so all columns of a round have the same height, and pieces of that many bytes join."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > LONGEST_COLUMN:
                out[i] = array("I", self.encode_piece(piece)).tobytes()
            else:
                by_size.setdefault(len(piece), []).append(i)
        height = max(by_size, default=0)
        who, tokens, made = np.zeros(0, np.int64), np.zeros((height, 0), np.int32), np.zeros((max(height - 1, 0), 0), np.int32)
        for n in range(height, 0, -1):
            if n in by_size:
                data = np.frombuffer(b"".join([pieces[i] for i in by_size[n]]), np.uint8).reshape(-1, n)
                fresh = self.token_of_byte[data.T]
                who, tokens = np.concatenate((who, by_size[n])), np.hstack((tokens, fresh))
                pairs = self._pair_made(fresh[:-1].ravel(), fresh[1:].ravel())
                made = np.hstack((made, pairs.reshape(n - 1, len(data))))
            # The least (token, position): the earliest merge, the leftmost of equal ones.
            at = np.arange(n - 1, dtype=np.int32)[:, None]
            best = (made << 8 | at).min(axis=0) if n > 1 else np.full(len(who), NEVER << 8, np.int32)
            live = best < NEVER << 8
            done = np.flatnonzero(~live)
            ids = self.id_of_token[tokens[:, done].T].tobytes()
            for k, i in enumerate(who[done].tolist()):
                out[i] = ids[4 * n * k : 4 * n * (k + 1)]
            if n == 1:
                break
            who, tokens, made, best = who[live], tokens[:, live], made[:, live], best[live]
            place, token, column = best & 255, best >> 8, np.arange(len(who))
            tokens = np.where(at > place, tokens[1:], tokens[:-1])
            tokens[place, column] = token
            made = np.where(at[:-1] > place, made[1:], made[:-1])
            before, after = np.flatnonzero(place > 0), np.flatnonzero(place < n - 2)
            made[place[before] - 1, before] = self._pair_made(tokens[place[before] - 1, before], token[before])
            made[place[after], after] = self._pair_made(token[after], tokens[place[after] + 1, after])
        return out

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one edge of a token (0 left, 1 right) while merges build it, in time
        order: each part with the merge that swallows it, for the token itself none."""
        parts = [(token, len(self.halves))]
        while (part := self.halves[parts[-1][0]][side]) != parts[-1][0]:
            parts.append((part, parts[-1][0]))
        return parts[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens. Merges happen in the
        order of token numbers, so time is replayed: at any moment one part of each token
        touches the border, and the border falls if the merge of these two comes before either
        is swallowed. Of equal merges the leftmost comes first: one inside `left` wins over one
        across the border, which wins over one inside `right`."""
        before, after = iter(self._edge(left, 1)), iter(self._edge(right, 0))
        (x, x_goes), (y, y_goes) = next(before), next(after)
        end = len(self.halves)
        while True:
            across = self.made.get((x, y), end)
            if across < x_goes and across <= y_goes:
                return False
            if x_goes == y_goes == end:
                return True
            if x_goes <= y_goes:
                x, x_goes = next(before)
            else:
                y, y_goes = next(after)

    def _joins(self, left: int, right: int) -> bool:
        """The pair rule for a pair that `fits` does not hold yet."""
        if len(self.fits) >= MAX_PAIRS:
            self.fits.clear()
        answer = self.fits[left << 32 | right] = self.compatible(left, right)
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """A depth-first search for the one chain of tokens whose neighbours all join. From each
        position tokens are tried longest first; a position from which none leads on is a dead
        end for good."""
        n, size, shorter, known, joins = len(piece), self.size, self.shorter, self.fits.get, self._joins
        # Of the matches that start at a position the longest is found first, so it is kept last.
        matches = dict([*self.longest.iter(piece.decode("latin-1")[::-1])][::-1])
        longest = [*map(matches.__getitem__, range(n - 1, -1, -1)), -1]
        dead, chain, at, last, choice = bytearray(n + 1), [], 0, -1, longest[0]
        while at < n:
            while choice >= 0:
                if not dead[at + size[choice]]:
                    if last < 0 or (fit := known(last << 32 | choice)) or (fit is None and joins(last, choice)):
                        break
                choice = shorter[choice]
            if choice >= 0:
                chain.append(choice)
                at += size[choice]
                last, choice = choice, longest[at]
            else:
                dead[at] = 1
                undone = chain.pop()
                at -= size[undone]
                last, choice = chain[-1] if chain else -1, shorter[undone]
        return [*map(self.ids.__getitem__, chain)]

    def _piece(self, piece: str) -> bytes:
        packed = self.pieces_known.get(piece)
        if packed is None:
            packed = array("I", self.encode_piece(piece.encode())).tobytes()
            if len(piece) <= LONGEST_ENTRY:
                self.pieces_known.put(piece, packed)
        return packed

    def _word(self, word: str) -> bytes:
        """Ids of a space and what follows it up to the next one."""
        packed = self.words.get(word)
        if packed is None:
            packed = b"".join(map(self._piece, self.pieces(" " + word)))
            if len(word) <= LONGEST_ENTRY:
                self.words.put(word, packed)
        return packed

    def _section(self, section: str) -> bytes:
        if not section:
            return b""
        first, *rest = section.split(" ")
        if UNSAFE.search(section) is None:
            packed = list(map(self.words.young.get, rest))
            if None in packed:
                packed = [p or self._word(w) for p, w in zip(packed, rest)]  # noqa: B905
            return b"".join([*map(self._piece, self.pieces(first)), *packed])
        return b"".join(map(self._piece, self.pieces(section)))

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        text = text or ""
        if not any(a in text for a in self.added):
            return self._section(text)
        return b"".join([
            array("I", [self.added[s]]).tobytes() if s in self.added else self._section(s)
            for s in self.at_added.split(text)
        ])

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words that follow a space."""
        if not words:
            return {}
        pieces = self.pieces(" " + " ".join(words))
        found = {p: self.pieces_known.get(p) for p in dict.fromkeys(pieces)}
        new = [p for p, packed in found.items() if packed is None]
        learned = dict(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        found.update(learned)
        self.pieces_known.put_all({p: packed for p, packed in learned.items() if len(p) <= LONGEST_ENTRY})
        packed = [*map(found.__getitem__, pieces)]
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        return {word: packed[a] if b == a + 1 else b"".join(packed[a:b])
                for word, a, b in zip(words, starts, [*starts[1:], len(pieces)], strict=True)}

    def packed_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """`packed` of each text; the new words of some half a million characters are encoded at once."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= MOST_CHARACTERS:
                yield from self._packed_group(group)
                group, size = [], 0
        yield from self._packed_group(group)

    def _packed_group(self, texts: list[str]) -> Iterator[bytes]:
        known, out, gaps, absent = self.words.young.get, [], [], set()
        for text in texts:
            if UNSAFE.search(text) is not None or any(a in text for a in self.added):
                out.append([self.packed(text)])
                gaps.append(())
                continue
            words = text.split(" ")
            packed = [*map(known, words)]
            packed[0] = b"".join(map(self._piece, self.pieces(words[0])))
            gap = [(i, words[i]) for i, p in enumerate(packed) if p is None] if None in packed else ()
            absent.update([w for _, w in gap])
            out.append(packed)
            gaps.append(gap)
        seen = {w: p for w in absent if (p := self.words.old.get(w)) is not None}
        seen.update(self._encode_words([w for w in absent if w not in seen]))
        self.words.put_all({w: p for w, p in seen.items() if len(w) <= LONGEST_ENTRY})
        for packed, gap in zip(out, gaps, strict=True):
            for i, word in gap:
                packed[i] = seen[word]
            yield b"".join(packed)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def digest(self, ids: np.ndarray) -> str:
        """The SHA-256 of the ids in decimal, joined by commas."""
        return sha256(",".join(map(self.decimal.__getitem__, ids.tolist())).encode()).hexdigest()

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(size) - size
        index = np.repeat(start - before, size) + np.arange(int(size.sum()))
        return self.buffer[index].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, max_words: int | None = None, max_pieces: int | None = None) -> Codec:
    """One codec per worker, file and size of tables."""
    return Codec(path, max_words, max_pieces)


def _added(docs: DataFrame, column: Callable, names: list[str]) -> DataFrame:
    out = docs.select(F.struct("*").alias("_doc"), column.alias("_new"))
    return out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in names],
                      *[F.col(f"_new.{n}").alias(n) for n in names])


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Documents with `ids`, an array of token ids."""

    @F.pandas_udf("ids array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"ids": [codec(path).encode(t).astype(np.int32) for t in part]})

    return _added(docs, ids(F.col(text)), ["ids"])


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Rows with `decoded`, the text of their ids."""

    @F.pandas_udf("decoded string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"decoded": [codec(path).decode(() if i is None else i) for i in part]})

    return _added(encoded, texts(F.col(ids)), ["decoded"])


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Documents with the number of ids, their digest, and the digest of the text decoded from
    them, in one pass that moves no ids."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in parts:
            rows = []
            for t in part:
                ids = own.encode(t)
                rows.append((len(ids), own.digest(ids), sha256(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return _added(docs, digests(F.col(text)), ["n_tokens", "ids_sha256", "decoded_sha256"])
