"""Language identification in two steps: the family, then the language within it.

Texts become counts of hashed letter pairs and triples over the whole text, damped by a square
root and scaled to unit length. A linear support vector machine against the rest picks the
family; within it one machine for each two languages votes. Machines are fitted on the driver
with numpy on a bounded sample: at most `per_language` rows of each of the `most_languages`
most frequent labels, chosen by the hash of their id. Prediction is one pass without shuffles
that sees nothing but the text.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text
if nothing could be learned. Rows without a label, or with a null or letterless text, teach
nothing. Languages of no known family are a family each. Repeated rows get equal results.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 4096
PER_LANGUAGE, MOST_LANGUAGES = 400, 100
UNKNOWN = "und"
#: Language families by language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
    "semitic": ("ar", "he", "am", "mt"),
}
PLAIN = np.full(256, 0x20, np.uint8)  # bytes of letters stay, all else is a space
PLAIN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
PLAIN[0x80:] = np.arange(0x80, 0x100)


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def features(text: str | None) -> np.ndarray | None:
    """A unit vector, or None if there is no letter."""
    if not text or not any(map(str.isalpha, text)):  # letters alone, as \p{L}: no other numerals
        return None
    data = PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    pairs = data[:-1] << np.uint32(8) | data[1:]
    triples = pairs[:-1] << np.uint32(8) | data[2:]
    counts = np.zeros(SIZE)
    for grams, factor in ((pairs, 0x9E3779B1), (triples, 0x85EBCA77)):
        counts += np.bincount((grams * np.uint32(factor)) >> np.uint32(20), minlength=SIZE)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 30.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated descent;
    y is +1 or -1, and both sides weigh the same."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    cost, step = np.float32(cost), np.float32(1 / (1 + 4 * cost))  # inputs have length sqrt(2) at most
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for i in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ ahead)) * weight
        new = ahead - step * (ahead - 2 * cost * (x.T @ (y * miss)))
        ahead, w = new + np.float32(i / (i + 3)) * (new - w), new
    return w


class Model:
    """Family machines and, per family, a machine for each two languages."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        labels = np.array(labels, dtype=object)
        groups = np.array([family_of(lang) for lang in labels], dtype=object)
        self.families = sorted(set(groups))
        self.members = {f: sorted(set(labels[groups == f])) for f in self.families}
        self.outer = np.stack([fit_machine(x, np.where(groups == f, 1, -1)) for f in self.families])
        self.inner = {}
        for langs in self.members.values():
            for i, a in enumerate(langs):
                for b in langs[i + 1 :]:
                    own = (labels == a) | (labels == b)
                    self.inner[a, b] = fit_machine(x[own], np.where(labels[own] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, np.float32(1))
        outer = self.outer @ x
        best = int(outer.argmax())
        langs, score = self.members[self.families[best]], 1.0
        if len(outer) > 1:
            score = 1 / (1 + np.exp(-2 * (outer[best] - np.delete(outer, best).max())))
        margins = {(a, b): float(self.inner[a, b] @ x) for i, a in enumerate(langs) for b in langs[i + 1 :]}
        against = {lang: [m if a == lang else -m for (a, b), m in margins.items() if lang in (a, b)] for lang in langs}
        chosen = max(langs, key=lambda lang: (sum(m > 0 for m in against[lang]), sum(against[lang])))
        if against[chosen]:
            score /= 1 + np.exp(-2 * min(against[chosen]))
        return chosen, float(score)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """A model from a bounded sample of the rows; None if no row can teach."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(most_languages).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, 2 * per_language / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit(11), "i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(draw <= F.try_element_at(share, F.col("l")))
    first = Window.partitionBy("l").orderBy("d", "h")
    drawn = drawn.select("i", "l", F.xxhash64(F.lit(12), "i").alias("d"), F.xxhash64("t").alias("h"), "t")
    drawn = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (x := features(t)) is None else x.tobytes() for t in texts], dtype=object)

    sample = drawn.select("l", packed("t").alias("x")).where("x IS NOT NULL").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["l"], bytes(r["x"])))
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in sample]), [r["l"] for r in sample])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Documents with `lang_pred` and `score`, which replace equally named columns."""
    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for value in part:
                x = features(value) if model is not None else None
                out.append((UNKNOWN, 0.0) if x is None else model.predict(x))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    both = docs.select(F.struct("*").alias("_doc"), predicted(F.col(text)).alias("_new"))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return both.select(*[F.col(f"_doc.`{c}`").alias(c) for c in kept], "_new.lang_pred", "_new.score")
