"""Operator 9: language identification with a string kernel, Nystroem landmarks and ridge regression.

The kernel counts the character n-grams of 1 to ``LONGEST`` code points that two texts have in
common (presence, blended over the lengths), normalised by both texts' own numbers of n-grams. A
bounded sample of labelled texts is drawn; some of it are the landmarks. With the landmark kernel
matrix the sample is mapped to ``W^(-1/2)`` features, and one ridge regression for each language
against the rest is solved in closed form. A text is scored by its n-grams' weights, the landmark matrix
times the regression weights, one sparse product for a block of texts; with many languages by the kernel values of a block with the landmarks.

``score`` shares one out over the learned languages, so its size depends on their number. ``known`` does not: it is
the share of the text's n-grams of ``LONG`` and more code points, digits and signs left out, that the landmarks of the answer's language hold,
as a part of the median share of that language's other labelled rows (of a landmark: in the other landmarks).

Defined cases: a null text, or one without a letter, is ``und`` with score and known 0; a language whose
labelled rows have nothing in common (one row, say) has no usual share, and known is 1; rows are independent, so
repeated rows get equal answers; ties go to the language first by name; no labelled rows at all, or
an empty table: every row is ``und``. Only ``text`` is read to predict; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.llm import shared
from telespark.llm.shared import slices

LONGEST = 4             # code points of the longest n-gram
LONG = 3                # code points of the shortest n-gram that tells languages from noise
SAMPLE = 400            # labelled texts for each language (the bound of the sample)
LANDMARKS = 40          # of them landmarks
LANGUAGES = 64          # so many languages have full samples; of more, each has fewer rows and landmarks, at least one
SAMPLE_CHARS = 4000     # texts of SAMPLE_LEAST to so many characters are drawn first, those over 25 times that last
SAMPLE_LEAST = 40
RIDGE = 1e-3
SHARP = 8.0             # steepness of the score over regression values
BLOCK = 256             # sampled texts mapped to features at once
PRODUCT = 1 << 25       # numbers of the product of presence and weights, if it is held
PRODUCT_CHARS = 1 << 16 # characters of the texts scored by one product (a longer text alone)
UNKNOWN = "und"
SIGNS = regex.compile(r"[\p{N}\p{P}\p{S}\p{C}]+")


def grams(text: str) -> np.ndarray:
    """Distinct n-grams of the lower-cased text as 64-bit codes, white space as one blank; ascending."""
    text = " " + " ".join(text.lower().split()) + " "
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out, code = [], np.zeros(len(letters), dtype=np.uint64)
    for n in range(LONGEST):
        size = len(letters) - n
        if size < 1:
            break
        code = ((code[:size] ^ (code[:size] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + letters[n:]) * np.uint64(8) + np.uint64(n)
        out.append(code)
    codes = np.sort(np.concatenate(out))
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def long(text: str) -> np.ndarray:
    """The n-grams of LONG and more code points of a text without digits and signs; the last bits of a code are its length less one."""
    codes = grams(SIGNS.sub(" ", text))
    return codes[(codes & np.uint64(7)) >= LONG - 1]


def share(codes: np.ndarray, own: np.ndarray) -> float:
    """The part of ``codes`` that is in ``own``, both ascending."""
    if not len(codes) or not len(own):
        return 0.0
    return float((own[np.minimum(np.searchsorted(own, codes), len(own) - 1)] == codes).mean())


class Model:
    """Landmark n-grams, the landmarks that hold each of them, and the regression weights of the landmarks."""

    def __init__(self, texts: list[str], languages: list[str]):
        self.languages = sorted(set(languages))
        place = {x: k for k, x in enumerate(self.languages)}
        label = np.array([place[x] for x in languages])
        held = max(1, min(LANDMARKS, LANGUAGES * LANDMARKS // len(self.languages)))
        order = np.argsort(label, kind="stable")
        rows = np.split(order, np.cumsum(np.bincount(label))[:-1])                  # of each language
        marks = np.concatenate([x[:held] for x in rows])
        sets = [grams(texts[i]) for i in marks]
        self.grams = np.unique(np.concatenate(sets))
        self.scale = np.array([1 / np.sqrt(len(x)) for x in sets])
        # presence is held sparse: the landmarks of n-gram g are self.marks[self.start[g]:self.start[g + 1]]
        at = np.concatenate([np.searchsorted(self.grams, x) for x in sets])
        by_gram = np.argsort(at, kind="stable")
        self.marks = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[by_gram]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.grams)))])
        del at, by_gram

        self.own, self.usual = [], []
        for x in rows:
            mine = {texts[i]: long(texts[i]) for i in x[:held]}
            others = {texts[i]: long(texts[i]) for i in x[held:] if texts[i] not in mine}
            own, times = np.unique(np.concatenate(list(mine.values())), return_counts=True)
            self.own.append(own)
            self.usual.append(float(np.median([share(y, own[times > 1]) for y in mine.values()] + [share(y, own) for y in others.values()])))

        values, vectors = np.linalg.eigh(np.stack([self.kernel(x) for x in sets]))
        good = values > 1e-6 * values.max()
        half = vectors[:, good] / np.sqrt(values[good])                              # W^(-1/2) on its range
        balance = 1 / np.bincount(label)
        size = half.shape[1] + 1
        inner, outer = np.zeros((size, size)), np.zeros((size, len(self.languages)))
        for low in range(0, len(texts), BLOCK):                                      # the sample's features are never held at once
            block = range(low, min(low + BLOCK, len(texts)))
            z = np.concatenate([np.stack([self.kernel(grams(texts[i])) for i in block]) @ half, np.ones((len(block), 1))], axis=1)
            weighted = (z * balance[label[block], None]).T
            inner += weighted @ z
            outer += weighted @ np.where(label[block, None] == np.arange(len(self.languages)), 1.0, -1.0)
        penalty = RIDGE * np.eye(size)
        penalty[-1, -1] = 0
        weights = np.linalg.solve(inner + penalty, outer)
        self.bias = weights[-1]
        self.alpha = half @ weights[:-1]                                             # landmarks by languages
        #: while that is small: landmark presence and regression weights multiplied once, n-grams by languages
        self.weights = None
        if len(self.grams) * len(self.languages) <= PRODUCT:
            self.weights = np.zeros((len(self.grams), len(self.languages)), dtype=np.float32)
            for codes, scale, alpha in zip(sets, self.scale, self.alpha):
                self.weights[np.searchsorted(self.grams, codes)] += (scale * alpha).astype(np.float32)

    def found(self, codes: np.ndarray) -> np.ndarray:
        """Places of those ``codes`` that are landmark n-grams."""
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        return at[self.grams[at] == codes]

    def kernel(self, codes: np.ndarray) -> np.ndarray:
        """Kernel values with all landmarks."""
        at = self.found(codes)
        low, n = self.start[at], self.start[at + 1] - self.start[at]
        places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.marks[places], minlength=len(self.scale)) * self.scale / np.sqrt(len(codes))

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values, texts by languages: one product of the texts' sparse presence with the weights, or of their kernel values with the landmarks'."""
        scale = 1 / np.sqrt([len(x) for x in sets])[:, None]
        if self.weights is None:
            return np.stack([self.kernel(x) for x in sets]) @ self.alpha + self.bias
        found = [self.found(x) for x in sets]
        sizes = np.array([len(x) for x in found])
        have, out = np.flatnonzero(sizes), np.zeros((len(sets), len(self.languages)))
        if len(have):
            out[have] = np.add.reduceat(self.weights[np.concatenate(found)], np.cumsum(sizes[have]) - sizes[have], axis=0, dtype=np.float64)
        return out * scale + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, scores, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        able = [i for i, text in enumerate(texts) if text and any(map(str.isalpha, text))]
        for low, high in slices([texts[i] for i in able], PRODUCT_CHARS):
            block = able[low:high]
            values = self.values([grams(texts[i]) for i in block])
            best = values.argmax(axis=1)
            scores[block] = 1 / np.exp(SHARP / 2 * (values - values.max(axis=1, keepdims=True))).sum(axis=1)
            for i, k in zip(block, best.tolist()):
                names[i] = self.languages[k]
                known[i] = share(long(texts[i]), self.own[k]) / self.usual[k] if self.usual[k] else 1
        return names, scores, known


def fit(labelled: DataFrame) -> Model | None:
    """A model of a bounded sample of (doc_id, text, lang) rows: every language with at most ``SAMPLE`` rows, fewer where there are over ``LANGUAGES``.

    Rows are drawn by a hash of the doc_id, those without one by a hash of the row, without their texts; then the
    texts of the drawn rows are fetched.
    """
    rows = labelled.where("lang is not null and text is not null").withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    size = F.length("text")
    late = F.when((size >= SAMPLE_LEAST) & (size <= SAMPLE_CHARS), 0).when(size <= 25 * SAMPLE_CHARS, 1).otherwise(2)
    lot = F.when(F.col("doc_id").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id"))
    slim = rows.select("doc_id", "lang", "key", late.alias("late"), lot.alias("lot"))
    # the rank limit is applied within tasks before rows of a language meet
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("late", "lot", "doc_id", "key"))
    drawn = slim.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "rank", "key").collect()
    if not drawn:
        return None
    most = max(1, SAMPLE * LANGUAGES // len({r.lang for r in drawn}))
    keys = [r.key for r in drawn if r["rank"] <= most]
    # of a longer text the middle is enough to learn from
    text = F.when(size > SAMPLE_CHARS, F.substring("text", F.floor((size - SAMPLE_CHARS) / 2).cast("int") + 1, F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    found = rows.where(F.col("key").isin(keys)).select("doc_id", "lang", text.alias("text"), lot.alias("lot")).distinct() \
        .orderBy("lot", "doc_id", "lang", "text").drop("lot").limit(len(keys)).collect()
    return Model([r.text for r in found], [r.lang for r in found])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``language`` (lang_pred, score, known); the model has at most LANGUAGES * LANDMARKS landmarks, or one a language."""
    if model is None:
        return docs.withColumn("language", F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("known")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())]))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shared.forget()
        for texts in batches:
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "known"), sent.value.predict(texts.tolist()))))

    return docs.withColumn("language", score(F.col(text).cast("string")))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
