"""Language identification with string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
HELD_OUT = 5
# Bounds of what a classifier is fitted on: rows per language, rows, landmarks per language. Whole texts
# are read of each, and all n-grams of the landmarks are kept.
ROWS_PER_LANGUAGE = 256
ROWS = 4096
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-2
# Rows of a language are ranked in this many lanes before the survivors are.
LANES = 16
# Texts whose kernel rows are multiplied at once, and cells of their matrix.
BATCH, CELLS = 256, 1 << 24
# A text is of its language if it shares with the landmarks this part of the share of 3-grams that all but
# the least twentieth of the language's own rows have in common with landmarks other than themselves.
KIN, LEAST_ROWS = 0.5, 0.05

LETTER = regex.compile(r"\p{L}")
# N-grams are over the bytes of the lower-cased text; ASCII other than letters counts as a space.
PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
# Where the codes of 1-, 2- and 3-grams begin, and how many codes there are.
STARTS = (0, 1 << 8, (1 << 8) + (1 << 16))
CODES = STARTS[2] + (1 << 24)


def gram_codes(text: str) -> np.ndarray:
    """The codes of all 1-, 2- and 3-grams of a whole text, in place and with repeats."""
    data = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split())
    one = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.int32)
    two = (one[:-1] << 8) + one[1:]
    three = (two[:-1] << 8) + one[2:]
    return np.concatenate([one + STARTS[0], two + STARTS[1], three + STARTS[2]])


@dataclass
class Classifier:
    """Landmarks as rows of n-gram presence, and the weights of their kernel values.

    The kernel of two texts is the number of n-grams both have over the root of the product of how
    many each has: a blended-spectrum presence kernel, over the n-grams of the landmarks.
    """

    languages: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    # Per language which codes its landmarks have, and the share of 3-grams its own rows have in common with them.
    own: np.ndarray
    usual: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_place"}

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The places of n-gram codes among the landmarks' codes; behind the last for those no landmark has."""
        if not hasattr(self, "_place"):
            self._place = np.full(CODES, len(self.codes), np.int32)
            self._place[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return self._place[codes]

    def presence(self, texts: list[str]) -> np.ndarray:
        """One row per text, scaled to length 1."""
        found = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for row, text in zip(found, texts, strict=True):
            row[self.places(gram_codes(text))] = 1
        return _scaled(found[:, :-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.presence(texts) @ self.landmarks.T @ self.weights + self.offset

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 if it is null or has no letter."""
        found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t is not None and self.languages and LETTER.search(t)]
        step = max(1, min(BATCH, CELLS // (len(self.codes) + 1)))
        for at in range(0, len(known), step):
            part = known[at : at + step]
            scores = self.scores([texts[i] for i in part])
            for i, k in zip(part, scores.argmax(axis=1), strict=True):
                found[i] = self.languages[k]
            score[part] = np.clip(scores.max(axis=1), 0, 1)
        return found, score

    def kin(self, text: str, language: str) -> float:
        """The share of a text's 3-grams that landmarks of a language have, over what is usual for it."""
        codes = gram_codes(text)
        codes = codes[codes >= STARTS[2]]
        number = self.languages.index(language)
        if not len(codes) or not self.usual[number]:
            return 1.0
        return float(np.append(self.own[number], False)[self.places(codes)].mean() / self.usual[number])

    def recognised(self, texts: list[str | None], least: float = KIN) -> list[bool]:
        """Whether each text has a letter and enough in common with the landmarks of its language."""
        found, _ = self.classify(texts)
        return [name != UNKNOWN and self.kin(text, name) >= least for text, name in zip(texts, found, strict=True)]


def _scaled(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def fitted(grams: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE) -> Classifier:
    """Fit on distinct n-gram codes of texts with known language, in an order that does not matter to them.

    The first `landmarks` of each language are the landmarks. Kernel values with them, times the root
    of the inverse of their own kernel matrix, are the features (Nyström); ridge regression on
    them, one language against the rest, gives the weights. Both products are folded into one.
    """
    names = sorted(set(languages))
    chosen = [i for name in names for i in [i for i, x in enumerate(languages) if x == name][:landmarks]]
    if not chosen:
        none = np.empty((0, 0))
        return Classifier([], np.empty(0, np.int32), none, none, np.empty(0), none, np.empty(0))
    codes = np.unique(np.concatenate([grams[i] for i in chosen]))
    landmark_codes, usual = _kinship(grams, languages, names, chosen, codes)
    rows = np.zeros((len(grams), len(codes)), np.float32)
    for row, own in zip(rows, grams, strict=True):
        row[np.searchsorted(codes, own[np.isin(own, codes)])] = 1
    rows = _scaled(rows)
    marks = rows[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    sound = values > 1e-6 * values.max()
    root = vectors[:, sound] / np.sqrt(values[sound])
    features = (rows @ marks.T).astype(float) @ root
    wanted = np.array([[float(x == name) for name in names] for x in languages])
    # Every language weighs the same in the fit, however many rows it has.
    weight = (1 / wanted.sum(axis=0))[[names.index(x) for x in languages]][:, None] / len(names)
    middle, mean = (weight * features).sum(axis=0), (weight * wanted).sum(axis=0)
    centred = features - middle
    inner = centred.T @ (weight * centred)
    ridge = RIDGE * np.trace(inner) / max(len(inner), 1) + 1e-12
    beta = np.linalg.solve(inner + ridge * np.eye(len(inner)), centred.T @ (weight * (wanted - mean)))
    return Classifier(names, codes, marks, (root @ beta).astype(np.float32), mean - middle @ beta, landmark_codes, usual)


def _kinship(grams, languages, names, chosen, codes) -> tuple[np.ndarray, np.ndarray]:
    """Per language the codes of its landmarks, and the share of 3-grams its rows have in common with them.

    A landmark is held against the other landmarks. Of a language's shares the one above the least twentieth
    counts, so a few rows with a wrong label don't matter; it does not depend on the other languages.
    """
    own, usual, marks = np.zeros((len(names), len(codes)), bool), np.zeros(len(names)), set(chosen)
    for number, name in enumerate(names):
        rows = [i for i, x in enumerate(languages) if x == name]
        times = np.zeros(len(codes) + 1, np.int64)
        for i in rows:
            if i in marks:
                times[np.searchsorted(codes, grams[i])] += 1
        own[number] = times[:-1] > 0
        shares = []
        for i in rows:
            three = grams[i][grams[i] >= STARTS[2]]
            place = np.searchsorted(codes, three)
            place[codes[np.minimum(place, len(codes) - 1)] != three] = len(codes)
            if len(three):
                shares.append((times[place] > (i in marks)).mean())
        if len(shares) > 1:
            usual[number] = np.quantile(shares, LEAST_ROWS, method="lower")
    return own, usual


def held_out(id_column: Column) -> Column:
    """Rows that no classifier learns from; a null id is not held out, but not learnt from either."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(HELD_OUT)) == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Fit on at most ROWS_PER_LANGUAGE rows of each language and ROWS in all; repeated rows count once.

    Taken are the rows with the least hash of id and text among those that are not held out and have
    id, language and a letter in the text. Tasks turn the texts into n-gram codes; only these and
    the languages come to the driver, a bounded number of rows.
    """
    able = docs.filter(
        F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).rlike(r"\p{L}")
    ).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("draw"), F.col(text_col).alias("text"))
    best = Window.partitionBy("lang").orderBy("draw")
    # Within a lane first, so that no task ever has more than LANES times the rows that are taken of a language.
    in_lane = Window.partitionBy("lang", "lane").orderBy("draw")
    lanes = able.select("lang", "draw", F.pmod(F.col("draw"), F.lit(LANES)).alias("lane")).distinct()
    drawn = lanes.withColumn("place", F.row_number().over(in_lane)).filter(F.col("place") <= ROWS_PER_LANGUAGE)
    drawn = drawn.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= ROWS_PER_LANGUAGE)
    drawn = drawn.orderBy("place", "lang").limit(ROWS).select("lang", "draw")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            grams = [np.unique(gram_codes(t)).astype("<i4").tobytes() for t in rows["text"]]
            yield pd.DataFrame({"lang": rows["lang"], "draw": rows["draw"], "grams": grams})

    once = able.join(drawn, ["lang", "draw"], "left_semi").dropDuplicates(["lang", "draw"])
    sample = once.mapInPandas(coded, "lang string, draw long, grams binary")
    rows = sorted({(r.lang, r.draw, bytes(r.grams)) for r in sample.collect()})
    return fitted([np.frombuffer(g, "<i4") for _, _, g in rows], [lang for lang, _, _ in rows])


def classified(classifier: Classifier, text: Column) -> Column:
    """Struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found, score = classifier.classify([None if t is None else t for t in texts])
            yield pd.DataFrame({"lang_pred": found, "score": score})

    return predict(text)


def predictions(
    docs: DataFrame, classifier: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Per row of `docs`: id_col, held_out, lang_pred, score (0 to 1).

    lang_pred is a language learnt from `docs`, or UNKNOWN with score 0 where the text is null or has
    no letter, or where there was nothing to learn from. Rows are classified on their own, by their
    whole text alone.
    """
    classifier = classifier or train(docs, id_col, text_col, lang_col)
    return docs.select(
        F.col(id_col), held_out(F.col(id_col)).alias("held_out"), classified(classifier, F.col(text_col)).alias("found")
    ).select(id_col, "held_out", "found.lang_pred", "found.score")


def identified(docs: DataFrame, least: float = KIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, all columns, that have a letter and are in a language that the labelled rows teach.

    A text is in the language predicted for it if the share of its 3-grams that the language's landmarks have is
    at least `least` of what is usual for that language's own rows. How many languages there are, or how close
    they are, plays no part. Null texts, texts without a letter, and all rows of a table without labels go; of a
    language with one labelled row nothing else is known, so what is taken for it stays. Rows are judged one by one,
    so repeated rows stay or go together; columns may have any names.
    """
    classifier = train(docs, id_col, text_col, lang_col)

    @F.pandas_udf("boolean")
    def recognised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(classifier.recognised([None if t is None else t for t in texts], least), dtype=bool)

    rows = docs.alias("docs").select(F.struct("docs.*").alias("row"), recognised(F.col(f"docs.`{text_col}`")).alias("stays"))
    return rows.filter("stays").select("row.*")
