"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

A text becomes counts of its hashed byte n-grams (orders 1 to 4 over lower-cased letters, other
ASCII folded to blanks), damped, weighted by inverse document frequency and scaled to length 1.
Each language has several centroids, found by spherical k-means; the cosine to the best one is
the score, and a text farther than ``REJECT_BELOW`` from all centroids is rejected.

* null text, or no letter in it: language ``und``, score 0, rejected
* very long texts: counted whole, in runs
* repeated rows: each is predicted by itself, alike; empty table: no rows
* rows without a label, or none at all: nothing to learn from; then every language is ``und``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.storage import lean
from concordia.llm.text_kernel import mix

#: Bound of the sample that the classifier is fitted on: about as many rows of each language.
ROWS_PER_LANGUAGE = 800
#: Of a sampled row, texts beyond this many characters are passed over in the fit (never cut).
LONGEST_SAMPLE = 50_000
CENTROIDS = 4
FEATURES = 1 << 13
ORDERS = (1, 2, 3, 4)
#: Places of a text whose n-grams are counted at a time.
PART = 1 << 20
#: Cosine under which no centroid is near enough. Running text of a known language scores 0.3 and more, unknown scripts under 0.05.
REJECT_BELOW = 0.1
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:65] = 32
_FOLD[65:91] += 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def folded(text: bytes) -> np.ndarray:
    """The letters of a lower-cased text; whatever lies between is one blank, and so are its edges."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    return b[(b != 32) | np.concatenate([[True], b[:-1] != 32])]


def grams(letters: np.ndarray, starts: int) -> np.ndarray:
    """Hashed n-grams that begin at the first ``starts`` places."""
    b = letters.astype(np.uint64)
    out, code = [], np.zeros(len(b), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = code[: len(b) - n + 1] * np.uint64(256) + b[n - 1 :]
        if n in ORDERS and len(code):
            out.append(mix(code[:starts] * np.uint64(8) + np.uint64(n)) % np.uint64(FEATURES))
    return np.concatenate(out).astype(np.int64)


def counts(texts: list[bytes]) -> np.ndarray:
    """Damped counts, a row for each text."""
    rows = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        letters = folded(t)
        for at in range(0, len(letters), PART):
            rows[i] += np.bincount(grams(letters[at : at + PART + max(ORDERS) - 1], PART), minlength=FEATURES)
    return np.log1p(rows, out=rows)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # of each centroid, its place in languages
    centroids: np.ndarray  # scaled to length 1, weights of rarity included
    idf: np.ndarray

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the best language's place and its cosine."""
        cosine = _unit(counts(texts) * self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(texts)), best], 0, 1)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means that starts from mutually far rows; empty clusters go."""
    picked = [_unit(rows.sum(axis=0, keepdims=True))[0]]
    near = rows @ picked[0]
    for _ in range(min(k, len(rows)) - 1):
        far = rows[near.argmin()]
        picked.append(far)
        near = np.maximum(near, rows @ far)
    centres = np.stack(picked)
    for _ in range(rounds):
        of = (rows @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([rows[of == c].sum(axis=0) for c in range(len(centres)) if (of == c).any()]))
    return centres


def fit(labelled: list[tuple[str, str]]) -> Model:
    """From (text, language) rows; the order of the rows doesn't matter."""
    labelled = sorted(set(labelled))
    languages = sorted({lang for _, lang in labelled})
    if not labelled:
        return Model([], np.zeros(0, int), np.zeros((0, FEATURES), np.float32), np.ones(FEATURES, np.float32))
    rows = counts([t.lower().encode() for t, _ in labelled])
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    of = np.array([languages.index(lang) for _, lang in labelled])
    parts = [_kmeans(rows[of == i], CENTROIDS) for i in range(len(languages))]
    return Model(languages, np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)]), np.concatenate(parts).astype(np.float32), idf)


def training_rows(docs: DataFrame, of_training: Column, per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """The bounded sample: rows with a language, taken by a hash of their text at each language's own rate."""
    rows = docs.where(of_training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return []
    rate = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        rate = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(rate)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where((place < rate) & (F.length("text") <= LONGEST_SAMPLE)).distinct()
    return [(r.text, r.lang) for r in picked.collect()]


def fit_on(docs: DataFrame, of_training: Column) -> Model:
    return fit(training_rows(docs, of_training))


#: The columns that ``identify`` adds.
COLUMNS = ["lang_pred", "score", "rejected"]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds to ``docs`` the columns lang_pred, score and rejected (these names are taken over)."""
    docs = docs.select([c for c in docs.columns if c not in COLUMNS])
    schema = docs.selectExpr("*", "'' as lang_pred", "0d as score", "false as rejected").schema
    for f in schema.fields[-3:]:
        f.nullable = True
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x FEATURES floats

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield predicted(whole.slice(at, 256), shared.value)

    return docs.mapInArrow(run, schema)


def predicted(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
    lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
    if model.languages and lettered.any():
        texts = pc.utf8_lower(text.filter(pa.array(lettered)))
        best, cosine = model.scores([t.as_buffer().to_pybytes() for t in texts])
        lang[lettered], score[lettered] = np.array(model.languages, object)[best], cosine
    columns = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(score < REJECT_BELOW)]
    return pa.record_batch(columns, [*batch.schema.names, "lang_pred", "score", "rejected"])
