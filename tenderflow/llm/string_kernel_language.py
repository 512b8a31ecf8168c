"""Language identification by a string kernel: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest ridge regression.

A text is the set of its byte n-grams of lengths 1 to `LENGTHS`, taken from the lower-cased text. The presence kernel of two texts is the
number of n-grams both have, over the square roots of their own counts. Only n-grams that some landmark has are looked at, so a batch of texts is a 0/1 matrix over those, and its kernel values are one matrix product. The Nyström map turns kernel
values into features, and ridge regression, one language against the rest, turns features into scores; both are one more product.

The classifier is fitted on a bounded sample of the labelled rows, drawn by a hash of their ids: about `TRAIN` texts of each language,
or all of them where there are fewer; `LANDMARKS` of them are landmarks. Every text is classified as a whole.

Nulls: a null text or one without a letter is `und` with score 0. Rows without a language are classified, not learned from. Ties go to
the first language in alphabetical order. With nothing to learn from, every text is `und`. Only id, text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import table, uniform
from tenderflow.llm.tokens import in_batches

LENGTHS = 4
#: Sample of labelled rows: texts, and landmarks, of each language.
TRAIN, LANDMARKS = 400, 24
RIDGE = 1e-2
#: Texts and bytes in one matrix product.
BATCH_TEXTS, BATCH_BYTES = 64, 400_000
LETTER = regex.compile(r"\p{L}")
SLOTS = 20


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # per length, the sorted keys of the landmarks' n-grams
    slots: list[np.ndarray]  # per length, key slot -> number of the n-gram, or -1
    clashes: list[np.ndarray]  # per length, the keys whose slot another n-gram has
    weights: np.ndarray  # (n-grams, landmarks), 0 or 1 over the landmark's norm
    scores: np.ndarray | None = None  # (n-grams, languages): the kernel, the Nyström map and the regression in one
    bias: np.ndarray | None = None


def keys(data: np.ndarray, length: int) -> np.ndarray:
    """The n-grams of a byte array as numbers, exact up to four bytes."""
    out = data[: len(data) - length + 1].astype(np.uint32)
    for j in range(1, length):
        out = (out << np.uint32(8)) | data[j : len(data) - length + 1 + j]
    return out


def slot(k: np.ndarray) -> np.ndarray:
    return (k * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def present(model: Model, texts: list[bytes]) -> np.ndarray:
    """0/1 rows over the model's n-grams. N-grams over the edge of two texts are left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    out = np.zeros((len(texts), len(model.weights)), np.float32)
    first = 0
    for length in range(1, LENGTHS + 1):
        grams = model.grams[length - 1]
        if len(data) >= length and len(grams):
            k = keys(data, length)
            number = model.slots[length - 1][slot(k)]
            at = np.flatnonzero(number >= 0)
            number = number[at]
            good = (grams[number] == k[at]) & (doc[at] == doc[at + length - 1])
            out[doc[at[good]], first + number[good]] = 1
            # Keys that share a slot with another n-gram of the model.
            clash = model.clashes[length - 1]
            if len(clash):
                at = at[~good & (doc[at] == doc[at + length - 1])]
                place = np.minimum(np.searchsorted(clash, k[at]), len(clash) - 1)
                hit = clash[place] == k[at]
                out[doc[at[hit]], first + np.searchsorted(grams, clash[place[hit]])] = 1
        first += len(grams)
    return out


def times(model: Model, texts: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """Rows of n-grams over their norm, times a matrix: with the weights, kernel values; with the scores, those of the languages."""
    x = present(model, texts)
    return (x @ matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """rows: (language, text) in a fixed order."""
    rows = [(lang, lowered(t)) for lang, t in rows if t and LETTER.search(t)]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    marks = [t for lang in languages for t in [t for own, t in rows if own == lang][:landmarks]]
    grams, slots, clashes = [], [], []
    for length in range(1, LENGTHS + 1):
        own = [np.unique(keys(np.frombuffer(t, np.uint8), length)) for t in marks if len(t) >= length]
        own = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint32)
        to = np.full(1 << SLOTS, -1, np.int32)
        to[slot(own)[::-1]] = np.arange(len(own), dtype=np.int32)[::-1]
        grams.append(own)
        slots.append(to)
        clashes.append(own[to[slot(own)] != np.arange(len(own))])
    model = Model(languages, grams, slots, clashes, np.zeros((sum(map(len, grams)), 0), np.float32))
    m = np.concatenate([present(model, marks[i : i + BATCH_TEXTS]) for i in range(0, len(marks), BATCH_TEXTS)])
    model.weights = np.ascontiguousarray((m / np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))).T.astype(np.float32))
    among = np.concatenate([times(model, marks[i : i + BATCH_TEXTS], model.weights) for i in range(0, len(marks), BATCH_TEXTS)]).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    good = value > 1e-6 * value[-1]
    nystrom = vector[:, good] / np.sqrt(value[good])
    k = np.concatenate([times(model, [t for _, t in rows[i : i + BATCH_TEXTS]], model.weights) for i in range(0, len(rows), BATCH_TEXTS)])
    x = k.astype(np.float64) @ nystrom
    x1 = np.hstack([x, np.ones((len(x), 1))])
    # Every language weighs the same, however many texts it has.
    label = np.array([languages.index(lang) for lang, _ in rows])
    weight = (1.0 / np.bincount(label, minlength=len(languages)))[label][:, None]
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    beta = np.linalg.solve(x1.T @ (weight * x1) + ridge * np.eye(x1.shape[1]), x1.T @ (weight * y))
    model.scores, model.bias = (model.weights @ (nystrom @ beta[:-1])).astype(np.float32), beta[-1]
    model.weights = model.weights[:, :0]
    return model


def sample(docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str, most: int = TRAIN) -> list[tuple[str, str]]:
    """The sample of labelled rows: about `most` of each language."""
    df = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    bound = F.lit(0.0)
    for row in df.groupBy(lang).count().collect():  # one row per language
        bound = F.when(F.col(lang) == row[0], F.lit(most / row[1])).otherwise(bound)
    rows = df.where(uniform(F.lit("sample"), F.col(doc_id)) < bound).select(lang, F.xxhash64(doc_id), text).collect()
    return [(r[0], r[2]) for r in sorted(rows)]


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the softmax of the regression scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids = batch.column(0)
            for part in in_batches(batch.column(1)):
                names, scores = ["und"] * len(part.texts), np.zeros(len(part.texts))
                todo = [i for i, t in enumerate(part.texts) if m and t and LETTER.search(t)]
                while todo:
                    take, size = [], 0
                    while todo and len(take) < BATCH_TEXTS and size < BATCH_BYTES:
                        take.append(todo.pop())
                        size += len(part.texts[take[-1]])
                    s = times(m, [lowered(part.texts[i]) for i in take], m.scores) + m.bias
                    best = s.argmax(1)
                    e = np.exp(4 * (s - s.max(1, keepdims=True)))
                    for i, b, p in zip(take, best.tolist(), (e.max(1) / e.sum(1)).tolist(), strict=True):
                        names[i], scores[i] = m.languages[b], p
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, len(part.texts)), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = fit(sample(docs, ~held_out, "doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
