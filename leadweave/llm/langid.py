"""Language identification by a string kernel: presence of blended n-grams, Nystroem landmarks, kernel ridge regression.

A text is the set of the n-grams (1 to ORDERS letters) of its lower-cased letters, other characters standing for one
space. The kernel of two texts is the number of n-grams both have, over the root of the product of the numbers that each
has. A few landmark texts of each language span the feature map: with K the landmarks' own kernel matrix, a text's kernel
values times K^-1/2 are its features, and ridge regressions of one language versus the rest are fitted on these. Scoring
multiplies a batch's presence matrix by the landmarks' presence matrix, and the kernel values by one matrix more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_batches, raw_texts

ORDERS = 3
#: Training texts of each language, landmarks of each, and the ridge; the alphabet's size with the space.
TRAIN, LANDMARKS, RIDGE, LETTERS = 240, 24, 1e-2, 64
#: Texts whose presence matrix is made at once.
BATCH = 64


def codes(text: str, place: np.ndarray) -> np.ndarray:
    """Letters of a text as numbers of the alphabet, runs of other characters as one 0, with a 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = place[np.minimum(points, len(place) - 1)]
    c = np.concatenate([np.zeros(1, c.dtype), c, np.zeros(1, c.dtype)])
    return c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]


def grams(c: np.ndarray, orders: int = ORDERS) -> list[np.ndarray]:
    """The n-grams of coded letters as numbers, by order, each order in a range of its own."""
    out, base, own = [], 0, c.astype(np.int64)
    for n in range(1, orders + 1):
        if n > 1:
            own = own[:-1] * LETTERS + c[n - 1 :]
        out.append(own + base)
        base += LETTERS**n
    return out


SPACE = sum(LETTERS**n for n in range(1, ORDERS + 1))


@dataclass(frozen=True)
class Model:
    """place: code point to letter number; languages; landmarks: presence by n-gram; sizes: of landmarks; to_score: kernel values to languages."""

    place: np.ndarray
    languages: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    to_score: np.ndarray

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts with the landmarks. A text is scored whole, whatever its length."""
        out = np.zeros((len(texts), len(self.sizes)), np.float32)
        width = self.landmarks.shape[0]
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            present = np.zeros((len(part), width), np.float32)
            seen = np.zeros(SPACE, bool)
            size = np.zeros(len(part), np.float32)
            for k, text in enumerate(part):
                seen[:] = False
                for g in grams(codes(text, self.place)):
                    seen[g] = True
                size[k] = np.count_nonzero(seen)
                present[k] = seen[self.column]
            out[at : at + BATCH] = (present @ self.landmarks) / np.sqrt(np.maximum(size, 1)[:, None] * self.sizes[None, :])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.to_score


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from (text, language) pairs, in a fixed order; needs one pair at least."""
    letters: dict[str, int] = {}
    for text, _ in rows:
        for ch in text.lower():
            if ch.isalpha():
                letters[ch] = letters.get(ch, 0) + 1
    place = np.zeros(0x30000, np.uint8)
    alpha = np.fromiter((chr(i).isalpha() for i in range(len(place))), bool, len(place))
    place[alpha] = LETTERS - 1  # letters that are rare in training share a number
    for k, ch in enumerate(sorted(letters, key=lambda x: (-letters[x], x))[: LETTERS - 2]):
        place[min(ord(ch), len(place) - 1)] = k + 1
    languages = sorted({lang for _, lang in rows})
    chosen = []
    for lang in languages:
        chosen += [t for t, own in rows if own == lang][:landmarks]
    sets = [np.unique(np.concatenate(grams(codes(t, place)))) for t in chosen]
    column = np.unique(np.concatenate(sets))
    presence = np.zeros((len(column), len(chosen)), np.float32)
    for k, s in enumerate(sets):
        presence[np.searchsorted(column, s), k] = 1
    sizes = np.array([len(s) for s in sets], np.float32)
    shape = Model(place, languages, column, presence, sizes, np.eye(len(chosen), dtype=np.float32))
    inner = shape.kernel(chosen).astype(np.float64)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    features = shape.kernel([t for t, _ in rows]).astype(np.float64) @ root
    target = np.where(np.array([lang for _, lang in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Languages count alike, however many texts each has.
    weight = np.zeros(len(rows))
    for k in range(len(languages)):
        weight[target[:, k] > 0] = 1 / max(1, (target[:, k] > 0).sum())
    bias = np.c_[features, np.ones(len(features))]
    normal = (bias * weight[:, None]).T @ bias + ridge * np.eye(bias.shape[1]) * weight.sum() / len(rows)
    solved = np.linalg.solve(normal, (bias * weight[:, None]).T @ target)
    to_score = np.r_[root @ solved[:-1], solved[-1:]].astype(np.float32)
    return Model(place, languages, column, presence, sizes, to_score)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores; `und` and 0 for texts without letters."""
    some = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    if some:
        kernel = model.kernel([texts[k] for k in some])
        found = kernel @ model.to_score[:-1] + model.to_score[-1]
        best = found.argmax(axis=1)
        share = np.exp(4 * (found - found.max(axis=1, keepdims=True)))
        score[some] = (share.max(axis=1) / share.sum(axis=1)).clip(0, 1)
        for k, b in zip(some, best.tolist(), strict=True):
            names[k] = model.languages[b]
    return names, score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN) -> Model | None:
    """Fit on about per_language texts of each language that may be learned from, chosen by a hash of their ids; None if there are none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    sample = bounded_sample(rows, "lang", per_language).collect()
    # Longer texts make better landmarks; ties go by id, so that the same rows give the same model.
    sample.sort(key=lambda r: (r.lang, -min(len(r.text), 1_000), r.doc_id, r.text))
    return fit([(r.text, r.lang) for r in sample]) if sample else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row. Null texts and texts without letters are `und`, as all are without a model.

    Texts are used whole; repeated rows are scored alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8") for t in raw_texts(batch)]
        names, score = predict(shared.value, texts) if shared.value else (["und"] * len(texts), np.zeros(len(texts)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, lang_pred string, score double")
