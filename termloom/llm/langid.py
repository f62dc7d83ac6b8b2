"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A
trigram binds its letters' vectors, rotated by 2, 1 and 0 places, by an
element-wise product; a document bundles (adds) the vectors of its trigrams; a
language's prototype bundles the unit vectors of its training documents. The
prediction is the prototype with the highest cosine, and the score is that
cosine, cut to 0..1.

Letters are lower-cased; runs of other characters, and the ends of a text, count as one space. Vectors
of trigrams are made on first use in each task and kept up to `MAX_CACHED`.

Training takes at most about `max_train` labelled documents, picked by a hash of
text: a bounded sample, as prototypes settle early. Prediction reads every text in
full. Prototypes are (number of languages) x `DIM` floats and travel with the job.

Defined results: a null text, or one without a letter, is `und` with score 0;
so is every text when nothing is labelled; ties go to the first language by
code point; repeated rows are predicted alike; an empty table gives an empty
result. Labels, sources and ids are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

DIM = 1024
MAX_CACHED = 20_000
CHUNK = 1 << 20
UND = "und"


class Profiler:
    """Trigram counts of a text, and their bundled vector."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.codes = np.full(0x3000, 32, np.uint64)  # lower-cased letters; all else is a space
        for c in range(0x3000):
            if chr(c).isalpha():
                self.codes[c] = ord(chr(c).lower()[0])
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((256, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            rng = np.random.Generator(np.random.Philox(key=code))
            self.letters[code] = rng.integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def trigram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(trigrams, their counts, whether there is a letter), over the whole text in pieces."""
        keys, numbers, lettered = [], [], False
        last = np.array([32], np.uint64)  # the text so far ends with these codes
        for at in range(0, len(text), CHUNK):
            points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", errors="surrogatepass"), np.uint32)
            codes = self.codes[np.minimum(points, 0x2FFF)]
            if points.max() >= 0x3000:
                high = points >= 0x3000
                codes[high] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in points[high]]
            lettered |= bool((codes != 32).any())
            codes = np.concatenate([last, codes] if at + CHUNK < len(text) else [last, codes, [np.uint64(32)]])
            space = codes == 32
            codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
            last = codes[-2:]
            tri = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
            k, n = np.unique(tri, return_counts=True)
            keys.append(k)
            numbers.append(n)
        if len(keys) == 1:
            return keys[0], numbers[0], lettered
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(inverse, np.concatenate(numbers)), lettered

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The document's unit vector; None without a letter."""
        if not text:
            return None
        keys, numbers, lettered = self.counts(text)
        if not lettered:
            return None
        rows, extra = np.empty(len(keys), np.int64), None
        for i, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                if len(self.rows) >= MAX_CACHED:  # beyond the cache: add its vector at once
                    extra = (0 if extra is None else extra) + numbers[i] * self.trigram(key).astype(np.float32)
                    row = -1
                else:
                    row = self.rows[key] = len(self.rows)
                    if row >= len(self.matrix):
                        self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                    self.matrix[row] = self.trigram(key)
            rows[i] = row
        known = rows >= 0
        vector = numbers[known].astype(np.float32) @ self.matrix[rows[known]].astype(np.float32)
        if extra is not None:
            vector = vector + extra
        return vector / max(float(np.linalg.norm(vector)), 1e-9)


def held_out() -> Column:
    """The documents that training never sees: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(labelled: DataFrame, dim: int = DIM, max_train: int = 20_000) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) of a table with text and lang."""
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = labelled.count()
    if total > max_train:
        share = max_train / total
        labelled = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler, found = Profiler(dim), {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if (v := profiler.bundle(text)) is not None:
                    found[lang] = found.get(lang, 0) + np.round(v.astype(np.float64) * (1 << 20))
        yield pd.DataFrame(
            [(lang, i, int(x)) for lang, v in found.items() for i, x in enumerate(v)],
            columns=["lang", "i", "x"],
        )

    parts = labelled.select("text", "lang").mapInPandas(sums, "lang string, i int, x long")
    with small_batches(labelled.sparkSession):
        rows = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.collect_list(F.struct("i", "x")).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in rows]
    matrix = np.zeros((len(rows), dim))
    for k, r in enumerate(rows):
        for x in r["v"]:
            matrix[k, x["i"]] = x["x"]
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return names, (matrix / np.maximum(norms, 1e-9)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, dim: int = DIM) -> DataFrame:
    """`docs` with lang_pred and score; the text is the only input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        profiler = Profiler(dim)
        for batch in batches:
            found = []
            for text in batch["text"]:
                v = profiler.bundle(text) if names else None
                if v is None:
                    found.append((UND, 0.0))
                else:
                    likeness = matrix @ v
                    k = int(np.argmax(likeness))
                    found.append((names[k], min(1.0, max(0.0, float(likeness[k])))))
            batch["lang_pred"] = [x[0] for x in found]
            batch["score"] = [x[1] for x in found]
            yield batch

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInPandas(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, dim: int = DIM, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the labelled documents that aren't held out."""
    names, matrix = prototypes(docs.filter(~held_out()), dim, max_train)
    found = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), names, matrix, dim)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.05, **options) -> DataFrame:
    """The documents with a recognised language; all their columns stay as they are."""
    names, matrix = prototypes(docs.filter(~held_out()), **options)
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score")}
    found = predict(docs.withColumnsRenamed(aside), names, matrix)
    kept = found.filter((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
