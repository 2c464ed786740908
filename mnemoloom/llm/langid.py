"""Language identification by hyperdimensional profiles.

Each letter symbol has a random vector of +1 and -1. A trigram's vector binds its letters' vectors,
each rotated by its place; a text's vector bundles (sums) its trigrams'; a language's prototype
bundles the unit vectors of its texts. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from mnemoloom.llm.common import arrays, runs

SYMBOLS, SCALE, DIMS = 64, 1 << 20, 1024
#: Trigrams whose vectors are made at once.
GRAMS = 1024
#: Training uses about so many labelled texts at most, chosen by a hash of their id.
MAX_TRAINING_TEXTS = 20_000
UNKNOWN = "und"
_STATE: dict = {}


def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for all but letters, own symbols for a-z and the Latin-1 letters, shared ones for the rest."""
    if "symbols" not in _STATE:
        table = np.zeros(0x110000, np.uint8)
        letters = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()])
        table[letters] = 58 + letters % 6
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        table[0xDF:0x100] = np.where(table[0xDF:0x100] > 0, 27 + np.arange(33) % 31, 0)
        _STATE["symbols"] = table
    return _STATE["symbols"]


def letter_vectors(dims: int, seed: int) -> np.ndarray:
    """SYMBOLS x dims of +1 and -1; symbol 0 stands for a word's edge."""
    key = (dims, seed)
    if key not in _STATE:
        _STATE[key] = (np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dims), np.int8) * 2 - 1).astype(np.float32)
    return _STATE[key]


def trigram_vectors(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Bind by place: twice rotated first letter x once rotated second x third."""
    v = letter_vectors(dims, seed)
    return np.roll(v, 2, axis=1)[grams >> 12] * np.roll(v, 1, axis=1)[grams >> 6 & 63] * v[grams & 63]


def text_vectors(texts: list[str | None], dims: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first index, bundled vectors, trigram counts). Every letter of every text is the middle of one trigram."""
    table = _symbol_table()
    joined = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in joined], np.int64) + 1
    points = np.frombuffer(("\0".join(joined) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[0], table[points]]).astype(np.int32)
    owner = np.repeat(np.arange(len(joined), dtype=np.int32), sizes)
    middle = np.flatnonzero(codes[1:-1]) + 1
    grams, owner = codes[middle - 1] << 12 | codes[middle] << 6 | codes[middle + 1], owner[middle - 1]
    present = np.flatnonzero(np.bincount(grams, minlength=1 << 18))
    place = np.zeros(1 << 18, np.int64)
    place[present] = np.arange(len(present))
    width = max(1, len(present))
    step = max(1, (1 << 20) // width)
    for start in range(0, len(joined), step):
        stop = min(start + step, len(joined))
        a, b = np.searchsorted(owner, (start, stop))
        counts = np.bincount((owner[a:b] - start) * width + place[grams[a:b]], minlength=(stop - start) * width)
        counts = counts.reshape(stop - start, width).astype(np.float32)
        bundled = np.zeros((stop - start, dims), np.float32)
        for j in range(0, len(present), GRAMS):
            bundled += counts[:, j : min(j + GRAMS, len(present))] @ trigram_vectors(present[j : j + GRAMS], dims, seed)
        yield start, bundled, counts.sum(axis=1)


def train(labelled: DataFrame, dims: int = DIMS, seed: int = 7, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_texts: int = MAX_TRAINING_TEXTS) -> dict[str, np.ndarray]:
    """Prototypes by label, from rows whose text and label are given. Texts without letters teach nothing.

    At most about ``max_texts`` rows are used: those whose hashed id falls below a fraction set by the
    row count. Sums are of scaled integers, so they do not depend on the order of tasks. What comes to
    the driver is one vector a label.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    total = labelled.where(F.col(label_col).isNotNull()).count()
    if total > max_texts:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * max_texts / total))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in runs(batches, "text", 1 << 20):
            labels, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
            for start, vectors, counts in text_vectors(texts, dims, seed):
                norms = np.linalg.norm(vectors, axis=1)
                for i in np.flatnonzero((counts > 0) & (norms > 0)):
                    unit = np.rint(vectors[i] / norms[i] * SCALE).astype(np.int64)
                    label = labels[start + i]
                    sums[label] = sums.get(label, 0) + unit
        names = sorted(sums)
        place = np.tile(np.arange(dims, dtype=np.int32), len(names))
        yield arrays([("label", pa.string()), ("place", pa.int32()), ("v", pa.int64())], [np.repeat(np.array(names, object), dims), place, np.concatenate([sums[n] for n in names]) if names else []])

    sums = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "label string, place int, v long")
    found: dict[str, np.ndarray] = {}
    for label, place, v in sums.groupBy("label", "place").agg(F.sum("v").alias("v")).toPandas().itertuples(index=False):
        found.setdefault(label, np.zeros(dims))[int(place)] = v
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = 7, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the cosine, cut to 0..1) and n_letters; other columns pass through.

    A null text, one without a letter, or no prototypes at all gives ``und`` and score 0. Ties go to the
    label that sorts first. A text's vector holds all its trigrams; nothing is cut. No shuffle.
    """
    names = list(prototypes)
    dims = len(next(iter(prototypes.values()))) if names else 1
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, 1), np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, text_col, 1 << 20):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            labels, scores, letters = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for start, vectors, counts in text_vectors(texts, dims, seed):
                own = slice(start, start + len(vectors))
                letters[own] = counts
                norms = np.linalg.norm(vectors, axis=1)
                if names:
                    cosine = (vectors @ matrix.T) / np.maximum(norms, 1e-9)[:, None]
                    best, ok = cosine.argmax(axis=1), (counts > 0) & (norms > 0)
                    labels[own] = np.where(ok, np.array(names, object)[best], UNKNOWN)
                    scores[own] = np.where(ok, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
            extra = [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "score", "n_letters"])

    kept = docs.drop("lang_pred", "score", "n_letters")
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_letters", LongType())]
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *made]))
