"""Language identification by a string kernel.

The kernel of two texts counts the character n-grams (n = 1 to 3, blended) present in both, divided
by the root of the product of the numbers present in each. Presence is kept in ``2^BITS`` hashed
places. A bounded sample of labelled texts is learnt from, the same number a language at most;
landmarks drawn from it span a Nyström approximation ``K_xL K_LL^(-1/2)``, in which a kernel ridge
regression is solved for each language against the rest. Scoring a batch is a matrix product: the
presence matrix of the texts times the landmarks' presence matrix, folded with the regression into
one matrix of a column a language.

Defined results: a null text, or one without a letter, is ``und`` with score 0. With nothing to
learn from, every text is. Of languages with equal scores the first in code point order wins.
``score`` is the winner's regression value moved from -1..1 to 0..1. Repeated rows score alike; other
columns are ignored. A null id counts as the empty text in the fold's checksum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.common import small_batches
from claimflow.llm.quality import remainder

BITS = 14
GRAMS = (1, 2, 3)
#: Bounds of the fit: labelled texts and landmarks a language. Every language is learnt.
ROWS_PER_LANGUAGE = 600
LANDMARKS_PER_LANGUAGE = 40
RIDGE = 1e-2
TEXTS = 64  # rows of a presence matrix
CHARS = 1 << 20  # characters hashed at once; a longer text is hashed in several goes
_ALPHABET = 0x110000


class _Characters:
    """Lower case and letter tables of all code points, made once a process."""

    lower: np.ndarray | None = None
    letter: np.ndarray

    @classmethod
    def ready(cls) -> None:
        if cls.lower is None:
            chars = [chr(i) for i in range(_ALPHABET)]
            low = [c.lower() for c in chars]
            cls.letter = np.array([c.isalpha() for c in chars])
            cls.lower = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)


def _mark(out: np.ndarray, row: np.ndarray, code: np.ndarray) -> None:
    """Set the places of all n-grams that lie within one row."""
    flat, base = out.reshape(-1), row.astype(np.int64) << BITS
    wide = code.astype(np.uint64)
    for n in GRAMS:
        if len(code) < n:
            break
        gram = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + wide[k : len(code) - n + 1 + k]
        gram *= np.uint64(0xD1B54A32D192ED03)
        place = base[: len(gram)] + (gram >> np.uint64(64 - BITS)).astype(np.int64)
        if n > 1:
            place = place[row[: len(gram)] == row[n - 1 :]]
        flat[place] = 1


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 presence matrix of the texts' n-grams, and whether each text has a letter."""
    _Characters.ready()
    out, letters = np.zeros((len(texts), 1 << BITS), np.float32), np.zeros(len(texts), bool)
    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            code = np.frombuffer("".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32)
            row = np.repeat([i for i, _ in held], [len(t) for _, t in held])
            letters[row[_Characters.letter[code]]] = True
            _mark(out, row, _Characters.lower[code])
        held, size = [], 0

    for i, text in enumerate(texts):
        text = text or ""
        for lo in range(0, max(len(text) - max(GRAMS) + 1, 1), CHARS):  # parts share n - 1 characters
            held.append((i, text[lo : lo + CHARS + max(GRAMS) - 1]))
            size += len(held[-1][1])
            if size >= CHARS or lo:
                flush()
    flush()
    return out, letters


class Model:
    def __init__(self, languages: list[str], matrix: np.ndarray | None):
        self.languages, self.matrix = languages, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for lo in range(0, len(texts), TEXTS):
            seen, letters = presence(texts[lo : lo + TEXTS])
            if self.matrix is None:
                names += ["und"] * len(seen)
                continue
            values = seen @ self.matrix / np.sqrt(np.maximum(seen.sum(1), 1))[:, None]
            best = values.argmax(1)
            names += [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            scores[lo : lo + len(seen)] = np.where(letters, np.clip((values.max(1) + 1) / 2, 0, 1), 0)
        return names, scores


def fit(texts: list[np.ndarray], labels: list[str], landmarks: list[int]) -> Model:
    """Ridge regression in the landmarks' span. ``texts`` are packed presence rows."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], None)
    unpack = lambda rows: np.unpackbits(np.stack(rows), axis=1).astype(np.float32)
    marks = unpack([texts[i] for i in landmarks])
    marks /= np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors @ np.diag(np.where(values > 1e-6 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)) @ vectors.T
    gram, right = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(languages)))
    for lo in range(0, len(texts), 256):
        rows = unpack(texts[lo : lo + 256])
        mapped = (rows @ marks.T / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]).astype(np.float64) @ root
        target = np.where(np.array(labels[lo : lo + 256])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        gram += mapped.T @ mapped
        right += mapped.T @ target
    solved = root @ np.linalg.solve(gram + RIDGE * np.eye(len(gram)), right)
    return Model(languages, (marks.T.astype(np.float64) @ solved).astype(np.float32))


def sample_ids(df: DataFrame, usable: Column, lang_col: str, id_col: str) -> DataFrame:
    """Up to ``ROWS_PER_LANGUAGE`` ids a language, by the hash of the id: first within 64 parts of each
    language, then among what the parts hand on."""
    rows = df.where(usable & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(id_col).alias("_turn"))
    part = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(64))
    for keys in (["_lang", part], ["_lang"]):
        order = Window.partitionBy(*keys).orderBy("_turn", "_id")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= ROWS_PER_LANGUAGE)
    return rows.select("_id", "_lang", "_n")


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    small_batches(df.sparkSession)
    picked = sample_ids(df, usable, lang_col, id_col)
    rows = df.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_id", "_lang", "_n", "_text")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, keep = batch.column(3).to_pylist(), [], []
            for lo in range(0, len(texts), TEXTS):
                seen, letters = presence(texts[lo : lo + TEXTS])
                keep += [lo + int(i) for i in np.flatnonzero(letters)]
                out += [x.tobytes() for x in np.packbits(seen[letters].astype(np.uint8), axis=1)]
            cols = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], names=["id", "lang", "n", "seen"])

    # 2 KB a row, and as many rows as the bounds above allow.
    got = rows.mapInArrow(pack, "id long, lang string, n int, seen binary").collect()
    got.sort(key=lambda r: (r["n"], r["lang"], r["id"], r["seen"]))
    marks = [i for i, r in enumerate(got) if r["n"] <= LANDMARKS_PER_LANGUAGE]
    marks = marks or list(range(min(len(got), LANDMARKS_PER_LANGUAGE)))
    return fit([np.frombuffer(r["seen"], np.uint8) for r in got], [r["lang"] for r in got], marks)


def predicted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score``; rows whose remainder modulo 5 is 0 are never learnt from."""
    held = remainder(id_col, 5) == 0
    shared = df.sparkSession.sparkContext.broadcast(train(df, ~held, id_col, text_col, lang_col))
    small_batches(df.sparkSession)

    def predict(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          names=["lang_pred", "score"])

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(predict, "lang_pred string, score double")
    out = df.select(F.col(id_col), held.alias("held_out"), udf(F.col(text_col)).alias("_p"))
    return out.select(id_col, "held_out", F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))
