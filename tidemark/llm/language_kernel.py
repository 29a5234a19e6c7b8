"""Language identification by string kernels.

The kernel of two texts counts the n-grams of 1 to 3 letters (blended spectrum)
present in both, divided by the root of the product of how many each holds. Texts
are lower-cased, everything that is no letter is one gap, and n-grams are hashed to
BINS. Landmark pieces span the kernel's space (Nyström); one-versus-rest kernel
ridge regression is solved in it. A score is linear in the presence vector, so the
landmarks, the Nyström map and the weights fold into one matrix, and documents are
scored by products of presence matrices with it. Long texts are cut into pieces of
PIECE letters, all of them scored and averaged by their n-grams.

The fit takes at most PER_LANGUAGE pieces of each language, of which LANDMARKS / languages
are landmarks; which ones is decided by hashes. The model is BINS x
languages numbers, whatever the corpus holds.

Defined cases: null text, or one without any letter, is ``und`` with score 0, as is
everything when nothing was learned; empty lang strings are languages like others,
null ones are not learned from; equal texts get equal results, of equal scores the language that sorts first wins; a text of
any length is scored piece by piece, a task holds some 40 bytes per letter of it; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import carried, trim, worker_state

GRAMS = 3
BINS = 1 << 14
PIECE = 1000
PER_LANGUAGE = 512
LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 10.0
GROUP = 400_000
"""Letters of the texts taken together."""
PIECES = 512
"""Pieces scored at once: 64 KB each."""

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BINS x languages
    bias: np.ndarray


def letters() -> np.ndarray:
    kept = worker_state("language")
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def code_points(text: str) -> np.ndarray:
    """Letters of the lower-cased text, runs of anything else as one 0, with a 0 at either end."""
    raw = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    raw = np.where(letters()[raw], raw, 0)
    return raw[np.append(True, (raw[1:] != 0) | (raw[:-1] != 0))]


def pieces_of(texts: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts in a row, the piece that each belongs to, and the text that each piece belongs to."""
    codes = [code_points(t) for t in texts]
    counts = np.array([max(1, round(len(c) / piece)) for c in codes])
    first = np.cumsum(counts) - counts
    sizes = np.array([len(c) for c in codes])
    rows = [f + np.minimum(np.arange(n) * c // n, c - 1) for f, n, c in zip(first.tolist(), sizes.tolist(), counts.tolist(), strict=True)]
    return np.concatenate(codes), np.concatenate(rows).astype(np.int32), np.repeat(np.arange(len(texts)), counts)


def marks_of(points: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """0/1 rows (piece x BINS) of the n-grams of pieces, given as code points and the piece of each."""
    flat = points.astype(np.uint64)
    out = np.zeros((n_rows, BINS), np.float32)
    with np.errstate(over="ignore"):
        h = np.zeros(len(flat), np.uint64)
        for n in range(GRAMS):
            h = h[: len(flat) - n] * np.uint64(MIX[0]) + flat[n:]
            g = (h ^ (h >> np.uint64(29))) * np.uint64(MIX[1]) + np.uint64(n * MIX[2] % 2**64)
            bins = ((g ^ (g >> np.uint64(32))) * np.uint64(MIX[0])) >> np.uint64(64 - 14)
            whole = slice(0, len(flat) - n)
            inside = rows[whole] == rows[n:]  # both ends in one piece, hence in one text
            inside &= (flat[whole] != 0) | (flat[n:] != 0) if n else flat != 0
            out[rows[whole][inside], bins[inside].astype(np.int64)] = 1
    return out


def presence(texts: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows of all pieces of the texts, and the text that each belongs to."""
    points, rows, owner = pieces_of(texts, piece)
    return marks_of(points, rows, len(owner)), owner


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T).astype(np.float64) / norm


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression, one language against the rest, on pieces given in a fixed order."""
    languages = sorted(set(labels))
    if not texts:
        return Model([], np.zeros((BINS, 0)), np.zeros(0))
    share = max(1, landmarks // len(languages))
    picked = np.sort(np.concatenate([np.flatnonzero([x == lang for x in labels])[:share] for lang in languages]))
    marks = presence([texts[i] for i in picked], 1 << 40)[0]
    blocks = [presence(texts[a : a + 256], 1 << 40)[0] for a in range(0, len(texts), 256)]
    to_marks = np.concatenate([kernel(x, marks) for x in blocks])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = to_marks @ root
    y = np.array([[float(x == lang) for lang in languages] for x in labels])
    mean_z, mean_y = z.mean(0), y.mean(0)
    z, y = z - mean_z, y - mean_y
    w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ y)
    per_mark = root @ w / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    return Model(languages, (marks.T @ per_mark).astype(np.float32), mean_y - mean_z @ w)


def score(model: Model, texts: list[str]) -> np.ndarray:
    """Texts x languages, averaged over pieces by their n-grams; pieces are scored some at a time, however many a text has."""
    points, rows, owner = pieces_of(texts)
    total, weight = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for a in range(0, len(owner), PIECES):
        b = min(a + PIECES, len(owner))
        lo, hi = np.searchsorted(rows, [a, b])
        marks = marks_of(points[lo:hi], rows[lo:hi] - a, b - a)
        sizes = marks.sum(1)
        s = (marks @ model.weights) / np.sqrt(np.maximum(sizes, 1))[:, None] + model.bias
        np.add.at(total, owner[a:b], s * sizes[:, None])
        weight += np.bincount(owner[a:b], sizes, len(texts))
    return total / np.maximum(weight, 1)[:, None]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, in groups of bounded size."""
    out = ["und"] * len(texts)
    sure = np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))]
    at = 0
    while at < len(known) and model.languages:
        end, size = at, 0
        while end < len(known) and (size == 0 or size + len(texts[known[end]]) <= GROUP):
            size += max(len(texts[known[end]]), 200)
            end += 1
        own = known[at:end]
        s = score(model, [texts[i] for i in own]) * SHARPNESS
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, k, v in zip(own, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            out[i], sure[i] = model.languages[k], v
        at = end
    return out, sure


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the doc_id as text, modulo 4 (null: as if empty)."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("")).cast("string")) % 4


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a hash-chosen sample of the labelled documents outside fold 2: one piece each, ``per_language`` of a language."""
    labelled = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(
        (F.crc32(F.coalesce("doc_id", F.lit(""))) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    counts = {r["lang"]: r["n"] for r in docs.where("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    rates = docs.sparkSession.createDataFrame([(k, 4.0 * per_language / n) for k, n in counts.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    order = F.xxhash64("text", F.lit(3))
    pieces = F.greatest(F.lit(1), F.floor(F.length("text") / PIECE))
    at = (F.pmod(F.xxhash64("text", F.lit(5)), pieces) * PIECE + 1).cast("int")
    chosen = labelled.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", F.substring("text", at, F.lit(PIECE)).alias("piece"), order.alias("o"))
    chosen = chosen.where(F.col("piece").rlike(r"\p{L}")).dropDuplicates(["lang", "o"])
    ranked = chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "piece"))).where(F.col("r") <= per_language)
    rows = sorted((r["lang"], r["r"], r["piece"]) for r in ranked.collect())
    return fit([r[2] for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            langs, sure = predict(model, texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": sure})
            trim()

    inner, finish = carried(docs, "text")
    out = inner.withColumn("_judged", judge("text")).withColumns({"lang_pred": F.col("_judged")["lang_pred"], "score": F.col("_judged")["score"]})
    return finish(out, "lang_pred", "score")
