"""Language identification with string kernels (operator 8).

Texts are compared by the blended-spectrum presence kernel: the share of byte n-grams (n from 1 to 3, hashed, marks
and digits as spaces) that two texts both hold.  A bounded sample of labelled texts gives the Nystrom landmarks and
the one-versus-rest kernel ridge regression; scoring is two matrix products for each slice of texts.

Null texts and texts without a letter (Unicode category L) are `und` with score 0; so is every text when nothing was
learned.  A null doc_id counts as held out.  Repeated rows give repeated rows, an empty table an empty one.  Languages
of equal score: the first by name.  Long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm.common import byte_view, pick, slices, table
from pageforge.llm.wordcodes import fold

#: Hash bins of n-grams; labelled texts of each language in the sample (about: rows are taken by a hash of their id,
#: at a rate that gives this many); landmarks; ridge.
BINS, SAMPLE, LANDMARKS, RIDGE = 1 << 13, 300, 160, 1e-4
UND = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_ANY_LETTER = re.compile(r"\p{L}")


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 0 and 1 over the bins, and which texts have a letter."""
    data, off = byte_view(texts)
    low = fold(data)
    letter = _LETTER[low]
    sign = np.flatnonzero((low[:-1] == 0xC3) & ((low[1:] == 0x97) | (low[1:] == 0xB7)))
    letter[sign] = letter[sign + 1] = False
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    b = np.where(letter, low, 32).astype(np.uint64)
    out = np.zeros((rows, BINS), bool)
    flat = out.reshape(-1)
    code = np.zeros(len(b), np.uint64)
    for n in (1, 2, 3):
        code = code[: len(b) - n + 1] * np.uint64(256) + b[n - 1 :]
        if not len(code):
            break
        at = (code + np.uint64(n << 32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)
        same = row[: len(code)] == row[n - 1 :]
        flat[(row[: len(code)] * BINS + at.astype(np.int64))[same]] = True
    total = np.zeros(len(b) + 1, np.int64)
    np.cumsum(letter & (low < 128) | (low == 0xC3) & letter, out=total[1:])
    has = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~has & (np.diff(off) > 0)):  # letters of other scripts
        has[i] = _ANY_LETTER.search(texts[int(i)].as_py()) is not None
    return out, has


class Model:
    """Landmarks as a matrix of unit rows, and the weights of each language over them."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray) -> None:
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def scores(self, seen: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(seen.sum(1), 1)).astype(np.float32)
        return seen.astype(np.float32) @ self.landmarks / size[:, None] @ self.weights


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on Nystrom landmarks; rows come in a fixed order, so the model is the same each time."""
    if not texts:
        return None
    names = sorted(set(langs))
    seen = np.concatenate([presence(pa.array(texts[i : i + 200], pa.string()))[0] for i in range(0, len(texts), 200)])
    unit = seen.astype(np.float32) / np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1)).astype(np.float32)
    every = max(1, len(texts) // landmarks)
    base = unit[::every][:landmarks]
    kernel, cross = (base @ base.T).astype(float), (unit @ base.T).astype(float)
    target = np.array([[1.0 if x == n else 0.0 for n in names] for x in langs])
    weight = np.array([1.0 / langs.count(x) for x in langs])[:, None]  # every language counts alike
    left = cross.T @ (cross * weight) + ridge * kernel + 1e-9 * np.eye(len(base))
    return Model(names, np.ascontiguousarray(base.T), np.linalg.solve(left, cross.T @ (target * weight)).astype(np.float32))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learns from rows that are not held out; about `sample` rows of each language go to the driver."""
    rows = pick(df, doc_id=doc_id, text=text, lang=lang).where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    rate = F.lit(None).cast("double")
    for name, n in sorted(counts.items()):
        rate = F.when(F.col("lang") == name, min(1.0, sample / n)).otherwise(rate)
    found = rows.where((draw < rate) & F.col("text").isNotNull()).withColumn("draw", draw).collect()
    found.sort(key=lambda r: (r["draw"], r["doc_id"], r["text"]))
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def predict(df: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, from the texts alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", rows=512):
                lang, score = [UND] * part.num_rows, np.zeros(part.num_rows)
                if model is not None:
                    seen, has = presence(part.column("text"))
                    found = model.scores(seen)
                    best = found.argmax(1)
                    lang = [model.langs[k] if h else UND for k, h in zip(best.tolist(), has.tolist())]
                    score = np.where(has, np.clip(found.max(1), 0, 1), 0).astype(float)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return pick(df, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, lang_pred string, score double")


#: A text is rejected where no language was found or the best one's score is below this.
LEAST_SCORE = 0.1


def recognized(df: DataFrame, model: Model | None, least: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is recognized; without a model all texts with a letter."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, rows=512):
                seen, keep = presence(part.column(text))
                if shared.value is not None:
                    keep = keep & (shared.value.scores(seen).max(1) >= least)
                yield part.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
