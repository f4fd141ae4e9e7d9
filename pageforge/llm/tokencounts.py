"""Token counts from the counts of distinct pre-tokens (operator 12).

The vocabulary says where a text may be cut without changing its tokens: where no piece reaches over.  That is before
white space that follows something else, around line ends and digits, and between ASCII letters and ASCII marks; the
vocabulary is looked through for pieces that do.  So a text's count is the sum of its pre-tokens' counts:

1. the corpus' distinct pre-tokens and how often they occur, summed in each task before they are shuffled;
2. the library counts the pieces of each distinct pre-token once;
3. each document's pre-token frequencies join these counts.  The pre-tokens that make up at least one in `COMMON` of all
   occurrences, so no more than `COMMON` of them, are joined where the text lies; the others, of which none is frequent,
   by a shuffled join on the pre-token;
4. the counts are summed by document.

No ids are made for documents.  Null and empty texts have no tokens and no bytes.  Repeated rows, also with null or
equal ids, are counted each; extra columns of any name are ignored; texts are counted whole however long they are; an
empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm.common import cut, pick, shared_dir, slices, table

LIMIT = 4096
#: Pre-tokens that are joined without a shuffle, at most, and bytes of one that are kept as they are (else its digest).
COMMON, KEPT = 1 << 20, 64
#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 1 << 17

SPACE = "▁"  # how the vocabulary writes a space
_MARK = r"[\x00-\x09\x0b-\x1f!-/:-@\[-`{-\x7f]++"  # marks and control characters of ASCII
#: Runs of letters or of marks; characters beyond ASCII keep what stands beside them.
_PRETOKEN = re.compile(rf" *(?:(?:(?:[A-Za-z]++|{_MARK})(?=[^\x00-\x7f])|[^\x00-\x7f]++)+(?:[A-Za-z]++|{_MARK})?|[A-Za-z]++|{_MARK}|[0-9])| +|\n")


def pretokens(text: str) -> Counter:
    """A text's pre-tokens, white space as spaces, with the space that the library puts before a text."""
    return Counter(map(re.Match.group, _PRETOKEN.finditer(" " + text.replace(SPACE, " ")))) if text else Counter()


_held: dict = {}


def library(path: str):
    """The library's model, one per worker, after a look at whether its pieces allow the cuts."""
    if path not in _held:
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]
        if any(pretokens(p.lstrip(SPACE)).total() > 1 for p in pieces):
            raise ValueError("the vocabulary has pieces that reach over the borders of pre-tokens")
        if own.encode("a  b") != own.encode("a") + own.encode("\n  b")[2:] or own.encode("\n") + own.encode("\nb")[2:] != own.encode("\nb"):
            raise ValueError("the model changes white space")
        _held[path] = own
    return _held[path]


def piece_counts(words: list[str], path: str) -> list[int]:
    """How many pieces each pre-token has inside a text: behind a line end, as texts themselves get a space in front."""
    own = library(path)
    spare = len(own.encode("\n"))
    return [len(x) - spare for x in own.encode(["\n" + w for w in words], num_threads=1)]


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "times"])

    held: Counter = Counter()
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                held.update(pretokens(text or ""))
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "word"):
            counts = piece_counts(part.column("word").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("times"), pa.array(counts, pa.int64())], ["word", "times", "pieces"])


def vocabulary(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word, times, pieces: each distinct pre-token of a table, its occurrences and the number of its pieces."""
    words = pick(df, text=text).mapInArrow(_occurring, "word string, times long")
    words = words.groupBy("word").agg(F.sum("times").alias("times"))
    return words.mapInArrow(partial(_counted, path=path), "word string, times long, pieces long")


def _name(word: str) -> str | bytes:
    if len(word) <= KEPT // 4:
        return word
    raw = word.encode()
    return word if len(raw) <= KEPT else hashlib.sha256(raw).digest()


def _joined(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """For each row its known pieces (word null), and the pre-tokens that are not common."""
    known: dict = common.value
    for batch in batches:
        for part in slices(batch, "text"):
            at, words, times, pieces, size = [], [], [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                total, rest = 0, 0
                for word, n in pretokens(text or "").items():
                    found = known.get(_name(word))
                    if found is None:
                        words.append(word)
                        times.append(n)
                        rest += 1
                    else:
                        total += n * found
                at += [k] * (rest + 1)
                words.append(None)
                times.append(None)
                pieces += [None] * rest + [total]
                size += [None] * rest + [len((text or "").encode())]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(at), part.column("doc_id").take(at), pa.array(size, pa.int64()), pa.array(words, pa.string()), pa.array(times, pa.int64()), pa.array(pieces, pa.int64())],
                ["row", "doc_id", "n_bytes", "word", "times", "pieces"],
            )


def count(df: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    spark = df.sparkSession
    where = shared_dir(spark)
    docs = pick(df, doc_id=doc_id, text=text)
    words = cut(vocabulary(docs, path), where, "words")
    total = words.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
    often = {_name(r["word"]): r["pieces"] for r in words.where(F.col("times") * common >= total).select("word", "pieces").toLocalIterator()}
    often = spark.sparkContext.broadcast(often)
    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(partial(_joined, common=often), "row long, doc_id long, n_bytes long, word string, times long, pieces long")
    rows = cut(rows, where, "rows")  # numbered once
    rare = rows.where("word is not null").select("row", "word", "times").join(words.select("word", F.col("pieces").alias("each")), "word")
    sums = rows.where("word is null").select("row", "doc_id", "n_bytes", "pieces").unionByName(rare.select("row", (F.col("times") * F.col("each")).alias("pieces")), allowMissingColumns=True)
    sums = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("pieces").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return count(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))
