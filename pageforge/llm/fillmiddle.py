"""Fill-in-the-middle transformation by big-integer bit-parallelism (operator 13).

A text's bytes are translated into class masks, one bit a byte, and read as one integer.  Shifted boolean operations
mark the last byte of each unit (white space and the word behind it, or white space at the end) in all places at once;
bit_count gives the number of units, and the end of the k-th one is found by halving the integer again and again.
Whether, where and in which order a text is cut depends on a seed and its doc_id alone.

Null and empty texts stay plain and empty.  A null doc_id counts as one without digits.  Repeated rows give repeated
rows, extra columns of any name are ignored, texts are cut whole however long they are, an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pageforge.llm.common import pick, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANK = b"\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Rates:
    """The seed, and the shares of texts that are cut and, of these, that have their suffix first, in hundredths."""

    seed: int = 42
    cut: int = 50
    suffix_first: int = 80


def _class(members: bytes) -> bytes:
    """The table that turns bytes into binary digits: 1 for members."""
    return bytes(0x31 if b in members else 0x30 for b in range(256))


WORD = _class(bytes(b for b in range(256) if b not in BLANK))
LEAD = _class(bytes(b for b in range(256) if b & 0xC0 != 0x80))  # first bytes of code points


def mask(data: bytes, table: bytes) -> int:
    """The class as an integer whose bit k stands for byte k."""
    return int(data[::-1].translate(table), 2) if data else 0


def unit_ends(data: bytes) -> int:
    """Bits at the last byte of each unit."""
    words = mask(data, WORD)
    ends = words & ~(words >> 1)
    return ends | 1 << len(data) - 1 if data else 0


def place(bits: int, nth: int, width: int) -> int:
    """The place of the nth set bit, from 1 on, of an integer of so many bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        held = low.bit_count()
        if nth <= held:
            bits, width = low, half
        else:
            bits, width, at, nth = bits >> half, width - half, at + half, nth - held
    return at


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(name[k : k + 4], "big") for k in (0, 4, 8, 12))


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transformed(text: str, doc_id: int | None, rates: Rates = Rates()) -> Cut:
    data = text.encode()
    ends = unit_ends(data)
    n = ends.bit_count()
    a, b, whether, order = draws(rates.seed, doc_id)
    if not data or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= rates.cut:
        return Cut(n, "plain", None, None, data)
    units = sorted((a % (n + 1), b % (n + 1)))
    first, second = (place(ends, k, len(data)) + 1 if k else 0 for k in units)
    lead = mask(data, LEAD)
    chars = [(lead & (1 << k) - 1).bit_count() for k in (first, second)]
    prefix, middle, suffix = PREFIX.encode() + data[:first], MIDDLE.encode() + data[first:second], SUFFIX.encode() + data[second:]
    spm = order % 100 < rates.suffix_first
    return Cut(n, "spm" if spm else "psm", chars[0], chars[1] - chars[0], (suffix + prefix if spm else prefix + suffix) + middle)


def restored(output: bytes, form: str) -> bytes:
    """The text from what was made of it: its parts lie between the marks, which no text that is cut contains."""
    if form == "plain":
        return output
    marks = [SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]
    parts, rest = {}, output.removeprefix(marks[0].encode())
    for mark, after in zip(marks, marks[1:]):
        parts[mark], _, rest = rest.partition(after.encode())
    return parts[PREFIX] + rest + parts[SUFFIX]


COLUMNS = "n long, form string, prefix_chars long, middle_chars long"


def _rows(batches: Iterator[pa.RecordBatch], rates: Rates, digests: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            ids = part.column("doc_id").to_pylist()
            cuts = [transformed(t or "", i, rates) for t, i in zip(part.column("text").to_pylist(), ids)]
            columns = [part.column("doc_id"), pa.array([c.n for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string())]
            columns += [pa.array([getattr(c, k) for c in cuts], pa.int64()) for k in ("prefix_chars", "middle_chars")]
            if digests:
                made = [[hashlib.sha256(x).hexdigest() for x in (c.output, restored(c.output, c.form))] for c in cuts]
                columns += [pa.array([m[k] for m in made], pa.string()) for k in (0, 1)]
            else:
                columns.append(pa.array([c.output.decode() for c in cuts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digests else ("text",))])


def transform(df: DataFrame, rates: Rates = Rates(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and text, the transformed one."""
    return pick(df, doc_id=doc_id, text=text).mapInArrow(partial(_rows, rates=rates, digests=False), f"doc_id long, {COLUMNS}, text string")


def restore(df: DataFrame, doc_id: str = "doc_id", form: str = "form", text: str = "text") -> DataFrame:
    """doc_id and text: the originals of transformed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [restored(t.encode(), f).decode() for t, f in zip(part.column("text").to_pylist(), part.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(df, doc_id=doc_id, form=form, text=text).mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of transformed texts and of what they give back."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return docs.mapInArrow(partial(_rows, rates=Rates(), digests=True), f"doc_id long, {COLUMNS}, output_sha256 string, restored_sha256 string")
