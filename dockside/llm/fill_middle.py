"""Fill-in-the-middle samples, cut at unit borders found eight bytes at a time.

A unit is a run of ASCII letters or any other single code point. The UTF-8 bytes
of many texts are laid out as 64-bit words, each text from a word of its own on
and with a zero byte or more behind it. Arithmetic on whole words marks the bytes
that end a unit; bit counts of the words and their running sum give the number of
units up to each word. The place of a cut is searched in that sum, and then among
the at most eight marks of one word.

Forms: ``plain`` is the text; ``psm`` is prefix, suffix, middle, and ``spm``
suffix, prefix, middle, each part behind its mark. No text that holds a mark is
cut, so :func:`restored_text` gives back every text exactly.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import record_batch, text_bytes

# Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

# Bytes of text that are laid out at a time; a longer text is laid out alone.
STEP_BYTES = 4 << 20

EACH = np.uint64(0x0101010101010101)
HIGH = EACH << np.uint64(7)
LOW = ~HIGH
CASE = EACH * np.uint64(0x20)
# Added to seven bits, these reach the eighth one from "a" on, and behind "z".
FROM_A = EACH * np.uint64(0x80 - ord("a"))
PAST_Z = EACH * np.uint64(0x80 - ord("z") - 1)


def following(marks: np.ndarray) -> np.ndarray:
    """The mark of the next byte, for each byte."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def mark_bytes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High bits of the bytes that end a unit, and of those that begin a code point."""
    folded = (words | CASE) & LOW
    letters = (folded + FROM_A) & ~(folded + PAST_Z) & ~words & HIGH
    inner = words & ~(words << np.uint64(1)) & HIGH
    goes_on = (letters & following(letters)) | (~letters & following(inner))
    return ~goes_on & HIGH, ~inner & HIGH


class Layout:
    """Units of some texts, found and counted word by word."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pads = [bytes(8 - r) for r in range(8)]
        laid = b"".join(x for text in texts for x in (text, pads[len(text) & 7]))
        words = np.frombuffer(laid, "<u8")
        past = np.cumsum(sizes // 8 + 1)
        #: First word of each text.
        self.first = past - sizes // 8 - 1
        live = np.full(len(words), HIGH)
        live[past - 1] = HIGH & ((np.uint64(1) << (sizes % 8 * 8).astype(np.uint64)) - np.uint64(1))
        ends, starts = mark_bytes(words)
        self.ends, self.starts = ends & live, starts & live
        self.units_before = np.append(0, np.cumsum(np.bitwise_count(self.ends), dtype=np.int64))
        self.points_before = np.append(0, np.cumsum(np.bitwise_count(self.starts), dtype=np.int64))
        #: Units of each text.
        self.n = self.units_before[past] - self.units_before[self.first]

    def byte_after(self, units: np.ndarray) -> np.ndarray:
        """Place of the byte behind the first ``units`` units of each text."""
        rank = self.units_before[self.first] + units
        word = np.maximum(np.searchsorted(self.units_before, rank, side="left") - 1, 0)
        left = rank - self.units_before[word]
        marks = self.ends[word]
        for _ in range(7):
            marks = np.where(left > 1, marks & (marks - np.uint64(1)), marks)
            left = left - 1
        lowest = marks & (~marks + np.uint64(1))
        byte = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8
        return np.where(units > 0, (word - self.first) * 8 + byte + 1, 0)

    def points_in(self, size: np.ndarray) -> np.ndarray:
        """Code points of the first ``size`` bytes of each text."""
        word = self.first + size // 8
        part = (np.uint64(1) << (size % 8 * 8).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.starts[word] & part)
        return self.points_before[word] - self.points_before[self.first] + inside


def draws(seed: int, doc_ids: list) -> np.ndarray:
    """Four numbers of 32 bits per id; a NULL id counts as an empty one."""
    keys = (f"{seed}:{'' if i is None else i}".encode() for i in doc_ids)
    raw = b"".join(hashlib.sha256(key).digest()[:16] for key in keys)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)


def rearranged(doc_ids: list, texts: list[bytes], seed: int, cut_percent: int, spm_percent: int):
    """One batch of results."""
    laid = Layout(texts)
    h = draws(seed, doc_ids)
    places = np.sort(h[:, :2] % (laid.n + 1)[:, None], axis=1)
    begin, end = laid.byte_after(places[:, 0]), laid.byte_after(places[:, 1])
    before, upto = laid.points_in(begin), laid.points_in(end)
    p, s, m = (mark.encode() for mark in MARKS)
    forms, outputs, prefix_chars, middle_chars = [], [], [], []
    cuts = zip(texts, (h[:, 2] % 100).tolist(), (h[:, 3] % 100).tolist(), begin.tolist(), end.tolist())
    for i, (text, chance, order, a, b) in enumerate(cuts):
        if not text or chance >= cut_percent or p in text or s in text or m in text:
            form, output = "plain", text
        elif order < spm_percent:
            form, output = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        else:
            form, output = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
        forms.append(form)
        outputs.append(output)
        prefix_chars.append(None if form == "plain" else int(before[i]))
        middle_chars.append(None if form == "plain" else int(upto[i] - before[i]))
    return record_batch(RESULT, doc_ids, laid.n, forms, prefix_chars, middle_chars, outputs)


def fill_in_middle(
    docs: DataFrame, seed: int = 1, cut_percent: int = 90, spm_percent: int = 20
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs``.

    ``n`` counts the text's units. ``seed`` and ``doc_id`` alone decide where a text is
    cut and which form it takes: ``cut_percent`` of the texts are cut, ``spm_percent``
    of these put the suffix first. An empty text and one that holds a mark stay plain;
    ``prefix_chars`` and ``middle_chars`` (code points) are NULL there. A NULL text is
    an empty one, a NULL ``doc_id`` draws as an empty id; repeated rows give repeated
    results, rows of one id are drawn alike, and other columns are ignored. A text of
    any length is one row, held whole in one task. Nothing is shuffled.
    """

    def compute(batches):
        for batch in batches:
            doc_ids, column = batch.column(0).to_pylist(), batch.column(1)
            at, held, size = 0, [], 0
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if held and size + len(text) > STEP_BYTES:
                    yield rearranged(doc_ids[at:i], held, seed, cut_percent, spm_percent)
                    at, held, size = i, [], 0
                held.append(text)
                size += len(text)
            if held:
                yield rearranged(doc_ids[at:], held, seed, cut_percent, spm_percent)

    texts = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return texts.mapInArrow(
        compute,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored_text(output: str = "output", form: str = "form") -> Column:
    """Column: the text that an output of :func:`fill_in_middle` was made of."""
    out = F.col(output)
    place = {mark: F.locate(mark, out) for mark in MARKS}
    p, s, m = MARKS
    wide = len(p)

    def between(first: str, then: str) -> Column:
        return F.substring(out, place[first] + wide, place[then] - place[first] - wide)

    middle = F.substring(out, place[m] + wide, F.length(out))
    return (
        F.when(F.col(form) == "plain", out)
        .when(F.col(form) == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(F.col(form) == "spm", F.concat(between(p, m), middle, between(s, p)))
    )
