"""Operator 12: fill-in-the-middle by displacement scatter.

A batch of texts is one buffer of bytes. A scan of line ends gives the cuts of each text; a difference array over the cuts, summed up, is the
shift of every byte to its place in the output, and one scatter writes all outputs. The way back finds the marks in the outputs, builds the
shifts of the restored bytes in the same way and gathers. Index arrays cover a window of bytes at a time, so a long text needs little
more than its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, utf8

MARKS = ("<P>", "<S>", "<M>")
WIDE = 3  # bytes of a mark
SEED, RATE, SPM_RATE = 7, 100, 50
_SLICE = 4 << 20  # bytes of texts that are moved at once, about
_WINDOW = 1 << 20  # bytes whose shifts are held at once


def draw(doc_id: Column, group: int, seed: int = SEED) -> Column:
    """One of the 8-digit groups of the hex sha256 of seed, colon and id, as a number; a null id counts as empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(key, 8 * group + 1, 8), 16, 10).cast("long")


def shifts(bounds: np.ndarray, moves: np.ndarray, size: int, window: int = _WINDOW) -> Iterator[tuple[int, int, np.ndarray]]:
    """Windows (from, to, shift of each byte) over `size` bytes; from bounds[i] on, bytes move by moves[i]. Bounds ascend, with the last of equal ones valid."""
    steps = np.diff(moves, prepend=0)
    at, moved = 0, 0
    for a in range(0, size, window):
        b = min(a + window, size)
        end = int(np.searchsorted(bounds, b))
        difference = np.zeros(b - a, np.int64)
        np.add.at(difference, bounds[at:end] - a, steps[at:end])
        difference[0] += moved
        out = np.cumsum(difference)
        at, moved = end, int(out[-1])
        yield a, b, out


def _woven(*columns: np.ndarray) -> np.ndarray:
    """First values of all columns, then second ones, and so on."""
    return np.stack(columns, axis=1).ravel()


def cut(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of lines of each text, and where its middle and its suffix start."""
    ends = np.flatnonzero(data == 10)
    first, last = (np.searchsorted(ends, x) for x in (offsets[:-1], offsets[1:]))
    filled = offsets[1:] > offsets[:-1]
    n = last - first
    n[filled] += data[offsets[1:][filled] - 1] != 10
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))

    def place(k: np.ndarray) -> np.ndarray:
        out = np.where(k == 0, offsets[:-1], offsets[1:])
        inside = (k > 0) & (k < n)
        out[inside] = ends[(first + k - 1)[inside]] + 1
        return out

    return n, place(low), place(high)


def scatter(data: np.ndarray, offsets: np.ndarray, middle: np.ndarray, suffix: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all texts as one buffer, and their offsets."""
    start, end = offsets[:-1], offsets[1:]
    ends = np.concatenate([[0], np.cumsum(end - start + np.where(plain, 0, 3 * WIDE))])
    to = ends[:-1]
    n_prefix, n_suffix = middle - start, end - suffix
    prefix_to = to + np.where(plain, 0, WIDE + np.where(spm, n_suffix + WIDE, 0))
    suffix_to = to + np.where(plain, suffix - start, WIDE + np.where(spm, 0, n_prefix + WIDE))
    middle_to = to + n_prefix + np.where(plain, 0, n_suffix + 3 * WIDE)
    out = np.empty(int(ends[-1]), np.uint8)
    for a, b, by in shifts(_woven(start, middle, suffix), _woven(prefix_to - start, middle_to - middle, suffix_to - suffix), len(data)):
        out[np.arange(a, b) + by] = data[a:b]
    for mark, before in zip(MARKS, (prefix_to, suffix_to, middle_to), strict=True):
        at = before[~plain] - WIDE
        for i, byte in enumerate(mark.encode()):
            out[at + i] = byte
    return out, ends


def gather(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that gave these outputs as one buffer, and their offsets. An output that isn't plain holds each mark once."""
    start, end = offsets[:-1], offsets[1:]
    found = []
    for mark in MARKS:
        a, b, c = mark.encode()
        hits = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)) if len(data) > 2 else np.zeros(0, np.int64)
        at = start.copy()
        at[~plain] = hits[np.searchsorted(hits, start[~plain])] + WIDE
        found.append(at)
    prefix, suffix, middle = found
    n_prefix = np.where(plain, 0, np.where(spm, middle, suffix) - WIDE - prefix)
    n_middle = end - middle
    ends = np.concatenate([[0], np.cumsum(end - start - np.where(plain, 0, 3 * WIDE))])
    to = ends[:-1]
    middle_to, suffix_to = to + n_prefix, to + n_prefix + n_middle
    out = np.empty(int(ends[-1]), np.uint8)
    for a, b, by in shifts(_woven(to, middle_to, suffix_to), _woven(prefix - to, middle - middle_to, suffix - suffix_to), len(out)):
        out[a:b] = data[np.arange(a, b) + by]
    return out, ends


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Code points in ranges of bytes."""
    return [int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, one row per row.

    A null text counts as empty; empty texts and texts that hold a mark stay as they are (plain). The draws depend on the id alone, so
    repeated rows give equal outputs; a null id draws as empty text. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    asked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[draw(F.col(id_col), g, seed).alias(f"h{g + 1}") for g in range(4)])
    marked = F.contains("text", F.lit(MARKS[0])) | F.contains("text", F.lit(MARKS[1])) | F.contains("text", F.lit(MARKS[2]))
    rows = asked.select("doc_id", "text", "h1", "h2", ((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)).alias("plain"), (F.col("h4") % 100 < spm_rate).alias("spm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            h1, h2, plain, spm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "plain", "spm"))
            for a, b in slices(offsets, _SLICE):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                p, s = plain[a:b], spm[a:b]
                n, middle, suffix = cut(part, at, h1[a:b], h2[a:b])
                out, ends = scatter(part, at, middle, suffix, p, s)
                forms = pa.array(np.where(p, "plain", np.where(s, "spm", "psm")).tolist(), pa.string())
                chars = [pa.array(np.array(_characters(part, x, y), np.int64), mask=p) for x, y in ((at[:-1], middle), (middle, suffix))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int64)), forms, *chars, _strings(out, ends)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(filled: DataFrame) -> DataFrame:
    """Adds `restored`, the text that gave `output` in `form`; nothing else of the row is read. A null output counts as plain and empty."""
    columns = [c for c in filled.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("output"))
            forms = np.array(batch.column("form").to_pylist(), object)
            empty = offsets[1:] == offsets[:-1]
            for a, b in slices(offsets, _SLICE):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                out, ends = gather(part, at, empty[a:b] | ((forms[a:b] != "psm") & (forms[a:b] != "spm")), forms[a:b] == "spm")
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, _strings(out, ends)], names=[*columns, "restored"])

    rows = filled.select(*columns)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, restored string")


def transformed(docs: DataFrame) -> DataFrame:
    """The transformation with digests in place of texts: of the output, and of what is restored from it."""
    rows = restore(fill_in_middle(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
