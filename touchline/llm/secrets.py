"""Operator 6: secrets in texts by patterns and by the guess cost of values in credential contexts.

Base kinds are patterns. Whole values that follow a credential word (or stand between user and host of an address) are split at minimum
guess cost into common words, dates, repeats, sequences, keyboard walks and brute-force spans; a value whose cheapest split still needs
many guesses is reported as kind `guess`, unless one base span covers all of it. Words are ranked by the documents that hold them outside
credential contexts, so that ordinary prose after a credential word is cheap to guess in whatever language the corpus has.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import utf8, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
#: A credential word, perhaps with a copula, and its value; or the password part of an address.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth|private[_-]?key|access[_-]?key)["']?\s{0,4}(?:[:=]|\bis\b)\s{0,4}["']?([^\s"',;<>|]{6,})|://[^\s/:@]+:([^\s/@]{6,})@)""",
    re.I | re.A,
)
DICTIONARY = 100_000  # most common words of the corpus that guesses try, at most (a few MB in each worker); rarer ones are guessed letter by letter
_HELD = 200_000  # distinct words that a task counts before it hands them on
MIN_GUESSES = 10.0  # log10 of the guesses that a value must need at least

#: Common parts of passwords, by rank (fixed values).
WORDS = (
    "password 123456 qwerty admin welcome login letmein monkey dragon master hello secret test user root guest changeme example default sample "
    "iloveyou football baseball sunshine princess shadow superman batman trustno starwars computer internet service server database token key "
    "love angel summer winter spring autumn monday friday january february march april june july august september october november december "
    "the and for you with this that have from your are was not all can will one out get new time day home work money pass word abc xyz foo bar"
).split()
#: Rows of a keyboard (fixed values).
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_WORD = re.compile(r"[^\W\d_]{3,40}")
_LEET = str.maketrans("4@3105$7", "aaeiloss")
_NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]} | {
    (a, b) for up, down in zip(ROWS, ROWS[1:]) for i, b in enumerate(down) for a in up[i : i + 2]
}
_NEXT |= {(b, a) for a, b in _NEXT}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d", re.A)


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _runs(holds: list[bool], n: int) -> list[int]:
    """From each of n places on, how many in a row hold."""
    out = [0] * (n + 1)
    for i in range(len(holds) - 1, -1, -1):
        out[i] = out[i + 1] + 1 if holds[i] else 0
    return out


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses for the cheapest split of the value into known parts (`ranks` holds words, lower-case) and brute-force spans."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower()[0] for c in value)
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n

    def offer(i: int, j: int, cost: float) -> None:
        if best[i] + cost < best[j]:
            best[j] = best[i] + cost

    dates: dict[int, list[int]] = {}
    for m in _DATE.finditer(value):
        dates.setdefault(m.start(), []).append(m.end())
    step = math.log10(2)  # a further part has to be chosen
    said = {w: _runs([a == b for a, b in zip(low, low[w:])], n) for w in (1, 2, 3, 4, 5, 6, 8)}
    rows = {t: _runs([ord(b) - ord(a) == t and b.isalnum() for a, b in zip(low, low[1:])], n) for t in (1, -1)}
    walks = _runs([pair in _NEXT for pair in zip(low, low[1:])], n)
    turned = [0, 0, *accumulate(abs(ord(c) - ord(b)) != abs(ord(b) - ord(a)) for a, b, c in zip(low, low[1:], low[2:]))]
    for i in range(n):
        offer(i, i + 1, math.log10(_alphabet(value[i])))
        for j in range(i + 2, min(n, i + 40) + 1):
            rank = ranks.get(low[i:j]) or 3 * ranks.get(plain[i:j], 0)
            if rank:
                offer(i, j, math.log10(rank * (1 if value[i:j] == low[i:j] else 2) + 1) + step)
        for j in dates.get(i, ()):
            offer(i, j, math.log10(365 * 120 if j - i > 4 else 120) + step)
        j = i + 1 + said[1][i]
        if j - i >= 3:
            offer(i, j, math.log10(_alphabet(value[i]) * (j - i)) + step)
        for width in (2, 3, 4, 5, 6, 8):  # a part said again and again
            if said[width][i] >= width:
                j = i + width + said[width][i] // width * width
                offer(i, j, sum(math.log10(_alphabet(c)) for c in value[i : i + width]) + math.log10((j - i) / width) + step)
        for turn in (1, -1):
            j = i + 1 + rows[turn][i]
            if j - i >= 3:
                offer(i, j, math.log10(_alphabet(value[i]) * (j - i)) + step)
        j = i + 1 + walks[i]
        if j - i >= 4:
            offer(i, j, math.log10(94 * (j - i)) + 0.3 * (turned[j - 1] - turned[i + 1]) + step)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind as listed."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                out.append((m.start(), m.end(), 1))
    for m in HEX.finditer(text):
        out.append((m.start(), m.end(), 2))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def guess_spans(text: str, base: list[tuple[int, int, str]], least: float = MIN_GUESSES, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, str]]:
    """Whole values in a credential context that no base span covers and that need 10^least guesses or more."""
    out = []
    for m in CONTEXT.finditer(text):
        g = 1 if m[1] else 2
        s = m.start(g)
        value = m[g].rstrip(".!?)")
        e = s + len(value)
        if len(value) >= 6 and not any(a <= s and e <= b for a, b, _ in base) and guess_cost(value, ranks) >= least:
            out.append((s, e, "guess"))
    return out


#: Lower-case bytes of which every base match other than hex, and every context, holds one (fixed values).
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"credential", b"auth", b"key", b"akia", b"://")
_HEX_BYTES = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))


def may_hold(piece: bytes) -> bool:
    """False only if the text can hold no span of any kind."""
    low = piece.lower()
    return any(h in low for h in _HINTS) or b"h" * 32 in piece.translate(_HEX_BYTES)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold each word outside credential contexts and base spans, counted in parts."""
    held: Counter[str] = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if may_hold(text.encode("utf-8", "replace")):
                cuts = sorted([(m.start(), m.end()) for m in CONTEXT.finditer(text)] + [(s, e) for s, e, _ in base_spans(text)])
                end, parts = 0, []
                for s, e in cuts:
                    parts.append(text[end : max(s, end)])
                    end = max(end, e)
                text = " ".join([*parts, text[end:]])
            held.update(set(_WORD.findall(text.lower())))
            if len(held) > _HELD:
                yield made()
                held.clear()
    yield made()


def common_words(docs: DataFrame, text: Column | str = "text", words: int = DICTIONARY) -> dict[str, int]:
    """Rank of the words that most documents hold, over all whole texts; words of one document and words in credential contexts don't count.

    The fixed list keeps its ranks where they are better. Counts fall into at most 64 bins per power of two; bins are taken from the top while
    they hold `words` words or fewer, so that many reach the driver and the workers at most, and words of a bin come together or not at all.
    """
    rows = docs.select(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")).alias("t"))
    counts = rows.mapInArrow(_said, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts.withColumn("bin", F.floor(F.log2("n") * 64).cast("int")), "words")
    held, least = 0, None
    for r in counts.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        held += r["count"]
        if held > words:
            break
        least = r.bin
    top = counts.where(F.col("bin") >= least).select("word", "n").collect() if least is not None else []
    ranks = {r.word: i + 1 for i, r in enumerate(sorted(top, key=lambda r: (-r.n, r.word)))}
    return ranks | {w: min(k, ranks.get(w, k)) for w, k in _RANK.items()}


def _digest(batches: Iterator[pa.RecordBatch], least: float, ranks: dict[str, int]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        raw, counts, shas, spans = memoryview(data), [[], [], []], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            piece = bytes(raw[a:b])
            base, more = [], []
            if may_hold(piece):
                text = piece.decode()
                base = base_spans(text)
                more = guess_spans(text, base, least, ranks)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(x[2] == kind for x in base))
            said = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
            shas.append(hashlib.sha256(said.encode()).hexdigest() if base else empty)
            order = sorted([*base, *more], key=lambda x: (x[0], (*KINDS, "guess").index(x[2])))
            spans.append(",".join(f"{k}:{s}:{e}" for s, e, k in order))
        arrays = [*(pa.array(np.array(c, np.int64)) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
        rest = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, *arrays], names=[*batch.schema.names, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame, text: Column | str = "text", keep: list[str] | None = None, least: float = MIN_GUESSES, ranks: dict[str, int] | None = None) -> DataFrame:
    """Columns `keep` with n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    Spans are `kind:start:end` of whole matches in code points, the end exclusive, by start and kind, joined by commas. A null or
    empty text has none: counts 0, the hash of the empty string, spans ''. Words are ranked over these documents unless `ranks` are given
    (`common_words`); otherwise rows are independent: ties and repeated rows get the same result, an empty table stays empty, and other
    columns are not looked at.
    """
    ranks = common_words(docs, text) if ranks is None else ranks
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"])
    return rows.mapInArrow(lambda batches: _digest(batches, least, ranks), schema).drop("__text")


def _masked(batches: Iterator[pa.RecordBatch], column: str, least: float, ranks: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(column)
        out = []
        for text in batch.column(at).to_pylist():
            if text and may_hold(text.encode()):
                base = base_spans(text)
                end, parts = 0, []
                for s, e, kind in sorted([*base, *guess_spans(text, base, least, ranks)]):
                    if e > end:
                        parts += [text[end : max(s, end)], f"[{kind}]" if s >= end else ""]
                        end = e
                text = "".join([*parts, text[end:]])
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def mask_secrets(docs: DataFrame, column: str = "text", least: float = MIN_GUESSES, ranks: dict[str, int] | None = None) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; overlapping spans become one mask. Null stays null.

    Words are ranked over these documents unless `ranks` are given.
    """
    ranks = common_words(docs, column) if ranks is None else ranks
    return docs.mapInArrow(lambda batches: _masked(batches, column, least, ranks), docs.schema)
