"""Operator 4: SentencePiece encoding with seeded merge-dropout, and decoding.

Pieces are merged from characters by an agenda of candidate merges, best score first and leftmost among equals. With dropout, each
candidate of each occurrence of a word is skipped at the given rate on its own, by a hash keyed by seed, document and place of the word: its
draws are the numbers of candidates up to the next one that is skipped. So one seed always gives one segmentation, other seeds vary it, and
all of them decode to the same text. Plain segmentations are kept by word. Occurrences with a skip run through their agendas side by side:
a row of numbers holds the ranks of a word's candidates, and each step takes the best candidate of every row.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.agendas import WIDTHS, Agendas, tables
from touchline.llm.common import mix

SPACE = "▁"  # stands for a space in pieces
DROPOUT, SEED = 0.1, 42
VARIANTS = 3  # first keys that the tests draw from; a word may have any segmentation in any document
_CACHED = 900_000  # plain segmentations kept by a Python worker, about
_LONG = WIDTHS[-1]  # characters beyond which a word goes through its agenda alone
_GAPS = 256  # candidates that one draw passes over, at most; then it is drawn again
_CHUNK = 200_000  # words that are looked up together
_MASK, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_START, _RANK = 10, 42  # bits of an entry of the agenda: length below, then start, then rank
_LENGTH, _PLACES = (1 << _START) - 1, (1 << (_RANK - _START)) - 1
_MARKS = ".,;:!?|%&*$#()[]{}<>\"'/\\=+~^`@-_0123456789"


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a model file, encoding by merges and decoding."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        scores = {names[i]: model.get_score(i) for i in plain}
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        if max(map(len, scores)) > _LENGTH:
            raise ValueError(f"this needs pieces of at most {_LENGTH} characters")
        # best score first; adding a shifted start gives an entry of the agenda
        self.entry = {x: order[v] << _RANK | len(x) for x, v in scores.items()}
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) < 256 or any(SPACE in x.lstrip(SPACE) or "\n" in x for x in self.ids):
            raise ValueError("this needs byte pieces, and pieces that hold a space at their start only and no line end")
        self.unknown = model.unk_id()
        self.table = [b""] * n
        for i in plain:
            self.table[i] = names[i].replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.table[i] = bytes([value])
        # a word may be cut before a mark if no piece holds that mark after anything but marks and spaces
        marks = set(_MARKS)
        for piece in self.ids:
            marks -= {b for a, b in zip(piece, piece[1:]) if a not in marks and a != SPACE}
        while any(b in marks and a not in marks and a != SPACE for piece in self.ids for a, b in zip(piece, piece[1:])):
            marks -= {b for piece in self.ids for a, b in zip(piece, piece[1:]) if b in marks and a not in marks and a != SPACE}
        cut = re.escape("".join(sorted(marks)))
        self.words = re.compile(f"[{SPACE}{cut}]*[^{SPACE}{cut}\n]+|[{SPACE}{cut}]+|\n")
        # u of 53 bits lies below the first k of (1 - dropout) ** 1, 2, ... if k candidates are taken before one is skipped
        self.drops = dropout > 0
        self.below = sorted(int((1 - min(dropout, 1.0)) ** k * (1 << 53)) for k in range(1, _GAPS + 1))
        self.limits = np.array(self.below, np.int64)
        self._forget()
        self._tables()

    def _forget(self) -> None:
        """The plain segmentations: number of each word, its ids and its merges, -1 for a word that is too long to be kept."""
        self.known: dict[str, int] = {}
        self.raw: list[bytes | None] = []
        self.merges = np.zeros(1024, np.int16)

    def _tables(self) -> None:
        """Parts are numbered from 1: pieces and their characters, then all other characters by code point. Pairs of parts that are a piece
        together have its rank and its number."""
        names = [*self.entry, *sorted({c for x in self.entry for c in x} - self.entry.keys())]
        number = {x: i for i, x in enumerate(names, 1)}
        self.others = len(names) + 1
        self.part_of = np.arange(self.others, self.others + 0x110000, dtype=np.int32)
        for x, i in number.items():
            if len(x) == 1:
                self.part_of[ord(x)] = i
        self.names = ["", *names]
        self.id_of = np.array([-1, *(self.ids.get(x, -1) for x in names), -1], np.int64)  # the last stands for other characters
        pairs = [(number[x[:i]], number[x[i:]], e >> _RANK, number[x]) for x, e in self.entry.items() for i in range(1, len(x)) if x[:i] in number and x[i:] in number]
        left, right, rank, whole = np.array(pairs, np.int64).reshape(-1, 4).T
        self.agendas = Agendas(left, right, rank, whole, self.others + 0x110000)

    def _gap(self, key: int, draw: int) -> int:
        x = (key + (draw + 1) * _STEP) & _MASK
        x = (x ^ (x >> 30)) * _MIX[0] & _MASK
        x = (x ^ (x >> 27)) * _MIX[1] & _MASK
        return _GAPS - bisect_right(self.below, (x ^ (x >> 31)) >> 11)

    def _some_gaps(self, keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """`_gap` of many keys."""
        x = keys + (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        return _GAPS - np.searchsorted(self.limits, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.int64), "right")

    def _gaps(self, key: int) -> Iterator[int]:
        """How many candidates are taken before each that is skipped."""
        draw = 0
        while True:
            passed = 0
            while (n := self._gap(key, draw)) == _GAPS:
                passed, draw = passed + n, draw + 1
            draw += 1
            yield passed + n

    def merge(self, word: str, gaps: Iterator[int] | None = None) -> tuple[list[int], int]:
        """Ids of a word, and how many candidates came after the last that was skipped. When `gaps` end, no more are skipped.

        The agenda is a heap of numbers made of rank, start and length of the merged piece, so the best score comes first and the leftmost
        among equals. An entry is out of date unless the part at its start and the next part have that length together.
        """
        n, since = len(word), 0
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0 where none starts
        if n > 1:
            entry = self.entry.get
            gap = next(gaps, -1) if gaps is not None else -1
            before = list(range(-1, n - 1))  # start of the part before
            agenda = [e + (i << _START) for i, e in enumerate(map(entry, map(add, word, word[1:]))) if e is not None]
            heapify(agenda)
            while agenda:
                e = heappop(agenda)
                start = e >> _START & _PLACES
                middle, end = ends[start], start + (e & _LENGTH)
                if not middle or middle >= end or ends[middle] != end:
                    continue
                if since == gap:
                    gap, since = next(gaps, -1), 0
                    continue
                since += 1
                ends[start], ends[middle] = end, 0
                if end < n:
                    before[end] = start
                    if (e := entry(word[start : ends[end]])) is not None:
                        heappush(agenda, e + (start << _START))
                if start and (e := entry(word[before[start] : end])) is not None:
                    heappush(agenda, e + (before[start] << _START))
        parts, at = [], 0
        while at < n:
            parts.append(word[at : ends[at]])
            at = ends[at]
        out = list(map(self.ids.get, parts))
        if None not in out:
            return out, since
        out = []
        for p in parts:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return out, since

    def _word(self, word: str, key: int | None) -> bytes:
        """Ids of one occurrence; without a key no merge is skipped."""
        return array("I", self.merge(word, None if key is None or not self.drops else self._gaps(key))[0]).tobytes()

    def _parts(self, words: list[str], width: int, keys: np.ndarray | None) -> np.ndarray:
        """`merge` of many words of at most `width` characters: their parts, a row each. Without keys no merge is skipped."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        table = np.zeros((len(words), width + 2), np.int32)
        table[:, 1:-1][np.arange(width) < lengths[:, None]] = self.part_of[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        return self.agendas.run(table, None if keys is None else lambda rows, draws: self._some_gaps(keys[rows], draws))

    def _spelled(self, part: int) -> list[int]:
        """Byte pieces of a character that is no piece."""
        return [self.byte[b] for b in (self.names[part] if part < self.others else chr(part - self.others)).encode()]

    def _together(self, words: list[str], keys: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
        """Ids of words of at most `_LONG` characters, each with its key, and how many parts each has."""
        out, n_parts = [b""] * len(words), np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for width, at in tables(lengths):
            table = self._parts(list(map(words.__getitem__, at.tolist())), width, None if keys is None else keys[at])
            held = table > 0
            parts, sizes = table[held], held.sum(1)
            n_parts[at] = sizes
            ids = self.id_of[np.minimum(parts, self.others)]
            odd = ids < 0
            if odd.any():
                spelled = list(map(self._spelled, parts[odd].tolist()))
                times = np.ones(len(ids), np.int64)
                times[odd] = list(map(len, spelled))
                sizes = np.add.reduceat(times, np.cumsum(sizes) - sizes)
                ids = np.repeat(ids, times)
                ids[np.repeat(odd, times)] = np.concatenate(spelled)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            for i, s, e in zip(at.tolist(), [0, *ends], ends):
                out[i] = raw[s:e]
        return out, n_parts

    def _learn(self, words: list[str]) -> None:
        """Plain segmentations of new words. A word of n characters and k parts has n - k merges."""
        first, end = len(self.raw), len(self.raw) + len(words)
        self.known.update(zip(words, range(first, end)))
        if end > len(self.merges):
            self.merges = np.pad(self.merges, (0, 2 * end - len(self.merges)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw, n_parts = self._together(words, None)
        self.raw += [x or None for x in raw]
        self.merges[first:end] = np.where(lengths > _LONG, -1, lengths - n_parts)

    def _drawn(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of occurrences of words, each with its key.

        The first draw either passes over all candidates of a word, which leaves its plain segmentation, or the agenda is run with it.
        """
        if len(self.raw) > _CACHED:
            self._forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = list(map(words.__getitem__, new))
            self._learn(list(dict.fromkeys(fresh)))
            at[new] = list(map(self.known.__getitem__, fresh))
        out = list(map(self.raw.__getitem__, at.tolist()))
        merges = self.merges[at]
        if self.drops:
            some = np.flatnonzero(self._some_gaps(keys, np.zeros(len(keys), np.int64)) < merges)
            for i, x in zip(some.tolist(), self._together(list(map(words.__getitem__, some.tolist())), keys[some])[0]):
                out[i] = x
        for i in np.flatnonzero(merges < 0).tolist():
            out[i] = self._word(words[i], int(keys[i]))
        return out

    def _new_words(self, words: list[tuple[str, int]]) -> list[bytes]:
        return self._drawn([w for w, _ in words], np.array([k for _, k in words], np.uint64))

    def _keys(self, key: int, first: int, n: int) -> np.ndarray:
        """Keys of the words of a document, by place."""
        return mix(np.arange(first, first + n, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(key & _MASK))

    def encode(self, text: str, key: int | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes. `key` draws the skips; without one no merge is skipped. Empty text, no ids."""
        if key is not None:
            return next(self.encode_all([text], [key]))
        if SPACE in text:
            return self._odd(text, None)
        return b"".join([self._word(w, None) for w in self._words(text)])

    def encode_all(self, texts: list[str], keys: list[int]) -> Iterator[bytes]:
        """Ids of many texts in their order; the words of several texts are looked up together."""
        words: list[str] = []
        word_keys: list[np.ndarray] = []
        sizes: list[int | bytes] = []  # words of each text that waits, or its ids
        for text, key in zip(texts, keys, strict=True):
            if SPACE in text:
                sizes.append(self._odd(text, key))
            else:
                found = self._words(text)
                words += found
                word_keys.append(self._keys(key, 0, len(found)))
                sizes.append(len(found))
            if len(words) >= _CHUNK:
                yield from self._joined(words, np.concatenate(word_keys), sizes)
                words, word_keys, sizes = [], [], []
        yield from self._joined(words, np.concatenate([*word_keys, np.zeros(0, np.uint64)]), sizes)

    def _joined(self, words: list[str], keys: np.ndarray, sizes: list[int | bytes]) -> Iterator[bytes]:
        out: list[bytes] = []
        for a in range(0, len(words), _CHUNK):
            out += self._drawn(words[a : a + _CHUNK], keys[a : a + _CHUNK])
        at = 0
        for size in sizes:
            if isinstance(size, bytes):
                yield size
            else:
                yield b"".join(out[at : at + size])
                at += size

    def _words(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _odd(self, text: str, key: int | None) -> bytes:
        """Text with the space sign itself: that becomes byte pieces, which do not decode as a space; the rest is encoded as usual."""
        out, first, place = [], True, 0
        for part in re.split(f"({SPACE})", text):
            if part == SPACE:
                if first:
                    out.append(np.array([self.ids[SPACE]], "<u4").tobytes())
                out.append(np.array([self.byte[b] for b in part.encode()], "<u4").tobytes())
                first = False
            elif part:
                words = self.words.findall((SPACE if first else "") + part.replace(" ", SPACE))
                keys = [None] * len(words) if key is None else self._keys(key, place, len(words)).tolist()
                out += map(self._word, words, keys)
                place += len(words)
                first = False
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids; the space that encoding puts in front goes."""
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=4)
def pieces(path: str, dropout: float = DROPOUT, seed: int = SEED) -> Pieces:
    return Pieces(path, dropout, seed)


def _key(doc_id: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(str(doc_id).encode(), seed) >> 1


def encode_documents(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `ids` (array of int) of every whole text. A null or empty text has no ids; rows of one id draw the same skips, so
    repeated rows are equal. Other columns are ignored; an empty table stays empty."""
    path = vocabulary_path() if path is None else path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path, dropout, seed)
        for batch in batches:
            keys = [_key(d, seed) for d in batch.column(0).to_pylist()]
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in p.encode_all([t or "" for t in batch.column(1).to_pylist()], keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and `text` of rows of (doc_id, ids); null ids decode to the empty text."""
    path = vocabulary_path() if path is None else path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            texts = [p.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(coded.dtypes)['doc_id']}, text string")


def round_trips(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of unsigned 32-bit little-endian ids) and `lossless`: whether the ids decode to the whole text.

    The same ids as `encode_documents`, digested where they are made. A null text counts as empty.
    """
    path = vocabulary_path() if path is None else path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path, dropout, seed)
        for batch in batches:
            n, crc, same = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for t, ids in zip(texts, p.encode_all(texts, [_key(d, seed) for d in batch.column(0).to_pylist()]), strict=True):
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(p.decode(ids) == t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "lossless"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, lossless boolean")
