"""Operator 9: packing of documents into windows by lexical neighbours.

Documents become token ids. Whole windows of a long document stand alone. The rests are dealt to shards by the terms that whole documents
share: among its heaviest terms by BM25, the one that is heaviest for most documents. Each shard holds an inverted index of whole documents
with the counts of the whole corpus: a seed is followed by its best unused neighbours until the window is full. The last of them is cut and
its remainder seeds the next window. The last window of a shard is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.agendas import WIDTHS, Agendas, Numbers, tables
from touchline.llm.common import lists, mix, partitions, run_bounds, slices, utf8, whole_runs, written

WINDOW = 1024
SHARD = 2048  # documents of a shard, about
SEPARATOR = 0
_SEPARATOR_BYTES = np.array([SEPARATOR], "<u4").tobytes()
K1, B = 1.2, 0.75
HEAVY = 16  # heaviest shared terms of a document, among which its group is chosen
LEVELS = 3  # terms by which groups are divided before the salt
#: The split into words of byte-level BPE (a published pattern, fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes do not change between Unicode versions; texts with others go to the tokenizer's own library.
_STABLE = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
_SPACES, _LETTERS, _NUMBERS, _OTHERS, _END, _UNSTABLE = range(6)  # classes of characters in PATTERN; the end of a text; others than _STABLE
_SHORT = 15  # bytes of a word that make its key
_WORDS = 1 << 19  # words whose ids a Python worker keeps
_IDS = 1 << 22  # ids of kept words, about
_BYTES = 1 << 20  # bytes of texts that are split together; longer texts are encoded alone


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level BPE writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _class(c: str) -> int:
    if not _STABLE.fullmatch(c):
        return _UNSTABLE
    if c in "\t\n\v\f\r \x85\xa0":
        return _SPACES
    return {"L": _LETTERS, "N": _NUMBERS}.get(unicodedata.category(c)[0], _OTHERS)


_CLASSES = np.array([_class(chr(c)) for c in range(0x20C1)], np.uint8)  # the last stands for all after it


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of the character of each byte of UTF-8."""
    out = _CLASSES[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        lead, second, third = tail[at], tail[at + 1] & 63, tail[at + 2] & 63
        code = np.where(lead < 0xE0, (lead & 31) << 6 | second, np.where(lead < 0xF0, (lead & 15) << 12 | second << 6 | third, len(_CLASSES)))
        found = _CLASSES[np.minimum(code, len(_CLASSES) - 1)]
        out[at] = found
        out[at + 1] = found
        for n, least in ((2, 0xE0), (3, 0xF0)):
            more = lead >= least
            out[at[more] + n] = found[more]
    return out


def split(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the words of PATTERN start in texts of which each is followed by a byte of class `_END`, a word by itself."""
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    # the last white space before another character starts a word, which goes on after a space
    last = np.flatnonzero((kind[:-1] == _SPACES) & (kind[1:] != _SPACES) & (kind[1:] != _END))
    first[last - (data[last] >= 0x80)] = True
    first[last[data[last] == 32] + 1] = False
    at = np.flatnonzero((data[:-2] == 39) & first[:-2] & (kind[1:-1] == _LETTERS))
    one, two = data[at + 1], data[at + 2]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
    first[at[short | long] + 1] = False
    first[at[short] + 2] = True
    first[at[long] + 3] = True
    return np.flatnonzero(first)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, those of the tokenizer's file.

    The file's ids are merge ranks, so its vocabulary also drives the faster rank encoder for common characters. Texts that hold the
    literal of an added token go to the tokenizer itself, which gives that token's id. Many texts are split together, and the ids of a
    word are kept: a word of few bytes is found by these bytes, others by a dict.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.special_bytes = re.compile(self.special.pattern.encode())
        to = _byte_alphabet()
        ranks = {bytes(to[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # a part is an id and 1; the bytes of a word are merged by the file's list
        number = {t: i + 1 for t, i in self.tokenizer.get_vocab().items()}
        self.part_of = np.zeros(256, np.int32)
        self.part_of[list(to.values())] = [number[c] for c in to]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(self.tokenizer.to_str())["model"]["merges"]]
        pairs = {(number[x], number[y]): (r, number[x + y]) for r, (x, y) in enumerate(merges)}
        left, right, rank, whole = np.array([(*k, *v) for k, v in pairs.items()], np.int64).T
        self.agendas = Agendas(left, right, rank, whole, max(number.values()) + 1)
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        self._forget()

    def _forget(self) -> None:
        """Kept words: numbers by key, the bytes of short ones, numbers of the others, and the ids of all; word 0 is the separator."""
        self.found, self.low, self.high = Numbers(_WORDS), np.zeros(_WORDS + 1, np.uint64), np.zeros(_WORDS + 1, np.uint64)
        self.others: dict[bytes, int] = {}
        self.n, self.starts, self.sizes = 1, np.zeros(_WORDS + 1, np.int64), np.zeros(_WORDS + 1, np.int64)
        self.ids, self.end = np.full(1 << 16, SEPARATOR, np.uint32), 1
        self.sizes[0] = 1

    def _keep(self, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new words, whose ids are kept from now on."""
        numbers = np.arange(self.n, self.n + len(at))
        self.n += len(at)
        for width, some in tables(sizes):
            table = np.zeros((len(some), width + 2), np.int32)
            places = np.arange(width)
            inside = places < sizes[some, None]
            table[:, 1:-1][inside] = self.part_of[data[(at[some, None] + places)[inside]]]
            parts = self.agendas.run(table)
            held = parts > 0
            self._store(numbers[some], parts[held] - 1, held.sum(1))
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            ids = self.fast.encode_ordinary(data[at[i] : at[i] + sizes[i]].tobytes().decode())
            self._store(numbers[i : i + 1], np.array(ids), np.array([len(ids)]))
        return numbers

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)])
        self.ids[self.end : self.end + len(ids)] = ids
        self.sizes[numbers], self.starts[numbers] = sizes, self.end + np.cumsum(sizes) - sizes
        self.end += len(ids)

    def _numbers(self, data: np.ndarray, at: np.ndarray, sizes: np.ndarray, again: bool = False) -> np.ndarray:
        """Numbers of the words that start at `at`; `data` goes on for 16 bytes after the last."""
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        short = np.minimum(sizes, _SHORT)
        low = eight[at] & self.masks[np.minimum(short, 8)]
        high = eight[at + 8] & self.masks[np.maximum(short - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)
        keys = mix(low) + high * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        out = self.found.find(keys)
        new = np.flatnonzero((out < 0) & (sizes <= _SHORT))
        fresh = new[np.unique(keys[new], return_index=True)[1]]
        if self.n + len(fresh) > _WORDS and not again:
            self._forget()
            return self._numbers(data, at, sizes, True)
        if len(fresh):
            numbers = self._keep(data, at[fresh], sizes[fresh])
            self.found.add(keys[fresh], numbers)
            self.low[numbers], self.high[numbers] = low[fresh], high[fresh]
            out[new] = self.found.find(keys[new])
        rest = np.flatnonzero((sizes > _SHORT) | (self.low[out] != low) | (self.high[out] != high))
        words = [data[s:e].tobytes() for s, e in zip(at[rest].tolist(), (at + sizes)[rest].tolist())]
        more = {w: i for w, i in zip(words, rest.tolist()) if w not in self.others}
        if self.n + len(more) > _WORDS and not again:
            self._forget()
            return self._numbers(data, at, sizes, True)
        which = np.array([*more.values()], np.int64)
        self.others |= zip(more, self._keep(data, at[which], sizes[which]).tolist())
        out[rest] = list(map(self.others.__getitem__, words))
        return out

    def _together(self, data: np.ndarray, kind: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Ids of texts, each with the separator."""
        if self.end > _IDS:
            self._forget()
        ends = np.cumsum(lengths) + np.arange(len(lengths))
        inside = np.ones(len(data) + len(lengths), bool)
        inside[ends] = False
        whole, kinds = np.zeros(len(inside) + 16, np.uint8), np.full(len(inside), _END, np.uint8)
        whole[: len(inside)][inside], kinds[inside] = data, kind
        at = split(whole[: len(inside)], kinds)
        sizes = np.diff(at, append=len(inside))
        end = kinds[at] == _END
        numbers = np.zeros(len(at), np.int64)
        numbers[~end] = self._numbers(whole, at[~end], sizes[~end])
        sizes = self.sizes[numbers]
        stops = np.cumsum(sizes)
        raw = self.ids[np.repeat(self.starts[numbers] - stops + sizes, sizes) + np.arange(stops[-1])].astype("<u4").tobytes()
        bounds = (4 * stops[end]).tolist()
        return [raw[s:e] for s, e in zip([0, *bounds], bounds)]

    def encode_all(self, column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
        """Ids of each text of a column, with the separator after them; a null is an empty text."""
        data, offsets = utf8(column)
        for a, b in slices(offsets, _BYTES):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            lengths = np.diff(bounds)
            kind = _classes(part)
            alone = np.flatnonzero(kind == _UNSTABLE)
            alone = np.concatenate([alone, np.array([m.start() for m in self.special_bytes.finditer(part)], np.int64)])
            plain = lengths <= _BYTES
            plain[np.searchsorted(bounds, alone, "right") - 1] = False
            if not plain.all():
                inside = np.repeat(plain, lengths)
                part, kind = part[inside], kind[inside]
            coded = iter(self._together(part, kind, lengths[plain]) if plain.any() else [])
            for i, x in enumerate(plain.tolist()):
                yield next(coded) if x else self.encode(bytes(data[offsets[a + i] : offsets[a + i + 1]]).decode()) + _SEPARATOR_BYTES

    def encode(self, text: str) -> bytes:
        if (text.isascii() or _STABLE.fullmatch(text)) and not self.special.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def counts_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs."""
    ids = np.sort(ids)
    bounds = run_bounds(ids)
    return ids[bounds[:-1]], np.diff(bounds)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Checksums of the whole windows and ids of the rest of each document; distinct ids with counts of documents with both."""
    wide = 4 * WINDOW
    for batch in batches:
        coded = encoder(path).encode_all(batch.column("text"))
        for a in range(0, batch.num_rows, 256):
            rows = batch.slice(a, 256)
            out: dict[str, list] = {c: [] for c in ("tokens", "whole", "rest", "terms", "counts")}
            for ids in islice(coded, rows.num_rows):
                cut = len(ids) // wide * wide
                terms, counts = counts_of(np.frombuffer(ids, "<u4")) if cut else (None, None)
                for c, x in (("tokens", len(ids) // 4), ("whole", [zlib.crc32(ids[s : s + wide]) for s in range(0, cut, wide)]), ("rest", ids[cut:]), ("terms", terms.tobytes() if cut else None), ("counts", counts.astype("<u4").tobytes() if cut else None)):
                    out[c].append(x)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("salt"), *(pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True))], names=["doc_id", "salt", *out])


def _terms(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct ids and their counts in each whole document; the ids of many documents are sorted together."""
    rests, terms, counts = (batch.column(c).to_pylist() for c in ("rest", "terms", "counts"))
    for a in range(0, len(rests), 256):
        known = terms[a : a + 256]
        raw = [b"" if t is not None else r for r, t in zip(rests[a : a + 256], known)]
        ids = np.repeat(np.arange(len(raw)) << 32, [len(r) // 4 for r in raw]) | np.frombuffer(b"".join(raw), "<u4")
        ids.sort()
        bounds = run_bounds(ids)
        first, times = ids[bounds[:-1]], np.diff(bounds)
        ends = np.searchsorted(first, np.arange(len(raw) + 1) << 32).tolist()
        found = first.astype(np.uint32)  # the lower half
        for t, c, s, e in zip(known, counts[a : a + 256], ends, ends[1:]):
            yield (found[s:e], times[s:e]) if t is None else (np.frombuffer(t, "<u4"), np.frombuffer(c, "<u4").astype(np.int64))


@dataclass
class Corpus:
    """Documents, their mean length, and by term the documents that hold it; at most one entry for each id of the tokenizer."""

    n: int
    mean: float
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents) of a task; term -1 has all documents, -2 all ids."""
    df, n, total = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        n, total = n + batch.num_rows, total + int(batch.column("tokens").to_numpy().sum())
        found = [t for t, _ in _terms(batch)]
        if found:
            more = np.bincount(np.concatenate(found))
            width = max(len(df), len(more))
            df = np.pad(df, (0, width - len(df))) + np.pad(more, (0, width - len(more)))
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at]).astype(np.int64)), pa.array(np.concatenate([[n, total], df[at]]).astype(np.int64))], names=["term", "n"])


def corpus_counts(coded: DataFrame) -> Corpus:
    """Counts over all documents of the table."""
    found = {r.term: r.n for r in coded.select("tokens", "rest", "terms", "counts").mapInArrow(_counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, total / max(n, 1), df)


def _weighed(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[pa.RecordBatch]:
    """Adds the heaviest terms of each whole document that other documents hold too."""
    idf = corpus.idf
    for batch in batches:
        heavy = []
        lengths, found = batch.column("tokens").to_numpy(), _terms(batch)
        for a in range(0, batch.num_rows, 256):
            some = list(islice(found, 256))
            terms, tf = np.concatenate([t for t, _ in some]), np.concatenate([c for _, c in some])
            length = np.repeat(lengths[a : a + 256], [len(t) for t, _ in some])
            rare = corpus.df[terms] > 1
            ends = np.cumsum(rare)[np.cumsum([len(t) for t, _ in some]) - 1].tolist()
            terms, tf, length = terms[rare], tf[rare], length[rare]
            below = -(idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / corpus.mean)))
            heavy += [terms[s:e][np.argsort(below[s:e], kind="stable")[:HEAVY]].astype(np.int32) for s, e in zip([0, *ends], ends)]
        yield pa.RecordBatch.from_arrays([*batch.columns, lists(heavy, pa.int32())], names=[*batch.schema.names, "heavy"])


@dataclass
class Deal:
    """Groups of documents by the terms they share, and the shard of each group.

    A document's first term is that of its heavy ones which most documents have among theirs; its next terms follow in that order. A group
    of more documents than a shard is divided by the next term, and after the last by the salt, so a hot group fills many shards.
    """

    common: np.ndarray
    bins: dict[tuple[int, ...], int] = field(default_factory=dict)
    shards: dict[tuple[int, ...], int] = field(default_factory=dict)

    def groups(self, batch: pa.RecordBatch) -> list[tuple[int, ...]]:
        heavy = batch.column("heavy")
        offsets, flat = heavy.offsets.to_numpy(), heavy.values.to_numpy()
        flat, ends = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
        sizes = np.diff(ends)
        ordered = flat[np.lexsort((flat, -self.common[flat], np.repeat(np.arange(len(sizes)), sizes)))]
        by = np.full((LEVELS + 1, len(sizes)), -1, np.int64)  # the terms by which a document is dealt, then its salt
        for k in range(LEVELS):
            by[k, sizes > k] = ordered[ends[:-1][sizes > k] + k]
        by[LEVELS] = batch.column("salt").to_numpy()
        out = []
        for first, *rest in zip(by[0].tolist(), *mix(by[1:].view(np.uint64)).tolist()):
            group: tuple[int, ...] = (first,)
            while (bins := self.bins.get(group)) is not None:
                group += (rest[len(group) - 1] % bins,)
            out.append(group)
        return out


def make_deal(weighed: DataFrame, shard: int) -> Deal:
    """Counts of groups are collected: at most one for each id of the tokenizer, then about two for each shard."""
    heavy = weighed.select("heavy", "salt")
    popular = heavy.select(F.explode("heavy").alias("term")).groupBy("term").count().collect()
    common = np.zeros(max((r["term"] for r in popular), default=0) + 1, np.int64)
    common[[r["term"] for r in popular]] = [r["count"] for r in popular]
    deal, sizes = Deal(common), {}
    for level in range(LEVELS + 1):

        def tally(batches: Iterator[pa.RecordBatch], deal: Deal = deal, level: int = level) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                seen.update(g for g in deal.groups(batch) if len(g) == level + 1)
            yield pa.RecordBatch.from_arrays([pa.array([list(g) for g in seen], pa.list_(pa.int64())), pa.array(list(seen.values()), pa.int64())], names=["g", "n"])

        found = {tuple(r.g): r.n for r in heavy.mapInArrow(tally, "g array<long>, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
        hot = {g: -(-n // shard) for g, n in found.items() if n > (2 if level else 1) * shard and level < LEVELS}
        sizes |= {g: n for g, n in found.items() if g not in hot}
        if not hot:
            break
        deal.bins |= hot
    at, filled = 0, 0
    for g in sorted(sizes):
        if filled and filled + sizes[g] > shard:
            at, filled = at + 1, 0
        deal.shards[g] = at
        filled += sizes[g]
    return deal


Counted = tuple[np.ndarray, np.ndarray]  # distinct ids of a document and their counts


class Bm25:
    """Inverted index over counted documents with scores of a query's distinct ids for all of them.

    Weights are whole multiples of 2 ** -30, so that sums are exact and their order is free: terms of a third of the documents are rows of
    a matrix, one number a document, the others have postings.
    """

    def __init__(self, docs: list[np.ndarray] | list[Counted], corpus: Corpus | None = None):
        """Counts of documents by term are those of `corpus`, without one those of `docs`."""
        counted = [d if isinstance(d, tuple) else counts_of(d) for d in docs]
        self.n = len(counted)
        terms = np.concatenate([t for t, _ in counted]).astype(np.int64)
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(self.n), [len(t) for t, _ in counted])[order]
        tf = np.concatenate([c for _, c in counted])[order]
        self.terms, lengths = terms[order], np.array([c.sum() for _, c in counted])
        df = np.bincount(self.terms)
        corpus = corpus or Corpus(self.n, lengths.mean(), df)
        norm = K1 * (1 - B + B * lengths / corpus.mean)
        self.weights = np.round(corpus.idf[self.terms] * tf * (K1 + 1) / (tf + norm[self.docs]) * (1 << 30)) / (1 << 30)
        common = np.flatnonzero(3 * df >= self.n)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.columns, self.rows = np.arange(self.n), np.zeros((len(common), self.n))
        dense = self.row[self.terms] >= 0
        self.rows[self.row[self.terms[dense]], self.docs[dense]] = self.weights[dense]
        self._postings(~dense)

    def _postings(self, kept: np.ndarray) -> None:
        self.terms, self.docs, self.weights = self.terms[kept], self.docs[kept], self.weights[kept]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=len(self.row)))])

    def keep(self, wanted: np.ndarray) -> None:
        """Drop the weights of all documents but the wanted ones."""
        self._postings(wanted[self.docs])
        held = wanted[self.columns]
        self.columns, self.rows = self.columns[held], np.ascontiguousarray(self.rows[:, held])

    def scores(self, tokens: np.ndarray) -> np.ndarray:
        return self.scores_of(np.unique(tokens))

    def scores_of(self, terms: np.ndarray) -> np.ndarray:
        """Scores for distinct terms."""
        row = self.row[terms]
        asked = np.zeros(len(self.rows))
        asked[row[row >= 0]] = 1.0
        rare = terms[row < 0]
        runs = [slice(a, b) for a, b in zip(self.starts[rare].tolist(), self.starts[rare + 1].tolist()) if a < b]
        out = np.bincount(np.concatenate([self.docs[r] for r in runs]), np.concatenate([self.weights[r] for r in runs]), minlength=self.n) if runs else np.zeros(self.n)
        out[self.columns] += asked @ self.rows
        return out


def fill(docs: list[np.ndarray], window: int = WINDOW, known: list[np.ndarray] | list[Counted] | None = None, corpus: Corpus | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); every id lies in one piece and all windows but the last are full.

    `known` has the ids by which each is found, those of its whole document; without it the arrays themselves count.
    """
    if not docs:
        return
    counted = [d if isinstance(d, tuple) else counts_of(d) for d in (docs if known is None else known)]
    index = Bm25(counted, corpus)
    unused, left, first = np.ones(len(docs), bool), len(docs), 0
    indexed = left  # documents with postings; those of used ones go when they are an eighth
    seed, at = -1, 0  # the document that is being cut, and how far it is used
    while left or seed >= 0:
        if seed < 0:
            while not unused[first]:
                first += 1
            seed, at = first, 0
            unused[first] = False
            left -= 1
        n = min(window, len(docs[seed]) - at)
        out, room = [(seed, at, n)], window - n
        asked, (seed, at) = seed, (seed, at + n) if at + n < len(docs[seed]) else (-1, 0)
        if room and left:
            if 8 * left < 7 * indexed:
                index.keep(unused)
                indexed = left
            score = np.where(unused, index.scores_of(counted[asked][0]), -1.0)
            while room and left:
                best = int(score.argmax())
                score[best] = -1.0
                unused[best] = False
                left -= 1
                n = min(room, len(docs[best]))
                out.append((best, 0, n))
                room -= n
                if n < len(docs[best]):
                    seed, at = best, n
        yield out


def _cut(pieces: list[tuple[int, int, int]], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """A window that is not full, cut into sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        out, room = [], size
        while room:
            d, s, n = pieces[0]
            m = min(n, room)
            out.append((d, s, m))
            room -= m
            pieces = [(d, s + m, n - m), *pieces[1:]] if m < n else pieces[1:]
        total -= size
        yield out


def _packed(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, "shard"):
        shards = table.column("shard").to_numpy()
        bounds = run_bounds(shards)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = table.slice(s, e - s)
            tokens = part.column("tokens").to_numpy()
            rows, k = [], 0
            for i, whole in enumerate(part.column("whole").to_pylist()):
                for w, crc in enumerate(whole):
                    rows.append((i, w * WINDOW, WINDOW, crc, k, 0))
                    k += 1
            raw = part.column("rest").to_pylist()
            rests = [i for i, x in enumerate(raw) if x]
            known = list(_terms(part))
            for window in fill([np.frombuffer(raw[i], "<u4") for i in rests], known=[known[i] for i in rests], corpus=corpus):
                for seq in [window] if sum(p[2] for p in window) == WINDOW else _cut(window):
                    offset = 0
                    for d, a, n in seq:
                        i = rests[d]
                        rows.append((i, int(tokens[i]) // WINDOW * WINDOW + a, n, zlib.crc32(raw[i][4 * a : 4 * (a + n)]), k, offset))
                        offset += n
                    k += 1
            at, begin, length, check, seq, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks().take(pa.array(at)), pa.array(begin), pa.array(length), pa.array(check), pa.array(tokens[at]), pa.array((int(shards[s]) << 32) + seq), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `path` names the tokenizer's file on every executor. A document is its ids and then id 0; a null or empty text is that id alone. All
    sequences hold 1024 ids, but for those of a shard's last window, whose lengths are powers of two. Repeated rows are packed once
    each; rows with a null id too. An empty table gives no rows; other columns are ignored. Ids are written to the shared folder, counted
    over the whole table and then dealt to shards of about `shard` documents that share terms.
    """
    path = vocabulary_path() if path is None else path
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.xxhash64("doc_id", "text"))
    schema = f"doc_id {kind}, salt long, tokens long, whole array<long>, rest binary, terms binary, counts binary"
    coded = written(rows.mapInArrow(lambda batches: _coded(batches, path), schema), "coded")
    corpus = corpus_counts(coded)
    weighed = written(coded.mapInArrow(lambda batches: _weighed(batches, corpus), f"{schema}, heavy array<int>"), "weighed")
    deal = make_deal(weighed, shard)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = pa.array([deal.shards[g] for g in deal.groups(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([shards, *batch.columns[:-1]], names=["shard", *batch.schema.names[:-1]])

    shards = max(deal.shards.values(), default=0) + 1
    pieces = weighed.mapInArrow(dealt, f"shard long, {schema}")
    pieces = pieces.repartition(min(shards, max(partitions(docs.sparkSession), 1)), "shard").sortWithinPartitions("shard", "doc_id", "salt")
    return pieces.mapInArrow(lambda batches: _packed(batches, corpus), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
