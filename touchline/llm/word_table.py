"""Operator 11: byte-level BPE through a table of distinct words, and decoding through an id-to-piece join.

Texts are split into words once. A block of texts keeps its words by number, in the order of first use, with the numbers of all positions.
The distinct words of the blocks meet by a hash of the word, and each is encoded once for the whole corpus; its ids go back to the blocks that
use it and are set in by position. Blocks are written bucketed by their number, so positions stay where they were written and only distinct
words and their ids are shuffled. A word that fills the corpus is one row of each block, so no word is hot.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import partitions, run_bounds, utf8, whole_runs
from touchline.sources.shared import new_path

BLOCK = 12 << 20  # characters of a block, about
WORDS = 1 << 20  # distinct words after which a block is closed
SHARD = 1 << 18  # entries (block, word) of a shard of the word table, about
_OUT = 1 << 20  # ids of a batch, about
#: Characters whose classes do not change between Unicode versions; words of texts with others come from the tokenizer's own library.
_STABLE = [(0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(kind: str) -> str:
    """The stable characters of a general category, as the inside of a character class."""
    found = [c for a, b in _STABLE for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind]
    return "".join(map(re.escape, map(chr, found)))


class Words:
    """Splits texts into the words of a tokenizer file, and encodes single words."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + ("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)") + ")")
        self.stable = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _STABLE) + "]*")
        letters, digits = _class("L"), _class("N")
        # the published split of byte-level BPE, with classes of stable characters
        self.words = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+")
        self.bytes_of = _bytes_of_characters()
        ranks = {self._raw(t): i for t, i in self.tokenizer.get_vocab().items() if t not in self.added}
        # the file's ids are merge ranks, so a rank encoder gives its ids
        self.ranks = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _raw(self, piece: str) -> bytes:
        return bytes(self.bytes_of[c] for c in piece)

    def split(self, text: str) -> list[str]:
        """Words that make up the text; a literal of an added token is a word."""
        if not self.stable.fullmatch(text):
            return [w for part in self._parts(text) for w in ([part] if part in self.added else [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)])]
        return [w for part in self._parts(text) for w in ([part] if part in self.added else self.words.findall(part))]

    def _parts(self, text: str) -> list[str]:
        """The text cut at literals of added tokens, which are parts themselves."""
        return [p for p in self.cut.split(text) if p] if self.cut.search(text) else [text]

    def encode(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        return self.ranks.encode_ordinary(word)

    def pieces(self) -> pa.Table:
        """(id, piece) of all ids; the piece as bytes."""
        vocabulary = self.tokenizer.get_vocab()
        rows = sorted((i, t.encode() if t in self.added else self._raw(t)) for t, i in vocabulary.items())
        return pa.table({"id": pa.array([i for i, _ in rows], pa.int32()), "piece": pa.array([t for _, t in rows], pa.large_binary())})


def _bytes_of_characters() -> dict[str, int]:
    """The printable characters by which byte-level BPE writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


class _Block:
    """Words by number and positions of the texts read so far."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list = []
        self.counts: list[int] = []
        self.positions: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: object, words: list[str], size: int) -> None:
        known = self.known
        for w in words:
            if w not in known:
                known[w] = len(known)
        self.ids.append(doc_id)
        self.counts.append(len(words))
        self.positions.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        self.size += size


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their low to high bytes apart, which compress better so."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _packed_words(words: pa.StringArray) -> tuple[bytes, bytes]:
    """Sizes and bytes of words."""
    data, offsets = utf8(words)
    return _packed(np.diff(offsets)), zstandard.ZstdCompressor(level=1).compress(data[offsets[0] : offsets[-1]].tobytes())


def _unpacked_words(sizes: bytes, data: bytes) -> pa.LargeStringArray:
    ends = np.concatenate([[0], np.cumsum(_unpacked(sizes), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data)))


def _split(batches: Iterator[pa.RecordBatch], path: str, block: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per block: its number, its rows with their counts of words, the packed positions, and its words in the order of their numbers."""
    words = words_of(path)
    number, held = TaskContext.get().partitionId() << 32, _Block()

    def row() -> pa.RecordBatch:
        positions = _packed(np.concatenate([*held.positions, np.zeros(0, np.uint32)]))
        sizes, data = _packed_words(pa.array(list(held.known), pa.large_string()))
        values = {"block": [number], "doc_id": [held.ids], "counts": [held.counts], "positions": [positions], "entries": [len(held.known)], "sizes": [sizes], "words": [data]}
        kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values.values(), kinds, strict=True)], names=list(values))

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, doc_id in enumerate(ids):
            text = texts[i].as_py()
            held.add(doc_id, words.split(text), len(text))
            if held.size >= block or len(held.known) >= WORDS:
                yield row()
                number, held = number + 1, _Block()
    if held.ids:
        yield row()


def _dealt(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The words of a block by shard of the word table: a row per block and shard with the words and their numbers (as steps)."""
    for batch in batches:
        for number, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "words")), strict=True):
            words = _unpacked_words(sizes, data)
            shard = np.array([zlib.crc32(w.encode()) % shards for w in words.to_pylist()], np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = run_bounds(shard[order])
            runs = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            packed = [(_packed(np.diff(run, prepend=0)), *_packed_words(words.take(pa.array(run)))) for run in runs]
            columns = [pa.array(x, pa.binary()) for x in zip(*packed, strict=True)] or [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(shard[order[bounds[:-1]]]), pa.array(np.full(len(runs), number)), *columns], names=["shard", "block", "numbers", "sizes", "words"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of the words of whole shards, each distinct word encoded once, by block."""
    encode = words_of(path).encode
    for table in whole_runs(batches, "shard"):
        shard = table.column("shard").to_numpy()
        bounds = run_bounds(shard)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = table.slice(a, b - a)
            words = [_unpacked_words(s, w) for s, w in zip(rows.column("sizes").to_pylist(), rows.column("words").to_pylist(), strict=True)]
            used = pc.dictionary_encode(pa.concat_arrays(words))
            coded = [encode(w) for w in used.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((i for x in coded for i in x), np.int32, int(sizes.sum()))
            ends, at = np.concatenate([[0], np.cumsum(sizes)]), used.indices.to_numpy()
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            out = [(_packed(sizes[at[c:d]]), _packed(_taken(flat, ends, at[c:d])[0])) for c, d in zip(starts[:-1], starts[1:], strict=True)]
            columns = [pa.array(x, pa.binary()) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("block").combine_chunks(), rows.column("numbers").combine_chunks(), *columns], names=["block", "numbers", "sizes", "ids"])


def _taken(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` numbered by `at` one after the other, and their ends with 0 in front."""
    sizes = ends[at + 1] - ends[at]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(out[-1]) + np.repeat(ends[at] - out[:-1], sizes)], out


def _set_in(block: pa.Table, words: pa.Table, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of the rows of one block from its positions and the ids of its words."""
    numbers, sizes, flat = (np.concatenate([f(x) for x in words.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c, f in (("numbers", lambda x: np.cumsum(_unpacked(x), dtype=np.int64)), ("sizes", _unpacked), ("ids", _unpacked)))
    flat = flat.astype(np.int32)
    where = np.empty(len(numbers), np.int64)
    where[numbers] = np.arange(len(numbers))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for k in range(block.num_rows):
        doc_ids, counts = block.column("doc_id")[k].values, np.array(block.column("counts")[k].as_py(), np.int64)
        positions = _unpacked(block.column("positions")[k].as_py())
        bounds = np.concatenate([[0], np.cumsum(counts)])
        a = 0
        while a < len(counts):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _OUT, "right")) - 1)
            ids, at = _taken(flat, ends, where[positions[bounds[a] : bounds[b]]])
            offsets = at[bounds[a : b + 1] - bounds[a]]
            yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a).cast(kind), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])
            a = b


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id and `ids` (array of int) of every whole text, one row per row, as the tokenizer's file gives them without special tokens.

    A null or empty text has no ids; rows with a null id and repeated rows stay as they are. Other columns are ignored; an empty table gives
    no rows. `path` names the file on every executor. Split texts are written to the shared folder as an external table.
    """
    path = vocabulary_path() if path is None else path
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = _arrow_type(rows, "doc_id")
    split = rows.mapInArrow(lambda batches: _split(batches, path, block, arrow), f"block long, doc_id array<{kind}>, counts array<int>, positions binary, entries long, sizes binary, words binary")
    name = f"split_{uuid.uuid4().hex}"
    split.write.bucketBy(max(partitions(spark), 1), "block").format("parquet").option("compression", "zstd").option("path", new_path(spark, "split")).saveAsTable(name)
    held = spark.table(name)
    entries = held.agg(F.sum("entries")).first()[0] or 0
    shards = max(1, -(-entries // shard))
    dealt = held.select("block", "sizes", "words").mapInArrow(lambda batches: _dealt(batches, shards), "shard long, block long, numbers binary, sizes binary, words binary")
    dealt = dealt.repartition(min(shards, max(partitions(spark), 1)), "shard").sortWithinPartitions("shard")
    table = dealt.mapInArrow(lambda batches: _encoded(batches, path), "block long, numbers binary, sizes binary, ids binary")

    def set_in(blocks: pa.Table, words: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_set_in(blocks, words, arrow)), pa.schema([("doc_id", arrow), ("ids", pa.list_(pa.int32()))]))

    blocks = held.select("block", "doc_id", "counts", "positions")
    return blocks.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(set_in, f"doc_id {kind}, ids array<int>")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _texts(pieces: pa.LargeBinaryArray, bounds: np.ndarray) -> pa.StringArray:
    """Runs of pieces as texts; pieces that follow each other already lie so in memory."""
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1][bounds]
    texts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends.astype(np.int32)), pieces.buffers()[2])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
    return texts


def _decoded(batches: Iterator[pa.RecordBatch], pieces: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows with the pieces of their ids joined by id and put together in the order of the ids; ids without a piece give nothing."""
    known, piece = (pieces[c].combine_chunks() for c in ("id", "piece"))
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _OUT, "right")) - 1)
            part = batch.slice(a, b - a)
            flat = part.column("ids").flatten()
            found = pc.fill_null(piece.take(pc.index_in(flat, value_set=known)), b"")
            texts = _texts(found, bounds[a : b + 1] - bounds[a])
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*batch.schema.names, "text"])
            a = b


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `coded` (with `ids`, array of int) with `text`, the pieces of the ids put together; null ids decode to the empty text.

    The id-to-piece table has one row per id of the vocabulary, which bounds it, so it is sent to the tasks and joined there. Bytes
    that are no UTF-8 become U+FFFD; ids outside the vocabulary give nothing.
    """
    pieces = words_of(vocabulary_path() if path is None else path).pieces()
    rows = coded.select(*[c for c in coded.columns if c != "text"])
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(lambda batches: _decoded(batches, pieces), f"{schema}, text string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their ids and a digest of them."""
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.flatten().to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        sums = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.string()), ids], names=["doc_id", "n_tokens", "ids_sha256", "ids"])


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of unsigned 32-bit little-endian ids) and decoded_sha256 of every text, encoded and decoded again.

    Digests and texts of the ids of `encode_documents` are made in one pass, as `decode_documents` makes them.
    """
    path = vocabulary_path() if path is None else path
    coded, pieces = encode_documents(docs, path), words_of(path).pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(_digested(batches), pieces):
            yield batch.select(["doc_id", "n_tokens", "ids_sha256", "text"])

    rows = coded.mapInArrow(run, f"doc_id {dict(coded.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, text string")
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
