"""Token ids of whole texts, and a binary file format with Elias-Fano document boundaries.

File format: Parquet as the container (so that any store Spark reaches can hold it), one row
per block. A block holds whole documents; its ``payload`` is

    magic 4s | id width u8 | low bits u8 | 2 unused | documents u64 | ids u64
    | upper bytes u64 | lower bytes u64 | samples u64 | upper | lower | samples u32 | ids

where upper/lower are the Elias-Fano code of the documents' end offsets in the block and
samples hold the position of every 64th one bit of upper, so that select(i) reads a bounded
stretch. Rows also hold shard, block, ids_before (in the shard) and doc_ids.
"""

from __future__ import annotations

import string
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbis.session import checked_broadcast

MAGIC = b"EFT1"
HEADER = struct.Struct("<4sBBHQQQQQ")
SAMPLE = 64
BLOCK_IDS = 1 << 18
TOKENIZER = "byte_bpe_50k.json"
#: Punctuation that forms one piece when it follows letters; an apostrophe may begin a contraction.
MARKS = string.punctuation.replace("'", "")

_ENCODERS: dict[str, "WordEncoder"] = {}


class Pieces(dict):
    """Ids by word, for words that a blank precedes; a missing word is encoded, and kept if it is short.

    The byte-level pre-tokenizer keeps letters with one blank before them whole, and a run of
    punctuation without apostrophes after them too, so these go straight to the BPE model.
    """

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.general, self.tokenize, self.alphabet = encoder.general, encoder.tokenizer.model.tokenize, encoder.alphabet
        self.code = encoder.dtype.char
        self.tails: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def renew(self) -> None:
        """Begin a new generation; what is still asked for comes over from the one before."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        if word in self.older:
            ids = self[word] = self.older[word]
            return ids
        core = word.rstrip(MARKS)
        if core.isalpha():
            if core == word:
                ids = self.letters("\u0120", core)
            else:
                ids = self[core] + self.tail(word[len(core) :])
        elif core[:1] == "\n" and core[1:].isalpha():
            # A piece that starts with a line feed has lost only the blank added by the encoder.
            ids = self.tail("\n") + self.letters("", core[1:]) + (self.tail(word[len(core) :]) if core != word else b"")
        else:
            ids = self.general(word if word[:1] == "\n" else " " + word)
        if len(word) <= 48:
            self[word] = ids
        return ids

    def letters(self, before: str, core: str) -> bytes:
        plain = core if core.isascii() else core.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.tokenize(before + plain)]).tobytes()

    def tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = self.general(marks)
        return self.tails[marks]


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct space-delimited piece encoded once.

    The byte-level pre-tokenizer always splits between a non-space character and a following
    space or line feed, so a text's ids are its pieces' ids in a row. Texts with doubled or
    unusual white space are cut only at positions where that holds. Added tokens, which the library
    looks for in the raw text first, cut it before; if one of them also takes blanks beside it or whole words
    only, texts that hold one go to the library whole. Other kinds of tokenizers get whole texts.
    The store begins a new generation between texts once it has ``most`` pieces, and keeps one older; a piece has at most 48 characters.
    """

    DOUBLED = ("  ", " \n", "\n ", "\n\n")
    UNUSUAL = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")

    def __init__(self, path: str, most: int = 400_000):
        import gc
        import os
        import re

        gc.set_threshold(200_000, 20, 100)  # the store's strings hold no cycles, and make collections long
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.most = most
        # The byte alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        before = self.tokenizer.pre_tokenizer
        self.by_model = type(before) is ByteLevel and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([k], self.dtype).tobytes() for k, t in added.items()}
        self.simple = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.cut = re.compile(r"(?<=\S)(?=[ \n])").split
        self.pieces = Pieces(self)

    def general(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, word: str) -> bytes:
        return self.pieces[word[1:]] if word[:1] == " " and word[1:2] not in ("", " ", "\n") else self.general(word)

    def encode(self, text: str) -> bytes:
        """Little-endian ids, self.dtype wide."""
        if not self.by_model:
            return self.general(text)
        if self.added and any(x in text for x in self.added):
            if not self.simple:
                return self.general(text)
            return b"".join(self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(self.cut_added(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.pieces) > self.most:
            self.pieces.renew()
        if any(x in text for x in self.DOUBLED) or any(x in text for x in self.UNUSUAL):
            return b"".join(map(self.piece, self.cut(text)))
        words = text.replace("\n", " \n").split(" ")
        return (self.general(words[0]) if words[0] else b"") + b"".join(map(self.pieces.__getitem__, words[1:]))


def encoder(path: str | None) -> WordEncoder:
    """One encoder per worker process and file. None: the public 50k byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str | None, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids (end id last) of each row of (doc_id, text) batches, few texts at a time."""
    enc = encoder(path)
    end = np.array([end_id], enc.dtype).tobytes()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        k = 0
        while k < len(ids):
            n, chars = 0, 0
            part: list[str] = []
            while k + n < len(ids) and n < 2000 and chars < 8_000_000:
                part.append(texts[k + n].as_py() or "")
                chars += len(part[-1])
                n += 1
            for doc_id, own in zip(ids.slice(k, n).to_pylist(), map(enc.encode, part)):
                yield doc_id, np.frombuffer(own + end, enc.dtype)
            k += n


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# --- Elias-Fano -----------------------------------------------------------------------------


def ef_encode(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Code of a non-decreasing array: number of low bits, upper bits, lower bits, select samples."""
    n = len(ends)
    ends = ends.astype(np.uint64)
    low = max(0, int(np.log2(max(1, int(ends[-1]) // n)))) if n else 0
    at = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    bits[at] = 1
    lower = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return low, np.packbits(bits, bitorder="little").tobytes(), np.packbits(lower.ravel(), bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes()


def ef_select(i: np.ndarray, low: int, upper: bytes, lower: bytes, samples: bytes) -> np.ndarray:
    """The values at the places i. Of upper only the stretches between samples that hold them are read, of lower only their bits."""
    i = np.asarray(i, np.int64)
    marks = np.append(np.frombuffer(samples, "<u4").astype(np.int64), 8 * len(upper))
    at = np.empty(len(i), np.int64)
    stretch = i // SAMPLE
    for g in np.unique(stretch):
        a, b = marks[g], marks[g + 1]
        own = stretch == g
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(upper, np.uint8, (b + 7) // 8 - a // 8, a // 8), bitorder="little")[a % 8 :])
        at[own] = a + ones[i[own] % SAMPLE]
    value = at - i
    bits = np.frombuffer(lower, np.uint8)
    for b in reversed(range(low)):
        k = i * low + b
        value = value << 1 | (bits[k >> 3] >> (k & 7) & 1)
    return value


def pack_block(docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    low, upper, lower, samples = ef_encode(np.cumsum([len(d) for d in docs]))
    head = HEADER.pack(MAGIC, ids.dtype.itemsize, low, 0, len(docs), len(ids), len(upper), len(lower), len(samples))
    return b"".join([head, upper, lower, samples, ids.tobytes()])


class Block:
    """A block's boundaries and ids; offset(i) is where document i ends."""

    def __init__(self, payload: bytes):
        magic, width, self.low, _, self.n, n_ids, a, b, c = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        k = HEADER.size
        self.upper, self.lower, self.samples = payload[k : k + a], payload[k + a : k + a + b], payload[k + a + b : k + a + b + c]
        self.ids = np.frombuffer(payload, f"<u{width}", n_ids, k + a + b + c)

    def offsets(self, i: np.ndarray) -> np.ndarray:
        """Where the documents i end, by select."""
        return ef_select(i, self.low, self.upper, self.lower, self.samples)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where document ``first`` begins and each up to ``last``, exclusive, ends."""
        ends = self.offsets(np.arange(max(first - 1, 0), last))
        return ends if first else np.append(0, ends)

    def document(self, i: int) -> np.ndarray:
        return self.ids[slice(*self.bounds(i, i + 1))]


BLOCKS = "shard int, block int, ids_before long, n_docs long, n_ids long, doc_ids array<bigint>, payload binary"


def write_token_file(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Write all texts' ids, each document ended by end_id, in ascending doc_id order.

    Null texts count as empty (one id). Null doc_ids come first. Rows that share a doc_id are
    ordered by a hash of the text; exact repeats stay, each with its own ids. Other columns are
    ignored. The range shuffle deals rows by doc_id, text hash and place in the input, so neither a
    doc_id nor exact repeats of a row can fill one task.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([pack_block(held)], pa.binary())],
                names=["shard", "block", "ids_before", "n_docs", "n_ids", "doc_ids", "payload"],
            )

        for doc_id, ids in encoded(batches, tokenizer, end_id):
            doc_ids.append(doc_id)
            held.append(ids)
            size += len(ids)
            if size >= block_ids:
                yield flush()
                block, before, doc_ids, held, size = block + 1, before + size, [], [], 0
        if held:
            yield flush()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "text")
    rows.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian u32)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for each write task, so this window's single partition doesn't grow with the rows.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    joined = blocks.join(checked_broadcast(bases, shards.count()), "shard")
    rows = joined.select((F.col("base") + F.col("ids_before")).alias("first"), "doc_ids", "payload")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, payload in zip(*(c for c in batch.columns)):
                block = Block(payload.as_py())
                bounds = block.bounds(0, block.n)
                starts, ends = bounds[:-1], bounds[1:]
                wide = block.ids.astype("<u4")
                each = [wide[a:b].tobytes() for a, b in zip(starts, ends)]
                columns = [pa.array(doc_ids.as_py(), pa.int64()), pa.array(starts + first.as_py(), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(each, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
