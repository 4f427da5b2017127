"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A block holds the ids of a run of documents, end to end, and two Elias-Fano lists: the documents' end
offsets and their doc_ids. An Elias-Fano list stores the low bits of each value as they are and the
high bits in unary; `select` on the unary part, helped by a sampled directory, gives any value without
a table of 64-bit numbers. Blocks are rows of a Parquet table with a binary column, because Spark's
writers reach every store that a cluster uses.

Block bytes, little-endian: the magic `GMTB`, id width (u1), documents (u4), documents without doc_id (u4), ids
(u8), first doc_id (i8), lengths of both lists (u4, u4), the lists, the ids. A list: values (u4), low width (u1),
then the low bits, the unary bits and a u4 position for every 64th value.
"""

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridmill.llm.bpe import Memo

MAGIC = b"GMTB"
HEAD = struct.Struct("<4sBIIQqII")
SAMPLE = 64            # one directory entry for so many values
CHUNKS = 600_000       # chunks remembered per Python worker, and as many again from before
RUN = 4_096            # documents whose spans a reader holds at a time
BYTES = 8_000_000      # of texts cut at a time; a longer text is alone
BLOCK_IDS = 2_000_000  # a block is closed once it has so many ids; a longer document has its own

# Kinds of bytes. Visible: ASCII letters, digits, marks and the apostrophe, the first byte of a longer character; then the space, line
# breaks and tabs, and what may be anything (control characters, longer blanks, bytes within a character).
LETTER, DIGIT, MARK, APOSTROPHE, VISIBLE, SPACE, BREAK, UNKNOWN = range(8)
MAYBE = 8              # first byte of a longer character that may be a blank: the next bytes tell
KINDS = np.full(256, UNKNOWN, np.uint8)
KINDS[0x21:0x7f], KINDS[0xc2:0xf5], KINDS[[0xc2, 0xe1, 0xe2, 0xe3]] = MARK, VISIBLE, MAYBE
KINDS[ord("A"):ord("Z") + 1] = KINDS[ord("a"):ord("z") + 1] = LETTER
KINDS[ord("0"):ord("9") + 1], KINDS[ord("'")], KINDS[ord(" ")], KINDS[list(b"\t\n\r")] = DIGIT, APOSTROPHE, SPACE, BREAK
BLANKS = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xa0, 0x1680, 0x180e, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f,
                                                    0x205f, 0x3000)]


class EliasFano:
    """A list of ascending numbers from 0 on, as bytes."""

    def __init__(self, data: bytes):
        self.n, self.width = struct.unpack_from("<IB", data)
        low_bytes = (self.n * self.width + 7) // 8
        self.low = np.frombuffer(data, np.uint8, low_bytes, 5)
        samples = -(-self.n // SAMPLE)
        self.high = np.frombuffer(data, np.uint8, len(data) - 5 - low_bytes - 4 * samples, 5 + low_bytes)
        self.directory = np.frombuffer(data, "<u4", samples, len(data) - 4 * samples)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return struct.pack("<IB", n, width) + pack(low) + pack(unary) + ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """Position of the i-th one of the unary part."""
        at = int(self.directory[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low = 0
        for k in range(self.width):
            bit = i * self.width + k
            low |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << k
        return (self.select(i) - i) << self.width | low

    def run(self, start: int, end: int) -> np.ndarray:
        """The values from `start` up to `end`: select at every place of the run, which begins at its directory entry."""
        if start >= end:
            return np.zeros(0, np.uint64)
        at = int(self.directory[start // SAMPLE])
        stop = -(-end // SAMPLE)
        until = int(self.directory[stop]) if stop < len(self.directory) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8:-(-until // 8)], bitorder="little")) + at // 8 * 8
        ones = ones[ones >= at][start % SAMPLE:start % SAMPLE + end - start]
        high = (ones - np.arange(start, end)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        first = start * self.width
        bits = np.unpackbits(self.low[first // 8:(end * self.width + 7) // 8], bitorder="little")
        low = bits[first % 8:first % 8 + (end - start) * self.width].reshape(-1, self.width).astype(np.uint64)
        return high | (low << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def pack_block(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One block; documents without doc_id come first, the others ascend."""
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(named[0]) if len(named) else 0
    ends = EliasFano.pack(np.cumsum([len(x) // width for x in ids]))
    names = EliasFano.pack(named.view(np.uint64) - np.int64(first).view(np.uint64))  # differences of up to 64 bits
    size = sum(map(len, ids)) // width
    return HEAD.pack(MAGIC, width, len(ids), len(ids) - len(named), size, first, len(ends), len(names)
                     ) + ends + names + b"".join(ids)


class Block:
    """Reads a block by select: `span(i)` of one document, `spans` and `doc_ids` of a run of them."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.unnamed, self.size, self.first, a, b = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.ends = EliasFano(data[HEAD.size:HEAD.size + a])
        self.names = EliasFano(data[HEAD.size + a:HEAD.size + a + b])
        self.data, self.at = data, HEAD.size + a + b

    def doc_ids(self, start: int, end: int) -> list[int | None]:
        lead = max(0, min(end, self.unnamed) - start)
        found = self.names.run(max(0, start - self.unnamed), max(0, end - self.unnamed)) + np.int64(self.first).view(np.uint64)
        return [None] * lead + found.view(np.int64).tolist()

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def spans(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents of a run begin and end."""
        ends = self.ends.run(start, end).astype(np.int64)
        return np.append([self.ends[start - 1] if start else 0], ends[:-1]), ends

    def ids(self, start: int, end: int) -> np.ndarray:
        kind = "<u2" if self.width == 2 else "<u4"
        return np.frombuffer(self.data, kind, end - start, self.at + start * self.width)


def cut_table(plain: bool) -> np.ndarray:
    """Whether a chunk surely starts at a byte, by the kinds of the byte before it and of itself, and whether the next is visible."""
    table = np.zeros((8, 8, 2), bool)
    table[:, SPACE, 1] = True
    if plain:
        table[:, BREAK, 1] = table[BREAK, :SPACE] = True
        for before in (LETTER, DIGIT, MARK, APOSTROPHE):
            table[before, [SPACE, BREAK]] = True
            for now in (LETTER, DIGIT, MARK, APOSTROPHE):
                table[before, now] = before != APOSTROPHE and before != (MARK if now == APOSTROPHE else now)
    return table.ravel()


class Encoder:
    """The library's ids of whole texts, from chunks that it encoded before.

    A byte-level pattern puts a space that stands before a visible character into the piece that it starts, so a text may be cut
    before each such space. Where the pattern is the plain one of byte-level files, pieces also part between ASCII letters,
    digits and marks, and around a line break or tab that stands before a visible character. What follows an
    apostrophe (contractions) or has other characters beside it is not cut but left to the library. Added tokens that
    are matched as they stand are chunks; a file with others is cut before spaces only.
    """

    WORD = re.compile(r" ?[^\s\u180e]{1,40}")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the tasks the cores
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(path)
        self.width = 2 if self.tool.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, added = file.get("pre_tokenizer") or {}, self.tool.get_added_tokens_decoder().values()
        special = [t.content for t in added if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.plain = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                      and not file.get("normalizer") and len(special) == len(added))
        self.table = cut_table(self.plain)
        self.special = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        vocab = self.tool.get_vocab()
        self.heads = np.zeros(max(vocab.values()) + 1, bool)
        self.heads[[i for t, i in vocab.items() if t.startswith("Ġ") or t == "Ċ"]] = True
        self.chunks = Memo(CHUNKS)

    def library(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of every text; the library's own objects, some hundred bytes an id, are held for a few texts at a time."""
        for at in range(0, len(texts), 100):
            yield from (e.ids for e in self.tool.encode_batch_fast(texts[at:at + 100], add_special_tokens=False))

    def learn(self, chunks: list[str]) -> None:
        """Short chunks without white space, or behind one space, are sent fifty at a time: each begins with its space or on a line."""
        spaced, bare, other = [], [], []
        for c in chunks:
            (other if not self.plain or not self.WORD.fullmatch(c) else spaced if c[0] == " " else bare).append(c)
        self.chunks.update(zip(other, (np.array(x, self.kind).tobytes() for x in self.library(other))))
        for lead, some in (("", spaced), ("\n", bare)):
            runs = [some[i:i + 50] for i in range(0, len(some), 50)]
            skip = self.width * len(lead)
            for run, ids in zip(runs, self.library([lead + lead.join(r) for r in runs])):
                packed = np.array(ids, self.kind)
                starts = np.flatnonzero(self.heads[packed])
                if len(starts) != len(run):
                    self.chunks.update(zip(run, (np.array(x, self.kind).tobytes() for x in self.library(run))))
                    continue
                data = packed.tobytes()
                at = [*(starts * self.width).tolist(), len(data)]
                self.chunks.update(zip(run, [data[i + skip:j] for i, j in zip(at, at[1:])]))

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, and how many there are up to the end of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        if not len(data):
            return pa.array([], pa.large_string()), ends[1:]
        kinds = KINDS[data]
        at = np.flatnonzero(kinds == MAYBE)
        codes = sum(data[np.minimum(at + i, len(data) - 1)].astype(np.int32) << 16 - 8 * i for i in range(3))
        kinds[at] = np.where(np.isin(codes, BLANKS) | np.isin(codes >> 8, BLANKS), UNKNOWN, VISIBLE)
        special = []
        if self.special:
            for i in np.flatnonzero(pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)):
                text = data[ends[i]:ends[i + 1]].tobytes()
                special += [(ends[i] + m.start(), ends[i] + m.end()) for m in re.finditer(self.special.encode(), text)]
        borders = np.concatenate([ends, np.array(special, np.int64).ravel()])
        place = np.zeros(len(data), np.uint8)
        place[:-1] = kinds[1:] < SPACE
        place[borders[borders > 0] - 1] = 0
        place |= kinds << 1
        place[1:] |= kinds[:-1] << 4
        starts = self.table[place]
        for i, j in special:
            starts[i:j] = False
        starts[borders[borders < len(data)]] = True
        at = np.flatnonzero(starts)
        offsets = pa.py_buffer(np.append(at, len(data)))
        return (pa.Array.from_buffers(pa.large_string(), len(at), [None, offsets, pa.py_buffer(data)]),
                np.searchsorted(at, ends[1:]))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The packed ids of every text. Equal chunks of a run of texts are looked up once."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        total, start = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(total, total[start] + BYTES, "right")) - 1)
            self.chunks.turn()
            chunks, ends = self.cut(texts.slice(start, end - start))
            start = end
            coded = chunks.dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = list(map(self.chunks.get, words))
            new = [i for i, x in enumerate(ids) if x is None]
            self.learn(self.chunks.missing([words[i] for i in new]))
            for i in new:
                ids[i] = self.chunks[words[i]]
            packed = pa.array(ids, pa.large_binary()).take(coded.indices)
            at = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1)[np.append(0, ends)].tolist()
            data = memoryview(packed.buffers()[2] or b"")
            yield from (data[i:j].tobytes() for i, j in zip(at, at[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_table(df: DataFrame, out: str, path: str, end_id: int, key: str = "doc_id", text: str = "text",
                      block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts, append `end_id` to each, and write blocks in ascending order of the key.

    Rows are ordered by range partitions (the hash of the text breaks ties, so a repeated key does not meet
    in one task); a null text has the end id only, null keys come first. Keys are integers or texts of integers; any other key
    is an error (ANSI mode, Spark's default) or counts as null. Other columns are not read; an empty table gives no block. Rows: shard, block, the ids
    of the shard before it (`start`), documents, ids, payload. Adaptive execution sets the shards' size.
    """
    ordered = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tie"))
    ordered = ordered.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie").select("_key", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, shard = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], tool.kind).tobytes()
        number = before = size = 0
        keys, ids = [], []

        def block():
            payload = pack_block(keys, ids, tool.width)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "block": pa.array([number], pa.int64()),
                "start": pa.array([before], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()),
                "n_ids": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1))):
                keys.append(k)
                ids.append(x + end)
                size += len(ids[-1]) // tool.width
                if size >= block_ids:
                    yield block()
                    number, before, size, keys, ids = number + 1, before + size, 0, [], []
        if keys:
            yield block()

    ordered.mapInArrow(run, "shard long, block long, start long, n_docs long, n_ids long, payload binary").write.parquet(out)


def read_token_table(spark: SparkSession, out: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, u4).

    Shards are as many as the writing job had tasks; their totals, one row each, place every shard.
    """
    blocks = spark.read.parquet(out)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        F.col("shard"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("start")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = Block(data)
                for at in range(0, block.n, RUN):
                    to = min(at + RUN, block.n)
                    begins, ends = block.spans(at, to)
                    ids = [block.ids(a, b).astype("<u4").tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.doc_ids(at, to), pa.int64()), pa.array(begins + start), pa.array(ends - begins),
                         pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
