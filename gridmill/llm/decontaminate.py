"""Benchmark decontamination by winnowing.

Of every 9 neighbouring 5-word hashes the smallest is kept, so any shared run of 13 words or more has a kept
hash in common. Kept hashes of a document are joined to those of the benchmark items, and each meeting is
extended to the windows of 13 words around it that some item has, compared word by word. Items shorter than
13 words are one window of their own length; hashes of that length are all kept.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gridmill.llm.bpe import appended
from gridmill.sources.work import stage

WINDOW = 13   # words of a window of the contract
GRAM = 5      # words of a hash
SLIDE = WINDOW - GRAM + 1
SHARE = 20    # contaminated from one hit word in so many
SLICE_WORDS = 2_000_000  # words of the benchmark that are broadcast at once

# Letters and digits in lower case and all bytes of longer characters are kept; the rest parts words.
FOLD = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32
             for b in range(256))
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)),
                     T.StructField("items", T.ArrayType(T.StringType()))])
ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                   ("items", pa.list_(pa.string()))])


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode().translate(FOLD).split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions that hold the smallest hash of some SLIDE neighbours (of all, where there are fewer)."""
    n = len(hashes)
    if n <= SLIDE:
        return np.flatnonzero(hashes == hashes.min()) if n else np.empty(0, np.int64)
    least = hashes[:n - SLIDE + 1].copy()
    for i in range(1, SLIDE):
        np.minimum(least, hashes[i:i + len(least)], out=least)
    most = np.zeros(n, np.uint64)  # the largest minimum of the windows that hold a position
    for i in range(SLIDE):
        part = most[i:i + len(least)]
        np.maximum(part, least, out=part)
    return np.flatnonzero(hashes == most)


class Windows:
    """The windows of one size of a set of items: their hashes in order, where one of each stands, and whose they are."""

    def __init__(self, items: list[np.ndarray], size: int):
        self.size = size
        hashes = [grams(words, size) for words in items]
        entry = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        begin = np.cumsum([0, *map(len, items)])[:-1]
        place = np.concatenate([b + np.arange(len(h)) for b, h in zip(begin, hashes)] or [np.empty(0, np.int64)])
        every = np.concatenate(hashes or [np.empty(0, np.uint64)])
        order = np.lexsort((entry, every))
        every, self.entry = every[order], entry[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
        self.hashes, self.place = every[first], place[order][first]
        self.bounds = np.append(first, len(every))  # the entries of the i-th hash
        self.words = np.concatenate(items or [np.empty(0, np.uint64)])

    def find(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the windows of a document that begin at `starts` which some item has, and their numbers here."""
        if not len(starts) or not len(self.hashes):
            return starts[:0], starts[:0]
        at = np.arange(self.size)
        few = 4 * len(starts) < len(words)
        own = grams(words[starts[:, None] + at].T, self.size)[0] if few else grams(words, self.size)[starts]
        number = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[number] == own)
        same = (self.words[self.place[number[met]][:, None] + at] == words[starts[met][:, None] + at]).all(axis=1)
        return starts[met[same]], number[met[same]]

    def owners(self, numbers: np.ndarray) -> set[int]:
        return set().union(*(self.entry[self.bounds[i]:self.bounds[i + 1]].tolist() for i in np.unique(numbers).tolist()))


class Index:
    """Fingerprints and windows of benchmark items. Items with equal words are one entry with several ids."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        ids = defaultdict(set)
        for item, words in items:
            ids[words.tobytes()].add(item)
        found = [np.frombuffer(w, np.uint64) for w in ids]
        self.ids = [sorted(x) for x in ids.values()]
        long = [i for i, words in enumerate(found) if len(words) >= WINDOW]
        marks = [hashes[winnowed(hashes)] for hashes in (grams(found[i], GRAM) for i in long)]
        self.marks = np.unique(np.concatenate(marks or [np.empty(0, np.uint64)]))
        self.windows = [(Windows([found[i] for i in long], WINDOW), np.array(long))]
        for size in sorted({len(w) for w in found if len(w) < WINDOW}):
            some = [i for i, words in enumerate(found) if len(words) == size]
            self.windows.append((Windows([found[i] for i in some], size), np.array(some)))

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Where windows begin that hold a fingerprint which the document shares with some item."""
        hashes = grams(words, GRAM)
        at = winnowed(hashes)
        if not len(at) or not len(self.marks):
            return np.empty(0, np.int64)
        kept = hashes[at]
        met = at[self.marks[np.minimum(np.searchsorted(self.marks, kept), len(self.marks) - 1)] == kept]
        starts = np.unique((met[:, None] - np.arange(SLIDE)).ravel())
        return starts[(starts >= 0) & (starts <= len(words) - WINDOW)]

    def find(self, words: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
        """Shared runs as (start, end) word positions, joined and in order, and the ids of their items.

        A meeting of fingerprints is extended to all windows around it that some item has; a window that thousands of items
        have is looked up once, and its owners are added once per document.
        """
        runs, entries = [], set()
        for windows, entry in self.windows:
            starts = self.candidates(words) if windows.size == WINDOW else np.arange(max(0, len(words) - windows.size + 1))
            starts, numbers = windows.find(words, starts)
            runs += [(at, at + windows.size) for at in starts.tolist()]
            entries.update(entry[list(windows.owners(numbers))].tolist() if len(numbers) else [])
        joined = []
        for start, end in sorted(runs):
            if joined and start <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(end, joined[-1][1])
            else:
                joined.append((start, end))
        return joined, sorted({i for e in entries for i in self.ids[e]})


def hashed(benchmark: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(item, words): the word hashes of every item that has words, made in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i or "", word_hashes(t)) for i, t in zip(*(c.to_pylist() for c in batch.columns))]
            kept = [(i, w.tobytes()) for i, w in found if len(w)]
            yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in kept], pa.string()), "words": pa.array([w for _, w in kept], pa.binary())})

    return benchmark.select(F.col(item).cast("string"), F.col(text)).mapInArrow(run, "item string, words binary")


def parts(benchmark: DataFrame, item: str, words: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Hashed items in runs of at most so many words (a longer item is alone), one run at a time; at least one run."""
    part, size = [], 0
    for r in hashed(benchmark, item).toLocalIterator():
        found = np.frombuffer(r["words"], np.uint64)
        if part and size + len(found) > words:
            yield part
            part, size = [], 0
        part.append((r["item"], found))
        size += len(found)
    yield part


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
              slice_words: int = SLICE_WORDS) -> DataFrame:
    """Add `hits`, a struct of n_words, n_hit, spans (word positions), items (ids as strings) and contaminated.

    The index that is broadcast holds at most `slice_words` words; a larger benchmark takes one pass over the
    documents per slice, each written to the work folder, and their spans are joined. A null or empty
    text has no words; an item without words has no window; a null item_id counts as an empty
    string; items with equal ids count once. Words are compared by 64-bit hashes.
    """
    sc, own = docs.sparkSession.sparkContext, [c for c in docs.columns if c != "hits"]
    found = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_doc"))
    columns = []
    for part in parts(benchmark, item, slice_words):
        index, name = sc.broadcast(Index(part)), f"_hits{len(columns)}"
        if columns:
            found = stage(found, "decontaminate")

        def make(texts: pa.Array, index=index) -> list[pa.Array]:
            rows = []
            for t in texts.to_pylist():
                words = word_hashes(t)
                runs, items = index.value.find(words)
                rows.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in runs], "items": items})
            return [pa.array(rows, ARROW)]

        found = appended(found, "_doc", T.StructType().add(name, HITS), make)
        columns.append(name)
    every = lambda field: F.concat(*[F.col(c)[field] for c in columns])
    spans = F.array_sort(F.array_distinct(every("spans")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"),
                                F.greatest(a["end"], s["end"]).alias("end"))
    n_words, n_hit = F.col(columns[0])["n_words"], F.aggregate(spans, zero, add, lambda a: a["n"])
    hits = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), spans.alias("spans"),
                    F.array_sort(F.array_distinct(every("items"))).alias("items"),
                    ((n_hit > 0) & (SHARE * n_hit >= n_words)).alias("contaminated"))
    return found.select(*[F.col("_row")[c].alias(c) for c in own], hits.alias("hits"))
