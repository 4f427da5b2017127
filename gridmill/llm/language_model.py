"""An n-gram language model by deleted interpolation, counted, trained and applied as Spark jobs.

Documents are packed into blocks of some million tokens. A block sends its distinct n-grams, as sorted 64-bit
hashes with counts, to the task of their hash range, gets the counts of the whole corpus back and from
then on holds for every token the counts of its n-grams of all orders; nothing is broadcast but the mixture
weights. p_k = l * count / context count + (1 - l) * p_(k-1), where l is learned per bucket of the
context's frequency by expectation-maximisation on deleted counts: each training token is taken out of
the counts that predict it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridmill.sources.work import fresh_path

BLOCK_TOKENS = 1_200_000
BUCKETS = 65            # by the bit length of the context's count
BINS, PER_OCTAVE, LOWEST = 1024, 8, -40  # bins of log2(ratio of two probabilities); the first is ratio 0
ROUNDS = 60             # of expectation-maximisation
END = np.uint64(0x9D39247E33776D41)    # hash of the end token
BEGIN = np.uint64(0x2AF7398005AAA5C7)  # context of the first token


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned numbers, differences if ascending, as planes of bytes without the empty high ones."""
    values = np.asarray(values, np.uint64)
    if ascending and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    out = out.view(np.uint64).ravel()
    return np.cumsum(out, dtype=np.uint64) if ascending else out


def chained(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its context and its last word."""
    x = (context * np.uint64(0x9E3779B97F4A7C15)) ^ word
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngrams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order the hash of the n-gram that ends at each token; `starts` are the documents' first tokens."""
    found = [words]
    for k in range(1, order):
        context = np.concatenate([[BEGIN], found[-1][:-1]])
        context[starts] = BEGIN + np.uint64(k)
        found.append(chained(context, words))
    return found


BLOCK = ("block long, keys array<long>, held array<boolean>, lengths array<int>, train_docs long, train_tokens long, "
         "words binary, sequence binary")


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (key, held, text) packed into blocks: hashed vocabulary and the documents' token sequences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId() << 32, 0
        keys, held, hashed, size = [], [], [], 0

        def block():
            lengths = np.array(list(map(len, hashed)), np.int64)
            words, sequence = np.unique(np.concatenate(hashed), return_inverse=True)
            train = ~np.array(held)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([shard + number], pa.int64()), "keys": pa.array([keys], pa.list_(pa.int64())),
                "held": pa.array([held], pa.list_(pa.bool_())), "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "train_docs": pa.array([int(train.sum())], pa.int64()),
                "train_tokens": pa.array([int(lengths[train].sum())], pa.int64()),
                "words": pa.array([pack(words, True)], pa.binary()), "sequence": pa.array([pack(sequence)], pa.binary())})

        for batch in batches:
            for key, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().lower().split() if text else []
                found = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                hashed.append(np.append(found, END))
                keys.append(key)
                held.append(out)
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield block()
                    number, size, keys, held, hashed = number + 1, 0, [], [], []
        if keys:
            yield block()

    return docs.mapInArrow(run, BLOCK)


class Tokens:
    """One block, token by token."""

    def __init__(self, row: dict, order: int):
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)
        words = unpack(row["words"], True)[unpack(row["sequence"])]
        self.grams = ngrams(words, self.starts, order)


def store(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def counted(packed: DataFrame, order: int) -> DataFrame:
    """Per block, order and hash range the corpus counts of the block's distinct n-grams, in order of their hash.

    `distinct` is the number of different n-grams of the range that occur in training, once per range. There are about as many
    ranges, and tasks that add them up, as blocks: a block sends each n-gram once, so a range has about as many entries as
    a block has n-grams, whatever the size of the corpus.
    """
    n_blocks = packed.count()
    bits = max(16, n_blocks).bit_length() - 1
    shift = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Tokens(row, order)
                for k, grams in enumerate(tokens.grams, 1):
                    keys, place = np.unique(grams, return_inverse=True)
                    counts = np.bincount(place[tokens.train], minlength=len(keys))
                    cuts = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
                    spans = [(p, a, b) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b]
                    yield pa.RecordBatch.from_pydict({
                        "n": pa.array([k] * len(spans), pa.int32()), "part": pa.array([p for p, _, _ in spans], pa.int32()),
                        "block": pa.array([row["block"]] * len(spans), pa.int64()),
                        "keys": pa.array([pack(keys[a:b], True) for _, a, b in spans], pa.binary()),
                        "counts": pa.array([pack(counts[a:b]) for _, a, b in spans], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack(x, True) for x in group.column("keys").to_pylist()]
        ends = np.cumsum(list(map(len, keys)))
        counts = np.concatenate([unpack(x) for x in group.column("counts").to_pylist()])
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(known)).astype(np.uint64)
        mine = np.split(total[place], ends[:-1])
        return pa.table({"n": group.column("n"), "part": group.column("part"), "block": group.column("block"),
                         "totals": pa.array([pack(x) for x in mine], pa.binary()),
                         "distinct": pa.array([int((total > 0).sum())] + [0] * (len(mine) - 1), pa.int64())})

    sent = packed.mapInArrow(send, "n int, part int, block long, keys binary, counts binary")
    return sent.repartition(max(n_blocks, 1), "n", "part").groupBy("n", "part").applyInArrow(add, "n int, part int, block long, totals binary, distinct long")


COUNTS = "block long, keys array<long>, held array<boolean>, lengths array<int>, counts array<binary>"


def with_counts(packed: DataFrame, totals: DataFrame, order: int) -> DataFrame:
    """Every block with the corpus count of the n-gram at each token, one packed list per order."""
    n_blocks = packed.count()

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        tokens = Tokens(row, order)
        rows = sorted((r["n"], r["part"], r["totals"]) for r in found.to_pylist())
        out = []
        for k, grams in enumerate(tokens.grams, 1):
            _, place = np.unique(grams, return_inverse=True)
            out.append(pack(np.concatenate([unpack(t) for n, _, t in rows if n == k])[place]))
        return pa.table({**{c: block.column(c) for c in ("block", "keys", "held", "lengths")},
                         "counts": pa.array([out], pa.list_(pa.binary()))})

    deal = lambda df: df.repartition(max(n_blocks, 1), "block")
    mine = deal(totals.select("block", "n", "part", "totals"))
    return deal(packed).groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, COUNTS)


class Model:
    """Corpus sizes and, per order, the weight of each bucket of context counts."""

    def __init__(self, tokens: int, docs: int, words: int):
        self.tokens, self.docs, self.words = tokens, docs, words
        self.weights: list[np.ndarray] = []

    def contexts(self, counts: list[np.ndarray], starts: np.ndarray, k: int) -> np.ndarray:
        """Training count of the context of each token's n-gram of order k + 1."""
        if k == 0:
            return np.full(len(counts[0]), self.tokens, np.float64)
        before = np.concatenate([[0], counts[k - 1][:-1]]).astype(np.float64)
        before[starts] = self.docs
        return before

    def below(self, counts: list[np.ndarray], starts: np.ndarray, deleted: int) -> np.ndarray:
        """Probability of each token by the orders learned so far; deleted = 1 takes the token itself out."""
        p = np.full(len(counts[0]), 1 / (self.words + 1))
        for k, weights in enumerate(self.weights):
            ml, bucket = self.maximum(counts, starts, k, deleted)
            share = weights[bucket]
            p = share * ml + (1 - share) * p
        return p

    def maximum(self, counts, starts, k: int, deleted: int) -> tuple[np.ndarray, np.ndarray]:
        """(maximum-likelihood estimate, bucket of the context's count); an unseen context has bucket 0."""
        context = np.maximum(self.contexts(counts, starts, k) - deleted, 0)
        ml = np.maximum(counts[k] - float(deleted), 0) / np.maximum(context, 1)
        return ml, np.where(context > 0, np.frexp(context)[1], 0)


def _read(row: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array(row["lengths"], np.int64)
    counts = [unpack(x).astype(np.float64) for x in row["counts"]]
    return counts, lengths, np.cumsum(lengths) - lengths, np.array(row["held"], bool)


def learned(stored: DataFrame, model: Model, order: int) -> Model:
    """Learn the weights, lowest order first: one pass over the counts of all training tokens per order.

    A pass returns, per bucket, a histogram of the ratio between the order's own estimate and that of the orders
    below, at most BUCKETS x BINS rows; the weights depend on nothing else.
    """
    for k in range(order):
        def run(batches: Iterator[pa.RecordBatch], k=k, model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BUCKETS * BINS, np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    counts, lengths, starts, held = _read(row)
                    ml, bucket = model.maximum(counts, starts, k, 1)
                    with np.errstate(divide="ignore"):
                        ratio = np.log2(ml / model.below(counts, starts, 1))
                    bins = np.where(ml > 0, np.clip(np.nan_to_num(ratio - LOWEST, neginf=0) * PER_OCTAVE + 1, 1, BINS - 1), 0)
                    use = np.repeat(~held, lengths) & (bucket > 0)
                    total += np.bincount(bucket[use] * BINS + bins[use].astype(np.int64), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

        rows = stored.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        seen = np.zeros((BUCKETS, BINS))
        for r in rows:
            seen[divmod(r["at"], BINS)] = r["n"]
        ratio = np.exp2((np.arange(BINS) - 0.5) / PER_OCTAVE + LOWEST)
        ratio[0] = 0
        weights = np.where(seen.sum(axis=1) > 0, 0.5, 0.0)
        for _ in range(ROUNDS):
            mixed = weights[:, None] * ratio
            weights = (seen * mixed / np.maximum(mixed + 1 - weights[:, None], 1e-300)).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
        model.weights.append(weights)
    return model


def scored(stored: DataFrame, model: Model) -> DataFrame:
    """One row per document with its token counts and log10 probabilities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, lengths, starts, held = _read(row)
                base = np.log10((counts[0] + 1) / (model.tokens + model.words + 1))
                p = np.log10(model.below(counts, starts, 0))
                add = lambda x: pa.array(np.add.reduceat(x, starts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(held), pa.array(lengths),
                     add((counts[0] > 0).astype(np.int64)), pa.array(np.full(len(lengths), model.tokens)), add(base), add(p)],
                    ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return stored.mapInArrow(run, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double")


def score(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Train on the rows where the boolean column `held` is not true and score all rows.

    Words are split at ASCII white space, A-Z in lower case; one end token follows. A null or empty text has the
    end token only; repeated rows count as often as they occur; a null `held` is training. Other columns
    are not read. Words and n-grams are told apart by 64-bit hashes. Without training rows all counts are 0.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(held, F.lit(False)).alias("held"),
                       F.col(text).alias("text"))
    packed = store(blocks(rows), "lm_blocks")
    totals = store(counted(packed, order), "lm_totals")
    sizes = packed.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    words = totals.where("n = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    stored = store(with_counts(packed, totals, order), "lm_counts")
    return scored(stored, learned(stored, Model(*sizes, words), order))
