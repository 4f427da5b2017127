"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 4 bits exactly if some value lies within 2 bits of both. So every
distinct fingerprint stands for all its variants within 2 bits, and fingerprints that share a variant are
linked. Sending 2,081 rows per fingerprint would cost more than the input itself, so what is shuffled
is the variant's first bits: a fingerprint goes once to every prefix that some of its variants have
(29 to some hundred rows), and the task of that prefix makes the rest of the variants, sorts them and
links those that meet. All fingerprints of one variant lie within 4 bits of each other, which is the check of the bit
distance, so linking each to the smallest of them loses no group and lists no pairs.
"""

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridmill.llm.bpe import appended
from gridmill.llm.components import components
from gridmill.sources.work import stage

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
AT_ONCE = 4_000_000  # variants sorted at a time in a task
PER_PREFIX = 512     # fingerprints that own a prefix, about
HOT = 20_000         # rows of a prefix that are dealt on by its next bits, at least, and
SHARE = 4            # so many times the rows of an even prefix
STEP = 4             # so many of them


def fingerprint(text: str | None) -> int:
    """Majority of each bit over the hashes of all word shingles; 0 for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Add the fingerprint as a long (its 64 bits)."""
    make = lambda texts: [pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())]
    return appended(df, text, T.StructType().add(into, "long"), make)


@lru_cache(maxsize=None)
def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of `bits` bits of which at most `most` are set."""
    return np.array([sum(1 << b for b in c) for k in range(min(bits, most) + 1) for c in combinations(range(bits), k)],
                    np.uint64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each of n nodes' component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, root) of all nodes that are not the root of their component: fewer than n rows."""
    label = roots(n, a, b)
    at = np.flatnonzero(label != np.arange(n))
    return np.stack([at, label[at]], axis=1)


def meeting(fps: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """(owner, owner) rows, fewer than owners, that span the groups of those that share a variant of the low `bits` bits,
    `left` flips each.

    More variants than are sorted at once are split by their next four bits, over and over; every part is reduced to
    such rows before the next one is made.
    """
    n = len(fps)
    sizes = [len(masks(bits, k)) for k in range(int(left.max(initial=0)) + 1)]
    if sum(sizes[k] * int((left == k).sum()) for k in range(len(sizes))) > AT_ONCE and bits > STEP:
        low, found = np.uint64((1 << (bits - STEP)) - 1), np.empty((0, 2), np.int64)
        for top in range(1 << STEP):
            away = np.bitwise_count((fps >> np.uint64(bits - STEP)) ^ np.uint64(top))
            near = np.flatnonzero(away <= left)
            if len(near) > 1:
                part = near[meeting(fps[near] & low, left[near] - away[near], bits - STEP)]
                found = forest(n, *np.concatenate([found, part]).T)
        return found
    owners, variants = [], []
    for k in range(len(sizes)):
        own = np.flatnonzero(left == k)
        variants.append((fps[own][:, None] ^ masks(bits, k)[None, :]).ravel())
        owners.append(np.repeat(own, sizes[k]))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    start = np.append(True, variants[1:] != variants[:-1])
    bucket = np.cumsum(start) - 1
    first = np.minimum.reduceat(owners, np.flatnonzero(start))[bucket]
    met = owners != first
    return forest(n, *np.divmod(np.unique(owners[met] * n + first[met]), max(n, 1)))


def _sent(fingerprints: DataFrame, prefix: int, half: int) -> DataFrame:
    """(fp, prefix, used, left): every fingerprint once for each prefix of `used` bits that its variants have, and the
    flips that are left."""
    flips = F.explode(F.array(*[F.lit(int(m)).cast("long") for m in masks(prefix, half)]))
    return fingerprints.select("fp", flips.alias("flip")).select(
        "fp", F.shiftrightunsigned("fp", BITS - prefix).bitwiseXOR(F.col("flip")).alias("prefix"),
        F.lit(prefix).alias("used"), (half - F.bit_count("flip")).alias("left"))


def _sent_on(rows: DataFrame) -> DataFrame:
    """The same rows by prefixes that are STEP bits longer."""
    flip = F.filter(F.sequence(F.lit(0), F.lit((1 << STEP) - 1)), lambda m: F.bit_count(m) <= F.col("left"))
    own = F.expr(f"shiftrightunsigned(fp, {BITS - STEP} - used)").bitwiseAND(F.lit((1 << STEP) - 1))
    return rows.withColumn("flip", F.explode(flip)).select(
        "fp", F.shiftleft("prefix", STEP).bitwiseOR(own.bitwiseXOR(F.col("flip"))).alias("prefix"),
        (F.col("used") + STEP).alias("used"), (F.col("left") - F.bit_count("flip")).alias("left"))


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) that span every group of distinct fingerprints (column fp) linked at `radius` bits or fewer.

    Groups within a task are reduced to one row per member, so the output stays below the input rows of
    the shuffle whatever the size of a group. The number of prefix bits follows the number of fingerprints, and prefixes
    that very many share (texts of one template) are dealt on by their next bits, again and again; this moves work
    between shuffle and tasks and changes no link.
    """
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    n = fingerprints.count()
    prefix = max(4, (n // PER_PREFIX).bit_length())
    limit = max(HOT, SHARE * n * len(masks(prefix, half)) >> prefix)
    rows, dealt = _sent(fingerprints, prefix, half), []
    while prefix + 2 * STEP <= BITS:
        hot = stage(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("prefix"), "hot_prefixes")
        if hot.isEmpty():
            break
        dealt.append(rows.join(hot, "prefix", "left_anti"))
        rows, prefix = _sent_on(rows.join(hot, "prefix", "left_semi")), prefix + STEP
    sent = reduce(DataFrame.unionByName, [*dealt, rows])

    def run(group: pa.Table) -> pa.Table:
        fps = np.sort(group.column("fp").to_numpy().view(np.uint64))
        own, rest = group.column("prefix")[0].as_py(), BITS - group.column("used")[0].as_py()
        left = half - np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(own)).astype(np.int64)
        met = meeting(fps & np.uint64((1 << rest) - 1), left, rest)
        a, b = fps[met[:, 0]], fps[met[:, 1]]
        return pa.table({"a": b.view(np.int64), "b": a.view(np.int64)})

    return sent.select("fp", "prefix", "used").groupBy("used", "prefix").applyInArrow(run, "a long, b long")


def clustered(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, first) for rows of (fp, rank): `first` is the smallest rank of all rows linked to fp."""
    per_fp = stage(rows.groupBy("fp").agg(F.min("rank").alias("own")), "fingerprints")
    groups = components(links(per_fp.select("fp"), radius)).withColumnRenamed("node", "fp")
    ranked = stage(groups.join(per_fp, "fp"), "groups")
    firsts = ranked.groupBy("root").agg(F.min("own").alias("first"))
    grouped = ranked.select("fp", "root").join(firsts, "root").select("fp", "first")
    return per_fp.join(grouped, "fp", "left").select("fp", F.coalesce("first", "own").alias("first"))


def _rank(key: str, text: str) -> Column:
    """Order of the documents of a group: by key, nulls last, then by a hash of the text."""
    return F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("key"),
                    F.xxhash64(text).alias("tie"))


def _ranked(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(_rank(key, text).alias("rank"), F.col(text).alias("text"))
    return stage(with_fingerprint(rows).select("rank", "fp"), "simhash")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row of df: the key, its fingerprint (16 hex digits) and component_id, the smallest key of its group.

    A text without words (null, empty or blank) has the fingerprint zero and links like any other. Equal rows
    give equal rows; a null key is the id of a group only if no other is there. Other columns are not read.
    """
    rows = _ranked(df, key, text)
    joined = rows.join(clustered(rows, radius), "fp")
    return joined.select(F.col("rank.key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("first.key").alias("component_id"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row with the smallest key of each group, all columns as they are.

    Of rows with equal key and text the one with the smallest hash of all its columns stays; of equal rows, one. Null, empty and blank
    texts are one group, as their fingerprint is zero. A null key comes after all others. An empty table stays empty.
    """
    firsts = clustered(_ranked(df, key, text), radius).select("first").distinct().select(
        F.coalesce("first.key", F.lit(0)).alias("_k"), F.col("first.absent").alias("_a"), F.col("first.tie").alias("_t"))
    named = df.select(F.struct("*").alias("_row"), F.coalesce(key, F.lit(0)).alias("_k"),
                      F.col(key).isNull().alias("_a"), F.xxhash64(text).alias("_t"), F.xxhash64("*").alias("_h"))
    order = Window.partitionBy("_k", "_a", "_t").orderBy("_h")
    single = named.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return single.join(firsts, ["_k", "_a", "_t"], "left_semi").select("_row.*")
