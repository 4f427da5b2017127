"""Encoding and decoding with a public byte-pair vocabulary, by forced-boundary splitting.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never be joined
by a merge, so a cut between them is certain. Words are cut there, the fragments are encoded
independently and their ids are put together again. Fragments and words are remembered per Python
worker, up to a fixed number.
"""

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

REMEMBERED = 240_000  # words kept per Python worker, and as many again that were used before
FAR = 1 << 40         # rank of a pair that no merge joins
AT_ONCE = 2_000       # rows whose results a worker holds at a time, or
BYTES_AT_ONCE = 16_000_000  # so many bytes of text; a longer text is alone

# The characters of the Unicode property White_Space, which no piece of a word reaches across.
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f"[^{WHITE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else from 256 up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class Memo(dict):
    """Results by key; when it is full, those that were not asked for since the last time are forgotten."""

    def __init__(self, limit: int = REMEMBERED):
        super().__init__()
        self.before, self.limit = {}, limit

    def missing(self, keys) -> list:
        """The keys without a result; a result from before is taken over."""
        out = []
        for key in set(keys).difference(self):
            known = self.before.get(key)
            if known is None:
                out.append(key)
            else:
                self[key] = known
        return out

    def turn(self) -> None:
        if len(self) > self.limit:
            self.before = dict(self)
            self.clear()


class Vocabulary:
    """A tokenizer file with NFC, white space and lower case normalised, and words that end in a mark.

    A white-space separated word of a raw text is encoded on its own, which is what the library gives
    for it: neither normalisation nor pieces reach across white space.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")" if self.special else "(?!)")
        letters = byte_letters()
        self.inner = np.array([self.ids[x] for x in letters], "<u4")
        self.final = np.array([self.ids[x + self.end] for x in letters], "<u4")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in pairs] or [-1], np.int64)
        self.by_key = np.argsort(keys, kind="stable")  # rank of the i-th smallest pair
        self.keys = keys[self.by_key]
        self.joined = np.array([self.ids[a + b] for a, b in pairs] or [0], "<u4")
        self.inside = np.zeros((256, 256), bool)  # pairs that stand side by side in some token
        byte_of = {x: b for b, x in enumerate(letters)}
        for token in self.ids:
            seen = [byte_of[x] for x in (token.removesuffix(self.end) if self.end else token)]
            self.inside[seen[:-1], seen[1:]] = True
        self.pieces = Memo()  # piece -> packed ids
        self.words = Memo()   # raw word -> packed ids

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], FAR)

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of every piece: all fragments join their pair of lowest rank, again and again."""
        raw = [p.encode() for p in pieces]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        b = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[b]
        ids[ends - 1] = self.final[b[ends - 1]]
        cut = ~self.inside[b[:-1], b[1:]]
        cut[ends[:-1] - 1] = True
        fragment = np.concatenate([[0], np.cumsum(cut)])
        place, done = np.arange(len(b)), []
        rank = np.append(self.ranks(ids[:-1], ids[1:]), FAR)
        rank[:-1][cut] = FAR
        while len(ids):
            first = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
            size = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = best < FAR
            if open_.mean() < 0.5:  # set the finished fragments aside
                done.append((place[~open_], ids[~open_]))
                ids, fragment, place, rank, best = (x[open_] for x in (ids, fragment, place, rank, best))
            at = np.flatnonzero((rank == best) & (best < FAR))
            if not len(at):
                continue
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))  # equal letters: every second pair of a run
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            ids[at] = self.joined[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, fragment, place, rank = ids[keep], fragment[keep], place[keep], rank[keep]
            moved = at - np.arange(len(at))
            for i in (moved, moved[moved > 0] - 1):
                inner = i[i + 1 < len(ids)]
                inner = inner[fragment[inner] == fragment[inner + 1]]
                rank[i] = FAR
                rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        place, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        place, ids = place[order], ids[order]
        bounds = [0, *(4 * np.searchsorted(place, ends)).tolist()]
        packed = ids.tobytes()
        return [packed[i:j] for i, j in zip(bounds, bounds[1:])]

    def split(self, words: list[str]) -> Iterator[list[str]]:
        """The pieces of every word, in order; words hold no special token."""
        text = "\n".join(words)
        if not text.isascii():  # letters change case one by one: no final sigma
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        out = []
        for piece in self.pattern.findall(text.lower()):
            if piece == "\n":
                yield out
                out = []
            else:
                out.append(piece)
        if words:
            yield out

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered yet; special tokens in them stand for themselves."""
        plain = [w for w in words if not self.cut_special.search(w)]
        found = list(self.split(plain))
        new = self.pieces.missing({p for pieces in found for p in pieces})
        for group in ([p for p in new if len(p) <= 64], [p for p in new if len(p) > 64]):
            if group:  # long ones apart: they take many rounds
                self.pieces.update(zip(group, self.merge(group)))
        for word, pieces in zip(plain, found):
            self.words[word] = b"".join([self.pieces[p] for p in pieces])
        for word in set(words).difference(plain):
            parts = [x for x in self.cut_special.split(word) if x]
            self.learn(self.words.missing({x for x in parts if x not in self.special}))
            self.words[word] = b"".join([self.special[x].to_bytes(4, "little") if x in self.special
                                         else self.words[x] for x in parts])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        for some in groups(texts):
            self.words.turn(), self.pieces.turn()
            words = [WORDS.findall(t) if t else [] for t in some]
            self.learn(self.words.missing(set().union(*words)))
            for w in words:
                yield b"".join(map(self.words.__getitem__, w))

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, tokens are joined by a space, special ones too."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def groups(texts: list[str | None], letters: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about so many letters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= letters:
            yield run
            run, size = [], 0
    if run:
        yield run


def slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Runs of rows bounded by number and by the bytes of their texts (other columns than texts: by number)."""
    if not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        yield from (batch.slice(at, AT_ONCE) for at in range(0, batch.num_rows, AT_ONCE))
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        room = BYTES_AT_ONCE + (total[at - 1] if at else 0)
        to = min(max(int(np.searchsorted(total, room, "right")), at + 1), at + AT_ONCE)
        yield batch.slice(at, to - at)
        at = to


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def appended(df: DataFrame, text: str, added: T.StructType, make) -> DataFrame:
    """Every row with its own columns and the `added` ones, which `make` gives as Arrow arrays per batch of texts.

    Columns go by position, so no name can clash; an older column of an added name is replaced.
    """
    kept = [c for c in df.columns if c not in added.names]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("_text"))
    fields = [T.StructField(name, f.dataType) for name, f in zip(kept, rows.schema.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(whole.num_columns - 1)):
                arrays = make(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*kept, *added.names])

    return rows.mapInArrow(run, T.StructType([*fields, *added.fields]))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add `ids` (binary, little-endian unsigned 32-bit) of each whole text, and its decoded form if named.

    A null or empty text has no ids and decodes to an empty text. Equal rows give equal rows.
    """
    added = T.StructType().add(ids, "binary")
    added = added.add(decoded, "string") if decoded else added

    def make(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(path)
        found = list(v.encode(texts.to_pylist()))
        out = [pa.array(found, pa.binary())]
        return out + [pa.array(map(v.decode, found), pa.string())] if decoded else out

    return appended(df, text, added, make)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that `ids` stand for; null ids give an empty text."""
    make = lambda c: [pa.array([vocabulary(path).decode(x) if x else "" for x in c.to_pylist()], pa.string())]
    return appended(df, ids, T.StructType().add(decoded, "string"), make)
