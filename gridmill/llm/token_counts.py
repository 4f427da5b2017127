"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix's encoding is the one vocabulary token t that ends it and that may follow
the last token of the prefix before t: "may follow" means that merging the two tokens' letters gives
those two tokens again. So count(prefix) = count(prefix before t) + 1, and each prefix takes its
state from shorter ones. States of prefixes inside words are remembered per Python worker; a text
stores its running count at every word end, which answers truncation and budget questions by a
search in that array, without encoding again.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from functools import lru_cache
from itertools import accumulate
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmill.llm.bpe import REMEMBERED, WORDS, Memo, Vocabulary, appended, byte_letters, groups, vocabulary

SHORT = 48  # prefixes of longer pieces are not remembered, so that memory stays linear in the text


class PrefixCounter:
    def __init__(self, v: Vocabulary):
        self.v = v
        cut = len(v.end)
        self.last = {t[:-cut]: i for t, i in v.ids.items() if cut and t.endswith(v.end)} if cut else v.ids
        self.inner = {t: i for t, i in v.ids.items() if not (cut and t.endswith(v.end))}
        self.longest = max(map(len, self.inner))
        self.letters = str.maketrans({chr(b): x for b, x in enumerate(byte_letters())})
        self.pair = {(int(k >> 32), int(k & 0xFFFFFFFF)): (int(r), int(v.joined[r])) for k, r in zip(v.keys, v.by_key)}
        self.follows = {}  # (token, token) -> whether they may stand side by side
        self.states = {}   # prefix inside a word -> (last token, count)
        self.counts = Memo()  # piece -> count
        self.words = Memo()   # raw word -> count

    def symbols(self, token: int) -> list[int]:
        text, end = self.v.tokens[token], self.v.end
        if end and text.endswith(end):
            body = text[:-len(end)]
            return [self.inner[x] for x in body[:-1]] + [self.last[body[-1]]]
        return [self.inner[x] for x in text]

    def joined(self, ids: list[int]) -> list[int]:
        while len(ids) > 1:
            found = [(self.pair[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pair]
            if not found:
                break
            i = min(found)[1]
            ids = [*ids[:i], self.pair[ids[i], ids[i + 1]][1], *ids[i + 2:]]
        return ids

    def may_follow(self, a: int | None, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            before = [] if a is None else [a]
            ids = [s for t in (*before, b) for s in self.symbols(t)]
            known = self.follows[a, b] = self.joined(ids) == [*before, b]
        return known

    def step(self, text: str, i: int, tokens: dict, state_at) -> tuple[int, int]:
        """(last token, count) of text[:i], from the states of shorter prefixes."""
        for j in range(max(0, i - self.longest), i):
            t = tokens.get(text[j:i])
            if t is not None:
                before, n = state_at(j) if j else (None, 0)
                if self.may_follow(before, t):
                    return t, n + 1
        raise ValueError("a letter is missing in the vocabulary")

    def state(self, text: str, i: int) -> tuple[int, int]:
        """State of an inner prefix of a short piece, remembered."""
        key = text[:i]
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = self.step(text, i, self.inner, lambda j: self.state(text, j))
        return found

    def piece(self, piece: str) -> int:
        text = piece.encode().decode("latin-1").translate(self.letters)
        if len(text) <= SHORT:
            return self.step(text, len(text), self.last, lambda j: self.state(text, j))[1]
        states = [(None, 0)]
        for i in range(1, len(text)):
            states.append(self.step(text, i, self.inner, states.__getitem__))
        return self.step(text, len(text), self.last, states.__getitem__)[1]

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if not self.v.cut_special.search(w)]
        found = list(self.v.split(plain))
        for p in self.counts.missing({p for pieces in found for p in pieces}):
            self.counts[p] = self.piece(p)
        for word, pieces in zip(plain, found):
            self.words[word] = sum([self.counts[p] for p in pieces])
        for word in set(words).difference(plain):
            parts = [x for x in self.v.cut_special.split(word) if x]
            self.learn(self.words.missing({x for x in parts if x not in self.v.special}))
            self.words[word] = sum(1 if x in self.v.special else self.words[x] for x in parts)

    def forget(self) -> None:
        self.words.turn(), self.counts.turn()
        for memo in (self.states, self.follows):
            if len(memo) > 2 * REMEMBERED:
                memo.clear()

    def running(self, texts: list[str | None]):
        """For each text the list of counts at its word ends."""
        for some in groups(texts):
            self.forget()
            words = [WORDS.findall(t) if t else [] for t in some]
            self.learn(self.words.missing(set().union(*words)))
            for w in words:
                yield list(accumulate(map(self.words.__getitem__, w)))


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(vocabulary(path))


def with_prefix_counts(df: DataFrame, path: str, text: str = "text", into: str = "prefix_tokens") -> DataFrame:
    """Add array<int>: the exact token count of the text up to the end of each white-space separated word.

    A null, empty or blank text has an empty array. Words of any length are counted whole.
    """
    def make(texts: pa.Array) -> list[pa.Array]:
        found = list(counter(path).running(texts.to_pylist()))
        offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
        values = np.fromiter((n for x in found for n in x), np.int32, offsets[-1])
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

    return appended(df, text, T.StructType().add(into, T.ArrayType(T.IntegerType())), make)


def n_tokens(prefix_tokens: str) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.get(prefix_tokens, F.size(prefix_tokens) - 1), F.lit(0)).cast("long")


def words_within(prefix_tokens: str, budget: int) -> Column:
    """The number of leading words whose tokens fit into the budget."""
    return F.size(F.filter(prefix_tokens, lambda n: n <= budget)).cast("long")


def tokens_before(path: str):
    """A Column function (text, length, prefix_tokens): the exact tokens of the first `length` code points.

    The stored count at the last word end before the cut is taken over; only the part of a word that the cut leaves is counted, from
    the states of its prefixes. A null text or length counts as 0.
    """
    @F.pandas_udf("long")
    def run(texts: pd.Series, lengths: pd.Series, prefixes: pd.Series) -> pd.Series:
        whole, parts = [], []
        for text, n, prefix in zip(texts, lengths.fillna(0), prefixes):
            cut = text[:int(n)] if text and n and n > 0 else ""
            words = sum(1 for _ in WORDS.finditer(cut))
            inside = len(cut) < len(text or "") and words > 0 and WORDS.match(cut[-1]) and WORDS.match(text[len(cut)])
            done = words - 1 if inside else words
            whole.append(int(prefix[done - 1]) if done else 0)
            parts.append(next(iter(reversed(WORDS.findall(cut)))) if inside else "")
        added = [x[-1] if x else 0 for x in counter(path).running(parts)]
        return pd.Series([a + b for a, b in zip(whole, added)], dtype="int64")
    return run
