"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain. The
texts of a shard (a run of rows in one task) are indexed once, postings are kept for the trigrams of
the queries, intersected and united per rule, and only candidate texts are searched with the expression. A
rule without mandatory trigrams searches every text.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as C, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmill.llm.bpe import appended, groups

Clause = frozenset  # of frozensets: one of the sets of trigrams must be there in full
MOST = 64           # strings that are followed exactly while a query is derived


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0     # the secret itself
    least: int = 1     # its code points
    base: bool = False

    def compiled(self):
        return _compiled(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


@lru_cache(maxsize=None)
def _compiled(pattern: str, flags: int):
    return re.compile(pattern, flags)


# The first three are the contract's base patterns.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ignore_case=True, group=2, least=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]+", least=32, base=True))
# What may part the pieces of a key: white space, quoting, line breaks written as escapes. A piece is a long run of base64,
# one that ends in padding, or all that is on its line.
_GAP = r"""(?:[\s>"',]|\\+[nrt])"""
_BREAK = r"(?:\n|\r|\\+[nr])"
_PIECE = (rf"(?:{_GAP}*+[A-Za-z0-9+/]{{20,}}+={{0,2}}|{_GAP}++[A-Za-z0-9+/]++={{1,2}}"
          rf"""|[\x20\t]*+{_BREAK}++[\x20\t>]*+[A-Za-z0-9+/]++(?=["',]*+[\x20\t]*+(?:{_BREAK}|\Z)))""")
# A key goes from its header to its END line, whatever stands between but another line of dashes. Without an END line
# it is the header with the attributes and pieces that follow.
_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
        rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\n\r\\]*+)*+{_PIECE}*+)")
MORE_RULES = (
    Rule("private_key", _KEY),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[opsru]_[A-Za-z0-9]{36,}"))
RULES = BASE_RULES + MORE_RULES


def _clause(strings: set[str]) -> Clause | None:
    """Of one of these strings all trigrams occur; no demand if one of them is too short to have any."""
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return Clause(s for s in sets if not any(o < s for o in sets))  # a set with a smaller one inside adds nothing


class _Walk:
    """Follows an expression from left to right: the strings that may stand since the last break, and the demands."""

    def __init__(self):
        self.strings, self.clauses = {""}, []

    def flush(self):
        clause = _clause(self.strings)
        if clause:
            self.clauses.append(clause)
        self.strings = {""}

    def then(self, strings: set[str]):
        if len(self.strings) * len(strings) > MOST:
            self.flush()
        if len(strings) > MOST:
            return self.flush()
        self.strings = {a + b for a, b in product(self.strings, strings)}


def _exact(items) -> set[str] | None:
    """All strings that the items match, in lower case, if they are few."""
    found = {""}
    for op, arg in items:
        if op is C.LITERAL:
            some = {chr(arg).lower()}
        elif op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in arg):
            codes = [c for o, a in arg for c in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))]
            some = {chr(c).lower() for c in codes} if len(codes) <= 8 else None
        elif op is C.SUBPATTERN:
            some = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            some = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
            one = _exact(arg[2])
            some = None if one is None else {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(one, repeat=k)}
        else:
            some = None
        if some is None or len(found) * len(some) > MOST:
            return None
        found = {a + b for a, b in product(found, some)}
    return found


def _follow(items, walk: _Walk) -> None:
    for item in items:
        op, arg = item
        exact = _exact([item])
        if exact is not None:
            walk.then(exact)
        elif op is C.SUBPATTERN:
            _follow(arg[3], walk)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            walk.flush()
            _follow(arg[2], walk)
            walk.flush()
        elif op is C.BRANCH:
            walk.flush()
            queries = [trigram_query(b) for b in arg[1]]
            if all(queries):  # each branch demands something: one full set of one of them must be there
                sets = [frozenset().union(*choice) for q in queries for choice in product(*q)]
                walk.clauses.append(Clause(sets))
        elif op is not C.AT:
            walk.flush()


def trigram_query(items) -> list[Clause]:
    """The demands of a pattern (or its parsed items) on lower-cased text; all must hold, none means a full scan."""
    walk = _Walk()
    _follow(_parser.parse(items) if isinstance(items, str) else items, walk)
    walk.flush()
    return walk.clauses


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.trigrams = sorted({t for q in self.queries for c in q for s in c for t in s if t.isascii()})
        self.number = np.zeros(1 << 24, np.uint8 if len(self.trigrams) < 256 else np.uint16)
        for i, t in enumerate(self.trigrams):
            a, b, c = t.encode()
            self.number[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Trigram -> the texts of this shard that hold it, ascending."""
        raw = [t.encode() for t in texts]
        starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
        data = np.frombuffer(b"\0".join(raw).lower() + b"\0\0\0", np.uint8)
        code = data[:-2].astype(np.uint32) << 16
        code |= data[1:-1].astype(np.uint32) << 8
        code |= data[2:]
        found = self.number[code]
        at = np.flatnonzero(found)
        owner = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + owner)
        return {t: pairs[np.searchsorted(pairs, (i + 1) * len(texts)):np.searchsorted(pairs, (i + 2) * len(texts))]
                - (i + 1) * len(texts) for i, t in enumerate(self.trigrams)}

    def candidates(self, query: list[Clause], postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        held = np.arange(n)
        for clause in query:
            some = [np.empty(0, np.int64)]
            for trigrams in clause:
                mine = None
                for t in trigrams:
                    if t in postings:  # a trigram outside ASCII has no list and demands nothing
                        mine = postings[t] if mine is None else np.intersect1d(mine, postings[t], assume_unique=True)
                some.append(held if mine is None else mine)
            held = np.intersect1d(held, np.concatenate(some))
        return held

    def scan(self, texts: list[str | None]) -> Iterator[list[dict]]:
        for shard in groups(texts):
            plain = [t or "" for t in shard]
            postings, found = self.postings(plain), [[] for _ in plain]
            for rank, (rule, query) in enumerate(zip(self.rules, self.queries)):
                search = rule.compiled().finditer
                for i in self.candidates(query, postings, len(plain)).tolist():
                    for m in search(plain[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), rank, rule.kind, m.end(), m.start(rule.group), rule.base))
            for spans in found:
                yield [dict(zip(("kind", "start", "end", "secret_start", "base"), (k, s, e, v, b)))
                       for s, _, k, e, v, b in sorted(spans)]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("secret_start", T.IntegerType()), T.StructField("base", T.BooleanType())]))
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                            ("secret_start", pa.int32()), ("base", pa.bool_())]))


def with_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Add the spans found in each whole text, by start and then in the order of the rules.

    Positions are code points, ends exclusive; `secret_start` is where the value begins within a match. A null
    or empty text has none. Matches of one kind do not overlap, those of two kinds may.
    """
    make = lambda texts: [pa.array(list(scanner(rules).scan(texts.to_pylist())), ARROW)]
    return appended(df, text, T.StructType().add(into, SPANS), make)


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, every secret's value in the text replaced by `mark`; a null text stays null."""
    def make(texts: pa.Array) -> list[pa.Array]:
        out, plain = [], texts.to_pylist()
        for t, spans in zip(plain, scanner(rules).scan(plain)):
            end, parts = 0, []
            for s in sorted(spans, key=lambda s: s["secret_start"]):
                if s["end"] > end:
                    if s["secret_start"] >= end:
                        parts += [t[end:s["secret_start"]], mark]
                    end = s["end"]
            out.append("".join(parts) + t[end:] if parts else t)
        return [pa.array(out, pa.string())]

    return appended(df, text, T.StructType().add(text, "string"), make).select(*df.columns)


def digest(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")
