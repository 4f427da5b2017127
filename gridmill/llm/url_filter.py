"""URL filters: a trie over reversed host labels, then path segments; the longest rule that fits decides."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridmill.llm.bpe import appended

SLICE_RULES = 200_000  # rules of one broadcast trie
Rule = tuple[str, str]  # verdict (allow or block) and host with path, like ("block", "example.com/en/")

VERDICT = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("host_length", T.IntegerType()),
                        T.StructField("verdict", T.StringType()), T.StructField("rule", T.StringType())])
ARROW = pa.struct([("length", pa.int32()), ("host_length", pa.int32()), ("verdict", pa.string()), ("rule", pa.string())])


def parse(url: str | None) -> tuple[str, str]:
    """(host, path): the host in lower case up to /, ? or #, the path up to ? or #; empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


class Node:
    __slots__ = ("labels", "segments", "prefixes")

    def __init__(self):
        self.labels: dict[str, Node] = {}    # the next host label to the left
        self.segments: dict[str, Node] = {}  # the next whole path segment
        self.prefixes: list = []             # (start of the segment here or None for any path, outcome)


class Trie:
    def __init__(self, rules: list[Rule]):
        self.root = Node()
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.labels.setdefault(label, Node())
            outcome = (len(rule), len(host), verdict, rule)
            if not slash:
                node.prefixes.append((None, outcome))
                continue
            *whole, last = path.split("/")
            node = node.segments.setdefault("", Node())
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            node.prefixes.append((last, outcome))

    def find(self, host: str, path: str):
        """The longest outcome that fits; of equal length the longer host, then block before allow."""
        fits, node = [], self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            fits += [outcome for _, outcome in node.prefixes]
            below = node
            for segment, after in zip(segments, segments[1:]):
                below = below.segments.get(segment)
                if below is None:
                    break
                fits += [outcome for start, outcome in below.prefixes if after.startswith(start)]
        return max(fits, default=None)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
          slice_rules: int = SLICE_RULES) -> DataFrame:
    """Add host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; the rule with most
    letters wins, no fit gives `default` and a null rule, and so does a null url. A broadcast trie holds at most
    `slice_rules` rules; more rules take several tries, one after the other in the same task pass, and the
    longest of their outcomes wins. Nothing is shuffled.
    """
    sc, own = df.sparkSession.sparkContext, [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    found = df.select(F.struct(*own).alias("_row"), F.col(url).alias("_url"))
    place = T.StructType().add("host", "string").add("path", "string")
    split = lambda urls: [pa.array([dict(zip(("host", "path"), parse(u))) for u in urls.to_pylist()],
                                   pa.struct([("host", pa.string()), ("path", pa.string())]))]
    found = appended(found, "_url", T.StructType().add("_at", place), split)
    columns = []
    for at in range(0, max(1, len(rules)), slice_rules):
        trie, name = sc.broadcast(Trie(rules[at:at + slice_rules])), f"_rule{at}"

        def make(places: pa.Array, trie=trie) -> list[pa.Array]:
            outcomes = (trie.value.find(p["host"], p["path"]) for p in places.to_pylist())
            return [pa.array([o and dict(zip(VERDICT.names, o)) for o in outcomes], ARROW)]

        found = appended(found, "_at", T.StructType().add(name, VERDICT), make)
        columns.append(F.col(name))
    best = F.array_max(F.array(*columns))
    return found.select(*[F.col("_row")[c].alias(c) for c in own], "_at.host", "_at.path", best["rule"].alias("rule"),
                        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
