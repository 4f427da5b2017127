"""Quality rules: text statistics and a learned decision list, in DataFrame operations only.

`with_statistics` measures every text, `learn` grows and prunes an ordered list of threshold
conjunctions from labelled statistics by sequential covering, and `verdict` turns the list into one
conditional Column. No Python function runs on the executors.
"""

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from gridmill.operators.curate import once
from gridmill.sources.work import stage

# Fixed values of the contract: white space, counted symbols, window length and base limits.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "word_length", "symbol_share", "bang_share", "distinct_share", "repeat_share",
            "dup_line_share"]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _pairs(hashes: str, apart: int) -> Column:
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + apart)))


def _symbols(text: str) -> Column:
    """Their number; the regular expression runs only where a plain search finds one of them."""
    some = F.lit(False)
    for symbol in SYMBOLS:
        some = some | F.contains(text, F.lit(symbol))
    return F.when(some, F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))).otherwise(F.lit(0)).cast("long")


def _repeat_starts(hashes: str) -> Column:
    """(hash, position) pairs in order of the hash; empty when no window occurs twice."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _covered(pairs: str) -> Column:
    """Words inside windows that occur twice or more, from the sorted (hash, position) pairs."""
    at = lambda j: F.get(F.col(pairs), j)["h"]
    same = F.filter(pairs, lambda x, j: F.coalesce(x["h"] == at(j - 1), F.lit(False)) |
                    F.coalesce(x["h"] == at(j + 1), F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda x: x["i"].cast("long")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def with_statistics(df: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """Add one struct column with the five counts and the features of the rules.

    A null text counts as empty: all counts and shares are 0. Windows are compared by 64-bit
    hashes within one text; a text without a repeated window is not sorted. Other columns pass
    through untouched, whatever their names; an older column of the same name is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    measured = once(df.drop(into).select(F.struct("*").alias("_row"), t.alias("_t")), "_w", _words(F.col("_t")))
    n = F.size("_w")
    measured = once(measured, "_x1", F.transform("_w", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):  # spans of 2, 4 and 8 words, each from two of half the length
        measured = once(measured, f"_x{2 * k}", _pairs(f"_x{k}", k))
    whole = F.slice("_x8", 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    measured = once(measured, "_h", whole)
    measured = once(measured, "_p", _repeat_starts("_h"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    measured = once(measured, "_lines", lines)
    long = lambda c: c.cast("long")
    counts = once(measured, "_c", F.struct(
        long(n).alias("n_words"), long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        _symbols("_t").alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _covered("_p").alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"), F.size(F.array_distinct("_x1")).alias("n_distinct"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).alias("n_bangs")))
    c = lambda name: F.col("_c")[name]
    share = lambda a, b: F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0))
    stats = F.struct(*[c(x).alias(x) for x in COUNTS], share("word_chars", "n_words").alias("word_length"),
                     share("n_symbols", "word_chars").alias("symbol_share"),
                     share("n_bangs", "word_chars").alias("bang_share"),
                     share("n_distinct", "n_words").alias("distinct_share"),
                     share("n_repeat_words", "n_words").alias("repeat_share"),
                     share("n_dup_lines", "n_lines").alias("dup_line_share"))
    return once(counts.select("_row", "_c"), "_s", stats).select("_row.*", F.col("_s").alias(into))


def base_failed(stats: str = "stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, stats: str) -> Column:
        value = F.col(stats)[self.feature].cast("double")
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]  # a conjunction; a document that meets it is rejected


def _holds(rule: Rule, stats: str) -> Column:
    met = F.lit(True)
    for condition in rule:
        met = met & condition.column(stats)
    return met


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """True (keep) or false, by the first rule that holds; no rule, keep."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(_holds(rule, stats), F.lit(False))
    return out.otherwise(F.lit(True))


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per feature and bin the (rejectable, good) rows: one small aggregate, features x bins rows."""
    below = lambda f, c: F.size(F.filter(F.array(*map(F.lit, c)), lambda cut: cut < F.col("stats")[f]))
    bins = [F.struct(F.lit(f).alias("f"), below(f, c).alias("b")) for f, c in cuts.items() if c]
    found = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(
        F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).collect()
    table = {f: [(0, 0)] * (len(c) + 1) for f, c in cuts.items() if c}
    for r in found:
        table[r["f"]][r["b"]] = (r["p"], r["n"])
    return table


def _best(table, cuts, p0: int, n0: int) -> tuple[float, Condition] | None:
    """The threshold condition with the largest gain p * (log purity after - log purity before).

    Cuts are quantiles, so between two neighbours lie few rows of either label. The limit is put in the
    middle of the gap on the rejecting side, which rejects no more than the cut itself would.
    """
    best = found = None
    for f, bins in table.items():
        below_p = below_n = 0
        for i, (p, n) in enumerate(bins[:-1]):
            below_p, below_n = below_p + p, below_n + n
            for above, bp, bn in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                if bp and (bp, bn) != (p0, n0):
                    gain = bp * (log2(bp / (bp + bn)) - log2(p0 / (p0 + n0)))
                    if gain > 0 and (best is None or gain > best):
                        best, found = gain, (f, above, i)
    if best is None:
        return None
    f, above, i = found
    beyond = cuts[f][min(max(i + (1 if above else -1), 0), len(cuts[f]) - 1)]
    return best, Condition(f, above, (cuts[f][i] + beyond) / 2)


def learn(labelled: DataFrame, label: str = "quality", key: str = "doc_id", max_rules: int = 8,
          max_conditions: int = 4, bins: int = 32, min_precision: float = 0.9, min_rows: int = 8) -> list[Rule]:
    """Grow and prune rules that reject label 0, from rows with `stats`, `label` and `key`.

    Rows that fail the base rule or have no label are left out. Two thirds of the rows (by a hash
    of the key) grow a rule by the gain of one threshold at a time; the last third prunes it to
    its best prefix and accepts it only with `min_precision` over at least `min_rows` rows. Each
    step is one aggregate of features x bins rows. No rows, or one label only: no rules.
    """
    rows = stage(labelled.where(F.col(label).isNotNull() & ~base_failed()).select(
        "stats", (F.col(label) == 0).alias("bad"), (F.pmod(F.xxhash64(key), F.lit(3)) > 0).alias("grow")), "rules")
    steps = [i / bins for i in range(1, bins)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(F.col("stats")[f].cast("double"), steps, 10_000).alias(f)
                                      for f in FEATURES]).collect()
    cuts = {f: sorted({x for r in found for x in r[f] or []}) for f in FEATURES}
    left, rules = rows, []
    while any(cuts.values()) and len(rules) < max_rules:
        rule, scope = (), left.where("grow")
        while len(rule) < max_conditions:
            table = _histogram(scope, cuts)
            p, n = (sum(x[i] for x in next(iter(table.values()))) for i in (0, 1))
            if p == 0 or n == 0:
                break
            step = _best(table, cuts, p, n)
            if step is None:
                break
            rule, scope = (*rule, step[1]), scope.where(step[1].column("stats"))
        if not rule:
            break
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        hit = lambda r, bad: F.coalesce(F.sum((_holds(r, "stats") & (F.col("bad") == bad)).cast("int")), F.lit(0))
        counts = left.where("NOT grow").agg(*[hit(r, b) for r in prefixes for b in (True, False)]).first()
        scored = [((p - n) / (p + n) if p + n else -1.0, p, n, r)
                  for r, p, n in zip(prefixes, counts[0::2], counts[1::2])]
        _, p, n, pruned = max(scored, key=lambda s: (s[0], -len(s[3])))
        if p + n < min_rows or p < min_precision * (p + n):
            break
        rules.append(pruned)
        left = left.where(~_holds(pruned, "stats"))
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
                    rows: int = 20_000, text: str = "text") -> DataFrame:
    """(key, label, stats) of at most `rows` labelled documents: a bounded sample, so it may be broadcast.

    The rows with the smallest hash of the key are taken. A key with contradictory labels, a null
    key and a null label are left out; repeated labels count once.
    """
    one = labels.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where(
        F.col(key).isNotNull() & (F.col("_a") == F.col("_b"))).select(key, F.col("_a").alias(label))
    chosen = one.orderBy(F.xxhash64(key), key).limit(rows)
    texts = docs.select(key, text).join(F.broadcast(chosen), key)
    return with_statistics(texts, text).select(key, label, "stats")


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """Every document with its `stats` and `kept`, by rules learned from `labels`.

    A null or empty text has no words and fails the base rule; repeated rows have equal verdicts; without usable labels the base rule
    alone decides; an empty table gives no rows. Older columns of these names are replaced, others pass through.
    """
    rules = learn(labelled_sample(docs, labels, rows=sample_rows))
    return with_statistics(docs).withColumn("kept", verdict(rules))
