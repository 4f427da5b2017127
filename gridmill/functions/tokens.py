"""Token-id array expressions: clamping, range validation, cutting."""

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Ignored label position, width of the preserved range above the vocabulary.
IGNORE = -100
PRESERVED_WIDTH = 100


def _preserved(x: Column, specials: Iterable[int], lo: int, hi: int) -> Column:
    return x.isin(list(specials)) | ((x >= lo) & (x < hi))


def _clampable(x: Column, vocab: int, specials, lo: int, hi: int, ignore: int | None) -> Column:
    hit = (x >= vocab) & ~_preserved(x, specials, lo, hi)
    return hit if ignore is None else hit & (x != ignore)


def clamp_ids(ids: Column, vocab: int, specials, lo: int, hi: int, repl: int = 0, ignore: int | None = None) -> Column:
    """Ids at or above the vocabulary that are neither special nor in [lo, hi) become `repl`."""
    fix = F.lit(repl).cast("int")
    return F.transform(ids, lambda x: F.when(_clampable(x, vocab, specials, lo, hi, ignore), fix).otherwise(x))


def clamped_count(ids: Column, vocab: int, specials, lo: int, hi: int) -> Column:
    return F.size(F.filter(ids, lambda x: _clampable(x, vocab, specials, lo, hi, None)))


def preserved_count(ids: Column, vocab: int, specials, lo: int, hi: int) -> Column:
    return F.size(F.filter(ids, lambda x: (x >= vocab) & _preserved(x, specials, lo, hi)))


def _range_error(field: str, ids: Column, vocab: int) -> Column:
    bad = (F.array_min(ids) < 0) | (F.array_max(ids) >= vocab)
    text = F.format_string(
        f"Invalid {field}: range [%d, %d] vs vocab_size {vocab}", F.array_min(ids), F.array_max(ids)
    )
    return F.when(bad, text)


def token_range_error(ids: Column, labels: Column | None, vocab: int) -> Column:
    """Message naming the first field with an id outside [0, vocab), null when all are inside."""
    checks = [_range_error("input_ids", ids, vocab)]
    if labels is not None:
        checks.append(_range_error("labels", F.filter(labels, lambda x: x != IGNORE), vocab))
    return F.coalesce(*checks)


def outside_after_clamp(ids: Column, vocab: int, specials, lo: int, hi: int, ignore: int | None = None) -> Column:
    """Does any id still lie outside the vocabulary, the specials and [lo, hi)?"""
    return F.exists(ids, lambda x: _clampable(x, vocab, specials, lo, hi, ignore))


def truncate_tokens(ids: Column, limit: int) -> Column:
    return F.slice(ids, 1, limit)


def strip_prompt(out: Column, prompt: Column) -> Column:
    """Generated ids without the prompt in front of them."""
    return F.slice(out, F.size(prompt) + 1, F.greatest(F.size(out) - F.size(prompt), F.lit(0)))


def zip_strip_prompt(outs: Column, prompts: Column) -> Column:
    """Position-wise `strip_prompt` over a batch of outputs and prompts."""
    pairs = F.arrays_zip(outs.alias("o"), prompts.alias("p"))
    return F.transform(pairs, lambda z: strip_prompt(z["o"], z["p"]))
