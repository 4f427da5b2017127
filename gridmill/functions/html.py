"""HTML cleaning, validation and length expressions. All of them stay inside the JVM."""

from pyspark.sql import Column, functions as F

# What Python's str.strip() and \s treat as white space, in Java regex form.
WS = r"[\s\x1c-\x1f]"

# The validator's limits.
MIN_RAW = 10
MIN_CLEAN = 20
MAX_CLEAN = 50_000

# Truncation length by capacity tier (at least this many devices -> characters).
TRUNCATE_TIERS = [(8, 8000), (4, 6000), (0, 4000)]

# Both patterns are anchored, so the matcher looks at the edge of the text only. The closing
# wrappers are matched on reversed text; searching for `...\z` would try every position.
_OPENING = rf"(?iU)^{WS}*(?:```(?:html)?{WS}*)?(?:<html>{WS}*)?(?:<body>{WS}*)?"
_CLOSING = rf"(?iU)^{WS}*(?:```{WS}*)?(?:>lmth/<{WS}*)?(?:>ydob/<{WS}*)?"
_EDGE_WS = rf"(?U)^{WS}+"

_TAIL = 96     # bytes looked at from the end
_MARGIN = 16   # bytes that must be left of them: a closing wrapper and a split character fit in


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut_end(c: Column, pattern: str) -> Column:
    """Remove a match of the reversed pattern from the end.

    Reversing a text, and counting its characters, costs a pass over it. So the match is made on
    the last bytes and cut off by its length in bytes. When it comes so close to the start of the
    tail that it might go on before it, the whole text is reversed.
    """
    raw = c.cast("binary")
    tail = F.when(F.octet_length(c) <= _TAIL, c).otherwise(
        F.substring(raw, F.octet_length(c) - _TAIL + 1, F.lit(_TAIL)).cast("string"))
    found = F.octet_length(F.regexp_extract(F.reverse(tail), pattern, 0))
    settled = lambda n: (F.octet_length(c) <= _TAIL) | (n <= _TAIL - _MARGIN)
    return _let(found, lambda n: F.when(n == 0, c).when(
        settled(n), F.substring(raw, F.lit(1), F.octet_length(c) - n).cast("string")).otherwise(
        F.reverse(F.regexp_replace(F.reverse(c), pattern, ""))))


def _cut_edges(c: Column, left: str, right: str) -> Column:
    return _let(F.regexp_replace(c, left, ""), lambda rest: _cut_end(rest, right))


def strip(c: Column) -> Column:
    """Remove white space (Python's notion of it) from both ends."""
    return _cut_edges(c, _EDGE_WS, _EDGE_WS)


def clean_html(c: Column) -> Column:
    """Strip, then drop an opening fence, closing fence, <html>, </html>, <body>, </body>.

    Every wrapper is optional on its own and swallows the white space next to it, so the six
    removals collapse into one pattern per end and a last strip has nothing left to do. Null
    and '' pass through. A text that begins and ends with its table has nothing to remove.
    """
    bare = c.startswith("<table") & c.endswith("</table>")
    return F.when(bare, c).otherwise(_cut_edges(c, _OPENING, _CLOSING))


def _occurrences(lowered: Column, tag: str) -> Column:
    gone = F.octet_length(lowered) - F.octet_length(F.replace(lowered, F.lit(tag), F.lit("")))
    return (gone / len(tag)).cast("int")


def count_table_open(c: Column) -> Column:
    """Case-folded count of '<table' (so '<tablet' counts as well)."""
    return _occurrences(F.lower(c), "<table")


def count_table_close(c: Column) -> Column:
    return _occurrences(F.lower(c), "</table>")


def has_table(c: Column) -> Column:
    """Does the text hold '<table' in any case? Null counts as no."""
    return F.coalesce(F.contains(F.lower(c), F.lit("<table")), F.lit(False))


def reject_reason(raw: Column, cleaned: Column, image: Column, lowered: Column | None = None) -> Column:
    """Code of the first validation rule a sample breaks, null when it is valid.

    The raw-length rule only needs the stripped raw text when the cleaned text, which is part
    of it, is itself below the limit. `lowered` is lower(cleaned) where that is at hand.
    """
    lowered = F.lower(cleaned) if lowered is None else lowered
    size = F.length(cleaned)
    return (
        F.when(raw.isNull() | ((size < MIN_RAW) & (F.length(strip(raw)) < MIN_RAW)), "too_short_raw")
        .when(~F.contains(lowered, F.lit("<table")), "no_table")
        .when(_occurrences(lowered, "<table") != _occurrences(lowered, "</table>"), "unbalanced")
        .when(~size.between(MIN_CLEAN, MAX_CLEAN), "length_out_of_range")
        .when(image.isNull(), "no_image")
    )


def valid_html(raw: Column, cleaned: Column, image: Column) -> Column:
    """True for a sample that passes every validation rule, never null."""
    return reject_reason(raw, cleaned, image).isNull()


def truncate_html(c: Column, limit) -> Column:
    """First `limit` characters and '...' when the text is longer than `limit`."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.when(F.length(c) > limit, F.concat(F.left(c, limit), F.lit("..."))).otherwise(c)


def tier_limit(devices) -> Column:
    """Truncation length for a capacity tier."""
    devices = devices if isinstance(devices, Column) else F.lit(devices)
    return F.coalesce(*[F.when(devices >= least, F.lit(limit)) for least, limit in TRUNCATE_TIERS])


def preview(c: Column, n: int = 200) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def sample_file(rank: Column, suffix: str) -> Column:
    """sample_01<suffix>, growing past two digits when needed."""
    return F.format_string(f"sample_%02d{suffix}", rank)


def path_suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, '' when the file name has none or is a dot file."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def path_stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


def error_type(message: Column) -> Column:
    """The part of an error message before its first ':'."""
    return F.substring_index(message, ":", 1)
