"""Chat-message shapes built from a sample, and extractors over them."""

from pyspark.sql import Column, functions as F


def _part(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(None).cast("string") if text is None else text).alias("text"),
        (F.lit(None).cast("binary") if image is None else image).alias("image"),
    )


def _turn(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def to_parts_messages(instruction: str, html: Column, image: Column) -> Column:
    """Training chat: user turn [instruction, image], assistant turn [html]."""
    return F.array(
        _turn("user", _part("text", F.lit(instruction)), _part("image", image=image)),
        _turn("assistant", _part("text", html)),
    )


def to_prompt_messages(instruction: str, image: Column, system: str | None = None) -> Column:
    """Inference chat: optional system turn, then a user turn with the image first."""
    user = _turn("user", _part("image", image=image), _part("text", F.lit(instruction)))
    if system is None:
        return F.array(user)
    return F.array(_turn("system", _part("text", F.lit(system))), user)


def to_flat_messages(prompt: str, html: Column) -> Column:
    """Training chat with plain-text turns; the images travel in a column of their own."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", F.lit(prompt)), turn("assistant", html))


def images_of(image: Column) -> Column:
    return F.array(image)


def prompt_turn(messages: Column) -> Column:
    """First message, null for an empty chat."""
    return F.try_element_at(messages, F.lit(1))


def ground_truth(messages: Column, html: Column | None = None, default: Column | None = None) -> Column:
    """Content of the second message, else the html column, else the default (null = skip)."""
    fallback = F.coalesce(*[c for c in (html, default, F.lit(None).cast("string")) if c is not None])
    second = F.try_element_at(messages, F.lit(2))["content"]
    return F.when(F.size(messages) > 1, second).otherwise(fallback)
