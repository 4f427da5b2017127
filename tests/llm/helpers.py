import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    """A documents table; texts may hold None."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)], DOCS)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [None, "", " \t\n ", "a", "x" * 5000, "<|endoftext|>", "a\0b", "don't  WE'LL étÉ 漢字 🎉!", "\x85\x1c x\x0by", "ΣΊΣΥΦΟΣ İ",
       "a" + "́" + " ́b", "one two", "\n".join(["same line here"] * 40), "  lead", "trail  "]
