import itertools
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmill.llm import bpe, token_counts as C, token_files as TF
from gridmill.llm.queries import BYTE_BPE, WORD_BPE
from tests.llm.helpers import DOCS, ODD, docs

ids_of = lambda tool, text: tool.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_tool():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte_tool():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    letters = "abcdehinorst ,.'!ÉñßΣ漢\n1"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(150)] + ["ab" * 3000]


def test_encoding_equals_the_library(spark, word_tool, texts):
    table = docs(spark, texts).withColumn("_text", F.lit("mine")).withColumn("ids", F.lit(0))
    out = bpe.encode(table, WORD_BPE, decoded="decoded")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "ids", "decoded"]
    for r in out.collect():
        ids = ids_of(word_tool, r["text"])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == word_tool.decode(ids, skip_special_tokens=False)
    again = bpe.decode(out.select("ids"), WORD_BPE)
    assert sorted(again.select("decoded").collect()) == sorted(out.select("decoded").collect())


def test_no_merge_crosses_a_forced_boundary():
    v = bpe.vocabulary(WORD_BPE)
    assert 0 < (~v.inside).sum() < 65536
    packed = lambda p: v.merge([p])[0]
    cut = next(p for p in ("a漢", "漢字", "!é", "ñ漢") if not v.inside[p.encode()[0], p.encode()[1]] or len(p.encode()) > 2)
    assert packed(cut) == v.merge(["x", cut, "y"])[1]


def test_forgetting_changes_nothing(word_tool, texts):
    v = bpe.Vocabulary(WORD_BPE)
    v.words.limit = v.pieces.limit = 3
    for _ in range(2):
        for text, ids in zip(texts, v.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(word_tool, text)


def test_prefix_counts(spark, word_tool, texts):
    out = C.with_prefix_counts(docs(spark, texts), WORD_BPE).select(
        "text", "prefix_tokens", C.n_tokens("prefix_tokens").alias("n"), C.words_within("prefix_tokens", 5).alias("w"))
    for r in out.collect():
        assert r["n"] == len(ids_of(word_tool, r["text"]))
        words = bpe.WORDS.findall(r["text"] or "")
        assert r["prefix_tokens"] == [len(ids_of(word_tool, " ".join(words[:i + 1]))) for i in range(len(words))]
        assert r["w"] == sum(n <= 5 for n in r["prefix_tokens"])


def test_every_prefix(spark, word_tool):
    text = "Thessalonians don't reordering, naïve <|endoftext|>x"
    rows = spark.createDataFrame([(text, n) for n in range(len(text) + 9)] + [(None, 1), (text, None), ("", 3), (" \n ", 2)], "t string, n int")
    rows = C.with_prefix_counts(rows, WORD_BPE, "t")
    for t, n, count in rows.select("t", "n", C.tokens_before(WORD_BPE)("t", "n", "prefix_tokens")).collect():
        want = 0 if t is None or n is None else len(ids_of(word_tool, t[:n]))
        assert count == want, (t, n)


def test_elias_fano():
    for values in ([], [0], [5], [0, 0, 0, 7, 7, 900], list(range(300)), [10 ** 12], [0, 2 ** 63, 2 ** 64 - 1], [2 ** 64 - 1], np.sort(np.random.default_rng(1).integers(0, 10 ** 9, 700)).tolist()):
        packed = TF.EliasFano.pack(np.array(values, np.uint64))
        read = TF.EliasFano(packed)
        assert read.run(0, len(values)).tolist() == values == [read[i] for i in range(len(values))]
        for a in range(0, len(values), 37):
            for b in (a, a + 1, a + 64, a + 130, len(values)):
                assert read.run(a, min(b, len(values))).tolist() == values[a:b]
    assert len(TF.EliasFano.pack(np.arange(0, 10 ** 6, 10))) < 10 ** 5  # far below eight bytes a value


def test_token_files(spark, tmp_path, byte_tool, texts):
    table = docs(spark, texts).union(docs(spark, ["again", "again"], 3)).union(
        docs(spark, ["no id", None]).withColumn("doc_id", F.lit(None).cast("long"))).repartition(7)
    TF.write_token_table(table, str(tmp_path / "t"), BYTE_BPE, 2, block_ids=500)
    rows = sorted(TF.read_token_table(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)
    at, got = 0, []
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        at += len(ids)
        got.append((r["doc_id"], ids))
    want = [(r["doc_id"], ids_of(byte_tool, r["text"]) + [2]) for r in table.collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_ids_of_the_whole_range(spark, tmp_path, byte_tool):
    keys = [-2 ** 63, -2 ** 62, -2 ** 62 + 1, -1, 0, 2 ** 62, 2 ** 63 - 1]
    table = spark.createDataFrame([(k, f"text {k}", "", "", 0) for k in keys], DOCS)
    TF.write_token_table(table, str(tmp_path / "t"), BYTE_BPE, 2)
    rows = sorted(TF.read_token_table(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == keys
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [ids_of(byte_tool, f"text {k}") + [2] for k in keys]


def test_batches_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 10)
    texts = ["a" * 4, None, "b" * 6, "c", "d" * 30, "", "e" * 10, "f"]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    assert [b.column(0).to_pylist() for b in bpe.slices(batch, batch.column(0))] == [texts[:3], texts[3:4], texts[4:5], texts[5:7], texts[7:]]
    monkeypatch.setattr(bpe, "AT_ONCE", 2)
    assert [b.num_rows for b in bpe.slices(batch, batch.column(0))] == [2, 2, 1, 2, 1]
    assert list(bpe.slices(batch.slice(0, 0), batch.column(0).slice(0, 0))) == []


def test_very_long_texts(spark, tmp_path, word_tool, byte_tool):
    """Five megabytes in one text, one of them a single word."""
    rng = np.random.default_rng(5)
    prose = " ".join(rng.choice(["alpha", "beta,", "naïve", "don't", "漢字", "x1y2"], 700_000).tolist())
    long = [prose + " " + "ab" * 500_000, "short", None]
    assert len(long[0].encode()) > 5_000_000
    table = docs(spark, long)
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(table, WORD_BPE).collect()}
    counts = {r["doc_id"]: r["n"] for r in C.with_prefix_counts(table, WORD_BPE).select("doc_id", C.n_tokens("prefix_tokens").alias("n")).collect()}
    for i, t in enumerate(long):
        assert ids[i] == ids_of(word_tool, t) and counts[i] == len(ids[i])
    TF.write_token_table(table, str(tmp_path / "t"), BYTE_BPE, 2)
    read = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in TF.read_token_table(spark, str(tmp_path / "t")).collect()}
    assert read == {i: ids_of(byte_tool, t) + [2] for i, t in enumerate(long)}


def packed(tool, texts):
    return [np.array(ids_of(tool, t), "<u2").tobytes() for t in texts]


def test_cuts_change_no_id(byte_tool, texts):
    encoder, rng = TF.Encoder(BYTE_BPE), random.Random(4)
    odd = [*"abZ09.,'-_ \n\t\r\x0b\x1c\0", "'s", "é", "漢", "\xa0", "\x85", "\u2003", "\u3000", "’", "\u180e", "\u0301", "²", "🎉", "<|endoftext|>", "<|endof"]
    some = ["".join(x) for n in range(5) for x in itertools.product("aB1.' \n", repeat=n)]
    some += ["".join(rng.choices(odd, k=rng.randrange(1, 20))) for _ in range(20_000)] + texts
    some += ["x  <|endoftext|>  y", "<|endof", "text|>", "<|endoftext|><|endoftext|>\n", None, "", " "]
    for _ in range(2):
        assert list(encoder.encode(pa.array(some))) == packed(byte_tool, some)
    assert list(encoder.encode(pa.array(some)[7:90])) == packed(byte_tool, some[7:90])
    for none in ([], [None, None], ["", None]):
        assert list(encoder.encode(pa.array(none, pa.string()))) == [b""] * len(none)


def test_repeated_chunks_are_looked_up_once(byte_tool, monkeypatch):
    looked_up, sent = [], []

    class Memo(TF.Memo):
        def __getitem__(self, key):
            looked_up.append(key)
            return super().__getitem__(key)

        def get(self, key):
            looked_up.append(key)
            return super().get(key)

    library = TF.Encoder.library
    monkeypatch.setattr(TF, "Memo", Memo)
    monkeypatch.setattr(TF.Encoder, "library", lambda self, texts: sent.extend(texts) or library(self, texts))
    words = [f"word{x}" for x in "abcdefghijklmnopqrstuvwxyz"]
    some = [f"{a}.\n{b}-{a}12, {b}" for a in words for b in words]
    assert list(TF.Encoder(BYTE_BPE).encode(pa.array(some))) == packed(byte_tool, some)
    assert len(looked_up) < 8 * len(words) and sum(map(len, sent)) < 1_000


def test_other_files_are_cut_before_spaces_only(tmp_path):
    """A pattern that joins marks to words and line breaks to marks, and an added token that takes the blanks before it."""
    with open(BYTE_BPE, encoding="utf-8") as f:
        file = json.load(f)
    split = {"type": "Split", "pattern": {"Regex": r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"},
             "behavior": "Isolated", "invert": False}
    file["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [split, file["pre_tokenizer"] | {"use_regex": False}]}
    (tmp_path / "split.json").write_text(json.dumps(file), encoding="utf-8")
    with open(BYTE_BPE, encoding="utf-8") as f:
        file = json.load(f)
    file["added_tokens"].append(file["added_tokens"][0] | {"id": 50257, "content": "<mask>", "lstrip": True})
    (tmp_path / "added.json").write_text(json.dumps(file), encoding="utf-8")
    some = ["one.two (three)\nfour.\n\nfive 12345 -six", ".a.b\t.c", "x.\ny é.z", "a<mask> b <mask>.c\n<mask>"]
    for name in ("split.json", "added.json"):
        tool = Tokenizer.from_file(str(tmp_path / name))
        assert list(TF.Encoder(str(tmp_path / name)).encode(pa.array(some))) == packed(tool, some)


def test_block_access(byte_tool):
    data = TF.pack_block([None, 4, 9], [b"\1\0\2\0", b"", b"\3\0"], 2)
    block = TF.Block(data)
    assert block.doc_ids(0, 3) == [None, 4, 9] and block.doc_ids(1, 2) == [4] and block.doc_ids(0, 1) == [None]
    assert [x.tolist() for x in block.spans(1, 3)] == [[2, 2], [2, 3]]
    ends = [-2 ** 63, -2 ** 62, -2 ** 62 + 1, 2 ** 62, 2 ** 63 - 1]
    assert TF.Block(TF.pack_block(ends, [b"\1\0"] * 5, 2)).doc_ids(0, 5) == ends
    assert [block.ids(*block.span(i)).tolist() for i in range(3)] == [[1, 2], [], [3]]
    with pytest.raises(ValueError):
        TF.Block(b"XXXX" + data[4:])


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    assert bpe.encode(none, WORD_BPE).collect() == []
    assert C.with_prefix_counts(none, WORD_BPE).collect() == []
    TF.write_token_table(none, str(tmp_path / "none"), BYTE_BPE, 2)
    assert TF.read_token_table(spark, str(tmp_path / "none")).collect() == []


def test_crc_of_the_query(spark, byte_tool):
    from gridmill.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op3_token_files"](spark, folder).collect():
        ids = ids_of(byte_tool, texts[r["doc_id"]]) + [2]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
