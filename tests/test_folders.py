"""Folders of many files: written and listed without a list of names on the driver."""

import contextlib
import dataclasses
import io
import os

import pytest

from gridmill import schema as S
from gridmill.sources import files as W, tables as IO


def tree(folder):
    return sorted(p.name for p in folder.iterdir())


def staged(tmp_path, overwrite, *tasks):
    """A writer and its messages, as tasks leave them: a folder with files and the list of their names."""
    writer, messages = W.OneFilePerRow(str(tmp_path / "out"), overwrite), [None]
    for number, names in enumerate(tasks):
        writer.names, writer.made = None, set()
        done = W.Written(f"{writer.staging}/{number}")
        for name in names:
            with writer.open(done, name) as out:
                out.write(name.encode())
        messages.append(writer.end(done))
    return writer, messages


def test_messages_hold_no_names(tmp_path):
    writer, messages = staged(tmp_path, True, [f"f{i}" for i in range(500)], [], ["é", "a/b"])
    assert all(not isinstance(v, (list, tuple, dict)) for m in messages if m for v in dataclasses.asdict(m).values())
    writer.commit(messages)
    assert tree(tmp_path / "out") == sorted(["_SUCCESS", "a", "é", *(f"f{i}" for i in range(500))])
    assert (tmp_path / "out" / "a" / "b").read_bytes() == b"a/b" and (tmp_path / "out" / "é").read_text() == "é"


def test_repeated_names_are_found_part_by_part(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "HASHED", 50)
    monkeypatch.setattr(W, "AT_ONCE", 7)
    for k in (0, 123, 299):
        writer, messages = staged(tmp_path, True, [f"f{i}" for i in range(300)], [f"f{k}", "new"])
        with pytest.raises(ValueError, match=f"two rows have the file name f{k}$"):
            writer.commit(messages)
    writer, messages = staged(tmp_path, True, [f"f{i}" for i in range(150)], [f"f{i}" for i in range(150, 300)])
    writer.commit(messages)
    assert len(tree(tmp_path / "out")) == 301
    writer, messages = staged(tmp_path, False, ["new"], ["f299"])
    with pytest.raises(ValueError, match="two rows have the file name f299$"):
        writer.commit(messages)
    assert len(tree(tmp_path / "out")) == 301
    writer, messages = staged(tmp_path, True, ["only"])
    writer.commit(messages)
    assert tree(tmp_path / "out") == ["_SUCCESS", "only"]


def spark_lists(spark, folder):
    return IO.only_images(spark.read.format("binaryFile").schema(S.IMAGES).option("pathGlobFilter", IO.IMAGE_GLOB).load(folder))


def rows(df):
    return sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in df.collect())


def test_a_folder_is_listed_by_tasks_as_spark_lists_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "LIST_FILES", 8)
    monkeypatch.setattr(W, "AT_ONCE", 3)
    monkeypatch.setattr(W, "CONTENT_BYTES", 5)
    for name in ("a.PNG", "b b.jpeg", "c.txt", "d", "é.webp", ".png", ".x.png", "_y.png", "_z=1.png", "e%20.bmp", "a.b.tiff", "png",
                 *(f"n{i}.jpg" for i in range(30))):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "sub.png").mkdir()
    (tmp_path / "sub.png" / "f.png").write_bytes(b"f")
    os.symlink(tmp_path / "c.txt", tmp_path / "link.png")
    os.symlink(tmp_path / "missing", tmp_path / "broken.png")
    found = IO.scan_images(spark, str(tmp_path))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.select("path", "length").explain("formatted")
    assert "folder_files" in out.getvalue() and "binaryFile" not in out.getvalue() and "EvalPython" not in out.getvalue()
    assert found.rdd.getNumPartitions() > 3 and found.schema == spark_lists(spark, str(tmp_path)).schema
    for folder in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/sub.png/.."):
        assert rows(IO.scan_images(spark, folder)) == rows(spark_lists(spark, folder))
    assert rows(found.where("length(content) > 6")) == rows(spark_lists(spark, str(tmp_path)).where("length(content) > 6"))


def test_other_folders_are_left_to_spark(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "a.png").write_bytes(b"a")
    for folder in (str(tmp_path), f"{tmp_path}/*", f"{tmp_path}/k=1/a.png", f"{tmp_path}/k=[1]"):
        assert rows(IO.scan_images(spark, folder)) == rows(spark_lists(spark, folder)) != []
        assert W.list_files(spark, folder, (".png",)) is None
