"""A folder listed and loaded by executors."""

import json
import os

from stancelake.plans.engine import Engine
from stancelake.sources import corpus

LONG = "This sentence is long enough to be kept as a section."


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def names(df):
    return sorted(r.relative for r in df.collect())


def test_walk(spark, tmp_path):
    write(tmp_path / "r", {
        "a.md": "# A\n\nx", "b/c.md": "x", "b/d/e.canvas": "{}", "b/.ignore": "d/*.tmp\n/top.md\nhere/\n", "b/top.md": "", "b/d/top.md": "", "b/d/x.tmp": "", "b/here/f.md": "", "here/f.md": "",
        ".git/config": "x", "p.png": "x", "drop/g.md": "", ".hidden.md": "x", "_under.md": "", "empty.md": "",
    })
    os.symlink(tmp_path / "r", tmp_path / "r/b/loop")
    os.symlink(tmp_path / "r/a.md", tmp_path / "r/link.md")
    files, skipped = corpus.listed(spark, str(tmp_path / "r"), ignore=["drop/"])
    assert names(files) == [".hidden.md", "_under.md", "a.md", "b/c.md", "b/d/e.canvas", "b/d/top.md", "empty.md", "here/f.md"]
    assert {r.reason: r.n for r in skipped.collect()} == {"link": 2, "hidden": 1, "image": 1, "ignored": 4}
    assert "p.png" in names(corpus.listed(spark, f"file://{tmp_path}/r", images=True)[0])
    assert names(corpus.listed(spark, str(tmp_path / "r/p.png"))[0]) == ["p.png"]
    assert names(corpus.listed(spark, str(tmp_path / "none"))[0]) == []
    sizes = {r.relative: (r.size, r.extension) for r in files.collect()}
    assert sizes["b/d/e.canvas"] == (2, ".canvas") and sizes["empty.md"] == (0, ".md")


def test_what_vanishes_is_counted(spark, tmp_path):
    assert [r[4] for r in corpus.entries(str(tmp_path / "gone"), "gone", [], False, ".ignore")] == ["vanished"]
    write(tmp_path, {"a.md": "x", "b.md": "y"})
    files, _ = corpus.listed(spark, str(tmp_path))
    os.remove(tmp_path / "a.md")
    assert {r.path.rsplit("/", 1)[1]: (r.content, r.problem) for r in corpus.contents(files).collect()} == {"a.md": (None, "vanished"), "b.md": (bytearray(b"y"), None)}


def test_every_format_is_dispatched(spark, tmp_path):
    canvas = {"nodes": [{"id": "n", "type": "text", "text": LONG}], "edges": []}
    chatgpt = [{"id": "c", "title": "T", "create_time": 1.0, "mapping": {"r": {"id": "r", "message": None, "parent": None, "children": ["m"]}, "m": {"id": "m", "message": {"author": {"role": "user"}, "content": {"parts": ["Hello there."]}, "create_time": 2.0}, "parent": "r", "children": []}}}]
    write(tmp_path, {
        "a.md": f"﻿# A\n\n{LONG}", "b.canvas": json.dumps(canvas), "c.txt": "One line.\nTwo lines.", "d.srt": "1\n00:00:01,000 --> 00:00:02,000\n[Speaker 1 (A)] Hello.\n", "e.json": json.dumps(chatgpt), "f.json": "{}",
        "g.yaml": "description: A house.\n", "h.yaml": "[", "i.pdf": b"one|two", "j.pdf": b"bad", "k.png": b"\x89", "l.xyz": "?", "m.md": "",
    })

    def extract(raw):
        if raw == b"bad":
            raise ValueError
        return raw.decode().split("|")

    units, warnings, _ = corpus.load(spark, str(tmp_path), images=True, extract=extract, describe=lambda paths: ["A picture."] * len(paths))
    n = {}
    for r in units.collect():
        n[r.source_path.rsplit("/", 1)[1]] = n.get(r.source_path.rsplit("/", 1)[1], 0) + 1
    assert n == {"a.md": 1, "b.canvas": 1, "c.txt": 2, "d.srt": 1, "e.json": 1, "g.yaml": 1, "i.pdf": 2, "k.png": 1}
    told = {r.path.rsplit("/", 1)[1]: r.problem for r in warnings.collect()}
    assert set(told) == {"f.json", "h.yaml", "j.pdf", "l.xyz", "m.md"}
    assert (told["f.json"], told["l.xyz"], told["m.md"]) == ("no units", "no loader", "no units") and told["j.pdf"].startswith("not extracted") and "YAML" in told["h.yaml"]
    _, warnings = Engine(spark, "/none").load_folder(str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in warnings.where("problem = 'no extractor for PDF'").collect()} == {"i.pdf", "j.pdf"}


def test_bytes_that_are_no_text_stop_nothing(spark, tmp_path):
    said = b"# Heading\n\nThe text of this document is long enough to be kept as a section of its own.\n"
    for i in range(5):
        (tmp_path / f"d{i}.md").write_bytes(said + b"\xff\xfe" * (i % 2))
    units, warnings, _ = corpus.load(spark, str(tmp_path))
    assert units.select("source_path").distinct().count() == 5 and warnings.count() == 0


def test_files_are_written_by_many_tasks(spark, data):
    from stancelake.plans import ledger

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folder", "folder")
    root = ledger._folder(spark, data)
    stages = [s for j in tracker.getJobIdsForGroup("folder") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("tests", "tests")
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) > 1
    assert all(".ignore" in names for _, _, names in os.walk(root) if names)
