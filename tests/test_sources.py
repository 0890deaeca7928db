"""Loaders over small files written here."""

import json

import pytest

from stancelake.sources import loaders as ld, routing


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def units(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("section_id").collect()]


def test_srt(spark, tmp_path):
    p = put(tmp_path, "a.srt", "1\n00:00:01,500 --> 00:00:02,000\n[Speaker 1 (Ann)] Hello\nthere.\n\n2\n00:00:03,000 --> 00:00:04,000\n[Speaker 1 (Ann)] Again.\n\n3\nno time\nlost\n\n4\n00:00:05,000 --> x\n[Speaker 2] Hi.\n")
    got = units(ld.srt(ld.text_files(spark, p)), "speaker", "text")
    assert got == [("Speaker 1 (Ann)", "Hello there. Again."), ("Speaker 2", "Hi.")]


def test_vtt(spark, tmp_path):
    p = put(tmp_path, "a.vtt", "WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000\n<v Ann>One.</v>\n\n01:00:02.000 --> 01:00:03.000\nTwo.\n")
    assert units(ld.vtt(ld.text_files(spark, p)), "speaker", "text") == [("Ann", "One."), ("Speaker", "Two.")]


def test_ass(spark, tmp_path):
    p = put(tmp_path, "a.ass", "[Script Info]\nx\n[Events]\nFormat: Layer, Start, End, Name, Text\nDialogue: 0,0:00:01.00,0:00:02.00,Bo,{\\b1}Hi, all\\Nof you\nDialogue: 0,bad,0:00:02.00,Bo,no\nDialogue: 0,0:00:03.00,0:00:04.00,,Who\n[Fonts]\n")
    assert units(ld.ass(ld.text_files(spark, p)), "speaker", "text") == [("Bo", "Hi, all of you"), ("Speaker", "Who")]


def test_chat_lines_and_cues(spark, tmp_path):
    a = put(tmp_path, "a.jsonl", '{"x":1}\n{"name":"Ann","is_user":true,"send_date":"June 10, 2026 2:30pm","mes":"Hi."}\nnot json\n{"name":"Bo","is_user":false,"mes":"Yo."}\n')
    got = units(ld.chat_jsonl(ld.text_files(spark, a)), "speaker", "text", "is_user")
    assert got == [("Ann", "Hi.", True), ("Bo", "Yo.", False)]
    assert str(ld.chat_jsonl(ld.text_files(spark, a)).orderBy("section_id").first().sent_at) == "2026-06-10 14:30:00"
    b = put(tmp_path, "b.jsonl", '{"speaker":"A","text":"x","start_ms":"oops"}\n{"speaker":"A","text":"y","start_ms":2000}\n{"speaker":"B","text":" "}\n')
    assert units(ld.chat_jsonl(ld.text_files(spark, b)), "speaker", "text") == [("A", "x y")]


def test_chatgpt_thread(spark, tmp_path):
    node = lambda i, parent, kids, role=None, parts=None: {"id": i, "parent": parent, "children": kids, "message": None if role is None else {"author": {"role": role}, "content": {"parts": parts}, "create_time": 1.5}}
    mapping = {"r": node("r", None, ["s"]), "s": node("s", "r", ["u"], "system", ["no"]), "u": node("u", "s", ["a"], "user", ["Hi", "you"]), "a": node("a", "u", [], "assistant", ["Hello."])}
    p = put(tmp_path, "c.json", json.dumps([{"id": "c1", "title": "T", "mapping": mapping}]))
    assert units(ld.chatgpt(ld.text_files(spark, p)), "section_id", "speaker", "text") == [("c1#turn-0", "User", "Hi\nyou"), ("c1#turn-1", "ChatGPT", "Hello.")]


def test_claude_and_mistral(spark, tmp_path):
    p = put(tmp_path, "d.json", json.dumps({"conversations": [{"uuid": "u", "name": None, "chat_messages": [{"sender": "human", "text": "plain", "content": []}, {"sender": "assistant", "text": "no", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "t"}, {"type": "text", "text": "b"}]}, {"sender": "human", "text": " "}]}]}))
    assert units(ld.claude(ld.text_files(spark, p)), "speaker", "text") == [("Human", "plain"), ("Assistant", "a\n\nb")]
    p = put(tmp_path, "e.json", json.dumps([{"chatId": "k", "role": "user", "content": "q"}, {"role": "assistant", "content": "r"}, {"role": "user", "content": ""}]))
    assert units(ld.mistral(ld.text_files(spark, p)), "section_id", "speaker", "text") == [("k#turn-0", "User", "q"), ("k#turn-1", "Mistral", "r")]


def test_markdown_nesting(spark, tmp_path):
    long = "This sentence is long enough to be kept as a section."
    p = put(tmp_path, "n.md", f"---\nt: 1\n---\n{long}\n\n# Overview\n{long}\n\n## Scope\n{long} `code` &amp; <b>bold</b>\n\n### Limits\n{long}\n\n## Audience\n{long}\n\n# Short\nno\n")
    rows = {r.heading: r for r in ld.markdown(ld.text_files(spark, p)).collect()}
    assert set(rows) == {None, "Overview", "Scope", "Limits", "Audience"}
    assert rows["Scope"].text == f"{long} code & bold"
    assert rows["Limits"].parent_section_id == rows["Scope"].section_id
    assert rows["Audience"].parent_section_id == rows["Overview"].section_id
    assert rows["Overview"].parent_section_id is None


def test_records_canvas_transcript_images(spark, tmp_path):
    p = put(tmp_path, "t.csv", "﻿id,speaker,text\n1,A,hello\n2,B,\n")
    assert units(ld.csv(spark, p), "speaker", "text") == [("A", "hello")]
    p = put(tmp_path, "t.jsonl", '{"id":1,"text":"x"}\n{"id":2,"text":""}\n')
    assert units(ld.json(spark, p, speaker=None, lines=True), "text") == [("x",)]
    p = put(tmp_path, "b.canvas", json.dumps({"nodes": [{"id": "1", "type": "text", "text": "A text node that is certainly long enough."}, {"id": "2", "type": "text", "text": "short"}, {"id": "3", "type": "file"}]}))
    assert [r.section_id.split("#")[1] for r in ld.canvas(ld.text_files(spark, p)).collect()] == ["1"]
    p = put(tmp_path, "transcription_x.txt", "one\n\n# two\n")
    assert units(ld.transcription(ld.text_files(spark, p)), "text") == [("one",), ("# two",)]
    good, bad = put(tmp_path, "image-1.meta.yaml", "description: A cat.\ntimestamp: 2024-01-02\n"), put(tmp_path, "image-2.meta.yaml", "- x\n")
    assert units(ld.image_meta_units(ld.text_files(spark, good)), "text") == [("A cat.",)]
    assert ld.image_meta(ld.text_files(spark, bad)).first().error == "root is not a mapping"


def test_routing(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("/v/transcription_a.txt", ""), ("/v/image-1.meta.yaml", ""), ("/v/a.SRT", ""), ("/v/a.md", ""), ("/v/c.json", '[{"mapping": {}}]'), ("/v/d.json", '[{"chatId": 1}]'), ("/v/x.bin", "")], "path string, head string")
    got = [r.f for r in df.select(routing.route(F.col("path"), F.col("head"))["format"].alias("f")).collect()]
    assert got == ["transcription", "image_meta", "chat_native", "markdown", "chatgpt_export", None, None]
    for name in ("keep.md", ".hidden.md", "drop.md", "x.png"):
        put(tmp_path, name, "x")
    (tmp_path / "build").mkdir()
    put(tmp_path, "build/in.md", "x")
    got = sorted(r.relative for r in routing.corpus(spark, str(tmp_path), ["drop.*", "build/", "# note"]).collect())
    assert got == ["keep.md"]


def test_registry():
    r = ld.catalogue()
    assert len(r.names()) >= 12
    with pytest.raises(ValueError):
        r.register("markdown", ld.markdown)
    with pytest.raises(KeyError):
        r.resolve("nope")
