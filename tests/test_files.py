import json
from datetime import datetime

import pytest

from loomline.schemas import HISTORY_LOG
from loomline.sources import files as f

SEG = {"start_ms": 0, "end_ms": 1000, "text": "hello big world", "source": None, "speaker": None}
NOW = datetime(2024, 6, 1, 10, 11, 12)


def log(spark, *rows):
    base = {"seq": 1, "format_version": 1, "id": "a", "kind": "scribe", "created_at": "2024-05-01T10:00:00Z", "title": "A: talk", "model": "base", "segments": [SEG], "speaker_blocks": [], "speaker_chunks": [], "session_speakers": [], "notes": [], "duration_ms": 1250, "word_count": 3, "deleted": False}
    return spark.createDataFrame([base | r for r in rows], HISTORY_LOG)


def test_containment_and_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_bytes(b"abc")
    (tmp_path / "out.txt").write_text("o")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out.txt")
    base = str(tmp_path / "in")
    assert f.within(f"{base}/x.txt", base) == f"{base}/x.txt" and f.within(f"{base}/../out.txt", base) is None and f.within(f"{base}/link", base) is None and f.within(f"{base}/none", base) is None
    assert f.within(str(tmp_path / "in2"), base) is None
    assert f.digests(spark, f"{base}/x.txt").first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_checks(tmp_path):
    assert f.check_id(" a ") == "a" and f.check_labels(" Me ", "You") == ("Me", "You") and f.check_name(" Ann ") == "Ann" and f.check_folder(str(tmp_path / "new"))
    (tmp_path / "file").write_text("")
    for call, bad in ((f.check_id, " "), (f.check_id, None), (f.check_paths, []), (f.check_paths, ["a", " "]), (f.check_folder, "rel"), (f.check_folder, str(tmp_path / "file")), (f.check_name, "x" * 81), (f.check_name, " ")):
        with pytest.raises(ValueError):
            call(bad)
    with pytest.raises(ValueError):
        f.check_labels("a", " ")


def test_deletion_removes_only_what_lies_in_the_folder(spark, tmp_path):
    folder = tmp_path / "notes"
    session = folder / "s"
    session.mkdir(parents=True)
    for p in (session / "mic.wav", folder / "a.md", tmp_path / "outside.md"):
        p.write_text("x")
    df = log(spark, {"session_dir": str(session), "markdown_path": str(folder / "a.md")}, {"id": "b", "markdown_path": str(tmp_path / "outside.md")})
    assert f.delete_record(df, "a", str(folder)).first().deleted and not session.exists() and not (folder / "a.md").exists()
    assert f.delete_record(df, "b", str(folder)).count() == 1 and (tmp_path / "outside.md").exists()
    assert f.delete_record(df, "none", str(folder)).count() == 0
    with pytest.raises(ValueError):
        f.delete_record(df, "md::x", str(folder))


def test_export(spark, tmp_path):
    block = {"label": "In", "start_ms": 0, "end_ms": 1000, "text": "one two", "chunk_id": None}
    df = log(spark, {}, {"id": "b", "speaker_blocks": [block, block | {"label": "Ann"}]}, {"id": "c", "kind": "written"})
    path, version = f.export_record(df, "a", str(tmp_path))
    assert path.endswith("A-_talk_base.md") and version.first().markdown_path == path and version.first().seq == 2
    assert open(path).read() == "---\ntitle: 'A: talk'\nduration_seconds: 1.2\nword_count: 3\ntoken_estimate: 4\nmodel: base\n---\n\n## Transcript\n\nhello big world\n"
    again, _ = f.export_record(df, "b", str(tmp_path), mic="Me")
    assert again.endswith("A-_talk_base_1.md")
    text = open(again).read()
    assert text.startswith("---\ntitle: 'A: talk'\nword_count: 11\nmodel: base\n---\n\n## Transcript\n\n**[Me]** · 00:00–00:01\n\none two\n\n---\n\n**[Ann]**")
    for key, error in (("c", ValueError), ("dictate::1", ValueError), ("none", KeyError)):
        with pytest.raises(error):
            f.export_record(df, key, str(tmp_path))


def test_sessions_and_salvage(tmp_path):
    s = f.make_session(str(tmp_path), NOW)
    assert s.endswith("2024-06-01_10-11-12")
    f.write_manifest(s, {"state": "recording"})
    f.write_manifest(s, {"state": "complete"})
    f.write_notes(s, "T", "mic.wav", [{"text": "n"}])
    assert json.load(open(f"{s}/session.json")) == {"state": "complete"} and json.load(open(f"{s}/notes.json"))["wav_file"] == "mic.wav"
    (tmp_path / "2024-06-01_10-11-12" / "mic.wav").write_text("x")
    f.finish_session(s, keep_audio=True)
    assert [p.name for p in (tmp_path / "2024-06-01_10-11-12").iterdir()] == ["mic.wav"]
    f.finish_session(s, keep_audio=False)
    f.finish_session(s, keep_audio=False)
    wav = tmp_path / "t.wav"
    wav.write_text("x")
    assert f.salvage(str(tmp_path), str(wav), NOW).endswith("dictate_failures/2024-06-01_10-11-12.wav") and not wav.exists()
