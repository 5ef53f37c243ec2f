import json

from loomline.cli import main
from loomline.operators.log_store import live, replay
from loomline.sources import records as src

RECORD = {"format_version": 1, "kind": "written", "created_at": "2024-06-01T10:00:00Z", "title": "t", "model": "m", "segments": [], "duration_ms": 0, "word_count": 1}


def line(key, **fields):
    return json.dumps(RECORD | {"id": key} | fields)


def test_lines_without_numbers_take_their_place(spark, tmp_path):
    path = tmp_path / "history.jsonl"
    said = [line(f"n{i % 7}", title=f"{i}", deleted=i == 699) for i in range(700)]
    said[3:3] = ["", "{broken", "  "]
    path.write_text("\n".join(said) + '\n{"id": "cut', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # many splits
    try:
        log, bad = src.read_log(spark, str(path))
        assert log.rdd.getNumPartitions() > 3 and log.count() == 700 and bad.count() == 2
        assert [r.title for r in log.orderBy("seq").collect()] == [str(i) for i in range(700)]
        assert {r.id: r.title for r in live(replay(log)).collect()} == {f"n{i % 7}": str(i) for i in range(693, 699)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_count_in_order_of_their_names(spark, tmp_path):
    for n, titles in enumerate([["a", "b"], ["c"], ["d ü"]]):
        (tmp_path / f"part {n}.jsonl").write_text("\n".join(line("x", title=t) for t in titles), encoding="utf-8")
    log, _ = src.read_log(spark, str(tmp_path))
    assert [r.title for r in log.orderBy("seq").collect()] == ["a", "b", "c", "d ü"]
    assert replay(log).first().title == "d ü"
    assert src.read_log(spark, str(tmp_path / "none.jsonl"))[0].count() == 0


def test_own_numbers_stay(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text("\n".join([line("x", seq=9, title="new"), line("x", seq=2, title="old")]))
    assert replay(src.read_log(spark, str(tmp_path / "h.jsonl"))[0]).first().title == "new"


def test_index_and_search_over_a_folder(spark, tmp_path, capsys):
    (tmp_path / "history.jsonl").write_text("\n".join([line("n1", written_content="The onboarding decision was made."), line("n2", written_content="Nothing here.")]) + "\n")
    note = tmp_path / ".notes" / "n1"
    note.mkdir(parents=True)
    (note / "meta.json").write_text(json.dumps({"title": "Side title", "tags": ["To Do"]}))
    folder = ["--save-folder", str(tmp_path)]
    assert main([*folder, "index", "build"]) == 0
    capsys.readouterr()
    assert main([*folder, "search", "onboarding decision", "--tag", "to-do"]) == 0
    out = capsys.readouterr().out
    assert "Side title" in out and "onboarding decision" in out and "n2" not in out
    assert main([*folder, "context", "--query", "onboarding", "--out", str(tmp_path / "pack.md")]) == 0 and "Side title" in (tmp_path / "pack.md").read_text()
