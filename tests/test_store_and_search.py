import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import chunking as c
from loomline.operators import log_store as ls
from loomline.operators import read_models as rm
from loomline.operators.search import SearchOptions, context_pack, result_lines, search
from loomline.schemas import HISTORY_LOG, NOTE_META
from loomline.session import scratch
from loomline.sources import records as src

SEG = {"start_ms": 0, "end_ms": 1000, "text": "hello big world", "source": None, "speaker": None}


def row(seq, id, **more):
    base = {"seq": seq, "format_version": 1, "id": id, "kind": "scribe", "created_at": "2024-05-01T10:00:00Z", "title": "T", "model": "m", "segments": [SEG], "speaker_blocks": [], "speaker_chunks": [], "session_speakers": [], "notes": [], "duration_ms": 1000, "word_count": 3, "deleted": False}
    return base | more


def log(spark, *rows):
    return spark.createDataFrame([{k: v for k, v in r.items()} for r in rows], HISTORY_LOG)


def test_reads_lines_and_bad_lines(spark, tmp_path):
    p = tmp_path / "history.jsonl"
    p.write_text("\n".join([json.dumps(row(1, "a")), "{broken", "", json.dumps(row(2, "b", kind="memo")), json.dumps(row(3, "a", title="new")), '{"id": "c"'])) 
    good, bad = src.read_log(spark, str(p))
    assert [(r.id, r.title) for r in ls.live(ls.replay(good)).collect()] == [("a", "new")] and bad.count() == 2


def test_replay_tombstones_and_compaction(spark):
    df = log(spark, row(1, "a"), row(2, "b"), row(3, "a", deleted=True), row(4, "b", title="B2"), row(5, "c", deleted=True), row(6, "c"))
    state = ls.replay(df)
    assert {(r.id, r.seq, r.first_seq) for r in ls.live(state).collect()} == {("b", 4, 2), ("c", 6, 5)}
    target = scratch(spark, "log")
    ls.compact(df, target)
    from loomline.operators.changes import current

    assert {r.id for r in current(spark, target).collect()} == {"b", "c"}
    assert ls.lookup(state, "a").count() == 0 and ls.tombstone(df, "a").count() == 0
    assert ls.live(ls.replay(df.unionByName(ls.tombstone(df, "b")))).select("id").collect()[0].id == "c"


def test_sidecars_override(spark):
    meta = spark.createDataFrame([("a", "Better", ["x"], [], [])] * 2 + [("b", " ", None, None, None)], NOTE_META)
    bodies = spark.createDataFrame([("a", "one two")], "note_id string, content string")
    got = {r.id: r for r in ls.hydrate(ls.replay(log(spark, row(1, "a"), row(2, "b"))), meta, bodies).collect()}
    assert (got["a"].title, got["a"].written_content, got["a"].word_count) == ("Better", "one two", 2) and got["b"].title == "T"


def test_relabel(spark):
    block = lambda label, link=None: {"label": label, "start_ms": 0, "end_ms": 1, "text": "x", "chunk_id": link}
    chunk = {"id": "k", "start_ms": 0, "end_ms": 1, "label": "Speaker 1", "corrections": []}
    df = log(spark, row(1, "a", speaker_blocks=[block("Speaker 1", "k"), block("Speaker 1"), block("Out")], speaker_chunks=[chunk]))
    every = ls.relabel_all(df, "a", "Speaker 1", " Ann ").first()
    assert [b.label for b in every.speaker_blocks] == ["Ann", "Ann", "Out"] and every.speaker_chunks[0].label == "Ann" and every.seq == 2
    one = ls.relabel_one(df, "a", 0, "Bo").first()
    assert [b.label for b in one.speaker_blocks] == ["Bo", "Speaker 1", "Out"] and one.speaker_chunks[0].label == "Bo"
    for bad in (lambda: ls.relabel_all(df, "a", "Nobody", "x"), lambda: ls.check_label("a", "é" * 41), lambda: ls.check_label("a", " ")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        ls.relabel_one(df, "a", 3, "x")


def test_attach_twice(spark):
    base = log(spark, row(1, "a"))
    more = spark.createDataFrame([("a", [SEG], "m2")], "id string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string,source:string,speaker:string>>, model string")
    got = ls.attach(ls.attach(base, more), more).first()
    assert [(s.start_ms, s.end_ms) for s in got.segments] == [(0, 1000), (1000, 2000), (2000, 3000)] and (got.duration_ms, got.word_count, got.model) == (3000, 9, "m2")


def test_names_and_meta(spark):
    names = spark.createDataFrame([("Ann B", "ann-b", "t0", None)], "name string, slug string, created_at string, updated_at string")
    assert ls.save_name(names, "Ann  B", "ann-b", "t1").first().created_at == "t0"
    both = ls.save_name(names, "Cy", "cy", "t1")
    assert both.count() == 2 and ls.delete_name(both, "cy").count() == 1
    with pytest.raises(ValueError):
        ls.save_name(both, "Cy", "cy", "t2", old_slug="ann-b")
    meta = spark.createDataFrame([("a", "t", ["x"], None, None)], NOTE_META)
    new = spark.createDataFrame([("a", "t2"), ("b", "u")], "note_id string, title string")
    assert {(r.note_id, r.title, tuple(r.tags or ())) for r in ls.upsert_meta(meta, new).collect()} == {("a", "t2", ("x",)), ("b", "u", ())}


def test_chunks(spark):
    lines = spark.createDataFrame([("n", i, i * 10, i * 10 + 5, "w " * 150) for i in range(7)] + [("n", 9, None, None, " ")], "note_id string, i int, start_ms bigint, end_ms bigint, text string")
    got = c.fill_chunks(lines, ["i"]).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start_ms, r.end_ms, len(r.text.split())) for r in got] == [(0, 0, 25, 450), (1, 30, 55, 450), (2, 60, 65, 150)]
    assert c.written_chunks("# Alpha\ntext\n\n# Beta\nmore") == ["# Alpha\ntext", "# Beta\nmore"]
    assert [len(x.split()) for x in c.written_chunks("\n\n".join(["w " * 400, "v " * 300, "u " * 30]))] == [400, 330]
    said = spark.createDataFrame([("a", [SEG]), ("b", [SEG | {"text": "w " * 700}])], "note_id string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string,source:string,speaker:string>>")
    assert sorted((r.note_id, r.ordinal, r.start_ms, len(r.text.split())) for r in c.chunk_dictated(said).collect()) == [("a", 0, 0, 3), ("b", 0, None, 420), ("b", 1, None, 280)]


def test_index_to_context_pack(spark):
    df = log(spark, row(1, "a", segments=[SEG | {"text": "the onboarding decision was made about onboarding"}]), row(2, "b", kind="written", written_content="# Lunch\nsoup recipes and soup"), row(3, "c", deleted=True))
    meta = spark.createDataFrame([("a", None, ["Work Items"], None, None)], NOTE_META)
    target = scratch(spark, "index")
    c.write_index(c.build_index(ls.replay(df), meta), target)
    index = c.read_index(spark, target)
    assert index.count() == 2
    options = SearchOptions("onboarding decision onboarding", limit=1)
    found = search(index, options, "2024-06-01T00:00:00Z")
    top = found.collect()
    assert [r.note_id for r in top] == ["a"] and "onboard" in top[0].matched_terms and top[0].total > 0
    assert result_lines(found).first().line.split("\t")[2] == "a"
    assert "## 1. T (2024-05-01T10:00:00Z)" in context_pack(found, options, "now")
    assert "No matching" in context_pack(search(index, SearchOptions("x", since_days=1), "2024-06-01T00:00:00Z"), options, "now")
    assert [r.note_id for r in search(index, SearchOptions("soup", tag="work-items"), "2024-06-01T00:00:00Z").collect()] == ["a"]
    with pytest.raises(ValueError):
        c.read_index(spark, target, "other")


def test_read_models(spark):
    state = ls.replay(log(spark, row(1, "a"), row(2, "b", kind="written", written_content=" note ", created_at="2024-06-12T01:00:00Z", duration_ms=5999)))
    items = {r.id: r for r in rm.list_summaries(state).collect()}
    assert items["a"].excerpt == "hello big world" and items["b"].excerpt == "note" and items["b"].duration_secs == 5
    d = rm.dashboard(state, "2024-06-12T12:00:00Z").first()
    assert (d.notes, d.written, d.week_secs) == (2, 1, 5)
    assert rm.recorded_this_week(rm.list_summaries(state), "2020-01-01T00:00:00Z").first().week_secs is None
    assert [rm.of_kind(rm.list_summaries(state), k).count() for k in ("all", "written", "upload")] == [2, 1, 0]
    q = spark.createDataFrame([("1", "done", 0.0), ("2", "queued", 0.9), ("3", "processing", 0.5)], "id string, status string, progress double")
    assert rm.batch_progress(q).first().progress == 0.5 and rm.batch_progress(q.limit(0)).first().progress == 0
    e = spark.createDataFrame([("2", 7.0, 1)], "item_id string, progress double, seq int")
    assert {(r.id, r.status, r.progress) for r in rm.apply_progress(q, e).collect()} == {("1", "done", 0.0), ("2", "processing", 1.0), ("3", "processing", 0.5)}
    f = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, base string")
    assert [r.name for r in rm.unique_file_names(f).orderBy("id").collect()] == ["x.md", "x_1.md", "y.md"]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: 'A'\nmodel: m\n---\nx")
    (tmp_path / "b.md").write_text("plain")
    assert {(r.title, r.model) for r in src.read_legacy_markdown(spark, str(tmp_path)).collect()} == {("A", "m"), ("b", "")}
    session = tmp_path / "audio" / "s1"
    session.mkdir(parents=True)
    for n in ("mic.wav", "speaker.wav"):
        (session / n).write_bytes(src.encode_wav([0.0, 0.5, -0.5]))
    (session / "session.json").write_text('{"state": "recording"}')
    (tmp_path / "audio" / "x.MP3").write_bytes(b"0")
    (tmp_path / "audio" / "x.txt").write_bytes(b"0")
    got = {(r.path.rsplit("/", 1)[1], r.dual) for r in src.expand_inputs(spark, [str(tmp_path / "audio")]).collect()}
    assert got == {("s1", True), ("x.MP3", False)}
    assert [r.state for r in src.incomplete_sessions(spark, str(tmp_path / "audio")).collect()] == ["recording"]
    assert src.read_speaker_names(spark, str(tmp_path / "none.json")).count() == 0
    pcm = src.decode_files(spark.read.format("binaryFile").load(str(session / "mic.wav"))).first().pcm
    assert [round(x, 2) for x in pcm] == [0, 0.5, -0.5] and src.wav_millis(src.encode_wav([0.0])) == 1
    assert src.decode_wav(b"no") is None and len(src.repair_wav(b"\0" * 48)) == 48
    config = tmp_path / "c.json"
    config.write_text("{")
    assert src.load_config(str(config), {"a": 1}) == {"a": 1} and (tmp_path / "c.json.corrupt").exists()
    src.save_config(str(config), {"a": 2})
    assert src.load_config(str(config), {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    src.write_documents(spark.createDataFrame([("n.md", "text")], "name string, body string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "n.md").read_text() == "text"


def test_chunks_over_many_stretches(spark):
    import random

    rnd = random.Random(8)
    rows = [(rnd.choice("aab"), i * 700, rnd.choice([None, i * 700]), rnd.choice([None, i * 700 + 500]), " ".join(["w"] * rnd.choice([0, 1, 5, 9, 30])) + f" l{i}") for i in range(400)]
    rows.append((None, 5, 5, 5, "no note"))
    df = spark.createDataFrame(rows, "note_id string, i bigint, start_ms bigint, end_ms bigint, text string").repartition(3)
    got = {(r.note_id, r.ordinal): (r.start_ms, r.end_ms, r.text) for r in c.fill_chunks(df, ["i"], target=40, stretch=9_000).collect()}
    want = {}
    for note in "ab":
        parts, ordinal = [], 0
        for row in [r for r in rows if r[0] == note] + [None]:
            if row:
                parts.append(row)
            if parts and (row is None or sum(len(p[4].split()) for p in parts) >= 40):
                starts, ends = [p[2] for p in parts if p[2] is not None], [p[3] for p in parts if p[3] is not None]
                want[note, ordinal] = (starts[0] if starts else None, ends[-1] if ends else None, " ".join(p[4].strip() for p in parts))
                parts, ordinal = [], ordinal + 1
    assert got == want and c.fill_chunks(df.limit(0), ["i"]).count() == 0


def test_counting_reads_no_texts(spark):
    path = scratch(spark, "log")
    log(spark, row(1, "a"), row(2, "b", segments=[]), row(3, "c", segments=None), row(4, "d", kind="written")).write.parquet(path)
    counted = rm.counts_by_kind(ls.replay(ls.usable(spark.read.parquet(path)), ["kind"]))
    assert tuple(counted.first())[:2] == (3, 2)
    plan = counted._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "segments:array<struct<start_ms:bigint>>" in plan and "written_content" not in plan
