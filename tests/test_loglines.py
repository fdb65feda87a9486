"""The line data source against plain reads."""

import random

import pytest

from lumenlog.sources import loglines


@pytest.fixture
def files(tmp_path):
    rng = random.Random(1)
    texts = {}
    for name in ("a", "b", "c"):
        rows = ["é" * rng.randint(0, 40) + str(i) if rng.random() > 0.2 else "" for i in range(rng.randint(30, 90))]
        texts[str(tmp_path / f"{name}.jsonl")] = "\n".join(rows) + ("\nunfinished" if name == "b" else "\n")
    texts[str(tmp_path / "empty.jsonl")] = ""
    texts[str(tmp_path / "one.jsonl")] = "only\n"
    texts[str(tmp_path / "blank.jsonl")] = "\n\n\nx\n\n"
    for path, text in texts.items():
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return tmp_path, texts


def plain(texts):
    return sorted((p, i, line) for p, t in texts.items() for i, line in enumerate(t.split("\n")[:-1], 1) if line)


@pytest.mark.parametrize("split", [29, 300, 1 << 20])
def test_line_numbers_equal_a_plain_reader(spark, files, split):
    folder, texts = files
    got = loglines.lines(spark, [str(folder)], split_bytes=split)
    assert sorted((r["file"], r["line_no"], r["value"]) for r in got.collect()) == plain(texts)


def test_offsets_are_bytes_and_resume(spark, files):
    folder, texts = files
    rows = loglines.lines(spark, [str(folder)], split_bytes=50).collect()
    for r in rows:
        assert texts[r["file"]].encode()[r["offset"] : r["end"]] == (r["value"] + "\n").encode()
    half = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["line_no"])):
        if r["line_no"] <= 20:
            half[r["file"]] = (r["end"], r["line_no"])
    rest = loglines.lines(spark, [str(folder)], resume=half, split_bytes=33)
    assert sorted((r["file"], r["line_no"], r["value"]) for r in rest.collect()) == [x for x in plain(texts) if x[0] not in half or x[1] > half[x[0]][1]]


def test_heads_and_tails(spark, files):
    folder, texts = files
    assert {r["file"]: r["value"] for r in loglines.first_lines(spark, [str(folder)]).collect()} == {p: t.split("\n")[0] for p, t in texts.items() if t}
    got = {}
    for r in loglines.last_lines(spark, [str(folder)], 60).collect():
        got.setdefault(r["file"], []).append((r["offset"], r["value"]))
    for p, t in texts.items():
        raw = t.encode()
        cut = raw[-60:].split(b"\n")[1:] if len(raw) > 60 else raw.split(b"\n")
        assert [v for _, v in sorted(got.get(p, []))] == [x.decode() for x in cut if x]
        assert all(raw[o : o + len(v.encode())] == v.encode() for o, v in got.get(p, []))
    with pytest.raises(Exception, match="first line exceeds"):
        (folder / "long.jsonl").write_text("x" * 300_000)
        loglines.first_lines(spark, [str(folder)], most=100_000).collect()


def test_no_files(spark, tmp_path):
    assert loglines.lines(spark, [str(tmp_path)]).collect() == [] and loglines.first_lines(spark, [str(tmp_path / "none")]).collect() == []


def test_zstd(spark, tmp_path):
    import pyarrow as pa

    text = "\n".join(f"line {i}" for i in range(500)) + "\ncut"
    with pa.output_stream(str(tmp_path / "z.jsonl.zst"), compression="zstd") as f:
        f.write(text.encode())
    path = str(tmp_path / "z.jsonl.zst")
    got = loglines.lines(spark, [str(tmp_path)], split_bytes=10)
    assert sorted((r["file"], r["line_no"], r["value"]) for r in got.collect()) == plain({path: text})
    part = loglines.lines(spark, [str(tmp_path)], resume={path: (len(b"line 0\nline 1\n"), 2)}).collect()
    assert min(r["line_no"] for r in part) == 3 and len(part) == 498
    assert loglines.first_lines(spark, [str(tmp_path)]).first()["value"] == "line 0"
    assert [r["value"] for r in loglines.last_lines(spark, [str(tmp_path)], 12).collect()][-1] == "cut"


def test_stream_waits_for_newlines_and_replays_what_was_rewritten(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"

    def run():
        q = loglines.tail(spark, [str(logs)]).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["value"], r["replayed"]) for r in spark.read.parquet(out).collect())
        new = [r for r in rows if r not in seen]
        seen.extend(new)
        assert len(rows) == len(seen)  # nothing twice
        return new

    seen = []
    a.write_text("one\ntw")
    b.write_text("x\n\n")
    assert run() == [("a.jsonl", 0, "one", False), ("b.jsonl", 0, "x", False)]
    a.write_text("one\ntwo\nthr")
    assert run() == [("a.jsonl", 4, "two", False)]
    a.write_text("one\ntwo\nthree\n")
    b.write_text("x\n\ny\n")
    assert run() == [("a.jsonl", 8, "three", False), ("b.jsonl", 3, "y", False)]
    a.write_text("new\nlines\nof all\nkinds\n")  # longer, but other first bytes
    b.write_text("x\n")  # shorter
    assert run() == [("a.jsonl", 0, "new", True), ("a.jsonl", 4, "lines", True), ("a.jsonl", 10, "of all", True), ("a.jsonl", 17, "kinds", True), ("b.jsonl", 0, "x", True)]
    assert run() == []
