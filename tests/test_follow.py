"""Growing files: appended lines, truncation, restarts and ranges give every line once."""

import pytest

from faultline.sources.follow import FollowReader, follow_lines, follow_logs


def lines_of(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            out += [(r["file"].rsplit("/", 1)[1], r["pos"], r["value"]) for r in batch.to_pylist()]
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_ranges_of_any_size_give_every_line_once(tmp_path, size):
    text = b"first\n\n\nlong line " + b"x" * 50 + b"\nb\r\n" + "é中\n".encode() + b"\xff\n" + b"\n" * 5 + b"last\nopen"
    (tmp_path / "a.log").write_bytes(text)
    (tmp_path / "none.log").write_bytes(b"")
    (tmp_path / "half.log").write_bytes(b"no end")
    reader = FollowReader(str(tmp_path), "*.log", size, False)
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append(("a.log", at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    assert lines_of(reader, reader.initialOffset(), reader.latestOffset()) == want


def test_appends_truncation_rewrite_and_removal(tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.txt"
    reader = FollowReader(str(tmp_path), "*.log", 16, False)
    at = reader.initialOffset()

    def more():
        nonlocal at
        start, at = at, reader.latestOffset()
        assert reader.latestOffset() == at
        again = FollowReader(str(tmp_path), "*.log", 5, False)  # as after a restart: it knows the offsets only
        assert lines_of(again, start, at) == lines_of(reader, start, at)
        return [v for _, _, v in lines_of(reader, start, at)]

    assert more() == []
    b.write_text("not followed\n")
    a.write_text("one\ntw")
    assert more() == ["one"]
    with a.open("a") as f:
        f.write("o\nthree\n")
    assert more() == ["two", "three"]
    assert more() == []
    a.write_text("new\n")
    assert more() == ["new"]
    a.write_text("other and longer than before\nx\n")  # rewritten, longer: known by its beginning
    assert more() == ["other and longer than before", "x"]
    with a.open("a") as f:
        f.write("y" * 300_000 + "\nz\n")
    assert more() == ["y" * 300_000, "z"]
    a.unlink()
    assert more() == []
    a.write_text("back\n")
    assert more() == ["back"]


def test_from_end_passes_over_what_is_there(tmp_path):
    (tmp_path / "a.log").write_text("old\nhal")
    reader = FollowReader(str(tmp_path / "a.log"), "*", 16, True)
    start = reader.initialOffset()
    with (tmp_path / "a.log").open("a") as f:
        f.write("f\nnew\n")
    assert [v for *_, v in lines_of(reader, start, reader.latestOffset())] == ["half", "new"]


def test_stream_restarts_without_loss_or_repeats(spark, tmp_path):
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ckpt")
    logs.mkdir()

    def run():
        query = (
            follow_logs(spark, str(logs), "app", {"pattern": "*.log", "range_bytes": "40"})
            .writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.file.rsplit("/", 1)[1], r.seq, r.message) for r in spark.read.parquet(out).collect())

    line = "2024-05-01T10:00:{:02d}Z ERROR failed {}\n"
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("".join(line.format(i, i) for i in range(5)) + "2024-05-01T10:01")
    n = len(line.format(0, 0))
    want = [("a.log", i * n, f"failed {i}") for i in range(5)]
    assert run() == want
    with a.open("a") as f:
        f.write(":00Z WARN slow\n")
    b.write_text(line.format(7, 7))
    want += [("a.log", 5 * n, "slow"), ("b.log", 0, "failed 7")]
    assert run() == sorted(want)
    assert run() == sorted(want)
    b.write_text("2024-05-01T10:02:00Z INFO cut\n")  # shorter: read from its start again
    assert run() == sorted([*want, ("b.log", 0, "cut")])


def test_a_file_is_followed_while_the_stream_runs(spark, tmp_path):
    log = tmp_path / "grows.log"
    log.write_text("a\n")
    query = follow_lines(spark, str(log)).writeStream.format("memory").queryName("grows").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for text in ("b\nc", "\nd\n", ""):
            query.processAllAvailable()
            with log.open("a") as f:
                f.write(text)
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r.value for r in spark.table("grows").orderBy("pos").collect()] == ["a", "b", "c", "d"]
