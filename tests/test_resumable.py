"""The resumable text sink: killed, damaged, changed, finished; and progress."""

import pytest

from quillmill.streaming import resumable

PAPERS = {"dataset": "papers", "config": "a", "split": "train", "revision": "r1"}


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "src")
    for i in range(3):
        rows = [(f"article {i}", " abstract\n"), (None, " "), ("", f"é only {i}"), (f"lone {i}", None)]
        spark.createDataFrame(rows, resumable.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


WANTED = sorted(x for i in range(3) for x in (f"article {i}\n\nabstract", f"é only {i}", f"lone {i}"))


def blocks_of(target):
    out = []
    for path in target.glob("block=*/part-*.txt"):
        out += [x for x in path.read_text().split("\n\n") if x]
    return sorted(out)


def split_blocks():
    return sorted(y for x in WANTED for y in x.split("\n\n"))


def run(spark, source, target, **revision):
    return resumable.append_text(spark, source, str(target), revision=PAPERS | revision)


def test_blocks_and_sums(spark, source, tmp_path):
    out = run(spark, source, tmp_path / "out")
    assert blocks_of(tmp_path / "out") == split_blocks()
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("block=*/part-*.txt"))
    assert out == {"source_rows_scanned": 12, "rows_written": 9, "byte_offset": size, "blocks": 3, "complete": True}


def test_a_finished_target_is_left_alone(spark, source, tmp_path):
    target = tmp_path / "out"
    first = run(spark, source, target)
    times = {p: p.stat().st_mtime_ns for p in target.rglob("*.txt")}
    assert run(spark, source, target) == first and {p: p.stat().st_mtime_ns for p in target.rglob("*.txt")} == times


def test_killed_between_write_and_commit(spark, source, tmp_path, monkeypatch):
    target, write = tmp_path / "out", resumable.Log.write

    def dies(self, name, value):
        if name == "00000001":
            raise RuntimeError("killed")
        write(self, name, value)

    with monkeypatch.context() as m:
        m.setattr(resumable.Log, "write", dies)
        with pytest.raises(Exception, match="killed"):
            run(spark, source, target)
    assert (target / "block=00000001").exists() and not (target / "_log/00000001.json").exists()
    (target / "block=00000002").mkdir()
    (target / "block=00000002/part-lost.txt").write_text("not committed\n\n")
    kept = {p: p.stat().st_mtime_ns for p in target.glob("block=00000000/*.txt")}
    out = run(spark, source, target)
    assert (out["rows_written"], out["source_rows_scanned"]) == (9, 12) and blocks_of(target) == split_blocks()
    assert {p: p.stat().st_mtime_ns for p in target.glob("block=00000000/*.txt")} == kept  # the committed block was not written again


@pytest.mark.parametrize("damage", ["entry", "lost", "complete", "block"])
def test_a_damaged_log_starts_over(spark, source, tmp_path, damage):
    target = tmp_path / "out"
    run(spark, source, target)
    if damage == "entry":
        (target / "_log/00000001.json").write_text("{half")
    elif damage == "lost":
        (target / "_log/00000002.json").unlink()
    elif damage == "block":
        for p in (target / "block=00000001").iterdir():
            p.unlink()
        (target / "block=00000001").rmdir()
    else:
        (target / "_log/complete.json").write_text("")
    for crc in (target / "_log").glob(".*.crc"):
        crc.unlink()
    before = {p.name for p in target.glob("block=00000000/*.txt")}
    assert run(spark, source, target)["rows_written"] == 9 and blocks_of(target) == split_blocks()
    assert {p.name for p in target.glob("block=00000000/*.txt")} != before


def test_another_revision_starts_over(spark, source, tmp_path):
    target = tmp_path / "out"
    run(spark, source, target)
    before = {p.name for p in target.rglob("part-*.txt")}
    assert run(spark, source, target, revision="r2")["blocks"] == 3 and blocks_of(target) == split_blocks()
    assert not before & {p.name for p in target.rglob("part-*.txt")}


def test_progress_over_three_batches(spark, source, tmp_path):
    size, rows = resumable.input_size(spark, source)
    seen = resumable.Progress(size, rows)
    assert seen.snapshot()["progress_fraction"] == 0 and seen.seconds_left() is None and rows == 12
    resumable.append_text(spark, source, str(tmp_path / "out"), revision=PAPERS, listener=seen)
    told = seen.snapshot()
    assert (seen.batches, seen.rows) == (3, 12)
    assert told == {"bytes_read": size, "total_bytes": size, "data_consumed_mb": size / 2**20, "data_remaining_mb": 0.0, "progress_fraction": 1.0, "tokens_yielded": 0, "sequences_yielded": 0}
    assert seen.seconds_left() == 0
    half = resumable.Progress(1000, 8)
    half.rows = 2
    assert half.snapshot()["bytes_read"] == 250 and half.seconds_left() > 0
    half.rows = 99
    assert half.snapshot()["progress_fraction"] == 1.0
