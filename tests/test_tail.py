"""The tail of a log: appended, partial, truncated, rotated, restarted."""

import os

import pytest

from hitscope.sources import tail

LINE = '1.2.3.4 - - [10/Jun/2024:12:30:0{} +0000] "GET /{} HTTP/1.1" 200 1'


class Reader:
    """A reader asked as a stream asks it: from each end on."""

    def __init__(self, path, start="end", at=None):
        self.reader = tail.TailReader({"path": str(path), "start": start})
        self.at = at or self.reader.initialOffset()

    def new(self):
        end = self.reader.latestOffset()
        got = [x for p in self.reader.partitions(self.at, end) for batch in self.reader.read(p) for x in batch.column(0).to_pylist()]
        self.at = end
        return got


def append(path, text):
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "access.log"
    append(path, "old\n")
    return path


def test_appended_lines_from_the_end_on(log):
    r = Reader(log)
    assert r.new() == []
    append(log, "a\nb\r\n")
    assert r.new() == ["a", "b"]
    append(log, "c\n")
    assert r.new() == ["c"] and r.new() == []


def test_other_starts(log):
    append(log, "x\n")
    assert Reader(log, "begin").new() == ["old", "x"]
    assert Reader(log, "4").new() == ["x"]


def test_a_partial_line_waits(log):
    r = Reader(log)
    append(log, "whole\nhal")
    assert r.new() == ["whole"] and r.new() == []
    append(log, "f\xc3")
    assert r.new() == []
    append(log, "\n")
    assert r.new() == ["half\xc3"]


def test_start_inside_a_line(tmp_path):
    append(tmp_path / "l", "one\ntw")
    r = Reader(tmp_path / "l")
    append(tmp_path / "l", "o\n")
    assert r.new() == ["two"]


def test_truncation_reads_from_the_beginning(log):
    append(log, "a long line before\n")
    r = Reader(log)
    os.truncate(log, 0)
    append(log, "new\n")
    assert r.new() == ["new"]


def test_rotation_reads_what_was_left_and_the_new_file(log, tmp_path):
    r = Reader(log)
    append(log, "left\n")
    os.rename(log, tmp_path / "access.log.1")
    append(log, "fresh\n")
    assert r.new() == ["left", "fresh"]
    append(log, "more\n")
    assert r.new() == ["more"]


def test_rotation_with_the_old_file_gone(log, tmp_path):
    r = Reader(log)
    append(log, "left\n")
    append(tmp_path / "next", "a fresh and longer line than before\n")
    os.replace(tmp_path / "next", log)
    assert r.new() == ["a fresh and longer line than before"]


def test_a_missing_file_is_read_whole_when_it_comes(tmp_path):
    r = Reader(tmp_path / "later.log")
    assert r.new() == []
    append(tmp_path / "later.log", "first\n")
    assert r.new() == ["first"]
    os.remove(tmp_path / "later.log")
    assert r.new() == []
    append(tmp_path / "later.log", "again\n")
    assert r.new() == ["again"]


def test_a_restart_goes_on(log):
    r = Reader(log)
    append(log, "a\n")
    assert r.new() == ["a"]
    append(log, "b\n")
    assert Reader(log, at=r.at).new() == ["b"]


def test_long_ranges_are_split_between_lines(log, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT", 7)
    monkeypatch.setattr(tail, "BLOCK", 3)
    r = Reader(log)
    lines = ["x" * k for k in (0, 1, 30, 6, 7, 8, 0, 0, 2)]
    append(log, "\n".join(lines) + "\n")
    assert len(r.reader.partitions(r.at, r.reader.latestOffset())) > 5
    assert r.new() == lines


def test_several_files(tmp_path):
    r = Reader(tmp_path / "*.log")
    append(tmp_path / "a.log", "1\n")
    append(tmp_path / "b.log", "2\n")
    assert r.new() == ["1", "2"]


def test_stream_of_events(spark, tmp_path):
    log = tmp_path / "access.log"
    append(log, LINE.format(0, "before") + "\n")
    out = []
    stream = tail.read_tail(spark, str(log), "apache", "s")
    start = lambda: stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: out.extend(r["path"] for r in df.collect())).start()
    query = start()
    try:
        query.processAllAvailable()
        append(log, LINE.format(1, "a") + "\nnot a line\n" + LINE.format(2, "b"))
        query.processAllAvailable()
        assert out == ["/a"]
        query.stop()
        append(log, "\n" + LINE.format(3, "c") + "\n")
        query = start()
        query.processAllAvailable()
        assert out == ["/a", "/b", "/c"]
    finally:
        query.stop()
