"""Folders whose files change, come and go between scans."""

import os
from types import SimpleNamespace

import pytest

from lokalis.streaming import watch

SCHEMA = "k long, v string"


@pytest.fixture
def scan(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "below")

    def run() -> tuple[list, list]:
        table, changes = watch.scanned(spark, str(tmp_path / "in"), str(tmp_path / "at"), SCHEMA)
        return sorted(((r.k, r.v or "") for r in table.collect())), sorted((r.op, r.k, r.v or "") for r in changes.collect())

    def put(name: str, text: str | None, time: int) -> None:
        path = tmp_path / "in" / name
        if text is None:
            os.remove(path)
        else:
            path.write_text(text)
            os.utime(path, (time, time))

    return SimpleNamespace(now=run, put=put)


def test_scans_follow_the_files(scan):
    assert scan.now() == ([], [])
    scan.put("a.csv", "k,v\n1,x\n2,y\n", 1000)
    scan.put("below/b c.csv", "k,v\n3,\n3,\n", 1000)
    table, changes = scan.now()
    assert len(table) == 4 and [c[0] for c in changes] == ["+"] * 4
    assert scan.now() == (table, [])
    scan.put("a.csv", "k,v\n1,z\n2,y\n", 2000)  # the same name and size at another time
    table, changes = scan.now()
    assert changes == [("+", 1, "z"), ("+", 2, "y"), ("-", 1, "x"), ("-", 2, "y")]
    scan.put("below/b c.csv", None, 0)
    table, changes = scan.now()
    assert table == [(1, "z"), (2, "y")] and [c[:2] for c in changes] == [("-", 3), ("-", 3)]


def test_a_scan_that_was_cut_short_is_done_again(scan, tmp_path):
    scan.put("a.csv", "k,v\n1,x\n", 1000)
    first = scan.now()
    os.remove(tmp_path / "at" / "scan-1" / "_SUCCESS")
    assert scan.now() == first and first[1] == [("+", 1, "x")]
