"""Quoted CSV files by byte ranges: the same rows at any split size, and as Spark's one-task reader."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkstone.sources import csv_split as CS
from inkstone.sources import io as IO


def put(spark, data: bytes, name: str = "a.csv") -> str:
    root = IO.scratch_path(spark, "t-split").removeprefix("file:")
    Path(root).mkdir(parents=True)
    (Path(root) / name).write_bytes(data)
    return root


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed: int, newline: str) -> str:
    rnd = random.Random(seed)
    parts = ['""', "\n", ",", "é", "日本", "x", " ", "\r\n", "'", "<svg>", "None", "NA"]
    quoted = lambda: '"' + "".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) + '"'
    plain = lambda: rnd.choice(["", "a", "NA", "b c", "ü", "1.5", "null"])
    field = lambda: quoted() if rnd.random() < 0.6 else plain()
    return newline.join(["id,prompt,svg"] + [f"{i},{field()},{field()}" for i in range(40)]) + rnd.choice(["", newline])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_same_rows_as_one_task_at_any_split(spark, newline):
    for seed in (1, 2):
        data = corpus(seed, newline).encode()
        path = put(spark, data)
        # the one-task reader turns line ends inside quotes into those of the rows' ends; ours keeps them
        feeds = lambda rows: sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in rows), key=repr)
        whole = rows_of(IO.read_pairs(spark, path))
        assert len(whole) == 40
        found = rows_of(CS.read_pairs_split(spark, path, split_bytes=7))
        assert feeds(found) == feeds(whole) if newline == "\r\n" else found == whole
        for size in (64, len(data) - 1, CS.SPLIT_BYTES):
            assert rows_of(CS.read_pairs_split(spark, path, split_bytes=size)) == found


def test_ranges_hold_each_record_once(spark):
    """All cuts of one file, without Spark: the records of the ranges are those of the whole."""
    data = corpus(3, "\n").encode()
    path = put(spark, data) + "/a.csv"
    whole = list(CS.own_records(path, 0, len(data), 0))
    for size in range(1, 60):
        found = []
        for start in range(0, len(data), size):
            found += CS.own_records(path, start, min(len(data), start + size), data[:start].count(b'"') % 2)
        assert found == whole


def test_bad_rows_go_to_quarantine(spark):
    lines = ["id,prompt,svg", "1,a,b", "2,only", '3,"x"y,z', "", "4,a,b,more", '5,"two\nlines",""', ",no id,s"]
    path, out = put(spark, "\n".join(lines).encode()), IO.scratch_path(spark, "t-ingest")
    good, bad, n = CS.pairs_to_parquet(spark, path, out, split_bytes=11)
    assert rows_of(good) == sorted([("1", "a", "b"), ("5", "two\nlines", None), (None, "no id", "s")], key=repr)
    assert n == 3 and rows_of(bad) == sorted([("2", "only", None, "2,only"), (None, None, None, '3,"x"y,z'),
                                             ("4", "a", "b", "4,a,b,more")], key=repr)


def test_files_without_certain_records(spark):
    with pytest.raises(ValueError, match="ends inside quotes"):
        CS.read_pairs_split(spark, put(spark, b'id,prompt,svg\n1,"a,b\n2,c,d\n'))
    with pytest.raises(ValueError, match="compressed"):
        CS.read_pairs_split(spark, put(spark, b"x", "a.csv.gz"))


def test_empty_files_headers_and_long_records(spark):
    assert CS.read_pairs_split(spark, put(spark, b"")).count() == 0
    assert CS.read_pairs_split(spark, put(spark, b"id,prompt,svg\n")).count() == 0
    text = "line\n" * 200_000
    out = CS.read_pairs_split(spark, put(spark, f'id,prompt,svg\n1,"{text}",s\n2,p,q'.encode()), split_bytes=50_000)
    assert rows_of(out.select("id", F.length("prompt"), "svg")) == [("1", 1_000_000, "s"), ("2", 1, "q")]


def test_one_file_is_read_by_many_tasks(spark):
    data = corpus(4, "\n").encode()
    out = CS.read_pairs_split(spark, put(spark, data), split_bytes=20)
    assert out.rdd.getNumPartitions() == -(-len(data) // 20) > 20
