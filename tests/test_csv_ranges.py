import random

import pytest
from pyspark.sql import functions as F

from vecbench.sources.csvranges import read_csv_ranges
from vecbench.sources.files import load_dataset, read_csv_text, read_items


def _rows(n, seed=3):
    rnd = random.Random(seed)
    cell = lambda: "".join(rnd.choice(["a", "é", '"', ",", "\n", "x\ny", " ", "", '""', "\r\n"]) for _ in range(rnd.randint(0, 30)))
    rows = [(f"id{k}", cell(), cell(), f'{{"n": "{k}"}}') for k in range(n)]
    rows[n // 2] = ("long", "line\n" * 3000 + '"quoted"', "", "{}")  # one cell over several ranges
    return rows


def _csv(cells):
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n\r') or c != c.strip() else c for c in cells)


def _write(path, rows, header="id,text,image_path,metadata", end="\n", last=True):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(end.join([header, *map(_csv, rows)]) + (end if last else ""))


def _sorted(df):
    columns = sorted(c for c in df.columns if c != "_path")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_is_read_by_many_tasks(spark, scratch, small_ranges):
    rows = _rows(400)
    _write(f"{scratch}/a.csv", rows)
    got = read_csv_ranges(spark, f"{scratch}/a.csv")
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    assert _sorted(got) == _sorted(read_csv_text(spark, f"{scratch}/a.csv"))
    assert sorted(r.text or "" for r in got.select("text").collect()) == sorted(r[1] for r in rows)


def test_several_files_with_other_columns(spark, scratch, small_ranges):
    one, two = _rows(60, 1), _rows(80, 2)
    _write(f"{scratch}/a.csv", one, last=False)
    _write(f"{scratch}/b.csv", [(m, i, t, p, "7") for i, t, p, m in two], header="metadata,id,text,image_path,more", end="\r\n")
    _write(f"{scratch}/c.csv", [], header="id,text,image_path,metadata")
    got = read_csv_ranges(spark, [f"{scratch}/{n}.csv" for n in "abc"])
    assert sorted((r.id, r.text or "", r.image_path or "", r.metadata) for r in got.collect()) == sorted(one + two)
    assert got.filter("more = '7'").count() == 80 and set(got.columns) == {"id", "text", "image_path", "metadata", "more", "_path"}


def test_rows_that_look_like_the_header_and_blank_lines(spark, scratch):
    with open(f"{scratch}/a.csv", "w") as f:
        f.write('﻿id,text,image_path,metadata\n\nid,text,image_path,metadata\n1,a,b,{}\n\n2,"c\n\nd",,\n')
    got = sorted((r.id, r.text, r.image_path) for r in read_csv_ranges(spark, f"{scratch}/a.csv").collect())
    assert got == sorted([("id", "text", "image_path"), ("1", "a", "b"), ("2", "c\n\nd", None)])


def test_an_open_quote_at_the_end_is_a_record(spark, scratch):
    with open(f"{scratch}/a.csv", "w") as f:
        f.write('id,text,image_path,metadata\n1,a,b,{}\n2,"open\nend')
    assert {r.id for r in read_csv_ranges(spark, f"{scratch}/a.csv").collect()} == {"1", "2"}


def test_a_header_of_several_lines_or_none_is_refused(spark, scratch):
    for name, text in (("a", 'id,"te\nxt"\n1,2\n'), ("b", "")):
        with open(f"{scratch}/{name}.csv", "w") as f:
            f.write(text)
        with pytest.raises(ValueError, match="header"):
            read_csv_ranges(spark, f"{scratch}/{name}.csv")


def test_items_by_either_reader(spark, scratch, small_ranges):
    import os
    for side in ("catalog", "test"):
        os.makedirs(f"{scratch}/d/{side}")
        _write(f"{scratch}/d/{side}/x.csv", _rows(50))
    keep = ["dataset", "id", "text", "image_path", "metadata"]
    for one, two in zip(load_dataset(spark, scratch, "d"), load_dataset(spark, scratch, "d", split_files=False), strict=True):
        assert _sorted(one.select(*keep)) == _sorted(two.select(*keep))
        assert one.select("row_id").distinct().count() == 50 and {r.dataset for r in one.select("dataset").collect()} == {"d"}
    plain = [(f"p{k}", "t", "i", "{}") for k in range(300)]
    _write(f"{scratch}/plain.csv", plain)
    assert _sorted(read_items(spark, f"{scratch}/plain.csv", multi_line=False).select("id")) == _sorted(read_items(spark, f"{scratch}/plain.csv").select("id"))
