"""Zip archives: entries, bounded blocks, round trips and errors."""

import io
import os
import zipfile

import pytest

from tests.conftest import SF_SMALL
from tillcast import schemas
from tillcast.sources import archives as A
from tillcast.sources import files as IO
from tillcast.sources import fixtures as FX

HEADER = b"time|itemID|order|salesPrice\n"


def _zip(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return str(path)


def test_round_trip_of_orders(spark, tmp_dir):
    txn = FX.transactions(spark, SF_SMALL).repartition(3)
    paths = A.write_zip(txn, os.path.join(tmp_dir, "orders"))
    back = IO.read_orders(spark, paths)
    assert len(paths) == 3 and back.schema == schemas.ORDERS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, txn.collect()))


def test_entries_columns_and_missing_values(spark, tmp_path):
    path = _zip(tmp_path / "a.ZIP", {
        "one.csv": HEADER + b"2018-01-01 00:01:56|450|1|17.42\r\n2018-01-01 00:02:56.250000|83||\n",
        "sub/two.csv": b"itemID|time|salesPrice|order\n7|2018-01-02 10:00:00|3|2",  # another order, no last line break
        "sub/empty.csv": HEADER, "nothing.csv": b"", "dir/": b""})
    rows = sorted((str(r["time"]), r["itemID"], r["order"], r["salesPrice"]) for r in IO.read_orders(spark, path).collect())
    assert rows == [("2018-01-01 00:01:56", 450, 1, 17.42), ("2018-01-01 00:02:56.250000", 83, None, None), ("2018-01-02 10:00:00", 7, 2, 3.0)]
    assert A.read_zip(spark, path, schemas.ORDERS, pattern="^sub/").count() == 1
    assert A.read_zip(spark, path, schemas.ORDERS, pattern="^no such").count() == 0
    uri = IO.read_orders(spark, [f"file://{path}", path])  # twice, and by a path with a scheme
    assert uri.count() == 6


def test_items_with_text_and_plain_files_beside_archives(spark, tmp_path):
    header = "itemID|brand|manufacturer|customerRating|category1|category2|category3|recommendedRetailPrice\n"
    path = _zip(tmp_path / "items.zip", {"items.csv": header + '1|"a|b"|m|4.5|é|2||9.99\n2|x||0|c|2|3|1\n'})
    plain = tmp_path / "items.csv"
    plain.write_text(header + "3|y|m|1|c|2|3|5\n")
    rows = {r["itemID"]: r for r in IO.read_items(spark, [path, str(plain)]).collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1]["brand"] == "a|b" and rows[1]["category1"] == "é"
    assert rows[1]["category3"] is None and rows[2]["manufacturer"] is None


def test_one_task_an_entry(spark, tmp_path):
    path = _zip(tmp_path / "many.zip", {f"e{k}.csv": HEADER + b"2018-01-01 00:00:00|%d|1|1\n" % k * (k + 1) for k in range(6)})
    assert IO.read_orders(spark, path).rdd.glom().map(len).collect() == [6, 5, 4, 3, 2, 1]


def test_an_entry_larger_than_a_tasks_share_of_the_heap(spark, tmp_path):
    line, many = b"2018-01-01 00:01:56.000000|123456789|3|12345.67\n", 5_000_000  # 240 MB inflated
    path = str(tmp_path / "large.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("orders.csv", "w", force_zip64=True) as f:
        f.write(HEADER)
        for _ in range(500):
            f.write(line * (many // 500))
    heap = spark.sparkContext._jvm.Runtime.getRuntime().maxMemory() / spark.sparkContext.defaultParallelism
    assert len(line) * many > heap
    found = IO.read_orders(spark, path).selectExpr("count(*)", "sum(order)", "min(itemID)", "max(salesPrice)").first()
    assert tuple(found) == (many, 3 * many, 123456789, 12345.67)


def test_blocks_are_bounded_whole_lines():
    class Stream(io.BytesIO):
        most = 0

        def read(self, size=-1):
            assert size == 64
            return super().read(size)

    data = b"".join(b"x" * (k % 40) + b"\n" for k in range(500)) + b"tail"
    parts = list(A.blocks(Stream(data), 64))
    assert b"".join(parts) == data and all(p.endswith(b"\n") for p in parts[:-1]) and max(map(len, parts)) <= 64 + 40


@pytest.mark.parametrize("data", [b"time|itemID\n", HEADER + b"2018-01-01 00:00:00|x|1|1\n", HEADER + b"2018-01-01 00:00:00|1|1\n"])
def test_wrong_columns_and_values_are_errors(spark, tmp_path, data):
    with pytest.raises(Exception):
        IO.read_orders(spark, _zip(tmp_path / "bad.zip", {"a.csv": data})).collect()


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    path = _zip(tmp_path / "cut.zip", {"a.csv": HEADER + b"2018-01-01 00:00:00|1|1|1\n" * 1000})
    whole = open(path, "rb").read()
    damaged = bytearray(whole)
    damaged[60] ^= 0xFF
    for name, raw in (("short", whole[:-30]), ("flipped", bytes(damaged))):
        bad = tmp_path / f"{name}.zip"
        bad.write_bytes(raw)
        with pytest.raises(Exception):
            IO.read_orders(spark, str(bad)).collect()
