"""Chunked windows give what plain windows give, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from netlens.ordered import Lag, Lead, Ordered, RowNumber, Running, group_sizes

SPECS = dict(prev=Lag("v"), nxt=Lead("v"), rn=RowNumber(), total=Running("sum", "v"), before=Running("sum", "v", inclusive=False),
             lo=Running("min", "v"), hi=Running("max", "v", inclusive=False), n=Running("count", "v", inclusive=False),
             seen=Running("set", "tag"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c"])
        data.append((key, rng.randrange(200), i, None if rng.random() < 0.1 else rng.randrange(50), rng.choice("xyz")))
    return spark.createDataFrame(data, "k string, t int, id int, v int, tag string").repartition(5)


def collected(ordered):
    df = ordered.result().withColumn("seen", F.array_sort("seen"))
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("keys", [["k"], []])
def test_chunked_equals_plain(rows, keys):
    plain = Ordered(rows, keys, ["t", "id"], max_group=10_000).add(**SPECS)
    chunked = Ordered(rows, keys, ["t", "id"], max_group=50, chunk_rows=60).add(**SPECS)
    assert not plain.chunked and chunked.chunked
    assert collected(plain) == collected(chunked)


def test_two_passes_and_filter(rows):
    def run(limit):
        seq = Ordered(rows, ["k"], ["t", "id"], max_group=limit).add(prev=Lag("t"))
        seq = seq.with_columns({"jump": F.coalesce(F.col("t") - F.col("prev") > 1, F.lit(True)).cast("int")}).add(part=Running("sum", "jump"))
        return sorted(map(tuple, seq.where("part % 2 = 1").add(rn=RowNumber()).result().select("id", "part", "rn").collect()))
    assert run(10_000) == run(40)


def test_group_sizes(rows):
    largest, total = group_sizes(rows, ["k"])
    assert total == 900 and 350 < largest < 600
