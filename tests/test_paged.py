"""The paged source: pruning, early ends, retries and failures."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from fathomflow.sources import paged

SCHEMA = "collection string, at timestamp, id long, title string"


class Flaky(paged.FolderClient):
    """Every page fails once, and those of collection ``broken`` always. Pages asked for are noted in a file beside the folder."""

    def __init__(self, location):
        super().__init__(location)
        self.failed, self.log = set(), location.removeprefix("file://") + ".log"

    def page(self, collection, number):
        if collection == "broken" or (collection, number) not in self.failed:
            self.failed.add((collection, number))
            raise OSError("no answer")
        with open(self.log, "a") as log:
            log.write(f"{collection} {number}\n")
        return super().page(collection, number)


@pytest.fixture
def service(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(c, start + datetime.timedelta(days=i), i, f"{c} {i}" if i % 5 else None) for c, n in (("a", 100), ("b", 30), ("broken", 3)) for i in range(n)]
    paged.serve(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/service", page_rows=10)
    return f"file://{tmp_path}/service", rows


def asked(location):
    with open(location.removeprefix("file://") + ".log") as log:
        return sorted(log.read().split("\n")[:-1])


def test_whole_collections(spark, service):
    location, rows = service
    found = paged.read_paged(spark, location, SCHEMA, pages="4")
    assert sorted((r.collection, r.id, r.title) for r in found.collect()) == sorted((c, i, t) for c, _, i, t in rows)
    assert found.rdd.getNumPartitions() >= 5
    assert {(r.id, r.at.astimezone(datetime.UTC)) for r in found.where("collection = 'b'").collect()} == {(i, at) for c, at, i, _ in rows if c == "b"}


def test_filters_prune_collections_and_end_the_paging(spark, service):
    location, rows = service
    found = paged.read_paged(spark, location, SCHEMA, client="tests.test_paged:Flaky", pause="0")
    recent = found.where(F.col("collection").isin("a", "zzz") & (F.col("at") >= F.lit("2024-03-31").cast("timestamp")) & (F.col("id") % 2 == 0))
    assert sorted(r.id for r in recent.collect()) == [i for c, at, i, _ in rows if c == "a" and i >= 90 and i % 2 == 0]
    assert 1 <= len(asked(location)) <= 3 and all(x.startswith("a ") for x in asked(location))  # of ten pages


def test_a_page_that_never_comes_fails(spark, service):
    found = paged.read_paged(spark, service[0], SCHEMA, client="tests.test_paged:Flaky", pause="0")
    assert found.where("collection = 'b'").count() == 30
    with pytest.raises(Exception, match="no answer"):
        found.where("collection = 'broken'").collect()
