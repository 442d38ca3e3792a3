import pytest
from pyspark.sql import functions as F

from tallyweave.operators import listings
from tallyweave.sources import page_index


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of all rows in one listing, with gaps and one far outlier among the ids."""
    rows = [(k * k % 10_007 + 10_007 * (k // 7), 1, 1) for k in range(6_000)] + [(10**15, 1, 1)]
    rows += [(-5 - k, 1, 2) for k in range(40)] + [(5_000_000_000 + k, 2, 1) for k in range(2_500)]
    return spark.createDataFrame(sorted(set(rows)), "image_id long, dataset_id int, label_id int").repartition(5)


def listing(df, dataset, label):
    return sorted(r.image_id for r in df.filter(f"dataset_id = {dataset} and label_id = {label}").collect())


def test_index_counts_every_row_once(skewed):
    index = listings.listing_index(skewed, range_rows=300).collect()
    for dataset, label in ((1, 1), (1, 2), (2, 1)):
        ids, before = listing(skewed, dataset, label), 0
        for r in sorted((r for r in index if (r.dataset_id, r.label_id) == (dataset, label)), key=lambda r: r.before):
            assert r.before == before and r.total == len(ids)
            assert [x for x in ids if r.low <= x <= r.high] == ids[before : before + r.rows]
            before += r.rows
        assert before == len(ids)
    assert max(r.rows for r in index) < 700


@pytest.mark.parametrize("page", [1, 2, 17, 60, 61, 400])
def test_pages_of_all_listings(skewed, page):
    index = listings.listing_index(skewed, range_rows=300)
    got = listings.paginate_all(skewed, page, 100, index).collect()
    for dataset, label in ((1, 1), (1, 2), (2, 1)):
        ids = listing(skewed, dataset, label)
        part = sorted((r for r in got if (r.dataset_id, r.label_id) == (dataset, label)), key=lambda r: r.position)
        assert [r.image_id for r in part] == ids[100 * (page - 1) : 100 * page]
        assert all(r.total == len(ids) and r.has_next == (len(ids) > 100 * page) for r in part)


@pytest.mark.parametrize("page", [1, 30, 61, 62])
def test_one_listing(spark, skewed, page, tmp_path):
    one = skewed.filter("dataset_id = 1 and label_id = 1")
    page_index.write_index(page_index.build_index(one, "image_id", range_rows=200), str(tmp_path / "index"))
    index = page_index.read_index(spark, str(tmp_path / "index"))
    got = [r.image_id for r in listings.paginate(one, page, 100, index).collect()]
    assert got == listing(skewed, 1, 1)[100 * (page - 1) : 100 * page]


def test_a_deep_page_scans_one_range(spark, skewed, tmp_path):
    path = str(tmp_path / "images")
    skewed.filter("dataset_id = 2").write.parquet(path)
    one = spark.read.parquet(path)
    index = page_index.build_index(one, "image_id", range_rows=100)
    plan = listings.paginate(one, 20, 50, index)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(image_id" in plan and "LessThanOrEqual(image_id" in plan and "Window" not in plan


def test_odd_listings(spark, skewed):
    none = skewed.limit(0)
    assert listings.paginate(none, 1).collect() == [] and listings.paginate_all(none, 1).collect() == []
    loose = skewed.filter("label_id = 2").withColumn("dataset_id", F.lit(None).cast("int"))
    assert listings.paginate_all(loose, 1).collect() == []
