"""Readers on hand-written files, writers, pages and targets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import pages
from seriesloom.plans import collection_plan
from seriesloom.sources import readers, writers


def put(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def daily(n, header="date,price(SGD)"):
    rows = [f"{dt.date(2024, 1, 1) + dt.timedelta(days=i)},{100 + i}" for i in range(n)]
    return "\n".join([header, *rows]) + "\n"


def test_series_folder(spark, tmp_path):
    put(tmp_path / "s", "Brand X-Model_A-1.csv", daily(40))
    put(tmp_path / "s", "Swapped-M-2.csv", "x,price(SGD),date\n" + "\n".join(
        f'"q,{i}",{i + 1},{dt.date(2024, 1, 1) + dt.timedelta(days=i)}' for i in range(31)))
    put(tmp_path / "s", "NoPrice-M-3.csv", daily(40, "date,value"))
    put(tmp_path / "s", "Short-M-4.csv", daily(10))
    put(tmp_path / "s", "BadDate-M-5.csv", daily(40) + "someday,3\n")
    put(tmp_path / "s", "Empty-M-6.csv", "")
    put(tmp_path / "s", "Repeats-M-7.csv", daily(20) + daily(20, "2024-01-01,7"))
    df = readers.read_series(spark, str(tmp_path / "s"))
    got = {r["asset_id"]: (r["n"], r["lo"], r["hi"]) for r in df.groupBy("asset_id").agg(
        F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi")).collect()}
    assert got == {"Brand X-Model_A-1": (40, 100.0, 139.0), "Swapped-M-2": (31, 1.0, 31.0)}


def test_positions_follow_the_file_over_splits(spark, tmp_path):
    put(tmp_path / "s", "a.csv", "date,price(SGD)\n" + "".join(f"2024-01-01,{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_series(spark, str(tmp_path / "s"), min_rows=1)
        assert readers.read_lines(spark, str(tmp_path / "s")).rdd.getNumPartitions() > 3
        rows = df.orderBy("position").select("price").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[0] for r in rows] == [float(i) for i in range(20000)]


def test_max_files_takes_the_first_names(spark, tmp_path):
    for name in ("b", "a", "c"):
        put(tmp_path / "s", f"{name}.csv", daily(3))
    df = readers.read_series(spark, str(tmp_path / "s"), min_rows=1, max_files=2)
    assert {r[0] for r in df.select("asset_id").distinct().collect()} == {"a", "b"}


def test_csv_modes(spark, tmp_path):
    put(tmp_path / "c", "x.csv", "a,b\n1,2\nx,3\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "c"), "a INT, b INT").collect()
    rows = readers.read_csv(spark, str(tmp_path / "c"), "a INT, b INT", strict=False).collect()
    assert [tuple(r) for r in rows] == [(1, 2), (None, 3)]
    assert readers.read_csv(spark, str(tmp_path / "none"), "a INT", strict=False).count() == 0
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "none"), "a INT").collect()


def test_json_shapes(spark, tmp_path):
    put(tmp_path / "j", "lines.json", '{"a": 1}\n\nnot json\n{"a": 2}\n')
    put(tmp_path / "j", "array.json", '[\n {\n"a": 3},\n {\n"a": 4}\n]')
    put(tmp_path / "j", "object.json", '{\n"n": 1,\n"rows":\n [{\n"a": 5}\n]}')
    put(tmp_path / "j", "single.json", '{\n"a":\n 6}')
    put(tmp_path / "j", "broken.json", "{\n")
    got = sorted(r[0] for r in readers.read_mixed_json(spark, str(tmp_path / "j"), "a INT").collect())
    assert got == [1, 2, 3, 4, 5, 6]
    assert readers.read_mixed_json(spark, str(tmp_path / "none"), "a INT").count() == 0
    assert sorted(r[0] for r in readers.read_jsonl(spark, str(tmp_path / "j" / "lines.json"), "a INT").collect()) == [1, 2]
    assert readers.read_json(spark, str(tmp_path / "none"), "a INT", strict=False).count() == 0


def test_combined_files_with_different_columns(spark, tmp_path):
    a, b = str(tmp_path / "all" / "x.parquet"), str(tmp_path / "all" / "y.parquet")
    spark.createDataFrame([(1.0,)], "price double").write.parquet(a)
    spark.createDataFrame([(2.0, "named", 9)], "price double, asset_id string, extra int").write.parquet(b)
    df = readers.combine_assets(spark, str(tmp_path / "all" / "*"))
    rows = {r["price"]: (r["asset_id"], r["extra"]) for r in df.collect()}
    assert rows[2.0] == ("named", 9) and rows[1.0][1] is None and rows[1.0][0]


def test_required_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="model_name"):
        readers.load_forecasts(spark, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="asset column"):
        readers.load_features(spark, str(tmp_path / "f"), "unused")


def test_safe_replace_keeps_the_old_table_on_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.safe_replace(spark.range(3), path)
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception):
        writers.safe_replace(bad, path)
    assert spark.read.parquet(path).count() == 3
    writers.safe_replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_quarantine_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", i, -i) for i in range(5)], "f string, i long, t long")
    v, _, _ = collection_plan.check_series(df, "f", "t", "i", 2)
    writers.write_quarantine(df, v, "f", str(tmp_path / "good"), str(tmp_path / "bad"), "s1")
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 5 and bad.count() == 5
    assert {"reason", "moved_at", "session"} <= set(bad.columns)


HTML = """<html><A class="x" HREF='/watch_model/12-brand-sub-one/overview'>1</A>
<a href="https://x.io/watch_model/12-brand-sub-one/overview">same</a> <a href="/watch_model/13-other-two">2</a>
<a href="/watches/brand/extra">3</a><a href="/watches/brand/">4</a><a href="">no</a><a href="sub?q=watches-brand">5</a>
<abbr href="/watch_model/99-brand-x">not a link</abbr></html>"""


def page(spark, html=HTML, url="https://x.io/a/b.html?p=1"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def urls(df):
    return [r["url"] for r in df.orderBy("pos").collect()]


def test_link_strategies(spark):
    one = "https://x.io/watch_model/12-brand-sub-one/overview"
    assert urls(pages.extract(page(spark), F.lit("brand"), 9, [pages.strict()])) == [one]
    broad = ["https://x.io/watches/brand/extra", "https://x.io/watches/brand/", "https://x.io/a/sub?q=watches-brand"]
    assert urls(pages.extract(page(spark), F.lit("brand"), 9, [pages.broad(not_under="/none/")])) == broad
    assert urls(pages.extract(page(spark), F.lit("brand"), 9, pages.default_chain())) == [
        one, "https://x.io/a/sub?q=watches-brand"]
    assert urls(pages.extract(page(spark), F.lit("brand"), 2, [pages.strict(), pages.strict(), pages.broad(not_under="/none/")])) == [
        one, broad[0]]


def test_a_strategy_spends_its_allowance_on_known_links(spark):
    def same_twice(found, fragment):
        return pages.strict()(found, fragment)

    html = '<a href="/watch_model/1-b">1</a><a href="/watch_model/2-b">2</a><a href="/watches/b">w</a>'
    first_only = lambda found, fragment: F.slice(found, 1, 1)
    got = urls(pages.extract(page(spark, html), F.lit("b"), 2, [first_only, same_twice]))
    # One place is left; the second strategy's first link is already known.
    assert got == ["https://x.io/watch_model/1-b"]


def test_challenge_pages(spark):
    rows = [(1, "<title>Just a moment</title>"), (2, "just a moment price chart"), (3, "nothing")]
    df = spark.createDataFrame(rows, "i int, h string").select("i", pages.is_challenge(F.col("h")).alias("c"))
    assert {r["i"]: r["c"] for r in df.collect()} == {1: True, 2: False, 3: False}


def test_discovery_to_targets(spark):
    brands = spark.createDataFrame([("Brand", "https://x.io/watches/brand/")], "brand string, url string")
    got = collection_plan.discover(page(spark), brands, F.lit("Brand"), 5).collect()
    by_url = {r["url"]: r for r in got}
    t = by_url["https://x.io/watch_model/12-brand-sub-one/overview"]
    assert (t["watch_id"], t["model_name"], t["slug"], t["brand"]) == ("12", "Sub One", "brand", "Brand")


def test_usable_targets(spark):
    rows = [
        ("B", "77 - Name", "u", None), ("B", "Name", "https://x/watch_model/88-b-n", ""), ("B", "Name", "u", None),
        (" ", "Name", "u", "1"), ("B ", " Name ", "u", "2"),
    ]
    raw = spark.createDataFrame(rows, "brand string, model_name string, url string, watch_id string")
    got = {r["watch_id"]: (r["brand"], r["model_name"]) for r in collection_plan.usable_targets(raw).collect()}
    assert got == {"77": ("B", "Name"), "88": ("B", "Name"), "2": ("B", "Name")}
