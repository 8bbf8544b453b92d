import pytest
from pyspark.sql import functions as F

from termloom.operators import articles
from termloom.sources import artifacts, pages

PAGE = "<page><title>{title}</title><ns>{ns}</ns>{redirect}<revision><text{attr}>{text}</text></revision></page>"
ROWS = [
    ("Alpha", "0", "", ' bytes="9"', "alpha [[a|b]] text"),
    ("NoAttr", "0", "", "", "plain text"),
    ("Redir", "0", '<redirect title="Alpha"/>', "", "#REDIRECT"),
    ("EmptyRedir", "0", "<redirect/>", "", "x"),
    ("Talk:A", "1", "", "", "talk"),
    ("B (Disambiguation)", "0", "", "", "dis"),
    ("Empty", "0", "", "", ""),
    ("BadNs", "zz", "", "", "q"),
]


@pytest.fixture
def dump(tmp_path):
    def write(rows):
        body = "\n".join(PAGE.format(title=t, ns=n, redirect=r, attr=a, text=x) for t, n, r, a, x in rows)
        path = tmp_path / "dump.xml"
        path.write_text(f"<mediawiki>\n{body}\n</mediawiki>", encoding="utf8")
        return str(path)

    return write


@pytest.mark.parametrize("by_record", [False, True])
def test_read_pages(spark, dump, by_record):
    read = pages.read_pages(spark, dump(ROWS), by_record=by_record)
    found = {r.title: r for r in read.collect()}
    assert len(found) == 8
    assert found["Alpha"].raw_text == "alpha [[a|b]] text"
    assert found["NoAttr"].raw_text == "plain text"
    assert found["Redir"].redirect._title == "Alpha"
    assert found["EmptyRedir"].redirect is not None
    assert found["Alpha"].redirect is None
    assert not found["Empty"].raw_text
    assert found["BadNs"].ns is None
    kept = articles.article_text(articles.articles(read))
    assert {tuple(r) for r in kept.collect()} == {("Alpha", "alpha b text"), ("NoAttr", "plain text")}


@pytest.mark.parametrize("by_record", [False, True])
def test_read_pages_inferred(spark, dump, by_record):
    rows = pages.read_pages_inferred(spark, dump(ROWS), by_record=by_record)
    kept = articles.article_text(articles.articles(rows))
    assert {r.title for r in kept.collect()} == {"Alpha", "NoAttr"}


def test_inferred_without_redirects_or_attributes(spark, dump):
    rows = pages.read_pages_inferred(spark, dump([ROWS[1], ROWS[4]]))
    assert {(r.title, r.ns, r.redirect, r.raw_text) for r in rows.collect()} == {
        ("NoAttr", 0, None, "plain text"), ("Talk:A", 1, None, "talk"),
    }


def test_null_title_is_no_article(spark):
    rows = spark.createDataFrame(
        [(None, 0, None, "x"), ("T", 0, None, "x")], "title string, ns int, redirect struct<_title:string>, raw_text string"
    )
    assert [r.title for r in articles.articles(rows).collect()] == ["T"]


def test_text_left_empty_is_dropped(spark):
    rows = spark.createDataFrame([("a", "{{only}}"), ("b", " x "), ("c", None)], "title string, raw_text string")
    assert [tuple(r) for r in articles.article_text(rows).collect()] == [("b", "x")]


def test_cap_by_key_is_exact_and_stable(spark):
    rows = spark.range(1000).repartition(7)
    assert sorted(r.id for r in articles.cap_rows(rows, 10, "id").collect()) == list(range(10))
    assert articles.cap_rows(rows, 10).count() == 10
    assert articles.cap_rows(rows, 0).count() == 1000


def test_key_sample_ignores_partitions(spark):
    rows = spark.range(2000)
    one = {r.id for r in articles.sample_by_key(rows.repartition(1), "id", 0.3).collect()}
    many = {r.id for r in articles.sample_by_key(rows.repartition(9), "id", 0.3).collect()}
    assert one == many and 500 < len(one) < 700
    assert articles.sample_by_key(rows, "id", 1.0).count() == 2000
    assert articles.sample_rows(rows, 1.0).count() == 2000
    assert articles.sample_rows(rows, 0.0).count() == 2000


def test_small_scans_are_spread_and_large_ones_left_alone(spark):
    assert articles.spread_scan(spark.range(10, numPartitions=1), 4).rdd.getNumPartitions() == 4
    assert articles.spread_scan(spark.range(10, numPartitions=6), 4).rdd.getNumPartitions() == 6


def test_records_without_a_key_are_dropped(spark, tmp_path):
    path = tmp_path / "out" / "term_embeddings"
    path.mkdir(parents=True)
    (path / "part-0.json").write_text('{"term":"a","embedding":[1.0,2.0]}\n{"term":"b"}\n{"embedding":[3.0,4.0]}\n')
    records = artifacts.read_artifact(spark, f"{tmp_path}/out/", artifacts.TERMS)
    assert [r.term for r in artifacts.embedding_matrix(records, "term").collect()] == ["a"]


def test_single_file_only_for_small_tables(spark, tmp_path):
    artifacts.write_single_file(spark.range(50, numPartitions=5), f"{tmp_path}/one", max_rows=50)
    assert len(list((tmp_path / "one").glob("part-*.json"))) == 1
    with pytest.raises(ValueError, match="part files"):
        artifacts.write_single_file(spark.range(51), f"{tmp_path}/two", max_rows=50)


def test_parquet_smoke(spark, tmp_path):
    table = artifacts.literal_table(spark, [(1, "a"), (2, "b")], "id bigint, v string")
    artifacts.write_parquet(table, f"{tmp_path}/t")
    assert artifacts.read_parquet(spark, f"{tmp_path}/t").orderBy("id").collect() == table.collect()
    files = artifacts.list_files(spark, f"{tmp_path}/t")
    assert files.filter(F.col("length") > 0).count() >= 1


def test_comments_and_cdata_read_as_xml(spark, dump, tmp_path):
    """Pages in comments are none, and a closing tag in CDATA closes nothing."""
    body = PAGE.format(title="In", ns=0, redirect="", attr="", text="<![CDATA[a </page> b]]>")
    path = tmp_path / "odd.xml"
    path.write_text(f"<mediawiki>\n<!-- {PAGE.format(title='Out', ns=0, redirect='', attr='', text='x')} -->\n{body}\n</mediawiki>", encoding="utf8")
    rows = pages.read_pages(spark, str(path)).collect()
    assert [(r.title, r.raw_text) for r in rows] == [("In", "a </page> b")]


def test_inferred_by_record_uses_several_tasks(spark, dump):
    path = dump(ROWS * 4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 * 1024)
    try:
        rows = pages.read_pages_inferred(spark, path, by_record=True)
        assert rows.rdd.getNumPartitions() > 1
        assert rows.count() == 8 * 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
