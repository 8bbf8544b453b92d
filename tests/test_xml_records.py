"""Records of split files against two parsers that read a file as a whole: Spark's XML reader and ElementTree."""

import random
from xml.etree import ElementTree

import pytest

from termloom.sources import pages, xml_records

PAGE = "<page><title>{0}</title><ns>0</ns><revision><text a='1'>{1}</text></revision></page>"
A, B, C = PAGE.format("A", "x"), PAGE.format("B", "y"), PAGE.format("C", "z")
PARTS = {
    "comment": f"<!-- {A} -->" + B,
    "cdata inside": PAGE.format("A", "<![CDATA[a </page> b <page> c]]>") + B,
    "cdata outside": f"<![CDATA[{A}]]>" + B,
    "instruction": f"<?x {A} ?>" + B,
    "nested": "<page><title>A</title><page><title>N</title></page><ns>0</ns><revision><text a='1'>q</text></revision></page>" + C,
    "empty": "<page/>" + A + "<page  id='a/>b' />",
    "closing with space": A.replace("</page>", "</page >") + B.replace("</page>", "</page\n>"),
    "attributes": B.replace("<page>", "<page\n id='a>b' n='2'>"),
    "other tags": A.replace("page>", "pagex>") + B + C.replace("page>", "xpage>"),
    "comment inside": PAGE.format("A", "<!-- </page> <page> -->v") + B,
    "mixed": PAGE.format("A", "<![CDATA[ <!-- ]]> x") + PAGE.format("B", "<!-- <![CDATA[ --> y") + C,
    "closings only": PAGE.format("A", "<![CDATA[" + "</page>" * 40 + "]]>") + "<!--" + "</page><page>" * 40 + "-->" + B,
    "entities": PAGE.format("A&amp;&lt;!--", "u&#65;v ]]&gt; --&gt; ?&gt;") + B,
    "plain": A + "\n\n" + B + " " + C,
}


def elements(node):
    """Pages that lie in no other page."""
    for child in node:
        if child.tag == "page":
            yield child
        else:
            yield from elements(child)


def whole(path):
    """The rows of all pages below a folder, by ElementTree."""
    found = []
    for file in path.iterdir():
        for page in elements(ElementTree.parse(file).getroot()):
            ns = page.findtext("ns")
            found.append((page.findtext("title"), None if ns is None else int(ns), None, page.findtext("revision/text")))
    return sorted(found, key=repr)


def rows(df):
    return sorted(((r.title, r.ns, r.redirect, r.raw_text) for r in df.collect()), key=repr)


@pytest.fixture
def split(spark):
    """Sets the size of splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def to(size):
        for name, value in zip(names, (size, 1), strict=True):
            spark.conf.set(name, value)

    yield to
    for name in names:
        spark.conf.unset(name)


def written(folder, bodies):
    for i, body in enumerate(bodies):
        (folder / f"dump {i}.xml").write_text(f"<?xml version='1.0' encoding='UTF-8'?>\n<mediawiki>\n{body}\n</mediawiki>", encoding="utf8")
    return folder


@pytest.fixture(scope="module")
def dumps(tmp_path_factory):
    """A file for each case, one with many of them in random order, and one without odd markup."""
    rng = random.Random(2)
    many = [PARTS[rng.choice(sorted(PARTS))] for _ in range(150)]
    return written(tmp_path_factory.mktemp("dumps"), [*PARTS.values(), "".join(many), "", "\n".join([A, B, C] * 30)])


@pytest.mark.parametrize("size", [1 << 20, 777, 100])
def test_same_rows_as_the_whole_file(spark, dumps, split, size):
    split(size)
    read = pages.read_pages(spark, str(dumps))
    assert rows(read) == whole(dumps)
    assert size == 1 << 20 or read.rdd.getNumPartitions() > 20


def test_same_rows_as_one_task(spark, tmp_path, split):
    folder = written(tmp_path, PARTS.values())
    want = rows(pages.read_pages(spark, str(folder), by_record=False))
    split(200)
    assert want == whole(folder) and rows(pages.read_pages(spark, str(folder))) == want


@pytest.mark.parametrize("odd", [False, True])
def test_same_rows_when_inferred(spark, tmp_path, split, odd):
    """All titles are numbers, and no text has an attribute: inference drops what no page has."""
    page = "<page><title>{0}</title><ns>{1}</ns><revision><text>{2}</text></revision></page>"
    body = "".join(page.format(f"{i:03}", "0" if i % 3 else "7.5", f"{i}e1") for i in range(50))
    path = tmp_path / "d.xml"
    path.write_text(f"<m>{PARTS['comment'] if odd else ''}{body}</m>", encoding="utf8")
    want = rows(pages.read_pages_inferred(spark, str(path), by_record=False))
    split(500)
    assert rows(pages.read_pages_inferred(spark, str(path))) == want


def test_many_odd_files_go_one_way(spark, dumps, monkeypatch):
    monkeypatch.setattr(xml_records, "NAMED_FILES", 1)
    assert rows(pages.read_pages(spark, str(dumps))) == whole(dumps)


def test_plain_files_stay_in_the_jvm(spark, tmp_path):
    path = tmp_path / "plain.xml"
    path.write_text(f"<m>{A}{B}{C}</m>", encoding="utf8")
    found = xml_records.records(spark, str(path), "page")
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.value for r in found.collect()) == [A, B, C]


def test_changes_compose_like_one_scan():
    """Whatever the cuts, the state after a file is that of the whole text."""
    markup, rng = xml_records.Markup("page"), random.Random(4)
    for _ in range(200):
        text = "".join(PARTS[rng.choice(sorted(PARTS))] for _ in range(3))
        chunks = text.split("</page>")
        state, depth = xml_records.TEXT, 0
        for chunk in chunks[:-1]:
            state, change = markup.change(chunk + "</page>", state)
            depth += change
        assert (state, depth) == (xml_records.TEXT, 0)
        assert markup.change(text, xml_records.TEXT) == (xml_records.TEXT, 0)
