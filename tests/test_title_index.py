import pytest

from termloom.operators import search, title_index

LONG = "long title " * 60


@pytest.fixture(scope="module")
def docs(spark):
    titles = [" Alpha One ", "alpha one", "Beta", "alphabet", "banana", "ab", "", None, "Ünï cödé", "a😀b😀c", LONG, "100% _x_", "beta"]
    titles += [f"list of things {i}" for i in range(200)]
    rows = [(i % 100, t) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "doc_id long, title string")


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "title", "status").collect()))


@pytest.fixture(scope="module")
def index(docs):
    return title_index.title_index(docs)


@pytest.mark.parametrize(
    "text",
    ["ALPHA", "beta ", "ana", "anana", "be", "", "gamma", "list of", "things 19", "ünï", "😀b😀", "0% _", "title long", "t t", "alpha betx"],
)
def test_same_as_the_scan(index, docs, text):
    assert rows(index.candidates(text)) == rows(search.title_candidates(docs, text))


def test_empty_table(docs):
    index = title_index.title_index(docs.limit(0))
    assert index.candidates("alpha").count() == 0


def test_one_gram_is_read(index):
    assert index.rarest("things 19") not in (None, "thi") and index.rarest("gamma") is None
    plan = index.candidates("things 19")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan and "Exchange" not in plan.split("Subquery")[0]
