import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom import settings
from termloom.operators import clusters, search
from termloom.plans import explore, lsa_job, queries
from termloom.sources import artifacts, pages

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")
    pages.write_pages(queries._pages(spark, SF_DIR).drop("doc_id"), f"{folder}/dump")
    params = lsa_job.LsaParams(
        input=f"{folder}/dump", out=f"{folder}/out/", k=6, min_df=3, vocab_size=800, cv_fit_sample=1.0, partitions=4
    )
    lsa_job.run(spark, params)
    return f"{folder}/out"


def test_artifacts(spark, out):
    articles = queries.articles_filter(spark, SF_DIR).count()
    topics = artifacts.read_artifact(spark, out, artifacts.TOPICS)
    docs = artifacts.read_artifact(spark, out, artifacts.DOCS)
    terms = artifacts.read_artifact(spark, out, artifacts.TERMS)
    assert topics.count() == 6 and topics.filter(F.size("terms") == 20).count() == 6
    assert docs.count() == articles and docs.filter(F.size("embedding") == 6).count() == articles
    assert 0 < terms.count() <= 800
    # No seed word occurs in the texts, so no neighbour table is written.
    assert "term_neighbors_samples" not in {p.name for p in Path(out).iterdir()}


def test_first_generation(spark, out, tmp_path):
    lexicon = tmp_path / "lexicon.json"
    lexicon.write_text(json.dumps({"form": "des", "lemma": "de"}) + "\n")
    stopwords = tmp_path / "stop.txt"
    stopwords.write_text("the\nof\n")
    params = lsa_job.LsaParams.first_generation(
        out.rsplit("/", 1)[0] + "/dump", f"{tmp_path}/out", k=3, min_df=3, vocab_size=500, partitions=2,
        lexicon=str(lexicon), stopwords=str(stopwords), format="parquet", limit_pages=150,
    )
    model = lsa_job.run(spark, params)
    assert "des" not in model.terms and "of" not in model.terms and "de" in model.terms and "and" in model.terms
    assert artifacts.read_artifact(spark, params.out, artifacts.TOPICS, "parquet").count() == 3


def test_explorer(spark, out):
    explorer = explore.Explorer(spark, out)
    word = explorer.terms.orderBy("term_id").first().term
    assert explorer.similar_terms(word).count() == 20
    assert explorer.similar_terms(word).filter(F.col("term") == word).count() == 0
    assert explorer.docs_for_term(word, 5).count() == 5
    title = explorer.docs.orderBy("doc_id").first().title
    assert explorer.find_document(title).count() >= 1
    assert explorer.similar_docs(title, 5).count() == 5
    assert explorer.similar_docs("no such title").count() == 0
    report = explorer.cluster_report(ks=(2, 3), restarts=2)
    assert report.best_k == 5 and report.silhouettes.count() == 2
    assert report.strengths.count() == 6
    assert report.scatter.count() == explorer.terms.count() + 5


def test_command_line():
    params = lsa_job.parse(["--input", "a", "--out", "b", "--k", "7", "--clean_v1"])
    assert (params.k, params.min_df, params.vocab_size, params.cv_fit_sample, params.clean_v1) == (7, 30, 80000, 1.0, True)
    with pytest.raises(SystemExit):
        lsa_job.parse(["--input", "a", "--out", "b", "--unknown", "1"])
    old = lsa_job.parse(["--first_generation", "--input", "a", "--out", "b", "--no-clean_v1"])
    assert not old.clean_v1 and old.infer_schema
    old = lsa_job.parse(["--first_generation", "--input", "a", "--out", "b"])
    assert old == lsa_job.LsaParams.first_generation("a", "b")
    assert (old.k, old.min_df, old.vocab_size, old.partitions) == (400, 5, 200000, 200)


def test_scratch_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = settings.scratch_path(spark, "x")
    assert path != settings.scratch_path(spark, "x")
    if named:
        assert path.startswith(named.rstrip("/"))


def test_capped_job_is_parallel_and_stable(spark, out):
    """After a cap the rows are dealt out, and ids do not depend on the number of tasks."""
    found = []
    for partitions in (3, 5, 5):
        params = lsa_job.LsaParams(input=out.rsplit("/", 1)[0] + "/dump", out=out, partitions=partitions, limit_pages=60, sample=0.8)
        tokens = lsa_job.article_tokens(spark, params)
        assert tokens.rdd.getNumPartitions() == partitions
        found.append({(r.doc_id, r.title) for r in tokens.collect()})
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) <= 60


def test_endings_are_detached_by_the_lexicon(spark, tmp_path):
    lexicon = tmp_path / "lexicon.json"
    lexicon.write_text(json.dumps({"form": "city", "lemma": "city"}) + "\n" + json.dumps({"form": "mice", "lemma": "mouse"}) + "\n")
    rows = [("A", 0, None, "Cities, mice & dogs of the city")]
    made = spark.createDataFrame(rows, "title string, ns int, redirect struct<_title:string>, raw_text string")
    pages.write_pages(made, f"{tmp_path}/dump")
    params = lsa_job.LsaParams(input=f"{tmp_path}/dump", out="", lexicon=str(lexicon), detach_endings=True)
    assert lsa_job.article_tokens(spark, params).first().tokens == ["city", "mouse", "dogs", "city"]


def test_result_rows_without_keys_are_in_file_order(spark, tmp_path):
    """A title's first document and a term's last vector go by part file and place, not by size of the split."""
    folder = tmp_path / "keyless"
    for kind, label in (("doc_embeddings", "title"), ("term_embeddings", "term")):
        (folder / kind).mkdir(parents=True)
        small = [{label: "dup", "embedding": [1.0, 0.0]}]
        large = [{label: f"x{i}", "embedding": [0.0, float(i)]} for i in range(3000)] + [{label: "dup", "embedding": [2.0, 0.0]}]
        for part, rows in enumerate((small, large)):
            (folder / kind / f"part-0000{part}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / "topics").mkdir()
    topic = {"topic": 0, "singular_value": 1.0, "terms": ["dup"], "weights": [1.0]}
    (folder / "topics" / "part-00000.json").write_text(json.dumps(topic) + "\n")
    explorer = explore.Explorer(spark, str(folder))
    assert search.select_title(explorer.docs, "dup").first().embedding == [1.0, 0.0]
    last = clusters.last_per_term(explorer.terms).where("term = 'dup'").first()
    assert last.embedding == [2.0, 0.0] and last.first_seen == 0
    order = [r.title for r in explorer.docs.orderBy("doc_id").collect()]
    assert order == ["dup", *(f"x{i}" for i in range(3000)), "dup"]
