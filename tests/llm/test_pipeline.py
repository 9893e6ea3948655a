"""The pipeline's stages on planted documents, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillon.llm import queries
from quillon.llm.text import made, release
from test_models import world


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, q) for i, t, q, _ in world(prose, 250, 5)]
    passage = prose(30, 321)
    good = [t for _, t, q in rows if q and len(t.split()) > 60]
    extra = [good[0], good[0] + " extra", passage + " " + prose(50, 1) + " " + prose(12, 44), prose(60, 2) + "\nshared line here\n" + prose(5, 3), None, ""]
    extra += [prose(40, 600 + k) + "\nShared line here" for k in range(12)]
    rows += [(1000 + k, t, 1) for k, t in enumerate(extra)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows[:250]], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    items = [(1, " ".join(passage.split()[2:22])), (2, " ".join(passage.split()[10:28])), (3, prose(12, 44))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, {i: (t, q) for i, t, q in rows}


def test_stages(spark, folder, tmp_path):
    root, rows = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in v} for n, v in seen.items()}
    text = {n: {r.doc_id: r.text for r in v} for n, v in seen.items() if n != "packing"}
    bad = {i for i, (_, q) in rows.items() if not q}
    assert len(bad & ids["quality"]) <= 0.05 * len(bad) and len(ids["quality"] - bad) >= 0.97 * (len(rows) - len(bad))
    assert ids["lines"] == ids["quality"]
    assert not any("hared line" in (t or "") for t in text["lines"].values())
    near = {1000, 1001} & ids["lines"]
    assert near and not near & ids["near_copies"]
    assert 1002 not in ids["benchmark"]  # windows of two items
    assert ids["benchmark"] >= ids["near_copies"] - {1002}
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["benchmark"] if (r.text or "").split()}
    assert sum(r.length for r in seen["packing"]) == sum(len((r.text or "").split()) for r in seen["benchmark"])
    for r in seen["benchmark"]:
        assert r.n_chars == len(r.text)


def test_near_copies_of_repeated_ids(spark, make, prose, tmp_path):
    a, b, c, d = (prose(60, 800 + k) for k in range(4))
    # 5 and 7 have a near copy of 1 and texts unlike any other; 7 has two near copies of one text, and a row twice
    rows = [(1, a), (5, a + " end"), (5, b), (7, c), (7, c + " end"), (7, d), (7, d), (7, a), (9, b), (None, a), (None, a), (8, ""), (8, None), (8, "")]
    want = [(1, a), (5, b), (7, d), (None, a), (None, a), (8, ""), (8, None)]
    seen = set()
    for parts, order in ((1, rows), (3, rows), (2, rows[::-1])):
        out = corpus_pipeline.near_copy_stage(spark, make([t for _, t in order], [i for i, _ in order]).repartition(parts), "")
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert sorted(map(str, (x for x in got if not (x[1] or "").startswith(c)))) == sorted(map(str, want))
        assert len(got) == len(want) + 1
        seen.add(str(sorted(map(str, got))))
    assert len(seen) == 1


def test_run_and_its_empty_tables(spark, folder, tmp_path):
    root, _ = folder
    assert corpus_pipeline.run(spark, root).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_every_stage(spark, make, prose, tmp_path):
    """Null ids, texts and columns, repeated rows, a very long text, and columns with the names of results."""
    long = "\n".join(prose(400, 900 + k) for k in range(300))
    texts = [None, "", long, prose(50, 950), prose(50, 950), prose(50, 951), None]
    docs = make(texts, [1, 2, 3, 4, 4, None, None]).withColumns({c: F.lit("clash") for c in ("h", "id", "kept", "items", "n_dropped", "row", "quality")})
    spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nowhere to be found"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        want = 6 if name in ("near_copies", "benchmark") else 7  # the repeated row
        assert docs.count() == want, name
    assert {r.doc_id: r.text for r in docs.collect()}[3] == long
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == 300 * 400 + 50 + 50 and {r.doc_id for r in packed} == {3, 4, None}


def test_run_leaves_the_last_stage_only(spark, folder):
    release(spark, made())
    corpus_pipeline.run(spark, folder[0]).count()
    assert sum("/stage-" in p for p in made()) == 1 and not any("/features-" in p or "/rows-" in p for p in made())


def test_registered(spark):
    named = __spark_entry__.queries()
    assert [n for n in named if n.startswith("op")] == list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert "pipeline" in named and set(__spark_entry__.oracle_sql()) <= set(named)
