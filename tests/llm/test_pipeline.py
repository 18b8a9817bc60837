"""The pipeline on a small corpus: what each stage decides takes effect."""

import corpus_pipeline

from .test_operators import DOCS, toxic_rows


def test_stages(spark, tmp_path):
    rows = [(*r, "x", 0.5) for r in toxic_rows(300)]
    rows += [(1000 + i, rows[1][1] + f" n{i}", "en", "s", "x", 0.5) for i in range(5)] + [(2000, "1234 5678", "en", "s", "x", 0.5)]
    rows = [(a, b, "en", d, e, f) for a, b, _, d, e, f in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    clean = {i for i in range(300) if i % 5}
    assert len(clean - set(ids["toxicity"])) <= 3 and len(set(range(0, 300, 5)) & set(ids["toxicity"])) <= 3
    assert 2000 not in ids["language_id"] and len(set(ids["toxicity"]) - set(ids["language_id"])) == 1
    assert not set(ids["ngram_jaccard"]) & set(range(1000, 1005)) and 1 in ids["ngram_jaccard"]
    assert all(seen[k].columns == ["doc_id", "text", "lang", "source", "id", "score"] for k in ("toxicity", "language_id", "ngram_jaccard", "mixing"))
    assert sorted(ids["packing"]) == sorted(ids["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["packing"])


def test_awkward_rows(spark, tmp_path):
    """Null, blank, repeated and very long rows, rows without an id, and columns with the operators' own names."""
    long = " ".join(f"word{i % 900} plain{i}" for i in range(9000))
    base = [(i, f"plain words of text {i} and some more of them for a length {i * 7}", "en", "ab"[i % 2]) for i in range(60)]
    odd = [(None, None, None, None), (100, "", "en", "a"), (101, " \t\n", None, "b"), (None, "an id is missing here but words are not", "en", None), (102, long, "en", "a"), (102, "other words under an id that is taken", "en", "a"), *[(103, "one row that comes twice with all that it has", "en", "b")] * 2]
    rows = [(*r, "x", 0.5) for r in base + odd]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 0, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "id", "score"] and {r.score for r in seen[name]} == {0.5}
    assert len(seen["toxicity"]) == 68  # no label says toxic
    assert not [r for r in seen["language_id"] if not (r.text or "").strip()]
    kept = [(r.doc_id, r.text) for r in seen["ngram_jaccard"]]
    assert len(kept) == len(set(kept)) == 64 and (None, odd[3][1]) in kept and sum(i == 102 for i, _ in kept) == 2
    assert len(seen["packing"]) == len(seen["mixing"]) > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
