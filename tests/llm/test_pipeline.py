from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_on_awkward_rows(spark, tmp_path):
    r = random.Random(1)
    plain = [f"w{k}" for k in range(200)]
    body = lambda n=60: " ".join(r.choice(plain) for _ in range(n))
    texts = [body() + (" vile" if k % 6 == 0 else "") for k in range(120)]
    item = " ".join(f"q{k}" for k in range(12))
    other = " ".join(f"z{k}" for k in range(12))
    rows = [(k, t, "en", f"s{k % 3}", len(t), "x") for k, t in enumerate(texts)]
    rows += [(200, texts[1], "en", "s0", 1, "x"), (201, f"{body()} {item} {other}", "en", "s1", 1, "x"), (202, f"{body()} {item}", "en", "s1", 1, "x"), (203, "mail bob@ex.com now", None, None, None, "x")]
    rows += [(None, None, None, None, None, None), (204, "", "en", "s0", 0, "x"), (204, "", "en", "s0", 0, "x")]
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert out.columns == columns if k + 1 < len(corpus_pipeline.STAGES) else out.columns[: len(columns)] == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    ids = {n: {i for i, _ in x} for n, x in kept.items()}
    toxic = {k for k in range(120) if k % 6 == 0}
    assert len(toxic & ids["toxicity"]) <= 1 and len(set(range(120)) - toxic - ids["toxicity"]) <= 2 and None in ids["toxicity"]
    assert 200 not in ids["near_duplicates"] and 1 in ids["near_duplicates"] and {202, 203, 204} <= ids["near_duplicates"]
    assert 201 not in ids["decontamination"] and 202 in ids["decontamination"] and not any("q5" in (t or "") for _, t in kept["decontamination"])
    assert (203, "mail <EMAIL> now") in kept["personal_data"]
    assert docs.filter(F.col("taken") > 3 * F.col("size")).count() == 0 and ids["mixture"]
    assert docs.filter("doc_id = 203").filter(F.col("n_chars") != F.length("text")).count() == 0
