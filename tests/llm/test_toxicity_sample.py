"""The training sample beside a text longer than all it may hold."""

from pyspark.sql import functions as F

from corvane.llm import toxicity


def test_long_text_does_not_empty_its_label(spark):
    ids = spark.range(60).filter(~toxicity.is_held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(12).collect()
    first = ids[0].id
    rows = [(r.id, "ab " * 3000 if r.id == first else f"text {r.id}", 1) for r in ids] + [(100 + r.id, "clean", 0) for r in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts, labels = toxicity.sample(df, df, "doc_id", "text", "toxic", 1500, 6400)
    toxic = [t for t, y in zip(texts, labels, strict=True) if y]
    assert len(toxic) == 12 and sum(map(len, toxic)) <= 3200
    assert sorted(t for t in toxic if t.startswith("text")) == sorted(f"text {r.id}" for r in ids[1:])
    assert max(map(len, toxic)) == 200 and max(toxic, key=len) in "ab " * 3000
