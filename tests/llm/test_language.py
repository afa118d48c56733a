import pandas as pd

from tablecraft.llm.language import _drawn, held_out, identify, learn
from tablecraft.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR


def test_held_out_accuracy(spark):
    found = QUERIES["op1_language_mixture"](spark, SF_DIR.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    kept = rows[rows["held_out"]]
    assert 100 < len(kept) < 300 and (kept["lang"] == kept["lang_pred"]).mean() > 0.98


def test_mixtures_and_rejects(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    model = learn(docs)
    longest = docs.where("n_chars BETWEEN 3000 AND 9000").toPandas().groupby("lang").head(2)
    by = longest.groupby("lang")["text"].first()
    mixed = by["en"][:1500] + " " + by["fr"][:1500]
    frame = spark.createDataFrame(
        pd.DataFrame({"score": ["clash"] * 4, "text": [mixed, by["de"], None, "12 -- %"]}).astype(object).where(lambda x: x.notna(), None),
        "score string, text string")
    rows = identify(frame, model).collect()
    assert sorted(rows[0]["languages"]) == ["en", "fr"] and 0.3 < rows[0]["score"] < 0.7
    assert abs(sum(rows[0]["proportions"]) - 1) < 1e-3
    assert rows[1]["languages"] == ["de"] and rows[1]["score"] == 1
    assert [(r["lang_pred"], r["score"], r["languages"]) for r in rows[2:]] == [("und", 0.0, [])] * 2


def test_odd_rows(odd_documents, no_documents):
    found = identify(odd_documents, learn(odd_documents)).toPandas()
    assert len(found) == 20
    assert set(found[found["text"].isna() | found["text"].isin(["", " \n\t ", "12 34 %% --"])]["lang_pred"]) == {"und"}
    assert found[found["doc_id"] == 12]["lang_pred"].tolist() == ["ja"]
    untrained = learn(no_documents)
    assert untrained[0] == []
    assert set(identify(odd_documents, untrained).toPandas()["lang_pred"]) == {"und"}
    assert identify(no_documents, learn(odd_documents)).count() == 0
    assert odd_documents.select(held_out().alias("h")).where("h IS NULL").count() == 0


def test_every_label_is_learned(spark):
    """90 labels of own words, the rarest with one row: each row is told by the label of its words."""
    words = {i: " ".join(chr(0x4E00 + 40 * i + k % 37) * 2 for k in range(60)) for i in range(90)}
    rows = [(100 * i + n, f"l{i}", words[i]) for i in range(90) for n in range(1 + (i < 80))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = learn(df)
    assert len(model[0]) == 90
    assert identify(df, model).where("lang_pred <> lang").count() == 0


def test_a_label_has_at_most_so_many_rows(spark):
    """A label that is mostly one text is drawn by its ids too, repeated rows count once, a small label is whole."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id < 50, 'b', 'a') AS lang", "if(id % 10 < 9, 'the same text', concat('text ', id)) AS text")
    df = df.unionByName(df.where("doc_id >= 19000"))
    rows = df.select("lang", F.shiftrightunsigned(F.xxhash64("text", "doc_id"), 1).alias("draw")).distinct()
    taken = {r["lang"]: r["count"] for r in rows.join(_drawn(rows, 400), "lang").where("draw <= bound").groupBy("lang").count().collect()}
    assert taken["b"] == 50 and 380 <= taken["a"] <= 400
    names, table_ = learn(df, 400)
    assert names == ["a", "b"] and abs(float(table_[:, 0].sum()) - 1) < 1e-3
