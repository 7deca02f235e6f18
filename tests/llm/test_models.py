"""Classifiers on held-out rows, neighbour search, revisits, surrogates."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from worklens.llm import batches, collision_ann, pii_surrogates, quality_indexing, queries, toxicity_cnn, warc_revisits

SF = "/root/testdata/sf0.01"
ODD = [(90001, None), (90002, ""), (90003, "a " * 30000), (None, "text without id"), (90003, "a " * 30000)]


def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("score", F.lit("clash"))


def rates(spark, result, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = result.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("label")).collect()
    return np.mean([r["predicted"] == r["label"] for r in rows]), len(rows)


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    result = quality_indexing.digest(documents(spark), labels).cache()
    assert result.count() == 1000 + len(ODD)
    assert result.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").isEmpty()
    accuracy, number = rates(spark, result, "quality")
    assert number > 80 and accuracy > 0.93
    unlabelled = quality_indexing.digest(documents(spark), labels.limit(0))
    assert unlabelled.where("score <> 0.5").isEmpty()
    assert quality_indexing.digest(documents(spark).limit(0), labels).collect() == []


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    result = toxicity_cnn.digest(documents(spark), labels).cache()
    assert result.count() == 1000 + len(ODD)
    assert result.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").isEmpty()
    accuracy, number = rates(spark, result, "toxic")
    assert number > 50 and accuracy > 0.93
    assert toxicity_cnn.digest(documents(spark).limit(0), labels.limit(0)).collect() == []


def test_scores_follow_from_the_text_alone(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents(spark)
    model = quality_indexing.fit(docs, labels)
    plain = quality_indexing.scored(docs, model, keep=["doc_id"]).where("doc_id < 50")
    moved = quality_indexing.scored(docs.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("xx")}), model, keep=["doc_id"]).where("doc_id > -50")
    assert sorted(r["score"] for r in plain.collect()) == sorted(r["score"] for r in moved.collect() if r)


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["The", "der", "word%%%", "été", "x" * 700, "a", "\n", "les", "des"], 2000)).encode()
    for classes, fold, prefixes in ((quality_indexing._CLASSES, None, ()), (toxicity_cnn._CLASSES, batches.LOWER, (4, 6))):
        whole = batches.Words([text], classes, fold).hashes(*prefixes)
        for limit in (1, 300, 1000, len(text)):
            parts = zip(*batches.hashes_by_part(text, classes, fold, *prefixes, limit=limit), strict=True)
            assert all((w == np.concatenate(p)).all() for w, p in zip(whole, parts, strict=True))
    vectors = rng.standard_normal((quality_indexing.BUCKETS, quality_indexing.LENGTH)).astype(np.float32)
    network, texts = toxicity_cnn.Network(), [text, b"", b"one two", b" " * 900]
    together = network.scores(texts)
    assert np.allclose(together, [network.scores([t])[0] for t in texts], atol=1e-6)
    pooled, context = quality_indexing.pooled(texts, vectors), quality_indexing.context_sums(texts)
    for module in (toxicity_cnn, quality_indexing):
        monkeypatch.setattr(module, "SLICE_BYTES", 500)
        monkeypatch.setattr(module, "hashes_by_part", lambda *args: batches.hashes_by_part(*args, limit=500))
    assert np.allclose(network.scores(texts), together, atol=1e-6)
    assert np.allclose(quality_indexing.pooled(texts, vectors), pooled, atol=1e-3)
    assert (quality_indexing.context_sums(texts) == context).all()


def test_neighbours_reach_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = collision_ann.nearest(rows, rows.where("vec_id % 100 = 0")).collect()
    table = rows.orderBy("vec_id").toPandas()
    x, ids = np.stack(table["embedding"].values).astype(float), table["vec_id"].values
    right = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert np.allclose([r["score"] for r in mine], [d[ids == r["vec_id"]][0] for r in mine], rtol=0, atol=1e-12)
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        right, total = right + len(set(best) & {r["vec_id"] for r in mine}), total + 10
    assert right / total >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [2.0, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    found = collision_ann.nearest(frame, frame.where("vec_id % 100 = 0"), block=1).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 0.0), (0, 2, 6, 1.0), (0, 3, 6, 1.0)]
    assert collision_ann.nearest(frame.limit(0), frame.limit(0)).collect() == []


def test_revisits_equal_the_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = queries.QUERIES["op5_revisit_resolution"](spark, SF)
    cursor = duck.execute(queries.ORACLE["op5_revisit_resolution"])
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, cursor.fetchall()))


def test_revisit_cases(spark):
    a, b = {"ETag": '"1"', "X": "kept", "Date": "d1"}, {"etag": 'W/"1"', "date": "d2", "content-length": "0"}
    rows = [
        (1, "http://Www.A.com:80/p/?b=2&utm_x=1&a=1#f", 10, "response", a), (2, "https://a.com/p?a=1&b=2", 20, "revisit", b),
        (3, "https://a.com/p?a=1&b=2", 30, "response", {"etag": '"2"'}), (4, "https://a.com/p?a=1&b=2", 30, "revisit", b),
        (5, "http://a.com/q", 5, "revisit", b), (6, "http://a.com/p?b=2&a=1", 10, "revisit", None), (7, None, 9, "revisit", b),
        (8, "http://a.com/q", None, "revisit", b), (9, "http://hot/", 1, "response", {"Last-Modified": "m"}),
    ] + [(100 + i, "http://hot/", 2 + i, "revisit", {"last-modified": "m" if i % 2 else "n"}) for i in range(200)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, captured long, kind string, headers map<string,string>, outcome string")
    got = {r["record_id"]: r for r in warc_revisits.resolved(frame, slices=8).collect()}
    assert (got[2]["outcome"], got[2]["response_id"]) == ("merged", 1)
    assert got[2]["headers"] == {"x": "kept", "etag": 'W/"1"', "date": "d2"}
    outcomes = {k: got[k]["outcome"] for k in (4, 5, 6, 7, 8)}
    assert outcomes == {4: "validator_mismatch", 5: "no_response", 6: "no_common_validator", 7: "no_response", 8: "no_response"}
    assert all((got[100 + i]["outcome"] == "merged") == bool(i % 2) for i in range(200)) and len(got) == 206
    assert warc_revisits.resolved(frame.limit(0)).collect() == []


PERSONAL = (
    "Mr. Smith met Mary Jones. Jones wrote to A.B@mail.example.com and a.b@mail.example.com from 97.51.17.173; "
    "call +1 (017) 555-7713, card 9807 9157 6280 4490 or 9807915762804490. SMITH left. Господин Петров"
)


def test_surrogates_keep_type_format_and_identity(spark):
    rows = [(1, PERSONAL), (2, "x a.b@mail.example.com 97.51.17.9 Mr. Jones"), (3, None), (4, ""), (5, "clean text"), (1, PERSONAL)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_entities string")
    out = pii_surrogates.pseudonymised(frame, "key").collect()
    text = {r["doc_id"]: r["text"] for r in out}
    assert len(out) == 6 and text[3] is None and text[4] == "" and text[5] == "clean text"
    for real in ("Smith", "SMITH", "Jones", "Mary", "mail.example.com", "97.51.17", "555-7713", "9807", "Петров"):
        assert real not in text[1]
    mails = re.findall(r"\S+@\S+\.com", text[1])
    assert mails[0].lower() == mails[1] and mails[1] in text[2] and mails[0][0].isupper()
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16})", text[1]).groups()
    assert cards[0].replace(" ", "") == cards[1]
    person = re.match(r"Mr\. (\w+) met (\w+a|\w+elle) (\w+)\. (\w+) wrote", text[1])
    assert person[3] == person[4] and person[1].upper() + " left" in text[1] and f"Mr. {person[3]}" in text[2]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[1]) and re.search("Господин [А-Я][а-я]+$", text[1])
    prefix = lambda t: re.search(r"(\d+\.\d+\.\d+)\.\d+", t)[1]
    assert prefix(text[1]) == prefix(text[2])
    other = {r["doc_id"]: r["text"] for r in pii_surrogates.pseudonymised(frame, "another").collect()}
    assert other[1] != text[1]
    joined = {r["doc_id"]: r["text"] for r in pii_surrogates.pseudonymised(frame, "key", broadcast=-1).collect()}
    assert joined == text


def test_phone_forms_wherever_they_stand(spark):
    forms = ["555-123-4567", "+14155552671", "+33 1 23 45 67 89", "+49 30 1234567", "+44 (0)20 7946 0958", "(030) 555-7713", "01 23 45 67 89", "030 12345678"]
    leads = ["", "tel:", "line\n", "so, ", '"', "call,"]
    for form in forms:
        for lead in leads:
            assert [e[:3] for e in pii_surrogates.entities(f"{lead}{form}\nrest")] == [(len(lead), len(lead) + len(form), "phone")]
    for other in ("2024-01-15", "01-02-2024 10:30", "01.02.2024", "room 12 34", "1,000,000"):
        assert pii_surrogates.entities(other) == []
    frame = spark.createDataFrame([(i, f"tel:{form}") for i, form in enumerate(forms)], "doc_id long, text string")
    for row in pii_surrogates.pseudonymised(frame, "key").collect():
        form = forms[row["doc_id"]]
        assert row["n_entities"] == 1 and form not in row["text"]
        assert ["d" if c.isdigit() else c for c in row["text"][4:]] == ["d" if c.isdigit() else c for c in form]


def test_clashing_surrogates_stay_distinct(spark):
    mails = [f"{c}@d.com" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    frame = spark.createDataFrame([(i, f"to {m} .") for i, m in enumerate(mails)], "doc_id long, text string")
    made = [r["text"].split()[1] for r in pii_surrogates.pseudonymised(frame, "key").collect()]
    assert len(set(made)) == len(mails)
    assert pii_surrogates.pseudonymised(frame.limit(0), "key").collect() == []
