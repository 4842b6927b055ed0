"""Samples, agreement, coding, graphs, search, storage, export, classifiers and streams on small inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import agreement as ag
from tesserae.operators import analytics as an
from tesserae.operators import classify as cl
from tesserae.operators import codebook as cb
from tesserae.operators import coding as cd
from tesserae.operators import export as ex
from tesserae.operators import filters as fl
from tesserae.operators import sampling as sm
from tesserae.storage import Store, cached


def rows(spark, n):
    return spark.range(n).withColumnRenamed("id", "_row_idx")


def test_quota_and_chunk_cases(spark):
    df = rows(spark, 10).withColumn("s", F.when(F.col("_row_idx") < 5, "a").when(F.col("_row_idx") < 8, "b"))
    assert {r.stratum: r.quota for r in sm.quotas(df, 4, "s").collect()} == {"a": 2, "b": 1, "__missing__": 1}
    assert sm.stratified_sample(df, 4, "s").count() == 4 and sm.stratified_sample(df, 99, "s").count() == 10
    sizes = [r["count"] for r in sm.equal_chunks(df, 3, overlap_pct=20).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [5, 5, 4]
    with pytest.raises(ValueError):
        sm.equal_chunks(df, 1)
    assert [r._row_idx for r in sm.systematic_sample(df, 4).orderBy("_row_idx").collect()] == [0, 4, 8]
    assert sm.random_sample(df, 0).count() == 0 and sm.random_sample(df, 99).count() == 10
    assert sm.SampleSpec.from_dict({"n": 0, "seed": 0, "step": "3"}) == sm.SampleSpec(step=3)
    assert sm.systematic_sample(rows(spark, 3252), 100).count() == 33


def test_agreement_by_hand(spark):
    a, b = [1, 1, 0, 0], [1, 0, 0, 0]
    tags = [(i, c, "yes" if v else "no", "cb") for c, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(tags, "_row_idx long, coder string, cat_id string, codebook_id string")
    cats = spark.createDataFrame([("yes",)], "cat_id string")
    k = ag.kappa(df, cats, "a", "b").first()
    assert (k.n, k.kappa, k.weight) == (4, 0.5, 2)
    assert abs(ag.alpha(df, cats).first().alpha - 0.533333) < 1e-6
    assert ag.mean_kappa(ag.kappa(df, cats, "a", "b")).first().kappa == 0.5
    assert ag.agreement(df, cats)[0] == "kappa" and ag.agreement(df.where("coder = 'a'"), cats)[1] is None
    assert {r._row_idx for r in ag.conflicts(df).collect()} == {1}
    same = ag.kappa(df.where("_row_idx = 0"), cats, "a", "b").first()
    assert same.kappa == 1.0
    assert {(r.a, r.b): r.shared for r in ag.coder_overlap(df).collect()} == {("a", "a"): 4, ("a", "b"): 4, ("b", "b"): 4}


def test_event_log(spark):
    log = [(1, 1, "tag", 0, "x", "a", "g"), (2, 2, "tag", 0, "y", "a", "g"), (3, 3, "tag", 1, "z", "a", None), (4, 3, "tag", 2, "z", "a", None), (5, 4, "untag", 1, "z", "a", None)]
    df = spark.createDataFrame([(*r, "cb") for r in log], "seq long, batch long, action string, _row_idx long, cat_id string, coder string, `group` string, codebook_id string")
    got = lambda e: sorted((r._row_idx, r.cat_id) for r in cd.current(e).collect())
    assert got(df) == [(0, "y"), (2, "z")]
    assert got(cd.undone(df)) == [(0, "y"), (1, "z"), (2, "z")]
    assert got(cd.undone(df, 2)) == [(0, "y")] and got(cd.undone(df, 3)) == [(0, "x")]
    more = df.unionByName(cd.bulk(rows(spark, 3), "x", "a", "cb", 9, "g").drop("source"))
    assert got(more) == [(0, "x"), (1, "x"), (2, "x"), (2, "z")]
    scores = spark.range(1).select(cd.merge_scores(F.create_map(F.lit("a"), F.lit(0.7), F.lit("b"), F.lit(0.6), F.lit("c"), F.lit(0.1)), ["a"], "b").alias("m")).first().m
    assert scores == {"c": 0.1, "b": 1.0}
    place = spark.createDataFrame([(0, "x", 0), (0, "y", 1), (0, "z", 2)], "_row_idx long, cat_id string, place int")
    groups = spark.createDataFrame([("x", "g"), ("y", "g"), ("z", None)], "cat_id string, exclusion_group string")
    assert {r.cat_id for r in cd.exclusive(place, groups).collect()} == {"x", "z"}
    assert {r.cat_id for r in cd.exclusive(place, groups, first_wins=False).collect()} == {"y", "z"}


def test_memos_and_spans(spark):
    memo = spark.createDataFrame([(1, "m1", "add", 0, "One", "a", "cb", "t1"), (2, "m1", "edit", 0, "Two", "a", "cb", "t1"), (3, "m2", "add", 0, "x", "b", "cb", "t2"), (4, "m2", "delete", 0, "x", "b", "cb", "t3")], "seq long, memo_id string, action string, _row_idx long, text string, coder string, codebook_id string, ts string")
    assert [r.text for r in cd.memos(memo, contains="tw").collect()] == ["Two"] and tuple(cd.memo_counts(cd.memos(memo)).first()) == (1, 1, 1)
    spans = spark.createDataFrame([(1, 0, 0, 3, "c"), (2, 0, 0, 3, "c"), (3, 0, 5, 5, "c")], "seq long, _row_idx long, start int, end int, cat_id string")
    texts = spark.createDataFrame([(0, "héllo")], "_row_idx long, text string")
    assert {r.quote for r in cd.span_texts(spans, texts).collect()} == {"hél"}
    assert {r.seq for r in cd.remove_span(spans, 0, 0, 3, "c").collect()} == {2, 3}


def test_codebooks(spark):
    book = cb.starter()
    book.add("Hate speech", shortcut_key="9")
    assert book.version == "1.0.1" and book.categories[-1].cat_id == "hate_speech_2" and len(book.at(0)) == 5
    with pytest.raises(ValueError):
        book.update("unsure", shortcut_key="9")
    again = cb.from_json(book.to_json())
    assert again.categories == book.categories and not again.problems()
    table = lambda cats: spark.createDataFrame(cb.replace_categories(book, cats).rows(), cb.SCHEMA)
    book.update("unsure", title="Not sure")
    diff = {r.cat_id: (r.change, r.fields) for r in cd.codebook_diff(table(book.at(0)), table(book.categories)).collect()}
    assert diff == {"hate_speech_2": ("added", ""), "unsure": ("changed", "title")}


def test_text_functions(spark):
    df = spark.createDataFrame([("Größe #Tag @Bob 😀😀 https://www.Site.org/a ﬁne",), (None,)], "t string")
    r = df.select(tx.tokens(F.col("t")).alias("w"), tx.mentions(F.col("t")).alias("m"), *[c.alias(n) for n, c in tx.post_features(F.col("t")).items()], tx.nfkc(F.col("t")).alias("n")).collect()
    assert r[0].w[:3] == ["größe", "#tag", "@bob"] and r[0].m == ["bob"] and r[0].domains == ["site.org"] and (r[0].emoji_count, r[0].emoji_unique) == (2, 1)
    assert "fine" in r[0].n and r[1].w == [] and r[1].char_count == 0 and r[1].n is None
    one = lambda c: df.limit(1).select(c).first()[0]
    assert one(tx.slug(F.lit("A b--C!"))) == "a_b_c" and one(tx.json_block(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert "der" not in tx.stopwords() and "der" in tx.stopwords(["DE"]) and "xyz" in tx.stopwords(["de"], {"de": ["xyz"]}) and "http" in tx.stopwords(["xx"])


def test_filters_with_absent_columns(spark):
    df = rows(spark, 3)
    assert fl.apply(df, fl.FilterSpec.from_dict({"text": "x", "ranges": {"like_count": {"max": 3}}})).count() == 3
    assert fl.apply(df, fl.FilterSpec.from_dict({"ranges": {"like_count": {"min": 3}}})).count() == 0
    with pytest.raises(ValueError):
        fl.text_condition(F.lit("x"), "(", regex=True)
    assert fl.page(df.orderBy("_row_idx"), 0, 2).count() == 2


def test_crosstab_pivot_and_descriptives(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "x", None)], "language string, platform string, like_count int").withColumn("text", F.lit("hi there"))
    assert sorted(map(tuple, an.pivoted(an.crosstab(df, "language", "platform")).collect())) == [("a", 1, 1), ("b", 1, 0)]
    d = an.descriptives(df)
    assert d["rows"].first().rows == 3 and d["like_count"].first().total == 3.0 and d["facets"].count() == 3


def test_descriptives_scan_twice_and_take_odd_rows(spark, tmp_path):
    """Two scans of the input, whatever the sections; exact medians over ties, blanks and nulls."""
    cells = [(i, None if i % 5 == 0 else f"u{i % 3}", [None, "", "x" * (i % 9)][i % 3], None if i % 4 == 0 else i % 7, "a, b" if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(cells, "_row_idx long, author_handle string, text string, like_count int, hashtags string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    d = an.descriptives(df.mapInArrow(seen, df.schema))
    out = {name: [tuple(r) for r in part.collect()] for name, part in d.items()}
    assert read.value == 2 * 200
    likes = sorted(c[3] for c in cells if c[3] is not None)
    texts = sorted(len(c[2]) for c in cells if c[2])
    middle = lambda x, q: x[int(q * (len(x) - 1))] + (x[min(len(x) - 1, int(q * (len(x) - 1)) + 1)] - x[int(q * (len(x) - 1))]) * (q * (len(x) - 1) % 1)
    assert out["rows"] == [(200,)] and out["authors"] == [(3,)] and out["like_count"][0][2] == middle(likes, 0.5)
    assert out["text_length"][0][0] == len(texts) and out["text_length"][0][2:] == pytest.approx((middle(texts, 0.5), middle(texts, 0.95)))
    assert out["hashtags"] == [("a", 100, 0.5), ("b", 100, 0.5)]
    empty = an.descriptives(df.limit(0))
    assert empty["rows"].first().rows == 0 and empty["like_count"].first().median is None and empty["top_authors"].count() == 0


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    corpus = rows(spark, 5).withColumn("text", F.lit("t"))
    sid = s.create_snapshot(corpus, ["b", "a"], {"near": True})
    assert sid == s.create_snapshot(corpus.limit(1), ["a", "b"], {"near": True}) and s.open_snapshot(sid, "_row_idx > 1", ["_row_idx"]).count() == 3
    assert s.sql(sid, "SELECT count(*) AS n FROM corpus WHERE _row_idx < :top", top=2).first().n == 2 and s.snapshots().count() == 1
    s.record("merge", rows=5)
    s.record("slice", name="x")
    assert "**merge** rows=5" in ex.provenance_markdown([r.asDict() for r in s.provenance().collect()])
    assert s.drop_snapshot(sid) and not s.exists(f"snapshots/{sid}")


def test_classifier_cache_and_topics(spark):
    df = spark.createDataFrame([(0, "good stuff"), (1, "bad stuff"), (2, None)], "_row_idx long, text string")
    groups = spark.createDataFrame([("pos", "g"), ("neg", "g"), ("any", None)], "cat_id string, exclusion_group string")
    make = lambda: cl.keyword_classifier({"pos": ["good"], "neg": ["bad", "stuff"], "any": ["stuff", "x"], "zz": ["stuff"]})
    told = cl.code_with(df, make, groups)
    assert {(r._row_idx, r.cat_id) for r in told.collect()} == {(0, "pos"), (0, "any"), (1, "neg"), (1, "any")}
    cache = told.where("_row_idx = 0").groupBy("key").agg(F.collect_list(F.struct("cat_id", "place", "confidence", "reason")).alias("answers")).withColumn("seq", F.lit(1))
    hits, misses = cached(told.select("key").distinct(), cache)
    assert (hits.count(), misses.count()) == (1, 1)
    fail = lambda: lambda texts: [[] for t in texts if not t.startswith("good")]
    assert {r._row_idx for r in cl.code_with(df, fail, groups, cache).collect()} == {0}
    assert cl.parse_answer('So: ```json\n[{"cat_id": "a"}]\n```') == [{"cat_id": "a"}] and cl.parse_answer("no") == []
    topics = [{"topic_id": "g", "keywords": ["good"]}, {"topic_id": "s", "keywords": ["stuff"]}]
    assert {r._row_idx: r.topic_id for r in cl.assign_topics(df, topics).collect()} == {0: "g", 1: "s", 2: "other"}
    assert [t["topic_id"] for t in cl.normalise_topics([{"name": "A b"}, {"name": "a B"}, {"name": "Other"}])] == ["a_b", "a_b_2", "other"]
    p = cl.preflight(df, 350, {"input": 1.0, "output": 2.0, "cache_write": 1.0, "cache_read": 0.1}).first()
    assert (p.rows, p.batches, p.out_tokens) == (3, 1, 120)
    b = cl.Budget(10)
    b.reserve("j", 8)
    assert b.state() == "warning"
    with pytest.raises(ValueError):
        b.reserve("k", 3)
    b.commit("j", 10)
    assert b.state() == "blocked"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(0, ["a", "b"], 'say "x"')], "_row_idx long, hashtags array<string>, text string")
    ex.write_csv(df.coalesce(1), f"file://{tmp_path}/csv")
    data = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*")).decode()
    assert data == '﻿_row_idx,hashtags,text\n0,a|b,"say ""x"""\n'
    z = ex.bundle({"a.csv": data}, "read me")
    (tmp_path / "z.zip").write_bytes(z)
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["a.csv", "README.txt"] and z == ex.bundle({"a.csv": data}, "read me")
    assert ex.latex_escape("a_b\\{") == r"a\_b\textbackslash{}\{" and "1.50" in ex.latex_table([{"x": 1.5}], "c", "l")
    assert "<td>&lt;</td>" in ex.report("t", {"s": [{"a": "<"}]}, as_html=True) and "| a |" in ex.report("t", {"s": [{"a": 1}]})


def test_streams(spark, tmp_path):
    from tesserae.streaming import live

    df = spark.sql("SELECT cast(id % 7 AS string) AS post_id, 'p' AS platform, timestamp'2024-01-01' + make_interval(0,0,0,cast(id % 3 AS int)) AS created_at, concat('text number ', id % 7) AS text FROM range(20)")
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = live.read(spark, f"file://{tmp_path}/in", df.schema)
    live.run_once(live.first_seen(stream, late="30 days"), f"file://{tmp_path}/a", f"file://{tmp_path}/ca")
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 7
    live.run_once(live.first_seen(stream, late="30 days", near=True), f"file://{tmp_path}/b", f"file://{tmp_path}/cb")
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 7
    q = live.bucket_counts(stream).writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", f"file://{tmp_path}/cc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {str(r.bucket)[:10]: r.n for r in spark.table("cells").collect()} == {"2024-01-01": 7, "2024-01-02": 7, "2024-01-03": 6}


def test_jobs_can_be_cancelled(spark):
    import time

    from tesserae.operators.jobs import Jobs

    jobs = Jobs(spark)
    fine = jobs.start("count", lambda tell: (tell(step=1), spark.range(10).count())[1])
    assert fine.done.wait(60) and (fine.status, fine.result, fine.events) == ("done", 10, [{"step": 1}])
    bad = jobs.start("bad", lambda tell: 1 / 0)
    assert bad.done.wait(10) and bad.status == "failed" and "ZeroDivisionError" in bad.error
    slow = jobs.start("slow", lambda tell: spark.range(0, 10**15, 1, 2).selectExpr("sum(id % 7)").collect())
    time.sleep(2)
    jobs.cancel(slow.id)
    assert slow.done.wait(60) and slow.status == "cancelled"


def test_adjudication_topics_and_enrichment_cache(spark):
    log = spark.createDataFrame([(1, 0, "a", "x", "n" * 600), (2, 0, "b", "y", "why"), (3, 1, "a", "x", "n" * 600)], "seq long, _row_idx long, cat_id string, judge string, note string")
    got = {r._row_idx: (r.cat_id, len(r.note)) for r in ag.adjudications(log).collect()}
    assert got == {0: ("b", 3), 1: ("a", 500)}
    now = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "_row_idx long, topic_id string")
    assert {r._row_idx: r.topic_id for r in cl.revert_topics(now, now.where("_row_idx < 2")).collect()} == {0: "x", 1: "y", 2: "other"}
    df = spark.createDataFrame([(0, "good"), (1, "good"), (2, None)], "_row_idx long, text string")
    made = cl.enrich(df, cl.word_sentiment(["good"], ["bad"]), "label string, score double", "sentiment")
    assert {r._row_idx: r.sentiment.label for r in made.collect()} == {0: "positive", 1: "positive", 2: "neutral"}
    cache = spark.createDataFrame([("sentiment", __import__("hashlib").sha1(b"sentiment||good").hexdigest(), '{"label": "cached"}')], "kind string, key string, answer string")
    made = cl.enrich(df, cl.word_sentiment(["good"], ["bad"]), "label string, score double", "sentiment", cache=cache)
    assert {r._row_idx: r.sentiment.label for r in made.collect()} == {0: "cached", 1: "cached", 2: "neutral"}


def test_cluster_list(spark):
    from tesserae.operators import network as nw

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "_row_idx long, text string")
    named = spark.createDataFrame([(i, 0 if i < 9 else 9) for i in range(13)], "row long, cluster long")
    got = nw.cluster_list(named, rows, samples=2, chars=4).collect()
    assert sorted((r.cluster, r["size"], r.rows, r.texts) for r in got) == [(0, 9, "0,1", ["text", "text"]), (9, 4, "9,10", ["text", "text"])]


def test_uploads_diagnostics_and_warnings(spark, tmp_path):
    import pytest

    from tesserae.operators import agreement as ag
    from tesserae.sources import ingest as ig

    (tmp_path / "a.csv").write_text("id,text\n1,x\n")
    assert ig.checked_upload(spark, f"file://{tmp_path}/a.csv") == "csv"
    with pytest.raises(ValueError, match="over the limit"):
        ig.checked_upload(spark, f"file://{tmp_path}/a.csv", 5)
    corpus = spark.createDataFrame([("en", "x" * 100, i) for i in range(100)], "language string, text string, like_count long")
    sample = corpus.limit(20).selectExpr("language", "substr(text, 1, 10) AS text", "1 AS like_count")
    assert len(ag.diagnose(corpus, sample)) == 1 and ag.diagnose(corpus, corpus) == []
    out = spark.createDataFrame([("good", 0.1), ("good", 0.9), ("odd", 2.0)], "cat_id string, confidence double")
    assert len(ag.guardrail_warnings(ag.guardrails(out, ["good"]))) == 3
    assert ag.guardrail_warnings(ag.guardrails(out.where("confidence = 0.9"), ["good"])) == []
