"""Detection, mapping and reading of exports."""

import gzip
import json

import pytest

from tesserae.operators import merge
from tesserae.schema import CANONICAL, apply_mapping, suggest_mapping, validate_mapping
from tesserae.sources import adapters, ingest

FIXTURES = {
    "brandwatch": ("Query Name,Date,Full Text,Sentiment,Author,Language,Country,URL,Twitter Retweets,Twitter Likes,Page Type", 0.95),
    "twitter": ("url,date,content,renderedContent,id,user.username,user.displayname,replyCount,retweetCount,likeCount,lang", 0.9),
    "meta": ("Page Name,User Name,Facebook Id,Page Category,Post Created,Type,Total Interactions,Likes,Comments,Shares,Message,Link,URL", 0.95),
    "tiktok": ("video_id,create_time,region_code,video_description,username,like_count,comment_count,share_count,view_count,play_count,hashtag_names", 0.95),
    "youtube": ("videoId,title,description,publishedAt,channelTitle,channelId,viewCount,likeCount,commentCount", 0.95),
    "reddit": ("id,title,selftext,subreddit,author,created_utc,score,num_comments,permalink", 0.95),
    "mastodon": ("id,created_at,content,account.username,account.acct,favourites_count,reblogs_count,replies_count,language,url", 0.95),
    "news": ("url,title,seendate,domain,sourcecountry,language", 0.85),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_detection(name):
    columns, least = FIXTURES[name]
    best = adapters.detect(columns.split(","), f"test_{name}.csv")[0]
    assert best[0] == name and best[1] >= least
    scores = dict(adapters.detect("My Custom ID,Posted On,Body,Who Said It,Stars".split(","), "test_generic.csv"))
    assert scores["reddit"] == 0.158 and scores["generic"] == 0.15


def test_mapping():
    got = {c: m.canonical for c, m in suggest_mapping(["Tweet ID", "user.screen name", "Likes Count", "nonsense", "Ｔｅｘｔ"]).items()}
    assert got == {"Tweet ID": "post_id", "user.screen name": "author_handle", "Likes Count": "like_count", "nonsense": None, "Ｔｅｘｔ": "text"}
    assert adapters.mapping_for(["content", "renderedContent", "id"], "twitter") == {"content": "text", "id": "post_id"}
    assert validate_mapping({"a": "text", "b": "text"}) == ["missing_required:post_id", "duplicate_target:text"]


def test_apply_mapping(spark):
    df = spark.createDataFrame([("7", "12.0", "a, b", "x")], "ID string, likes string, tags string, other string")
    r = apply_mapping(df, {"id": "post_id", "likes": "like_count", "tags": "hashtags", "missing": "text"}, {"platform": "p"}).first()
    assert (r.post_id, r.like_count, r.hashtags, r.text, r.platform) == ("7", 12, ["a", "b"], None, "p") and list(r.asDict()) == list(CANONICAL)


def test_readers(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data.encode() if isinstance(data, str) else data)
        return f"file://{tmp_path}/{name}"

    csv = "﻿id;text; ;n\n1;a;z;2\n2;b\n3;c;z;4;5\n4;\"q;\n\"\"r\"\"\";z;1\n"
    got = ingest.read_any(spark, put("a.csv", csv))
    assert got.columns == ["id", "text", "n"]
    assert sorted(map(tuple, got.collect())) == [("1", "a", "2"), ("2", "b", None), ("4", 'q;\n"r"', "1")]
    assert [tuple(r) for r in ingest.read_any(spark, put("b.tsv", "x\ty,z\n1\t2\n")).collect()] == [("1", "2")]
    latin = ingest.read_any(spark, put("c.csv", "a,b\nché,1\nzü,2\n".encode("latin-1")))
    assert {r.a for r in latin.collect()} == {"ché", "zü"}
    lines = ingest.read_any(spark, put("d.jsonl", '{"id": 1, "user": {"name": "x", "geo": {"c": 1}}}\nbroken\n{"id": 2}\n'))
    assert set(lines.columns) == {"id", "user.name", "user.geo.c"} and {r.id for r in lines.collect()} >= {1, 2}
    assert {r.id for r in ingest.read_any(spark, put("e.json", json.dumps([{"id": 1}, {"id": 2}]))).collect()} == {1, 2}
    assert {r.id for r in ingest.read_any(spark, put("f.json", json.dumps({"n": 2, "data": [{"id": 1}, {"id": 3}]}))).collect()} == {1, 3}
    assert ingest.file_digest(spark, put("g.txt", "abc")) == "a9993e364706816aba3e25717850c26c9cd0d89d"
    with pytest.raises(ValueError):
        ingest.ending("x.exe")
    assert gzip and ingest.demo(spark).distinct().count() == 300
    assert ingest.demo(spark).collect() == ingest.demo(spark.newSession()).collect()


def test_corpus_from_two_exports(spark):
    tw = spark.createDataFrame([("1", "Hello world friends", "2026-03-14T10:00:00Z", "5"), ("1", "again", "2026-03-15T10:00:00Z", "x"), ("2", "hello, WORLD friends! http://t.co/1", "2026-03-16", None)], "id string, text string, created_at string, retweet_count string")
    rd = spark.createDataFrame([("9", "Ein Beitrag", "news", 1767225600), (None, "no id here", "b", 1767225600)], "id string, title string, subreddit string, created_utc long")
    sets = [merge.Dataset("t.csv", tw, adapters.by_id("twitter").columns, "twitter", adapters.by_id("twitter").defaults), merge.Dataset("r.csv", rd, adapters.by_id("reddit").columns, "reddit")]
    got = merge.build_corpus(sets).orderBy("_row_idx").collect()
    assert [(r._row_idx, r.post_id, r.platform, r.share_count, str(r.created_at)) for r in got] == [
        (0, "1", "twitter", 5, "2026-03-14 10:00:00"), (1, "9", "news", None, "2026-01-01 00:00:00"), (2, None, "b", None, "2026-01-01 00:00:00"),
    ]
    stats = merge.merge_stats(merge.united(sets), "_set", "_line").first()
    assert tuple(stats) == (5, 1, 1, 3)


def test_dates(spark):
    df = spark.createDataFrame([("03/04/2026",), ("14/03/2026",)], "d string")
    assert merge.is_day_first(df, "d")
    got = [str(r[0])[:10] for r in df.select(merge.parsed_date(df.d, True)).collect()]
    assert got == ["2026-04-03", "2026-03-14"]
    shapes = ["2026-01-02", "2026-01-02T03:04:05Z", "20260102T030405Z", "1767323045", "1767323045000", "2026-01-02 03:04", "Fri Jan 02 03:04:05 +0000 2026", "nope", None]
    got = [r[0] and str(r[0])[:10] for r in spark.createDataFrame([(s,) for s in shapes], "d string").select(merge.parsed_date(__import__("pyspark.sql.functions").sql.functions.col("d"))).collect()]
    assert got == ["2026-01-02"] * 7 + [None, None]


def test_only_texts_that_composition_may_change_go_to_python(spark, monkeypatch):
    """Of every character that stays in the JVM, composition changes nothing, whatever stands before it."""
    import re
    import sys
    import unicodedata

    from pyspark.sql import functions as F

    from tesserae.functions import text as tx

    may = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), tx.MAY_COMPOSE))
    stays = [chr(c) for c in range(sys.maxunicode + 1) if not may.match(chr(c))]
    assert set("äß€“é’—") <= set(stays) and not set("ﬁ½e\u0301"[:2] + "\u0301\u1100") & set(stays)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in stays for b in stays)
    rows = [(0, "Crème “brûlée” – 5 €"), (1, None), (2, "ﬁne e\u0301"), (3, "plain")]
    df = spark.createDataFrame(rows, "i int, t string").orderBy("i")
    assert [r.t for r in df.select(tx.composed(F.col("t")).alias("t")).collect()] == ["Crème “brûlée” – 5 €", None, "fine é", "plain"]
    sent = []
    monkeypatch.setattr(tx, "nfkc", lambda c: sent.append(str(c)) or c)
    tx.dedup_key(F.col("t"))
    assert len(sent) == 1 and "RLIKE" in sent[0].upper()
