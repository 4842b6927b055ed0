"""Registered queries that write exports, read them back and go on with them, each with its DuckDB SQL.

Exports of every known source are made from ``documents``, written to the shared folder in the format and
with the column names of that source, read by the tolerant readers, recognised by their columns alone,
mapped onto the canonical schema and dated. Logs, snapshots, slices and checkpoints are stored likewise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.eventlog import EventLog, last_of
from tesserae.functions import text as tx
from tesserae.operators import agreement as ag
from tesserae.operators import analytics as an
from tesserae.operators import classify as cl
from tesserae.operators import coding as cd
from tesserae.operators import export as ex
from tesserae.operators import filters as fl
from tesserae.operators import merge as mg
from tesserae.operators import network as nw
from tesserae.operators import sampling as sm
from tesserae.operators import search as se
from tesserae.plans import boolean as bq
from tesserae.plans import catalog as ca
from tesserae.schema import apply_mapping, one_to_one, suggest_mapping, validate_mapping
from tesserae.session import kept, scratch, table
from tesserae.sources import adapters as ad
from tesserae.sources import ingest as ig
from tesserae.storage import Store, cached

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# --- exports of every source --------------------------------------------------------------------------

_BASE = """b AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source AS src, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS day,
 doc_id % 97 AS n1, n_chars AS n2 FROM documents)"""


def base(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(365)).cast("int")), "yyyy-MM-dd")
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", "lang", F.col("source").alias("src"), day.alias("day"), (F.col("doc_id") % 97).alias("n1"), F.col("n_chars").alias("n2")
    )


#: Of each source: the file, the separator, and the export's columns by what they hold (or a fixed text after =).
EXPORTS: dict[str, tuple[str, str, dict[str, str]]] = {
    "brandwatch": ("bw_export.csv", ";", {"Query Name": "=q", "Resource Id": "id", "Full Text": "text", "Date": "day", "Author": "src", "Language": "lang", "Sentiment": "=neutral", "Twitter Likes": "n2", "Twitter Retweets": "n1"}),
    "twitter": ("tweets.csv", ",", {"id": "id", "text": "text", "created_at": "day", "user_screen_name": "src", "retweet_count": "n1", "favorite_count": "n2", "lang": "lang"}),
    "meta": ("posts.tsv", "\t", {"id": "id", "Page Name": "=page", "User Name": "src", "Message": "text", "Post Created": "day", "Total Interactions": "n1", "Likes": "n2", "Shares": "n1", "lang": "lang"}),
    "tiktok": ("videos.jsonl", "", {"video_id": "id", "video_description": "text", "create_time": "day", "username": "src", "like_count": "n2", "share_count": "n1", "play_count": "n1", "region_code": "lang"}),
    "youtube": ("list.jsonl", "", {"videoId": "id", "title": "text", "publishedAt": "day", "channelTitle": "src", "viewCount": "n1", "likeCount": "n2"}),
    "reddit": ("dump.ndjson", "", {"id": "id", "title": "text", "selftext": "=more", "author": "src", "subreddit": "src", "created_utc": "day", "score": "n2", "num_comments": "n1"}),
    "mastodon": ("toots.jsonl", "", {"id": "id", "content": "text", "created_at": "day", "account.acct": "src", "favourites_count": "n2", "reblogs_count": "n1", "replies_count": "n1", "language": "lang"}),
    "news": ("articles.csv", "|", {"id": "id", "url": "id", "title": "text", "seendate": "day", "domain": "src", "sourcecountry": "lang", "language": "lang"}),
    "generic": ("table.parquet", "", {"Message ID": "id", "Tweet": "text", "Posted At": "day", "Handle": "src", "Lang": "lang", "Upvotes": "n2", "Reblogs": "n1"}),
}

#: What the canonical columns must hold then: author, language, likes, shares, platform and source type as SQL.
WANTED: dict[str, tuple[str, str, str, str, str, str]] = {
    "brandwatch": ("src", "lang", "n2", "n1", "'brandwatch'", "NULL"),
    "twitter": ("src", "lang", "n2", "n1", "'twitter'", "'post'"),
    "meta": ("src", "lang", "n2", "n1", "'facebook'", "NULL"),
    "tiktok": ("src", "NULL", "n2", "n1", "'tiktok'", "'video'"),
    "youtube": ("NULL", "NULL", "n2", "NULL", "'youtube'", "'video'"),
    "reddit": ("src", "NULL", "n2", "NULL", "src", "'post'"),
    "mastodon": ("src", "lang", "n2", "n1", "'mastodon'", "NULL"),
    "news": ("src", "lang", "NULL", "NULL", "'news'", "'article'"),
    "generic": ("src", "lang", "n2", "n1", "NULL", "NULL"),
}


def exported(rows: DataFrame, source: str, compression: str = "none") -> str:
    """Write ``rows`` as an export of ``source``; returns its path. Text files are packed with a ``compression``."""
    name, sep, columns = EXPORTS[source]
    of = lambda what: F.lit(what[1:]) if what.startswith("=") else F.col(what)
    nested: dict[str, list] = {}
    out = []
    for column, what in columns.items():
        if "." in column:
            nested.setdefault(column.split(".")[0], []).append(of(what).alias(column.split(".")[1]))
        else:
            out.append(of(what).alias(column))
    made = rows.select(*out, *[F.struct(*fields).alias(parent) for parent, fields in nested.items()])
    path = f"{scratch(rows.sparkSession, source)}/{name}"
    kind = ig.ending(name)
    if kind == "csv":
        ex.write_csv(made, path, sep=sep, compression=compression)
    elif kind == "jsonl":
        ex.write_json(made, path, compression)
    else:
        made.write.parquet(path)
    return path


def _source(source: str):
    def run(spark, d):
        raw = ig.read_any(spark, exported(base(spark, d), source))
        known = ad.detect(raw.columns)[0][0]
        rows = ad.normalize(raw, known)
        day = F.date_format(mg.parsed_date(F.col("created_at")), "yyyy-MM-dd")
        return rows.select(
            F.lit(known).alias("adapter"), "post_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "author_handle", "language",
            day.alias("day"), "like_count", "share_count", "platform", "source_type",
        )

    return run


for _name, (_author, _lang, _likes, _shares, _platform, _type) in WANTED.items():
    query(
        f"WITH {_BASE} SELECT '{_name}' AS adapter, id AS post_id, md5(text) AS text_md5, CAST({_author} AS VARCHAR) AS author_handle, CAST({_lang} AS VARCHAR) AS language, day,"
        f" CAST({_likes} AS BIGINT) AS like_count, CAST({_shares} AS BIGINT) AS share_count, CAST({_platform} AS VARCHAR) AS platform, CAST({_type} AS VARCHAR) AS source_type FROM b",
        f"source_{_name}",
    )(_source(_name))


@query("SELECT s AS source, s AS detected, (SELECT count(*) FROM documents) AS rows FROM (SELECT unnest(['brandwatch', 'twitter', 'meta', 'tiktok', 'youtube', 'reddit', 'mastodon', 'news', 'generic']) AS s)")
def detect_sources(spark, d):
    """Each export of the documents, packed, is read back and recognised by its columns; all its rows are counted."""
    out = None
    for source in EXPORTS:
        raw = ig.read_any(spark, exported(base(spark, d), source, "gzip"))
        one = raw.agg(F.lit(source).alias("source"), F.lit(ad.detect(raw.columns)[0][0]).alias("detected"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _headed(spark: SparkSession, d: str, columns: dict[str, str]) -> DataFrame:
    """The documents as a CSV file with these headers, read back; blank cells are null then."""
    path = f"{scratch(spark, 'headed')}/table.csv"
    ex.write_csv(base(spark, d).select(*[F.col(what).alias(name) for name, what in columns.items()]), path, sep=",")
    raw = ig.read_csv(spark, path)
    return raw.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def _filled(raw: DataFrame) -> DataFrame:
    """(column, filled): how many rows have something in a column."""
    counts = raw.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(raw.columns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(raw.columns)])).alias("x")).select("x.*")


@query(f"""WITH {_BASE}, f AS (SELECT count(id) AS id, count(nullif(text, '')) AS text, count(nullif(src, '')) AS src, count(nullif(lang, '')) AS lang, count(day) AS day, count(n1) AS n1, count(n2) AS n2 FROM b)
SELECT t."column", field, how, filled FROM f, (VALUES ('Message ID', 'post_id', 'alias', id), ('Body', 'text', 'alias', text), ('Posted At', 'created_at', 'alias', day), ('HANDLE', 'author_handle', 'alias', src), ('user.Lang', 'language', 'alias', lang),
 ('upvotes', 'like_count', 'alias', n2), ('Retweet Counts', 'share_count', 'similar', n1), ('zzz', NULL, 'none', n1), ('own', 'url', 'adapter', id)) AS t("column", field, how, filled)""")
def suggest_mapping_rows(spark, d):
    """What each column of a file of all documents is taken for, and how many rows fill it."""
    raw = _headed(spark, d, {"Message ID": "id", "Body": "text", "Posted At": "day", "HANDLE": "src", "user.Lang": "lang", "upvotes": "n2", "Retweet Counts": "n1", "zzz": "n1", "own": "id"})
    told = suggest_mapping(raw.columns, {"OWN": "url"})
    field = F.create_map(*[x for c, m in told.items() for x in (F.lit(c), F.struct(F.lit(m.canonical).cast("string").alias("field"), F.lit(m.how).alias("how")))])
    return _filled(raw).select("column", field[F.col("column")]["field"].alias("field"), field[F.col("column")]["how"].alias("how"), "filled")


@query("""SELECT kind, name, field, n FROM (SELECT count(*) AS a, count(nullif(text, '')) AS t FROM documents), (VALUES ('kept', 'ID', 'post_id', a), ('kept', 'Body', 'text', t), ('problem', 'missing_required:text', NULL, NULL), ('problem', 'duplicate_target:url', NULL, NULL)) AS v(kind, name, field, n)""")
def mapping_checks(spark, d):
    """The columns of a file of all documents that a mapping keeps, with the rows that they fill after it, and the problems of a bad one."""
    raw = _headed(spark, d, {"ID": "id", "Tweet Id": "id", "Body": "text", "Textt": "src"})
    kept = one_to_one(suggest_mapping(raw.columns))
    rows = apply_mapping(raw, kept)
    counts = rows.agg(*[F.count(f).alias(c) for c, f in kept.items()])
    found = F.array(*[F.struct(F.lit("kept").alias("kind"), F.lit(c).alias("name"), F.lit(f).cast("string").alias("field"), F.col(c).alias("n")) for c, f in kept.items()])
    wrong = [(p,) for p in validate_mapping(dict(zip(raw.columns, ["post_id", "url", "url"], strict=False)))]
    problems = F.array(*[F.struct(F.lit("problem").alias("kind"), F.lit(p).alias("name"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("long").alias("n")) for (p,) in wrong])
    return counts.select(F.explode(F.concat(found, problems)).alias("x")).select("x.*")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def json_scan(spark, d):
    """One JSON object whose list of nested objects is the table."""
    nations = table(spark, d, "nation")
    one = nations.groupBy().agg(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("meta"))).alias("items"))
    path = f"{scratch(spark, 'json')}/nations.json"
    one.select(F.to_json(F.struct("items")).alias("value")).coalesce(1).write.text(path)
    rows = ig.read_json(spark, path)
    return rows.select(F.col("key").cast("long").alias("key"), F.col("`meta.name`").alias("name"), F.col("`meta.region.key`").cast("long").alias("region"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, s_acctbal AS balance, s_suppkey % 2 = 0 AS even, CASE WHEN s_suppkey % 3 > 0 THEN ' <' || s_name || '>' || chr(10) || '_x0041_ &' END AS note FROM supplier")
def xlsx_round_trip(spark, d):
    """The suppliers as spreadsheets and back."""
    rows = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), (F.col("s_suppkey") % 2 == 0).alias("even"),
        F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit(" <"), "s_name", F.lit(">\n_x0041_ &"))).alias("note"),
    )
    path = f"{scratch(spark, 'sheets')}/suppliers.xlsx"
    ex.write_xlsx(rows, path)
    return ig.read_any(spark, path).select("key", "name", F.col("balance").cast("double").alias("balance"), F.col("even").cast("boolean").alias("even"), "note")


#: Of each encoding, words that its files hold beside the suppliers' names.
SAID = {"windows-1252": "“Crème brûlée” – 5 €, così", "iso-8859-2": "Zażółć gęślą jaźń, příliš žluťoučký", "utf-16-le": "naïve Ωμέγα", "shift_jis": "これはテストの文章です", "utf-8": "plain Ünïcode ✓"}


@query("SELECT unnest(['" + "', '".join(SAID) + "']) AS encoding, unnest(['" + "', '".join(SAID.values()) + "']) AS said, count(*) AS rows, count(DISTINCT s_name) AS names FROM supplier")
def charset_scan(spark, d):
    """The suppliers as CSV files in five encodings, none of them marked, each recognised and read back."""
    out = None
    for encoding, said in SAID.items():
        rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(said).alias("said"))
        path = f"{scratch(spark, 'encoded')}/suppliers.csv"
        if encoding.startswith("utf-16"):
            ex.write_csv(rows, path, bom=False, encoding="UTF-16LE")
        else:  # the bytes of the encoding as Latin-1 letters, which are written as just these bytes
            as_bytes = F.pandas_udf(lambda cells, e=encoding: cells.map(lambda t: t.encode(e).decode("latin-1")), "string")
            ex.write_csv(rows.withColumn("said", as_bytes("said")), path, bom=False, encoding="ISO-8859-1")
        raw = ig.read_csv(spark, path)
        part = raw.agg(F.lit(encoding).alias("encoding"), F.max("said").alias("said"), F.count("*").alias("rows"), F.count_distinct("name").alias("names"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT s_suppkey AS key, 'é; ' || s_name AS name FROM supplier")
def latin_csv_scan(spark, d):
    """A CSV in Latin-1 with semicolons, encoding and separator found from its first bytes."""
    path = f"{scratch(spark, 'latin')}/suppliers.csv"
    ex.write_csv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("é; "), "s_name").alias("name")), path, bom=False, sep=";", encoding="ISO-8859-1")
    return ig.read_csv(spark, path).select(F.col("key").cast("long").alias("key"), "name")


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id, md5(text) AS text_md5, lang AS language FROM documents")
def csv_sink(spark, d):
    path = f"{scratch(spark, 'sink')}/corpus.csv"
    ex.write_csv(ca.posts(spark, d).select("post_id", "text", "language"), path)
    return ig.read_csv(spark, path).select("post_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "language")


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id, md5(text) AS text_md5, lang AS language FROM documents")
def json_sink(spark, d):
    path = f"{scratch(spark, 'sink')}/corpus.jsonl"
    ex.write_json(ca.posts(spark, d).select("post_id", "text", "language"), path)
    return ig.read_any(spark, path).select("post_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "language")


# --- the corpus ---------------------------------------------------------------------------------------

_NEAR = ca._NEAR


@query(f"""WITH k AS ({_NEAR}), t AS (SELECT k.doc_id % 10 = 0 AS again, k.k FROM k) SELECT 'first' AS source_dataset, (SELECT count(*) FILTER (length(k) < 8) + count(DISTINCT k) FILTER (length(k) >= 8) FROM t) AS n
UNION ALL SELECT 'second', (SELECT count(*) FILTER (again AND length(k) < 8) FROM t) HAVING (SELECT count(*) FILTER (again AND length(k) < 8) FROM t) > 0
UNION ALL SELECT 'rows numbered', (SELECT count(*) FILTER (length(k) < 8) + count(DISTINCT k) FILTER (length(k) >= 8) + count(*) FILTER (again AND length(k) < 8) FROM t)""")
def build_corpus(spark, d):
    """Two datasets, the second a tenth of the first under other ids, united, deduplicated and numbered."""
    rows = base(spark, d)
    again = rows.where("CAST(id AS BIGINT) % 10 = 0").withColumn("id", F.concat(F.lit("again "), "id"))
    sets = []
    for name, df, source in (("first", rows, "twitter"), ("second", again, "generic")):
        raw = ig.read_any(spark, exported(df, source))
        sets.append(mg.Dataset(name, raw, ad.mapping_for(raw.columns, source), source))
    corpus = mg.build_corpus(sets)
    dense = corpus.agg(F.lit("rows numbered").alias("source_dataset"), F.when((F.min("_row_idx") == 0) & (F.max("_row_idx") == F.count("*") - 1), F.count_distinct("_row_idx")).alias("n"))
    return corpus.groupBy("source_dataset").agg(F.count("*").alias("n")).unionByName(dense)


@query("SELECT CAST(0 AS BIGINT) AS blank_ids, CAST(count(*) FILTER (doc_id % 11 = 0) AS BIGINT) AS bad_dates FROM documents")
def bad_dates(spark, d):
    rows = ca.posts(spark, d).withColumn("created_at", F.when(F.col("_row_idx") % 11 == 0, "not a date").otherwise("2024-02-29 10:11:12"))
    return mg.quality_flags(rows).select(F.col("duplicate_ids").alias("blank_ids"), "bad_dates")


@query("SELECT doc_id AS _row_idx FROM documents WHERE contains(lower(coalesce(text, '')), 'the ') AND lower(lang) = 'en' AND n_chars >= 300 AND n_chars <= 4000")
def filter_conjunction(spark, d):
    return fl.apply(ca.posts(spark, d), fl.FilterSpec(text="The ", members={"language": ["en"]}, ranges={"view_count": (300, 4000)})).select("_row_idx")


@query("SELECT doc_id AS _row_idx, CAST(doc_id AS VARCHAR) AS post_id FROM documents WHERE doc_id = 17")
def row_fetch(spark, d):
    return fl.row(ca.posts(spark, d), 17).select("_row_idx", "post_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id, lang AS language, n_chars AS view_count, source AS source_dataset FROM documents")
def export_projection(spark, d):
    return fl.projected(ca.posts(spark, d), export=True).select("post_id", "language", "view_count", "source_dataset")


_THE, _OF = ca._W.format("the"), ca._W.format("of")


@query(f"SELECT doc_id AS _row_idx FROM documents WHERE {_THE} AND {_OF}")
def bool_near(spark, d):
    return bq.matching(ca.posts(spark, d), "the NEAR of").select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM documents WHERE contains(lower(coalesce(text, '')), 'of the') AND contains(CAST(doc_id AS VARCHAR), '7')")
def bool_unterminated_quote(spark, d):
    return bq.matching(ca.posts(spark, d), 'id:7 "of the').select("_row_idx")


@query("SELECT count(*) AS n FROM documents")
def bool_empty(spark, d):
    return bq.matching(ca.posts(spark, d), "  ").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS _row_idx FROM documents WHERE ({_THE} OR lang = 'de') AND NOT contains(lower(source), 'src1')")
def bool_builder(spark, d):
    """The same query from the tree that a visual builder sends."""
    node = bq.compose(bq.compose(bq.parse("the"), "or", bq.parse("lang:de")), "and_not", bq.parse("dataset:src1"))
    return bq.matching(ca.posts(spark, d), node).select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM documents WHERE lang = 'en' ORDER BY md5('7:' || doc_id), doc_id LIMIT 40")
def sample_spec(spark, d):
    return sm.run(ca.posts(spark, d), sm.SampleSpec.from_dict({"method": "random", "n": "40", "seed": 7, "query": "lang:en"})).select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 60")
def sample_scope(spark, d):
    return sm.scope_sample(ca.posts(spark, d), 60).select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)")
def slice_from_indices(spark, d):
    return sm.from_indices(ca.posts(spark, d), table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("_row_idx"))).select("_row_idx")


@query("SELECT CAST(count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS hits, CAST(count(*) FILTER (doc_id % 3 <> 0) AS BIGINT) AS misses FROM documents")
def cache_lookup(spark, d):
    rows = ca.posts(spark, d).select("_row_idx", F.col("post_id").alias("key"))
    cache = rows.where("_row_idx % 3 = 0").select("key", F.lit("a").alias("answer"), F.lit(1).alias("seq"))
    hits, misses = cached(rows, cache.unionByName(cache.withColumn("seq", F.lit(2))))
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))  # one row each


# --- analytics ----------------------------------------------------------------------------------------

_LIST = "lang || ', ' || source || ' ' || lang"


@query(f"SELECT value, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array({_LIST}, '[,\\s]+'), lambda x: trim(x) <> '')) AS value FROM documents) GROUP BY value ORDER BY n DESC, value LIMIT 12")
def list_column_counts(spark, d):
    rows = ca.posts(spark, d).select(F.concat("language", F.lit(", "), "source_dataset", F.lit(" "), "language").alias("tags"))
    return an.top_counts(an.exploded(rows, "tags"), "item", 12).select("value", "n")


@query("""WITH c AS (SELECT lang AS row, source AS col, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT * FROM c WHERE row IN (SELECT row FROM c GROUP BY row ORDER BY sum(n) DESC, row LIMIT 3)),
 t AS (SELECT * FROM k WHERE col IN (SELECT col FROM k GROUP BY col ORDER BY sum(n) DESC, col LIMIT 5)), z AS (SELECT count(DISTINCT lang) > 3 AS r, count(DISTINCT source) > 5 AS c FROM documents)
SELECT 'row' AS axis, row AS value, CAST(sum(n) AS BIGINT) AS n, any_value(z.r) AS truncated FROM t, z GROUP BY row UNION ALL SELECT 'col', col, CAST(sum(n) AS BIGINT), any_value(z.c) FROM t, z GROUP BY col UNION ALL SELECT 'all', 'all', CAST(sum(n) AS BIGINT), any_value(z.r OR z.c) FROM t, z""")
def crosstab_margins(spark, d):
    return an.crosstab_margins(ca.posts(spark, d), "language", "source_dataset", 3, 5)


@query(f"WITH {ca._TAGS} SELECT (SELECT count(*) FROM documents) AS rows, count(DISTINCT _row_idx) AS tagged, count(*) AS tags, count(DISTINCT coder) AS coders, count(DISTINCT cat_id) AS categories, count(DISTINCT _row_idx) AS hand_rows, CAST(0 AS BIGINT) AS ai_rows FROM tags")
def export_preview(spark, d):
    n = ex.export_counts(ca.posts(spark, d), ca.tags(spark, d))
    return spark.createDataFrame([tuple(n[k] for k in ("rows", "tagged", "tags", "coders", "categories", "hand_rows", "ai_rows"))], "rows long, tagged long, tags long, coders long, categories long, hand_rows long, ai_rows long")


@query("SELECT round(avg(length(coalesce(text, ''))), 6) AS mean, quantile_cont(CAST(length(coalesce(text, '')) AS DOUBLE), 0.9) AS p90, CAST(count(*) FILTER (doc_id % 2 = 0) AS BIGINT) AS with_media FROM documents")
def corpus_summary(spark, d):
    rows = ca.posts(spark, d).withColumn("media_url", F.when(F.col("_row_idx") % 2 == 0, "http://m"))
    return an.corpus_features(rows)["lengths"].select(ca.r6("mean").alias("mean"), "p90", "with_media")


@query("SELECT doc_id AS _row_idx, array_to_string([lower(x) FOR x IN regexp_extract_all('@' || source || ' and @Ann_' || doc_id || ' a@b', '@([A-Za-z0-9_]{1,30})', 1)], '|') AS mentions FROM documents")
def mentions(spark, d):
    rows = ca.posts(spark, d).select("_row_idx", F.concat(F.lit("@"), "source_dataset", F.lit(" and @Ann_"), "post_id", F.lit(" a@b")).alias("t"))
    return rows.select("_row_idx", F.array_join(tx.mentions(F.col("t")), "|").alias("mentions"))


@query("SELECT doc_id AS _row_idx, substr(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) AS slug FROM documents")
def slugs(spark, d):
    return ca.posts(spark, d).select("_row_idx", tx.slug(F.coalesce("text", F.lit(""))).alias("slug"))


@query("SELECT doc_id AS _row_idx, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE substr(sha1(doc_id || ':' || coalesce(text, '')), 1, 16) END AS key FROM documents")
def row_keys(spark, d):
    rows = ca.posts(spark, d).withColumn("post_id", F.when(F.col("_row_idx") % 2 == 0, F.col("post_id")).otherwise(" "))
    return rows.select("_row_idx", tx.row_key(rows.columns).alias("key"))


@query("""WITH t AS (SELECT doc_id, translate(substr(coalesce(text, ''), 1, 200), '{}[]`"', '      ') AS p FROM documents)
SELECT doc_id AS _row_idx, CASE doc_id % 3 WHEN 0 THEN '{"a": "' || p || '"}' WHEN 1 THEN '[' || doc_id || ', {"p": 1}]' END AS json FROM t""")
def json_from_prose(spark, d):
    """JSON among the words of each document: in a fence, bare, or not at all."""
    said = F.translate(F.substring(F.coalesce("text", F.lit("")), 1, 200), '{}[]`"', "      ")
    fenced = F.concat(said, F.lit(':\n```json\n{"a": "'), said, F.lit('"}\n``` '), said)
    bare = F.concat(said, F.lit(" ["), "post_id", F.lit(', {"p": 1}] '), said)
    kind = F.col("_row_idx") % 3
    return ca.posts(spark, d).select("_row_idx", tx.json_block(F.when(kind == 0, fenced).when(kind == 1, bare).otherwise(said)).alias("json"))


@query("SELECT round(least(1, sum(value) FILTER (event_type = 'view') / 1000), 6) AS share, count(*) AS n FROM events GROUP BY user_id % 10")
def score_merge(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("k")).agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("v"), F.count("*").alias("n"))
    scores = F.create_map(F.lit("a"), F.col("v") / 2000, F.lit("b"), F.col("v") / 4000, F.lit("c"), F.col("v") / 4000, F.lit("z"), F.lit(0.5))
    return e.select(F.round(F.try_element_at(cd.merge_scores(scores, ["b", "c"], "a"), F.lit("a")), 6).alias("share"), "n")


# --- coding -------------------------------------------------------------------------------------------


@query(f"WITH {ca._EVENTS} SELECT seq FROM e WHERE batch NOT IN (SELECT DISTINCT batch FROM e ORDER BY batch DESC LIMIT 3)")
def redo(spark, d):
    return cd.redone(ca._tag_events(spark, d), 5, 2).select("seq")


@query(f"SELECT 'edit' AS kind, count(*) AS n FROM documents WHERE {_THE} UNION ALL SELECT 'dry run', count(*) FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)")
def bulk_tag(spark, d):
    """A bulk edit by a query, and the dry run of one by a slice, which goes before its query."""
    p = ca.posts(spark, d)
    edit = cd.bulk(cd.scope(p, query="the"), "good", "ann", "cb", 7)
    dry = cd.scope(p, slice_rows=table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("_row_idx")), query="the")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(edit.where("batch = 7 AND action = 'tag'"), "edit").unionByName(count(dry, "dry run"))


@query(f"WITH {ca._TAGS} SELECT CASE WHEN cat_id = 'good' THEN 'fine' ELSE cat_id END AS cat_id, count(*) AS n FROM tags WHERE cat_id <> 'toxic' GROUP BY 1")
def category_rename_delete(spark, d):
    gone = spark.createDataFrame([("toxic",)], "cat_id string")
    return cd.rename_category(cd.delete_categories(ca.tags(spark, d), gone), "good", "fine").groupBy("cat_id").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id AS _row_idx, event_type AS cat_id, event_id AS place, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'g' END AS grp FROM events)
SELECT _row_idx, cat_id, place FROM t QUALIFY row_number() OVER (PARTITION BY _row_idx, coalesce('g:' || grp, 'c:' || cat_id) ORDER BY place DESC) = 1""")
def exclusion_last_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("_row_idx"), F.col("event_type").alias("cat_id"), F.col("event_id").alias("place"))
    groups = spark.createDataFrame([("view", "g"), ("click", "g"), ("purchase", "g")], "cat_id string, exclusion_group string")
    return cd.exclusive(e, groups, first_wins=False)


@query("""WITH m AS (SELECT user_id AS _row_idx, event_type, event_id % 50 AS memo, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id DESC) = 1)
SELECT CAST(memo AS VARCHAR) AS memo_id, _row_idx, event_type AS coder FROM m WHERE event_type = 'click'""")
def memo_list(spark, d):
    return cd.memos(_memo_log(spark, d), coder="click", contains="T").select("memo_id", "_row_idx", "coder")


def _memo_log(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 50).cast("string").alias("memo_id"), F.when(F.col("event_type") == "purchase", "delete").otherwise("edit").alias("action"),
        F.col("user_id").alias("_row_idx"), F.col("event_type").alias("coder"), F.lit("text").alias("text"), F.lit("cb").alias("codebook_id"), F.col("ts").cast("string").alias("ts"),
    )


@query("""WITH m AS (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id DESC) = 1) SELECT event_type AS coder, count(*) AS memos FROM m WHERE event_type <> 'purchase' GROUP BY 1""")
def memos_by_coder(spark, d):
    return cd.memos_by_coder(cd.memos(_memo_log(spark, d)))


@query("SELECT user_id AS _row_idx, arg_max(event_type, event_id) AS cat_id, CAST(max(event_id) AS VARCHAR) AS note FROM events GROUP BY user_id")
def adjudications(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("_row_idx"), F.col("event_id").alias("seq"), F.col("event_type").alias("cat_id"), F.lit("j").alias("judge"), F.col("event_id").cast("string").alias("note"))
    return ag.adjudications(log).select("_row_idx", "cat_id", "note")


_ALPHA, _KAPPA = ca.ORACLE["alpha"], ca.ORACLE["kappa"]


@query(f"SELECT round(avg(alpha), 5) AS alpha, count(alpha) AS categories FROM ({_ALPHA})")
def mean_alpha(spark, d):
    return ag.mean_alpha(ag.alpha(ca.tags(spark, d), ca.categories(spark))).select(F.round("alpha", 5).alias("alpha"), "categories")


@query(f"SELECT round(sum(kappa * weight) / sum(weight), 5) AS kappa FROM ({_KAPPA})")
def mean_kappa(spark, d):
    return ag.mean_kappa(ag.kappa(ca.tags(spark, d), ca.categories(spark), "human", "length")).select(F.round("kappa", 5).alias("kappa"))


@query(f"SELECT 'alpha' AS method, cat_id, round(alpha, 5) AS value FROM ({_ALPHA})")
def agreement_method(spark, d):
    """Three coders, so the method is alpha."""
    method, told = ag.agreement(ca.tags(spark, d), ca.categories(spark))
    return told.select(F.lit(method).alias("method"), "cat_id", F.round("alpha", 5).alias("value"))


@query(f"WITH {ca._REPLIES}, n AS (SELECT node, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT src AS node, weight FROM g UNION ALL SELECT tgt, weight FROM g) GROUP BY node) SELECT node, degree FROM n ORDER BY degree DESC, node LIMIT 20")
def degree_top(spark, d):
    return nw.degree(ca._replies(spark, d)).orderBy(F.desc("degree"), "node").limit(20)


@query("SELECT doc_id AS _row_idx FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20")
def topic_sample_rows(spark, d):
    p = ca.posts(spark, d)
    return cd.topic_rows(p.select("_row_idx", F.col("language").alias("topic_id")), p, "fr").select("_row_idx")


@query("SELECT user_id AS k, round(sum((event_id % 1000) * CAST(3 AS DOUBLE) + (event_id % 100) * CAST(15 AS DOUBLE) + (event_id % 10) * CAST(3.75 AS DOUBLE)) / 1000000, 8) AS cost FROM events GROUP BY user_id")
def usage_cost(spark, d):
    e = table(spark, d, "events")
    cost = cl.usage_cost({"input": 3.0, "output": 15.0, "cache_write": 3.75}, input=F.col("event_id") % 1000, output=F.col("event_id") % 100, cache_write=F.col("event_id") % 10)
    return e.groupBy(F.col("user_id").alias("k")).agg(F.round(F.sum(cost), 8).alias("cost"))


# --- search and storage -------------------------------------------------------------------------------


@query(ca.ORACLE["tfidf_search"])
def tfidf_index(spark, d):
    """The search of ``tfidf_search`` from a stored index."""
    path = scratch(spark, "index")
    se.build_index(ca.posts(spark, d), path)
    return se.search_index(spark, path, "with that onouea", 20).select("_row_idx", ca.r6("score").alias("score"))


@query(ca.ORACLE["tfidf_search"])
def tfidf_segments(spark, d):
    """The search of ``tfidf_search`` from an index of two segments: half of the table, and the rest added."""
    from tesserae.operators import segments as sg

    path, rows = scratch(spark, "segments"), ca.posts(spark, d)
    sg.add(rows.where("_row_idx % 2 = 0"), path)
    sg.add(rows.where("_row_idx % 2 = 1"), path)
    return sg.Searcher(spark, path).search("with that onouea", 20).select(F.col("row").alias("_row_idx"), ca.r6("score").alias("score"))


@query("SELECT doc_id AS _row_idx, lang AS language FROM documents WHERE n_chars > 800 AND lang = 'de'")
def snapshot_scan(spark, d):
    store = Store(spark, scratch(spark, "store"))
    sid = store.create_snapshot(ca.posts(spark, d), ["documents"], {"near": True})
    return store.open_snapshot(sid, "view_count > 800 AND language = 'de'", ["_row_idx", "language"])


@query("SELECT lang AS language, count(*) AS n FROM documents WHERE n_chars > 700 GROUP BY lang")
def snapshot_sql(spark, d):
    store = Store(spark, scratch(spark, "store"))
    sid = store.create_snapshot(ca.posts(spark, d), ["documents"], {})
    return store.sql(sid, "SELECT language, count(*) AS n FROM corpus WHERE view_count > :least GROUP BY language", least=700)


@query("SELECT * FROM (VALUES ('again', 'same'), ('active', 'second'), ('activated twice', 'no'), ('slice', 'stale'), ('purged', 'first'), ('left', 'second')) AS t(step, told)")
def snapshot_life(spark, d):
    store = Store(spark, scratch(spark, "store"))
    p = ca.posts(spark, d)
    first = store.create_snapshot(p, ["documents"], {"k": 1})
    again = store.create_snapshot(p, ["documents"], {"k": 1})
    second = store.create_snapshot(p.where("language = 'en'"), ["documents"], {"k": 2})
    store.activate(first)
    store.freeze("s", p.where("language = 'de'"))
    frozen = store.frozen("s").count() == p.where("language = 'de'").count()
    store.activate(second)
    try:
        store.frozen("s").count()
        told = "valid"
    except ValueError:
        told = "stale" if frozen else "lost"
    names = {first: "first", second: "second"}
    out = [("again", "same" if first == again else "new"), ("active", names[store.active()]), ("activated twice", "yes" if store.activate(second) else "no"), ("slice", told)]
    out += [("purged", ",".join(names[x] for x in store.purge_snapshots([]))), ("left", ",".join(names[r.snapshot_id] for r in store.snapshots().collect()))]
    return spark.createDataFrame(out, "step string, told string")


@query(ca.ORACLE["chunks_overlap"])
def split_slices(spark, d):
    """The chunks of ``chunks_overlap``, each frozen as a slice and read back."""
    store = Store(spark, scratch(spark, "store"))
    store.activate(store.create_snapshot(ca.posts(spark, d), ["documents"], {}))
    names = store.split("part", sm.equal_chunks(ca.posts(spark, d), 3, 42, 20), 3)
    out = None
    for i, name in enumerate(names):
        part = store.frozen(name).withColumn("chunk", F.lit(i).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {ca._TAGS} SELECT _row_idx, coder, cat_id FROM tags WHERE cat_id <> 'bad'")
def checkpoint_revert(spark, d):
    """Eleven checkpoints of which ten stay; the tags of the oldest one left are back."""
    store = Store(spark, scratch(spark, "store"))
    t = ca.tags(spark, d)
    store.checkpoint("cb", t.limit(1), "first")
    kept = store.checkpoint("cb", t.where("cat_id <> 'bad'"), "second")
    for k in range(9):
        store.checkpoint("cb", t.limit(1), f"later {k}")
    ids = store.checkpoints("cb")
    if len(ids) != 10 or ids[0] != kept:
        raise RuntimeError("the last ten checkpoints should be left")
    return store.reverted("cb", kept).select("_row_idx", "coder", "cat_id")


@query(ca.ORACLE["tag_state"])
def tag_log_replay(spark, d):
    """Tags that stand by a log of four batches, of which three were compacted into a snapshot."""
    log = EventLog(spark, scratch(spark, "log"), last_of(*cd.KEY))
    events = ca._tag_events(spark, d)
    for i in range(4):
        log.append(events.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == i))
        if i == 2:
            log.compact()
    return cd.current(log.replay()).select("_row_idx", "cat_id", "coder", "seq")


@query()
def topics_factors(spark, d):
    """Topics of all documents by non-negative factorisation; SQL has no such rounds, a test holds it against numpy."""
    from tesserae.operators import factors as fa

    posts = ca.posts(spark, d)
    known = kept(se.vocabulary(posts, min_df=5), "vocabulary").orderBy("term")
    sent = spark.sparkContext.broadcast(known.select("term").toArrow().column("term").combine_chunks())  # 100,000 terms at most
    cells = kept(se.numbered_rows(posts, sent), "cells")
    return fa.assigned(fa.factorise_rows(cells, known, topics=4, rounds=4)).select("row", "topic", ca.r6("share").alias("share"))
