"""Registered corpus queries, each with the DuckDB SQL that gives the same rows.

The driver's tables stand in for a corpus: ``documents`` are posts (language, source), ``events`` are
dated posts with an author and a count, labels and rules are coders, ``conversations`` hold replies.
Floating results are rounded to six places on both sides, as sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import agreement as ag
from tesserae.operators import analytics as an
from tesserae.operators import coding as cd
from tesserae.operators import filters as fl
from tesserae.operators import layout as lo
from tesserae.operators import merge as mg
from tesserae.operators import network as nw
from tesserae.operators import paths as pt
from tesserae.operators import sampling as sm
from tesserae.operators import search as se
from tesserae.operators import similar as si
from tesserae.plans import boolean as bq
from tesserae.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("_row_idx"), F.col("doc_id").cast("string").alias("post_id"), "text", F.col("lang").alias("language"),
        F.col("source").alias("source_dataset"), F.col("n_chars").alias("view_count"),
    )


def dated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("_row_idx"), F.col("event_id").cast("string").alias("post_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("user_id").cast("string").alias("author_handle"), F.col("event_type").alias("platform"), F.col("value").alias("like_count"),
    )


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Three coders of the labelled documents: the labels, and two rules on the text."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    said = F.array(
        F.struct(F.lit("human").alias("coder"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("cat_id")),
        F.struct(F.lit("length").alias("coder"), F.when(F.col("n_chars") > 500, "good").otherwise("bad").alias("cat_id")),
        F.struct(F.lit("place").alias("coder"), F.when(F.col("doc_id") % 7 != 0, "good").otherwise("toxic").alias("cat_id")),
        F.struct(F.lit("human").alias("coder"), F.when(F.col("toxic") == 1, "toxic").alias("cat_id")),
    )
    one = rows.select(F.col("doc_id").alias("_row_idx"), "n_chars", F.explode(said).alias("s")).where("s.cat_id IS NOT NULL")
    return one.select("_row_idx", "s.coder", "s.cat_id", F.lit("cb").alias("codebook_id"), (F.col("n_chars") % 100 / 100.0).alias("confidence"))


_TAGS = """tags AS (
  SELECT doc_id AS _row_idx, coder, cat_id, CAST((n_chars % 100) AS DOUBLE) / 100 AS confidence FROM (
    SELECT l.doc_id, d.n_chars, unnest([
      {'coder': 'human', 'cat_id': CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END},
      {'coder': 'length', 'cat_id': CASE WHEN d.n_chars > 500 THEN 'good' ELSE 'bad' END},
      {'coder': 'place', 'cat_id': CASE WHEN l.doc_id % 7 <> 0 THEN 'good' ELSE 'toxic' END},
      {'coder': 'human', 'cat_id': CASE WHEN toxic = 1 THEN 'toxic' END}], recursive := true)
    FROM labels l JOIN documents d USING (doc_id)) WHERE cat_id IS NOT NULL)"""


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("good", "Good"), ("bad", "Bad"), ("toxic", "Toxic")], "cat_id string, title string")


# --- boolean queries and filters --------------------------------------------------------------------

_W = "regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_]){}([^\\p{{L}}\\p{{N}}_]|$)')"


@query(f"SELECT lang AS language, count(*) AS n FROM documents WHERE ({_W.format('the')} OR {_W.format('der')}) AND NOT lang = 'fr' GROUP BY lang")
def bool_query(spark, d):
    return bq.matching(posts(spark, d), "(the OR der) AND NOT lang:fr").groupBy("language").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS _row_idx FROM documents WHERE ({_W.format('th[\\p{L}\\p{N}_]*ing')} OR contains(lower(text), 'in the')) AND lang = 'en' AND contains(lower(source), 'src1')")
def bool_query_field(spark, d):
    return bq.matching(posts(spark, d), '(th*ing OR "in the") language:EN source:src1').select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM documents WHERE contains(lower(coalesce(text, '')), 'that the')")
def filter_text(spark, d):
    return fl.apply(posts(spark, d), fl.FilterSpec(text="THAT the")).select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)(^|\\n)the and')")
def filter_regex(spark, d):
    return fl.apply(posts(spark, d), fl.FilterSpec(text=r"(^|\n)the and", regex=True)).select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM documents WHERE lower(lang) IN ('de', 'fr')")
def filter_in(spark, d):
    return fl.apply(posts(spark, d), fl.FilterSpec(members={"language": ["DE", " fr", ""], "country": ["x"]})).select("_row_idx")


@query("SELECT event_id AS _row_idx FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def filter_range_date(spark, d):
    return fl.apply(dated(spark, d), fl.FilterSpec(date_from="2024-01-05", date_to="2024-01-09")).select("_row_idx")


@query("SELECT doc_id AS _row_idx FROM documents WHERE n_chars >= 500 AND n_chars <= 1500")
def filter_range_num(spark, d):
    return fl.apply(posts(spark, d), fl.FilterSpec.from_dict({"ranges": {"view_count": {"min": "500", "max": 1500}, "nope": {"min": 1}}})).select("_row_idx")


@query("SELECT doc_id AS _row_idx, n_chars AS view_count FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25 OFFSET 25")
def sort_page(spark, d):
    return fl.page(fl.ordered(posts(spark, d), "view_count", True).select("_row_idx", "view_count"), 2, 25)


# --- counts and descriptions ------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'language' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT 'source_dataset', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 15""")
def facets(spark, d):
    return an.facets(posts(spark, d))


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type ORDER BY n DESC, value LIMIT 3")
def top_counts(spark, d):
    return an.top_counts(dated(spark, d), "platform", 3).select("value", "n", r6("share").alias("share"))


@query("SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def describe_numeric(spark, d):
    s = an.numeric_summary(table(spark, d, "lineitem"), "l_extendedprice")
    return s.select("n", r6("mean").alias("mean"), r6("median").alias("median"), F.round("total", 2).alias("total"), "low", "high")


@query("SELECT count(DISTINCT user_id) AS authors FROM events")
def unique_authors(spark, d):
    return an.unique_authors(dated(spark, d))


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS author, sum(value) AS total FROM events GROUP BY user_id HAVING sum(value) > 0),
 t AS (SELECT * FROM s ORDER BY total DESC, author LIMIT 10) SELECT author, round(total, 6) AS total, round(total / sum(total) OVER (), 6) AS share FROM t""")
def top_authors_engagement(spark, d):
    return an.top_authors_by(dated(spark, d), "like_count").select("author", r6("total").alias("total"), r6("share").alias("share"))


@query("""SELECT count(*) AS texts, round(avg(length(text)), 6) AS mean, round(quantile_cont(CAST(length(text) AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(length(text) AS DOUBLE), 0.95), 6) AS p95
FROM documents WHERE trim(coalesce(text, '')) <> ''""")
def text_length(spark, d):
    return an.text_length(posts(spark, d)).select("texts", *[r6(c).alias(c) for c in ("mean", "median", "p95")])


@query("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, round(date_diff('microsecond', min(ts), max(ts)) / CAST(86400000000 AS DOUBLE), 6) AS span_days FROM events")
def date_coverage(spark, d):
    c = an.date_coverage(dated(spark, d))
    return c.select(*[F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x) for x in ("first", "last")], r6("span_days").alias("span_days"))


_CROSS = """WITH c AS (SELECT lang AS row, source AS col, count(*) AS n FROM documents GROUP BY ALL),
 k AS (SELECT * FROM c WHERE row IN (SELECT row FROM c GROUP BY row ORDER BY sum(n) DESC, row LIMIT 3)),
 t AS (SELECT * FROM k WHERE col IN (SELECT col FROM k GROUP BY col ORDER BY sum(n) DESC, col LIMIT 5)) SELECT row, col, {} AS value FROM t"""


@query(_CROSS.format("n"))
def crosstab_counts(spark, d):
    return an.crosstab(posts(spark, d), "language", "source_dataset", None, 3, 5)


_AUTHORS = "SELECT CAST(user_id AS VARCHAR) AS author, count(*) AS n, sum(value) AS total FROM events GROUP BY 1"


@query(f"""WITH a AS ({_AUTHORS}), p AS (SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, item LIMIT 5),
 h AS (SELECT item, count(*) AS n FROM (SELECT unnest([event_type, 'u' || user_id % 10]) AS item FROM events) GROUP BY 1), hs AS (SELECT item, n, n / (SELECT sum(n) FROM h) AS share FROM h ORDER BY n DESC, item LIMIT 5),
 t AS (SELECT author, n, n / (SELECT sum(n) FROM a) AS share FROM a ORDER BY n DESC, author LIMIT 5), e AS (SELECT author, total FROM a WHERE total > 0 ORDER BY total DESC, author LIMIT 5), l AS (SELECT CAST(length(props) AS DOUBLE) AS x FROM events)
SELECT section, item, n, round(value, 6) AS value FROM (
 SELECT 'rows' AS section, 'rows' AS item, NULL AS n, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'authors', 'authors', NULL, count(*) FROM a
 UNION ALL SELECT 'top_authors', author, n, share FROM t UNION ALL SELECT 'facet:platform', item, n, NULL FROM p UNION ALL SELECT 'hashtags', item, n, share FROM hs UNION ALL SELECT 'authors_by_engagement', author, NULL, total FROM e
 UNION ALL SELECT 'like_count', unnest(['n', 'mean', 'median', 'total', 'low', 'high']), NULL, unnest([count(value), avg(value), quantile_cont(value, 0.5), sum(value), min(value), max(value)]) FROM events
 UNION ALL SELECT 'text_length', unnest(['texts', 'mean', 'median', 'p95']), NULL, unnest([count(x), avg(x), quantile_cont(x, 0.5), quantile_cont(x, 0.95)]) FROM l
 UNION ALL SELECT 'dates', 'span_days', NULL, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000 FROM events)""")
def descriptives(spark, d):
    """All parts of a corpus description, from two scans."""
    made = table(spark, d, "events").select(F.col("event_id").alias("_row_idx"), F.col("props").alias("text"), F.concat_ws(",", "event_type", F.concat(F.lit("u"), F.col("user_id") % 10)).alias("hashtags"))
    return an.described(dated(spark, d).join(made, "_row_idx"), 5).withColumn("value", r6("value"))


def _crosstab_norm(how: str):
    def run(spark, d):
        return an.crosstab(posts(spark, d), "language", "source_dataset", how, 3, 5).withColumn("value", r6("value"))

    return run


for _how, _over in (("row", "PARTITION BY row"), ("col", "PARTITION BY col"), ("all", "")):
    query(_CROSS.format(f"round(n / sum(n) OVER ({_over}), 6)"), f"crosstab_norm_{_how}")(_crosstab_norm(_how))


def _series(step: str):
    def run(spark, d):
        return an.timeseries(dated(spark, d), step).select("bucket", F.col("value").cast("long").alias("value"))

    return run


for _step in ("hour", "day", "week", "month", "quarter", "year"):
    _b = f"date_trunc('{_step}', ts)" + (" + INTERVAL 6 DAY" if _step == "week" else "")
    _f = "%Y-%m-%d %H:%M" if _step == "hour" else "%Y-%m-%d"
    query(f"SELECT strftime(CAST({_b} AS TIMESTAMP), '{_f}') AS bucket, count(*) AS value FROM events GROUP BY 1", f"ts_{_step}")(_series(_step))

_GROUPED = """WITH e AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, event_type, coalesce(value, 0) AS x FROM events),
 b AS (SELECT event_type FROM e GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 2)
SELECT bucket, CASE WHEN event_type IN (FROM b) THEN event_type ELSE 'Other' END AS grp, {} AS value FROM e GROUP BY ALL"""


@query(_GROUPED.format("count(*)"))
def ts_group_topk_other(spark, d):
    return an.timeseries(dated(spark, d), "day", "platform", 2)


@query(_GROUPED.format("round(sum(x), 6)"))
def ts_sum(spark, d):
    return an.timeseries(dated(spark, d), "day", "platform", 2, "sum", "like_count").withColumn("value", r6("value"))


@query(_GROUPED.format("round(avg(x), 6)"))
def ts_mean(spark, d):
    return an.timeseries(dated(spark, d), "day", "platform", 2, "mean", "like_count").withColumn("value", r6("value"))


_TOKEN = "regexp_extract_all(lower(text), '[#@]?[a-zÀ-ɏ][a-zÀ-ɏ''’\\-]+')"
_GRAMS = """WITH w AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
 g AS (SELECT doc_id, unnest([array_to_string(w[i:i+{n}-1], ' ') FOR i IN range(1, len(w) - {n} + 2)]) AS gram FROM w)
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs, round(count(DISTINCT doc_id) / (SELECT count(text) FROM documents), 6) AS doc_share
FROM g GROUP BY gram HAVING count(*) >= {least} ORDER BY n DESC, gram LIMIT 50"""


def _ngrams(n: int, least: int = 1, stop: list[str] | None = None):
    def run(spark, d):
        return an.ngrams(posts(spark, d), n, 50, least, stop).withColumn("doc_share", r6("doc_share"))

    return run


for _n, _name in ((1, "unigrams"), (2, "bigrams"), (3, "trigrams")):
    query(_GRAMS.format(words=_TOKEN, n=_n, least=_n), _name)(_ngrams(_n, _n))
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.stopwords())
query(_GRAMS.format(words=f"list_filter({_TOKEN}, lambda x: x NOT IN ({_STOP}))", n=2, least=1), "ngrams_stopwords")(_ngrams(2, 1, tx.stopwords()))


@query("""WITH f AS (SELECT lang, CAST(count(*) AS DOUBLE) AS rows, avg(n_chars) AS m FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang),
 x AS (SELECT 'rows' AS metric, max(rows) FILTER (lang = 'de') AS a, max(rows) FILTER (lang = 'fr') AS b FROM f
  UNION ALL SELECT 'mean_view_count', max(m) FILTER (lang = 'de'), max(m) FILTER (lang = 'fr') FROM f UNION ALL SELECT 'authors', 0, 0)
SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS diff, round((b - a) / nullif(a, 0), 6) AS relative FROM x""")
def compare(spark, d):
    p = posts(spark, d)
    out = an.compare(p.where("language = 'de'"), p.where("language = 'fr'"))
    return out.select("metric", *[r6(c).alias(c) for c in ("a", "b", "diff", "relative")])


@query("""SELECT 'language' AS name, count(DISTINCT lang) AS "distinct" FROM documents UNION ALL SELECT 'source_dataset', count(DISTINCT source) FROM documents
UNION ALL SELECT 'text', count(DISTINCT text) FROM documents UNION ALL SELECT '_row_idx', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'post_id', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'view_count', count(DISTINCT n_chars) FROM documents""")
def column_profile(spark, d):
    return an.column_profile(posts(spark, d)).select("name", "distinct")


# --- merging and deduplication ----------------------------------------------------------------------


@query("SELECT source, kind, count(*) AS n FROM (SELECT source, 'a' AS kind FROM documents UNION ALL SELECT lang, 'b' FROM documents) GROUP BY ALL")
def union_merge(spark, d):
    a = table(spark, d, "documents")
    both = a.select("source", F.lit("a").alias("kind")).unionByName(a.select(F.col("lang").alias("source"), F.lit("b").alias("kind")))
    return both.groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS _row_idx FROM documents WHERE trim(coalesce(source, '')) <> '' GROUP BY trim(source) UNION ALL SELECT doc_id FROM documents WHERE trim(coalesce(source, '')) = ''")
def dedupe_exact(spark, d):
    return mg.dedupe_exact(posts(spark, d), "_row_idx", key="source_dataset").select("_row_idx")


_KEY = "substr(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), 'ς', 'σ'), 'https?://\\S+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 600)"
_NEAR = f"SELECT doc_id, {_KEY} AS k FROM documents"


@query(f"SELECT doc_id AS _row_idx FROM ({_NEAR}) WHERE length(k) < 8 UNION ALL SELECT min(doc_id) FROM ({_NEAR}) WHERE length(k) >= 8 GROUP BY k")
def dedupe_near(spark, d):
    return mg.dedupe_near(posts(spark, d), "_row_idx").select("_row_idx")


@query(f"""WITH k AS ({_NEAR}), n AS (SELECT count(*) FILTER (length(k) < 8) + count(DISTINCT k) FILTER (length(k) >= 8) AS left_ FROM k)
SELECT (SELECT count(*) FROM documents) AS rows_in, CAST(0 AS BIGINT) AS exact_removed, (SELECT count(*) FROM documents) - left_ AS near_removed, left_ AS rows_out FROM n""")
def merge_stats(spark, d):
    return mg.merge_stats(posts(spark, d), "_row_idx")


@query("SELECT CAST(sum(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_text, count(*) - count(DISTINCT source) - max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS duplicate_ids FROM documents")
def quality_flags(spark, d):
    return mg.quality_flags(posts(spark, d).withColumn("post_id", F.col("source_dataset"))).select("blank_text", "duplicate_ids")


@query("""WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS s FROM orders) SELECT o_orderkey AS _row_idx, strftime(strptime(s, '%d.%m.%Y'), '%Y-%m-%d') AS day FROM x""")
def date_parse_day_first(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row_idx"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("s"))
    return x.select("_row_idx", F.date_format(mg.parsed_date(F.col("s"), mg.is_day_first(x, "s", order=("_row_idx",))), "yyyy-MM-dd").alias("day"))


# --- samples and slices -----------------------------------------------------------------------------


@query("SELECT doc_id AS _row_idx FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def sample_random(spark, d):
    return sm.random_sample(posts(spark, d), 100).select("_row_idx")


_QUOTA = """WITH c AS (SELECT coalesce(lang, '__missing__') AS stratum, count(*) AS size FROM documents GROUP BY 1),
 q AS (SELECT *, least(50, sum(size) OVER ()) * size / sum(size) OVER () AS raw, sum(size) OVER () AS total FROM c),
 r AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, stratum) AS rank FROM q),
 quotas AS (SELECT stratum, size, CAST(base + CASE WHEN rank <= least(50, total) - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r)"""


@query(f"{_QUOTA} SELECT stratum, size, quota FROM quotas")
def sample_quotas(spark, d):
    return sm.quotas(posts(spark, d), 50, "language")


@query(f"""{_QUOTA}, k AS (SELECT doc_id, quota, row_number() OVER (PARTITION BY coalesce(lang, '__missing__') ORDER BY md5('42:' || doc_id), doc_id) AS rn
 FROM documents JOIN quotas ON stratum = coalesce(lang, '__missing__')) SELECT doc_id AS _row_idx FROM k WHERE rn <= quota""")
def sample_stratified(spark, d):
    return sm.stratified_sample(posts(spark, d), 50, "language").select("_row_idx")


@query("SELECT doc_id AS _row_idx, n_chars AS view_count FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 30")
def sample_topn(spark, d):
    return sm.top_n(posts(spark, d), 30, "view_count").select("_row_idx", "view_count")


@query("SELECT doc_id AS _row_idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) % 7 = 0")
def sample_systematic(spark, d):
    return sm.systematic_sample(posts(spark, d), 7).select("_row_idx")


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
 c AS (SELECT *, CAST(round(n * 0.2) AS BIGINT) AS k FROM p), s AS (SELECT *, (n - k) // 3 AS size, (n - k) % 3 AS extra, i - k AS pos FROM c)
SELECT doc_id AS _row_idx, unnest(CASE WHEN pos < 0 THEN [0, 1, 2] WHEN pos < extra * (size + 1) THEN [pos // (size + 1)] ELSE [extra + (pos - extra * (size + 1)) // size] END)::BIGINT AS chunk FROM s""")
def chunks_overlap(spark, d):
    return sm.equal_chunks(posts(spark, d), 3, 42, 20).select("_row_idx", "chunk")


@query("SELECT min(doc_id) AS _row_idx FROM documents GROUP BY lower(trim(coalesce(text, '')))")
def sample_dedupe(spark, d):
    return sm.distinct_texts(posts(spark, d)).select("_row_idx")


_A, _B = _W.format("the"), "lang = 'en'"


def _composed(glue: str):
    def run(spark, d):
        return bq.matching(posts(spark, d), bq.compose(bq.parse("the"), glue, bq.parse("lang:en"))).select("_row_idx")

    return run


for _glue, _sql in (("and", f"{_A} AND {_B}"), ("or", f"{_A} OR {_B}"), ("and_not", f"{_A} AND NOT {_B}"), ("or_not", f"{_A} OR NOT {_B}")):
    query(f"SELECT doc_id AS _row_idx FROM documents WHERE {_sql}", f"slice_{_glue}")(_composed(_glue))


@query(f"SELECT count(*) FILTER ({_A} AND {_B}) AS both, count(*) FILTER ({_A} AND NOT {_B}) AS a_only, count(*) FILTER ({_B} AND NOT {_A}) AS b_only, count(*) FILTER ({_A} OR {_B}) AS either FROM documents")
def slice_diff(spark, d):
    p = posts(spark, d)
    return sm.slice_counts(p, bq.to_column(bq.parse("the"), p), bq.to_column(bq.parse("lang:en"), p))


@query("SELECT doc_id AS _row_idx FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM documents)")
def slice_unique(spark, d):
    rows = table(spark, d, "labels").withColumnRenamed("doc_id", "_row_idx")
    return sm.unique_to(posts(spark, d), rows.where("toxic = 1"), rows.where("quality = 1")).select("_row_idx")


# --- coding and agreement ---------------------------------------------------------------------------


@query(f"WITH {_TAGS} SELECT d.doc_id AS _row_idx, coalesce((SELECT string_agg(DISTINCT upper(cat_id[1]) || cat_id[2:], ' + ' ORDER BY upper(cat_id[1]) || cat_id[2:]) FROM tags t WHERE t._row_idx = d.doc_id), '') AS tag FROM documents d")
def tags_join(spark, d):
    return cd.attach_tags(posts(spark, d), tags(spark, d), categories(spark)).select("_row_idx", "tag")


@query(f"WITH {_TAGS} SELECT 'category' AS kind, cat_id AS name, count(*) AS n FROM tags GROUP BY cat_id UNION ALL SELECT 'coder', coder, count(DISTINCT _row_idx) FROM tags GROUP BY coder UNION ALL SELECT 'rows', 'rows', count(DISTINCT _row_idx) FROM tags")
def progress(spark, d):
    p = cd.progress(tags(spark, d))
    out = p["by_category"].select(F.lit("category").alias("kind"), F.col("cat_id").alias("name"), "n")
    out = out.unionByName(p["by_coder"].select(F.lit("coder").alias("kind"), F.col("coder").alias("name"), "n"))
    return out.unionByName(p["rows"].select(F.lit("rows").alias("kind"), F.lit("rows").alias("name"), F.col("rows_tagged").alias("n")))


_EVENTS = "e AS (SELECT event_id AS seq, event_id // 3 AS batch, CASE WHEN event_type = 'purchase' OR event_id % 5 = 0 THEN 'untag' ELSE 'tag' END AS action, user_id AS _row_idx, event_type AS cat_id, CAST(event_id % 2 AS VARCHAR) AS coder, CASE WHEN event_type IN ('view', 'click') THEN 'g' END AS grp FROM events)"


def _tag_events(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).alias("batch"), F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 5 == 0), "untag").otherwise("tag").alias("action"),
        F.col("user_id").alias("_row_idx"), F.col("event_type").alias("cat_id"), (F.col("event_id") % 2).cast("string").alias("coder"), F.lit("cb").alias("codebook_id"),
        F.when(F.col("event_type").isin("view", "click"), "g").alias("group"),
    )


@query(f"""WITH {_EVENTS}, s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY _row_idx, coder, cat_id ORDER BY seq DESC) = 1),
 t AS (SELECT * FROM s WHERE action = 'tag' QUALIFY row_number() OVER (PARTITION BY _row_idx, coder, coalesce('g:' || grp, 'c:' || cat_id) ORDER BY seq DESC) = 1)
SELECT _row_idx, cat_id, coder, seq FROM t""")
def tag_state(spark, d):
    return cd.current(_tag_events(spark, d)).select("_row_idx", "cat_id", "coder", "seq")


@query(f"WITH {_EVENTS} SELECT seq FROM e WHERE batch NOT IN (SELECT DISTINCT batch FROM e ORDER BY batch DESC LIMIT 5)")
def undo(spark, d):
    return cd.undone(_tag_events(spark, d), 5).select("seq")


@query(f"WITH {_TAGS} SELECT DISTINCT _row_idx, coder, CASE WHEN cat_id = 'bad' THEN 'toxic' ELSE cat_id END AS cat_id FROM tags")
def cat_merge(spark, d):
    return cd.merge_categories(tags(spark, d), ["bad"], "toxic").select("_row_idx", "coder", "cat_id")


_VOTES = f"""WITH {_TAGS}, t AS (SELECT DISTINCT _row_idx, coder FROM tags), c AS (SELECT unnest(['good', 'bad', 'toxic']) AS cat_id),
 v AS (SELECT t._row_idx, t.coder, c.cat_id, CASE WHEN EXISTS (SELECT 1 FROM tags g WHERE g._row_idx = t._row_idx AND g.coder = t.coder AND g.cat_id = c.cat_id) THEN 1 ELSE 0 END AS yes FROM t, c)"""


@query(f"""{_VOTES}, p AS (SELECT x.cat_id, x.yes AS a, y.yes AS b FROM v x JOIN v y ON x._row_idx = y._row_idx AND x.cat_id = y.cat_id WHERE x.coder = 'human' AND y.coder = 'length'),
 n AS (SELECT cat_id, count(*) AS n, CAST(sum(a * b) AS DOUBLE) AS n11, CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(b) AS DOUBLE) AS sb FROM p GROUP BY cat_id),
 k AS (SELECT *, (n - sa - sb + 2 * n11) / n AS po, (sa / n) * (sb / n) + (1 - sa / n) * (1 - sb / n) AS pe FROM n)
SELECT cat_id, n, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa, CAST(greatest(1, sa + sb - n11) AS BIGINT) AS weight FROM k""")
def kappa(spark, d):
    return ag.kappa(tags(spark, d), categories(spark), "human", "length").withColumn("kappa", r6("kappa"))


@query(f"""{_VOTES}, u AS (SELECT _row_idx, cat_id, CAST(count(*) AS DOUBLE) AS m, CAST(sum(yes) AS DOUBLE) AS y FROM v GROUP BY ALL HAVING count(*) >= 2),
 s AS (SELECT cat_id, sum(m) AS n, sum(y) AS y, sum(m - y) AS z, sum(2 * y * (m - y) / (m - 1)) AS a FROM u GROUP BY cat_id)
SELECT cat_id, CAST(n AS BIGINT) AS "values", round(CASE WHEN y * z = 0 THEN 1 ELSE 1 - (a / n) / (2 * y * z / (n * (n - 1))) END, 6) AS alpha FROM s""")
def alpha(spark, d):
    return ag.alpha(tags(spark, d), categories(spark)).withColumn("alpha", r6("alpha"))


@query(f"WITH {_TAGS}, t AS (SELECT DISTINCT _row_idx, coder FROM tags) SELECT x.coder AS a, y.coder AS b, count(*) AS shared FROM t x JOIN t y ON x._row_idx = y._row_idx AND x.coder <= y.coder GROUP BY ALL")
def coder_overlap(spark, d):
    return ag.coder_overlap(tags(spark, d))


@query(f"""WITH {_TAGS}, s AS (SELECT _row_idx, coder, string_agg(DISTINCT cat_id, '+' ORDER BY cat_id) AS cats FROM tags GROUP BY ALL)
SELECT _row_idx, count(DISTINCT cats) AS kinds, count(*) AS coders, string_agg(DISTINCT cats, ' | ' ORDER BY cats) AS sets FROM s GROUP BY _row_idx HAVING count(DISTINCT cats) > 1""")
def conflicts(spark, d):
    return ag.conflicts(tags(spark, d))


@query(f"""WITH {_TAGS}, r AS (SELECT _row_idx, confidence AS c, max(cat_id) FILTER (coder = 'length') AS told, max(cat_id) FILTER (coder = 'place') AS human FROM tags GROUP BY ALL)
SELECT _row_idx, round(CASE WHEN c < 0.6 THEN CAST(0.6 AS DOUBLE) ELSE 0 END + CASE WHEN c BETWEEN 0.45 AND 0.65 THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN human <> told THEN CAST(0.5 AS DOUBLE) ELSE 0 END, 6) AS uncertainty
FROM r ORDER BY uncertainty DESC, _row_idx LIMIT 40""")
def uncertainty(spark, d):
    of = lambda coder: F.max(F.when(F.col("coder") == coder, F.col("cat_id")))
    rows = tags(spark, d).groupBy("_row_idx", F.col("confidence").alias("ai_confidence")).agg(of("length").alias("ai_category"), of("place").alias("human_category"))
    return ag.most_uncertain(rows, 40).select("_row_idx", r6("uncertainty").alias("uncertainty"))


@query("""WITH s AS (SELECT * FROM documents WHERE doc_id % 3 = 0), p AS (SELECT source, count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY source),
 q AS (SELECT source, count(*) / sum(count(*)) OVER () AS q FROM s GROUP BY source)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS distance FROM p FULL JOIN q USING (source)""")
def tv_distance(spark, d):
    p = posts(spark, d)
    return ag.variation_distance(p, p.where("_row_idx % 3 = 0"), "source_dataset").select(r6("distance").alias("distance"))


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders), s AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders WHERE o_orderkey % 40 = 0)
SELECT count(*) AS months, count(*) FILTER (m NOT IN (FROM s)) AS missing FROM m""")
def month_coverage(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    return ag.missing_months(o, o.where("o_orderkey % 40 = 0"))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS rn, count(*) OVER () AS n, sum(value) OVER () AS t FROM events WHERE value IS NOT NULL)
SELECT round(sum(value) / any_value(t), 6) AS share FROM r WHERE rn <= greatest(1, n // 10)""")
def top_decile(spark, d):
    return ag.top_decile_share(dated(spark, d), "like_count").select(r6("share").alias("share"))


@query(f"WITH {_TAGS} SELECT count(*) AS rows, count(*) FILTER (cat_id NOT IN ('good', 'bad')) AS unknown, count(*) FILTER (confidence < 0 OR confidence > 1) AS out_of_range, count(*) FILTER (confidence < 0.4) AS low FROM tags")
def guardrails(spark, d):
    return ag.guardrails(tags(spark, d), ["good", "bad"])


@query("SELECT CASE WHEN lang IN ('es', 'fr') THEN 'romance' ELSE lang END AS topic_id, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def topic_merge(spark, d):
    given = posts(spark, d).where("language IS NOT NULL").select("_row_idx", F.col("language").alias("topic_id"))
    return cd.merge_topics(given, ["es", "fr"], "romance").groupBy("topic_id").agg(F.count("*").alias("n"))


@query("SELECT t.topic_id, count(d.doc_id) AS n FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'other']) AS topic_id) t LEFT JOIN documents d ON d.lang = t.topic_id GROUP BY 1")
def topic_counts(spark, d):
    topics = spark.createDataFrame([(t,) for t in ("de", "en", "es", "fr", "other")], "topic_id string")
    return cd.topic_counts(posts(spark, d).select("_row_idx", F.col("language").alias("topic_id")), topics)


# --- search, graphs and features --------------------------------------------------------------------


_TERMS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), t AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))])) AS term FROM w),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
 idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.9 * n),
 q AS (SELECT term, count(*) AS c FROM (SELECT unnest(['with', 'that', 'onouea', 'with that', 'that onouea']) AS term) GROUP BY term), m AS (SELECT term, (1 + ln(c)) * idf AS w FROM q JOIN idf USING (term))"""


@query(f"""WITH {_TERMS}, s AS (SELECT doc_id, sum(coalesce(m.w, 0) / (SELECT sqrt(sum(w * w)) FROM m) * (1 + ln(tf)) * idf) / sqrt(sum(((1 + ln(tf)) * idf) ** 2)) AS score
 FROM tf JOIN idf USING (term) LEFT JOIN m USING (term) GROUP BY doc_id) SELECT doc_id AS _row_idx, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 20""")
def tfidf_search(spark, d):
    return se.search(posts(spark, d), "with that onouea", 20).select("_row_idx", r6("score").alias("score"))


@query(f"WITH {_TAGS} SELECT cat_id, _row_idx, coder FROM tags WHERE coder = 'human' QUALIFY row_number() OVER (PARTITION BY cat_id ORDER BY confidence DESC, _row_idx) <= 5")
def quotes_topk(spark, d):
    return se.quotes_by_confidence(tags(spark, d).where("coder = 'human'"), 5).select("cat_id", "_row_idx", "coder")


@query(f"WITH {_TAGS} SELECT cat_id, _row_idx FROM tags WHERE coder = 'human' QUALIFY row_number() OVER (PARTITION BY cat_id ORDER BY md5('42:' || _row_idx), _row_idx) <= 3")
def quotes_random(spark, d):
    return se.random_quotes(tags(spark, d).where("coder = 'human'"), 3).select("cat_id", "_row_idx")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS row, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT query, row, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, row) <= 5""")
def embedding_knn(spark, d):
    v = table(spark, d, "embeddings")
    return se.nearest(v, v.where("vec_id % 20 = 0")).select("query", "row", r6("similarity").alias("similarity"))


_MENTION = "[lower(event_type), CAST(user_id % 50 AS VARCHAR), CAST(user_id % 7 AS VARCHAR)]"


@query(f"""WITH n AS (SELECT list_sort(list_distinct({_MENTION})) AS n FROM events), p AS (SELECT unnest(flatten([[{{'src': n[i], 'tgt': n[j]}} FOR j IN range(i + 1, len(n) + 1)] FOR i IN range(1, len(n) + 1)]), recursive := true) FROM n)
SELECT src, tgt, count(*) AS weight FROM p GROUP BY ALL HAVING count(*) >= 2""")
def comention(spark, d):
    e = table(spark, d, "events").select(F.array(F.col("event_type"), (F.col("user_id") % 50).cast("string"), (F.col("user_id") % 7).cast("string")).alias("mentions"))
    return nw.comentions(e)


_REPLIES = "r AS (SELECT a.role || a.conv_id % 9 AS src, b.role || b.conv_id % 5 AS tgt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1), g AS (SELECT src, tgt, count(*) AS weight FROM r WHERE src <> tgt GROUP BY ALL)"


def _replies(spark, d):
    c = table(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.concat("role", (F.col("conv_id") % 9).cast("string")).alias("author_handle"))
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat("role", (F.col("conv_id") % 5).cast("string")).alias("in_reply_to"))
    return nw.interactions(a.join(b, ["conv_id", "turn"]))


@query(f"WITH {_REPLIES} SELECT src, tgt, weight FROM g")
def interaction(spark, d):
    return _replies(spark, d)


@query(f"WITH {_REPLIES} SELECT node, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT src AS node, weight FROM g UNION ALL SELECT tgt, weight FROM g) GROUP BY node")
def degree(spark, d):
    return nw.degree(_replies(spark, d))


_TAGGED = "'#' || lang || ' @' || source || ' http://www.Ex.com/' || doc_id || ' #Ü' || lang || ' 😀 ' || text"


@query(f"""WITH p AS (SELECT doc_id, {_TAGGED} AS t FROM documents) SELECT doc_id AS _row_idx, length(t) AS char_count, CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count,
 CAST(len(regexp_extract_all(t, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')) AS BIGINT) AS emoji_count, CAST(len(regexp_extract_all(t, '#([\\p{{L}}\\p{{N}}_]+)')) AS BIGINT) AS hashtag_count,
 CAST(len(regexp_extract_all(t, 'https?://[^\\s/$.?#].[^\\s]*')) AS BIGINT) AS url_count, array_to_string([lower(x) FOR x IN regexp_extract_all(t, '#([\\p{{L}}\\p{{N}}_]+)', 1)], '|') AS hashtags FROM p""")
def post_features(spark, d):
    p = posts(spark, d).select("_row_idx", F.concat(F.lit("#"), "language", F.lit(" @"), "source_dataset", F.lit(" http://www.Ex.com/"), "post_id", F.lit(" #Ü"), "language", F.lit(" 😀 "), "text").alias("t"))
    f = tx.post_features(F.col("t"))
    return p.select("_row_idx", *[f[c].alias(c) for c in ("char_count", "word_count", "emoji_count", "hashtag_count", "url_count")], F.array_join(f["hashtags"], "|").alias("hashtags"))


@query("""SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN '' WHEN length(regexp_replace(trim(text), '[\\x00-\\x7F]', '', 'g')) / length(trim(text)) > 0.3 THEN 'other' ELSE 'en' END AS guess, count(*) AS n FROM documents GROUP BY 1""")
def lang_guess(spark, d):
    return posts(spark, d).groupBy(tx.language_guess(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(url, '^https?://(?:www\\.)?([^/]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def page_domains(spark, d):
    return table(spark, d, "pages").select(F.explode(F.slice(tx.domains(F.col("url")), 1, 1)).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS kinds FROM events GROUP BY user_id")
def array_join_export(spark, d):
    from tesserae.operators.export import flat

    return flat(table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds")))


@query()
def embedding_layout(spark, d):
    """A place in the plane for every vector; SQL has no layout, a test holds the neighbour graph below it against all similarities."""
    return lo.layout(table(spark, d, "embeddings"))


@query()
def embedding_graph_recall(spark, d):
    """Share of the ten nearest vectors that the neighbour graph has, over every twentieth vector against all; no SQL makes that graph."""
    vectors = table(spark, d, "embeddings")
    exact = se.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).select(F.col("query").alias("row"), F.col("row").alias("other"))
    found = lo.neighbours(vectors, 10).select("row", "other", F.lit(1.0).alias("hit"))
    return exact.join(found, ["row", "other"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(1.0)).alias("recall"))


#: Percent from which the registered queries link texts letter by letter.
ALIKE = 95.0


@query()
def dup_clusters(spark, d):
    """Clusters of similar posts over all documents; alignment has no SQL, a test holds them against all pairs."""
    return si.clusters(posts(spark, d), ALIKE)


@query()
def dup_cluster_list(spark, d):
    """The largest clusters of ``dup_clusters`` with sample rows; no SQL, as alignment has none."""
    p = posts(spark, d)
    return nw.cluster_list(si.clusters(p, ALIKE), p).select("cluster", "size", "rows")


@query()
def betweenness_top(spark, d):
    """Betweenness of the reply graph by weighted, directed paths; SQL has none of these, a test counts them all."""
    return pt.top_betweenness(_replies(spark, d))


@query(f"""WITH RECURSIVE {_REPLIES}, n AS (SELECT src AS v FROM g UNION SELECT tgt FROM g),
b AS (SELECT v AS s, v, 0 AS d FROM n UNION SELECT s, tgt, d + 1 FROM b JOIN g ON src = v WHERE d < 40),
f AS (SELECT s, v, min(d) AS d FROM b GROUP BY s, v),
w AS (SELECT v AS s, v, 0 AS d FROM n UNION ALL SELECT w.s, tgt, w.d + 1 FROM w JOIN g ON src = w.v JOIN f ON f.s = w.s AND f.v = tgt AND f.d = w.d + 1),
p AS (SELECT s, v, d, count(*) AS paths FROM w GROUP BY ALL),
t AS (SELECT x.v AS node, sum(x.paths * y.paths / CAST(z.paths AS DOUBLE)) AS share FROM p x JOIN p y ON y.s = x.v JOIN p z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v GROUP BY x.v)
SELECT n.v AS node, round(coalesce(share, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 6) AS betweenness FROM n LEFT JOIN t ON t.node = n.v""")
def betweenness_hops(spark, d):
    """Betweenness of all nodes of the reply graph by directed paths of fewest hops."""
    return pt.betweenness(_replies(spark, d), weighted=False).select("node", r6("betweenness").alias("betweenness"))


@query("SELECT 'language' AS name, count(DISTINCT lang) AS \"distinct\" FROM documents UNION ALL SELECT 'source_dataset', count(DISTINCT source) FROM documents")
def stratification_candidates(spark, d):
    return an.stratification_candidates(posts(spark, d))


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, value LIMIT 20")
def language_counts(spark, d):
    return an.language_counts(posts(spark, d)).select("value", "n")


@query("""WITH t AS (SELECT user_id AS _row_idx, event_type AS cat_id, event_id AS place, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'g' END AS grp FROM events)
SELECT _row_idx, cat_id, place FROM t QUALIFY row_number() OVER (PARTITION BY _row_idx, coalesce('g:' || grp, 'c:' || cat_id) ORDER BY place) = 1""")
def exclusion_first_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("_row_idx"), F.col("event_type").alias("cat_id"), F.col("event_id").alias("place"))
    groups = spark.createDataFrame([("view", "g"), ("click", "g"), ("purchase", "g")], "cat_id string, exclusion_group string")
    return cd.exclusive(e, groups)


@query("""WITH m AS (SELECT user_id, event_type, event_id, CAST(event_id % 50 AS VARCHAR) AS memo_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id DESC) = 1)
SELECT count(*) AS memos, count(DISTINCT user_id) AS rows, count(DISTINCT event_type) AS coders FROM m WHERE event_type <> 'purchase'""")
def memo_counts(spark, d):
    log = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 50).cast("string").alias("memo_id"), F.when(F.col("event_type") == "purchase", "delete").otherwise("edit").alias("action"),
        F.col("user_id").alias("_row_idx"), F.col("event_type").alias("coder"), F.lit("t").alias("text"), F.lit("cb").alias("codebook_id"), F.col("ts").cast("string").alias("ts"),
    )
    return cd.memo_counts(cd.memos(log))


@query("SELECT doc_id AS _row_idx, substr(text, length(text) // 3 + 1, length(text) // 2 + 1) AS quote FROM documents WHERE text IS NOT NULL")
def span_quotes(spark, d):
    """A span of every document, from its third, half its length long."""
    p = posts(spark, d).where("text IS NOT NULL")
    n = F.length("text")
    spans = p.select("_row_idx", F.floor(n / 3).cast("int").alias("start"), (F.floor(n / 3) + F.floor(n / 2) + 1).cast("int").alias("end"))
    return cd.span_texts(spans, p).select("_row_idx", "quote")


@query("""WITH a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0)
SELECT CAST(p_partkey AS VARCHAR) AS cat_id, CASE WHEN a.p_brand IS NULL THEN 'added' WHEN b.p_brand IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.p_brand IS NOT NULL AND b.p_brand IS NOT NULL THEN 'description' ELSE '' END AS fields
FROM a FULL JOIN b USING (p_partkey) WHERE a.p_brand IS NULL OR b.p_brand IS NULL OR a.p_size <> b.p_size""")
def codebook_diff(spark, d):
    book = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("cat_id"), F.col("p_brand").alias("title"), F.col("p_size").cast("string").alias("description"), F.lit(None).cast("string").alias("exclusion_group"), F.lit("k").alias("shortcut_key"), F.lit("c").alias("color"), "p_size")
    new = book.withColumn("description", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string"))
    return cd.codebook_diff(book.where("p_partkey % 5 <> 0"), new.where("p_partkey % 3 <> 0"))


@query(f"WITH {_TAGS}, s AS (SELECT _row_idx, coder, string_agg(DISTINCT cat_id, '+' ORDER BY cat_id) AS cats FROM tags GROUP BY ALL), c AS (SELECT _row_idx FROM s GROUP BY _row_idx HAVING count(DISTINCT cats) > 1) SELECT count(DISTINCT _row_idx) AS conflicts, count(DISTINCT cat_id) AS cats, count(DISTINCT coder) AS coders FROM tags WHERE _row_idx IN (FROM c)")
def conflict_summary(spark, d):
    return ag.conflict_summary(tags(spark, d))


@query("SELECT quantile_cont(CAST(length(text) AS DOUBLE), 0.1) AS p10, quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(length(text) AS DOUBLE), 0.9) AS p90 FROM documents")
def length_quantiles(spark, d):
    return ag.length_quantiles(posts(spark, d))


@query("SELECT doc_id AS _row_idx, sha1('cb|1||a,b|' || coalesce(text, '')) AS key FROM documents")
def answer_keys(spark, d):
    from tesserae.storage import answer_key

    return posts(spark, d).select("_row_idx", answer_key(F.col("text"), "cb", "1", "", ["b", "a"]).alias("key"))


@query("""SELECT count(*) AS rows, CAST(ceil(count(*) / 20) AS BIGINT) AS batches, CAST(ceil(sum(length(text)) / CAST(3.5 AS DOUBLE)) AS BIGINT) AS row_tokens, count(*) * 40 AS out_tokens FROM documents""")
def preflight(spark, d):
    from tesserae.operators.classify import preflight as run

    return run(posts(spark, d), 700, {"input": 1.0, "output": 4.0, "cache_write": 1.25, "cache_read": 0.1}).select("rows", "batches", "row_tokens", "out_tokens")


_KEYS = {"t_the": ["the", "and"], "t_der": ["der", "und"], "t_les": ["les", "des"]}


@query(f"""WITH w AS (SELECT doc_id, list_distinct({_TOKEN}) AS w FROM documents), n AS (SELECT doc_id, [{', '.join(f"len(list_intersect(w, {k}))" for k in _KEYS.values())}] AS n FROM w)
SELECT doc_id AS _row_idx, CASE WHEN list_max(n) = 0 OR list_max(n) IS NULL THEN 'other' ELSE {list(_KEYS)}[list_position(n, list_max(n))] END AS topic_id FROM n""")
def topics_assign(spark, d):
    from tesserae.operators.classify import assign_topics

    return assign_topics(posts(spark, d), [{"topic_id": k, "keywords": v} for k, v in _KEYS.items()])


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'to'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'and'))) AS n FROM w)
SELECT doc_id AS _row_idx, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label, round((p - n) / CAST(greatest(1, p + n) AS DOUBLE), 6) AS score FROM s""")
def enrich_sentiment(spark, d):
    from tesserae.operators.classify import enrich, word_sentiment

    told = enrich(posts(spark, d).select("_row_idx", "text"), word_sentiment(["the", "to"], ["of", "and"]), "label string, score double", "sentiment")
    return told.select("_row_idx", "sentiment.label", r6(F.col("sentiment.score")).alias("score"))
