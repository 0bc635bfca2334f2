"""The registered queries of the engine over the star schema and text tables, each with its SQL.

Every query runs over its whole tables; a limit stands only where it is the operation itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import canon, discover, kin, phrases, relational, search, stats, transcripts, usage
from scriptorium.operators.gram_index import GramIndex
from scriptorium.plans.registry import QUERIES, SQL, register
from scriptorium.plans.session import kept, table, written
from scriptorium.sources import readers

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- Stand-ins: documents as catalogue rows, brands of an order as its cast.

LANGS, STOP = ("en", "de"), ("the", "and", "les", "der", "las")
NAMES, ENDS = ("the", "en", "der", "que", "on"), ("", "n", "s", "er", "re")


def as_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the columns that search reads."""
    blank = F.lit("")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text"), blank.alias("textCommon"), F.col("source").alias("title"), F.col("lang").alias("actorsRaw"), blank.alias("rolesNames"), F.col("source").alias("location"),
        F.array("lang").alias("languages"), F.array("lang").alias("actors"), F.col("n_chars").alias("viewCount"), (F.col("n_chars") / 10).cast("int").alias("durationSec"), blank.alias("uploadDate"),
    )


def cast_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, actor): distinct brands of each order's parts."""
    li, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("actor")).distinct()


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("views", F.floor("o_totalprice").cast("long"))


BRIDGE = "bridge AS (SELECT DISTINCT l_orderkey AS o_orderkey, p_brand AS actor FROM lineitem JOIN part ON l_partkey = p_partkey)"
VIEWS = "CAST(floor(o_totalprice) AS BIGINT)"

# --- Search

_FOLD = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_COMBINED = f"trim(regexp_replace(lower(concat_ws(' ', source, text, lang, source)), '\\s+', ' ', 'g'))"
_INDEXED = f"ix AS (SELECT doc_id, lang, source, n_chars, {_FOLD.format('nfc_normalize(text)')} AS f_text, lower(source) AS f_src, lang AS f_lang, trim(regexp_replace(lower(nfc_normalize(concat_ws(' ', source, text, lang, source))), '\\s+', ' ', 'g')) AS combined FROM documents)"
_SCORE = "CAST(greatest(4 * CAST(contains(f_src, '{q}') AS INT) + 3 * CAST(contains(f_text, '{q}') AS INT) + 2 * CAST(contains(f_lang, '{q}') AS INT) + CAST(contains(f_src, '{q}') AS INT), 1) AS DOUBLE)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search index over documents, written once and read by every search. Without transliteration tables, as these
    tables' alphabets have none; text is composed by the function itself."""
    made = lambda home: search.index(as_catalogue(spark, sf_dir), tables=()).write.parquet(f"{home}/rows")
    return spark.read.parquet(f"{kept(spark, 'documents index', f'{sf_dir}/documents.parquet', made)}/rows")


def _words(spark: SparkSession, sf_dir: str) -> GramIndex:
    """The grams of the index's words, written once."""
    made = lambda home: GramIndex.build(search.word_index(_index(spark, sf_dir), "doc_id"), f"{home}/words", "doc_id")
    return GramIndex(spark, f"{kept(spark, 'documents words', f'{sf_dir}/documents.parquet', made)}/words", "doc_id")


@register(f"WITH {_INDEXED} SELECT doc_id, lang, n_chars AS views, {_SCORE.format(q='tion the')} AS score FROM ix WHERE contains(combined, 'tion the')")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.exact(_index(spark, sf_dir), search.normal_query("  Tion  THE "))
    return found.select("doc_id", F.col("actorsRaw").alias("lang"), F.col("viewCount").alias("views"), "score")


@register(f"WITH {_INDEXED} SELECT doc_id, n_chars AS views, {_SCORE.format(q='tion the')} AS score FROM ix WHERE contains(combined, 'tion the') ORDER BY score DESC, views DESC, doc_id LIMIT 48")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.exact(_index(spark, sf_dir), "tion the")
    return search.page(search.ordered(found, "tion the", "views", "viewCount", "uploadDate", "doc_id")).select("doc_id", F.col("viewCount").alias("views"), "score")


@register(f"WITH {_INDEXED} SELECT doc_id, n_chars AS views, {_SCORE.format(q='er')} AS score FROM ix WHERE contains(combined, 'er') AND source IN ('src0', 'src1', 'src2') AND lang IN ('en', 'de') AND CAST(trunc(n_chars / 10) AS INT) BETWEEN 120 AND 240")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = search.filters(location=("src0", "src1", "src2"), language=LANGS, duration="2-4")
    return search.exact(_index(spark, sf_dir), "er", keep).select("doc_id", F.col("viewCount").alias("views"), "score")


_NEAR = """win AS (SELECT word, unnest(CASE WHEN length(word) = 0 THEN [word] ELSE list_concat([word],
 list_transform(range(1, greatest(length(word) - 4 + 1, 1) + 1), lambda i: word[i:i+3]),
 list_transform(range(1, greatest(length(word) - 5 + 1, 1) + 1), lambda i: word[i:i+4]),
 list_transform(range(1, greatest(length(word) - 6 + 1, 1) + 1), lambda i: word[i:i+5])) END) AS w FROM vocab),
 near AS (SELECT word, min(levenshtein(w, 'thang')) / CAST(5 AS DOUBLE) AS near FROM win GROUP BY word HAVING min(levenshtein(w, 'thang')) <= 1)"""
_WORDS = "words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), vocab AS (SELECT DISTINCT word FROM words WHERE length(word) >= 4)"


@register(f"WITH {_WORDS}, {_NEAR} SELECT doc_id, min(near) AS near FROM words JOIN near USING (word) GROUP BY doc_id")
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typo-tolerant search over ASCII words, on which both engines' edit distances agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.words("text", "[a-z]+"), " ").alias("combined"))
    return search.fuzzy(docs, "thang", "doc_id")


@register(
    f"""WITH {_WORDS}, {_NEAR}, ex AS (SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE contains(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' '), 'thangxq')),
 fz AS (SELECT doc_id, (1 - min(near)) * CAST(0.5 AS DOUBLE) AS score FROM words JOIN near USING (word) WHERE near < 1 GROUP BY doc_id)
 SELECT * FROM ex UNION ALL SELECT * FROM fz WHERE doc_id NOT IN (SELECT doc_id FROM ex)"""
)
def search_with_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union behind the gate: exact rows first, then rows that only fuzzy search finds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.words("text", "[a-z]+"), " ").alias("combined")).withColumn("fields", F.expr("cast(array() as array<struct<value:string,weight:int>>)"))
    found = search.exact(docs, "thangxq")
    return search.with_fuzzy(found, docs, "thang", "doc_id").select("doc_id", "score")


def sellers_sql(word: str, query: str) -> str:
    """The least edit distance between the query and any part of a word, by rows of distances; the last number is the least so far."""
    n, codes = len(query), "[" + ", ".join(str(ord(c)) for c in query) + "]"
    base = f"list_transform(range(0, {n + 1}), lambda j: CASE WHEN j = 0 THEN 0 ELSE least(r[j] + CAST({codes}[j] <> c[1] AS INT), r[j + 1] + 1) - j END)"
    row = f"list_transform([{base}], lambda b: list_transform(range(0, {n + 1}), lambda j: j + list_min(b[1:j + 1])))[1]"
    step = f"list_transform([{row}], lambda x: list_concat(x, [least(r[{n + 2}], x[{n + 1}])]))[1]"
    start = f"list_concat(range(0, {n + 1}), [{n}])"
    return f"list_reduce(list_concat([{start}], list_transform(list_filter(string_split({word}, ''), lambda x: x <> ''), lambda x: [CAST(unicode(x) AS BIGINT)])), lambda r, c: {step})[{n + 2}]"


_TYPO = "thbleonst"
_VOCABULARY = "xw AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split(combined, ' ')) AS word FROM ix) WHERE length(word) >= 2), xv AS (SELECT DISTINCT word FROM xw)"


@register(f"WITH {_INDEXED}, {_VOCABULARY} SELECT word, {sellers_sql('word', _TYPO)} / CAST({len(_TYPO)} AS DOUBLE) AS near FROM xv WHERE {sellers_sql('word', _TYPO)} <= 3")
def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with a part within three edits of a query, from the kept lists of its grams."""
    return _words(spark, sf_dir).near(_TYPO, search.FUZZY_MOST)


@register(
    f"""WITH {_INDEXED}, {_VOCABULARY}, xn AS (SELECT word, {sellers_sql('word', _TYPO)} / CAST({len(_TYPO)} AS DOUBLE) AS near FROM xv),
 xe AS (SELECT doc_id, {_SCORE.format(q=_TYPO)} AS score FROM ix WHERE contains(combined, '{_TYPO}'))
 SELECT * FROM xe UNION ALL SELECT doc_id, (1 - min(near)) * CAST(0.5 AS DOUBLE) AS score FROM xw JOIN xn USING (word)
 WHERE near <= 0.35 AND near < 1 AND (SELECT count(*) FROM xe) < {search.FUZZY_BELOW} AND doc_id NOT IN (SELECT doc_id FROM xe) GROUP BY doc_id"""
)
def search_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with its gate, which is one small action, over the kept index and the kept lists of grams."""
    return search.search(_index(spark, sf_dir), _TYPO, key="doc_id", words=_words(spark, sf_dir)).select("doc_id", "score")


@register("SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(nfc_normalize(concat_ws(' ', source, text, lang, source))), '\\s+', ' ', 'g')), ' ')) AS word FROM documents) WHERE length(word) >= 2")
def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.word_index(_index(spark, sf_dir), "doc_id")


@register("SELECT doc_id, CAST(100 AS DOUBLE) AS score, CASE WHEN contains(lower(text), 'est') THEN 'text' ELSE 'source' END AS best_field FROM documents WHERE (contains(lower(text), 'est') OR contains(lower(source), 'est')) AND lang = 'en'")
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("languages", F.col("lang"))
    return search.page_search(docs, "Est", ("text", "source"), language="en", key="doc_id").select("doc_id", "score", "best_field")


@register(
    """WITH t AS (SELECT doc_id, 'title' AS kind, 0 AS branch, CAST(100 AS DOUBLE) AS score FROM documents WHERE contains(source, 'src7') ORDER BY score DESC, doc_id LIMIT 5),
 x AS (SELECT doc_id, 'text' AS kind, 1 AS branch, CAST(90 AS DOUBLE) AS score FROM documents WHERE contains(text, 'thing') ORDER BY score DESC, doc_id LIMIT 5),
 u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY branch, score DESC) AS r FROM (SELECT * FROM t UNION ALL SELECT * FROM x))
 SELECT doc_id, kind, score FROM u WHERE r = 1 ORDER BY score DESC, branch, doc_id LIMIT 5"""
)
def union_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches cut to their best, united with the first branch's row kept, sorted and cut; fixed scores stand in for library scorers."""
    docs = table(spark, sf_dir, "documents").withColumn("link", F.col("doc_id"))
    title = docs.where(F.contains("source", F.lit("src7"))).select("link", "doc_id", F.lit(100.0).alias("score"))
    body = docs.where(F.contains("text", F.lit("thing"))).select("link", "doc_id", F.lit(90.0).alias("score"))
    return search.union_search([("title", title), ("text", body)], "link", "doc_id").select("doc_id", "kind", "score")


@register()
def bot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older bot's search over short texts, by library-like scorers."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("links"), F.col("p_name").alias("titles"), F.col("p_type").alias("text"), F.col("p_brand").alias("main_actors"))
    return search.bot_search(rows, "small ring")


@register()
def sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of nine rows by a seeded shuffle."""
    return search.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), 9, seed=7)


# --- Text

_W = "regexp_extract_all(lower(text), '[\\p{L}]+')"


@register(f"WITH w AS (SELECT unnest({_W}) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN {STOP} GROUP BY word ORDER BY n DESC, word LIMIT 18")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.word_counts(table(spark, sf_dir, "documents"), F.col("text"), stop=STOP)


@register(
    f"""WITH t AS (SELECT list_filter({_W}, lambda x: length(x) > 1) AS w FROM documents),
 p AS (SELECT unnest(list_zip(w[1:len(w)-1], w[2:len(w)])) AS z FROM t WHERE len(w) >= 2)
 SELECT z[1] || ' ' || z[2] AS phrase, count(*) AS n FROM p WHERE length(z[1]) >= 3 AND length(z[2]) >= 3 AND z[1] NOT IN {STOP} AND z[2] NOT IN {STOP} GROUP BY 1 ORDER BY n DESC, phrase LIMIT 12"""
)
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bigram_counts(table(spark, sf_dir, "documents"), F.col("text"), stop=STOP)


_HIT = "len(list_filter({w}, lambda x: x = '{n}' OR (starts_with(x, '{n}') AND substr(x, length('{n}') + 1) IN {ends}))) > 0"


def _mentions(name: str) -> str:
    return f"SELECT '{name}' AS name, count(*) FILTER (WHERE {_HIT.format(w=_W, n=name, ends=ENDS)}) AS n FROM documents"


@register(" UNION ALL ".join(map(_mentions, NAMES)))
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.name_mentions(table(spark, sf_dir, "documents"), F.col("text"), NAMES, ENDS)


@register(f"SELECT * FROM ({' UNION ALL '.join(map(_mentions, NAMES))}) WHERE n > 0 ORDER BY n DESC, name LIMIT 3")
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.name_suggestions(table(spark, sf_dir, "documents"), F.col("text"), NAMES, top=3, suffixes=ENDS)


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: x <> '')"


_CAST_HIT, _SPOKEN_HIT = (_HIT.format(w=f"regexp_extract_all(lower({c}), '[\\p{{L}}]+')", n="en", ends=ENDS) for c in ("lang", "text"))


@register(
    f"""SELECT doc_id, CASE WHEN {_CAST_HIT} THEN 'actor' ELSE 'mention' END AS kind,
 coalesce(CASE WHEN {_CAST_HIT} THEN NULL ELSE list_filter({_LINES}, lambda l: {_HIT.format(w="regexp_extract_all(lower(l), '[\\p{L}]+')", n="en", ends=ENDS)})[1] END, '') AS snippet
 FROM documents WHERE {_CAST_HIT} OR {_SPOKEN_HIT}"""
)
def find_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language stands in for the cast."""
    docs = table(spark, sf_dir, "documents").withColumns({"lines": T.split_lines("text", "\n"), "phrase": F.lit("")})
    found = discover.find_by_name(docs, " EN ", "n_chars", "doc_id", F.col("lang"), F.lit(""), F.col("text"), "lines", "text", "phrase", ENDS)
    return found.select("doc_id", "kind", F.coalesce("snippet", F.lit("")).alias("snippet"))


@register("SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) AS folded FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("folded"))


#: A table for Latin alphabets, for tables without the archive's own.
PLAIN = ({"ch": "x", "qu": "k"}, {"é": "e", "è": "e", "ê": "e", "ç": "s", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ñ": "ny", "í": "i", "ó": "o", "h": ""})


@register("SELECT doc_id, replace(replace(translate(replace(replace(replace(replace(replace(replace(replace(lower(text), 'ch', chr(57344)), 'qu', chr(57345)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'ñ', 'ny'), 'éèêçíóh', 'eeesio'), chr(57344), 'x'), chr(57345), 'k') AS plain FROM documents")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.transliterate("text", PLAIN).alias("plain"))


@register("SELECT doc_id, len(l) AS n_lines, l[1] AS first_line FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[;.]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", T.split_lines("text", "[;.]").alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.get("l", 0).alias("first_line"))


@register("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, nullif(regexp_extract(url, '(?:v=|page=)([A-Za-z0-9_-]+)', 1), '') AS key, CAST(NULL AS VARCHAR) AS video FROM pages")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.nullif(F.regexp_extract("url", "(?:v=|page=)([A-Za-z0-9_-]+)", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", T.host("url").alias("host"), key.alias("key"), F.coalesce(T.video_id("url"), T.video_id_by_host("url")).alias("video"))


@register("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock, CASE WHEN l_extendedprice >= 1000 THEN CAST(floor(l_extendedprice / 1000 + 0.5) AS BIGINT) || 'K' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS short FROM lineitem")
def format_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").withColumn("x", F.floor("l_extendedprice"))
    short = F.when(F.col("l_extendedprice") >= 1000, T.format_views("l_extendedprice")).otherwise(T.format_views("x"))
    return n.select("l_orderkey", "l_linenumber", T.format_duration("x").alias("clock"), short.alias("short"))


# --- Canonical facets

KINDS = ("ring", "bolt", "gear")


@register(
    """WITH t AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'widget' THEN 'gear' ELSE x END) AS k FROM part)
 SELECT p_partkey, array_to_string(list_filter(k, lambda x: x IN ('ring', 'bolt', 'gear')), ', ') AS known, array_to_string(list_filter(k, lambda x: x NOT IN ('ring', 'bolt', 'gear')), ', ') AS roles FROM t"""
)
def canon_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = canon.people("p_name", KINDS, {"widget": "gear"})
    return table(spark, sf_dir, "part").select("p_partkey", who.alias("w")).select("p_partkey", F.array_join("w.actors", ", ").alias("known"), F.array_join("w.roles", ", ").alias("roles"))


@register("SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'other' END AS place, lang || ', xx' AS langs FROM documents")
def canon_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", canon.place("source", ("src0", "src1"), "other").alias("place"), F.array_join(canon.languages(F.concat("lang", F.lit(" + xx,"), "lang")), ", ").alias("langs"))


@register("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token NOT IN ('ring', 'bolt', 'gear') AND token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 15")
def unmapped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit(", ")).alias("rolesNames"))
    return canon.unmapped(rows, KINDS)


@register("SELECT count(*) AS n, count(*) FILTER (WHERE text <> '') AS with_text, count(*) AS with_actors FROM documents")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.coverage(as_catalogue(spark, sf_dir))


# --- Statistics


@register("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> '' GROUP BY source")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.facet_counts(table(spark, sf_dir, "documents"), {"lang": F.array("lang"), "source": F.array("source")})


@register(f"WITH {BRIDGE} SELECT (SELECT count(*) FROM orders) AS n, (SELECT sum({VIEWS})::BIGINT FROM orders) AS views, (SELECT CAST(min(o_orderdate) AS DATE)::VARCHAR FROM orders) AS first, (SELECT CAST(max(o_orderdate) AS DATE)::VARCHAR FROM orders) AS last, (SELECT count(DISTINCT actor) FROM bridge) AS actors, (SELECT round_even(sum({VIEWS}) / 3600, 1)::DOUBLE FROM orders) AS hours")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return stats.totals(rows, "views", "views", "d", cast_bridge(spark, sf_dir))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_viewed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@register("SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS shortest, (SELECT min(o_totalprice) FROM orders) AS shortest_value, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS longest, (SELECT max(o_totalprice) FROM orders) AS longest_value")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extremes(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@register(f"WITH {BRIDGE} SELECT actor, count(*) AS n FROM bridge GROUP BY actor ORDER BY n DESC, actor LIMIT 8")
def actor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_counts(cast_bridge(spark, sf_dir), "actor", "o_orderkey")


@register(f"WITH {BRIDGE} SELECT actor, count(*) AS n, CAST(round_even(avg({VIEWS}), 0) AS BIGINT) AS avg_views FROM bridge JOIN orders USING (o_orderkey) GROUP BY actor HAVING count(*) >= 8")
def actor_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.means_by(cast_bridge(spark, sf_dir).join(orders(spark, sf_dir).select("o_orderkey", "views"), "o_orderkey"), "actor", "views", least=8)


@register("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def location_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@register(f"SELECT c_mktsegment, count(*) AS n, CAST(round_even(avg(coalesce({VIEWS}, 0)), 0) AS BIGINT) AS avg_views FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment NOT IN ('MACHINERY') GROUP BY c_mktsegment")
def location_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
    return stats.means_by(rows, "c_mktsegment", "views", without=["MACHINERY"])


EDGES, BINS = [50_000, 100_000, 200_000, 300_000], ["<50K", "50-100K", "100-200K", "200-300K", "300K+"]
_BUCKET = "CASE WHEN {v} < 50000 THEN 0 WHEN {v} < 100000 THEN 1 WHEN {v} < 200000 THEN 2 WHEN {v} < 300000 THEN 3 ELSE 4 END"


@register(f"SELECT {_BUCKET.format(v='o_totalprice')} AS ord, ['<50K', '50-100K', '100-200K', '200-300K', '300K+'][{_BUCKET.format(v='o_totalprice')} + 1] AS bucket, count(*) AS n, CAST(round_even(avg({VIEWS}), 0) AS BIGINT) AS avg_views FROM orders GROUP BY 1, 2")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.buckets(orders(spark, sf_dir), F.col("o_totalprice"), EDGES, BINS, "views")


@register(f"SELECT CAST(b.ord AS INT) AS ord, b.bin, count(o.k) AS n FROM (VALUES (0, '<50K'), (1, '50-100K'), (2, '100-200K'), (3, '200-300K'), (4, '300K+'), (5, '9M+')) b(ord, bin) LEFT JOIN (SELECT CASE WHEN o_totalprice >= 9000000 THEN 5 ELSE {_BUCKET.format(v='o_totalprice')} END AS k FROM orders) o ON o.k = b.ord GROUP BY b.ord, b.bin")
def views_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bin that stays empty."""
    return stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice", [*EDGES, 9_000_000], [*BINS, "9M+"])


@register(
    f"""WITH s AS (SELECT o_orderkey AS seq, {VIEWS} AS v, row_number() OVER (ORDER BY o_orderkey, {VIEWS}) - 1 AS i, greatest(1, count(*) OVER () // 8) AS size FROM orders WHERE o_orderkey <> 0)
 SELECT CAST(i // size AS BIGINT) AS chunk, min(seq) || '-' || max(seq) AS label, CAST(round_even(avg(v), 0) AS BIGINT) AS avg_views FROM s GROUP BY i // size"""
)
def views_by_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_sequence(orders(spark, sf_dir), "o_orderkey", "views")


@register(f"WITH {BRIDGE}, top AS (SELECT actor, count(*) AS m FROM bridge GROUP BY actor ORDER BY m DESC, actor LIMIT 7) SELECT x.actor AS a, y.actor AS b, count(*) AS n FROM bridge x JOIN bridge y ON x.o_orderkey = y.o_orderkey AND x.actor <> y.actor WHERE x.actor IN (SELECT actor FROM top) AND y.actor IN (SELECT actor FROM top) GROUP BY 1, 2")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.co_occurrence(cast_bridge(spark, sf_dir), "actor", "o_orderkey")


@register(f"WITH {BRIDGE} SELECT y.actor, count(*) AS n FROM bridge x JOIN bridge y ON x.o_orderkey = y.o_orderkey AND x.actor <> y.actor WHERE x.actor = 'Brand#11' GROUP BY y.actor")
def costars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.co_stars(cast_bridge(spark, sf_dir), "Brand#11", "o_orderkey", "actor")


@register(f"WITH {BRIDGE}, a AS (SELECT o_orderkey, list_sort(list_distinct(list(actor))) AS l FROM bridge GROUP BY o_orderkey), o AS (SELECT coalesce(l, []) AS l FROM orders LEFT JOIN a USING (o_orderkey)) SELECT CASE WHEN len(l) = 0 THEN 'uncurated' WHEN l = ['Brand#11', 'Brand#12'] THEN 'duo' WHEN len(l) = 1 THEN 'solo' ELSE 'ensemble' END AS kind, count(*) AS n FROM o GROUP BY 1")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = cast_bridge(spark, sf_dir).groupBy("o_orderkey").agg(F.collect_set("actor").alias("actors"))  # one order's brands
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(held, "o_orderkey", "left").withColumn("actors", F.coalesce("actors", F.array().cast("array<string>")))
    return stats.composition(rows, "actors", ("Brand#11", "Brand#12"))


@register("SELECT count(*) FILTER (WHERE text <> '') AS with_text, CAST(sum(n_chars) AS BIGINT) AS views, CAST(floor(sum(n_chars) / 3600 + 0.5) AS BIGINT) AS hours FROM documents")
def hero_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hero_figures(table(spark, sf_dir, "documents"), "text", "n_chars", "n_chars")


@register("SELECT count(DISTINCT o_orderpriority) AS n_values, count(o_orderstatus) AS n_text, (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_value, avg(o_custkey) AS mean_number FROM orders")
def eda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_custkey")


# --- Discovery

_RELATED = f"""WITH {BRIDGE}, f AS (SELECT actor, count(*) AS f FROM bridge GROUP BY actor), mine AS (SELECT actor FROM bridge WHERE o_orderkey = 1), w AS (SELECT o_orderkey, sum(1.0::DOUBLE / f) AS w FROM bridge JOIN f USING (actor) WHERE actor IN (SELECT actor FROM mine) GROUP BY 1)
 SELECT o_orderkey, round(coalesce(w, 0) + CASE WHEN o_orderpriority = (SELECT o_orderpriority FROM orders WHERE o_orderkey = 1) AND o_orderpriority <> '5-LOW' THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score, {VIEWS} AS views FROM orders LEFT JOIN w USING (o_orderkey) WHERE o_orderkey <> 1
 ORDER BY (round(coalesce(w, 0) + CASE WHEN o_orderpriority = (SELECT o_orderpriority FROM orders WHERE o_orderkey = 1) AND o_orderpriority <> '5-LOW' THEN 0.05 ELSE 0 END, 6) > 0) DESC, score DESC, views DESC, o_orderkey LIMIT 6"""


@register(_RELATED)
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "views")
    return discover.related(rows, cast_bridge(spark, sf_dir), 1, "o_orderkey", "actor", "o_orderpriority", "views", other="5-LOW").select("o_orderkey", "score", "views")


#: Customers by the parts that they bought and, as a value that many share, their nation; the segment is the place.
_KIN = """kb AS (SELECT DISTINCT o_custkey AS k, 'p' || l_partkey AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT c_custkey, 'n' || c_nationkey FROM customer),
 kf AS (SELECT a, count(*) AS f FROM kb GROUP BY a), kw AS (SELECT x.k AS k, y.k AS s, sum(1.0::DOUBLE / f) AS w FROM kb x JOIN kb y ON x.a = y.a AND x.k <> y.k JOIN kf ON kf.a = x.a GROUP BY 1, 2),
 ks AS (SELECT c.c_custkey AS k, d.c_custkey AS s, round(coalesce(w, 0) + CASE WHEN c.c_mktsegment = d.c_mktsegment AND c.c_mktsegment <> 'MACHINERY' THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score, floor(d.c_acctbal) AS v
 FROM customer c JOIN customer d ON c.c_custkey <> d.c_custkey LEFT JOIN kw ON kw.k = c.c_custkey AND kw.s = d.c_custkey)"""


@register(f"WITH {_KIN} SELECT k AS c_custkey, CAST(r AS INTEGER) AS rank, s AS other, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, v DESC, s) AS r FROM ks) WHERE r <= 6")
def related_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most related customers of every customer, filled with those of the highest balance."""
    c = table(spark, sf_dir, "customer").withColumn("v", F.floor("c_acctbal"))
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"))
    bridge = bought.unionByName(c.select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("a")))
    return kin.related_every(c, bridge, "c_custkey", "a", "c_mktsegment", "v", other="MACHINERY", hub=50)


@register(f"WITH {BRIDGE} SELECT 'Brand#11' AS name, count(*) AS n, CAST(sum({VIEWS}) AS BIGINT) AS views, CAST(floor(avg({VIEWS}) + 0.5) AS BIGINT) AS avg_views FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM bridge WHERE actor = 'Brand#11')")
def actor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.actor_profile(orders(spark, sf_dir), cast_bridge(spark, sf_dir), "Brand#11", "o_orderkey", "actor", "views")


@register(f"WITH {BRIDGE} SELECT DISTINCT actor FROM bridge")
def actor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.actor_names(cast_bridge(spark, sf_dir), "actor")


@register("SELECT conv_id, text FROM (SELECT min(conv_id) AS conv_id, text FROM conversations WHERE turn = 0 AND text <> '' GROUP BY conv_id, text) ORDER BY conv_id LIMIT 4")
def catchphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "text").distinct()
    return discover.catchphrases(first, "text", "conv_id")


@register(
    """WITH p AS (SELECT DISTINCT text AS phrase FROM benchmark), h AS (SELECT phrase, doc_id, n_chars, row_number() OVER (PARTITION BY phrase ORDER BY n_chars DESC, doc_id) AS r FROM p JOIN documents ON contains(text, phrase))
 SELECT phrase, doc_id AS key, n_chars AS views FROM h WHERE r = 1"""
)
def phrase_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "benchmark").select(F.col("text").alias("phrase")).distinct()
    return discover.phrase_tiles(wanted, "phrase", table(spark, sf_dir, "documents"), "text", "doc_id", "n_chars")


#: Distinct words, pairs of words and characters of the benchmark's texts.
_PHRASES = """pw AS (SELECT list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark),
 ph AS (SELECT DISTINCT p AS phrase FROM (SELECT unnest(w) AS p FROM pw UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM pw UNION ALL SELECT unnest(string_split(array_to_string(w, ' '), '')) FROM pw) WHERE p <> '')"""


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    pairs = F.transform(F.expr("sequence(0, size(w) - 2)"), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    parts = F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.expr("cast(array() as array<string>)")), F.regexp_extract_all(F.array_join("w", " "), F.lit("(?s)."), F.lit(0)))
    return w.select(F.explode(parts).alias("phrase")).distinct()


@register(f"WITH {_PHRASES} SELECT phrase, count(*) AS n FROM ph JOIN documents ON contains(text, phrase) GROUP BY phrase")
def phrases_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each of many phrases is, single characters too."""
    return phrases.held(table(spark, sf_dir, "documents"), "text", "doc_id", _phrases(spark, sf_dir), "phrase").groupBy("phrase").agg(F.count("*").alias("n"))


@register(
    f"""WITH t AS (SELECT list_filter({_W}, lambda x: length(x) > 1) AS w FROM documents),
 p AS (SELECT unnest(list_zip(w[1:len(w)-1], w[2:len(w)])) AS z FROM t WHERE len(w) >= 2),
 b AS (SELECT z[1] || ' ' || z[2] AS phrase, count(*) AS n FROM p WHERE length(z[1]) >= 3 AND length(z[2]) >= 3 AND z[1] NOT IN {STOP} AND z[2] NOT IN {STOP} GROUP BY 1 ORDER BY n DESC, phrase LIMIT 12),
 h AS (SELECT b.phrase, b.n, doc_id, n_chars, row_number() OVER (PARTITION BY b.phrase ORDER BY n_chars DESC, doc_id) AS r FROM b JOIN documents ON contains({_FOLD.format('text')}, b.phrase))
 SELECT phrase, n, doc_id AS key, n_chars AS views FROM h WHERE r = 1"""
)
def phrase_tiles_of_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent word pairs with the most viewed document that has them side by side."""
    docs = table(spark, sf_dir, "documents")
    top = written(stats.bigram_counts(docs, F.col("text"), stop=STOP))
    found = discover.phrase_tiles(top, "phrase", docs.withColumn("said", T.fold("text")), "said", "doc_id", "n_chars")
    return found.join(top, "phrase").select("phrase", "n", "key", "views")


_NAMES = "SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 4"


@register(
    f"""WITH nm AS ({_NAMES}), f AS (SELECT name, name || unnest({list(ENDS)}) AS form FROM nm), w AS (SELECT DISTINCT doc_id, unnest({_W}) AS form FROM documents)
 SELECT name, count(DISTINCT doc_id) AS n FROM nm LEFT JOIN f USING (name) LEFT JOIN w USING (form) GROUP BY name"""
)
def mentions_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each of many names is, with or without an ending."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(T.words("text", "[a-z]+")).alias("name")).where(F.length("name") >= 4).distinct()
    return phrases.mentions(table(spark, sf_dir, "documents"), T.words("text"), names, "name", ENDS)


# --- Ingest


@register("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.enrich(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"]).fillna(-1)


@register("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def todo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.todo(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@register("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return relational.upsert(e.where("event_type = 'view'"), e.where("event_type <> 'view' or event_type is null"), "user_id", "ts", "event_id").drop("ts")


@register("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_of(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS file_seq FROM orders WHERE o_orderstatus = 'F'")
def file_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", "private").alias("availability"))
    return relational.available(rows, "availability", "o_orderkey").select("o_orderkey", F.col("file_seq").cast("long").alias("file_seq"))


@register("SELECT p_partkey, coalesce(s_name, '') AS s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return relational.lookup(table(spark, sf_dir, "part").select("p_partkey"), names, "p_partkey", "s_name")


@register("SELECT CASE WHEN b.doc_id IS NULL THEN 'left' WHEN a.doc_id IS NULL THEN 'right' ELSE 'both' END AS where_found, count(*) AS n FROM documents a FULL JOIN labels b USING (doc_id) GROUP BY 1")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@register("SELECT a.conv_id, a.user_text, b.assistant_text FROM (SELECT conv_id, max(text) FILTER (WHERE role = 'user') AS user_text FROM conversations GROUP BY 1) a JOIN (SELECT conv_id, max(text) FILTER (WHERE role = 'assistant') AS assistant_text FROM conversations GROUP BY 1) b USING (conv_id)")
def compare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return relational.compare(c, {"user_text": c.where("role = 'user'"), "assistant_text": c.where("role = 'assistant'")}, "conv_id", "text")


# --- Transcripts, costs, usage, quizzes


@register("SELECT conv_id, count(*) AS n_turns, string_agg(text, chr(10) ORDER BY turn, text) AS full_text FROM conversations GROUP BY conv_id")
def transcript_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.join_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@register("SELECT role AS source_lang, count(*) AS files, CAST(sum(turn) AS BIGINT) AS events, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def caption_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("source_lang"), F.col("turn").alias("n_events"), F.col("text").alias("full_text"))
    return transcripts.caption_totals(c)


_RUNS = "SELECT CASE l_returnflag WHEN 'R' THEN 'pro' ELSE 'lite' END AS model, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS audio_sec, CAST(sum(l_quantity) AS BIGINT) AS tokens_in, CAST(sum(l_suppkey) AS BIGINT) AS tokens_out FROM lineitem GROUP BY 1"


@register(f"SELECT *, CASE model WHEN 'pro' THEN tokens_in / 1e6::DOUBLE * 2.0::DOUBLE + tokens_out / 1e6::DOUBLE * 12.0::DOUBLE ELSE tokens_in / 1e6::DOUBLE * 0.5::DOUBLE + tokens_out / 1e6::DOUBLE * 1.5::DOUBLE END AS cost_usd FROM ({_RUNS})")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.run_totals(_runs(spark, sf_dir), transcripts.price_table(spark)).select("model", "n", "audio_sec", "tokens_in", "tokens_out", "cost_usd")


@register()
def cost_extrapolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried on to the archive's hours; the chain of divisions is not the same in both engines to the last bit."""
    return transcripts.extrapolate(transcripts.run_totals(_runs(spark, sf_dir), transcripts.price_table(spark)))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("l_returnflag") == "R", "pro").otherwise("lite")
    return table(spark, sf_dir, "lineitem").select(model.alias("model"), F.col("l_linenumber").cast("long").alias("audio_sec"), F.col("l_linenumber").cast("long").alias("gen_sec"), F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"))


@register("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 30")
def usage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_by(table(spark, sf_dir, "events"), "click", "event_type", "user_id")


@register("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE event_type = 'view' AND value < 50 GROUP BY 1")
def usage_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return usage.top_by(e, "view", "event_type", "k", F.col("value") < 50, top=None)


@register("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 30")
def usage_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_by(table(spark, sf_dir, "events"), "purchase", "event_type", "user_id")


@register("SELECT event_id FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600000000")
def usage_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.settled(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600).select("event_id")


@register("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the events, run to its end into a table; each event counts once.

    A day's count is written when its window closes; what is still open at the end of the input comes from the batch report.
    """
    from scriptorium.plans.session import scratch
    from scriptorium.streaming.usage import windowed

    events, home = table(spark, sf_dir, "events"), scratch(spark)
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    day, late = F.to_date("w.start").cast("string").alias("d"), "2 days"
    counts = windowed(stream, "ts", "event_id", "event_type", late=late).select(day, "event_type", "n")
    query = counts.writeStream.format("parquet").option("path", f"{home}/daily").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.schema("d string, event_type string, n long").parquet(f"{home}/daily")
    own = events.dropDuplicates(["event_id"]).groupBy(F.to_date("ts").cast("string").alias("d"), "event_type").agg(F.count("*").alias("n"))
    return closed.unionByName(own.join(closed.select("d").distinct(), "d", "left_anti"))


@register(
    """WITH b AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS level, max(value) AS best FROM events WHERE event_type = 'view' GROUP BY 1, 2)
 SELECT user_id, level, best, CASE WHEN best / 500 >= 0.9 THEN 3 WHEN best / 500 >= 0.8 THEN 2 WHEN best / 500 >= 0.7 THEN 1 ELSE 0 END AS stars, best >= 100 AS passed, coalesce(lag(best >= 100) OVER (PARTITION BY user_id ORDER BY level), true) AS unlocked FROM b"""
)
def quiz_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("level", F.to_date("ts").cast("string"))
    done = transcripts.quiz_progress(e, "user_id", "level", "value", 100)
    return done.withColumn("stars", transcripts.stars(F.col("best") / 500))


@register("SELECT user_id, count(*) AS n, coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 0) AS total FROM events GROUP BY user_id")
def coerced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text coerced to numbers, anything else as 0."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("x", readers.number("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


from scriptorium.plans import catalog_more  # noqa: E402, F401  registers its queries, whose stand-ins are those above
