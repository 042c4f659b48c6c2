"""Queries of the headline operators.  Titles are the documents' first lines; invented headlines come from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import headline_model as M
from tickloom.operators import headlines as H
from tickloom.operators import leaders
from tickloom.plans.registry import query
from tickloom.sources import headlines as L
from tickloom.sources import views as V
from tickloom.sources.views import with_views

T = "titles"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def stem_sql(w: str) -> str:
    return f"""CASE WHEN length({w}) < 5 THEN {w} WHEN {w} LIKE '%ing' AND length({w}) >= 6 THEN {w}[:-4] WHEN {w} LIKE '%ed' THEN {w}[:-3]
        WHEN regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN {w}[:-3] WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:-2] ELSE {w} END"""


TOKENS_SQL = f"""tw AS (SELECT *, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: NOT list_contains({_list(H.STOP_WORDS)}, w) AND (length(w) > 1 OR regexp_full_match(w, '[0-9]'))) AS ws FROM titles),
    tk AS (SELECT * EXCLUDE (ws), list_distinct(list_transform(list_transform(ws, lambda w: {stem_sql('w')}), lambda s: CASE WHEN list_contains({_list(H._stems(H.DELAYS))}, s) THEN 'delay' ELSE s END)) AS tokens FROM tw)"""


def similar_sql(a: str, b: str) -> str:
    up, down, no = _list(H._stems(H.RISES)), _list(H._stems(H.FALLS)), _list(H.NEGATIONS)
    only = lambda x, y: f"list_filter({x}, lambda t: NOT list_contains({y}, t))"
    both, shared = f"list_concat({only(a, b)}, {only(b, a)})", f"len(list_intersect({a}, {b}))"
    opposed = f"((list_has_any({only(a, b)}, {up}) AND list_has_any({only(b, a)}, {down})) OR (list_has_any({only(a, b)}, {down}) AND list_has_any({only(b, a)}, {up})))"
    return f"({shared} >= 3 AND len(list_filter({both}, lambda t: regexp_matches(t, '[0-9]'))) = 0 AND NOT list_has_any({both}, {no}) AND NOT {opposed} AND ({shared} * 2 >= len({a}) + len({b}) - {shared} OR (least(len({a}), len({b})) >= 3 AND {shared} * 5 >= least(len({a}), len({b})) * 4)))"


@query("story_key", with_views(T, "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g'), '\\s+', ' ', 'g')) || chr(124) || lower(day)) AS story_key FROM titles"))
def story_key(spark, d):
    return V.titles(spark, d).select("doc_id", H.story_key(F.col("title"), F.col("day")).alias("story_key"))


_FORMS = "CASE p_partkey % 6 WHEN 0 THEN ' Holdings, Inc.' WHEN 1 THEN ' Group Ltd' WHEN 2 THEN ' Co.' WHEN 3 THEN ' & Sons' WHEN 4 THEN ' S.A.' ELSE '' END"
CORE_SQL = f"""nm AS (SELECT p_partkey, p_name || {_FORMS} AS name, upper(p_brand[1:1]) || p_partkey || CASE WHEN p_size > 25 THEN '.SI' ELSE '' END AS symbol FROM part),
    cr AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(replace(name, '.', ''), '[^\\w&\\s-]', '', 'g'), '\\s+', ' ', 'g')), '(?i)^(.+?)(?: (?:{'|'.join(H.LEGAL_FORMS)}))+$', '\\1') AS core FROM nm)"""


def _names(spark, d):
    k = F.col("p_partkey") % 6
    form = F.when(k == 0, " Holdings, Inc.").when(k == 1, " Group Ltd").when(k == 2, " Co.").when(k == 3, " & Sons").when(k == 4, " S.A.").otherwise("")
    symbol = F.concat(F.upper(F.substring("p_brand", 1, 1)), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".SI").otherwise(""))
    return V.table(spark, d, "part").select("p_partkey", F.concat("p_name", form).alias("name"), symbol.alias("symbol"))


@query("core_name", f"WITH {CORE_SQL} SELECT p_partkey, core AS core_name FROM cr")
def core_name(spark, d):
    return _names(spark, d).select("p_partkey", H.core_name(F.col("name")).alias("core_name"))


@query("ignore_tokens", f"WITH {CORE_SQL} SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(symbol || ' ' || core), '[a-z0-9]+'))), ' ') AS tokens FROM cr")
def ignore_tokens(spark, d):
    return _names(spark, d).select("p_partkey", F.array_join(F.array_sort(H.ignore_tokens(F.col("symbol"), F.col("name"))), " ").alias("tokens"))


@query("title_tokens", with_views(T, f", {TOKENS_SQL} SELECT doc_id, array_to_string(list_sort(tokens), ' ') AS tokens FROM tk"))
def title_tokens(spark, d):
    return V.titles(spark, d).select("doc_id", F.array_join(F.array_sort(H.title_tokens(F.col("title"))), " ").alias("tokens"))


_SETS = "SELECT lang AS symbol, day, min(doc_id) AS name, tokens FROM (SELECT * REPLACE (list_sort(tokens) AS tokens) FROM tk) WHERE len(tokens) >= 3 GROUP BY ALL"


@query("title_similarity", with_views(T, f", {TOKENS_SQL}, st AS ({_SETS}) SELECT a.symbol AS lang, a.day, a.name AS doc_id, b.name AS before FROM st a JOIN st b ON a.symbol = b.symbol AND a.day = b.day AND b.name < a.name AND {similar_sql('a.tokens', 'b.tokens')}"))
def title_similarity(spark, d):
    """Similar titles of a language's day, equal ones as one: pairs with the earlier one, found by their rare tokens."""
    t = V.titles(spark, d).select("lang", "day", "doc_id", F.array_sort(H.title_tokens(F.col("title"))).alias("tokens")).where(F.size("tokens") >= leaders.LEAST_SHARED)
    sets = t.groupBy("lang", "day", "tokens").agg(F.min("doc_id").alias("name")).withColumn("first", F.col("name"))
    return leaders.similar_pairs(sets, ["lang", "day"], H.similar).select("lang", "day", F.col("name").alias("doc_id"), F.col("head").alias("before"))


def _stories(spark, d):
    """Titles as stories of their day (a source), a third of them stored already."""
    t = V.titles(spark, d)
    return t.select(F.col("lang").alias("symbol"), "day", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("stored_first"), F.col("doc_id").alias("published_at"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), H.title_tokens(F.col("title")).alias("tokens"))


def _led_sql(stored_first: str) -> str:
    """Titles with their head, one title of each day after the other: a row's list has the day's leaders so far."""
    return f"""{TOKENS_SQL}, ti AS (SELECT doc_id, lang AS symbol, day, {stored_first} AS sf, list_sort(tokens) AS tokens FROM tk),
        se AS (SELECT symbol, day, tokens, min([sf, doc_id]) AS first FROM ti WHERE len(tokens) >= 3 GROUP BY ALL), sn AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY first) AS n FROM se),
        ld AS (SELECT DISTINCT symbol, day, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, tokens VARCHAR[])[]) AS led, CAST(NULL AS VARCHAR[]) AS tokens, CAST(NULL AS BIGINT) AS head FROM se
            UNION ALL SELECT symbol, day, n, CASE WHEN found IS NULL THEN list_append(led, {{id: id, tokens: tokens}}) ELSE led END, tokens, coalesce(found, id) FROM
            (SELECT ld.symbol, ld.day, sn.n, ld.led, sn.tokens, sn.first[2] AS id, list_filter(ld.led, lambda l: {similar_sql('sn.tokens', 'l.tokens')})[1].id AS found FROM ld JOIN sn ON sn.symbol = ld.symbol AND sn.day = ld.day AND sn.n = ld.n + 1)),
        hd AS (SELECT ti.symbol, ti.day, ti.doc_id, ti.sf, coalesce(ld.head, ti.doc_id) AS head FROM ti LEFT JOIN ld ON ld.symbol = ti.symbol AND ld.day = ti.day AND ld.tokens = ti.tokens)"""


@query("cluster_stories", with_views(T, f", {_led_sql('0')} SELECT symbol, day, doc_id, head FROM hd", recursive=True))
def cluster_stories(spark, d):
    """Greedy leaders by day in order of publication."""
    s = H.cluster_stories(_stories(spark, d).withColumn("stored_first", F.lit(0)))
    return s.select("symbol", "day", F.col("key").cast("long").alias("doc_id"), F.col("head").cast("long").alias("head"))


@query("fold_duplicates", with_views(T, f", {_led_sql('CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END')} SELECT symbol, day, doc_id, head AS main FROM hd WHERE sf = 1 AND head <> doc_id", recursive=True))
def fold_duplicates(spark, d):
    """New stories that a stored or earlier new story of the day already tells, with that story."""
    s = H.cluster_stories(_stories(spark, d)).where((F.col("stored_first") == 1) & (F.col("key") != F.col("head")))
    return s.select("symbol", "day", F.col("key").cast("long").alias("doc_id"), F.col("head").cast("long").alias("main"))


@query("news_relevant", "SELECT doc_id, coalesce(regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])and the([^0-9A-Za-z_]|$)') OR regexp_matches(text, '(^|[^0-9A-Za-z_.])Aneres([^0-9A-Za-z_]|$)'), FALSE) AS relevant FROM documents")
def news_relevant(spark, d):
    """Whole texts that name the company 'And The Group Ltd' or the ticker Aneres.SI."""
    return V.table(spark, d, "documents").select("doc_id", H.relevant(F.col("text"), F.lit("Aneres.SI"), F.lit("And The Group Ltd")).alias("relevant"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _headlines_sql(of: dict[str, str]) -> str:
    """Orders as headlines: o_orderkey, kind, shape's number and title."""
    every = L.shapes(of)
    name = lambda n: f"({_list(L.NAMES)})[1 + ({n}) % {len(L.NAMES)}]"
    n = "(o_orderkey % 900 + 101)"
    slots = {
        "{C}": "company",
        "{O}": "other",
        "{F}": "other || ([' Capital LLC', ' Advisors Inc.', ' Wealth Partners LP', ' Trust Co'])[1 + o_orderkey % 4]",
        "{T}": "'$' || upper(substr(company, 1, 4))",
        "{N}": f"({n} // 10) || ',' || {n}",
        "{D}": f"'$' || {n} || ([' million', '.5 million', ' billion'])[1 + o_orderkey % 3]",
        "{P}": "((o_orderkey % 290 + 10) / 10) || '%'",
    }
    title = f"([{', '.join(_quoted(x) for _, x in every)}])[1 + nth]"
    for slot, value in slots.items():
        title = f"replace({title}, '{slot}', {value})"
    return f"""SELECT o_orderkey, nth, ({_list([k for k, _ in every])})[1 + nth] AS kind, {title} AS title
        FROM (SELECT o_orderkey, o_orderkey % {len(every)} AS nth, {name("o_custkey")} AS company, {name("o_custkey + o_orderkey + 1")} AS other FROM orders)"""


def _features_sql(source: str) -> str:
    """Distinct words and pairs of neighbours of the titles of a CTE."""
    text = "coalesce(title, '')"
    for pattern, by in M.LOOKS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    words = f"SELECT *, list_filter(string_split(lower({text}), ' '), lambda w: w <> '') AS w FROM {source}"
    edged = f"SELECT *, list_concat(['<'], w, ['>']) AS e FROM ({words})"
    return f"SELECT * EXCLUDE (w, e), list_distinct(list_concat(w, list_transform(range(1, len(e)), lambda i: e[i] || ' ' || e[i + 1]))) AS f FROM ({edged})"


#: Scores over which a headline is flagged: high enough that fewer than one in twenty news headlines is.
LEAST = {"recap": 2.0, "fund": 10.0}


def _flag_sql(kind: str) -> str:
    """Naive Bayes over the training headlines, each shape once, for the judged ones."""
    return f"""WITH tr0 AS ({_headlines_sql(L.TRAIN)}), tr1 AS (SELECT nth, arg_min(title, o_orderkey) AS title, any_value(kind) = '{kind}' AS y FROM tr0 GROUP BY nth), tr AS ({_features_sql("tr1")}),
        n AS (SELECT count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0 FROM tr),
        c AS (SELECT f, count(*) FILTER (y) AS c1, count(*) FILTER (NOT y) AS c0 FROM (SELECT y, unnest(f) AS f FROM tr) GROUP BY f),
        w AS (SELECT f, ln((c1 + 0.5) / (n1 + 1)) - ln((c0 + 0.5) / (n0 + 1)) AS w FROM c, n), j0 AS ({_headlines_sql(L.JUDGED)}), j AS ({_features_sql("j0")}),
        s AS (SELECT o_orderkey, sum(w) AS s FROM (SELECT o_orderkey, unnest(f) AS f FROM j) JOIN w USING (f) GROUP BY o_orderkey)
        SELECT j.o_orderkey, round(coalesce(s, 0) + ln(n1 / n0), 6) AS score, s IS NOT NULL AND coalesce(s, 0) + ln(n1 / n0) > {LEAST[kind]} AS hit FROM j CROSS JOIN n LEFT JOIN s USING (o_orderkey)"""


def _flagged(spark, d, kind: str):
    """Headlines of shapes that the filter has not seen, judged by what it learned from others."""
    every = F.element_at(F.array(*[F.lit(i) for i in range(len(L.shapes(L.TRAIN)))]), (F.col("o_orderkey") % len(L.shapes(L.TRAIN)) + 1).cast("int"))
    once = L.headlines(spark, d, L.TRAIN).groupBy(every.alias("nth"), "kind").agg(F.min_by("title", "o_orderkey").alias("title"))
    weights = F.broadcast(M.train(once.withColumn("label", F.col("kind") == kind)))  # features of the fixed shapes, so a headline's features stay where they are
    got = M.flag(L.headlines(spark, d, L.JUDGED), weights, ["o_orderkey"], least=LEAST[kind])
    return got.select("o_orderkey", F.round("score", 6).alias("score"), "hit")


@query("news_recap", _flag_sql("recap"))
def news_recap(spark, d):
    return _flagged(spark, d, "recap")


@query("news_low_value", _flag_sql("fund"))
def news_low_value(spark, d):
    return _flagged(spark, d, "fund")


@query("shared_words", with_views(T, ", wd AS (SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS word FROM titles), n AS (SELECT lang, count(*) AS n FROM titles GROUP BY lang HAVING count(*) >= 10) SELECT lang, word, count(*) AS titles FROM wd JOIN n USING (lang) GROUP BY lang, word, n HAVING count(*) >= 0.5 * n"))
def shared_words(spark, d):
    """Words of at least half of a language's titles, where there are ten or more."""
    t = V.titles(spark, d)
    n = t.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 10")
    words = t.select("lang", F.explode(F.array_distinct(H.words_of(F.col("title")))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("titles"))
    return words.join(n, "lang").where(F.col("titles") >= 0.5 * F.col("n")).select("lang", "word", "titles")


_UNESCAPE = "regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g')"
for _entity, _char in H.ENTITIES.items():
    _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query("html_strip", f"SELECT page_id, trim(regexp_replace({_UNESCAPE}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, d):
    return V.table(spark, d, "pages").select("page_id", H.html_strip(F.col("html")).alias("text"))


_RSS = "CASE p_partkey % 3 WHEN 0 THEN p_name || ' - ' || p_brand WHEN 1 THEN p_name || ' - ' || p_type || ' - ' || p_brand ELSE p_name END"


@query("rss_title_split", f"SELECT p_partkey, CASE WHEN regexp_matches(t, '^.+ - .+$') THEN regexp_extract(t, '^(.+) - (.+)$', 1) ELSE t END AS headline, CASE WHEN regexp_matches(t, '^.+ - .+$') THEN regexp_extract(t, '^(.+) - (.+)$', 2) END AS publisher FROM (SELECT p_partkey, {_RSS} AS t FROM part)")
def rss_title_split(spark, d):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat_ws(" - ", "p_name", "p_brand")).when(k == 1, F.concat_ws(" - ", "p_name", "p_type", "p_brand")).otherwise(F.col("p_name"))
    return V.table(spark, d, "part").select("p_partkey", H.split_title(t).alias("s")).select("p_partkey", "s.headline", "s.publisher")


@query("url_clean", "SELECT page_id, CASE WHEN regexp_matches(u, '^(?i:https?)://[^/?#\\s]+') THEN u END AS url FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(url, '://', ':') WHEN page_id % 4 = 1 THEN 'ftp' || url ELSE url END AS u FROM pages)")
def url_clean(spark, d):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.replace("url", F.lit("://"), F.lit(":"))).when(k == 1, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url"))
    return V.table(spark, d, "pages").select("page_id", H.clean_url(u).alias("url"))


@query("redact", "SELECT page_id, regexp_replace(url || '&token=' || page_id || ' Bearer x' || page_id, '(?i)\\b(api_?key|token|password|secret)=([^&\\s]+)', '\\1=***', 'g').replace('Bearer x' || page_id, 'Bearer ***') AS text FROM pages")
def redact(spark, d):
    n = F.col("page_id").cast("string")
    return V.table(spark, d, "pages").select("page_id", H.redact(F.concat("url", F.lit("&token="), n, F.lit(" Bearer x"), n)).alias("text"))


@query("industry_phrase", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(split_part(p_name, ' ', 2)) || ' ' || lower(p_name) WHEN 1 THEN 'IT ' || lower(p_type) WHEN 2 THEN 'retail REITs' ELSE lower(p_name) END AS phrase FROM part")
def industry_phrase(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat("p_name", F.lit(" - "), F.split("p_name", " ")[1])).when(k == 1, F.concat(F.initcap("p_type"), F.lit(" - IT"))).when(k == 2, F.lit("REIT - Retail")).otherwise(F.concat("p_name", F.lit(" - General")))
    return V.table(spark, d, "part").select("p_partkey", H.industry_phrase(raw).alias("phrase"))
