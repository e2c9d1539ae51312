"""Queries over the stored tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import health, text, web
from corpusloom.operators import excerpts, fit, inventory, policy, postings, reading, snapshots, stats, usage, vectors
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.sources import searches
from corpusloom.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WHITE}+', ''), '{WHITE}+$', '')"


TOKENS = rf"""CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[\x{{3000}}-\x{{303f}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{ff00}}-\x{{ffef}}]'))
 + (length(regexp_replace(text, '{WHITE}+', '', 'g')) - len(regexp_extract_all(text, '[\x{{3000}}-\x{{303f}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{ff00}}-\x{{ffef}}]'))) / 4.0)::INT) END"""


@query(f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"""SELECT lang, source, count(*) AS docs, sum({TOKENS})::BIGINT AS tokens, max(n_chars) AS longest, count(DISTINCT text) AS distinct_texts
FROM documents GROUP BY lang, source""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the corpus by language and source."""
    docs = spread(table(spark, sf_dir, "documents").select("lang", "source", "n_chars", "text"))
    # texts are told apart by 128 bits, so that no text is shuffled to be counted
    digest = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1))))
    sized = docs.select("lang", "source", "n_chars", text.token_estimate(F.col("text")).alias("_n"), digest.alias("_d"))
    same = sized.groupBy("lang", "source", "_d").agg(F.count("*").alias("docs"), F.sum("_n").alias("_n"), F.max("n_chars").alias("longest"))
    return same.groupBy("lang", "source").agg(F.sum("docs").alias("docs"), F.sum("_n").alias("tokens"), F.max("longest").alias("longest"), F.count("_d").alias("distinct_texts"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::INT AS n_terms, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))::INT AS n_distinct FROM documents")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_terms"), F.size(F.array_distinct(found)).alias("n_distinct"))


@query(r"""
WITH steps AS (SELECT doc_id, '# Head' || chr(10) || '- ' || text || chr(10) || chr(10) || '> [link](/x) and `code`' || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' AS t FROM documents),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
 '(?m)^```.*$', '', 'g'), '(?m)^#{1,6}\s*', '', 'g'), '(?m)^\s{0,2}[-*]\s+', '', 'g'), '(?m)^\s{0,2}>\s?', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '\n{2,}', chr(10), 'g') AS p FROM steps)
SELECT doc_id, md5(regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '')) AS digest FROM plain""")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown without its marks."""
    marked = F.concat(F.lit("# Head\n- "), F.col("text"), F.lit("\n\n> [link](/x) and `code`\n```py\nx = 1\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain_text(marked)).alias("digest"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT doc_id, pos, {sql_strip('line')} AS line FROM l)
SELECT doc_id, count(*) FILTER (WHERE line <> '')::INT AS n_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line <> ''), '')) AS digest FROM s GROUP BY doc_id""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.nonblank_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_lines"), F.md5(F.array_join(found, "\n")).alias("digest"))


@query(r"""SELECT doc_id, sha256(array_to_string(list_transform(list_filter(string_split(replace(text || chr(13) || chr(10) || '  ' || chr(10), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: rtrim(x, ' ')), chr(10))) AS hash FROM documents""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines, line breaks and trailing white space don't change a hash."""
    return table(spark, sf_dir, "documents").select("doc_id", web.content_hash(F.concat("text", F.lit("\r\n  \n"))).alias("hash"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || text, chr(10))) AS line, generate_subscripts(string_split(text || chr(10) || text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS rn FROM (SELECT doc_id, pos, {sql_strip('line')} AS line FROM l) WHERE line <> '')
SELECT doc_id, count(*) FILTER (WHERE rn = 1 OR length(line) > 120)::INT AS n_kept, md5(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE rn = 1 OR length(line) > 120)) AS digest FROM n GROUP BY doc_id""")
def block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short blocks that repeat in a document stay once, long ones always."""
    rows = text.nonblank_lines(F.concat("text", F.lit("\n"), "text"))
    kept = F.filter(F.col("_l"), lambda x, i: (F.length(x) > 120) | (F.array_position(F.col("_l"), x) == i + 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", rows.alias("_l")).where(F.size("_l") > 0)
    return docs.select("doc_id", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("digest"))


FIT_INPUT = "text || chr(10) || '## Related posts' || chr(10) || left(text, 60) || chr(10) || '# Back' || chr(10) || '```' || chr(10) || '# Comments' || chr(10) || '```' || chr(10) || '[a](/a) [b](/b) [c](/c) | x' || chr(10) || 'All rights reserved, ' || source || chr(10) || 'Sponsored by [me](/me)' || chr(10) || '### Discussion' || chr(10) || left(text, 40)"


@query(rf"""
WITH src AS (SELECT doc_id, {FIT_INPUT} AS t FROM documents),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM src),
b AS (SELECT *, {sql_strip('line')} AS bare FROM l),
f AS (SELECT *, starts_with(bare, '```') AS fence, sum(CASE WHEN starts_with(bare, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS odd FROM b),
h AS (SELECT *, NOT fence AND NOT odd AND regexp_matches(bare, '^#{{1,6}}\s+(.*)$') AS heading, {sql_strip("regexp_replace(bare, '" + chr(92) + "[[^" + chr(92) + "]]*" + chr(92) + "]" + chr(92) + "([^)]*" + chr(92) + ")', '', 'g')")} AS beside, len(regexp_extract_all(bare, '\[[^\]]*\]\([^)]*\)')) AS links FROM f),
k AS (SELECT *, CASE WHEN NOT heading THEN NULL WHEN regexp_matches(regexp_extract(bare, '^#{{1,6}}\s+(.*)$', 1), '(?i)(Comments?|Discussion)') THEN 'comments'
  WHEN regexp_matches(regexp_extract(bare, '^#{{1,6}}\s+(.*)$', 1), '(?i)(You (?:may|might) also like|Related|Recommended)') THEN 'related'
  WHEN regexp_matches(regexp_extract(bare, '^#{{1,6}}\s+(.*)$', 1), '(?i)(Sponsored|Advertisement)') THEN 'ads' ELSE '' END AS opened FROM h),
s AS (SELECT *, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '') AS section FROM k),
d AS (SELECT *, CASE WHEN fence OR odd OR bare = '' THEN '' WHEN section <> '' THEN section WHEN heading THEN ''
  WHEN length(bare) <= 200 AND regexp_matches(CASE WHEN beside = '' THEN bare ELSE beside END, '(?i)(Sponsored|Advertisement)') THEN 'ads'
  WHEN length(bare) <= 200 AND regexp_matches(CASE WHEN beside = '' THEN bare ELSE beside END, '(?i)(©|All rights reserved|Privacy Policy|Terms of Service)') THEN 'footer'
  WHEN (links >= 3 AND length(beside) <= 40) OR (links >= 2 AND length(beside) <= 16) THEN 'nav' ELSE '' END AS kind FROM s),
g AS (SELECT doc_id, any_value(t) AS t, {sql_strip("string_agg(CASE WHEN bare = '' AND NOT odd THEN '' ELSE line END, chr(10) ORDER BY pos) FILTER (WHERE kind = '')")} AS fitted,
  count(*) FILTER (WHERE kind = 'nav')::INT AS nav, count(*) FILTER (WHERE kind = 'footer')::INT AS footer, count(*) FILTER (WHERE kind = 'comments')::INT AS comments, count(*) FILTER (WHERE kind = 'related')::INT AS related, count(*) FILTER (WHERE kind = 'ads')::INT AS ads FROM d GROUP BY doc_id),
a AS (SELECT *, fitted <> '' AND NOT (length(t) >= 400 AND length(fitted) < length(t) * 0.3) AS applied FROM g)
SELECT doc_id, applied, md5(CASE WHEN applied THEN fitted ELSE t END) AS digest, CASE WHEN applied THEN nav ELSE 0 END AS nav, CASE WHEN applied THEN footer ELSE 0 END AS footer,
  CASE WHEN applied THEN comments ELSE 0 END AS comments, CASE WHEN applied THEN related ELSE 0 END AS related, CASE WHEN applied THEN ads ELSE 0 END AS ads FROM a""")
def fit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of low value dropped from documents with sections, fences and footers put behind them."""
    content = F.expr(FIT_INPUT.replace("chr(10)", "'\\n'"))
    digest = text.let(fit.fit_markdown(content), lambda f: F.struct(f["applied"].alias("applied"), F.md5(f["content"]).alias("digest"), *[f["dropped"][k].alias(k) for k in fit.CATEGORIES]))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", text.unpacked(digest))


@query(r"""
WITH v AS (SELECT page_id, [200, 200, 403, 429, 503, 500, 404][(page_id % 7 + 1)::INT] AS status, html, lower(left(html, 200000)) AS low,
  length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
   '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g'), '(?is)<template\b[^>]*>.*?</template\s*>', '', 'g'), '(?is)<svg\b[^>]*>.*?</svg\s*>', '', 'g'), '<[^>]+>', '', 'g'), '\s+', '', 'g')) AS visible FROM pages)
SELECT page_id, visible::INT AS visible, CASE WHEN regexp_matches(low, 'just a moment|cf-chl|cf_chl_opt|checking your browser|enable javascript and cookies to continue|attention required! \| cloudflare') THEN 'cloudflare'
  WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403, 451) THEN 'waf' WHEN status IN (503, 521, 522, 1020) THEN 'cloudflare' WHEN status >= 500 THEN 'waf'
  WHEN regexp_matches(low, 'verify you are human|geetest|recaptcha|hcaptcha') AND visible < 1500 THEN 'captcha'
  WHEN visible < 200 AND regexp_matches(low, '<div id="?(app|root)"?></div>') THEN 'empty_spa' WHEN visible < 200 THEN 'empty' ELSE 'none' END AS kind,
  length(html) >= 30000 AND visible < 2000 AS shell, regexp_matches(low, 'type=["'']password["'']|sign in|log in|signin') AS login FROM v""")
def page_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenges, refusals, shells and empty pages, with status codes by page_id."""
    codes = F.array(*[F.lit(c) for c in (200, 200, 403, 429, 503, 500, 404)])
    pages = table(spark, sf_dir, "pages").select("page_id", F.get(codes, (F.col("page_id") % 7).cast("int")).alias("status"), "html", health.visible_length(F.col("html")).alias("visible"))
    html, visible = F.col("html"), F.col("visible")
    return pages.select("page_id", "visible", health.block_kind(F.col("status"), html, visible).alias("kind"), health.is_shell(html, visible).alias("shell"), health.is_login_wall(html).alias("login"))


#: What a page is given, by page_id, so that every kind of challenge is there.
MARKED = ("", "<div class=CF-Turnstile data-sitekey='0x4AAAAAAA'></div>", "<script>window.dd_cookie=1</script>", "px-captcha action: 'verify'", "<!-- _abck -->", "<title>Just a moment...</title>", "h-captcha 人机验证", "grecaptcha.render='abcdefghijklmnopqrstu'", "please log in", "__cf_chl_opt please wait")


@query(r"""
WITH k(i, provider, kind, sitekey, action, mark) AS (VALUES (1, 'turnstile', 'captcha', '0x4AAAAAAA', NULL, 'cf-turnstile'), (2, 'datadome', 'js_challenge', NULL, NULL, 'dd_cookie'), (3, 'perimeterx', 'captcha', NULL, 'verify', 'px-captcha'),
  (4, 'akamai', 'js_challenge', NULL, NULL, '_abck'), (5, 'cloudflare', 'interstitial', NULL, NULL, 'just a moment'), (6, 'hcaptcha', 'captcha', NULL, NULL, 'h-captcha'), (7, 'recaptcha', 'captcha', 'abcdefghijklmnopqrstu', NULL, 'recaptcha'), (9, 'cloudflare', 'interstitial', NULL, NULL, 'cf_chl_opt')),
p AS (SELECT page_id, page_id % 10 AS i, [200, 403, 429][(page_id // 10 % 3 + 1)::INT] AS status FROM pages)
SELECT page_id, CASE WHEN status = 429 THEN coalesce(provider, 'unknown') WHEN p.i = 8 THEN 'unknown' ELSE provider END AS provider,
  CASE WHEN status = 429 THEN 'rate_limit' WHEN p.i = 8 THEN 'login_wall' ELSE kind END AS kind, CASE WHEN status <> 429 THEN sitekey END AS sitekey, CASE WHEN status <> 429 THEN action END AS action,
  CASE WHEN status = 429 THEN coalesce(mark, 'HTTP 429') WHEN p.i = 8 THEN 'HTTP ' || status || ' 且含登录入口' ELSE '命中 ' || provider || ' 特征: ' || mark END AS evidence
FROM p LEFT JOIN k ON p.i = k.i WHERE provider IS NOT NULL OR status = 429 OR p.i = 8 AND status = 403""")
def challenge_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who set up the challenges on pages that are marked by page_id."""
    codes = F.get(F.array(F.lit(200), F.lit(403), F.lit(429)), (F.floor(F.col("page_id") / 10) % 3).cast("int"))
    mark = F.get(F.array(*[F.lit(m) for m in MARKED]), (F.col("page_id") % 10).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", codes.alias("status"), F.concat(mark, "html").alias("html"))
    found = pages.select("page_id", health.challenge(F.col("html"), F.col("status")).alias("c")).where("c is not null")
    return found.select("page_id", "c.provider", "c.kind", "c.sitekey", "c.action", "c.evidence")


ERRORS = ("", "", "", "Read timed out", "getaddrinfo failed", "SSL handshake", "Connection refused", "odd")


@query("""
WITH e AS (SELECT event_id, ['', '', '', 'Read timed out', 'getaddrinfo failed', 'SSL handshake', 'Connection refused', 'odd'][(event_id % 8 + 1)::INT] AS error,
  [200, 404, 500][(event_id % 3 + 1)::INT] AS status, CASE WHEN event_id % 11 = 0 THEN 'waf' ELSE 'none' END AS blocked, event_id % 22 = 0 AS login, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'x' END AS html FROM events),
c AS (SELECT event_id, CASE WHEN error LIKE '%timed out%' THEN 'timeout' WHEN error LIKE '%getaddrinfo%' THEN 'dns' WHEN error LIKE 'SSL%' THEN 'tls' WHEN error LIKE 'Connection%' THEN 'connection' WHEN error <> '' THEN 'unknown'
  WHEN blocked <> 'none' THEN CASE WHEN login THEN 'login_required' ELSE 'blocked' END WHEN status >= 500 THEN 'http_5xx' WHEN status >= 400 THEN 'http_4xx' WHEN trim(html) = '' THEN 'empty' ELSE 'ok' END AS code FROM e)
SELECT code, count(*) AS n, code IN ('timeout', 'dns', 'connection', 'tls', 'http_5xx', 'unknown') AS retryable FROM c GROUP BY code""")
def outcome_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    error, status = F.get(F.array(*[F.lit(e) for e in ERRORS]), (n % 8).cast("int")), F.get(F.array(F.lit(200), F.lit(404), F.lit(500)), (n % 3).cast("int"))
    code = health.outcome_code(status, F.when(n % 13 == 0, " ").otherwise("x"), F.when(n % 11 == 0, "waf").otherwise("none"), error, n % 22 == 0)
    return table(spark, sf_dir, "events").select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n")).withColumn("retryable", health.is_retryable(F.col("code")))


@query(r"""
WITH u AS (SELECT page_id, url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'UTM_x=1&keep=' || page_id || '&gclid=9#top' AS url FROM pages),
p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS auth, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
  list_filter(string_split(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|msclkid|spm)(=|$)')) AS q FROM u)
SELECT page_id, scheme || '://' || auth || path || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(q, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END AS canonical,
  regexp_replace(regexp_replace(auth, '^.*@|:\d*$', ''), '^www\.', '') AS host, left(sha256(url || chr(10)), 32) AS watch_key FROM p""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("UTM_x=1&keep="), F.col("page_id").cast("string"), F.lit("&gclid=9#top"))
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return pages.select("page_id", web.canonical_url(F.col("url")).alias("canonical"), web.bare_host(web.host(F.col("url"))).alias("host"), web.watch_key(F.col("url"), F.lit(None)).alias("watch_key"))


BM25 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b, len(list_filter(w, lambda x: x = 'ouble')) AS c FROM t),
s AS (SELECT count(*) AS total, avg(n) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc FROM c),
r AS (SELECT doc_id, round(CASE WHEN a > 0 THEN ln(1 + (total - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / av)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (total - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / av)) ELSE 0 END
  + CASE WHEN c > 0 THEN ln(1 + (total - dc + 0.5) / (dc + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / av)) ELSE 0 END, 6) AS score, ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) AS hits FROM c, s)
SELECT doc_id, score, hits, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 25"""


@query(BM25)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 documents that answer a query best."""
    return excerpts.search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "the License ouble", 25)


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents), s AS (SELECT count(*) AS total, avg(len(w)) AS av FROM w),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM conversations),
r AS (SELECT conv_id, turn, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))), 6) AS score, count(*)::INT AS hits FROM q JOIN d USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT conv_id, turn, doc_id, hits, round(score, 3) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id) <= 5""")
def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that answer each turn of the conversations best, all turns in one pass of an index."""
    asked = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("turn"), "text")
    found = postings.SearchIndex.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).search(asked, 5, "turn", "text")
    return found.select("turn.conv_id", "turn.turn", F.col("key").alias("doc_id"), "hits", F.round("score", 3).alias("score"), "rank")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_type").alias("hash"), F.length("props").alias("chars"), "event_id").withColumn("ts", F.col("us") / 1e6)


@query("SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS version FROM events")
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.versions(_snapshots(spark, sf_dir), tie="event_id").select("key", "event_id", "version")


@query("""WITH v AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS version FROM events)
SELECT key, event_id, version FROM v WHERE version <= 3 AND ts >= 1706572800 - 10 * 86400""")
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three versions of the last ten days."""
    return snapshots.retained(_snapshots(spark, sf_dir), F.lit(1706572800.0), 3, 10, tie="event_id").select("key", "event_id", "version")


@query("""SELECT user_id AS key, event_id, lag(event_type) OVER w AS previous_hash, lag(length(props)) OVER w AS previous_chars, row_number() OVER w = 1 AS first_seen,
  row_number() OVER w > 1 AND lag(event_type) OVER w IS DISTINCT FROM event_type AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(_snapshots(spark, sf_dir), tie="event_id").select("key", "event_id", "previous_hash", "previous_chars", "first_seen", "changed")


@query("""WITH m AS (SELECT DISTINCT c_custkey AS key, 1704067200.0::DOUBLE + (c_custkey % 30) * 86400 AS at FROM customer),
s AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS ts, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT m.key, m.at, s.ts, s.event_id FROM m ASOF LEFT JOIN s ON m.key = s.key AND m.at + 1e-4 >= s.ts""")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each key as of a day."""
    shots = _snapshots(spark, sf_dir).groupBy("key", "ts").agg(F.max("event_id").alias("event_id"))
    moments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.lit(1704067200.0) + (F.col("c_custkey") % 30) * 86400).alias("at")).distinct()
    return snapshots.as_of(shots, moments, values=("event_id",))


@query("""WITH p AS (SELECT url, max(CASE WHEN page_id % 3 = 0 THEN '2024-01-01' ELSE '' END) AS lastmod FROM pages WHERE page_id % 5 <> 0 GROUP BY url),
c AS (SELECT url, max(CASE WHEN page_id % 4 = 0 THEN '2024-01-01' ELSE '' END) AS lastmod FROM pages WHERE page_id % 7 <> 0 GROUP BY url)
SELECT coalesce(p.url, c.url) AS url, CASE WHEN p.url IS NULL THEN 'new' WHEN c.url IS NULL THEN 'removed' WHEN p.lastmod = c.lastmod THEN 'unchanged' ELSE 'changed' END AS state FROM p FULL JOIN c ON p.url = c.url""")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    of = lambda skip, every: pages.where(F.col("page_id") % skip != 0).groupBy("url").agg(F.max(F.when(F.col("page_id") % every == 0, "2024-01-01").otherwise("")).alias("lastmod"))
    return inventory.diff(of(5, 3), of(7, 4))


@query("""WITH p AS (SELECT url, max('2024-0' || (1 + page_id % 3)) AS lastmod, max(md5(html)) AS hash FROM pages WHERE page_id % 5 <> 0 GROUP BY url), c AS (SELECT url, max('2024-0' || (1 + page_id % 2)) AS lastmod FROM pages GROUP BY url)
SELECT c.url, c.lastmod, CASE WHEN p.lastmod = c.lastmod THEN p.hash END AS hash FROM c LEFT JOIN p ON c.url = p.url""")
def inventory_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes carried over where lastmod didn't change."""
    pages = table(spark, sf_dir, "pages")
    month = lambda k: F.max(F.concat(F.lit("2024-0"), (F.col("page_id") % k + 1).cast("string"))).alias("lastmod")
    return inventory.carry_hashes(pages.where("page_id % 5 <> 0").groupBy("url").agg(month(3), F.max(F.md5("html")).alias("hash")), pages.groupBy("url").agg(month(2)))


@query(r"""WITH a AS (SELECT url, 'sitemap' AS source, 0 AS p FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 'homepage', 1 FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 'search', 2 FROM pages WHERE page_id % 5 = 0),
f AS (SELECT url, source, p, row_number() OVER (PARTITION BY url ORDER BY p) AS n FROM a) SELECT url, source FROM f WHERE n = 1 ORDER BY p, encode(url) LIMIT 120""")
def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 addresses of three sources merged, by priority of the sources."""
    pages = table(spark, sf_dir, "pages")
    parts = [pages.where(F.col("page_id") % k == 0).select("url", F.lit(name).alias("source")) for k, name in ((2, "sitemap"), (3, "homepage"), (5, "search"))]
    return inventory.site_map(*parts, limit=120)


RULES = [(False, "/"), (True, "/2"), (False, "/20"), (True, "/wiki"), (True, "/p"), (False, "/p"), (False, "/page/1"), (True, "/a"), (False, "/art"), (False, "/blog"), (True, "/blog/1")]


@query("""WITH r(allow, pattern) AS (VALUES """ + ", ".join(f"({a}, '{p}')" for a, p in RULES) + r"""),
p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC) AS n FROM p JOIN r ON starts_with(path, pattern))
SELECT p.page_id, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"), web.part(F.col("url"), 3).alias("path"))
    rules = pages.select("host").distinct().crossJoin(F.broadcast(spark.createDataFrame(RULES, "allow boolean, pattern string")))  # eleven rules a host
    return policy.robots_allowed(pages, rules)


@query(r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':\d*$', '') AS host FROM pages),
r AS (SELECT DISTINCT host AS k FROM p WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(host, '[^.]+$') FROM p WHERE page_id % 2 = 0),
m AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY length(k) DESC) AS n FROM p JOIN r ON host = k OR ends_with(host, '.' || k))
SELECT p.page_id, m.k AS recipe FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1""")
def recipe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recipe of the longest host suffix."""
    pages = table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"))
    recipes = pages.where("page_id % 3 = 0").select("host").union(pages.where("page_id % 2 = 0").select(F.substring_index("host", ".", -1))).distinct()
    return policy.match_recipes(pages, recipes)


@query("""SELECT event_type AS tool, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts, round_even(avg(value), 0)::BIGINT AS avg_tokens, round_even(avg(length(props)), 0)::BIGINT AS avg_chars FROM events GROUP BY event_type""")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), "ts", F.col("value").alias("tokens"), F.length("props").alias("chars"))
    return stats.record_summary(records)


MS = "floor(value * 97)::BIGINT"


@query(f"""WITH e AS (SELECT event_type AS tier, {MS} AS ms FROM events) SELECT tier, count(*) AS samples, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99,
  count(*) FILTER (WHERE ms >= 0 AND ms < 100) AS lt_100, count(*) FILTER (WHERE ms >= 100 AND ms < 300) AS lt_300, count(*) FILTER (WHERE ms >= 300 AND ms < 1000) AS lt_1000, count(*) FILTER (WHERE ms >= 1000 AND ms < 3000) AS lt_3000,
  count(*) FILTER (WHERE ms >= 3000 AND ms < 10000) AS lt_10000, count(*) FILTER (WHERE ms >= 10000) AS gte_10000, count(*) FILTER (WHERE ms < 500) AS below_500, count(*) FILTER (WHERE ms < 5000) AS below_5000 FROM e GROUP BY tier""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and histograms by tier."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("tier"), F.floor(F.col("value") * 97).cast("long").alias("ms"))
    ranks = [stats.nearest_rank("ms", q).cast("long").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return log.groupBy("tier").agg(F.count("*").alias("samples"), *ranks, *stats.histogram(F.col("ms")), *stats.cumulative(F.col("ms"), (500, 5000)))


@query(f"""WITH e AS (SELECT event_type AS tier, {MS} AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT tier, list_sort(list(ms))[(round_even(0.95 * (count(*) - 1), 0) + 1)::INT] AS p95, max(ms) AS slowest FROM e WHERE n <= 1024 GROUP BY tier""")
def latest_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentile over each tier's 1,024 latest samples."""
    log = stats.latest(table(spark, sf_dir, "events"), "ts", "event_id", stats.WINDOW, "event_type")
    ms = F.floor(F.col("value") * 97).cast("long")
    return log.groupBy(F.col("event_type").alias("tier")).agg(stats.rounded_rank(ms, 0.95).alias("p95"), F.max(ms).alias("slowest"))


@query("""WITH r AS (SELECT source AS category, doc_id % 10 <> 3 AS passed, doc_id % 4 <> 1 AS fetched, n_chars FROM documents)
SELECT category, count(*) AS sites, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE fetched) AS fetched, round(count(*) FILTER (WHERE passed) / count(*), 4) AS pass_rate, floor(median(n_chars) FILTER (WHERE passed))::BIGINT AS median_chars FROM r GROUP BY category""")
def corpus_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass and fetch rates, median sizes by category."""
    runs = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), (F.col("doc_id") % 10 != 3).alias("passed"), (F.col("doc_id") % 4 != 1).alias("fetched"), "n_chars")
    return runs.groupBy("category").agg(F.count("*").alias("sites"), F.count_if("passed").alias("passed"), F.count_if("fetched").alias("fetched"), F.round(F.count_if("passed") / F.count("*"), 4).alias("pass_rate"), F.floor(F.median(F.when(F.col("passed"), F.col("n_chars")))).cast("long").alias("median_chars"))


@query("""SELECT doc_id AS id, round((n_chars - n_chars * (1 + doc_id % 3) // 2) / (n_chars * (1 + doc_id % 3) // 2), 4) AS delta FROM documents WHERE n_chars * (1 + doc_id % 3) // 2 > 0 AND round((n_chars - n_chars * (1 + doc_id % 3) // 2) / (n_chars * (1 + doc_id % 3) // 2), 4) < -0.2""")
def run_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = docs.select(F.col("doc_id").alias("id"), F.expr("n_chars * (1 + doc_id % 3) div 2").alias("chars"))
    return stats.regressions(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("chars")), base)


@query("""SELECT doc_id AS id, round(n_chars * 1.0 / (100 + doc_id % 900), 2) AS ratio FROM documents WHERE n_chars > greatest((100 + doc_id % 900) * 3.0, 100 + doc_id % 900 + 3000)""")
def run_slowdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = docs.select(F.col("doc_id").alias("id"), (F.lit(100) + F.col("doc_id") % 900).alias("elapsed_ms"))
    return stats.slow_sites(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("elapsed_ms")), base).select("id", "ratio")


HITS = "SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank, 'https://h' || l_suppkey % 3 || '.org/p' || l_partkey % 5 || '?utm_a=' || l_linenumber AS url, l_partkey AS n FROM lineitem"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    items.createOrReplaceTempView("_loom_lineitem")
    return spark.sql(HITS.replace("FROM lineitem", "FROM _loom_lineitem"))


@query(f"""WITH h AS ({HITS}), k AS (SELECT query, rank, url, regexp_extract(url, 'https://([^/]*)', 1) AS host, row_number() OVER (PARTITION BY query, split_part(url, '?', 1) ORDER BY rank) AS n FROM h),
c AS (SELECT *, row_number() OVER (PARTITION BY query, host ORDER BY rank) AS m FROM k WHERE n = 1), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank)::INT AS place FROM c WHERE m <= 2)
SELECT query, rank, url, place FROM p WHERE place <= 3""")
def read_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits a query, two a host, none twice."""
    return reading.read_targets(_hits(spark, sf_dir)).select("query", "rank", "url", "place")


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, l_quantity::BIGINT AS n FROM lineitem),
r AS (SELECT query, i, n AS used, true AS taken FROM o WHERE i = 1 UNION ALL SELECT o.query, o.i, CASE WHEN r.used + o.n <= 60 OR r.used = 0 THEN r.used + o.n ELSE r.used END, r.used + o.n <= 60 OR r.used = 0 FROM r JOIN o ON o.query = r.query AND o.i = r.i + 1)
SELECT query, count(*) FILTER (WHERE taken) AS n_taken, max(used) AS used FROM r GROUP BY query""")
def budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items taken in order while they fit; later ones may still fit."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("n")))).alias("_o"))
    sizes = F.transform("_o", lambda o: o["n"])
    filled = items.select("query", sizes.alias("_s"), reading.fill_budget(sizes, F.lit(60)).alias("_t"))
    used = F.aggregate(F.zip_with("_s", "_t", lambda n, t: F.when(t, n).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return filled.select("query", F.size(F.filter("_t", lambda t: t)).cast("long").alias("n_taken"), used.alias("used"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest each whose id is divisible by 50, among all."""
    found = table(spark, sf_dir, "embeddings")
    return vectors.nearest(found, found.where("vec_id % 50 = 0"), 5)


@query(None)  # what an index finds isn't said in SQL: its recall is tested
def vector_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the five vectors nearest each whose id is divisible by 50, by an index of all."""
    found = table(spark, sf_dir, "embeddings")
    return VectorIndex.build(found).search(found.where("vec_id % 50 = 0"), 5)


@query("""SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01') AS day, event_type AS tenant, count(*) AS requests, greatest(count(*) - 20, 0) AS over_quota FROM events GROUP BY ALL""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each tenant and day, and those beyond a quota of 20."""
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("event_type").alias("tenant")).agg(F.count("*").alias("requests"))
    return days.withColumn("over_quota", F.greatest(F.col("requests") - 20, F.lit(0)))


@query("""SELECT doc_id, coalesce(len(list_filter(['the', 'license', 'zzzz'], lambda w: contains(lower(text), w))), 0)::INT AS hits, greatest(0, instr(text, left(source, 3)) - 1)::INT AS found FROM documents""")
def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.query_hits(F.lit("the License zzzz the"), F.col("text")).alias("hits"), F.coalesce(text.locate(F.substring("source", 1, 3), F.col("text")), F.lit(0)).cast("int").alias("found"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS x FROM conversations)
SELECT conv_id, turn, role, md5(CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS cell, try_cast(replace(nullif(regexp_extract(text, '-?\d[\d,]*(?:\.\d+)?'), ''), ',', '') AS DOUBLE) AS number FROM c""")
def cells_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(text.csv_cell(F.col("text"))).alias("cell"), text.number(F.col("text")).alias("number"))


@query("""WITH l AS (SELECT event_id % 4 = 0 AS hit, event_id % 3 = 0 AS cached, floor(value)::BIGINT AS tokens, length(props) AS bytes FROM events)
SELECT count(*) AS requests, count(*) FILTER (WHERE NOT hit) AS fetches, count(*) FILTER (WHERE hit) AS result_cache_hits, count(*) FILTER (WHERE NOT hit AND cached) AS http_cache_hits, round(count(*) FILTER (WHERE hit) / count(*), 3) AS cache_hit_rate,
  sum(greatest(tokens, 0))::BIGINT AS tokens_returned, (sum(bytes) FILTER (WHERE NOT hit))::BIGINT AS bytes_in FROM l""")
def fetch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select((F.col("event_id") % 4 == 0).alias("result_hit"), (F.col("event_id") % 3 == 0).alias("cached"), F.floor("value").cast("long").alias("tokens"), F.length("props").alias("bytes"))
    return usage.fetch_counters(log)


@query("""SELECT 'lang' AS dimension, coalesce(nullif(lang, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM documents GROUP BY ALL""")
def counts_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.counts_by(table(spark, sf_dir, "documents"), "lang", "source")


@query("""WITH l AS (SELECT 'u' || user_id % 9 AS tenant, event_type AS tool, CASE WHEN event_id % 10 = 0 THEN 'rate' WHEN event_id % 15 = 1 THEN 'daily_quota' END AS reason FROM events),
t AS (SELECT tenant, string_agg('"' || tool || '":' || n, ',' ORDER BY tool) AS s FROM (SELECT tenant, tool, count(*) AS n FROM l WHERE reason IS NULL GROUP BY ALL) GROUP BY tenant),
r AS (SELECT tenant, string_agg('"' || reason || '":' || n, ',' ORDER BY reason) AS s FROM (SELECT tenant, reason, count(*) AS n FROM l WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY tenant)
SELECT l.tenant, count(*) AS requests, '{' || coalesce(any_value(t.s), '') || '}' AS tool_calls, '{' || coalesce(any_value(r.s), '') || '}' AS rejections FROM l LEFT JOIN t ON t.tenant = l.tenant LEFT JOIN r ON r.tenant = l.tenant GROUP BY l.tenant""")
def tenant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("tenant"), F.col("event_type").alias("tool"), F.when(n % 10 == 0, "rate").when(n % 15 == 1, "daily_quota").alias("reason"))
    return usage.tenant_usage(log).select("tenant", "requests", F.to_json("tool_calls").alias("tool_calls"), F.to_json("rejections").alias("rejections"))


@query("""WITH h AS (SELECT doc_id, 1 AS rank, 'A b' AS title, 'https://a.org/' || doc_id % 7 AS url, 'c' AS snippet FROM documents
UNION ALL SELECT doc_id, 2, 'https://a.org/' || doc_id % 3, 'https://a.org/' || doc_id % 3, '' FROM documents WHERE doc_id % 7 <> doc_id % 3) SELECT * FROM h""")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of JSON answers with a repeat, an address of another kind and an entry that is no object."""
    url = lambda n: F.concat(F.lit('"url":"https://a.org/'), (F.col("doc_id") % n).cast("string"), F.lit('"'))
    body = F.concat(F.lit('<pre>{"results":[{"title":" A  b ","content":"c",'), url(7), F.lit('},{"url":"ftp://x"},5,{'), url(3), F.lit("}]}</pre>"))
    return searches.json_hits(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "searxng", "body", 10, "doc_id").select("doc_id", "rank", "title", "url", "snippet")


@query("""SELECT user_id AS key, max(epoch_us(ts)) / 1e6 AS ts, 1706572800 - max(epoch_us(ts)) / 1e6 > 86400 AS stale FROM events GROUP BY user_id""")
def fresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stored row of each key, and whether a day has passed since."""
    return usage.fresh(_snapshots(spark, sf_dir).select("key", "ts"), F.lit(1706572800.0), 86400)


@query("""SELECT doc_id, len(list_filter(['The', 'LICENSE', 'zzzz'], lambda c: NOT contains(lower(coalesce(text, '')), lower(c))))::INT AS n_missing FROM documents""")
def missing_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = F.array(F.lit("The"), F.lit("LICENSE"), F.lit("zzzz"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(usage.missing_checks(F.col("text"), checks)).alias("n_missing"))


@query(r"""WITH s AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE '2024-01-0' || (1 + page_id % 5) END AS lastmod FROM pages WHERE page_id % 11 <> 0)
SELECT url, max(lastmod) AS lastmod FROM s GROUP BY url""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses read from sitemaps of one address each, the one with the latest lastmod of those that repeat."""
    pages = table(spark, sf_dir, "pages").where("page_id % 11 <> 0")
    stamp = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("<lastmod> 2024-01-0"), (F.col("page_id") % 5 + 1).cast("string"), F.lit(" </lastmod>")))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="x"><!-- <url><loc>no</loc></url> --><url><loc>'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), stamp, F.lit("</url></urlset>"))
    entries = inventory.sitemap_entries(pages.select("page_id", xml.alias("xml")), "xml", "page_id")
    return entries.groupBy("url").agg(F.max("lastmod").alias("lastmod"))
