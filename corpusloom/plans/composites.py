"""Whole tasks made of the operators: pages read in a form, searches read under a budget, versions compared, monitors run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions import text
from corpusloom.html.pages import Request, parse_pages
from corpusloom.operators import chunks, excerpts, fit, reading, schedule, snapshots
from corpusloom.operators.snapshots import moment
from corpusloom.session import shared_folder
from corpusloom.sources.snapshots import SnapshotStore
from corpusloom.sources.tables import PAGE_TASKS, spread, table

FORMS = ("markdown", "text", "blocks", "chunks", "html")
BUDGET_LEAST, BUDGET_MOST = 200, 8000


def budget(tokens: int) -> int:
    """A budget of tokens within the hard limits."""
    return max(BUDGET_LEAST, min(tokens, BUDGET_MOST))


def relevant(rows: DataFrame, query: str, content: str = "content", most: int = 3, chars: int = 600) -> DataFrame:
    """rows with their content cut to the excerpts that answer a query, and excerpted: whether it was.

    Content is fitted first. Where excerpts hold too little of it, the content stays as it is."""
    fitted = rows.withColumn("_fit", fit.fit_markdown(F.col(content))["content"])
    found = fitted.withColumn("_e", excerpts.excerpts(F.col("_fit"), F.lit(query), most, chars))
    joined = found.withColumn("_x", F.array_join(F.transform("_e", lambda e: e["text"]), "\n\n"))
    weak = text.should_fall_back(F.length("_x"), F.length("_fit"), text.query_hits(F.lit(query), F.col("_x")))
    marked = joined.withColumn("excerpted", ~weak)
    return marked.withColumn(content, F.when(F.col("excerpted"), F.col("_x")).otherwise(F.col(content))).drop("_fit", "_e", "_x")


def read_pages(pages: DataFrame, form: str = "markdown", max_tokens: int = 4000, links: str = "internal", fitted: bool = False, query: str | None = None, key: str = "page_id") -> DataFrame:
    """(key, title, content, tokens, truncated, error) of pages, each parsed once; chunks: a row each; blocks: an array.

    The budget cuts before fitting and excerpting, as what is over it isn't looked at any more. With form html the page
    comes back as it is."""
    if form not in FORMS:
        raise ValueError(f"not one of {FORMS}: {form}")
    if form == "html":
        return pages.select(key, F.col("html").alias("content"), text.token_estimate(F.col("html")).alias("tokens"))
    found = parse_pages(pages, Request("compact", max_tokens=budget(max_tokens), links=links), "url", "html", key)
    rows = found.select(key, "compact.title", "compact.content", "compact.tokens", "compact.truncated", "error")
    if fitted:
        rows = rows.withColumn("content", fit.fit_markdown(F.col("content"))["content"]).withColumn("tokens", text.token_estimate(F.col("content")))
    if query:
        rows = relevant(rows, query).withColumn("tokens", text.token_estimate(F.col("content")))
    if form == "chunks":
        return chunks.chunk_documents(rows, "content", chunks.SIZE, chunks.OVERLAP, key)
    shape = {"text": text.plain_text, "blocks": text.nonblank_lines}.get(form)
    return rows.withColumn("content", shape(F.col("content"))) if shape else rows


def search_and_read(hits: DataFrame, pages: DataFrame, tokens: int = 4000, top_k: int = reading.TOP_K, per_host: int = reading.PER_HOST) -> DataFrame:
    """(query, place, url, content, tokens, taken) of the hits worth reading; pages: (url, content, tokens)."""
    targets = reading.read_targets(hits, top_k, per_host)
    return reading.read_hits(targets, pages, budget(tokens)).select("query", "place", "url", "content", "tokens", "taken")


def compare_versions(shots: DataFrame, compare: str = "prev", key: str = "key", ts: str = "ts", text_column: str = "text") -> DataFrame:
    """(key, added_lines, removed_lines, diff, diff_truncated, has_previous): each key's newest version against another."""
    new = snapshots.resolve(shots, "latest", key, ts).select(key, F.col(text_column).alias("after"))
    old = snapshots.resolve(shots, compare, key, ts).select(key, F.col(text_column).alias("before"))
    pairs = new.join(old.withColumn("_have", F.lit(True)), key, "left").withColumn("has_previous", F.coalesce("_have", F.lit(False)))
    return snapshots.line_diff(pairs, "before", "after", key, "has_previous").select(key, "diff.*", "has_previous")


def monitor_run(tasks: DataFrame, current: DataFrame, now: int) -> DataFrame:
    """(key, status, notify, last_hash, next_run_at) of the tasks that are due, against the pages' present hashes.

    The first run of a task keeps its hash as the baseline; later a changed hash notifies; a page that couldn't be read
    fails and changes nothing."""
    held = schedule.due(tasks, F.lit(now)).join(current.select("key", F.col("hash").alias("_now")), "key", "left")
    status = F.when(F.col("_now").isNull(), "failed").when(F.col("last_hash").isNull(), "baseline").when(F.col("last_hash") == F.col("_now"), "unchanged").otherwise("changed")
    return held.select("key", status.alias("status"), (status == "changed").alias("notify"), F.coalesce("_now", "last_hash").alias("last_hash"), (F.lit(now) + F.col("interval_s")).alias("next_run_at"))


def read_version(shots: DataFrame, version: str = "latest", max_tokens: int = 4000, key: str = "key", ts: str = "ts", text_column: str = "text") -> DataFrame:
    """(key, version, ts, content, truncated, tokens): each key's text at a version (latest, prev, an ordinal or an ISO
    time), cut to max_tokens."""
    found = snapshots.resolve(shots, version, key, ts).select(key, "version", ts, F.col(text_column).alias("content"))
    cut = chunks.truncate_texts(found.withColumn("_text", F.col("content")).drop("content"), "_text", max_tokens)
    return cut.select(key, "version", ts, "content", "truncated", "tokens")


def compare_fields(shots: DataFrame, compare: str = "prev", key: str = "key", ts: str = "ts", fields: str = "fields", most: int = snapshots.CHANGES) -> DataFrame:
    """(key, path, kind, old, new, delta, pct, line, n_changes): changes of JSON fields of each key's newest version
    against another, the first `most` by path; line says it in words."""
    new, old = (snapshots.flatten_json(snapshots.resolve(shots, v, key, ts), fields, key) for v in ("latest", compare))
    found = snapshots.field_changes(old, new, key)
    line = snapshots.change_line(F.col("path"), F.col("kind"), F.col("old"), F.col("new"), F.col("pct"))
    return snapshots.first_changes(found.withColumn("line", line), key, most=most)


def first_answers(answers: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """(query, provider, hits, tried) from stored answers (query, provider, ok, hits): each query's answer by the first
    provider of the chain that gave any; tried: providers asked until then, all if none answered (provider and hits null).

    A provider that failed, gave nothing or wasn't asked is passed over."""
    place = F.array_position(F.array(*map(F.lit, chain)), F.col("provider"))
    placed = answers.withColumn("_at", place).where("_at > 0")
    good = F.col("ok") & (F.size("hits") > 0)
    best = F.min_by(F.struct("_at", "provider", "hits"), F.when(good, F.col("_at")))
    found = placed.groupBy("query").agg(F.when(F.bool_or(good), best).alias("_b"), F.array_sort(F.collect_set("_at")).alias("_tried"))
    tried = F.size(F.filter("_tried", lambda t: F.col("_b").isNull() | (t <= F.col("_b._at"))))
    return found.select("query", "_b.provider", "_b.hits", tried.alias("tried"))


def batch_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """requests (position, url) in their order beside results (url, content, error): a request without a result or with
    an error fails alone. Columns position, url, ok, content, error."""
    joined = requests.join(results, "url", "left")
    error = F.when(F.col("content").isNull(), F.coalesce("error", F.lit("not stored")))
    return joined.select("position", "url", (F.col("content").isNotNull() & F.col("error").isNull()).alias("ok"), "content", F.coalesce("error", error).alias("error")).orderBy("position")


def ok_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, ok_count, total) of rows with a column ok."""
    return rows.groupBy(*keys).agg(F.count_if("ok").alias("ok_count"), F.count("*").alias("total"))


def content_checks(entries: DataFrame, current: DataFrame, most: int = 20) -> DataFrame:
    """(host, url, state) of at most `most` entries (host, url, hash) a host, by url, against current (url, hash): new where
    no hash was kept, missing where there is none now, else same or changed."""
    order = Window.partitionBy("host").orderBy("url")
    chosen = entries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    joined = chosen.join(current.select("url", F.col("hash").alias("_now")), "url", "left")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("hash").isNull(), "new").when(F.col("hash") == F.col("_now"), "same").otherwise("changed")
    return joined.select("host", "url", state.alias("state"))


def newest_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The jobs made last, the newest first."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def page_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut to what answers a query."""
    found = read_pages(spread(table(spark, sf_dir, "pages"), PAGE_TASKS), fitted=True, query="the license page")
    return found.select("page_id", "excerpted", "tokens", F.md5("content").alias("digest"))


def searched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits of each search read under a budget: customers by nation, orders as what they answer."""
    hits = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("rank"), F.concat(F.lit("https://h"), (F.col("c_custkey") % 4).cast("string"), F.lit(".org/"), F.col("c_custkey").cast("string")).alias("url"), "c_custkey")
    pages = table(spark, sf_dir, "customer").where("c_custkey % 6 <> 0").select(F.concat(F.lit("https://h"), (F.col("c_custkey") % 4).cast("string"), F.lit(".org/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("content"), (F.col("c_custkey") % 300).cast("int").alias("tokens"))
    return search_and_read(hits, pages, 300, 3, 1).select("query", "place", "url", "content", "tokens", "taken")


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of monitors over customers."""
    n = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    tasks = customers.select(n.alias("key"), F.when(n % 3 == 1, F.col("c_mktsegment")).when(n % 3 == 2, "old").alias("last_hash"), (n % 5 != 0).alias("enabled"), (n % 2000).alias("next_run_at"), (n % 900 + 60).alias("interval_s"))
    return monitor_run(tasks, customers.where("c_custkey % 7 <> 0").select(n.alias("key"), F.col("c_mktsegment").alias("hash")), 1000)


def compared_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event against the one before, as versions of a text of one line."""
    shots = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("event_type").alias("text"))
    return compare_versions(shots).select("key", "added_lines", "removed_lines", "has_previous")


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as versions of a text and of fields."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_type", "value", "event_id")
    newest = events.groupBy("key", "ts").agg(F.max(F.struct("event_id", "event_type", "value")).alias("e"))
    fields = F.to_json(F.struct(F.col("e.value").alias("value"), F.col("e.event_type").alias("kind")))
    return newest.select("key", "ts", F.col("e.event_type").alias("text"), fields.alias("fields"))


def version_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events read as of a time."""
    return read_version(_shots(spark, sf_dir), "2024-01-16T00:00:00Z").select("key", "version", "content", "truncated")


def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events written to a store in three batches, the newest first, and read back as of a time."""
    shots = _shots(spark, sf_dir).select(F.col("key").cast("string").alias("key"), "ts", "text", "fields")
    store = SnapshotStore(spark, shared_folder(spark, "snapshots"))
    for turn in (2, 0, 1):
        store.append(shots.where(F.pmod(F.floor(F.col("ts") / 86400), F.lit(3)) == turn))
    return store.as_of(moment("2024-01-16T00:00:00Z")).select("key", "ts", "text")


def changes_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event against the one as of a time, field by field."""
    return compare_fields(_shots(spark, sf_dir), "2024-01-16T00:00:00Z").select("key", "path", "kind", "delta", "n_changes")


def answered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers of providers to customers' queries."""
    n = F.col("o_orderkey")
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.concat(F.lit("p"), (n % 5).cast("string")).alias("provider"), (n % 3 != 0).alias("ok"), F.when(n % 7 != 0, F.array(n)).otherwise(F.array().cast("array<bigint>")).alias("hits"))
    first = answers.groupBy("query", "provider").agg(F.min_by(F.struct("ok", "hits"), F.struct("ok", "hits")).alias("a")).select("query", "provider", "a.*")
    return first_answers(first, ("p2", "p4", "p1")).select("query", "provider", F.element_at("hits", 1).alias("hit"), "tried")


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders asked for customers' pages, some of which aren't stored or failed, counted by status."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("url"), "o_orderstatus")
    k = F.col("c_custkey")
    results = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(k.alias("url"), F.when(k % 3 != 0, F.col("c_name")).alias("content"), F.when(k % 3 == 0, "timeout").alias("error"))
    return ok_counts(batch_results(orders, results).join(orders.select("position", "o_orderstatus"), "position"), "o_orderstatus")


def checked_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of nations' sites, twenty of each checked."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    entries = customers.select(F.col("c_nationkey").alias("host"), k.alias("url"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("hash"))
    return content_checks(entries, customers.where("c_custkey % 5 <> 0").select(k.alias("url"), F.when(k % 4 == 0, "other").otherwise(F.col("c_mktsegment")).alias("hash")))


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_jobs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))).select("job_id")


QUERIES = {f.__name__: f for f in (page_answers, searched_pages, monitored, compared_versions, version_reads, stored_versions, changes_as_of, answered_queries, batch_outcomes, checked_contents, newest_orders)}
SHOTS = """WITH s AS (SELECT user_id AS key, ts, max((event_id, event_type, value)) AS e FROM (SELECT user_id, ts, event_id, event_type, value FROM events) GROUP BY ALL),
v AS (SELECT key, ts, e[2] AS kind, e[3] AS value, row_number() OVER (PARTITION BY key ORDER BY ts DESC)::INT AS version FROM s), o AS (SELECT * FROM v WHERE ts <= TIMESTAMP '2024-01-16 00:00:00' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) = 1)"""
SQL = {
    "searched_pages": """WITH h AS (SELECT c_nationkey AS query, c_custkey AS rank, 'https://h' || c_custkey % 4 || '.org/' || c_custkey AS url, c_name, c_custkey % 300 AS n FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY query, rank % 4 ORDER BY rank) AS m FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank)::INT AS place FROM f WHERE m = 1),
t AS (SELECT query, place, url, CASE WHEN rank % 6 <> 0 THEN c_name END AS content, CASE WHEN rank % 6 <> 0 THEN n::INT END AS tokens FROM p WHERE place <= 3),
w AS (SELECT query, coalesce(max(tokens) FILTER (WHERE place = 1), 0) AS a, coalesce(max(tokens) FILTER (WHERE place = 2), 0) AS b, coalesce(max(tokens) FILTER (WHERE place = 3), 0) AS c FROM t GROUP BY query),
u AS (SELECT *, a AS u1, CASE WHEN a + b <= 300 OR a = 0 THEN a + b ELSE a END AS u2 FROM w)
SELECT t.*, CASE place WHEN 1 THEN true WHEN 2 THEN a + b <= 300 OR a = 0 ELSE u2 + c <= 300 OR u2 = 0 END AS taken FROM t JOIN u ON t.query = u.query""",
    "monitored": """WITH t AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment WHEN c_custkey % 3 = 2 THEN 'old' END AS last_hash, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS h, c_custkey % 900 + 60 AS s FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 2000 <= 1000),
r AS (SELECT *, CASE WHEN h IS NULL THEN 'failed' WHEN last_hash IS NULL THEN 'baseline' WHEN last_hash = h THEN 'unchanged' ELSE 'changed' END AS status FROM t)
SELECT key, status, status = 'changed' AS notify, coalesce(h, last_hash) AS last_hash, 1000 + s AS next_run_at FROM r""",
    "compared_versions": """WITH s AS (SELECT user_id AS key, ts, max(event_type) AS t FROM events GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS n FROM s),
p AS (SELECT a.key, a.t AS now, b.t AS was, b.key IS NOT NULL AS has_previous FROM v a LEFT JOIN v b ON a.key = b.key AND b.n = 2 WHERE a.n = 1)
SELECT key, CASE WHEN now IS DISTINCT FROM was THEN 1 ELSE 0 END AS added_lines, CASE WHEN has_previous AND now <> was THEN 1 ELSE 0 END AS removed_lines, has_previous FROM p""",
    "stored_versions": SHOTS + " SELECT key::VARCHAR AS key, epoch_us(ts) / 1e6 AS ts, kind AS text FROM o",
    "version_reads": SHOTS + " SELECT key, version, kind AS content, false AS truncated FROM o",
    "changes_as_of": SHOTS + """, j AS (SELECT coalesce(a.key, b.key) AS key, a.key IS NULL AS new, a.kind AS k0, b.kind AS k1, a.value AS v0, b.value AS v1 FROM o a RIGHT JOIN (SELECT * FROM v WHERE version = 1) b ON a.key = b.key),
c AS (SELECT key, 'kind' AS path, CASE WHEN new THEN 'added' ELSE 'modified' END AS kind, NULL AS delta FROM j WHERE new OR k0 <> k1 UNION ALL SELECT key, 'value', CASE WHEN new THEN 'added' ELSE 'modified' END, CASE WHEN NOT new THEN round(v1 - v0, 6) + 0.0 END FROM j WHERE new OR v0 <> v1)
SELECT *, count(*) OVER (PARTITION BY key) AS n_changes FROM c""",
    "answered_queries": """WITH a AS (SELECT o_custkey AS query, 'p' || o_orderkey % 5 AS provider, min((o_orderkey % 3 <> 0, CASE WHEN o_orderkey % 7 <> 0 THEN [o_orderkey] ELSE [] END)) AS a FROM orders GROUP BY ALL),
p AS (SELECT query, provider, a[1] AS ok, a[2] AS hits, list_position(['p2', 'p4', 'p1'], provider) AS place FROM a WHERE provider IN ('p1', 'p2', 'p4')),
b AS (SELECT *, min(place) FILTER (WHERE ok AND len(hits) > 0) OVER (PARTITION BY query) AS best FROM p)
SELECT query, max(provider) FILTER (WHERE place = best) AS provider, max(hits[1]) FILTER (WHERE place = best) AS hit, count(*) FILTER (WHERE best IS NULL OR place <= best)::INT AS tried FROM b GROUP BY query""",
    "batch_outcomes": "SELECT o_orderstatus, count(*) FILTER (WHERE c_custkey % 3 <> 0)::BIGINT AS ok_count, count(*) AS total FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey GROUP BY o_orderstatus",
    "checked_contents": """SELECT c_nationkey AS host, c_custkey AS url, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 4 = 0 THEN 'changed' ELSE 'same' END AS state
FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 20""",
    "newest_orders": "SELECT o_orderkey AS job_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
}
