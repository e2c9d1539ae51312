"""What kind of answer a stored page is: content, challenge, refusal, shell or nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import SPACE, let, text_of

# Phrases, in lower case, that mark each kind of page or error, and its limits.
CHALLENGE = ("just a moment", "cf-chl", "cf_chl_opt", "checking your browser", "enable javascript and cookies to continue", "attention required! | cloudflare")
CAPTCHA = ("验证码", "人机验证", "安全验证", "滑动验证", "拖动滑块", "verify you are human", "geetest", "recaptcha", "hcaptcha")
SHELL = ('<div id="app"></div>', "<div id=app></div>", '<div id="root"></div>', "<div id=root></div>")
LOGIN = ('type="password"', "type='password'", "登录", "登陆", "密码", "sign in", "log in", "signin")
PROVIDERS = {
    "turnstile": ("cf-turnstile", "challenges.cloudflare.com/turnstile", "turnstile.render"),
    "datadome": ("datadome", "dd_cookie", "captcha-delivery.com", "geo.captcha-delivery"),
    "perimeterx": ("perimeterx", "px-captcha", "_pxhd", "px-cloud.net", "px-cdn.net"),
    "akamai": ("_abck", "ak_bmsc", "bm-verify", "sec-cpt", "akamai bot manager"),
    "cloudflare": ("just a moment", "cf-chl", "cf_chl_opt", "__cf_chl", "checking your browser", "attention required! | cloudflare", "needs to review the security of your connection"),
    "hcaptcha": ("hcaptcha", "h-captcha"),
    "recaptcha": ("recaptcha", "g-recaptcha", "grecaptcha"),
}
PUZZLES = ("recaptcha", "hcaptcha", "turnstile")
PUZZLE_HINTS = ("验证码", "人机验证", "安全验证", "滑动验证", "拖动滑块", "verify you are human", "captcha")
WAITING_HINTS = ("just a moment", "checking your browser", "attention required", "please wait")
SITE_KEYS = (r"""(?i)data-sitekey\s*=\s*["']([A-Za-z0-9_-]{6,200})["']""", r"""(?i)sitekey["']?\s*[:=]\s*["']([A-Za-z0-9_-]{6,200})["']""", r"""(?i)\brender\s*=\s*["']?([A-Za-z0-9_-]{20,})["']?""")
ACTION = r"""(?i)["']?action["']?\s*[:=]\s*["']([A-Za-z0-9_\-/]{1,64})["']"""
TELLING_HEADERS = ("server", "cf-ray", "x-datadome", "x-px", "x-akamai")
HIT, WALL = "命中 %s 特征: %s", "HTTP %s 且含登录入口"
EVIDENCE_CHARS = 160
TIMEOUT = ("timeout", "timed out", "time out", "read timeout")
DNS = ("could not resolve", "name or service not known", "getaddrinfo", "nodename nor servname", "temporary failure in name resolution", "no address associated")
TLS = ("ssl", "certificate", "tls", "handshake")
CONNECTION = ("connection", "refused", "reset by peer", "proxy", "connect")
CODES = (
    "ok", "invalid_url", "invalid_argument", "denied", "robots_disallowed", "login_required", "blocked", "timeout", "dns",
    "tls", "connection", "http_4xx", "http_5xx", "missing_required", "unsupported_content", "empty", "unknown", "no_snapshot",
)
RETRYABLE = ("timeout", "dns", "connection", "tls", "http_5xx", "unknown")
LOOKED_AT, VISIBLE_MIN, CAPTCHA_MAX, SHELL_HTML, SHELL_VISIBLE = 200_000, 200, 1500, 30_000, 2000
LOW_TOKENS = 250


def has_any(low: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(low, F.lit(mark))
    return out


def head(html: Column) -> Column:
    return F.lower(F.substring(text_of(html), 1, LOOKED_AT))


def visible_length(html: Column) -> Column:
    """Characters that are neither tags, nor white space, nor in scripts, styles and the like."""
    out = F.regexp_replace(text_of(html), r"(?is)<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>", "")
    return F.length(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", ""), rf"{SPACE}+", ""))


def is_shell(html: Column, visible: Column | None = None, most: int = SHELL_VISIBLE) -> Column:
    """Much markup, hardly any text."""
    return (F.length(text_of(html)) >= SHELL_HTML) & ((visible_length(html) if visible is None else visible) < most)


def is_login_wall(html: Column) -> Column:
    return has_any(head(html), LOGIN)


def block_kind(status: Column, html: Column, visible: Column | None = None) -> Column:
    """cloudflare, rate_limit, waf, captcha, empty_spa, empty or none; the first rule that holds decides."""
    low, visible = head(html), visible_length(html) if visible is None else visible
    return (
        F.when(has_any(low, CHALLENGE), "cloudflare")
        .when(status == 429, "rate_limit")
        .when(status.isin(401, 403, 451), "waf")
        .when(status.isin(503, 521, 522, 1020), "cloudflare")
        .when(status >= 500, "waf")
        .when(has_any(low, CAPTCHA) & (visible < CAPTCHA_MAX), "captcha")
        .when((visible < VISIBLE_MIN) & has_any(low, SHELL), "empty_spa")
        .when(visible < VISIBLE_MIN, "empty")
        .otherwise("none")
    )


def is_final_refusal(status: Column, html: Column) -> Column:
    """A refusal that waiting doesn't change: no challenge, no login, no shell to be filled."""
    low = head(html)
    return (status >= 400) & (F.trim(text_of(html)) != "") & ~has_any(low, CHALLENGE + CAPTCHA + LOGIN + SHELL) & ~is_shell(html)


def message_code(message: Column) -> Column:
    low = F.lower(text_of(message))
    return F.when(has_any(low, TIMEOUT), "timeout").when(has_any(low, DNS), "dns").when(has_any(low, TLS), "tls").when(has_any(low, CONNECTION), "connection").otherwise("unknown")


def outcome_code(status: Column, html: Column, blocked: Column, error: Column, login: Column | None = None, expired: Column | None = None) -> Column:
    """The one code of a fetched page: deadline, error text, block, status, emptiness, in this order."""
    no = F.lit(False)
    return (
        F.when(no if expired is None else expired, "timeout")
        .when(text_of(error) != "", message_code(error))
        .when(F.coalesce(blocked, F.lit("none")) != "none", F.when(no if login is None else login, "login_required").otherwise("blocked"))
        .when(status >= 500, "http_5xx")
        .when(status >= 400, "http_4xx")
        .when(F.trim(text_of(html)) == "", "empty")
        .otherwise("ok")
    )


def is_retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


def is_thin(html: Column, tokens: Column) -> Column:
    """Much markup, few tokens of content."""
    return (F.length(text_of(html)) >= SHELL_HTML) & (tokens < LOW_TOKENS)


def challenge(html: Column, status: Column, retry_after: Column | None = None, headers: Column | None = None) -> Column:
    """Who set up a challenge page and what it asks for: struct(provider, kind, sitekey, action, status, retry_after,
    evidence), null for a page that is none. Only the page's head is looked at.

    All marks are looked for once; the first provider in order with a mark that is there decides. kind is rate_limit (429),
    login_wall, captcha, interstitial or js_challenge. headers: a map, whose telling entries are the evidence if there are any."""
    none = F.lit(None).cast("string")
    raw = F.substring(text_of(html), 1, LOOKED_AT)
    marks = F.array(*[F.struct(F.lit(name).alias("provider"), F.lit(mark).alias("mark")) for name, of in PROVIDERS.items() for mark in of])
    group = lambda pattern, text: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    by_header = none
    if headers is not None:
        told = F.filter(F.map_entries(headers), lambda h: F.lower(h["key"]).isin(*TELLING_HEADERS))
        by_header = F.nullif(F.substring(F.array_join(F.transform(told, lambda h: F.concat(h["key"], F.lit("="), h["value"])), "；"), 1, EVIDENCE_CHARS), F.lit(""))
    wait = (F.lit(None) if retry_after is None else retry_after).cast("double")

    def whole(provider: Column, kind: Column, sitekey: Column, action: Column, evidence: Column) -> Column:
        return F.struct(provider.alias("provider"), kind.alias("kind"), sitekey.alias("sitekey"), action.alias("action"), status.cast("int").alias("status"), wait.alias("retry_after"), F.coalesce(by_header, evidence).alias("evidence"))

    def found_in(page: Column) -> Column:
        low, text = page["low"], page["raw"]

        def answer(x: Column) -> Column:
            provider, mark, key = x["hit"]["provider"], x["hit"]["mark"], x["key"]
            puzzle = provider.isin(*PUZZLES) | key.isNotNull() | has_any(low, PUZZLE_HINTS)
            kind = F.when(puzzle, "captcha").when(has_any(low, WAITING_HINTS), "interstitial").otherwise("js_challenge")
            limited = whole(F.coalesce(provider, F.lit("unknown")), F.lit("rate_limit"), none, none, F.coalesce(mark, F.lit("HTTP 429")))
            walled = whole(F.lit("unknown"), F.lit("login_wall"), none, none, F.format_string(WALL, status.cast("string")))
            named = whole(provider, kind, key, group(ACTION, text), F.format_string(HIT, provider, mark))
            wall = provider.isNull() & status.isin(401, 403) & has_any(low, LOGIN)
            return F.when(status == 429, limited).when(wall, walled).when(provider.isNotNull(), named)

        hit = F.get(F.filter(marks, lambda m: F.contains(low, m["mark"])), F.lit(0))
        return let(F.struct(hit.alias("hit"), F.coalesce(*[group(p, text) for p in SITE_KEYS]).alias("key")), answer)

    return F.when(text_of(html) != "", let(F.struct(F.lower(raw).alias("low"), raw.alias("raw")), found_in))
