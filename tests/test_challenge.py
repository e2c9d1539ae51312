"""Challenges on pages: whose, of what kind, with which keys."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import health


def asked(spark, html, status=200, headers=None, wait=None):
    frame = spark.createDataFrame([(html, status, headers, wait)], "html string, status int, headers map<string,string>, wait double")
    return frame.select(health.challenge(F.col("html"), F.col("status"), F.col("wait"), F.col("headers")).alias("c")).first()["c"]


@pytest.mark.parametrize(("html", "status", "want"), [
    ("<div class='cf-turnstile' data-sitekey='0xAbC_123' data-action='login'>captcha", 403, ("turnstile", "captcha", "0xAbC_123", "login")),
    ("Checking your browser before", 503, ("cloudflare", "interstitial", None, None)), ("<script src=//ct.captcha-delivery.com>", 403, ("datadome", "captcha", None, None)),
    ("var _pxhd='1'", 403, ("perimeterx", "js_challenge", None, None)), ("bm-verify", 200, ("akamai", "js_challenge", None, None)), ("g-recaptcha {sitekey: 'k1234567'}", 200, ("recaptcha", "captcha", "k1234567", None)),
    ("nothing here", 429, ("unknown", "rate_limit", None, None)), ("<input type='password'>", 401, ("unknown", "login_wall", None, None)),
])
def test_kinds(spark, html, status, want):
    c = asked(spark, html, status)
    assert (c["provider"], c["kind"], c["sitekey"], c["action"], c["status"]) == (*want, status)


def test_what_is_none(spark):
    assert asked(spark, None) is None and asked(spark, "") is None and asked(spark, "an article", 403) is None
    assert asked(spark, "<input type='password'>", 200) is None and asked(spark, "x" * health.LOOKED_AT + "hcaptcha") is None


def test_evidence(spark):
    c = asked(spark, "_abck", 429, {"Server": "AkamaiGHost", "Age": "1"}, 7.5)
    assert (c["provider"], c["evidence"], c["retry_after"]) == ("akamai", "Server=AkamaiGHost", 7.5)
    assert asked(spark, "_abck", 429)["evidence"] == "_abck" and "datadome" in asked(spark, "DataDome")["evidence"]
