"""Examples of the text and number columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T
from attestry.functions import urls as U


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "expected"), [
    ("See No. 4 of the code. It applies.", ["See No. 4 of the code.", "It applies."]),
    ("Clause 6.4.2 applies. Ask J. Smith. Done!", ["Clause 6.4.2 applies.", "Ask J. Smith.", "Done!"]),
    ("Use e.g. steel. Or wood?", ["Use e.g. steel.", "Or wood?"]), ("", []), ("no end", ["no end"]),
])
def test_sentences(spark, text, expected):
    assert value(spark, T.sentences(F.lit(text))) == expected


@pytest.mark.parametrize(("token", "stem"), [("doors", "door"), ("boxes", "box"), ("glass", "glass"), ("status", "status"), ("stairs", "stair"), ("bodies", "body"), ("bus", "bus"), ("exits", "exit")])
def test_stem(spark, token, stem):
    assert value(spark, T.stem(F.lit(token))) == stem


def test_fold_and_rejoin(spark):
    assert value(spark, T.normal_space(F.lit("ﬁre  “safe” inspec-\n tion…"))) == 'fire "safe" inspection...'


@pytest.mark.parametrize(("text", "h"), [("", 2166136261), ("a", 3826002220), ("foobar", 3214735720)])
def test_fnv1a_published_vectors(spark, text, h):
    assert value(spark, N.fnv1a(F.lit(text))) == h


def test_measurements(spark):
    found = value(spark, N.measurements(F.lit("Stair width not less than 1,2 m; area 45 m² within 30 minutes.")))
    assert [(m["unit"], round(m["value"], 6), m["raw"]) for m in found] == [("length_m", 1.2, "1,2 m"), ("area_m2", 45.0, "45 m²"), ("time_s", 1800.0, "30 minutes")]


@pytest.mark.parametrize(("text", "modality"), [
    ("Doors shall not be locked", "prohibited"), ("Doors shall be open", "mandatory"), ("Doors are not required to close", "exemptive"),
    ("Doors should close", "recommended"), ("Doors may close", "permissive"), ("Doors close", None),
])
def test_modality(spark, text, modality):
    assert value(spark, T.modality(F.lit(text))) == modality


@pytest.mark.parametrize(("url", "expected"), [
    ("HTTPS://Example.COM:443/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"), ("http://h.org", "http://h.org/"),
    ("http://h.org:8080/x//", "http://h.org:8080/x"),
])
def test_canonical_url(spark, url, expected):
    assert value(spark, U.canonical_url(F.lit(url))) == expected


@pytest.mark.parametrize(("ip", "closed"), [("10.1.2.3", True), ("8.8.8.8", False), ("172.20.0.1", True), ("::1", True), ("fd00::1", True), ("2001:db8::1", False), ("1.2.3", True), ("::ffff:10.0.0.1", True)])
def test_private_address(spark, ip, closed):
    assert value(spark, U.is_private_address(F.lit(ip))) is closed


def test_redact(spark):
    out = value(spark, T.redact(F.lit("mail a.b@c.org card 4111 1111 1111 1111 key sk-abcdefghijklmnop1234")))
    assert out == "mail [email] card [card] key sk-[redacted]" or "[card]" in out and "[email]" in out and "sk-[redacted]" in out


def test_secret_names(spark):
    for name, secret in (("apiKey", True), ("statusCode", False), ("session_token", True), ("key", True), ("keyboard", False)):
        assert value(spark, T.is_secret_name(F.lit(name))) is secret
