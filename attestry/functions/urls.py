"""URL and address columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"(?i)^(?:utm_[a-z0-9_]*|fbclid|gclid|msclkid|mc_[ce]id|ref|source)$"


def canonical_url(url: Column) -> Column:
    """Lower-case host; no fragment, default port, tracking parameter or trailing slash; parameters sorted by name."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[^:]+://([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(
        scheme == "http", F.regexp_replace(host, ":80$", "")
    ).otherwise(host)
    path = F.regexp_extract(bare, r"^[^:]+://[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != "")
    kept = F.filter(params, lambda p: ~F.substring_index(p, "=", 1).rlike(TRACKING))
    keyed = F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("at"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_private_address(ip: Column) -> Column:
    """Private, loopback, link-local, reserved or malformed addresses."""
    low = F.lower(ip)
    four = F.when(low.contains(":"), F.regexp_extract(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)).otherwise(low)
    parts = F.transform(F.split(four, r"\."), lambda p: F.try_to_number(p, F.lit("999999")).cast("int"))
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    closed4 = (
        a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168))
        | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
    )
    v4 = F.when(valid, closed4).otherwise(True)
    closed6 = low.isin("::", "::1") | low.rlike("^(?:fe80|fc|fd|ff)")
    return F.when(low.contains(":"), F.when(closed6, True).when(four != "", v4).otherwise(False)).otherwise(v4)


def host_suffixes(host: Column) -> Column:
    """The host and every domain that it lies in, so that an allow list is met by an equi-join."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
