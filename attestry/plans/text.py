"""Queries over text, number and URL columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T
from attestry.functions import urls as U
from attestry.plans.world import content_sql, in_sql, stem_sql, table, tokens_sql
from attestry.registry import register


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register("SELECT doc_id, md5(replace(text, ' de ', ' \"de\" - ')) AS folded FROM documents")
def t1_fold_lookalikes(spark, sf_dir):
    typeset = F.replace("text", F.lit(" de "), F.lit(" “de” —​ "))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.fold(typeset)).alias("folded"))


@register("SELECT doc_id, md5(text) AS rejoined FROM documents")
def t2_rejoin_hyphens(spark, sf_dir):
    broken = F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n$2")
    return docs(spark, sf_dir).select("doc_id", F.md5(T.rejoin_hyphens(broken)).alias("rejoined"))


@register("""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>')) AS INT) AS scripts,
  CAST(len(regexp_extract_all(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>')) AS INT) AS styles,
  CAST(length(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')) AS INT) AS n
FROM pages""")
def t3_strip_active(spark, sf_dir):
    text, removed = T.strip_active(F.col("html"))

    def count(name):
        own = F.filter(removed, lambda r: r.startswith(name))
        return F.coalesce(F.regexp_extract(F.get(own, F.lit(0)), "x(\\d+)", 1).cast("int"), F.lit(0))

    return table(spark, sf_dir, "pages").select("page_id", count("script").alias("scripts"), count("style").alias("styles"), F.length(text).alias("n"))


_HTML = "regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
_TEXT = f"replace(replace(replace(replace(replace(regexp_replace({_HTML}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"


@register(f"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TEXT}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text FROM pages")
def t4_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text"))


@register("SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS flat FROM documents")
def t5_normal_match(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normal_match(F.col("text"))).alias("flat"))


_PLAIN = "list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@register(f"""SELECT doc_id, len({_PLAIN}) AS n, {_PLAIN}[1] AS first FROM documents
WHERE NOT regexp_matches(text, '(?i)(^|[^a-z.])({"|".join(a.replace(".", "[.]") for a in T.ABBREVIATIONS)})[.]\\s') AND NOT regexp_matches(text, '(^|\\s)[A-Z][.]\\s') AND NOT regexp_matches(text, '\\d[.]\\s')""")
def t6_sentences(spark, sf_dir):
    short = "|".join(a.replace(".", "[.]") for a in T.ABBREVIATIONS)
    odd = F.col("text").rlike(rf"(?i)(^|[^a-z.])({short})[.]\s") | F.col("text").rlike(r"(^|\s)[A-Z][.]\s") | F.col("text").rlike(r"\d[.]\s")
    s = T.sentences(F.col("text"))
    return docs(spark, sf_dir).filter(~odd).select("doc_id", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).alias("first"))


@register(f"SELECT doc_id, len({tokens_sql('text')}) AS n, len(list_distinct({tokens_sql('text')})) AS kinds FROM documents")
def t7_tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))


@register(f"SELECT lang, CAST(sum(len({content_sql('text')})) AS BIGINT) AS n FROM documents GROUP BY lang")
def t8_content_tokens(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.size(T.content_tokens(F.col("text")))).alias("n"))


@register(f"""WITH w AS (SELECT unnest({content_sql('text')}) AS t FROM documents)
SELECT {stem_sql('t')} AS stem, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 20""")
def t9_stems(spark, sf_dir):
    w = docs(spark, sf_dir).select(F.explode(T.stems(F.col("text"))).alias("stem"))
    return w.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 20")


@register(f"""WITH w AS (SELECT DISTINCT unnest({content_sql('text')}) AS t FROM documents),
p AS (SELECT '<' || t || '>' AS p FROM w), g AS (
  SELECT substr(p, i, n) AS g FROM (SELECT p, n, unnest(range(1, length(p) - n + 2)) AS i FROM p, (SELECT unnest([3, 4, 5]) AS n)))
SELECT g AS gram, count(*) AS n FROM g GROUP BY g HAVING count(*) > 200""")
def t10_char_ngrams(spark, sf_dir):
    w = docs(spark, sf_dir).select(F.explode(T.content_tokens(F.col("text"))).alias("t")).distinct()
    grams = w.select(F.explode(T.char_ngrams(F.col("t"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 200")


@register(f"""WITH w AS (SELECT doc_id, list_distinct({content_sql('text')}) AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard
FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def t11_jaccard(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", F.array_distinct(T.content_tokens(F.col("text"))).alias("w"))
    b = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@register("SELECT doc_id, CAST(ceil(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 4.0) AS INT) AS tokens FROM documents")
def t12_token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@register("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, t, left(t, 100) AS cut, regexp_extract(left(t, 100), '(?s)^(.*) ', 1) AS whole FROM c)
SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE rtrim(CASE WHEN length(whole) > 60 THEN whole ELSE cut END) || '...' END AS short FROM s""")
def t13_truncate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.truncate_words(F.col("text"), 100).alias("short"))


@register("""SELECT p_partkey, CASE
  WHEN p_partkey % 4 = 0 THEN 'Ch. 6 · §6.' || p_size || ' · p. ' || p_partkey
  WHEN p_partkey % 4 = 1 THEN 'Sheet ' || p_brand || ' · A1:Z' || p_size
  WHEN p_partkey % 4 = 2 THEN p_brand || ' › ' || p_type ELSE '¶' || (p_size + 1) END AS label FROM part""")
def t14_locator_label(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit(None)
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", T.locator_label(
        F.when(k % 4 == 0, "6"), F.lit(None).cast("string"), F.when(k % 4 == 0, F.concat(F.lit("6."), size)),
        F.when(k % 4 == 1, F.col("p_brand")), F.when(k % 4 == 1, F.concat(F.lit("A1:Z"), size)), none.cast("int"),
        F.when(k % 4 == 0, k), F.when(k % 4 == 2, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")),
        F.when(k % 4 == 3, F.col("p_size")), none.cast("string"),
    ).alias("label"))


@register("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN '6.' || p_size || ',' || p_size || '.' || p_partkey % 900 || '.1' ELSE p_size || '.' || p_partkey % 900 || '.1' END AS VARCHAR) AS found FROM part""")
def t15_locators(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    named = F.when(k % 2 == 0, F.concat(F.lit("see clause 6."), n, F.lit(" and "))).otherwise("read ")
    text = F.concat(named, n, F.lit("."), (k % 900).cast("string"), F.lit(".1 or 1.2 of it"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.retrievable_locators(text), ",").alias("found"))


_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[a-z0-9]+)*'), lambda t: length(t) > 1 AND t NOT IN {in_sql(T.QUERY_STOPWORDS)}))"


@register(f"SELECT item_id, len({_TERMS}) AS terms, array_to_string(list_sort({_TERMS})[1:3], ',') AS first FROM benchmark")
def t17_query_terms(spark, sf_dir):
    t = T.query_terms(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).cast("long").alias("terms"), F.array_join(F.slice(F.array_sort(t), 1, 3), ",").alias("first"))


@register(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[email]', 'g'), '\b(?:\d[ -]?){13,19}\b', '[card]', 'g') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 2000 THEN left(t, 2000) || '...[truncated]' ELSE t END) AS t FROM r""")
def t18_redact(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.redact(F.col("text"))).alias("t"))


@register("SELECT event_type, count(*) AS n, event_type IN ('token', 'secret') AS bare, true AS coded FROM events GROUP BY event_type")
def t19_secret_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_type", "n", T.is_secret_name(F.col("event_type")).alias("bare"), T.is_secret_name(F.concat("event_type", F.lit("ApiKey"))).alias("coded"))


@register("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'exemptive' WHEN 1 THEN 'prohibited' WHEN 2 THEN 'mandatory' WHEN 3 THEN 'recommended' WHEN 4 THEN 'permissive' END AS modality,
  p_partkey % 6 IN (1, 2) AS requirement, '6.4.' || p_size AS refs, DATE '2026-01-01' + INTERVAL 1 DAY * (p_size % 28) AS effective FROM part""")
def t20_patterns(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    verb = F.element_at(F.array(*map(F.lit, ("is not required for", "shall not be", "shall be", "should be", "may be", "was seen"))), (k % 6 + 1).cast("int"))
    day = F.date_add(F.lit("2026-01-01").cast("date"), n % 28)
    text = F.concat(F.lit("Every stair of the tower "), verb, F.lit(" lit, in accordance with 6.4."), n.cast("string"), F.lit(", effective from "), day.cast("string"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", T.modality(text).alias("modality"), T.is_requirement(text).alias("requirement"),
        F.array_join(T.cross_references(text), ",").alias("refs"), T.effective_date(text).cast("timestamp").alias("effective"))


@register("SELECT p_partkey, 'the door ' || p_partkey || ' of ' || p_brand || ' not wider than ' || p_size || ' m' AS plain FROM part")
def t21_plain_obligation(spark, sf_dir):
    text = F.concat(F.lit("a) The door "), F.col("p_partkey").cast("string"), F.lit(" of "), F.col("p_brand"), F.lit(" shall not be wider than "), F.col("p_size").cast("string"), F.lit(" m."))
    return table(spark, sf_dir, "part").select("p_partkey", T.plain_obligation(text, F.col("p_name")).alias("plain"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@register(f"SELECT p_partkey, {_FNV} AS h FROM part")
def n1_fnv1a(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.fnv1a(F.col("p_name")).alias("h"))


@register("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def n2_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@register("""WITH f AS (SELECT vec_id, list_transform(range(1, 17), lambda i: embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE + embedding[i + 48]::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first, round(v[16] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS last FROM f""")
def n3_fold_vector(spark, sf_dir):
    v = N.fold_vector(F.col("embedding"), 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.col("v")[15], 5).alias("last"))


@register("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'length_m' WHEN 1 THEN 'area_m2' WHEN 2 THEN 'time_s' ELSE 'pressure_pa' END AS family,
  round(CASE p_partkey % 4 WHEN 0 THEN p_size * 0.3048 WHEN 1 THEN p_size / 10000.0 WHEN 2 THEN p_size * 60.0 ELSE p_size * 1000.0 END, 6) AS value FROM part""")
def n4_units(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("ft", "cm2", "minutes", "kpa"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.unit_family(unit).alias("family"), F.round(N.to_family_unit(F.col("p_size").cast("double"), unit), 6).alias("value"))


@register("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity <= p_size + 1e-9 WHEN 1 THEN l_quantity >= p_size - 1e-9
  ELSE abs(l_quantity - p_size) <= greatest(1e-9, p_size * 0.001) END AS ok FROM lineitem JOIN part ON p_partkey = l_partkey""")
def n5_direction(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    words = F.element_at(F.array(*map(F.lit, ("shall not exceed", "at least", "shall be"))), F.col("l_linenumber") % 3 + 1)
    return rows.select("l_orderkey", "l_linenumber", N.satisfies(words, F.col("p_size").cast("double"), F.col("l_quantity")).alias("ok"))


@register("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size < 20 THEN CAST(p_size * 50 AS VARCHAR) || ' mm' ELSE regexp_replace(printf('%.2f', p_size / 20.0), '\\.?0+$', '') || ' m' END
  WHEN 1 THEN CASE WHEN p_size >= 2 THEN printf('%.0f', p_size * 30 / 60.0 + 1e-9) || ' min' ELSE printf('%.0f', p_size * 30.0) || ' s' END
  WHEN 2 THEN p_size || '%' ELSE p_size || ' persons' END AS shown FROM part WHERE p_partkey % 4 <> 1 OR p_size % 2 = 0""")
def n6_display(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    unit = F.element_at(F.array(*map(F.lit, ("length_m", "time_s", "percent", "people"))), (k + 1).cast("int"))
    value = F.when(k == 0, n / 20).when(k == 1, n * 30).otherwise(n)
    rows = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 1 OR p_size % 2 = 0")
    return rows.select("p_partkey", N.display_quantity(unit, value).alias("shown"))


@register("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) END / (365 * 86400.0) AS years FROM orders)
SELECT o_orderkey, CASE WHEN years IS NULL THEN 0.5 ELSE round(greatest(0, least(1, 1 - years / 10)), 6) END AS rerank, CASE WHEN years IS NULL THEN 0.5 ELSE round(greatest(0, least(1, 1 - years / 15)), 6) END AS confidence FROM o""")
def n7_recency(spark, sf_dir):
    at, date = F.lit("2000-01-01").cast("timestamp"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(N.recency(date, at, 10), 6).alias("rerank"), F.round(N.recency(date, at, 15), 6).alias("confidence"))


@register("SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 700 THEN length(text) / 700.0 ELSE 700.0 / length(text) END, 6) AS fit FROM documents")
def n8_length_fit(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(N.length_fit(F.length("text")), 6).alias("fit"))


@register("SELECT event_id, least(600.0, power(2.0, event_id % 12) * 5) AS delay FROM events")
def n9_retry_delay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.retry_delay((F.col("event_id") % 12).cast("double")).alias("delay"))


@register("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def n10_content_digest(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.normal_space(F.col("text")), 256).alias("digest"))


@register("""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (
  SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(u, '^[^:]+://([^/?]*)', 1)) AS h, regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1) AS p,
    list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^(utm_[a-z0-9_]*|fbclid|gclid|msclkid|mc_[ce]id|ref|source)$'))) AS params FROM p)
SELECT page_id, s || '://' || CASE s WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE regexp_replace(h, ':80$', '') END
  || CASE WHEN p = '' OR regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM q""")
def u1_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@register("""WITH i AS (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b FROM events)
SELECT event_id, a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 100 AND b BETWEEN 64 AND 127)
  OR (a = 198 AND b IN (18, 19)) OR a >= 224 AS closed FROM i""")
def u2_private_address(spark, sf_dir):
    ip = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("1"), F.lit("2"))
    return table(spark, sf_dir, "events").select("event_id", U.is_private_address(ip).alias("closed"))


@register("""SELECT DISTINCT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS before, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'changed' END AS after FROM events WHERE event_id % 3 <> 0""")
def m1_audit_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    changed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("changed")
    before = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    after = F.create_map(F.lit("kind"), changed, F.lit("user"), F.col("user_id").cast("string"))
    keys = F.filter(F.map_keys(F.map_concat(before)), lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))
    rows = e.select("event_id", before.alias("b"), after.alias("a"), keys.alias("keys")).filter(F.size("keys") > 0)

    def side(c):
        return F.when(T.is_secret_name(F.col("keys")[0]), "[redacted]").otherwise(T.redact(F.element_at(c, F.col("keys")[0])))

    return rows.select("event_id", side("b").alias("before"), side("a").alias("after"))


@register("SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN '[redacted]' ELSE '[content:' || length(event_type) || ' chars]' END AS VARCHAR) AS value FROM events")
def m2_redact_map(spark, sf_dir):
    name = F.when(F.col("event_id") % 2 == 0, "sessionToken").otherwise("body")
    shown = F.when(T.is_secret_name(name), "[redacted]").when(name.isin(T.CONTENT_NAMES), F.concat(F.lit("[content:"), F.length("event_type").cast("string"), F.lit(" chars]"))).otherwise(T.redact(F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", shown.alias("value"))


@register("SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n, json_extract_string(props, '$.' || json_keys(props)[1]) AS value FROM events")
def m3_json_columns(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.size(m).alias("n"), F.get(F.map_values(m), F.lit(0)).alias("value"))


@register("SELECT event_id, CAST(round((event_id % 5) * 100 / 4.0) AS INT) AS percent FROM events")
def m4_stage_progress(spark, sf_dir):
    from attestry.operators.metrics import stage_progress

    stages = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.when(i <= F.col("event_id") % 5, "complete").otherwise("running").alias("state")))
    return table(spark, sf_dir, "events").select("event_id", stage_progress(stages).alias("percent"))
