"""Dates, names, formatting, chart payloads and stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import P_SQL, p, query, table
from seriesloom.functions import dates, labels, names, payloads
from seriesloom.operators import pages
from seriesloom.plans import collection_plan

# ---- dates -----------------------------------------------------------------------


@query("dat5_horizon_dates", f"""
WITH {P_SQL} SELECT tie, CAST(ts + 7 AS DATE) AS prediction_date, strftime(ts, '%Y-%m-%d') AS feature_date,
  CAST(DATE '2001-08-02' - ts AS INTEGER) AS age_days FROM p""", as_text=("prediction_date",))
def dat5(spark, sf):
    return p(spark, sf).select(
        "tie", dates.horizon_date(F.col("ts"), F.lit(7)).alias("prediction_date"),
        dates.iso_date(F.col("ts")).alias("feature_date"),
        F.datediff(F.lit("2001-08-02").cast("date"), "ts").alias("age_days"))


@query("dat6_parse_dates", """
SELECT o_orderkey, TRY_CAST(t AS DATE) AS d FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)""",
       as_text=("d",))
def dat6(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not a date")).otherwise(dates.iso_date(F.col("o_orderdate")))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_date(text).alias("d"))


@query("dat7_epoch_days", "SELECT event_id, CAST(make_timestamp(epoch_us(ts)) AS DATE) AS d FROM events", as_text=("d",))
def dat7(spark, sf):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", dates.epoch_day(seconds).alias("d"))


# ---- names -----------------------------------------------------------------------

_NAME_SQL = """n AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || '-' || replace(p_name, ' ', '_')
  WHEN 1 THEN p_brand ELSE concat_ws('-', replace(p_type, ' ', '_'), p_partkey, replace(p_name, ' ', '_'), p_size) END AS name FROM part)"""


def _part_names(spark, sf):
    size = F.col("p_size")
    under = F.replace("p_name", F.lit(" "), F.lit("_"))
    name = (
        F.when(size % 3 == 0, F.concat_ws("-", "p_brand", under))
        .when(size % 3 == 1, F.col("p_brand"))
        .otherwise(F.concat_ws("-", F.replace("p_type", F.lit(" "), F.lit("_")), "p_partkey", under, size))
    )
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


@query("str1_asset_name", f"""
WITH {_NAME_SQL}, s AS (SELECT p_partkey, name, string_split(name, '-') AS x FROM n)
SELECT p_partkey, CASE WHEN len(x) >= 2 THEN replace(x[1], '_', ' ') ELSE name END AS brand,
  CASE WHEN len(x) >= 3 THEN x[2] ELSE 'unknown' END AS id,
  CASE WHEN len(x) >= 3 THEN replace(array_to_string(x[3:], '-'), '_', ' ') WHEN len(x) = 2 THEN replace(x[2], '_', ' ') ELSE 'unknown' END AS model,
  CASE WHEN len(x) >= 3 THEN replace(x[1], '_', ' ') || ' ' || replace(array_to_string(x[3:], '-'), '_', ' ')
       WHEN len(x) = 2 THEN x[1] || ' ' || x[2] ELSE name END AS full_name FROM s""")
def str1(spark, sf):
    return _part_names(spark, sf).select("p_partkey", *[c.alias(n) for n, c in names.asset_name(F.col("name")).items()])


@query("str2_file_name", f"""
WITH {_NAME_SQL}, s AS (SELECT p_partkey, string_split(name, '-') AS x FROM n)
SELECT p_partkey, x[1] AS brand, CASE WHEN len(x) > 2 THEN array_to_string(x[2:len(x) - 1], '-') ELSE 'Unknown' END AS model, x[len(x)] AS id FROM s""")
def str2(spark, sf):
    file = F.concat("name", F.lit(".csv"))
    return _part_names(spark, sf).select("p_partkey", *[c.alias(n) for n, c in names.file_name(file).items()])


_ADDRESS = """a AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'https://x.example/other/' || replace(p_name, ' ', '-') || '-' || p_size || 'ab'
  WHEN p_size % 4 = 1 THEN 'https://x.example/item/' || p_partkey || '-' || replace(p_name, ' ', '') || '/more'
  ELSE 'https://x.example/item/' || p_partkey || '-' || replace(p_name, ' ', '-') || '-' || p_size || 'ab-' || p_type END AS url FROM part)"""


def _addresses(spark, sf):
    size, dashed = F.col("p_size"), F.replace("p_name", F.lit(" "), F.lit("-"))
    tail = F.concat(F.lit("-"), size.cast("string"), F.lit("ab"))
    item = F.concat(F.lit("https://x.example/item/"), F.col("p_partkey").cast("string"), F.lit("-"))
    url = (
        F.when(size % 4 == 0, F.concat(F.lit("https://x.example/other/"), dashed, tail))
        .when(size % 4 == 1, F.concat(item, F.replace("p_name", F.lit(" "), F.lit("")), F.lit("/more")))
        .otherwise(F.concat(item, dashed, tail, F.lit("-"), F.col("p_type")))
    )
    return table(spark, sf, "part").select("p_partkey", "p_name", size.alias("p_size"), url.alias("url"))


_TITLE = """array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches({x}[i - 1:i - 1], '\\p{{L}}')
  THEN upper({x}[i:i]) ELSE lower({x}[i:i]) END), '')"""


@query("str3_product_address", f"""
WITH {_ADDRESS}, s AS (SELECT p_partkey, url, contains(url, '/item/') AS is_item,
  string_split(string_split(string_split(url, '/item/')[2], '/')[1], '-') AS x FROM a),
t AS (SELECT p_partkey, CASE WHEN is_item THEN x[1] ELSE '' END AS watch_id,
  replace(CASE WHEN NOT is_item THEN string_split(url, '/')[-1] WHEN len(x) >= 3 THEN array_to_string(x[3:], '-')
    WHEN len(x) = 2 THEN x[2] ELSE '' END, '-', ' ') AS raw FROM s)
SELECT p_partkey, watch_id, watch_id AS model_id, {_TITLE.format(x='raw')} AS model_name FROM t""")
def str3(spark, sf):
    parts = names.product_address(F.col("url"), "/item/")
    return _addresses(spark, sf).select("p_partkey", *[c.alias(n) for n, c in parts.items()])


@query("str4_slug", """
SELECT s_suppkey, trim(regexp_replace(lower('#' || s_name || ' ' || s_acctbal), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier""")
def str4(spark, sf):
    text = F.concat(F.lit("#"), F.col("s_name"), F.lit(" "), F.col("s_acctbal").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", names.slug(text).alias("slug"))


@query("str5_last_segment", "SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS segment FROM pages")
def str5(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.last_segment(F.col("url")).alias("segment"))


@query("str6_safe_file_name", r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[<>:"/\\|?*]', '_', 'g') AS t FROM documents),
b AS (SELECT doc_id, trim(replace(trim(regexp_replace(regexp_replace(t, '[\x00-\x1f]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')), ' ', '_'), '._ ') AS t FROM a)
SELECT doc_id, coalesce(nullif(CASE WHEN length(t) > 200 THEN rtrim(left(t, 200), '._') ELSE t END, ''), 'unnamed') AS name FROM b""")
def str6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.safe_file_name(F.col("text")).alias("name"))


@query("str7_output_name", r"""
SELECT p_partkey, replace(replace(p_brand, ' ', '_'), '/', '_') || '-' || replace(p_name, ' ', '_') || '-' ||
  CASE WHEN p_size % 3 = 0 THEN 'unknown' WHEN p_size % 3 = 1 THEN 'm' || p_size ELSE CAST(p_partkey AS VARCHAR) END || '.csv' AS name FROM part""")
def str7(spark, sf):
    size = F.col("p_size")
    own = F.when(size % 3 == 2, F.col("p_partkey").cast("string")).otherwise(F.lit(""))
    model = F.when(size % 3 == 1, F.concat(F.lit("m"), size.cast("string")))
    return table(spark, sf, "part").select(
        "p_partkey", names.output_name(F.col("p_brand"), F.col("p_name"), own, model).alias("name"))


@query("str8_asset_label", """
WITH a AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size AS asset, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE '' END AS brand FROM part),
s AS (SELECT p_partkey, brand, list_filter(string_split(asset, '_'), lambda x: x <> '') AS x FROM a),
c AS (SELECT p_partkey, brand, x[-1] AS ref, x[1:len(x) - 1] AS core, list_filter(x[1:len(x) - 1], lambda v: lower(v) <> lower(brand)) AS cut FROM s),
l AS (SELECT p_partkey, ref, trim(concat_ws(' ', nullif(brand, ''), nullif(array_to_string(CASE WHEN brand <> '' AND len(cut) > 0 THEN cut ELSE core END, ' '), ''))) AS label FROM c)
SELECT p_partkey, CASE WHEN contains(lower(label), lower(ref)) THEN label WHEN label = '' THEN ref ELSE label || ' (' || ref || ')' END AS label FROM l""")
def str8(spark, sf):
    asset = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))
    brand = F.when(F.col("p_size") % 2 == 0, F.get(F.split("p_name", " "), F.lit(0))).otherwise(F.lit(""))
    return table(spark, sf, "part").select("p_partkey", names.asset_label(asset, brand).alias("label"))


@query("str9_currency_text", """
SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'N/A' ELSE 'S$' || format('{:,.2f}', c_acctbal) END AS price_text,
  CASE WHEN c_acctbal > 9000 THEN 'N/A' WHEN c_acctbal >= 0 THEN '+S$' || format('{:,.2f}', c_acctbal)
       ELSE '-S$' || format('{:,.2f}', abs(c_acctbal)) END AS delta_text FROM customer""")
def str9(spark, sf):
    value = F.when(F.col("c_acctbal") <= 9000, F.col("c_acctbal"))
    return table(spark, sf, "customer").select(
        "c_custkey", labels.currency(value).alias("price_text"), labels.signed_currency(value).alias("delta_text"))


@query("str11_backfilled_ids", f"""
WITH {_ADDRESS}, t AS (SELECT p.p_partkey, CASE WHEN p_size % 5 = 0 THEN 'given' ELSE '' END AS w,
  CASE WHEN p_size % 5 = 1 THEN p_size || ' - ' || p_name ELSE p_name END AS m, url FROM part p JOIN a USING (p_partkey)),
u AS (SELECT p_partkey, m, url, coalesce(nullif(w, ''), nullif(regexp_extract(m, '^([0-9]+) - ', 1), ''),
  nullif(regexp_extract(url, '/item/([0-9]+)-', 1), '')) AS watch_id, w FROM t)
SELECT p_partkey, watch_id, CASE WHEN w = '' THEN regexp_replace(m, '^[0-9]+ - ', '') ELSE m END AS model_name FROM u WHERE watch_id IS NOT NULL""")
def str11(spark, sf):
    size = F.col("p_size")
    raw = _addresses(spark, sf).select(
        "p_partkey", "url", F.lit("b").alias("brand"), F.when(size % 5 == 0, F.lit("given")).otherwise(F.lit("")).alias("watch_id"),
        F.when(size % 5 == 1, F.concat(size.cast("string"), F.lit(" - "), F.col("p_name"))).otherwise(F.col("p_name")).alias("model_name"))
    return collection_plan.usable_targets(raw, "/item/").select("p_partkey", "watch_id", "model_name")


# ---- chart payloads --------------------------------------------------------------------


def _payload_rows(spark, sf):
    v = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", v)
        .when(kind == "view", F.concat(F.lit('{"other": 1, "avg": '), v, F.lit("}")))
        .when(kind == "signup", F.concat(F.lit('["x", null, '), v, F.lit("]")))
        .when(kind == "purchase", F.concat(F.lit('"'), v, F.lit('"')))
        .when(F.col("event_id") % 2 == 0, F.lit('{"zz": "no"}'))
        .otherwise(F.concat(F.lit('{"zz": "no", "zy": '), v, F.lit("}")))
    )
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    text = F.concat(F.lit('{"data": {"all": {"'), epoch, F.lit('": '), value, F.lit("}}}"))
    return table(spark, sf, "events").select("event_id", text.alias("payload"))


_PAYLOAD_SQL = """SELECT event_id, CAST(ts AS DATE) AS date, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS price
FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0)"""


@query("src11_chart_payload", """
SELECT event_id, CAST(ts AS DATE) AS date, CASE event_type WHEN 'click' THEN k WHEN 'view' THEN '{"avg":' || k || ',"other":1}'
  WHEN 'signup' THEN '["x",null,' || k || ']' WHEN 'purchase' THEN '"' || k || '"'
  ELSE CASE WHEN event_id % 2 = 0 THEN '{"zz":"no"}' ELSE '{"zy":' || k || ',"zz":"no"}' END END AS value
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""", as_text=("date",))
def src11(spark, sf):
    rows = payloads.chart_rows(_payload_rows(spark, sf), "payload", ["event_id"])
    return rows.select("event_id", "date", F.to_json("value").alias("value"))


@query("jsn1_normalised_prices", _PAYLOAD_SQL, as_text=("date",))
def jsn1(spark, sf):
    rows = payloads.chart_rows(_payload_rows(spark, sf), "payload", ["event_id"])
    return payloads.normalise_prices(rows)


# ---- stored pages ----------------------------------------------------------------------

_LINKS = """raw AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) AS x FROM pages),
flat AS (SELECT page_id, url, unnest(x) AS raw, unnest(range(1, len(x) + 1)) AS pos FROM raw),
links AS (SELECT page_id, pos, raw, CASE WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN raw
  WHEN starts_with(raw, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || raw
  WHEN starts_with(raw, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || raw
  WHEN starts_with(raw, '#') OR starts_with(raw, '?') THEN regexp_replace(url, '[?#].*$', '') || raw
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || raw END AS href, url AS page_url FROM flat WHERE raw <> ''),
strict AS (SELECT page_id, href, min(pos) AS pos FROM links WHERE contains(raw, '/t') AND contains(lower(href), 'example') GROUP BY 1, 2),
heads AS (SELECT * FROM links WHERE contains(raw, 'e') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 50),
broad AS (SELECT page_id, href, min(pos) AS pos FROM heads WHERE contains(lower(href), 'example') AND NOT contains(lower(href), '/the') GROUP BY 1, 2)"""


@query("str12_strict_links", f"""
WITH {_LINKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href AS url FROM strict
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3""")
def str12(spark, sf):
    return pages.extract(table(spark, sf, "pages"), F.lit("example"), 3, [pages.strict("/t")])


@query("str13_broad_links", f"""
WITH {_LINKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href AS url FROM broad
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 40""")
def str13(spark, sf):
    return pages.extract(table(spark, sf, "pages"), F.lit("example"), 40, [pages.broad("e", 50, "/the")])


@query("set3_link_chain", f"""
WITH {_LINKS}, a AS (SELECT page_id, href, pos FROM strict QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 4),
n AS (SELECT page_id, count(*) AS n FROM a GROUP BY 1),
b AS (SELECT broad.page_id, href FROM broad LEFT JOIN n ON n.page_id = broad.page_id
  QUALIFY row_number() OVER (PARTITION BY broad.page_id ORDER BY broad.pos) <= 4 - coalesce(n.n, 0))
SELECT page_id, href AS url FROM a UNION SELECT page_id, href FROM b""")
def set3(spark, sf):
    chain = [pages.strict("/t"), pages.strict("/t"), pages.broad("e", 50, "/the")]
    return pages.extract(table(spark, sf, "pages"), F.lit("example"), 4, chain).select("page_id", "url")


@query("flt12_challenge_pages", """
SELECT page_id, (CASE WHEN contains(lower(html), 'nicht') THEN 1 ELSE 0 END + CASE WHEN contains(lower(html), 'que') THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(html), 'haere') THEN 1 ELSE 0 END) < 2 AND (contains(lower(html), 'track(1') OR contains(lower(html), 'the')) AS is_challenge FROM pages""")
def flt12(spark, sf):
    test = pages.is_challenge(F.col("html"), ("nicht", "que", "haere"), ("track(1", "the"))
    return table(spark, sf, "pages").select("page_id", test.alias("is_challenge"))


@query("src14_brand_dimension", """
SELECT DISTINCT p_brand AS brand, 'https://x.example/brand/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS url FROM part""")
def src14(spark, sf):
    from seriesloom.sources.readers import brand_dimension

    return brand_dimension(table(spark, sf, "part"), "p_brand", "https://x.example/brand/")


_LANG = "regexp_extract(url, '://[^/]+/([a-z]+)/', 1)"


@query("pip9_discovered_targets", f"""
WITH {_LINKS}, dim AS (SELECT DISTINCT {_LANG} AS brand FROM pages WHERE {_LANG} <> ''),
ok AS (SELECT page_id, {_LANG} AS brand FROM pages
  WHERE NOT ((CASE WHEN contains(lower(html), 'watchcharts') THEN 1 ELSE 0 END + CASE WHEN contains(lower(html), 'chart') THEN 1 ELSE 0 END
    + CASE WHEN contains(lower(html), 'price') THEN 1 ELSE 0 END + CASE WHEN contains(lower(html), 'watch') THEN 1 ELSE 0 END) < 2
    AND (contains(lower(html), 'checking your browser') OR contains(lower(html), 'just a moment')
      OR contains(lower(html), 'cf-browser-verification') OR contains(lower(html), 'verify you are human')))),
hit AS (SELECT ok.brand, l.page_id, l.href, min(l.pos) AS pos FROM links l JOIN ok USING (page_id) JOIN dim USING (brand)
  WHERE contains(l.raw, '/') AND contains(lower(l.href), ok.brand) GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY l.page_id ORDER BY min(l.pos)) <= 20),
seen AS (SELECT brand, href, arg_min(page_id, page_id * 1000000 + pos) AS page_id, arg_min(pos, page_id * 1000000 + pos) AS pos FROM hit GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY brand ORDER BY min(page_id * 1000000 + pos)) <= 20)
SELECT brand, brand AS slug, href AS url FROM seen""")
def pip9(spark, sf):
    stored = table(spark, sf, "pages")
    lang = F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1)
    dim = stored.select(lang.alias("brand")).filter("brand <> ''").distinct().withColumn(
        "url", F.concat(F.lit("https://x.example/"), F.col("brand"), F.lit("/")))
    found = collection_plan.discover(stored, dim, lang, 20, "/", [pages.strict("/")])
    return found.select("brand", "slug", "url")


@query("src12_registered_models", """
SELECT DISTINCT regexp_replace(name, '(__h|_h)[0-9]+$', '') AS model FROM (
  SELECT lower(p_type) || CASE WHEN p_size % 3 = 0 THEN '__h' WHEN p_size % 3 = 1 THEN '_h' ELSE 'h' END || p_size AS name FROM part)""")
def src12(spark, sf):
    from seriesloom.sources.readers import registered_models

    return registered_models(_registry(spark, sf))


def _registry(spark, sf):
    size = F.col("p_size")
    mark = F.when(size % 3 == 0, "__h").when(size % 3 == 1, "_h").otherwise("h")
    return table(spark, sf, "part").select(F.concat(F.lower("p_type"), mark, size.cast("string")).alias("name"))


@query("mdl9_model_resolution", """
WITH reg AS (SELECT DISTINCT lower(p_type) || CASE WHEN p_size % 3 = 0 THEN '__h' WHEN p_size % 3 = 1 THEN '_h' ELSE 'h' END || p_size AS name FROM part),
req AS (SELECT DISTINCT lower(p_type) AS model_name, h AS horizon_days FROM part, (SELECT unnest(range(1, 31)) AS h)),
c AS (SELECT model_name, horizon_days, 0 AS rank, model_name || '__h' || horizon_days AS name FROM req
  UNION ALL SELECT model_name, horizon_days, 1, model_name || '_h' || horizon_days FROM req)
SELECT model_name, CAST(horizon_days AS INTEGER) AS horizon_days, arg_min(name, rank) AS resolved, min(rank) < 2 AS is_specific
FROM c JOIN reg USING (name) GROUP BY 1, 2""")
def mdl9(spark, sf):
    from seriesloom.operators.forecast import resolve_models

    req = table(spark, sf, "part").select(F.lower("p_type").alias("model_name")).distinct().withColumn(
        "horizon_days", F.explode(F.sequence(F.lit(1), F.lit(30))))
    return resolve_models(req, _registry(spark, sf), many_horizons=True)
