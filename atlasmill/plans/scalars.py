"""Small functions on the driver's tables: numbers, coordinates, times, names, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions import categories, geo, hours, text
from atlasmill.operators import accounts, adjudication, serving
from atlasmill.plans import tables as T
from atlasmill.plans.registry import query
from atlasmill.sources.payloads import payload_hash, snapshot_key


def _pick(values: list[str], by: str, kind: str = "string"):
    """One of the literals for each row, in turn."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _form(forms: list, by: str) -> Column:
    """One of the expressions for each row, in turn."""
    return F.element_at(F.array(*forms), (F.col(by) % len(forms) + 1).cast("int"))


def _listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values) + "]"


@query(f"""WITH v AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_partkey || ',' || lpad(p_size::VARCHAR, 2, '0') WHEN 1 THEN ' ' || p_size || '.' || p_partkey || ' ' WHEN 2 THEN '' WHEN 3 THEN p_brand || p_size
        WHEN 4 THEN '-' || p_partkey WHEN 5 THEN p_size || 'e2' ELSE p_partkey || '.' END AS t FROM part)
    SELECT p_partkey, try_cast(nullif(trim(replace(t, ',', '.')), '') AS DOUBLE) AS loose, CASE WHEN regexp_full_match(trim(t), '-?[0-9]+(\\.[0-9]+)?') THEN trim(t)::DOUBLE END AS strict FROM v""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each part as they come in texts: with a comma, blanks, a sign, an exponent, letters, a dot too many, or none."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    forms = [F.concat(key, F.lit(","), F.lpad(size, 2, "0")), F.concat(F.lit(" "), size, F.lit("."), key, F.lit(" ")), F.lit(""), F.concat("p_brand", size), F.concat(F.lit("-"), key), F.concat(size, F.lit("e2")), F.concat(key, F.lit("."))]
    t = _form(forms, "p_partkey")
    return T.read(spark, sf_dir, "part").select("p_partkey", geo.to_float(t).alias("loose"), geo.strict_number(t).alias("strict"))


@query("SELECT event_id, round(least(greatest(event_id % 150 / 100.0 - 0.2, 0), 1), 2)::DOUBLE AS confidence FROM events")
def clamped_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").select("event_id", adjudication.clamped(F.col("event_id") % 150 / 100.0 - 0.2).alias("confidence"))


@query(f"WITH p AS ({T.PLACE_SQL}) SELECT id, CASE WHEN id % 5 < 3 THEN round(lat, 5) END AS lat, CASE WHEN id % 5 < 3 THEN round(lng, 5) END AS lng FROM p")
def wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point texts with and without the right form."""
    lat, lng = (F.format_string("%.5f", F.col(c)) for c in ("lat", "lng"))
    good = F.concat(F.lit("Point("), lng, F.lit(" "), lat, F.lit(")"))
    bad = F.when(F.col("id") % 5 == 3, F.lower(good)).otherwise(F.concat(F.lit("Point("), lng, F.lit(","), lat, F.lit(")")))
    point = geo.parse_point(F.when(F.col("id") % 5 < 3, good).otherwise(bad))
    return T.places(spark, sf_dir).select("id", point["lat"].alias("lat"), point["lng"].alias("lng"))


@query("SELECT p_partkey, round((p_partkey % 90 + p_size / 60.0 + p_partkey % 60 / 3600.0) * CASE WHEN p_partkey % 4 IN (1, 3) THEN -1 ELSE 1 END, 9) AS degrees FROM part")
def dms_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = _pick(["N", "s", "E", "W"], "p_partkey")
    value = geo.dms_to_decimal((F.col("p_partkey") % 90).cast("double"), F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double"), ref)
    return T.read(spark, sf_dir, "part").select("p_partkey", F.round(value, 9).alias("degrees"))


def vincenty_sql(source: str, lat1: str, lng1: str, lat2: str, lng2: str, columns: str, rounds: int = 8) -> str:
    """Common table expressions that end in geodesic(columns, distance_m)."""
    f = "(1 / 298.257223563)"
    arc = "sqrt(pow(c2 * sin(l), 2) + pow(c1 * s2 - s1 * c2 * cos(l), 2)) AS ss, s1 * s2 + c1 * c2 * cos(l) AS cs"
    angle = "atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(l) / ss END AS sa"
    more = "1 - sa * sa AS ca, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * s1 * s2 / (1 - sa * sa) END AS cm"
    out = f"v0 AS (SELECT {columns}, sin(atan((1 - {f}) * tan(radians({lat1})))) AS s1, cos(atan((1 - {f}) * tan(radians({lat1})))) AS c1, sin(atan((1 - {f}) * tan(radians({lat2})))) AS s2, cos(atan((1 - {f}) * tan(radians({lat2})))) AS c2, radians({lng2} - {lng1}) AS span, radians({lng2} - {lng1}) AS l FROM {source})"
    keep = f"{columns}, s1, c1, s2, c2, span"
    for i in range(rounds + 1):
        out += f", a{i} AS (SELECT {keep}, l, {arc} FROM v{i}), b{i} AS (SELECT {keep}, l, ss, cs, {angle} FROM a{i}), c{i} AS (SELECT {keep}, ss, cs, sg, sa, {more}, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS k FROM b{i})"
        if i < rounds:
            out += f", v{i + 1} AS (SELECT {keep}, span + (1 - k) * {f} * sa * (sg + k * ss * (cm + k * cs * (2 * cm * cm - 1))) AS l FROM c{i})"
    minor = "6356752.314245179"
    u = f"ca * (6378137.0 * 6378137.0 - {minor} * {minor}) / ({minor} * {minor})"
    out += f", d AS (SELECT *, {u} AS u FROM c{rounds}), e AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS aa, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM d)"
    return out + f", geodesic AS (SELECT {columns}, {minor} * aa * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS distance_m FROM e)"


@query(f"WITH p AS ({T.PLACE_SQL}), {vincenty_sql('p', 'lat', 'lng', '38.42', '27.14', 'id')} SELECT id, round(distance_m, 3) AS distance_m FROM geodesic")
def spheroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.spheroid_m(F.col("lat"), F.col("lng"), F.lit(38.42), F.lit(27.14))
    return T.places(spark, sf_dir).select("id", F.round(d, 3).alias("distance_m"))


@query(f"WITH p AS ({T.PLACE_SQL}), {vincenty_sql('p', 'lat', 'lng', '38.42', '27.14', 'id, is_published')} SELECT id, round(distance_m, 3) AS distance_m FROM geodesic WHERE is_published AND distance_m <= 25000")
def nearby_spheroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.nearby(T.places(spark, sf_dir), 38.42, 27.14, 25000, 1_000_000, spheroid=True).select("id", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH v AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN y || '-04-01' WHEN 1 THEN '-' || y WHEN 2 THEN p_name WHEN 3 THEN '' WHEN 4 THEN ' ' || y || ' ' WHEN 5 THEN '+' || lpad(y::VARCHAR, 4, '0') || '-00-00T00:00:00Z'
        WHEN 6 THEN '-' || lpad(y::VARCHAR, 4, '0') || '-01-01T00:00:00Z' ELSE (y + 1000000)::VARCHAR END AS t FROM (SELECT *, 1 + p_partkey % 2000 AS y FROM part))
    SELECT p_partkey, try_cast(nullif(regexp_extract(trim(t), '^(-?[0-9]+)', 1), '') AS INT) AS started, CASE WHEN NOT regexp_matches(trim(t), '^\\+?-?[0-9]{{6}}') THEN try_cast(nullif(regexp_extract(trim(t), '^[+]?(-?[0-9]{{1,5}})', 1), '') AS INT) END AS founded FROM v""")
def year_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of each part as dates have it: with month and day, before our era, padded, with more digits, or none."""
    year = (1 + F.col("p_partkey") % 2000).cast("string")
    padded = F.lpad(year, 4, "0")
    forms = [F.concat(year, F.lit("-04-01")), F.concat(F.lit("-"), year), F.col("p_name"), F.lit(""), F.concat(F.lit(" "), year, F.lit(" ")), F.concat(F.lit("+"), padded, F.lit("-00-00T00:00:00Z")), F.concat(F.lit("-"), padded, F.lit("-01-01T00:00:00Z")), (year.cast("int") + 1000000).cast("string")]
    t = _form(forms, "p_partkey")
    return T.read(spark, sf_dir, "part").select("p_partkey", hours.leading_year(t).alias("started"), hours.inception_year(t).alias("founded"))


@query("SELECT o_orderkey, date_sub('year', o_orderdate::DATE, DATE '2031-06-15')::INT AS years FROM orders")
def whole_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = hours.whole_years(F.to_date("o_orderdate"), F.lit("2031-06-15").cast("date"))
    return T.read(spark, sf_dir, "orders").select("o_orderkey", age.alias("years"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").select("event_id", hours.iso_time(F.col("ts").cast("timestamp")).alias("iso"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) END AS taken_at FROM events")
def exif_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera times of the right form, ISO ones and impossible ones."""
    ts = F.col("ts").cast("timestamp")
    good, iso = F.date_format(ts, "yyyy:MM:dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    value = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, iso).otherwise(F.lit("2024:13:41 10:00:00"))
    return T.read(spark, sf_dir, "events").select("event_id", hours.exif_time(value).cast("timestamp_ntz").alias("taken_at"))


DAYS = ["pazartesi", "salı", "çarşamba", "perşembe", "cuma", "cumartesi", "pazar"]


@query(f"""WITH v AS (SELECT p_partkey, (p_partkey // 5 % 6)::INT AS form, (p_partkey % 7)::INT AS a, ((p_partkey + 3) % 7)::INT AS b, (7 + p_partkey % 4)::VARCHAR AS o, (15 + p_size % 8)::VARCHAR AS c FROM part),
    s AS (SELECT p_partkey, d, o || ':30' AS opens_at, c || ':00' AS closes_at, false AS closed FROM v, range(0, 7) t(d) WHERE form = 0 OR (form = 1 AND d < 5)
        UNION ALL SELECT p_partkey, a, NULL, NULL, true FROM v WHERE form IN (1, 2) UNION ALL SELECT p_partkey, b, o || ':00', c || ':15', false FROM v WHERE form = 2
        UNION ALL SELECT p_partkey, a, o || ':00', c || ':00', false FROM v WHERE form = 4)
    SELECT p_partkey, d::INT AS day_of_week, opens_at, closes_at, closed AS is_closed_special FROM s""")
def hours_turkish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each part in words: all days, workdays and a closed day, one day closed and one open, nothing that can be told."""
    n = F.col("p_partkey")
    days = F.array(*[F.lit(d) for d in DAYS])
    a, b = F.element_at(days, (n % 7 + 1).cast("int")), F.element_at(days, ((n + 3) % 7 + 1).cast("int"))
    o, c = (7 + n % 4).cast("string"), (15 + F.col("p_size") % 8).cast("string")
    forms = [
        F.concat(_form([F.lit("pazartesi-pazar "), F.lit("her gün ")], "p_partkey"), o, F.lit(".30-"), c, F.lit(".00")), F.concat(F.lit("hafta içi "), o, F.lit(":30-"), c, F.lit(":00, "), a, F.lit(" kapalı")),
        F.concat(a, F.lit(" kapalı; "), b, F.lit(" "), o, F.lit(":00 – "), c, F.lit(":15")), F.lit("her gün açık"), F.concat(a, F.lit(" "), o, F.lit(".00-"), c, F.lit(".00")), F.lower("p_name"),
    ]
    text_ = F.element_at(F.array(*forms), (F.floor(n / 5) % 6 + 1).cast("int"))
    slots = T.read(spark, sf_dir, "part").select("p_partkey", F.explode(hours.turkish_hours(text_)).alias("s"))
    return slots.select("p_partkey", "s.day_of_week", "s.opens_at", "s.closes_at", "s.is_closed_special")


def _chain_sql() -> str:
    """The terms of a name replaced one after another, where the name as it was has them."""
    steps = []
    for i, (term, turkish) in enumerate(text.TERMS.items()):
        steps.append(f"r{i} AS (SELECT p_partkey, t, CASE WHEN contains(lower(t), '{term}') THEN regexp_replace(x, '{term}', '{turkish}', 'gi') ELSE x END AS x FROM {f'r{i - 1}' if i else 'v'})")
    return ", ".join(steps)


TERM_LIST, PROPER_LIST = list(text.TERMS), list(text.PROPER_NAMES)


@query(f"""WITH v AS (SELECT *, t AS x FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper({_listed(PROPER_LIST)}[p_partkey % {len(PROPER_LIST)} + 1]) WHEN 1 THEN p_name || ' ' || {_listed(TERM_LIST)}[p_size % {len(TERM_LIST)} + 1] || ' ' || p_partkey
        WHEN 2 THEN upper({_listed(TERM_LIST)}[p_partkey % {len(TERM_LIST)} + 1]) || ' and ' || {_listed(TERM_LIST)}[p_size % {len(TERM_LIST)} + 1] ELSE p_name END AS t FROM part)),
    {_chain_sql()}
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN {_listed(list(text.PROPER_NAMES.values()))}[p_partkey % {len(PROPER_LIST)} + 1] ELSE x END AS turkish FROM r{len(TERM_LIST) - 1}""")
def turkish_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names put together from the parts' own, English terms in any case, and whole proper names."""
    terms, proper = (F.array(*[F.lit(x) for x in xs]) for xs in (TERM_LIST, PROPER_LIST))

    def one(xs, by: str, n: int):
        return F.element_at(xs, (F.col(by) % n + 1).cast("int"))

    by_key, by_size = one(terms, "p_partkey", len(TERM_LIST)), one(terms, "p_size", len(TERM_LIST))
    forms = [F.upper(one(proper, "p_partkey", len(PROPER_LIST))), F.concat_ws(" ", "p_name", by_size, F.col("p_partkey").cast("string")), F.concat(F.upper(by_key), F.lit(" and "), by_size), F.col("p_name")]
    return T.read(spark, sf_dir, "part").select("p_partkey", text.to_turkish(_form(forms, "p_partkey")).alias("turkish"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Müzesi ' || p_name WHEN 2 THEN 'Efes' ELSE 'İsimsiz Mekan' END AS name FROM part")
def localized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turkish name, one made from the English name, one from another language, none at all."""
    k = F.col("p_partkey") % 4
    names = F.when(k == 0, F.create_map(F.lit("tr"), F.col("p_name"), F.lit("en"), F.lit("x"))).when(k == 1, F.create_map(F.lit("en"), F.concat(F.lit("Museum "), F.col("p_name")))).when(k == 2, F.create_map(F.lit("de"), F.lit(" Ephesus ")))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.element_at(serving.localized(names), F.lit("tr")).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS name FROM part")
def names_in_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("tr"), F.col("p_name"), F.lit("en"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lit(" ")))
    return T.read(spark, sf_dir, "part").select("p_partkey", serving.name_in(names, "en").alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 5 THEN 'image/jpeg' END AS type,
    CASE p_partkey % 7 WHEN 2 THEN 'unsupported' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'empty' WHEN 5 THEN CASE WHEN p_size > 20 THEN 'too_large' ELSE 'mismatch' END WHEN 6 THEN 'unsupported' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'mismatch' END END AS error FROM part""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of two kinds, RIFF files, nothing, too much for a limit of 64 bytes, and text, some under a wrong type."""
    k = F.col("p_partkey") % 7
    starts = ["FFD8FFE0", "89504E470D0A1A0A00", "52494646000000005745425000", "5249464600000000415649", "", "FFD8FF", "74657874"]
    padding = F.when(k == 5, F.lpad(F.lit(""), F.when(F.col("p_size") > 20, 62).otherwise(61), F.lit("x"))).otherwise(F.lit("")).cast("binary")
    data = F.concat(F.element_at(F.array(*[F.unhex(F.lit(x)) for x in starts]), (k + 1).cast("int")), padding)
    declared = F.when(F.col("p_partkey") % 3 == 0, "image/gif").otherwise(F.element_at(F.array(F.lit("image/jpeg"), F.lit("image/png"), F.lit("image/webp")), F.least(k + 1, F.lit(3)).cast("int")))
    p = T.read(spark, sf_dir, "part").select("p_partkey", data.alias("data"), declared.alias("declared"))
    return p.select("p_partkey", accounts.upload_type(F.col("data")).alias("type"), accounts.upload_error(F.col("data"), F.col("declared"), 64).alias("error"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 1997) || '...' ELSE text END AS short FROM documents")
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select("doc_id", text.shorten(F.col("text")).alias("short"))


@query("""SELECT page_id, nullif(left(url, 45), '') AS ip, nullif(left(html, 255), '') AS agent, CASE WHEN page_id % 2 = 0 THEN split_part(url, '/', 3) || '@x' END AS email_domain,
           CASE page_id % 3 WHEN 0 THEN 'u:' || page_id WHEN 1 THEN 'ip:' || split_part(url, '/', 3) ELSE 'ip:unknown' END AS client FROM pages""")
def client_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.element_at(F.split("url", "/"), 3)
    email = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("me@"), host, F.lit("@x"))).otherwise(F.lit("nobody"))
    user = F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string"))
    hops = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), host, F.lit(" , 10.0.0.1, 10.0.0.2"))).otherwise(F.lit(""))
    p = T.read(spark, sf_dir, "pages")
    return p.select("page_id", text.clipped(F.col("url"), 45).alias("ip"), text.clipped(F.col("html"), 255).alias("agent"), text.email_domain(email).alias("email_domain"), text.client_key(user, hops, F.lit(None).cast("string")).alias("client"))


@query("""SELECT event_id, event_type || ':' || left(sha256('[{"key":"a","value":"' || (event_id % 7) || '"},{"key":"z","value":"' || event_type || '"}]'), 24) AS snapshot, left(sha1(props), 16) AS payload FROM events""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.create_map(F.lit("z"), F.col("event_type"), F.lit("a"), (F.col("event_id") % 7).cast("string"))
    return T.read(spark, sf_dir, "events").select("event_id", snapshot_key(F.col("event_type"), params).alias("snapshot"), payload_hash(F.col("props")).alias("payload"))


KINDS, WORDS = ["Q33506", "Q32815", "Q23413", "Q0", "Q16970"], ["Müze", "ÖREN", "antik", "cami", "Kilise", "kale", "ev"]


@query(f"""WITH v AS (SELECT p_partkey, p_size, lower(p_type) AS ty, lower(p_brand) AS br, {_listed(KINDS)}[p_partkey % 5 + 1] AS a, {_listed(KINDS)}[p_size % 5 + 1] AS b, lower({_listed(WORDS)}[p_partkey % 7 + 1] || ' ' || p_name || ' ' || {_listed(WORDS)}[p_size % 7 + 1]) AS t FROM part),
    k AS (SELECT *, list_transform([a, b], lambda q: CASE q WHEN 'Q33506' THEN 'museum' WHEN 'Q32815' THEN 'mosque' WHEN 'Q23413' THEN 'castle' WHEN 'Q16970' THEN 'church' END) AS c FROM v)
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'building=' || br || ',' ELSE '' END || 'tourism=' || ty AS raw, p_size % 4 = 1 AS unesco, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: x IS NOT NULL))), ',') AS wikidata,
           CASE WHEN contains(t, 'müze') THEN 'museum' WHEN contains(t, 'ören') OR contains(t, 'antik') THEN 'archaeological_site' WHEN contains(t, 'cami') THEN 'mosque' WHEN contains(t, 'kilise') THEN 'church' WHEN contains(t, 'kale') THEN 'castle' ELSE '' END AS turkish FROM k""")
def category_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw categories of each part's tags, world heritage marks, pairs of classes as ids and addresses, Turkish texts with two key words."""
    p, n = T.read(spark, sf_dir, "part"), F.col("p_partkey")
    tags = F.map_filter(F.create_map(F.lit("tourism"), F.lower("p_type"), F.lit("building"), F.when(n % 3 == 0, F.lower("p_brand")), F.lit("note"), F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("a UNESCO site "), "p_name"))), lambda k, v: v.isNotNull())
    classes = F.concat(_pick(KINDS, "p_partkey"), F.lit(" |http://www.wikidata.org/entity/"), _pick(KINDS, "p_size"))
    words = text.tr_casefold(F.concat_ws(" ", _pick(WORDS, "p_partkey"), "p_name", _pick(WORDS, "p_size")))
    joined = [F.array_join(c, ",") for c in (categories.osm_raw_categories(tags), categories.wikidata_categories(classes), categories.turkish_category(words))]
    return p.select("p_partkey", joined[0].alias("raw"), categories.mentions_unesco(tags).alias("unesco"), joined[1].alias("wikidata"), joined[2].alias("turkish"))


def token_set_sql(source: str, key: str, a: str, b: str) -> str:
    """Common table expressions that end in token_ratio(key, ratio), from the definition: the best of the three comparisons of common tokens and rests."""
    return f"""
    tok AS (SELECT {key}, list_sort(list_distinct(list_filter(string_split({a}, ' '), lambda t: t <> ''))) AS x, list_sort(list_distinct(list_filter(string_split({b}, ' '), lambda t: t <> ''))) AS y FROM {source}),
    parts AS (SELECT {key}, x, y, array_to_string(list_filter(x, lambda t: list_contains(y, t)), ' ') AS s, array_to_string(list_filter(x, lambda t: NOT list_contains(y, t)), ' ') AS ra, array_to_string(list_filter(y, lambda t: NOT list_contains(x, t)), ' ') AS rb FROM tok),
    texts AS (SELECT *, trim(s || ' ' || ra) AS sa, trim(s || ' ' || rb) AS sb FROM parts),
    letters AS (SELECT DISTINCT sa, sb FROM texts WHERE len(x) > 0 AND len(y) > 0 AND NOT (s <> '' AND (ra = '' OR rb = ''))),
    grid AS (SELECT sa, sb, 0 AS n, list_transform(range(0, length(sa) + 1), lambda i: 0::BIGINT) AS r FROM letters
        UNION ALL SELECT sa, sb, n + 1, [0::BIGINT] || list_transform(range(1, length(sa) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN substr(sa, i::INT, 1) = substr(sb, n + 1, 1) THEN r[i] + 1 ELSE r[i + 1] END))) FROM grid WHERE n < length(sb)),
    common AS (SELECT sa, sb, list_last(r) AS lcs FROM grid WHERE n = length(sb)),
    token_ratio AS (SELECT {key}, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN s <> '' AND (ra = '' OR rb = '') THEN 100 ELSE greatest(200.0 * lcs / (length(sa) + length(sb)), CASE WHEN s <> '' THEN greatest(200.0 * length(s) / (length(s) + length(sa)), 200.0 * length(s) / (length(s) + length(sb))) ELSE 0 END) END AS ratio FROM texts LEFT JOIN common USING (sa, sb))"""


@query(f"WITH RECURSIVE {token_set_sql('part', 'p_partkey', 'lower(p_name)', 'lower(p_type)')} SELECT p_partkey, round(ratio::DOUBLE, 4) AS ratio FROM token_ratio")
def token_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each part's name and type."""
    p = T.read(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(text.token_set_ratio(F.lower("p_name"), F.lower("p_type")), 4).alias("ratio"))


@query("WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS x, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS y FROM part) SELECT p_partkey, len(list_intersect(x, y))::INT AS common, len(list_filter(y, lambda v: NOT list_contains(x, v)))::INT AS added FROM t")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (text.tokens(F.lower(c)) for c in (F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(x, y)).alias("common"), F.size(F.array_except(y, x)).alias("added"))
