"""The registered queries over the analytics operators, and the SQL that they're held against."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import similarity as S
from sentrylake.functions import text as T
from sentrylake.functions import urls as U
from sentrylake.operators import campaigns as G
from sentrylake.operators import casework as K
from sentrylake.operators import evaluation as E
from sentrylake.operators import messages as M
from sentrylake.operators import pages as P
from sentrylake.operators import reads as R
from sentrylake.operators import state as ST
from sentrylake.plans import base as B
from sentrylake.sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sql(spark, sf_dir, B.URL_ROWS)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sql(spark, sf_dir, B.TEXT_ROWS)


def _assets(spark: SparkSession, sf_dir: str, where: str = "TRUE") -> DataFrame:
    return B.sql(spark, sf_dir, f"SELECT * FROM ({B.ASSETS}) x WHERE {where}")


def _entities(spark: SparkSession, sf_dir: str, where: str = "TRUE") -> DataFrame:
    return B.sql(spark, sf_dir, B.with_assets("SELECT * FROM e", where))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# SQL of URL parts, by its own means
_FULL = "CASE WHEN contains({u}, '://') THEN {u} ELSE 'http://' || {u} END"
_HOST = f"lower(regexp_replace(regexp_replace(regexp_extract({_FULL}, '^[^:/?#]*://([^/?#]*)', 1), '^.*@', ''), ':[^:]*$', ''))"
_REG = """CASE WHEN regexp_full_match({h}, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN {h}
    WHEN len(string_split({h}, '.')) >= 3 AND (list_contains(['bank.in', 'fin.in'], array_to_string(string_split({h}, '.')[-2:], '.')) OR (len(string_split({h}, '.')[-1]) = 2 AND list_contains([""" + _quoted(C.CC_SECOND_LEVEL) + """], string_split({h}, '.')[-2])))
    THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"""
_SKEL = "replace(replace(translate(translate(strip_accents(lower({h})), '" + C.CONFUSABLES[0] + "', '" + C.CONFUSABLES[1] + "'), '" + C.DIGIT_LETTERS[0] + "', '" + C.DIGIT_LETTERS[1] + "'), 'rn', 'm'), 'vv', 'w')"
_OWNER = "CASE WHEN contains({r}, '.') AND string_split({r}, '.')[-1] = 'sbi' THEN 'sbi' " + " ".join(f"WHEN {{r}} IN ({_quoted(d)}) THEN '{k}'" for k, _, _, d, _ in C.BRANDS) + " END"
_PLATFORM = "CASE " + " ".join(f"WHEN {{h}} = '{s}' OR ends_with({{h}}, '.{s}') THEN '{s}'" for s in C.FREE_HOSTING) + " END"


def _url_sql(tail: str) -> str:
    return f"""WITH u AS ({B.URL_ROWS}), h AS (SELECT *, {_HOST.format(u="url")} AS host FROM u), r AS (SELECT *, {_REG.format(h="host")} AS registered, {_SKEL.format(h="host")} AS skel FROM h),
        o AS (SELECT *, {_OWNER.format(r="registered")} AS owner, {_PLATFORM.format(h="host")} AS platform, {_PLATFORM.format(h="skel")} AS skel_platform FROM r) {tail}"""


_SEGMENT = {k: U.segment_pattern(k).replace("'", "''") for k, _ in C.KEYWORDS if len(k) < 5}


def _keyword_sql(k: str, skel: str = "skel", platform: str = "skel_platform") -> str:
    if len(k) >= 5:
        return f"contains({skel}, '{k}')"
    user = f"CASE WHEN {platform} IS NULL THEN '' ELSE substr({skel}, 1, length({skel}) - length({platform})) END"
    return f"(contains({skel}, '{k}') AND (regexp_matches({user}, '(^|[^a-z0-9]){k}') OR regexp_matches({skel}, '{_SEGMENT[k]}')))"


def _typo_sql() -> str:
    flat = "regexp_replace(lower(skel), '[^a-z0-9]', '', 'g')"
    for w in C.TYPO_ALLOWED:
        flat = f"replace({flat}, '{w}', '#')"
    cases = []
    for k in [k for k, _ in C.KEYWORDS if len(k) >= 5]:
        hits = " OR ".join(f"len(list_filter(range(1, greatest(length(flat) - {n} + 2, 1)), lambda i: substr(flat, i, 1) = '{k[0]}' AND damerau_levenshtein(substr(flat, i, {n}), '{k}') <= 1)) > 0" for n in range(len(k) - (len(k) >= 7), len(k) + 2))
        cases.append(f"WHEN NOT contains(flat, '{k}') AND ({hits}) THEN '{k}'")
    return f"SELECT *, CASE {' '.join(cases)} END AS squat FROM (SELECT *, {flat} AS flat FROM o)"


def _listed(cases: list[tuple[str, int, str]]) -> tuple[str, str]:
    """SQL of the names of the cases that hold, comma-joined, and of the sum of their points."""
    names = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, _, when in cases)
    return f"array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',')", " + ".join(f"CASE WHEN {when} THEN {points} ELSE 0 END" for _, points, when in cases)


_BRAND_OF = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{b}'" for k, b in C.KEYWORDS) + " END"
_VERDICT = "CASE WHEN score >= 70 THEN 'malicious' WHEN score >= 40 THEN 'suspicious' ELSE 'benign' END"


def _lexical_sql(rows: str, tail: str) -> str:
    """SQL of the lexical score over rows (with id and url); it has no means to decode punycode, which these rows lack."""
    keyword = "CASE " + " ".join(f"WHEN {_keyword_sql(k)} THEN '{k}'" for k, _ in C.KEYWORDS) + " END"
    deeper = "CASE keyword " + " ".join(f"WHEN '{k}' THEN {_keyword_sql(k, 'skel_sub', 'sub_platform')} AND NOT {_keyword_sql(k, 'skel_reg', 'reg_platform')}" for k, _ in C.KEYWORDS) + " END"
    embedded = "CASE keyword " + " ".join("WHEN '{}' THEN len(list_filter([{}], lambda d: registered <> d AND (starts_with(host, d || '.') OR contains(host, '.' || d || '.')))) > 0".format(k, _quoted(next(d for b, _, _, d, _ in C.BRANDS if b == key))) for k, key in C.KEYWORDS) + " END"
    contains = lambda x, words: f"len(list_filter([{_quoted(words)}], lambda w: contains({x}, w))) > 0"
    names, points = _listed([
        ("brand_in_unofficial_domain", 50, "keyword IS NOT NULL"), ("homoglyph_obfuscation", 20, "keyword IS NOT NULL AND NOT contains(host, keyword)"), ("brand_in_subdomain", 20, f"keyword IS NOT NULL AND skel_sub <> '' AND {deeper}"),
        ("brand_with_banking_terms", 20, "keyword IS NOT NULL AND " + contains("replace(host, '-', '') || ' ' || replace(skel, '-', '')", C.BANKING_TERMS)), ("official_domain_in_subdomain", 20, f"keyword IS NOT NULL AND {embedded}"),
        ("typosquatting", 45, "squat IS NOT NULL"), ("idn_homograph", 30, "len(list_filter(string_split(host, '.'), lambda x: regexp_matches(x, '\\p{Latin}') AND regexp_matches(x, '[\\p{Cyrillic}\\p{Greek}]'))) > 0"),
        ("url_shortener", 10, f"regexp_replace(host, '^www\\.', '') IN ({_quoted(C.SHORTENERS)})"), ("free_hosting_platform", 20, "platform IS NOT NULL"), ("brand_in_url_path", 30, "in_path IS NOT NULL"),
        ("suspicious_tld", 20, f"string_split(host, '.')[-1] IN ({_quoted(C.SUSPICIOUS_TLDS)})"), ("punycode", 20, "starts_with(host, 'xn--') OR contains(host, '.xn--')"), ("many_hyphens", 10, "length(host) - length(replace(host, '-', '')) >= 2"),
        ("lure_keywords", 20, contains("lower(url)", C.LURE_WORDS)), ("long_host", 5, "length(host) > 40"), ("ip_host", 30, "regexp_full_match(host, '[0-9]{1,3}(\\.[0-9]{1,3}){3}')"),
    ])
    paths = f"list_min(list_filter([{_quoted([d for d, _ in C.OFFICIAL])}], lambda d: regexp_matches(rest, '(^|[^a-z0-9-])' || replace(d, '.', '\\.') || '($|[^a-z0-9-])') AND NOT contains(rest, '@' || d)))"
    return f"""WITH u AS ({rows}), h AS (SELECT *, {_HOST.format(u="url")} AS host, lower(regexp_extract({_FULL.format(u="url")}, '^[^:/?#]*://[^/?#]*([^#]*)', 1)) AS rest FROM u),
        r AS (SELECT *, {_REG.format(h="host")} AS registered, {_SKEL.format(h="host")} AS skel FROM h), v AS (SELECT *, {_SKEL.format(h="registered")} AS skel_reg, CASE WHEN ends_with(host, registered) THEN {_SKEL.format(h="regexp_replace(substr(host, 1, length(host) - length(registered)), '[.]+$', '')")} ELSE '' END AS skel_sub FROM r),
        w AS (SELECT *, {_OWNER.format(r="registered")} AS owner, {_PLATFORM.format(h="host")} AS platform, {_PLATFORM.format(h="skel")} AS skel_platform, {_PLATFORM.format(h="skel_sub")} AS sub_platform, {_PLATFORM.format(h="skel_reg")} AS reg_platform FROM v),
        k AS (SELECT *, CASE WHEN owner IS NULL THEN {keyword} END AS keyword FROM w), o AS (SELECT * FROM k), t AS (SELECT * REPLACE (CASE WHEN owner IS NULL AND keyword IS NULL THEN squat END AS squat) FROM ({_typo_sql()})),
        i AS (SELECT *, CASE WHEN owner IS NULL AND keyword IS NULL AND squat IS NULL THEN {paths} END AS in_path FROM t),
        f AS (SELECT *, coalesce({_BRAND_OF.format("keyword")}, {_BRAND_OF.format("squat")}, {_OWNER.format(r="in_path")}) AS brand, {names} AS signals, {points} AS points, least(100, points) AS score FROM i),
        x AS (SELECT *, {_VERDICT} AS verdict FROM f) {tail}"""


@query(f"SELECT page_id, {_HOST.format(u='url')} AS host, {_REG.format(h=_HOST.format(u='url'))} AS registered FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.host_of(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", host.alias("host"), U.registered_domain(host).alias("registered"))


@query(_url_sql("SELECT id, host, registered, owner, platform FROM o"))
def url_registered_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.host_of(F.col("url"))
    out = _urls(spark, sf_dir).withColumn("host", host).withColumn("registered", U.registered_domain(F.col("host")))
    return out.select("id", "host", "registered", U.owner_of(F.col("registered")).alias("owner"), U.hosting_platform(F.col("host")).alias("platform"))


@query(
    f"""WITH u AS ({B.URL_ROWS}), f AS (SELECT id, {_FULL.format(u="url")} AS u FROM u),
    p AS (SELECT id, lower(string_split(u, '://')[1]) AS scheme, {_HOST.format(u="u")} AS host, regexp_extract(u, '^[^:/?#]*://[^/?#]*:([0-9]+)([/?#]|$)', 1) AS port,
        regexp_extract(u, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) AS query FROM f)
    SELECT id, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
        || CASE WHEN path = '/' THEN '' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key FROM p"""
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", U.normalize_url(F.col("url")).alias("url_key"))


@query(_url_sql("SELECT id, skel, len(list_filter(string_split(host, '.'), lambda x: regexp_matches(x, '\\p{Latin}') AND regexp_matches(x, '[\\p{Cyrillic}\\p{Greek}]'))) > 0 AS mixed FROM o"))
def url_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _urls(spark, sf_dir).withColumn("host", U.host_of(F.col("url")))
    return out.select("id", U.skeleton(F.col("host")).alias("skel"), U.mixed_scripts(F.col("host")).alias("mixed"))


@query(_url_sql("SELECT id, " + ", ".join(f"{_keyword_sql(k)} AS has_{k}" for k, _ in C.KEYWORDS) + " FROM o"))
def url_short_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _urls(spark, sf_dir).withColumn("skel", U.skeleton(U.host_of(F.col("url"))))
    return out.select("id", *(U.keyword_in(k, F.col("skel")).alias(f"has_{k}") for k, _ in C.KEYWORDS))


@query(_url_sql(f"SELECT id, squat FROM ({_typo_sql()})"))
def url_typosquat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _urls(spark, sf_dir).withColumn("skel", U.skeleton(U.host_of(F.col("url")))).withColumn("flat", U.flat_of(F.col("skel")))
    return out.select("id", U.typosquat(F.col("flat")).alias("squat"))


@query(_lexical_sql(B.URL_ROWS, "SELECT id, brand, signals, score, verdict FROM x"))
def url_lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.lexical(_urls(spark, sf_dir)).select("id", "brand", F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("signals"), "score", "verdict")


@query(_lexical_sql("SELECT page_id AS id, url FROM pages", "SELECT host, verdict, count(*) AS n, max(score) AS score FROM x GROUP BY host, verdict"))
def url_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.lexical(_table(spark, sf_dir, "pages").select("url")).groupBy("host", "verdict").agg(F.count("*").alias("n"), F.max("score").alias("score"))


@query(_url_sql(f"SELECT id, host FROM o WHERE regexp_replace(host, '^www\\.', '') IN ({_quoted(C.SHORTENERS)})"))
def url_shortener_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _urls(spark, sf_dir).withColumn("host", U.host_of(F.col("url")))
    return out.where(U.is_shortener(F.col("host"))).select("id", "host")


@query(f"WITH t AS ({B.TEXT_ROWS}) SELECT id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM t")
def message_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", T.message_digest(F.col("text")).alias("digest"))


@query(
    f"""WITH t AS ({B.TEXT_ROWS}) SELECT id, array_to_string(list_distinct_ordered, ',') AS upi, array_to_string(regexp_extract_all(text, '(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\\.)[^\\s<>"'']+'), ' ') AS raw_urls
    FROM (SELECT id, text, regexp_extract_all(text, '\\b[a-zA-Z0-9.\\-_]{{2,}}@[a-zA-Z]{{2,}}\\b') AS list_distinct_ordered FROM t)"""
)
def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.array_join(T.upi_ids(F.col("text")), ",").alias("upi"), F.array_join(F.regexp_extract_all("text", F.lit(C.URL), F.lit(0)), " ").alias("raw_urls"))


_ALL_URLS = "list_transform(list_transform(regexp_extract_all(text, '(?i)(?:https?://|www\\.)[^\\s<>\"'']+'), lambda u: regexp_replace(u, '[.,);]+$', '')), lambda u: CASE WHEN contains(u, '://') THEN u ELSE 'http://' || u END)"
_PHONES = "list_transform(regexp_extract_all(text, '(?:^|[^0-9])((?:[+]?91[-\\s]?)?[6-9][0-9]{9})(?:$|[^0-9])', 1), lambda p: right(regexp_replace(p, '[^0-9]', '', 'g'), 10))"
_HANDLES = "list_transform(regexp_extract_all(text, '(?i)(?:https?://)?(?:www[.])?t(?:elegram)?[.]me/([+]?[a-z0-9_]{3,})', 1), lambda h: h) || regexp_extract_all(text, '(?:^|[^a-zA-Z0-9@._-])@([a-zA-Z][a-zA-Z0-9_]{4,31})\\b', 1)"


def _indicator_sql(rows: str, key: str) -> str:
    each = lambda v: f"array_to_string(list_filter({v}, lambda x, i: list_position({v}, x) = i), ',')"
    return f"WITH t AS ({rows}) SELECT {key}, {each(_ALL_URLS)} AS urls, {each(_PHONES)} AS phones, {each('(' + _HANDLES + ')')} AS telegram FROM t"


def _indicators(df: DataFrame, key: str) -> DataFrame:
    t = F.col("text")
    return df.select(key, *(F.array_join(f(t), ",").alias(n) for n, f in (("urls", T.urls), ("phones", T.phones), ("telegram", T.telegram))))


@query(_indicator_sql(B.TEXT_ROWS, "id"))
def text_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(_texts(spark, sf_dir), "id")


@query(_indicator_sql("SELECT doc_id, text FROM documents", "doc_id"))
def document_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators in whole texts of the real table."""
    return _indicators(_table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT conv_id, turn, regexp_extract_all(text, '\\b[a-zA-Z0-9.\\-_]{2,}@[a-zA-Z]{2,}\\b')[1] AS first_upi, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM conversations")
def conversation_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(T.upi_ids(t), F.lit(0)).alias("first_upi"), T.message_digest(t).alias("digest"))


_RUNS = "regexp_extract_all(text, '[0-9]{11,19}')"


@query(f"""SELECT doc_id, substr(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(repeat('X', length(hits[i]) - 4) || right(hits[i], 4), '')), ''), 1, 500) AS excerpt
    FROM (SELECT doc_id, string_split_regex(text, '[0-9]{{11,19}}') AS gaps, {_RUNS} AS hits FROM documents)""")
def text_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("excerpt"))


@query(f"WITH t AS ({B.TEXT_ROWS}) SELECT id, " + ", ".join("regexp_matches(text, '(?i){}') AS {}".format(p.replace("'", "''"), n) for n, _, p in C.MESSAGE_RULES) + " FROM t")
def message_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform("signals", lambda s: s["name"])
    return M.scored_messages(_texts(spark, sf_dir)).select("id", *(F.array_contains(names, n).alias(n) for n, _, _ in C.MESSAGE_RULES))


def _message_sql() -> str:
    fold = lambda x: f"replace(replace(translate({x}, '{C.DIGIT_LETTERS[0]}', '{C.DIGIT_LETTERS[1]}'), 'rn', 'm'), 'vv', 'w')"
    named = "CASE " + " ".join("WHEN regexp_matches(low, '(^|[^a-z0-9])({})($|[^a-z0-9])') THEN '{}'".format("|".join([display.lower(), *words]), key) for key, display, words, *_ in C.BRANDS) + " END"
    handled = "CASE " + " ".join(f"WHEN contains(handle, '{k}') THEN '{b}'" for k, b in C.KEYWORDS) + " END"
    rules = [(n, w, "regexp_matches(text, '(?i){}')".format(p.replace("'", "''"))) for n, w, p in C.MESSAGE_RULES]
    names, points = _listed([
        ("brand_mentioned", 25, "named IS NOT NULL"), ("brand_impersonating_upi_handle", 35, "handle IS NOT NULL"), *rules, ("payment_request_to_upi", 25, f"len(upi) > 0 AND regexp_matches(text, '(?i){C.PAYMENT_REQUEST}')"),
        ("callback_number", 10, f"regexp_matches(text, '(^|[^0-9])([+]?91[-\\s]?)?[6-9][0-9]{{9}}($|[^0-9])') AND regexp_matches(text, '(?i){C.CALLBACK}')"),
        ("telegram_contact", 10, "regexp_matches(text, '(?i)t(elegram)?[.]me/[+]?[a-z0-9_]{3,}') OR regexp_matches(text, '(^|[^a-zA-Z0-9@._-])@[a-zA-Z][a-zA-Z0-9_]{4,31}\\b')"),
    ])
    return f"""WITH t AS ({B.TEXT_ROWS}), a AS (SELECT *, {_SKEL.format(h="text")} AS low, regexp_extract_all(text, '\\b[a-zA-Z0-9.\\-_]{{2,}}@[a-zA-Z]{{2,}}\\b') AS upi FROM t),
        b AS (SELECT *, list_filter(list_transform(upi, lambda u: {fold("lower(string_split(u, '@')[1])")}), lambda h: regexp_matches(h, '{"|".join(k for k, _ in C.KEYWORDS)}'))[1] AS handle, {named} AS named FROM a),
        c AS (SELECT *, {names} AS signals, {points} AS points, coalesce(named, {handled}) AS brand FROM b),
        d AS (SELECT *, least(100, CASE WHEN brand IS NULL AND NOT regexp_matches(signals, 'payment_request_to_upi|credential_request') THEN least(60, points) ELSE points END) AS score FROM c)
        SELECT id, brand, signals, score, {_VERDICT} AS verdict, 'message://' || substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 24) AS url FROM d"""


@query(_message_sql())
def message_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scored_messages(_texts(spark, sf_dir)).select("id", "brand", F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("signals"), "score", "verdict", "url")


@query("""WITH s AS (SELECT user_id AS url_key, event_id AS id, event_id AS seq, ts, value, CASE WHEN event_type = 'click' THEN value END AS visual FROM events)
    SELECT url_key, min(id) AS id, arg_max(value, seq) AS score, arg_max(visual, CASE WHEN visual IS NOT NULL THEN seq END) AS visual, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings FROM s GROUP BY url_key""")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.upserted(_sightings(spark, sf_dir)).drop("entities")


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("url_key"), F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("seen"), F.col("value").alias("score"), F.when(F.col("event_type") == "click", F.col("value")).alias("visual"), F.array(F.struct(F.col("event_type").alias("type"), k.alias("value")), F.struct(F.lit("k").alias("type"), k.alias("value"))).alias("entities"))


@query("""WITH s AS (SELECT user_id AS url_key, event_id AS seq, unnest([event_type || ':' || (props->>'$.k'), 'k:' || (props->>'$.k')]) AS e, unnest([0, 1]) AS pos FROM events),
    f AS (SELECT url_key, e, min(-2 * seq + pos) AS place FROM s GROUP BY ALL) SELECT url_key, string_agg(e, ',' ORDER BY place) AS entities FROM f GROUP BY url_key""")
def entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.upserted(_sightings(spark, sf_dir)).select("url_key", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["value"])), ",").alias("entities"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.latest(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


_ENTITY_HOST = f"CASE WHEN type = 'domain' THEN ({_OWNER.format(r=_REG.format(h='lower(value)'))}) IS NULL AND regexp_replace(lower(value), '^www\\.', '') NOT IN ({_quoted(C.SHORTENERS)}) AND lower(value) NOT IN ({_quoted(C.FREE_HOSTING)}) ELSE TRUE END"
_STRONG = f"(type NOT IN ('registrar', 'asn') AND NOT (shared_hosting AND type IN ('ip', 'cert_fingerprint')) AND {_ENTITY_HOST})"


@query(B.with_assets(f"SELECT type, value, bool_and({_STRONG}) AS links, count(*) AS n FROM e GROUP BY type, value"))
def entity_linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = G.strongly_linking(F.col("type"), F.col("value"), F.col("shared_hosting"))
    return _entities(spark, sf_dir).groupBy("type", "value").agg(F.bool_and(strong).alias("links"), F.count("*").alias("n"))


def _components_sql(tail: str) -> str:
    text = B.with_assets(
        f""", k AS (SELECT DISTINCT id, type, CASE WHEN type = 'domain' THEN lower(value) ELSE value END AS value FROM e WHERE {_STRONG}),
        s AS (SELECT k.id, m.first AS peer FROM k JOIN (SELECT type, value, min(id) AS first FROM k GROUP BY type, value HAVING count(*) > 1) m USING (type, value)),
        b AS (SELECT id AS x, peer AS y FROM s WHERE id <> peer UNION SELECT peer, id FROM s WHERE id <> peer),
        c AS (SELECT x AS id, x AS label FROM b UNION SELECT b.y, c.label FROM c JOIN b ON b.x = c.id),
        m AS (SELECT id, min(label) AS component FROM c GROUP BY id) {tail}""",
        B.FLAGGED,
    )
    return text.replace(" , k AS", ", k AS").replace("WITH a AS", "WITH RECURSIVE a AS", 1)


def _flagged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.members(_entities(spark, sf_dir, B.FLAGGED))


@query(_components_sql("SELECT id, component FROM m"))
def campaign_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged_members(spark, sf_dir)


@query(
    _components_sql(
        """SELECT 'camp-' || substr(sha1(CAST(arg_min(id, struct_pack(f := first_seen, i := id)) AS VARCHAR)), 1, 8) AS camp_id, count(*) AS size, min(first_seen) AS first_seen, max(coalesce(last_seen, first_seen)) AS last_seen,
        'Campaign targeting ' || coalesce(string_agg(DISTINCT brand, ', ' ORDER BY brand), 'unknown brand') AS name FROM m JOIN a USING (id) GROUP BY component"""
    )
)
def campaign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.campaigns(_assets(spark, sf_dir, B.FLAGGED), _entities(spark, sf_dir, B.FLAGGED)).select("camp_id", "size", "first_seen", "last_seen", "name")


@query(_components_sql(f"SELECT component, type, CASE WHEN type = 'domain' THEN lower(value) ELSE value END AS value, count(DISTINCT id) AS users FROM e JOIN m USING (id) WHERE {_ENTITY_HOST} GROUP BY ALL HAVING count(DISTINCT id) >= 2"))
def campaign_shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_entities(_entities(spark, sf_dir, B.FLAGGED), _flagged_members(spark, sf_dir))


@query(B.with_assets(f"SELECT type || ':' || value AS node, type, count(DISTINCT id) AS degree, bool_and({_STRONG}) AS linking FROM e GROUP BY type, value"))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_nodes(_entities(spark, sf_dir))


_RELATION = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RELATIONS.items()) + " ELSE 'uses' END"


@query(B.with_assets(f"SELECT DISTINCT 'domain:' || domain AS source, type || ':' || value AS target, CASE WHEN type = 'domain' AND value IN (SELECT domain FROM a) THEN 'redirects_to' ELSE {_RELATION} END AS relation FROM e JOIN a USING (id) WHERE 'domain:' || domain <> type || ':' || value"))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_edges(_assets(spark, sf_dir), _entities(spark, sf_dir))


@query(B.with_assets("SELECT DISTINCT id FROM e WHERE type = 'domain' AND lower(value) = 'bit.ly'"))
def pivot_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pivot(_entities(spark, sf_dir), "domain", "Bit.LY")


@query(f"SELECT id, points, first_seen, domain FROM ({B.ASSETS}) WHERE points >= 40 AND verdict = 'suspicious' AND kind = 'web' AND live IS NOT DISTINCT FROM TRUE AND contains(lower(domain), 'example') ORDER BY points DESC, first_seen DESC, id LIMIT 50 OFFSET 10")
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.search(_assets(spark, sf_dir), min_points=40, verdict="suspicious", kind="web", live=True, text="EXAMPLE", limit=50, offset=10)
    return found.select("id", "points", "first_seen", "domain")


@query(f"SELECT id, url, campaign FROM ({B.CASE_ASSETS}) WHERE campaign = 'camp-7' AND (contains(lower(domain), '/p3') OR contains(lower(url), '/p3')) ORDER BY points DESC, first_seen DESC, id LIMIT 1000")
def candidate_search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = B.sql(spark, sf_dir, B.CASE_ASSETS)
    return R.search(assets, text="/P3", campaign="camp-7", limit=1000).select("id", "url", "campaign")


@query(f"SELECT verdict, count(*) AS n FROM ({B.ASSETS}) GROUP BY verdict")
def stats_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(_assets(spark, sf_dir), "verdict")


@query(f"SELECT count(*) AS candidates, count(*) FILTER ({B.FLAGGED}) AS flagged, count(*) FILTER ({B.FLAGGED} AND live) AS live, count(*) FILTER ({B.FLAGGED} AND NOT live) AS offline FROM ({B.ASSETS})")
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(_assets(spark, sf_dir))


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-20', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, count(a.id) AS n FROM d LEFT JOIN (SELECT * FROM ({B.ASSETS}) WHERE {B.FLAGGED}) a ON CAST(a.first_seen AS DATE) = day GROUP BY day""")
def summary_daily_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_day(_assets(spark, sf_dir), "2024-02-02", 14)


@query(f"SELECT id, points, review FROM ({B.ASSETS}) WHERE {B.FLAGGED} AND review = 'unreviewed' ORDER BY points DESC, id LIMIT 10")
def summary_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.review_queue(_assets(spark, sf_dir)).select("id", "points", "review")


@query("SELECT event_type AS name, count(*) AS n FROM events WHERE value > 5 GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def summary_top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array(F.struct(F.col("event_type").alias("name"), F.when(F.col("value") > 5, 10).otherwise(0).alias("points"))).alias("signals"))
    return R.top_signals(rows)


@query("SELECT round(median(epoch(o2.ts) - epoch(o1.ts)) / 3600, 1) AS median_hours, count(*) AS resolved FROM events o1 JOIN events o2 ON o2.event_id = o1.event_id + 500 WHERE o1.event_type = 'click'")
def summary_median_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    sent = e.where("event_type = 'click'").select("event_id", F.col("ts").alias("sent_at"))
    return R.median_hours(sent.join(e.select((F.col("event_id") - 500).alias("event_id"), F.col("ts").alias("resolved_at")), "event_id"))


@query("SELECT user_id AS case_id, count(*) AS checks, bool_and(value < 5) AND count(*) > 0 AS resolves FROM events WHERE event_type = 'view' GROUP BY user_id")
def recheck_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("case_id"), (F.col("value") >= 5).alias("live"))
    return K.rechecked(checks)


@query("SELECT event_id, CASE WHEN d < 0 THEN NULL WHEN d <= 30 THEN 'newly_registered_domain' WHEN d <= 180 THEN 'recently_registered_domain' END AS signal FROM (SELECT event_id, floor((epoch(TIMESTAMP '2024-01-25 12:00:00') - epoch(ts - CAST(event_id % 40 AS INT) * INTERVAL 5 DAY)) / 86400) AS d FROM events)")
def domain_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.sql(spark, sf_dir, "SELECT event_id, ts - make_dt_interval(CAST(event_id % 40 AS INT) * 5) AS created FROM events")
    return e.select("event_id", K.age_signal(F.col("created"), F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")).alias("signal"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(lower(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]+>', ' ', 'g')), '[a-z0-9]{3,}'))) AS tokens, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def page_title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.size(T.visible_tokens(F.col("html"))).alias("tokens"), P.title(F.col("html")).alias("title"))


@query("""WITH t AS (SELECT page_id, url, list_distinct(regexp_extract_all(lower(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]+>', ' ', 'g')), '[a-z0-9]{3,}')) AS w FROM pages)
    SELECT a.page_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS overlap FROM t a JOIN t b ON b.page_id = a.page_id + 1 WHERE len(a.w) >= 20""")
def page_cloaking_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", "html")
    crawler = p.select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("crawler_html"))
    return P.overlaps(p.join(crawler, "page_id"), "page_id", "html", "crawler_html")


@query("WITH h AS (SELECT doc_id, md5(text) AS a, md5(lang || text) AS b FROM documents) SELECT doc_id, 1 - bit_count(xor(('0x' || substr(a, 1, 8))::BIGINT, ('0x' || substr(b, 1, 8))::BIGINT)) / 64.0 - bit_count(xor(('0x' || substr(a, 9, 8))::BIGINT, ('0x' || substr(b, 9, 8))::BIGINT)) / 64.0 AS similarity FROM h")
def hash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 16).alias("a"), F.substring(F.md5(F.concat("lang", "text")), 1, 16).alias("b"))
    return h.select("doc_id", S.hash_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: least(a.embedding[i]::DOUBLE, b.embedding[i]::DOUBLE))), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def palette_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(S.palette_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


#: A library of hashes, one for each owned domain of the brands.
_LIBRARY = "SELECT ref, substr(md5(ref), 1, 16) AS ref_hash FROM (VALUES " + ", ".join(f"('{d}')" for d, _ in C.OFFICIAL) + ") l(ref)"


@query(f"""WITH h AS (SELECT doc_id, md5(text) AS a FROM documents), r AS ({_LIBRARY}),
    s AS (SELECT doc_id, ref, 1 - bit_count(xor(('0x' || substr(a, 1, 8))::BIGINT, ('0x' || substr(ref_hash, 1, 8))::BIGINT)) / 64.0 - bit_count(xor(('0x' || substr(a, 9, 8))::BIGINT, ('0x' || substr(ref_hash, 9, 8))::BIGINT)) / 64.0 AS sim FROM h, r)
    SELECT doc_id, arg_min(ref, struct_pack(s := -sim, r := ref)) AS ref, max(sim) AS sim FROM s GROUP BY doc_id""")
def nearest_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 16).alias("hash"))
    return S.nearest(rows, B.sql(spark, sf_dir, _LIBRARY), "doc_id")


_SPLIT = "CASE WHEN right(sha256(CAST(doc_id AS VARCHAR)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'dev' ELSE 'test' END"
_MATRIX = f"SELECT {_SPLIT} AS split, count(*) FILTER (quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (quality = 0 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 500) AS fn, count(*) FILTER (quality = 0 AND n_chars <= 500) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY 1"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return d.select(E.split_of(F.col("doc_id").cast("string")).alias("split"), (F.col("quality") == 1).alias("actual"), (F.col("n_chars") > 500).alias("predicted"))


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", E.split_of(F.col("doc_id").cast("string")).alias("split"))


@query(_MATRIX)
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_judged(spark, sf_dir), "split")


@query(f"SELECT split, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (fp + tn), 4) AS fpr FROM ({_MATRIX})")
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rates(E.confusion(_judged(spark, sf_dir), "split")).select("split", "precision", "recall", "f1", "fpr")


@query(f"""SELECT split, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high
    FROM (SELECT split, tp / (tp + fp) AS p, tp + fp AS n FROM ({_MATRIX}))""")
def eval_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.confusion(_judged(spark, sf_dir), "split")
    low, high = E.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return m.select("split", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"(https?://[^\"]+)\"', 1)) AS url FROM pages UNION SELECT DISTINCT url FROM pages WHERE starts_with(url, 'http')")
def feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    lines = p.select(F.col("page_id").alias("line"), F.col("url").alias("value")).union(p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(https?://[^"]+)"'), F.lit(1)))))
    return feeds.feed_urls(lines).select("url")


@query("SELECT DISTINCT h AS host FROM (SELECT regexp_replace(regexp_replace(lower(trim(x)), '^\\*\\.', ''), '\\.+$', '') AS h FROM (SELECT unnest(string_split('*.' || host || '\n' || host, '\n')) AS x FROM (SELECT " + _HOST.format(u="url") + " AS host FROM pages))) WHERE regexp_full_match(h, '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z][a-z0-9-]{0,61}[a-z0-9]')")
def ct_names_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.host_of(F.col("url"))
    raw = _table(spark, sf_dir, "pages").select(F.to_json(F.array(F.struct(F.concat(F.lit("*."), host, F.lit("\n"), host).alias("name_value"), host.alias("common_name")))).alias("raw"))
    return feeds.ct_hosts(raw)


@query("SELECT user_id, count(*) AS sightings, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def stream_state_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sentrylake.streaming.sightings import final_state

    return final_state(spark, f"{sf_dir}/events.parquet")


from sentrylake.plans import case_queries, catalogue_queries, intake_queries, network_queries, page_queries, picture_queries, state_queries  # noqa: E402, F401 - they register their queries
