"""Queries over captured pages, apps and messages, and their SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import markup as H
from sentrylake.functions import text as T
from sentrylake.functions.page import page_of
from sentrylake.operators import apps as A
from sentrylake.operators import pages as P
from sentrylake.operators import verdicts as V
from sentrylake.operators import visual as VI
from sentrylake.plans import base as B
from sentrylake.plans.queries import _HOST, _OWNER, _REG, _VERDICT, _lexical_sql, _listed, _quoted, _table, _texts, query
from sentrylake.sources import feeds


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sql(spark, sf_dir, B.CAPTURES)


def _joined(x: Column | str) -> Column:
    return F.array_join(x, ",")


# SQL of parts of HTML
def _attr(tag: str, name: str) -> str:
    pattern = f"""(?i)(?:^|[\\s"''/]){name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))"""
    return "(" + " || ".join(f"regexp_extract({tag}, '{pattern}', {k})" for k in (1, 2, 3)) + ")"


def _flat_sql(x: str) -> str:
    for name, char in [*H.NAMED[:-1], ("&copy;", "©"), ("&middot;", "·"), H.NAMED[-1]]:
        x = "replace({}, '{}', '{}')".format(x, name, char.replace("'", "''"))
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_FORMS = "regexp_extract_all(html, '(?is)<form\\b[^>]*>.*?</form\\s*>')"
_TEXT = _flat_sql("regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[^>]+>', ' ', 'g')")
_TITLE = _flat_sql("array_to_string(regexp_extract_all(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), ' ')")
_INNER = f"""regexp_extract_all(array_to_string({_FORMS}, ''), '(?i)<input\\b([^>]*)>', 1)"""
_KIND = f"""CASE WHEN {_attr("t", "type")} = '' THEN 'text' ELSE lower({_attr("t", "type")}) END"""
_FIELDS = f"""list_transform({_INNER}, lambda t: lower({_attr("t", "name")}) || ' ' || {_KIND})"""
_PROMPTS = f"""list_transform(regexp_extract_all(html, '(?i)<input\\b([^>]*)>', 1), lambda t: lower(replace({_attr("t", "placeholder")}, '&amp;', '&')))"""
_SCRIPTS = "array_to_string(list_transform(list_filter(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>'), lambda s: NOT regexp_matches(s, '(?i)^<script[^>]*\\ssrc\\s*=')), lambda s: regexp_replace(s, '(?is)^<script\\b[^>]*>|</script\\s*>$', '', 'g')), '\n')"
_ACTIONS = f"""list_filter(list_transform({_FORMS}, lambda f: trim({_attr("regexp_extract(f, '(?i)^<form([^>]*)>', 1)", "action")})), lambda a: a <> '')"""
_TO = "CASE WHEN regexp_matches(x, '(?i)^([a-z][a-z0-9+.-]*:)?//') THEN lower(regexp_extract(x, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)) WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*:') AND NOT regexp_matches(x, '(?i)^https?:') THEN '' ELSE host END"
_ROOT, _FOLDER = "regexp_extract(url, '^[^:/?#]+://[^/?#]*')", "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*/)?')"
_WHOLE = f"CASE WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*:') THEN x WHEN starts_with(x, '//') THEN regexp_extract(url, '^[^:/?#]+:') || x WHEN starts_with(x, '/') THEN {_ROOT} || x WHEN ends_with({_FOLDER}, '/') THEN {_FOLDER} || x ELSE {_FOLDER} || '/' || x END"


def _ordered_distinct(values: str) -> str:
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


_APKS = _ordered_distinct(f"""list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+?\\.apk(?:\\?[^"'']*)?)["'']', 1), lambda x: {_WHOLE})""") + "[:5]"
_OBFUSCATED = "list_filter([" + ", ".join("CASE WHEN regexp_matches(scripts, '{}') THEN '{}' END".format(p.replace("'", "''"), label) for p, label in C.OBFUSCATION) + "], lambda x: x IS NOT NULL)"
_WITHIN = "len(list_filter({}, lambda f: contains(f, {}))) > 0"
_SENSITIVE = f"list_filter([{_quoted(C.SENSITIVE_FIELDS)}], lambda w: {_WITHIN.format('names', 'w')} OR {_WITHIN.format('prompts', 'w')} OR {_WITHIN.format('prompts', chr(39).join(['replace(w, ', '_', ', ', ' ', ')']))})"


def _pages_sql(rows: str) -> str:
    """CTEs over rows (page_id, url, html) up to f, which has what their markup does."""
    return f"""c AS ({rows}), g AS (SELECT *, {_HOST.format(u="url")} AS host, {_FIELDS} AS names, {_PROMPTS} AS prompts, {_SCRIPTS} AS scripts, lower({_TEXT}) AS shown, {_ACTIONS} AS actions, {_APKS} AS apk_links FROM c),
        f AS (SELECT *, {_SENSITIVE} AS fields, len(list_filter(list_transform(actions, lambda x: {_TO}), lambda h: h <> '' AND host <> '' AND h <> host)) > 0 AS foreign_form, {_OBFUSCATED} AS obfuscated, list_filter([{_quoted(C.HARVEST_PROMPTS)}], lambda w: contains(shown, w)) AS harvest FROM g)"""


def _behaviour_cases(impersonating: str) -> list[tuple[str, int, str]]:
    full = f"({impersonating} OR len(fields) > 0)"
    strong = f"list_has_any(fields, [{_quoted(C.STRONG_FIELDS)}])"
    either = lambda name, a, b, when: [(name, a, f"{when} AND {full}"), (name, b, f"{when} AND NOT {full}")]
    return [("credential_input_fields", 40, strong), ("credential_input_fields", 25, f"len(fields) > 0 AND NOT {strong}"), ("cross_domain_form_action", 30, "foreign_form"), *either("obfuscated_js", 25, 5, "len(obfuscated) > 0"), *either("apk_download_offered", 20, 10, "len(apk_links) > 0"), *either("credential_harvesting_text", 20, 10, "len(harvest) > 0")]


@query(f"WITH {_pages_sql(B.CAPTURES)} SELECT page_id, array_to_string(fields, ',') AS fields, foreign_form, array_to_string(obfuscated, ',') AS obfuscated, array_to_string(apk_links, ',') AS apk_links, array_to_string(harvest, ',') AS harvest FROM f")
def page_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.behaviour(_captures(spark, sf_dir)).select("page_id", _joined("fields").alias("fields"), "foreign_form", *(_joined(c).alias(c) for c in ("obfuscated", "apk_links", "harvest")))


_NAMES, _POINTS = _listed(_behaviour_cases("page_id % 2 = 0"))


@query(f"WITH {_pages_sql(B.CAPTURES)} SELECT page_id, {_NAMES} AS signals, {_POINTS} AS points FROM f")
def page_behaviour_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.behaviour(_captures(spark, sf_dir)).withColumn("s", P.behaviour_signals(F.col("page_id") % 2 == 0))
    return out.select("page_id", _joined(F.transform("s", lambda x: x["name"])).alias("signals"), F.aggregate("s", F.lit(0), lambda a, x: a + x["points"]).alias("points"))


@query(f"""WITH c AS ({B.CAPTURES}), f AS (SELECT page_id, unnest({_FORMS}) AS form FROM c)
    SELECT page_id, {_attr("regexp_extract(form, '(?i)^<form([^>]*)>', 1)", "action")} AS action, CASE WHEN {_attr("regexp_extract(form, '(?i)^<form([^>]*)>', 1)", "method")} = '' THEN 'get' ELSE lower({_attr("regexp_extract(form, '(?i)^<form([^>]*)>', 1)", "method")}) END AS method, array_to_string(list_transform(regexp_extract_all(form, '(?i)<input\\b([^>]*)>', 1), lambda t: {_attr("t", "name")} || ':' || {_KIND}), ',') AS inputs FROM f""")
def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _captures(spark, sf_dir).select("page_id", F.explode(page_of(F.col("html"))["forms"]).alias("f"))
    return rows.select("page_id", "f.action", "f.method", _joined(F.transform("f.inputs", lambda i: F.concat(i["name"], F.lit(":"), i["type"]))).alias("inputs"))


#: What patterns over a page's characters get wrong: forms in comments, > in attributes, what isn't closed, tags in scripts and styles.
_ODD = [
    '<!-- <form action="/hidden"><input name="x"></form> --><form action="/a>b" method="POST"><input name="q" placeholder="a &lt; b"></form>',
    '<form action="/lost"><input name="gone"><form action="/kept"><input name="here"></form><input name="after" placeholder="free">',
    '<script>var f = "<form action=x></form><title>no</title>"; Enter OTP',
    '<style>p::after { content: "<input placeholder=no>" }</style><title>Second &amp; last</title><form action="/open"><input name="lost">',
    "",
]
_ODDS = f"SELECT q.page_id, q.url, q.html || CASE q.page_id % {len(_ODD)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ODD)) + f" END AS html FROM ({B.CAPTURES}) q"
_TAG = '(?:[^>"]|"[^"]*")*'
_BARE_PAGE = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script\\b.*?</script|style\\b.*?</style)\\s*>', ' ', 'g'), '(?is)<script\\b.*$', ' ')"
_WITHIN_FORM = f"""list_transform(regexp_extract_all(f, '(?i)<input\\b({_TAG})>', 1), lambda t: {_attr("t", "name")} || ':' || {_KIND})"""
_CLOSED = """list_transform(list_filter(list_transform(string_split(h, '</form>')[:-2], lambda b: regexp_extract(b, '(?is)^.*(<form\\b.*)$', 1)), lambda f: f <> ''), lambda f: {x})"""


@query(f"""WITH c AS (SELECT page_id, {_BARE_PAGE} AS h FROM ({_ODDS})) SELECT page_id, array_to_string({_CLOSED.format(x=_attr(f"regexp_extract(f, '(?i)^<form({_TAG})>', 1)", "action") + " || ' ' || array_to_string(" + _WITHIN_FORM + ", ',')")}, ' | ') AS forms,
    array_to_string(list_filter(list_transform(regexp_extract_all(h, '(?i)<input\\b({_TAG})>', 1), lambda t: replace(replace({_attr("t", "placeholder")}, '&lt;', '<'), '&amp;', '&')), lambda p: p <> ''), ',') AS prompts, {_flat_sql("array_to_string(regexp_extract_all(h, '(?is)<title>(.*?)</title>', 1), ' ')")} AS title,
    {_flat_sql(f"regexp_replace(regexp_replace(h, '(?is)<title>.*?</title>', ' ', 'g'), '<{_TAG}>', ' ', 'g')")} AS body FROM c""")
def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed forms with their inputs, prompts, title and text of pages whose markup isn't plain."""
    rows = B.sql(spark, sf_dir, _ODDS).select("page_id", page_of(F.col("html")).alias("p"))
    form = lambda f: F.concat(f["action"], F.lit(" "), _joined(F.transform(f["inputs"], lambda i: F.concat(i["name"], F.lit(":"), i["type"]))))
    return rows.select("page_id", F.array_join(F.transform("p.forms", form), " | ").alias("forms"), _joined("p.prompts").alias("prompts"), "p.title", "p.body")


@query(f"""WITH c AS (SELECT *, {_HOST.format(u="url")} AS host FROM ({B.CAPTURES})) SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?i)<script\\b([^>]*)>', 1), lambda t: {_attr("t", "src")}), lambda x: regexp_matches(x, '^(//|http)') AND (host = '' OR ({_TO}) <> host)), ',') AS scripts,
    nullif(regexp_extract(html, '(?i)<link rel="shortcut icon" href="([^"]+)"', 1), '') AS icon FROM c""")
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = feeds.host_of(F.col("url"))
    rows = _captures(spark, sf_dir).withColumn("page", page_of(F.col("html")))
    return rows.select("page_id", _joined(H.external_scripts(F.col("page.sources"), host)).alias("scripts"), F.col("page.icon").alias("icon"))


_MARK = "list_filter([{}], lambda m: contains(lower(substr(html, 1, 20000)), m) OR contains(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), m))[1]"
_WORDS = "len(list_distinct(regexp_extract_all(lower(regexp_replace(substr(html, 1, 20000), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]+>', ' ', 'g')), '[a-z0-9]{3,}')))"
_STATE = "SELECT *, page_id % 11 <> 0 AS ok, CASE WHEN page_id % 13 = 0 THEN 503 ELSE 200 END AS status FROM ({})"
_GONE = f"CASE WHEN NOT ok THEN 'unreachable' WHEN status IN (404, 410, 451) OR status >= 500 THEN 'HTTP ' || status WHEN mark IS NOT NULL AND {_WORDS} < 150 THEN 'platform error page: ' || mark END"
_SHORT = f"SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN substr(html, 1, 100) || ' <b>Page not found</b>' ELSE html END AS html FROM ({B.CAPTURES}) q"


@query(f"WITH c AS ({_STATE.format(_SHORT)}), m AS (SELECT *, {_MARK.format(_quoted(C.OFFLINE_MARKERS))} AS mark FROM c) SELECT page_id, {_GONE} AS reason, {_MARK.format(_quoted(C.CHALLENGE_MARKERS))} AS challenge FROM m")
def page_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.sql(spark, sf_dir, _SHORT).withColumns({"ok": F.col("page_id") % 11 != 0, "status": F.when(F.col("page_id") % 13 == 0, 503).otherwise(200)})
    return p.select("page_id", P.offline_reason(F.col("ok"), F.col("status"), F.col("html")).alias("reason"), P.challenge(F.col("html")).alias("challenge"))


_LOOKS = "CASE brand " + " ".join("WHEN '{}' THEN {{{{'title': [{}], 'vocab': [{}], 'markers': [{}]}}}}".format(k, _quoted(t), _quoted(v), _quoted(m)) for k, t, v, m in C.LOOKS) + " END"
_LOOKS = _LOOKS.replace("{{", "{").replace("}}", "}")


def _visual_sql(tail: str, rows: str) -> str:
    """CTEs over rows (page_id, html, brand) up to v, with title hits and structural similarity."""
    return f"""p AS ({rows}), l AS (SELECT *, {_LOOKS} AS looks, lower({_TITLE}) AS title, lower({_TEXT}) AS shown FROM p),
        t AS (SELECT *, list_distinct(regexp_extract_all(shown, '[a-z0-9]+') || regexp_extract_all(title, '[a-z0-9]+')) AS words FROM l),
        j AS (SELECT *, CASE WHEN looks IS NULL THEN NULL WHEN len(words) = 0 THEN 0.0 ELSE len(list_intersect(words, looks.vocab)) / len(list_distinct(words || looks.vocab)) END AS jac, len(list_filter(looks.title, lambda w: contains(title, w))) AS hits, len(list_filter(looks.markers, lambda w: contains(shown, w) OR contains(title, w))) AS marks FROM t),
        v AS (SELECT *, 0.4::DOUBLE * hits / len(looks.title) + 0.4::DOUBLE * least(1.0, 2 * jac) + 0.2::DOUBLE * (marks / len(looks.markers)) AS alike FROM j) {tail}"""


_BRANDED = f"SELECT page_id, html, CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, *_) in enumerate(C.LOOKS)) + f" END AS brand FROM ({B.CAPTURES}) q"


@query("WITH " + _visual_sql("SELECT page_id, round(alike, 3) AS visual, array_to_string(list_filter([CASE WHEN hits > 0 THEN 'brand_title_match' END, CASE WHEN alike >= 0.3 THEN 'visual_structural_similarity' END], lambda x: x IS NOT NULL), ',') AS signals FROM v", _BRANDED))
def page_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.sql(spark, sf_dir, _BRANDED).withColumns({"shot": F.lit(None).cast("struct<phash:string,dhash:string>"), "icon_phash": F.lit(None).cast("string"), "icon_md5": F.lit(None).cast("string")})
    return VI.compared(rows).select("page_id", "visual", _joined(F.transform("visual_signals", lambda s: s["name"])).alias("signals"))


_PICTURES = "SELECT vec_id, substr(md5(CAST(vec_id AS VARCHAR(12))), 1, 16) AS phash, substr(md5(CAST(vec_id + 7 AS VARCHAR(12))), 1, 16) AS dhash FROM embeddings"
_REFERENCES = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{('0123456789abcdef' * 2)[i:i + 16]}', '{('fedcba9876543210' * 2)[i:i + 16]}')" for i, (k, *_) in enumerate(C.LOOKS)) + ") r(brand, phash, dhash)"
_BITS = "(1 - (bit_count(xor(('0x' || substr({a}, 1, 8))::BIGINT, ('0x' || substr({b}, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr({a}, 9, 8))::BIGINT, ('0x' || substr({b}, 9, 8))::BIGINT))) / 64.0)"


@query(f"""WITH e AS ({_PICTURES}), r AS ({_REFERENCES}), s AS (SELECT vec_id, brand, ({_BITS.format(a="e.phash", b="r.phash")} + {_BITS.format(a="e.dhash", b="r.dhash")}) / 2 AS sim FROM e, r)
    SELECT vec_id, arg_min(brand, {{'s': -sim, 'b': brand}}) AS brand, max(sim) AS sim FROM s GROUP BY vec_id""")
def screenshot_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = B.sql(spark, sf_dir, _REFERENCES).withColumns({"kind": F.lit("screenshot"), "md5": F.lit(None).cast("string")})
    rows = B.sql(spark, sf_dir, _PICTURES).crossJoin(F.broadcast(VI.packed(refs)))
    best = rows.select("vec_id", VI.best_screenshot(F.struct("phash", "dhash")).alias("b"))
    return best.select("vec_id", F.col("b.brand").alias("brand"), (-F.col("b.far")).alias("sim"))


@query(f"SELECT page_id, array_to_string({_ordered_distinct(chr(32).join(['list_transform(regexp_extract_all(html, ' + chr(39) + '(UA-[0-9]{4,}-[0-9]+)|[' + chr(34) + chr(39) * 2 + '=:/(,](G-[A-Z0-9]{8,10}|GTM-[A-Z0-9]{6,7})[' + chr(34) + chr(39) * 2 + '<&);]' + chr(39) + '), lambda x: regexp_extract(x, ' + chr(39) + '(UA|G|GTM)-[A-Z0-9-]+' + chr(39) + '))']))}, ',') AS ids FROM ({B.CAPTURES})")
def page_analytics_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captures(spark, sf_dir).select("page_id", _joined(H.analytics_ids(F.col("html"))).alias("ids"))


_LISTINGS = """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN html ELSE '<meta property="og:title" content="Pay &amp; Go ' || CAST(page_id AS VARCHAR(12)) || ' – Apps on Google Play"><meta property="og:image" content="https://img.example/' || CAST(page_id AS VARCHAR(12)) || '">' || CASE WHEN page_id % 3 = 0 THEN '' ELSE '<a href="/store/apps/dev?id=77"><span>Dev &amp; Co</span></a>' END END AS html FROM pages"""


@query(f"""SELECT page_id, CASE WHEN t <> '' THEN trim(regexp_replace(replace(t, '&amp;', '&'), ' – Apps on Google Play$', '')) END AS title, CASE WHEN t <> '' THEN nullif(replace(d, '&amp;', '&'), '') END AS developer, CASE WHEN t <> '' THEN nullif(i, '') END AS icon_url
    FROM (SELECT page_id, regexp_extract(html, 'og:title" content="([^"]+)"', 1) AS t, regexp_extract(html, '/store/apps/dev[?]id=[^"]+"><span>([^<]+)<', 1) AS d, regexp_extract(html, 'og:image" content="([^"]+)"', 1) AS i FROM ({_LISTINGS}))""")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sql(spark, sf_dir, _LISTINGS).select("page_id", H.listing(F.col("html")).alias("l")).select("page_id", "l.title", "l.developer", "l.icon_url")


@query(f"""WITH u AS (SELECT id, url || CASE id % 5 WHEN 0 THEN '.apk' WHEN 1 THEN '?f=x.APK' WHEN 2 THEN '/a.apk/b' WHEN 3 THEN '/a.apk?x=1' ELSE '' END AS url FROM ({B.URL_ROWS}))
    SELECT id, regexp_matches(regexp_extract(f, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '(?i)[.]apk$') OR regexp_matches(regexp_extract(f, '^[^?#]*[?]([^#]*)', 1), '(?i)[.]apk$') AS apk FROM (SELECT id, CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END AS f FROM u)""")
def url_apk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = "CASE id % 5 WHEN 0 THEN '.apk' WHEN 1 THEN '?f=x.APK' WHEN 2 THEN '/a.apk/b' WHEN 3 THEN '/a.apk?x=1' ELSE '' END"
    return B.sql(spark, sf_dir, f"SELECT id, url || {tail} AS url FROM ({B.URL_ROWS}) u").select("id", H.is_apk_url(F.col("url")).alias("apk"))


# apps
_PERMITS = [p for p, *_ in C.RISKY_PERMISSIONS]
_PERMIT_NAMES = list(dict.fromkeys(n for _, n, _ in C.RISKY_PERMISSIONS))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.sql(spark, sf_dir, B.APP_ROWS)
    numbers = F.filter(F.split("permits", ","), lambda x: x != "")
    return rows.select("event_id", "sha256", "package", "label", F.lit("1").alias("version"), F.transform(numbers, lambda i: F.get(F.array(*map(F.lit, _PERMITS)), i.cast("int"))).alias("permissions"), F.array_compact(F.array("cert")).alias("cert_sha256"), F.lit(None).cast("struct<phash:string,dhash:string>").alias("icon"), F.lit(None).cast("string").alias("icon_md5"), F.filter(F.split("strings", r"\|"), lambda s: s != "").alias("strings"), "has_launcher", "origin_url")


def _certs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("hdfc", "cert1"), ("hdfc", "cert2")], "brand string, cert string")


def _apps_sql(tail: str) -> str:
    """SQL of the scores of apps. Their names are plain ASCII and their strings few, so that plainer patterns serve."""
    official = "CASE package " + " ".join(f"WHEN '{p}' THEN '{k}'" for k, own in C.PACKAGES.items() for p in own) + " END"
    fold = "replace(replace(translate(lower({}), '" + C.DIGIT_LETTERS[0] + "', '" + C.DIGIT_LETTERS[1] + "'), 'rn', 'm'), 'vv', 'w')"
    flat = lambda x: f"regexp_replace({fold.format(x)}, '[^a-z0-9]', '', 'g')"
    named = lambda x: "CASE " + " ".join(f"WHEN contains({flat(x)}, '{k}') THEN '{b}'" for k, b in C.KEYWORDS) + " END"

    def typo(x: str) -> str:
        text = flat(x)
        for w in C.TYPO_ALLOWED:
            text = f"replace({text}, '{w}', '#')"
        cases = []
        for k, b in [(k, b) for k, b in C.KEYWORDS if len(k) >= 5]:
            hits = " OR ".join(f"len(list_filter(range(1, greatest(length({text}) - {n} + 2, 1)), lambda i: substr({text}, i, 1) = '{k[0]}' AND damerau_levenshtein(substr({text}, i, {n}), '{k}') <= 1)) > 0" for n in range(len(k) - (len(k) >= 7), len(k) + 2))
            cases.append(f"WHEN NOT contains({text}, '{k}') AND ({hits}) THEN '{b}'")
        return f"CASE {' '.join(cases)} END"

    kits = sorted({".".join(h.split(".")[-2:]) for h in C.PLATFORM_HOSTS})
    permit = {n: [(i, w) for i, (_, name, w) in enumerate(C.RISKY_PERMISSIONS) if name == n] for n in _PERMIT_NAMES}
    has = lambda n: "(" + " OR ".join(f"list_contains(permits, {i})" for i, _ in permit[n]) + ")"
    permits = [(n, w, " AND ".join([f"list_contains(permits, {i})", *(f"NOT list_contains(permits, {j})" for j, _ in permit[n] if j < i)])) for n in _PERMIT_NAMES for i, w in permit[n]]
    forged = "official IS NOT NULL AND official = 'hdfc' AND coalesce(cert, '') NOT IN ('cert1', 'cert2')"
    names, points = _listed([
        ("repackaged_official_app", 70, forged), ("official_package_name", 0, f"official IS NOT NULL AND NOT ({forged})"), ("brand_impersonating_app", 45, "official IS NULL AND named IS NOT NULL"), *permits,
        ("banking_trojan_profile", 20, f"{has('sms_interception')} AND ({has('accessibility_abuse')} OR {has('notification_access')})"), ("hidden_launcher_icon", 10, "NOT has_launcher"), ("unsigned_apk", 10, "cert IS NULL"), ("telegram_bot_exfiltration", 25, "len(bots) > 0"), ("embedded_upi_handles", 10, "len(upi) > 0"),
    ])
    hosts = f"list_filter(list_transform(regexp_extract_all(blob, '(?i)https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\\s\"<>]*)?'), lambda u: {_HOST.format(u='u')}), lambda h: contains(h, '.') AND ({_REG.format(h='h')}) NOT IN ({_quoted(kits)}) AND ({_OWNER.format(r=_REG.format(h='h'))}) IS NULL)"
    contact = "regexp_matches(s, '(?i)^\\s*(?:tel:|https?://wa[.]me/)?(?:[+]?91[\\s-]?)?[6-9][0-9]{9}\\s*$') OR (length(s) < 300 AND regexp_matches(s, '(?i)\\b(call|whatsapp|contact|helpline|customer care|sms to|number)\\b'))"
    return f"""WITH a AS (SELECT * REPLACE (list_transform(list_filter(string_split(permits, ','), lambda x: x <> ''), lambda x: x::INT) AS permits), {official} AS official, list_filter(string_split(strings, '|'), lambda s: length(s) BETWEEN 4 AND 4000) AS usable FROM ({B.APP_ROWS})),
        b AS (SELECT *, array_to_string(usable, chr(10)) AS blob, coalesce({named("label")}, {typo("label")}, {named("package")}, {typo("package")}) AS named FROM a),
        c AS (SELECT *, {_ordered_distinct("regexp_extract_all(blob, '\\b([0-9]{8,11}):AA[A-Za-z0-9_-]{30,40}\\b', 1)")} AS bots, {_ordered_distinct(hosts)} AS hosts, {_ordered_distinct("list_transform(regexp_extract_all(blob, '(?i)(?:t[.]me|telegram[.]me)/([A-Za-z0-9_]{5,32})', 1), lambda x: lower(x))")} AS telegram,
            {_ordered_distinct("regexp_extract_all(blob, '\\b[a-zA-Z0-9.\\-_]{2,}@[a-zA-Z]{2,}\\b')")} AS upi, list_transform(regexp_extract_all(array_to_string(list_filter(string_split(strings, '|'), lambda s: {contact}), chr(10)), '(?:^|[^0-9])((?:[+]?91[-\\s]?)?[6-9][0-9]{{9}})(?:$|[^0-9])', 1), lambda p: right(regexp_replace(p, '[^0-9]', '', 'g'), 10)) AS phones FROM b),
        d AS (SELECT *, coalesce(official, named) AS brand, {names} AS signals, {points} AS points FROM c), s AS (SELECT *, least(100, CASE WHEN brand IS NULL OR regexp_matches(signals, 'official_package_name') THEN least(60, points) ELSE points END) AS score FROM d) {tail}"""


@query(_apps_sql(f"SELECT event_id, brand, signals, score, {_VERDICT} AS verdict FROM s"))
def app_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.scored_apps(_facts(spark, sf_dir), certs=_certs(spark))
    return out.select("event_id", "brand", _joined(F.transform("signals", lambda s: s["name"])).alias("signals"), "score", "verdict")


@query(_apps_sql(f"""SELECT 'android://' || package || '?sha256=' || left(sha256, 16) AS url, package AS domain, 'app' AS kind, score, {_VERDICT} AS verdict, brand, NULL::DOUBLE AS visual_similarity,
    concat_ws(',', nullif(signals, ''), CASE WHEN origin_url IS NOT NULL THEN 'sideloaded_distribution' END) AS signals FROM s"""))
def app_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.app_candidates(A.scored_apps(_facts(spark, sf_dir), certs=_certs(spark)))
    return out.select("url", "domain", "kind", "score", "verdict", "brand", "visual_similarity", _joined(F.transform("signals", lambda s: s["name"])).alias("signals"))


_APP_ENTITIES = "[{'t': 'package_name', 'v': package}, {'t': 'apk_sha256', 'v': sha256}] || CASE WHEN cert IS NULL THEN [] ELSE [{'t': 'signing_cert', 'v': cert}] END || " + " || ".join(f"list_transform({c}, lambda x: {{'t': '{t}', 'v': {v}}})" for t, c, v in (("domain", "hosts", "x"), ("upi_id", "upi", "x"), ("phone", "phones", "x"), ("telegram", "bots", "'bot:' || x"), ("telegram", "telegram", "x"))) + f" || CASE WHEN origin_url IS NULL THEN [] ELSE [{{'t': 'domain', 'v': {_HOST.format(u='origin_url')}}}] END"


@query(_apps_sql(f"SELECT sha256, e.t AS type, e.v AS value FROM (SELECT sha256, unnest({_APP_ENTITIES}) AS e FROM s)"))
def app_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.app_entities(A.scored_apps(_facts(spark, sf_dir))).select("sha256", "type", "value")


# feeds and messages
@query(_lexical_sql(B.URL_ROWS, "SELECT DISTINCT host, brand FROM x WHERE brand IS NOT NULL"))
def ct_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of URLs with a brand; those rows that have it by their path alone are told apart by their own query."""
    from sentrylake.functions.urls import branded

    return branded(B.sql(spark, sf_dir, B.URL_ROWS).select("url").distinct()).select("host", "brand").distinct()


@query(_lexical_sql("SELECT min(id) AS id, url FROM (" + B.URL_ROWS + ") GROUP BY url", "SELECT url, id AS line, brand FROM x WHERE brand IS NOT NULL AND regexp_matches(url, '(?i)^https?://') ORDER BY id LIMIT 200"))
def feed_brand_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.sql(spark, sf_dir, B.URL_ROWS).select(F.col("id").alias("line"), F.col("url").alias("value"))
    return feeds.brand_urls(feeds.feed_urls(lines), 200)


_BARE = "regexp_extract_all(' ' || regexp_replace(text, '(?i)(?:https?://|www\\.)[^\\s<>\"'']+', ' ', 'g') || ' ', '(?i)[^@\\w.:/-]((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?[.])+[a-z]{2,24})(/[^\\s<>\"'']*)?[^\\w@-]', @)"


_SUFFIXED = "(regexp_matches(lower(x[1]), '[.](?:[a-z][a-z]|" + "|".join(sorted({*C.GENERIC_SUFFIXES, *C.SUSPICIOUS_TLDS})) + ")$') AND NOT regexp_matches(lower(x[1]), '^(?:" + "|".join(C.CC_SECOND_LEVEL) + ")[.][a-z][a-z]$'))"


@query(f"""WITH t AS (SELECT id, text || CASE id % 3 WHEN 0 THEN ' see sbi-kyc' || CAST(id AS VARCHAR) || '.top/update, or file.pdf' WHEN 1 THEN ' Dear Mr.Sharma of co.in ask pay' || CAST(id AS VARCHAR) || '.co.in now' ELSE '' END AS text FROM ({B.TEXT_ROWS}))
    SELECT id, array_to_string({_ordered_distinct(chr(32).join(["list_transform(regexp_extract_all(text, '(?i)(?:https?://|www\\.)[^\\s<>" + chr(34) + chr(39) * 2 + "]+'), lambda u: regexp_replace(u, '[.,);]+$', ''))"]))} || list_transform(list_filter(list_zip({_BARE.replace(", @)", ", 1)")}, {_BARE.replace(", @)", ", 2)")}), lambda x: x[1] <> 'file.pdf' AND {_SUFFIXED}), lambda x: 'http://' || lower(x[1]) || regexp_replace(coalesce(x[2], ''), '[.,);]+$', '')), ',') AS urls FROM t""")
def text_bare_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.sql(spark, sf_dir, f"SELECT id, text || CASE id % 3 WHEN 0 THEN ' see sbi-kyc' || CAST(id AS VARCHAR(12)) || '.top/update, or file.pdf' WHEN 1 THEN ' Dear Mr.Sharma of co.in ask pay' || CAST(id AS VARCHAR(12)) || '.co.in now' ELSE '' END AS text FROM ({B.TEXT_ROWS}) q")
    return t.select("id", _joined(T.all_urls(F.col("text"))).alias("urls"))


@query(f"""WITH t AS ({B.TEXT_ROWS}), f AS (SELECT id, text, list_transform(regexp_extract_all(text, '(?i)(?:https?://|www\\.)[^\\s<>"'']+'), lambda u: regexp_replace(u, '[.,);]+$', '')) || list_transform(list_zip({_BARE.replace(", @)", ", 1)")}, {_BARE.replace(", @)", ", 2)")}), lambda x: 'http://' || lower(x[1]) || regexp_replace(x[2], '[.,);]+$', '')) AS urls, len(regexp_extract_all(text, '\\b[a-zA-Z0-9.\\-_]{{2,}}@[a-zA-Z]{{2,}}\\b')) AS upi, len(regexp_extract_all(text, '(?:^|[^0-9])(?:[+]?91[-\\s]?)?[6-9][0-9]{{9}}(?:$|[^0-9])')) AS phones,
    len(list_distinct(regexp_extract_all(text, '(?i)t(?:elegram)?[.]me/([+]?[a-z0-9_]{{3,}})', 1) || regexp_extract_all(text, '(?:^|[^a-zA-Z0-9@._-])@([a-zA-Z][a-zA-Z0-9_]{{4,31}})\\b', 1))) AS handles FROM t)
    SELECT id, 'url' AS kind, unnest(urls) AS value, upi + phones + handles AS entities FROM f UNION ALL SELECT id, 'message', 'message://' || substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 24), upi + phones + handles FROM f WHERE len(urls) = 0 AND upi + phones + handles > 0""")
def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.message_rows(_texts(spark, sf_dir)).select("id", "kind", "value", F.size("entities").alias("entities"))


# the whole verdict
_VIEWED = f"""SELECT page_id, url, html, page_id % 11 <> 0 AS ok, CASE WHEN page_id % 13 = 0 THEN 503 ELSE 200 END AS status, CASE WHEN page_id % 8 = 3 THEN 'https://landing.sbi-kyc.top/x' WHEN page_id % 17 = 4 THEN 'https://www.phonepe.com/' ELSE url END AS final,
    CASE page_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 1000 END AS days FROM ({B.CAPTURES}) q"""


#: Points of the signals of a URL.
_URL_POINTS = {"brand_in_unofficial_domain": 50, "homoglyph_obfuscation": 20, "brand_in_subdomain": 20, "brand_with_banking_terms": 20, "official_domain_in_subdomain": 20, "typosquatting": 45, "idn_homograph": 30, "url_shortener": 10, "free_hosting_platform": 20, "brand_in_url_path": 30, "suspicious_tld": 20, "punycode": 20, "many_hyphens": 10, "lure_keywords": 20, "long_host": 5, "ip_host": 30}


def _full_sql() -> str:
    parts = "id AS page_id, host, registered, owner, brand, signals, points"
    first = _lexical_sql(f"SELECT page_id AS id, url FROM ({B.CAPTURES})", f"SELECT {parts} FROM x")
    landing = _lexical_sql(f"SELECT page_id AS id, final AS url FROM ({_VIEWED})", f"SELECT {parts} FROM x")
    listed = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ',') END"
    fresh = f"list_filter({listed.format('y.signals')}, lambda s: NOT list_contains({listed.format('l.signals')}, s))"
    worth = "CASE s " + " ".join(f"WHEN '{n}' THEN {p}" for n, p in _URL_POINTS.items()) + " END"
    does, does_points = _listed(_behaviour_cases("brand IS NOT NULL"))
    gone = _GONE.replace("mark", "off_mark")
    early, early_points = _listed([("site_offline", 0, "gone IS NOT NULL"), ("official_brand_domain", 0, "ours"), ("cross_site_redirect", 10, "moved")])
    late, late_points = _listed([("newly_registered_domain", 25, "owner IS NULL AND days <= 30"), ("recently_registered_domain", 10, "owner IS NULL AND days > 30 AND days <= 180")])
    looks, looks_points = _listed([("brand_title_match", 25, "hits > 0"), ("visual_structural_similarity", 30, "alike >= 0.3")])
    joined = "array_to_string(list_filter([{}], lambda s: s <> ''), ',')".format("m.signals, m.early, array_to_string(list_transform(m.landed, lambda s: 'landing_' || s), ','), CASE WHEN m.look AND m.guard IS NOT NULL THEN 'bot_challenge' ELSE '' END, coalesce(v2.vs, ''), coalesce(b2.bs, ''), m.late")
    return f"""WITH l AS MATERIALIZED ({first}), y AS MATERIALIZED ({landing}), w AS ({_VIEWED}), k AS (SELECT *, {_MARK.format(_quoted(C.OFFLINE_MARKERS))} AS off_mark, {_MARK.format(_quoted(C.CHALLENGE_MARKERS))} AS guard FROM w), g AS (SELECT *, {gone} AS gone FROM k),
        o AS (SELECT g.page_id, g.html, g.final, g.days, g.guard, g.gone, l.host, l.owner, l.signals, l.points, l.brand AS own_brand, g.gone IS NULL AND y.owner IS NOT NULL AS ours, g.gone IS NULL AND y.owner IS NULL AND y.registered <> l.registered AS moved, y.brand AS land_brand, {fresh} AS news FROM g JOIN l USING (page_id) JOIN y USING (page_id)),
        m AS (SELECT *, coalesce(own_brand, CASE WHEN moved THEN land_brand END) AS brand, gone IS NULL AND NOT ours AS look, CASE WHEN moved THEN news ELSE [] END AS landed, {early} AS early, {early_points} AS early_points, {late} AS late, {late_points} AS late_points FROM o),
        v2 AS (SELECT page_id, CASE WHEN brand IS NULL THEN '' ELSE {looks} END AS vs, CASE WHEN brand IS NULL THEN 0 ELSE {looks_points} END AS vp FROM (WITH {_visual_sql("SELECT * FROM v", "SELECT page_id, html, brand FROM m WHERE look")})),
        b2 AS (SELECT page_id, {does} AS bs, {does_points} AS bp FROM (WITH {_pages_sql("SELECT page_id, final AS url, html FROM m WHERE look")} SELECT f.*, m2.brand FROM f JOIN (SELECT page_id, brand FROM m) m2 USING (page_id))),
        z AS (SELECT m.page_id, m.host, m.brand, m.gone IS NULL AS live, {joined} AS signals, least(100, m.points + early_points + coalesce(list_sum(list_transform(m.landed, lambda s: {worth})), 0) + CASE WHEN m.look AND m.guard IS NOT NULL THEN 5 ELSE 0 END + coalesce(v2.vp, 0) + coalesce(b2.bp, 0) + late_points)::INT AS score,
            least(100, m.points) AS url_points, least(100, m.points + CASE WHEN m.own_brand IS NULL THEN 0 ELSE coalesce(v2.vp, 0) END) AS url_visual_points FROM m LEFT JOIN v2 USING (page_id) LEFT JOIN b2 USING (page_id))
        SELECT page_id, host, brand, live, signals, score, {_VERDICT} AS verdict, url_points, url_visual_points FROM z"""


@query(_full_sql())
def url_full_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.sql(spark, sf_dir, _VIEWED)
    none = lambda kind: F.lit(None).cast(kind)
    view = F.struct("ok", F.col("status").cast("int").alias("status"), F.col("final").alias("url"), F.lit(2).alias("hops"), F.lit("text/html").alias("content_type"), "html", none("struct<phash:string,dhash:string>").alias("shot"), none("string").alias("icon_phash"), none("string").alias("icon_md5"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    df = rows.select("page_id", "url", view.cast(V.VIEW).alias("page"), (now - F.make_dt_interval(F.col("days"))).alias("created"))
    out = V.judged(df, now=now)
    return out.select("page_id", "host", "brand", "live", _joined(F.transform("signals", lambda s: s["name"])).alias("signals"), "score", "verdict", F.col("stages.url").alias("url_points"), F.col("stages.url_visual").alias("url_visual_points"))
