"""Queries over cases, plans, exports, landed answers and labelled sets, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions.urls import host_of, lexical
from sentrylake.operators import casework as K
from sentrylake.operators import exports as X
from sentrylake.operators import labelled as L
from sentrylake.operators import reads as R
from sentrylake.operators import verdicts as V
from sentrylake.plans import base as B
from sentrylake.plans.queries import _HOST, _OWNER, _PLATFORM, _REG, _quoted, _table, query
from sentrylake.sources import landed


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.sql(spark, sf_dir, B.CASE_ASSETS)
    return a.withColumns({"host_contacts": F.array("host_contact"), "certs": F.split("cert_list", ",")})


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sql(spark, sf_dir, B.with_case_assets("SELECT * FROM e"))


_ADDRESS = "regexp_matches(domain, '^([0-9.]+|\\[?[0-9a-f:]+\\]?)$')"
_CONTACTS = lambda table: "CASE {} " + " ".join(f"WHEN '{k}' THEN [{_quoted(v)}]::VARCHAR[]" for k, v in table.items()) + " END"
_FIXED = _CONTACTS(C.FIXED_CHANNELS)


def _plan_sql(tail: str) -> str:
    own = _CONTACTS({key: to for key, _, _, _, to in C.BRANDS}).format("brand")
    abuse = "CASE platform " + " ".join(f"WHEN '{p}' THEN ['{v}']" for p, v in C.PLATFORM_ABUSE.items()) + " ELSE [] END"
    fixed = lambda r: _FIXED.format(f"'{r}'")
    used = lambda r, kind: f"SELECT campaign, '{r}', '{r}', {fixed(r)}, value FROM e JOIN b USING (id) WHERE type = '{kind}'"
    return f"""WITH a AS ({B.CASE_ASSETS}), e AS ({B.ENTITIES}), b AS (SELECT *, {_PLATFORM.format(h="lower(domain)")} AS platform, {_REG.format(h="domain")} AS registered FROM a WHERE campaign IS NOT NULL AND review <> 'false_positive'), w AS (SELECT * FROM b WHERE kind = 'web'),
        t AS (SELECT campaign, 'registrar' AS recipient, coalesce(registrar, 'unknown registrar') AS name, CASE WHEN registrar_contact IS NULL THEN []::VARCHAR[] ELSE [registrar_contact] END AS contacts, registered AS target FROM w WHERE platform IS NULL AND NOT {_ADDRESS}
        UNION SELECT campaign, 'hosting', platform, {abuse}, url FROM w WHERE platform IS NOT NULL UNION SELECT campaign, 'hosting', trim(asn || ' ' || coalesce(as_name, '')), [host_contact], url FROM w WHERE platform IS NULL AND asn IS NOT NULL
        UNION SELECT campaign, 'bank', brand, {own}, url FROM b WHERE brand IS NOT NULL UNION {used("npci", "upi_id")} UNION {used("telecom", "phone")} UNION SELECT campaign, 'app_store', 'app_store', {fixed("app_store")}, package || ' (' || sha256 || ')' FROM b WHERE kind = 'app'
        UNION SELECT campaign, 'safe_browsing', 'safe_browsing', {fixed("safe_browsing")}, url FROM w UNION SELECT campaign, 'cert_in', 'cert_in', {fixed("cert_in")}, campaign FROM b UNION SELECT campaign, 'cybercrime_portal', 'cybercrime_portal', {fixed("cybercrime_portal")}, campaign FROM b) {tail}"""


@query(_plan_sql("SELECT campaign, recipient, name, array_to_string(contacts, ',') AS contacts, target FROM t"))
def takedown_plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.plan_targets(_assets(spark, sf_dir), _entities(spark, sf_dir))
    return out.select("campaign", "recipient", "name", F.array_join("contacts", ",").alias("contacts"), "target")


@query(_plan_sql("""SELECT campaign, recipient, name, CASE WHEN len(c) = 0 THEN 'lookup_required' WHEN len(list_filter(c, lambda x: NOT contains(x, '@'))) = 0 THEN 'email' WHEN len(list_filter(c, lambda x: starts_with(x, 'http'))) > 0 THEN 'web_form' ELSE 'phone' END AS channel, array_to_string(c, ',') AS contacts, targets
    FROM (SELECT campaign, recipient, name, list_sort(list_distinct(flatten(list(contacts)))) AS c, count(DISTINCT target) AS targets FROM t GROUP BY ALL)"""))
def takedown_plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.plan(K.plan_targets(_assets(spark, sf_dir), _entities(spark, sf_dir)))
    return out.select("campaign", "recipient", "name", "channel", F.array_join("contacts", ",").alias("contacts"), "targets")


_REQUESTS = "SELECT user_id * 100 + n AS case_id, 'camp-' || CAST(user_id % 40 AS VARCHAR(12)) AS campaign, CASE n WHEN 0 THEN 'registrar' WHEN 1 THEN 'bank' WHEN 2 THEN 'npci' ELSE 'hosting' END AS recipient, CASE WHEN n = 3 THEN 'given@example.org' END AS contact, CASE WHEN n = 0 THEN 'host' || CAST(user_id AS VARCHAR(12)) || '.co.in' WHEN n = 1 THEN 'https://host' || CAST(user_id AS VARCHAR(12)) || '.web.app/p1' WHEN n = 3 THEN 'nowhere' END AS wanted FROM (SELECT DISTINCT user_id FROM events) d JOIN (VALUES (0), (1), (2), (3)) v(n) ON TRUE"


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, e = _assets(spark, sf_dir), _entities(spark, sf_dir)
    requests = B.sql(spark, sf_dir, _REQUESTS).withColumn("wanted", F.when(F.col("wanted").isNotNull(), F.array("wanted")))
    return K.opened(requests, K.case_targets(a, e), K.plan_targets(a, e))


_WHOLE = """c AS (SELECT DISTINCT campaign, 'registrar' AS recipient, registered AS target FROM w WHERE NOT """ + _ADDRESS + """ UNION SELECT campaign, 'npci', value FROM e JOIN b USING (id) WHERE type = 'upi_id' UNION SELECT campaign, r, url FROM b, (VALUES ('bank'), ('hosting')) v(r) WHERE kind <> 'message'),
    q AS (""" + _REQUESTS + """), h AS (SELECT case_id, target FROM q JOIN c USING (campaign, recipient) WHERE wanted IS NULL OR wanted = target)"""


@query(_plan_sql(f", {_WHOLE} SELECT * FROM h UNION SELECT case_id, wanted FROM q WHERE wanted IS NOT NULL AND case_id NOT IN (SELECT case_id FROM h)").replace(") , c AS", "), c AS"))
def case_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)[1]


@query(_plan_sql(f", {_WHOLE}, i AS (SELECT *, contacts[1] AS first FROM t WHERE len(contacts) > 0) SELECT case_id, q.campaign, q.recipient, coalesce(contact, found) AS contact FROM q LEFT JOIN (SELECT case_id, arg_min(first, {{'n': name, 'f': first}}) AS found FROM q JOIN i ON i.campaign = q.campaign AND i.recipient = q.recipient AND (wanted IS NULL OR wanted = target) GROUP BY case_id) USING (case_id)").replace(") , c AS", "), c AS"))
def case_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)[0]


@query(B.with_case_assets("""SELECT DISTINCT campaign AS case_id, id FROM (SELECT *, bool_or(hit) OVER (PARTITION BY campaign) AS any_hit FROM (SELECT campaign, id, 'host' || CAST(replace(campaign, 'camp-', '')::INT + 40 AS VARCHAR) || '.co.in' IN (domain, url) AS hit FROM a WHERE campaign IS NOT NULL)) WHERE hit OR NOT any_hit"""))
def case_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assets(spark, sf_dir).where("campaign IS NOT NULL").withColumn("case_id", F.col("campaign"))
    targets = a.select("case_id").distinct().withColumn("target", F.concat(F.lit("host"), (F.replace("case_id", F.lit("camp-"), F.lit("")).cast("int") + 40).cast("string"), F.lit(".co.in")))
    return K.in_scope(a.select("case_id", "id", F.array("url", "domain").alias("keys")), targets)


_STEPS = "SELECT user_id AS case_id, ts AS at, event_id AS seq, CASE event_type WHEN 'click' THEN 'sent' WHEN 'view' THEN 'acknowledged' WHEN 'error' THEN 'resolved' ELSE 'rejected' END AS status, CASE WHEN event_id % 5 = 0 THEN 'note ' || CAST(event_id AS VARCHAR(12)) END AS note FROM events WHERE event_id % 3 = 0"


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = B.sql(spark, sf_dir, "SELECT user_id AS case_id, min(ts) AS created_at FROM events GROUP BY user_id")
    return cases, B.sql(spark, sf_dir, _STEPS)


@query(f"""WITH s AS ({_STEPS}), c AS (SELECT user_id AS case_id, min(ts) AS created_at FROM events GROUP BY user_id),
    g AS (SELECT case_id, arg_max(status, {{'a': "at", 's': seq}}) AS status, max("at") AS at, min("at") FILTER (status = 'sent') AS sent_at, max("at") FILTER (status IN ('resolved', 'rejected')) AS resolved_at, string_agg(strftime("at", '%Y-%m-%d %H:%M') || ' UTC [' || status || '] ' || note, '; ' ORDER BY "at", seq) FILTER (note IS NOT NULL) AS notes FROM s GROUP BY case_id)
    SELECT case_id, coalesce(status, 'drafted') AS status, coalesce("at", created_at) AS updated_at, sent_at, resolved_at, coalesce(notes, '') AS notes FROM c LEFT JOIN g USING (case_id)""")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.status_of(*_steps(spark, sf_dir))
    return out.select("case_id", "status", "updated_at", "sent_at", "resolved_at", F.array_join("notes", "; ").alias("notes"))


@query(f"""SELECT status, count(*) AS n, status IN ('drafted', 'sent', 'acknowledged') AS open FROM (SELECT case_id, arg_max(status, {{'a': "at", 's': seq}}) AS status FROM ({_STEPS}) GROUP BY case_id) GROUP BY status""")
def case_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, steps = _steps(spark, sf_dir)
    return R.case_counts(K.status_of(cases.join(steps.select("case_id").distinct(), "case_id", "left_semi"), steps))


_CHECKS = "SELECT user_id AS case_id, CAST(ts AS DATE) AS at, value > 25 AS live FROM events"


@query(f"""WITH k AS ({_CHECKS}), l AS (SELECT case_id, max("at") AS at FROM k GROUP BY case_id), s AS (SELECT case_id, arg_max(status, {{'a': "at", 's': seq}}) AS status FROM ({_STEPS}) GROUP BY case_id)
    SELECT case_id, l."at", 'resolved' AS status, 'All targets offline on re-check' AS note FROM k JOIN l USING (case_id, "at") JOIN s USING (case_id) WHERE s.status IN ('sent', 'acknowledged') GROUP BY case_id, l."at" HAVING NOT bool_or(live)""")
def case_resolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resolving(K.status_of(*_steps(spark, sf_dir)), B.sql(spark, sf_dir, _CHECKS)).select("case_id", "at", "status", "note")


@query(f"""SELECT case_id, "at", count(*) FILTER (live) AS live FROM ({_CHECKS}) JOIN (SELECT case_id, max("at") AS at FROM ({_CHECKS}) GROUP BY case_id) USING (case_id, "at") GROUP BY case_id, "at" """)
def case_live_at_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.live_at_last(B.sql(spark, sf_dir, _CHECKS)).select("case_id", "at", "live")


@query("SELECT id, CASE WHEN target IS NULL OR starts_with(target, 'android://') OR NOT contains(target, '.') THEN NULL WHEN contains(target, '://') THEN target ELSE 'http://' || target || '/' END AS url FROM (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'android://x.y' WHEN 1 THEN 'host' || user_id || '.in' WHEN 2 THEN 'https://a.b/c' ELSE '9876543210' END AS target FROM events)")
def case_check_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.sql(spark, sf_dir, "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'android://x.y' WHEN 1 THEN 'host' || CAST(user_id AS VARCHAR(12)) || '.in' WHEN 2 THEN 'https://a.b/c' ELSE '9876543210' END AS target FROM events")
    return t.select("id", K.check_url(F.col("target")).alias("url"))


_REVIEWS = "SELECT user_id AS id, ts AS at, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'confirmed' ELSE 'false_positive' END AS review, 'n' || CAST(event_id AS VARCHAR(12)) AS note, event_type AS who FROM events WHERE event_id % 7 = 0"


@query(f"""WITH r AS ({_REVIEWS}) SELECT a.id, coalesce(r.review, 'unreviewed') AS review, r.note AS review_note, r.who AS reviewed_by, r."at" AS reviewed_at FROM ({B.CASE_ASSETS}) a LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, seq DESC) = 1) r ON r.id = a.id""")
def asset_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = B.sql(spark, sf_dir, _REVIEWS).withColumnRenamed("who", "by")
    return K.reviewed(_assets(spark, sf_dir), reviews).select("id", "review", "review_note", "reviewed_by", "reviewed_at")


@query("""SELECT ts AS at, event_type AS actor, 'review' AS action, CAST(user_id AS VARCHAR) AS target, '{"value":' || CAST(event_id AS VARCHAR) || ',"note":"n"}' AS detail FROM events WHERE event_id % 7 = 0 AND user_id = 3 ORDER BY ts DESC LIMIT 200""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("value"), F.col("ts").alias("at"), F.col("event_type").alias("actor"), F.col("user_id").alias("id"), F.lit("n").alias("note"))
    log = K.audit(e, "review", "id", "value", "note").withColumn("id", F.col("detail"))
    return R.newest(log, "at", 200, target="3").drop("id")


@query("SELECT user_id AS job, count(*) AS processed, count(*) FILTER (value <= 1) AS failed, count(DISTINCT CASE WHEN value > 1 THEN event_type END) AS assets FROM events GROUP BY user_id")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return R.progress(e.select(F.col("user_id").alias("job"), (F.col("value") > 1).alias("ok"), F.when(F.col("value") > 1, F.col("event_type")).alias("asset")))


@query(B.with_case_assets("SELECT campaign, count(*) FILTER (kind = 'web') AS sites, count(*) FILTER (kind = 'app') AS apps, count(*) FILTER (kind = 'message') AS messages FROM a WHERE campaign IS NOT NULL GROUP BY campaign"))
def campaign_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_kind(_assets(spark, sf_dir).where("campaign IS NOT NULL"))


@query(f"SELECT source AS name, 'source' AS what, count(*) AS n FROM ({B.ASSETS}) WHERE {B.FLAGGED} GROUP BY source UNION ALL SELECT brand, 'brand', count(*) FROM ({B.ASSETS}) WHERE {B.FLAGGED} AND brand IS NOT NULL GROUP BY brand UNION ALL SELECT review, 'review', count(*) FROM ({B.ASSETS}) GROUP BY review")
def summary_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.sql(spark, sf_dir, B.ASSETS)
    on = a.where(R.flagged())
    of = lambda df, by: R.counts(df, by).select(F.col(by).alias("name"), F.lit(by).alias("what"), "n")
    return of(on, "source").unionByName(of(on.where("brand IS NOT NULL"), "brand")).unionByName(of(a, "review"))


# exports
_CAMPAIGNS = "SELECT campaign, 'Campaign ' || campaign AS name, count(*) AS size, min(first_seen) AS first_seen, max(coalesce(last_seen, first_seen)) AS last_seen FROM a WHERE campaign IS NOT NULL GROUP BY campaign"
_SHARED = "SELECT DISTINCT campaign, type, value FROM e JOIN a USING (id) WHERE campaign IS NOT NULL AND type IN ('ip', 'asn', 'phone') AND id % 10 = 0"
_UUID = "regexp_replace(substr(h, 1, 13) || '5' || substr(h, 14, 3) || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 15), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _id_sql(kind: str, value: str) -> str:
    h = f"sha1(unhex('{X.URL_SPACE}') || encode('{X.OURS}:{kind}:' || {value}))"
    flat = f"substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || substr('89ab', (('0x' || substr({h}, 17, 1))::INT % 4) + 1, 1) || substr({h}, 18, 15)"
    return f"'{kind}--' || regexp_replace({flat}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


_ESCAPED = "replace(replace({}, '\\', '\\\\'), '''', '\\''')"
_STIX = f"""b AS (SELECT * FROM a WHERE campaign IS NOT NULL AND review <> 'false_positive'), p AS (SELECT campaign, '[file:hashes.''SHA-256'' = ''' || sha256 || ''']' AS pattern, 'Fake app ' || package AS name FROM b WHERE kind = 'app' UNION SELECT campaign, '[url:value = ''' || {_ESCAPED.format("url")} || ''']', 'Phishing URL ' || domain FROM b WHERE kind = 'web'
    UNION SELECT campaign, '[' || CASE type WHEN 'ip' THEN 'ipv4-addr' WHEN 'upi_id' THEN 'x-upi-handle' ELSE 'x-phone-number' END || ':value = ''' || {_ESCAPED.format("value")} || ''']', CASE type WHEN 'ip' THEN 'Hosting IP ' WHEN 'upi_id' THEN 'Mule UPI handle ' ELSE 'Fraud phone number ' END || value FROM e JOIN b USING (id) WHERE type IN ('ip', 'upi_id', 'phone')),
    i AS (SELECT campaign, {_id_sql("indicator", "pattern")} AS id, pattern, name FROM p)"""


@query(B.with_case_assets(f", {_STIX}, r AS (SELECT campaign, {_id_sql('relationship', 'id')} AS id FROM i) SELECT campaign, id, 'indicator' AS type, pattern, name FROM i UNION ALL SELECT campaign, id, 'relationship', NULL, NULL FROM r UNION ALL SELECT DISTINCT campaign, {_id_sql('campaign', 'campaign')}, 'campaign', NULL, 'Campaign ' || campaign FROM a WHERE campaign IS NOT NULL").replace(") , b AS", "), b AS"))
def stix_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    campaigns = B.sql(spark, sf_dir, B.with_case_assets(_CAMPAIGNS)).withColumn("brands", F.array().cast("array<string>"))
    out = X.stix_objects(campaigns, X.stix_patterns(_assets(spark, sf_dir), _entities(spark, sf_dir)), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("campaign", "id", *(F.get_json_object("object", f"$.{x}").alias(x) for x in ("type", "pattern", "name")))


_REASONS = "substr(coalesce(nullif(reasons, ''), 'n/a'), 1, 200)"
_WHAT = "CASE kind WHEN 'app' THEN 'Android app ' || label || ' (' || package || ')' WHEN 'message' THEN upper(domain) || ' lure \"' || substr(excerpt, 1, 90) || '\"' ELSE url END"


_KNOWN = f"""f AS (SELECT campaign, count(*) FILTER (kind = 'web') AS sites, count(*) FILTER (kind = 'app') AS apps, count(*) FILTER (kind = 'message') AS messages, bool_or(kind = 'web' AND NOT {_ADDRESS}) AS named FROM b GROUP BY campaign), l AS (SELECT campaign, list(DISTINCT type) AS linked FROM s GROUP BY campaign),
    k AS (SELECT c.*, coalesce(sites, 0) AS sites, coalesce(apps, 0) AS apps, coalesce(messages, 0) AS messages, coalesce(named, FALSE) AS named, coalesce(linked, []) AS linked FROM c LEFT JOIN f USING (campaign) LEFT JOIN l USING (campaign))"""


def _fixed_sql(*lines: tuple[int, str, str]) -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {when} THEN {{'s': {n}, 'l': {line}}} END" for n, line, when in lines) + "], lambda x: x IS NOT NULL)) AS x"


#: Some campaigns have no evidence that links them.
_LINKS = f"SELECT * FROM ({_SHARED}) WHERE campaign NOT LIKE '%7'"


def _report_sql() -> str:
    rows = ", ".join(f"('{r}', '{C.INTROS[r]}', '{C.CONTEXTS[r][0]}', [{_quoted(C.CONTEXTS[r][1])}]::VARCHAR[])" for r in C.INTROS)
    wants = f"recipient IN ({_quoted(C.WANTS_DOMAINS)})"
    bare = f"CASE WHEN recipient = 'safe_browsing' THEN sites = 0 ELSE NOT ({wants} AND named) AND NOT list_has_any(linked, types) END"
    header = "'Campaign: ' || name || ' (' || size || ' sites, first seen ' || strftime(first_seen, '%Y-%m-%d') || ')'"
    q = lambda x: f"'{x}'"
    fixed = _fixed_sql((0, "intro", "TRUE"), (1, "''", "TRUE"), (2, header, "TRUE"), (3, "''", "TRUE"), (4, q(C.EVIDENCE), "TRUE"), (5, q(C.NO_EVIDENCE), "len(linked) = 0"), (6, "''", "TRUE"), (7, "label || ':'", "TRUE"), (8, q(C.NO_APPS), "recipient = 'app_store' AND apps = 0"), (10, q(C.NO_CONTEXT), bare), (11, "''", "TRUE"), (12, q(C.REPORTED), "TRUE"), (14, "''", "TRUE"), (15, q(C.CLOSING), "TRUE"))
    about = "['  - ' || b.label || ' (' || package || ', version ' || coalesce(version, 'unknown') || ')', '      APK SHA-256: ' || sha256] || list_transform(coalesce(string_split(cert_list, ','), []), lambda x: '      signing certificate SHA-256: ' || x) || CASE WHEN origin_url IS NULL THEN [] ELSE ['      distributed from: ' || origin_url] END"
    risk = f"'  - ' || {_WHAT.replace('label', 'b.label')} || '  (risk ' || printf('%.2f', points / 100) || ', seen ' || strftime(b.first_seen, '%Y-%m-%d %H:%M') || ' UTC; ' || {_REASONS} || ')'"
    many = lambda section, lines, when: f"SELECT campaign, recipient, {section}, id, i - 1, ls[i] FROM (SELECT campaign, recipient, id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT campaign, recipient, b.id::VARCHAR AS id, {lines} AS ls FROM t JOIN b USING (campaign) WHERE {when}))"
    return B.with_case_assets(f""", c AS ({_CAMPAIGNS}), s AS ({_LINKS}), b AS (SELECT * FROM a WHERE review <> 'false_positive'), {_KNOWN}, t AS (SELECT * FROM k, (VALUES {rows}) v(recipient, intro, label, types))
        SELECT campaign, recipient, x.s AS section, '' AS at, 0 AS nth, x.l AS line FROM (SELECT campaign, recipient, {fixed} FROM t)
        UNION ALL SELECT campaign, recipient, 5, type || ': ' || value, 0, '  - shared ' || type || ': ' || value FROM t JOIN s USING (campaign) UNION ALL {many(8, about, "recipient = 'app_store' AND kind = 'app'")}
        UNION ALL SELECT DISTINCT campaign, recipient, 8, domain, 0, '  - domain: ' || domain FROM t JOIN b USING (campaign) WHERE {wants} AND kind = 'web' AND NOT {_ADDRESS}
        UNION ALL SELECT campaign, recipient, 8, b.id::VARCHAR, 0, '  - ' || url FROM t JOIN b USING (campaign) WHERE recipient = 'safe_browsing' AND kind = 'web' UNION ALL SELECT campaign, recipient, 9, type || ': ' || value, 0, '  - ' || type || ': ' || value FROM t JOIN s USING (campaign) WHERE list_contains(types, type)
        UNION ALL {many(13, f"[{risk}] || CASE WHEN screenshot IS NULL THEN [] ELSE ['      screenshot evidence: ' || screenshot] END", "TRUE")}""").replace(") , c AS", "), c AS")


@query(_report_sql())
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.report_lines(B.sql(spark, sf_dir, B.with_case_assets(_CAMPAIGNS)), _assets(spark, sf_dir), B.sql(spark, sf_dir, B.with_case_assets(_LINKS)))


#: Cases of some campaigns, as their events left them.
_CASES = "SELECT 'camp-' || CAST(user_id % 40 AS VARCHAR(12)) AS campaign, event_id AS case_id, CASE WHEN event_id % 2 = 0 THEN 'bank' ELSE 'registrar' END AS recipient, CASE WHEN event_id % 3 = 0 THEN 'abuse@r.example' END AS contact, CASE WHEN event_id % 5 = 0 THEN 'sent' ELSE 'drafted' END AS status, ts AS updated_at FROM events WHERE event_id % 11 = 0 AND user_id % 40 > 9"


def _dossier_sql() -> str:
    lines = [(0, "'# ' || name"), (1, "''"), (2, "'- Campaign id: `' || campaign || '`'"), (3, "'- Assets: ' || size || ' (' || sites || ' sites, ' || apps || ' apps, ' || messages || ' messages)'"), (4, "'- First seen: ' || strftime(first_seen, '%Y-%m-%d %H:%M') || ' UTC; last seen ' || strftime(last_seen, '%Y-%m-%d %H:%M') || ' UTC'"), (5, "''"), (6, "'## Linking evidence'"), (7, "''"), (9, "''"), (10, "'## Assets'"), (11, "''"), (12, "'| asset | kind | risk | verdict | review | top signals |'"), (13, "'|---|---|---|---|---|---|'"), (15, "''"), (16, "'## Takedown plan'"), (17, "''"), (19, "''"), (20, "'## Takedown cases'"), (21, "''")]
    fixed = _fixed_sql(*((n, x, "TRUE") for n, x in lines), (8, "'- none'", "len(linked) = 0"), (22, "'- none yet'", "campaign NOT IN (SELECT campaign FROM z)"))
    text = lambda x: "'" + x.replace("'", "''") + "'"
    brand = "CASE name " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t, *_ in C.BRANDS) + " ELSE name END"
    why = "CASE recipient " + " ".join(f"WHEN '{r}' THEN replace({text(v)}, '{{}}', {brand if r == 'bank' else 'name'})" for r, v in C.RATIONALES.items()) + " END || CASE WHEN len(c) > 0 THEN '' " + " ".join(f"WHEN recipient = '{r}' THEN {text(v)}" for r, v in C.NO_CONTACT.items()) + " ELSE '' END"
    way = "CASE WHEN len(c) = 0 THEN 'lookup_required' WHEN len(list_filter(c, lambda x: NOT contains(x, '@'))) = 0 THEN 'email' WHEN len(list_filter(c, lambda x: starts_with(x, 'http'))) > 0 THEN 'web_form' ELSE 'phone' END"
    asset = "CASE kind WHEN 'app' THEN label || ' (' || package || ')' WHEN 'message' THEN replace(substr(excerpt, 1, 80), '|', '/') ELSE url END"
    return _plan_sql(f""", c AS ({_CAMPAIGNS}), s AS ({_LINKS}), {_KNOWN}, z AS ({_CASES}), i AS (SELECT campaign, recipient, name, list_sort(list_distinct(flatten(list(contacts)))) AS c, count(DISTINCT target) AS targets FROM t GROUP BY ALL)
        SELECT campaign, x.s AS section, '' AS at, x.l AS line FROM (SELECT campaign, {fixed} FROM k) UNION ALL SELECT campaign, 8, type || ': ' || value, '- ' || type || ': `' || value || '`' FROM s
        UNION ALL SELECT campaign, 14, lpad(CAST(1000 - points AS VARCHAR), 4, '0') || '-' || id, '| `' || {asset} || '` | ' || kind || ' | ' || printf('%.2f', points / 100) || ' | ' || verdict || ' | ' || review || ' | ' || CASE WHEN id % 2 = 0 THEN 'b, c, a' ELSE 'c' END || ' |' FROM b
        UNION ALL SELECT campaign, 18, list_position([{_quoted(list(C.RATIONALES))}], recipient) || '-' || name, '- **' || recipient || '** via ' || {way} || ' (' || CASE WHEN len(c) = 0 THEN 'lookup required' ELSE array_to_string(c, ', ') END || '): ' || {why} || '; ' || targets || ' target(s)' FROM i
        UNION ALL SELECT campaign, 22, case_id::VARCHAR, '- `' || case_id || '` ' || recipient || ' -> ' || coalesce(contact, 'n/a') || ': **' || status || '**, updated ' || strftime(updated_at, '%Y-%m-%d %H:%M') || ' UTC' FROM z WHERE campaign IN (SELECT campaign FROM c)""").replace(") , c AS", "), c AS")


@query(_dossier_sql())
def dossier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = lambda n, p: F.struct(F.lit(n).alias("name"), F.lit(p).alias("points"))
    some = F.when(F.col("id") % 2 == 0, F.array(signal("a", 10), signal("b", 30), signal("c", 20), signal("d", 5))).otherwise(F.array(signal("z", 0), signal("c", 20)))
    a, e = _assets(spark, sf_dir), _entities(spark, sf_dir)
    campaigns, shared = (B.sql(spark, sf_dir, B.with_case_assets(x)) for x in (_CAMPAIGNS, _LINKS))
    return X.dossier_lines(campaigns, a.withColumn("signals", some), shared, K.plan(K.plan_targets(a, e)), B.sql(spark, sf_dir, _CASES))


@query(B.with_case_assets("""SELECT campaign, 'member' AS kind, '{"campaign":"' || campaign || '","id":' || id || ',"url":"' || url || '"' || CASE WHEN brand IS NULL THEN '' ELSE ',"brand":"' || brand || '"' END || '}' AS object FROM a WHERE campaign IS NOT NULL"""))
def campaign_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.as_json(_assets(spark, sf_dir).where("campaign IS NOT NULL").select("campaign", "id", "url", "brand"), "member")


# landed answers
_RDAP = """SELECT 'd' || CAST(event_id AS VARCHAR(12)) || '.com' AS domain, CASE WHEN event_id % 5 = 0 THEN 'not json' WHEN event_id % 5 = 1 THEN '{"events": [{"eventAction": "last changed", "eventDate": "2020-01-01T00:00:00Z"}]}' ELSE
    '{"events": [{"eventAction": "registration", "eventDate": "2019-03-0' || CAST(event_id % 9 + 1 AS VARCHAR(12)) || 'T10:00:00Z"}], "entities": [{"roles": ["registrant"]}, {"roles": ["registrar"], "vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "Reg ' || CAST(user_id AS VARCHAR(12)) || '"]], "x"], "entities": [{"roles": ["abuse"], "vcardArray": ["vcard", [["email", {}, "text", "abuse@r.example"], ["tel", {"type": "voice"}, "uri", "tel:+1.555"]]]}]}]}' END AS raw FROM events"""


@query("SELECT 'd' || event_id || '.com' AS domain, CASE WHEN event_id % 5 > 1 THEN make_timestamp(2019, 3, event_id % 9 + 1, 10, 0, 0) END AS created, CASE WHEN event_id % 5 > 1 THEN 'Reg ' || user_id END AS registrar, CASE WHEN event_id % 5 > 1 THEN 'abuse@r.example' END AS abuse_email, CASE WHEN event_id % 5 > 1 THEN '+1.555' END AS abuse_phone FROM events")
def rdap_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.registrations(B.sql(spark, sf_dir, _RDAP))


_NETS = """SELECT '10.0.' || CAST(event_id AS VARCHAR(12)) AS ip, CASE WHEN event_id % 4 = 0 THEN '{}' WHEN event_id % 4 = 1 THEN '{"data": {"asns": ["13335"], "prefix": "10.0.0.0/8"}}' ELSE '{"data": {"asns": ["' || CAST(user_id AS VARCHAR(12)) || '", "2"], "prefix": "10.0.0.0/16"}}' END AS network, '{"data": {"holder": "Net ' || CAST(user_id AS VARCHAR(12)) || '"}}' AS overview, CASE WHEN event_id % 3 = 0 THEN 'oops' ELSE '{"data": {"abuse_contacts": ["a@n.example", "b@n.example"]}}' END AS abuse FROM events"""


@query(f"""WITH n AS (SELECT ip, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'AS13335' ELSE 'AS' || user_id END AS asn, user_id, event_id FROM (SELECT '10.0.' || event_id AS ip, * FROM events))
    SELECT 'h' || event_id || '.com' AS host, n.ip, asn, CASE WHEN asn IS NOT NULL THEN 'Net ' || user_id END AS as_name, coalesce(asn IN ({_quoted(C.SHARED_NETWORKS)}), FALSE) AS shared_hosting, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'a@n.example,b@n.example' END AS contacts, CASE WHEN event_id % 5 > 1 THEN 'Reg ' || user_id END AS registrar FROM n""")
def host_infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, their addresses, networks and registrations, joined."""
    e = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("i"))
    hosts = e.select(F.concat(F.lit("h"), "i", F.lit(".com")).alias("host"), F.concat(F.lit("d"), "i", F.lit(".com")).alias("registered"))
    addresses = e.select(F.concat(F.lit("h"), "i", F.lit(".com")).alias("host"), F.concat(F.lit("10.0."), "i").alias("ip"))
    out = V.infrastructure(hosts, addresses, landed.networks(B.sql(spark, sf_dir, _NETS)), landed.registrations(B.sql(spark, sf_dir, _RDAP)))
    return out.select("host", "ip", "asn", "as_name", "shared_hosting", F.array_join("host_contacts", ",").alias("contacts"), "registrar")


_RULES = ["// comment", "", "com", "in", "co.in", "web.app", "*.ck", "!www.ck", "example.com", "top", "site  trailing", "jp", "ne.jp"]
_HOSTS = "SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'a.b' || CAST(user_id AS VARCHAR(12)) || '.co.in' WHEN 1 THEN 'x' || CAST(user_id AS VARCHAR(12)) || '.web.app' WHEN 2 THEN 'www.ck' WHEN 3 THEN 'a.b' || CAST(user_id AS VARCHAR(12)) || '.ck' WHEN 4 THEN 'co.in' WHEN 5 THEN 'u' || CAST(user_id AS VARCHAR(12)) || '.ne.jp' WHEN 6 THEN 'no.rule' ELSE 'y.z' || CAST(user_id AS VARCHAR(12)) || '.com' END AS host FROM events"


@query("""SELECT DISTINCT CASE m WHEN 0 THEN 'a.b' || u || '.co.in' WHEN 1 THEN 'x' || u || '.web.app' WHEN 2 THEN 'www.ck' WHEN 3 THEN 'a.b' || u || '.ck' WHEN 4 THEN 'co.in' WHEN 5 THEN 'u' || u || '.ne.jp' WHEN 6 THEN 'no.rule' ELSE 'y.z' || u || '.com' END AS host,
    CASE m WHEN 0 THEN 'co.in' WHEN 1 THEN 'web.app' WHEN 2 THEN 'ck' WHEN 3 THEN 'b' || u || '.ck' WHEN 4 THEN 'co.in' WHEN 5 THEN 'ne.jp' WHEN 6 THEN NULL ELSE 'com' END AS suffix,
    CASE m WHEN 0 THEN 'b' || u || '.co.in' WHEN 1 THEN 'x' || u || '.web.app' WHEN 2 THEN 'www.ck' WHEN 3 THEN 'a.b' || u || '.ck' WHEN 5 THEN 'u' || u || '.ne.jp' WHEN 7 THEN 'z' || u || '.com' END AS registered FROM (SELECT event_id % 8 AS m, user_id AS u FROM events)""")
def suffix_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = landed.suffix_rules(spark.createDataFrame([(r,) for r in _RULES], "value string"))
    return landed.registered_by(B.sql(spark, sf_dir, _HOSTS), rules)


_LOGIN = f"SELECT id, 'https://login.' || host || '/' || CAST(id AS VARCHAR(12)) AS url FROM ({_HOSTS}) h"


@query("""SELECT id, 'login.' || CASE m WHEN 0 THEN 'a.b' || u || '.co.in' WHEN 1 THEN 'x' || u || '.web.app' WHEN 2 THEN 'www.ck' WHEN 3 THEN 'a.b' || u || '.ck' WHEN 4 THEN 'co.in' WHEN 5 THEN 'u' || u || '.ne.jp' WHEN 6 THEN 'no.rule' ELSE 'y.z' || u || '.com' END AS host,
    CASE m WHEN 0 THEN 'b' || u || '.co.in' WHEN 1 THEN 'x' || u || '.web.app' WHEN 2 THEN 'www.ck' WHEN 3 THEN 'a.b' || u || '.ck' WHEN 4 THEN 'login.co.in' WHEN 5 THEN 'u' || u || '.ne.jp' WHEN 6 THEN 'no.rule' ELSE 'z' || u || '.com' END AS registered FROM (SELECT event_id AS id, event_id % 8 AS m, user_id AS u FROM events)""")
def url_registered_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lexical rules take for registered names under a list of suffixes."""
    rules = landed.suffix_rules(spark.createDataFrame([(r,) for r in _RULES], "value string"))
    rows = B.sql(spark, sf_dir, _LOGIN).withColumn("site", host_of(F.col("url")))
    return lexical(landed.with_registered(rows, rules, "site", "name"), "url", "name").select("id", "host", "registered")


# labelled sets
_FEED = f"SELECT CASE WHEN id % 2 = 0 THEN 'links' ELSE 'openlist' END AS source, id % 2 AS rank, id AS nth, CASE WHEN id % 29 = 0 THEN '# ' || url WHEN id % 31 = 0 THEN url || ' x' ELSE url END AS value FROM ({B.URL_ROWS}) q"
_RANKING = "SELECT event_id + 1 AS rank, CASE event_id % 6 WHEN 0 THEN 'news' || CAST(user_id AS VARCHAR(12)) || '.com' WHEN 1 THEN 'upimarket' || CAST(user_id AS VARCHAR(12)) || '.com' WHEN 2 THEN 'paytm.com' WHEN 3 THEN 'site' || CAST(event_id AS VARCHAR(12)) || '.net' WHEN 4 THEN 'payment' || CAST(user_id + 100 AS VARCHAR(12)) || '.com' ELSE 'blog' || CAST(event_id % 50 AS VARCHAR(12)) || '.org' END AS domain FROM events"
_TARGETS = "SELECT DISTINCT 'hdfc' || CAST(user_id + 100 AS VARCHAR(12)) || '.vercel.app' AS host, 'hdfc' AS target FROM events"


def _labelled_sql(tail: str) -> str:
    long = "|".join(w for w in L.WORDS if len(w) >= 5)
    official = lambda h: f"({_OWNER.format(r=_REG.format(h=h))}) IS NOT NULL"
    return f"""WITH f AS (SELECT source, rank, nth, {_HOST.format(u="value")} AS host FROM ({_FEED}) WHERE NOT regexp_matches(value, '^#|[ ,"<>]')), p AS (SELECT host, arg_min(source, {{'r': rank, 'n': nth}}) AS source FROM f WHERE host <> '' GROUP BY host),
        b AS (SELECT host, 'phishing' AS label, source FROM p WHERE NOT {official("host")} AND len(list_filter(regexp_extract_all(lower(host), '[a-z0-9]+'), lambda t: length(t) <= 40 AND regexp_matches(t, '^({"|".join(L.WORDS)})|({long})$'))) > 0),
        c AS (SELECT DISTINCT domain AS host, min(rank) OVER (PARTITION BY domain) AS rank FROM ({_RANKING}) WHERE NOT {official("domain")} AND domain NOT IN (SELECT host FROM p)), h AS (SELECT host, 'benign' AS label, 'ranking_keyword' AS source FROM c WHERE regexp_matches(host, '{"|".join(L.WORDS)}')),
        g AS (SELECT host, 'benign' AS label, 'ranking_general' AS source FROM c WHERE NOT regexp_matches(host, '{"|".join(L.WORDS)}')),
        r AS (SELECT 'https://' || host || '/' AS url, host, label, CASE WHEN label = 'phishing' THEN coalesce(t.target, 'other') ELSE '' END AS target, source, CASE WHEN right(sha256(host), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'dev' ELSE 'test' END AS split FROM (SELECT * FROM b UNION ALL SELECT * FROM h UNION ALL SELECT * FROM g) LEFT JOIN ({_TARGETS}) t USING (host)) {tail}"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a sample as large as all domains: no hash function is common to both engines
    return L.hosts_of(*(B.sql(spark, sf_dir, q) for q in (_FEED, _RANKING, _TARGETS)), general=2**31 - 1, top=2**31 - 1)


@query(_labelled_sql("SELECT url, host, label, target, source, split FROM r"))
def labelled_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


@query(_labelled_sql("SELECT label, split, count(*) AS n FROM r GROUP BY ALL"))
def labelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counted(_labelled(spark, sf_dir))
