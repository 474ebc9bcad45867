"""Campaigns as rows for other systems: STIX 2.1 objects, JSON, lines of reports and dossiers. One row an object or line, so that a
campaign of any size is written by many tasks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.operators.casework import is_address

#: The namespace of URLs in RFC 4122, and what our names there begin with.
URL_SPACE, OURS = "6ba7b8119dad11d180b400c04fd430c8", "sentrylake"


def uuid5(name: Column) -> Column:
    """The UUID of version 5 of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    kind = F.substr(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), kind, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def stix_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), uuid5(F.concat(F.lit(f"{OURS}:{kind}:"), value)))


def escaped(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def stix_patterns(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (campaign, pattern, name) of the indicators of active assets (id, campaign, kind, review, url, domain, package,
    sha256) and their addresses, handles and numbers. Messages are told by the latter alone."""
    active = assets.where("campaign IS NOT NULL AND review <> 'false_positive'")
    app = active.where("kind = 'app'").select("campaign", F.concat(F.lit("[file:hashes.'SHA-256' = '"), "sha256", F.lit("']")).alias("pattern"), F.concat(F.lit("Fake app "), "package").alias("name"))
    web = active.where("kind = 'web'").select("campaign", F.concat(F.lit("[url:value = '"), escaped(F.col("url")), F.lit("']")).alias("pattern"), F.concat(F.lit("Phishing URL "), "domain").alias("name"))
    used = entities.join(active.select("id", "campaign"), "id")
    out = app.unionByName(web)
    for kind, head, name in (("ip", "ipv4-addr", "Hosting IP "), ("upi_id", "x-upi-handle", "Mule UPI handle "), ("phone", "x-phone-number", "Fraud phone number ")):
        out = out.unionByName(used.where(F.col("type") == kind).select("campaign", F.concat(F.lit(f"[{head}:value = '"), escaped(F.col("value")), F.lit("']")).alias("pattern"), F.concat(F.lit(name), "value").alias("name")))
    return out.distinct()


def stix_objects(campaigns: DataFrame, patterns: DataFrame, now: Column) -> DataFrame:
    """(campaign, id, object: JSON) of the campaigns (campaign, name, first_seen, last_seen, size, brands), of their indicators and
    of the relationships between them. A bundle is the objects of a campaign."""
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.'000Z'")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = lambda kind, key: [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), key.alias("id"), at.alias("created"), at.alias("modified")]
    owner = stix_id("campaign", F.col("campaign").cast("string"))
    brands = F.when(F.size("brands") > 0, F.array_join("brands", ", ")).otherwise("unknown")
    about = F.concat(F.col("size").cast("string"), F.lit(" assets impersonating "), brands)
    camps = campaigns.select("campaign", owner.alias("id"), F.to_json(F.struct(*head("campaign", owner), "name", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"), about.alias("description"))).alias("object"))
    own = patterns.withColumns({"_i": stix_id("indicator", F.col("pattern")), "_c": owner}).withColumn("_r", stix_id("relationship", F.col("_i")))
    ind = own.select("campaign", F.col("_i").alias("id"), F.to_json(F.struct(*head("indicator", F.col("_i")), "name", "pattern", F.lit("stix").alias("pattern_type"), at.alias("valid_from"), F.array(F.lit("malicious-activity")).alias("indicator_types"))).alias("object"))
    rel = own.select("campaign", F.col("_r").alias("id"), F.to_json(F.struct(*head("relationship", F.col("_r")), F.lit("indicates").alias("relationship_type"), F.col("_i").alias("source_ref"), F.col("_c").alias("target_ref"))).alias("object"))
    return camps.unionByName(ind).unionByName(rel)


def as_json(rows: DataFrame, kind: str, key: str = "campaign") -> DataFrame:
    """(campaign, kind, object: JSON) of the rows of a table that has the campaign's id: campaign, member, plan item or case."""
    return rows.select(F.col(key).cast("string").alias("campaign"), F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("object"))


def _texts(*lines: tuple[int, Column | str, Column | None]) -> Column:
    """array<struct<section, line>> of those (section, line, when) whose condition holds or isn't given."""
    some = [F.struct(F.lit(n).alias("section"), (F.lit(line) if isinstance(line, str) else line).alias("line")) for n, line, _ in lines]
    return F.array_compact(F.array(*(x if when is None else F.when(when, x) for x, (_, _, when) in zip(some, lines, strict=True))))


def _known(campaigns: DataFrame, active: DataFrame, shared: DataFrame) -> DataFrame:
    """campaigns with sites, apps and messages (numbers of active assets), named (whether a site has a name, not an address) and
    linked (the kinds of shared entities, of which there are few)."""
    n = active.groupBy("campaign").agg(*(F.count_if(F.col("kind") == k).alias(c) for k, c in (("web", "sites"), ("app", "apps"), ("message", "messages"))), F.bool_or((F.col("kind") == "web") & (F.col("domain") != "") & ~is_address(F.col("domain"))).alias("named"))
    kinds = shared.groupBy("campaign").agg(F.collect_set("type").alias("linked"))
    out = campaigns.join(n, "campaign", "left").join(kinds, "campaign", "left")
    return out.withColumns({"named": F.coalesce("named", F.lit(False)), "linked": F.coalesce("linked", F.array().cast("array<string>")), **{c: F.coalesce(c, F.lit(0)) for c in ("sites", "apps", "messages")}})


def report_lines(campaigns: DataFrame, assets: DataFrame, shared: DataFrame) -> DataFrame:
    """(campaign, recipient, section, at, nth, line) of the report to each of the nine recipients: its text are the lines, in order
    of section, at and nth.

    campaigns: campaign, name, size, first_seen; assets: campaign, id, kind, review, url, domain, label, package, version, sha256,
    certs, origin_url, excerpt, points, first_seen, reasons, screenshot; shared: campaign, type, value of the entities that link the
    campaign. Where a part has nothing to list it says so.
    """
    active = assets.where("review <> 'false_positive'")
    recipients = F.explode(F.array(*(F.struct(F.lit(r).alias("recipient"), F.lit(C.INTROS[r]).alias("intro"), F.lit(C.CONTEXTS[r][0]).alias("label"), F.array(*map(F.lit, C.CONTEXTS[r][1])).cast("array<string>").alias("types")) for r in C.INTROS)))
    to = _known(campaigns, active, shared).select("*", recipients.alias("r")).select("*", "r.*")
    none, wants, search = F.lit(""), F.col("recipient").isin(C.WANTS_DOMAINS), F.col("recipient") == "safe_browsing"
    header = F.concat(F.lit("Campaign: "), "name", F.lit(" ("), F.col("size").cast("string"), F.lit(" sites, first seen "), F.date_format("first_seen", "yyyy-MM-dd"), F.lit(")"))
    bare = F.when(search, F.col("sites") == 0).otherwise(~(wants & F.col("named")) & ~F.arrays_overlap("linked", "types"))
    fixed = _texts((0, F.col("intro"), None), (1, "", None), (2, header, None), (3, "", None), (4, C.EVIDENCE, None), (5, C.NO_EVIDENCE, F.size("linked") == 0), (6, "", None), (7, F.concat("label", F.lit(":")), None), (8, C.NO_APPS, (F.col("recipient") == "app_store") & (F.col("apps") == 0)), (10, C.NO_CONTEXT, bare), (11, "", None), (12, C.REPORTED, None), (14, "", None), (15, C.CLOSING, None))
    line = lambda df, section, at, text: df.select("campaign", "recipient", F.lit(section).alias("section"), at.cast("string").alias("at"), F.lit(0).alias("nth"), text.alias("line"))
    many = lambda df, section, texts: df.select("campaign", "recipient", F.lit(section).alias("section"), F.col("id").cast("string").alias("at"), F.posexplode(F.array_compact(texts)).alias("nth", "line"))
    linked = to.select("campaign", "recipient", "types").join(shared, "campaign")
    named = F.concat("type", F.lit(": "), "value")
    web = active.where((F.col("kind") == "web") & (F.col("domain") != "") & ~is_address(F.col("domain"))).select("campaign", "domain").distinct()
    own = active.select("campaign", "id", "kind", "url", "domain", F.col("label").alias("app"), "package", "version", "sha256", "certs", "origin_url", "excerpt", "points", F.col("first_seen").alias("seen"), "reasons", "screenshot")
    member = to.select("campaign", "recipient").join(own, "campaign")
    what = F.when(F.col("kind") == "app", F.concat(F.lit("Android app "), "app", F.lit(" ("), "package", F.lit(")"))).when(F.col("kind") == "message", F.concat(F.upper("domain"), F.lit(' lure "'), F.substring("excerpt", 1, 90), F.lit('"'))).otherwise(F.col("url"))
    risk = F.concat(F.lit("  - "), what, F.lit("  (risk "), F.format_number(F.col("points") / 100, 2), F.lit(", seen "), F.date_format("seen", "yyyy-MM-dd HH:mm"), F.lit(" UTC; "), F.when(F.coalesce("reasons", none) != "", F.substring("reasons", 1, 200)).otherwise("n/a"), F.lit(")"))
    head = F.concat(F.lit("  - "), "app", F.lit(" ("), "package", F.lit(", version "), F.when(F.coalesce("version", none) != "", F.col("version")).otherwise("unknown"), F.lit(")"))
    certs = F.transform(F.coalesce("certs", F.array().cast("array<string>")), lambda x: F.concat(F.lit("      signing certificate SHA-256: "), x))
    about = F.concat(F.array(head, F.concat(F.lit("      APK SHA-256: "), "sha256")), certs, F.array(F.when(F.col("origin_url") != "", F.concat(F.lit("      distributed from: "), "origin_url"))))
    out = to.select("campaign", "recipient", F.explode(fixed).alias("x")).select("campaign", "recipient", "x.section", none.alias("at"), F.lit(0).alias("nth"), "x.line")
    return (
        out.unionByName(line(linked, 5, named, F.concat(F.lit("  - shared "), named)))
        .unionByName(many(member.where("recipient = 'app_store' AND kind = 'app'"), 8, about))
        .unionByName(line(to.where(wants).select("campaign", "recipient").join(web, "campaign"), 8, F.col("domain"), F.concat(F.lit("  - domain: "), "domain")))
        .unionByName(line(member.where("recipient = 'safe_browsing' AND kind = 'web'"), 8, F.col("id"), F.concat(F.lit("  - "), "url")))
        .unionByName(line(linked.where(F.array_contains("types", F.col("type"))), 9, named, F.concat(F.lit("  - "), named)))
        .unionByName(many(member, 13, F.array(risk, F.when(F.col("screenshot") != "", F.concat(F.lit("      screenshot evidence: "), "screenshot")))))
    )


def rationale(recipient: Column, name: Column, contacts: Column) -> Column:
    """Why a plan has an item; a brand goes by the name that it is shown with."""
    shown = F.coalesce(F.create_map(*(F.lit(x) for key, title, *_ in C.BRANDS for x in (key, title)))[name], name)
    text = F.create_map(*(F.lit(x) for pair in C.RATIONALES.items() for x in pair))[recipient]
    more = F.when(F.size(contacts) == 0, F.create_map(*(F.lit(x) for pair in C.NO_CONTACT.items() for x in pair))[recipient])
    return F.concat(F.replace(text, F.lit("{}"), F.when(recipient == "bank", shown).otherwise(name)), F.coalesce(more, F.lit("")))


def dossier_lines(campaigns: DataFrame, assets: DataFrame, shared: DataFrame, plan: DataFrame, cases: DataFrame) -> DataFrame:
    """(campaign, section, at, line) of a campaign's dossier in Markdown, in order of section and at: its head, the entities that
    link it, a table of active assets, the riskiest first, with their three heaviest signals (signals: array of name and points),
    the items of its plan (casework.plan) and its cases (campaign, case_id, recipient, contact, status, updated_at)."""
    active = assets.where("campaign IS NOT NULL AND review <> 'false_positive'")
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    has = _known(campaigns, active, shared).join(cases.select("campaign").distinct().withColumn("_cases", F.lit(True)), "campaign", "left")
    count = F.concat(F.lit("- Assets: "), F.col("size").cast("string"), F.lit(" ("), F.col("sites").cast("string"), F.lit(" sites, "), F.col("apps").cast("string"), F.lit(" apps, "), F.col("messages").cast("string"), F.lit(" messages)"))
    seen = F.concat(F.lit("- First seen: "), minute("first_seen"), F.lit(" UTC; last seen "), minute("last_seen"), F.lit(" UTC"))
    fixed = _texts(
        (0, F.concat(F.lit("# "), "name"), None), (1, "", None), (2, F.concat(F.lit("- Campaign id: `"), F.col("campaign").cast("string"), F.lit("`")), None), (3, count, None), (4, seen, None), (5, "", None), (6, "## Linking evidence", None), (7, "", None), (8, "- none", F.size("linked") == 0),
        (9, "", None), (10, "## Assets", None), (11, "", None), (12, "| asset | kind | risk | verdict | review | top signals |", None), (13, "|---|---|---|---|---|---|", None), (15, "", None), (16, "## Takedown plan", None), (17, "", None), (19, "", None), (20, "## Takedown cases", None), (21, "", None), (22, "- none yet", F.col("_cases").isNull()),
    )
    line = lambda df, section, at, text: df.select("campaign", F.lit(section).alias("section"), at.cast("string").alias("at"), text.alias("line"))
    top = F.filter(F.slice(F.array_sort(F.transform("signals", lambda s: F.struct((-s["points"]).alias("w"), s["name"].alias("name")))), 1, 3), lambda s: s["w"] < 0)
    asset = F.when(F.col("kind") == "app", F.concat("label", F.lit(" ("), "package", F.lit(")"))).when(F.col("kind") == "message", F.replace(F.substring("excerpt", 1, 80), F.lit("|"), F.lit("/"))).otherwise(F.col("url"))
    row = F.concat(F.lit("| `"), asset, F.lit("` | "), "kind", F.lit(" | "), F.format_number(F.col("points") / 100, 2), F.lit(" | "), "verdict", F.lit(" | "), "review", F.lit(" | "), F.array_join(F.transform(top, lambda s: s["name"]), ", "), F.lit(" |"))
    rank = F.array_position(F.array(*map(F.lit, C.RATIONALES)), F.col("recipient"))
    contacts = F.when(F.size("contacts") > 0, F.array_join("contacts", ", ")).otherwise("lookup required")
    item = F.concat(F.lit("- **"), "recipient", F.lit("** via "), "channel", F.lit(" ("), contacts, F.lit("): "), rationale(F.col("recipient"), F.col("name"), F.col("contacts")), F.lit("; "), F.col("targets").cast("string"), F.lit(" target(s)"))
    case = F.concat(F.lit("- `"), F.col("case_id").cast("string"), F.lit("` "), "recipient", F.lit(" -> "), F.when(F.coalesce("contact", F.lit("")) != "", F.col("contact")).otherwise("n/a"), F.lit(": **"), "status", F.lit("**, updated "), minute("updated_at"), F.lit(" UTC"))
    ours = lambda df: df.join(campaigns.select("campaign"), "campaign", "left_semi")
    out = has.select("campaign", F.explode(fixed).alias("x")).select("campaign", "x.section", F.lit("").alias("at"), "x.line")
    return (
        out.unionByName(line(ours(shared), 8, F.concat("type", F.lit(": "), "value"), F.concat(F.lit("- "), "type", F.lit(": `"), "value", F.lit("`"))))
        .unionByName(line(ours(active), 14, F.concat(F.lpad((1000 - F.col("points")).cast("string"), 4, "0"), F.lit("-"), F.col("id").cast("string")), row))
        .unionByName(line(ours(plan), 18, F.concat(rank.cast("string"), F.lit("-"), "name"), item))
        .unionByName(line(ours(cases), 22, F.col("case_id"), case))
    )
