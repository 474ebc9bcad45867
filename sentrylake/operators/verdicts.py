"""The whole verdict on a URL: its letters, what its page shows and does, who else sees what, and how old its domain is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import markup as H
from sentrylake.functions.page import page_of
from sentrylake.functions.urls import LEXICAL, _signal, host_of, lexical, owner_of, registered_domain, verdict
from sentrylake.operators import pages as P
from sentrylake.operators import visual as V
from sentrylake.operators.casework import age_signal
from sentrylake.sources.landed import with_registered

APK_TYPE = "application/vnd.android.package-archive"
#: A capture of a page. hops is the number of addresses that led to url; shot holds the hashes of the screenshot.
VIEW = "struct<ok:boolean,status:int,url:string,hops:int,content_type:string,html:string,shot:struct<phash:string,dhash:string>,icon_phash:string,icon_md5:string>"


def _prefixed(signals: Column, known: Column) -> Column:
    names = F.transform(known, lambda s: s["name"])
    return F.transform(F.filter(signals, lambda s: ~F.array_contains(names, s["name"])), lambda s: F.struct(F.concat(F.lit("landing_"), s["name"]).alias("name"), s["points"].alias("points")))


def judged(urls: DataFrame, refs: DataFrame | None = None, now: Column | None = None, rules: DataFrame | None = None) -> DataFrame:
    """urls (url; page, mobile and crawler: captures as VIEW or null; created: the domain's registration or null) with host, brand,
    visual, live, signals, score (hundredths), verdict, and stages (points of the URL alone, with its look, with all).

    Without a capture only the letters and the domain's age count. A page that is gone is noted and not looked at; one that the
    brand itself serves adds nothing. Of a mobile view only what the page itself lacks is added. refs is a library of pictures,
    rules a list of suffixes (landed.suffix_rules) by which the names of the URL and of where it leads are registered.
    """
    own = [c for c in urls.columns if c not in ("page", "mobile", "crawler", "created")]
    none = lambda kind: F.lit(None).cast(kind)
    out = urls
    for view in ("page", "mobile", "crawler"):
        out = out if view in urls.columns else out.withColumn(view, none(VIEW))
    out = out if "created" in urls.columns else out.withColumn("created", none("timestamp"))

    def letters(df: DataFrame, url: str) -> DataFrame:
        if rules is None:
            return lexical(df, url)
        held = with_registered(df.withColumn("_url_host", host_of(F.coalesce(url, F.lit("")))), rules, "_url_host", "_url_name")
        return lexical(held, url, "_url_name").drop("_url_host", "_url_name")

    out = letters(out, "url").withColumnsRenamed({c: f"_{c}" for c in LEXICAL})
    # a direct download is an app, not a page
    app = F.coalesce(F.col("page.content_type") == APK_TYPE, F.lit(False)) | H.is_apk_url(F.coalesce("url", F.lit("")))
    out = out.withColumns({"_apk": app, "page": F.when(~F.coalesce(F.col("page.content_type") == APK_TYPE, F.lit(False)), F.col("page"))})
    gone = F.when(F.col("page").isNotNull(), P.offline_reason(F.col("page.ok"), F.col("page.status"), F.col("page.html")))
    out = out.withColumn("_gone", gone).withColumns({"live": F.when(F.col("page").isNotNull(), F.col("_gone").isNull()), "_seen": F.when(F.col("_gone").isNull(), F.col("page"))})
    final = F.coalesce(F.when(F.col("_seen.url") != "", F.col("_seen.url")), F.col("url"))
    out = out.withColumn("_final", F.when(F.col("_seen").isNotNull(), final)).withColumn("_final_host", host_of(F.coalesce("_final", F.lit(""))))
    out = (out.withColumn("_site", registered_domain(F.col("_final_host"))) if rules is None else with_registered(out, rules, "_final_host", "_site")).drop("_final_host")
    out = out.withColumn("_ours", owner_of(F.col("_site")).isNotNull() & F.col("_seen").isNotNull())
    moved = F.col("_seen").isNotNull() & ~F.col("_ours") & (F.col("_site") != F.col("_registered")) & (F.col("_seen.hops") > 1)
    out = out.withColumn("_moved", F.coalesce(moved, F.lit(False))).withColumn("_landing", F.when(F.col("_moved"), F.col("_final")))
    out = letters(out, "_landing").withColumnsRenamed({"brand": "_land_brand", "signals": "_land_signals"}).drop("host", "registered", "skel", "owner", "keyword", "score", "verdict")
    look = F.when(F.col("_seen").isNotNull() & ~F.col("_ours"), F.col("_seen"))
    out = out.withColumn("_look", look)
    named = F.coalesce("_brand", F.when(F.col("_moved"), F.col("_land_brand")))
    seen = out.withColumns({"_named": named, "html": F.col("_look.html"), "shot": F.col("_look.shot"), "icon_phash": F.col("_look.icon_phash"), "icon_md5": F.col("_look.icon_md5")})
    if refs is not None:
        library = V.packed(refs)
        seen = seen.crossJoin(F.broadcast(library)).withColumn("_alike", F.when(F.col("_named").isNull() & F.col("_look").isNotNull(), V.identified(F.col("shot"), F.col("icon_phash")))).drop("screenshot_refs", "icon_refs", "app_refs")
    else:
        seen = seen.withColumn("_alike", none("string"))
    seen = seen.withColumn("_read", page_of(F.col("html")))
    seen = V.compared(seen.withColumn("brand", F.when(F.col("_look").isNotNull(), F.coalesce("_named", "_alike")).otherwise(F.col("_named"))), refs, "_read")
    seen = seen.withColumns({"visual": F.when(F.col("_look").isNotNull(), F.col("visual")), "visual_signals": F.when(F.col("_look").isNotNull(), F.col("visual_signals"))})

    def tells(df: DataFrame, view: str, into: str, page: str | None = None) -> DataFrame:
        held = df.withColumnsRenamed({"url": "_url", "html": "_html"}).withColumns({"url": F.coalesce(F.when(F.col(f"{view}.url") != "", F.col(f"{view}.url")), F.col("_url")), "html": F.col(f"{view}.html")})
        found = P.behaviour(held, page).withColumn(into, F.when(F.col(view).isNotNull(), P.behaviour_signals(F.col("brand").isNotNull())))
        return found.drop("url", "html", "fields", "foreign_form", "obfuscated", "apk_links", "harvest").withColumnsRenamed({"_url": "url", "_html": "html"})

    seen = tells(seen, "_look", "_does", "_read").withColumn("_phone", F.when(F.col("_look").isNotNull() & F.col("mobile.ok"), F.col("mobile")))
    seen = tells(seen, "_phone", "_does_phone")
    empty = F.array().cast("array<struct<name:string,points:int>>")
    some = lambda c: F.coalesce(c, empty)
    names = F.transform(some(F.col("_does")), lambda s: s["name"])
    does = F.concat(some(F.col("_does")), F.filter(some(F.col("_does_phone")), lambda s: ~F.array_contains(names, s["name"])))
    seen = seen.withColumn("_does", does).withColumn("_cloak", F.when(F.col("_look").isNotNull(), P.cloaking(F.coalesce("mobile", "_look"), F.col("crawler"))))
    phishing = F.col("brand").isNotNull() | F.exists("_does", lambda s: s["name"].isin("credential_input_fields", "cross_domain_form_action"))
    cloak = F.when(F.col("_cloak").isNotNull(), F.struct(F.col("_cloak.name").alias("name"), F.when(phishing, F.col("_cloak.points")).otherwise(0).alias("points")))
    age = F.when(F.col("_owner").isNull(), age_signal(F.col("created"), F.current_timestamp() if now is None else now))
    url_part = F.concat(F.col("_signals"), F.array_compact(F.array(_signal("apk_download", 20, F.col("_apk")))))
    look_part = F.array_compact(F.array(_signal("visual_brand_impersonation", 50, F.col("_alike").isNotNull())))
    page_part = F.array_compact(F.array(_signal("site_offline", 0, F.col("_gone").isNotNull()), _signal("official_brand_domain", 0, F.col("_ours")), _signal("cross_site_redirect", 10, F.col("_moved"))))
    landing = F.when(F.col("_moved"), _prefixed(F.col("_land_signals"), F.col("_signals"))).otherwise(empty)
    guarded = F.array_compact(F.array(_signal("bot_challenge", 5, F.col("_look").isNotNull() & P.challenge(F.col("_look.html")).isNotNull())))
    aged = F.array_compact(F.array(_signal("newly_registered_domain", 25, age == "newly_registered_domain"), _signal("recently_registered_domain", 10, age == "recently_registered_domain")))
    signals = F.concat(url_part, page_part, landing, guarded, look_part, some(F.col("visual_signals")), F.col("_does"), F.array_compact(F.array(cloak)), aged)
    total = lambda s: F.least(F.lit(100), F.aggregate(s, F.lit(0), lambda a, x: a + x["points"]))
    shown = F.concat(F.col("_signals"), F.when(F.col("_brand").isNotNull(), some(F.col("visual_signals"))).otherwise(empty))
    seen = seen.withColumn("signals", signals).withColumn("stages", F.struct(total(F.col("_signals")).alias("url"), total(shown).alias("url_visual"), total(F.col("signals")).alias("full")))
    return seen.select(*own, F.col("_host").alias("host"), "brand", "visual", "live", "signals", F.col("stages.full").alias("score"), verdict(F.col("stages.full")).alias("verdict"), "stages")


def infrastructure(hosts: DataFrame, addresses: DataFrame, networks: DataFrame, registrations: DataFrame) -> DataFrame:
    """hosts (host, registered) with ip, asn, as_name, prefix, shared_hosting, host_contacts, registrar, abuse_email, abuse_phone and
    created, from landed tables (host, ip), (ip, asn, as_name, prefix, contacts) and (domain, registrar, ...). The tables hold one
    row for each key."""
    net = networks.select("ip", "asn", "as_name", "prefix", F.col("contacts").alias("host_contacts"))
    reg = registrations.withColumnRenamed("domain", "registered")
    out = hosts.join(addresses.select("host", "ip"), "host", "left").join(net, "ip", "left").join(reg, "registered", "left")
    return out.withColumn("shared_hosting", F.coalesce(F.col("asn").isin(C.SHARED_NETWORKS), F.lit(False)))


def host_entities(facts: DataFrame) -> DataFrame:
    """(host, nth, type, value) of what infrastructure (with cert and analytics: array, where they're known) says about a host."""
    has = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string")
    ids = F.coalesce(F.col("analytics"), F.array().cast("array<string>")) if "analytics" in facts.columns else F.array().cast("array<string>")
    fixed = F.array(*(F.struct(F.lit(kind).alias("type"), has(c).alias("value")) for kind, c in (("ip", "ip"), ("asn", "asn"), ("cert_fingerprint", "cert"), ("registrar", "registrar"))))
    rows = F.concat(fixed, F.transform(ids, lambda v: F.struct(F.lit("analytics_id").alias("type"), v.alias("value"))))
    return facts.select("host", F.posexplode(F.filter(rows, lambda e: e["value"].isNotNull())).alias("nth", "e")).select("host", "nth", "e.*")
