"""Scores of app packages, from what unpacking them yields: one row of facts for each package."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import text as T
from sentrylake.functions.urls import _signal, first_of, flat_of, host_of, owner_of, registered_domain, skeleton, typosquat, verdict
from sentrylake.operators import visual as V

FACTS = "sha256 string, package string, label string, version string, permissions array<string>, cert_sha256 array<string>, icon struct<phash:string,dhash:string>, icon_md5 string, strings array<string>, has_launcher boolean"


def _some(x: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(x, F.array().cast(kind))


def text_brand(skel: Column) -> Column:
    """struct<brand, typo> of the first keyword that a name holds, or has within one edit; null without. skel is its skeleton."""
    plain = F.regexp_replace(skel, "[^a-z0-9]", "")
    named = first_of([(F.contains(plain, F.lit(k)), key) for k, key in C.KEYWORDS])
    squat = F.create_map(*[F.lit(x) for p in C.KEYWORDS for x in p])[typosquat(flat_of(skel))]
    return F.when(named.isNotNull(), F.struct(named.alias("brand"), F.lit(False).alias("typo"))).when(squat.isNotNull(), F.struct(squat.alias("brand"), F.lit(True).alias("typo")))


def _foreign(host: Column) -> Column:
    """Hosts that neither a development kit nor a brand owns."""
    own = registered_domain(host)
    kits = sorted({".".join(h.split(".")[-2:]) for h in C.PLATFORM_HOSTS})
    return (host != "") & F.contains(host, F.lit(".")) & ~own.isin(kits) & owner_of(own).isNull()


def indicators(strings: Column) -> Column:
    """struct of arrays hosts, upi_ids, phones, bots and telegram that the strings of an app hold, in their order, each once.
    How many are kept is bounded, as an app needs no more to be linked: 50, 20, 20, 10 and 10."""
    usable = F.filter(_some(strings), lambda s: F.length(s).between(4, 4000))
    blob = F.array_join(usable, "\n")
    bare = F.regexp_replace(blob, C.BOT_TOKEN, " ")
    numbers = F.filter(_some(strings), lambda s: s.rlike(C.PHONE_STRING) | ((F.length(s) < 300) & s.rlike(C.PHONE_CONTEXT)))
    hosts = F.filter(F.transform(T._all(blob, C.APP_URL), host_of), _foreign)
    return F.struct(
        F.slice(F.array_distinct(hosts), 1, 50).alias("hosts"),
        F.slice(T.upi_ids(bare), 1, 20).alias("upi_ids"),
        F.slice(T.phones(F.array_join(numbers, "\n")), 1, 20).alias("phones"),
        F.slice(F.array_distinct(T._all(blob, C.BOT_TOKEN, 1)), 1, 10).alias("bots"),
        F.slice(F.array_distinct(F.transform(T._all(blob, C.APP_TELEGRAM, 1), F.lower)), 1, 10).alias("telegram"),
    )


def permission_signals(permissions: Column) -> Column:
    """One signal for each name that the permissions give, with the points of the first permission that gives it."""
    names = list(dict.fromkeys(name for _, name, _ in C.RISKY_PERMISSIONS))
    points = {n: first_of([(F.array_contains(_some(permissions), p), w) for p, name, w in C.RISKY_PERMISSIONS if name == n]) for n in names}
    return F.array_compact(F.array(*(F.when(points[n].isNotNull(), F.struct(F.lit(n).alias("name"), points[n].alias("points"))) for n in names)))


def scored_apps(facts: DataFrame, refs: DataFrame | None = None, certs: DataFrame | None = None) -> DataFrame:
    """facts with brand, found (indicators), signals, icon_similarity (to the closest of the library, of apps with a brand), score
    (hundredths) and verdict.

    refs is a library of pictures, certs the known signing certificates (brand, cert) of official apps; both small, both optional.
    An app under an official package name is suspect only if its brand's certificates are known and it has none of them. An app
    without brand, or an official one, scores 60 at most. Null lists count as empty, null labels as no label.
    """
    spark = facts.sparkSession
    official = F.create_map(*[F.lit(x) for key, packages in C.PACKAGES.items() for p in packages for x in (p, key)])
    held = certs if certs is not None else spark.createDataFrame([], "brand string, cert string")
    known = F.broadcast(held.groupBy(F.col("brand").alias("_of")).agg(F.collect_set("cert").alias("_known")))  # a row for each brand
    pictures = V.packed(refs) if refs is not None else spark.range(1).select(F.array().cast("array<struct<brand:string,look:struct<phash:string,dhash:string>,md5:string>>").alias("app_refs"))
    out = facts.withColumns({"_official": official[F.col("package")], "_label": skeleton(F.lower(F.coalesce("label", F.lit("")))), "_package": skeleton(F.lower(F.coalesce("package", F.lit(""))))})
    out = out.join(known, out["_official"] == known["_of"], "left").crossJoin(F.broadcast(pictures.select("app_refs")))  # one row
    out = out.withColumns({"_named": F.coalesce(text_brand(F.col("_label")), text_brand(F.col("_package"))), "_icon": V.best_app_icon(F.col("icon")), "found": indicators(F.col("strings")), "_permits": permission_signals(F.col("permissions"))})
    free = F.col("_official").isNull()
    alike = free & (F.coalesce(-F.col("_icon.far"), F.lit(0.0)) >= C.APP_ICON)
    forged = ~free & (F.size(_some(F.col("_known"))) > 0) & ~F.arrays_overlap(_some(F.col("cert_sha256")), _some(F.col("_known")))
    has = lambda n: F.exists("_permits", lambda s: s["name"] == n)
    signals = F.array_compact(
        F.concat(
            F.array(_signal("repackaged_official_app", 70, forged), _signal("official_package_name", 0, ~free & ~forged), _signal("brand_impersonating_app", 45, free & F.col("_named").isNotNull()), _signal("app_icon_impersonation", 40, alike)),
            F.col("_permits"),
            F.array(
                _signal("banking_trojan_profile", 20, has("sms_interception") & (has("accessibility_abuse") | has("notification_access"))),
                _signal("hidden_launcher_icon", 10, ~F.coalesce("has_launcher", F.lit(True))),
                _signal("unsigned_apk", 10, F.size(_some(F.col("cert_sha256"))) == 0),
                _signal("telegram_bot_exfiltration", 25, F.size("found.bots") > 0),
                _signal("embedded_upi_handles", 10, F.size("found.upi_ids") > 0),
            ),
        )
    )
    out = out.withColumns({"brand": F.coalesce("_official", F.when(free, F.col("_named.brand")), F.when(alike, F.col("_icon.brand"))), "signals": signals})
    total = F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"])
    capped = F.when(F.col("brand").isNull() | F.exists("signals", lambda s: s["name"] == "official_package_name"), F.least(total, F.lit(60))).otherwise(total)
    close = F.coalesce(-F.col("_icon.far"), F.lit(0.0))
    out = out.withColumn("icon_similarity", F.when(F.col("brand").isNotNull() & (close > 0), F.round(close, 3)))
    out = out.withColumn("score", F.least(F.lit(100), capped)).withColumn("verdict", verdict(F.col("score")))
    return out.drop("_official", "_label", "_package", "_of", "_known", "app_refs", "_named", "_icon", "_permits")


def app_entities(apps: DataFrame, origin: str = "origin_url") -> DataFrame:
    """sha256, nth, type, value: what links an app of scored_apps to others, in order, each once."""
    of = lambda kind, values: F.transform(_some(values), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    host = host_of(F.coalesce(origin, F.lit("")))
    rows = F.concat(
        of("package_name", F.array("package")), of("apk_sha256", F.array("sha256")), of("signing_cert", F.col("cert_sha256")), of("favicon_hash", F.array("icon_md5")), of("domain", F.col("found.hosts")), of("upi_id", F.col("found.upi_ids")), of("phone", F.col("found.phones")),
        of("telegram", F.transform("found.bots", lambda b: F.concat(F.lit("bot:"), b))), of("telegram", F.col("found.telegram")), of("domain", F.array(F.when(host != "", host))),
    )
    return apps.select("sha256", F.posexplode(F.array_distinct(F.filter(rows, lambda e: e["value"].isNotNull()))).alias("nth", "e")).select("sha256", "nth", "e.*")


def app_candidates(scored: DataFrame, source: str = "user_report") -> DataFrame:
    """The asset that each app of scored_apps becomes: url by package and digest, domain (its package), kind, source, score, verdict,
    brand, visual_similarity and signals, with one of no points for an app that comes from outside the store. An app without
    package or digest has a null url."""
    url = F.concat(F.lit("android://"), "package", F.lit("?sha256="), F.substring("sha256", 1, 16))
    outside = _signal("sideloaded_distribution", 0, F.coalesce("origin_url", F.lit("")) != "")
    signals = F.array_compact(F.concat("signals", F.array(outside)))
    return scored.select("sha256", url.alias("url"), F.col("package").alias("domain"), F.lit("app").alias("kind"), F.lit(source).alias("source"), "score", "verdict", "brand", F.col("icon_similarity").alias("visual_similarity"), signals.alias("signals"))
