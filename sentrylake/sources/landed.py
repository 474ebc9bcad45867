"""Answers of other services, landed as text, as tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.catalogue import EXTRA_SUFFIXES
from sentrylake.functions.urls import is_ip, registered_domain

ENTITY = "struct<roles:array<string>,vcardArray:array<string>,entities:array<struct<roles:array<string>,vcardArray:array<string>>>>"
RDAP = f"struct<events:array<struct<eventAction:string,eventDate:string>>,entities:array<{ENTITY}>>"


def _card(entity: Column, field: str) -> Column:
    """The first value that is set of a field of a contact card: an array of (name, parameters, type, value)."""
    rows = F.from_json(F.get(entity["vcardArray"], F.lit(1)), "array<array<string>>")
    value = F.get(F.filter(rows, lambda r: (F.get(r, F.lit(0)) == field) & (F.coalesce(F.get(r, F.lit(3)), F.lit("")) != "")), F.lit(0))
    return F.regexp_replace(F.get(value, F.lit(3)), "^tel:", "")


def _of_role(entities: Column, role: str) -> Column:
    return F.get(F.filter(entities, lambda e: F.coalesce(F.array_contains(e["roles"], role), F.lit(False))), F.lit(0))


def registrations(answers: DataFrame) -> DataFrame:
    """(domain, created, registrar, abuse_email, abuse_phone) of registration answers (domain, raw: JSON): the last valid date of
    registration, the first registrar and its contact for abuse. Anything else gives nulls."""
    out = answers.select("domain", F.from_json("raw", RDAP).alias("r"))
    dates = F.transform(F.filter("r.events", lambda e: (e["eventAction"] == "registration") & (F.coalesce(e["eventDate"], F.lit("")) != "")), lambda e: F.try_to_timestamp(e["eventDate"]))
    owner = _of_role(F.col("r.entities"), "registrar")
    out = out.withColumns({"created": F.when(F.size(dates) > 0, F.element_at(dates, -1)), "owner": owner}).withColumn("abuse", _of_role(F.col("owner.entities"), "abuse"))
    return out.select("domain", "created", _card(F.col("owner"), "fn").alias("registrar"), _card(F.col("abuse"), "email").alias("abuse_email"), _card(F.col("abuse"), "tel").alias("abuse_phone"))


def networks(answers: DataFrame) -> DataFrame:
    """(ip, asn, as_name, prefix, contacts) of landed answers about addresses (ip, network, overview, abuse: JSON); an address
    without a network has no asn."""
    net, over, abuse = F.from_json("network", "struct<data:struct<asns:array<string>,prefix:string>>"), F.from_json("overview", "struct<data:struct<holder:string>>"), F.from_json("abuse", "struct<data:struct<abuse_contacts:array<string>>>")
    out = answers.select("ip", net.alias("n"), over.alias("o"), abuse.alias("a"))
    asn = F.concat(F.lit("AS"), F.get("n.data.asns", F.lit(0)))
    return out.select("ip", asn.alias("asn"), F.when(asn.isNotNull(), F.col("o.data.holder")).alias("as_name"), F.when(asn.isNotNull(), F.col("n.data.prefix")).alias("prefix"), F.coalesce("a.data.abuse_contacts", F.array().cast("array<string>")).alias("contacts"))


LIBRARY = "brands map<string,struct<apps:array<struct<package:string,icon_phash:string,icon_dhash:string,cert_sha256:array<string>>>,favicon_md5:array<string>,favicon_phash:array<string>,screenshots:array<struct<phash:string,dhash:string,url:string,viewport:string>>>>"


def brand_library(spark: SparkSession, path: str) -> DataFrame:
    """(brand, kind, phash, dhash, md5) of a JSON library of the brands' pictures: kinds screenshot, icon and app."""
    own = spark.read.schema(LIBRARY).json(path, multiLine=True).select(F.explode("brands").alias("brand", "b"))
    none = F.lit(None).cast("string")
    row = lambda kind, phash, dhash, md5: F.struct(F.lit(kind).alias("kind"), phash.alias("phash"), dhash.alias("dhash"), md5.alias("md5"))
    rows = F.concat(
        F.coalesce(F.transform("b.screenshots", lambda s: row("screenshot", s["phash"], s["dhash"], none)), F.array()),
        F.coalesce(F.transform("b.favicon_phash", lambda p: row("icon", p, none, none)), F.array()),
        F.coalesce(F.transform("b.favicon_md5", lambda m: row("icon", none, none, m)), F.array()),
        F.coalesce(F.transform("b.apps", lambda a: row("app", a["icon_phash"], a["icon_dhash"], none)), F.array()),
    )
    return own.select("brand", F.explode(rows).alias("r")).select("brand", "r.*")


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a labelled CSV (with a header) whose target is known."""
    return spark.read.csv(path, header=True).where("target IS NULL OR target <> 'other'")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(stage, name, value) of a JSON file of figures by stage; a file without any gives no rows."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("stage", "raw"))
    return rows.select("stage", F.explode(F.from_json("raw", "map<string,double>")).alias("name", "value")).where("value IS NOT NULL")


def write_metrics(rates: DataFrame, path: str, key: str = "split") -> None:
    """One JSON line for each row of the rates, in order of the key."""
    rates.orderBy(key).coalesce(1).write.mode("overwrite").json(path)


def suffix_rules(lines: DataFrame) -> DataFrame:
    """(rule, kind: plain, wildcard or exception) of the lines (value) of a list of public suffixes; comments and blanks are none."""
    rule = F.lower(F.regexp_extract(F.trim("value"), r"^(\S+)", 1))
    kept = lines.select(rule.alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')")
    return kept.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("rule"), F.when(F.startswith("rule", F.lit("*.")), "wildcard").when(F.startswith("rule", F.lit("!")), "exception").otherwise("plain").alias("kind")).distinct()


#: Rules that every task may hold; public lists have some ten thousand.
MOST_RULES = 100_000


def registered_by(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Distinct hosts with suffix and registered, by the longest rule that fits: suffix null where no rule does, registered null for
    a bare suffix. An exception's own parent is the suffix. The rules go to all tasks if they're few enough, as a list of suffixes
    is; larger tables are joined by their key."""
    some = F.broadcast(rules) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else rules
    parts = hosts.select(F.col(host).alias("host")).where("host IS NOT NULL").distinct().withColumn("x", F.split(F.regexp_replace(F.lower("host"), r"\.+$", ""), r"\."))
    ends = parts.select("host", "x", F.explode(F.sequence(F.lit(1), F.size("x"))).alias("n")).withColumn("rule", F.array_join(F.slice("x", -F.col("n"), F.col("n")), "."))
    depth = F.when(F.col("kind") == "wildcard", F.col("n") + 1).when(F.col("kind") == "exception", F.col("n") - 1).otherwise(F.col("n"))
    hit = ends.join(some, "rule").withColumn("depth", depth).where("depth <= size(x)")
    best = hit.groupBy("host").agg(F.max_by("depth", F.struct((F.col("kind") == "exception").alias("e"), "depth")).alias("depth"))
    out = parts.join(best, "host", "left")
    return out.select("host", F.array_join(F.slice("x", -F.col("depth"), F.col("depth")), ".").alias("suffix"), F.when(F.size("x") > F.col("depth"), F.array_join(F.slice("x", -(F.col("depth") + 1), F.col("depth") + 1), ".")).alias("registered"))


def with_registered(df: DataFrame, rules: DataFrame, host: str = "host", into: str = "registered") -> DataFrame:
    """df with the registered name of each row's host under the rules (suffix_rules) and the suffixes of banks. Hosts that no rule
    fits, bare suffixes and addresses have what urls.registered_domain gives. Each host is looked up once, however many rows have
    it; a host that very many rows share is on the side that adaptive execution splits."""
    extra = df.sparkSession.createDataFrame([(s, "plain") for s in EXTRA_SUFFIXES], "rule string, kind string")
    known = registered_by(df, rules.select("rule", "kind").unionByName(extra).distinct(), host).select(F.col("host").alias("_known_host"), F.col("registered").alias("_known_name"))
    out = df.join(known, F.col(host) == F.col("_known_host"), "left")
    name = F.when(is_ip(F.coalesce(host, F.lit(""))), F.col(host)).otherwise(F.coalesce("_known_name", registered_domain(F.col(host))))
    return out.withColumn(into, name).drop("_known_host", "_known_name")
