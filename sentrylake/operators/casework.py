"""Takedown plans, cases and what feeds them. Targets are rows, never lists, since one recipient may have most of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentrylake.functions import catalogue as C
from sentrylake.functions.urls import hosting_platform, registered_domain

REVIEWS, STATUSES, OPEN = ["unreviewed", "confirmed", "false_positive"], ["drafted", "sent", "acknowledged", "resolved", "rejected"], ["drafted", "sent", "acknowledged"]


def is_address(host: Column) -> Column:
    return host.rlike(r"^([\d.]+|\[?[0-9a-f:]+\]?)$")


def channel(contacts: Column) -> Column:
    return F.when(F.size(contacts) == 0, "lookup_required").when(F.forall(contacts, lambda c: F.contains(c, F.lit("@"))), "email").when(F.exists(contacts, lambda c: F.startswith(c, F.lit("http"))), "web_form").otherwise("phone")


def _rows(df: DataFrame, recipient: str, name: Column, contacts: Column, target: Column) -> DataFrame:
    return df.select("campaign", F.lit(recipient).alias("recipient"), name.alias("name"), contacts.cast("array<string>").alias("contacts"), target.alias("target"))


def _fixed(recipient: str) -> Column:
    return F.array(*map(F.lit, C.FIXED_CHANNELS[recipient]))


def _name(assets: DataFrame) -> Column:
    own = registered_domain(F.col("domain"))
    return F.coalesce("registered", own) if "registered" in assets.columns else own


def plan_targets(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (campaign, recipient, name, contacts, target): who to contact about what, for each campaign.

    assets: id, campaign, kind, review, domain, url, brand, registrar, registrar_contact, asn, as_name, host_contacts, package and
    sha256 (of apps); entities: id, type, value. False positives count for nothing, nor do assets without a campaign. Registrars
    get registered names, platforms or networks the URLs on them, brands the URLs that imitate them, the payment and telecom
    bodies the handles and numbers, the app store and the browser lists what is theirs, and the two authorities the campaign. Where
    assets have a column registered (landed.with_registered), it is the name that registrars get.
    """
    active = assets.where("campaign IS NOT NULL AND review <> 'false_positive'")
    web = active.where("kind = 'web'").withColumn("platform", hosting_platform(F.col("domain")))
    one = lambda c: F.array_compact(F.array(c))
    abuse = F.create_map(*[F.lit(x) for p in C.PLATFORM_ABUSE.items() for x in p])
    own = F.create_map(*[x for key, _, _, _, to in C.BRANDS for x in (F.lit(key), F.array(*map(F.lit, to)).cast("array<string>"))])
    used = entities.join(active.select("id", "campaign"), "id")
    network = F.trim(F.concat(F.col("asn"), F.lit(" "), F.coalesce("as_name", F.lit(""))))
    campaigns = active.select("campaign").distinct()
    parts = [
        _rows(web.where(F.col("platform").isNull() & ~is_address(F.col("domain"))), "registrar", F.coalesce("registrar", F.lit("unknown registrar")), one(F.col("registrar_contact")), _name(assets)),
        _rows(web.where("platform IS NOT NULL"), "hosting", F.col("platform"), one(abuse[F.col("platform")]), F.col("url")),
        _rows(web.where("platform IS NULL AND asn IS NOT NULL"), "hosting", network, F.coalesce("host_contacts", F.array().cast("array<string>")), F.col("url")),
        _rows(active.where("brand IS NOT NULL"), "bank", F.col("brand"), own[F.col("brand")], F.col("url")),
        _rows(used.where("type = 'upi_id'"), "npci", F.lit("npci"), _fixed("npci"), F.col("value")),
        _rows(used.where("type = 'phone'"), "telecom", F.lit("telecom"), _fixed("telecom"), F.col("value")),
        _rows(active.where("kind = 'app'"), "app_store", F.lit("app_store"), _fixed("app_store"), F.concat("package", F.lit(" ("), "sha256", F.lit(")"))),
        _rows(web, "safe_browsing", F.lit("safe_browsing"), _fixed("safe_browsing"), F.col("url")),
        *(_rows(campaigns, r, F.lit(r), _fixed(r), F.col("campaign").cast("string")) for r in ("cert_in", "cybercrime_portal")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def plan(targets: DataFrame) -> DataFrame:
    """One item for each campaign, recipient and name of plan_targets: contacts (of which there are few), channel and the number
    of targets."""
    each = targets.select("campaign", "recipient", "name", "target", F.explode_outer("contacts").alias("contact"))
    few = each.select("campaign", "recipient", "name", "contact").distinct().groupBy("campaign", "recipient", "name").agg(F.array_sort(F.collect_set("contact")).alias("contacts"))
    n = targets.groupBy("campaign", "recipient", "name").agg(F.count_distinct("target").alias("targets"))
    return few.join(n, ["campaign", "recipient", "name"]).withColumn("channel", channel(F.col("contacts")))


def case_targets(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (campaign, recipient, target) of a whole case, whichever item of a plan it comes from: registered names of all web
    assets for registrars, handles for npci, numbers for telecom, the URLs of apps for the store, and for everyone else the URLs
    of what isn't a message."""
    active = assets.where("campaign IS NOT NULL AND review <> 'false_positive'")
    used = entities.join(active.select("id", "campaign"), "id")
    of = lambda df, to, target: df.select("campaign", F.lit(to).alias("to"), target.alias("target"))
    out = of(active.where((F.col("kind") == "web") & ~is_address(F.col("domain"))), "registrar", _name(assets))
    for recipient, kind in (("npci", "upi_id"), ("telecom", "phone")):
        out = out.unionByName(of(used.where(F.col("type") == kind), recipient, F.col("value")))
    out = out.unionByName(of(active.where("kind = 'app'"), "app_store", F.col("url"))).unionByName(of(active.where("kind <> 'message'"), "others", F.col("url")))
    others = F.array(*(F.lit(r) for r in C.INTROS if r not in ("registrar", "npci", "telecom", "app_store")))
    return out.distinct().select("campaign", F.explode(F.when(F.col("to") == "others", others).otherwise(F.array("to"))).alias("recipient"), "target")


#: Cases and targets of a block, about; what a recipient of one campaign has of both is dealt in pairs of blocks.
BLOCK = 1000


def _sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))


def _blocks(rows: DataFrame, sizes: DataFrame, by: list[str], column: str, nth: str) -> DataFrame:
    """by, nth, and the values of column of each block, about BLOCK of them, in which the rows of each key of sizes are packed."""
    dealt = rows.join(sizes, by).withColumn(nth, F.pmod(F.xxhash64(column), F.col("_blocks")))
    return dealt.groupBy(*by, nth).agg(F.collect_list(column).alias(f"{column}s"))


def _all_of(cases: DataFrame, whole: DataFrame) -> DataFrame:
    """(case_id, target): each of cases (case_id, campaign, recipient) with all targets of its campaign and recipient. Blocks of cases
    meet blocks of targets that some case asks for, and these pairs, not the rows that they stand for, are dealt to the tasks; the
    rows are made last, those of a target at a time."""
    by = ["campaign", "recipient"]
    asked = _sizes(cases, by)
    targets = _blocks(whole, _sizes(whole, by).join(asked, by, "left_semi"), by, "target", "n")
    pairs = _blocks(cases, asked, by, "case_id", "m").join(targets, by)
    parts = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # generated code holds copies of all that it makes of a row, with both explodes in it a whole pair's; transform isn't generated
    each = pairs.repartition(parts, *by, "m", "n").select(F.explode(F.transform("targets", lambda t: t)).alias("target"), "case_ids")
    return each.select(F.explode("case_ids").alias("case_id"), "target")


def opened(requests: DataFrame, whole: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases and their targets, of requests (case_id, campaign, recipient, contact, wanted: array of targets or null).

    Without wanted a case has all case_targets of its recipient. With it, those of them that are wanted, or all that is wanted
    where none of them is. A contact that isn't given is the first one, by name and order, of the plan's items of that recipient
    that have any of the wanted targets, or of all its items. First result: requests with contact; second: (case_id, target).
    whole is as case_targets gives it, each row once. The targets of a case of one request are distinct as they are made; only where
    requests share an id are they compared, so the many rows of cases without wanted aren't shuffled.
    """
    whole = whole.where("target IS NOT NULL")  # as its join with narrow has it, so all uses are one plan that is run once
    narrow = requests.select("case_id", "campaign", "recipient", F.explode("wanted").alias("target"))
    free_of = requests.withColumn("_same", F.count("*").over(Window.partitionBy("case_id"))).where("wanted IS NULL OR size(wanted) = 0").select("case_id", "campaign", "recipient", "_same")
    alone = _all_of(free_of.where("_same = 1").drop("_same"), whole)
    full = _all_of(free_of.where("_same > 1").drop("_same").distinct(), whole)
    known = narrow.join(whole.withColumn("_known", F.lit(True)), ["campaign", "recipient", "target"], "left").withColumn("_any", F.max("_known").over(Window.partitionBy("case_id")))
    some = known.where("_known OR _any IS NULL").select("case_id", "target")
    items = targets.select("campaign", "recipient", "name", "target", F.get("contacts", F.lit(0)).alias("first")).where("first IS NOT NULL")
    asked = narrow.join(items, ["campaign", "recipient", "target"]).select("case_id", "name", "first")
    free = requests.where("wanted IS NULL OR size(wanted) = 0").select("case_id", "campaign", "recipient").join(items.select("campaign", "recipient", "name", "first").distinct(), ["campaign", "recipient"]).select("case_id", "name", "first")
    contact = asked.unionByName(free).groupBy("case_id").agg(F.min(F.struct("name", "first")).alias("x")).select("case_id", F.col("x.first").alias("found"))
    cases = requests.join(contact, "case_id", "left").withColumn("contact", F.coalesce("contact", "found")).drop("found", "wanted")
    return cases, alone.unionByName(full.unionByName(some).distinct())


def in_scope(members: DataFrame, targets: DataFrame) -> DataFrame:
    """(case_id, id) of the assets that a case is about. members: case_id, id, and keys, the strings that name an asset; targets:
    case_id, target. All members of a case count where none of them has any of its targets."""
    each = members.select("case_id", "id", F.explode("keys").alias("target"))
    hit = each.join(targets, ["case_id", "target"], "left_semi").select("case_id", "id").distinct()
    lost = members.select("case_id", "id").join(hit.select("case_id").distinct(), "case_id", "left_anti")
    return hit.unionByName(lost)


def status_of(cases: DataFrame, events: DataFrame) -> DataFrame:
    """cases (case_id, created_at) with what their events (case_id, at, seq, status, note) make of them: status (drafted without
    any), updated_at, sent_at (the first time sent), resolved_at (the last time resolved or rejected) and notes, one line an event
    that has a note. Events count in the order of at and seq; unknown cases' events are ignored. A case has few events."""
    order = F.struct("at", "seq")
    line = F.concat(F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit(" UTC ["), "status", F.lit("] "), "note")
    kept = events.groupBy("case_id").agg(
        F.max_by("status", order).alias("_status"), F.max("at").alias("_at"), F.min(F.when(F.col("status") == "sent", F.col("at"))).alias("sent_at"), F.max(F.when(F.col("status").isin("resolved", "rejected"), F.col("at"))).alias("resolved_at"),
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("note", F.lit("")) != "", F.struct("at", "seq", line.alias("line"))))), lambda x: x["line"]).alias("notes"),
    )
    out = cases.join(kept, "case_id", "left")
    return out.withColumns({"status": F.coalesce("_status", F.lit("drafted")), "updated_at": F.coalesce("_at", "created_at"), "notes": F.coalesce("notes", F.array().cast("array<string>"))}).drop("_status", "_at")


def check_url(target: Column) -> Column:
    """Where to look for a target: with a scheme; null for apps and for what has no dot."""
    return F.when(~F.startswith(target, F.lit("android://")) & F.contains(target, F.lit(".")), F.when(F.contains(target, F.lit("://")), target).otherwise(F.concat(F.lit("http://"), target, F.lit("/"))))


def rechecked(checks: DataFrame) -> DataFrame:
    """case_id, checks and resolves: whether all of a case's targets are gone."""
    return checks.groupBy("case_id").agg(F.count("*").alias("checks"), F.bool_and(~F.col("live")).alias("resolves"))


def resolving(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """Events that resolve the cases (case_id, status) that were sent or acknowledged and none of whose checks (case_id, at, live)
    of the latest round found a target alive."""
    last = checks.groupBy("case_id").agg(F.max("at").alias("at"))
    gone = rechecked(checks.join(last, ["case_id", "at"])).where("resolves").join(last, "case_id")
    due = cases.where(F.col("status").isin("sent", "acknowledged")).select("case_id")
    return gone.join(due, "case_id", "left_semi").select("case_id", "at", F.lit("resolved").alias("status"), F.lit("All targets offline on re-check").alias("note"))


def live_at_last(checks: DataFrame) -> DataFrame:
    """case_id, at (of the latest round of checks) and live, how many targets it found alive."""
    return checks.groupBy("case_id", "at").agg(F.count_if("live").alias("live")).groupBy("case_id").agg(F.max_by("live", "at").alias("live"), F.max("at").alias("at"))


def reviewed(assets: DataFrame, reviews: DataFrame) -> DataFrame:
    """assets with review, review_note, reviewed_by and reviewed_at by the latest of the reviews (id, at, seq, review, note, by); no
    review leaves an asset unreviewed. Reviews outlive new sightings, since they are rows of their own."""
    last = reviews.groupBy("id").agg(F.max_by(F.struct("review", "note", "by", "at"), F.struct("at", "seq")).alias("r"))
    out = assets.drop("review", "review_note", "reviewed_by", "reviewed_at").join(last, "id", "left")
    return out.withColumns({"review": F.coalesce("r.review", F.lit("unreviewed")), "review_note": F.col("r.note"), "reviewed_by": F.col("r.by"), "reviewed_at": F.col("r.at")}).drop("r")


def audit(events: DataFrame, action: str, target: str, *detail: str) -> DataFrame:
    """Rows (at, actor, action, target, detail: JSON) of the log that events with at and actor leave; it's only appended to."""
    return events.select("at", "actor", F.lit(action).alias("action"), F.col(target).cast("string").alias("target"), F.to_json(F.struct(*detail)).alias("detail"))


def age_signal(created: Column, now: Column) -> Column:
    """Of whole days since registration; none for the future."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    days = F.floor(micros / 86400e6)
    return F.when(days < 0, None).when(days <= 30, "newly_registered_domain").when(days <= 180, "recently_registered_domain")


def first_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, by an order that decides; one row a group is kept before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").select(*by, *rest)
