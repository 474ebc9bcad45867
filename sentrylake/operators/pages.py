"""Liveness, cloaking and behaviour of captured pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import markup as H
from sentrylake.functions.page import page_of
from sentrylake.functions.text import jaccard, visible_tokens
from sentrylake.functions.urls import _signal, host_of, registered_domain

HEAD = 20_000


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def _marked(html: Column, markers: list[str]) -> Column:
    """The first marker that stands in the title or in the head of the page, both in lower case; a page's head is what these
    notices fill, so no more is read."""
    low = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, HEAD))
    return F.get(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m) | F.contains(F.lower(title(html)), m)), F.lit(0))


def offline_reason(ok: Column, status: Column, html: Column) -> Column:
    """Why a page counts as gone, or null: no connection, a status that says so, or a platform's notice of few words."""
    marker = _marked(html, C.OFFLINE_MARKERS)
    few = F.size(visible_tokens(F.substring(html, 1, HEAD))) < 150
    return F.when(~F.coalesce(ok, F.lit(False)), "unreachable").when(status.isin(404, 410, 451) | (status >= 500), F.concat(F.lit("HTTP "), status.cast("string"))).when(marker.isNotNull() & few, F.concat(F.lit("platform error page: "), marker))


def challenge(html: Column) -> Column:
    return _marked(html, C.CHALLENGE_MARKERS)


def overlaps(pairs: DataFrame, key: str, victim: str, crawler: str) -> DataFrame:
    """key and overlap: the Jaccard index of the two views' visible words, where the victim sees 20 words or more."""
    out = pairs.select(key, visible_tokens(F.col(victim)).alias("a"), visible_tokens(F.col(crawler)).alias("b")).where(F.size("a") >= 20)
    return out.select(key, F.round(jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


def cloaking(victim: Column, crawler: Column) -> Column:
    """Signal of two captures (struct<ok, status, url, html>) of a page, as its victims and as crawlers see it: null where they
    agree or one is missing."""
    a, b = visible_tokens(victim["html"]), visible_tokens(crawler["html"])
    site = lambda view: registered_domain(host_of(view["url"]))
    other = (site(crawler) != "") & (site(victim) != "") & (site(victim) != site(crawler))
    refused = victim["status"].between(200, 399) & (crawler["status"] >= 400)
    found = other | refused | ((F.size(a) >= 20) & (jaccard(a, b) < 0.2))
    readable = F.coalesce(victim["ok"], F.lit(False)) & (F.coalesce(victim["html"], F.lit("")) != "")
    return F.when(readable & crawler.isNotNull(), F.coalesce(_signal("cloaking_suspected", 15, ~F.coalesce(crawler["ok"], F.lit(False))), _signal("cloaking_detected", 30, found)))


def _any(words: Column, texts: Column) -> Column:
    return F.exists(texts, lambda t: F.contains(t, words))


def sensitive_fields(page: Column) -> Column:
    """The words of the catalogue that name or type a field of a form, or stand in a prompt. page is a PAGE."""
    fields = F.transform(F.flatten(F.transform(page["forms"], lambda f: f["inputs"])), lambda i: F.concat(F.lower(i["name"]), F.lit(" "), i["type"]))
    prompts = F.transform(page["prompts"], lambda p: F.lower(p))
    words = F.array(*map(F.lit, C.SENSITIVE_FIELDS))
    return F.filter(words, lambda w: _any(w, fields) | _any(w, prompts) | _any(F.replace(w, F.lit("_"), F.lit(" ")), prompts))


def behaviour(pages: DataFrame, page: str | None = None) -> DataFrame:
    """pages (with url and html) and what their markup does: fields (sensitive words), foreign_form, obfuscated (labels), blob,
    apk_links and harvest (prompts for credentials). Null HTML has none of these. page is a column of html's PAGE, where it has
    been read before."""
    out = pages.withColumns({"_page": page_of(F.col("html")) if page is None else F.col(page), "_page_host": host_of(F.coalesce("url", F.lit("")))})
    actions = F.transform("_page.forms", lambda f: F.trim(f["action"]))
    out = out.withColumns({"_page_text": F.lower("_page.shown"), "_page_actions": actions})
    foreign = F.exists(F.transform("_page_actions", lambda a: F.when(a != "", H.host_in(a, F.col("_page_host"))).otherwise("")), lambda h: (h != "") & (F.col("_page_host") != "") & (h != F.col("_page_host")))
    obfuscated = F.array_compact(F.array(*(F.when(F.col("_page.scripts").rlike(p), label) for p, label in C.OBFUSCATION)))
    harvest = F.filter(F.array(*map(F.lit, C.HARVEST_PROMPTS)), lambda w: F.contains("_page_text", w))
    out = out.withColumns({"fields": sensitive_fields(F.col("_page")), "foreign_form": foreign, "obfuscated": obfuscated, "apk_links": H.apk_links(F.col("html"), F.col("url")), "harvest": harvest})
    return out.drop("_page", "_page_host", "_page_text", "_page_actions")


def behaviour_signals(impersonating: Column) -> Column:
    """Signals of behaviour()'s columns. What genuine pages do as well counts in full only where a page impersonates a brand or
    asks for credentials."""
    asks = F.size("fields") > 0
    full = F.coalesce(impersonating, F.lit(False)) | asks
    strong = F.arrays_overlap("fields", F.array(*map(F.lit, C.STRONG_FIELDS)))

    def either(name: str, within: int, without: int, when: Column) -> Column:
        return F.coalesce(_signal(name, within, when & full), _signal(name, without, when))

    return F.array_compact(
        F.array(
            either("credential_input_fields", 40, 40, strong & asks),
            _signal("credential_input_fields", 25, asks & ~strong),
            _signal("cross_domain_form_action", 30, F.col("foreign_form")),
            either("obfuscated_js", 25, 5, F.size("obfuscated") > 0),
            either("apk_download_offered", 20, 10, F.size("apk_links") > 0),
            either("credential_harvesting_text", 20, 10, F.size("harvest") > 0),
        )
    )
