"""Indicators and digests of message text, and tokens of pages, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def urls(text: Column) -> Column:
    """URLs in the order of the text, each once, with a scheme, without closing punctuation."""
    cut = F.transform(_all(text, C.URL), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))
    return F.array_distinct(F.transform(cut, lambda u: F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("http://"), u))))


#: A host without a scheme, and what follows it, that isn't part of an address, a name or another host.
BARE = r"(?i)(?<![@\w.:/-])((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})(/[^\s<>\"']*)?(?![\w@-])"


def has_public_suffix(host: Column, suffixes: list[str] | None = None) -> Column:
    """Whether a lower-case host is a name under a public suffix, and not a bare one. suffixes is a list of them; without one, those of two
    letters (countries), their usual second levels, and common generic ones count."""
    if suffixes is not None:
        labels = F.split(host, r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.array_join(F.slice(labels, n + 1, F.size(labels)), "."))
        return (F.size(labels) > 1) & F.arrays_overlap(ends, F.array(*map(F.lit, suffixes))) & ~host.isin(suffixes)
    second = "|".join(C.CC_SECOND_LEVEL)
    known = F.substring_index(host, ".", -1).isin(*{*C.GENERIC_SUFFIXES, *C.SUSPICIOUS_TLDS}) | host.rlike(r"\.[a-z][a-z]$")
    return known & ~host.rlike(rf"^(?:{second})\.[a-z][a-z]$")


def bare_domains(text: Column, known: Column, suffixes: list[str] | None = None) -> Column:
    """URLs of hosts that stand in the text without a scheme, in order, the first of each host, if they have a public suffix; not file
    names, nor hosts of the known URLs. text has its URLs blanked out."""
    found = F.arrays_zip(F.transform(_all(text, BARE, 1), lambda h: F.lower(h)).alias("host"), _all(text, BARE, 2).alias("path"))
    seen = F.transform(known, lambda u: F.lower(F.regexp_extract(u, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    fresh = F.filter(found, lambda x: ~F.substring_index(x["host"], ".", -1).isin(C.FILE_ENDINGS) & ~F.array_contains(seen, x["host"]) & has_public_suffix(x["host"], suffixes))
    hosts = F.transform(fresh, lambda x: x["host"])
    first = F.filter(fresh, lambda x, i: F.array_position(hosts, x["host"]) == i + 1)
    return F.transform(first, lambda x: F.concat(F.lit("http://"), x["host"], F.regexp_replace(F.coalesce(x["path"], F.lit("")), r"[.,);]+$", "")))


def all_urls(text: Column, suffixes: list[str] | None = None) -> Column:
    """URLs with a scheme or www, then bare ones."""
    own = urls(text)
    return F.array_distinct(F.concat(own, bare_domains(F.regexp_replace(text, C.URL, " "), own, suffixes)))


def message_entities(text: Column) -> Column:
    """array<struct<type, value>> of the handles, numbers and accounts of a message, in this order."""
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    return F.concat(of("upi_id", upi_ids(text)), of("phone", phones(text)), of("telegram", telegram(text)))


def upi_ids(text: Column) -> Column:
    return F.array_distinct(_all(text, C.UPI))


def phones(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, C.PHONE), lambda p: F.right(F.regexp_replace(p, r"\D", ""), F.lit(10))))


def telegram(text: Column) -> Column:
    links = F.transform(_all(text, C.TELEGRAM_LINK, 1), lambda h: F.regexp_replace(h, "^@+", ""))
    return F.array_distinct(F.concat(links, _all(text, C.TELEGRAM_HANDLE, 1)))


def redact(text: Column, most: int = 500) -> Column:
    """Runs of 11 to 19 digits masked but for their last four, then cut to most characters. Longer runs are masked piece by
    piece, as the pattern finds them."""
    runs = r"\d{11,19}"
    gaps, hits = F.split(text, runs, -1), _all(text, runs)
    masked = F.transform(hits, lambda h: F.concat(F.repeat(F.lit("X"), F.length(h) - 4), F.right(h, F.lit(4))))
    joined = F.array_join(F.zip_with(gaps, masked, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))), "")
    return F.substring(joined, 1, most)


def message_digest(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def visible_tokens(html: Column) -> Column:
    """Distinct runs of three or more ASCII letters and digits outside tags, scripts and styles, in lower case."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]+>", " ")
    return F.array_distinct(_all(F.lower(bare), r"[a-z0-9]{3,}"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)
