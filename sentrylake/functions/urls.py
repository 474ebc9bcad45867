"""URL functions and lexical scoring, as column expressions."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from sentrylake.functions import catalogue as C

SIGNAL = "struct<name:string,points:int>"


def first_of(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first case that holds, in one flat expression."""
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(default)


def with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))


def _netloc(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), r"(?s)^[^:/?#]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_netloc(url), r"^.*@", ""), r":[^:\]]*$", ""))


def normalize_url(url: Column) -> Column:
    """The form by which URLs are the same: lower-case scheme and host, no default port, fragment or bare slash."""
    full = with_scheme(F.trim(F.coalesce(url, F.lit(""))))
    scheme = F.lower(F.regexp_extract(full, r"^([^:/?#]*)://", 1))
    host = F.regexp_replace(host_of(full), r"\.+$", "")
    port = F.regexp_extract(_netloc(full), r":([0-9]+)$", 1)
    usual = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
    path = F.regexp_extract(full, r"(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(full, r"(?s)^[^?#]*\?([^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, F.when((port != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "/", "").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_ip(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def registered_domain(host: Column) -> Column:
    """The last two labels, or three under a country's second level or a bank suffix; addresses stay whole."""
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", "")
    second = "|".join(C.CC_SECOND_LEVEL)
    extra = "|".join(s.replace(".", r"\.") for s in C.EXTRA_SUFFIXES)
    three = F.regexp_extract(h, rf"([^.]+\.(?:(?:{second})\.[^.][^.]|{extra}))$", 1)
    return F.when((h == "") | is_ip(h), h).when(three != "", three).otherwise(F.substring_index(h, ".", -2))


def owner_of(domain: Column) -> Column:
    """The brand that owns a registered domain, or null."""
    tld = F.substring_index(domain, ".", -1)
    top = [((tld == name) & F.contains(domain, F.lit(".")), key) for name, key in C.BRAND_TLDS.items()]
    return first_of(top + [(domain.isin([d for d, k in C.OFFICIAL if k == key]), key) for key, *_ in C.BRANDS])


@F.pandas_udf(StructType().add("decoded", ArrayType(StringType())).add("folded", ArrayType(StringType())))
def _labels(hosts: pd.Series) -> pd.DataFrame:
    """Labels of hosts that aren't plain: punycode as text (labels that aren't valid stay), and that without combining marks."""

    def text(x: str) -> str:
        try:
            return x.encode("ascii").decode("idna") if x.startswith("xn--") else x
        except (UnicodeError, ValueError):
            return x

    def folded(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))

    decoded = hosts.map(lambda h: None if h is None else [text(x) for x in h.split(".")])
    return pd.DataFrame({"decoded": decoded, "folded": decoded.map(lambda d: None if d is None else [folded(x) for x in d])})


def labels(host: Column) -> Column:
    """struct of two arrays, the host's labels decoded and without marks; null for a host that is plain ASCII. Python sees no
    others."""
    odd = host.rlike(r"[^\x00-\x7F]|(^|\.)xn--")
    return F.when(odd, _labels(F.when(odd, host)))


def decoded_labels(host: Column, odd: Column) -> Column:
    """odd is labels(host), which a query that needs several of these should hold as a column."""
    return F.coalesce(odd["decoded"], F.split(host, r"\."))


def skeleton_labels(host: Column, odd: Column) -> Column:
    return F.transform(F.coalesce(odd["folded"], F.split(F.lower(host), r"\.")), plain_look)


def plain_look(label: Column) -> Column:
    """Look-alikes and digits as letters, rn as m, vv as w."""
    plain = F.translate(F.translate(label, *C.CONFUSABLES), *C.DIGIT_LETTERS)
    return F.replace(F.replace(plain, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def skeleton(host: Column) -> Column:
    """Latin look of a host: decoded, without accents, look-alikes and digits as letters, rn as m, vv as w."""
    return F.array_join(skeleton_labels(host, labels(host)), ".")


def mixed_scripts(host: Column, odd: Column | None = None) -> Column:
    own = decoded_labels(host, labels(host) if odd is None else odd)
    return F.exists(own, lambda x: x.rlike(r"\p{IsLatin}") & x.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))


def is_shortener(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "").isin(C.SHORTENERS)


def hosting_platform(host: Column) -> Column:
    """The first platform suffix that the host is or ends in, or null."""
    ends = "|".join(s.replace(".", r"\.") for s in C.FREE_HOSTING)
    found = F.regexp_extract(F.lower(host), rf"(?:^|\.)({ends})$", 1)  # no suffix of the list ends in another one
    return F.when(found != "", found)


VOCABULARY = sorted({*C.CONTEXT_WORDS, *(k for k, _ in C.KEYWORDS)}, key=lambda w: (-len(w), w))


def segment_pattern(keyword: str) -> str:
    """A label in which the keyword stands among vocabulary words, with digits only at their ends."""
    words = "(?:" + "|".join(VOCABULARY) + ")*"
    side = f"[0-9]*{words}[0-9]*"
    return f"(?:^|[^a-z0-9]){side}{keyword}{side}(?:$|[^a-z0-9])"


def user_part(skel: Column) -> Column:
    """What the customer of a free hosting platform chose of a host; empty elsewhere."""
    ends = "|".join(s.replace(".", r"\.") for s in C.FREE_HOSTING)
    return F.regexp_extract(skel, rf"^(.*?)(?:^|\.)(?:{ends})$", 1)


def keyword_in(keyword: str, skel: Column, user: Column | None = None) -> Column:
    """Long keywords anywhere; short ones as words of a label, or at the start of a label on a free hosting platform. user is
    user_part(skel). Few hosts hold the letters of a short keyword at all, so the patterns run on those only."""
    held = F.contains(skel, F.lit(keyword))
    if len(keyword) >= 5:
        return held
    return held & (skel.rlike(segment_pattern(keyword)) | (user_part(skel) if user is None else user).rlike(f"(^|[^a-z0-9]){keyword}"))


def near_pattern(keyword: str) -> str:
    """What begins like the keyword and is one insertion, deletion (of seven letters or more), substitution or swap of
    neighbours away from it."""
    k, n = keyword, len(keyword)
    forms = [f"{k[1:i]}.{k[i + 1 :]}" for i in range(1, n)] + [f"{k[1:i]}.{k[i:]}" for i in range(1, n)]
    forms += [k[1:i] + k[i + 1 :] for i in range(1, n) if n >= 7] + [k[1:i] + k[i + 1] + k[i] + k[i + 2 :] for i in range(1, n - 1)]
    return f"{k[0]}(?:{'|'.join(dict.fromkeys(forms))})"


def flat_of(skel: Column) -> Column:
    """The host's letters and digits, with # for ordinary words that are near a keyword."""
    return F.regexp_replace(F.regexp_replace(F.lower(skel), "[^a-z0-9]", ""), "|".join(C.TYPO_ALLOWED), "#")


def typosquat(flat: Column) -> Column:
    """The first keyword that the host has within one edit but not itself, or null. flat is a column of flat_of."""
    return first_of([(~F.contains(flat, F.lit(k)) & flat.rlike(near_pattern(k)), k) for k, _ in C.KEYWORDS if len(k) >= 5])


def domain_in_path(url: Column) -> Column:
    """The first owned domain, by name, that stands in path or query, not as part of an address; or null."""
    rest = F.lower(F.regexp_extract(with_scheme(url), r"(?s)^[^:/?#]*://[^/?#]*([^#]*)", 1))
    names = sorted(d for d, _ in C.OFFICIAL)
    any_of = "|".join(re.escape(n) for n in names)
    hits = F.regexp_extract_all(rest, F.lit(rf"(?<![a-z0-9-])(?=({any_of})(?![a-z0-9-]))"), F.lit(1))
    return F.array_min(F.filter(hits, lambda n: ~F.contains(rest, F.concat(F.lit("@"), n))))


def verdict(points: Column) -> Column:
    return F.when(points >= 70, "malicious").when(points >= 40, "suspicious").otherwise("benign")


def _signal(name: str, points: int, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("name"), F.lit(points).alias("points")))


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def _of_keyword(keyword: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in C.KEYWORDS for x in p])[keyword]


def _of_domain(domain: Column) -> Column:
    """The brand of an owned domain that stands in a path."""
    top = F.substring_index(domain, ".", -1)
    return F.coalesce(F.when(top.isin(*C.BRAND_TLDS), top), F.create_map(*[F.lit(x) for p in dict(reversed(C.OFFICIAL)).items() for x in p])[domain])


def branded(df, url: str = "url"):
    """The rows of df whose URL has a brand by lexical()'s rules, with its host and brand, and none of the other columns.

    A filter on lexical()'s brand is pushed below its layers, which then hold each other's expressions many times. Here the rules for
    hosts run once for each distinct host, below an aggregate that no filter on their outcome passes; of a URL itself only the path
    is looked at.
    """
    rows = df.withColumn("host", host_of(F.coalesce(F.col(url), F.lit("")))).withColumn("in_path", domain_in_path(F.coalesce(F.col(url), F.lit(""))))
    ruled = _ruled(rows.select("host").distinct(), registered_domain(F.col("host")))
    known = F.coalesce(_of_keyword(F.col("keyword")), _of_keyword(F.col("squatted")))
    hosts = ruled.groupBy("host").agg(F.max(known).alias("known"), F.max(F.col("owner").isNull()).alias("foreign"))
    # a host has many URLs: none of the two sides goes to all tasks, whatever their files' size suggests
    out = rows.join(hosts.hint("merge"), "host").withColumn("brand", F.coalesce("known", F.when(F.col("foreign"), _of_domain(F.col("in_path")))))
    return out.where("brand IS NOT NULL").select(*[c for c in df.columns if c not in ("host", "brand")], "host", "brand")


def _ruled(df, registered: Column):
    """df with what the rules need of its column host, up to keyword and squatted. The one call of Python is made first; what follows is
    native and stands in layers, so that no layer repeats another's expressions."""
    out = df.withColumn("odd", labels(F.col("host")))
    out = out.withColumns({"registered": registered, "decoded": decoded_labels(F.col("host"), F.col("odd")), "looks": skeleton_labels(F.col("host"), F.col("odd"))})
    deep = F.greatest(F.size("looks") - F.size(F.split("registered", r"\.")), F.lit(0))
    within = F.endswith("host", F.col("registered"))
    own = F.slice("looks", F.lit(1), deep)
    rest = F.slice("looks", deep + 1, F.greatest(F.size("looks"), F.lit(1)))
    out = out.withColumns({"owner": owner_of(F.col("registered")), "platform": hosting_platform(F.col("host")), "skel": F.array_join("looks", "."), "skel_sub": F.when(within, F.array_join(own, ".")).otherwise(""), "skel_reg": F.array_join(rest, ".")})
    out = out.withColumns({f"user{x}": user_part(F.col(f"skel{x}")) for x in ("", "_sub", "_reg")})
    out = out.withColumn("keyword", F.when(F.col("owner").isNull(), first_of([(keyword_in(k, F.col("skel"), F.col("user")), k) for k, _ in C.KEYWORDS])))
    free = F.col("owner").isNull() & F.col("keyword").isNull()
    out = out.withColumn("flat_skel", F.when(free, flat_of(F.col("skel"))))
    out = out.withColumn("squatted", typosquat(F.col("flat_skel")))
    return out


def lexical(df, url: str = "url", registered: str | None = None):
    """df with host, registered, skel, owner, keyword, brand, signals (array of name and points), score (hundredths, 100 at
    most) and verdict of each URL. A null URL has an empty host and no brand. registered is a column that holds the host's
    registered name by a list of suffixes (landed.with_registered); without one a short list serves. Rows with a brand alone are
    had from branded().
    """
    text = F.coalesce(F.col(url), F.lit(""))
    out = _ruled(df.withColumn("host", host_of(text)), registered_domain(F.col("host")) if registered is None else F.coalesce(registered, F.lit("")))
    free = F.col("owner").isNull() & F.col("keyword").isNull()
    out = out.withColumn("in_path", F.when(free & F.col("squatted").isNull(), domain_in_path(text)))
    subdomain = first_of([(F.col("keyword") == k, keyword_in(k, F.col("skel_sub"), F.col("user_sub")) & ~keyword_in(k, F.col("skel_reg"), F.col("user_reg"))) for k, _ in C.KEYWORDS], False)
    # an owned domain as registered one has an owner, and so no keyword
    embedded = first_of([(F.col("keyword").isin([k for k, b in C.KEYWORDS if b == key]), F.col("host").rlike(rf"(^|\.)(?:{any_of(domains)})\.")) for key, _, _, domains, _ in C.BRANDS], False)
    name = F.array_join("decoded", ".")
    flat = F.concat(F.replace("host", F.lit("-"), F.lit("")), F.lit(" "), F.replace("skel", F.lit("-"), F.lit("")))
    has = F.col("keyword").isNotNull()
    signals = F.array_compact(
        F.array(
            _signal("brand_in_unofficial_domain", 50, has),
            _signal("homoglyph_obfuscation", 20, has & ~F.contains(name, F.col("keyword"))),
            _signal("brand_in_subdomain", 20, has & (F.col("skel_sub") != "") & subdomain),
            _signal("brand_with_banking_terms", 20, has & flat.rlike(any_of(C.BANKING_TERMS))),
            _signal("official_domain_in_subdomain", 20, has & embedded),
            _signal("typosquatting", 45, F.col("squatted").isNotNull()),
            _signal("idn_homograph", 30, mixed_scripts(F.col("host"), F.col("odd"))),
            _signal("url_shortener", 10, is_shortener(F.col("host"))),
            _signal("free_hosting_platform", 20, F.col("platform").isNotNull()),
            _signal("brand_in_url_path", 30, F.col("in_path").isNotNull()),
            _signal("suspicious_tld", 20, F.substring_index("host", ".", -1).isin(C.SUSPICIOUS_TLDS)),
            _signal("punycode", 20, F.col("host").rlike(r"(^|\.)xn--")),
            _signal("many_hyphens", 10, F.length(name) - F.length(F.replace(name, F.lit("-"), F.lit(""))) >= 2),
            _signal("lure_keywords", 20, F.lower(text).rlike(any_of(C.LURE_WORDS))),
            _signal("long_host", 5, F.length("host") > 40),
            _signal("ip_host", 30, is_ip(F.col("host"))),
        )
    )
    out = out.withColumns({"brand": F.coalesce(_of_keyword(F.col("keyword")), _of_keyword(F.col("squatted")), _of_domain(F.col("in_path"))), "signals": signals})
    out = out.withColumn("score", F.least(F.lit(100), F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"]))).withColumn("verdict", verdict(F.col("score")))
    return out.select(*[c for c in df.columns if c not in LEXICAL], *LEXICAL)


LEXICAL = ["host", "registered", "skel", "owner", "keyword", "brand", "signals", "score", "verdict"]
