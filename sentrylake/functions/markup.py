"""What addresses, ids and listings stand in HTML, by patterns over its characters; functions.page reads it as tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrylake.functions.text import _all


def _html(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def host_in(url: Column, page_host: Column) -> Column:
    """The host that an address in a page leads to: its own where it names one, otherwise the page's."""
    own = F.lower(F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(own != "", own).when(url.rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"), "").otherwise(page_host)


def absolute(url: Column, page: Column) -> Column:
    """An address of a page as a whole URL; dot segments stay as they are."""
    root = F.regexp_extract(page, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    below = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), url).when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(page, r"^([^:/?#]+:)", 1), url)).when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(below, url))


def external_scripts(sources: Column, page_host: Column) -> Column:
    """Those sources of scripts that name a host other than the page's."""
    return F.filter(sources, lambda s: s.rlike("^(//|http)") & ((page_host == "") | (host_in(s, page_host) != page_host)))


#: Named characters of HTML that titles and prompts use.
NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescaped(text: Column) -> Column:
    for name, char in NAMED:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def apk_links(html: Column, page: Column, most: int = 5) -> Column:
    """Whole URLs of app packages that the page links to, each once, the first few (a feature: one page is evidence enough)."""
    links = _all(_html(html), r"""(?i)href\s*=\s*["']([^"']+?\.apk(?:\?[^"']*)?)["']""", 1)
    return F.slice(F.array_distinct(F.transform(links, lambda u: absolute(u, page))), 1, most)


def is_apk_url(url: Column) -> Column:
    """Whether a URL's path, or its query, ends in .apk."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    return F.coalesce(full.rlike(r"(?i)^[^:/?#]+://[^/?#]*/[^?#]*\.apk(?:[?#]|$)") | full.rlike(r"(?i)^[^?#]*\?[^#]*\.apk(?:#|$)"), F.lit(False))


def analytics_ids(html: Column) -> Column:
    """Tracking ids in the order of the document, each once: UA- anywhere, G- and GTM- only within quotes, addresses or calls."""
    found = _all(_html(html), r"""\bUA-\d{4,}-\d+\b|(?:^|(?<=["'=:/(,]))(?:G-[A-Z0-9]{8,10}|GTM-[A-Z0-9]{6,7})(?=["'<&);\s]|$)""")
    return F.array_distinct(found)


def listing(html: Column) -> Column:
    """struct<title, developer, icon_url> of a store page, null where it has no title."""
    page = _html(html)
    meta = lambda name: F.regexp_extract(page, rf'<meta property="og:{name}" content="([^"]+)"', 1)
    some = lambda x: F.when(x != "", x)
    title = F.trim(F.regexp_replace(unescaped(meta("title")), " – Apps on Google Play$", ""))
    developer = F.regexp_extract(page, r'href="/store/apps/dev(?:eloper)?\?id=[^"]+"[^>]*><span>([^<]+)</span>', 1)
    return F.when(meta("title") != "", F.struct(title.alias("title"), some(F.trim(unescaped(developer))).alias("developer"), some(unescaped(meta("image"))).alias("icon_url")))


#: Titles of refusals and errors.
BLOCK_TITLES = ["sorry", "error", "access denied", "attention required", "just a moment", "request could not be satisfied", "forbidden", "not found"]


def is_block_page(title: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (low == "") | low.rlike("|".join(BLOCK_TITLES))
