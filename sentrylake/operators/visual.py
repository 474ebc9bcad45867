"""Which brand a page or an app looks like, and how much."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import similarity as S
from sentrylake.functions.page import page_of
from sentrylake.functions.urls import _signal

#: Rows of a reference library that go to every task. A library holds a few pictures of each monitored brand.
MOST_PICTURES = 10_000


def packed(refs: DataFrame) -> DataFrame:
    """One row of a library of pictures (brand, kind: screenshot, icon or app; phash, dhash, md5), as arrays by kind. A larger
    library than every task may hold is refused: it's a table of brands, which doesn't grow with the pages."""
    if refs.limit(MOST_PICTURES + 1).count() > MOST_PICTURES:
        raise ValueError(f"more than {MOST_PICTURES} pictures of brands")
    one = F.struct("brand", F.struct("phash", "dhash").alias("look"), "md5")
    return refs.agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, one))).alias(f"{k}_refs") for k in ("screenshot", "icon", "app")))


def _best(refs: Column, sim) -> Column:
    """struct<far, brand> of the most similar reference; ties go to the first brand by name."""
    return F.array_min(F.transform(refs, lambda r: F.struct((-sim(r)).alias("far"), r["brand"].alias("brand"))))


def best_screenshot(shot: Column, brand: Column | None = None) -> Column:
    own = F.col("screenshot_refs") if brand is None else F.filter("screenshot_refs", lambda r: r["brand"] == brand)
    return _best(own, lambda r: S.layout_similarity(shot, r["look"]))


def best_icon(icon: Column, brand: Column | None = None) -> Column:
    own = F.col("icon_refs") if brand is None else F.filter("icon_refs", lambda r: r["brand"] == brand)
    return _best(own, lambda r: S.hash_similarity(icon, r["look"]["phash"]))


def best_app_icon(look: Column) -> Column:
    return _best(F.col("app_refs"), lambda r: S.layout_similarity(look, r["look"]))


def _sim(best: Column) -> Column:
    return F.coalesce(-best["far"], F.lit(0.0))


def identified(shot: Column, icon: Column) -> Column:
    """The brand that a page looks like, whatever its URL, or null. An icon counts where it is closer than the screenshot."""
    by_shot, by_icon = best_screenshot(shot), best_icon(icon)
    icon_sim = F.when(_sim(by_icon) >= C.ICON_LOOK, _sim(by_icon)).otherwise(0.0)
    return F.when(F.greatest(_sim(by_shot), icon_sim) >= C.SCREENSHOT_MATCH, F.when(icon_sim > _sim(by_shot), by_icon["brand"]).otherwise(by_shot["brand"]))


def compared(pages: DataFrame, refs: DataFrame | None = None, page: str | None = None) -> DataFrame:
    """pages (html, brand, shot: struct<phash, dhash>, icon_phash, icon_md5) with visual, the similarity to the brand's own pages
    (null without brand or evidence), and visual_signals. Without a library only markup and text are compared. page is a column of html's
    PAGE, where it has been read before."""
    none = pages.sparkSession.sql("SELECT " + ", ".join(f"CAST(array() AS array<struct<brand:string,look:struct<phash:string,dhash:string>,md5:string>>) AS {k}_refs" for k in ("screenshot", "icon", "app")))
    out = pages.crossJoin(F.broadcast(none if refs is None else packed(refs)))  # one row
    out = out.withColumn("_page", page_of(F.col("html")) if page is None else F.col(page))
    out = out.withColumns({"_looks": S.looks_of(F.col("brand")), "_title": F.lower("_page.title"), "_text": F.lower("_page.body"), "_shot": _sim(best_screenshot(F.col("shot"), F.col("brand"))), "_icon": _sim(best_icon(F.col("icon_phash"), F.col("brand")))})
    same_icon = F.exists("icon_refs", lambda r: (r["brand"] == F.col("brand")) & (r["md5"] == F.col("icon_md5")))
    out = out.withColumns({"_same": F.coalesce(same_icon, F.lit(False)), "_markup": F.when(F.coalesce("html", F.lit("")) != "", S.structural_similarity(F.col("_title"), F.col("_text"), F.col("_looks")))})
    known = F.col("_looks").isNotNull()
    signals = F.array_compact(
        F.array(
            _signal("visual_screenshot_match", 45, known & (F.col("_shot") >= C.SCREENSHOT_MATCH)),
            _signal("visual_screenshot_resemblance", 25, known & F.col("_shot").between(C.SCREENSHOT_LIKE, C.SCREENSHOT_MATCH - 1e-12)),
            _signal("favicon_match", 40, known & F.col("_same")),
            _signal("favicon_visual_match", 35, known & ~F.col("_same") & (F.col("_icon") >= C.ICON_LOOK)),
            _signal("brand_title_match", 25, known & (F.coalesce("html", F.lit("")) != "") & (S.title_hits(F.col("_title"), F.col("_looks")) > 0)),
            _signal("visual_structural_similarity", 30, known & (F.col("_markup") >= 0.3)),
        )
    )
    best = F.greatest(F.when(F.col("_shot") > 0, F.col("_shot")), F.when(F.col("_same"), 1.0).when(F.col("_icon") >= C.ICON_LOOK, F.col("_icon")), F.col("_markup"))
    out = out.withColumns({"visual": F.when(known, F.round(best, 3)), "visual_signals": signals})
    return out.drop("_page", "_looks", "_title", "_text", "_shot", "_icon", "_same", "_markup", "screenshot_refs", "icon_refs", "app_refs")
