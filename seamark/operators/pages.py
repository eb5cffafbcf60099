"""Pages to image urls and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions import exprs, udfs


def references(pages: DataFrame) -> DataFrame:
    """page_id, url, login, ordinal, kind, value, target (absolute) of every reference; srcset lists are split."""
    parsed = pages.select("page_id", "url", udfs.parsed_html("html").alias("p"))
    rows = parsed.select("page_id", "url", F.col("p.login").alias("login"), F.explode("p.refs").alias("r")).select("page_id", "url", "login", "r.*")
    each = rows.withColumn("value", F.explode(F.when(F.col("kind") == "srcset", exprs.srcset(F.col("value"))).otherwise(F.array("value"))))
    return each.withColumn("target", udfs.absolute("url", "value"))


def image_urls(refs: DataFrame) -> DataFrame:
    """Distinct accepted image urls of each page."""
    return refs.filter((F.col("kind") != "link") & exprs.image_url(F.col("target"))).select("page_id", "target").distinct()


#: A path with segments that a resolution would change, or white space and controls that it would strip.
DOTS = r"/\.{1,2}(?:[/?#]|$)|[\x00-\x20]"


def followed(target: Column, domain: Column) -> Column:
    """Whether an absolute link stays within the domain and does not end like a file."""
    path = F.regexp_extract(F.lower(target), r"^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return (exprs.netloc(target) == domain) & ~path.rlike(exprs.BINARY_ENDINGS)


def followed_links(refs: DataFrame) -> DataFrame:
    """Links within the page's domain that do not end like files; duplicates and fragments are kept."""
    return refs.filter((F.col("kind") == "link") & followed(F.col("target"), exprs.netloc(F.col("url")))).select("page_id", "ordinal", "target")


#: What happens to a page, in the order in which it is asked.
PAGE_OUTCOMES = ("blocked_domain", "not_html", "login_blocked", "parsed")


def outcomes(pages: DataFrame, blocked: DataFrame | None = None, block_on_login: bool = True) -> DataFrame:
    """page_id, outcome, images (distinct accepted urls), links (followed ones, repeats counted). Each page is parsed once.

    pages: page_id, url, html and, if there, text_response and content_type, which decide whether it is a page at all. Pages of
    blocked domains (a frame with `domain`), of other types and, if asked for, login pages yield nothing.
    """
    type_of = F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")
    is_text = F.col("text_response") if "text_response" in pages.columns else F.lit("content_type" not in pages.columns)
    rows = pages.select("page_id", "url", exprs.netloc(F.col("url")).alias("domain"), exprs.parseable(is_text, type_of, F.length("html")).alias("readable"), "html")
    if blocked is not None:
        rows = rows.join(blocked.select("domain", F.lit(True).alias("is_blocked")).distinct(), "domain", "left")
    else:
        rows = rows.withColumn("is_blocked", F.lit(False))
    read = rows.select("page_id", "url", "domain", "is_blocked", "readable", udfs.parsed_html(F.when(F.coalesce("is_blocked", F.lit(False)) | ~F.col("readable"), "").otherwise(F.col("html"))).alias("p"))
    outcome = F.when(F.coalesce("is_blocked", F.lit(False)), "blocked_domain").when(~F.col("readable"), "not_html").when(F.col("p.login") & F.lit(block_on_login), "login_blocked").otherwise("parsed")
    refs = read.select("page_id", "url", "domain", outcome.alias("outcome"), F.explode_outer("p.refs").alias("r")).withColumn("value", F.explode_outer(F.when(F.col("r.kind") == "srcset", exprs.srcset(F.col("r.value"))).otherwise(F.array("r.value"))))
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    # most references need no UDF: absolute ones, and those from the root without dots to resolve
    plain = F.when(F.col("value").rlike("^https?://[^/?#]+(?:[/?#]|$)") & ~F.col("value").rlike(DOTS), F.col("value")).when(F.col("value").rlike("^/(?!/)") & ~F.col("value").rlike(DOTS) & (root != ""), F.concat(root, F.col("value")))
    each = refs.select("page_id", "outcome", "domain", F.col("r.kind").alias("kind"), F.coalesce(plain, udfs.absolute("url", F.when(plain.isNull(), F.col("value")))).alias("target"))
    parsed = F.col("outcome") == "parsed"
    image = F.when(parsed & (F.col("kind") != "link") & exprs.image_url(F.col("target")), F.col("target"))
    link = parsed & (F.col("kind") == "link") & followed(F.col("target"), F.col("domain"))
    return each.groupBy("page_id").agg(F.first("outcome").alias("outcome"), F.count_distinct(image).alias("images"), F.count_if(F.coalesce(link, F.lit(False))).alias("links"))
