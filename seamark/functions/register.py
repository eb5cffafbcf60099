"""The engine's functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.functions import udfs


@F.pandas_udf(T.StringType())
def canonical_domain(urls: pd.Series) -> pd.Series:
    """The canonical domain of urls or hosts, international ones included."""
    return urls.map(udfs.canonical_host, na_action="ignore")


@F.udtf(returnType="ordinal int, kind string, value string")
class HtmlReferences:
    """Rows of a page's references: images, srcset lists, the first og:image, links."""

    def eval(self, html: str):
        for r in udfs.references(html)["refs"]:
            yield r["ordinal"], r["kind"], r["value"]


@F.udtf(returnType="place int, url string")
class SrcsetUrls:
    """Rows of the urls of a srcset attribute."""

    def eval(self, value: str):
        for i, part in enumerate(x.split()[0] for x in (value or "").split(",") if x.split()):
            yield i, part


def register(spark: SparkSession) -> None:
    """canonical_domain, absolute_url, image_header, perceptual_hashes, parsed_html as functions; html_references and srcset_urls as table functions."""
    for name, f in (("canonical_domain", canonical_domain), ("absolute_url", udfs.absolute), ("image_header", udfs.image_header), ("perceptual_hashes", udfs.perceptual_hashes), ("parsed_html", udfs.parsed_html)):
        spark.udf.register(name, f)
    spark.udtf.register("html_references", HtmlReferences)
    spark.udtf.register("srcset_urls", SrcsetUrls)



