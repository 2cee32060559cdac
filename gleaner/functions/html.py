"""Article text from HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the header taken where a page has no article.
FALLBACK_ID = "mntl-external-basic-sublayout_1-0"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))


class _Article(HTMLParser):
    """The text inside the first element that ``wanted`` accepts; script, style, template and comments are left out."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.silent, self.done, self.tag, self.parts = wanted, 0, 0, False, "", []
        self.found = False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if self.depth:
            self.depth += tag == self.tag
            self.silent += tag in _SILENT
        elif self.wanted(tag, dict(attrs)):
            self.depth, self.tag, self.found = 1, tag, True

    def handle_endtag(self, tag):
        if self.done or not self.depth:
            return
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == self.tag:
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data):
        if self.depth and not self.silent and not self.done:
            self.parts.append(data)


def extract_article(html: str | None) -> str | None:
    """Text of the first ``<article>``, else of the fallback header; None where a page has neither; '' for no page."""
    if html is None:
        return ""
    for wanted in (lambda tag, attrs: tag == "article", lambda tag, attrs: tag == "header" and attrs.get("id") == FALLBACK_ID):
        parser = _Article(wanted)
        parser.feed(html)
        parser.close()
        if parser.found:
            return "".join(parser.parts)
    return None


@F.pandas_udf(T.StringType())
def article_text(html: pd.Series) -> pd.Series:
    return html.map(extract_article, na_action=None)


def article_text_sql(html: Column) -> Column:
    """The same by built-in functions, for pages whose articles hold plain markup and the five basic entities."""
    body = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    text = F.regexp_replace(F.regexp_replace(body, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1>", ""), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
