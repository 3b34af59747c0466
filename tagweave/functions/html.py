"""Columns over raw HTML and extracted page text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.constants import (
    BLOCKING_PHRASES,
    MAX_LOGO_CANDIDATES,
    MAX_LOGO_IMAGES,
    MAX_NOISE_RATIO,
    MAX_TEXT_CHARS,
    MIN_CONTENT_CHARS,
    MIN_LIGHT_CHARS,
    SHORT_LINE_CHARS,
)
from tagweave.functions.text import EDGE_BLANKS
from tagweave.functions.urls import resolve_url

# line breaks and blanks beyond ASCII count too
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# fixed values: patterns and elements that decide the text
TEMPLATE_MARK = r"\{\{[^}]+\}\}|\{%[^%]+%\}"
DROPPED_ELEMENTS = ("script", "style", "nav", "footer")
# fixed values: entities of HTML, the ampersand last
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&hellip;", "…"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&middot;", "·"), ("&bull;", "•"), ("&euro;", "€"), ("&amp;", "&"),
)
NUMERIC_ENTITY = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def all_tags(html: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(f"(?i){pattern}"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag, '' if missing. A longer name that
    merely ends in ``name`` (data-src, xlink:href) does not count."""
    return F.regexp_extract(tag, rf"""(?i)(?<![\w:-]){name}=["']([^"']*)["']""", 1)


def _first_resolved(refs: Column, base: Column | str) -> Column:
    """First of some references, absolute. The lambda names it, so the long
    expression behind it is evaluated once."""
    base = _c(base)
    return F.get(F.transform(F.slice(refs, 1, 1), lambda r: resolve_url(base, r)), F.lit(0))


def profile_link(html: Column | str, base: Column | str) -> Column:
    """First company-profile link on the page, absolute; null if none."""
    hrefs = F.transform(all_tags(html, "<a[^>]+>"), lambda t: attribute(t, "href"))
    hits = F.filter(hrefs, lambda h: F.lower(h).contains("linkedin.com/company/"))
    return _first_resolved(hits, base)


def _icon_links(html: Column | str) -> Column:
    links = F.transform(
        all_tags(html, "<link[^>]+>"),
        lambda t: F.struct(
            F.lower(attribute(t, "rel")).alias("rel"), attribute(t, "href").alias("href")
        ),
    )
    return F.filter(links, lambda x: x["rel"].contains("icon") & (x["href"] != ""))


def favicon_link(html: Column | str, base: Column | str) -> Column:
    """Touch icon if there is one, else the first icon link; null if none."""
    icons = _icon_links(html)
    touch = F.filter(icons, lambda x: x["rel"].contains("apple-touch-icon"))
    return _first_resolved(F.transform(F.concat(touch, icons), lambda x: x["href"]), base)


def logo_candidates(
    html: Column | str,
    base: Column | str,
    max_images: int = MAX_LOGO_IMAGES,
    max_candidates: int = MAX_LOGO_CANDIDATES,
) -> Column:
    """Array of {url, hint}: logo images, then icon links, then preview images;
    the first of each absolute URL."""
    base = _c(base)
    images = F.filter(
        all_tags(html, "<img[^>]+>"),
        lambda t: F.lower(t).contains("logo") & (attribute(t, "src") != ""),
    )
    images = F.transform(
        F.slice(images, 1, max_images),
        lambda t: F.struct(
            attribute(t, "src").alias("url"),
            F.concat(F.lit("img alt='"), attribute(t, "alt"), F.lit("'")).alias("hint"),
        ),
    )
    icons = F.transform(
        _icon_links(html), lambda x: F.struct(x["href"].alias("url"), x["rel"].alias("hint"))
    )
    previews = F.transform(
        F.filter(
            F.transform(
                all_tags(html, "<meta[^>]+og:image[^>]+>"), lambda t: attribute(t, "content")
            ),
            lambda u: u != "",
        ),
        lambda u: F.struct(u.alias("url"), F.lit("og:image").alias("hint")),
    )
    found = F.transform(
        F.concat(images, icons, previews),
        lambda x: F.struct(resolve_url(base, x["url"]).alias("url"), x["hint"].alias("hint")),
    )
    urls = F.transform(found, lambda x: x["url"])
    firsts = F.filter(found, lambda x, i: F.array_position(urls, x["url"]) == i + 1)
    return F.slice(firsts, 1, max_candidates)


def _with_characters(text: Column) -> Column:
    """Numeric entities as the characters they stand for; impossible ones stay."""
    found = F.regexp_extract_all(text, F.lit(NUMERIC_ENTITY), F.lit(0))

    def character(entity: Column) -> Column:
        number = F.regexp_extract(entity, r"&#[xX]?([0-9a-fA-F]+);", 1)
        hexadecimal = F.lower(entity).startswith("&#x")
        code = F.when(hexadecimal, F.conv(number, 16, 10)).otherwise(F.conv(number, 10, 10))
        code = code.cast("long")
        possible = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        bytes_ = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return F.when(possible, F.decode(bytes_, "UTF-32")).otherwise(entity)

    shown = F.array_join(
        F.zip_with(
            F.split(text, NUMERIC_ENTITY, -1),
            F.transform(found, character),
            lambda between, char: F.concat(between, F.coalesce(char, F.lit(""))),
        ),
        "",
    )
    return F.when(text.contains("&#"), shown).otherwise(text)


def page_text(html: Column | str) -> Column:
    """Visible text: boilerplate elements and comments dropped, tags become line
    breaks, numeric and common entities decoded, blank lines removed."""
    text = _c(html)
    for name in DROPPED_ELEMENTS:
        text = F.regexp_replace(text, rf"(?is)<{name}\b.*?</{name}\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "\n")
    text = _with_characters(text)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]*[\r\n]+\s*", "\n")
    return F.regexp_replace(text, EDGE_BLANKS, "")


def lines_of(text: Column | str) -> Column:
    """Stripped non-blank lines."""
    stripped = F.transform(
        F.split(_c(text), LINE_BREAK), lambda s: F.regexp_replace(s, EDGE_BLANKS, "")
    )
    return F.filter(stripped, lambda s: s != "")


def noise_ratio(lines: Column | str, short: int = SHORT_LINE_CHARS) -> Column:
    """Share of short lines among the non-blank ones; 0 when there are none."""
    lines = _c(lines)
    few = F.size(F.filter(lines, lambda s: F.length(s) < short))
    return F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(few.cast("double") / F.size(lines))


def blocking_phrase(text: Column | str, phrases: Iterable[str] = BLOCKING_PHRASES) -> Column:
    """First listed phrase the text contains; null if none."""
    lowered = F.lower(_c(text))
    return F.coalesce(*[F.when(lowered.contains(p), F.lit(p)) for p in phrases])


def with_text_facts(df: DataFrame, text: str) -> DataFrame:
    """Adds what the gates below need (lines, noise, phrase), each computed once: a
    projection of its own keeps the optimizer from repeating the text work."""
    lined = df.withColumn("lines", lines_of(text)).withColumn("phrase", blocking_phrase(text))
    return lined.withColumn("noise", noise_ratio("lines")).withColumn(
        "n_lines", F.size("lines")
    ).drop("lines")


def light_gate(text: Column | str) -> Column:
    """Why a light fetch is refused, or 'accepted'. Needs :func:`with_text_facts`."""
    text = F.coalesce(_c(text), F.lit(""))
    return (
        F.when(F.length(text) < MIN_LIGHT_CHARS, "too_short")
        .when(text.rlike(TEMPLATE_MARK), "template_syntax")
        .when(F.col("phrase").isNotNull(), "blocking_page")
        .when(F.col("noise") > MAX_NOISE_RATIO, "noise")
        .otherwise("accepted")
    )


def prefixed_text(text: Column | str, link: Column | str, limit: int = MAX_TEXT_CHARS) -> Column:
    """Text with the profile link in front, cut to the model's input size."""
    link = _c(link)
    full = F.when(
        link.isNotNull(), F.concat(F.lit("LinkedIn: "), link, F.lit("\n\n"), _c(text))
    ).otherwise(_c(text))
    return F.left(full, F.lit(limit))


def verdict_of(text: Column | str) -> Column:
    """Diagnosis label of a text. Needs :func:`with_text_facts`."""
    return (
        F.when(F.col("phrase").isNotNull(), "blocking_page")
        .when(F.length(_c(text)) < MIN_CONTENT_CHARS, "incomplete_content")
        .when(F.col("noise") > MAX_NOISE_RATIO, "content_drowned_in_noise")
        .otherwise("ok")
    )


def notes_on(verdict: Column | str, text: Column | str) -> Column:
    """What led to the diagnosis, in words. Needs :func:`with_text_facts`."""
    verdict, size = _c(verdict), F.length(_c(text))
    return (
        F.when(
            verdict == "blocking_page",
            F.format_string("matched trigger phrase: '%s' (length=%d)", F.col("phrase"), size),
        )
        .when(
            verdict == "incomplete_content",
            F.format_string(f"markdown length=%d < {MIN_CONTENT_CHARS}", size),
        )
        .when(
            verdict == "content_drowned_in_noise",
            F.format_string(
                "noise_ratio=%.2f over %d lines (length=%d)", F.col("noise"), F.col("n_lines"), size
            ),
        )
        .otherwise(F.format_string("length=%d", size))
    )
