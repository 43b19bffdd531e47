"""What fetched pages hold: titles, metadata, links, product data, images, product cards, as Column expressions.

Patterns stand for selectors; the two helpers that walk nested JSON are the
only ones in Python, as recursion has no built-in function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from .text import host

#: Named entities of HTML that texts use (fixed values); the ampersand comes last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "#34": '"', "nbsp": " ", "amp": "&"}


def unescape(c: Column) -> Column:
    """Text with its entities decoded, once."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def visible(html: Column) -> Column:
    """A page without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")


def title_source(html: Column) -> Column:
    """A page's title as it is written, entities and all."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def title(html: Column) -> Column:
    return F.trim(unescape(title_source(html)))


def language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html[^>]*\blang=[\"']([A-Za-z-]+)", 1)


def links(html: Column) -> Column:
    """The addresses of a page's visible anchors, in order, entities decoded."""
    return F.transform(F.regexp_extract_all(visible(html), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)), unescape)


def meta(html: Column, name: str) -> Column:
    """The content of the first meta element with this property, name or itemprop, either order of attributes; null if there is none."""
    key = rf"(?:property|name|itemprop)\s*=\s*[\"']{name}[\"']"
    content = r"content\s*=\s*[\"']([^\"']*)[\"']"
    one = F.regexp_extract(html, rf"(?is)<meta\b[^>]*{key}[^>]*{content}", 1)
    other = F.regexp_extract(html, rf"(?is)<meta\b[^>]*{content}[^>]*{key}", 1)
    found = F.when(one != "", one).otherwise(other)
    return F.when(found != "", unescape(found))


def _objects(value, out: list[str]) -> None:
    if isinstance(value, dict):
        out.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _objects(inner, out)


@pandas_udf(ArrayType(StringType()))
def json_objects(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every object of a list of JSON texts, at any depth, outer ones first; invalid texts give none."""

    def of(texts) -> list[str]:
        out: list[str] = []
        for text in texts if texts is not None else ():
            try:
                _objects(json.loads(text), out)
            except ValueError:
                continue
        return out

    for part in parts:
        yield part.map(of)


def _values(value, key: str, out: list[str]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            if k.lower() == key and isinstance(v, (str, int, float)) and not isinstance(v, bool):
                out.append(str(v))
            _values(v, key, out)
    elif isinstance(value, list):
        for v in value:
            _values(v, key, out)


@pandas_udf(ArrayType(StringType()))
def json_values(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """All plain values under a key (lower case) anywhere in a JSON text, in order; invalid texts give none."""

    def of(text, key) -> list[str]:
        out: list[str] = []
        try:
            _values(json.loads(text), key, out)
        except (TypeError, ValueError):
            return []
        return out

    for texts, keys in parts:
        yield pd.Series([of(t, k) for t, k in zip(texts, keys)])


def json_ld(html: Column) -> Column:
    """The objects of a page's application/ld+json scripts, at any depth, as JSON texts."""
    return json_objects(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)))


#: Parts of an address that mark what isn't a product's picture, segments that do, and hints that it is one (fixed values).
BLOCKED = (
    "logo", "icon", "sprite", "avatar", "badge", "payment", "banner", "placeholder", "favicon", "loader", "loading", "campaign", "coupon", "kupon", "cargo", "shipping", "delivery", "rating", "stars", "trust", "secure",
    "certificate", "seal", "footer", "header", "appstore", "googleplay", "qr-code", "qrcode", "social", "facebook", "instagram", "youtube", "tiktok", "flag", "country", "bank", "credit-card", "wallet", "receipt",
    "invoice", "fatura", "etiket", "watermark", "no-image", "noimage", "empty-image", "default-image", "blank-image", "pixel.gif", "tracking-pixel", "analytics", "advert", "reklam", "promo", "recommend", "widget",
    "cross-sell", "upsell", "marketing", "newsletter", "breadcrumb", "navigation", "user-content", "customer-image", "installment", "taksit", "warranty", "mobile-app", "landing-page",
)
HINTS = ("product", "gallery", "image", "media", "zoom", "large", "original", "detail", "pim", "catalog")
_DIMENSIONS = r"(?<![0-9])([0-9]{2,4})[xX]([0-9]{2,4})(?![0-9])"


def image_size(url: Column) -> Column:
    """width and height that an address names, in its path or as parameters; null if it names none."""
    path = [F.regexp_extract(url, _DIMENSIONS, i).try_cast("int") for i in (1, 2)]
    asked = [F.regexp_extract(url, rf"(?i)[?&](?:{names})=([0-9]+)", 1).try_cast("int") for names in ("width|w|wid", "height|h|hei")]
    w, h = (F.coalesce(p, F.when(path[0].isNull() & asked[0].isNotNull() & asked[1].isNotNull(), a)) for p, a in zip(path, asked))
    return F.struct(w.alias("width"), h.alias("height"))


def blocked_image(url: Column) -> Column:
    """Not a product's picture: by a word of its address, or smaller than 260, or narrower than .38 of its length."""
    size = image_size(url)
    low, high = F.least(size["width"], size["height"]), F.greatest(size["width"], size["height"])
    return F.lower(url).rlike("|".join(w.replace(".", r"\.") for w in BLOCKED)) | F.coalesce((low < 260) | (low / high < 0.38), F.lit(False))


def image_url(raw: Column, base: Column | None = None) -> Column:
    """A candidate's absolute address, null if it isn't a product's picture."""
    v = F.replace(F.replace(unescape(F.trim(raw)), F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/"))
    v = F.when(v.startswith("//"), F.concat(F.lit("https:"), v)).when(v.startswith("/") & F.lit(base is not None), F.concat(base if base is not None else F.lit(""), v)).otherwise(v)
    bare = F.lower(F.regexp_replace(v, r"[?#].*$", ""))
    picture = bare.rlike(r"\.(jpe?g|png|webp|avif)$") | F.lower(v).rlike("|".join(HINTS)) | F.lower(v).rlike("(width|height|quality|format|resize|imwidth)=")
    other = bare.rlike(r"\.(js|css|svg|woff2?|json|mp4|webm|gif)$")
    return F.when(v.rlike("^https?://") & picture & ~other & ~blocked_image(v), v)


def image_key(url: Column) -> Column:
    """What the copies of one picture share: the address without sizes and parameters."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    path = F.regexp_replace(path, "/(?:small|medium|large|thumbnail|thumb|zoom)/", "/")
    path = F.regexp_replace(path, r"[-_](?:[0-9]{2,4}x[0-9]{2,4}|[0-9]{2,4})\.(jpg|jpeg|png|webp|avif)$", ".$1")
    return F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1)), F.lit("://"), host(url), path)


def image_quality(url: Column, primary_key: Column | None = None) -> Column:
    """How good a copy is: 10,000 the page's main picture, 120 a hint, 80 a large form, up to 250 by area, 120 from 600 by 600, 20 an ending."""
    size, low = image_size(url), F.lower(url)
    area = F.least(F.floor(size["width"] * size["height"] / 20_000), F.lit(250))
    main = F.when(image_key(url) == primary_key, 10_000).otherwise(0) if primary_key is not None else F.lit(0)
    large = F.when((size["width"] >= 600) & (size["height"] >= 600), 120).otherwise(0)
    score = main + F.when(low.rlike("|".join(HINTS)), 120).otherwise(0) + F.when(low.rlike("zoom|large|original|quality=100|imwidth=1200"), 80).otherwise(0)
    return score + F.coalesce(area + large, F.lit(0)) + F.when(low.rlike(r"\.(jpe?g|png|webp|avif)($|[?#])"), 20).otherwise(0)


def image_candidates(html: Column) -> Column:
    """Addresses that may be pictures, in order: sources, lazy and zoom attributes, srcsets, and image values of JSON-LD."""
    sources = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*?\b(?:data-zoom-image|data-large-image|data-original|data-src|src)\s*=\s*[\"']([^\"']+)"), F.lit(1))
    sets = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)srcset\s*=\s*[\"']([^\"']+)"), F.lit(1)), lambda s: F.transform(F.split(s, ","), lambda p: F.substring_index(F.trim(p), " ", 1))))
    named = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)\"(?:image|images|gallery|media|contentUrl)\"\s*:\s*(\[[^\]]*\]|\"[^\"]*\")"), F.lit(1)), lambda v: F.regexp_extract_all(v, F.lit("\"([^\"]+)\""), F.lit(1))))
    return F.concat(sources, sets, named)


def gallery(c: Column) -> Column:
    """A stored gallery as a list: a JSON list, or addresses parted by lines, bars or semicolons."""
    text = F.trim(F.coalesce(c, F.lit("")))
    listed = F.from_json(text, "array<string>")
    parted = F.filter(F.transform(F.split(text, r"[\n\r|;]+|,(?=\s*https?://)"), lambda u: F.trim(u)), lambda u: u != "")
    return F.when(text.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(parted)


def card_rows(payload: Column) -> Column:
    """url, name, prices (texts), code of each product card of a JSON list."""
    return F.from_json(payload, "array<struct<url: string, name: string, price_candidates: array<string>, product_code: string>>")


def srcset(url: Column, widths: tuple[int, ...] = (320, 640, 960)) -> Column:
    """A picture in several widths, as pages write it."""
    mark = F.when(url.contains("?"), "&").otherwise("?")
    return F.array_join(F.array(*[F.concat(url, mark, F.lit(f"w={w} {w}w")) for w in widths]), ", ")


def money(c: Column) -> Column:
    """A price in Turkish writing with two decimals and the currency."""
    return F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(" TL"))
