"""Brand, category and model of a product out of its name, for records that lack them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import fold

#: Brands, words of categories and patterns of models, in the order in which they are tried (fixed values).
KNOWN_BRANDS = (
    "Apple", "Samsung", "Xiaomi", "Redmi", "Poco", "Huawei", "Honor", "Oppo", "Realme", "Vivo", "OnePlus", "Google", "Asus", "Acer", "Lenovo", "HP", "Dell", "MSI", "Monster", "Casper", "Sony", "LG", "Philips", "TCL", "Vestel",
    "Arçelik", "Beko", "Bosch", "Siemens", "Dyson", "JBL", "Anker", "Logitech", "Razer", "Corsair", "Kingston", "Sandisk", "Seagate", "WD", "Western Digital", "Intel", "AMD", "Nvidia", "Canon", "Nikon", "GoPro",
)
CATEGORY_WORDS = (
    ("Telefon", ("iphone", "galaxy s", "galaxy a", "telefon", "smartphone", "redmi note", "poco ", "pixel ")), ("Laptop", ("laptop", "notebook", "macbook", "thinkpad", "vivobook", "ideapad", "victus", "tuf gaming")),
    ("Tablet", ("tablet", "ipad", "galaxy tab", "matepad")), ("Televizyon", ("televizyon", "smart tv", "oled tv", "qled tv", "mini led tv")), ("Monitör", ("monitör", "monitor", "gaming monitor", "oyuncu monitörü")),
    ("Kulaklık", ("kulaklık", "earbuds", "headset", "airpods")), ("Akıllı Saat", ("akıllı saat", "smartwatch", "watch series", "galaxy watch")), ("Ekran Kartı", ("rtx ", "radeon rx", "ekran kartı", "graphics card")),
    ("İşlemci", ("işlemci", "processor", "ryzen ", "core i3", "core i5", "core i7", "core i9")), ("SSD", ("ssd", "nvme", "solid state")), ("Beyaz Eşya", ("çamaşır makinesi", "buzdolabı", "bulaşık makinesi", "kurutma makinesi")),
    ("Küçük Ev Aletleri", ("airfryer", "robot süpürge", "kahve makinesi", "blender", "ütü", "süpürge")), ("Fotoğraf Makinesi", ("fotoğraf makinesi", "mirrorless", "dslr", "aksiyon kamerası")),
)
MODELS = (
    r"\b(?:iphone\s+[0-9]{1,2}(?:\s+(?:pro|max|plus|mini)){0,2})\b", r"\b(?:galaxy\s+(?:s|a|m|z|note|tab)\s?[0-9]{1,3}(?:\s+(?:ultra|plus|fe))?)\b", r"\b(?:redmi\s+note\s+[0-9]{1,2}(?:\s+pro\+?)?)\b", r"\b(?:poco\s+[xfm][0-9]{1,2}(?:\s+pro)?)\b",
    r"\b(?:rtx\s*[0-9]{4}(?:\s*(?:ti|super))?)\b", r"\b(?:rx\s*[0-9]{4}(?:\s*xt)?)\b", r"\b(?:ryzen\s+[3579]\s+[0-9]{4,5}[a-z]{0,3})\b", r"\b(?:core\s+i[3579][\s-]*[0-9]{4,5}[a-z]{0,3})\b", r"\b[A-Z]{1,5}[- ]?[0-9]{2,6}[A-Z0-9-]*\b",
)


def _bare(word: str) -> str:
    """A fixed word as `undotted` writes it."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()


def undotted(c: Column) -> Column:
    """Folded, but a dotless i stays one."""
    kept = F.replace(F.coalesce(c, F.lit("")), F.lit("ı"), F.lit("\x01"))
    return F.replace(fold(kept), F.lit("\x01"), F.lit("ı"))


def clean_name(c: Column) -> Column:
    """One space between words, none before a mark, no space, dash, bar or comma at the ends."""
    spaced = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), F.lit(" -|,"))
    return F.regexp_replace(spaced, r"\s+([,.;:])", "$1")


def infer_brand(name: Column) -> Column:
    """The first known brand that stands in a name as a word, as it is written; null if none does."""
    return let(undotted(name), lambda t: F.coalesce(*[F.when(t.rlike(rf"(?<![a-z0-9])\Q{_bare(b)}\E(?![a-z0-9])"), F.lit(b)) for b in KNOWN_BRANDS]))


def infer_category(name: Column) -> Column:
    """The first category of which a word stands in a name; null if none does."""

    def of(t: Column) -> Column:
        has = lambda words: F.exists(F.array(*[F.lit(_bare(w)) for w in words]), lambda w: t.contains(w))
        return F.coalesce(*[F.when(has(words), F.lit(category)) for category, words in CATEGORY_WORDS])

    return let(undotted(name), of)


def infer_model(name: Column, brand: Column) -> Column:
    """The model by the first pattern that a cleaned name holds, without the brand in front; null if none does."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(name, f"(?i){p}", 0), F.lit("")) for p in MODELS])

    def without(m: Column) -> Column:
        named = (F.coalesce(brand, F.lit("")) != "") & undotted(m).startswith(undotted(brand))
        return F.when(named, clean_name(F.substring(m, F.length(brand) + 1, F.length(m)))).otherwise(m)

    return F.when(found.isNotNull(), let(clean_name(found), without))


def suggested_fix(name: Column, brand: Column, model: Column, category: Column) -> Column:
    """brand, model, category, name that a record lacks or should change; null where nothing is to be done."""
    lacks = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def fix(n: Column) -> Column:
        new_brand = F.when(lacks(brand), infer_brand(n))
        return let(
            F.struct(n.alias("n"), new_brand.alias("b")),
            lambda x: F.struct(
                x["b"].alias("brand"), F.when(lacks(model), infer_model(x["n"], F.when(lacks(brand), x["b"]).otherwise(F.trim(brand)))).alias("model"), F.when(lacks(category), infer_category(x["n"])).alias("category"),
                F.when((x["n"] != "") & ~x["n"].eqNullSafe(name), x["n"]).alias("name"),
            ),
        )

    return let(clean_name(name), fix)
