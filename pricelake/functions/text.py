"""Text and URL functions as Column expressions, all inside Catalyst.

Several folds exist side by side on purpose: search, identities, sellers and
similarity each have their own rules, and their results differ.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters and their plain forms (fixed values).
TURKISH_FROM, TURKISH_TO = "çğıöşü", "cgiosu"
#: Title words that say nothing about the product (fixed values).
TITLE_NOISE = (
    "kampanya", "indirim", "indirimli", "firsat", "firsati", "stoktan", "hizli", "kargo", "ucretsiz", "resmi", "garantili",
    "garanti", "turkiye", "distributoru", "distributor", "yetkili", "satici", "magaza", "orijinal",
)
#: Names of stores and their codes (fixed values); domain endings are dropped before the lookup.
STORE_CODES = {
    "turkcell pasaj": "turkcellpasaj", "turkcell": "turkcellpasaj", "pttavm": "pttavm", "ptt avm": "pttavm", "beymen": "beymen",
    "trendyol": "trendyol", "hepsiburada": "hepsiburada", "hepsi burada": "hepsiburada", "n11": "n11", "pazarama": "pazarama",
    "amazon": "amazon", "ciceksepeti": "ciceksepeti", "cicek sepeti": "ciceksepeti",
}
#: Store domains and their codes (fixed values).
STORE_DOMAINS = {
    "trendyol.com": "trendyol", "hepsiburada.com": "hepsiburada", "amazon.com.tr": "amazon", "n11.com": "n11", "mediamarkt.com.tr": "mediamarkt",
    "teknosa.com": "teknosa", "vatanbilgisayar.com": "vatan", "pazarama.com": "pazarama", "idefix.com": "idefix", "pttavm.com": "pttavm", "beymen.com": "beymen",
}


def _latin() -> tuple[str, str]:
    """Letters of the Latin blocks that compatibility decomposition makes one plain letter of, lower case, and those letters."""
    pairs = {"ı": "i"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(plain) == 1 and plain.isascii() and plain.isalpha():
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _latin()


def fold(c: Column) -> Column:
    """Lower case without accents, whether composed or combining."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), FOLD_FROM, FOLD_TO)


def _spaced(c: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(c, f"[^{keep}]+", " "))


def normalize_text(c: Column) -> Column:
    """Folded; everything that isn't a letter or digit becomes one space. Null: empty."""
    return _spaced(fold(F.coalesce(c, F.lit(""))), "a-z0-9")


def normalize_product_name(c: Column) -> Column:
    """`normalize_text` without the words that only advertise."""
    words = F.filter(F.split(normalize_text(c), " "), lambda w: ~w.isin(*TITLE_NOISE))
    return F.array_join(words, " ")


def normalize_query(c: Column) -> Column:
    """For search queries: folded, keeps plus, point and slash."""
    return _spaced(fold(F.coalesce(c, F.lit(""))), "a-z0-9+./")


def normalize_token(c: Column) -> Column:
    """For identities: folded, a capacity joined with its unit, keeps point, underscore, slash, plus and minus."""
    joined = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"\b([0-9]+)\s*(tb|gb|mb)\b", "$1$2")
    return _spaced(joined, r"a-z0-9._/+\-")


def similarity_text(c: Column) -> Column:
    """For similarity: lower case, Turkish letters alone are folded, other letters part words."""
    return _spaced(F.translate(F.lower(F.coalesce(c, F.lit(""))), TURKISH_FROM, TURKISH_TO), "a-z0-9")


def similarity_tokens(c: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """The distinct words of `similarity_text` of two letters or more that aren't stop words."""
    keep = lambda w: (F.length(w) > 1) & (~w.isin(*stop_words) if stop_words else F.lit(True))
    return F.array_distinct(F.filter(F.split(similarity_text(c), " "), keep))


def url_words(c: Column) -> Column:
    """For source checks: percent signs decoded (a plus stays), folded, letters and digits alone."""
    decoded = F.try_url_decode(F.replace(F.coalesce(c, F.lit("")), F.lit("+"), F.lit("%2B")))
    return _spaced(fold(F.coalesce(decoded, c, F.lit(""))), "a-z0-9")


def normalize_seller(c: Column) -> Column:
    """A seller's name without company forms and shop words."""
    plain = F.regexp_replace(normalize_token(c), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(ltd|sti|as|anonim sirketi|magazasi|store)\b", " "), r"\s+", " "))


def store_code(c: Column) -> Column:
    """The code of a store's name: the whole name first, then the first known name inside it; null if none."""
    name = normalize_text(c)
    whole = F.regexp_replace(name, r"^www | com( tr)?$| tr$| turkiye$", "")
    out = F.coalesce(*[F.when(whole == k, F.lit(v)) for k, v in STORE_CODES.items()])
    return F.coalesce(out, *[F.when(name.contains(k), F.lit(v)) for k, v in STORE_CODES.items()])


def store_of_url(c: Column) -> Column:
    """The store of a URL's host by its domain; else the host's first label, unknown without one."""
    h = host(F.coalesce(c, F.lit("")))
    known = [F.when((h == d) | h.endswith(f".{d}"), F.lit(code)) for d, code in STORE_DOMAINS.items()]
    first = F.substring_index(h, ".", 1)
    return F.coalesce(*known, F.when(first == "", F.lit("unknown")).otherwise(first))


def slugify(c: Column, fallback: str = "urun") -> Column:
    dashed = F.regexp_replace(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.substring(dashed, 1, 100)
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def product_path(name: Column, key: Column) -> Column:
    return F.concat(F.lit("/urun/"), slugify(name), F.lit("-p-"), F.url_encode(F.trim(key)))


def parse_product_path(c: Column) -> Column:
    """key and slug of the last segment of a product path; without the mark the whole is the key and the slug null."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    key = F.trim(F.regexp_extract(raw, r"(?s)^.*-p-(.*)$", 1))
    slug = F.trim(F.regexp_extract(raw, r"(?s)^(.*)-p-.*$", 1))
    marked = raw.contains("-p-")
    return F.struct(F.when(marked, key).otherwise(raw).alias("key"), F.when(marked & (slug != ""), slug).alias("slug"))


def category_leaf(c: Column) -> Column:
    """The last part of a category path that isn't empty, folded."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[>›»|]+"), lambda p: F.trim(fold(p))), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def tokens(c: Column) -> Column:
    """The distinct words of normalised text, of two letters or more."""
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda t: F.length(t) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no query or fragment, double slashes collapsed, no slash at the end."""
    bare = F.regexp_replace(F.trim(c), "[?#].*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    where = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1), "/+", "/"), "/$", "")
    return F.concat(scheme, F.lit("://"), where, path)


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#:]*)", 1))


def valid_url(c: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(c, F.lit("")).rlike(r"^https?://[^/?#\s]+")


def dedupe_key(store_id: Column, product_ref: Column, seller: Column, url: Column) -> Column:
    """The key of an offer in its store: the product's reference, or its canonical URL without one, and the seller."""
    ref = F.lower(F.trim(F.coalesce(product_ref, F.lit(""))))
    ref = F.when(ref != "", ref).otherwise(canonical_url(F.coalesce(url, F.lit(""))))
    return F.sha2(F.concat_ws("|", store_id.cast("string"), normalize_seller(seller), ref), 256)


def fingerprint(store: Column, code: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(store, F.lit("")), F.coalesce(code, F.lit("")), F.coalesce(url, F.lit(""))), 256)


def identity_map(c: Column) -> Column:
    """`identity_v3:brand=a|family=b` as a map; parts without a value are left out."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: p.rlike("^[^=]+=.*[^ ]"))
    key = lambda p: F.lower(F.trim(F.regexp_replace(F.substring_index(p, "=", 1), "^.*:", "")))
    value = lambda p: F.trim(F.regexp_replace(p, "^[^=]*=", ""))
    return F.map_from_entries(F.array_compact(F.transform(parts, lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))))


def identity_key(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def signature(*parts: Column) -> Column:
    """A short key of equal events."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def error_class(c: Column) -> Column:
    """The class of a failure's text, the first that fits."""
    t = F.upper(F.coalesce(c, F.lit("")))
    return (
        F.when(t == "", "NONE")
        .when(t.contains("SECURITY_CHALLENGE"), "SECURITY_CHALLENGE")
        .when(t.contains("NO_BUYABLE_OFFER"), "NO_BUYABLE_OFFER")
        .when(t.contains("TIMEOUT"), "TIMEOUT")
        .when(t.contains("PRODUCT_NOT_FOUND") | t.contains("ADAY"), "PRODUCT_NOT_FOUND")
        .otherwise("ERROR")
    )
