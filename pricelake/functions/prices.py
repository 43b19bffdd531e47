"""Prices, capacities, stock, coupons and campaigns out of text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import fold, normalize_text


def _number(text: Column) -> Column:
    """A positive double, else null."""
    value = F.when(text != "", text).try_cast("double")
    return F.when(value > 0, value)


def _one_point(text: Column, mark: str) -> Column:
    """Of several ``mark`` only the last stays, as the decimal point."""
    head, tail = F.regexp_extract(text, rf"^(.*)\{mark}([^{mark}]*)$", 1), F.substring_index(text, mark, -1)
    return F.when(text.contains(mark), F.concat(F.replace(head, F.lit(mark), F.lit("")), F.lit("."), tail)).otherwise(text)


def normalize_price(c: Column) -> Column:
    """A price in Turkish or English writing; null where there is none or it isn't above 0.

    With both separators the last one is decimal; a single kind is decimal
    only if one or two digits follow the last of it, else it parts thousands.
    """
    raw = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" ")))
    return let(F.regexp_replace(F.regexp_extract(raw, r"-?[0-9][0-9\s.,]*", 0), r"\s+", ""), _plain_price)


def _plain_price(text: Column) -> Column:
    comma, dot = F.instr(F.reverse(text), ","), F.instr(F.reverse(text), ".")  # distance from the end, 0 if none
    plain = (
        F.when(text.startswith("-"), "")
        .when((comma > 0) & (dot > 0) & (comma < dot), _one_point(F.replace(text, F.lit("."), F.lit("")), ","))
        .when((comma > 0) & (dot > 0), _one_point(F.replace(text, F.lit(","), F.lit("")), "."))
        .when(comma.isin(2, 3), _one_point(text, ","))
        .when(dot.isin(2, 3), _one_point(text, "."))
        .otherwise(F.regexp_replace(text, "[.,]", ""))
    )
    return _number(plain)


def parse_tr_price(c: Column) -> Column:
    """Turkish writing: with both separators the comma is decimal, a single comma too; one point before three digits parts thousands."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.,]", "")
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    plain = (
        F.when(text.contains(".") & text.contains(","), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(text.contains(","), F.replace(text, F.lit(","), F.lit(".")))
        .when((dots > 1) | text.rlike(r"^[^.]*\.[0-9]{3}$"), F.replace(text, F.lit("."), F.lit("")))
        .otherwise(text)
    )
    return _number(plain)


def field_price(c: Column) -> Column:
    """A price field of a page: currency marks dropped; both separators: the last is decimal; a comma before one or two digits too."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), " |₺|TL|TRY|tl|try| ", "")
    n = F.regexp_extract(text, r"-?[0-9][0-9.,]*", 0)
    comma, dot = F.instr(F.reverse(n), ","), F.instr(F.reverse(n), ".")
    dots = F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
    drop = lambda text, mark: F.replace(text, F.lit(mark), F.lit(""))
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(drop(n, "."), F.lit(","), F.lit(".")))
        .when((comma > 0) & (dot > 0), drop(n, ","))
        .when(comma.isin(2, 3), F.replace(drop(n, "."), F.lit(","), F.lit(".")))
        .when(comma > 0, drop(n, ","))
        .when((dots > 1) & dot.isin(2, 3), _one_point(n, "."))
        .when((dots > 1) | ((dots == 1) & (dot == 4)), drop(n, "."))
        .otherwise(n)
    )
    return _number(plain)


_MARK = r"(?:₺|\bTL\b|\bTRY\b)"


def currency_prices(c: Column) -> Column:
    """All distinct prices next to a currency mark: those after a mark in order, then those before one."""
    raw = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" "))
    after = F.regexp_extract_all(raw, F.lit(rf"(?iU){_MARK}\s*([0-9][0-9\s.,]*)"), F.lit(1))
    before = F.regexp_extract_all(raw, F.lit(rf"(?iU)([0-9][0-9\s.,]*)\s*{_MARK}"), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(F.concat(after, before), normalize_price)))


def select_prices(prices: Column, least: float = 1.0, most: float = 100_000_000.0) -> Column:
    """current and old price of a card's candidates: the least, and the largest above it."""
    inside = F.filter(prices, lambda p: p.between(least, most))
    low, high = F.array_min(inside), F.array_max(inside)
    return F.struct(low.alias("current"), F.when(high - low >= 0.001, high).alias("old"))


def capacity_gb(c: Column) -> Column:
    """The first capacity in whole GB: a TB is 1024 GB, an MB a 1024th, at least 1; null without one."""
    text = F.replace(fold(F.coalesce(c, F.lit(""))), F.lit(","), F.lit("."))
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*(tb|gb|mb)"
    number, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    return F.when(unit == "tb", F.rint(number * 1024)).when(unit == "mb", F.greatest(F.lit(1.0), F.rint(number / 1024))).otherwise(F.rint(number)).cast("int")


_RAM = "(2|3|4|6|8|12|16|18|24|32|36|48|64)"
_STORAGE = "(32|64|128|256|512|1024|2048|4096)"
_UNIT = "(?:gb?|tb|ssd|nvme)"
#: A number that stands for two: memory, then storage, in one piece.
_PAIR = rf"(?<![0-9]){_RAM}\s*(?:gb|g)?\s*(?:[+/x]|(?<=g|b)\s*)\s*{_STORAGE}\s*({_UNIT})?\b"
_RAM_NAMED = rf"(?<![0-9]){_RAM}\s*gb\s*(?:ram|bellek)\b|\b(?:ram|bellek)\s*[:=-]?\s*{_RAM}\s*gb\b"
_DISK_NAMED = r"(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s*(tb|gb)?\s*(?:m\.?2\s*)?(?:nvme\s*)?(?:ssd|nvme|depolama|hafiza|disk)\b"
#: A capacity that is neither a speed nor the memory of a graphics card.
_FREE = r"(?<![0-9])(?<!(?:rtx|gtx|gpu|vram)[^,;]{0,24})([0-9]+(?:[.,][0-9]+)?\s*(?:tb|gb|mb))\b(?!\s*/?\s*s\b)(?!\s*(?:gddr|vram|ekran kart|rtx|gtx))"


def memory_and_disk(c: Column) -> Column:
    """ram_gb and storage_gb of a title: as a pair, by the words beside them, else by size."""
    return let(fold(F.coalesce(c, F.lit(""))), _memory_and_disk)


def _memory_and_disk(text: Column) -> Column:
    pair_ram, pair_disk, pair_unit = (F.regexp_extract(text, _PAIR, i).try_cast("int") if i < 3 else F.regexp_extract(text, _PAIR, 3) for i in (1, 2, 3))
    ram = F.coalesce(F.regexp_extract(text, _RAM_NAMED, 1).try_cast("int"), F.regexp_extract(text, _RAM_NAMED, 2).try_cast("int"))
    disk = F.struct(F.replace(F.regexp_extract(text, _DISK_NAMED, 1), F.lit(","), F.lit(".")).try_cast("double").alias("number"), F.regexp_extract(text, _DISK_NAMED, 2).alias("unit"))
    free = F.transform(F.regexp_extract_all(text, F.lit(_FREE), F.lit(1)), capacity_gb)
    pair = F.struct(pair_ram.alias("ram"), pair_disk.alias("disk"), pair_unit.alias("unit"))

    def paired(p: Column) -> Column:
        whole = p["ram"].isNotNull() & p["disk"].isNotNull() & ((p["unit"] != "") | text.rlike(rf"(?<![0-9]){_RAM}\s*(?:gb?)?\s*[+/x]"))
        both = F.struct(p["ram"].alias("ram_gb"), F.when(p["unit"] == "tb", p["disk"] * 1024).otherwise(p["disk"]).alias("storage_gb"))
        return F.when(whole, both).otherwise(let(F.struct(ram.alias("ram"), disk.alias("disk"), free.alias("free")), _apart))

    return let(pair, paired)


def _apart(t: Column) -> Column:
    """Memory and disk that aren't written as a pair: by the words beside them, else by size."""
    ram, free, unit = t["ram"], t["free"], t["disk"]["unit"]
    named = F.when(unit == "tb", F.rint(t["disk"]["number"] * 1024)).otherwise(F.rint(t["disk"]["number"])).cast("int")
    named = F.when((unit != "") | (named >= 32), named)
    others = F.filter(free, lambda g: ram.isNull() | (g != ram))
    small = F.filter(free, lambda g: g.isin(2, 3, 4, 6, 8, 12, 16, 18, 24, 32, 48, 64) & (g < F.array_max(free)))
    guess = (F.size(free) >= 2) & (F.size(small) > 0) & (F.array_max(free) >= 32)
    return F.struct(
        F.coalesce(ram, F.when(guess, F.try_element_at(small, F.lit(1)))).alias("ram_gb"),
        F.coalesce(named, F.when(ram.isNull() & guess, F.array_max(free)), F.array_max(others)).alias("storage_gb"),
    )


def stock(c: Column, active: Column, price: Column) -> Column:
    """status, confidence and quantity of an offer, from its texts, whether it is active, and its price; the first rule that fits."""
    return let(F.struct(fold(F.coalesce(c, F.lit(""))).alias("text"), F.coalesce(active, F.lit(False)).alias("active"), price.alias("price")), _stock)


def _stock(o: Column) -> Column:
    t, active, price = o["text"], o["active"], o["price"]
    out = t.rlike(r"\b(?:stok(?:ta)?\s*yok|tukendi|satisa kapali|mevcut degil|out\s*of\s*stock)\b")
    low = t.rlike(r"\b(?:son\s*[0-9]+\s*(?:urun|adet)|az\s*kaldi|sinirli\s*stok|tukenmek\s*uzere|low\s*stock)\b")
    there = t.rlike(r"\b(?:stokta|hemen\s*kargo|ayni\s*gun\s*kargo|in\s*stock|mevcut)\b")
    quantity = F.regexp_extract(t, r"\b(?:son|yalnizca)\s*([0-9]{1,3})\s*(?:urun|adet)\b", 1).try_cast("int")
    status = (
        F.when(out | ~active, "out_of_stock")
        .when(low | F.coalesce(quantity <= 5, F.lit(False)), "low_stock")
        .when(there | (price > 0), "in_stock")
        .otherwise("unknown")
    )
    sure = out | (active & (low | F.coalesce(quantity <= 5, F.lit(False)) | there))
    confidence = F.when(sure, "high").when(~active | (price > 0), "medium").otherwise("low")
    return F.struct(status.alias("status"), confidence.alias("confidence"), quantity.alias("quantity"))


def available(c: Column) -> Column:
    """Whether a stock text doesn't say that the offer is gone; null says nothing."""
    return ~normalize_text(c).rlike("stokta yok|tukendi|satisa kapali|mevcut degil|temin edilemiyor")


def _amount(text: Column) -> Column:
    return F.when(text != "", F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).try_cast("double")


def coupon(c: Column) -> Column:
    """code, kind, percent, amount, minimum_basket, valid_until of a coupon text; null where no coupon is named."""
    t = F.coalesce(c, F.lit(""))
    named = F.lower(t).rlike("kupon|koduyla|indirim kod")
    first = F.upper(F.regexp_extract(t, r"(?i)(?:kupon(?:\s+kodu)?|kod)\s*[:\-]?\s*([A-Z0-9][A-Z0-9_-]{2,24})", 1))
    second = F.upper(F.regexp_extract(t, r"(?i)\b([A-Z]{3,}[0-9]{0,4})\b\s+(?:koduyla|kuponuyla)", 1))
    words = ("", "KUPON", "KOD", "INDIRIM", "İNDIRIM", "İNDİRİM")
    code = F.coalesce(F.when(~first.isin(*words), first), F.when(~second.isin(*words), second))
    percent = _amount(F.regexp_extract(t, r"(?i)%\s*([0-9]{1,2}(?:[.,][0-9]+)?)\s*(?:indirim|kupon)?", 1))
    amount = _amount(F.regexp_extract(t, r"(?i)([0-9]{2,6}(?:[.,][0-9]{1,2})?)\s*(?:TL|₺)\s*(?:indirim|kupon)", 1))
    basket = _amount(F.regexp_extract(t, r"(?i)(?:en\s+az|min(?:imum)?|alt\s+limit)\s*([0-9]{2,7}(?:[.,][0-9]{1,2})?)\s*(?:TL|₺)", 1))
    until = F.regexp_extract(t, r"(?iu)(?:son\s+tarih|geçerli(?:lik)?|bitiş)\s*[:\-]?\s*([0-9]{1,2}[./-][0-9]{1,2}(?:[./-][0-9]{2,4})?)", 1)
    fields = F.struct(
        code.alias("code"), F.when(code.isNotNull(), "code").otherwise("automatic").alias("kind"),
        F.when((percent > 0) & (percent <= 100), percent).alias("percent"), F.when(amount > 0, amount).alias("amount"),
        basket.alias("minimum_basket"), F.when(until != "", until).alias("valid_until"),
    )
    return F.when(named, fields)


def campaign_tags(price: Column, old: Column, shipping: Column, text: Column, official: Column) -> Column:
    """Up to five tags: price_drop (5 % or more), free_shipping, installment, store_campaign, official."""
    t = F.lower(F.coalesce(text, F.lit("")))
    drop = F.when((old > price) & (price > 0), F.rint((old - price) / old * 100))
    return F.array_compact(F.array(
        F.when(drop >= 5, "price_drop"),
        F.when((F.coalesce(shipping, F.lit(0.0)) <= 0) | t.contains("ücretsiz"), "free_shipping"),
        F.when(t.rlike("taksit|peşin fiyatına|vade"), "installment"),
        F.when(t.rlike("sepette|indirim|kampanya|fırsat"), "store_campaign"),
        F.when(official, "official"),
    ))


#: Words beside a price that speak against and for it (fixed values, folded).
NEGATIVE = ("ayda", "aylik", "taksit", "alisveris kredisi", "kredi ile", "krediyle", "aylik odeme", "installment", "x taksit", "taksitle")
POSITIVE = (
    "satis fiyat", "urun fiyat", "sepette", "web'e ozel", "webe ozel", "ozel fiyat", "indirimli fiyat", "kampanyali fiyat", "pesin fiyat",
    "fiyati", "fiyat",
)
_PRICE = r"(?iU)(?<![0-9])([0-9]{1,3}(?:[.\s][0-9]{3})+(?:,[0-9]{1,2})?|[0-9]{2,6}(?:[.,][0-9]{1,2})?)\s*(?:TL|₺)(?![\w])"


def price_mentions(c: Column, least: float = 100.0, most: float = 1_000_000.0) -> Column:
    """Each price of a text with price, place, positive and negative: how many words for and against stand around it.

    A price's surroundings reach back to the price before it, 90 characters at
    most, and 45 ahead.
    """
    text = F.coalesce(c, F.lit(""))
    # a mark after each price cuts the text into pieces of one price each, the price at the end
    pieces = F.split(F.regexp_replace(text, _PRICE, "$0\u0001"), "\u0001")
    count = lambda context, terms: sum((F.when(context.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    flat = lambda s: F.regexp_replace(F.trim(fold(s)), r"\s+", " ")

    def mention(piece: Column, i: Column) -> Column:
        raw = F.regexp_extract(piece, _PRICE + r"\z", 1)
        before = F.regexp_replace(piece, _PRICE + r"\z", "")
        ahead = F.substring(F.array_join(F.slice(pieces, i + 2, F.lit(3)), ""), 1, 45)
        context = F.concat_ws(" ", flat(F.right(before, F.lit(90))), flat(ahead))
        return F.struct(parse_tr_price(raw).alias("price"), i.alias("place"), count(context, POSITIVE).alias("positive"), count(context, NEGATIVE).alias("negative"))

    return F.filter(F.transform(pieces, mention), lambda m: m["price"].between(least, most))
