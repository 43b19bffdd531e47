"""Technical attributes and the kind of a product out of its title, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .prices import memory_and_disk
from .text import category_leaf, fold, normalize_text

#: Processors in the order in which they are tried, panels from the most specific on, colours as shown (fixed values).
CPUS = (
    r"\b(intel\s+core\s+ultra\s+[3579]\s*[0-9]{3}[a-z]{0,2})\b", r"\b(intel\s+core\s+i[3579][\s-]?[0-9]{4,5}[a-z]{0,2})\b", r"\b(i[3579][\s-]?[0-9]{4,5}[a-z]{0,2})\b",
    r"\b(amd\s+ryzen\s+[3579]\s+[0-9]{4,5}[a-z]{0,3})\b", r"\b(ryzen\s+[3579]\s+[0-9]{4,5}[a-z]{0,3})\b", r"\b(apple\s+m[1-5](?:\s+(?:pro|max|ultra))?)\b",
    r"\b(dimensity\s+[0-9]{3,5}(?:\s+ultra)?)\b", r"\b(exynos\s+[0-9]{3,5})\b",
)
GPU = r"\b((?:nvidia\s+)?(?:geforce\s+)?(?:rtx|gtx)\s*[0-9]{3,4}(?:\s*ti|\s*super)?|(?:amd\s+)?radeon\s+rx\s*[0-9]{3,4}(?:\s*xt)?|intel\s+arc\s+[a-z][0-9]{3})\b"
PANELS = {"super amoled": "Super AMOLED", "mini led": "Mini LED", "amoled": "AMOLED", "oled": "OLED", "qled": "QLED", "ips": "IPS", "va": "VA", "tn": "TN"}
COLORS = {
    "siyah": "Siyah", "beyaz": "Beyaz", "mavi": "Mavi", "kirmizi": "Kırmızı", "yesil": "Yeşil", "gri": "Gri", "gumus": "Gümüş", "gold": "Gold", "altin": "Altın", "mor": "Mor", "pembe": "Pembe",
    "lacivert": "Lacivert", "turuncu": "Turuncu", "bej": "Bej", "grafit": "Grafit", "titanyum": "Titanyum",
}
YES_TERMS = {
    ("Bağlantılar", "5G"): r"\b5g\b", ("Bağlantılar", "eSIM"): r"\besim\b", ("Bağlantılar", "NFC"): r"\bnfc\b", ("Bağlantılar", "Wi-Fi 6"): r"\b(?:wi[ -]?fi|wifi)\s*6(?:e)?\b",
    ("Bağlantılar", "Wi-Fi 7"): r"\b(?:wi[ -]?fi|wifi)\s*7\b", ("Ekran", "Dokunmatik Ekran"): r"\bdokunmatik\b", ("Ses", "Aktif Gürültü Engelleme"): r"\b(?:anc|aktif gurultu engelleme)\b",
}


def attributes(title: Column) -> Column:
    """section, name, value of what a title says, in a fixed order."""
    text = F.regexp_replace(F.trim(fold(F.coalesce(title, F.lit("")))), r"\s+", " ")
    return let(text, lambda t: let(memory_and_disk(t), lambda size: let(_entries(t, size), F.array_compact)))


def _entries(text: Column, size: Column) -> Column:
    has = lambda pattern, i=1: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    disk = size["storage_gb"]
    shown_disk = F.when((disk >= 1024) & (disk % 1024 == 0), F.concat((disk / 1024).cast("int"), F.lit(" TB"))).otherwise(F.concat(disk, F.lit(" GB")))
    cpu = F.coalesce(*[has(p) for p in CPUS])
    gpu = F.upper(F.regexp_replace(has(GPU), r"\s+", " "))
    pixels = r"\b([0-9]{3,4})\s*[x×]\s*([0-9]{3,4})\b"
    cameras = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3}(?:[.,][0-9]+)?)\s*mp\b"), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double"))
    entries = [
        ("Bellek", "RAM", F.concat(size["ram_gb"], F.lit(" GB"))), ("Depolama", "Depolama Kapasitesi", shown_disk), ("İşlemci", "İşlemci Modeli", F.upper(cpu)), ("Ekran Kartı", "Ekran Kartı", gpu),
        ("Ekran", "Ekran Boyutu", F.concat(F.replace(has(r"\b([0-9]{1,2}(?:[.,][0-9])?)\s*(?:inch?|inc|\")"), F.lit("."), F.lit(",")), F.lit(" inç"))),
        ("Ekran", "Yenileme Hızı", F.concat(has(r"\b(60|75|90|100|120|144|165|180|200|240|360|480)\s*hz\b"), F.lit(" Hz"))), ("Ekran", "Ekran Çözünürlüğü", F.concat(has(pixels), F.lit(" x "), has(pixels, 2))),
        ("Ekran", "Panel Tipi", F.coalesce(*[F.when(text.rlike(rf"\b{k}\b"), F.lit(v)) for k, v in PANELS.items()])),
        ("Kamera", "Ana Kamera", F.concat(F.regexp_replace(F.array_max(cameras).cast("string"), r"\.0$", ""), F.lit(" MP"))), ("Batarya", "Batarya Kapasitesi", F.concat(has(r"\b([0-9]{3,5})\s*mah\b"), F.lit(" mAh"))),
        ("Batarya", "Hızlı Şarj Gücü", F.concat(has(r"\b([0-9]{1,3})\s*w(?:att)?\s*(?:hizli\s*)?(?:sarj|charge)?\b"), F.lit(" W"))), *[(s, n, F.when(text.rlike(p), F.lit("Var"))) for (s, n), p in YES_TERMS.items()],
        ("Bağlantılar", "Bluetooth Sürümü", F.replace(has(r"\bbluetooth\s*([0-9](?:[.,][0-9])?)\b"), F.lit(","), F.lit("."))), ("Tasarım", "Renk", F.coalesce(*[F.when(text.rlike(rf"\b{k}\b"), F.lit(v)) for k, v in COLORS.items()])),
    ]
    row = lambda s, n: lambda v: F.when(v.isNotNull(), F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value")))
    return F.array(*[let(v, row(s, n)) for s, n, v in entries])


def evidence_confidence(found: Column) -> Column:
    """30 and 7 for each attribute, 98 at most; 0 without any."""
    return F.when(F.size(found) > 0, F.least(F.lit(98), 30 + F.size(found) * 7)).otherwise(0)


#: Kinds in the order in which they are tried: words of title, category and identity (fixed values).
KINDS = (
    ("accessory", "powerbank", r"powerbank|power bank|tasinabilir sarj"), ("accessory", "jump_starter_inflator", r"aku.*(?:atesleyici|takviye)|jump starter|lastik sisirici.*psi"),
    ("generic", "room_fragrance", r"oda kokusu|reed diffuser|room fragrance"), ("generic", "perfume", r"parfum| eau de | edp | edt "), ("laptop", "laptop", r"macbook|ideapad|thinkpad|notebook|laptop"),
    ("tablet", "tablet", r"galaxy tab |ipad | tablet"), ("wearable", "smartwatch", r"apple watch|galaxy watch|redmi watch|akilli saat|smartwatch|giyilebilir"),
    ("audio/headphone", "headphone", r"redmi buds|galaxy buds|airpods|earbuds|kulaklik|headphone"),
)


def product_kind(name: Column, category: Column, family: Column) -> Column:
    """kind and subkind of a product: what its type says comes before what its brand's families suggest."""
    words = F.struct(F.concat_ws(" ", fold(category), category_leaf(category), fold(family), fold(name)).alias("all"), fold(F.coalesce(category, F.lit(""))).alias("category"), fold(F.coalesce(family, F.lit(""))).alias("family"))

    def of(w: Column) -> Column:
        pair = lambda k, s: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("subkind"))
        out = [F.when(F.concat(F.lit(" "), w["all"], F.lit(" ")).rlike(p), pair(k, s)) for k, s, p in KINDS]
        out.append(F.when(w["category"].rlike("cep telefonu|akilli telefon|smartphone"), pair("phone", "phone")))
        out.append(F.when(w["all"].rlike("sarj|charger|adapt|usb-c|usb c|kablo|kilif|ekran koruyucu"), pair("accessory", "accessory")))
        out.append(F.when(w["family"].rlike("^(iphone |redmi |poco |galaxy [as]|fold|flip|xiaomi )"), pair("phone", "phone")))
        return F.coalesce(*out, pair("generic", "generic"))

    return let(words, of)


#: Offer details in folded texts: what is looked for, by field (fixed values).
FREE_SHIPPING = "ucretsiz kargo|kargo bedava|bedava kargo|free shipping|ucretsiz teslimat"
OFFICIAL = "resmi satici|yetkili satici|official store|resmi magaza"
SPONSORED = "sponsorlu|reklam|sponsored"
DELIVERY = r"(yarin kapinda|bugun kapinda|ayni gun teslimat|hizli teslimat|[0-9]+ gunde kargo(?:da)?|tahmini teslimat [a-z0-9 ]{3,40})"
WARRANTY = r"((?:[0-9]+ yil )?(?:resmi )?(?:distributor|ithalatci|uretici|satici) garantisi|[0-9]+ (?:yil|ay) garanti)"
INSTALLMENT = r"([0-9]+ (?:aya varan )?taksit|pesin fiyatina [0-9]+ taksit)"


def offer_details(text: Column, seller: Column, source: Column, shipping: Column) -> Column:
    """free_shipping, sponsored, official, delivery, warranty, installment of an offer's texts; a seller that is the source is official, shipping given as 0 is free."""

    def of(t: Column) -> Column:
        first = lambda pattern: F.nullif(F.substring(F.regexp_extract(t, pattern, 1), 1, 180), F.lit(""))
        s, o = normalize_text(seller), normalize_text(source)
        same = (s != "") & (o != "") & (s.contains(o) | o.contains(s))
        return F.struct(
            F.coalesce(shipping == 0, t.rlike(FREE_SHIPPING)).alias("free_shipping"), t.rlike(SPONSORED).alias("sponsored"), (t.rlike(OFFICIAL) | same).alias("official"),
            first(DELIVERY).alias("delivery"), first(WARRANTY).alias("warranty"), first(INSTALLMENT).alias("installment"),
        )

    return let(normalize_text(text), of)
