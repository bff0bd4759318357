"""Product names and catalogs: plausible names, completeness, recency, ids, destination checks, application profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls
from harrow.functions.text import nfkc, non_empty, short_hash
from harrow.operators.gate import SOCIAL_HOST, reasons
from harrow.operators.match import first_profile


def plausible_name(name: Column, noise: str, generic: str, prefix: str, shortest: int = 4, longest: int = 90) -> Column:
    """Whether a product name can be one: of a usable length, without noise words, not generic alone, at most one leading series word."""
    text = F.trim(F.coalesce(name, F.lit("")))
    return F.length(text).between(shortest, longest) & ~text.rlike(noise) & ~text.rlike(f"^(?:{generic})$") & (F.regexp_count(text, F.lit(prefix)) <= 1)


def is_card_product(name: Column, card: str, other: str) -> Column:
    """A card product: the card pattern without one that tells accessories."""
    return F.coalesce(name.rlike(card) & ~name.rlike(other), F.lit(False))


def completeness_reasons(name_ok: Column, date: Column, image: Column, url: Column, confidence: Column, least: float = 0.8) -> Column:
    """What a catalog candidate lacks."""
    return reasons(
        ("name", ~name_ok), ("release_date", non_empty(date) == ""), ("image", non_empty(image) == ""), ("official_url", urls.host(url) == ""), ("confidence", F.coalesce(confidence, F.lit(0.0)) < least)
    )


def recent_enough(year: Column, now_year: Column, span: int = 2) -> Column:
    return F.coalesce(F.abs(year - now_year) <= span, F.lit(False))


def product_id(date: Column, name: Column, prefix: str = "pcg") -> Column:
    """Stable id of a product: prefix, date, leading digits of the SHA-1 of its name."""
    return F.concat_ws("-", F.lit(prefix), date, F.substring(F.sha1(name), 1, 12))


def product_confidence(date: Column, image: Column, url: Column, named: Column) -> Column:
    plus = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    return F.round(F.lit(0.25) + plus(date, 0.25) + plus(image, 0.25) + plus(url, 0.15) + plus(named, 0.1), 2)


def useful_tokens(product: Column, vocabulary: str, shortest: int = 4) -> Column:
    """Distinct tokens of a product name that can identify it: without vocabulary words, of so many characters."""
    rest = F.regexp_replace(F.lower(F.coalesce(product, F.lit(""))), vocabulary, " ")
    return F.array_distinct(F.filter(F.split(rest, r"(?U)[\s・/|,、()（）「」\[\]]+"), lambda t: F.length(t) >= shortest))


def verify_destination(url: Column, page_text: Column, product: Column, blocked: list[str], language: str, vocabulary: str) -> Column:
    """struct(ok, reason): the host may be a destination, and its page speaks of applying and of the product (by vocabulary or token)."""
    host = urls.host(url)
    text = F.lower(F.coalesce(page_text, F.lit("")))
    about = text.rlike(vocabulary) | F.exists(useful_tokens(product, vocabulary), lambda t: F.contains(text, t))
    reason = (
        F.when(host == "", "no_host").when(urls.host_under(host, blocked), "blocked").when(host.rlike(SOCIAL_HOST), "social").when(page_text.isNull(), "not_fetched").when(~text.rlike(language), "language").when(~about, "product")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def app_fields(intent: Column, profile: Column, app: Column, app_profile: Column) -> Column:
    """struct(app, repaired): the application named for a record; one of another profile is cleared, and a missing one filled, only where the record speaks of an application."""
    foreign = (non_empty(app) != "") & app_profile.isNotNull() & profile.isNotNull() & (app_profile != profile)
    kept = F.when(foreign, F.lit("")).otherwise(non_empty(app))
    return F.struct(F.when((kept == "") & intent & profile.isNotNull(), profile).otherwise(kept).alias("app"), foreign.alias("repaired"))


@dataclass(frozen=True)
class App:
    """A shop's application: patterns of texts that mean the shop, addresses of the application, whether it opens from a chat."""

    id: str
    name: str
    patterns: tuple[str, ...]
    official: str
    ios: str = ""
    android: str = ""
    in_chat: bool = False


_STORE = "https://apps.apple.com/jp/app/id"
#: The applications that are known, in the order in which they are looked for, and words that speak of one.
APPS = (
    App("geo", "ゲオアプリ", (r"(?i)\bGEO\b", "ゲオ(?!ルグ)"), "https://geo-online.co.jp/", _STORE + "590190880"),
    App("bookoff", "ブックオフ公式アプリ", (r"(?i)BOOK\s*OFF", "ブックオフ"), "https://www.bookoff.co.jp/members/redirect.html", _STORE + "1369113760"),
    App("kojima", "コジマアプリ", ("コジマ(?!プロダクション)", "(?i)KOJIMA"), "https://www.kojima.net/shop/app/kojima_appli.html", _STORE + "1216586207"),
    App("yamada", "ヤマダデジタル会員", ("ヤマダ(?:デンキ|電機)?", "(?i)YAMADA"), "https://www.yamada-denki.jp/", _STORE + "364504659"),
    App("aeon", "イオンお買物アプリ", ("イオン(?:スタイル|リテール|お買物)?", "(?i)AEON"), "https://www.aeonretail.jp/", _STORE + "634744681"),
    App("majica", "majicaアプリ", ("(?i)majica", "ドン[・･]?キホーテ", "MEGAドン", "アピタ|ピアゴ"), "https://www.majica-net.com/", _STORE + "1001883210"),
    App("biccamera", "ビックカメラアプリ", ("ビックカメラ", r"(?i)BIC\s*CAMERA"), "https://www.biccamera.com/", _STORE + "518593576"),
    App("edion", "エディオンアプリ", ("エディオン", "(?i)EDION"), "https://www.edion.com/", _STORE + "434823849"),
    App("nojima", "ノジマアプリ", ("ノジマ", "(?i)NOJIMA"), "https://www.nojima.co.jp/", _STORE + "451436140"),
    App("furuichi", "LINE（ふるいちアプリ）", ("ふるいち", "古本市場", "トレカパーク"), "https://www.furu1.net/point-card.html", in_chat=True),
    App("tsutaya", "本コレアプリ（TSUTAYA）", ("(?i)TSUTAYA", "蔦屋書店", "ツタヤ"), "https://tsutaya.tsite.jp/", _STORE + "391429128"),
    App("x", "X", (r"(?i)\bX\b", "(?i)Twitter", "ツイッター"), "https://x.com/"),
)
APP_INTENT = (
    r"(?i)アプリ(?:内|から|で|限定)?[^\n]{0,24}(?:応募|抽選|申込|申し込み|エントリー|受付)", r"(?i)(?:応募|抽選|申込|申し込み|エントリー|受付)[^\n]{0,24}アプリ", r"(?i)WEB事前抽選[^\n]{0,20}アプリ", "アプリ抽選", "アプリ会員限定", r"[（(]\s*アプリ\s*[）)]",
)
STALE_APP_TEXT = "アプリ内の抽選案内|ゲオアプリ内"
CHAT_LINK = r"(?i)^https://(?:liff|miniapp)\.line\.me/"
#: What a record says of its application; cleared where it is another shop's.
APP_FIELDS = ("appId", "appName", "appUrl", "iosAppStoreUrl", "androidAppStoreUrl", "appOfficialUrl")


def _of_app(ident: Column, field: str, apps: tuple[App, ...]) -> Column:
    """A field of the application with this id; "" for none."""
    return F.coalesce(*[F.when(ident == a.id, F.lit(getattr(a, field))) for a in apps if getattr(a, field)], F.lit(""))


def _launchable(url: Column) -> Column:
    return F.when(F.trim(F.coalesce(url, F.lit(""))).rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), F.trim(url)).otherwise("")


def with_app_destination(rows: DataFrame, apps: tuple[App, ...] = APPS, intent: tuple[str, ...] = APP_INTENT, platform: str = "ios") -> DataFrame:
    """Records with the application by which one applies: repaired first, then filled.

    rows: shop, product, url, sourceUrl, fallbackUrl, instructions, memo, destinationType, appId, appName, appUrl, iosAppStoreUrl, androidAppStoreUrl,
    appOfficialUrl. A record that names an application of another shop than its own (by shop and addresses), or that names one
    though neither its shop nor an address of the application speaks for it, loses what it says of applications (`repaired`). A record that speaks of
    an application then gets the fields that its shop's application has: the address to open, the stores, the fallback by `platform`.
    """
    known = [(a.id, list(a.patterns)) for a in apps]
    text = lambda *cols: nfkc_all(rows, *cols)
    marked = rows.withColumns({"_own": text("shop", "url", "sourceUrl"), "_all": text("shop", "appName", "product", "instructions", "memo", "url", "sourceUrl"), "_named": text("appName"), "_shop": text("shop"), "_by": text("appName", "shop", "instructions", "memo", "url")})
    told = F.when(~F.coalesce(F.col("instructions"), F.lit("")).rlike(STALE_APP_TEXT), F.col("instructions"))  # what is left of a repaired record
    plain = marked.withColumn("_told", told)
    marked = plain.withColumns({"_rest": nfkc_all(plain, "shop", "product", "_told", "memo", "url", "sourceUrl"), "_rest_by": nfkc_all(plain, "shop", "_told", "memo", "url")})
    for c in ("_own", "_all", "_named", "_shop", "_by", "_rest", "_rest_by"):
        marked = marked.withColumn(c, nfkc(F.col(c)))
    by_id = F.when(F.col("appId").isin(*[a.id for a in apps]), F.col("appId"))
    declared, identity = F.coalesce(by_id, first_profile(F.col("_named"), known)), first_profile(F.col("_own"), known)
    marked = marked.withColumns({"_declared": declared, "_identity": identity, "_of_shop": first_profile(F.col("_shop"), known)})
    said = (F.col("destinationType") == "app") | (non_empty(F.col("appName"), F.col("appUrl")) != "")
    speaks_for = (non_empty(F.col("appUrl")) != "") | F.coalesce(F.exists(F.array(*[F.struct(F.lit(a.id).alias("id"), _says(F.col("_shop"), a).alias("yes")) for a in apps]), lambda p: (p["id"] == F.col("_declared")) & p["yes"]), F.lit(False))
    foreign = F.coalesce(said, F.lit(False)) & F.col("_declared").isNotNull() & F.when(F.col("_identity").isNotNull(), F.col("_declared") != F.col("_identity")).otherwise(~speaks_for)
    marked = marked.withColumn("repaired", F.coalesce(foreign, F.lit(False)))
    cleared = {c: F.when(F.col("repaired"), "").otherwise(F.coalesce(F.col(c), F.lit(""))) for c in APP_FIELDS}
    stale = F.col("repaired") & F.coalesce(F.col("instructions"), F.lit("")).rlike(STALE_APP_TEXT)
    fallback_stale = F.col("repaired") & F.coalesce(F.col("fallbackUrl"), F.lit("")).rlike(r"geo-online\.co\.jp|apps\.apple\.com/jp/app/id590190880")
    marked = marked.withColumns({
        **cleared, "instructions": F.when(stale, "").otherwise(F.col("instructions")), "fallbackUrl": F.when(fallback_stale, non_empty(F.col("url"), F.col("sourceUrl"))).otherwise(F.col("fallbackUrl")),
        "destinationType": F.when(F.col("repaired") & (F.col("destinationType") == "app"), "direct").otherwise(non_empty(F.col("destinationType"), F.lit("direct"))),
    })
    wants = (F.col("destinationType") == "app") | (non_empty(*[F.col(c) for c in ("appName", "appUrl", "iosAppStoreUrl", "androidAppStoreUrl")]) != "") | F.when(F.col("repaired"), F.col("_rest")).otherwise(F.col("_all")).rlike("|".join(f"(?:{p})" for p in intent))
    marked = marked.withColumn("_by", F.when(F.col("repaired"), F.col("_rest_by")).otherwise(F.col("_by")))
    profile = F.coalesce(F.when(F.col("appId").isin(*[a.id for a in apps]), F.col("appId")), first_profile(F.col("_by"), known))
    marked = marked.withColumns({"_wants": F.coalesce(wants, F.lit(False)), "_profile": F.coalesce(profile, F.lit(""))})
    of = lambda field: _of_app(F.col("_profile"), field, apps)
    chat = F.when(F.col("_profile").isin(*[a.id for a in apps if a.in_chat]), F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("")).rlike(CHAT_LINK), F.col(c)) for c in ("appUrl", "url", "fallbackUrl", "sourceUrl")], F.lit(""))).otherwise("")
    ios, android, official = (non_empty(_launchable(F.col(c)), of(f)) for c, f in (("iosAppStoreUrl", "ios"), ("androidAppStoreUrl", "android"), ("appOfficialUrl", "official")))
    stores = (android, official, ios) if platform == "android" else (ios, official, android)
    filled = {
        "appId": non_empty(F.col("appId"), F.col("_profile")), "appName": non_empty(F.col("appName"), of("name"), F.lit("応募アプリ")), "appUrl": non_empty(_launchable(F.col("appUrl")), chat), "fallbackUrl": non_empty(_launchable(F.col("fallbackUrl")), *stores),
        "iosAppStoreUrl": ios, "androidAppStoreUrl": android, "appOfficialUrl": official, "destinationType": F.lit("app"),
    }
    return marked.withColumns({c: F.when(F.col("_wants"), v).otherwise(F.col(c)) for c, v in filled.items()}).select(*rows.columns, "repaired")


def _says(text: Column, app: App) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in app.patterns))


def nfkc_all(rows: DataFrame, *cols: str) -> Column:
    """The filled ones of the columns, a line each, white space squeezed; NFKC is for the caller, on a plain column."""
    have = [F.nullif(F.col(c), F.lit("")) for c in cols if c in rows.columns]
    return F.trim(F.regexp_replace(F.concat_ws("\n", *have), r"(?U)\s+", " "))


def image_name(release: Column, content: Column, kind: Column) -> Column:
    """File name of a stored image: release date, leading digits of its SHA-1, extension of its kind."""
    return F.concat(F.lit("auto-"), release, F.lit("-"), F.substring(F.sha1(content), 1, 12), F.lit("."), F.when(kind == "jpeg", "jpg").otherwise(kind))


def record_id(*parts: Column) -> Column:
    return short_hash(*parts)
