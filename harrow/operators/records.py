"""Records as a whole: keys, aliases, entered records, predicates, fallbacks, samples, search status, catalog output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import urls
from harrow.functions.text import first_alias, let, non_empty
from harrow.operators.gate import SOCIAL_HOST

#: Keys of catalog products that stay private, and words by which notices name a shop's counter or an application.
PRIVATE_PRODUCT_KEYS = ("source", "sourceUrl", "imageSource", "imageSourceUrl", "imageSourceType", "sourceFingerprint", "imageInfo", "lastSeenAt", "discoveredAt")
STORE_ONLY = "店頭(?:掲示|ポスター|QR|ＱＲ|受付)|受付QRコードは店頭|店頭のみ|レジにて受付|店舗で受付|申込用紙"
#: Shops by the names that their notices use (patterns of cleaned names).
SHOP_ALIASES = (
    ("amazon|アマゾン", "amazon"), ("pokemoncenter|ポケセン", "pokemoncenter"), ("楽天ブックス", "rakutenbooks"), ("セブンネット", "7net"), ("あみあみ", "amiami"), ("ヤマダ", "yamada"), ("ノジマ", "nojima"),
    ("エディオン", "edion"), ("トレカキャピタル", "trecacapital"), ("キッズリパブリック", "kidsrepublic"), ("ファミマ", "famima"), ("コジマ", "kojima"), ("ホビーステーション|ホビステ", "hbst"), ("カードラボ", "cardlabo"),
)


def canonical_shop(cleaned: Column, aliases: tuple[tuple[str, str], ...] = SHOP_ALIASES) -> Column:
    """One name for a shop: that of the first alias found in its cleaned name, else the cleaned name."""
    return first_alias(cleaned, list(aliases))


def action_host(*links: Column) -> Column:
    """Host of the first address that isn't on the social network; "" without one."""
    hosts = F.array(*[urls.host(u) for u in links])
    return F.coalesce(F.get(F.filter(hosts, lambda h: (h != "") & ~h.rlike(SOCIAL_HOST)), F.lit(0)), F.lit(""))


def dedupe_key(shop: Column, product: Column, dates: list[Column], host: Column, longest: int = 90) -> Column:
    """shop|product|when: what makes two records the same. shop and product are cleaned; the first filled date, else the host."""
    return F.concat_ws("|", shop, F.left(product, F.lit(longest)), non_empty(*dates, host))


#: Entered records: output field -> (input fields in order of preference, longest).
ENTERED = {
    "shop": (("shop",), 100), "product": (("product",), 200), "area": (("area",), 20), "applyStartDate": (("applyStartDate",), 10), "applyEndDate": (("applyEndDate", "deadline"), 10),
    "resultStartDate": (("resultStartDate", "resultDate"), 10), "purchaseEndDate": (("purchaseEndDate", "purchaseDeadline"), 10), "memo": (("memo",), 2000),
}
REQUIRED = ("shop", "product", "applyEndDate", "resultStartDate", "url")


def normalise_entered(rows: DataFrame) -> DataFrame:
    """Records that people entered: aliases taken in, texts trimmed and cut to their lengths, an https address as the record's key,
    and `errors`: required fields that are missing. Input columns that are absent count as empty; others pass through."""
    have = set(rows.columns)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    fields = {name: F.left(non_empty(*[text(c) for c in sources]), F.lit(longest)) for name, (sources, longest) in ENTERED.items()}
    fields["area"] = non_empty(fields["area"], F.lit("全国"))
    url = text("url")
    fields["url"] = F.when(url.rlike(r"^https://[^/\s]+"), url).otherwise(F.lit(""))
    rest = [c for c in rows.columns if c not in {*fields, "externalId", "sourceKey", *(s for v, _ in ENTERED.values() for s in v)}]
    out = rows.select(*rest, text("externalId").alias("_id"), text("sourceKey").alias("_key"), *[v.alias(k) for k, v in fields.items()])
    errors = F.array_compact(F.array(*[F.when(F.col(r) == "", F.lit(r)) for r in REQUIRED]))
    linked = F.col("url") != ""
    return out.select(
        *rest, *fields, F.when(linked, F.col("url")).otherwise(F.left("_id", F.lit(160))).alias("externalId"),
        F.when(linked, F.concat(F.lit("url:"), F.col("url"))).otherwise(F.left("_key", F.lit(220))).alias("sourceKey"), errors.alias("errors"),
    )


def is_managed_remote(manual: Column, published: Column, origin: Column, remote_id: Column, external_id: Column, verified: Column, collected: Column, version: Column) -> Column:
    """Whether a record came from the feed: not entered by hand, and marked as remote or carrying a collected id."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    collected_one = (non_empty(external_id) != "") & (yes(verified) | (non_empty(collected) != "") | (F.coalesce(version, F.lit(0)) >= 2))
    return ~(yes(manual) | yes(published)) & ((non_empty(origin) == "remote") | (non_empty(remote_id) != "") | collected_one)


def store_notice(official: Column, link: Column, text: Column, pattern: str = STORE_ONLY) -> Column:
    """Whether an official account's post is a notice only: without an address, or with a lottery at the counter."""
    return F.coalesce(official, F.lit(False)) & ((non_empty(link) == "") | F.coalesce(text, F.lit("")).rlike(pattern))


def app_intent(destination: Column, fields: list[Column], text: Column, patterns: list[str]) -> Column:
    """Whether a record speaks of an application: by its destination, a filled field, or a pattern in its text."""
    return F.coalesce(destination == "app", F.lit(False)) | (non_empty(*fields) != "") | F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def device(agent: Column) -> Column:
    return F.when(agent.rlike("(?i)android"), "android").when(agent.rlike("(?i)iphone|ipad|ipod"), "ios").otherwise("other")


def fallback_link(on: Column, android: Column, ios: Column, general: Column, official: Column) -> Column:
    """Where to go when an application can't be opened: the device's store first, else the site."""
    return F.when(on == "android", non_empty(android, general, official, ios)).when(on == "ios", non_empty(ios, general, official, android)).otherwise(non_empty(official, general, ios, android))


def first_samples(rows: DataFrame, keys: list[str], value: str, order: str, most: int = 3) -> DataFrame:
    """The first `most` values of each key, in order, as an array: a ranked limit before they are gathered."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= most)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda s: s[value]).alias("samples"))


def search_status(sources: Column, failed: Column, links: Column, fetched: Column, fetch_failed: Column, relevant: Column, items: Column) -> Column:
    """How a search over list pages went, the first that holds of eight states."""
    return (
        F.when(sources == 0, "not_configured").when(failed == sources, "search_failed").when(links == 0, "no_candidates").when((fetched == 0) & (fetch_failed > 0), "candidate_fetch_failed")
        .when(relevant == 0, "no_relevant_pages").when(items == 0, "parser_returned_zero").when((failed > 0) | (fetch_failed > 0), "partial").otherwise("ok")
    )


def status_with_search(fatal: Column, warnings: Column, all_failed: Column, broken: Column, search: Column) -> Column:
    """struct(status, reasons): the run's status with the search's; reasons in order."""
    critical = search.isin("search_failed", "candidate_fetch_failed", "parser_returned_zero")
    mild = search.isin("no_candidates", "no_relevant_pages", "partial")
    why = lambda c, text: F.when(c, text)
    reasons = F.array_compact(F.array(why(fatal > 0, F.lit("source_failed")), why(broken > 0, F.lit("official_discovery_broken")), why(critical, F.concat(F.lit("livepocket:"), search)), why(all_failed, F.lit("all_web_sources_failed"))))
    return let(reasons, lambda r: F.struct(F.when(F.size(r) > 0, "partial").when((warnings > 0) | mild, "degraded").otherwise("ok").alias("status"), r.alias("reasons")))


def prune_products(products: DataFrame, managed: Column, plausible: Column) -> DataFrame:
    """Products without those that the collector manages and whose name can't be one."""
    return products.where(~(F.coalesce(managed, F.lit(False)) & ~plausible))


def public_products(products: DataFrame, private: tuple[str, ...] = PRIVATE_PRODUCT_KEYS) -> DataFrame:
    """Products without the columns that stay private."""
    return products.drop(*[c for c in private if c in products.columns])
