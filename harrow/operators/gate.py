"""Acceptance with reasons, three-way split, publication: retention, privacy, final validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls
from harrow.functions.text import nfkc, non_empty
from harrow.operators.match import fill_start

#: Hosts of the social network, as the pipeline tests them: any host that ends so.
SOCIAL_HOST = r"x\.com$|twitter\.com$"
#: Keys that no public record carries.
PRIVATE_KEYS = (
    "sourceUrl", "sourceType", "sourceKind", "sourceKinds", "intelligenceSource", "privateSources", "evidenceCount", "destinationHost", "destinationVerified",
    "destinationVerificationReason", "verificationChecks", "rawApplyText", "rawResultText", "xAuthor", "xPostId", "officialAccount", "productCandidates",
    "purchaseStartPolicy", "expandCatalogGroup", "catalogGroupExpandedFrom",
)


def reasons(*rules: tuple[str, Column]) -> Column:
    """array<string> of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]))


def day_end(date: Column, zone: str = "Asia/Tokyo") -> Column:
    """Last second of a YYYY-MM-DD day in the zone, as an instant; null for no date."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(date, F.lit(" 23:59:59")), F.lit("yyyy-MM-dd HH:mm:ss")), zone)


def valid_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


#: The names of the days, Sunday first.
WEEKDAYS = ("日", "月", "火", "水", "木", "金", "土")


def weekday_matches(text: Column, date: Column) -> Column:
    """Whether the last month/day(weekday) of the text is the date; texts without one and bad dates pass."""
    number = r"(\d{1,2})"
    pattern = rf"{number}[/月]{number}日?\s*[（(]([{''.join(WEEKDAYS)}])[)）]"
    part = lambda g: F.element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), g), -1)
    count = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
    day = F.try_to_date(date, "yyyy-MM-dd")
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day))
    same = (part(1).cast("int") == F.month(day)) & (part(2).cast("int") == F.dayofmonth(day)) & (part(3) == name)
    return F.when((count == 0) | ~valid_date(date), F.lit(True)).otherwise(same)


def evaluate(candidates: DataFrame, now: Column, blocked: list[str], past_days: int = 35, future_days: int = 365) -> DataFrame:
    """candidates (catalog_id, applyStartDate, applyEndDate, rawApplyText, url, sourceUrl, sourceKind, officialNotice,
    destinationVerified) with reasons, warnings, accepted and directHost."""
    start, end = F.col("applyStartDate"), F.col("applyEndDate")
    # worked out once, in a projection of their own
    bound = {"_host": urls.host(F.col("url")), "_source_host": urls.host(F.col("sourceUrl")), "_ends": day_end(end), "_end_ok": valid_date(end), "_start_ok": valid_date(start)}
    host, source_host, ends, end_ok, start_ok = (F.col(c) for c in bound)
    aggregated = F.coalesce(F.col("sourceKind").isin("aggregated", "intelligence"), F.lit(False))
    official = F.coalesce(F.col("officialNotice"), F.lit(False))
    is_blocked = urls.host_under(host, blocked)
    own_page = aggregated & (source_host != "") & (host == source_host)
    verified = F.coalesce(F.col("destinationVerified"), F.lit(False))
    why = reasons(
        ("catalog", F.col("catalog_id").isNull()),
        ("deadline", ~end_ok),
        ("order", start_ok & end_ok & (start > end)),
        ("expired", ends < now - F.make_dt_interval(F.lit(past_days))),
        ("far", ends > now + F.make_dt_interval(F.lit(future_days))),
        ("weekday", (F.coalesce(F.col("rawApplyText"), F.lit("")) != "") & ~weekday_matches(F.col("rawApplyText"), end)),
        ("no_host", host == ""),
        ("blocked", is_blocked),
        ("not_direct", ~official & (own_page | is_blocked | host.rlike(SOCIAL_HOST))),
        ("unverified", aggregated & ~official & ~verified),
    )
    recheck = reasons(("recheck", ~aggregated & (F.col("destinationVerified") == F.lit(False))))
    judged = candidates.withColumns(bound).withColumns({"directHost": host, "reasons": why, "warnings": recheck})
    return judged.withColumn("accepted", F.size("reasons") == 0).drop(*bound)


#: Kinds of sources whose destinations have to be verified, and reasons that reject for good.
INTELLIGENCE = ("aggregated", "intelligence", "x")
HARD = "^(?:expired|far|order|weekday)$"


def decide(candidates: DataFrame, matches: DataFrame, verified: DataFrame, now: Column, blocked: list[str], votes: DataFrame | None = None, key: str = "key", least: float = 0.8, floor: float = 0.86) -> DataFrame:
    """What becomes of candidates, through both gates: status (published, review, rejected), product and productCatalogId as published,
    purchaseStartDate, destinationVerified, confidence, reasons, catalogMatched, directVerified.

    candidates: key, sourceKind, manualEntry, noticeOnly, officialAccount, officialNotice, shop, product, applyStartDate, applyEndDate,
    resultStartDate, purchaseStartDate, purchaseEndDate, rawApplyText, url, sourceUrl, purchasePolicy (boolean), context (text), confidence.
    matches: key, catalog_id, catalog_name, release (the catalog's product, if any). verified: key, ok (the check of a destination).
    votes: key, accepted, confidence (of models, if they were asked).

    Destinations of aggregated, intelligence and social candidates count as verified by their check, those of others if they have one, official
    notices always. The first gate judges a candidate as it came; one that the catalog knows takes its name and, where it has none, a start
    of purchases, and is judged again. A candidate that is refused and isn't sure can be made sure by votes, and is judged a third time. Manual
    entries with all they need are published whatever the gates say; others of theirs are under review.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    manual = (F.col("sourceKind") == "manual") | flag("manualEntry")
    rows = candidates.join(matches.select(key, "catalog_id", "catalog_name", "release"), key, "left").join(verified.select(key, F.col("ok").alias("_ok")), key, "left")
    intelligence, notice = F.coalesce(F.col("sourceKind").isin(*INTELLIGENCE), F.lit(False)), flag("noticeOnly") & (flag("officialAccount") | flag("officialNotice"))
    checked = F.when(notice, True).when(intelligence, F.when(non_empty(F.col("url")) != "", F.coalesce("_ok", F.lit(False)))).otherwise(non_empty(F.col("url")) != "")
    first = evaluate(rows.withColumns({"destinationVerified": checked, "officialNotice": notice}), now, blocked)
    known = F.col("catalog_id").isNotNull()
    start = non_empty(F.col("purchaseStartDate"), fill_start(candidates, F.col("release"), F.col("context"), F.col("resultStartDate"), F.col("purchaseEndDate"), F.coalesce(F.col("purchasePolicy"), F.lit(False))))
    renamed = first.drop("reasons", "warnings", "accepted", "directHost").withColumns({"product": F.when(known, F.col("catalog_name")).otherwise(F.col("product")), "purchaseStartDate": F.when(known & ~manual, start).otherwise(F.col("purchaseStartDate"))})
    second = evaluate(renamed, now, blocked).withColumn("_sure", F.coalesce(F.col("confidence"), F.lit(0.0)))
    if votes is not None:
        second = second.join(votes.select(key, F.col("accepted").alias("_yes"), F.col("confidence").alias("_vote")), key, "left")
        asked = ~F.col("accepted") & (F.col("_sure") < least) & F.coalesce(F.col("_yes"), F.lit(False))
        second = second.withColumn("_sure", F.when(asked, F.round(F.greatest("_sure", F.coalesce("_vote", F.lit(0.0))), 2)).otherwise(F.col("_sure")))
    complete = manual_complete(F.col("shop"), F.col("product"), F.col("applyEndDate"), F.col("resultStartDate"))
    status = F.when(manual, F.when(complete, "published").otherwise("review")).otherwise(split_status(F.col("reasons"), HARD))
    why = F.when(manual, F.when(complete, F.array().cast("array<string>")).otherwise(F.array(F.lit("incomplete")))).otherwise(F.col("reasons"))
    sure = F.when(manual & complete, 0.99).when(status == "published", F.round(F.greatest(F.lit(floor), F.col("_sure")), 2)).otherwise(F.col("_sure"))
    direct = ~manual & F.col("destinationVerified") & ~F.exists("reasons", lambda r: r.isin("not_direct", "no_host", "blocked"))
    return second.select(
        *[c for c in candidates.columns if c not in {"product", "purchaseStartDate", "confidence", "officialNotice", "destinationVerified"}], "product", "purchaseStartDate", F.col("catalog_id").alias("productCatalogId"),
        F.when(~manual, F.col("destinationVerified")).alias("destinationVerified"), status.alias("status"), why.alias("reasons"), sure.alias("confidence"), known.alias("catalogMatched"), F.coalesce(direct, F.lit(False)).alias("directVerified"),
    )


def split_status(reasons_col: Column, hard: str, bypass: Column | None = None) -> Column:
    """published, rejected (a reason that matches `hard`) or review; rows of the bypass are published."""
    rejected = F.exists(reasons_col, lambda r: r.rlike(hard))
    status = F.when(F.size(reasons_col) == 0, "published").when(rejected, "rejected").otherwise("review")
    return status if bypass is None else F.when(bypass, F.lit("published")).otherwise(status)


def manual_complete(shop: Column, product: Column, deadline: Column, result: Column) -> Column:
    """Manual records bypass the gate with all four fields."""
    return (non_empty(shop) != "") & (non_empty(product) != "") & (non_empty(deadline) != "") & (non_empty(result) != "")


def keep_relevant(rows: DataFrame, dates: list[str], now: Column, days: int = 35) -> DataFrame:
    """Rows whose first non-empty date ends within the last `days`; rows without a readable date stay."""
    first = non_empty(*[F.col(d) for d in dates])
    ends = day_end(first)
    return rows.where((first == "") | ends.isNull() | (ends >= now - F.make_dt_interval(F.lit(days))))


def public_projection(rows: DataFrame, private: tuple[str, ...] = PRIVATE_KEYS, url_col: str = "url", notice_col: str | None = "noticeOnly") -> DataFrame:
    """Rows without private columns; addresses on social hosts (unless a notice) and bad ones are blanked."""
    notice = F.coalesce(F.col(notice_col), F.lit(False)) if notice_col else F.lit(False)
    host = urls.url_part(F.col(url_col), "host")
    clean = F.when((host == "") | (host.rlike(SOCIAL_HOST) & ~notice), F.lit("")).otherwise(F.col(url_col))
    return rows.withColumn(url_col, clean).drop(*[c for c in private if c in rows.columns])


def description_like(name: Column, patterns: list[str], longest: int = 110, with_prose: int = 42) -> Column:
    """Whether a product name reads like a description: very long, or long with prose in it."""
    text = nfkc(F.coalesce(name, F.lit("")))
    return (F.length(text) >= longest) | ((F.length(text) >= with_prose) & text.rlike("|".join(patterns)))


def assert_publishable(rows: DataFrame, errors: Column, shown: int = 5) -> DataFrame:
    """rows, or a ValueError right here if any row violates the rules: nothing is written then. Reads rows once."""
    bad = rows.select(errors.alias("_e")).where(F.size("_e") > 0).groupBy(F.array_join("_e", ", ").alias("e")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "e").limit(shown).collect()
    if bad:
        raise ValueError("not publishable: " + "; ".join(f"{r['e']} ({r['n']} rows)" for r in bad))
    return rows
