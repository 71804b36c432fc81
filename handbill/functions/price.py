"""Prices as (is_free, price_text): from offers, cost strings and free text. is_free is never false for want of a price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from handbill.functions import vocab
from handbill.functions.text import described, let, matches, with_low

OFFER = "array<struct<price:string,lowPrice:string,highPrice:string,isAccessibleForFree:string>>"


def signal(is_free: Column, price_text: Column) -> Column:
    return F.struct(is_free.cast("boolean").alias("is_free"), price_text.cast("string").alias("price_text"))


def nothing() -> Column:
    return signal(F.lit(None), F.lit(None))


def money(amount: Column) -> Column:
    """Whole amounts without decimals, others with two."""
    return F.when(amount == F.floor(amount), F.concat(F.lit("$"), amount.cast("bigint").cast("string"))).otherwise(F.format_string("$%.2f", amount))


def price_range(amounts: Column) -> Column:
    low, high = F.array_min(amounts), F.array_max(amounts)
    return F.when(low == high, money(low)).otherwise(F.concat(money(low), F.lit("–"), money(high)))


def amounts_in(text: Column) -> Column:
    found = F.when(text.contains("$"), F.regexp_extract_all(text, F.lit(vocab.PRICE), 1)).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.transform(found, lambda x: x.cast("double"))


def parse_offers(offers: Column) -> Column:
    """From a JSON-LD offers text, an object or a list of them."""
    parsed = F.from_json(offers, OFFER)
    bare = lambda x: F.trim(F.replace(F.replace(x, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))).try_cast("double")

    def read(parsed: Column) -> Column:
        amounts = F.array_compact(F.flatten(F.transform(parsed, lambda o: F.array(bare(o["price"]), bare(o["lowPrice"]), bare(o["highPrice"])))))
        told = F.coalesce(F.exists(parsed, lambda o: F.coalesce(F.lower(F.trim(o["isAccessibleForFree"])).isin("true", "1", "yes"), F.lit(False))), F.lit(False))
        return let(F.struct(amounts.alias("amounts"), told.alias("told")), judged)

    def judged(x: Column) -> Column:
        amounts, told = x["amounts"], x["told"]
        low, high, some = F.array_min(amounts), F.array_max(amounts), F.coalesce(F.size(amounts), F.lit(0)) > 0
        free = F.when(some & (high == 0), F.lit(True)).when(told, F.lit(True)).when(some & (low == 0), F.lit(False))
        text = F.when(some & (high != 0), price_range(amounts)).when(F.coalesce(free, F.lit(False)), F.lit("Free"))
        return signal(free, text)

    return let(parsed, read)


def parse_cost(cost: Column) -> Column:
    """From a cost text such as "Free" or "$10 – $25"."""

    def read(x: Column) -> Column:
        amounts = x["amounts"]
        some = F.size(amounts) > 0
        free = F.lower(x["bare"]).isin(vocab.FREE_COSTS) | (some & (F.array_max(amounts) == 0))
        return F.when(free, signal(F.lit(True), F.lit("Free"))).when(some, signal(F.lit(None), price_range(amounts))).otherwise(nothing())

    parts = lambda bare: F.struct(bare.alias("bare"), amounts_in(bare).alias("amounts"))
    return let(let(F.trim(F.coalesce(cost, F.lit(""))), parts), read)


def infer_price(title: Column, description: Column) -> Column:
    """From words: a phrase for free admission, else amounts, else the word free."""
    free = signal(F.lit(True), F.lit("Free"))

    def read(text: Column, low: Column, plain: Column) -> Column:
        said = lambda pattern: matches(text, pattern, low, plain)
        worded = let(amounts_in(text), lambda a: F.when(F.size(a) > 0, signal(F.lit(None), price_range(a))).when(said(vocab.FREE_WORD) & ~said(vocab.PAID_HINT), free).otherwise(nothing()))
        return F.when(said(vocab.FREE_PHRASE) & ~said(vocab.PAID_HINT), free).otherwise(worded)

    return with_low(described(title, description), read)


def resolve_price(title: Column, description: Column, is_free: Column, price_text: Column, offers: Column, cost: Column) -> Column:
    """What is given, else offers, else cost, else words: each only while both outputs are null."""
    unset = lambda s: s["is_free"].isNull() & s["price_text"].isNull()
    # Each reading is named by a variable: its condition and what is kept of it don't make it anew.
    later = lambda found, given, parsed: let(found, lambda f: F.when(unset(f) & given.isNotNull(), parsed).otherwise(f))
    found = signal(is_free, price_text)
    for given, parsed in ((offers, parse_offers(offers)), (cost, parse_cost(cost)), (F.lit(""), infer_price(title, description))):
        found = later(found, given, parsed)
    free = lambda f: F.when(f["is_free"].isNull() & (f["price_text"] == "Free"), F.lit(True)).otherwise(f["is_free"])
    return let(found, lambda f: signal(free(f), f["price_text"]))
