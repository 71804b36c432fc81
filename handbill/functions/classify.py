"""Event types and audiences from words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from handbill.functions import vocab
from handbill.functions.text import described, matches, with_low


def infer_type(title: Column, description: Column, default: Column | str = "other", text: Column | None = None) -> Column:
    """The first type whose words occur, else ``default`` if it is a known type, else other. ``text`` is words_text() where a column holds it."""
    return type_or(worded_type(words_text(title, description) if text is None else text), default)


def worded_type(words: Column) -> Column:
    """The first type whose words occur in words_text(), or null. Its many patterns are named in a variable's scope, which is compiled in pieces."""

    def first(text: Column, low: Column, plain: Column) -> Column:
        found = F.lit(None).cast("string")
        for kind, pattern in reversed(vocab.TYPE_PATTERNS):
            found = F.when(matches(text, pattern, low, plain), kind).otherwise(found)
        return found

    return with_low(words, first)


def type_or(found: Column, default: Column | str) -> Column:
    """A type that was found, else ``default`` if it is a known type, else other."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(found, F.when(default.isin(vocab.EVENT_TYPES), default), F.lit("other"))


def words_text(title: Column, description: Column) -> Column:
    """What types are inferred from; best as a column of its own, as each pattern names it."""
    return F.lower(described(title, description))


def infer_all(title: Column, description: Column, text: Column | None = None) -> Column:
    """All types whose words occur, in the order of the patterns. ``text`` is words_text() where a column holds it."""
    every = lambda text, low, plain: F.array(*[F.when(matches(text, p, low, plain), F.lit(k)) for k, p in vocab.TYPE_PATTERNS])
    return F.array_compact(with_low(words_text(title, description) if text is None else text, every))


def final_types(primary: Column, given: Column, inferred: Column) -> Column:
    """An exhibition is only that; else the given types or the primary, then those inferred, the primary at the front if it is lacking.

    ``inferred`` is infer_all(), best as a column of its own: it is named more than once here.
    """
    base = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(F.array(primary))
    more = F.concat(base, F.filter(inferred, lambda x: x != "exhibition"))
    whole = F.array_distinct(F.when(F.array_contains(more, primary), more).otherwise(F.concat(F.array(primary), more)))
    return F.when(primary == "exhibition", F.array(F.lit("exhibition"))).otherwise(whole)


def infer_audience(title: Column, description: Column) -> Column:
    """family and teen, where their words occur; a possessive before "family" doesn't count."""

    def found(text: Column, low: Column, plain: Column) -> Column:
        family = matches(text, vocab.FAMILY_WORDS, low, plain, r"(?<!'s )(?<!s' )")
        return F.array(F.when(family, F.lit("family")), F.when(matches(text, vocab.TEEN_WORDS, low, plain), F.lit("teen")))

    return F.array_compact(with_low(described(title, description), found))


def jsonld_type_hint(kind: Column) -> Column:
    """The event type that a JSON-LD @type hints at."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(low.contains("screen"), "screening").when(low.contains("educat"), "workshop")
        .when(low.contains("exhibition"), "exhibition").when(low.contains("festival"), "fair").otherwise("other")
    )


def is_recurring(title: Column, description: Column) -> Column:
    """Whether title or description names a standing programme."""
    return matches(title, vocab.RECURRING_WORDS) | matches(description, vocab.RECURRING_WORDS)


def types_of(event_types: Column, event_type: Column) -> Column:
    return F.when(F.coalesce(F.size(event_types), F.lit(0)) > 0, event_types).otherwise(F.array(event_type))


def chip_types(chips: list[str]) -> list[str] | None:
    """The types that the chosen chips stand for; None for no restriction."""
    return [t for c in chips for t in vocab.TYPE_CHIPS.get(c, [])] or None


def display_labels(types: Column) -> Column:
    """Distinct display labels, in order: fair and other are both Other, unknown types have none."""
    labels = F.create_map(*[x for t in vocab.EVENT_TYPES for x in (F.lit(t), F.lit("Other" if t in ("fair", "other") else t.capitalize()))])
    return F.array_distinct(F.array_compact(F.transform(types, lambda t: F.try_element_at(labels, t))))
