"""Nested JSON to any depth: the JSON-LD scripts of a page, opened within its row.

SQL functions copy all that lies below a node at each level they open. So a page is read
once, by Python's parser in the page's task, and only what is asked of its objects leaves it;
nothing is written or shuffled on the way. Text that is no JSON, names a field of an object
twice or nests deeper than DEEPEST gives no objects.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.functions import vocab
from handbill.sources import storage

LD_SCRIPT = re.compile(r"""(?is)<script[^>]*type=["']?application/ld\+json["']?[^>]*>([^<]*+(?:<(?!/script>)[^<]*+)*+)</script>""", re.ASCII)
#: What a sample of an object shows, and characters of it.
SAMPLE_KEYS = ("@type", "name", "startDate", "endDate", "url", "location", "description", "image", "performer")
SAMPLE_CHARS = 1500
#: Levels of a text that counts as JSON.
DEEPEST = 1000
#: The field that lists of objects stand under; where only it is opened, other fields aren't.
GRAPH = ("@graph",)
Found = Iterator[tuple[tuple[int, ...], str, dict]]


def number(told: str) -> float | int | str:
    """A number with a point or an exponent, without zeros at its end; its text if a double would change it."""
    if "e" in told or "E" in told:
        return value if math.isfinite(value := float(told)) else "Infinity" if value > 0 else "-Infinity"
    plain = told.rstrip("0").removesuffix(".")
    return plain if "." in plain and repr(float(plain)) != plain else float(plain) if "." in plain else int(plain)


def fields_of(pairs: list[tuple[str, object]]) -> dict:
    fields = dict(pairs)
    if len(fields) < len(pairs):
        raise ValueError("a field twice")
    return fields


def no_json(told: str) -> None:
    raise ValueError(told)


decoder = json.JSONDecoder(object_pairs_hook=fields_of, parse_float=number, parse_constant=no_json)
encoder = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def is_open(value: object) -> bool:
    return type(value) is dict or type(value) is list


def deeper(value: dict | list, levels: int) -> bool:
    level = [value]
    for _ in range(levels):
        level = [v for x in level for v in (x.values() if type(x) is dict else x) if is_open(v)]
    return bool(level)


def read(told: str) -> dict | list | None:
    """The object or list that a text begins with."""
    try:
        value = decoder.raw_decode(told.lstrip(" \t\r\n"))[0]
    except (ValueError, RecursionError):
        return None
    # No text is deeper than it has brackets.
    return value if is_open(value) and (told.count("[") + told.count("{") <= DEEPEST or not deeper(value, DEEPEST)) else None


def objects_in(page: str, opened: tuple[str, ...] | None = None) -> Found:
    """(place, path, object) of all objects of a page's scripts that lists and ``opened`` fields, or any, lead to, in their order.

    ``place`` is the script's number and the node's position at each depth, fields by their names;
    ``path`` names the keys on the way, [] for any item of a list.
    """
    for n, told in enumerate(LD_SCRIPT.findall(page)):
        root = read(told)
        waiting = [] if root is None else [((n,), "$", root)]
        while waiting:
            place, path, value = waiting.pop()
            if type(value) is dict:
                yield place, path, value
                names = sorted(value) if opened is None else [k for k in opened if k in value]
                inner = [((*place, i), f"{path}.{k}", v) for i, k in enumerate(names) if type(v := value[k]) is dict or type(v) is list]
            else:
                inner = [((*place, i), path + "[]", v) for i, v in enumerate(value) if type(v) is dict or type(v) is list]
            waiting += reversed(inner)


def shown(value: object) -> str:
    """A text as it is, other values as JSON; half of a pair of surrogates, which no text can hold, as "?"."""
    told = value if type(value) is str else encoder.encode(value)
    return told if told.isascii() else told.encode("utf-8", "replace").decode()


def types_of(value: dict) -> list[str]:
    """The @type texts of an object, one or a list of them."""
    found = value.get("@type")
    return [shown(t) for t in (found if type(found) is list else [found]) if t is not None]


@lru_cache(4096)
def names_event(kind: str) -> bool:
    """Whether a type is one of events, whatever its case and what comes before its name."""
    return re.sub("^schema:", "", re.sub("^.*/", "", kind.lower())) in vocab.JSONLD_EVENT_TYPES


def is_event(value: dict) -> bool:
    return any(map(names_event, types_of(value)))


def of_page(body: Column, made: Callable[[Found], object], kind: str, shape: pa.DataType, opened: tuple[str, ...] | None = None) -> Column:
    """What ``made`` makes of the objects of each page, of Spark's type ``kind``; of none for a page that is null."""

    @F.arrow_udf(kind)
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([made(objects_in(page or "", opened)) for page in pages.to_pylist()], type=shape)

    return run(body)


def event_texts(found: Found) -> list[str]:
    return [shown(x) for _, _, x in found if is_event(x)]


def events_of(documents: DataFrame, *keys: str) -> DataFrame:
    """(*keys, seq, node): the events in the JSON-LD scripts of pages, as JSON text, in the order of each page.

    Lists and @graph are opened however deep they nest, other fields aren't.
    """
    storage.ship(documents.sparkSession)
    nodes = of_page(F.col("body"), event_texts, "array<string>", pa.list_(pa.string()), GRAPH)
    return documents.select(*keys, F.posexplode(nodes).alias("seq", "node"))


def count_events(found: Found) -> tuple[int, int]:
    events = [is_event(x) for _, _, x in found]
    return len(events), sum(events)


def counts_of(documents: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, n_objects, n_events): how many objects lists and @graph lead to in the JSON-LD of each source that has any, and how many are events."""
    storage.ship(documents.sparkSession)
    shape = pa.struct([("n_objects", pa.int64()), ("n_events", pa.int64())])
    each = documents.select(source, of_page(F.col("body"), count_events, "struct<n_objects:bigint,n_events:bigint>", shape, GRAPH).alias("_n"))
    return each.groupBy(source).agg(F.sum("_n.n_objects").alias("n_objects"), F.sum("_n.n_events").alias("n_events")).where("n_objects > 0")


def count_types(found: Found) -> list[tuple[str, str, int]]:
    counts = Counter((path, t) for _, path, x in found for t in types_of(x))
    return [(shown(path), t, n) for (path, t), n in counts.items()]


def types_by_path(documents: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, path, type, n): how often each @type stands where in the JSON-LD of each source, in objects of any depth."""
    storage.ship(documents.sparkSession)
    shape = pa.list_(pa.struct([("path", pa.string()), ("type", pa.string()), ("n", pa.int64())]))
    each = documents.select(source, F.explode(of_page(F.col("body"), count_types, "array<struct<path:string,type:string,n:bigint>>", shape)).alias("_at"))
    return each.groupBy(source, F.col("_at.path").alias("path"), F.col("_at.type").alias("type")).agg(F.sum("_at.n").alias("n"))


def types_and_first(found: Found) -> tuple[list[str], tuple[int, ...] | None, str | None]:
    kinds, place, sample = {}, None, None
    for at, _, x in found:
        types = types_of(x)
        kinds.update(dict.fromkeys(types))
        if place is None and any("event" in t.lower() for t in types):
            place, sample = at, shown({k: x[k] for k in SAMPLE_KEYS if k in x})[:SAMPLE_CHARS]
    return list(kinds), place, sample


def types_and_sample(body: Column) -> Column:
    """(types, place, sample): the types of a page's objects, each once, and its first object that has "event" in one, its telling fields as JSON, cut."""
    shape = pa.struct([("types", pa.list_(pa.string())), ("place", pa.list_(pa.int32())), ("sample", pa.string())])
    return of_page(body, types_and_first, "struct<types:array<string>,place:array<int>,sample:string>", shape)
