"""JSON-LD blocks of a page to flat values.

JSON nests without bound, which no built-in expression walks, so this is the one
function of the audit in Python; it takes and gives Arrow batches and sees only
the blocks, not the pages.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

#: The fields a typed object needs, by type.
REQUIRED = {
    "WebSite": ("name", "url"),
    "Organization": ("name", "url"),
    "SoftwareApplication": ("name", "operatingSystem", "applicationCategory"),
    "Product": ("name", "description"),
    "Article": ("headline", "author"),
    "TechArticle": ("headline", "author"),
    "HowTo": ("name", "step"),
    "ItemList": ("itemListElement",),
    "SearchAction": ("target", "query-input"),
    "Review": ("reviewRating", "author"),
    "Offer": ("price", "priceCurrency"),
    "VideoObject": ("name", "thumbnailUrl"),
    "FAQPage": ("mainEntity",),
    "BreadcrumbList": ("itemListElement",),
}
#: Fields that show that a SoftwareApplication is an application; the last two do not by themselves ask for its other fields.
APP_FIELDS = ("applicationCategory", "operatingSystem", "browserRequirements", "downloadUrl", "installUrl", "featureList", "offers")
KEYS = tuple(sorted({"@type", "datePublished", "dateModified", *APP_FIELDS, *(f for fields in REQUIRED.values() for f in fields)}))
#: A block that nests as deep as this is no JSON for the audit.
DEEPEST = 127
VALUE = "struct<obj:int,block:int,depth:int,key:string,kind:string,value:string>"
TYPE = f"struct<bads:array<int>,vals:array<{VALUE}>>"
_VALUES = pa.list_(pa.struct([("obj", pa.int32()), ("block", pa.int32()), ("depth", pa.int32()), ("key", pa.string()), ("kind", pa.string()), ("value", pa.string())]))
_ROW = pa.struct([("bads", pa.list_(pa.int32())), ("vals", _VALUES)])
_KEYS = frozenset(KEYS)
#: Workers get these functions by value, as they need not have the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _never(name: str) -> None:
    raise ValueError(name)


def block_values(text: str, first: int = 0) -> list[dict] | None:
    """The values of the known keys in all objects of one block, numbered from first; None if the block is no JSON.

    A string has kind ``string``; an array ``array`` and an ``item`` for each
    string in it; null ``null``; all else ``other``.
    """
    try:
        tree = json.loads(text, parse_constant=_never)
        text.encode()
    except (ValueError, RecursionError):
        return None
    found, numbered, stack = [], first, [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, str) and not _encodes(node):
            return None
        if not isinstance(node, (dict, list)):
            continue
        if depth >= DEEPEST:
            return None
        if isinstance(node, list):
            stack.extend((x, depth + 1) for x in node)
            continue
        for key, value in node.items():
            if not _encodes(key):
                return None
            stack.append((value, depth + 1))
            if key in _KEYS:
                kind = "string" if isinstance(value, str) else "array" if isinstance(value, list) else "null" if value is None else "other"
                found.append((numbered, depth, key, kind, value if kind == "string" else None))
                if kind == "array":
                    found.extend((numbered, depth, key, "item", x) for x in value if isinstance(x, str))
        numbered += 1
    return [dict(zip(("obj", "depth", "key", "kind", "value"), row)) for row in found]


def _encodes(text: str) -> bool:
    """Half of a surrogate pair is no text."""
    return not any("\ud800" <= c <= "\udfff" for c in text)


def page_values(blocks: list[str] | None) -> dict:
    """bads: the places of blocks that are no JSON; vals: the values of the others."""
    bads, vals = [], []
    for place, text in enumerate(blocks or []):
        if not text:
            continue
        found = block_values(text, vals[-1]["obj"] + 1 if vals else 0)
        if found is None:
            bads.append(place)
        else:
            vals += [v | {"block": place} for v in sorted(found, key=lambda v: v["obj"])]
    return {"bads": bads, "vals": vals}


def register(spark: SparkSession) -> None:
    @arrow_udf(TYPE)
    def walk_json_ld(blocks: pa.Array) -> pa.Array:
        return pa.array([page_values(b) for b in blocks.to_pylist()], type=_ROW)

    spark.udf.register("walk_json_ld", walk_json_ld)
