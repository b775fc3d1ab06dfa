"""Metadata blocks: as JSON, and their tags. Both need PyYAML."""

from __future__ import annotations

import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import markdown as M

#: The loaders of libyaml where it is there: the same results, faster.
BASE = getattr(yaml, "CBaseLoader", yaml.BaseLoader)
#: What an unquoted scalar of the core schema is that is no string.
NOT_STRING = r"^(?:|~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"
#: A line that needs no parser: a key with one plain value, or with a list of such.
SIMPLE = r"^(?:[ \t]*|[A-Za-z_][A-Za-z0-9_-]*:[ \t]+(?:[\p{L}\p{N}_][\p{L}\p{N}_ ./-]*|\[[\p{L}\p{N}_ ,./-]*\])[ \t]*)$"
ODD = r"[\[,][ \t]*,|\[[ \t]*-|,[ \t]*-"


def _json(block: str) -> str | None:
    try:
        return json.dumps(yaml.load(block, Loader=BASE), ensure_ascii=False)
    except yaml.YAMLError:
        return None


def _listed(node) -> list[str]:
    """Strings of a scalar or of a list of scalars."""
    items = node.value if isinstance(node, yaml.SequenceNode) else [node]
    return [x.value.strip() for x in items if isinstance(x, yaml.ScalarNode) and (x.style or not re.match(NOT_STRING, x.value))]


def _tags(block: str) -> list[str]:
    try:
        root = yaml.compose(block, Loader=BASE)
    except yaml.YAMLError:
        return []
    held = {k.value: v for k, v in root.value if isinstance(k, yaml.ScalarNode)} if isinstance(root, yaml.MappingNode) else {}
    return [t for key in ("tags", "tag") if key in held for t in _listed(held[key]) if t]


@F.pandas_udf(StringType())
def _to_json(blocks: pd.Series) -> pd.Series:
    return blocks.map(_json, na_action="ignore").astype(object)


@F.pandas_udf(ArrayType(StringType()))
def _to_tags(blocks: pd.Series) -> pd.Series:
    return blocks.map(_tags, na_action="ignore").astype(object)


def parse(notes: DataFrame) -> DataFrame:
    """Adds ``meta``, the metadata block as JSON text; null if there is none or it is invalid."""
    return notes.withColumn("meta", _to_json("frontmatter"))


def tags(meta: Column) -> Column:
    """The block's tags. Simple blocks are read in place; the others that speak of tags go through the parser."""
    simple = F.forall(F.split(meta, r"\r?\n"), lambda x: x.rlike(SIMPLE) & ~x.rlike(ODD))
    read = F.filter(M.metadata_tags(meta), lambda t: ~t.rlike(NOT_STRING))
    parsed = _to_tags(F.when(~simple & meta.contains("tag"), meta))
    return F.when(simple, read).otherwise(F.coalesce(parsed, F.array().cast("array<string>")))
