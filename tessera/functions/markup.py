"""Front matter and links of Markdown notes.

Covers fences, inline code, comments, escaped brackets, balanced brackets and angle-
bracketed destinations; nested block structure is not parsed.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of files that are no notes.
ASSETS = (
    "png jpg jpeg gif webp svg bmp ico tif tiff pdf mp4 mov webm mkv mp3 wav ogg flac zip gz tar 7z rar docx xlsx pptx doc xls ppt csv json yaml yml toml"
).split()
_HIDDEN = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)|<!--.*?-->|(`+)(?!`).*?(?<!`)\2(?!`)", re.M | re.S)
_WIKI = re.compile(r"(?<![!\\])\[\[([^\]|#\n]+)(?:[|#][^\]\n]*)?\]\]")
_INLINE = re.compile(r"(?<![!\\])\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")


def front_matter(text: str | None) -> tuple[dict, str]:
    """(fields, body); a fence that does not parse as a mapping is taken off and gives no fields."""
    import yaml

    text = (text or "").removeprefix("﻿")
    hit = re.match(r"---[ \t]*\r?\n(.*?\n)??---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not hit:
        return {}, text
    try:
        fields = yaml.safe_load(hit[1] or "")
    except yaml.YAMLError:
        fields = None
    return (fields if isinstance(fields, dict) else {}), text[hit.end() :]


def note_key(raw: str) -> str | None:
    """The note that a destination names; None for other schemes, anchors and assets."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw) or raw.startswith("//"):
        return None
    path = unquote(re.split(r"[#?|]", raw, maxsplit=1)[0]).strip().replace("\\[", "[").replace("\\]", "]").rstrip("/")
    ending = path.rsplit("/", 1)[-1].lower().rpartition(".")
    if not path or (ending[1] and ending[2] in ASSETS):
        return None
    return path[:-3] if path.lower().endswith(".md") else path


def find_links(text: str | None) -> list[tuple[str, bool]]:
    """(target, is a wiki link) of a note's links to notes, in order, without repeats."""
    shown = _HIDDEN.sub(" ", text or "")
    inline = [(m.start(), m.end(), note_key(m[1] if m[1] is not None else m[2]), False) for m in _INLINE.finditer(shown)]
    wiki = [(m.start(), m.end(), note_key(m[1]), True) for m in _WIKI.finditer(shown)]
    inside = lambda at: any(a < at < b for a, b, _, _ in inline)
    found = sorted([*inline, *(w for w in wiki if not inside(w[0]))])
    return list(dict.fromkeys((key, style) for _, _, key, style in found if key))


@F.pandas_udf(T.StructType([T.StructField("fields", T.StringType()), T.StructField("body", T.StringType())]))
def split_front_matter(texts: pd.Series) -> pd.DataFrame:
    """fields (JSON) and body."""
    parts = [front_matter(t) for t in texts]
    return pd.DataFrame({"fields": [json.dumps(f, default=str, ensure_ascii=False) for f, _ in parts], "body": [b for _, b in parts]})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("target", T.StringType()), T.StructField("is_wikilink", T.BooleanType())])))
def links(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"target": k, "is_wikilink": w} for k, w in find_links(t)])
