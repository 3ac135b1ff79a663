"""Token counts of the sections of a text, from one encoding of the whole text.

The tokens of a byte-level vocabulary cover the text's bytes without gaps, so the running sum of their byte lengths is
their offset map; sections are intervals of the same bytes, and the two are joined by binary search. A token that lies in more than
one section goes to one of them by a rule that is named: "majority" (the section with most of its characters, the first of
equal ones), "start" (where it starts) or "end" (where it ends). So the sections' counts add up to the text's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, quoted, strings
from .tokens import byte_lengths, encoded

RULES = ("majority", "start", "end")


def char_index(raw: np.ndarray) -> np.ndarray:
    """Characters that start before each byte offset (0 to the end)."""
    return np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]


def line_bounds(raw: np.ndarray) -> np.ndarray:
    """Byte offsets between lines, from 0 to the end; the line feed belongs to the line that it ends."""
    return np.r_[0, np.flatnonzero(raw == 10) + 1, len(raw)]


def attribute(ends: np.ndarray, bounds: np.ndarray, chars: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a bound). ends: byte offsets at which tokens end; bounds: of sections; sections may be empty, and have no token then
    but for a text without bytes."""
    starts = np.r_[0, ends[:-1]]
    # the last of equal bounds starts the section that has the byte
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.maximum(np.searchsorted(bounds, ends - 1, side="right") - 1, first)
    top = len(bounds) - 2
    first, last = np.minimum(first, top), np.minimum(last, top)
    crosses = first != last
    if rule == "start":
        return first, crosses
    if rule == "end":
        return last, crosses
    out = first.copy()
    for k in np.flatnonzero(crosses):
        at = np.arange(first[k], last[k] + 1)
        lo, hi = np.maximum(bounds[at], starts[k]), np.minimum(bounds[at + 1], ends[k])
        out[k] = at[np.argmax(chars[np.maximum(hi, lo)] - chars[lo])]
    return out, crosses


_LENGTHS: dict[str, np.ndarray] = {}


def _count(rule: str, path: str, parts: bool, names: list[str], with_spans: bool):
    struct = pa.struct([("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        if path not in _LENGTHS:
            _LENGTHS[path] = byte_lengths(path)
        for b, encodings in encoded(batches, 1, path):
            texts = strings(b, 1)
            fields = b.column(2).to_pylist() if parts else None
            totals, counts, crossing, spans = [], [], [], []
            for k, (text, ids) in enumerate(zip(texts, encodings, strict=True)):
                raw = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(_LENGTHS[path][np.frombuffer(ids, "<u4")])
                if len(ends) and ends[-1] != len(raw):
                    raise ValueError("the tokens' bytes don't cover the text: the vocabulary isn't byte-level")
                bounds = np.r_[0, np.cumsum([x or 0 for x in fields[k] or []])] if parts else line_bounds(raw)
                if len(bounds) < 2:
                    bounds = np.array([0, 0])
                chars = char_index(raw)
                section, crosses = attribute(ends, bounds, chars, rule) if len(ends) else (np.zeros(0, np.int64), np.zeros(0, bool))
                totals.append(len(ends))
                counts.append(np.bincount(section, minlength=len(bounds) - 1))
                crossing.append(int(crosses.sum()))
                if with_spans:
                    at = chars[np.r_[0, ends]]
                    spans.append([{"section": int(s), "start": int(x), "end": int(y)} for s, x, y in zip(section, at[:-1], at[1:], strict=True)])
            cols = [b.column(0), pa.array(totals, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(crossing, pa.int64())]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(struct)))
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _schema(id_col: str, kind, with_spans: bool):
    names = [id_col]
    for n in ("n_tokens", "section_tokens", "n_crossing", *(["spans"] if with_spans else [])):
        names.append(fresh(names, n))
    span = T.ArrayType(T.StructType([T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    types = (kind, T.LongType(), T.ArrayType(T.LongType()), T.LongType(), span)
    return names, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=False)])


def count_line_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", with_spans: bool = False) -> DataFrame:
    """One row per row of df: the id, n_tokens, section_tokens (of each line), n_crossing (tokens in more than one line) and, with_spans, each token's section
    and span of characters (a character cut by a token's edge counts to the token that it starts in).

    Null or empty text: no tokens, one section with 0. Null and repeated ids each give a row. An empty table gives an empty one. Extra columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names, schema = _schema(id_col, df.schema[id_col].dataType, with_spans)
    return df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).mapInArrow(_count(rule, tokenizer_path, False, names, with_spans), schema)


def count_field_tokens(df: DataFrame, fields: list[str], tokenizer_path: str, id_col: str, rule: str = "majority", with_spans: bool = False) -> DataFrame:
    """As count_line_tokens, for the fields (columns) of each row, joined without a separator and encoded as one text. A null field is empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names, schema = _schema(id_col, df.schema[id_col].dataType, with_spans)
    cols = [F.coalesce(quoted(f).cast("string"), F.lit("")) for f in fields]
    slim = df.select(quoted(id_col).alias("id"), F.concat(*cols).alias("text"), F.array(*(F.octet_length(c).cast("long") for c in cols)).alias("parts"))
    return slim.mapInArrow(_count(rule, tokenizer_path, True, names, with_spans), schema)
