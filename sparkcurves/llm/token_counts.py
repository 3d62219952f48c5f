"""Token counts of fields and sections from one encoding of the whole document.

A document's fields are laid one after the other with a separator between them and encoded once, as one text, so counts add up to what a model
will see; encoding parts by themselves would give other tokens at their edges. Each token's bytes are known from the vocabulary, which maps
tokens to spans of the text. Spans of tokens and of sections are both in order, so they meet in one interval join per document.

Rule for a token that crosses an edge: it belongs as a whole to the section that holds most of its bytes, and of two with as many to the first. Tokens,
or parts of tokens, in a separator between fields belong to the field before it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurves.llm import shared as S
from sparkcurves.llm import tokens as K

RULES = ("most", "first", "share")


def attribute(sizes: np.ndarray, edges: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section. `sizes` are the bytes of the tokens of one text in order; section i is edges[i] <= byte < edges[i + 1].

    "most": a token counts where most of its bytes are, ties to the first section. "first": where its first byte is. "share": by share of its bytes.
    Sections may be empty; they get no tokens. Tokens without bytes count where the next byte is.
    """
    n = len(edges) - 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.maximum(np.searchsorted(edges, ends, "left") - 1, first)
    first, last = np.clip(first, 0, n - 1), np.clip(last, 0, n - 1)
    crossing = first != last
    crossed = np.bincount(first[crossing], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossed
    counts = np.bincount(first[~crossing], minlength=n).astype(float)
    for i in np.flatnonzero(crossing).tolist():
        own = np.arange(first[i], last[i] + 1)
        held = np.minimum(edges[own + 1], ends[i]) - np.maximum(edges[own], starts[i])
        if rule == "share":
            counts[own] += held / sizes[i]
        else:
            counts[own[held.argmax()]] += 1
    return counts, crossed


def count_tokens(documents: DataFrame, fields: Sequence[str] = ("text",), doc_id: str = "doc_id", section: str | None = "\n", joiner: str = "\n",
                 rule: str = "most", vocabulary: str | None = None) -> DataFrame:
    """documents(doc_id, fields...) -> doc_id, field, section, start, length, tokens, crossing, doc_tokens: one row per section of each field of each row.

    The fields are joined by `joiner` and encoded once. A section ends with the `section` string (None: a field is one section); its end belongs
    to it. `start` and `length` are bytes of the field's UTF-8 text, `tokens` the tokens that `rule` gives the section, `crossing` how many of the
    tokens that start in it reach beyond it, `doc_tokens` all of the row's. Tokens of a row's sections add up to doc_tokens. A null field is an
    empty one; an empty field has one empty section. Rows that repeat are counted each by itself; a null doc_id stays null. An empty table
    gives an empty result. Columns that are not named are ignored, whatever they are called.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or K.vocabulary_path()
    names = list(fields)
    rows = S.pick(documents, doc_id=doc_id, **{f"f{i}": name for i, name in enumerate(names)})
    texts = rows.select("doc_id", *[S.whole_text(f"f{i}").alias(f"f{i}") for i in range(len(names))])
    texts = texts.select("doc_id", F.concat_ws(joiner, *[f"f{i}" for i in range(len(names))]).alias("whole"),
                         F.array(*[F.octet_length(f"f{i}").cast("long") for i in range(len(names))]).alias("sizes"))
    mark, gap = section.encode() if section else None, len(joiner.encode())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = K.encoder(path)
        whole = batch.column("whole")
        ids, at = encoder.encode(whole)
        token_bytes = encoder.sizes[ids]
        data, offsets = S.text_buffer(whole)
        raw = data.tobytes()
        out: dict[str, list] = {x: [] for x in ("row", "field", "section", "start", "length", "tokens", "crossing", "doc_tokens")}
        for i, sizes in enumerate(batch.column("sizes").to_pylist()):
            edges, field, number, begin = [0], [], [], []
            place = 0
            for f, size in enumerate(sizes):
                cuts = _cuts(raw, offsets[i] + place, size, mark)
                for j, cut in enumerate(cuts):
                    field.append(f), number.append(j), begin.append(edges[-1] - place if j else 0)
                    edges.append(place + cut)
                if f < len(sizes) - 1:  # what joins two fields counts for the first
                    edges[-1] += gap
                place += size + gap
            counts, crossed = attribute(token_bytes[at[i] : at[i + 1]], np.array(edges), rule)
            lengths = np.diff(edges)
            for f in range(len(sizes) - 1):
                lengths[np.flatnonzero(np.array(field) == f)[-1]] -= gap
            out["row"].append(np.full(len(field), i)), out["field"].append(field), out["section"].append(number), out["start"].append(begin)
            out["length"].append(lengths), out["tokens"].append(counts), out["crossing"].append(crossed)
            out["doc_tokens"].append(np.full(len(field), at[i + 1] - at[i]))
        flat = {x: np.concatenate(v) for x, v in out.items()}
        return pa.record_batch({
            "doc_id": batch.column("doc_id").take(pa.array(flat["row"].astype(np.int64))), "field": pa.array(names, pa.string()).take(pa.array(flat["field"].astype(np.int64))),
            **{x: pa.array(flat[x].astype(np.int64)) for x in ("section", "start", "length")}, "tokens": pa.array(flat["tokens"].astype(float)),
            **{x: pa.array(flat[x].astype(np.int64)) for x in ("crossing", "doc_tokens")}})

    kind = documents.schema[doc_id].dataType.simpleString()
    return S.map_arrow(texts, S.arrow_map(run), f"doc_id {kind}, field string, section long, start long, length long, tokens double, crossing long, doc_tokens long")


def _cuts(raw: bytes, start: int, size: int, mark: bytes | None) -> list[int]:
    """Ends of a field's sections, counted from the field's start."""
    if not mark or not size:
        return [size]
    parts = raw[start : start + size].split(mark)
    ends = np.cumsum([len(p) + len(mark) for p in parts])
    ends[-1] -= len(mark)
    ends = ends.tolist()
    return ends[:-1] if len(ends) > 1 and not parts[-1] else ends  # a text that ends with the mark has no empty section after it
