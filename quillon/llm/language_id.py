"""Language identification by rank-order profiles.

A profile is a language's ``TOP`` most frequent n-grams (one to three symbols)
in order.  Letters, in lower case, are symbols; whatever is between them is one
boundary symbol.  A document's own ``TOP`` n-grams are ranked in the same way
and compared to each profile: every n-gram adds the distance between its two
places, or ``TOP`` if the profile lacks it (out-of-place distance).  The least
distance wins; ties go to the alphabetically first language.  Equal counts are
ranked by n-gram hash (48 bits).

The score is ``1 - distance / (TOP * n)`` for a document with n ranked n-grams:
1 for a text ranked just as the profile, 0 for one that shares nothing.

Null texts and texts without a letter are ``und`` with score 0, as is all if
nothing was learned.  Null doc_ids are kept and count as not held out.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace, unused
from ._words import CHUNK_BYTES, chunks, mix64, text_buffers

TOP = 300
LONGEST = 3
#: Distinct n-grams that a task gathers before it sends their counts.
GATHERED = 1 << 20
_symbols = None


def _table() -> np.ndarray:
    """Lower-case symbol of each code point, 0 if it isn't a letter."""
    global _symbols
    if _symbols is None:
        _symbols = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                _symbols[i] = ord(low) if len(low) == 1 else i
    return _symbols


def _grams(texts: list[str | None]):
    """(document, 48-bit n-gram hash) as sorted keys document << 48 | hash."""
    points = np.frombuffer("\n".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts) + 1), np.r_[lengths + 1, 1])  # the boundary before a text is its own
    symbols = _table()[points].astype(np.uint64)
    keep = np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]
    symbols, doc = symbols[keep], doc[keep]
    letter = symbols != 0
    keys = []
    for n in range(1, min(LONGEST, len(symbols)) + 1):
        code = np.zeros(len(symbols) - n + 1, np.uint64)
        some = np.zeros(len(code), bool)
        for k in range(n):
            code = (code << np.uint64(21)) | symbols[k : k + len(code)]
            some |= letter[k : k + len(code)]
        # an n-gram is of the document of its first letter
        owner = np.where(letter[: len(code)], doc[: len(code)], doc[min(1, n - 1) : min(1, n - 1) + len(code)])
        if n == 3:
            some &= letter[1 : 1 + len(code)]  # a boundary in the middle tells nothing of a word
        hashed = mix64(code + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(16)
        keys.append((owner[some].astype(np.uint64) << np.uint64(48)) | hashed[some])
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    keys.sort()
    return keys


def _counted(keys):
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)])


_LOW = np.uint64((1 << 48) - 1)


def _pieces(batch, text="text", limit=1 << 20):
    _, offsets = text_buffers(batch.column(text))
    texts = batch.column(text).to_pylist()
    for i, j in chunks(offsets, limit):
        yield i, j, texts[i:j]


def learn(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, place): profiles of the languages of docs (text, lang)."""

    def counts(batches):
        held: dict[str, tuple] = {}

        def send():
            for lang, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, j, texts in _pieces(batch):
                own = langs[i:j]
                for lang in set(own):
                    pick = [t for t, x in zip(texts, own) if x == lang]
                    keys = _grams(pick) & _LOW
                    keys.sort()
                    g, n = _counted(keys)
                    if lang in held:
                        g0, n0 = held[lang]
                        both, at = np.unique(np.r_[g0, g], return_inverse=True)
                        g, n = both, np.bincount(at, np.r_[n0, n], len(both)).astype(np.int64)
                    held[lang] = (g, n)
            if sum(len(g) for g, _ in held.values()) > GATHERED:
                yield from send()
        yield from send()

    totals = docs.select("text", "lang").mapInArrow(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("lang", "gram", "place")


def identify(docs: DataFrame, profiles: DataFrame, top: int = TOP, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score, which docs must not have already."""
    if unused(docs.columns, pred, score) != [pred, score]:
        raise ValueError(f"docs have a column {pred} or {score} of their own")
    # a language has at most ``top`` rows
    known = profiles.toPandas()
    langs = sorted(known["lang"].unique())
    grams = np.array(sorted(set(known["gram"])), np.uint64)
    places = np.full((len(grams) + 1, len(langs)), -1, np.int64)
    for lang, gram, place in zip(known["lang"], known["gram"], known["place"]):
        places[np.searchsorted(grams, np.uint64(gram)), langs.index(lang)] = place - 1
    columns = docs.columns

    def rows(batches):
        for batch in batches:
            found, near = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for i, j, texts in _pieces(batch, text, CHUNK_BYTES):
                if not langs:
                    continue
                g, n = _counted(_grams(texts))
                doc = (g >> np.uint64(48)).astype(np.int64)
                order = np.argsort((doc << 32) + ((1 << 31) - np.minimum(n, 1 << 30)), kind="stable")
                doc, g = doc[order], g[order] & _LOW
                place = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
                use = place < top
                doc, g, place = doc[use], g[use], place[use]
                at = np.searchsorted(grams, g)
                at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != g)] = len(grams)
                size = np.bincount(doc, minlength=j - i)
                apart = np.empty((j - i, len(langs)))
                for k in range(len(langs)):
                    there = places[at, k]
                    apart[:, k] = np.bincount(doc, np.where(there < 0, top, np.abs(place - there)), j - i)
                best = apart.argmin(axis=1)
                for d in np.flatnonzero(size).tolist():
                    found[i + d] = langs[best[d]]
                    near[i + d] = max(0.0, 1.0 - apart[d, best[d]] / (top * size[d]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.string()), pa.array(near)], [*columns, pred, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{fields}, `{pred}` string, `{score}` double")


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs.

    Learns from text and lang where crc32(doc_id as text) mod 4 is not 2 only.
    """
    Workspace(docs.sparkSession, "language-id")
    held = F.expr(f"pmod(crc32(coalesce(cast(`{key}` as string), '')), 4) = 2")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    profiles = learn(docs.where("not held_out and lang is not null and text is not null"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).drop("text")
