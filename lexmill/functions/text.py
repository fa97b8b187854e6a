"""Tokens of a text: as a Column for tables and as a plain function for query strings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.batches import in_parts
from lexmill.functions.stemmer import stem

# The words that the stopword filter removes.
STOPWORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with or not this but they".split()
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class TextOptions:
    """How texts become tokens; stored with an index, and used again for its queries."""

    remove_stopwords: bool = False
    stem: bool = False


def tokenize(text: str | None, options: TextOptions = TextOptions()) -> list[str]:
    """Runs of ASCII letters and digits in lower case; all else separates. Stopwords go before stemming, empty stems after."""
    found = [t.lower() for t in re.findall(TOKEN, text or "")]
    if options.remove_stopwords:
        found = [t for t in found if t not in _STOP]
    return [s for s in map(stem, found) if s] if options.stem else found


_STOP = frozenset(STOPWORDS)


@lru_cache(maxsize=1 << 18)
def _stem(token: str) -> str:
    return stem(token)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(column: pa.Array) -> pa.Array:
    """Stems of lists of tokens: of each part of a batch every distinct token is stemmed once, and workers remember the last ones."""

    def stems_of(part: pa.Array) -> pa.Array:
        flat = part.flatten().dictionary_encode()
        known = pa.array([_stem(t) for t in flat.dictionary.to_pylist()], pa.string())
        stems = known.take(flat.indices)
        kept = np.asarray(pc.not_equal(stems, ""), bool)
        ends = np.concatenate([[0], np.cumsum(kept)])
        bounds = np.concatenate([[0], np.cumsum(np.asarray(part.value_lengths().fill_null(0), np.int64))])
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), stems.filter(pa.array(kept)))

    return in_parts(column, column.value_lengths(), stems_of)


def tokens(text: Column, options: TextOptions = TextOptions()) -> Column:
    """The column twin of tokenize(). Null is an empty text. Lower-casing comes after matching: it would turn some other letters into ASCII ones."""
    out = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    out = F.transform(out, F.lower)
    if options.remove_stopwords:
        out = F.filter(out, lambda t: ~t.isin(STOPWORDS))
    return _stemmed(out) if options.stem else out


def split(texts: pa.Array, options: TextOptions = TextOptions()) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """tokenize() of an Arrow array of texts: numbers of the words of all texts one after another, where each text begins
    and ends among them, and the distinct words that the numbers stand for."""
    texts = pc.ascii_lower(pc.replace_substring_regex(texts.cast(pa.large_string()).fill_null(""), "[^A-Za-z0-9]+", " "))
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    names, numbers, offsets = flat.dictionary, np.asarray(flat.indices, np.int64), np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    keep = np.asarray(pc.not_equal(names, ""), bool)  # blanks at either end of a text leave an empty word
    if options.remove_stopwords:
        keep &= ~np.asarray(pc.is_in(names, pa.array(STOPWORDS, names.type)), bool)
    if options.stem:
        stems = pa.array([_stem(t) for t in names.to_pylist()], pa.string()).dictionary_encode()
        keep &= np.asarray(pc.not_equal(stems, ""), bool)
        numbers_of, names = np.asarray(stems.indices, np.int64), stems.dictionary
    else:
        numbers_of = np.arange(len(names))
    kept = keep[numbers]
    return numbers_of[numbers[kept]], np.concatenate([[0], np.cumsum(kept)])[offsets], names
