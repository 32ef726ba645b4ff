"""Fill-in-the-middle transformation of whole texts, and its inverse.

A text is cut into units: a word with the white space before it, or white space at the end. A pandas UDF goes over Arrow
batches; the regex library's matches give the units' end offsets, which a compact array holds, and two lookups in it cut
the text into prefix, middle and suffix. Which units end the prefix and the middle, whether a text is transformed, and
in which form, follow from a digest of the seed and the id alone: the same row gives the same result wherever and
however often it is computed.

Null texts count as empty. Empty texts, and texts that contain one of the marks, stay plain, so that every output can be
told apart again. A text of white space only is one unit. Texts of any length are whole. A null id counts as an empty
one. Repeated rows give repeated results; rows with one id are cut by the same draw, each in its own units. An empty
table gives an empty table. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import bound_batches

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of a seed and a row's id in decimal."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))  # type: ignore[return-value]


def unit_ends(text: str) -> array:
    return array("q", (m.end() for m in _UNIT.finditer(text)))


def transformed(text: str, key: str, *, seed: int, rate: int, spm_rate: int) -> tuple[int, str, str, int | None, int | None]:
    """Number of units, form, output, and the characters of prefix and middle; these are None in plain form."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not n or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", text, None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[lo - 1] if lo else 0, ends[hi - 1] if hi else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def rebuilt(output: str, form: str) -> str:
    """The text of an output; its parts contain no mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, output, prefix_chars, middle_chars, output_sha256) of every row. rate: percent of texts that are transformed; spm_rate: percent of those with the suffix first."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("n long, form string, output string, prefix_chars long, middle_chars long, output_sha256 string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in parts:
            rows = [transformed(t, k, seed=seed, rate=rate, spm_rate=spm_rate) for k, t in zip(keys, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars"])
            out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
            yield out.assign(output_sha256=[_sha256(t) for t in out["output"]])

    source = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return source.select(F.col("id").alias(id_col), cut("key", "text").alias("cut")).select(id_col, "cut.*")


def restored(outputs: DataFrame, *, output_col: str = "output", form_col: str = "form", into: str = "restored") -> DataFrame:
    """outputs with the rebuilt text and its digest, as a struct (text, sha256)."""
    bound_batches(outputs.sparkSession)

    @F.pandas_udf("text string, sha256 string")
    def rebuild(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for done, forms in parts:
            texts = [rebuilt(o, f) for o, f in zip(done, forms, strict=True)]
            yield pd.DataFrame({"text": texts, "sha256": [_sha256(t) for t in texts]})

    return outputs.withColumn(into, rebuild(output_col, form_col))
