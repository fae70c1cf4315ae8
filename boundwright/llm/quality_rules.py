"""Quality rules: counts of words, symbols and repetition, then compression bands.

The verdict beyond the base rules comes from zstandard ratios (bytes before over bytes after) of the
whole document and of each of its fixed chunks. A ratio above the band is repetitive text, one below it
is incompressible (encoded or random) text; the band depends on the length of the piece, because a short
piece carries the format's overhead and shares less with itself.

Everything is per document, so nothing is shuffled.

Defined results: a null or empty text has no words, all counts 0, ratios 0, fails the base rules and is
not kept. Repeated rows each get their row; texts of any length are taken whole, in chunks of CHUNK bytes; a ratio on a
band's edge is within it; an empty table gives an empty one; `kept` returns the columns it was given, and the
query reads doc_id and text alone.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table

LEVEL = 3
CHUNK = 4096
#: Pieces of up to so many bytes: least and greatest ratio.
BANDS = ((256, 0.0, 3.0), (1024, 1.1, 3.0), (4096, 1.3, 3.5), (16384, 1.4, 4.0), (float("inf"), 1.4, 5.0))
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, low_chunk double, high_chunk double, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words that the text has more than once."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, upto = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 3 - max(at, upto)
            upto = at + 3
    return covered


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def in_band(size: int, ratio: float) -> bool:
    least, most = next((low, high) for upto, low, high in BANDS if size <= upto)
    return least <= ratio <= most


def judge(text: str | None, squeeze) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    ratio = low = high = 0.0
    fits = True
    if data:
        ratio = low = high = len(data) / len(squeeze(data))
        fits = in_band(len(data), ratio)
        if len(data) > CHUNK:
            pieces = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
            ratios = [len(x) / len(squeeze(x)) for x in pieces]
            low, high = min(ratios), max(ratios)
            fits = fits and all(in_band(len(x), r) for x, r in zip(pieces, ratios, strict=True))
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, ratio, low, high, not failed and fits


def verdict(text: str | Column) -> Column:
    """The counts, the ratios and whether to keep a text, as a struct."""

    @F.pandas_udf(SCHEMA)
    def rules(texts: pd.Series) -> pd.DataFrame:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [judge(x, squeeze) for x in texts]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return rules(text)


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they had."""
    bounded_batches(docs.sparkSession)
    return docs.filter(verdict(text)["kept"])


def op7_compression_bands(spark, sf_dir: str) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", verdict("text").alias("v")).select("doc_id", "v.*")


QUERIES = {"op7_compression_bands": op7_compression_bands}
