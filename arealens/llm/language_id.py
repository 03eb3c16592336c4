"""Language ID by compression.

Each language gets a raw-content zstandard dictionary of its own training text.
A text is compressed once with every dictionary; the language whose dictionary
leaves the fewest bytes wins.  ``margin`` is (second - best) / second; texts
whose margin is below ``min_margin`` are rejected.

Defined results
* null text, or text without a letter: language ``und``, score 0, rejected;
* training rows with null text or null language are left out; without any
  training row every text is ``und``;
* equal sizes: the language that sorts first wins, with margin 0 (rejected);
* a single learned language wins every text with margin 1;
* the whole text counts, in blocks of ``BLOCK`` bytes, so very long texts cost
  memory for one block; extra columns pass through untouched (the three result
  columns replace columns of the same name), repeated rows give repeated results.

Training data is a bounded sample, the only bounded part: ``SAMPLE_ROWS`` texts
per language with the smallest seeded hash of ``key``, at most ``SAMPLE_CHARS``
characters of each, cut at ``DICT_BYTES`` bytes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DICT_BYTES = 112_640
SAMPLE_ROWS = 96
SAMPLE_CHARS = 20_000
LEVEL = 6
BLOCK = 8_192
MIN_MARGIN = 0.001
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
RESULT = "lang_pred string, score double, margin double"


def plain(text: str) -> bytes:
    """Lower case, every run of anything but letters as one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def learn(rows: DataFrame, key: Column, text: Column, lang: Column) -> dict[str, bytes]:
    """One dictionary per language from (key, text, lang) of the training rows."""
    usable = rows.select(key.alias("k"), F.substring(text, 1, SAMPLE_CHARS).alias("t"), lang.alias("l")).where(
        "l is not null and t is not null and t rlike '\\\\p{L}'")
    order = Window.partitionBy("l").orderBy("h", "k")
    chosen = (usable.select("k", "l", F.xxhash64(F.col("k"), F.lit(17)).alias("h"))
              .withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_ROWS).select("k", "l", "r"))
    sample = usable.join(F.broadcast(chosen), ["k", "l"]).select("l", "r", "t").distinct().collect()
    texts: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for row in sample:
        texts[row["l"]].append((row["r"], row["t"]))
    learned = {}
    for name in sorted(texts):
        body = b" ".join(plain(t) for _, t in sorted(texts[name]))[:DICT_BYTES]
        if len(body) >= 8:  # the shortest raw-content dictionary there is
            learned[name] = body
    return learned


def _sizes(learned: dict[str, bytes]):
    """A function from a text to its compressed size per language, and the names."""
    import zstandard

    names = sorted(learned)
    makers = []
    for name in names:
        data = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        makers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False,
                                               write_checksum=False, write_dict_id=False))

    def sizes(text: str) -> list[int]:
        body = plain(text)
        blocks = [body[i:i + BLOCK] for i in range(0, len(body), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in makers]

    return names, sizes


def decide(names: list[str], sizes: list[int]) -> tuple[str, float, float]:
    """(language, score, margin) from the sizes, ties to the first name."""
    order = sorted(range(len(names)), key=lambda i: (sizes[i], names[i]))
    best = order[0]
    margin = 1.0 if len(order) == 1 else (sizes[order[1]] - sizes[best]) / sizes[order[1]]
    return names[best], min(1.0, 0.5 + 5 * margin), margin


def classify(spark: SparkSession, learned: dict[str, bytes], text: Column) -> Column:
    """A struct (lang_pred, score, margin) for each text.

    Score is 0.5 at margin 0 and 1 from margin 0.1 on.  The dictionaries are
    broadcast: at most ``DICT_BYTES`` for each learned language."""
    shared = spark.sparkContext.broadcast(learned)

    @pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, sizes = _sizes(shared.value)
        for batch in batches:
            out = [decide(names, sizes(t)) if names and isinstance(t, str) else (UNKNOWN, 0.0, 0.0) for t in batch]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "margin"])

    # Marked so that a filter on the result does not compress the texts a second time.
    return run.asNondeterministic()(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, learned: dict[str, bytes], text: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score, and rejected (null or letterless text, or a narrow margin)."""
    found = classify(docs.sparkSession, learned, F.col(text))
    return (docs.withColumn("__lang", found)
            .withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score"),
                          "rejected": (F.col("__lang.lang_pred") == UNKNOWN) | (F.col("__lang.margin") < min_margin)})
            .drop("__lang"))
