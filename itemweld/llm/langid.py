"""Language identification by compression.

Per language a raw-content zstandard dictionary is filled with text of that
language; a text is encoded with each of them and belongs to the language whose encoding
is smallest. Narrow margins are rejected.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F, Window

CHUNK = 4096        # characters encoded at once, so that a long text doesn't become its own dictionary
LEVEL = 6
SHORT, SHORT_LEVEL = 600, 12   # texts of few characters leave few bytes to tell by: a closer search for them
UNKNOWN = "und"
MIN_MARGIN = 0.005  # below it (as a share of the runner-up's size) a text is rejected


def learn(docs: DataFrame, *, text="text", lang="lang", key="doc_id", per_language=600, excerpt=300) -> dict:
    """{language: dictionary bytes} from the labelled rows of ``docs``.

    The sample is bounded: per language the ``per_language`` rows with the lowest hash of
    their key give one excerpt of ``excerpt`` characters each, at a hashed place of the text.
    Rows without text or language are left out; no rows give no languages.
    """
    rows = (docs.select(F.lower(F.col(text).cast("string")).alias("t"), F.col(lang).cast("string").alias("l"),
                        F.xxhash64(F.col(key)).alias("h"))
                .where("l IS NOT NULL AND length(t) > 0"))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - excerpt, F.lit(0)) + 1).cast("int") + 1
    cut = rows.select("l", "h", F.substring("t", place, F.lit(excerpt)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    picked = cut.withColumn("r", rank).where(F.col("r") <= per_language).select("l", "t").collect()
    out = {}
    for language, sample in sorted((r[0], r[1]) for r in picked):
        out.setdefault(language, []).append(sample)
    return {k: "\n".join(v).encode() for k, v in sorted(out.items())}


def packer(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


def sizes(texts, packers, short_packers, chunk=CHUNK) -> np.ndarray:
    """Encoded bytes of every text (lower case, whole, chunk by chunk) per language."""
    out = np.zeros((len(texts), len(packers)), np.int64)
    for i, t in enumerate(texts):
        use = short_packers if len(t) < SHORT else packers
        for a in range(0, len(t), chunk):
            part = t[a:a + chunk].encode()
            for j, p in enumerate(use):
                out[i, j] += len(p.compress(part))
    return out


def identify(docs: DataFrame, dictionaries: dict, *, text="text", min_margin=MIN_MARGIN) -> DataFrame:
    """``docs`` with one more column ``language``: struct(lang_pred string, score double,
    margin double, accepted boolean).

    A text that is null or has no letter, or any text when no language was learned, is
    ``und`` with score 0 and not accepted. Ties go to the language first in
    alphabetical order, with margin 0. The margin is the share by which the smallest encoding
    is below the runner-up's; with a single language it is 1. score = margin / (margin + 0.02).
    An input column called ``language`` is replaced.
    """
    names, raws = list(dictionaries), list(dictionaries.values())
    schema = "struct<lang_pred:string,score:double,margin:double,accepted:boolean>"

    def best(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packers, short = ([packer(raw, level) for raw in raws] for level in (LEVEL, SHORT_LEVEL))
        for column in parts:
            texts = [t.lower() if t is not None and any(map(str.isalpha, t)) else "" for t in column]
            none = np.array([not t for t in texts]) | (not names)
            if not names:
                winner, margin = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                s = sizes(texts, packers, short)
                winner = s.argmin(1)
                low = np.take_along_axis(s, winner[:, None], 1)[:, 0]
                second = np.partition(s, 1, 1)[:, 1] if len(names) > 1 else np.full(len(s), np.inf)
                margin = np.where(none, 0.0, 1 - low / np.maximum(second, 1))
            yield pd.DataFrame({"lang_pred": [UNKNOWN if n else names[w] for n, w in zip(none, winner)],
                                "score": margin / (margin + 0.02), "margin": margin,
                                "accepted": ~none & (margin >= min_margin)})

    return docs.withColumn("language", F.pandas_udf(best, schema)(F.col(text).cast("string")))
