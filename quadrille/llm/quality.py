"""Quality rules: what public vocabularies make of a text, held against bands per language or script."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import guarded, kind_of, slices
from .vocab import TOKENIZER_DIR, pieces, ranks

#: Fertility is taken from the one, fallback and entropy from the other.
WORDS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


@dataclass(frozen=True)
class Band:
    """A document inside all limits stays. The limits of characters a token give way by low or high over the square root of
    the number of tokens, as a short text's mean says less; entropy need not be over `entropy_share` of what so many pieces
    can have at most."""

    min_chars_per_token: float
    max_chars_per_token: float
    low: float
    high: float
    max_fallback: float
    min_entropy: float
    entropy_share: float


#: By language code; then by script; "" is for everything else. The languages' bands are those of fit_bands() for the rows
#: that labels call good (quality 1) at sf0.1; of scripts there are no labelled rows, and their bands are wide ones set by
#: hand. So are the most characters a token (MOST): good prose from elsewhere has more of them than these rows.
MOST = (8.0, 3.0)
BANDS: dict[str, Band] = {
    "en": Band(2.490, 8.0, 5.98, 3.0, 0.093, 6.271, 0.642),
    "fr": Band(2.248, 8.0, 4.05, 3.0, 0.096, 6.109, 0.649),
    "de": Band(2.553, 8.0, 7.38, 3.0, 0.096, 6.222, 0.634),
    "es": Band(2.306, 8.0, 3.55, 3.0, 0.055, 6.080, 0.672),
    "Latin": Band(1.6, 8.0, 6.0, 3.0, 0.10, 5.0, 0.6),
    "Cyrillic": Band(1.0, 6.0, 6.0, 3.0, 0.10, 5.0, 0.6),
    "Han": Band(0.3, 3.0, 1.0, 3.0, 0.75, 5.0, 0.6),
    "": Band(0.2, 8.0, 1.0, 3.0, 0.98, 4.5, 0.5),
}

#: fit_bands() takes at most so many rows of a band; texts from LONG tokens on set the limits, and all the leeway of short ones.
FIT_ROWS, LONG, MARGIN = 5000, 512, 0.25

_SCRIPTS = {
    "Latin": r"[A-Za-zÀ-ɏ]",
    "Cyrillic": r"[Ѐ-ӿ]",
    "Han": r"[぀-ヿ㐀-鿿]",
}
METRICS = "doc_id {kind}, lang string, band string, n_chars long, n_tokens long, chars_per_token double, n_pieces long, fallback_share double, token_entropy double"


def _script(text: str) -> str:
    counts = {k: len(re.findall(p, text)) for k, p in _SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] * 2 > len(text.replace(" ", "")) else ""


def entropy_bits(ids: np.ndarray) -> float:
    """Bits of the distribution of the token ids; 0 for none."""
    if not len(ids):
        return 0.0
    c = np.bincount(ids)
    c = c[c > 0]
    return float(np.log2(len(ids)) - (c * np.log2(c)).sum() / len(ids))


def measure(
    docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", keep: tuple[str, ...] = (),
) -> DataFrame:
    """METRICS of each row of docs under two public vocabularies, and the columns named in keep, as __ql_0 and on.

    band is the language where it has a band, else the script that most of the text is in, else ''. Whole
    texts; map only. A null or empty text has 0 tokens, characters a token and entropy. Null ids and
    languages are carried along, repeated rows each have their row."""
    words, fallback = f"{tokenizer_dir}/{WORDS}", f"{tokenizer_dir}/{PIECES}"
    known = frozenset(BANDS) - set(_SCRIPTS) - {""}
    names = [x.split()[0] for x in METRICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, encode = pieces(fallback), ranks(words).encode_ordinary
        is_byte = np.array([sp.is_byte(i) for i in range(sp.vocab_size())])
        for b in batches:
            langs, rows = b.column(1).to_pylist(), []
            for at, part in slices(b.column(2)):
                texts = ["" if x is None else x for x in part.to_pylist()]
                for i, (t, found) in enumerate(zip(texts, sp.encode(texts, num_threads=1)), at):
                    ids, n = np.array(found, np.int64), len(encode(t))
                    share = float(is_byte[ids].mean()) if len(ids) else 0.0
                    rows.append((langs[i] if langs[i] in known else _script(t), len(t), n, len(t) / n if n else 0.0, len(ids), share, entropy_bits(ids)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)], *b.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *b.schema.names[3:]])

    held = [F.col(f"`{c}`").alias(f"__ql_{i}") for i, c in enumerate(keep)]
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *held
    )
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, METRICS.format(kind=kind_of(docs, id_col)) + "".join(f", __ql_{i} {kinds[f'__ql_{i}']}" for i in range(len(keep))))


def fit_bands(docs: DataFrame, good: DataFrame, rows: int = FIT_ROWS, long: int = LONG, margin: float = MARGIN, tokenizer_dir: str = TOKENIZER_DIR) -> dict[str, Band]:
    """Bands by language from rows known to be good: ids in good.doc_id, of which at most `rows` a band are taken, those with
    the least hashes of the id. The most characters a token are MOST, with its leeway, and not fitted.

    Limits are the extremes of the texts of `long` tokens and over, moved out by `margin` of their distance from the median.
    Leeways are the least with which all shorter texts are inside, and that margin more. Bands without long texts aren't there."""
    ids = good.select("doc_id").where("doc_id is not null").distinct()
    order = W.partitionBy("band").orderBy(F.xxhash64("doc_id"), "doc_id")
    taken = measure(docs.join(ids, "doc_id", "left_semi"), tokenizer_dir).where("n_tokens > 0").withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    by: dict[str, list] = {}
    for r in taken.select("band", "n_tokens", "n_pieces", "chars_per_token", "token_entropy", "fallback_share").collect():
        by.setdefault(r[0], []).append(tuple(r)[1:])
    out: dict[str, Band] = {}
    for band, found in sorted(by.items()):
        n, pieces_, per, bits, share = np.array(found, np.float64).T
        far = n >= long
        if not far.any():
            continue
        mid = np.median(per[far])
        low = per[far].min() - margin * (mid - per[far].min())
        least = bits[far].min() - margin * (np.median(bits[far]) - bits[far].min())
        short = (bits < least) & (pieces_ > 1)
        part = (bits[short] / np.log2(pieces_[short])).min() if short.any() else 1.0
        leeway = (1 + margin) * max(0.0, float(((low - per) * np.sqrt(n)).max()))
        out[band] = Band(*[round(float(x), 3) for x in (low, MOST[0], leeway, MOST[1], share.max() * (1 + margin), least, 1 - (1 - part) * (1 + margin))])
    return out


def reason(bands: dict[str, Band] = BANDS) -> Column:
    """The first limit that a row of measure() breaks, or null: 'empty', 'fallback', 'fertility', 'entropy'."""

    def pick(name: str) -> Column:
        out = F.lit(getattr(bands[""], name))
        for key, band in bands.items():
            if key:
                out = F.when(F.col("band") == key, F.lit(getattr(band, name))).otherwise(out)
        return out

    n, per, root = F.col("n_tokens"), F.col("chars_per_token"), F.sqrt(F.col("n_tokens").cast("double"))
    possible = F.log2(F.greatest(F.col("n_pieces"), F.lit(1)).cast("double"))
    return (
        F.when(n == 0, F.lit("empty"))
        .when(F.col("fallback_share") > pick("max_fallback"), F.lit("fallback"))
        .when((per < pick("min_chars_per_token") - pick("low") / root) | (per > pick("max_chars_per_token") + pick("high") / root), F.lit("fertility"))
        .when(F.col("token_entropy") < F.least(pick("min_entropy"), pick("entropy_share") * possible), F.lit("entropy"))
    )


def quality_rules(docs: DataFrame, bands: dict[str, Band] = BANDS, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """measure() of the rows that break no limit of their band. Texts of any length are judged; README has how many of the
    rows that labels call bad are kept. Rows with a null or empty text are rejected; repeated rows are judged alike; a table
    without rows gives none."""
    return measure(docs, tokenizer_dir).where(reason(bands).isNull())


@guarded
def filter_quality(docs: DataFrame, bands: dict[str, Band] = BANDS, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The rows of docs, with all their columns and no others, that quality_rules() keeps."""
    out = measure(docs, tokenizer_dir, keep=tuple(docs.columns)).where(reason(bands).isNull())
    return out.select(*[F.col(f"__ql_{i}").alias(c) for i, c in enumerate(docs.columns)])
