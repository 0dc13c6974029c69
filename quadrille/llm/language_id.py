"""Language ID: unigram piece models per language, each text scored by the sum over all its segmentations.

The pieces are those of a fixed public vocabulary. A language gives each piece a probability; a word's
probability is the sum over every way to cut it into pieces (forward algorithm), a text's the product over
its words. Probabilities are fitted by expectation maximisation over the same segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kind_of, slices
from .vocab import TOKENIZER_DIR, pieces

PIECES = "piece_bpe_32k.model"

#: The classifier is fitted on at most so many labelled rows of each language, chosen by a hash of the text.
TRAIN_ROWS_PER_LANGUAGE = 150
#: Texts of fewer or more characters are not among them. All texts are scored.
MIN_CHARS, MAX_CHARS = 40, 20_000
EM_ROUNDS = 3
#: Weight of the uniform distribution that each language's pieces are mixed with.
SMOOTHING = 0.02
#: Words up to so many characters are scored together, in arrays; longer ones one by one.
WIDE = 48
_WIDTHS = (8, 12, 20, WIDE + 1)
_HASH, _BUCKETS = 0x9E3779B97F4A7C15, 20


class Pieces:
    """The vocabulary as a lookup of substrings by hash, with byte pieces for characters outside it."""

    def __init__(self, path: str):
        sp = pieces(path)
        self.size = sp.vocab_size()
        self.ids: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
        self.longest = max(map(len, self.ids))
        #: By length: sorted hashes, their ids, and which leading bits of a hash occur.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(2, self.longest + 1):
            own = [(p, i) for p, i in self.ids.items() if len(p) == n]
            if not own:
                continue
            chars = np.frombuffer("".join(p for p, _ in own).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = _step(h, chars[:, k])
            order = np.argsort(h)
            seen = np.zeros(1 << _BUCKETS, bool)
            seen[(h >> np.uint64(64 - _BUCKETS)).astype(np.int64)] = True
            self.tables[n] = (h[order], np.array([i for _, i in own])[order], seen)

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, ids) of the hashes that are pieces of n characters."""
        known, ids, seen = self.tables[n]
        maybe = np.flatnonzero(seen[(h >> np.uint64(64 - _BUCKETS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        hit = known[at] == h[maybe]
        return maybe[hit], ids[at[hit]]

    def characters(self, codes: np.ndarray) -> list[tuple[int, ...]]:
        """The ids of each character: one, or those of its UTF-8 bytes."""
        out = []
        for c in codes.tolist():
            k = self.ids.get(chr(c))
            out.append((k,) if k is not None else tuple(self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")))
        return out

    def spans(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, ids) of each piece in the word, by start; a character that is no piece is its UTF-8 bytes."""
        out, n, ids, most = [], len(word), self.ids, self.longest
        for i in range(n):
            for j in range(i + 1, min(n, i + most) + 1):
                k = ids.get(word[i:j])
                if k is not None:
                    out.append((i, j, (k,)))
                elif j == i + 1:
                    out.append((i, j, tuple(self.byte[b] for b in word[i].encode("utf-8", "surrogatepass"))))
        return out


def _step(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ chars.astype(np.uint64)) * np.uint64(_HASH)
        return x ^ (x >> np.uint64(29))


class Lattices:
    """The segmentations of many words of about the same length: for each start and length, the words that have a
    piece there, and which. Row `size + k` of a table of scores stands for character k where that is no piece."""

    def __init__(self, chars: np.ndarray, lengths: np.ndarray, vocab: Pieces):
        self.n, self.width = chars.shape
        self.lengths, self.vocab = lengths, vocab
        codes, where = np.unique(chars, return_inverse=True)
        where = where.reshape(chars.shape)
        self.single = vocab.characters(codes)
        row = np.array([k[0] if len(k) == 1 else vocab.size + i for i, k in enumerate(self.single)])
        self.spans: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # start, length, words, rows of the table
        for i in range(self.width):
            at = np.flatnonzero(lengths > i)
            if not len(at):
                break
            self.spans.append((i, 1, at, row[where[at, i]]))
            h = _step(np.zeros(len(at), np.uint64), chars[at, i])
            for n in range(2, min(vocab.longest, self.width - i) + 1):
                go = lengths[at] >= i + n
                at, h = at[go], h[go]
                if not len(at):
                    break
                h = _step(h, chars[at, i + n - 1])
                if n in vocab.tables:
                    hit, ids = vocab.find(n, h)
                    if len(hit):
                        self.spans.append((i, n, at[hit], ids))

    def table(self, logp: np.ndarray) -> np.ndarray:
        """Probabilities by row for each language."""
        more = np.zeros((len(self.single), logp.shape[1]))
        for i, k in enumerate(self.single):
            if len(k) > 1:
                more[i] = logp[list(k)].sum(0)
        return np.exp(np.concatenate((logp, more)))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[end, word, language]: spans come by start, so what a span continues is complete."""
        alpha = np.zeros((self.width + 1, self.n, prob.shape[1]))
        alpha[0] = 1.0
        for i, n, at, row in self.spans:
            alpha[i + n, at] += alpha[i, at] * prob[row]
        return alpha

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of each piece over all segmentations of the words, in one language; words whose probability
        underflows are left out."""
        prob = self.table(logp[:, None])
        alpha = self.forward(prob)[:, :, 0]
        total = alpha[self.lengths, np.arange(self.n)]
        beta = np.zeros((self.width + 1, self.n))
        beta[self.lengths, np.arange(self.n)] = 1.0
        share = np.divide(weight, total, out=np.zeros(self.n), where=total > 0)
        seen = np.zeros(len(prob))
        for i, n, at, row in reversed(self.spans):
            gain = prob[row, 0] * beta[i + n, at]
            beta[i, at] += gain
            seen += np.bincount(row, alpha[i, at] * gain * share[at], minlength=len(seen))
        out = seen[: self.vocab.size]
        for i, k in enumerate(self.single):
            if len(k) > 1:
                np.add.at(out, list(k), seen[self.vocab.size + i])
        return out


def forward(word: str, vocab: Pieces, logp: np.ndarray) -> np.ndarray:
    """Log probability of a word of any length per language (columns of logp), summed over segmentations."""
    alpha = np.full((len(word) + 1, logp.shape[1]), -np.inf)
    alpha[0] = 0.0
    for i, j, ids in vocab.spans(word):  # by start: alpha[i] is complete
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + logp[list(ids)].sum(0))
    return alpha[-1]


def lattices(chars: np.ndarray, offsets: np.ndarray, vocab: Pieces, mark: bool = True) -> Iterator[tuple[np.ndarray, Lattices]]:
    """(words, their lattices) by width, of words that are chars[offsets[i]:offsets[i+1]]; mark puts the sign of a
    word's beginning before each. Words over WIDE characters are left out."""
    lengths = np.diff(offsets) + mark
    low = 0
    for high in _WIDTHS:
        own = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        for a in range(0, len(own), 1 << 15):
            w = own[a : a + (1 << 15)]
            n = lengths[w]
            grid = np.zeros((len(w), int(n.max())), np.uint32)
            row = np.repeat(np.arange(len(w)), n - mark)
            col = np.arange(len(row)) - np.repeat(np.cumsum(n - mark) - (n - mark), n - mark)
            grid[row, col + mark] = chars[np.repeat(offsets[w], n - mark) + col]
            if mark:
                grid[:, 0] = 0x2581
            yield w, Lattices(grid, n, vocab)


def _characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(characters, offsets) of an array of strings without nulls."""
    text = "".join(words.to_pylist())
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return chars, np.concatenate(([0], np.cumsum(lengths)))


def forward_many(words: pa.Array, vocab: Pieces, logp: np.ndarray) -> np.ndarray:
    """forward() of many words, each with the sign of a word's beginning."""
    chars, offsets = _characters(words)
    out = np.zeros((len(words), logp.shape[1]))
    done = np.zeros(len(words), bool)
    for w, lattice in lattices(chars, offsets, vocab):
        alpha = lattice.forward(lattice.table(logp))
        with np.errstate(divide="ignore"):
            out[w] = np.log(alpha[lattice.lengths, np.arange(len(w))])
        done[w] = np.isfinite(out[w]).all(1)
    for i in np.flatnonzero(~done):  # long, or the probability underflows
        out[i] = forward("▁" + words[int(i)].as_py(), vocab, logp)
    return out


def fit(samples: dict[str, list[str]], tokenizer_dir: str = TOKENIZER_DIR, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [piece, language]) fitted on sample texts by expectation maximisation.

    Words are split at white space; case and punctuation stay. Words over WIDE characters aren't used to fit (they are
    scored, one by one)."""
    vocab = Pieces(f"{tokenizer_dir}/{PIECES}")
    langs = sorted(samples)
    logp = np.full((vocab.size, len(langs)), -np.log(vocab.size))
    for k, lang in enumerate(langs):
        counts: dict[str, int] = {}
        for text in samples[lang]:
            for w in text.split():
                counts[w] = counts.get(w, 0) + 1
        if not counts:
            continue
        weight = np.fromiter(counts.values(), np.float64, len(counts))
        parts = list(lattices(*_characters(pa.array(list(counts), pa.string())), vocab))
        p = np.full(vocab.size, 1.0 / vocab.size)
        for _ in range(rounds):
            seen = sum((x.expected(np.log(p), weight[w]) for w, x in parts), np.zeros(vocab.size))
            p = (1 - SMOOTHING) * seen / max(seen.sum(), 1e-300) + SMOOTHING / vocab.size
        logp[:, k] = np.log(p)
    return langs, logp


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS_PER_LANGUAGE, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> dict[str, list[str]]:
    """At most `rows` labelled texts of each language, those with the least hashes; texts of under min_chars or over
    max_chars characters are not used to fit. Two passes, whatever the number of languages; rows and max_chars bound
    what comes to the driver."""
    text, lang = F.col("text"), F.col("lang").cast("string")
    known = docs.where(lang.isNotNull() & F.char_length(text).between(min_chars, max_chars)).select(lang.alias("lang"), F.xxhash64(text).alias("h"), text.alias("t"))
    limits = []
    for r in known.groupBy("lang").count().collect():
        # a hash threshold that leaves a few more than `rows` in expectation, then the least of those
        share = min(1.0, 1.5 * rows / r["count"] + 60 / r["count"])
        limits.append((r["lang"], min(int(-(2**63) + share * (2**64 - 1)), 2**63 - 1)))
    if not limits:
        return {}
    least = F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))
    near = known.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most long")), "lang").where("h <= most")
    out: dict[str, list[str]] = {}
    for r in near.withColumn("k", least).where(F.col("k") <= rows).orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["t"])
    return out


SCHEMA = "doc_id {kind}, lang string, predicted string, n_words long, log_prob double, margin double"


def language_id(
    docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """SCHEMA for each row of docs: the language whose pieces give the whole text the highest probability,
    that log probability, and how far it is above the runner-up (in nats a word).

    Without a model, one is fitted on a bounded sample of the rows with a lang. A text that is null, empty
    or all white space, or a table in which no language is known, gives a null prediction with 0 words' probability 0.0.
    Ties go to the language that sorts first. Null ids and languages are carried along; repeated rows each
    have their row. Map only: each distinct word of a slice of texts is scored once."""
    langs, logp = model if model is not None else fit(training_sample(docs), tokenizer_dir)
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp))  # of fixed size: vocabulary x languages
    path = f"{tokenizer_dir}/{PIECES}"
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        vocab = Pieces(path)
        for b in batches:
            rows = []
            for _, part in slices(b.column(2)):
                lists = pc.utf8_split_whitespace(pc.fill_null(part, ""))
                flat = lists.flatten()
                keep = pc.not_equal(flat, "")
                coded = flat.dictionary_encode()
                scores = forward_many(coded.dictionary, vocab, logp) if langs else np.zeros((len(coded.dictionary), 1))
                ok = keep.to_numpy(zero_copy_only=False).astype(np.int64)
                idx = coded.indices.to_numpy(zero_copy_only=False)
                each = np.concatenate((scores[idx] * ok[:, None], np.zeros((1, scores.shape[1])))) if len(idx) else np.zeros((1, scores.shape[1]))
                off = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
                total = np.add.reduceat(each, np.minimum(off[:-1], len(each) - 1), axis=0) if len(off) > 1 else each[:0]
                counts = np.concatenate(([0], np.cumsum(ok)))
                n = counts[off[1:]] - counts[off[:-1]]
                total[n == 0] = 0.0
                for k, t in zip(n.tolist(), total):
                    if not k or not langs:
                        rows.append((None, k, 0.0, 0.0))
                        continue
                    top = int(np.argmax(t))
                    gap = float((t[top] - np.delete(t, top).max()) / k) if len(t) > 1 else 0.0
                    rows.append((langs[top], k, float(t[top]), gap))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    narrow = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    return narrow.mapInArrow(run, SCHEMA.format(kind=kind_of(docs, "doc_id")))
