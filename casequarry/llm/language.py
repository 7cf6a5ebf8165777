"""Language of texts from a linear-chain conditional random field over their words.

Every word has a score for each language: the weights of its affixes, of its letter n-grams and, if the fitted lexicon
holds it, of the word itself. Transition weights tie neighbours together. Forward-backward gives each word a
distribution over the languages, so a text that switches is labelled word by word; the text's language is the one that
holds most of its words, and the score its share of them.

The field is fitted by gradient steps on the log-likelihood, also with forward-backward, on a bounded sample: at most
``SAMPLE_DOCS`` labelled documents, about as many of each language, chosen by a hash, and ``SAMPLE_WORDS`` words of
each. Windows of different documents are joined to one sequence, so transitions see switches. Nothing else reaches the
driver. Only documents outside the held-out quarter are learnt from. Prediction reads whole texts; long ones are cut
into chunks whose transfer matrices are multiplied, which gives the same result as one pass.

Cases: ``und`` with score 0 for a null text, one without a letter, or when there is nothing to learn from; a null
``doc_id`` is not held out and not learnt from; repeated rows stay; equal shares go to the first language in order; an
empty table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import store

SAMPLE_DOCS = 3000
SAMPLE_WORDS = 120
#: More different values of ``lang`` are joined by a shuffle instead of a broadcast.
MOST_LANGS = 10_000
#: Of a sampled window, at most so many characters.
SAMPLE_CHARS = 4000
FEATURES = 1 << 16
STEPS = 25
#: Words whose distributions the fit holds at once.
STEP_WORDS = 50_000
#: Words that a worker remembers with their scores, and words of a chunk.
REMEMBERED = 300_000
CHUNK = 64
UNKNOWN = "und"
#: A text is kept by ``keep_known`` if one language holds this share of its words.
LEAST_SHARE = 0.4

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; empty if the text has no letter."""
    words = WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed affixes, letter n-grams and, for a word of the lexicon, the word."""
    if len(word) > 40:  # no word of a language: what it begins and ends with tells enough
        word = word[:20] + word[-20:]
    marked = f"^{word}$"
    found = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    found += [marked[k : k + n] for n in (2, 3) for k in range(len(marked) - n + 1)]
    if word in lexicon:
        found.append(f"w{word}")
    return [zlib.crc32(f.encode()) % FEATURES for f in found]


@dataclass
class Field:
    """A fitted field: weights by feature and language, transition weights, and the words it holds."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: frozenset[str]

    def scores(self, words: list[str]) -> np.ndarray:
        """exp of each word's scores, the best of them 1."""
        found = [features(w, self.lexicon) for w in words]
        return _scaled(_summed(self.weights, found))


def _summed(weights: np.ndarray, found: list[list[int]]) -> np.ndarray:
    if not found:
        return np.zeros((0, weights.shape[1]))
    at = np.concatenate([[0], np.cumsum([len(f) for f in found[:-1]])]).astype(np.int64)
    return np.add.reduceat(weights[np.concatenate([np.array(f) for f in found])], at, axis=0)


def _scaled(score: np.ndarray) -> np.ndarray:
    return np.exp(score - score.max(axis=1, keepdims=True)) + 1e-30


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(
    words: np.ndarray, moves: np.ndarray, lengths: np.ndarray, chunk: int = CHUNK
) -> tuple[np.ndarray, np.ndarray]:
    """Distribution over the languages of every word of several texts, and the forward part alone, chunk by chunk.

    ``words`` has the scaled scores of all words in a row, ``moves`` the exp of the transition weights. A text starts
    as if after a word of no known language.
    """
    kinds = words.shape[1]
    chunks = -(-lengths // chunk)
    text = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = np.repeat(np.cumsum(lengths) - lengths, chunks) + nth * chunk
    size = np.minimum(chunk, lengths[text] - nth * chunk)
    n = len(text)
    cell = begin[:, None] + np.minimum(np.arange(chunk), size[:, None] - 1)
    real = np.arange(chunk) < size[:, None]
    each = words[cell]  # (chunks, words, languages)

    through = np.broadcast_to(np.eye(kinds), (n, kinds, kinds)).copy()
    for t in range(chunk):
        on = np.flatnonzero(real[:, t])
        step = (through[on] @ moves) * each[on, t][:, None, :]
        through[on] = step / step.sum(axis=(1, 2), keepdims=True)
    before, after = np.full((n, kinds), 1.0 / kinds), np.ones((n, kinds))
    for k in range(1, int(chunks.max(initial=0))):
        on = np.flatnonzero(nth == k)
        before[on] = _norm(np.einsum("ni,nij->nj", before[on - 1], through[on - 1]))
    last = chunks[text] - 1
    for k in range(int(chunks.max(initial=0)) - 2, -1, -1):
        on = np.flatnonzero((nth == k) & (last > k))
        after[on] = _norm(np.einsum("nij,nj->ni", through[on + 1], after[on + 1]))

    forward = np.empty_like(each)
    a = before
    for t in range(chunk):
        a = np.where(real[:, t, None], _norm((a @ moves) * each[:, t]), a)
        forward[:, t] = a
    out, ahead, b = np.empty_like(words), np.empty_like(words), after
    ahead[cell[real]] = forward[real]
    for t in range(chunk - 1, -1, -1):
        on = real[:, t]
        out[cell[on, t]] = _norm(forward[on, t] * b[on])
        b = np.where(on[:, None], _norm((each[:, t] * b) @ moves.T), b)
    return out, ahead


def fit(samples: list[tuple[str, str]], steps: int = STEPS) -> Field | None:
    """Fit the field to (language, text) samples by full gradient steps with momentum and scaled rates."""
    own = [(lang, words_of(text)) for lang, text in samples]
    own = [(lang, words) for lang, words in own if words]
    langs = sorted({lang for lang, _ in own})
    if not langs:
        return None
    count = Counter(w for _, words in own for w in words)
    lexicon = frozenset(w for w, n in count.items() if n > 1)
    place = {w: k for k, w in enumerate(count)}
    held, sizes = array("i"), array("i")
    for w in place:
        found = features(w, lexicon)
        held.extend(found)
        sizes.append(len(found))
    flat, sizes = np.array(held), np.array(sizes)
    at, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    del held

    # Half of the windows follow one another in sequences of different documents.
    rng = np.random.default_rng(7)
    windows = []
    for lang, words in own:
        label, k = langs.index(lang), 0
        while k < len(words):
            n = int(rng.integers(8, 60))
            windows.append((label, [place[w] for w in words[k : k + n]]))
            k += n
    order = rng.permutation(len(windows))
    sequences, joined = [], []
    for k in order:
        joined.append(windows[k])
        if len(joined) == 4 or k % 2:
            sequences.append(joined)
            joined = []
    if joined:
        sequences.append(joined)
    word = np.array([w for s in sequences for _, words in s for w in words])
    label = np.array([lab for s in sequences for lab, words in s for _ in words])
    lengths = np.array([sum(len(words) for _, words in s) for s in sequences])
    first = np.zeros(len(word), bool)
    first[np.cumsum(lengths) - lengths] = True

    kinds, n = len(langs), len(word)
    weights, moves = np.zeros((FEATURES, kinds)), np.zeros((kinds, kinds))
    ends = np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(ends, np.arange(STEP_WORDS, n, STEP_WORDS), "left"))
    blocks = [part for part in np.split(np.arange(len(lengths)), cuts) if len(part)]
    speed, size = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        scaled = _scaled(np.stack([np.add.reduceat(weights[flat, k], at) for k in range(kinds)], axis=1))
        power = np.exp(moves)
        by_word, of_moves = np.zeros((len(sizes), kinds)), np.zeros((kinds, kinds))
        for part in blocks:  # sequences by some words at a time
            own = slice(ends[part[0]] - lengths[part[0]], ends[part[-1]])
            here, true = word[own], label[own]
            post, ahead = posteriors(scaled[here], power, lengths[part])
            switch = np.flatnonzero(~first[own])
            # A pair's distribution: the forward part before it, the move, and the word's own distribution; all at once.
            before = ahead[switch - 1]
            of_moves -= power * (before.T @ (post[switch] / (before @ power)))
            np.add.at(of_moves, (true[switch - 1], true[switch]), 1.0)
            post[np.arange(len(true)), true] -= 1.0
            for k in range(kinds):
                by_word[:, k] -= np.bincount(here, post[:, k], minlength=len(sizes))
        by_feature = np.stack([np.bincount(flat, by_word[owner, k], minlength=FEATURES) for k in range(kinds)], axis=1)
        for k, (values, gradient) in enumerate(((weights, by_feature / n - 1e-6 * weights), (moves, of_moves / n - 1e-6 * moves))):
            speed[k] = 0.8 * speed[k] + 0.2 * gradient
            size[k] = 0.95 * size[k] + 0.05 * gradient**2
            values += 0.1 * (speed[k] / (1 - 0.8**step)) / (np.sqrt(size[k] / (1 - 0.95**step)) + 1e-8)
    return Field(langs, weights.astype(np.float32), np.exp(moves), lexicon)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """Fit the field to labelled documents that are not held out; a bounded sample of them reaches the driver."""
    known = docs.select("doc_id", "text", "lang").where(
        (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    many = langs.count()
    share = (F.lit(float(sample_docs)) / (max(1, many) * F.col("n"))).alias("share")
    shares = langs.select("lang", share)
    shares = F.broadcast(shares) if many <= MOST_LANGS else shares
    key = F.xxhash64("doc_id", "text")
    drawn = known.withColumn("key", key).join(shares, "lang")
    drawn = drawn.where(F.pmod("key", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    words = F.split("text", r"\s+")
    window = F.slice(words, (1 + F.pmod("key", F.greatest(F.lit(1), F.size(words) - SAMPLE_WORDS + 1))).cast("int"), SAMPLE_WORDS)
    sample = drawn.orderBy("key", "doc_id", "lang").limit(sample_docs)
    rows = sample.select("lang", F.substring(F.array_join(window, " "), 1, SAMPLE_CHARS).alias("text")).collect()
    return fit(sorted((r.lang, r.text) for r in rows))


class _Labels:
    """Labels the texts of a task, batch by batch; remembers the scores of words."""

    def __init__(self, field: Field | None):
        self.field, self.place, self.table = field, {}, np.zeros((0, len(field.langs) if field else 0))

    def of(self, column: pa.Array) -> tuple[list[str], list[float], list[list[float] | None]]:
        """Language, score and shares by language of each text."""
        field = self.field
        texts = [words_of(t or "") for t in column.to_pylist()]
        lengths = np.array([len(w) for w in texts], np.int64)
        lang, score, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        some = np.flatnonzero(lengths) if field else np.zeros(0, np.int64)
        if len(some):
            new = list({w for words in texts for w in words if w not in self.place})
            if len(self.place) + len(new) > REMEMBERED:
                self.place, self.table = {}, self.table[:0]
                new = list({w for words in texts for w in words})
            place = self.place
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, field.scores(new)]) if new else self.table
            each = self.table[np.fromiter((place[w] for words in texts for w in words), np.int64, int(lengths.sum()))]
            post, _ = posteriors(each, field.moves, lengths[some])
            at = np.cumsum(lengths[some]) - lengths[some]
            part = np.add.reduceat(post, at, axis=0) / lengths[some][:, None]
            for k, own in zip(some, part, strict=True):
                best = int(own.argmax())
                lang[k], score[k], shares[k] = field.langs[best], float(min(1.0, own[best])), own.tolist()
        return lang, score, shares


def label(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ``shares`` (of the words, by language) of every row."""
    store.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labels(field)
        for b in batches:
            found = [pa.array(x, f.type) for x, f in zip(labels.of(b["text"]), list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], *found], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    found = rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, shares array<double>")
    langs = F.array(*[F.lit(x) for x in field.langs]) if field else F.array().cast("array<string>")
    return found.withColumn("shares", F.map_from_arrays(langs, F.col("shares")))


def keep_known(docs: DataFrame, field: Field | None, least: float = LEAST_SHARE) -> DataFrame:
    """The rows whose text is in one of the field's languages, with all their columns.

    Texts without a letter go, and those of whose words no language holds ``least``. Without a field every row stays.
    """
    store.small_batches(docs.sparkSession)
    if field is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labels(field)
        for b in batches:
            lang, score, _ = labels.of(b["text"])
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    return label(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_language": op8_language}
ORACLES: dict[str, str] = {}
