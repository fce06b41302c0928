"""Quality rules: text statistics, and bands on n-gram perplexity under modified Kneser-Ney models.

A language has three n-gram models. The first is that of the words themselves: bigrams of all
words of all documents (`word_grams`), whose number grows with the corpus, so they stay in
hash ranges and units of documents, and are never gathered. The other two have a size that no
corpus exceeds; they see what the first cannot, as most bigrams of a text occur once:

* classes: n-grams of word classes across the whole text (order WORD_ORDER). A class is a
  short word itself or a longer word's ending, hashed to CLASSES; a word equal to the one
  before it and a word without letter or digit have classes of their own. So word order,
  runs and stray symbols count.
* spelling: n-grams of characters inside words (order SPELLING_ORDER), with marks for a
  word's start and end. ASCII characters stand for themselves, all others for one of
  OTHERS classes by code point.

Spark counts the n-grams of all documents; a task sums before it sends. Counts of counts,
discounts, lower orders and back-off weights of one of these two are made in one task from its
n-grams, at most CLASSES**2 and (95 + OTHERS + 2)**3. A model is stored as sorted arrays of
n-gram hashes (symbols packed into a whole number, so without collision) with log
probabilities, and is broadcast by language; a task loads those of the languages it meets
and looks n-grams up by binary search. Nothing is pruned, at no size.

The perplexity of a document is exp(-log p / words), one for each model. For each language
the lower and upper band are BELOW and ABOVE robust standard deviations (1.4826 times the
median absolute deviation) from the median of log perplexity over all documents that pass
the base rules; a document outside the bands of any model is rejected. Word bigrams have an
upper band only: a low value there says that the text stands elsewhere as well, which is for
deduplication to judge, and runs leave the bands of the classes. For a document of
fewer than FULL_WORDS words the bands are wider by the square root of the ratio, as its
mean varies more.

Null or empty texts have zero counts, fail the base rules and are rejected. A null lang is
a language of its own. Rows that repeat are judged alike; a tie with a band's edge is
inside. Texts of any length are judged whole, in the memory of their words. An empty table
gives an empty result. Extra columns are ignored, or passed through by `filter_quality`
(names with the prefix _cw_ are this library's own).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, free_memory, in_pieces, materialize, mix, split_words, texts_of, window_hashes
from .word_grams import log_perplexities

WORD_ORDER, SPELLING_ORDER = 2, 3
#: Word classes: two special ones (0 is a document's start), short words, endings.
CLASSES, REPEAT, SYMBOL, SHORT, LONG = 256, 1, 2, (3, 125), (128, 128)
SHORT_LETTERS, ENDING = 4, 3
START, END, OTHERS = 1, 2, 97
#: Bits of a symbol in an n-gram's hash.
BITS = 8
#: Distinct words, and languages, that a task keeps before it starts anew: they bound its memory.
MOST_WORDS, MOST_LANGUAGES = 200_000, 64
PIECE = 1 << 20
BELOW, ABOVE = 5.5, 10.0
#: The narrowest robust standard deviation, so that a corpus of like documents rejects none for small changes.
LEAST_SPREAD = 0.05
FULL_WORDS = 200
MIN_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
MODELS = ("word", "spelling")
_BASE = 0x9FB21C651E98DF25
_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes([0x20, *range(9, 14), *range(0x80, 0xC0)])  # white space and UTF-8 continuation bytes
_MARKED = dict.fromkeys(range(END + 1), END + 1)  # characters that stand for marks
_MARKS = b".,;:!?\"'()[]{}#*%&$|<>-_/\\"


def word_class(word: bytes) -> int:
    """The class of a word where it does not repeat the one before."""
    bare = word.strip(_MARKS).decode("utf-8", "replace").lower()
    if not any(map(str.isalnum, bare)):
        return SYMBOL
    bare = "".join("0" if c.isdigit() else c for c in bare)
    first, many = SHORT if len(bare) <= SHORT_LETTERS else LONG
    return first + xxhash.xxh3_64_intdigest(bare[-ENDING:] if len(bare) > SHORT_LETTERS else bare) % many


def symbols_of(words: list[bytes], order: int = SPELLING_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Spelling symbols of the padded words in a row, and the sizes of the padded words."""
    text = [w.decode("utf-8", "replace") for w in words]
    text = [t if t.isprintable() else t.translate(_MARKED) for t in text]
    sizes = np.fromiter(map(len, text), np.int64, len(text)) + order
    pad, end = chr(START) * (order - 1), chr(END)
    points = np.frombuffer("".join(chain.from_iterable((pad, t, end) for t in text)).encode("utf-32-le"), np.uint32)
    return np.where(points < 127, points, 127 + points % OTHERS).astype(np.uint32), sizes


def packed(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place from order - 1 on."""
    n = len(symbols) - order + 1
    out = np.zeros(max(0, n), np.uint32)
    for j in range(order if n > 0 else 0):
        out = (out << np.uint32(BITS)) | symbols[j : j + n].astype(np.uint32)
    return out


def spelling_grams(words: list[bytes], times: np.ndarray, order: int = SPELLING_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the words, with the words' counts summed."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    symbols, sizes = symbols_of(words, order)
    keys, weight = packed(symbols, order), np.repeat(times, sizes)[order - 1 :]
    real = symbols[order - 1 :] != START
    keys, weight = keys[real], weight[real]
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weight).astype(np.int64)


class _Shorts(dict):
    """Lower-cased word of at most SHORT_LETTERS letters, without marks around it -> class."""

    def __missing__(self, bare: str) -> int:
        c = self[bare] = word_class(bare.encode())
        return c


class _Endings(dict):
    """Last ENDING letters of a lower-cased longer word -> class; 0 where they do not tell it, as they hold no letter or digit."""

    def __missing__(self, ending: str) -> int:
        c = self[ending] = word_class(("x" * SHORT_LETTERS + ending).encode()) if any(map(str.isalnum, ending)) else 0
        return c


class Words(dict):
    """word -> its place in the arrays of one language: class, and log p of its spelling if there is a model."""

    def __init__(self, model=None):
        super().__init__()
        self.model, self.new = model, []
        self.classes, self.spelling = np.zeros(0, np.uint8), np.zeros(0)
        self.shorts, self.endings = _Shorts(), _Endings()

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        """word_class of each, worked out once for an ending or a short word."""
        bare = [w.strip(_MARKS).decode("utf-8", "replace").lower() for w in words]
        shorts, endings = self.shorts, self.endings
        found = np.fromiter((shorts[b] if len(b) <= SHORT_LETTERS else endings[b[-ENDING:]] for b in bare), np.uint8, len(bare))
        for i in np.flatnonzero(found == 0).tolist():
            found[i] = word_class(words[i])
        return found

    def places(self, words: list[bytes], n: int) -> np.ndarray:
        """Places of the words, n in all; new words are added."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if self.new:
            self.classes = np.concatenate([self.classes, self.classes_of(self.new)])
            if self.model:
                self.spelling = np.concatenate([self.spelling, self.model.spell(self.new)])
            self.new = []
        return at


def classes_in_text(classes: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class) of each word; first marks the first words of documents."""
    own = classes[at].astype(np.int64)
    same = np.zeros(len(at), bool)
    same[1:] = at[1:] == at[:-1]
    own[same & ~first] = REPEAT
    before = np.zeros(len(at), np.int64)
    before[1:] = own[:-1]
    before[first] = 0
    return before, own


def by_language(langs: list, split: list[list[bytes]]):
    """(lang, document numbers, words in a row, words of each, number of each word's document)."""
    docs: dict = {}
    for i, lang in enumerate(langs):
        if split[i]:
            docs.setdefault(lang, []).append(i)
    for lang, at in docs.items():
        many = np.fromiter((len(split[i]) for i in at), np.int64, len(at))
        yield lang, np.array(at), list(chain.from_iterable(split[i] for i in at)), many


GRAMS = "lang string, model string, gram long, n long"


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, model, gram, n over all words of all documents."""

    def run(batches):
        free_memory("quality")
        known: dict[str | None, tuple[Words, np.ndarray, list[np.ndarray]]] = {}

        def flush():
            for lang, (words, pairs, parts) in known.items():
                times = np.zeros(len(words), np.int64)
                for p in parts:
                    times[: len(p)] += p
                for model, (keys, n) in zip(MODELS, ((np.flatnonzero(pairs), pairs[pairs > 0]), spelling_grams(list(words), times)), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys)), pa.repeat(pa.scalar(model, pa.string()), len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "model", "gram", "n"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, z in in_pieces(texts, PIECE):
                for lang, _, words, many in by_language(langs[a:z], [split_words(t) for t in texts[a:z]]):
                    lexicon, pairs, parts = known.setdefault(lang, (Words(), np.zeros(CLASSES**2, np.int64), []))
                    at = lexicon.places(words, int(many.sum()))
                    first = np.zeros(len(at), bool)
                    first[np.cumsum(many) - many] = True
                    before, own = classes_in_text(lexicon.classes, at, first)
                    pairs += np.bincount(before * CLASSES + own, minlength=CLASSES**2)
                    parts.append(np.bincount(at, minlength=len(lexicon)))
                    if len(parts) > 8:
                        total = np.zeros(len(lexicon), np.int64)
                        for p in parts:
                            total[: len(p)] += p
                        parts[:] = [total]
                if len(known) > MOST_LANGUAGES or sum(len(k[0]) for k in known.values()) > MOST_WORDS:
                    yield from flush()
                    known.clear()
        yield from flush()

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, GRAMS)
    return rows.groupBy("lang", "model", "gram").agg(F.sum("n").alias("n"))


def discounts(c: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    return discounts_from([int((c == k).sum()) for k in (1, 2, 3, 4)])


def discounts_from(counts_of_counts: list[int]) -> np.ndarray:
    """The same from how many n-grams occur 1, 2, 3 and 4 times."""
    n = [0, *counts_of_counts]
    if not n[1] or not n[2]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = [0.0] + [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in (1, 2, 3)]
    return np.clip(d, 0.0, [0.0, 0.95, 1.9, 2.85])


class KneserNey:
    """For each order, from 1 up, sorted hashes of n-grams with log p, and of contexts with log back-off weight."""

    def __init__(self, prob: list, weight: list, unseen: float):
        self.prob, self.weight, self.unseen = prob, weight, unseen

    @property
    def order(self) -> int:
        return len(self.prob)

    @classmethod
    def estimate(cls, grams: np.ndarray, counts: np.ndarray, order: int) -> KneserNey:
        """grams: sorted distinct hashes of n-grams of the highest order."""
        prob, weight = [], []
        levels = [(grams.astype(np.uint32), counts.astype(np.float64))]
        for k in range(order - 1, 0, -1):  # lower orders count the distinct symbols before an n-gram
            tails, n = np.unique(levels[-1][0] & np.uint32((1 << BITS * k) - 1), return_counts=True)
            levels.append((tails, n.astype(np.float64)))
        lower = None
        for k, (keys, c) in enumerate(reversed(levels), 1):
            d = discounts(c)
            contexts, at = np.unique(keys >> np.uint32(BITS), return_inverse=True)
            total = np.bincount(at, c, len(contexts))
            cut = d[np.minimum(c, 3).astype(int)]
            left = np.bincount(at, cut, len(contexts)) / total
            below = 1.0 / (len(keys) + 1) if lower is None else lower[1][np.searchsorted(lower[0], keys & np.uint32((1 << BITS * (k - 1)) - 1))]
            p = (c - cut) / total[at] + left[at] * below
            lower = keys, p
            prob.append((keys, np.log(np.maximum(p, 1e-30)).astype(np.float32)))
            weight.append((contexts, np.log(np.maximum(left, 1e-12)).astype(np.float32)))
        return cls(prob, weight, float(weight[0][1][0] - np.log(len(prob[0][0]) + 1)))

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log p of the last symbol of each n-gram after the others."""
        value, left = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.order, 0, -1):
            own = keys[left] & np.uint32((1 << BITS * k) - 1)
            hit, v = self._find(self.prob[k - 1], own)
            value[left[hit]] += v[hit]
            left, own = left[~hit], own[~hit]
            if len(left) and k > 1:
                known, w = self._find(self.weight[k - 1], own >> np.uint32(BITS))
                value[left] += np.where(known, w, 0.0)
        value[left] += self.unseen
        return value

    @staticmethod
    def _find(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, v = table
        if not len(h):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        i = np.minimum(np.searchsorted(h, keys), len(h) - 1)
        return h[i] == keys, v[i]


class Model:
    """The two models of a language."""

    def __init__(self, word: KneserNey, spelling: KneserNey):
        self.word, self.spelling, self._pairs = word, spelling, None

    def spell(self, words: list[bytes]) -> np.ndarray:
        """log p of each word's characters and its end."""
        order = self.spelling.order
        symbols, sizes = symbols_of(words, order)
        keys, real = packed(symbols, order), symbols[order - 1 :] != START
        value = self.spelling.scores(keys[real])
        scored = sizes - order + 1
        return np.add.reduceat(value, np.cumsum(scored) - scored)

    def pairs(self) -> np.ndarray:
        """log p of every class after every class: the word model's arrays spread out."""
        if self._pairs is None:
            self._pairs = self.word.scores(np.arange(CLASSES**2, dtype=np.uint32))
        return self._pairs


ARRAYS = "lang string, model string, level int, kind string, keys binary, log_values binary, unseen double"


def estimated(grams: DataFrame) -> DataFrame:
    """The arrays of each language's models, a row per order and kind: prob (n-grams), weight (contexts)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gram")
        lang, model = pdf["lang"].iloc[0], pdf["model"].iloc[0]
        kn = KneserNey.estimate(pdf["gram"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), WORD_ORDER if model == "word" else SPELLING_ORDER)
        rows = [(lang, model, k, kind, h.tobytes(), v.tobytes(), kn.unseen) for kind, tables in (("prob", kn.prob), ("weight", kn.weight)) for k, (h, v) in enumerate(tables)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in ARRAYS.split(", ")])

    return grams.groupBy("lang", "model").applyInPandas(run, ARRAYS)


def train(docs: DataFrame) -> dict:
    """lang -> broadcast Model. The arrays that pass the driver have the bound of the models."""
    spark = docs.sparkSession
    found: dict = {}
    rows = materialize(estimated(count_grams(docs)), "models").collect()
    for r in sorted(rows, key=lambda r: r["level"]):
        kn = found.setdefault(r["lang"], {}).setdefault(r["model"], KneserNey([], [], r["unseen"]))
        getattr(kn, r["kind"]).append((np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["log_values"], np.float32)))
    return {lang: spark.sparkContext.broadcast(Model(*(m[k] for k in MODELS))) for lang, m in found.items()}


def forget(models: dict) -> None:
    """Frees the broadcast models, once nothing lazy needs them."""
    for b in models.values():
        b.destroy()


class Scorer:
    """Statistics and log perplexities of texts, a piece at a time."""

    def __init__(self, models: dict):
        self.models, self.known = models, {}

    def rows(self, langs: list, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Statistics (rows x 5) and log perplexity per word under the models (rows x 2) of each text."""
        stats, score = np.zeros((len(texts), 5), np.int64), np.full((len(texts), len(MODELS)), 99.0)
        for a, z in in_pieces(texts, PIECE):
            self._piece(langs[a:z], texts[a:z], stats[a:z], score[a:z])
        return stats, score

    def _piece(self, langs, texts, stats, score) -> None:
        split = [split_words(t) for t in texts]
        for i, t in enumerate(texts):
            if t:
                lines = [x for x in t.split(b"\n") if x.strip()]
                stats[i, :4] = len(split[i]), len(t.translate(None, _NOT_COUNTED)), len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines))
        if len(self.known) > MOST_LANGUAGES or sum(map(len, self.known.values())) > MOST_WORDS:
            self.known.clear()
        for lang, docs, words, many in by_language(langs, split):
            model = self.models[lang].value if lang in self.models else None
            lexicon = self.known.setdefault(lang, Words(model))
            at = lexicon.places(words, int(many.sum()))
            starts = np.cumsum(many) - many
            stats[docs, 4] = repeated_words(at, many)
            if model:
                first = np.zeros(len(at), bool)
                first[starts] = True
                before, own = classes_in_text(lexicon.classes, at, first)
                score[docs, 0] = -np.add.reduceat(model.pairs()[before * CLASSES + own], starts) / many
                score[docs, 1] = -np.add.reduceat(lexicon.spelling[at], starts) / many


def repeated_words(at: np.ndarray, many: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each document in windows that it holds twice or more. at: word numbers of all documents in a row."""
    out, n = np.zeros(len(many), np.int64), len(at)
    if n < width + 1:
        return out
    doc = np.repeat(np.arange(len(many)), many)
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    h = window_hashes(mix(at.astype(np.uint64) + np.uint64(1)), width, _BASE)[starts] ^ mix(doc[starts].astype(np.uint64) + np.uint64(0x9E37))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    if twice.any():
        hit = starts[order[twice]]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
        out[:] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(many))
    return out


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MOST_REPEATED_PERCENT * stats[:, 0])


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BOUNDED = tuple(f"{m}_log_perplexity" for m in MODELS)  # of the models whose size has a bound; "word" is that of classes
BIGRAM = "word_bigram_log_perplexity"
SCORES = (BIGRAM, *BOUNDED)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _cw_key, the hash of what a row's scores depend on and of its doc_id: rows equal in it have equal scores."""
    parts = [F.col(c).cast("string") for c in ("doc_id", "lang", "text")]
    return docs.withColumn("_cw_key", F.xxhash64(*(F.coalesce(F.concat(F.lit("+"), p), F.lit("")) for p in parts)))


def word_scores(docs: DataFrame) -> DataFrame:
    """_cw_key and the log perplexity under word bigrams, for documents (keyed) with words; a row for each key."""
    found = log_perplexities(docs.select("_cw_key", F.col("lang").cast("string"), F.col("text").cast("string")), discounts_from)
    return found.groupBy(F.col("key").alias("_cw_key")).agg(F.first("score").alias(BIGRAM))


def scored(docs: DataFrame, models: dict) -> DataFrame:
    """doc_id, lang, the statistics, base_failed, log perplexity per word under each model of BOUNDED, _cw_key. docs: keyed."""

    def run(batches):
        free_memory("quality")
        scorer = Scorer(models)
        for batch in batches:
            stats, score = scorer.rows(batch.column(1).to_pylist(), texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(stats[:, k]) for k in range(5)), pa.array(base_failed(stats)), *(pa.array(score[:, k]) for k in range(len(MODELS))), batch.column(3)], names=["doc_id", "lang", *STATS, "base_failed", *BOUNDED, "_cw_key"])

    fields = "doc_id long, lang string, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, " + ", ".join(f"{s} double" for s in BOUNDED) + ", _cw_key long"
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"), "_cw_key").mapInArrow(run, fields)


def bands(scores: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """_cw_lang, and for each score its middle and the bands' distances from it (_cw_mid_*, _cw_low_*, _cw_high_*): a row per language."""
    good = scores.filter(~F.col("base_failed")).select("lang", *SCORES)
    mid = good.groupBy(F.col("lang").alias("_cw_lang")).agg(*(F.percentile_approx(s, 0.5, 100_000).alias(f"_cw_mid_{s}") for s in SCORES))
    off = good.join(mid, F.col("lang").eqNullSafe(F.col("_cw_lang")))
    spread = off.groupBy("_cw_lang", *(f"_cw_mid_{s}" for s in SCORES)).agg(*(F.greatest(F.lit(LEAST_SPREAD), 1.4826 * F.percentile_approx(F.abs(F.col(s) - F.col(f"_cw_mid_{s}")), 0.5, 100_000)).alias(f"_cw_{s}") for s in SCORES))
    return spread.select("_cw_lang", *(c for s in SCORES for c in (f"_cw_mid_{s}", (below * F.col(f"_cw_{s}")).alias(f"_cw_low_{s}"), (above * F.col(f"_cw_{s}")).alias(f"_cw_high_{s}"))))


def judged(scores: DataFrame, below: float, above: float) -> DataFrame:
    """scores (materialized) with _cw_inside: whether a row is inside all bands of its language."""
    band = bands(scores, below, above)  # a row per language: Spark broadcasts it by its size
    wider = F.sqrt(F.greatest(F.lit(1.0), FULL_WORDS / F.greatest(F.lit(1), "n_words")))
    inside = F.lit(True)
    for s in SCORES:
        off = F.col(s) - F.col(f"_cw_mid_{s}")
        inside = inside & (off <= F.col(f"_cw_high_{s}") * wider)
        if s != BIGRAM:
            inside = inside & (off >= -F.col(f"_cw_low_{s}") * wider)
    return scores.join(materialize(band, "bands"), F.col("lang").eqNullSafe(F.col("_cw_lang")), "left").withColumn("_cw_inside", F.coalesce(inside, F.lit(False)))


def with_word_scores(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """scores (with _cw_key) with the log perplexity of docs (keyed) under word bigrams; 99 for a document without words."""
    return scores.join(word_scores(docs), "_cw_key", "left").withColumn(BIGRAM, F.coalesce(BIGRAM, F.lit(99.0)))


def quality_rules(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, log perplexities for every document."""
    docs = keyed(docs)
    models = train(docs)
    scores = materialize(scored(docs, models), "quality-bounded")
    forget(models)
    scores = materialize(with_word_scores(scores, docs), "quality")
    kept = ~F.col("base_failed") & F.col("_cw_inside")
    return judged(scores, below, above).select("doc_id", *STATS, "base_failed", kept.alias("kept"), *SCORES)


def filter_quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The documents that quality_rules keeps, all columns, without a join of texts: one pass scores and writes those that pass the base rules, the bands cut them by a list of keys."""
    names = docs.columns
    docs = keyed(docs)
    models = train(docs)
    lang_at, text_at = names.index("lang"), names.index("text")

    def run(batches):
        free_memory("quality")
        scorer = Scorer(models)
        for batch in batches:
            langs = batch.column(lang_at).cast(pa.string()).to_pylist()
            stats, score = scorer.rows(langs, texts_of(batch.column(text_at)))
            ok = pa.array(~base_failed(stats))
            more = [pa.array(langs, pa.string()), pa.array(stats[:, 0]), *(pa.array(score[:, k]) for k in range(len(MODELS)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[f"_cw_{i}" for i in range(len(names))] + ["_cw_key", "lang", "n_words", *BOUNDED]).filter(ok)

    kinds = [f"_cw_{i} {t}" for i, (_, t) in enumerate(docs.dtypes[:-1])]
    rows = docs.mapInArrow(run, ", ".join([*kinds, "_cw_key long", "lang string", "n_words long", *(f"{s} double" for s in BOUNDED)]))
    rows = materialize(rows.withColumn("base_failed", F.lit(False)), "quality")
    forget(models)
    scores = materialize(with_word_scores(rows.select("_cw_key", "lang", "n_words", "base_failed", *BOUNDED), docs), "scores")
    outside = materialize(judged(scores, below, above).filter("NOT _cw_inside").select("_cw_key").distinct(), "outside")
    return rows.join(few(outside), "_cw_key", "left_anti").select(*(F.col(f"_cw_{i}").alias(c) for i, c in enumerate(names)))
