"""Word bigrams under an interpolated modified Kneser-Ney model: counted over all documents, none left out or pruned.

p(w2 | w1) = (c(w1 w2) - D) / C(w1) + (D1 N1(w1) + D2 N2(w1) + D3 N3(w1)) / C(w1) * q(w2), where q is the same with
the number of distinct words before w2, over 1 / (words + 1). The word before a document's first is a mark of its own.

Neither bigrams nor words pass the driver, and no table of them is broadcast:

1. Units: a task hashes the words of about UNIT_WORDS words of one language as arrays. A unit is a row: its documents, its
   sorted word hashes (64 bits) and its words as places in them. Later steps read units, not texts.
2. A unit sends its distinct bigrams (60-bit hashes, sorted, as gaps) with counts, cut by hash range, a row a range.
   A range's task sums them and answers each unit with the counts in the unit's own order; one unit owns each bigram.
3. Units sum what a word needs (C, N1, N2, N3, distinct words before) over the bigrams that they own, and send it cut
   by word hash; a range's task sums it and answers.
4. Each unit scores its documents from both answers. Units are a table bucketed by their number, so that answers
   come to them and they are not shuffled.

Bigrams whose 60-bit hashes are equal are counted as one: about three pairs in 2.5 billion distinct bigrams.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, give_back, hashed_words, in_pieces, materialize, mix, new_path, texts_of

#: Words of a unit; languages that a task holds before it sends units.
UNIT_WORDS, MOST_LANGUAGES = 2_000_000, 64
#: Words, or entries of units' word lists, for which a hash range is made.
RANGE = 2_000_000
PIECE = 1 << 20
HASH_BITS = 60
START = 0  # the hash of the mark before a document
STATS = ("total", "once", "twice", "more", "before")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, byte by byte of all, compressed."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)
    return np.array([len(values), size], "<u8").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n, size = np.frombuffer(blob, "<u8", 2).tolist()
    planes = np.frombuffer(pa.decompress(blob[16:], n * size, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = planes.reshape(size, n).T
    return out.view("<u8").reshape(n)


def gaps(sorted_values: np.ndarray) -> bytes:
    return packed(np.diff(sorted_values, prepend=np.uint64(0)))


def from_gaps(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def bits_for(n: int) -> int:
    """Leading hash bits by which n entries are cut into ranges."""
    return max(0, -(-n // RANGE) - 1).bit_length()


def cuts(sorted_hashes: np.ndarray, hash_bits: int, bits: int) -> np.ndarray:
    """Where each hash range begins, and the end."""
    if not bits:
        return np.array([0, len(sorted_hashes)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(hash_bits - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


UNITS = "unit long, lang string, n_words long, n_vocabulary long, docs binary, sizes binary, vocabulary binary, words binary"


def units(docs: DataFrame) -> DataFrame:
    """docs: key (long), lang, text. A row per unit; documents without words are in none."""

    def row(number, lang, held):
        keys, sizes, hashes = held
        vocabulary, words = np.unique(np.concatenate([np.zeros(1, np.uint64) + np.uint64(START), *hashes]), return_inverse=True)
        words = words[1:]
        columns = [number, lang, len(words), len(vocabulary), np.asarray(keys, "<i8").tobytes(), packed(np.asarray(sizes)), gaps(vocabulary), packed(words)]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=[f.split()[0] for f in UNITS.split(", ")])

    def run(batches):
        free_memory("word grams")
        number, known, n = TaskContext.get().partitionId() << 32, {}, {}
        for batch in batches:
            all_keys, langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))
            for a, z in in_pieces(texts, PIECE):
                h, counts = hashed_words(texts[a:z])
                h = np.maximum(h, np.uint64(START + 1))
                ends = np.cumsum(counts)
                for i, many, end in zip(range(a, z), counts.tolist(), ends.tolist(), strict=True):
                    if not many:
                        continue
                    keys, sizes, hashes = known.setdefault(langs[i], ([], [], []))
                    keys.append(all_keys[i])
                    sizes.append(many)
                    hashes.append(h[end - many : end].copy())  # a view would keep the words of other languages in memory
                    n[langs[i]] = n.get(langs[i], 0) + many
                    if n[langs[i]] >= UNIT_WORDS:
                        yield row(number, langs[i], known.pop(langs[i]))
                        number, n[langs[i]] = number + 1, 0
                if len(known) > MOST_LANGUAGES or sum(n.values()) > 2 * UNIT_WORDS:
                    lang = max(known, key=lambda x: n[x])
                    yield row(number, lang, known.pop(lang))
                    number, n[lang] = number + 1, 0
        for lang, held in known.items():
            yield row(number, lang, held)
            number += 1
        known.clear()
        give_back()

    return docs.mapInArrow(run, UNITS)


def _bigrams(vocabulary: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word's bigram, and the place of the word before it."""
    before = np.zeros(len(words), np.int64)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = START  # the mark's hash is the least, so its place is 0
    h = mix(mix(vocabulary ^ np.uint64(0x5851F42D4C957F2D))[before] + vocabulary[words] * np.uint64(0x9E3779B97F4A7C15))
    return h >> np.uint64(64 - HASH_BITS), before


def _sent(rows: DataFrame, step) -> DataFrame:
    """step(unit row as dict) -> (hashes, values) of sorted hash ranges: rows lang, range, unit, hashes, values."""

    def run(batches):
        free_memory("word grams")
        for batch in batches:
            for one in batch.to_pylist():
                parts = [(i, h, v) for i, (h, v) in enumerate(step(one)) if h is not None]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([one["lang"]] * n, pa.string()), pa.array([p[0] for p in parts], pa.int64()), pa.array([one["unit"]] * n, pa.int64()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.list_(pa.binary()))], names=["lang", "range", "unit", "hashes", "values"])
        give_back()

    return rows.mapInArrow(run, "lang string, range long, unit long, hashes binary, values array<binary>")


ANSWERS = "lang string, unit long, range long, answers array<binary>, of_counts array<long>, entries long, total long"


def _answered(sent: DataFrame, answer) -> DataFrame:
    """Per range, answer(which distinct hash each entry is, number of distinct ones, values of the entries) -> (answers to the entries, value of each distinct hash that is counted).

    Rows lang, unit, range, answers; the range's first row has how many distinct hashes have the value 1, 2, 3 and 4, how many are above 0, and the sum.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        hashes = [from_gaps(b) for b in pdf["hashes"]]
        ends = np.cumsum([0, *map(len, hashes)])
        found, at = np.unique(np.concatenate(hashes), return_inverse=True)
        values = [np.concatenate([unpacked(v[k]) for v in pdf["values"]]) for k in range(len(pdf["values"].iloc[0]))]
        out, counted = answer(at, len(found), values)
        many = np.bincount(np.minimum(counted, 5), minlength=6)[1:5].tolist()
        first = [i == 0 for i in range(len(pdf))]
        answers = [[packed(o[a:z]) for o in out] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pd.DataFrame({"lang": pdf["lang"].to_numpy(), "unit": pdf["unit"].to_numpy(), "range": pdf["range"].to_numpy(), "answers": answers, "of_counts": [many if f else [0] * 4 for f in first], "entries": [int((counted > 0).sum()) if f else 0 for f in first], "total": [int(counted.sum()) if f else 0 for f in first]})

    return sent.groupBy("lang", "range").applyInPandas(run, ANSWERS)


def _sums(at: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(at, values.astype(np.float64), n).astype(np.int64)  # exact up to 2**53


def _bigram_answer(at, n, values):
    counts = _sums(at, n, values[0])
    own = np.zeros(len(at), np.int64)
    own[np.unique(at, return_index=True)[1]] = 1
    return [2 * counts[at] + own], counts


def _word_answer(at, n, values):
    sums = [_sums(at, n, v) for v in values]
    return [s[at] for s in sums], sums[-1]


def _by_unit(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("unit").agg(F.collect_list(F.struct("range", "answers")).alias(name))


def _in_order(parts: list[dict], k: int) -> np.ndarray:
    return np.concatenate([unpacked(p["answers"][k]) for p in sorted(parts, key=lambda p: p["range"])])


def _constants(answers: DataFrame) -> dict:
    """lang -> (counts of counts, entries, total): a few numbers a language."""
    parts = answers.groupBy("lang").agg(*(F.sum(F.col("of_counts")[k]).alias(f"n{k}") for k in range(4)), F.sum("entries").alias("entries"), F.sum("total").alias("total"))
    return {r["lang"]: ([r[f"n{k}"] for k in range(4)], r["entries"], r["total"]) for r in parts.collect()}


def log_perplexities(docs: DataFrame, discounts) -> DataFrame:
    """key, score: mean of -log p of the words of each document that has words. docs: key (long), lang, text; discounts: counts of counts 1 to 4 -> discounts of counts 0 to 3."""
    spark = docs.sparkSession
    table = f"clipweave_units_{uuid.uuid4().hex}"
    units(docs).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit").option("path", new_path(spark, "word-units")).saveAsTable(table)
    held = spark.table(table)
    sizes = held.agg(F.sum("n_words"), F.sum("n_vocabulary")).first()
    bits, word_bits = (bits_for(n or 0) for n in sizes)

    def opened(one):
        vocabulary, words, many = from_gaps(one["vocabulary"]), unpacked(one["words"]).astype(np.int64), unpacked(one["sizes"]).astype(np.int64)
        return (vocabulary, words, many, *_bigrams(vocabulary, words, many))

    def ranges(hashes, values, hash_bits, b):
        cut = cuts(hashes, hash_bits, b).tolist()
        return [(gaps(hashes[a:z]), [packed(v[a:z]) for v in values]) if z > a else (None, None) for a, z in zip(cut[:-1], cut[1:], strict=True)]

    def send_bigrams(one):
        found, n = np.unique(opened(one)[3], return_counts=True)
        return ranges(found, [n], HASH_BITS, bits)

    counts = materialize(_answered(_sent(held, send_bigrams), _bigram_answer), "bigrams")
    counted = held.join(_by_unit(counts, "counts").hint("shuffle_hash"), "unit")

    def send_words(one):
        vocabulary, words, _, h, before = opened(one)
        _, first = np.unique(h, return_index=True)
        code, n = _in_order(one["counts"], 0).astype(np.int64), len(vocabulary)
        c, own = code >> 1, (code & 1).astype(bool)
        w1, w2 = before[first], words[first]
        kinds = (np.bincount(w1[own & k], minlength=n) for k in (c == 1, c == 2, c > 2))
        return ranges(vocabulary, [np.bincount(before, minlength=n), *kinds, np.bincount(w2[own], minlength=n)], 64, word_bits)

    stats = materialize(_answered(_sent(counted, send_words), _word_answer), "words")
    of_bigrams, of_words = _constants(counts), _constants(stats)

    def score(batches):
        free_memory("word grams")
        for batch in batches:
            for one in batch.to_pylist():
                _, words, many, h, before = opened(one)
                _, first, at = np.unique(h, return_index=True, return_inverse=True)
                c = _in_order(one["counts"], 0).astype(np.int64) >> 1
                total, once, twice, more, ahead = (_in_order(one["stats"], k).astype(np.int64) for k in range(len(STATS)))
                d = discounts(of_bigrams[one["lang"]][0])
                n, entries, all_ahead = of_words[one["lang"]]
                e = discounts(n)
                left = (e[1] * n[0] + e[2] * n[1] + e[3] * (entries - n[0] - n[1])) / all_ahead
                q = (ahead - e[np.minimum(ahead, 3)]) / all_ahead + left / (entries + 1)
                w1, w2 = before[first], words[first]
                p = (c - d[np.minimum(c, 3)] + (d[1] * once + d[2] * twice + d[3] * more)[w1] * q[w2]) / total[w1]
                value = -np.add.reduceat(np.log(p)[at], np.cumsum(many) - many) / many
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(one["docs"], "<i8")), pa.array(value)], names=["key", "score"])
        give_back()

    answered = _by_unit(counts, "counts").join(_by_unit(stats, "stats"), "unit")
    found = materialize(held.join(answered.hint("shuffle_hash"), "unit").mapInArrow(score, "key long, score double"), "word-scores")
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry; its files are in the shared folder, as those of other tables
    return found
