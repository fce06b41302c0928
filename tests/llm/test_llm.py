"""Operators of the llm subpackage: against SQL on the small tables, brute force and planted cases on small fixtures."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from clipweave.llm import decontam, filter_audit, html_extract, jaccard_join, links, minhash, packing, quality, queries, spelling, substring_dedup, token_store, toxicity, url_filter, warc, word_grams
from clipweave.llm.common import CLEANUP, hashed_words, materialize, send_array, sent_array, whole_groups
from clipweave.llm.tokenizer import WordEncoder
from compare import SF, connect, spark_rows, sql_rows
from pyspark import SparkFiles
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(connect(), queries.SQL[name])


AWKWARD = [None, "", " \t\n", "one", "one two", "one two", "é̀ x\u00a0y\x1cz", "word " * 5000, "### ||| $$$", "<|endoftext|> it's I'LL 12"]


def awkward(spark):
    """Nulls, empty and long texts, repeated rows, a null and a repeated doc_id, columns with internal names."""
    base = docs_of(spark, [*AWKWARD, "one two", "other"], [*range(len(AWKWARD)), None, 3])
    return base.union(base.limit(6)).withColumns({"kept": F.lit("x"), "score": F.lit(1), "rep": F.lit(2), "_bucket": F.lit(3), "row": F.lit("r")})


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")}

    before = shuffled()
    got = materialize(spark.range(50_000).groupBy(F.col("id") % 777).count(), "counted")
    for _ in range(50):  # they are removed in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert got.count() == 777 and spark.conf.get(CLEANUP) == "false"


def test_awkward_documents_have_a_row_each(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    n = docs.count()
    assert quality.quality_rules(docs).count() == n
    assert substring_dedup.substring_dedup(docs).count() == n
    assert minhash.near_duplicates(docs).count() == n
    assert jaccard_join.jaccard_components(docs).count() == n
    assert filter_audit.failures(docs).count() == n
    spelling.spelling_variants(docs).collect()
    assert toxicity.toxicity(docs, labels).count() == n
    assert packing.tokenized_pieces(docs, queries.word_bpe()).filter("piece = 0").count() == n
    assert substring_dedup.dedup_texts(docs).columns == docs.columns
    assert quality.filter_quality(docs).columns == docs.columns


def test_empty_tables(spark):
    docs = docs_of(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality_rules(docs).count() == 0
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    assert packing.pack_documents(docs, queries.word_bpe()).count() == 0
    assert decontam.leaks(docs, bench).count() == 0
    assert html_extract.extract(pages).count() == 0
    assert url_filter.filter_urls(pages).count() == 0


def test_toxicity_finds_learned_insults_and_leaves_clean_ones(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(400):
        w = prose(rng, 60)
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorky", "blavver", "gruntling"]) if i % 8 else "quax" + rng.choice(["en", "ung", "or", "ast"])
        texts.append(" ".join(w) + ".")
        toxic.append(int(i % 4 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(spark, texts), labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


N, R, T = toxicity.NEGATED, toxicity.REPORTED, toxicity.AIMED
CLAUSES = [
    ("trash", 0), ("you are trash", T), ("you are not trash", T | N), ("trash, not", 0), ("you are not bad, you are trash", T), ("you are not kind but trash", T), ("not one of these many long words is trash", 0),
    ("she said you are trash", T | R), ("I said you are trash", T), ("she said: you are trash", T | R), ("she said it. you are trash", T), ("«trash»", R), ("he is \"trash\" we think", T | R), ("\"a b. trash\" w", R),
]
THREATS = [("I will kill you", [T]), ("I will not kill you", [T | N]), ("she said I will kill you", [T | R]), ("kill him now", [T]), ("kill time", []), ("plants kill weeds", []), ("we are going to burn the garden", [0]), ("do they? kill them", [T])]


def marks_of(text):
    """Marks of each match, in order of marks, by clause."""
    return [[f for f in range(8) for _ in range(int(c[8 + f]))] for c in toxicity.Grammar({"trash": 4.0}).matched(text.encode())]


@pytest.mark.parametrize("text,marks", CLAUSES)
def test_insults_are_marked_in_their_scope(text, marks):
    assert marks_of(text)[0][0] == marks


@pytest.mark.parametrize("text,marks", THREATS)
def test_threats_need_intent_or_a_target(text, marks):
    assert [m for c in marks_of(text) for m in c] == marks


def test_cascade_matches_brute_force():
    rng = random.Random(7)
    alphabet = ["INSULT", "NEG", "TARGET", "REPORT", "FIRST", "CONJ", "COMMA", "COLON", "END", "OTHER", "OTHER"]
    for _ in range(300):
        symbols = [rng.choice(alphabet) for _ in range(25)]
        cascade = toxicity.Cascade()
        state, got = cascade.start, []
        for x in symbols:
            state, out = cascade.step(state, x)
            got += [f for kind, f in out if kind == "INSULT"]
        want = []
        for i, x in enumerate(symbols):
            if x == "INSULT":
                free = lambda j, closers: not closers & set(symbols[j + 1 : i])  # noqa: B023, E731
                neg = any(symbols[j] == "NEG" and free(j, {"END", "COLON", "COMMA", "CONJ"}) for j in range(max(0, i - toxicity.NEGATION_REACH), i))
                aimed = any(symbols[j] == "TARGET" and free(j, {"END", "COLON"}) for j in range(max(0, i - toxicity.TARGET_REACH), i))
                said = any(symbols[j] == "REPORT" and (j == 0 or symbols[j - 1] != "FIRST") and free(j, {"END"}) for j in range(i))
                want.append(N * neg | R * said | T * aimed)
        assert got == want


def test_minimal_pairs_move_the_score(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(400):
        w = prose(rng, 60)
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorky", "blavver", "gruntling"])
        texts.append(" ".join(w) + ".")
        toxic.append(int(i % 4 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels)
    score = model.scorer()
    rest = " w1 w2 w3 w4 w5 w6 w7 w8 w9. " * 8
    p = {k: score((t + "." + rest).encode()) for k, t in {"plain": "that is zorky", "aimed": "you are zorky", "negated": "you are not zorky", "reported": "she said you are zorky", "threat": "I will kill you", "no_threat": "I will not kill you", "clean": "you are w1"}.items()}
    assert p["aimed"] > p["plain"] > p["negated"] >= p["clean"] and p["aimed"] > p["reported"] and p["threat"] > 0.5 > p["no_threat"] >= p["clean"] and p["negated"] < 0.5
    assert all(f > 0 for f in model.factors)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(win)
    hit = {j for i, w in enumerate(win) if many[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics_match_brute_force(spark):
    rng = random.Random(1)
    texts = AWKWARD + ["\n".join(" ".join(prose(rng, 12, 9)) for _ in range(rng.randrange(1, 9))) + "#|<é" for _ in range(60)]
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_statistics(t)
        assert tuple(got[i][s] for s in quality.STATS) == want
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def brute_kneser_ney(words, n):
    """A plain interpolated modified Kneser-Ney over padded character n-grams: a function of (context + character)."""
    start, end = chr(quality.START), chr(quality.END)
    counts = [Counter() for _ in range(n + 1)]
    for w, k in words.items():
        p = start * (n - 1) + w + end
        for i in range(n - 1, len(p)):
            counts[n][p[i - n + 1 : i + 1]] += k
    for k in range(n - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        c = counts[len(g)]
        d = quality.discounts(np.array(list(c.values()), float))
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        gamma = sum(d[min(v, 3)] for v in same.values()) / total
        v = same.get(g, 0)
        return (v - d[min(v, 3)] if v else 0) / total + gamma * p(g[1:])

    return p


def test_kneser_ney_matches_brute_force():
    rng = random.Random(2)
    words = Counter("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(400))
    keys, n = quality.spelling_grams([w.encode() for w in words], np.array(list(words.values())), 3)
    spelling, p = quality.KneserNey.estimate(keys, n, 3), brute_kneser_ney(words, 3)
    model = quality.Model(None, spelling)
    for w in [*list(words)[:20], "zzz", "abz", "zab"]:
        padded = chr(quality.START) * 2 + w + chr(quality.END)
        want = sum(math.log(p(padded[i - 2 : i + 1])) for i in range(2, len(padded)))
        assert abs(model.spell([w.encode()])[0] - want) < 1e-4


def test_grams_are_counted_across_words_and_batches(spark):
    rng = random.Random(8)
    texts = [" ".join(prose(rng, rng.randrange(1, 60), 30)) + (" ### ### x" if i % 3 else "") for i in range(50)]
    got = {r.gram: r.n for r in quality.count_grams(docs_of(spark, texts)).filter("model = 'word'").collect()}
    want = Counter()
    for t in texts:
        before, last = 0, None
        for w in t.split():
            own = quality.REPEAT if w == last else quality.word_class(w.encode())
            want[before * quality.CLASSES + own] += 1
            before, last = own, w
    assert got == dict(want)


def brute_word_perplexities(docs):
    """(key, lang, text) -> key: mean of -log p under a plain interpolated modified Kneser-Ney over word bigrams."""
    out = {}
    for lang in {x for _, x, _ in docs}:
        own = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, x, t in docs if x == lang]
        pairs = Counter(p for _, w in own for p in zip([None, *w], w, strict=False))
        ahead = Counter(b for _, b in pairs)
        if not pairs:
            continue
        d, e = (quality.discounts(np.array(list(c.values()), float)) for c in (pairs, ahead))
        total, cut = Counter(), Counter()
        for (a, _), n in pairs.items():
            total[a] += n
            cut[a] += d[min(n, 3)]
        left = sum(e[min(n, 3)] for n in ahead.values()) / len(pairs)
        q = {b: (n - e[min(n, 3)]) / len(pairs) + left / (len(ahead) + 1) for b, n in ahead.items()}
        for k, w in own:
            if w:
                out[k] = -sum(math.log((pairs[a, b] - d[min(pairs[a, b], 3)] + cut[a] * q[b]) / total[a]) for a, b in zip([None, *w], w, strict=False)) / len(w)
    return out


def test_classes_of_many_words_are_those_of_each():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"aZ09.,-_'~^+=@\x00\xff\xc3\xa9\xb2") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    words += [w.encode() for w in ("\u0130x\u00b2\u0663\u00c0\u00c9", "\u00b2", "\u039f\u0394\u039f\u03a3\u03a3", "\u0391\u03a3", "word12345", "WORD99999", "ab^^~^^~", "^^~^^~^")]
    assert quality.Words().classes_of(words).tolist() == [quality.word_class(w) for w in words]


def test_word_bigrams_match_brute_force_across_units_and_ranges(spark, monkeypatch):
    rng = random.Random(12)
    docs = [(i, rng.choice(["en", "fr", None]), " ".join(prose(rng, rng.randrange(0, 80), rng.choice([20, 300])))) for i in range(150)]
    docs += [(200, "en", None), (201, "en", " \t"), (202, "xx", "one"), (203, "fr", "é̀ x\u00a0y\x1cz " * 9), (204, "yy", ""), (205, "en", docs[0][2]), (206, "en", docs[0][2])]
    df = spark.createDataFrame(docs, "key long, lang string, text string").repartition(3)
    want = brute_word_perplexities(docs)
    for words, entries in ((word_grams.UNIT_WORDS, word_grams.RANGE), (300, 200)):
        bits, units = word_grams.bits_for, word_grams.UNIT_WORDS
        monkeypatch.setattr(word_grams, "RANGE", entries)
        held = word_grams.units
        if words != units:
            monkeypatch.setattr(word_grams, "units", lambda d: held(d.repartition(20)))
            assert bits(1000) > 0
        got = {r.key: r.score for r in word_grams.log_perplexities(df, quality.discounts_from).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quality_bands_see_words_that_follow_no_usual_word(spark):
    """Each word's class and spelling are usual, and so are the classes in a row; only which word follows which is not."""
    rng = random.Random(6)
    names = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) + "an" for _ in range(400)]
    after = {a: rng.sample(names, 2) for a in names}

    def chain(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    texts = [" ".join(chain(250)) for _ in range(200)] + [" ".join(rng.choice(names) for _ in range(250)) for _ in range(6)]
    kept = [r.kept for r in quality.quality_rules(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert all(kept[:200]) and not any(kept[200:])
    assert quality.filter_quality(docs_of(spark, texts)).count() == 200


def grammatical(rng, n):
    """Sentences in which an article, an adjective, a noun and a verb follow each other."""
    out = []
    for _ in range(n):
        stem = lambda: rng.choice("bdfgkl") + rng.choice("aeiou") + rng.choice("mnprst")
        out += [rng.choice(["the", "a"]), stem() + "ish", stem() + "ens", stem() + "ked", rng.choice(["in", "on"])]
    return out


def test_quality_bands_reject_shuffled_texts_and_runs(spark):
    rng = random.Random(4)
    texts = [" ".join(grammatical(rng, rng.randrange(20, 60))) for _ in range(300)]
    shuffled = []
    for _ in range(10):
        w = grammatical(rng, 40)
        rng.shuffle(w)
        shuffled.append(" ".join(w))
    runs = []
    for _ in range(10):
        w = grammatical(rng, 30)
        runs.append(" ".join([*w[:60], *["This"] * 6, *w[60:70], *["riders"] * 5, *w[70:80], *["turned"] * 5]))
    kept = [r.kept for r in quality.quality_rules(docs_of(spark, texts + shuffled + runs)).orderBy("doc_id").collect()]
    assert sum(kept[:300]) >= 297 and not any(kept[300:])


def test_quality_bands_reject_noise_and_keep_prose(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice(["an", "er", "ti", "on", "the", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(150)) for _ in range(200)]
    texts += [" ".join("".join(rng.choice("qxzjkvw#%$") for _ in range(9)) for _ in range(150)) for _ in range(8)]
    kept = [r.kept for r in quality.quality_rules(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert all(kept[:200]) and not any(kept[200:])
    assert quality.filter_quality(docs_of(spark, texts)).count() == 200


def test_html_extraction_on_other_templates(spark):
    rng = random.Random(4)
    pages, want = [], []
    for i in range(80):
        body = [" ".join(prose(rng, rng.randrange(15, 40))) + "." for _ in range(4)]
        side = "".join(f"<li><a href='/{k}'>{w}</a></li>" for k, w in enumerate(prose(rng, 8)))
        inner = "".join(f"<p>{b}</p>" for b in body)
        box = [f"<article>{inner}</article>", f"<main><div class=content>{inner}</div></main>", f"<div id='post-body'>{inner}<div class='comments'><p>{' '.join(prose(rng, 20))}.</p></div></div>"][i % 3]
        pages.append((i, "http://x", f"<html><head><title>t</title></head><body><nav><ul>{side}</ul></nav><aside class='sidebar'><p>{' '.join(prose(rng, 9))}</p></aside>{box}<form>Name <input></form><footer>&copy; me</footer><script>var a = '<p>no</p>';</script></body></html>"))
        want.append(" ".join(body))
    pages += [(900, None, None), (901, "u", ""), (902, "u", "<p>a &amp; b<!-- x --><b>c"), (903, "u", "<" * 2000 + "<div class='" + "x" * 5000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert sum(got[i].text == w for i, w in enumerate(want)) >= 76
    assert got[900].text == "" and got[901].n_chars == 0 and len(got) == 84


def test_html_decoding_is_consistent_on_the_tree():
    page = html_extract.Page("<body><div><p>aa bb</p><p>cc</p></div><div><p>dd</p></div></body>")
    page.features()
    rng = np.random.default_rng(0)
    for _ in range(200):
        keep = page.decode(rng.normal(0, 2, len(page.kind)))
        assert all(keep[page.parent[i]] for i in range(1, len(keep)) if keep[i])


def brute_substrings(texts, width):
    seen, out = set(), []
    for t in texts:
        w = (t or "").split(" ") if t else []
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        cover = set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                cover.update(range(i, i + width))
            seen.add(k)
        out.append((len(w), len(cover), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in cover).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("cells", [1 << 6, None])
def test_substring_dedup_matches_brute_force(spark, cells):
    rng = random.Random(6)
    base = [prose(rng, rng.randrange(0, 90), 50) for _ in range(60)]
    passage = prose(rng, 30)
    for d in base[::3]:
        at = rng.randrange(len(d) + 1)
        d[at:at] = passage
    texts = [" ".join(d) for d in base] + [" ".join(base[3]), "a " * 70, None]
    got = substring_dedup.digest(substring_dedup.substring_dedup(docs_of(spark, texts).repartition(5), cells=cells)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute_substrings(texts, 20)


def brute_glob(globs, url):
    return any(re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), url, re.S) for g in globs)


def test_gathered_cells_are_listed_in_little_memory():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 1 << 24, 1_000_000, dtype=np.uint32)
    cells[:9] = 77
    gathered = [cells[:500_000].copy(), cells[500_000:].copy()]
    tracemalloc.start()
    listed = dict(substring_dedup._listed(gathered, 1 << 8, 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.concatenate([(b << 16) + substring_dedup._cells_of(g) for b, g in sorted(listed.items())])
    values, times = np.unique(cells, return_counts=True)
    assert got.tolist() == np.repeat(values, np.minimum(times, 2)).tolist()
    assert peak < 3.3 * cells.nbytes and not gathered  # 2.5 times; 4.2 with copies of 64 bits


def test_sketch_is_mapped_from_one_file_by_all_workers(spark):
    rng = random.Random(35)
    shared = " ".join(prose(rng, 60, 10**6))
    texts = spark.createDataFrame([(" ".join(prose(rng, 40, 10**6)) + " " + shared,) for _ in range(20)], "text string").repartition(4)
    name = substring_dedup._sketch(texts, 1 << 10, substring_dedup.WIDTH)

    def run(batches):
        for _ in batches:
            bits = sent_array(name)
            yield pa.RecordBatch.from_arrays([pa.array([isinstance(bits.base, np.memmap)]), pa.array([int(bits.any(1).sum())])], names=["mapped", "rows"])

    assert {tuple(r) for r in texts.mapInArrow(run, "mapped boolean, rows long").collect()} == {(True, 2)}


def test_sent_arrays_travel_compressed_and_arrive_whole(spark):
    bits = np.zeros((2, 1 << 20), np.uint8)
    bits[:, ::64] = np.random.default_rng(1).integers(0, 256, (2, 1 << 14), np.uint8)
    name = send_array(spark, bits, "test")
    assert os.path.getsize(SparkFiles.get(name)) < bits.nbytes // 4
    assert (sent_array(name) == bits).all() and (sent_array(name) == bits).all()


def test_globs_match_brute_force():
    rng = random.Random(7)
    globs = ["*", "", "a*b", "?b*", "*é?", "abc", "*a*b*c*", "??"] + ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    urls = ["", "ab", "é", "abé́", "éa"] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    for g in globs + [globs[1:]]:
        g = [g] if isinstance(g, str) else g
        assert url_filter.Globs(g).match([u.encode() for u in urls]).tolist() == [brute_glob(g, u) for u in urls]


def test_url_parts(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Org?x/y"), (4, "x://u@EXAMPLE.org:8/es/#a"), (5, "a://b://c.com/fr/x"), (6, "s://spam-farm.net/x"), (7, "s://notorg/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "", None, "allow") and got[4][:2] == ("u@example.org:8", "/es/")
    assert got[6][3] == "block" and got[7] == ("notorg", "/", None, "allow")


def test_url_rules_are_those_of_the_contract(spark):
    want = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    rows = [(i, f"s://{host}{rule}2") for i, (rule, host) in enumerate((r, h) for r in want for h in ("", "sub."))]
    got = [(r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [(r, v) for r, v in want.items() for _ in range(2)]


def test_warc_rejects_magic_inside_payloads(spark, tmp_path):
    rng = random.Random(8)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = []
    for i in range(120):
        html = "".join(rng.choice(["abc é ", "\r\n\r\n", "WARC/1.0\r\n", fake, "x" * 700]) for _ in range(rng.randrange(0, 9)))
        pages.append((i, f"http://h/{i}\r\nX: y", html))
    pages += [(200, None, None), (201, "u", "q" * 1000), (202, "u", "q" * 1000), (203, "u", "q" * 1000), (204, "u", "q" * 999), (205, "u", "q" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for block in ("128m", "9000b", "2000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = {int(re.search(r"-?\d+", r.record_id)[0]): r for r in warc.read_warc(spark, path).collect()}
            assert len(got) == len(pages) and 666 not in got
            for i, _, html in pages:
                data = (html or "").encode()
                if got[i].record_type == "response":
                    assert bytes(got[i].payload) == data
                assert got[i].digest == hashlib.sha1(data).hexdigest() and got[i].payload_length == len(data)
            assert [got[i].record_type for i in (201, 202, 203, 204, 205)] == ["revisit", "revisit", "response", "response", "response"]
            assert got[201].refers_to == "<urn:page:203>"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_encoder_equals_whole_text_encoding(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + AWKWARD + ["İIΣ ς ΑΣ Σ", "日本語 テスト", "a'b' s't ½²"]
    coder = WordEncoder(queries.word_bpe(), most_words=500)
    ids, off = coder.encode([t.encode() if t is not None else None for t in texts], 7)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7]


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(9)
    sizes = [*np.minimum(2048, rng.lognormal(5.5, 1, 3000).astype(int) + 1).tolist(), 2048, 1, 2047]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES)
    for group in (60_000, 500):
        got = packing.best_fit_pack(pieces, group=group).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 2048
        assert len(bins) <= math.ceil(sum(sizes) / 2048) * 1.02 + 1


def test_packed_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    placed = packing.pack_documents(docs, queries.word_bpe()).cache()
    seqs = {r.sequence_id: np.array(r.ids, "<u4") for r in packing.sequences(docs, placed, queries.word_bpe()).collect()}
    for r in placed.collect():
        assert zlib.crc32(seqs[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32


def test_store_round_trip_and_verification(spark, tmp_path):
    docs = docs_of(spark, [*AWKWARD, "alpha beta " * 900, "gamma " + "alpha beta " * 900], [*range(3, 3 + len(AWKWARD)), 1, 2])
    path = f"file://{tmp_path}/s"
    token_store.write_store(docs, path, queries.word_bpe(), 2)
    coder, at = WordEncoder(queries.word_bpe()), 0
    got = {r.doc_id: r for r in token_store.read_digests(spark, path).collect()}
    full = {r.doc_id: r.ids for r in token_store.read_documents(spark, path).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert full[r.doc_id] == ids.tolist()
        at += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    bad = chunks.withColumn("ids", F.when(F.octet_length("ids") > 200, F.concat("ids", F.lit(b"\0\0"))).otherwise(F.col("ids")))
    bad.write.parquet(f"file://{tmp_path}/b/chunks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"file://{tmp_path}/b/{part}")
    with pytest.raises(Exception, match="content of its name"):
        token_store.read_digests(spark, f"file://{tmp_path}/b").collect()
    junk = F.when(F.col("doc_id") == 2, F.lit(b"0123456789abcdef")).otherwise(F.col("root"))
    tampered = {
        "root": ("manifest", lambda m: m.withColumn("root", F.lit(b"0123456789abcdef"))),
        "lost_row": ("manifest", lambda m: m.filter("level > 0")),
        "recipe_root": ("recipes", lambda r: r.withColumn("root", junk)),
        "recipe_id": ("recipes", lambda r: r.withColumn("doc_id", F.col("doc_id") + 1)),
        "lost_chunk": ("chunks", lambda c: c.limit(1)),
    }
    for name, (what, edit) in tampered.items():
        for part in ("chunks", "recipes", "manifest"):
            df = spark.read.parquet(f"{path}/{part}")
            (edit(df) if part == what else df).write.parquet(f"file://{tmp_path}/{name}/{part}")
        with pytest.raises(Exception, match="the manifest contradicts|cannot be rebuilt"):
            token_store.read_digests(spark, f"file://{tmp_path}/{name}").collect()


def test_manifest_tree_has_levels_up_to_one_root(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 4)
    rows = [(f"{i:016d}".encode(), i) for i in range(21)]
    recipes = spark.createDataFrame([(i, i, 2 * i, 2, r) for r, i in rows], "place long, doc_id long, start long, n_tokens long, root binary")
    got = {(r.level, r.node): (r.documents, r.root) for r in token_store.manifest(recipes).collect()}
    nodes = [hashlib.blake2b(b"%d,%d,%d,2," % (i, i, 2 * i) + r, digest_size=16).digest() for r, i in rows]
    level = 0
    while level == 0 or len(nodes) > 1:
        nodes = [token_store.merkle_root(nodes[i : i + 4]) for i in range(0, len(nodes), 4)]
        assert [got[level, i][1] for i in range(len(nodes))] == nodes
        assert sum(v[0] for k, v in got.items() if k[0] == level) == 21
        level += 1
    assert max(k[0] for k in got) == level - 1


def test_joined_crc_and_narrow_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 32, n, np.uint32).tobytes() for n in (5, 900))
    assert token_store.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([900]))[0] == zlib.crc32(a + b)


def test_store_of_awkward_and_empty_tables(spark, tmp_path):
    docs = awkward(spark)
    for name, d in (("a", docs), ("e", docs.limit(0))):
        token_store.write_store(d, f"file://{tmp_path}/{name}", queries.word_bpe(), 2)
        rows = token_store.read_digests(spark, f"file://{tmp_path}/{name}").orderBy("start").collect()
        assert len(rows) == d.count()
        assert all(y.start == x.start + x.n_tokens for x, y in itertools.pairwise(rows))
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))


def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    again = True
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while again:
        again = False
        for i, j in links:
            m = min(comp[i], comp[j])
            again |= comp[i] != m or comp[j] != m
            comp[i] = comp[j] = m
    return [len(s) for s in sets], comp


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, k, percent):
    rng = random.Random(10)
    texts = []
    for _ in range(12):
        base = prose(rng, 120)
        for _ in range(8):
            d = list(base)
            for _ in range(rng.randrange(0, 8)):
                d[rng.randrange(len(d))] = f"n{rng.randrange(1000)}"
            texts.append(" ".join(d))
    texts += ["A b C", "a B c", "a b", "A b", "x", "", None, texts[5].upper()]
    got = minhash.near_duplicates(docs_of(spark, texts), percent=percent, k=k).orderBy("doc_id").collect()
    sizes, comp = brute_groups(texts, k, percent)
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == comp
    assert [r.kept for r in got] == [i == c for i, c in enumerate(comp)]


def test_large_near_copy_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(11)
    base = prose(rng, 60)
    texts = []
    for _ in range(90):
        d = list(base)
        for _ in range(3):
            d[rng.randrange(60)] = f"n{rng.randrange(10_000)}"
        texts.append(" ".join(d))
    got = minhash.near_duplicates(docs_of(spark, texts), percent=70, k=3).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == brute_groups(texts, 3, 70)[1]


def test_unlinked_documents_of_a_template_are_not_dealt_in_squares(spark, monkeypatch):
    """600 documents share most of their words, none links: what is compared stays in proportion to them."""
    rng = random.Random(21)
    base = prose(rng, 100, 10**6)
    texts = [" ".join([*base, *prose(rng, 30, 10**6)]) for _ in range(600)]
    dealt = []
    across = jaccard_join.across
    monkeypatch.setattr(jaccard_join, "across", lambda rows, percent: (dealt.append(rows.count()), across(rows, percent))[1])
    got = minhash.near_duplicates(docs_of(spark, texts), percent=85, k=3).collect()
    assert all(r.kept for r in got) and dealt[0] <= 600


def test_b_bit_estimates_are_unbiased():
    rng = np.random.default_rng(12)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(40):
            n = 400
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            own = [np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) for _ in range(2)]
            true = len(both) / (2 * n - len(both))
            bits = minhash.pack(np.stack([minhash.minima(s) for s in own]))
            got.append(float(minhash.estimate(bits[0], bits[1])) - true)
        assert abs(np.mean(got)) < 0.02


def brute_align(a, b):
    best = 0
    m = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i, j] = max(0, m[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] and b[j - 1] > 0 else -1), m[i - 1, j] - 1, m[i, j - 1] - 1)
            best = max(best, m[i, j])
    return best / (2 * len(a))


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(13)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        score, x, y = decontam.align(a, b)
        assert score == pytest.approx(brute_align(a.tolist(), b.tolist()))
        assert 0 <= x <= y <= len(b)


def test_leaks_exact_edited_and_clean(spark):
    rng = random.Random(14)
    items = [" ".join(prose(rng, 30, 3000)) for _ in range(20)] + ["tiny item", None, ""]
    bench = spark.createDataFrame([*enumerate(items), (None, "a b c d e")], "item_id long, text string").withColumn("text2", F.lit("x"))
    texts, want = [], set()
    for i in range(20):
        w = items[i].split()
        if i % 3 == 1:
            for j in range(4, 30, 7):
                w[j] = "edited"
        if i % 3 == 2:
            del w[10:12]
        texts.append(" ".join(prose(rng, 50, 3000) + ["And,"] + [x.upper() + "," for x in w] + prose(rng, 50, 3000)))
        want.add((i, i))
    texts += [" ".join(prose(rng, 150, 3000)) for _ in range(40)] + [None, "", items[0]] + [items[3]] * 30
    want |= {(62, 0)} | {(63 + k, 3) for k in range(30)}
    got = decontam.leaks(docs_of(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score == 1 for r in got if r.doc_id >= 62)


def leaks_without_search(items, texts, least=0.5):
    """Every pair aligned over the whole document."""
    known = decontam.Items(items)
    out = {}
    for d, t in enumerate(texts):
        numbers = known.numbers(t.encode())
        for item, words in zip(known.ids, known.words, strict=True):
            s = decontam.align(words, numbers)[0]
            if s >= least:
                out[d, item] = max(s, out.get((d, item), 0))
    return out


def found_leaks(spark, items, texts):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs_of(spark, texts), bench).collect()}


def test_leaks_of_an_item_cut_short_in_many_documents(spark):
    rng = random.Random(31)
    words = prose(rng, 59, 10**6)
    texts = [" ".join(prose(rng, 20) + words[:41] + prose(rng, 20)) for _ in range(60)] + [" ".join(prose(rng, 20) + words) for _ in range(3)]
    got = found_leaks(spark, [(7, " ".join(words))], texts)
    assert got == leaks_without_search([(7, " ".join(words))], texts) and len(got) == 63


def test_leaks_without_an_intact_run(spark):
    rng = random.Random(32)
    items = [(i, " ".join(prose(rng, 16 + i, 2000))) for i in range(24)]
    texts = []
    for i, t in items:
        w, out = t.split(), []
        for j, x in enumerate(w):
            replaced = i % 3 == 1 and j % 4 == 3 or i % 3 == 2 and rng.random() < 0.3
            out += ["foreign"] if replaced else [x]
            out += ["foreign"] * (i % 3 == 0 and j % 3 == 2 or i % 3 == 2 and rng.random() < 0.2)
        texts.append(" ".join(prose(rng, 30, 2000) + out + prose(rng, 30, 2000)))
    got = found_leaks(spark, items, texts)
    assert got == leaks_without_search(items, texts)
    assert {(i, i) for i in range(24) if i % 3 < 2} <= set(got)


def test_places_hold_every_alignment(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_HITS", 200)
    monkeypatch.setattr(decontam, "BLOCK", 64)
    rng = random.Random(33)
    items = decontam.Items([(i, " ".join(prose(rng, rng.randrange(4, 12), 30))) for i in range(40)])
    for least in (0.3, 0.5, 0.8, 1.0):
        find, leaks = decontam.Finder(items, np.array([rng.randrange(5) for _ in range(len(items.vocab) + 1)]), least), 0
        for _ in range(6):
            text = items.numbers(" ".join(prose(rng, 250, 60)).encode())
            best = {}
            for o, a, z in find.places(text):
                best[o] = max(best.get(o, 0), decontam.align(items.words[o], text[a:z])[0])
            for o, w in enumerate(items.words):
                s = decontam.align(w, text)[0]
                leaks += s >= least
                assert s < least or best[o] == s
        assert leaks or least > 0.5


def test_words_of_items_are_counted_in_all_documents(spark):
    rng = random.Random(34)
    items = decontam.Items([(i, " ".join(prose(rng, 12, 60))) for i in range(5)])
    texts = [" ".join(prose(rng, rng.randrange(1, 40), 80)) for _ in range(60)] + [None, "", "--- W1, w1"]
    want = Counter(n for t in texts for n in items.numbers((t or "").encode()).tolist())
    got = {r.word: r.n for r in decontam._counts(docs_of(spark, texts), spark.sparkContext.broadcast(items)).collect()}
    assert got == dict(want)


def test_numbers_of_many_texts_are_those_of_each(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 40)
    rng = random.Random(36)
    items = decontam.Items([(1, "Straße ÉTÉ w1 w2 don't"), (2, "w3 İx ὈΔΟΣ A-B été")])
    some = ["STRASSE", "straße,", "(ÉTÉ)", "été", "W1", "w2.", "--", "İX", "ὁδός", "ὀδοσ", "a-b!", "DON'T", "é", "\u00a0", "w3\x1cw1"]
    texts = [None, "", " \t\n", "\x0b w1\x0c"] + ["".join(rng.choice(some) + rng.choice(" \t\n\r\x0b\x0c") for _ in range(rng.randrange(30))) for _ in range(40)]
    column, got = pa.array(texts, pa.string()), []
    for a, z in decontam._pieces(column):
        row, at = items.numbers_of(column.slice(a, z - a))
        got += [row[at[i] : at[i + 1]].tolist() for i in range(z - a)]
    assert got == [items.numbers(None if t is None else t.encode()).tolist() for t in texts]


def test_leaks_of_items_of_one_to_three_words(spark):
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "delta, epsilon zeta")]
    texts = ["x x x alpha x x", "x beta gamma x x x", "x x delta epsilon zeta x", "x beta x gamma x delta epsilon x zeta x"]
    assert found_leaks(spark, items, texts) == {(0, 1): 1, (1, 2): 1, (2, 3): 1}


def test_pipeline_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path_docs = left
        left = corpus_pipeline.materialize(stage(spark, path_docs, SF), name)
        assert left.columns == docs.columns and left.count() <= path_docs.count()
    known = {r.doc_id for r in left.collect()}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == known and known
    assert decontam.leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_html_cut_off_tags_are_no_text():
    page = html_extract.Page("<article><p>Real text, of some words.</p><div a='xxx and more words")
    assert "".join(s for n, s in page.pieces if n >= 0) == "Real text, of some words."
    assert "".join(s for n, s in html_extract.Page("<p>1 < 2 and 3 > 2").pieces if n >= 0) == "1 < 2 and 3 > 2"


def test_html_awkward_pages(spark):
    long = "<article>" + "<p>Some words, of a long page.</p>" * 3000 + "</article>"
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<p>x"), (3, "w", long), (3, "w", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "h": F.lit(1), "y": F.lit(2), "n_chars": F.lit("z")})
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0, 0] and len({r.text for r in got if r.page_id == 3}) == 1


def test_url_awkward_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "http://A.com/de/x"), (3, "http://example.org/" + "a" * 100_000), (3, "nohost")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "rule": F.lit(3), "verdict": F.lit(4), "c": F.lit(5)})
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows) and [r.host for r in got if r.page_id in (1, 2)] == ["", "", ""]
    assert next(r for r in got if r.page_id is None)[1:] == ("a.com", "/de/x", "com/de/", "block")


def test_whole_warc_records_are_read_by_one_python_worker_a_task(spark, tmp_path):
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 2000 + id) AS html")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w")
    assert sorted(r.payload_length for r in got.collect()) == list(range(2000, 2050))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_warc_awkward_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", None), (1, "u", None), (2, None, "x" * 1200), (3, "a\r\nb", "x" * 1200), (3, "c", "x" * 1200), (None, "d", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "refers_to": F.lit(1), "value": F.lit("v"), "size": F.lit(3)})
    for name, p in (("a", pages), ("e", pages.limit(0))):
        warc.write_warc(p, f"file://{tmp_path}/{name}")
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert len(got) == p.count()
    warc.write_warc(pages, f"file://{tmp_path}/b")
    got = warc.read_warc(spark, f"file://{tmp_path}/b").collect()
    assert sorted((r.record_id, r.record_type, r.payload_length) for r in got) == sorted([("<urn:page:1>", "response", 0)] * 2 + [("<urn:page:2>", "revisit", 1200)] + [("<urn:page:3>", "response", 1200)] * 2 + [("<urn:page:>", "response", 300_000)])


def test_packing_awkward_rows(spark):
    docs = awkward(spark).withColumns({"piece": F.lit("p"), "start": F.lit(1), "length": F.lit(2), "sequence_id": F.lit(3), "offset": F.lit(4), "bin": F.lit(5), "free": F.lit(6)})
    got = packing.pack_documents(docs, queries.word_bpe()).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rs in whole.values():
        at = 0
        for o, n in sorted(rs):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert sum(r.piece == 0 for r in got) == docs.count()


def test_packing_matches_a_plain_rule():
    """Each piece goes where the squared counts of open bins per gap sum to the least; the smallest gap of equals; a new bin where none has room."""
    rng = random.Random(11)
    for _ in range(20):
        sizes = sorted((rng.randrange(1, 40) for _ in range(60)), reverse=True)
        bins, offsets = packing.sum_of_squares_pack(np.array(sizes), 40)
        open_bins = []  # gaps
        for i, s in enumerate(sizes):
            count = Counter(g for g in open_bins if g > 0)
            best = None
            for g in sorted(count):
                if g >= s:
                    after = count.copy()
                    after[g] -= 1
                    if g > s:
                        after[g - s] += 1
                    key = sum(v * v for v in after.values())
                    if best is None or key < best[0]:
                        best = key, g
            if best is None:
                open_bins.append(40)
                assert bins[i] == len(open_bins) - 1 and offsets[i] == 0
            else:
                assert open_bins[bins[i]] == best[1] and offsets[i] == 40 - best[1]
            open_bins[bins[i]] -= s


def test_leaks_awkward_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = docs_of(spark, [item, item, None, "", "x " * 50_000 + item], [1, 1, 2, None, None]).withColumns({"item_id": F.lit("x"), "score": F.lit(1), "end": F.lit(2)})
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, "")], "item_id long, text string").withColumn("doc_id", F.lit("d"))
    got = sorted(((r.doc_id, r.item_id, r.score) for r in decontam.leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 7, 1.0)] * 2 + [(None, 7, 1.0)], key=repr)


def test_pipeline_stages_on_awkward_and_empty_tables(spark):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars", "kept", "score", "rep")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, d, SF).columns == d.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() >= (d.count() and 1)


def near_copies(rng, n_groups=12, size=6, length=60, edits=2):
    """Groups of texts of `length` words that differ in a few words, some alike, beside short and lone texts."""
    out = []
    for g in range(n_groups):
        base = [f"g{g}x{rng.randrange(500)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def linked_components(texts, k, percent):
    """Smallest index reachable over pairs with 100 * intersection >= percent * union, by trying all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))]


@pytest.mark.parametrize("boundary", [1, None, 16])
def test_jaccard_join_equals_all_pairs(spark, boundary):
    rng = random.Random(11)
    texts = near_copies(rng) + near_copies(rng, 25, 5, 15, 1) + near_copies(rng, 25, 5, 9, 1) + [None, "", "a", "A", "a b", "b a", "a b c d"]
    for t in list(texts[:40]):  # supersets, so that sizes differ
        texts.append(f"{t} {'tail ' * rng.randrange(3)}x{rng.randrange(9)}")
    rows = jaccard_join.jaccard_components(docs_of(spark, texts), boundary=boundary).collect()
    assert sorted(map(tuple, rows)) == linked_components(texts, 4, 85)


def test_jaccard_join_of_a_large_list_in_blocks(spark, monkeypatch):
    """Texts of one template that link in part, more than a block of them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(12)
    texts = near_copies(rng, 1, 120, 90, 5)
    rows = jaccard_join.jaccard_components(docs_of(spark, texts)).collect()
    assert sorted(map(tuple, rows)) == linked_components(texts, 4, 85)


def test_hashes_of_many_texts_tell_words_apart():
    rng = random.Random(37)
    some = [b"".join(rng.choice([b"a", b"b", b"\0", b"\xc3\xa9", b"\x1c", b"\xc2\xa0"]) for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    some += [b"x" * n for n in (7, 8, 9, 16, 17, 511, 512, 513, 5000)] + [b"\0" * n for n in range(1, 20)]
    texts = [None, b"", b" \t\n\r\x0b\x0c", b"a", b" a"] + [b"".join(rng.choice(some) + rng.choice([b" ", b"\n", b"\x0b", b"\t \r", b"\x0c"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    h, many = hashed_words(texts)
    words = [w for t in texts for w in (t or b"").split()]
    assert many.tolist() == [len((t or b"").split()) for t in texts]
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    for k in (1, 3, 4):
        for t, s in zip(texts, links.shingle_sets(texts, k), strict=True):
            w = (t or b"").lower().split()
            assert len(s) == len({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}) * bool(w)
            assert (np.diff(s.astype(object)) > 0).all() and s.tolist() == links.shingle_sets([t], k)[0].tolist()


def test_jaccard_light_subsets_and_boundary():
    rng = random.Random(3)
    for s, t in itertools.product(range(1, 24), repeat=2):
        fits = any(100 * o >= 85 * (s + t - o) for o in range(min(s, t) + 1))
        assert (t in jaccard_join.partners(s)) == fits
        if fits:
            assert jaccard_join.least_overlap(s, t) == min(o for o in range(min(s, t) + 1) if 100 * o >= 85 * (s + t - o))
    x = np.array([rng.randrange(1 << 63) for _ in range(9)], np.uint64)
    keys = jaccard_join.subset_keys(x, 7)
    assert len(set(keys.tolist())) == math.comb(9, 7)
    assert set(jaccard_join.subset_keys(x[:8], 7).tolist()) <= set(keys.tolist())
    sizes = {8: 1000, 20: 1000}
    assert jaccard_join.boundary_of(sizes, 1.0) <= 8
    assert jaccard_join.boundary_of(sizes, 50.0) in range(9, 21)
    assert jaccard_join.boundary_of(sizes, 1e6) > 20


def audit_by_hand(docs, labels):
    """docs: (doc_id, text, source); labels: doc_id -> (quality, toxic)."""
    masks = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        masks.append((source or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, labels.get(i, (None, None))))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = set()
            for step, x in enumerate(order, 1):
                removed = [m for m in own if x in m[1] and not m[1] & gone]
                gone.add(x)
                total[x] += len(removed)
                out[part, order, step] = [sum(not m[1] & gone for m in own), len(removed), sum(x in m[1] for m in own) - len(removed), sum(m[1] == {x} for m in own), sum(m[2][0] == 1 for m in removed), sum(m[2][1] == 1 for m in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_equals_going_through_all_orders(spark):
    rng = random.Random(8)
    texts = [" ".join(prose(rng, rng.choice([5, 60, 200]), rng.choice([30, 900]))) for _ in range(60)]
    texts = [t.upper() if rng.random() < 0.2 else t + " #" if rng.random() < 0.2 else t for t in texts]
    opening = "the same opening line of many texts " * 40
    texts += [opening + t for t in texts[:30]] + [opening, opening[:100], None, "", "é" * 60] + rng.choices(texts, k=40)
    docs = [(rng.randrange(500), t, rng.choice(["a", "b", None, ""])) for t in texts] + [(None, texts[0], "a"), (None, None, None)]
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1])) for i in {d[0] for d in docs if d[0] is not None} if i % 3}
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit("x"), "part": F.lit(1), "good": F.lit(2)})
    marks = spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")
    for size in (1 << 20, 700):  # one range, and many
        rows = filter_audit.audit(frame.repartition(7), marks, size).collect()
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in rows}
        assert len(rows) == len(got) and got == audit_by_hand(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0


def test_prefix_boundaries_go_beyond_what_texts_share(spark):
    opening = "shared " * 60
    texts = [f"{opening}{i:04}" for i in range(400)] + [f"{i:04}" for i in range(400)]
    cuts = filter_audit.prefix_boundaries(docs_of(spark, texts).select("text"), 16)
    counts = Counter(sum(t.encode() >= c for c in cuts) for t in texts)
    assert len(cuts) >= 10 and max(counts.values()) <= 200


def test_trie_holds_the_smallest_id_of_each_text():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=rng.randrange(9))).encode() for _ in range(500)] + [b"", "é".encode(), "è".encode()]
    trie = filter_audit.Trie()
    ends = [trie.insert(t, n * 7919 % 503) for n, t in enumerate(texts)]
    for t, end in zip(texts, ends, strict=True):
        assert trie.least[end] == min(n * 7919 % 503 for n, u in enumerate(texts) if u == t)


def spelling_by_hand(docs):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in n:
        around = [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = (form[w], n[w], len(around), n[best] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


@pytest.mark.parametrize("cell", [None, 10, 1])
def test_spelling_variants_equal_comparing_all_words(spark, cell):
    rng = random.Random(13)
    stems = ["".join(rng.choices("abcdeéß", k=rng.randrange(5, 9))) for _ in range(40)] + ["abcdef", "bacdef", "fedcba"]
    words = []
    for s in stems:
        words += [s] * 200
        for _ in range(4):  # chains: stem, variant, variant of the variant
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abé") + s[i:], s[:i] + rng.choice("abÀÿ") + s[i + 1 :]])
            words += [s] * rng.choice([5, 6, 30])
    rng.shuffle(words)
    texts = [rng.choice([" ", "\n", "·1", "×", "ā"]).join(w.upper() if w.isascii() and rng.random() < 0.3 else w for w in words[i : i + 50]) for i in range(0, len(words), 50)]
    docs = [*enumerate(texts), (None, texts[0]), (3, texts[1]), (3, texts[1]), (4, None), (5, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "word": F.lit(1), "cell": F.lit(2)})
    rows = spelling.spelling_variants(frame, cell).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(rows) == len(got) and got == spelling_by_hand(docs)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_large_leaves_are_matched_by_halves():
    words = [("".join(p), 1) for p in itertools.permutations("abcdefg")][:1500]
    group = {c: i % 3 for i, c in enumerate("abcdefgh")}
    words += [(w[:3] + "h" + w[3:], 1) for w, _ in words[:300]] + [(w[:6] + "h", 1) for w, _ in words[:200]]
    found = Counter(frozenset((a[0], b[0])) for a, b in spelling.near_pairs(words, words, group))
    texts = [w for w, _ in words]
    one = {w[:i] + w[i + 1 :] for w in texts for i in range(len(w))}
    slow = {frozenset(p) for p in itertools.combinations(sorted(set(texts)), 2) if len(p[0]) == len(p[1]) and sum(x != y for x, y in zip(*p, strict=True)) == 1}
    slow |= {frozenset((w, w[:i] + w[i + 1 :])) for w in texts for i in range(len(w)) if w[:i] + w[i + 1 :] in set(texts) & one}
    assert set(found) == slow and set(found.values()) == {1}


def test_whole_groups_over_batches():
    keys = [b"a\0\0", b"a\0\0", b"a\0", b"a", b"b", b"b", b"b", b"c\0"]
    rows = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "n": list(range(8))})
    for size in (1, 2, 3, 8):
        batches = [rows.slice(i, size) for i in range(0, 8, size)] + [rows.slice(0, 0)]
        got = [[tuple(r.values()) for r in b.to_pylist()] for b in whole_groups(batches, ["key"])]
        assert [r for b in got for r in b] == list(zip(keys, range(8), strict=True))
        assert all(b[-1][0] != c[0][0] for b, c in itertools.pairwise(got))


def without_names(html):
    """The page with its class, id and role attributes gone and semantic tags made div."""
    html = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html or "")
    return re.sub(r"<(/?)(nav|menu|header|footer|aside|form|article|main|section|fieldset)\b", r"<\1div", html)


def test_html_trees_judge_pages_that_name_nothing(spark):
    pages = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet")
    trees = html_extract.train(pages)
    used = {int(f) for feature, cut, _ in trees.trees for f, c in zip(feature, cut, strict=True) if c < html_extract.BINS}
    assert len(used) >= 5
    named = {r.page_id: r for r in html_extract.extract(pages, trees).collect()}
    bare = spark.createDataFrame([(r.page_id, r.url, without_names(r.html)) for r in pages.collect()], "page_id long, url string, html string")
    f1 = []
    for r in html_extract.extract(bare, trees).collect():
        x, y = Counter(named[r.page_id].text.split()), Counter(r.text.split())
        f1.append(2 * (x & y).total() / (x.total() + y.total()))
    assert min(f1) > 0 and sum(f1) / len(f1) >= 0.95


def test_html_decoding_is_the_best_of_all_consistent_choices():
    rng = random.Random(4)

    def tree(depth):
        return "".join(f"<div>{'word ' * rng.randrange(4)}{tree(depth - 1) if depth else ''}</div>" for _ in range(rng.randrange(1, 3)))

    for _ in range(60):
        page = html_extract.Page(tree(2))
        page.features()
        n = len(page.kind)
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        value = [odds[i] * math.log1p(page.own[i]) if page.own[i] else odds[i] * math.log1p(page.total[i]) if odds[i] < -1 else 0.0 for i in range(n)]
        value[0] = 0.0
        best = max(sum(value[i] for i in range(n) if s >> i & 1) for s in range(1, 1 << n, 2) if all(s >> page.parent[i] & 1 for i in range(1, n) if s >> i & 1)) if n < 14 else None
        keep = page.decode(odds)
        assert keep[0] and all(keep[page.parent[i]] for i in range(1, n) if keep[i])
        assert best is None or sum(v for v, k in zip(value, keep, strict=True) if k) == pytest.approx(best)


def test_html_trees_take_the_best_split_of_every_node():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (80, 4)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3)).astype(float)
    made = html_extract.Trees(x, y, trees=2, depth=2)
    b, score = made.bins(x), np.full(80, made.base)

    def gain(g, h, left):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(np.ones(len(g), bool))

    for feature, cut, leaf in made.trees:
        p = 1 / (1 + np.exp(-score))
        g, h, rows = y - p, p * (1 - p), [np.arange(80)]
        for level in range(2):
            after = []
            for k, r in enumerate(rows):
                at = 2**level - 1 + k
                best = max((gain(g[r], h[r], b[r, j] <= c) for j in range(4) for c in range(6)), default=0)
                left = b[r, feature[at]] <= cut[at]
                assert gain(g[r], h[r], left) == pytest.approx(max(best, 0), abs=1e-9)
                after += [r[left], r[~left]]
            rows = after
        for k, r in enumerate(rows):
            assert leaf[k] == pytest.approx(html_extract.RATE * g[r].sum() / (h[r].sum() + 1))
            score[r] += leaf[k]
    assert np.allclose(made.log_odds(x), score)
