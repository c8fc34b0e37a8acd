"""The training-data operators against plain Python versions of the same rules."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from math import log10

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import decontaminate, licenses, lines, neardup, pieces, ppm, quality, queries, rules, sharding, substrings, tokens
from postloom.llm.queries import VOCABULARY

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, kept string, key string, n long"  # columns that clash with inner names


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60, vocabulary=40):
    """Random texts, copies, near copies, shared passages, odd white space, null, empty and short ones."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(vocabulary)] + ["Ümlaut", "日本", "A-Z", "#tag"]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    texts = [None, "", " \n\t", "one", "two words", "one", "a b c d e"]
    passage = say(60)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and len(texts) > 8:
            texts.append(rng.choice(texts[7:]))
        elif kind < 0.45 and len(texts) > 8:
            w = rng.choice(texts[7:]).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(say(20) + "\n" + passage[: rng.randint(100, len(passage))] + "\n" + say(10))
        else:
            texts.append("\n".join(say(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))))
    texts.append(" ".join(["again"] * 3000))
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # a repeated row and a row without an id belong to every table
    return frame(spark, [*rows, rows[10], (None, rows[11][1])]).repartition(3).cache()


@pytest.fixture(scope="module")
def every(rows):
    return [*rows, rows[10], (None, rows[11][1])]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---------------------------------------------------------------- 3


def shingle_set(text):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(every):
    sets = [shingle_set(t) for _, t in every]
    root = list(range(len(every)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(every):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(every))


def test_near_duplicates(docs, every):
    assert bag(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == brute_components(every)


def test_large_buckets_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(3)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(2, 6)):
            w[rng.randrange(120)] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = bag(neardup.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(rows)


def test_keep_one(docs, every):
    left = [(r.doc_id, r.text) for r in neardup.keep_one(docs).collect()]
    want = {d for d, _, _, kept in brute_components(every) if kept}
    assert sorted(d for d, _ in left if d is not None) == sorted(want)
    assert neardup.keep_one(docs).columns == docs.columns


def test_estimate_finds_the_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    for shared in (0.9, 0.75, 0.5):
        n = 2000
        both = int(2 * n * shared / (1 + shared))
        a, b = neardup.registers(pool[:n]), neardup.registers(pool[n - both : 2 * n - both])
        more, less = (a > b).sum(), (a < b).sum()
        got = neardup.estimate(*[np.array([float(x)]) for x in (n, n, more, less, neardup.REGISTERS - more - less)])[0]
        assert abs(got - shared) < 0.15
    # registers of a union are the greater ones
    whole = neardup.registers(pool[:3000])
    assert (np.maximum(neardup.registers(pool[:1000]), neardup.registers(pool[1000:3000])) == whole).all()


# ---------------------------------------------------------------- 4


def test_shards(docs, every):
    got = sharding.shard_by_bytes(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), crc(t)) for d, t in every)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id if r.doc_id is not None else -1 for r in order] == sorted(-1 if d is None else d for d, _ in every)
    for s in range(8):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in order)))
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        assert abs(sum(r.size for r in got if r.shard == s) - total / 8) <= longest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


# ---------------------------------------------------------------- 6


def test_substrings(docs, every):
    depth = 35
    seen = Counter(tuple(w[i : i + depth]) for _, t in every for w in [words(t)] for i in range(len(w) - depth + 1))
    want = Counter()
    for d, t in every:
        w = words(t)
        gone = {i + j for i in range(len(w) - depth + 1) if seen[tuple(w[i : i + depth])] > 1 for j in range(depth)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert sum(n * k[2] for k, n in want.items()) > 1000
    assert bag(substrings.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_equal_node_hashes_of_different_windows(docs, every, monkeypatch):
    """With a first hash of eight bits the second one tells windows apart."""
    whole = tokens.Words.windows

    def few(self, k):
        starts, keys = whole(self, k)
        return starts, keys & 255 if k == 35 else keys

    want = bag(substrings.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    monkeypatch.setattr(tokens.Words, "windows", few)
    assert bag(substrings.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


# ---------------------------------------------------------------- 8


def brute_ppm(every):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    order = ppm.ORDER
    symbols = lambda t: [255] * order + list((t or "").encode()) + [255]
    grams, counts = Counter(), Counter()
    for d, t in every:
        if not held(d):
            s = symbols(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    grams[tuple(s[i - k : i + 1])] += 1
            counts.update([*words((t or "").translate(FOLD)), None])
    follow = {}
    for g, n in grams.items():
        follow.setdefault(g[:-1], {})[g[-1]] = n

    def lp(context, symbol):
        known, out = set(), 0.0
        for k in range(order, -1, -1):
            seen = follow.get(context[order - k :], {})
            open_ = {s: n for s, n in seen.items() if s not in known}
            total = sum(open_.values()) + len(open_)
            if symbol in open_:
                return out + log10(open_[symbol] / total)
            if open_:
                out += log10(len(open_) / total)
            known |= set(seen)
        return out - log10(256 - len(known))

    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in every:
        s, w = symbols(t), [*words((t or "").translate(FOLD)), None]
        score = sum(lp(tuple(s[i - order : i]), s[i]) for i in range(order, len(s)))
        base = sum(log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((-1 if d is None else d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(want)


def test_ppm(docs, every):
    got = ppm.score_texts(docs, block_rows=7).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    for a, b in zip(got, brute_ppm(every), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


# ---------------------------------------------------------------- 9


def test_rules(docs, every):
    want = Counter()
    for d, t in every:
        t = t or ""
        w = words(t)
        full = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        base = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(again), base] += 1
    judged = rules.judge(docs)
    assert bag(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert judged.where("kept and base_failed").count() == 0
    alone = {r.rule: (r.failed, r.removed_by_it_alone) for r in rules.ablations(judged).collect()}
    for rule in rules.CURRENT.rules:
        failed = judged.where(F.expr(rules.RULES[rule][1]))
        others = " or ".join(rules.RULES[r][1] for r in rules.CURRENT.rules if r != rule)
        assert alone[rule] == (failed.count(), failed.where(f"not ({others})").count())


# ---------------------------------------------------------------- 2


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    for i in range(max(len(a), len(b)) + 1):
        if a[:i] == b[:i] and (a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]):
            return True
    return False


def test_lines(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.choice((2, 3, 4, 5, 6, 7, 8, 9, 14)))) for _ in range(18)]
    rows = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(3, 90):
        out = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(pool).split()
            edit = rng.random()
            if edit < 0.3:
                w[rng.randrange(len(w))] = "zz%d" % rng.randrange(3)
            elif edit < 0.45:
                w.insert(rng.randrange(len(w) + 1), "yy")
            elif edit < 0.6:
                w.pop(rng.randrange(len(w)))
            out.append("  ".join(w).title() if edit > 0.9 else " ".join(w))
        rows.append((i, "\n".join(out)))
    seen, want = [], []
    for d, t in rows:
        left, gone = [], 0
        for line in (t or "").split("\n"):
            w = line.lower().split()
            again = len(w) >= 3 and any(w == o or (len(w) >= 4 and within_one(w, o)) for o in seen)
            seen.append(w)
            gone += again
            left += [] if again else [line]
        want.append((d, len((t or "").split("\n")), gone, t if t is None else "\n".join(left)))
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.line_report(frame(spark, rows)).collect())
    assert sum(w[2] for w in want) > 30
    assert got == want
    kept = lines.dedup_lines(frame(spark, rows), drop_emptied=True)
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[2] == 0 or words(w[3])}


@pytest.mark.parametrize("n", range(3, 10))
def test_lines_one_word_longer_shorter_or_other(spark, n):
    """An earlier line may have a word more or less, at any length and place; from four words on the later one goes."""
    base = ["w%d" % i for i in range(n)]
    rows = []
    for i in range(n):
        for j, w in enumerate((base[:i] + ["new"] + base[i:], base[:i] + ["new"] + base[i + 1 :], base[:i] + base[i + 1 :])):
            tag = "t%dx%d" % (i, j)  # own words for every pair, so that only its two lines can meet
            a, b = (" ".join(tag + x for x in line) for line in (base, w))
            rows += [(len(rows), a), (len(rows) + 1, b)] if (i + j) % 2 else [(len(rows), b), (len(rows) + 1, a)]
    got = {r.doc_id: r.n_removed for r in lines.line_report(frame(spark, rows)).collect()}
    assert got == {d: int(d % 2 == 1 and len(t.split()) >= 4) for d, t in rows}


def test_queries_compare_lines_of_every_length(spark, tmp_path):
    text = "Yes\nso be it then\nTwo words"
    rows = [(0, text), (1, text), (2, "two  WORDS\n\nnew"), (3, None), (4, " "), (5, " ")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 3, 0, text), (1, 3, 3, ""), (2, 3, 1, "\nnew"), (3, 1, 0, None), (4, 1, 0, " "), (5, 1, 0, " ")]
    kept = corpus_pipeline.line_dedup(spark, queries.documents(spark, str(tmp_path)), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5]


# ---------------------------------------------------------------- 5


def test_decontamination(spark):
    rng = random.Random(8)
    say = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randrange(30)) for _ in range(k)]
    items = [(i, " ".join(say(rng.randint(12, 50)))) for i in range(12)] + [(12, "three word item"), (13, ""), (14, None)]
    rows, planted = [(0, None), (1, "")], set()
    for i in range(2, 60):
        w = say(rng.randint(5, 120))
        if i % 3 == 0:
            n, item = rng.choice(items[:12])
            inner = item.upper().split()
            for _ in range(rng.randint(0, max(0, len(inner) // 40))):
                inner[rng.randrange(len(inner))] = "changed"
            w[3:3] = inner
            planted.add((i, n))
        rows.append((i, " ".join(w)))
    rows.append((60, "a THREE word\titem here"))
    planted.add((60, 12))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_items(frame(spark, rows), benchmark).collect()}
    assert set(found) == planted and all(0.75 <= s <= 1 for s in found.values())
    left = decontaminate.decontaminate(frame(spark, rows), benchmark)
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in rows} - {d for d, _ in planted})
    none = decontaminate.decontaminate(frame(spark, rows), benchmark.where("false"))
    assert none.count() == len(rows)


def test_items_at_every_place(spark):
    """An item of five words, and one of 67 with a word inserted near either end, after 0 to 9 other words."""
    short = "five words are one shingle"
    long = ["i%d" % i for i in range(67)]
    torn = " ".join([*long[:5], "more", *long[5:62], "more", *long[62:]])
    rows = [(2 * n + one, " ".join(["other"] * n + [text, "and", "so", "on"])) for n in range(10) for one, text in enumerate((short, torn))]
    benchmark = spark.createDataFrame([(0, short), (1, " ".join(long))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_items(frame(spark, rows), benchmark).collect()}
    assert set(found) == {(d, d % 2) for d, _ in rows}
    # of 63 shingles the best window lacks four at each insertion and the one that leaves its end
    assert all(s == pytest.approx(54 / 72 if d % 2 else 1) for (d, _), s in found.items())


# ---------------------------------------------------------------- 1


def test_licenses(spark):
    rng = random.Random(9)
    filler = lambda k: " ".join(rng.choice(["lorem", "ipsum", "dolor", "license", "the", "under"]) for _ in range(k))
    names = sorted(licenses.TEMPLATES)
    rows, planted = [(0, None), (1, "")], set()
    for i in range(2, 60):
        name = rng.choice(names)
        text = licenses.TEMPLATES[name]
        if i % 2:
            planted.add((i, name))
            rows.append((i, f"{filler(rng.randint(0, 300))}\n{text.upper() if i % 4 == 1 else text}\n{filler(rng.randint(0, 100))}"))
        else:
            rows.append((i, filler(200)))
    found = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert planted <= set(found)
    assert all(found[p] == 1.0 for p in planted)
    for d, name in set(found) - planted:  # what else is found must hold the shingles
        t, w = (licenses._plain_words(x) for x in (licenses.TEMPLATES[name], dict(rows)[d]))
        k = min(5, len(t))
        have = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
        assert len(have(t) & have(w)) >= 0.75 * len(have(t))


def brute_licenses(rows):
    """Every window of every text against every template, by sets of word tuples."""
    have = lambda x, k: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    want = {}
    for d, t in set(rows):
        w = licenses._plain_words(t or "")
        for name, template in licenses.TEMPLATES.items():
            p = licenses._plain_words(template)
            size, k = licenses._class(p)
            for cell in range(0, len(w), size):
                share = len(have(p, k) & have(w[cell : cell + 2 * size], k)) / len(have(p, k))
                if share >= 0.75:
                    best, n = want.get((d, name), (0, 0))
                    want[d, name] = (max(best, share), n + 1)
    return want


def test_license_windows_equal_brute_force(spark):
    """Whole notices, and such with lost ends and foreign words, among other words and at the ends of texts."""
    rng = random.Random(12)
    filler = lambda k: ["f%d" % rng.randrange(50) for _ in range(k)]
    rows = [(0, None), (1, ""), (2, "rights")]
    for name, template in licenses.TEMPLATES.items():
        for _ in range(25):
            w = licenses._plain_words(template)
            w = w[rng.choice((0, 0, 1, 2, len(w) // 8)) : len(w) - rng.choice((0, 0, 1, len(w) // 8))]
            if rng.random() < 0.3:
                w[rng.choice((0, len(w) - 1, len(w) // 2))] = "other"
            rows.append((len(rows), " ".join(filler(rng.choice((0, 3, 50, 130))) + w + filler(rng.choice((0, 5, 90))))))
    rows += [rows[5], rows[30]]
    got = {(r.doc_id, r.license): (r.containment, r.windows) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    want = brute_licenses(rows)
    assert {name for _, name in want} == set(licenses.TEMPLATES)
    assert any(share < 1 for share, _ in want.values())
    assert got == want


def test_bands_suffice():
    """A class of one-shingle templates needs most; a window's chance to be missed stays below MISS."""
    assert licenses.bands_for(8, 5, 1) == 159
    for template in licenses.TEMPLATES.values():
        w = licenses._plain_words(template)
        size, k = licenses._class(w)
        m = len(licenses._every(w, k))
        need = next(n for n in range(m + 1) if 4 * n >= 3 * m)
        least = need / (m + 2 * size - k + 1 - need)
        assert (1 - least) ** licenses.bands_for(size, k, m) <= licenses.MISS


def test_every_exact_notice_is_found(spark):
    """Short notices between many other words, at every place of a window; 300 random neighbourhoods each."""
    rng = random.Random(10)
    filler = lambda k: " ".join("f%d" % rng.randrange(10**6) for _ in range(k))
    rows, planted = [], set()
    for name in ("mit", "all-rights-reserved", "mpl-2.0-notice"):
        for i in range(300):
            planted.add((len(rows), name))
            rows.append((len(rows), f"{filler(40 + i % 32)} {licenses.TEMPLATES[name]} {filler(80)}"))
    found = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert found == {p: 1.0 for p in planted}


def test_rows_with_one_id_hide_no_notice(spark):
    near, far = "Licensed under the Apache License, Version 2", "a b c d"  # three of four shingles
    whole = licenses.TEMPLATES["apache-2.0"]
    for one in (7, None):
        rows = [(one, near)] * 3 + [(one, whole)] * 2 + [(one, near + " " + far)] * 3
        for order in (rows, rows[::-1]):
            got = licenses.scan_licenses(frame(spark, order).coalesce(1)).collect()
            assert [tuple(r) for r in got] == [(one, "apache-2.0", 1.0, 3)]


# ---------------------------------------------------------------- 7


def test_classifier(spark):
    rng = random.Random(4)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["spam!!", "buy$$$", "WIN***", "click"]
    rows, marks = [(-1, None), (-2, "")], []
    for i in range(600):
        label = int(rng.random() < 0.7)
        rows.append((i, " ".join(rng.choice(good if label else bad) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 60)))))
        marks.append((i, label, 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(frame(spark, rows), labels).collect()}
    truth = {d: q for d, q, _ in marks}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert 0 <= got[-1].score <= 1 and got[-1].score == got[-2].score
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(quality.in_training(), F.col("quality")).otherwise(1 - F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(frame(spark, rows), flipped).collect()}
    assert again == {d: r.score for d, r in got.items()}
    unlabelled = quality.classify(frame(spark, rows), labels.where("false")).collect()
    assert {r.score for r in unlabelled} == {0.5}


# ---------------------------------------------------------------- 10


def brute_path(v, text):
    best = [(0.0, [])] + [(-1e18, None)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            part = text[start:end]
            hit = None if pieces.MARK in part else v.pieces.get(part.replace(" ", pieces.MARK))
            if hit and best[start][0] + hit[1] > best[end][0]:
                best[end] = (best[start][0] + hit[1], best[start][1] + [hit[0]])
        last = text[end - 1]
        if last == pieces.MARK or last.replace(" ", pieces.MARK) not in v.pieces:
            raw = last.encode()
            if best[end - 1][0] + v.byte_score * len(raw) > best[end][0]:
                best[end] = (best[end - 1][0] + v.byte_score * len(raw), best[end - 1][1] + [v.byte_ids[b] for b in raw])
    return best[-1][1]


def test_pieces(docs, every):
    v = pieces.Vocabulary.load(VOCABULARY)
    odd = ["  two  spaces ", "▁ itself", "a\x00b", "x" * 500, "日本語テキスト" * 40, "\n\n\t", "ça va?\r\n", "🎉🎉"]
    for t in [*odd, *(t for _, t in every[:40] if t)]:
        ids = list(v.encode(t))
        assert v.decode(ids) == t
        assert ids == brute_path(v, " " + t)
        assert ids == list(v.search(" " + t))
    got = pieces.decode(pieces.encode(docs, v), v)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    assert bag(got, "doc_id", "decoded") == Counter(every)


# ---------------------------------------------------------------- empty tables


def test_empty_tables(spark, nothing):
    v = pieces.Vocabulary.load(VOCABULARY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        licenses.scan_licenses(nothing), lines.line_report(nothing), lines.dedup_lines(nothing), neardup.near_duplicates(nothing), neardup.keep_one(nothing),
        sharding.shard_by_bytes(nothing), decontaminate.find_items(nothing, items), decontaminate.decontaminate(nothing, items),
        substrings.dedup_substrings(nothing), quality.classify(nothing, labels), ppm.score_texts(nothing), rules.judge(nothing), pieces.encode(nothing, v),
    ):
        assert out.count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not there")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert sorted(con.sql(queries.ORACLE[name]).columns) == names
    got = Counter(tuple(r) for r in df.select(*names).collect())
    assert got == Counter(con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE[name]})").fetchall())


def test_windows_are_cut_from_the_texts_once(spark, monkeypatch):
    """The texts move to their anchors once: nodes and hits are read from the written windows."""
    plans, plain = [], substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    passage = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{passage} d"), (3, "e f")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(docs).collect()}
    assert got == {1: (53, 50), 2: (51, 50), 3: (2, 0)}
    assert not any("MapInArrow" in line and "more#" in line for plan in plans for line in plan.splitlines())


def test_shuffles_of_written_steps_do_not_pile_up(spark, monkeypatch):
    key, seen, plain = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df: seen.append(spark.conf.get(key)) or plain(df))
    before = spark.conf.get(key)
    rows = substrings.dedup_substrings(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string"))
    assert set(seen) == {"true"} and spark.conf.get(key) == before
    assert rows.count() == 2 and len(rows.collect()) == 2 and len(rows.collect()) == 2
