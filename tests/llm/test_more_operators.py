"""Manifest, packing, spelling variants, decontamination and the pipeline against plain Python versions of their rules."""

import hashlib
import os
import random
import re
import subprocess
import sys
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import decontaminate, merkle, packing, pieces, queries, spelling
from test_operators import FOLD, bag, brute_components, corpus, frame, words

# ---------------------------------------------------------------- 11


def brute_spelling(rows):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 5}
    near = {w: [v for v in count if v != w and one_edit(w, v)] for w in count}
    form = {}
    for w in count:
        if near[w]:
            best = min(near[w], key=lambda v: (-count[v], v.encode()))
            if count[best] >= 5 * count[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n, len(near[w]), count[form[w]] if w in form else None) for w, n in count.items())


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def spelled(seed):
    """Words of few letters, many of them edits of others, in all frequencies; runs of one letter; letters beyond ASCII."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀß") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababababab", "verwandt"]
    pool = []
    for w in base:
        pool += [w] * rng.choice([5, 30, 200])
        for _ in range(6):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ×") + w[i:], w[:i] + rng.choice("abÀ") + w[i + 1 :]])
            pool += [v] * rng.choice([4, 5, 6, 40])
    rng.shuffle(pool)
    texts = [" ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in pool[i : i + 50]) for i in range(0, len(pool), 50)]
    return [*enumerate(texts), (None, "verwandt verwandt1verwandt"), (3, None), (4, ""), (5, " .\n"), (0, texts[0]), (0, texts[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling(spark, seed):
    rows = spelled(seed)
    got = bag(spelling.group_variants(frame(spark, rows)), "word", "form", "root", "n", "n_near", "form_n")
    assert got == brute_spelling(rows)
    assert seed != 1 or any(k[1] and k[2] != k[1] for k in got)  # a chain of forms


def test_pivots_are_the_rarest_disjoint_pair(spark):
    rng = random.Random(5)
    rows = [(str(i), [(g, rng.randrange(9), float(rng.randrange(5))) for g in range(rng.randint(3, 6))]) for i in range(40)]
    rows = [(i, list({p: (g, p, c) for g, p, c in gs}.values())) for i, gs in rows]
    df = spark.createDataFrame(rows, "i string, prefix array<struct<gram: int, pos: int, cost: double>>")
    for r in df.withColumn("pivots", spelling._pivots(F.col("prefix"))).collect():
        pairs = [x.cost + y.cost for x in r.prefix for y in r.prefix if y.pos - x.pos >= 2]
        if pairs:
            a, b = r.pivots
            assert b.pos - a.pos >= 2 and a.cost + b.cost == min(pairs)


# ---------------------------------------------------------------- 12


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows):
    """Rows are doc_id, source, lang, n_chars, text."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    hashed = lambda r: sha("".join(map(field, r)))

    def build(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed(r)))
    trees = {x: build([hashed(r) for r in by[x]]) for x in langs}
    top = build([trees[x][-1][0] for x in langs])
    out = Counter()
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            torn = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = hashed((*r[:4], r[4] and r[4].translate(FOLD))) if torn else hashed(r)
            proof = ""
            for levels, place in ((trees[x], i), (top, k)):
                for level in levels[:-1]:
                    run, p = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    proof += "".join(run[:p] + run[p + 1 :])
                    h = sha("".join([*run[:p], h, *run[p + 1 :]]))
                    place //= 8
            out[r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]] += 1
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, t long, idx string, n string, leaf string, h long"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {"en": 64}, {"en": 65, None: 8, "": 1, "zh": 7}, {"de": 530, "en": 2, "é": 1} | {f"l{i}": 1 for i in range(70)}, {}])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    texts = [None, "", "A", "plain", "Große Wörter ÀB", "x" * 300_000 + "Z"]
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.choice([None, *range(40)]), rng.choice([None, "", "web"]), lang, rng.choice([None, 0, 77]), texts[min(rng.randrange(40), 5) if n > 100 else rng.randrange(6)]) for _ in range(n)]
    rows += rows[:2]  # repeated rows are leaves of their own
    df = spark.createDataFrame([(*r, 1, "x", "y", "z", 2) for r in rows], FIELDS).repartition(3)
    got = bag(merkle.Manifest(df).proofs(), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert got == brute_manifest(rows)


# ---------------------------------------------------------------- 13


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_tokenizer())


ODD = [
    None, "", " \n\t", "It's they'LL 12.5% don't", "<|endoftext|>a <|startoftext|>", "x<|endoftext|>y b", "Straße ÀÉÖ ñandú çß, ÿ×÷", "日本語 и кириллица ΣΑΣ",
    "é ́x a b c\u0085d \x1c \x00  z", "İstanbul ŒUVRE ﬁn ①",
]


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 64)  # texts go through in parts
    tokens = packing.Tokens(tokenizer.to_str())
    texts = [t or "" for t in ODD] + [t or "" for _, t in corpus()]
    for room in (1 << 20, 500):  # the second time the table is forgotten again and again
        monkeypatch.setattr(packing, "REMEMBERED_BYTES", room)
        tokens.room = 0
        for i in range(0, len(texts), 7):
            for text, raw in zip(texts[i : i + 7], tokens.ids([t.encode() for t in texts[i : i + 7]])):
                want = tokenizer.encode(text, add_special_tokens=False).ids
                assert raw == b"".join(x.to_bytes(4, "little") for x in want), text


def check_packing(rows, got, tokenizer, limits):
    """Every token is in one place, no sequence exceeds a limit, and there are about as few as there can be."""
    want = Counter()
    for d, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), limits.piece)):
            part = ids[at : at + limits.piece]
            want[d, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        at = 0
        for r in held:
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(held) <= (limits.documents or at) and sum(r.length**2 for r in held) <= (limits.attention or at * at)
    full = limits.capacity()
    total = [sum(r.length for r in got), len(got), sum(r.length**2 for r in got)]
    return len(sequences), max(x / f for x, f in zip(total, full))


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(300), packing.Limits(300, rule="dot"), packing.Limits(300, documents=4), packing.Limits(300, attention=200 * 200, rule="dot")])
def test_packing(spark, tokenizer, limits):
    rng = random.Random(7)
    rows = [*corpus(seed=4, n=150), *enumerate(ODD), (None, "no id"), (None, None)]
    rows += [(1000 + i, " ".join(rng.choice(["alpha", "Beta,", "gamma"]) for _ in range(rng.randint(1, 250)))) for i in range(200)]
    rows += [rows[-1], rows[-1], (5000, "word " * 70_000)]  # repeated rows, and a text above one slab
    got = packing.pack_documents(frame(spark, rows).repartition(3), queries.word_tokenizer(), limits, chunk=64).collect()
    made, least = check_packing(rows, got, tokenizer, limits)
    assert made <= least * 1.06 + 2


def test_second_round_joins_what_chunks_left(spark, tokenizer):
    rows = [(i, "a " * 19) for i in range(64)]  # ten fill a sequence; three chunks leave one or two documents each
    got = packing.pack_documents(frame(spark, rows), queries.word_tokenizer(), packing.Limits(200), chunk=25).collect()
    assert len({r.sequence_id for r in got}) == 7


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [*corpus(seed=6), (0, None), (0, None), (None, "x y")]
    limits = packing.Limits(128)
    got = packing.sequences(frame(spark, rows), queries.word_tokenizer(), limits).collect()
    parts = Counter()
    for r in got:
        at = 0
        for n in r.lengths:
            parts[tuple(r.ids[at : at + n])] += 1
            at += n
        assert at == len(r.ids) <= 128
    want = Counter()
    for _, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.update(tuple(ids[at : at + 128]) for at in range(0, len(ids), 128))
    assert parts == want


# ---------------------------------------------------------------- 5


def multiset(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_items(rows, items):
    out = {}
    for item, t in items:
        want = words((t or "").lower())
        if not want:
            continue
        n, k = len(want), min(len(want), 5)
        b = multiset(want, k)
        for d, text in rows:
            w = words((text or "").lower())
            if not multiset(w, k) & b:
                continue
            for s in range(max(1, len(w) - n + 1)):
                a = multiset(w[s : s + n], k)
                if a:
                    x = sum((a & b).values()) / sum((a | b).values())
                    if 100 * x >= 75 - 1e-9:
                        out[d, item] = max(x, out.get((d, item), 0))
    return out


def test_windows_in_any_order_are_found(spark):
    """Against all windows of every text: items with swapped halves and thirds, said twice, interleaved, changed, at the ends."""
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(4000)
    say = lambda k: [word() for _ in range(k)]
    items = [(i, say(n)) for i, n in enumerate([60, 60, 45, 30, 12, 5, 3, 1])]
    items.append((20, say(15) * 3))  # repeated shingles
    items.append((21, say(150)))
    rows = []
    for _, it in items:
        n = len(it)
        a, b, c = it[: n // 3], it[n // 3 : 2 * n // 3], it[2 * n // 3 :]
        h = n // 2
        changed = [word() if rng.random() < 0.03 else x for x in it]
        for x in (it, it[h:] + it[:h], c + b + a, b + a + c, it + it, a + a + b + c, changed, it[: -n // 6 or None], it[n // 10 :] + say(n // 10), a + say(3) + b + c):
            rows += [say(80) + x + say(rng.choice([0, 7])), x, x + say(30)]
    texts = [(i, " ".join(x)) for i, x in enumerate(rows)] + [(900, None), (901, ""), (902, "w1"), (903, " ".join(say(3000)))]
    texts += [(904, "\t".join(items[0][1]).upper()), (905, "one " * 300)]
    listed = [(i, " ".join(x)) for i, x in items] + [(30, None), (31, ""), (32, "one " * 40), (0, " ".join(items[0][1]))]
    got = decontaminate.find_items(frame(spark, [*texts, texts[0], (None, texts[0][1])]), spark.createDataFrame(listed, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    want = brute_items([*texts, (None, texts[0][1])], listed)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fingerprints(spark):
    rng = random.Random(3)
    lists = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 3, 10, 500)]
    lists[3] = lists[3] * 3 + lists[2]
    for r in spark.createDataFrame([(x,) for x in lists], "h array<long>").select("h", decontaminate.fingerprint(F.col("h")).alias("f")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))
        assert r.f % 2**64 == want


# ---------------------------------------------------------------- pipeline, and jobs from any folder


def test_pipeline_hands_on_what_each_stage_keeps(spark, tmp_path):
    rng = random.Random(11)
    say = lambda k: " ".join("t%d" % rng.randrange(900) for _ in range(k))
    item = say(40)
    rows = [(i, "\n".join(say(rng.randint(9, 30)) for _ in range(4))) for i in range(50)]
    rows += [(50 + i, rows[i][1]) for i in range(6)]  # copies
    rows += [(60, rows[7][1].replace("t1", "q1")), (61, say(20) + " " + item + " " + say(9)), (62, None), (63, ""), (64, say(30) + "\n" + rows[9][1].split("\n")[0])]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # every stage by itself against a plain version, on what the one before has kept
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        now = {r.doc_id: (r.text if "text" in out.columns else r.ids) for r in out.collect()}
        if name == "quality_classifier":
            assert set(now) <= {d for d, _ in rows} and all(now[d] == t for d, t in rows if d in now)
        elif name == "line_dedup":
            seen, want = [], {}
            for d in sorted(before):
                kept = []
                for line in (before[d] or "").split("\n"):
                    w = words(line.lower())
                    again = any(w == v or min(len(w), len(v)) >= 8 and one_edit(w, v) for v in seen) if w else False
                    seen += [w] if w else []
                    kept += [] if again else [line]
                if before[d] is None or len(kept) == len(before[d].split("\n")):
                    want[d] = before[d]
                elif words("\n".join(kept)):
                    want[d] = "\n".join(kept)
            assert now == want
        elif name == "near_dedup":
            kept = {d for d, _, _, kept in brute_components(sorted(before.items())) if kept}
            assert now == {d: t for d, t in before.items() if d in kept}
        elif name == "decontamination":
            assert now == {d: t for d, t in before.items() if not brute_items([(d, t)], [(1, item)])}
        else:
            vocabulary = pieces.Vocabulary.load(queries.VOCABULARY)
            assert {d: list(x or []) for d, x in now.items()} == {d: list(vocabulary.encode(t or "")) for d, t in before.items()}
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), now
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == before


def test_jobs_run_from_any_folder(tmp_path):
    """Workers that can't import this package get the functions with the job."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {repo!r})
        import __spark_entry__ as e
        from postloom.session import build_session
        spark = build_session("any", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__checkpoint__dir="c")
        for name, query in e.queries().items():
            if name[:2] == "op" and name[2].isdigit():
                query(spark, "in").collect()
        print("all ran")
    """)
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.mkdir(tmp_path / "in")
    docs = [(i, f"some words of text {i} " * 9, "en", "s", 9) for i in range(12)]
    for name, rows, columns in (("documents", docs, ["doc_id", "text", "lang", "source", "n_chars"]), ("labels", [(i, i % 2, 0) for i in range(12)], ["doc_id", "quality", "toxic"]), ("benchmark", [(1, "a b c d e f")], ["item_id", "text"])):
        pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}), tmp_path / "in" / f"{name}.parquet")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
