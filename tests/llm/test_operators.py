"""Every operator on a small awkward table, against brute force: nulls, empty and long texts, ties, repeated rows, clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, media, minhash, mixing, packing, queries, scoring, suffixes, toxicity, vectors, warc
from quarry.llm.common import Scratch, components

CLASH = ["digest", "k", "task", "rid", "size", "target", "row", "id", "key", "label", "a", "b", "doc", "spans", "place", "rank", "bands"]


def prose(rng, n, v=60):
    return " ".join("w%d" % rng.randrange(v) for _ in range(n))


def documents():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 80)), ("en", "de")[i % 2], f"s{i % 3}") for i in range(40)]
    base, passage = prose(rng, 120, 900), prose(rng, 90, 900)
    for i in range(40, 60):  # near copies, and a passage that many share
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s0"))
    rows += [(i, prose(rng, 30, 900) + " " + passage + " " + prose(rng, 30, 900), "fr", "s1") for i in range(60, 70)]
    rows += [(i, base, "en", "s0") for i in range(70, 80)]  # exact copies
    rows += [(80, None, "en", "s0"), (81, "", None, None), (82, "   \n", "xx", ""), (83, "é" * 400, "es", "s2"), (84, "ab" * 3000, "de", "s2")]
    rows += [(85, prose(rng, 9000, 5000), "en", "s0"), (None, "no id here at all", "en", "s1"), (None, None, None, None), (3, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0"), (86, "Idiot! 123", "en", "S"), (87, "!!! 42", "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def key(x):
    return (x is None, x or 0)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, 500) for i in range(300, 330)] + [(7, 7), (None, 3)]
    root = {i: i for i in range(600)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r[0]: r[1] for r in got} == {x: find(x) for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_near_duplicates_against_all_pairs(spark, docs, empty):
    rows = documents()
    bag = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        bag.setdefault(i, collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    text = {r[0]: r[1] or "" for r in rows}
    for i in ids:
        for j in ids:
            if i < j and (text[i] == text[j] or (bag[i] and bag[j] and sum((bag[i] & bag[j]).values()) >= 0.8 * sum((bag[i] | bag[j]).values()))):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = minhash.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id)) and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(empty, Scratch(spark, "t")).count() == 0


def test_a_bucket_of_unlike_texts_loses_no_link(spark):
    """With one register a band, unlike texts share buckets; what is linked must not depend on the hub."""
    rng = random.Random(8)
    shared = prose(rng, 60, 900)
    rows = []
    for g in range(6):
        own = prose(rng, 20, 900)
        rows += [(10 * g + i, shared + " " + own + f" end{i}") for i in range(4)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), rows=1, n_bands=24, threshold=0.85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 10 * 10 for i, _ in rows}


def test_texts_under_one_id_are_judged_by_themselves(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 100, 900) for _ in range(3))
    rows = [(1, a + " end"), (3, a), (3, b), (3, b), (5, b + " end"), (2, c), (2, a), (None, b), (None, "alone"), (9, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), keep_digest=True).collect()
    have = collections.Counter((r.doc_id, bytes(r.digest), r.class_id, r.component_id, r.kept) for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    want = [(1, a + " end", 1, 1, True), (3, a, 2, 1, False), (3, b, 3, 3, True), (3, b, 3, 3, True), (5, b + " end", 5, 3, False), (2, c, 2, 2, True), (2, a, 2, 1, False), (None, b, None, None, True), (None, "alone", None, None, True), (9, "", 9, 9, True)]
    assert have == collections.Counter((i, sha(t), *x) for i, t, *x in want)


def test_blocks_of_large_buckets(spark, monkeypatch):
    """Many texts in each bucket, blocks bounded by rows and by bytes: links as without blocks."""
    rng = random.Random(15)
    shared = prose(rng, 40, 900)
    rows = [(10 * g + i, shared + " " + own + f" end{i}") for g in range(12) for own in [prose(rng, 40, 900)] for i in range(4)]
    want = {i: i // 10 * 10 for i, _ in rows}
    for block, size in ((1024, 4 << 20), (8, 4 << 20), (1024, 3000)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), rows=1, n_bands=24)
        assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("spans", [(16, 1), (64, 16, 1)])
def test_a_hot_anchor_is_cut(spark, monkeypatch, spans):
    """A line in many texts between different words, with longer and shorter common parts around it."""
    monkeypatch.setattr(suffixes, "HOT_BYTES", 2000)
    monkeypatch.setattr(suffixes, "SPANS", spans)
    rng = random.Random(13)
    line = "".join(rng.choice("abcdefghij ") for _ in range(190))
    around = [prose(rng, 12, 900) for _ in range(5)]
    texts = [prose(rng, 20, 900) + rng.choice(around)[rng.randint(0, 30) :] + line + rng.choice(around)[: rng.randint(1, 60)] + prose(rng, 20, 900) for _ in range(60)]
    got = suffixes.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_removed([t.encode() for t in texts], 200)


def brute_removed(texts, d):
    c = collections.Counter(t[i : i + d] for t in texts for i in range(len(t) - d + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, int)
        for i in range(len(t) - d + 1):
            if c[t[i : i + d]] > 1:
                m[i : i + d] = 1
        kept = bytes(b for b, x in zip(t, m) if not x)
        out.append((len(t), len(t) - len(kept), int((np.diff(np.append(0, m)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1 << 19, 600, 0])
def test_repeats_against_brute_force(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
    rows = documents()
    want = brute_removed([(r[1] or "").encode() for r in rows], 200)
    got = suffixes.deduplicated(docs, Scratch(spark, "t")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(((i[0], *w) for i, w in zip(rows, want)), key=str)
    assert suffixes.deduplicated(empty, Scratch(spark, "t")).count() == 0


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "LONG", 700)
    rng = random.Random(5)
    part = prose(rng, 100, 900)
    texts = [prose(rng, 400, 900) + part + prose(rng, 300, 900), part[10:] + "x", "z" * 3000]
    got = suffixes.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t"), keep_text=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_removed([t.encode() for t in texts], 200)
    assert hashlib.sha256(got[0].text.encode()).hexdigest() == got[0].kept_sha256


def test_scores_against_counts(spark, docs, empty):
    rows = documents()
    toks = [(r[1] or "").encode().lower().split() + [b""] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    c = collections.Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for head in (100000, 30, 0):
        got = scoring.score(docs, Scratch(spark, "t"), head=head).collect()
        assert len(got) == len(rows)
        have = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
        assert have == collections.Counter((r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(rows, toks, held))
        assert all(r.score < 0 and abs(r.mean_score * r.n_tokens - r.score) < 1e-6 for r in got)
        assert any(abs(r.score - r.base_score) > 1 for r in got)  # the model is used, however few words have vectors of their own
        if head > 30:
            assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert scoring.score(empty, Scratch(spark, "t")).count() == 0
    alone = scoring.score(spark.createDataFrame([(i, "a b") for i in range(30) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert alone and all(r.score == r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_scores_against_the_definition(spark):
    """Each token's probability by summing over all symbols in plain Python, from the same vectors."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 25), 90) + (" rare%d" % i if i % 3 else "")) for i in range(120)] + [(500, None), (501, "w" * 300 + " never seen")]
    base = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 100)
    counts = scoring.token_counts(base.where("not held_out")).cache()
    model = scoring.fit(base.where("not held_out"), counts, head=40)
    s, m, n = model.symbols, model.vectors, {bytes(r[0]): r[1] for r in counts.collect()}
    size, k = m["C"].shape[1], len(m["C"]) // m["C"].shape[1]
    groups = [range(a, z) for a, z in zip(s.first[:-1].tolist(), s.first[1:].tolist())]
    heads = []
    for g in groups:
        mass = sum(s.p[i] for i in g)
        q = sum(m["Q"][i].astype(float) * s.p[i] for i in g) / mass
        heads.append((q[:-1], math.log(mass)) if len(g) > 1 else (m["Q"][g[0]][:-1].astype(float), float(m["Q"][g[0]][-1])))

    def log_p(history, symbol):
        h = sum(m["R"][x].astype(float) @ m["C"][i * size : (i + 1) * size].astype(float) for i, x in enumerate(history))
        top = [q @ h + b for q, b in heads]
        at = next(i for i, g in enumerate(groups) if symbol in g)
        inner = {i: float(m["Q"][i][:-1].astype(float) @ h + m["Q"][i][-1]) for i in groups[at]}
        return top[at] - math.log(sum(map(math.exp, top))) + inner[symbol] - math.log(sum(map(math.exp, inner.values())))

    cells = collections.Counter(), collections.Counter()
    for w, c in n.items():
        if w not in s.at:
            cells[0][s.cell(w)] += c
            cells[1][s.cell(w)] += 1
    for r in scoring.apply(base, counts, model, Scratch(spark, "t")).collect():
        text = dict(rows)[r.doc_id]
        history, want = [s.end] * k, 0.0
        for w in [*(text or "").encode().lower().split(), b""]:
            x = s.at[w] if w in s.at else s.cell(w)
            want += log_p(history, x) / math.log(10) + (0 if w in s.at else math.log10((n.get(w, 0) + 1) / (cells[0][x] + cells[1][x] + 1)))
            history = [x, *history[:-1]]
        assert abs(r.score - want) < 1e-3 * max(1, abs(want)), (r.doc_id, r.score, want)


def test_language(spark, docs, empty):
    found = language.model(docs)
    got = language.identify(language.from_documents(docs), found, Scratch(spark, "t")).collect()
    assert len(got) == len(documents())
    for r in got:
        if r.doc_id in (80, 81, 82, 87):
            assert (r.language, r.kept) == ("und", False)
        if r.doc_id in (83, 84, 86):
            assert r.kept
    assert language.identify(language.from_documents(empty), language.model(empty), Scratch(spark, "t")).count() == 0


def test_language_against_bayes_in_plain_python(spark, docs):
    """The posterior of each row from the trigram tables, by the formulas of the docstring, one row at a time."""
    rows = [(*r, i) for i, r in enumerate(documents())] + [(3, documents()[3][1], "en-GB", "s1", 900), (99, "ü" * 30_000 + " w1 w2", "de", "s0", 901)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long")
    found = language.model(docs)
    langs, prior, table = found
    tag = lambda x: (x or "").strip().lower().split("-")[0] if (x or "").strip()[:2].isalpha() and len((x or "").strip().split("-")[0]) in (2, 3) else None
    facts = {}
    for i, text, lang, source, row in rows:
        at, _, letters = language.trigrams([text])
        own_at = [int(t) for t in at if t < language.BUCKETS]
        n = len(own_at)
        mean = [sum(float(table[k][t]) for t in own_at) / max(n, 1) for k in range(len(langs))]
        logs = [x * n / (1 + n / language.SATURATION) for x in mean]
        raw = [math.exp(x + p - max(a + b for a, b in zip(logs, prior))) for x, p in zip(logs, prior)]
        facts[row] = (logs, [x / sum(raw) if n else 0.0 for x in raw], letters[0] > 0, tag(lang), source)
    votes = lambda at, value: [sum(f[1][k] for f in facts.values() if f[2] and f[at] == value) for k in range(len(langs))] if any(f[2] and f[at] == value for f in facts.values()) else None
    lean = lambda v, parent, w: [(max(x, 0) + w * p) / (max(sum(v), 0) + w) for x, p in zip(v, parent)]
    base = [math.exp(p) for p in prior]
    for r in language.identify(language.from_documents(df, keep=("row",)), found, Scratch(spark, "t")).collect():
        logs, own, readable, declared, host = facts[r.row]
        at_declared = base if declared is None or votes(3, declared) is None else lean(votes(3, declared), base, language.DECLARED_WEIGHT)
        v = None if host is None else votes(4, host)
        at_host = lean([0.0] * len(langs) if v is None else [a - b for a, b in zip(v, own)], base, language.HOST_WEIGHT)
        total = [x + math.log(h) + math.log(d) - p for x, h, d, p in zip(logs, at_host, at_declared, prior)]
        best = max(range(len(langs)), key=lambda k: total[k])
        chance = 1 / sum(math.exp(x - total[best]) for x in total)
        if readable:
            assert r.language == langs[best] and abs(r.probability - chance) < 1e-6 and r.kept == (chance >= language.LEAST), r
        else:
            assert (r.language, r.probability, r.kept) == ("und", 0.0, False)


def test_language_of_texts_alone(spark):
    """Held-out accuracy without any declared value: models of one half of a test table, the other half's texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 40")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rows = docs.where(half == 1).withColumn("true", F.col("lang")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    got = language.identify(language.from_documents(rows, keep=("true",)), language.model(docs.where(half == 0)), Scratch(spark, "t")).collect()
    assert len(got) > 50 and sum(r.language == r.true for r in got) >= 0.95 * len(got)


def test_language_evidence_and_hosts(spark):
    rng = random.Random(2)
    en, de = "the thing and that with".split(), "der schön und nicht über".split()
    train = spark.createDataFrame([(i, " ".join(rng.choice((en, de)[i % 2]) for _ in range(40)), ("en", "de")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    pages = [(i, f"http://h{i % 2}.example.de/x", f'<html lang="{("en", "de-AT")[i % 2]}"><script>var the;</script><p>{" ".join(rng.choice((en, de)[i % 2]) for _ in range(20))}</p>') for i in range(40)]
    pages += [(90, "http://h1.example.de/short", "<p>x</p>"), (91, None, None), (92, "::bad", "<p>42</p>"), (93, "http://h0.example.de", '<html lang="de"><p>' + " ".join(en * 5))]
    got = {r.page_id: r for r in language.identify(language.from_pages(spark.createDataFrame(pages, "page_id long, url string, html string")), language.model(train), Scratch(spark, "t")).collect()}
    assert all(got[i].language == ("en", "de")[i % 2] and got[i].kept for i in range(40))
    assert got[90].language == "de" and got[93].language == "en"
    assert not got[91].kept and not got[92].kept


def test_every_label_has_a_model(spark):
    """More languages than one block, the rare ones too; regions count as their language, other labels as they are."""
    rng = random.Random(9)
    names = [a + b for a in "abcdefgh" for b in "klmnopqrst"][:75] + ["plain english"]
    words = [["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(12)] for _ in names]
    rows = [(k * 10 + i, " ".join(rng.choice(words[k]) for _ in range(40)), (n, n.upper() + "-XX")[i % 2] if k < 75 else n) for k, n in enumerate(names) for i in range(2 + (k < 64))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s").cast("string"))
    found = language.model(docs)
    assert found[0] == sorted(names)
    got = {r.doc_id: r for r in language.identify(language.from_documents(docs), found, Scratch(spark, "t")).collect()}
    assert all(got[i].language == got[i].text_language == names[i // 10] and got[i].kept for i, *_ in rows)


def test_toxicity_held_out(spark, empty):
    rng = random.Random(6)
    bad = ["idiot", "scum", "moron"]
    rows = [(i, prose(rng, 60, 500) + (" " + rng.choice(bad) + "! " + prose(rng, 10, 500) if i % 4 == 0 else "") + (" %%% ###" * 5 if i % 3 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows + [(None, None), (9000, "")], "doc_id long, text string").withColumn("p_toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(0, 600, 2)] + [(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.classify(docs, chain).collect()}
    assert len(got) == 602
    assert sum(got[i].toxic == (i % 4 == 0) for i in range(1, 600, 2)) >= 297 and sum(got[i].toxic for i in range(0, 600, 4)) >= 148
    assert got[None].toxic is False
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.classify(docs, nothing).count() == 602
    assert toxicity.classify(empty, chain).count() == 0


def test_toxicity_against_the_weights(spark):
    """Probabilities one word at a time from the fitted chain; repeated ids and a very long text too."""
    rng = random.Random(16)
    rows = [(i, prose(rng, 30, 300) + (" idiot" if i % 4 == 0 else "")) for i in range(300)] + [(7, "another text of one id"), (7, "another text of one id"), (400, prose(rng, 60_000, 40_000)), (None, "x"), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    want = collections.Counter()
    for i, text in rows:
        p = []
        for m in chain:
            weight, total = dict(zip(m["ids"], m["w"])), m["b"]
            for w in {w for w in "".join(ch if ch.isalpha() else " " for ch in (text or "").lower()).split()}:
                total += sum(weight.get(f, 0.0) for f in toxicity.word_features(w))
            p.append(1 / (1 + math.exp(-max(-30, min(30, total + sum(e * x for e, x in zip(m["e"], p)))))))
        want[(i, *(round(x, 6) for x in p), p[-1] >= toxicity.THRESHOLD)] += 1
    got = toxicity.classify(docs, chain).collect()
    assert collections.Counter((r.doc_id, round(r.p_low_quality, 6), round(r.p_toxic, 6), r.toxic) for r in got) == want
    alone = toxicity.train(docs.where("doc_id < 7"), labels.where("doc_id < 7"))  # fewer rows than make good folds
    assert [m["name"] for m in alone] == list(toxicity.CHAIN)


def test_chain_in_tasks_equals_the_chain_in_one(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng, 40, 200) + (" scum" if i % 5 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(200)]
    got = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    pairs = [toxicity.features(t) for _, t in rows]
    doc, ids, val = (np.concatenate(x) for x in zip(*((np.full(len(a), i), a, n) for i, (a, n) in enumerate(pairs))))
    want = toxicity.fit_chain(doc, ids, val, {"low_quality": np.array([float(q == 0) for _, q, _ in labels]), "toxic": np.array([float(t) for *_, t in labels])}, np.arange(200) % toxicity.FOLDS)
    for a, b in zip(got, want, strict=True):
        assert list(a["ids"]) == b["ids"].tolist() and np.allclose(a["w"], b["w"]) and np.allclose(a["e"], b["e"]) and abs(a["b"] - b["b"]) < 1e-9


def test_folds_get_the_chosen_features_only(spark, monkeypatch):
    """Rare words train nothing and are not sent to the folds, so the tasks' memory does not grow with them."""
    rng, real = random.Random(18), toxicity.fit_category
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(40)) + (" idiot" if i % 4 == 0 else "")) for i in range(200)]
    entries = sum(len(toxicity.features(t)[0]) for _, t in rows)

    def spy(doc, *args):
        if 4 * len(doc) > entries:
            raise MemoryError(f"{len(doc)} of {entries} entries in a task")
        return real(doc, *args)

    monkeypatch.setattr(toxicity, "fit_category", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert set(toxicity.word_features("idiot")) <= set(chain[1]["ids"])
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in toxicity.classify(docs, chain).collect())
    alone = toxicity.train(docs.where("doc_id < 2"), labels)  # no feature of at least RARE documents: rates stand for models
    assert [m["ids"] for m in alone] == [[], []] and toxicity.classify(docs, alone).count() == 200


def test_media_digests(spark, docs, empty):
    table = Scratch(spark, "t").put(media.store(docs, "doc_id", "text"))
    got = collections.Counter()
    for r in media.digests(table, "doc_id", keep=("n_bytes", "codec", "timescale", "duration", "n_samples", "keyframes")).collect():
        at = r.media_bytes - r.payload_bytes  # the frames are the end of the file
        assert r.codec == "raw " and r.n_samples * 64 == r.payload_bytes and r.duration == r.n_samples and r.timescale == 25
        assert [tuple(k) for k in r.keyframes] == [(at + o, 64) for o in range(0, r.payload_bytes, 512)]
        first, last = at, at + (r.n_samples - 1) // 8 * 512
        ranges = zlib.crc32(np.array([tuple(k) for k in r.keyframes], "<i8").tobytes())
        assert r.feature == f"codec=raw ;seconds={r.n_samples / 25:.2f};samples={r.n_samples};sync={len(r.keyframes)};first={first};last={last};ranges={ranges:08x}"
        got[(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256)] += 1
    want = collections.Counter()
    for i, t, *_ in documents():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(media.build(p)).hexdigest())] += 1
    assert got == want
    assert media.digests(media.store(empty, "doc_id", "text"), "doc_id").count() == 0
    rows = media.probe(media.to_media(docs, "doc_id", "text").unionByName(spark.createDataFrame([(99, 3, b"junk"), (98, 3, None)], "doc_id long, n_bytes long, media binary")), "doc_id").collect()
    assert len(rows) == len(documents()) + 2 and {r.doc_id for r in rows if r.error} == {98, 99}


def test_packing(spark, docs, empty):
    got = packing.pack(docs, queries.tokenizer_path(), Scratch(spark, "t"), keep_ids=True).collect()
    tok = packing._shared(queries.tokenizer_path()).slow
    want = collections.Counter()
    for i, t, *_ in documents():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(n for _, n in x) <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(empty, queries.tokenizer_path(), Scratch(spark, "t")).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in names if s not in full)
        if not free:
            return {s: 3 * sizes[s] for s in names}
        level = (total - sum(3 * sizes[s] for s in full)) / free
        more = {s for s in names if s not in full and 3 * sizes[s] <= w[s] * level}
        if not more:
            return {s: 3 * sizes[s] if s in full else w[s] * level for s in names}
        full |= more


def test_mixing(spark, docs, empty):
    rows = documents()
    got = mixing.mix(docs, Scratch(spark, "t"), shard_words=500).collect()
    again = mixing.mix(docs.repartition(7), Scratch(spark, "t"), shard_words=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").encode().split())
    goal, taken = brute_targets(size), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(40, 0.02 * g), (s, taken[s], g)
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len((t or "").encode().split())) for i, t, *_ in rows)
    assert mixing.mix(empty, Scratch(spark, "t")).count() == 0


def test_mixing_spreads_rows_without_an_id(spark):
    """Null and repeated ids are many shards, and every row is taken within its bounds."""
    rng = random.Random(3)
    rows = [(None if i % 2 else 7, prose(rng, rng.randint(1, 60)), ("a", "b", None)[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, Scratch(spark, "t"), shard_words=200).collect()
    again = mixing.mix(df.repartition(5), Scratch(spark, "t"), shard_words=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 300
    assert all(0 <= r.taken <= 3 * r.size for r in got) and len({r.taken / r.size for r in got}) > 3
    goal = brute_targets({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", None)})
    for s, g in goal.items():
        assert abs(sum(r.taken for r in got if r.source == s) - g) <= max(40, 0.02 * g)


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_filling_by_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice((0, 1, 10, 1000, 100_000)) * rng.randint(1, 5) for i in range(rng.randint(1, 30))}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark, "t")).collect()
    want = brute_targets(sizes)
    assert {r.source for r in got} == set(want) and all(abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) for r in got)


@pytest.mark.parametrize("seats", [5, 60])
def test_apportionment_within_groups(spark, seats):
    votes = [(g, i, float(v)) for g, vs in enumerate(([9, 9, 1], [100, 3, 3, 0], [7])) for i, v in enumerate(vs)]
    got = mixing.apportion(spark.createDataFrame(votes, "g long, p long, v double"), "v", F.lit(seats), ["p"], "n", Scratch(spark, "t"), by=["g"]).collect()
    for g in range(3):
        mine = [(p, v) for h, p, v in votes if h == g]
        want = collections.Counter()
        for _ in range(seats):
            want[max(mine, key=lambda x: (x[1] / (2 * want[x[0]] + 1), -x[0]))[0]] += 1
        assert {r.p: r.n for r in got if r.g == g} == {p: want[p] for p, _ in mine}


def test_mixed_texts_hold_the_taken_words(spark, docs):
    mixed = mixing.mix(docs, Scratch(spark, "t"), keep_text=True, extra=("lang",)).cache()
    words = mixing.expand(mixed, ["doc_id", "text", "lang", "source", "n_chars"]).select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).collect()[0][0]
    assert words == mixed.agg(F.sum("taken")).collect()[0][0]


@pytest.mark.parametrize("seats", [0, 1, 7, 40, 101])
def test_apportionment_by_highest_quotients(spark, seats):
    votes = [(i, v) for i, v in enumerate([100.0, 53.0, 53.0, 20.0, 3.0, 0.0, 1.0])]
    want = collections.Counter()
    for _ in range(seats):
        best = max(votes, key=lambda x: (x[1] / (2 * want[x[0]] + 1), -x[0]))
        want[best[0]] += 1
    got = mixing.apportion(spark.createDataFrame(votes, "p long, v double"), "v", seats, ["p"], "n", Scratch(spark, "t")).collect()
    assert {r.p: r.n for r in got} == {p: want[p] for p, _ in votes}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(0, 0.02, 8) * (i % 3)).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(300, (np.array(rows[0][1]) * 2).tolist(), 0)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] + [1.0] * 7, 0), (403, [None] + [1.0] * 7, 0), (404, rows[0][1], None), (405, [float("inf")] * 8, 1), (406, [], 1), (407, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash")).withColumn("v", F.lit("clash"))
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    root, links = {r[0]: r[0] for r in rows}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = sorted((find(a[0]), find(b[0])))
                    root[q] = p
    for kw in ({}, {"shard": 20, "block": 15}):
        got = vectors.near_vectors(df, Scratch(spark, "t"), **kw).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == ((0, None, True) if r.vec_id is None else (links[r.vec_id], find(r.vec_id), find(r.vec_id) == r.vec_id)), r
    assert vectors.near_vectors(df.limit(0), Scratch(spark, "t")).count() == 0


def test_vectors_that_repeat_an_id(spark):
    """A repeated row is one vector; two vectors of one id are two, and one node."""
    rows = [(5, [0.0, 1.0], 1), (5, [0.7, 0.7], 1), (6, [0.0, 1.0], 1), (6, [0.0, 1.0], 1), (9, [1.0, 0.0], 1), (9, [0.0, -1.0], 1), (7, [1.0, 0.01], 1), (8, [0.0, -2.0], 1), (4, [0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, Scratch(spark, "t")).collect())
    assert got == sorted([(5, 1, 5, True), (5, 0, 5, True), (6, 1, 5, False), (6, 1, 5, False), (9, 1, 7, False), (9, 1, 7, False), (7, 1, 7, True), (8, 1, 7, False), (4, 0, 4, True)])


def test_audited_recall_is_told(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(0, 0.01, 16)).tolist(), i % 2) for i in range(400)] + [(900, [1.0, 2.0], 7), (901, None, 0)]
    got = {r.vec_id: r.audit_recall for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), Scratch(spark, "t"), audit=True).collect()}
    assert len(got) == 402 and got[900] is None and got[901] is None and all(got[i] >= 0.99 for i in range(400))


def test_archives(spark):
    big = "<html>" + "x" * 1200
    rows = [(i, f"http://h/{i}", big) for i in (5, 9, 7)] + [(1, None, None), (2, "u", ""), (3, "u r\nl", "small"), (4, "u", "small"), (6, "u", "é" * 700), (None, "n", big), (9, "u2", big), (8, "u", big + "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))
    out = warc.read_archives(warc.write_archives(warc.mark_revisits(df), archive_bytes=1500)).collect()
    assert {r.kind for r in out} == {"record"} and len(out) == len(rows)
    want = collections.Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        top = max((r[0] for r in rows if r[2] == t and r[0] is not None), default=None)
        again = len(b) >= 1000 and i != top
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(df.limit(0)))).count() == 0


def test_pages_of_very_long_addresses_are_kept(spark, tmp_path):
    rows = [(1, "http://h/" + "a" * 100_000, "<p>" + "x" * 1200), (2, "http://h/" + "b " * 50_000, "<p>" + "x" * 1200), (3, "http://h/" + "c" * 100_000, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in queries.op10_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (1203, "revisit", 2), 2: (1203, "response", None), 3: (0, "response", None)}
