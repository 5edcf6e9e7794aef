"""Parts that need no Spark: hashing, transforms, signatures, packing plans, containers, archives, tokens, graphs."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bwt, hnsw, logbilinear, media, minhash, packing, scoring, suffixes, toxicity, vectors, warc
from quarry.llm.common import Rolling, words
from quarry.llm.queries import tokenizer_path
from quarry.llm.tokens import WordIds


@given(st.binary(min_size=1, max_size=60), st.data())
@settings(max_examples=60, deadline=None)
def test_rolling_hash_depends_on_content_only(x, data):
    a = data.draw(st.integers(0, len(x)))
    z = data.draw(st.integers(a, len(x)))
    buf = np.frombuffer(b"pad" + x, np.uint8)
    own = np.frombuffer(x[a:z] + b"!", np.uint8)
    one, two = Rolling(buf, 5).ranges(np.array([a + 3]), np.array([z + 3])), Rolling(own, 5).ranges(np.array([0]), np.array([z - a]))
    assert one[0] == two[0]


@given(st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_words_are_ascii_split(text):
    raw = text.encode()
    s, e = words(np.frombuffer(raw + b"\n", np.uint8))
    assert [raw[a:z] for a, z in zip(s, e)] == raw.split()


def brute_repeats(strings, d):
    c = collections.Counter(s[i : i + d] for s in strings for i in range(len(s) - d + 1))
    return {(j, i) for j, s in enumerate(strings) for i in range(len(s) - d + 1) if c[s[i : i + d]] > 1}


@pytest.mark.parametrize("seed", range(12))
def test_merged_transforms_find_all_repeats(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abc\0\xff"
    strings = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 12))]
    if seed % 3 == 0:
        strings.append(strings[0])
    for d in (1, 3, 8):
        cuts = sorted({0, len(strings), rng.randint(0, len(strings))})
        shards = [bwt.Shard(strings[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]
        got = {(a + int(i), int(j)) for a, (s, o, n) in zip(cuts[:-1], bwt.repeats(shards, d)) for i, j in zip(s, o)}
        assert got == brute_repeats(strings, d)


@pytest.mark.parametrize("seed", range(8))
def test_strings_that_stand_for_several(seed):
    """Equal strings given once with a number are as good as given that often."""
    rng = random.Random(seed)
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(9)})
    times = [rng.choice((1, 1, 2, 5)) for _ in strings]
    for d in (1, 4, 9):
        cut = rng.randint(1, len(strings) - 1)
        shards = [bwt.Shard(strings[:cut], times[:cut]), bwt.Shard(strings[cut:], times[cut:])]
        found = [(a + int(i), int(j), int(n)) for a, x in zip((0, cut), bwt.repeats(shards, d)) for i, j, n in zip(*x)]
        many = [s for s, n in zip(strings, times) for _ in range(n)]
        want = {(many[i], j) for i, j in brute_repeats(many, d)}
        assert {(strings[i], j) for i, j, _ in found} == want and all(1 <= n <= d for *_, n in found)


@pytest.mark.parametrize("d", [5, 8, 15, 16, 23, 31, 40])
def test_wide_steps_find_all_repeats(d):
    """Steps of 8, 4, 2 and 1 bytes, over groups that part at any byte and strings that stand for several."""
    rng = random.Random(d)
    pieces = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 30))) for _ in range(5)]
    strings = sorted({b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(30)})
    times = [rng.choice((1, 1, 1, 3)) for _ in strings]
    shards = [bwt.Shard(strings[a:z], times[a:z], d) for a, z in ((0, 9), (9, 10), (10, len(strings)))]
    found = [(strings[a + int(i)], int(j)) for a, x in zip((0, 9, 10), bwt.repeats(shards, d)) for i, j in zip(*x[:2])]
    many = [s for s, n in zip(strings, times) for _ in range(n)]
    assert len(found) == len(set(found)) and set(found) == {(many[i], j) for i, j in brute_repeats(many, d)}


def test_groups_that_stay_whole_are_not_sorted_again(monkeypatch):
    """Two strings with one long common part: each of its windows is sorted in the first steps, and only carried on after."""
    rng = random.Random(3)
    part = bytes(rng.randrange(1, 256) for _ in range(3000))
    shards = [bwt.Shard([b"x" + part], None, 200), bwt.Shard([part + b"y"], None, 200)]
    sorted_rows = []
    for name in ("argsort", "lexsort"):
        real = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, real=real, **k: (r := real(x, *a, **k), sorted_rows.append(len(r)))[0])
    found = bwt.repeats(shards, 200)
    assert [sorted(o.tolist()) for _, o, _ in found] == [list(range(1, 2802)), list(range(2801))]
    assert sum(sorted_rows) < 3 * 2 * 2802  # two bytes a step sorted all of them a hundred times


def test_shard_is_a_transform():
    shard = bwt.Shard([b"banana", b"ananas"])
    text = b"banana\0ananas\0"
    assert sorted(shard.at.tolist()) == list(range(len(text)))
    for r in range(len(text)):
        if shard.last[r] >= 0:
            assert shard.last[r] == text[shard.at[r] - 1]
            assert shard.at[shard.lf[r]] == shard.at[r] - 1


@pytest.mark.parametrize("text", [b"a" * 50, b"abcabcabc" * 5, bytes(range(60)), b"x" * 12])
def test_segments_hold_each_window_once_under_a_content_anchor(text):
    depth, gram = 12, 4
    data = np.frombuffer(text, np.uint8)
    anchor, start, length, place = suffixes.segments(data, depth, gram)
    grams = {int(a): text[s + p : s + p + gram] for a, s, p in zip(anchor, start, place)}
    assert all(text[s + p : s + p + gram] == grams[int(a)] for a, s, p in zip(anchor, start, place))
    owned = [s + i for s, n in zip(start, length) for i in range(n - depth + 1)]
    assert owned == list(range(len(text) - depth + 1))
    by_window = collections.defaultdict(set)
    for a, s, n in zip(anchor, start, length):
        for i in range(n - depth + 1):
            by_window[text[s + i : s + i + depth]].add(int(a))
    assert all(len(v) == 1 for v in by_window.values())


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") for _ in range(200)]
    texts = [" ".join(base), " ".join(base[:150] + ["z"] * 40), " ".join(["a b c d e"] * 40), " ".join(["a b c d e"] * 25)]
    doc, item, n = minhash.shingles(texts, 1)
    reg = minhash.signatures(4, doc, item, n, 4096)
    cut = np.searchsorted(doc, np.arange(5))
    bag = [(item[a:z], n[a:z]) for a, z in zip(cut[:-1], cut[1:])]
    for i, j in ((0, 1), (2, 3), (0, 2)):
        assert abs(minhash.similarity(bag[i], bag[j]) - (reg[i] == reg[j]).mean()) < 0.035


def test_signature_does_not_depend_on_the_batch():
    texts = ["one two three four five six", "x y", None, "a b c d e f g h i j k l m n o p"]
    doc, item, n = minhash.shingles(texts)
    together = minhash.signatures(4, doc, item, n, 32)
    for i, t in enumerate(texts):
        assert (minhash.signatures(1, *minhash.shingles([t]), 32)[0] == together[i]).all()


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 9), max_size=20))
@settings(max_examples=60, deadline=None)
def test_packing_plan_places_everything_without_overlap(counts):
    slots = packing.plan(counts, 100)
    used = collections.defaultdict(list)
    placed = collections.Counter()
    for length, rank, n, first, at in slots.tolist():
        assert rank == placed[length]
        placed[length] += n
        for i in range(n):
            used[first + i].append((at, length))
    assert placed == collections.Counter(counts)
    for items in used.values():
        items.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and items[0][0] == 0
        assert sum(n for _, n in items) <= 100
        assert sum(3 * n > 100 for _, n in items) <= 2


@given(st.binary(max_size=2000))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(raw):
    payload = media.pad(raw)
    data = media.build(payload)
    (t,) = media.tracks(data)
    assert media.stored(data, t) == payload and len(payload) % 64 == 0 and len(payload) > 0
    assert all(data[o : o + n] == payload[64 * 8 * i : 64 * 8 * i + 64] for i, (o, n) in enumerate(media.sync_ranges(t)))


def test_media_reads_many_chunks_and_refuses_damage():
    data = media.build(bytes(range(256)) * 400)
    (t,) = media.tracks(data)
    assert t["codec"] == "raw " and len(t["sizes"]) == 1600 and t["played"] == 1600 and t["sync"].sum() == 200
    for bad in (b"", data[:100], data[:-1], data.replace(b"stsz", b"free")):
        with pytest.raises(media.Malformed):
            media.tracks(bad)
    assert media.tracks(media.box(b"moov", media.box(b"free"))) == []  # a movie without tracks is whole


def test_media_damage_has_a_name():
    deep = b""
    for _ in range(5000):
        deep = media.box(b"moov", deep)
    with pytest.raises(media.Malformed, match="deep"):
        media.tracks(deep)
    data = media.build(bytes(640))
    at = data.index(b"mdhd") + 4 + 20
    with pytest.raises(media.Malformed, match="timescale"):
        media.tracks(data[:at] + bytes(4) + data[at + 4 :])
    stco = data.index(b"stco")
    wide = data[: stco - 4] + media.box(b"co64", bytes(4), (1).to_bytes(4, "big"), (2**64 - 200).to_bytes(8, "big")) + data[stco + 16 :]
    grown = _grown(wide, 4, (b"moov", b"trak", b"mdia", b"minf", b"stbl"))
    with pytest.raises(media.Malformed, match="outside"):
        media.tracks(grown)


def _grown(data, by, kinds):
    """The file after boxes on the way to a place grew by some bytes."""
    out = bytearray(data)
    for kind in kinds:
        at = data.index(kind) - 4
        out[at : at + 4] = (int.from_bytes(data[at : at + 4], "big") + by).to_bytes(4, "big")
    return bytes(out)


def test_media_reads_fragments():
    """An empty movie and two fragments: sizes and flags by sample, by run and by default."""
    be = lambda *x: b"".join(n.to_bytes(4, "big") for n in x)
    data = media.build(bytes(64))
    trex = media.box(b"mvex", media.box(b"trex", be(0, 1, 1, 2, 10, 0x10000)))
    moov = data.index(b"moov") - 4
    size = int.from_bytes(data[moov : moov + 4], "big")
    start = _grown(data[: moov + size] + trex + data[moov + size :], len(trex), (b"moov",))
    shift = len(trex)  # the one sample of the movie moved
    stco = start.index(b"stco") + 12
    start = start[:stco] + be(int.from_bytes(start[stco : stco + 4], "big") + shift) + start[stco + 4 :]
    one = lambda run, tfhd=be(0x20000, 1): media.box(b"moof", media.box(b"mfhd", be(0, 1)), media.box(b"traf", media.box(b"tfhd", tfhd), run))
    run = lambda off: media.box(b"trun", be(0x205, 2, off, 0, 30, 40))  # offset, flags of the first, sizes
    first = one(run(len(one(run(0))) + 8))
    plain = lambda off: media.box(b"trun", be(1, 3, off))
    second = one(plain(len(one(plain(0))) + 8))
    whole = start + first + media.box(b"mdat", b"a" * 30 + b"b" * 40) + second + media.box(b"mdat", b"c" * 30)
    (t,) = media.tracks(whole)
    assert media.stored(whole, t) == bytes(64) + b"a" * 30 + b"b" * 40 + b"c" * 30
    assert t["sizes"].tolist() == [64, 30, 40, 10, 10, 10] and t["sync"].tolist() == [True, True, False, False, False, False] and t["played"] == 1 + 2 * 5
    with pytest.raises(media.Malformed):
        media.tracks(whole[:-5])
    with pytest.raises(media.Malformed):
        media.tracks(start + one(plain(0), be(0x20000, 9)))


def test_warc_salvage_recovers_what_follows_damage():
    recs = [warc.record(i, f"http://h/{i}", bytes([65 + i]) * 1500) for i in range(5)]
    packed = [warc._member(r) for r in recs]
    cut = bytearray(packed[1])
    cut[len(cut) // 2] ^= 0xFF
    data = packed[0] + bytes(cut) + b"garbage" + packed[2] + packed[3][:40] + packed[4]
    out = list(warc.salvage(data))
    assert [x["page_id"] for x in out if x["kind"] == "record"] == [0, 2, 4]
    assert sum(x["length"] for x in out) == len(data)
    plain = recs[0] + recs[1][:-30] + recs[2]
    out = list(warc.salvage(plain))
    assert [x["page_id"] for x in out if x["kind"] == "record"] == [0, 2] and [x["kind"] for x in out] == ["record", "gap", "record"]
    changed = recs[0].replace(b"A" * 1500, b"A" * 1499 + b"B")
    assert [x["reason"] for x in warc.salvage(changed)] == ["block digest"]


def test_warc_headers_of_any_length():
    url = "http://h/" + "é x" * 50_000
    recs = [warc.record(1, url, b"a" * 1500), warc.record(2, url, b"a" * 1500, refers_to=1), warc.record(3, "u", b"b")]
    for parts in (recs, [warc._member(r) for r in recs]):
        out = list(warc.salvage(b"".join(parts)))
        assert [(x["kind"], x["page_id"], x["refers_to"]) for x in out] == [("record", 1, None), ("record", 2, 1), ("record", 3, None)]
        assert out[0]["uri"] == out[1]["uri"] == url.replace(" ", "%20")
        damaged = list(warc.salvage(b"WARC/1.1\r\n" + parts[0][:700] + b"".join(parts)))
        assert [(x["kind"], x.get("page_id")) for x in damaged] == [("gap", None), ("record", 1), ("record", 2), ("record", 3)]


def test_warc_revisit_keeps_digest_and_length():
    (x,) = warc.salvage(warc._member(warc.record(3, None, b"p" * 1200, refers_to=9)))
    assert (x["record_type"], x["refers_to"], x["payload_bytes"], x["page_id"]) == ("revisit", 9, 1200, 3)


@given(st.lists(st.text(max_size=40), max_size=4))
@settings(max_examples=60, deadline=None)
def test_ids_are_those_of_the_tokenizer(texts):
    w = test_ids_are_those_of_the_tokenizer.__dict__.setdefault("w", WordIds(tokenizer_path()))
    want = [np.array(e.ids, "<u4").tobytes() for e in w.slow.encode_batch(texts, add_special_tokens=False)]
    assert w.ids(texts) == want


def test_ids_of_awkward_texts():
    w = WordIds(tokenizer_path())
    texts = ["it's he'LL 123 x²½ <|endoftext|> a<|startoftext|>b", "İstanbul ΑΣ ñandú ÀÉ", "日本語 a\x01b \x1c", "", "naïve—word “q” €5 ß!!! a.b,c", "é ́x"]
    assert w.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in w.slow.encode_batch(texts, add_special_tokens=False)]


def test_graph_search_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph.load(hnsw.Graph(x.astype(np.float32)).dump(), x)
    ids, _ = g.search(x[:100].astype(np.float32), 48)
    true = np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true.tolist(), ids.tolist())]) > 0.9


def test_forest_joins_sets():
    f = vectors.Forest(6)
    f.link(np.array([5, 4]), np.array([4, 1]))
    f.link(np.array([0]), np.array([3]))
    assert f.root.tolist() == [0, 1, 2, 0, 1, 1]


def test_log_bilinear_model_is_normalised_and_beats_the_unigram():
    rng = np.random.default_rng(3)
    words = {b"": 500} | {b"w%d" % i: 3000 // (i + 1) + 2 for i in range(200)}
    s = logbilinear.Symbols(words, np.full(16, 40.0), np.full(16, 20.0))
    assert len(s.first) - 1 < len(s.p) and s.first[-1] == len(s.p) and abs(s.p.sum() - 1) < 1e-12
    follow = rng.permutation(len(s.p))  # the next symbol often depends on the last but one
    ids = [s.end, s.end]
    for _ in range(30_000):
        ids.append(int(follow[ids[-2]]) if rng.random() < 0.7 else int(rng.choice(len(s.p), p=s.p)))
    ids, at = np.array(ids, np.int32), np.arange(2, 30_002)
    m = logbilinear.start(s)
    assert np.allclose(logbilinear.log_probs(m, s, ids[:300], np.arange(2, 300)), np.log10(s.p[ids[2:300]]), atol=1e-5)
    t = logbilinear.Trainer(m, s, 1)
    for _ in range(4):
        t.text(ids, at)
    everything = np.concatenate([np.array([*ids[50:52], k], np.int32) for k in range(len(s.p))])
    p = 10 ** logbilinear.log_probs(t.m, s, everything, np.arange(2, len(everything), 3))
    assert abs(p.sum() - 1) < 1e-4
    assert logbilinear.log_probs(t.m, s, ids, at).mean() > np.log10(s.p[ids[at]]).mean() + 0.3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAzZ[@`{\x00\x1c\x85\xa0\u00c9\u2003 \t\n\x0b\x0c\r", max_size=14), max_size=8), st.integers(0, 3))
def test_tokens_of_a_batch_are_those_of_each_text(texts, skip):
    codes, kinds, n = scoring._tokens(pa.array(texts, pa.string()).slice(skip))
    want = [(t or "").encode().lower().split() for t in texts[skip:]]
    assert n.tolist() == [len(t) for t in want] and len(kinds) == len(set(kinds.to_pylist()))
    assert [kinds[int(c)].as_py() for c in codes] == [w for t in want for w in t]


def test_each_different_token_of_a_batch_is_looked_up_once():
    s = logbilinear.Symbols({b"": 9, b"the": 5, b"a": 3}, np.full(4, 2.0), np.full(4, 1.0))
    asked, real = [], s.ids
    s.ids = lambda tokens: (asked.extend(tokens), real(tokens))[1]
    ids, n, far, kinds, codes = scoring._symbols(s, pa.array(["The rare a the", None, "a rare the rare"]))
    assert sorted(asked) == [b"a", b"rare", b"the"]
    assert ids.tolist() == [s.at[b"the"], s.cell(b"rare"), s.at[b"a"], s.at[b"the"], s.at[b"a"], s.cell(b"rare"), s.at[b"the"], s.cell(b"rare")]
    assert n.tolist() == [4, 0, 4] and far.tolist() == [1, 5, 7]
    tails = scoring._tails(np.searchsorted(np.cumsum(n), far, side="right"), codes, kinds, 3)
    assert tails.to_pylist() == [[{"token": b"rare", "n": 1}], [], [{"token": b"rare", "n": 2}]]


@pytest.mark.parametrize("kinds", [1, 7, 5000])
def test_gradients_are_summed_by_row(kinds):
    rng = np.random.default_rng(kinds)
    ids, grad = rng.integers(0, kinds, 700).astype(np.int32), rng.normal(size=(700, 5)).astype(np.float32)
    rows, sums = logbilinear._rows(ids, grad.copy())
    want = np.zeros((kinds, 5))
    np.add.at(want, ids, grad)
    assert rows.tolist() == sorted(set(ids.tolist())) and sums.dtype == np.float32 and np.allclose(sums, want[rows], atol=1e-4)


def test_moves_of_tasks_are_averaged_by_row():
    words = {b"": 50} | {b"w%d" % i: 30 - i for i in range(20)}
    s = logbilinear.Symbols(words, np.zeros(16), np.zeros(16))
    m = logbilinear.start(s)
    ids = np.array([s.end, s.end, 3, 4, 5, 3], np.int32)
    both = [logbilinear.Trainer(m, s, k) for k in (1, 2)]
    for t in both:
        t.text(ids, np.arange(2, 6))
    parts = [[x for x in logbilinear.deltas(m, t, 8) if x[:2] == ("R", 0)][0][2:] for t in both]
    rows, weights, moves = logbilinear.merged(parts, m["R"].shape[1])
    rows = np.frombuffer(rows, "<u2")
    assert set(rows.tolist()) == {s.end, 3, 4, 5} & set(range(8)) and (np.frombuffer(weights, "<f4") == 2).all()
    want = (both[0].m["R"][rows] + both[1].m["R"][rows]) / 2 - m["R"][rows]
    assert np.allclose(np.frombuffer(moves, "<f2").reshape(len(rows), -1), want, atol=2e-3)


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    n = 400
    y1 = (rng.random(n) < 0.5).astype(float)
    y2 = np.where(rng.random(n) < 0.9, y1, 1 - y1)
    doc, ids = np.arange(n), np.where(y1 > 0, 7, 9)
    chain = toxicity.fit_chain(doc, ids, np.ones(n), {"a": y1, "b": y2}, np.arange(n) % 5)
    assert [len(m["e"]) for m in chain] == [0, 1]
    assert chain[1]["e"][0] > 0  # the second category leans on the first


def test_chain_makes_few_arrays_of_all_entries():
    """One entry in four is of a telling feature; a fit holds less beside its input than two arrays of all entries."""
    rng = np.random.default_rng(2)
    n, common, rare = 6000, 300, 900
    y = (np.arange(n) % 4 == 0).astype(float)
    ids = np.column_stack((rng.integers(0, 1500, (n, common)) + 500 * y[:, None].astype(int), rng.integers(2000, toxicity.BUCKETS, (n, rare)))).ravel()
    doc, val = np.repeat(np.arange(n, dtype=np.int32), common + rare), np.ones(len(ids), np.int32)
    tracemalloc.start()
    try:
        toxicity.fit_chain(doc, ids, val, {"a": y}, np.arange(n) % 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * 8 * len(ids), peak / len(ids)


def test_audit_finds_links_that_a_narrow_beam_misses():
    """Links of queries outside the first sample only, and isolated links beside a hot cluster."""
    rng = np.random.default_rng(3)
    x = vectors._unit(rng.normal(size=(600, 24)))
    x[:300] = vectors._unit(x[0] + rng.normal(0, 0.005, (300, 24)))

    class Narrow:  # sees nothing but the first 300 places below a width of 128
        def search(self, q, w):
            sims = q @ x.T
            if w < 128:
                sims = np.where(np.arange(600) < 300, sims, -1)
            ids = np.argsort(-sims, axis=1)[:, :w]
            return ids, np.take_along_axis(sims, ids, 1)

    for hot in (0, 16):
        q = vectors._unit(rng.normal(size=(160, 24)))
        q[:hot] = x[:hot]
        for i in (5, 48, 77):
            if hot or i % 16:
                q[i] = x[400 + i]
        n, *_ = vectors.search_block(Narrow(), x, np.ones(600, np.int64), q, 0.98)
        assert (n == (q @ x.T >= 0.98).sum(axis=1)).all() and n[77] == 1
