import hashlib
import random
import struct
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from captionforge.llm import bpe, components, exact_dedup, mixing, quality_rules, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = " \t\n\r\x0b\x0c"


def brute_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def rows(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = ["the", "of", "And", "thé", "naïve,", "x|y", "|", "end.", "###", "Ünder", "日本", "a", "b c"]
    out = []
    for i in range(n):
        text = "".join(rnd.choice(vocab) + rnd.choice(WS + "    ") for _ in range(rnd.choice([0, 1, 3, 12, 60])))
        out.append((i, text, "en", rnd.choice(["s0", "s0", "s1", "s2", None]), len(text)))
    out += [(n + i, t, None, s, None) for i, (t, s) in enumerate([(None, "s0"), ("", None), (" \n\t", "s9"), ("word " * 30_000, "s1"), (out[3][1], "s2"), (out[3][1].upper(), "s2"), (out[7][1], "s0")])]
    return out + [out[5], out[5]]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def clash(df):
    """The same rows with more columns, named as the operators' own and the results' are."""
    from pyspark.sql import functions as F

    names = ["size", "kept", "keep_id", "_text", "_id", "_fp", "_sha", "_source", "_q", "target", "taken", "shard", "n_words", "component_id"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])


OPERATORS = [quality_rules.quality_rules, bpe.digests, simhash.near_duplicates, exact_dedup.exact_dedup, mixing.mix, sharding.ring_shards]


@pytest.mark.parametrize("op", OPERATORS)
def test_empty_table_and_clashing_names(spark, docs, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []
    plain, clashing = op(docs), op(clash(docs))
    assert plain.columns == clashing.columns
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, clashing.collect()))


@pytest.mark.parametrize("op", OPERATORS)
def test_null_ids(spark, op):
    got = op(spark.createDataFrame([(None, "a b c", None, None, None), (None, None, None, None, None), (4, "A b c", None, None, None)], SCHEMA)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "None", "None"]


def brute_quality(text):
    text = text or ""
    w = brute_words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    hit = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
    lines = [x for x in text.split("\n") if brute_words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_base(docs, data):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, text, *_ in data:
        r = got[i]
        n, chars, sym, dup, rep = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep), i
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["kept"] and r["base_failed"])


def test_quality_lines(spark):
    prose = "Some plain prose that says little, but says it in a whole sentence, as sentences go.\n" "Another line follows here, with words of its own and an end."
    menu = "Home | About | Contact | Terms | Imprint"
    cases = [(1, prose), (2, "\n".join([menu] * 2 + [f"a{i} | b{i} | c{i} | d{i}" for i in range(9)])), (3, prose + "\n" + menu), (4, " ".join(f"w{i}###" for i in range(40))), (5, " ".join(f"W{i}!!" for i in range(40)))]
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in cases], SCHEMA)
    kept = {r["doc_id"]: r["text"] for r in quality_rules.keep_quality(df).collect()}
    assert kept == {1: prose, 3: prose}


def test_quality_boilerplate_in_four_languages(spark):
    prose = "Some plain prose that says little, but says it in a whole sentence, as sentences go."
    notices = ["All Rights Reserved.", "Datenschutz und Impressum", "Tous droits réservés.", "Aviso legal", "Política de privacidad"]
    df = spark.createDataFrame([(i, prose + "\n" + x, None, None, None) for i, x in enumerate(notices)], SCHEMA)
    assert {r["text"] for r in quality_rules.keep_quality(df).collect()} == {prose}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


SPACED = ["a  b", "a   b", "a \n b", "a\n \nb", "a\n  b", " a", "  a", "a ", "a  ", "\n", " ", "", "a  b", "a   b", "it's I'LL we've 'tis", "x\x1c y \x1c\x1c z", "12 345½ ²", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "日本語 テスト", "🎉🎉 é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x01", "tab\tbed  \t x"]


def test_bpe_against_library(docs, data, library):
    texts = SPACED + [t or "" for _, t, *_ in data]
    own = bpe.TrieBPE(open(bpe.default_tokenizer()).read())
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t[:80]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for i, t, *_ in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_random_strings(library):
    own, rnd = bpe.TrieBPE(open(bpe.default_tokenizer()).read()), random.Random(3)
    letters = "abcdeeeinnrstth .,\n'é§日  "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids, t


def test_bpe_steps_do_not_grow_with_the_word(library):
    own, rnd = bpe.TrieBPE(open(bpe.default_tokenizer()).read()), random.Random(5)
    word = "".join(rnd.choice("abcdeeeinnrstth") for _ in range(2000)).encode()
    want = library.encode(word.decode(), add_special_tokens=False).ids
    assert struct.unpack(f"<{len(want)}I", dict(own.walk([word]))[word]) == tuple(want)
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        list(own.walk([word]))
    finally:
        sys.setprofile(None)
    assert calls["c_call"] < 8 * len(word)


def test_bpe_store_keeps_words_in_use(library, monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 400)
    own, rnd = bpe.TrieBPE(open(bpe.default_tokenizer()).read()), random.Random(6)
    walked, walk = Counter(), bpe.TrieBPE.walk
    monkeypatch.setattr(bpe.TrieBPE, "walk", lambda self, words: walked.update(words) or walk(self, words))
    usual = [f"x{n:03}." for n in range(50)]
    for _ in range(40):
        texts = [" ".join(["", *usual, *("".join(rnd.choice("abcdenrst'é\n") for _ in range(9)) for _ in range(60))]) for _ in range(2)]
        own.learn(texts)
        for t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            assert struct.unpack(f"<{len(ids)}I", own.encode_learned(t)) == tuple(ids)
        assert sum(len(v) for k, v in vars(own).items() if k.endswith("pieces")) < 400 + 2 * 170
    assert [walked[p] for p in (b" x", b".", b"000", b"049")] == [1, 1, 1, 1]


def test_bpe_splits_new_words_together(library):
    own, rnd = bpe.TrieBPE(open(bpe.default_tokenizer()).read()), random.Random(8)
    parts = [*"abcdenrst.,'é日🎉12½\n\t\x1c\x85\xa0\u3000\u200b ", "'s", "'ll", "  ", " \n", "\r\n", "***", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    found, find = [], own.find
    own.find = lambda text: found.append(text) or find(text)
    own.learn(texts)
    assert len(found) <= 1 + len({t.split(" ")[0] for t in texts})
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert struct.unpack(f"<{len(e.ids)}I", own.encode_learned(t)) == tuple(e.ids), t


def test_bpe_ids_and_text(docs):
    got = bpe.bpe_encode(docs.filter("text is not null"))
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    both = got.join(docs, "doc_id").filter("decoded <> text or size(ids) <> n_tokens")
    assert both.count() == 0


def brute_components(fps):
    """fps: doc_id -> fingerprint, or several, any of which may link."""
    fps = {i: f if isinstance(f, list) else [f] for i, f in fps.items()}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any((x ^ y).bit_count() <= 3 for x, y in zip(fps[i], fps[j], strict=True)):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def mix64(h, k):
    if not k:
        return h
    m = (1 << 64) - 1
    z = h + k * 0x9E3779B97F4A7C15 & m
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ z >> 27) * 0x94D049BB133111EB & m
    return z ^ z >> 31


def brute_fingerprint(text, n=3, k=0):
    import xxhash

    w = [x.decode() for x in (text or "").encode().lower().split()]
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [mix64(xxhash.xxh64_intdigest(x, seed=42), k) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute(spark, docs, data):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in data}
    want = brute_components(fps)
    for i in fps:
        assert got[i]["fingerprint"] == f"{fps[i]:016x}"
        assert got[i]["component_id"] == want[i]


def test_masks_cover_every_three_bits():
    from itertools import combinations

    m = [x & (1 << 64) - 1 for x in simhash.masks()]
    assert len(m) == 15
    for c in combinations(range(64), 3):
        bits = sum(1 << b for b in c)
        assert any(not x & bits for x in m)


@pytest.mark.parametrize("most", [1, 4, 64])
def test_links_small_and_large_buckets(spark, most):
    rnd = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(15):
            fps.add(base)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4])):
                base ^= 1 << b
    fps = {f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.links(spark.createDataFrame([(0, f, f) for f in fps], "_k int, _fp long, _m long"), most)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3
    got = {r["node"]: r["root"] for r in components.stars(edges).collect()}
    unsigned = {f: f & (1 << 64) - 1 for f in fps}
    assert {f: got.get(f, f) for f in fps} == brute_components(unsigned)


@pytest.mark.parametrize("most", [1, 64])
def test_several_fingerprints_link_by_any(spark, most):
    rnd = random.Random(6)
    rows = []
    for _ in range(8):
        base = [rnd.getrandbits(64) for _ in range(3)]
        for _ in range(6):
            base = [b ^ sum(1 << x for x in rnd.sample(range(64), rnd.choice([0, 3, 5]))) if rnd.random() < 0.6 else rnd.getrandbits(64) for b in base]
            rows.append(base)
    rows += [rows[0], [rows[1][0], 5, 6], [7, rows[9][1], 8]]
    signed = [[f - (1 << 64) if f >> 63 else f for f in r] for r in rows]
    found = spark.createDataFrame(list(enumerate(signed)), "id long, _fps array<long>")
    got = {r["_fp"]: r["_least"] for r in simhash.components(found, "id", most).collect()}
    want = brute_components(dict(enumerate(rows)))
    assert {i: got[r[0]] for i, r in enumerate(signed)} == want and len(set(want.values())) > 5


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def test_exact_brute(docs, data):
    low = lambda t: (t or "").encode().lower().decode()
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[low(t)].append(i)
    want = Counter((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t, *_ in data)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want


def brute_targets(sizes, weights=(5, 2, 1)):
    """Fractions: the level is raised until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: Fraction(weights[k % 3]) for k, s in enumerate(names)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > 3 * sizes[s]]
        if not over:
            return {s: Fraction(3 * sizes[s]) if s in full else level * w[s] for s in names}
        full |= set(over)


def test_mix_brute(docs, data):
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += len(brute_words(t))
    want = brute_targets(sizes)
    source = {i: s for i, _, _, s, _ in data}
    got = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in data)
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - float(want[s])) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= 1, s
    assert Counter(map(tuple, mixing.mix(docs.repartition(3)).collect())) == Counter(map(tuple, got))


def test_schedule_is_low_discrepancy(spark):
    per = mixing.targets(spark.createDataFrame([(1, f"s{k}", 40_000) for k in range(7)], "doc_id long, _source string, size long"))
    slots = sorted((r["_slot"], r["_sid"], r["_rank"]) for r in mixing.schedule(spark, per).collect())
    n, share = len(slots), Counter(s for _, s, _ in slots)
    assert [sorted(r for _, s, r in slots if s == k) for k in share] == [list(range(share[k])) for k in share]
    seen = Counter()
    for k, (_, s, _) in enumerate(slots[: n * 9 // 10], 1):
        seen[s] += 1
        if k % 50 == 0:
            assert all(abs(seen[x] - k * share[x] / n) < 12 for x in share)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, data, law):
    got = sharding.ring_shards(docs, law=law).collect()
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in data}
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in data}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in data)
    by = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (size[r["doc_id"]], crc[r["doc_id"]], None)
        by[r["shard"]].append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    if law == "rows":
        counts = [len(by[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in sharding.ring_shards(docs.repartition(3), law=law).collect())


def test_bytes_law_is_near_equal(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, "x" * rnd.randint(0, 99)) for i in range(6000)], "doc_id long, text string")
    loads = Counter()
    for r in sharding.ring_shards(df, law="bytes").collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 3 * 100


def test_ring_moves_little():
    """One more shard's worth of room moves rows mostly because of the bounds, not of the ring."""
    loads = dict.fromkeys(range(1 << 14), 10)
    total = sum(loads.values())
    roomy = lambda n: {(c, f): s for c, f, t, s in sharding.walk(loads, [total] * n, 128, 1 << 14)}
    a, b = roomy(16), roomy(17)
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == 16 for k in moved) and len(moved) < len(loads) / 10


def test_ring_moves_little_as_it_is_run():
    """With bounds that leave no room, as law rows has them: what overflows moves as well, but little more than a shard's worth."""
    loads = dict.fromkeys(range(1 << 14), 10)
    total = sum(loads.values())
    caps = lambda n: [total // n + (s < total % n) for s in range(n)]

    def owners(n):
        out = {}
        for c, f, t, s in sharding.walk(loads, caps(n), sharding.VNODES, 1 << 14):
            out |= {(c, k): s for k in range(f, t)}
        return out

    a, b = owners(16), owners(17)
    moved = sum(a[k] != b[k] for k in a)
    assert 1 / 17 <= moved / total < 0.1


def near_group(n, bits=1, seed=8):
    """n fingerprints that differ from one in `bits` of twenty bits at most, and so share buckets."""
    rnd = random.Random(seed)
    out = {rnd.getrandbits(63)}
    base = next(iter(out))
    while len(out) < n:
        out.add(base ^ sum(1 << b for b in rnd.sample(range(20), bits)))
    return out


def test_edges_of_a_bucket_grow_with_its_members(spark):
    """A group of 150 near copies, all in buckets that are joined with themselves, has far fewer edges than its 11,175 pairs."""
    fps = near_group(150, 2)
    edges = simhash.links(spark.createDataFrame([(0, f, f) for f in fps], "_k int, _fp long, _m long"), 256).collect()
    assert len(edges) <= 2 * 15 * len(fps) < 150 * 149 // 2
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame([tuple(r) for r in edges], "a long, b long")).collect()}
    assert {f: got.get(f, f) for f in fps} == brute_components({f: f for f in fps})


def test_near_copies_are_linked_without_broadcasts(spark, monkeypatch):
    """Whatever the threshold, no table of fingerprints or edges goes through the driver."""
    plans, real = [], simhash.cut

    def cut(df, instead_of=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, instead_of=instead_of)

    monkeypatch.setattr(simhash, "cut", cut)
    monkeypatch.setattr(components, "cut", cut)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(30)), None, None, None) for i in range(60)]
    out = simhash.keep_near(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
