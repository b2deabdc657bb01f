"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import binrecords, common, crf, decontam, langid, minhash, mixing, pii, rpforest, sharding, tokencount
from loomgraph.llm.queries import ORACLE_SQL, QUERIES, vocabulary_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, band long, size long, kept boolean"


def frame(spark, rows):
    """Documents with more columns than needed, named like the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, None, "r", 1, 2, True) for i, t, lang, s in rows], SCHEMA)


WORDS = ["the", "red", "mill", "über", "naïve", "ocean", "42", "stone", "river", "cloud", "iron", "leaf", "moon", "sand"]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [prose(r, n) for n in (0, 1, 3, 4, 5, 9, 10, 11, 40, 200, 200)]
    out = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(base)]
    near = base[9].split()
    near[100] = "changed"
    out += [(20, base[9], "en", "s0"), (21, " ".join(near).upper(), "en", "s0"), (22, None, None, None), (23, " \n\t ", "en", "s1"), (24, "!!! 123", "en", "s1"), (9, base[9], "en", "s0"), (9, base[9], "en", "s0"), (None, "no id here at all", "en", "s1"), (30, prose(r, 30_000), "en", "s2"), (31, "x" * 60_000, "en", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file(name))


def test_token_counts(spark, docs, rows, empty):
    t = library("word_bpe_49k.json")
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in rows), key=str)
    assert got(tokencount.token_counts(docs, vocabulary_file("word_bpe_49k.json")), "doc_id", "n_bytes", "n_tokens") == want
    assert tokencount.token_counts(empty, vocabulary_file("word_bpe_49k.json")).count() == 0


def test_transducer_equals_library_for_any_chunk():
    t, r = library("word_bpe_49k.json"), random.Random(3)
    machines = [tokencount.Maps(vocabulary_file("word_bpe_49k.json"), c) for c in (1, 7, 64, 10_000)]
    letters = "abcdefghijklmnoprstuvwxyzABC   '''!?.,-\n\t0123éüßñ日本語́İΣ \x1c　😀"
    for _ in range(1500):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 60))) + r.choice(["", "<|endoftext|>", "'s"])
        assert {m.count(s) for m in machines} == {len(t.encode(s, add_special_tokens=False).ids)}, s


def test_map_composition_is_associative():
    m, r = tokencount.Maps(vocabulary_file("word_bpe_49k.json")), random.Random(4)
    for _ in range(200):
        a, b, c = (m.of("".join(r.choice("ab c") for _ in range(r.randint(1, 6))), False) for _ in range(3))
        assert m.compose(m.compose(a, b), c) == m.compose(a, m.compose(b, c))


def test_unbroken_texts_of_any_length():
    m, t, r = tokencount.Maps(vocabulary_file("word_bpe_49k.json"), 64), library("word_bpe_49k.json"), random.Random(7)
    for letters in ("ab", "abc'!1", "日本語文字", "'rslv", "x"):
        s = "".join(r.choice(letters) for _ in range(5000))
        assert m.count(s) == len(t.encode(s, add_special_tokens=False).ids)
    assert m.compose(m.of("ab", False), m.of("c d", False))[0] == ("ab", "c")


def test_memory_of_a_long_unbroken_text_is_linear():
    import tracemalloc

    m = tokencount.Maps(vocabulary_file("word_bpe_49k.json"))
    peak = []
    for n in (500_000, 2_000_000):
        text = "xyzzy" * (n // 5)
        tracemalloc.start()
        m.count(text)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 6 * peak[0] and peak[1] < 40_000_000


def test_other_vocabularies(spark, docs):
    with pytest.raises(ValueError):
        tokencount.token_counts(docs, vocabulary_file("byte_bpe_50k.json"))
    t = library("word_bpe_49k.json")
    enc = binrecords.Encoder(vocabulary_file("word_bpe_49k.json"), "<u4")
    for s in ("Hello World, it's 2024!", "a  b <|endoftext|> c", "日本"):
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def brute_contamination(text, items):
    words = common.alnum_words((text or "").encode())
    hit, found = set(), set()
    for i, t in items:
        for w in decontam.windows(common.alnum_words((t or "").encode())):
            for p in range(len(words) - len(w) + 1):
                if tuple(words[p : p + len(w)]) == w:
                    hit |= set(range(p, p + len(w)))
                    if i is not None:
                        found.add(str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, rows, empty, block_bytes):
    long = rows[9][1].split()
    items = [(1, " ".join(long[5:25])), (2, "red mill"), (3, None), (4, "..."), (None, " ".join(long[150:165])), (5, " ".join(long[8:18]).upper()), (5, "the river"), (10, "absent words only here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.decontaminate(docs, table, block_bytes=block_bytes)
    have = sorted(((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), list(r["items"])) for r in found.collect()), key=str)
    assert have == sorted(((i, *brute_contamination(t, items)) for i, t, _, _ in rows), key=str)
    assert decontam.decontaminate(empty, table).count() == 0
    assert all(not r.starts for r in decontam.decontaminate(docs, table.where("false")).collect())


def test_proximity_matches(spark):
    docs = frame(spark, [(1, "a b x c d", "en", "s"), (2, "a q q q q q q q b c d", "en", "s"), (3, "d c b a", "en", "s")])
    index = decontam.build_index(docs, None)
    near = decontam.phrase_matches(index, [("i", "a b c d")], slack=1)
    assert {r.doc_id for r in near.collect() if r["items"]} == {1}
    assert {r.doc_id for r in decontam.phrase_matches(index, [("i", "a b c d")], slack=6).collect() if r["items"]} == {1, 3}


def brute_near(rows, percent=85):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_near_duplicates(spark, rows, empty):
    r = random.Random(8)
    own = [(i, t) for i, t, _, _ in rows if i is not None]
    star = " ".join(f"w{k}" for k in range(400)).split()
    for k in range(40):  # copies around one text, close to it and often too far from each other
        copy = list(star)
        for p in r.sample(range(400), r.randint(1, 12)):
            copy[p] = f"x{k}{p}"
        own.append((100 + k, " ".join(copy)))
    found = minhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in own]), block=16)
    assert got(found, "doc_id", "n_shingles", "component_id") == sorted(brute_near(own), key=str)
    assert all(x.kept == (x.doc_id == x.component_id) for x in found.collect())
    assert minhash.near_duplicates(empty).count() == 0


def test_links_within_one_large_cluster(spark):
    """All members in one cluster: two star groups whose leaves are far from each other, a group of close copies, chains and singles."""
    r = random.Random(11)
    pool, own = [f"w{k}" for k in range(4000)], []

    def varied(words, n):
        words = list(words)
        for at in r.sample(range(0, len(words) - 5, 12), n):
            words[at] = r.choice(pool)
        return words

    for size, edits, many in ((240, 2, 45), (240, 2, 30), (200, 1, 25)):
        base = [r.choice(pool) for _ in range(size)]
        own += [varied(base, edits) for _ in range(many)] + [base]
    chain = [r.choice(pool) for _ in range(150)]
    for k in range(12):
        chain = chain[8:] + [r.choice(pool) for _ in range(8)]
        own.append(chain)
    own += [[r.choice(pool) for _ in range(120)] for _ in range(20)]
    r.shuffle(own)
    own = [(i, " ".join(w)) for i, w in enumerate(own)]
    want = {i: c for i, _, c in brute_near(own)}
    assert 4 < len(set(want.values())) < 60
    for block in (8, 16):
        found = minhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in own]), block=block)
        assert {x.doc_id: x.component_id for x in found.collect()} == want


def test_a_long_chain_of_half_similar_texts_is_never_joined(spark, monkeypatch):
    """Each text shares half of its words with the next one: they meet in buckets, and no pair that shares none is compared."""
    words = [f"w{k}" for k in range(24_000)]
    own = [(i, " ".join(words[i * 60 : i * 60 + 120])) for i in range(390)]
    seen = []
    tasks = minhash._by_task
    monkeypatch.setattr(minhash, "_by_task", lambda *a: seen.append(tasks(*a)) or seen[-1])
    drop = common.drop
    monkeypatch.setattr(common, "drop", lambda *t: None)
    found = minhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in own]), percent=30, block=4)
    assert all(x.component_id == 0 for x in found.collect())
    found = minhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in own]), percent=40, block=4)
    assert all(x.component_id == x.doc_id for x in found.collect())
    monkeypatch.setattr(common, "drop", drop)
    assert sum(x.count() for x in seen) <= 2 * len(own)


def test_signature_estimates(spark):
    r = np.random.default_rng(1)
    for overlap in (0, 300, 500, 900):
        pool = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - overlap : 2000 - overlap])
        sig = minhash.packed(minhash.minima([a, b]))
        n = minhash.BANDS * minhash.ROWS
        guess = minhash.estimated(sig[0], sig[1:], n)[0]
        assert abs(guess - overlap / (2000 - overlap)) < minhash.MARGIN
        row = spark.createDataFrame([(sig[0].view(np.int64).tolist(), sig[1].view(np.int64).tolist())], "a array<long>, b array<long>")
        assert row.select(minhash.estimate(F.col("a"), F.col("b"), n)).first()[0] == pytest.approx(guess)
    band = 1 - (1 - 0.85**minhash.ROWS) ** minhash.BANDS
    assert band > 0.9999


def test_bands_follow_the_threshold():
    assert minhash.banding(85)[:2] == (24, 7)
    for percent in range(1, 101):
        of = minhash.banding(percent)
        assert (1 - (percent / 100) ** of.rows) ** of.bands <= minhash.MISS and of.bands * of.rows % 2 == 0 and of.margin >= minhash.MARGIN
    with pytest.raises(ValueError):
        minhash.banding(0)


@pytest.mark.parametrize("percent", [50, 80])
def test_pairs_near_a_lower_threshold(spark, percent):
    # pairs of texts of 296 shingles each whose similarity is a little above the threshold, and five pairs below
    least = -(-2 * 296 * percent // (100 + percent))
    rows = []
    for k in range(45):
        same = least + k % 8 if k < 40 else least - 1
        one = [f"w{k}x{i}" for i in range(300)]
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(one[: same + 4] + [f"v{k}x{i}" for i in range(296 - same)]))]
    found = minhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows]), percent=percent)
    have = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert have == brute_near(rows, percent) and sum(i != c for i, _, c in have) == 40


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    have = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert have == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_binary_records(spark, docs, rows, empty):
    t = library("byte_bpe_50k.json")
    some = sorted((x for x in rows if x[0] not in (30, 31)), key=lambda x: (x[0] is not None, x[0] or 0))
    extra = [(50, "a  b\n\nc <|endoftext|> d", "en", "s"), (51, " lead", "en", "s"), (52, "日本 x", "en", "s")]
    want, start = [], 0
    for i, x, _, _ in some + extra:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = binrecords.round_trip(spark, frame(spark, some + extra), vocabulary_file("byte_bpe_50k.json"))
    assert got(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert binrecords.round_trip(spark, empty, vocabulary_file("byte_bpe_50k.json")).count() == 0
    index = binrecords.with_starts(binrecords.write_records(frame(spark, extra), vocabulary_file("byte_bpe_50k.json"), common.new_path(spark, "records"), wide=True))
    ids = {r.doc_id: r.ids for r in binrecords.read_records(binrecords.shuffled(index, 3), wide=True).collect()}
    assert ids[50] == t.encode(extra[0][1], add_special_tokens=False).ids + [0]


def test_damaged_record():
    good = binrecords.frame(b"abcd") + binrecords.frame(b"")
    assert binrecords.unframe(good, 0) == b"abcd" and binrecords.unframe(good, 20) == b""
    for at in (1, 9, 13, 17):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            binrecords.unframe(bytes(bad), 0)


def test_sharding(spark, docs, rows, empty):
    table = sharding.lookup(sharding.names(10), 8191)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    assert sharding.moved(sharding.names(10), sharding.names(11)) < 0.2
    with pytest.raises(ValueError):
        sharding.lookup(["a"], 10)
    placed = sharding.place(docs.withColumn("slot", F.lit("old")))
    assert placed.count() == len(rows) and set(docs.columns) < set(placed.columns)
    of = {}
    for r in placed.collect():
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.lookup(sharding.names(sharding.SHARDS))[slot])
        of.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(x) == 1 for x in of.values())
    assert sharding.place(empty).count() == 0


def test_mixing(spark, docs, rows, empty):
    found = mixing.copies(docs).collect()
    assert len(found) == len(rows)
    size = {}
    for r in found:
        size.setdefault(r.source, 0)
        size[r.source] += r.size
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, left = {}, 1.5 * sum(size.values())
    todo = set(names)
    while todo:  # share, cut what is above, share the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in todo) for s in todo}
        over = {s for s in todo if share[s] > 2 * size[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        todo -= over
    for r in found:
        assert r.target == pytest.approx(goal[r.source])
        assert 0 <= r.copies <= 2 and r.source_size == size[r.source]
    assert sorted(map(str, found)) == sorted(map(str, mixing.copies(docs.repartition(3)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)
    assert mixing.copies(empty).count() == 0


def test_mix_follows_targets(spark):
    r = random.Random(1)
    many = [(i, prose(r, r.choice([5, 20, 60, 400])), "en", r.choice(["a", "a", "a", "b", "c"])) for i in range(600)]
    taken, goal = {}, {}
    for x in mixing.copies(frame(spark, many)).collect():
        taken[x.source] = taken.get(x.source, 0) + x.size * x.copies
        goal[x.source] = x.target
    assert all(abs(taken[s] - goal[s]) < 0.03 * goal[s] + 400 for s in goal)


def test_language_id(spark, rows, empty):
    found = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    docs = frame(spark, rows)
    odd = {r.doc_id: r for r in langid.identify(docs, langid.profiles(docs), keep=docs.columns).collect()}
    assert odd[22].lang_pred == odd[23].lang_pred == odd[24].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[22].row.row == "r"
    assert langid.identify(empty, langid.profiles(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_numbers_are_not_letters():
    for t in ("½ ² 123 ⅷ ٣", "\u2460", "_ _"):
        assert langid.letters(t) == "", t
    assert langid.letters("a²b ª") == " a b ª " and langid.letters("日本 X") == " 日本 x "


def test_profile_distance_by_hand():
    p = {"x": np.array([1, 2, 3], np.uint64), "y": np.array([3, 2, 1], np.uint64)}
    name, score = langid.Nearest(p, most=3)(np.array([1, 2, 9], np.uint64))
    # out of place: x 0 + 0 + 3, y 2 + 0 + 3, of at most 9
    assert name == "x" and score == pytest.approx((1 - 3 / 9) / ((1 - 3 / 9) + (1 - 5 / 9)))


def test_quality(spark, rows, empty):
    found = QUERIES["op7_quality_crf"](spark, "/root/testdata/sf0.01")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = found.join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    docs = frame(spark, rows)
    model = crf.train(docs, spark.createDataFrame([(9, 1), (10, 0), (8, None), (77, 1)], "doc_id long, quality int"))
    scores = crf.score(docs, model).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)
    assert crf.score(empty, crf.train(empty, lab)).count() == 0


def test_forward_backward_by_enumeration():
    r = np.random.default_rng(0)
    starts = np.array([0, 3, 4, 8])
    potential, transition = r.normal(size=8), r.normal(size=(2, 2))
    good, pairs, z = crf.forward_backward(potential, starts, transition)
    total, want_pairs, want = 0.0, np.zeros((2, 2)), np.zeros(8)
    for a, b in zip(starts, starts[1:]):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weight[y] = np.exp(sum(potential[a + k] for k in range(b - a) if y[k]) + sum(transition[y[k], y[k + 1]] for k in range(b - a - 1)))
        s = sum(weight.values())
        total += np.log(s)
        for y, w in weight.items():
            want[a:b] += np.array(y) * w / s
            for k in range(b - a - 1):
                want_pairs[y[k], y[k + 1]] += w / s
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and z == pytest.approx(total)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_personal(t):
    def counts(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]

    found = sorted((m.start(), i, k, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], t or "") if counts(k, m.group()))
    return [f"{k}:{a}:{e}" for a, _, k, e in found]


def test_personal_data(spark, rows, empty):
    r = random.Random(6)
    alphabet = "0123456789012345.-+ @ab😀é()"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["4111 1111 1111 1111 x 4111-1111-1111-1111", "a@b.c@d.e", "a@b.c+d@e.f..g@h.i.j.", "1.2.3.4.5.6.7.8 0001.255.256.1 00255.1.1.1", "+1 (974) 555-3436, +12", "1" * 50_000, "1 " * 20_000, "1." * 3_000, "a" * 50_000 + "@", "😀 x@y.zz 😀"]
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)] + [x for x in rows if x[0] in (22, 23, 9)])
    found = pii.personal_data(docs).withColumn("b", pii.joined(F.col("base"))).collect()
    want = {k: brute_personal(t) for k, t in enumerate(texts)}
    for x in found:
        if x.doc_id < len(texts) and x.doc_id not in (9, 22, 23):
            assert x.b == ",".join(want[x.doc_id]), texts[x.doc_id]
    assert len(found) == docs.count()
    assert pii.personal_data(empty).count() == 0


def test_disclosing_terms(spark):
    # "zanzibar" stands beside one address only; "common" everywhere
    docs = frame(spark, [(k, f"common Zanzibar ann@x.org common words {k}", "en", "s") for k in range(3)] + [(10 + k, "common words " * 40, "en", "s") for k in range(80)])
    found = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.personal_data(docs).collect()}
    assert found[0] == {("email", 16, 25), ("remove", 7, 15)}
    assert all(not found[10 + k] for k in range(80))


def test_terms_count_outside_base_spans(spark):
    # the name is part of the address too; what stands inside a base span is no occurrence of the term
    told = ["common Smithson <smithson@x.org> common", "common Okonkwo <j.okonkwo@okonkwo.org> common"]
    docs = frame(spark, [(k, told[k % 2], "en", "s") for k in range(6)] + [(10 + k, "common words " * 40, "en", "s") for k in range(80)])
    found = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.personal_data(docs).collect()}
    assert found[0] == {("email", 17, 31), ("remove", 7, 15)} and found[1] == {("email", 16, 37), ("remove", 7, 14)}
    assert all("mithson" not in r.text and "konkwo" not in r.text for r in pii.sanitised(docs).collect())


def test_disclosing_terms_are_marked_wherever_they_stand(spark):
    # the name stands six words from the address, and twice without it; of a text with several entities each has its own terms
    told = "Quillfeather wrote in common words again to ann@x.org common"
    rows = [(k, told, "en", "s") for k in range(8)] + [(8, "common Quillfeather words", "en", "s"), (9, "QUILLFEATHER", "en", "s")]
    rows += [(20 + k, "common words wrote again " * 60, "en", "s") for k in range(80)]
    found = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.personal_data(frame(spark, rows)).collect()}
    assert found[0] == {("email", 44, 53), ("remove", 0, 12)} and found[8] == {("remove", 7, 19)} and found[9] == {("remove", 0, 12)}
    assert not any(found[20 + k] for k in range(80))


def test_texts_with_many_matches(spark):
    import time

    took = []
    for n in (5_000, 40_000):
        text = " ".join(f"name{k % 7} 10.{k % 200}.{k // 200 % 200}.7 a{k}@b.org" for k in range(n))
        t = time.time()
        r = pii.personal_data(frame(spark, [(1, text, "en", "s"), (2, "plain", "en", "s")])).where("doc_id = 1").collect()[0]
        took.append(time.time() - t)
        assert len(r.base) == 2 * n and all(text[s.start : s.end] == s.value for s in r.base[:: n // 50])
    assert took[1] < 30 * max(took[0], 1)
    clean = pii.sanitised(frame(spark, [(1, text, "en", "s")])).collect()[0].text
    assert "@" not in clean and clean.count("[EMAIL]") == n == clean.count("[IP]")


def test_sanitised_texts(spark):
    rows = [(i, f"Zanthor: write a{i % 2}@b.org now, or +49 30 1234567 ü 10.0.0.1", "en", "s") for i in range(6)]
    rows += [(10 + i, "filler words of no harm at all " * 40, "en", "s") for i in range(25)] + [(50 + i, "other words stand here too, write now " * 400, "en", "s") for i in range(10)] + [(40, None, None, None), (41, "", "en", "s"), (42, "plain write now", "en", "s")]
    found = {r.doc_id: r for r in pii.personal_data(frame(spark, rows), with_text=True).collect()}
    texts = {r.doc_id: r.text for r in pii.sanitised(frame(spark, rows)).collect()}
    assert len(texts) == len(rows) and texts[40] == texts[41] == "" and texts[42] == "plain write now" and texts[10] == rows[6][1]
    for i, t, _, _ in rows:
        want, at = "", 0
        for s in found[i].spans:
            if s.end > at:
                want += t[at : max(s.start, at)] + pii.STANDS_FOR[s.kind]
                at = s.end
        assert texts[i] == want + (t or "")[at:]
    assert "@" not in texts[0] and "[EMAIL]" in texts[0] and "[IP]" in texts[0] and "[PHONE]" in texts[0] and "Zanthor" not in texts[0]


def test_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    v = [(int(i), (centres[i % 30] + r.normal(scale=0.12, size=16)).tolist()) for i in range(900)]
    v += [(1000 + k, v[0][1]) for k in range(50)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [float("inf")] * 16)]
    table = spark.createDataFrame([(i, x, 1, "clash") for i, x in v], "vec_id long, embedding array<double>, label int, rep string")
    found = {x.vec_id: x for x in rpforest.near_duplicates(table, leaf=32, block=64).collect()}
    ok = [(i, np.array(x)) for i, x in v if x and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]
    m = np.array([x for _, x in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = (m @ m.T >= 0.95).sum(axis=1) - 1
    have = np.array([found[i].n_links for i, _ in ok])
    assert (have <= links).all() and have.sum() >= 0.97 * links.sum()
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006))
    assert all(found[1000 + k].component_id == 0 for k in range(50))
    assert rpforest.near_duplicates(table.where("false")).count() == 0


def test_vectors_under_one_id(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (3, [1.0, 0.01, 0.0]), (4, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    found = sorted((x.vec_id, x.n_links, x.component_id) for x in rpforest.near_duplicates(table).collect())
    assert [x[:1] + x[2:] for x in found] == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_links_between_parts_of_two_blocks():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = 40
        m = np.triu(r.random((n, n)) < 0.03, 1)
        m |= m.T
        side = np.arange(n) % 2
        within = m & (side[:, None] == side)
        i, j = np.nonzero(np.triu(m & ~within))
        part = rpforest.parts_of(within)
        if len(i):
            a, b = rpforest.between(part, i, j)
            fewer = within.copy()
            fewer[a, b] = fewer[b, a] = True
            want = rpforest.parts_of(m)
            assert (rpforest.parts_of(fewer) == want).all() and len(a) <= len(i)


def test_vectors_in_one_dense_group(spark):
    # a third of the vectors, all different, at a cosine of about 0.96 with each other; each cut parts many of them
    r = np.random.default_rng(5)
    noise = rpforest.unit(r.normal(size=(800, 64)))
    v = rpforest.unit(np.concatenate([np.sqrt(0.96) * rpforest.unit(r.normal(size=(1, 64))) + np.sqrt(0.04) * noise, r.normal(size=(1600, 64))]))
    want = (v @ v.T >= 0.95).sum(axis=1) - 1
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {x.vec_id: x for x in rpforest.near_duplicates(table, leaf=8, block=64).collect()}
    have = np.array([found[i].n_links for i in range(len(v))])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum() > 500_000
    assert {found[i].component_id for i in range(800)} == {0}


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rel = duck(sf).sql(ORACLE_SQL[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    want = sorted(tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
