"""Line deduplication, periodic runs and the divergence audit against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import divergence, linededup, periodic
from loomgraph.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t1 string, pos long, slice int, keep string, runs int, rank int, term string, p long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 2, 3, "k", 4, 5, "t", 6) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_periodic_runs", "op13_source_divergence"])
def test_twin(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df, rel = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted(tuple(plain(v) for v in r) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in rel.columns) for r in df.collect()) == want


# Lines


def line_rows():
    r = random.Random(3)
    shared = ["Terms apply.", "  terms APPLY.\t", "Über uns", "über uns", "©", " ", ""]
    out = [(i, "\n".join([f"own {i}", *r.sample(shared, r.randrange(len(shared) + 1)), f"more {i}"] * r.randrange(1, 3)), "en", "s") for i in range(60)]
    out += [(60, None, None, None), (61, "", "en", "s"), (62, "\n\n", "en", "s"), (63, "x" * 50_000 + "\n" + " " * 50_000 + "\nterms apply.", "en", "s"), (64, "\n".join(f"line {i}" for i in range(20_000)) + "\nterms apply. ", "en", "s")]
    return out + [(5, "terms apply.\nrest", "en", "s"), (5, "terms apply.\nrest", "en", "s"), (None, "terms apply.\nnone", "en", "s"), (None, "a\nterms apply.", "en", "s")]


def lowered(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x)


def brute_lines(rows, min_docs, min_chars, keep):
    cut = [[(x, lowered(x.strip(" \t\n\x0b\x0c\r"))) for x in (t or "").split("\n")] for _, t, _, _ in rows]
    n = Counter(k for own in cut for k in {k for _, k in own})
    frequent = {k for k in n if n[k] >= min_docs and len(k) >= min_chars}
    leads = set()
    for k in frequent:
        least = min((i is not None, i if i is not None else 0) for (i, _, _, _), own in zip(rows, cut) if any(y == k for _, y in own))
        leads.add((k, least))
    out = []
    for (i, _, _, _), own in zip(rows, cut):
        kept, seen, dropped = [], set(), 0
        for x, k in own:
            first = (k, (i is not None, i if i is not None else 0)) in leads and k not in seen
            seen.add(k)
            gone = k in frequent and not (keep == "first" and first)
            dropped += gone
            if not gone:
                kept.append(x)
        out.append((i, "\n".join(kept), len(own), dropped))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs,min_chars,slice_", [(10, 1, 512), (10, 1, 4), (2, 0, 3), (1, 1, 512), (100, 1, 512)])
def test_lines(spark, monkeypatch, min_docs, min_chars, slice_):
    monkeypatch.setattr(linededup, "SLICE", slice_)
    rows = line_rows()
    found = linededup.deduplicated(frame(spark, rows), min_docs=min_docs, min_chars=min_chars).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=str) == brute_lines(rows, min_docs, min_chars, "none")


@pytest.mark.parametrize("slice_", [512, 3])
def test_first_lines_stay(spark, monkeypatch, slice_):
    monkeypatch.setattr(linededup, "SLICE", slice_)
    rows = [r for r in line_rows() if r[0] is not None and r[0] != 5]
    docs = frame(spark, rows)
    found = linededup.deduplicated(docs, keep="first").collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=str) == brute_lines(rows, 10, 1, "first")
    assert sum(r.n_first for r in found) == len({k for _, t, _, _ in rows for k in [lowered(x.strip()) for x in (t or "").split("\n")] if k in ("terms apply.", "Über uns", "über uns", "©")})


def test_bitmaps_say_what_stays(spark, empty):
    rows = line_rows()
    docs = frame(spark, rows)
    maps = linededup.keep_bitmaps(docs)
    assert maps.columns == ["doc_id", "t1", "t2", "n_lines", "n_dropped", "n_first", "keep"]
    own = linededup._identified(docs, "doc_id", "text")
    joined = own.join(maps.distinct().withColumnsRenamed({c: f"m_{c}" for c in ("doc_id", "t1", "t2")}), own["doc_id"].eqNullSafe(F.col("m_doc_id")) & (own["t1"] == F.col("m_t1")) & (own["t2"] == F.col("m_t2")))
    texts = joined.select("doc_id", linededup.kept_lines(F.col("text"), F.col("keep")).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in texts), key=str) == [x[:2] for x in brute_lines(rows, 10, 1, "none")]
    runs = {r.doc_id: r for r in maps.where("doc_id >= 60").collect()}
    assert [(x.start, x.length) for x in runs[64].keep] == [(0, 20_001)] and [(x.start, x.length) for x in runs[63].keep] == [(0, 2)]
    assert sum(x.length for x in runs[64].keep) == runs[64].n_lines - runs[64].n_dropped
    assert linededup.keep_bitmaps(empty).count() == 0 and linededup.deduplicated(empty).count() == 0
    with pytest.raises(ValueError):
        linededup.keep_bitmaps(docs, keep="last")


def test_lines_run_no_python(spark):
    plan = linededup.deduplicated(frame(spark, line_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Runs


def brute_runs(w, length, exponent):
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(length, exponent * q, 2 * q) and not any(all(w[x] == w[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def random_words(r, n):
    w = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(n)]
    for _ in range(r.randrange(3)):
        if n > 6:
            p, a, b = r.randrange(1, 7), *sorted(r.sample(range(n + 1), 2))
            w[a:b] = [w[a + (i - a) % p] if a + (i - a) % p < n else w[a] for i in range(a, b)]
    return w


def test_runs_of_trees_equal_brute_force():
    r = random.Random(11)
    for _ in range(400):
        w = random_words(r, r.randrange(45))
        assert periodic.all_runs(w) == brute_runs(w, 2, 2)
        assert periodic.all_runs(w, 6, 4) == brute_runs(w, 6, 4)


@pytest.mark.parametrize("length,exponent", [(6, 4), (6, 2), (12, 3), (5, 5)])
def test_regions_hold_every_run(length, exponent):
    """Texts side by side, so that nothing may cross from one to the next."""
    r = random.Random(7)
    for _ in range(60):
        texts = [random_words(r, r.randrange(60)) for _ in range(6)]
        flat = np.array([w for t in texts for w in t] + [""], dtype=object)[:-1]
        ends = np.cumsum([len(t) for t in texts])
        found = []
        for a, b in periodic.regions(pd.util.hash_array(flat) if len(flat) else np.empty(0, np.uint64), ends, length, exponent):
            found += [(a + s, n, q) for s, n, q in periodic.all_runs(flat[a:b].tolist(), length, exponent)]
        want = [(int(e) - len(t) + s, n, q) for t, e in zip(texts, ends) for s, n, q in brute_runs(t, length, exponent)]
        assert sorted(found) == sorted(want)
    with pytest.raises(ValueError):
        periodic.regions(np.arange(9, dtype=np.uint64), np.array([9]), 3, 2)


def test_agreement_is_the_longest_common_prefix():
    r = random.Random(2)
    for _ in range(30):
        w = [*random_words(r, 30), "end"]
        ids = {x: i + 1 for i, x in enumerate(dict.fromkeys(w))}
        s = [*(ids[x] for x in w), 0]
        suffixes, between = periodic.tour(periodic.suffix_tree(s), len(s))
        assert suffixes == sorted(range(len(s)), key=lambda i: s[i:])
        i, j = np.array([(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]).T
        want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
        assert periodic.Agreement(suffixes, between)(i, j).tolist() == want


def run_rows():
    r = random.Random(4)
    texts = [" ".join(random_words(r, r.randrange(80))) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "Over and over " * 5, "a b " * 9, "x " * 30_000, " ".join(map(str, range(30_000))), " ".join(str(i % 3000) for i in range(14_500)), "A a " * 4]
    return [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (3, texts[3], "en", "s"), (None, "go on go on go on go on", "en", "s")]


def test_periodic_runs(spark, empty):
    rows = run_rows()
    found = periodic.periodic_runs(frame(spark, rows)).withColumn("best", periodic.longest()).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    for i, text, _, _ in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        long = len(w) > 5000
        want = brute_runs(w, 6, 4) if not long else {66: [(0, 30_000, 1)], 67: [], 68: [(0, 14_500, 3000)]}[i]
        gone = {x for s, n, q in want for x in range(s + q, s + n)}
        for r in by_id[i]:
            assert [tuple(x) for x in r.runs] == want and r.n_words == len(w)
            assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
            best = min(((-n, s, q) for s, n, q in want), default=None)
            assert r.best is None if best is None else (r.best.start, r.best.length, r.best.period) == (best[1], -best[0], best[2])
    assert periodic.periodic_runs(empty).count() == 0


def test_query_changes_the_rows_of_its_contract(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["the", "Mill", "über", "x", "y", "z"]) for _ in range(r.randrange(40))) if i % 7 else None, "en", "s") for i in range(300)] + [(None, "a b c", "en", "s")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    for i, text, _, _ in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w, 6, 4)
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        x, sha = found[i], lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (x.n_runs, x.runs_sha256, x.collapsed_sha256) == (len(runs), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(y for k, y in enumerate(w) if k not in gone)))
        assert (x.start, x.length, x.period, x.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)


# Terms


def term_rows():
    r = random.Random(6)
    words = ["mill", "Mill", "über", "a", "river", "stone-age", "l'eau", "naïveté", "seventeen-letters", "x" * 17, "y" * 16, "z" * 8, "w" * 9, "漢字", "é", "Ünïcödé" * 3]
    out = []
    for i in range(200):
        lang = r.choice(["en", "en", "de", None, ""])
        source = r.choice(["s0", "s0", "s1", "s2", None, "é"])
        out.append((i, " ".join(r.choice(words[: 4 + (i % 13)]) for _ in range(r.randrange(30))), lang, source))
    out += [(200, None, "en", "only-null"), (201, "", "fr", "a"), (202, "123 !", "fr", "b"), (203, "v" * 100_000 + " mill " * 5_000, "en", "s1"), (204, "few", "it", "a"), (0, out[0][1], out[0][2], out[0][3]), (None, "mill a", "en", "s1")]
    return out


def brute_audit(rows, min_docs, top):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        g = lang or "", source or ""
        groups.add(g)
        w = [x.decode() for x in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))]
        tf[g].update(w)
        df[g[0]].update(set(w))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in df[lang].items() if n >= min_docs}
        own = sorted(s for x, s in groups if x == lang)
        v, whole = len(kept), Counter()
        for s in own:
            whole.update({t: n for t, n in tf[lang, s].items() if t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}
        q, p = share(whole), {s: share(tf[lang, s]) for s in own}
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            terms = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if tf[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -f, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (f, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top,sources,terms", [(30, 50, 256, 8192), (5, 3, 2, 3), (1, 50, 256, 8192)])
def test_audit(spark, monkeypatch, min_docs, top, sources, terms):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = term_rows()
    found = divergence.audit(frame(spark, rows), min_docs=min_docs, top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, min_docs, top)


def test_audit_of_little(spark, empty):
    assert divergence.audit(empty).count() == 0
    assert [tuple(r) for r in divergence.audit(frame(spark, [(1, None, None, None)])).collect()] == []
    assert sorted(map(tuple, divergence.audit(frame(spark, [(1, "a", "en", "x"), (2, "b", "en", None)])).collect())) == [("en", "", "pair", "x", 0, 1), ("en", "x", "pair", "", 0, 1)]


def test_packed_terms_sort_as_bytes_and_count():
    r = random.Random(8)
    words = ["".join(r.choice("abé漢") for _ in range(n)) for n in (*range(1, 9), 12, 20, 20, 40) for _ in range(3)]
    texts = [" ".join(r.choice(words) for _ in range(50)) for _ in range(20)] + ["", "1 2 3"]
    groups = np.array(sorted(r.randrange(3) for _ in texts))
    found = [(t, g, n, d) for terms, group, tf, df in divergence.counted([t.encode() for t in texts], groups) for t, g, n, d in zip(terms.to_pylist(), group.tolist(), tf.tolist(), df.tolist())]
    tf, df = Counter(), Counter()
    for t, g in zip(texts, groups.tolist()):
        w = re.findall("[^\x00-@]+", t)
        tf.update((x, g) for x in w)
        df.update((x, g) for x in set(w))
    assert sorted(found) == sorted((t, g, n, df[t, g]) for (t, g), n in tf.items())
    order = divergence.radix_order([np.array([3 << 48, 1 << 60, 3 << 48, 5], np.uint64)], 4)
    assert order.tolist() == [3, 0, 2, 1]
