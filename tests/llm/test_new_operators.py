"""Lexical search, fill-in-the-middle and SimHash against brute force and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_corpus import documents, odd_rows, words

from fleetlens.llm import infill, lexical, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Lexical search

def brute_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(find(t))) for i, t in docs if find(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + 90 * c.total() * n_docs // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(find(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    docs = [r[:2] for r in odd_rows(rng)] + [(None, "only w1 and w2"), (None, "only w1 and w2"), (-3, "W1, W2; É-é 東京x")]
    docs += [(100 + i, words(rng, rng.randrange(1, 60)) + f" rare{i // 3} " * (i % 4)) for i in range(300)]
    docs += [(1000 + i, "the same text of w3 w4 and rare5") for i in range(40)]
    items = [(i, words(rng, 12) + f" rare{i}") for i in range(25)]
    items += [(90, None), (91, ""), (92, "?!"), (93, "unheard of"), (None, "w5 rare9"), (1, items[1][1]), (94, "the same É"), (95, "é É é Rare7")]
    queries = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1)).withColumn("terms", F.lit("x"))
    for points, terms in ((1_000_000, 1_000_000), (500, 30)):
        monkeypatch.setattr(lexical, "PASS_TERMS", terms)
        index = lexical.build_index(documents(spark, docs).repartition(3), points=points)
        assert points > 500 or spark.read.parquet(index).count() > 10
        got = lexical.search(spark, index, queries)
        assert Counter(map(tuple, got.collect())) == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs, none = documents(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(spark, lexical.build_index(docs), none).count() == 0
    assert lexical.search(spark, lexical.build_index(docs.limit(0)), some).count() == 0
    assert [tuple(r) for r in lexical.search(spark, lexical.build_index(docs), some).select("rank", "doc_id").collect()] == [(1, 1)]


def test_treap_cells_keep_their_maxima():
    rng = np.random.default_rng(5)
    terms, docs = rng.integers(0, 300, 4000).astype(np.uint64), rng.integers(0, 500, 4000)
    at = np.unique(terms.astype(np.int64) * 1000 + docs)
    terms, docs = (at // 1000).astype(np.uint64), at % 1000
    impacts = rng.integers(1, 1_000_000, len(at))
    shard = lexical.Shard.load(lexical.Shard.build(terms, docs, impacts, 500))
    for name in (0, 7, 299):
        row = shard.rows[np.searchsorted(shard.terms, np.uint64(name))]
        rows, cells = np.array([row]), np.array([[row // lexical.BAND]])
        start, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth in range(shard.depth):
            left, right = shard.halved(cells, level, start, rows)
            cells = np.concatenate([left, right])
            start = np.concatenate([start, start + (1 << (shard.depth - depth - 1))])
            level = np.full(len(cells), depth + 1)
            bound = shard.bounds(cells, rows, np.ones(1, np.int64))
            size = 1 << (shard.depth - depth - 1)
            true = [impacts[(terms == name) & (docs >= s) & (docs < s + size)].max(initial=0) for s in start]
            assert (bound >= true).all() and (depth + 1 < max(lexical.BAND_BITS, 1) or (bound == true).all())


# Fill in the middle

def brute_example(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(("7:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle_against_brute_force(spark):
    rng = random.Random(12)
    texts = ["\n", "\n\n\n", "a", "a\n", "a\nb", "É\n東京\r\n🙂", "<P>\nx", "x<M", "<S\n<P\nM>", "a b\x0bc\nd", "<", "<<\nS>"]
    docs = [r[:2] for r in odd_rows(rng)] + [(50 + i, t) for i in range(8) for t in texts]
    docs += [(200 + i, "\n".join(words(rng, rng.randrange(5)) for _ in range(rng.randrange(40)))) for i in range(80)]
    docs += [(999, "long line\n" * 300_000)]
    got = infill.restore(infill.fill_in_middle(documents(spark, docs)))
    assert len(got.columns) == 9
    rows = [(r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got.collect()]
    assert Counter(rows) == Counter(brute_example(*d) for d in docs)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    for r in got.select("output", "output_sha256", "restored", "restored_sha256").collect():
        assert hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256
        assert hashlib.sha256(r.restored.encode()).hexdigest() == r.restored_sha256
    assert infill.restore(infill.fill_in_middle(documents(spark, docs).limit(0))).count() == 0


# SimHash

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rng = random.Random(13)
    docs = [r[:2] for r in odd_rows(rng)] + [(60, "ONE two"), (61, "É one"), (None, "")]
    for i in range(40):
        w = words(rng, rng.randrange(5, 400)).split()
        docs += [(100 + 3 * i, " ".join(w)), (101 + 3 * i, " ".join(w[:-1] + ["Changed"])), (102 + 3 * i, "\n".join(w))]
    got = [tuple(r) for r in simhash.near_duplicates(documents(spark, docs)).select("id", "fingerprint", "component_id").collect()]
    prints = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(prints)
    least = {r: min((i for (i, _), q in zip(docs, roots, strict=True) if q == r and i is not None), default=None) for r in roots}
    assert Counter(got) == Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(docs, prints, roots, strict=True))
    assert simhash.near_duplicates(documents(spark, docs).limit(0)).count() == 0


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = (words(random.Random(3), 3000) + " É\n").encode() * 2
    whole = simhash.fingerprint(text)
    for step in (7, 100, 5000):
        monkeypatch.setattr(simhash, "STEP", step)
        assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


def test_golay_words_share_a_key():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 23, 30_000)
    b = a.copy()
    for _ in range(2):
        b ^= (1 << rng.integers(0, 23, len(b))) * rng.integers(0, 2, len(b))
    keys = []
    for x in (a, b):
        sets = [set() for _ in x]
        for at, key in zip(*(v.tolist() for v in simhash.fuzzy_keys(x)), strict=True):
            sets[at].add(key)
        keys.append(sets)
    assert all(p & q for p, q in zip(*keys, strict=True)) and {len(p) for p in keys[0]} == {1, 6}


@pytest.mark.parametrize("large", [4_096, 0])
def test_simhash_links_are_complete(spark, monkeypatch, large):
    """Fingerprints a few bits off common ones; with ``large`` 0 every key is refined."""
    monkeypatch.setattr(simhash, "LARGE", large)
    if not large:
        monkeypatch.setattr(simhash, "TIMES", 0)
    rng = random.Random(14)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(30):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "bits bigint").repartition(5)
    label = {s: s for s in signed}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in simhash.near_links(df).collect():
        label[top(a)] = top(b)
    mine = [top(s) for s in signed]
    roots = brute_components(prints)
    assert len(set(zip(mine, roots, strict=True))) == len(set(mine)) == len(set(roots))


# Line dedup inside lines

def test_winnowing_keeps_the_least_of_every_window():
    import numpy as np

    from fleetlens.llm import lines

    rng = np.random.default_rng(1)
    counts = np.array([0, 49, 50, 300, 20, 1000])
    hashes = rng.integers(1, 2 ** 63, counts.sum()).astype(np.uint64)
    prints, at = lines.winnow(hashes, counts)
    units, kept = lines._rolled(hashes), set(at.tolist())
    start = 0
    for n in counts.tolist():
        own = set(range(start, start + max(n - lines.LEAST_WORDS + 1, 0)))
        want = {i + int(np.argmin(units[i:i + lines.WINDOW])) for i in own}
        assert want == {p for p in kept if start <= p < start + n}
        start += n
    assert (units[at] == prints).all()


def test_words_are_cut_for_a_whole_batch_at_once(monkeypatch):
    """One pass of hashing per batch of texts, not one per text; rows with and without spans, nulls and sliced arrays."""
    import pyarrow as pa

    from fleetlens.llm import lines

    rng = random.Random(5)
    made = lambda n: [f"é{rng.randrange(900)}" for _ in range(n)]
    passage = made(60)
    other = (lines.word_hashes(pa.array([" ".join(passage)]), fold=False)[0] >> np.uint64(48)).astype("<u2").tobytes()
    rows, want = [], []
    for i in range(40):
        a, b = made(rng.randrange(1, 30)), made(rng.randrange(0, 30))
        text = " ".join(a) + "\t " + "\x0b".join(passage) + "\r\n\n" * (i % 2) + " " + " ".join(b) + " " * (i % 3)
        rows += [(text, [{"low": len(a), "words": other}], []), (None, None, None), (text, [], [0]), ("", [], [])]
        want += [(60, (a + b)), None, (0, b if i % 2 else []), (0, [])]
    kinds = (pa.string(), pa.list_(pa.struct([("low", pa.int32()), ("words", pa.binary())])), pa.list_(pa.int32()))
    arrays = [pa.array([("x", [{"low": 0, "words": other}], [0])[c], *[r[c] for r in rows]], k).slice(1) for c, k in enumerate(kinds)]
    calls, whole = [], lines.word_hashes
    monkeypatch.setattr(lines, "word_hashes", lambda *a, **k: calls.append(1) or whole(*a, **k))
    got = lines._cut_texts(*arrays).to_pylist()
    assert len(calls) == 1
    assert [None if g is None else (g["inside"], g["kept"].split()) for g in got] == want


@pytest.mark.parametrize("hits", [20, 5000])
def test_passages_inside_lines_are_cut(spark, monkeypatch, hits):
    """Against every repeated run of 50 words, found word by word; also with first places dealt over several tasks."""
    import random

    from fleetlens.llm import lines

    monkeypatch.setattr(lines, "HITS", hits)
    rng = random.Random(31)
    made = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [made(n) for n in (51, 55, 61, 80, 200)]
    rows = []
    for i in range(80):
        parts = [made(rng.randrange(5, 60)), rng.choice(passages), made(rng.randrange(0, 40))]
        text = " ".join(parts[0] + parts[1] + parts[2])
        if i % 3 == 0:  # the same words over several lines
            text = "\n".join(" ".join(text.split()[j:j + 17]) for j in range(0, len(text.split()), 17))
        rows.append((i, text))
    rows += [(200, "la " * 3000), (201, "x y z " * 400), (202, " ".join(made(49))), (203, None), (204, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    seen, checked = {}, 0
    for doc, text in rows:
        w = (text or "").split()
        gone = set()
        for a in range(len(w) - lines.LEAST_WORDS + 1):
            first = seen.setdefault(tuple(w[a:a + lines.LEAST_WORDS]), (doc, a))
            if first[0] != doc or a >= first[1] + lines.LEAST_WORDS:
                gone |= set(range(a, a + lines.LEAST_WORDS))
        kept = (got[doc]._kept_text or "").split()
        want = [x for i, x in enumerate(w) if i not in gone]
        if doc < 200:
            # Only chance neighbours and stretches below CUT_WORDS at the ends of lines may differ.
            assert 0 <= len(kept) - len(want) < 2 * lines.CUT_WORDS, doc
            checked += bool(gone)
        else:
            assert abs(len(kept) - len(want)) <= lines.UNIT + lines.LEAST_WORDS, doc
    assert checked > 70 and got[203]._kept_text is None and got[204]._kept_text == "" and got[202]._kept_text == rows[-3][1]
    assert got[200]._cut_words > 2800 and lines.dedup_lines(df.limit(0)).count() == 0


# URL farms and long words

def test_link_farms_are_blocked_whatever_their_size(spark):
    from fleetlens.llm import urls

    page = lambda host, *to: (f"https://{host}/", "".join(f'<a href="https://{h}/">x</a>' for h in to))
    rows = [page("one.net"), page("three.net"), page("many.net"), page("solo.io", "one.net"),
            page("clean.io", "a.io", "b.io", "c.io", "d.io", "one.net"), page("far.io", "clean.io")]
    rows += [page(f"t{i}.io", "three.net") for i in range(3)] + [page(f"m{i}.io", "many.net") for i in range(1000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.host: r for r in urls.filter_urls(df).collect()}
    assert all(r.verdict == "block" for h, r in got.items() if h not in ("clean.io", "far.io"))
    assert got["clean.io"].verdict == got["far.io"].verdict == "allow"
    assert got["solo.io"].distrust == got["t0.io"].distrust == got["m999.io"].distrust > 0


def test_words_of_any_length_are_features():
    import numpy as np
    import pyarrow as pa

    from fleetlens.llm import toxicity

    for n in (10, 64, 65, 10_000):
        owner, slots = toxicity.features(pa.array(["x" * n + "a", "x" * n + "b", "X" * n + "A"]))
        a, b, c = (sorted(slots[owner == i]) for i in range(3))
        assert a != b and a == c
    one = 0
    for c in b"x" * 64 + b"a":
        one = (one * toxicity.BASE + c + 1) % (1 << 64)
    whole = toxicity.subwords.slot(toxicity.mix(np.array([one], np.uint64)))
    assert whole[0] in toxicity.features(pa.array(["x" * 64 + "a"]))[1]
    owner, slots = toxicity.features(pa.array(["東京都" * 5000 + "毒", "毒薬", "東", "", "é"]))
    assert set(slots[owner == 1]) - set(slots[owner == 0]) and len(slots[owner == 0]) == 15_002 and not (owner == 3).any()
