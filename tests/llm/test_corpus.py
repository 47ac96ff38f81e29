"""Corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from check_queries import compare, entry, oracle
from pyspark.sql import functions as F

from fleetlens.llm import (
    components, curriculum, decontaminate, jaccard, language, lines, quality, queries, sketch, tokens, toxicity, urls)

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
VOCAB = [f"w{i}" for i in range(60)]
CLASH = "id bigint, hash bigint, n int, h int, g int, item int, range int, sig bigint, host string, label int, position int, key string"


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def documents(spark, rows, clash=True):
    """Rows (doc_id, text, source) with further columns whose names the operators use themselves."""
    df = spark.createDataFrame([(*r, None, None)[:3] for r in rows], "doc_id bigint, text string, source string")
    if clash:
        for c in CLASH.split(", "):
            df = df.withColumn(c.split()[0], F.lit(7).cast(c.split()[1]))
    return df


def odd_rows(rng):
    long = words(rng, 30_000)
    return [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one two", "b"), (4, "one two", "b"), (4, "other text here", "b"),
            (None, "nobody knows who wrote these five or six words", "a"), (None, None, None), (5, long, "c"), (6, long, "c"),
            (7, "É È ÄÖ 東京 🙂 " * 5, "é")]


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE)))
def test_sql(spark, name):
    assert compare(spark, oracle(SF), SF, name)[0] == "ok"


def test_registered():
    assert set(queries.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


# Benchmark decontamination

def brute_hits(docs, items):
    find = lambda t: re.findall(decontaminate.WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = []
    for doc, text in docs:
        w, hit, met = find(text), set(), set()
        for item, t in items:
            v = find(t)
            n = min(13, len(v))
            marks = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in marks:
                    hit |= set(range(i, i + n))
                    met.add("" if item is None else str(item))
        names = ",".join(sorted(met))
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, words(rng, n)) for i, n in enumerate([1, 3, 5, 6, 7, 12, 13, 14, 40, 90])]
    items += [(20, items[8][1]), (21, items[8][1]), (22, None), (23, ""), (24, "?!"), (None, words(rng, 20)), (25, items[9][1] + " " + items[9][1])]
    docs = [r[:2] for r in odd_rows(rng)]
    for i in range(60):
        it = rng.choice(items)[1] or ""
        v = it.split()
        a = rng.randrange(max(len(v), 1))
        docs.append((100 + i, ", ".join([words(rng, rng.randrange(80)), " ".join(v[a:a + rng.randrange(30)]), words(rng, 5), it.upper() if i % 3 else ""])))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hash", F.lit(1)).withColumn("doc_id", F.lit(2))
    got = decontaminate.decontaminate(documents(spark, docs), bench)
    cols = ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(map(tuple, got.select(cols).collect())) == brute_hits(docs, items)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark, [(1, "a b c"), (2, None)])
    assert [r.contaminated for r in decontaminate.decontaminate(docs, none).collect()] == [False, False]
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def test_words_are_split_and_winnowed_without_slices(spark):
    """Texts are split, not searched for all matches, and no window is copied; words and kept grams are as by brute force."""
    rng = random.Random(9)
    texts = ["", None, "?!", " a", "a ", "\x00A\x7fb", "ÀÉ x_Y", "ẞ-İ 12.5", "漢字, 😀z", words(rng, 12), words(rng, 13), words(rng, 300), "la " * 60]
    find = lambda t: re.findall(decontaminate.WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows.select("id", decontaminate.words_of(F.col("text")).alias("w"))
    assert {r.id: r.w for r in got.collect()} == {i: find(t) for i, t in enumerate(texts)}
    hashed = rows.select("text", decontaminate.word_hashes(F.col("text")).alias("h"))
    for n in (1, 5, 6, 7, 9, 13):
        gram = min(6, n)
        width = n - gram + 1
        grams = F.transform(F.sequence(F.lit(1), F.size("h") - gram + 1), lambda i: F.xxhash64(F.lit(n), F.slice("h", i, gram)))
        kept = decontaminate.winnowed(hashed, n, "kept")
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "slice(" not in plan and "regexp_extract_all(" not in plan
        for r in kept.select("kept", F.when(F.size("h") >= n, grams).alias("g")).collect():
            g = r.g or []
            want = {p for a in range(len(g) - width + 1) for p in range(a, a + width) if g[p] == min(g[a:a + width])}
            assert [tuple(k) for k in r.kept] == [(g[p], p) for p in sorted(want)]


# URL filters

def test_url_ranks_against_brute_force(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.example.{t}" for i in range(8) for t in ("org", "net", "com")]
    pages = []
    for i in range(150):
        h = rng.choice(hosts)
        links = "".join(f'<a class=x HREF="{rng.choice(["https:", ""])}//{rng.choice(hosts).upper()}/p?q">x</a>' for _ in range(rng.randrange(4)))
        pages.append((i, f"https://{h}/{rng.choice(['en', 'de', 'fr'])}/{i}?u=http://z.net/", f"<html>{links}<a href='/own'>o</a>"))
    pages += [(900, None, None), (901, "no scheme", "x"), (902, "HTTP://EXAMPLE.NET", None), (903, "://net/", ""), (904, "ftp://xexample.com/de/", ""), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("trust", F.lit(1))
    got = urls.filter_urls(df).collect()

    def judge(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1:] if fits else (None, None)
    facts = [(p, *judge(u), html) for p, u, html in pages]
    own, edges = defaultdict(list), set()
    for _, host, _, (_, v), html in facts:
        if host:
            own[host].append(v)
            edges |= {(host, d.lower()) for d in re.findall(r'HREF="(?:https:)?//([^/?#"]+)', html or "") if d.lower() != host}
    rank = {}
    for kind, verdict, hops in (("trust", "allow", edges), ("distrust", "block", {(b, a) for a, b in edges})):
        start = {h: (v.count(verdict) * urls.UNIT // len(v)) * 15 // 100 for h, v in own.items()}
        out, r = Counter(a for a, _ in edges), dict(start)
        for _ in range(urls.ROUNDS):
            new = Counter(start)
            for a, b in hops:
                new[b] += r.get(a, 0) * 85 // (100 * out[a if kind == "trust" else b])
            r = new
        rank[kind] = r
    want = []
    for p, host, path, (rule, v), _ in facts:
        t, d = rank["trust"].get(host, 0), rank["distrust"].get(host, 0)
        want.append((p, host, path, rule, v or ("block" if d >= urls.THRESHOLD and d > t else "allow"), t, d))
    assert Counter(map(tuple, got)) == Counter(want)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    assert urls.filter_urls(df.limit(0)).count() == 0


# N-gram Jaccard join

def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                head[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(3)
    rows = [r[:2] for r in odd_rows(rng)]
    for base in range(12):
        text = words(rng, rng.choice([6, 9, 20, 60, 200])).split()
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(text) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    passage = words(rng, 50)  # texts made of few shared passages
    rows += [(2000 + i, passage + " " + words(rng, i)) for i in range(40)]
    got = jaccard.join_texts(documents(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_jaccard_join_without_leaders(spark, monkeypatch):
    """The prefix join alone finds every link."""
    rng = random.Random(4)
    rows = []
    for base in range(6):
        text = words(rng, 40).split()
        for _ in range(8):
            copy = list(text)
            copy[rng.randrange(40)] = rng.choice(VOCAB)
            rows.append((len(rows), " ".join(copy)))
    real, calls = jaccard.verify, []

    def verify(pairs, sets):
        calls.append(1)
        return real(pairs.limit(0) if len(calls) == 1 else pairs, sets)
    monkeypatch.setattr(jaccard, "verify", verify)
    assert Counter(map(tuple, jaccard.join_texts(documents(spark, rows)).collect())) == brute_groups(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard.join_texts(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (3, 2), (200, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


# Document fingerprints

def test_sketch_difference_against_sets(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(60):
        n, m, both = rng.choice([0, 1, 5, 40]), rng.choice([0, 1, 5, 150]), rng.choice([0, 3, 60])
        k = [rng.getrandbits(63) for _ in range(n + m + both)]
        pairs.append((k[:n + both], k[n:]))
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    got = df.select(sketch.differing(F.col("a"), F.col("b")).alias("d"), "a", "b").collect()
    assert [r.d for r in got] == [len(set(r.a) ^ set(r.b)) for r in got]


def test_sketch_that_does_not_peel_is_left_to_the_next(spark):
    df = spark.createDataFrame([(list(range(1, 40)),)], "a array<bigint>").withColumn("e", F.transform("a", lambda k: sketch._placed(k, F.lit(1), 12)))
    assert df.select(sketch.peel(sketch.sketch(F.col("e"), 12), 12)).first()[0] is None


def test_fingerprints(spark):
    rng = random.Random(6)
    rows = [r[:2] for r in odd_rows(rng) if r[0] is not None] + [(50 + i, "\n".join(words(rng, 12) for _ in range(rng.randrange(9)))) for i in range(60)] + [(500, "x y")]
    rows = [r for i, r in enumerate(rows) if r not in rows[:i]]
    got = sketch.fingerprints(documents(spark, rows)).collect()
    texts = sorted(((i, t or "") for i, t in rows), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(texts):
        n, h = texts[(k + 1) % len(texts)][1], len(t) // 2
        want[(i, len(t), hashlib.sha256((t[:len(t) - h] + n[:h]).encode()).hexdigest())] += 1
    assert Counter((r.id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.id: r.fingerprint for r in got}
    assert prints[5] == prints[6] and prints[1] == prints[2] != prints[5]
    assert {r.near_next for r in got if r.id == 6} == {1.0}


@pytest.mark.parametrize("rows", [[(1, "only one text")], [(None, "a"), (None, None), (2, "b"), (2, "b")]])
def test_fingerprints_of_few(spark, rows):
    assert sketch.fingerprints(documents(spark, rows)).count() == len(rows)
    assert sketch.fingerprints(documents(spark, rows).limit(0)).count() == 0


# Token files

def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    extra = ["a\x01b <|endoftext|>. x<|startoftext|>y", "ǅ İstanbul ΟΔΟΣ ́ x", "it's, WE'LL!! don't. 's a'.b c d\x1ce", "x̸ ≠ 9's THE.'S", "ŉ ß ﬁ é é", "a b c\u0085d"]
    rows = odd_rows(rng) + [(100 + i, t, None) for i, t in enumerate(extra)] + [(200 + i, words(rng, rng.randrange(50)), None) for i in range(50)]
    path = tokens.write_tokens(documents(spark, rows), queries.tokenizer_path(), str(tmp_path / "t"))
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    coder = Tokenizer.from_file(queries.tokenizer_path())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (doc, text, _) in zip(got, order, strict=True):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (doc, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert tokens.read_document(spark, path, 7) == next(list(r.ids) for r in got if r.doc_id == 7)
    assert tokens.read_document(spark, path, 12345) is None


def test_variants_of_a_word_share_an_entry():
    import pyarrow as pa

    coder = tokens.Encoder(queries.tokenizer_path())
    texts = ["Été, été. ÉTÉ! été", None, "", " The\tTHE,\nthe. ", "a1. <|endoftext|>", "ΟΔΟΣ!"]
    got = coder.encode(pa.array(texts))
    assert [ids.tolist() for ids in got] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert set(coder) == {"", "été", ",", ".", "!", "the", "a1.", "<|endoftext|>", "ΟΔΟΣ!"}


def test_token_files_of_nothing(spark):
    path = tokens.write_tokens(documents(spark, [(1, "a")]).limit(0), queries.tokenizer_path())
    assert tokens.read_tokens(spark, path).count() == 0


def test_workers_that_encode_nothing_hold_no_words(monkeypatch):
    class Task:
        get = partitionId = staticmethod(lambda: Task)

    path = queries.tokenizer_path()
    monkeypatch.setattr(tokens, "TaskContext", Task)
    for stage in (tokens._shards, tokens._decode(False)):
        assert len(tokens.encoder(path).encode(pa.array(["some words"]))) == 1 and tokens._ENCODERS
        assert list(stage(iter([]))) == [] and not tokens._ENCODERS


def test_token_files_are_made_of_short_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 1_000)

    def count(batches):
        for n, batch in enumerate(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for f, v in zip(kinds, [0, n, *[None] * 8], strict=True)], kinds.names)

    kinds = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") and "bigint" not in c else pa.list_(pa.int64()) if "array" in c else
                        pa.int64() if "bigint" in c else pa.binary()) for c in tokens.SHARDS.split(", ")])
    monkeypatch.setattr(tokens, "_encode", lambda path: count)
    monkeypatch.setattr(tokens, "_shards", count)
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    docs = documents(spark, [(1, "x" * 500)] * 100, clash=False).coalesce(1)
    rows = docs.select("doc_id", F.lit(0).alias("text_key"), F.col("text").cast("binary").alias("ids"), F.lit(0).alias("place"))
    for path in (tokens.write_tokens(docs, "", str(tmp_path / "t")), tokens.write_encoded(rows, "place", str(tmp_path / "e"))):
        assert spark.read.schema(tokens.SHARDS).parquet(path).agg(F.max("shard")).first()[0] >= 10
    assert spark.conf.get(conf) == before


def test_a_grammar_takes_few_bytes_an_id():
    import tracemalloc

    import numpy as np

    from fleetlens.llm import repair

    ids = np.random.default_rng(1).zipf(1.3, 400_000).clip(max=40_000).astype(np.uint32)
    tracemalloc.start()
    try:
        repair.compress(ids, np.full(400, 1_000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak <= 54 * len(ids)


@pytest.mark.parametrize("ids", [[], [5], [3, 3, 3, 3, 3] * 200, [1, 2] * 500, list(range(70_000)) * 2, [9] * 3 + [70_000, 1] * 200])
def test_grammar_round_trip(ids):
    import numpy as np

    from fleetlens.llm import repair

    lengths = np.array([0, len(ids) // 3, 0, len(ids) - len(ids) // 3], np.int64)
    symbols, packed, rules, first = repair.compress(np.array(ids, np.uint32), lengths)
    assert repair.Grammar(rules, first).expand(symbols).tolist() == ids and packed.sum() == len(symbols)


def test_no_pair_that_pays_is_left_without_a_rule():
    import numpy as np

    from fleetlens.llm import repair

    rng = np.random.default_rng(5)
    common = rng.integers(0, 4000, (3000, 2))
    ids = np.concatenate([common[i] for i in rng.integers(0, len(common), 30_000)] + [np.full(999, 7), np.tile([1, 1, 2], 50)]).astype(np.uint32)
    lengths = np.full(len(ids) // 10, 10, np.int64)
    lengths[-1] += len(ids) % 10
    symbols, packed, rules, first = repair.compress(ids, lengths)
    assert repair.Grammar(rules, first).expand(symbols).tolist() == ids.tolist()
    docs, counts = np.split(symbols, np.cumsum(packed)[:-1]), Counter()
    for doc in docs:
        last = None
        for i, pair in enumerate(zip(doc.tolist(), doc[1:].tolist(), strict=False)):
            if pair == last and pair[0] == pair[1]:
                last = None  # overlaps the pair before
                continue
            counts[pair] += 1
            last = pair
    assert max(counts.values()) < 5 and len(rules) > 384


# Line dedup

def brute_lines(rows):
    places, removed = {}, defaultdict(set)
    order = sorted(rows, key=lambda r: r[0])
    runs = []
    for doc, text in order:
        full = [(i, x.strip()) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += len(full[b][1].split())
                if n >= lines.LEAST_WORDS:
                    runs.append((doc, a, b, full))
                    if n - len(full[b][1].split()) >= lines.LEAST_WORDS + 30:
                        break
    for doc, a, b, full in runs:
        places.setdefault(tuple(x for _, x in full[a:b + 1]), (doc, full[b][0]))
    for doc, a, b, full in runs:
        first = places[tuple(x for _, x in full[a:b + 1])]
        if first[0] != doc or full[a][0] > first[1]:
            removed[doc] |= {i for d, (i, _) in enumerate(full) if a <= d <= b}
    return {doc: removed[doc] for doc, _ in rows}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    passages = [[words(rng, rng.choice([4, 15, 30, 60])) for _ in range(rng.randrange(1, 6))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "x\n\n")]
    for i in range(60):
        parts = [[words(rng, rng.randrange(1, 20))] for _ in range(3)] + [rng.choice(passages) for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        rows.append((10 + i, "\n".join([x for p in parts for x in p] + ["", " tail "])))
    got = lines.dedup_lines(documents(spark, rows)).collect()
    want = brute_lines(rows)
    text = dict(rows)
    assert any(want.values())
    for r in got:
        assert want[r.doc_id] <= set(r._removed), r.doc_id
        assert r._lines == (0 if text[r.doc_id] is None else text[r.doc_id].count("\n") + 1)
        kept = None if text[r.doc_id] is None else "\n".join(x for i, x in enumerate(text[r.doc_id].split("\n")) if i not in r._removed)
        assert r._kept_text == kept
        extra = {i for i in r._removed if text[r.doc_id].split("\n")[i].strip()} - want[r.doc_id]
        assert not extra


def test_line_dedup_cases(spark):
    line = " ".join(map(str, range(60)))
    rows = [(5, line), (5, line), (None, line), (4, f"a\n{line}\nb"), (9, f"{line}\n{line}"), (1, None)]
    got = lines.dedup_lines(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r._kept_text) for r in got) == Counter([(5, ""), (5, ""), (None, ""), (4, f"a\n{line}\nb"), (9, ""), (1, None)])
    assert lines.dedup_lines(documents(spark, rows).limit(0)).count() == 0


# Curriculum

@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1000], [100, 1, 5, 1, 900], [0, 10], [7], [0]])
def test_targets_against_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size bigint")
    got = {r.source: r.target for r in curriculum.targets(df).collect()}
    names = [f"s{i}" for i in range(1, len(sizes))] + [None]
    size = dict(zip([None, *names[:-1]], sizes, strict=True))
    weight = {s: curriculum.WEIGHTS[k % 3] for k, s in enumerate(names)}
    full, left = {}, 1.5 * sum(sizes)
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            full[s] = 2 * size[s]
        left = 1.5 * sum(sizes) - sum(full.values())
    assert got == pytest.approx({**full, **share})


def test_mix(spark):
    rng = random.Random(9)
    rows = odd_rows(rng)[:8] + [(100 + i, words(rng, rng.randrange(1, 30)), rng.choice(["a", "b", None, "é"])) for i in range(300)]
    docs = documents(spark, rows)
    plan = curriculum.assign(docs).collect()
    assert len(plan) == len(rows)
    by = defaultdict(int)
    for r in plan:
        assert len(r.positions) <= 2 and all(0 <= p <= 1 for p in r.positions)
        by[(r.source, r.source_size, r.target)] += r.size * len(r.positions)
    for (_, size, target), taken in by.items():
        assert abs(taken - target) <= 30 and target <= 2 * size
    mixed = curriculum.mix(docs)
    at = [r._position for r in mixed.collect()]
    assert at == sorted(at) and len(at) == sum(len(r.positions) for r in plan)
    assert mixed.columns[:-1] == docs.columns
    again = curriculum.assign(docs.repartition(7)).collect()
    assert Counter(map(str, plan)) == Counter(map(str, again))
    assert curriculum.mix(docs.limit(0)).count() == 0


def test_demand_time_inverts_the_integral(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("c"))
    for slope in (-1.0, -0.5, 0.0, 0.5, 1.0):
        for r in df.select("c", curriculum.demand_time(F.col("c"), F.lit(slope)).alias("t")).collect():
            assert r.t + slope * (r.t * r.t - r.t) == pytest.approx(r.c)


# Classifiers

def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").select("_held_out", "_good", "_score", "quality").collect()
    held = [r for r in rows if r._held_out]
    right = sum((r._score >= 0.7) == bool(r.quality) for r in held)
    assert len(held) > 300 and right >= 0.97 * len(held)


def test_quality_cases(spark):
    rows = odd_rows(random.Random(10))
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels = labels.withColumn("text", F.lit("clash"))
    for df in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.classify(documents(spark, rows), df)
        assert got.count() == len(rows) and got.where("_score is null or _score < 0 or _score > 1").count() == 0
        rated = toxicity.rate(documents(spark, rows), df)
        assert rated.count() == len(rows) and rated.where("_severity is null or _toxic is null").count() == 0
    assert quality.classify(documents(spark, rows).limit(0), labels).count() == 0


def test_held_out(spark):
    got = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in got]


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.rate(docs, labels).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    toxic = [r for r in held if r.toxic]
    assert sum(r._toxic for r in toxic) >= 0.85 * len(toxic)
    assert sum(r._toxic for r in held if not r.toxic) <= 0.01 * len(held)
    assert all(0 <= r._severity <= 3 and 0 <= r._grade <= 3 for r in held)


def test_thresholds_are_ordered():
    import numpy as np

    used = [np.array(x) for x in ([1, 2], [1, 2, 3], [4], [4, 5], [2, 4])] * 10
    weight, t = toxicity.fit(np.array([1, 1, 0, 0, 0] * 10), used)
    assert (np.diff(t) >= 0).all() and weight[1] > 0 >= weight[4]


def test_language(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    model = language.train(docs)
    got = language.document_languages(docs, model).join(docs, F.col("id") == F.col("doc_id")).select(docs.lang.alias("want"), docs.text, F.col("probability")).count()
    rows = language.document_languages(docs, model).withColumnRenamed("lang", "found").join(docs, F.col("id") == F.col("doc_id")).collect()
    assert got == len(rows) == docs.count() and sum(r.found == r.lang for r in rows) >= 0.99 * len(rows)
    assert language.page_languages(pages, model).count() == pages.count()


def test_language_cases(spark):
    rows = odd_rows(random.Random(11))
    docs = documents(spark, rows)
    model = (["de", "en"], __import__("numpy").zeros((2, 1 << language.BITS), "float32"))
    got = language.document_languages(docs, model).collect()
    assert len(got) == len(rows) and all(r.lang in ("de", "en") and 0 < r.probability <= 1 for r in got)
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.de/x", '<html lang="DE-at"><b>x</b>'), (2, "http://a.de/x", '<html lang="DE-at"><b>x</b>')],
                                  "page_id bigint, url string, html string").withColumn("near", F.lit(1)).withColumn("host", F.lit("h"))
    assert language.page_languages(pages, model).count() == 3
    assert language.page_languages(pages.limit(0), model).count() == 0
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert [r.lang for r in language.page_languages(pages, nothing).collect()] == [None] * 3
    assert pages.select(language.declared_language(F.col("html"))).collect()[1][0] == "de"


def test_text_parts():
    from fleetlens.llm import subwords

    texts = pa.array(["a" * 3_000_000, None, "b", "c" * 3_000_000])
    assert [(k, len(p)) for k, p in subwords.parts(texts)][0][0] == 0
    assert sum(len(p) for _, p in subwords.parts(texts)) == 4


# Pipeline

def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination",
                                                       "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    steps = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SMALL).cache())
        assert steps[-1].columns == columns
    rows = [s.collect() for s in steps]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows[1]}
    assert not [i for i, q in labels.items() if q == 1 and i not in kept and not zlib.crc32(str(i).encode()) % 4 == 2]
    groups = brute_groups([(r.doc_id, r.text) for r in rows[1]])
    assert {r.doc_id for r in rows[2]} == {i for i, n, c in groups if n == 0 or i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in rows[2]], items)
    assert {r.doc_id for r in rows[3]} == {h[0] for h in hits if not h[5]}
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]}
    out = corpus_pipeline.to_tokens(spark, steps[-1], SMALL).collect()
    assert len(out) == len(rows[4])


def repeated_rows():
    """Copies in repeated rows, with null ids, and with an id that a unique document has too."""
    rng = random.Random(12)
    same, named, shared, other, lone = [words(rng, 40) for _ in range(5)]
    rows = [(10, same, "a")] * 3 + [(None, named, "a"), (None, named, "a"), (11, named, "b")]
    rows += [(1, shared, "a"), (5, shared, "a"), (5, other, "b"), (5, lone, None), (None, "", "a"), (None, None, "a"), (12, "", "b"), (12, "", "b")]
    nameless = words(rng, 40)
    return rows + [(None, nameless, "b"), (None, nameless, "b"), (None, words(rng, 40), "b")]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    rows = repeated_rows()
    docs = documents(spark, rows)
    got = corpus_pipeline.keep_one_of_alike(spark, docs, SMALL)
    assert got.columns == docs.columns
    wordless = [r for r in rows if not r[1]]
    same, named, shared, other, lone = rows[0], (11, *rows[3][1:2], "b"), rows[6], rows[8], rows[9]
    want = wordless + [same, named, shared, other, lone, rows[-3], rows[-1]]
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter(want)
    sides = spark.createDataFrame([(1, "some words here", "b"), (1, "some words here", "a")], "doc_id bigint, text string, source string")
    assert [r.source for r in corpus_pipeline.keep_one_of_alike(spark, sides, SMALL).collect()] == \
        [r.source for r in corpus_pipeline.keep_one_of_alike(spark, sides.orderBy("source"), SMALL).collect()]


def test_pipeline_stages_on_repeated_rows(spark):
    """Every other stage judges each row by its own text, whatever its id."""
    import corpus_pipeline

    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len(r.text.split()) > 20][0]
    rows = repeated_rows() + [(5, bench, "a"), (None, bench, "a"), (5, bench, "a")]
    docs = documents(spark, rows).drop("source").withColumn("source", F.lit("a"))
    bag = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    want = Counter(r[:2] for r in rows)
    good = bag(corpus_pipeline.keep_good(spark, docs, SMALL))
    judged = {}
    for (doc, text), n in want.items():
        assert good[(doc, text)] in (0, n)
        assert judged.setdefault(text, good[(doc, text)] > 0) == (good[(doc, text)] > 0)
    assert bag(corpus_pipeline.drop_contaminated(spark, docs, SMALL)) == Counter(r[:2] for r in rows if r[1] != bench)
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL).cache()
    plan = curriculum.assign(docs).collect()
    assert mixed.count() == sum(len(r.positions) for r in plan) and set(bag(mixed)) <= set(want)
    assert Counter(r.doc_id for r in corpus_pipeline.to_tokens(spark, mixed, SMALL).collect()) == Counter(r.doc_id for r in mixed.collect())


def test_pipeline_writes_tokens_in_the_order_of_the_mix(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, repeated_rows() + [(100 + i, words(random.Random(i), 1 + i % 25), "abc"[i % 3]) for i in range(300)], clash=False)
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    mixed.repartition(5, "text").write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.to_tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), SMALL).orderBy("start").collect()
    want = [(r._position, r.doc_id is not None, r.doc_id or 0) for r in curriculum.mix(docs).collect()]
    assert [r.doc_id for r in got] == [i if named else None for _, named, i in sorted(want)]
    assert [r.doc_id for r in got] != sorted([r.doc_id for r in got], key=lambda i: (i is not None, i or 0))


def test_order_follows_the_schedules(spark, monkeypatch):
    ranks = lambda: [r.doc_id for r in queries.QUERIES["op10_curriculum_order"](spark, SMALL).collect()]
    rows = queries.QUERIES["op10_curriculum_order"](spark, SMALL).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    plan = curriculum.assign(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert Counter((r.doc_id, r.position) for r in rows) == Counter((r.id, p) for r in plan for p in r.positions)
    before = ranks()
    monkeypatch.setattr(curriculum, "SLOPES", (0.5, 0.0, -0.5))
    assert ranks() != before and sorted(ranks()) == sorted(before)


MORE_CLASH = ["_key", "_score", "_good", "_gone", "_label", "_total", "_severity", "_id", "_removed", "_repeated", "text_key", "copies",
              "component_id", "size", "positions", "first", "row"]


def test_no_column_name_gets_in_the_way(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.select("*", *[F.lit(-5.0).alias(c) for c in MORE_CLASH])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, named = stage(spark, docs, SMALL), stage(spark, more, SMALL)
        assert named.columns == more.columns
        rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        assert rows(named) == rows(plain)
        assert named.where(" or ".join(f"`{c}` is null or `{c}` <> -5.0" for c in MORE_CLASH)).count() == 0
        docs, more = plain, named
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs, more = docs.limit(40), more.limit(40)
    for made in (toxicity.rate(more, labels), quality.classify(more, labels), lines.dedup_lines(more)):
        assert made.count() == 40 and made.where("_key <> -5.0 or _total <> -5.0 or _id <> -5.0").count() == 0


def test_every_stage_takes_an_empty_table(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0, name
