"""The text operators against brute force, exact round trips, edge cases and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import audio, decontam, langid, linededup, packing, passages, quality, queries, simhash, tokens, toxicity
from lumenfold.llm.graph import components
from lumenfold.llm.hashing import prefix_sums, span_hash, xxh64_spans
from lumenfold.llm.textbuf import texts_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, node long"
LONG = " ".join(f"word{i} and" for i in range(30_000))
LINE = "A shared line of more than twenty characters"
ODD = [
    (1, None, None, None, None, "k", 0.5, 1), (2, "", "en", "s", 0, None, None, None), (3, LONG, "en", "s", 9, "k", 1.0, 2), (3, LONG, "en", "s", 9, "k", 1.0, 2),
    (4, f"  {LINE}\t\n12", "de", None, 3, "", 0.0, 4), (5, f"{LINE.upper()}\nx", "de", "s", 3, "", 0.0, 4), (6, f"{LINE}\n{LINE}", None, "s", 3, "", 0.0, 4), (None, f"{LINE}\n", "en", "s", 3, "", 0.0, 4),
    (7, "\n\n \t", "en", "s", 4, "", 0.0, 4), (8, "12 34 !?", "en", "s", 4, "", 0.0, 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_xxh64_and_span_hash():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 5000, dtype=np.uint8)
    start, size = rng.integers(0, 4000, 500), rng.integers(0, 200, 500)
    got = xxh64_spans(buf, start, start + size)
    assert got.tolist() == [xxhash.xxh64_intdigest(buf[a : a + n].tobytes(), 42) for a, n in zip(start, size)]
    twice = np.concatenate([buf[:50], buf[:50]])
    sums = prefix_sums(twice)
    assert span_hash(sums, np.array([3]), np.array([40])) == span_hash(sums, np.array([53]), np.array([90]))


def brute_lines(rows):
    of = {}
    cut = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(cut(line)) >= 20:
                of.setdefault(cut(line), set()).add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(of.get(cut(x), ())) < 3 or max(of[cut(x)]) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [linededup.BOUND, 0])
def test_line_dedup(spark, odd, docs, empty, bound):
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, linededup.digest(linededup.dedup_lines(df, bound=bound)).collect()), key=repr) == brute_lines(rows)
    assert linededup.dedup_lines(empty, bound=bound).count() == 0


def test_line_dedup_sql(docs):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = linededup.digest(linededup.dedup_lines(docs)).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(linededup.ORACLE_SQL).fetchall())


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots_of(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_links(spark, bucket):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains and dense groups of near fingerprints
        x = rng.choice(fps)
        for k in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << k
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, bucket=bucket)).collect()}
    want = roots_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_simhash(odd, empty, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        for r in simhash.simhash_groups(df).join(df.select(F.col("doc_id").alias("d"), "text").distinct(), F.expr("doc_id <=> d")).collect():
            assert r.fp % 2**64 == brute_fingerprint(r.text)
        assert simhash.simhash_groups(df).count() == len(rows)
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(odd).collect()}
    assert groups[1] == groups[2] == groups[7] == 1
    assert simhash.simhash_groups(empty).count() == 0 and simhash.one_of_each(odd).filter("doc_id in (1, 2, 7)").count() == 1


def test_near_groups(spark, odd, empty):
    """Copies edited to a similarity well above 0.8 meet, those well below don't; exact and empty ones are one group."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    rows, near, far = [], [], []
    for i in range(40):
        base = [word() for _ in range(300)]
        for k, edits in enumerate((0, 0, 4, 40)):  # similarities of 1, 1, about 0.87 and 0.3
            copy = list(base)
            for at in range(edits):
                copy[at * 300 // edits if edits else 0] = word()
            rows.append((4 * i + k, " ".join(copy)))
        near += [(4 * i, 4 * i + 1), (4 * i, 4 * i + 2)]
        far.append((4 * i, 4 * i + 3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in simhash.near_groups(df, bucket=16).collect()}
    assert sum(group[a] == group[b] for a, b in near) >= 0.95 * len(near) and not any(group[a] == group[b] for a, b in far)
    lanes = simhash.fingerprints(df, 4, 4).join(simhash.fingerprints(df, 4).withColumnRenamed("fp", "one"), "doc_id").collect()
    assert all(int.from_bytes(r.fp[:8], "little") == r.one % 2**64 for r in lanes)
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(odd).collect()}
    assert groups[1] == groups[2] == groups[7] == 1 and simhash.near_groups(empty).count() == 0


CLASHING = ["_text", "_own_held_out", "own_score", "_gone", "c0", "c1", "own_n_lines", "n_dropped", "a.b", "we`ird", "key", "keep", "text_", "node", "n", "fp", "bits", "lang"]


def test_clashing_names(spark):
    """Columns with names that operators use themselves, dots and backticks are carried or ignored."""
    from lumenfold.llm.textbuf import others
    import corpus_pipeline

    rows = [(i, f"{LINE}\nThis is text number {i} of a small table in English, and the words are " + " ".join(f"{i}x{k}" for k in range(30)), *[f"{i}{n}" for n in CLASHING[:-1]], "en") for i in range(6)]
    names = ["doc_id", "text", *CLASHING]
    df = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    for bound in (linededup.BOUND, 0):
        kept = linededup.dedup_lines(df, carry=others(df), prefix="own2_", bound=bound)
        assert kept.columns == ["doc_id", "own2_n_lines", "own2_n_dropped", "text", *CLASHING]
        assert sorted(tuple(r)[4:] for r in kept.collect()) == sorted(r[2:] for r in rows)
    bench = spark.createDataFrame([(1, "words are 3x0 3x1 3x2 3x3 3x4 3x5")], "item_id long, text string")
    assert decontam.clean(df, bench).columns == names and decontam.clean(df, bench).count() == 5
    assert langid.accepted(df).columns == names and langid.accepted(df).count() == 6
    assert simhash.one_of_each(df).columns == names and simhash.one_of_each(df, simhash.near_groups).count() == 6
    small = spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic long, quality long")
    for count in (simhash.simhash_groups(df), packing.pack(df).select("doc_id").distinct(), tokens.token_counts(df), toxicity.score(df, small), quality.score(df, small), audio.audio(df), decontam.contamination(df, bench), passages.repeated_passages(df)):
        assert count.count() in (0, 1, 6)
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name != "decontaminate":
            assert stage(spark, df, SF).columns == names


def test_least_slack():
    rng = random.Random(2)
    for _ in range(100):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 8))]
        room = rng.randint(0, 60)
        best = max(s for m in range(1 << len(lengths)) if (s := sum(x for i, x in enumerate(lengths) if m >> i & 1)) <= room)
        taken = packing.least_slack({x: lengths.count(x) for x in lengths}, room)
        assert sum(taken) == best and all(taken.count(x) <= lengths.count(x) for x in taken)


def test_packing(odd, empty, docs):
    library = tokens.tokenizer(tokens.vocabulary_path()).library
    for df in (odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        pieces = packing.pack(df).toPandas()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            own = pieces[pieces.doc_id == r.doc_id].sort_values("start")
            assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
            assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
            assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
        by = pieces.sort_values("offset").groupby("sequence_id").length
        assert (by.cumsum() - pieces.sort_values("offset").length == pieces.sort_values("offset").offset).all()
        used = by.sum()
        assert used[used < 1024].map(lambda n: n & (n - 1) == 0).all() and used.max() <= 1024
    assert packing.pack(empty).count() == 0


def test_tokens_like_library(odd, empty):
    compiled = tokens.tokenizer(tokens.vocabulary_path())
    rng = random.Random(3)
    alphabet = "ab 's'll 're't \n\t  !?12éñ 　中👍'\"<|endoftext|>"
    strings = ["", " ", "\n", "a'", "''s", " 's", "<|endoftext|>a", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400))]
    column = texts_of(pa.array(strings))
    ids, off = compiled.ids(column)
    for i, s in enumerate(strings):
        assert ids[off[i] : off[i + 1]].tolist() == compiled.library.encode(s, add_special_tokens=False).ids
    assert compiled.counts(column).tolist() == np.diff(off).tolist()
    small = tokens.Lexicon(compiled._annotate, 64)  # fewer spans than one step has
    compiled.lexicon, kept = small, compiled.lexicon
    assert compiled.counts(column).tolist() == np.diff(off).tolist()
    compiled.lexicon = kept
    rows = tokens.token_counts(odd).collect()
    assert len(rows) == len(ODD) and sorted(r.n_tokens for r in rows)[:2] == [0, 0] and tokens.token_counts(empty).count() == 0


def test_merges_like_library():
    """Spans against the library: words of texts, random ones, long runs; and colliding hashes."""
    compiled = tokens.tokenizer(tokens.vocabulary_path())
    rng = random.Random(4)
    vocabulary = [t for t in compiled.merges.id if len(t) > 1]
    alphabet = tokens._alphabet()
    spans = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    spans += [" " + "".join(rng.choice(["th", "e", "ing", "tion", "a", "s", "un", "er", "re"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    spans += ["a" * 700, " " * 300, "日本語" * 50, "é" * 99, "=" * 513, "ñandú", "\u2028", "abab" * 60]
    ids, off = compiled._annotate([s.encode() for s in spans])
    pieces = dict(zip(alphabet, range(256)))
    for i, span in enumerate(spans):
        got = [bytes(pieces[c] for c in compiled.library.id_to_token(int(x))) for x in ids[off[i] : off[i + 1]]]
        assert b"".join(got) == span.encode()
        if not any(c.isspace() for c in span[1:]):
            assert ids[off[i] : off[i + 1]].tolist() == compiled.library.encode(span, add_special_tokens=False).ids, span
    for one, two in ((rng.choice(vocabulary), rng.choice(vocabulary)) for _ in range(3000)):
        whole = compiled.merges.tokens(one + two)
        assert (whole == [compiled.merges.id[one], compiled.merges.id[two]]) == compiled.merges.follows(one, two)
    lexicon = tokens.Lexicon(compiled._annotate, 64)
    buf = np.frombuffer(b"abcabdabc\0\0\0\0\0\0\0\0", np.uint8)
    start, end = np.array([0, 3, 6]), np.array([3, 6, 9])
    place = lexicon.lookup(np.array([5, 5, 5], np.uint64), lambda i: buf[start[i] : end[i]].tobytes())
    assert lexicon.same(place, buf, start, end).tolist() == [True, False, True]


def test_state_maps_compose():
    """A run of letters and apostrophes gives chunks whose maps don't meet at once."""
    compiled = tokens.tokenizer(tokens.vocabulary_path())
    strings = ["'" * 700, "'re" * 400, "a" * 5000, "'s" * 300 + "!" * 900]
    assert compiled.counts(texts_of(pa.array(strings))).tolist() == [len(compiled.library.encode(s, add_special_tokens=False).ids) for s in strings]


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(100):
        h = rng.integers(0, 25, rng.integers(1, 60)).astype(np.uint64)
        width, n, want = int(rng.integers(2, 9)), len(h), []
        for c in np.flatnonzero(h).tolist():
            lo, hi = c, c
            while lo > 0 and h[lo - 1] > h[c]:
                lo -= 1
            while hi + 1 < n and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= width:
                want.append((lo, c, hi))
        assert sorted(zip(*(x.tolist() for x in passages.compact_windows(h, width)))) == sorted(want)


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, edited = [word() for _ in range(60)], [word() for _ in range(120)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 200))] + shared + [word() for _ in range(rng.randint(0, 200))])) for i in range(30)]
    for i in range(30, 34):
        copy = list(edited)
        copy[60 + i - 30] = word()
        rows.append((i, " ".join([word() for _ in range(50)] + copy)))
    rows += [(i, " ".join(word() for _ in range(300))) for i in range(34, 60)]
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == set(range(34))
    assert {found[i].class_id for i in range(30)} == {0} and {found[i].class_id for i in range(30, 34)} == {30}
    for i in range(30):
        words = rows[i][1].split()
        at = words.index(shared[0])
        assert any(s.start <= at + 5 and s.end >= at + 55 for s in found[i].spans)
    assert passages.repeated_passages(empty).count() == 0 and passages.repeated_passages(odd).count() == 0


def jaccard(x, y):
    x, y = set(x.tolist()), set(y.tolist())
    return len(x & y) / len(x | y)


def test_matched_single_edits():
    """A replaced, added or missing word at every place of passages of 50 to 95 words in other text."""
    width = passages.PASSAGE - passages.SHINGLE + 1
    shingled = lambda words: np.array([hash(tuple(words[i : i + 5])) for i in range(len(words) - 4)], np.int64).view(np.uint64)
    checked = 0
    for n in range(50, 96):
        shared = list(range(n))
        for at in range(n):
            for edited in ([*shared[:at], -1, *shared[at + 1 :]], [*shared[:at], -1, *shared[at:]], shared[:at] + shared[at + 1 :]):
                if len(edited) < passages.PASSAGE or jaccard(shingled(shared), shingled(edited)) < 0.8:
                    continue
                x, y = shingled([*range(1000, 1030), *shared, *range(2000, 2030)]), shingled([*range(3000, 3020), *edited, *range(4000, 4040)])
                found = passages.matched(x, y, width, 0.8)
                assert found and all(e - s >= width and q - p >= width for s, e, p, q in found), (n, at, len(edited))
                checked += 1
    assert checked > 9000


def test_matched_against_all_runs():
    rng, n, width, some = random.Random(9), 18, 7, 0
    for trial in range(300):
        x = list(range(n)) if trial % 2 else [rng.randrange(12) for _ in range(n)]
        y = list(x)
        for _ in range(rng.randint(1, 6)):
            k = rng.randrange(len(y))
            y[k : k + rng.randint(0, 2)] = [100 + rng.randrange(50) for _ in range(rng.randint(0, 2))]
        y = y[:k] + y[k:][:n]
        x, y = np.array(x, np.uint64), np.array(y, np.uint64)
        want = any(jaccard(x[s:e], y[p:q]) >= 0.8 for s in range(n) for e in range(s + width, n + 1) for p in range(len(y)) for q in range(p + width, len(y) + 1))
        found = passages.matched(x, y, width, 0.8)
        if trial % 2 and len(set(y.tolist())) == len(y):
            assert bool(found) == want
            some += want
        assert want or not found
    assert some > 20


def test_matched_equal_runs():
    """An equal run is found whatever shingles stand twice in it and around it."""
    rng, width = np.random.default_rng(1), 12
    for _ in range(2000):
        some = rng.integers(3, 40)
        words = lambda low, high: rng.integers(1, some + 1, rng.integers(low, high))  # noqa: E731, B023
        run = words(width, width + 4)
        x, y = (np.concatenate([words(0, 30), run, words(0, 30)]).astype(np.uint64) for _ in range(2))
        found = passages.matched(x, y, width, 0.8)
        assert found and all(e - s >= width and q - p >= width for s, e, p, q in found)


def near_passages(rng, pairs=60):
    """Rows of two documents a pair that share a passage edited to a similarity of 0.80 to 0.95, among others' words, and the pairs."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(pairs):
        shared = [word() for _ in range(rng.randint(60, 200))]
        while True:
            copy, n = list(shared), rng.randint(1, 1 + len(shared) // 40)
            for at in rng.sample(range(len(copy)), n) if i % 2 else [k * len(copy) // (n + 1) for k in range(1, n + 1)]:
                copy[at] = word()
            a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (shared, copy))
            if 0.8 <= len(a & b) / len(a | b) <= 0.95:
                break
        for k, words in enumerate((shared, copy)):
            rows.append((2 * i + k, " ".join([word() for _ in range(rng.randint(0, 300))] + words + [word() for _ in range(rng.randint(0, 300))])))
    return rows, word


def test_repeated_passages_near_copies_and_partitions(spark):
    """Recall over all pairs at similarities of 0.80 to 0.95, against a scan of all pairs; the same rows however the table is dealt out."""
    rng = random.Random(17)
    rows, word = near_passages(rng)
    twice = [word() for _ in range(60)]
    text = [word() for _ in range(40)] + twice + [word() for _ in range(80)] + twice + [word() for _ in range(30)]
    rows.append((500, " ".join(text)))
    exact = [word() for _ in range(60)]
    for i in range(12):  # two exact copies with edited ones between them
        copy = list(exact)
        for at in rng.sample(range(60), 6 if i not in (3, 9) else 0):
            copy[at] = word()
        rows.append((600 + i, " ".join([word() for _ in range(50)] + copy + [word() for _ in range(50)])))
    hot = [word() for _ in range(55)]
    rows += [(700 + i, " ".join([word() for _ in range(20)] + hot + [word() for _ in range(20)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for parts in (1, 8):
        found = sorted(passages.repeated_passages(df.repartition(parts)).collect())
        results.append(found)
    assert results[0] == results[1]
    got = {r.doc_id: r for r in results[0]}
    tokens_of = lambda text: passages.shingle_tokens(texts_of(pa.array([text])))[0][:-1]
    tokens = {i: tokens_of(t) for i, t in rows}
    width = passages.PASSAGE - passages.SHINGLE + 1
    want = [(a, b) for a in tokens for b in tokens if a < b < 120 and passages.matched(tokens[a], tokens[b], width, 0.8)]
    assert len(want) == 60
    assert sum(a in got and b in got and got[a].class_id == got[b].class_id for a, b in want) >= 0.95 * len(want)
    assert {(s.start // 10, s.end // 10) for s in got[500].spans} == {(4, 10), (18, 24)} and got[500].class_id == 500
    assert got[603].class_id == got[609].class_id
    assert {got[700 + i].class_id for i in range(60)} == {700}
    assert all(r.class_id == min(x.doc_id for x in results[0] if x.class_id == r.class_id) for r in results[0])


def drifting(rng, word):
    """Families of texts, each an edited copy of the one before in its family, with ids in random order, behind texts with lower ids that share some words of a passage only."""
    rows, ids = [], iter(rng.sample(range(1000, 3000), 400))
    for family in range(25):
        now = [word() for _ in range(rng.randint(60, 160))]
        for k in range(20):
            at = rng.randrange(len(now) - 20)
            part = now[at : at + 20] if k % 4 == 0 else []
            rows.append((40 * family + k, " ".join([word() for _ in range(60)] + part + [word() for _ in range(60)])))
        for _ in range(14):
            rows.append((next(ids), " ".join([word() for _ in range(rng.randint(0, 90))] + now + [word() for _ in range(rng.randint(0, 90))])))
            now = list(now)
            for at in rng.sample(range(len(now)), max(1, len(now) // 50)):
                now[at] = word()
    return rows


def test_repeated_passages_unlike_least(spark, monkeypatch):
    """Classes are those of all similar pairs, also of members of a group that are unlike its least document; in whole groups and in parts."""
    rng = random.Random(23)
    rows = drifting(rng, lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6)))
    width = passages.PASSAGE - passages.SHINGLE + 1
    tokens = {i: passages.shingle_tokens(texts_of(pa.array([text])))[0][:-1] for i, text in rows}
    near = [(a, b) for a in tokens for b in tokens if a < b and len(np.intersect1d(tokens[a], tokens[b])) >= 41]
    want = {(a, b) for a, b in near if passages.matched(tokens[a], tokens[b], width, 0.8)}
    assert 300 < len(want) < len(near)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for parts, group in ((1, 4096), (8, 4096), (8, 5)):
        monkeypatch.setattr(passages, "GROUP", group)
        results.append(sorted(passages.repeated_passages(df.repartition(parts)).collect()))
    assert results[0] == results[1]
    label = {a: a for a in tokens}
    for _ in range(40):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    linked = {d for pair in want for d in pair}
    for rows in results[1:]:
        got = {r.doc_id: r.class_id for r in rows}
        assert got == {d: label[d] for d in linked}


def test_repeated_passages_periodic(spark):
    """A document whose one line or few lines go on and on repeats itself; so does one in which a word of the stretch is another."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, want = [], {}
    for i, (period, times) in enumerate([(30, 4), (1, 100), (7, 15), (60, 2), (60, 5), (30, 3), (50, 40), (1, 90), (25, 40)]):
        line, edge = [word() for _ in range(period)], [word() for _ in range(20)]
        inner = line * times
        if i == 8:
            inner[500] = word()
        rows.append((i, " ".join([*edge, *inner, *(word() for _ in range(20))])))
        if period * times - 4 >= period * -(-46 // period) + 46:
            want[i] = (20, 20 + period * times)
    assert set(want) == {0, 1, 2, 3, 4, 6, 8}
    results = [sorted(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()) for parts in (1, 8)]
    assert results[0] == results[1]
    got = {r.doc_id: r for r in results[0]}
    assert set(want) <= set(got) and all(r.class_id == r.doc_id and r.n_links == 1 for r in got.values())
    for i, (start, end) in want.items():
        assert sum(min(s.end, end) - max(s.start, start) for s in got[i].spans) >= (end - start if i != 8 else 900), (i, got[i].spans)


def test_periodic():
    """A stretch of any period is found whole, if parts of it that don't overlap are equal."""
    rng, width, some = np.random.default_rng(7), 9, 0
    for _ in range(200):
        texts, made = [], []
        for _ in range(4):
            period, times, edge = int(rng.integers(1, 25)), int(rng.integers(1, 12)), int(rng.integers(0, 20))
            line = rng.integers(1, 2**60, period)
            texts.append(np.concatenate([rng.integers(1, 2**60, edge), np.tile(line, times), rng.integers(1, 2**60, edge), [0]]))
            made.append((edge, edge + period * times, -(-width // period) * period))
        place = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = list(zip(*(v.tolist() for v in passages._periodic(np.concatenate(texts).astype(np.uint64), place, width))))
        assert sorted(found) == [(i, a, b, d) for i, (a, b, d) in enumerate(made) if b - a >= d + width]
        some += len(found)
    assert some > 200


def test_unlike_where_shingles_repeat(monkeypatch):
    """Members of few different shingles: classes are those of all pairs, and of unlike pairs only few are compared."""
    rng, width, compared, links, fewer = random.Random(3), 12, [0], 0, 0
    matched = passages.matched

    def counted(*given):
        compared[0] += 1
        return matched(*given)

    for _ in range(60):
        lists = []
        for _ in range(12):
            x = [w for _ in range(rng.randint(2, 5)) for w in [rng.randrange(1, 30)] * rng.choice([1, 1, 8, 15])]
            lists.append(np.array([*x, *range(30, 34), *[rng.randrange(1, 6) for _ in range(rng.randint(8, 20))]], np.uint32))
        members = [(k, 0, 0, len(x), x) for k, x in enumerate(lists)]
        monkeypatch.setattr(passages, "matched", counted)
        got = [(i, j) for i, j, _ in passages._unlike(members, [None] * len(members), width, 0.8)]
        monkeypatch.setattr(passages, "matched", matched)
        want = [(i, j) for i in range(12) for j in range(i) if matched(lists[i], lists[j], width, 0.8) or matched(lists[j], lists[i], width, 0.8)]
        label = {}
        for name, pairs in (("got", got), ("want", want)):
            now = list(range(12))
            for _ in range(12):
                for i, j in pairs:
                    now[i] = now[j] = min(now[i], now[j])
            label[name] = now
        assert label["got"] == label["want"]
        links, fewer = links + len(want), fewer + 66
    assert links > 100 and compared[0] < fewer / 2

    junk = [np.array([k] * 90 + list(range(1000, 1003)) + [5000 + k], np.uint32) for k in range(1, 60)]
    compared[0] = 0
    monkeypatch.setattr(passages, "matched", counted)
    assert not list(passages._unlike([(k, 0, 0, len(x), x) for k, x in enumerate(junk)], [None] * len(junk), 46, 0.8)) and compared[0] == 0


def test_joined_by_key(spark, monkeypatch):
    from lumenfold.llm import graph

    monkeypatch.setattr(graph, "HOT", 3)
    rows = spark.createDataFrame([(i % 5 if i < 50 else 9, i) for i in range(2000)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    joined = graph.joined_by_key(rows, table, "k")
    assert sorted(map(tuple, joined.select("k", "v", "least").collect())) == sorted((i % 5 if i < 50 else 9, i, i % 5 if i < 50 else 50) for i in range(2000))


def test_audio(odd, empty):
    for n in (1, 64, 65):
        assert audio.decode_wav(audio.encode_wav(bytes(range(n)))) == (bytes(range(n)), 8000)
    with pytest.raises(ValueError):
        audio.decode_wav(b"RIFFxxxxWAVE")
    table = audio.audio(odd).toArrow()
    for r in table.to_pylist():
        text = next(t for i, t, *_ in ODD if i == r["doc_id"])
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert audio.decode_wav(r["media"])[0] == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["n_bytes"] == len(raw)
    tensors = audio.as_tensors(table)
    assert tensors["log_mel"].type.shape == [16, 16] and tensors.num_rows == sum(len(t) for t in table["tensors"].to_pylist())
    kept = table.to_pylist()[2]["tensors"]
    assert all(t["end"] == n["start"] for t, n in zip(kept, kept[1:])) and all(t["frames"] == 16 for t in kept[:-1])
    features = {r["payload_sha256"]: r["feature"] for r in table.to_pylist()}
    assert all(features[r["payload_sha256"]] == r["feature"] for r in table.to_pylist())
    assert audio.digest(audio.audio(empty)).count() == 0
    tone = (128 + 100 * np.sin(2 * np.pi * 500 * np.arange(8000) / 8000)).astype(np.uint8)
    loud = np.concatenate([np.full(8000, 128, np.uint8), tone, np.full(8000, 128, np.uint8)]).tobytes()
    frames, seconds = audio.log_mel(loud, 8000, audio.Settings())
    (start, end), = audio.segments(frames, seconds, audio.Settings())
    assert abs(start - 1) < 0.1 and abs(end - 2) < 0.1
    three = audio.Settings(up=3, down=4)
    y = audio.resample(np.sin(2 * np.pi * 200 * np.arange(8000) / 8000).astype(np.float32), three)
    assert len(y) == 6000 and np.abs(np.fft.rfft(y)).argmax() == 200


def test_audio_against_definitions():
    """Resampling by filling in zeros, filtering and dropping; mel bands by sums over a direct transform; segments by a walk over frames."""
    rng = np.random.default_rng(3)
    for up, down in ((2, 3), (1, 2), (3, 4), (5, 2)):
        s = audio.Settings(up=up, down=down)
        x = rng.normal(size=501).astype(np.float32)
        n = s.taps * up
        t = (np.arange(n) - (n - 1) / 2) / max(up, down)
        h = np.sinc(t) * np.hanning(n + 2)[1:-1]
        filled = np.zeros(len(x) * up)
        filled[::up] = x
        want = np.convolve(filled, h * up / h.sum())[: len(filled)][::down]
        assert np.allclose(audio.resample(x, s), want, atol=1e-4)
    s, raw = audio.Settings(), rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    y = audio.resample((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128, s)
    y = np.concatenate([y, np.zeros(s.window)])
    frames, seconds = audio.log_mel(raw, 8000, s)
    rate = 8000 * s.up / s.down
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    for k in range(len(frames)):
        part = y[k * s.hop : k * s.hop + s.window] * np.hanning(s.window)
        for band in (0, 7, 15):
            low, mid, high = (700 * (10 ** (mel(rate / 2) * (band + d) / (s.bands + 1) / 2595) - 1) for d in range(3))
            power = 0.0
            for b in range(s.window // 2 + 1):
                hz = b * rate / s.window
                if low < hz < high:
                    angle = 2 * math.pi * b * np.arange(s.window) / s.window
                    spectrum = (part * np.cos(angle)).sum() ** 2 + (part * np.sin(angle)).sum() ** 2
                    power += spectrum * min((hz - low) / (mid - low), (high - hz) / (high - mid))
            assert abs(frames[k, band] - math.log(power + 1e-6)) < 2e-2
    for _ in range(50):
        f = rng.normal(size=(40, 4)).astype(np.float32).cumsum(axis=0)
        e = f.mean(axis=1)
        on, want = False, []
        for k, v in enumerate(e):
            if not on and v >= e.mean() + s.high * e.std():
                on = True
                want.append([k, len(e)])
            elif on and v < e.mean() + s.low * e.std():
                on = False
                want[-1][1] = k
        assert audio.segments(f, 1.0, s) == [tuple(map(float, x)) for x in want]


def test_string_kernel():
    """The kernel of two texts is the share of n-grams of 1 to 3 bytes that both have; n-grams of one hash count as one."""
    strings = ["the cat sat", "The hat", "", "ñandú é", "aaaa", "x"]
    got = langid.presence(texts_of(pa.array(strings)))
    bits = langid.DIMENSIONS.bit_length() - 1

    def columns(text):
        raw = bytes(b | 32 if 65 <= b <= 90 else b for b in text.encode())
        grams = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
        return {(int.from_bytes(g, "little") * (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[len(g) - 1]) % 2**32 >> 32 - bits for g in grams} - {0}

    for i, text in enumerate(strings):
        assert set(np.flatnonzero(got[i]).tolist()) == columns(text)


def test_samples(spark):
    from lumenfold.llm.training import sample

    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 3), f"l{i % 40}") for i in range(400)] + [(1, "another text", "l1"), (None, "x", "l1"), (7, None, "l2")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 5 - 1) for i in range(400)] + [(3, None)], "doc_id long, toxic int")
    texts, y, sizes = sample(docs, labels, "toxic", 20, [0, 1])
    assert set(y) == {0, 1} == set(sizes) and max(y.count(0), y.count(1)) <= 20
    assert len(sample(docs, docs, "lang", 5, classes=7)[2]) == 7
    few = sample(docs, labels, "toxic", 20, [0, 1], most_bytes=100)
    assert few[0] == texts[: len(few[0])] and sum(map(len, few[0])) <= 100 < sum(map(len, texts))
    assert sample(docs, labels, "toxic", 20, [8])[2] == {} and sample(docs.limit(0), docs.limit(0), "lang", 5) == ([], [], {})
    for operator, column in ((toxicity, "toxic"), (quality, "quality")):
        assert all(0 <= r.score <= 1 for r in operator.score(docs, labels.withColumnRenamed("toxic", column)).collect())


def test_banded_edits():
    rng = random.Random(7)
    for _ in range(150):
        text, item = (bytes(rng.choice(b"abc") for _ in range(rng.randint(a, b))) for a, b in ((0, 40), (1, 15)))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i, *[0] * len(text)]
            for j, x in enumerate(text, 1):
                new[j] = min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1)
            row = new
        assert decontam.banded_edits(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), -15, 40, 5)[0] == min(min(row), 6)


def test_decontamination(spark, odd, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    rows, want = [], {}
    for i in range(60):
        around = [" ".join(word() for _ in range(40)) for _ in range(2)]
        passage = ""
        if i < 40:
            passage = list(items[i % 20][1])
            n = rng.randint(0, len(passage) // 10)
            for k in rng.sample(range(len(passage)), n):
                passage[k] = rng.choice(["", "x", passage[k] + "y"])
            passage = "".join(passage)
            want[i] = i % 20
        rows.append((i, f"{around[0]}\n{passage.upper() if i % 3 else passage} \t{around[1]}"))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, ""), (97, "short")], "item_id long, text string")
    for bound in (decontam.BOUND, 500):
        found = decontam.contamination(df, bench, bound=bound).collect()
        assert {(r.doc_id, r.item_id) for r in found} == set(want.items())
        assert all(r.edits <= 0.1 * r.item_bytes and r.similarity >= 0.9 for r in found)
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == set(range(40, 60))
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(odd, bench.limit(0)).count() == 0
    assert decontam.contamination(odd, bench).count() == 0 and decontam.clean(odd, bench).columns == odd.columns


def test_contamination_against_scan():
    """Every item of 1 to 70 bytes against every text, with near misses, by edit distances over whole texts."""
    rng = random.Random(21)

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i, *[0] * len(text)]
            for j, x in enumerate(text, 1):
                new[j] = min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1)
            row = new
        return min(row)

    some = 0
    for trial in range(25):
        alphabet = "ab" if trial % 5 == 0 else "abcdefgh"
        items = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 70))) for _ in range(20)]
        strings = ["", "a" * 300 if trial % 5 == 0 else "x"]
        for item in items:
            copy = list(item)
            for k in range(rng.randint(0, 1 + len(item) // 8)):
                copy[rng.randrange(len(copy))] = rng.choice(["", "z", "qq"])
            strings.append("".join(rng.choice("mnop") for _ in range(30)) + " " * (rng.random() < 0.5) + "".join(copy) + " " + "".join(rng.choice("mnop") for _ in range(20)))
        searcher = decontam.Searcher(list(range(20)), [x.encode() for x in items], 0.1)
        got = {(t, searcher.ids[i]): e for t, i, e, *_ in searcher.search(texts_of(pa.array(strings)))}
        want = {}
        for t, text in enumerate(" ".join(x.split()) for x in strings):
            for k, item in enumerate(items):
                e = least(item, text)
                if e <= decontam.edit_budget(len(item)) and (decontam.gram(len(item)) or f" {item} " in f" {text} "):
                    want[t, k] = e
        assert got == want
        some += len(want)
    assert some > 150


def test_language(odd, empty, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got >= 0.97
    rows = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[7].lang_pred == rows[8].lang_pred == "und" and rows[3].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in rows.values()) and langid.identify(empty).count() == 0
    assert {r.doc_id for r in langid.accepted(odd).collect()} == {3, 4, 5, 6, None} and langid.accepted(odd).columns == odd.columns


def auc(pairs):
    ones, zeros = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_and_quality(spark, odd, empty, labels):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for operator, label in ((toxicity, "toxic"), (quality, "quality")):
        rows = operator.score(d, lab).join(lab, "doc_id").filter("held_out").select(label, "score").collect()
        assert auc([tuple(r) for r in rows]) >= 0.95
        for few in (labels, labels.limit(0)):
            rows = operator.score(odd, few).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert operator.score(empty, labels).count() == 0


def brute_weights(tokens):
    """Each match by its definition, from the clause as a whole."""
    out, kinds = [], [c for c, _ in tokens]
    for k, (c, weight) in enumerate(tokens):
        near = kinds[max(0, k - toxicity.FADES) : k]
        if c == toxicity.INSULT:
            w = toxicity.PHRASED if k and kinds[k - 1] == toxicity.INSULT else 1.0
        elif c == toxicity.THREAT:
            w = 1.0 if toxicity.INTENT in near else toxicity.BARE
        else:
            w = 0.0
        w *= toxicity.NEGATED if toxicity.NEGATION in near else 1.0
        w *= toxicity.REPORTED if toxicity.REPORT in kinds[:k] else 1.0
        w *= toxicity.TARGETED if toxicity.TARGET in kinds[:k] + kinds[k + 1 :] else 1.0
        out.append(w * weight)
    return out


def test_grammar():
    rng = random.Random(6)
    for _ in range(3000):
        tokens_ = [(rng.choice(toxicity.CLASSES), rng.random()) for _ in range(rng.randint(0, 9))]
        assert np.allclose(toxicity.path_weights(tokens_), brute_weights(tokens_))
    you, idiot, no, said, kill, will = ((c, 2.0) for c in (toxicity.TARGET, toxicity.INSULT, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT, toxicity.INTENT))
    plain = toxicity.clause_score([idiot])
    assert toxicity.clause_score([you, idiot]) == toxicity.clause_score([idiot, you]) > plain > toxicity.clause_score([said, idiot]) > toxicity.clause_score([no, idiot])
    assert toxicity.clause_score([will, kill]) > toxicity.clause_score([kill]) and toxicity.clause_score([idiot, idiot]) > 2 * plain


def test_multipliers_decide():
    """Where negated and reported insults are harmless, the composed transducer tells them apart and the bare sum of matches doesn't."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeflmno") for _ in range(rng.randint(3, 8)))
    texts, y = [], []
    for i in range(600):
        insults = rng.sample(["idiot", "moron", "stupid", "loser", "pathetic"], 2)
        around = [" ".join(word() for _ in range(6)) for _ in range(2)]
        toxic = i % 2
        clause = ("" if toxic else rng.choice(["not ", "said "])) + f"you {insults[0]} {insults[1]}"
        texts.append(f"{around[0]}. {clause}. {around[1]}".encode())
        y.append(toxic)

    def held_out_auc(clause):
        g = toxicity.fit(texts[:400], y[:400], {0: 200, 1: 200}, clause)
        return auc(list(zip(y[400:], g.scores(texts_of(pa.array(texts[400:], pa.binary()).cast(pa.string()))).tolist())))

    assert held_out_auc(toxicity.CLAUSE) > 0.99 > 0.8 > held_out_auc(toxicity.union(toxicity.INSULTS, toxicity.THREATS))


def test_marginals():
    rng = np.random.default_rng(9)
    emission, move, first = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), np.array([0, 4, 5])
    m, _, log_z = quality.marginals(emission, first, move)
    total, marks = 0.0, np.zeros((4, 2))
    for k in range(16):
        y = [k >> i & 1 for i in range(4)]
        w = np.exp(sum(emission[i, y[i]] for i in range(4)) + sum(move[y[i], y[i + 1]] for i in range(3)))
        total += w
        for i in range(4):
            marks[i, y[i]] += w
    assert np.allclose(m[:4], marks / total)
    assert np.isclose(log_z, np.log(total) + np.log(np.exp(emission[4]).sum()))


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = d.count()
    assert 200 >= kept["language"] == kept["line_dedup"] > kept["near_dedup"] >= kept["decontaminate"] > 150
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert len(ids) == kept["decontaminate"]


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
