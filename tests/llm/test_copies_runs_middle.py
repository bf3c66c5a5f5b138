"""SimHash classes, periodic runs and fill-in-the-middle against plain loops."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import fill_middle, jaccard_join, periodic_runs, simhash

from .test_operators import SCHEMA, VOCAB, brute_components, by_row, docs, expected, hashed, rows, words  # noqa: F401


def plain_print(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_classes(prints, radius):
    """Smallest id (None: none) of each row's component; prints: (id, fingerprint)."""
    comp = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius and comp[i] != comp[j]:
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    least = {}
    for (i, _), c in zip(prints, comp, strict=True):
        least.setdefault(c, []).extend([] if i is None else [i])
    return [min(least[c], default=None) for c in comp]


def test_fingerprints_and_classes(docs):  # noqa: F811
    prints = [(r[0], plain_print(r[1])) for r in rows()]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_classes(prints, 2), strict=True)), key=repr)
    odd = docs.withColumn("fp", F.lit("x")).withColumn("comp", F.lit(1))
    assert by_row(simhash.query(odd), "fingerprint", "component_id") == want


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair(radius):
    masks = simhash.tables(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        bits = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(not bits & m for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("block", [1024, 5, 1])
def test_links_of_buckets_of_any_size(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 1: all by common neighbours
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(40):  # chains and clouds around it
            prints.add(p)
            q = p
            for _ in range(rng.randint(0, 4)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
            p = rng.choice([p, q])
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = {r.vid: r.comp for r in simhash.linked_components(df, radius).collect()}
    numbered = [(simhash.signed(p), p) for p in prints]
    assert [got.get(i, i) for i, _ in numbered] == plain_classes(numbered, radius)


def test_large_buckets_make_few_rows(spark):
    """A bucket's cost is its neighbours', 29 for each row, not its pairs: each neighbour has as many rows at most."""
    base = 0x1234_5678_9ABC_DEF0
    open_bits = [1 << i for i in range(64) if not simhash.tables()[0] >> i & 1]
    prints = {base ^ a ^ b ^ c for a in open_bits[:14] for b in open_bits[:14] for c in open_bits[14:20]}
    rows_ = spark.createDataFrame([(0, simhash.signed(p)) for p in prints], "tab int, fp long")
    links = simhash.links_by_neighbours(rows_, 2)
    assert links.count() <= 29 * len(prints)
    got = {r.vid: r.comp for r in simhash.components(links).collect()}
    numbered = [(simhash.signed(p), p) for p in sorted(prints)]
    assert [got.get(i, i) for i, _ in numbered] == plain_classes(numbered, 2)


def plain_runs(w, least=12):
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, 2 * q) and all(any(w[k] != w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_repeated(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_of_small_alphabets():
    rng = random.Random(7)
    for _ in range(1500):
        least = rng.choice([2, 3, 12])
        w = []
        for _ in range(rng.randint(0, 5)):
            w += ([rng.randrange(4) for _ in range(rng.randint(1, 8))] * 6)[: rng.randint(1, 30)]
        assert periodic_runs.runs_of(np.array(w, np.int64), least) == plain_runs(w, least)


def test_runs_and_what_is_left(spark, docs):  # noqa: F811
    def want(i, t):
        w = plain_repeated(words(t), i)
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        numbers = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        return len(runs), *numbers, hashed("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), hashed(" ".join(x for k, x in enumerate(w) if k not in gone).encode())

    extra = [(i, " ".join(random.Random(i).choices(VOCAB, k=80)), "en", "s", 1) for i in range(1000, 1120)]
    small = docs.where("text is null or length(text) < 5000").unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("runs", F.lit(1))
    cols = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    made = sorted(((r.doc_id, *want(r.doc_id, r.text)) for r in small.collect()), key=repr)
    assert by_row(periodic_runs.digests(small), *cols) == made
    assert sum(n > 0 for _, n, *_ in made) > 8
    long = spark.createDataFrame([(3, "a b c " * 60_000, "x")], "doc_id long, text string, runs string")
    got = periodic_runs.found_runs(long.drop("runs"), ["doc_id"]).first()
    assert [tuple(r) for r in got.runs] == [(0, 180_000, 3)] and got.collapsed == "a b c"


def plain_middle(t, i):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, hashed(t.encode()), hashed(t.encode())
    x, y = sorted(v % (len(units) + 1) for v in h[:2])
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(units), form, len(p), len(m), hashed(out.encode()), hashed(t.encode())


ODD = ["a\n\nb\r\nc", "\n\n\n", "<P>x\ny", "x<\n<S\n>y<", "<<M\n<\n", "é\n😀\nß", "no end", "end\n", "l\n" * 3000]


def test_middle_and_back(spark, docs):  # noqa: F811
    more = spark.createDataFrame([(100 + 50 * k + j, t, "en", "s", 1) for k, t in enumerate(ODD) for j in range(8)], SCHEMA)
    whole = docs.where("doc_id is not null").unionByName(more).withColumn("form", F.lit("mine")).withColumn("output", F.lit(2))
    cols = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert by_row(fill_middle.digests(whole), *cols) == sorted(((r.doc_id, *plain_middle(r.text, r.doc_id)) for r in whole.collect()), key=repr)
    assert {f for _, _, f, *_ in by_row(fill_middle.digests(whole), *cols)} == {"plain", "psm", "spm"}
    out = fill_middle.transform(whole)
    assert out.columns == [*whole.columns, "fim"]
    back = fill_middle.restore(out.select("doc_id", "fim.form", "fim.output"))
    assert by_row(back, "text") == sorted(((r.doc_id, r.text or "") for r in whole.collect()), key=repr)
    none = fill_middle.digests(docs.where("doc_id is null")).collect()
    assert len(none) == 2 and all(r.restored_sha256 in {hashed(b""), hashed(b"no id here")} for r in none)


def test_pieces_cut_anywhere():
    p = fill_middle.Pieces(b"abcdef").cut(0, 2, 2, 6)
    assert [bytes(v) for v in p.views()] == [b"", b"ab", b"", b"cdef", b""] and p.content() == b"abcdef"
    assert p.permuted((3, 1, 0, 2, 4)).sha256() == hashed(b"cdefab")
    with pytest.raises(ValueError):
        fill_middle.restored(b"<P>a<M>b", "psm")


# ---- large groups of the Jaccard join

def split_of(spark, sets):
    """One group of all these sets, each a component, as still_split gives it, and the sets."""
    vids = [jaccard_join.vertex_of(s) for s in sets]
    rows_ = spark.createDataFrame([(v, 7, v, min(vids), len(vids), len(vids) - 1) for v in vids], "vid long, key long, comp long, top long, many long, outside long")
    return rows_, spark.createDataFrame([(v, len(s), bytearray(jaccard_join.bitmap_of(s)), bytearray(s.tobytes())) for v, s in zip(vids, sets, strict=True)], "vid long, size long, bitmap binary, elements binary")


@pytest.mark.parametrize("n", [6000, 24_000])
def test_a_group_of_unlike_sets_is_not_dealt_in_squares(spark, n):
    rng = np.random.default_rng(n)
    common = np.sort(rng.integers(0, 1 << 60, 12, dtype=np.uint64))  # one range of hashes
    sets = [np.unique(np.concatenate([common, rng.integers(1 << 60, (1 << 64) - 1, 38, dtype=np.uint64)])) for _ in range(n)]
    split, whole = split_of(spark, sets)
    none = spark.createDataFrame([], "vid long, comp long")
    left = jaccard_join.finer(split, whole, none, jaccard_join.Rule(3, 90, 100))
    dealt = 0 if left.isEmpty() else jaccard_join.dealt(left.join(whole.select("vid", "size", "bitmap"), "vid")).count()
    assert dealt <= 4 * n


def test_smaller_parts_lose_no_link():
    """Of a pair that links one common key is among the first of both, in any order of the keys."""
    rng = np.random.default_rng(3)
    for num in (90, 80, 50):
        rule = jaccard_join.Rule(3, num, 100)
        bands, apart = rule.bands(), rule.parts()[1]
        for n in (1, 3, 9, 40, 300):
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                drop = int(rng.integers(0, max(1, int(len(a) * (1 - num / 100))) + 1))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, drop + 1)), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < num * (len(a) + len(b) - both):
                    continue
                salt = int(rng.integers(1 << 30))
                first = [{(t, k) for t, room, keys in jaccard_join.finer_keys(s, bands, apart) for k in sorted(keys.tolist(), key=lambda k: hash((k, salt)))[:room]} for s in (a, b)]
                assert first[0] & first[1]


@pytest.mark.parametrize(("rule", "block"), [((3, 90, 100), 3), ((3, 60, 100), 8)])
def test_components_with_groups_split_again(spark, monkeypatch, rule, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    page = [f"menu{i}" for i in range(60)]  # pages of one site: much in common, some linked
    data = []
    for i in range(70):
        w = page + [rng.choice(VOCAB) + str(rng.randint(0, 400)) for _ in range(rng.choice([2, 5, 9, 40]))]
        data.append((i, " ".join(w)))
        if i % 5 == 0:
            data.append((500 + i, " ".join([*w[:-1], "end"])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert by_row(jaccard_join.query(df, jaccard_join.Rule(*rule)), "n_shingles", "component_id") == brute_components(data, *rule)
