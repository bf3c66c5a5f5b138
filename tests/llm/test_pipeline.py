"""The pipeline's stages one after the other, against what each should do to its input."""

import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lectern.llm import byte_bpe, mixing, secret_scan
from tests.llm.test_operators import SCHEMA, VOCAB, brute_components, hashed, rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen.append((name, before, docs))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    _, before, after = seen[0]
    kept = sorted(r.doc_id for r in after.where("doc_id is not null").collect())
    assert 5 in kept and 1 not in kept and 10 not in kept
    _, before, after = seen[1]
    comps = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in comps})
    _, before, after = seen[2]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: secret_scan.redacted(r.text) for r in before.collect()}
    _, before, after = seen[3]
    assert sorted(map(tuple, before.collect()), key=repr) == sorted(map(tuple, after.collect()), key=repr)
    _, before, after = seen[4]
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r.doc_id: tk.encode_ordinary(r.text) for r in before.collect()}
    assert {r.doc_id: r.ids for r in after.collect()} == want
    assert all(r.decoded_sha256 == hashed(t.encode()) for r in after.collect() for t in [next(x.text for x in before.collect() if x.doc_id == r.doc_id)])
    assert sorted(r.doc_id for r in cp.run(spark, sf).collect()) == sorted(want)


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_run_over_huge_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(VOCAB) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randint(0, 999)) for _ in range(n))
    huge, page = prose(140_000), prose(60)
    made = [(0, huge), (1, huge + " end"), (2, page), (3, page.replace(" ", "  ", 1)), (4, "x" * 1_000_000), (None, prose(50)), (5, f"{prose(30)} password=abcdef123 {prose(30)}"), (6, None), (6, "")]
    made += [(10 + i, prose(40)) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in made], SCHEMA)
    names = ("slot", "row_in_block", "_row", "_order", "_text", "comp", "vid", "kept", "spans", "text_key", "ids", "quality")
    docs.select("*", *(F.lit(n).alias(n) for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 2, 5, None, *range(10, 30)}
    assert got[0].decoded_sha256 == hashed(huge.encode()) and got[2].decoded_sha256 == hashed(page.encode())
    assert got[5].decoded_sha256 == hashed(secret_scan.redacted(made[6][1]).encode()) != hashed(made[6][1].encode())


def test_order_of_the_mix(spark, tmp_path):
    size = {"a": 400, "b": 150, "c": 60, None: 20}
    made = [(i, f"text {i} of {s}", "en", s, 10) for s, n in size.items() for i in range(n)]
    docs = spark.createDataFrame(made, SCHEMA).repartition(3)
    # files are read in any order
    cp.mix_sources(spark, docs, "").repartition(5).write.parquet(f"{tmp_path}/mixed")
    got = cp.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").select("doc_id", "decoded_sha256", "slot", "row_in_block").collect()
    source = {hashed(t.encode()): s for _, t, _, s, _ in made}
    assert len(got) == len(made) == len({(r.slot, r.row_in_block) for r in got})
    total = sum(n**0.5 for n in size.values())
    share = {s: max(1, round(n**0.5 / total * mixing.PERIOD)) for s, n in size.items()}
    placed, seen = dict.fromkeys(size, 0), dict.fromkeys(size, 0)
    slots = {r.slot: source[r.decoded_sha256] for r in got}
    rows_of = Counter((r.slot, source[r.decoded_sha256]) for r in got)
    assert len(rows_of) == len(slots)
    for t in range(max(slots) + 1):
        if t in slots:
            placed[slots[t]] += 1
            seen[slots[t]] += rows_of[t, slots[t]]
        for s in size:
            if seen[s] < size[s]:
                assert abs(placed[s] - share[s] * (t + 1) / sum(share.values())) < 1
