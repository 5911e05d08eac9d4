"""SimHash groups against brute force over all pairs."""

import itertools
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash

import __spark_entry__ as contract
from almanac.llm import simhash

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    runs = [words[i : i + size] for i in range(len(words) - size + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, radius=3):
    """The smallest fingerprint that links lead to, for each one."""
    top = {p: p for p in prints}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for p, q in itertools.combinations(top, 2):
        if (p ^ q).bit_count() <= radius:
            a, b = sorted((find(p), find(q)))
            top[b] = a
    return {p: find(p) for p in top}


def check(rows, docs):
    """rows: (doc_id, fingerprint, component_id) of the query; docs: (doc_id, text)."""
    prints = {i: plain(t) for i, t in docs}
    top = grouped(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[top[p]] = min(i, least.get(top[p], i))
    assert sorted(rows) == sorted((i, f"{p:016x}", least[top[p]]) for i, p in prints.items())


def test_query_equals_brute_force(spark):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = [tuple(r) for r in contract.queries()["op11_simhash"](spark, SF).collect()]
    check(got, list(zip(table["doc_id"], table["text"], strict=True)))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("crowd", "radius"), [(128, 3), (4, 3), (1, 3), (0, 3), (2, 2), (1, 1), (1, 0)])
def test_links_are_whole_however_cells_are_divided(spark, monkeypatch, crowd, radius):
    """Random fingerprints with neighbours up to five bits away, and a dense ball around one."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(30):
        p = rng.getrandbits(64)
        prints |= {p} | {p ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(1, 6)}
    center = rng.getrandbits(64)
    prints |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(120)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "x bigint")
    got = [tuple(r) for r in simhash.links(df, radius).collect()]
    wanted = {tuple(sorted((signed(p), signed(q)))) for p, q in itertools.combinations(prints, 2) if (p ^ q).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(50)] + [0, (1 << 64) - 1]
    df = spark.createDataFrame([(signed(p),) for p in prints], "x bigint")
    for x, c in df.select("x", simhash.bit_counts(df.x)).collect():
        fields = [(c >> i & 3) for i in range(0, 64, 2)]
        assert fields == [(x >> i & 3).bit_count() for i in range(0, 64, 2)]


def test_odd_rows(spark):
    """Nulls, texts without words, short and very long texts, repeated rows, null ids, and clashing columns."""
    long = "Words of a text\twithout end and " * 150_000  # several lists of words
    texts = [None, "", " \n\t", "one", "ONE", "two words", "a b c", "A  b\nc", long, long + "more", "x" * 3_000_000, "é É e", "a b c"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "mine", 3, "kept") for i, t in docs], "doc_id bigint, text string, fingerprint string, component_id int, x string")
    found = simhash.near_duplicates(df).collect()
    check([(r["id"], f"{r['fingerprint'] % (1 << 64):016x}", r["component_id"]) for r in found], docs)
    again = spark.createDataFrame([(5, "same text of four"), (5, "same text of four"), (None, "same text of four"), (None, "quite other words here"), (9, None)], "doc_id int, text string")
    found = simhash.near_duplicates(again).collect()
    assert sorted((r["id"] or 0, r["component_id"]) for r in found if r["component_id"]) == [(0, 5), (5, 5), (5, 5), (9, 9)]
    assert len(found) == 5
    none = simhash.near_duplicates(df.limit(0))
    assert none.collect() == [] and none.columns == ["id", "fingerprint", "label", "component_id"]
