"""SimHash near-duplicates against brute force: every pair of fingerprints, shingle by shingle."""

import random
import re

import pytest
import xxhash

from dataward.llm.simhash_dedup import SimHash, _forest, simhash, simhash_duplicates

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, print string, component string, n int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [w[k:k + 4] for k in range(len(w) - 3)] if len(w) >= 4 else [w] if w else []
    h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(prints, distance=4):
    """(id, print) rows -> {id: least id reachable}."""
    top = {p: p for _, p in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    distinct = sorted(top)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1:]:
            if (a ^ b).bit_count() <= distance:
                top[find(b)] = find(a)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {i: least.get(find(p)) for i, p in prints}


def found(df):
    return {r["doc_id"]: (r["print"] % (1 << 64), r["component_id"]) for r in df.collect()}


def test_documents_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    prints = [(r["doc_id"], fingerprint(r["text"])) for r in df.collect()]
    want = expected(prints)
    assert found(simhash_duplicates(df)) == {i: (p, want[i]) for i, p in prints}


def _neighbourhood(n, seed, flips):
    """Prints around a few centres: dense enough for chains, far enough apart for several components."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = rnd.choice(centres)
        for b in rnd.sample(range(64), rnd.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("blocks", "chunk", "flips"), [(None, 7, 8), (None, 1024, 9), (5, 16, 6), (8, 5, 7)])
def test_links_of_crowded_prints_equal_brute_force(spark, blocks, chunk, flips):
    """Hundreds of prints a few bits apart: keys hold many components, and steps are split into chunks."""
    from dataward.llm.components import components
    from dataward.llm.simhash_dedup import _links

    prints = _neighbourhood(400, flips, flips)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = _links(spark.createDataFrame([(p,) for p in signed], "print long"), SimHash(blocks=blocks, chunk=chunk))
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    part = {r["node"] % (1 << 64): r["component"] for r in components(links).collect()}
    number = {p: k for k, p in enumerate(prints)}
    want = expected([(number[p], p) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(part.get(p, p - (1 << 64) if p >> 63 else p), []).append(number[p])
    assert {i: min(g) for g in groups.values() for i in g} == want
    assert len(set(want.values())) > 1


def test_odd_rows(spark):
    """Null, empty and blank texts link by their zero print; null ids, repeats, hot copies and a very long text."""
    long_text = " ".join(f"w{k % 7919}" for k in range(60_000))
    rows = [(9, None), (3, ""), (4, " \n\t"), (5, "one Two"), (5, "one Two"), (None, "one two"), (None, "alone here"), (6, long_text), (7, "日本 é ünï \x85 x")]
    rows += [(100 + k, "the same text again and again") for k in range(50)]
    got = simhash_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [(i, fingerprint(t)) for i, t in rows]
    want = expected(prints)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, c in want.items() if i is not None}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {5, None}
    assert {r["component_id"] for r in got if (r["doc_id"] or 0) >= 100} == {100}
    assert simhash_duplicates(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_slices_and_ties_of_bits():
    """A bit that exactly half of the hashes have is 0, however the hashes are sliced."""
    rnd = random.Random(1)
    h = [rnd.getrandbits(64) for _ in range(70_000)]
    assert simhash(h) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash([3, 1]) == 1 and simhash([]) == 0


def test_keys_cover_every_pair_within_the_distance():
    rnd = random.Random(2)
    for count in (10, 3_000_000, 200_000_000):
        masks = SimHash().masks(count)
        for _ in range(300):
            diff = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_forest_joins_what_the_pairs_join():
    import numpy as np

    assert _forest(np.array([[1, 2], [2, 1], [3, 4], [1, 3], [2, 4]])) == [0, 2, 3]
