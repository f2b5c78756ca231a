"""Near copies against all pairs of fingerprints."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash

from conftest import FOLDER
from tomeseek.llm import copies, near_dups, queries
from tomeseek.llm.components import components

DOCS = "doc_id bigint, text string, lang string, text_hash int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_query_equals_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    of = groups(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i in sorted(fps):
        first.setdefault(of[fps[i]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_near_duplicates(spark, FOLDER).collect()}
    assert got == {i: (f"{fp:016x}", first[of[fp]]) for i, fp in fps.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_crowded_fingerprints(spark, seed):
    draw = random.Random(seed)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(60):
            one = centre
            for _ in range(draw.randint(0, 5)):
                one ^= 1 << draw.randrange(64)
            fps.add(one)
    signed = {near_dups._signed(x): x for x in fps}
    links = near_dups.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 2 for r in links)
    want = groups(signed, lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 2)
    joined = groups(signed, lambda a, b, held={frozenset((r.a, r.b)) for r in links}: frozenset((a, b)) in held)
    assert joined == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text, "a", 1), (2, text.upper(), "b", 2), (2, text.upper(), "b", 2), (None, text, "c", 3), (9, None, "d", 4), (8, " \n", "e", 5), (7, "quite another text here", "f", 6), (None, "w " * 50_000, "g", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.lang, r.text_hash) for r in kept.collect()) == [(0, "g", 7), (2, "b", 2), (7, "f", 6), (8, "e", 5)]
    assert near_dups.drop_near_duplicates(docs.limit(0)).count() == 0


def test_copies_equal_all_pairs_by_similarity(spark):
    draw = random.Random(7)
    docs = [(i, t) for i, t in enumerate((None, " ", "a b", "A  b", "w " * 9, "w " * 40))]
    for _ in range(12):
        base = [f"v{draw.randrange(5000)}" for _ in range(draw.choice((30, 100, 300)))]
        docs.append((len(docs), " ".join(base)))
        for edits in range(1, 8):
            new = list(base)
            for at in draw.sample(range(len(base)), max(1, edits * len(base) // 300)):
                new[at] += "x"
            docs.append((len(docs), " ".join(new)))

    def bag(text):
        words = (text or "").lower().split()
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])

    bags = {i: bag(t) for i, t in docs}
    alike = lambda a, b: not (bags[a] or bags[b]) or (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total()
    want = {i for i, root in groups(bags, alike).items() if i == root}
    kept = near_dups.drop_near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in kept} == want and len(want) < 40
    # Pairs of similarity 0.8 to 0.85 share a band.
    close = [(a, b) for a in bags for b in range(a) if bags[a] and 0.8 <= (bags[a] & bags[b]).total() / (bags[a] | bags[b]).total() < 0.85]
    bands = {i: set(copies.bands_of(t, 5)) for i, t in docs}
    assert len(close) > 20 and sum(bool(bands[a] & bands[b]) for a, b in close) >= 0.99 * len(close)


def _unlike_crowd(draw, m, words, edits, apart=1):
    """``m`` texts made from one that is not among them, with changed words so far apart."""
    base = [f"w{i}" for i in range(words)]
    for k in range(m):
        new = list(base)
        for at in draw.sample(range(apart - 1, words - apart + 1, apart), edits):
            new[at] = f"x{k}_{at}"
        yield " ".join(new)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_crowds_equal_all_pairs(spark, edits):
    """Crowds of texts that are all, partly or never alike, and one group of copies beside a larger one under the same bands."""
    draw = random.Random(edits)
    texts = list(_unlike_crowd(draw, 40, 100, edits)) + [f"{t} {'tail ' * 30}" for t in _unlike_crowd(draw, 12, 100, edits)] + [f"{t} {'other tail ' * 4}" for t in _unlike_crowd(draw, 12, 100, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = {i: copies.elements(t, 5) for i, t in enumerate(texts)}
    want = groups(sets, lambda a, b: copies.similarity(sets[a], sets[b]) >= 0.8)
    rows, classes = near_dups.near_duplicates(docs)
    got = {r.doc_id: r.component_id for r in rows.join(classes, "fp").collect()}
    assert got == want


def test_rare_pairs_lose_none_and_grow_in_proportion(spark):
    counts = []
    for m in (60, 120, 240):
        draw = random.Random(m)
        texts = list(_unlike_crowd(draw, m, 120, 3, 10))
        for base in range(m // 6):  # pairs of any likeness and length
            one = [f"y{base}_{i}" for i in range(draw.randint(20, 90))]
            two = list(one)
            for at in draw.sample(range(len(two)), draw.randint(0, len(two) // 12)):
                two[at] += "z"
            texts += [" ".join(one), " ".join(two[draw.randint(0, 9):])]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        held = copies.Texts(docs, "text", 5, 0.8)
        nodes = docs.select(copies.text_hash("text").alias("node"), "doc_id").collect()
        ids = {r.node: r.doc_id for r in nodes}
        roots = spark.createDataFrame([(n, n) for n in ids], "node bigint, root bigint")
        pairs = {tuple(sorted((ids[r.a], ids[r.b]))) for r in copies.rare_pairs(held, roots.select("node"), roots).collect()}
        sets = [copies.elements(t, 5) for t in texts]
        alike = {(a, b) for b in range(len(sets)) for a in range(b) if texts[a] != texts[b] and copies.similarity(sets[a], sets[b]) >= 0.8}
        assert alike <= pairs
        counts.append(len(pairs))
    assert counts[2] < 6 * counts[0] and counts[2] < 240


def test_the_pipeline_meets_texts_by_pivots_first(spark, monkeypatch):
    """The pipeline's near copies go through the tables of pivots, and what these find is compared exactly."""
    import corpus_pipeline
    from tomeseek.llm.common import text_hash

    made = random.Random(6)
    base = [f"w{made.randrange(10**6)}" for _ in range(900)]
    texts = {i: " ".join([*base, *(f"end{i}" for _ in range(i % 2))]) for i in range(12)}
    texts |= {100 + i: " ".join(f"v{made.randrange(10**6)}" for _ in range(50)) for i in range(5)}
    # One bit apart by chance at most: their own fingerprints, far from alike.
    asked, compared = [], []
    link, links = near_dups.fingerprint_links, copies.Texts.links

    def pivots(fps):
        out = link(fps)
        asked.append(({r.fp for r in fps.collect()}, {tuple(sorted((r.a, r.b))) for r in out.collect()}))
        return out

    def exact(self, pairs):
        compared.append({frozenset((r.a, r.b)) for r in pairs.collect()})
        return links(self, pairs)

    monkeypatch.setattr(near_dups, "fingerprint_links", pivots)
    monkeypatch.setattr(copies.Texts, "links", exact)
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in texts.items()], DOCS)
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {0, *range(100, 105)}
    fps = {near_dups.fingerprint_of(t, 5) for t in texts.values()}
    assert asked[0][0] == fps
    near = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= near_dups.RADIUS}
    assert near and {x for pair in near for x in pair} == {x for pair in asked[0][1] for x in pair}
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", text_hash("text").alias("h")).collect()}
    by_fp = {}
    for i in sorted(texts):
        by_fp.setdefault(near_dups.fingerprint_of(texts[i], 5), set()).add(hashed[i])
    # All texts of near fingerprints were compared, before any others were.
    assert {h for fp in {x for pair in near for x in pair} for h in by_fp[fp]} <= {h for pair in compared[0] for h in pair}
