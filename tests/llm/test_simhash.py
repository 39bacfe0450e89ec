import random

from keyweave.llm.components import components
from keyweave.llm.simhash_dedup import fingerprint, hex_fingerprint, keep_first, near_duplicates, near_links
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in nodes}


def test_against_brute_force(frame, documents):
    prints = {}
    for i, t in documents:
        prints.setdefault(i, plain_fingerprint(t))
    of = groups({p for p in prints.values()}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints.items():
        if i is not None:
            least[of[p]] = min(least.get(of[p], i), i)
    found = near_duplicates(frame).select("id", hex_fingerprint(F.col("fp")).alias("x"), "component").collect()
    assert len(found) == len(documents)
    assert sorted((r.id if r.id is not None else -1, r.x, r.component) for r in found) == sorted((i if i is not None else -1, f"{plain_fingerprint(t):016x}", least.get(of[plain_fingerprint(t)])) for i, t in documents)


def test_links_find_every_pair_within_two_bits(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:20]:
        for bits in (1, 2, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    prints += [0, (1 << 64) - 1, 1 << 63, 3 << 62]
    prints = sorted(set(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    of = groups({signed(p) for p in prints}, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    links = near_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    assert links.where("bit_count(u ^ v) > 2").isEmpty()
    roots = {r.node: r.root for r in components(links).collect()}
    assert {x: roots.get(x, x) for x in of} == of


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    random.Random(3).shuffle(chain)
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[500 + i] == 500 for i in range(50))


def test_one_of_each_group_stays(frame, no_rows):
    found = near_duplicates(frame).collect()
    gone = {r.id for r in found if r.id is not None and r.id != r.component}
    kept = keep_first(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r.id for r in found} - gone
    assert keep_first(no_rows).count() == near_duplicates(no_rows).count() == 0


def test_pages_of_a_long_text(monkeypatch):
    text = " ".join(map(str, range(1000)))
    whole = fingerprint(text.encode())
    monkeypatch.setattr("keyweave.llm.simhash_dedup.PAGE", 7)
    assert fingerprint(text.encode()) == whole and whole & ((1 << 64) - 1) == plain_fingerprint(text)
