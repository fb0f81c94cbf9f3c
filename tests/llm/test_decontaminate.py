import random

import numpy as np

from jestframe.llm import decontaminate as D

DOCS = "doc_id long, text string, matches string"


def by_rule(docs, items, threshold=0.8):
    """Every window of every item's size against the item."""
    found = set()
    for i, text in docs:
        words = D.words_of(text)
        for k, item in items:
            own = D.words_of(item)
            size = min(len(own), len(words))
            if own and words:
                y = D.shingle_weights(own, 5)
                if any(D.similarity(D.shingle_weights(words[s:s + size], 5), y) >= threshold for s in range(len(words) - size + 1)):
                    found.add((i, k))
    return found


def run(spark, docs, items, **more):
    out = D.contaminated(spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string"), **more)
    return {(r.doc_id, m.item_id) for r in out.collect() for m in r.matches}, out.count()


def test_against_every_window(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([3, 5, 8, 15, 15, 24, 40, 57, 57, 60])]
    docs = [(i, " ".join(say(rng.randint(0, 200)))) for i in range(30)]
    for i in range(60):
        item = D.words_of(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            item[rng.choice([0, len(item) - 1, rng.randrange(len(item))])] = rng.choice(vocab)
        docs.append((100 + i, " ".join(say(rng.randint(0, 60)) + item[rng.choice([0, 0, 1]):] + say(rng.randint(0, 60))).upper() + "!"))
    docs += [(500, None), (501, ""), (502, "w1"), (100, docs[30][1]), (503, " ".join(say(8000)) + " " + items[7][1])]
    want = by_rule(docs, items)
    assert len(want) > 30
    assert run(spark, docs, items)[0] == want
    assert run(spark, docs, items, slice_items=3)[0] == want  # several passes


def test_nulls_and_empty(spark):
    items = [(1, None), (2, ""), (None, "some words of an item that has no id at all"), (3, "!!")]
    docs = [(1, "x some words of an item that has no id at all y"), (2, "nothing"), (None, "")]
    assert run(spark, docs, items) == ({(1, None)}, 3)
    assert run(spark, docs, []) == (set(), 3)
    assert run(spark, [], items) == (set(), 0)


def test_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    own = rng.integers(1 << 63, size=40, dtype=np.uint64)
    index = D.ItemIndex([], 5)
    tables = np.zeros((4, 1 << 16), bool)
    for k, block in enumerate(own.view(np.uint16).reshape(-1, 4).T):
        tables[k, (block[:, None] ^ D.FLIPS).ravel()] = True
    index.sizes[9] = (own, tables, [])
    prints = own[rng.integers(40, size=3000)]
    for i, n in enumerate(rng.integers(0, 14, size=3000)):
        for bit in rng.choice(64, size=n, replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(bit)
    want = {(i, k) for i in range(len(prints)) for k in range(40) if bin(int(prints[i] ^ own[k])).count("1") <= D.RADIUS}
    assert set(index.near(prints, 9)) == want


def test_edited_short_items_against_every_window():
    """Edited copies over the threshold, many of them beyond the radius, are all found."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    items = [(k, [rng.choice(vocab) for _ in range(rng.randint(15, 30))]) for k in range(30)]
    index, docs, far, alone = D.ItemIndex(items, 5), [], 0, 0
    for i in range(700):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randint(1, 2)):
            item[rng.choice([0, 0, 1, len(item) - 1, len(item) - 1, rng.randrange(len(item))])] = rng.choice(vocab)
        docs.append((i, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 9))] + item + [rng.choice(vocab) for _ in range(rng.randint(0, 9))])))
    want = by_rule(docs, [(k, " ".join(w)) for k, w in items])
    assert {(i, m["item_id"]) for i, t in docs for m in index.matches(t, 0.8)} == want and len(want) > 200
    for i, k in want:
        words, own = D.words_of(docs[i][1]), items[k][1]
        prints = [D.fingerprints(D.hashed(w), np.array([len(x) for x in w]), np.zeros(1, np.int64), len(own))[0] for w in [own, *(words[s:s + len(own)] for s in range(len(words) - len(own) + 1))]]
        alone += any(m["item_id"] == k for m in index.matches(docs[i][1], 0.8, complete=False))
        far += min(int(np.bitwise_count(p ^ prints[0])) for p in prints[1:]) > D.RADIUS
    assert far and alone >= 0.9 * len(want)  # the Hamming search alone
