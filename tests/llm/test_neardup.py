"""Near duplicates in crowded buckets against all pairs."""

import random

import pytest
from gazette.llm import neardup

COLUMNS = "doc_id bigint, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def smallest(texts):
    """The smallest id of each text's component, by comparing all pairs."""
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= neardup.PERCENT * (len(a) + len(sets[j]) - both) and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def wrong(spark, texts, parts=1):
    """How many documents have another component than by comparing all pairs."""
    want = smallest(texts)
    rows = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), COLUMNS).repartition(parts, "doc_id")).collect()
    assert len(rows) == len(texts)
    return sum(r.component_id != want[r.doc_id] for r in rows)


@pytest.fixture(params=[1000, 40])
def block(request, monkeypatch):
    """With 40, shingles of the template are dealt in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", request.param, raising=False)


def test_pairs_among_templates(spark, block):
    rng = random.Random(1)
    template = words(rng, 100)
    texts = [" ".join(template + words(rng, 14)) for _ in range(1000)]  # of similarity 0.78
    for i in range(0, 1000, 50):
        texts.append(" ".join(texts[i].split()[:102] + words(rng, 12)))  # of similarity 0.81 to text i
    rng.shuffle(texts)
    assert len(set(smallest(texts))) == 1000
    assert wrong(spark, texts) == 0


def test_pairs_among_other_sizes(spark):
    rng = random.Random(2)
    text = words(rng, 500)
    texts = [" ".join(text[:150] + words(rng, 3) + text[153:]) for _ in range(300)]
    for part in (375, 380):  # excerpts of under 0.8 of the others' size
        mine = text[500 - part :]
        texts.append(" ".join(mine))
    rng.shuffle(texts)
    assert len(set(smallest(texts))) == 2
    assert wrong(spark, texts) == 0


def test_links_to_one_member_of_a_component(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        text = words(rng, 1600)
        chain = [text[a : a + 400] for a in range(0, 1200, 20)]
        texts += [" ".join(c) for c in chain]
        for c in chain[::6]:  # similar to the chain's c alone
            at = rng.sample(range(5, 395, 5), 21)
            texts.append(" ".join("x%d" % rng.randrange(10**6) if i in at else w for i, w in enumerate(c)))
    rng.shuffle(texts)
    assert len(set(smallest(texts))) == 6
    assert wrong(spark, texts, 8) == 0


@pytest.mark.parametrize("own", [14, 25])
def test_rows_grow_with_the_number_of_template_documents(spark, own):
    """Of n documents of one template, of similarity 0.78 or 0.65, the rows and pairs of the second look grow no faster than n."""
    sizes = []
    for n in (500, 2000):
        rng = random.Random(n)
        template = words(rng, 100)
        texts = [" ".join(template + words(rng, own)) for _ in range(n)]
        keyed = spark.createDataFrame(list(enumerate(texts)), "_k bigint, text string")
        rows = neardup.between_groups(neardup.grouped(neardup.prefixes(keyed, keyed.select("_k"), 2), None))
        sizes.append((rows.count(), neardup.cells(rows).count(), neardup.cell_pairs(rows, neardup.features(keyed), True).count()))
    assert all(large <= 5 * small + 100 for small, large in zip(*sizes))


def test_prefixes_of_similar_sets_share_a_shingle():
    import numpy as np

    rng = np.random.default_rng(5)
    universe = rng.integers(0, 1 << 63, 400, np.uint64)
    common = (np.sort(universe[:50]), rng.integers(8, 99, 50))
    for _ in range(3000):
        size = int(rng.integers(1, 60))
        one = np.unique(rng.choice(universe, size))
        two = np.unique(np.concatenate([one[: int(rng.integers(0, len(one) + 1))], rng.choice(universe, int(rng.integers(0, 12)))]))
        small, large = sorted((one, two), key=len)
        both = len(np.intersect1d(small, large))
        if len(small) and 100 * both >= neardup.PERCENT * (len(small) + len(large) - both):
            a, short = neardup.prefix(small, common)
            assert np.isin(a[:short], neardup.prefix(large, common)[0]).any()
