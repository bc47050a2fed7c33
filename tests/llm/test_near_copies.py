"""Near copies among strangers in crowded variants, and of short texts."""

import random

import xxhash
from pyspark.sql import functions as F

from vaksetu.llm import simhash


def grams(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def labels_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = simhash.near_copies(docs).join(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")), "key")
    return {r.doc_id: r.component for r in classes.collect()}


def test_pairs_between_the_hubs_of_a_crowd(spark):
    """Two copies between strangers on either side, all at one variant: hubs alone never compare them."""
    met = spark.createDataFrame([(i, 7, 1, 9, True) for i in (1, 4, 5, 9)], "id long, variant long, low long, high long, crowded boolean")
    none = spark.createDataFrame([], "node long, label long")
    assert (4, 5) not in {tuple(r) for r in simhash._with_hubs(met).collect()}
    seeds = met.selectExpr("id", "true AS long", "variant AS seed")
    assert {r.id for r in simhash._left_in_crowds(seeds, none).collect()} == {1, 4, 5, 9}
    same = spark.createDataFrame([(4, 1), (5, 1), (9, 1)], "node long, label long")
    assert simhash._left_in_crowds(seeds, same).count() == 0
    sets = [(1, 1, list(range(100, 200))), (4, 4, list(range(20))), (5, 5, list(range(1, 20))), (9, 9, list(range(60, 80)))]
    left = spark.createDataFrame(sets, "id long, id_label long, grams array<long>")
    assert {tuple(r) for r in simhash._by_rare_shingles(left).collect()} == {(4, 5)}


def test_prefix_filters_miss_no_pair(spark):
    """Families of sets around a similarity of 0.8, with a common part that all of them share."""
    rng = random.Random(17)
    sets = []
    for family in range(12):
        core = rng.sample(range(family * 1000, family * 1000 + 400), rng.randint(10, 80))
        for _ in range(12):
            own = [g for g in core if rng.random() < 0.95] + rng.sample(range(10**6), rng.randint(0, len(core) // 5)) + list(range(-8, 0))
            sets.append((len(sets), len(sets), sorted(set(own))))
    got = {tuple(r) for r in simhash._by_rare_shingles(spark.createDataFrame(sets, "id long, id_label long, grams array<long>")).collect()}
    own = [set(g) for _, _, g in sets]
    want = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b])}
    assert len(want) > 50 and want <= got


def test_classes_of_the_documents(spark):
    """All near copies of the test documents, against all pairs of those that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    label = labels_of(spark, rows)
    sets, at, parent = {}, {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for g in sets[i]:
            at.setdefault(g, []).append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(x, y) for ids in at.values() for k, x in enumerate(ids) for y in ids[k + 1 :]}:
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    ours = {}
    for i, _ in rows:
        ours.setdefault(label[i], []).append(i)
    theirs = {}
    for i, _ in rows:
        theirs.setdefault(root(i), []).append(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_copies_in_a_crowd_of_blocks(spark, monkeypatch):
    """Narrow blocks draw many strangers to each variant; copies meet and must be found all the same."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(20_000)}" for _ in range(200)]
        other = list(words)
        for at in (40, 120, 160):
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    label = labels_of(spark, rows)
    assert [label[2 * i] == label[2 * i + 1] for i in range(60)] == [True] * 60
    assert len(set(label.values())) == 60


def test_short_texts_are_exact(spark):
    """Pairs of 5 to 60 words that share four fifths of their shingles or a little less, with and without a common line."""
    rng = random.Random(13)
    rows, line = [], " ".join(f"common{k}" for k in range(8))
    for i in range(300):
        words = [f"w{rng.randrange(20_000)}" for _ in range(rng.randint(5, 60))]
        cut = rng.randint(1, max(1, len(words) // 2))
        other = words + [f"x{rng.randrange(20_000)}" for _ in range(cut)]
        head = f"{line} " if i % 3 == 0 else ""
        rows += [(2 * i, head + " ".join(words)), (2 * i + 1, head + " ".join(other))]
    rows.append((600, " ".join(f"e{k}" for k in range(8))))
    rows.append((601, rows[-1][1] + " more"))  # 4 of 5 shingles
    sets = {i: grams(t) for i, t in rows}
    label = labels_of(spark, rows)
    want = [10 * len(sets[i] & sets[i + 1]) >= 8 * len(sets[i] | sets[i + 1]) for i in range(0, 602, 2)]
    assert 60 < sum(want) < 280
    assert [label[i] == label[i + 1] for i in range(0, 602, 2)] == want


def test_a_crowd_lists_few_pairs_first(spark):
    """Members that meet at very many variants, each with hubs of its own there, are not all joined with all those hubs at the start."""
    rng = random.Random(6)
    ball = [(i, 100 if i < 250 else 50, v) for i in range(300) for v in rng.sample(range(9000), 150)]
    met = simhash._meetings(spark.createDataFrame(ball, "id long, n long, variant long"))
    pairs = simhash._pairs(met).cache()
    most = {tuple(r) for r in simhash._most_met(pairs).collect()}
    assert pairs.count() > 300 * (simhash.OFTEN + 1) >= len(most) and most <= {(r.a, r.b) for r in pairs.collect()}
    assert not any((r.a < 250) != (r.b < 250) for r in pairs.collect())  # sets of 50 and 100 cannot be similar
    met_by = {}
    for r in pairs.collect():
        met_by.setdefault(r.a, []).append(r)
    for a, rows in met_by.items():
        best = max(r.meets for r in rows)
        assert any((a, r.b) in most for r in rows if r.meets == best)


def family(rng, members, least, most):
    """Texts of 150 words with words of a common original left out, so that many members have some changes in common."""
    words = [f"w{rng.randrange(20_000)}" for _ in range(150)]
    texts = []
    for _ in range(members):
        gone = set(rng.sample(range(150), rng.randint(least, most)))
        texts.append(" ".join(w for k, w in enumerate(words) if k not in gone))
    return texts


def test_a_family_of_unlike_copies_compares_few_pairs(spark, monkeypatch):
    """What is compared grows with the members of a family, not with their pairs, and the classes are those of all pairs."""
    similar, compared = simhash._similar, []

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(simhash, "_similar", counted)
    texts = list(dict.fromkeys(family(random.Random(3), 400, 3, 12)))
    label = labels_of(spark, list(enumerate(texts)))
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    alike = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for a, b in alike:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    by = lambda of: sorted(sorted(i for i in range(len(texts)) if of(i) == c) for c in {of(i) for i in range(len(texts))})
    assert by(lambda i: label[i]) == by(root) and 20 < len({root(i) for i in range(len(texts))}) < 380
    assert sum(compared) < 15 * len(texts)


def test_parities_leave_pairs_that_may_be_similar(spark):
    """Members of a family with changes in common share rare shingles; hardly any but the similar pairs are listed, and of those each one."""
    hashes = lambda t: sorted(xxhash.xxh64_intdigest(" ".join(g), 42) - 2**63 for g in grams(t))
    sets = [hashes(t) for t in family(random.Random(4), 200, 1, 10)]
    rows = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "id long, id_label long, grams array<long>")
    got = {tuple(r) for r in simhash._by_rare_shingles(rows).collect()}
    own = [set(s) for s in sets]
    want = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b])}
    assert len(want) > 100 and want <= got and len(got) < 1.5 * len(want)
