"""Near duplicates: what large groups and repeated rows cost, and that no link is lost in them."""

import random

import pytest

from uptake.llm import near_duplicates


@pytest.fixture
def tasks(monkeypatch):
    """(rows of all tasks, rows of the largest) of every step that meets rows."""
    seen, before = [], near_duplicates._links

    def counted(members, load, compare):
        def loaded(rows):
            full = load(rows)
            n = [r[0] for r in full.groupBy("centre", "i", "j").count().select("count").collect()]
            seen.append((sum(n), max(n, default=0)))
            return full
        return before(members, loaded, compare)
    monkeypatch.setattr(near_duplicates, "_links", counted)
    return seen


def edited(count, edits, seed=1, length=40):
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    texts = []
    for i in range(count):
        words = list(base)
        for _ in range(edits):
            words[draw.randrange(length)] = f"x{draw.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    return texts


def classes(spark, texts, size=2):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, size=size).collect()}


def brute(texts, size=2):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)})
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: top(i) for i in range(len(texts))}


@pytest.mark.parametrize("edits", [3])
def test_rows_grow_with_the_group_and_not_with_its_square(spark, tasks, edits):
    sums = []
    for count in (2000, 4000):
        tasks.clear()
        classes(spark, edited(count, edits))
        sums.append(sum(n for n, _ in tasks))
        assert max(largest for _, largest in tasks) <= near_duplicates._BLOCK_ROWS + 1
    assert 0 < sums[1] <= 2.2 * sums[0]


@pytest.mark.parametrize("count", [60])
def test_repeated_rows_are_compared_once(spark, tasks, count):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near)] * count + [(2, near + " end")] * count + [(2, "another text of the same id " + near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates.near_duplicates(docs, size=2).collect()
    assert len(found) == 2 * count + 1 and {r.component_id for r in found} == {1}
    assert max(largest for _, largest in tasks) <= 10


@pytest.mark.parametrize("edits,block", [(2, 16), (4, 16), (3, 8192)])
def test_groups_of_several_blocks_against_brute_force(spark, monkeypatch, edits, block):
    """Loose and tight groups, dealt to many blocks: the same classes as all pairs give."""
    monkeypatch.setattr(near_duplicates, "_BLOCK_ROWS", block)
    texts = edited(150, edits, seed=edits) + edited(60, 2, seed=9, length=25) + ["a b", "a b", "a", "", "b a"]
    found, expected = classes(spark, texts), brute(texts)
    expected[len(texts) - 2] = len(texts) - 2
    assert found == expected
    assert len(set(found.values())) < len(texts)


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "_BLOCK_BYTES", 2000)
    texts = edited(80, 2, seed=4)
    assert classes(spark, texts) == brute(texts)
