"""Near copies of one text are not paired all with all, and components come the same way for few and many links."""

import random

import pytest

from strandline.llm import common, similar


def test_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Of 150 near copies each was paired with each (11,175 rows) before the first ones were compared."""
    draw, made = random.Random(4), {}
    base = [f"w{n}" for n in range(160)]
    texts = []
    for _ in range(150):
        new = list(base)
        for _ in range(draw.randint(1, 5)):
            new[draw.randrange(len(new))] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(new))
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").repartition(4)
    store = similar.stored

    def counted(frame, name):
        table = store(frame, name)
        if {"a", "b"} <= set(table.columns):
            made[name] = max(made.get(name, 0), table.count())
        return table

    monkeypatch.setattr(similar, "stored", counted)
    links = [tuple(r) for r in similar.similar_links(rows, connecting=True).collect()]
    sets = [similar.shingles(text) for text in texts]
    want = [(a, b) for a in range(150) for b in range(a) if 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))]
    assert len(want) > 2_000 and groups(links) == groups(want)
    assert max(made.values()) < 8 * len(texts)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_few_and_many_links(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    draw = random.Random(3)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(130)] + [(n, n + 1) for n in range(300, 340)]
    found = common.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.component for r in found} == groups([link for link in links if link[0] != link[1]])


def groups(links: list[tuple[int, int]]) -> dict[int, int]:
    label = {node: node for link in links for node in link}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label
