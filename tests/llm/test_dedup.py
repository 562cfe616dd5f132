"""Exact duplicates, SimHash groups and repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF
from odd_rows import none, odd  # noqa: F401
from oracle import connect, differences

from strandline.llm import exact_dedup, simhash, suffix_array, suffix_dedup
from strandline.llm.common import components

SPACE = " \t\n\x0b\x0c\r"


def pairs_of(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=lambda row: tuple((v is not None, str(v)) for v in row))


def by_id(i):
    return (i is not None, i or 0)


def test_exact_groups(odd):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(c for c in text if c not in SPACE)].append((doc_id, text))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), by_id(m[0])))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        want += [(doc_id, keep, len(members), doc_id == keep, digest) for doc_id, _ in members]
    got = exact_dedup.exact_groups(odd)
    assert pairs_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(
        want, key=lambda row: tuple((v is not None, str(v)) for v in row)
    )


def test_exact_of_nothing(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).columns == none.columns


def test_exact_documents_keep_their_columns(odd):
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    texts = ["".join(c for c in r.text or "" if c not in SPACE) for r in kept.collect()]
    assert len(set(texts)) == len({"".join(c for c in r.text or "" if c not in SPACE) for r in odd.collect()})


def test_chunks_make_the_text(odd):
    norm = exact_dedup.without_white_space(exact_dedup.text_or_empty())
    rows = odd.select(norm.alias("norm"), exact_dedup.chunks(norm).alias("chunks")).collect()
    assert all("".join(r.chunks) == r.norm and all(len(c) <= 2000 for c in r.chunks) for r in rows)


@pytest.mark.parametrize("listed", [0, 1, 10_000])
def test_ambiguous_identifiers(odd, monkeypatch, listed):
    """Whatever identifiers are held to be ambiguous, the groups are the same."""
    want = pairs_of(exact_dedup.exact_groups(odd), "doc_id", "keep_id", "group_size")
    some = exact_dedup.recipes(odd).selectExpr("explode(recipe) as id").distinct().limit(3)
    monkeypatch.setattr(exact_dedup, "ambiguous_ids", lambda documents: some)
    monkeypatch.setattr(exact_dedup, "MAX_LISTED", listed)
    assert pairs_of(exact_dedup.exact_groups(odd), "doc_id", "keep_id", "group_size") == want


def slow_fingerprint(text: str) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in SPACE:
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(prints: dict[int, int]) -> dict[int, int]:
    label = {i: i for i in prints}
    values = np.array(list(prints.values()), np.uint64)
    ids = np.array(list(prints))
    changed = True
    links = [(a, ids[np.bitwise_count(values ^ v) <= 3]) for a, v in zip(ids, values)]
    while changed:
        changed = False
        for a, near in links:
            least = min(label[b] for b in near)
            if least < label[a]:
                label[a], changed = least, True
    return label


def test_near_groups(odd, spark):
    """Rows without an id link like others; their component has an id if a row in it has one."""
    alone = [(None, "no other row has these words at all", None), (None, "No other row has these words at ALL", None)]
    alone += [(None, "nor has any row what stands in this one", None), (9_000, "nor has any row what stands in this one", None)]
    more = odd.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in alone], "doc_id bigint, text string"))
    rows = [(r.doc_id, r.text or "") for r in more.collect()]
    prints = {n: slow_fingerprint(text) for n, (_, text) in enumerate(rows)}
    label, least = slow_components(prints), {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[label[n]] = min(least.get(label[n], doc_id), doc_id)
    want = sorted(((i, f"{prints[n]:016x}", least.get(label[n])) for n, (i, _) in enumerate(rows)), key=str)
    got = simhash.near_groups(more).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(component is None for _, _, component in want) == 2 and (None, f"{prints[len(rows) - 2]:016x}", 9_000) in want
    label = {i: c for i, _, c in want if i not in (None, 9_000)}  # odd has no 9,000
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {*label.values(), None}


def test_near_groups_of_nothing(none):
    assert simhash.near_groups(none).count() == 0
    assert simhash.keep_one_of_each(none).count() == 0


def test_links_of_close_prints(spark):
    """All pairs within three bits, wherever the bits are."""
    draw = random.Random(9)
    centre = [draw.getrandbits(64) for _ in range(12)]
    values = {c ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 4))}) for c in centre for _ in range(25)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in simhash.print_links(spark.createDataFrame([(v,) for v in signed], "print bigint")).collect()}
    assert got == {(a, b) for n, a in enumerate(signed) for b in signed[n + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


@pytest.mark.parametrize("crowd", [0, 2, 8])
def test_links_of_crowded_halves(spark, crowd):
    """Fewer links, all of them true, and the same components."""
    draw = random.Random(21)
    centre = [draw.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 5))}) for c in centre for _ in range(40)})
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    prints = spark.createDataFrame([(v,) for v in signed.values()], "print bigint")
    found = {(r.a % 2**64, r.b % 2**64) for r in simhash.print_links(prints, crowd).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    want = slow_components(dict(enumerate(values)))  # in sorted order, so the least number is the least value

    def reach(links):
        label = {v: v for v in values}
        for _ in values:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert reach(found) == {values[k]: values[v] for k, v in want.items()}


def test_components(spark):
    """Chains, stars and single links, in any order."""
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(7, n) for n in range(8, 40)] + [(500, 501), (501, 500), (9, 9)]
    draw.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()))
    assert got == {**dict.fromkeys(range(1000, 1061), 1000), **dict.fromkeys(range(7, 40), 7), 500: 500, 501: 500}


def slow_repeats(rows: list[tuple]) -> list[tuple]:
    first: dict[bytes, tuple] = {}
    texts = [(by_id(i), i, (text or "").encode()) for i, text in rows]
    for key, _, data in texts:
        for s in range(len(data) - 99):
            window = data[s : s + 100]
            first[window] = min(first.get(window, (key, s)), (key, s))
    found = []
    for key, i, data in texts:
        cover = bytearray(len(data))
        for s in range(len(data) - 99):
            if first[data[s : s + 100]] < (key, s):
                cover[s : s + 100] = b"\1" * 100
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        kept = hashlib.sha256(bytes(b for b, c in zip(data, cover) if not c)).hexdigest()
        found.append((i, len(data), sum(cover), spans, kept))
    return found


@pytest.mark.parametrize("hot, array_bytes, shard_bytes", [(2000, 1 << 20, None), (2, 1 << 20, 20_000), (2000, 2000, 20_000)])
def test_repeats(odd, hot, array_bytes, shard_bytes):
    want = slow_repeats([(r.doc_id, r.text) for r in odd.collect()])
    got = suffix_dedup.remove_repeats(odd, hot, array_bytes, shard_bytes)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert pairs_of(got, *columns) == sorted(want, key=lambda row: tuple((v is not None, str(v)) for v in row))
    assert sum(row[2] for row in want) > 100_000


def test_repeats_in_a_long_text(spark):
    """A text of several blocks, and a copy of part of it."""
    draw = random.Random(8)
    text = "".join(draw.choices("ab cd", k=2_100_000))
    other = "start" + text[990_000:1_010_000] + "end"
    rows = spark.createDataFrame([(1, text), (2, other)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(rows).collect()}
    assert got == {1: (0, 0), 2: (20_000, 1)}


def test_repeats_of_nothing(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("size, letters", [(0, 2), (1, 2), (60, 1), (2500, 2), (2500, 5)])
def test_suffix_array(size, letters):
    text = np.random.default_rng(size).integers(0, letters, size)
    text[size // 4 : size // 3] = text[size // 2 : size // 2 + len(text[size // 4 : size // 3])]
    data = bytes(text.astype(np.uint8))
    order = suffix_array.suffix_array(text)
    assert order.tolist() == sorted(range(size), key=lambda i: data[i:])
    shared = suffix_array.common_prefixes(text, order, 30) if size else []
    for i in range(1, size):
        a, b = data[order[i - 1] :][:30], data[order[i] :][:30]
        assert shared[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_search():
    text = np.frombuffer(random.Random(2).randbytes(3000) * 2, np.uint8)
    rows = suffix_array.windows(text, np.arange(3000), 20)
    order = np.lexsort(rows.T[::-1])
    assert order[suffix_array.search(rows[order], rows)].tolist() == list(range(3000))
    assert (suffix_array.search(rows[order], rows + np.uint64(1)) < 0).sum() > 2900


def test_exact_twin(spark):
    from strandline.llm import queries

    name = "op9_exact_duplicates"
    assert differences(queries.CATALOG.queries[name](spark, SF), connect(SF), queries.CATALOG.sql[name]) == []
