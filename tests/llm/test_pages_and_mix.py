"""WARC archives, source mixing and the pipeline."""

import base64
import hashlib
from collections import defaultdict

import duckdb
import pytest
from conftest import SF
from test_similar import reached, slow_pairs
from odd_rows import none, odd  # noqa: F401
from oracle import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontaminate, mixing, queries, simhash, toxicity, warc
from strandline.sources.shared import shared_folder

PAGES = [
    (1, "http://a/x y\r\nz", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""),
    (5, "http://e", "WARC/1.0\r\n\r\n\r\n"), (5, "http://e", "WARC/1.0\r\n\r\n\r\n"), (None, "http://n", "<p>é</p>"),
    (None, "http://n", "alone"), (6, "http://f", "z" * 3_000_000), (5, "http://e", "another"),
]


def want_records(pages):
    first = {}
    for page_id, _, html in pages:
        ids = first.setdefault(html or "", [])
        if page_id is not None:
            ids.append(page_id)
    want = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        target = min(first[html or ""], default=None)
        refers = None if target is None or target == page_id else target
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page_id, len(payload), digest, "response" if refers is None else "revisit", refers))
    return sorted(want, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_archives(spark, monkeypatch):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, archive string").repartition(3)
    index = warc.write_archives(pages, shared_folder(spark, "archives"))
    assert rows_of(index) == want_records(PAGES) == rows_of(warc.read_records(index))
    payloads = {(r.page_id, bytes(r.payload).decode()) for r in warc.read_records(index, with_payload=True).collect() if r.payload is not None}
    assert payloads == {(i, h or "") for i, _, h in PAGES} - {(2, "<p>é</p>"), (None, "<p>é</p>"), (4, "")}
    monkeypatch.setattr(warc, "RANGE_BYTES", 500)
    monkeypatch.setattr(warc, "TASK_BYTES", 300)
    spread = warc.read_records(index)
    assert rows_of(spread) == want_records(PAGES)
    assert spread.rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.agg({"length": "sum"}).first()[0] // 300))
    some = index.filter("page_id = 6")
    assert [r.url for r in warc.read_records(some).collect()] == ["http://f"]
    assert warc.read_records(index.filter("page_id = 1")).first().url == "http://a/x%20y%0D%0Az"


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    index = warc.write_archives(pages, shared_folder(spark, "archives"), min_revisit_bytes=10)
    assert index.filter("record_type = 'revisit'").count() == 0


def test_archives_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_and_read(empty).count() == 0


def test_archive_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert rows_of(queries.op5_warc_archives(spark, SF)) == want_records(pages)


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 50, 5), ("b", 55, 100)]
    assert list(warc.coalesce_ranges(iter(rows), 30, 50)) == [
        ("a", 0, [(0, 10), (10, 5), (40, 5)]), ("b", 50, [(50, 5)]), ("b", 55, [(55, 100)])
    ]
    assert list(warc.coalesce_ranges(iter(rows[:3]), 5, 50)) == [("a", 0, [(0, 10), (10, 5)]), ("a", 40, [(40, 5)])]
    assert list(warc.coalesce_ranges(iter([]), 5, 50)) == []


def test_mix_twin(spark):
    name = "op1_mix_sources"
    assert differences(queries.CATALOG.queries[name](spark, SF), connect(SF), queries.CATALOG.sql[name]) == []


def slow_split(budget, children):
    """children: name -> (capacity, weight). Level by level, with whole numbers."""
    share, open_ = {}, dict(children)
    while open_:
        weights = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * weights <= budget * w]
        if not full:
            return share | {n: budget * w // weights for n, (_, w) in open_.items()}
        least = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        share[least] = open_.pop(least)[0]
        budget -= share[least]
    return share


def test_budgets(spark):
    nodes = [("p", "a", 100, 1, 1000), ("p", "b", 900, 1, 1000), ("p", "c", 900, 2, 1000), ("q", "a", 5, 7, 100), ("q", "b", 9, 1, 100)]
    frame = spark.createDataFrame(nodes, "parent string, node string, capacity bigint, weight bigint, budget bigint")
    got = {(r.parent, r.node): r.share for r in mixing.split_budget(frame, ["parent"], "node").collect()}
    assert got == {("p", "a"): 100, ("p", "b"): 300, ("p", "c"): 600, ("q", "a"): 5, ("q", "b"): 9}
    assert slow_split(1000, {"a": (100, 1), "b": (900, 1), "c": (900, 2)}) == {"a": 100, "b": 300, "c": 600}


@pytest.mark.parametrize("budget", ["total div 2", "total * 3", "cast(0 as bigint)", "cast(700 as bigint)"])
def test_mix_of_odd_rows(odd, none, budget):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": {"en": 3}, "source": {"src5": 2}}
    got = mixing.mix(odd, levels, weights, F.expr(budget), max_epochs=2, seed=1).collect()
    tokens, tree = defaultdict(int), {}
    for r in odd.collect():
        n = len((r.text or "").encode().split())
        if n:
            tokens[r.lang or "-", r.source or "-"] += n
    total = sum(tokens.values())
    whole = {"total div 2": total // 2, "total * 3": 2 * total}.get(budget, 700 if "700" in budget else 0)
    langs = {lang for lang, _ in tokens}
    capacity = lambda lang: 2 * sum(n for (a, _), n in tokens.items() if a == lang)
    shares = slow_split(whole, {lang: (capacity(lang), 3 if lang == "en" else 1) for lang in langs})
    for lang in langs:
        leaves = {s: (2 * n, 2 if s == "src5" else 1) for (a, s), n in tokens.items() if a == lang}
        tree |= {(lang, s): n for s, n in slow_split(shares[lang], leaves).items()}
    taken = defaultdict(int)
    for r in got:
        taken[r.lang, r.source] += r.take_tokens
        assert 0 < r.take_tokens <= r.n_tokens and 0 <= r.epoch < 2
    assert dict(taken) == {leaf: n for leaf, n in tree.items() if n}
    assert sum(r.take_tokens < r.n_tokens for r in got) <= len(tree)
    assert mixing.mix(none, levels, weights, F.expr(budget)).count() == 0


def test_weights_and_prefix(spark):
    with pytest.raises(ValueError):
        mixing.node_weight("lang", {"en": 0})
    row = spark.createDataFrame([(" a\tb  c ", 2)], "text string, n bigint").select(mixing.token_prefix(F.col("text"), F.col("n")).alias("p"))
    assert row.first().p == "a b"


def test_pipeline(spark, monkeypatch):
    """Each stage against brute force on what its predecessor kept."""
    kept, seen = {}, {"documents": spark.read.parquet(f"{SF}/documents.parquet")}

    def remember(frame, name):
        kept[name] = frame.cache()
        return kept[name]

    monkeypatch.setattr(corpus_pipeline, "stored", remember)
    result = corpus_pipeline.run(spark, SF)
    columns = seen["documents"].columns
    names = [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]]
    frames = [seen["documents"], *[kept[name] for name in names]]
    assert all(frame.columns == columns for frame in frames)
    ids = [[r.doc_id for r in frame.collect()] for frame in frames]
    texts = {r.doc_id: r.text or "" for r in frames[0].collect()}
    assert all(len(a) >= len(b) > 50 for a, b in zip(ids, ids[1:])) and len(ids) == 5

    lexicon = toxicity.learn(frames[0], queries.table(spark, SF, "labels"))
    measure = toxicity._linear(lexicon)
    assert set(ids[1]) == {i for i in ids[0] if measure(texts[i]) < 0}

    groups = defaultdict(list)
    for i in ids[1]:
        groups["".join(texts[i].split())].append(i)
    assert set(ids[2]) == {min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values()}

    near = {i: texts[i] for i in sorted(ids[2])}
    assert set(ids[3]) == {list(near)[n] for n in reached(near, slow_pairs(near)).values()}

    items = [b" ".join(decontaminate.words(r.text)) for r in queries.table(spark, SF, "benchmark").collect()]
    assert set(ids[4]) == {i for i in ids[3] if not any(item in b" ".join(decontaminate.words(texts[i])) for item in items)}

    con = duckdb.connect()
    con.register("last", frames[4].toPandas())
    assert differences(result, con, queries.mix_sql("last")) == []


def test_pipeline_of_nothing(spark, none):
    """Without documents no stage has anything to do."""
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
