"""Personal data, toxicity, main text of pages, decontamination, language model scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from odd_rows import none, odd  # noqa: F401

from strandline.llm import decontaminate, dom, html_text, labelled_pages, lm_score, pii, queries, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


TEXTS = [
    "", "a@b.c", "a@b", "@b.c x@y.z@q.r", "..@a-.b. %+-@x.y.z.", "a@b@c.d e@f.g.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0.0.0.0.0",
    "0001.02.3.255", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (980) 555-6268", "+1((((((", "+49 30 1234567.",
    "+1 555 123 4567 +44.20.7946.0958", "x" * 5000 + "@" + "y" * 5000, "1" * 6000 + ".2.3.4", "é" * 10 + "a.b@c.de", "1.2..3.4.5.6",
]


def test_base_spans(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    for text in texts:
        assert pii.base_spans(text) == slow_spans(text), text[:80]


@pytest.mark.parametrize("text, kind, source", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("jane at example dot com", "email", "jane at example dot com"),
    ("(bob (at) mail.example.org)", "email", "bob (at) mail.example.org"),
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("write jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call plus four nine one five two 5 five five 1 two three four", "phone", "plus four nine one five two 5 five five 1 two three four"),
    ("ip 192[.]168[.]1[.]10 is", "ip", "192[.]168[.]1[.]10"),
    ("one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("card 4111‑1111‑1111‑1111", "card", "4111‑1111‑1111‑1111"),
    ("to john.doe {at} example {.} com.", "email", "john.doe {at} example {.} com"),
    ("to john.doe <at> example <.> com,", "email", "john.doe <at> example <.> com"),
    ("to john.doe[＠]example[.]com!", "email", "john.doe[＠]example[.]com"),
    ("to john.doe@example[ . ]com", "email", "john.doe@example[ . ]com"),
    ("john.doe (аt) example (dоt) com", "email", "john.doe (аt) example (dоt) com"),
    ("jo​hn.d​oe (​at) exаmple dоt com", "email", "jo​hn.d​oe (​at) exаmple dоt com"),
    ("call plus four nine one fivе two 5 fіve five 1 two three four", "phone", "plus four nine one fivе two 5 fіve five 1 two three four"),
    ("ip １９２[．]168[.]1（.）10 is", "ip", "１９２[．]168[.]1（.）10"),
])
def test_disguises(text, kind, source):
    added = pii.added_spans(text, pii.base_spans(text))
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, source)]


@pytest.mark.parametrize("text", ["seen at example.com", "we met at noon. Dot com", "one two three", "a@b.cd is a mail", "point at it", "5 at 3.2"])
def test_plain_texts(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_personal_data_rows(odd, none):
    found = pii.find(odd)
    assert found.count() == odd.count() and pii.find(none).count() == 0
    assert {r.base for r in found.filter("doc_id in (120, 121)").collect()} == {""}
    assert pii.mask("x a@b.cd y", [("email", 2, 8)]) == "x [email] y"


def test_personal_data_query(spark):
    rows = {r.doc_id: r for r in queries.op4_personal_data(spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = pii.written(slow_spans(doc.text or ""))
        assert rows[doc.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[doc.doc_id].spans.split(","))


def test_fold():
    assert toxicity.fold("You 1d1ot, mоrоn ＩＤＩＯＴ $cum tr@sh! 2024 p4thetic") == " you idiot moron idiot scum trash 2024 pathetic "
    assert toxicity.fold("") == "  " or toxicity.fold("").strip() == ""
    assert toxicity.fold("id​iot lo$er, l0$er!") == " idiot loser loser "


def test_matches():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " loser ": 3.0, " vequ": 1.5}, (" trash can ",))
    automaton = lexicon.automaton()
    found = lambda text: [w for _, _, w in toxicity.matches(toxicity.fold(text), automaton)]
    assert found("trash in the trash can, trashy") == [2.0]
    assert found("1oser LOSER vequité") == [3.0, 3.0, 1.5]
    assert found("") == [] and toxicity.Lexicon({}).automaton() is not None


def test_toxicity_is_learned(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(documents, labels)
    scored = toxicity.score(documents, lexicon).join(labels.groupBy("doc_id").agg({"toxic": "max"}), "doc_id")
    right = scored.filter("held_out").selectExpr("avg(cast(predicted = `max(toxic)` as int)) as a", "avg(1 - `max(toxic)`) as b").first()
    assert right.a > 0.95 and right.a > right.b
    assert " loser " in lexicon.weights


def test_toxicity_of_odd_rows(odd, none):
    lexicon = toxicity.Lexicon({" one ": 9.0})
    scored = toxicity.score(odd, lexicon).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert {r.predicted for r in scored if r.doc_id in (120, 121, 122)} == {0}
    assert toxicity.score(none, lexicon).count() == 0
    kept = toxicity.keep_clean(odd, lexicon)
    assert kept.columns == odd.columns and {200, 201, 202} & {r.doc_id for r in kept.collect()} == set()


def test_learning_needs_both_labels(spark, odd, none):
    """Without them every text has the same score, below one half."""
    kind = "doc_id bigint, toxic int"
    rows = [(odd, []), (odd, [(n, 1) for n in range(12)]), (odd, [(n, 0) for n in range(12)]), (none, [(1, 1), (2, 0), (None, 1), (4, None)])]
    for documents, labels in rows:
        lexicon = toxicity.learn(documents, spark.createDataFrame(labels, kind))
        assert lexicon.weights == {}
        scored = toxicity.score(odd, lexicon).collect()
        assert len(scored) == odd.count() and len({r.score for r in scored}) == 1 and {r.predicted for r in scored} == {0}


def test_l_written_as_i():
    """However many l a term has; a term that stands there as it is comes first."""
    lexicon = toxicity.Lexicon({" lollalill ": 2.0, " foii ": 5.0, " foll ": 3.0, " foil ": 4.0}, (" a foll ",))
    automaton = lexicon.automaton()
    found = lambda text: [w for _, _, w in toxicity.matches(toxicity.fold(text), automaton)]
    assert found("1o11a1i11") == [2.0] and found("lollalill") == [2.0] and found("loiiaiiii iollaiiil") == [2.0, 2.0]
    assert found("foll") == [3.0] and found("foil") == [4.0] and found("foii fo11") == [5.0, 5.0] and found("fo1l") == [4.0]
    assert found("lollallll foli") == [3.0] and found("a foll") == [] and found("a fo11") == [5.0]


def test_learning_depends_on_rows_only(spark):
    """Against counts and weights computed one text at a time, for several partitionings."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)
    least = {}
    for r in documents.select("doc_id", "text").collect():
        if r.doc_id in known and r.text is not None:
            least[r.doc_id] = min(least.get(r.doc_id, r.text), r.text)
    assert 100 < len(known) <= toxicity.TRAIN_ROWS
    firsts = {}
    for doc_id in sorted(least):
        text = toxicity.fold(least[doc_id])
        firsts.setdefault((known[doc_id], toxicity._sketch(text)), (doc_id, text))
    texts = toxicity.training_texts(documents, labels)
    assert sorted((r.text, r.toxic) for r in texts.collect()) == sorted((text, kind[0]) for kind, (_, text) in firsts.items())
    parts = [(r.text, r.toxic) for r in texts.filter("part < 2").collect()]
    counts = [Counter(), Counter()]
    for text, toxic in parts:
        counts[toxic].update({f" {w} " for w in text.split()} | {f" {w[:n]}" for w in text.split() for n in toxicity.STEM_LETTERS if len(w) > n})
    toxic = sum(t for _, t in parts)
    clean, kept = len(parts) - toxic, {}
    for term in counts[1]:
        a, b = counts[1][term], counts[0][term]
        share = toxic / len(parts)
        ratio = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        if a > (a + b) * share and ratio >= toxicity.MIN_RATIO:
            kept[term] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)), a
    learned = [toxicity.learn(documents.repartition(n), labels.repartition(n)) for n in (1, 3, 7)]
    want = toxicity.best_names(kept)
    assert want and learned[0].weights == pytest.approx(want)
    assert learned[0] == learned[1] == learned[2]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.default_model(spark)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href="/">home</a></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<main><article><h1>A &amp; title</h1><p>First  paragraph\n of <b>some</b> length<br>and more words in it, to be read.<script>x</script></p>
<div class="ad">Buy now</div><p>Second &eacute; one, with an <a href="/l">inner link</a> here, and then some more.<ul><li>Point one is here<li>Point two is there</ul>
</article><section id="comments"><div class="comment"><p>I do not agree with any of this at all, and I have a lot of reasons for it.</p></div></section></main>
<aside class="sidebar"><p>Popular posts of the week</p></aside><form><p>Your mail</p><input></form><footer>&copy; us</footer>"""


def test_main_text(model):
    assert html_text.main_text(PAGE, model).split("\n") == [
        "A & title", "First paragraph of some length and more words in it, to be read.",
        "Second é one, with an inner link here, and then some more.", "Point one is here", "Point two is there",
    ]


def test_held_out_layouts(model):
    """Pages of layouts that were not trained on."""
    right = blocks = 0
    for page in labelled_pages.labelled_pages(150, seed=77):
        nodes, texts = dom.parse(page)
        content, labels = html_text.marginals(nodes, model), [0]
        for node in nodes[1:]:
            labels.append(int(node.attributes.get(labelled_pages.LABEL, labels[node.parent])))
        right += sum((content[n] > 0.5) == labels[n] for n, _ in texts)
        blocks += len(texts)
    assert right / blocks > 0.98


def labelled_text(page):
    nodes, texts = dom.parse(page)
    labels = [0]
    for node in nodes[1:]:
        labels.append(int(node.attributes.get(labelled_pages.LABEL, labels[node.parent])))
    return "\n".join(text for node, text in texts if labels[node])


def test_held_out_pages(model):
    """Page by page, for layouts that were not trained on; pages of other parts alone have no text."""
    pages = labelled_pages.labelled_pages(1_200, seed=77)
    found, want = [html_text.main_text(page, model) for page in pages], [labelled_text(page) for page in pages]
    equal, empty = sum(a == b for a, b in zip(found, want)), sum(not a for a in found)
    assert equal >= 0.98 * len(pages) and empty <= 0.01 * len(pages)
    texts = 0
    for n in range(300):
        draw, make = random.Random(n), labelled_pages
        parts = [make._part(draw.choice(make._HEADERS), 0, make._links(draw)), make._part(draw.choice(make._LINK_LISTS), 0, make._links(draw))]
        parts += [make._junk(draw), make._form(draw), make._comments(draw), make._part(draw.choice(make._FOOTERS), 0, make._words(draw, 2, 30))]
        draw.shuffle(parts)
        texts += html_text.main_text(f"<html><body>{''.join(parts[: draw.randint(1, 5)])}</body></html>", model) != ""
    assert texts <= 0.05 * 300


SHORT = "<p>Some plain words of an article that say a thing or two.</p>"
CHAT_BLOCK = '<div class="comment"><p>I do not agree with any of this at all.</p></div>'


@pytest.mark.parametrize("page, blocks", [
    (f"<main>{SHORT}</main>", 1),
    (f'<main>{SHORT * 3}<div class="comment-thread">{CHAT_BLOCK}</div></main>', 3),
    (f'<h1>Title</h1>{SHORT * 2}<div class="comments">{CHAT_BLOCK}</div>', 3),
    (SHORT, 1),
    (f'<div class="comments">{CHAT_BLOCK}</div>', 0),
    ("<nav><a href=1>x</a></nav><footer>c</footer>", 0),
    ('<div class="cookie-notice"><p>We use cookies here.</p></div>', 0),
])
def test_short_articles(model, page, blocks):
    found = html_text.main_text(f"<html><body>{page}</body></html>", model)
    assert len(found.split("\n") if found else []) == blocks and "agree" not in found


def test_marginals_are_exact(model):
    """Against all labellings of small trees."""
    for page in ("<div><p>Some text</p><p><a>x</a></p></div>", "<article>" + "<p>Words and words</p>" * 4 + "<ul><li>a</ul></article><nav><a>b</a></nav>"):
        nodes, _ = dom.parse(page)
        alike = Counter(map(html_text._kin, nodes))
        weights = {}
        for bits in range(1 << len(nodes)):
            labels = [bits >> i & 1 for i in range(len(nodes))]
            weight = model.root[labels[0]]
            for i, node in enumerate(nodes[1:], 1):
                edge = model.between(node, alike[html_text._kin(node)])
                weight += edge[labels[node.parent]][labels[i]] + model.potential(node)[labels[i]] / alike[html_text._kin(node)]
            weights[tuple(labels)] = math.exp(weight)
        total = sum(weights.values())
        some = sum(w for labels, w in weights.items() if any(labels)) / total
        assert html_text.marginals_and_some(nodes, model)[1] == pytest.approx(some, rel=1e-6)
        for i, got in enumerate(html_text.marginals(nodes, model)):
            assert got == pytest.approx(sum(w for labels, w in weights.items() if labels[i]) / total, rel=1e-6)


@pytest.mark.parametrize("page", ["", "<", "<p", "plain words", "</div></p>", "<p>" * 2000, "<div " + "a" * 50_000, "<!-- open", "<script>x", "&#0;&bogus;"])
def test_broken_pages(model, page):
    assert isinstance(html_text.main_text(page, model), str)


def test_pages_rows(spark, model):
    rows = [(1, None, None, 1), (2, "u", "", 2), (None, "u", PAGE, 3), (2, "u", PAGE, 4)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"), model).collect()
    assert sorted((r.text != "") for r in found) == [False, False, True, True]
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string"), model).count() == 0


def test_pages_query(spark):
    """The pages' articles, taken out by their tags."""
    import html

    found = {r.page_id: r for r in queries.op2_main_text(spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert found[page.page_id].text == "\n".join(filter(None, blocks))
        assert found[page.page_id].n_chars == len(found[page.page_id].text)


def test_words():
    assert decontaminate.words("It’s “Éa”, a_b—c 12.5! 「中文」") == [w.encode() for w in ["it", "s", "éa", "a", "b", "c", "12", "5", "中文"]]
    assert decontaminate.words(None) == decontaminate.words(" .,") == []


def slow_align(item, window):
    best, row = 0, [0] * (len(window) + 1)
    for word in item:
        new = [0]
        for j, other in enumerate(window):
            new.append(max(0, row[j] + (2 if word == other else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_contaminations(spark, odd, none):
    """Copies, edited copies and clean texts; every pair aligned in full."""
    texts = [r.text for r in odd.filter("doc_id < 12").orderBy("doc_id").collect()][:12]
    items = [(n, b" ".join(decontaminate.words(t)[:30]).decode()) for n, t in enumerate(texts[:8])] + [(90, None), (91, "a b"), (None, texts[9][:150])]
    edited = [[w.decode() for w in decontaminate.words(t)[:30]] for t in texts[:6]]
    for n, words in enumerate(edited):
        for k in range(n % 5, len(words), 6):
            words[k] = "changed"
    more = [(300 + n, "before " * 40 + " ".join(words) + " after" * 40) for n, words in enumerate(edited)]
    documents = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for doc in documents.filter("length(text) < 5000").collect():
        for item_id, text in items:
            item = decontaminate.words(text)
            if len(item) >= 3 and slow_align(item, decontaminate.words(doc.text)) / (2 * len(item)) >= decontaminate.THRESHOLD:
                want.add((doc.doc_id, item_id))
    found = decontaminate.contaminations(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id not in (140, 141, 142)} == want and len(want) > 15
    in_blocks = decontaminate.contaminations(documents, benchmark, block_bytes=300).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, found))
    kept = decontaminate.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and 0 not in {r.doc_id for r in kept.collect()}
    assert decontaminate.contaminations(none, benchmark).count() == 0
    assert decontaminate.contaminations(documents, benchmark.limit(0)).count() == 0


def test_edited_copies():
    """Added, left out and replaced words, items of 1 to 60 words: what aligning all words in full gives."""
    draw = random.Random(5)
    common = ["of", "the", "in"] + [f"w{n}" for n in range(12)]
    word = lambda: draw.choice(common) if draw.random() < 0.5 else f"v{draw.randint(0, 400)}"
    sizes = [*range(1, 13), 20, 25, 40, 60]
    rows = [(n, " ".join(word() for _ in range(size))) for n, size in enumerate(sizes * 2)]
    items = decontaminate.Items.of(rows)
    counts = Counter()
    texts = []
    for _, item in rows:
        for share in (0.0, 0.1, 0.2, 0.35, 0.5, 0.69, 0.8):
            for kinds in ("r", "d", "i", "rdi", "m"):
                copy = item.split()
                for _ in range(round(share * len(copy))):
                    at, kind = draw.randint(0, max(0, len(copy) - 1)), draw.choice(kinds)
                    at = len(item.split()) // 2 if kind == "m" else at
                    if kind in "im":
                        copy.insert(at, word())
                    elif kind == "d":
                        del copy[at : at + 1]
                    else:
                        copy[at : at + 1] = [word()]
                texts.append(" ".join([*(word() for _ in range(draw.choice((0, 5, 80)))), *copy, *(word() for _ in range(draw.choice((0, 7))))]))
    for text in texts:
        numbers = items.numbers(text)
        for kind in items.grams:
            counts.update((kind.width, c) for c in decontaminate.grams(numbers, kind.width, len(items.vocabulary)).tolist())
    rare, passed = items.with_rare_seeds(counts), 0
    assert all(1 <= limit.left and limit.broken < limit.size - limit.width + 1 for limit in rare.limits if limit.size >= 3)
    for text in texts:
        found = {item: score for item, score, _, _ in decontaminate.find_in_text(rare, text)}
        numbers, want = rare.numbers(text), {}
        for item, own in enumerate(rare.words):
            if len(own) < 3:
                score = float(numbers.tolist() == own.tolist())
            else:
                score = decontaminate.align(own, numbers) / (2 * len(own))
            if score >= decontaminate.THRESHOLD:
                want[item] = score
        assert found == want
        passed += len(want)
    assert passed > 500
    item = [f"x{n}" for n in range(40)]
    rare = decontaminate.Items.of([(1, " ".join(item)), (2, "alpha beta gamma delta epsilon")])
    for added, score in ((12, 0.85), (15, 0.8125), (20, 0.75), (24, 0.7), (27, 0.6625)):
        text = " ".join([*item[:20], *(f"y{n}" for n in range(added)), *item[20:]])
        assert [(i, s) for i, s, _, _ in decontaminate.find_in_text(rare, text)] == [(0, score)]
    assert [(i, s) for i, s, _, _ in decontaminate.find_in_text(rare, "alpha beta ZZZ delta epsilon")] == [(1, 0.7)]


def test_alignment_rows():
    """The row-wise alignment against one cell at a time."""
    draw = random.Random(9)
    for _ in range(60):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(1, 25))] for _ in range(2))
        assert decontaminate.align(np.array(a), np.array(b)) == slow_align(a, b)


def test_benchmark_query(spark):
    """Exactly the documents that hold an item are found in the test tables."""
    found = {(r.doc_id, r.item_id) for r in queries.op6_benchmark_copies(spark, SF).collect()}
    items = [(r.item_id, b" ".join(decontaminate.words(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = b" ".join(decontaminate.words(doc.text))
        want |= {(doc.doc_id, item_id) for item_id, item in items if item in text}
    assert found == want and want


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(odd, none, order):
    docs = [(r.doc_id, (r.text or "").lower().encode().split()) for r in odd.collect()]
    counts = [Counter() for _ in range(order)]
    grams = lambda words, n: zip(*[words[k:] for k in range(n + 1)])
    for _, words in docs:
        for n in range(order):
            counts[n].update(grams(words, n))
    tokens, want = sum(len(words) for _, words in docs), []
    for doc_id, words in docs:
        own = [Counter(grams(words, n)) for n in range(order)]
        others = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g]
        total = 0.0
        for at in range(len(words)):
            factor = 1.0
            for n in range(min(at, order - 1), 0, -1):
                gram = tuple(words[at - n : at + 1])
                if others(gram):
                    total += math.log(factor * others(gram) / others(gram[:-1]))
                    break
                factor *= lm_score.BACKOFF
            else:
                seen, outside = others((words[at],)), tokens - len(words)
                total += math.log(factor * (seen / outside if seen else 1 / (outside + 1)))
        want.append((str(doc_id), len(words), total))
    got = [(str(r.doc_id), r.n_tokens, r.log_score) for r in lm_score.lm_scores(odd, order, shard_bytes=30_000).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9)
    assert lm_score.lm_scores(none, order).count() == 0


LONG = "This is a paragraph of the article with a fair number of words in it, so that it looks like prose."
CHAT = "I really think that this comment is quite long, and it has many words, but it is still only a comment."


@pytest.mark.parametrize("page, want", [
    (f'<div id="header"><h1>Site</h1></div><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div id="content"><h1>T</h1>'
     f'<p>{LONG}</p><p>Short.</p><p class="notice">{CHAT}</p><p>{LONG}</p></div><div id="sidebar"><p>{CHAT}</p></div>'
     f'<div id="comments"><p>{CHAT}</p><p>{CHAT}</p></div><div id="footer">c</div>', ["T", LONG, "Short.", LONG]),
    (f'<header><a href=/>Home</a></header><main><h1>T</h1><p>{LONG}</p><div class="advertisement"><p>{CHAT}</p></div><blockquote>{LONG}'
     f'</blockquote><form><label>Mail</label><p>{CHAT}</p></form></main><aside><p>{CHAT}</p></aside>', ["T", LONG, LONG]),
    (f'<div class="cookie-banner"><p>{CHAT}</p></div><article><h1>T</h1><p>{LONG}<p>{LONG}</article><section class="comments">'
     f'<article class="comment"><p>{CHAT}</p></article><article class="comment"><p>{CHAT}</p></article></section>', ["T", LONG, LONG]),
    (f'<article><h1>T</h1><p>{LONG}</p><div class="comments"><div class="comment"><p>{CHAT}</p></div></div><div class="related"><ul>'
     f'<li><a href=1>{CHAT}</a></li></ul></div></article>', ["T", LONG]),
    (f'<nav><a href=1>One</a></nav><article><p>Hi.</p></article><footer>{LONG}</footer>', ["Hi."]),
    (f'<article><h1>T</h1><ul><li>one</li></ul><table><tr><td>a</td><td>b</td></tr></table><pre>x = 1</pre></article>', ["T", "one", "a", "b", "x = 1"]),
])
def test_other_layouts(model, page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>", model).split("\n") == want
