"""Labelled pages to train content extraction on, composed by rule from layouts in use on the web.

An element with ``data-content`` 1 or 0 begins a part that is content or not, until a descendant says otherwise.
"""

import random

LABEL = "data-content"

_LETTERS = "etaoinshrdlucmfwypvbgkqjxz"
_MAIN = (
    "<article{}>", "<article class=\"post\"{}>", "<div class=\"post-content\"{}>", "<div id=\"content\"{}>",
    "<div class=\"article-body\"{}>", "<section class=\"story\"{}>", "<div class=\"entry\"{}>", "<main{}>",
    "<div itemprop=\"articleBody\"{}>", "<td class=\"maintext\"{}>", "<div{}>", "<div id=\"main\"{}>", "<div role=\"main\"{}>",
    "<section{}>", "<div class=\"text\"{}>", "<div class=\"page-content\"{}>", "<article id=\"story\"{}>",
)
_WRAPPERS = ("", "<div class=\"container\">", "<div class=\"wrapper\">", "<div id=\"main\">", "<div id=\"page\"><div class=\"row\">", "<main>", "<table><tr>")
_LINK_LISTS = (
    "<nav{}>", "<div class=\"menu\"{}>", "<ul class=\"navbar\"{}>", "<div id=\"navigation\"{}>",
    "<div class=\"breadcrumb\"{}>", "<div class=\"related-links\"{}>", "<ul class=\"share social\"{}>",
    "<div class=\"pagination\"{}>", "<div class=\"tags\"{}>", "<div{}>",
)
_TEXT_JUNK = (
    "<div class=\"ad\"{}>", "<div class=\"advert banner\"{}>", "<div class=\"advertisement\"{}>", "<div class=\"ads\"{}>",
    "<div class=\"adslot box\"{}>", "<div class=\"promoted\"{}>", "<div class=\"sponsor\"{}>", "<div class=\"teaser\"{}>", "<div id=\"ad-slot-1\"{}>", "<aside class=\"promo\"{}>",
    "<div class=\"sponsored\"{}>", "<div class=\"cookie-notice\"{}>", "<div class=\"notice alert\"{}>",
    "<div class=\"newsletter subscribe\"{}>", "<aside{}>", "<aside class=\"sidebar\"{}>", "<div id=\"sidebar\"{}>",
    "<div class=\"widget\"{}>", "<div class=\"consent popup\"{}>", "<div class=\"copyright\"{}>",
    "<div role=\"alert\"{}>", "<div class=\"disclaimer\"{}>", "<div class=\"modal overlay\"{}>",
    "<section class=\"related\"{}>", "<div class=\"banner top\"{}>", "<div role=\"complementary\"{}>", "<aside id=\"widget\"{}>",
)
#: Junk that is one block of text, also among paragraphs.
_LINE_JUNK = (
    "<p class=\"ad\"{}>", "<p class=\"notice\"{}>", "<p class=\"disclaimer\"{}>", "<p class=\"share\"{}>", "<p class=\"copyright\"{}>",
    "<p class=\"sponsored\"{}>", "<p class=\"newsletter\"{}>", "<p class=\"comment\"{}>", "<p class=\"cookie\"{}>",
)
_PARAGRAPHS = ("<p>",) * 12 + ("<p class=\"lead\">", "<p class=\"text\">", "<p id=\"p1\">", "<p style=\"margin:0\">")
_HEADERS = ("<header{}>", "<div id=\"header\"{}>", "<div class=\"masthead top\"{}>", "<div class=\"site-header\"{}>")
_FOOTERS = ("<footer{}>", "<div id=\"footer\"{}>", "<div class=\"footer bottom\"{}>", "<div class=\"site-footer\"{}>")
_COMMENTS = (
    "<section id=\"comments\"{}>", "<div class=\"comments\"{}>", "<ol class=\"comment-list\"{}>",
    "<div class=\"discussion replies\"{}>", "<section class=\"user-comments\"{}>", "<div id=\"disqus_thread\"{}>",
)
_FORMS = ("<form{}>", "<form class=\"search\"{}>", "<div class=\"login form\"{}>", "<form id=\"signup\"{}>")


def labelled_pages(count: int = 800, seed: int = 1) -> list[str]:
    """``count`` pages, each with a layout of its own; equal for equal arguments."""
    return [_page(random.Random(seed * 1_000_003 + number)) for number in range(count)]


def _words(draw: random.Random, low: int, high: int) -> str:
    words = ["".join(draw.choices(_LETTERS, range(26, 0, -1), k=draw.randint(1, 9))) for _ in range(draw.randint(low, high))]
    return " ".join(word + ("." if draw.random() < 0.08 else "") for word in words).capitalize() + "."


def _end(start: str) -> str:
    return f"</{start[1:].split()[0].split('{')[0].rstrip('>')}>"


def _part(start: str, content: int, inside: str) -> str:
    return start.format(f' {LABEL}="{content}"') + inside + _end(start)


def _text(draw: random.Random) -> str:
    """Texts of any part are as long as those of others: what they are must not hang on their lengths."""
    return _words(draw, 1, 8) if draw.random() < 0.25 else _words(draw, 8, 160)


def _links(draw: random.Random) -> str:
    items = [f'<a href="/{n}">{_words(draw, 1, 4)}</a>' for n in range(draw.randint(2, 9))]
    if draw.random() < 0.6:
        return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"
    return " | ".join(items)


def _paragraph(draw: random.Random) -> str:
    kind = draw.random()
    text = _text(draw)
    if draw.random() < 0.2:
        text += f' <a href="/x">{_words(draw, 1, 3)}</a> {_words(draw, 2, 20)}'
    if kind > 0.93:
        return f"<ul><li>{text}</li><li>{_words(draw, 2, 30)}</li></ul>"
    if kind > 0.88:
        return f"<blockquote><p>{text}</p></blockquote>" if draw.random() < 0.5 else f"<blockquote>{text}</blockquote>"
    if kind > 0.84:
        return f"<figure><img src=\"i.jpg\"><figcaption>{_words(draw, 3, 12)}</figcaption></figure>"
    if kind > 0.8:
        return f"<h{draw.randint(2, 4)}>{_words(draw, 2, 7)}</h2>"
    if kind > 0.76:
        return f"<div>{text}</div>"
    if kind > 0.74:
        return f"<pre>{text}</pre>"
    if kind > 0.72:
        return f"<table><tr><td>{_words(draw, 1, 4)}</td><td>{_words(draw, 1, 4)}</td></tr></table>"
    return f"{draw.choice(_PARAGRAPHS)}{text}</p>" if draw.random() < 0.8 else f"<p><b>{text}<br>"


def _junk(draw: random.Random) -> str:
    text = _text(draw) if draw.random() < 0.5 else "".join(f"<p>{_text(draw)}</p>" for _ in range(draw.randint(1, 4)))
    return _part(draw.choice(_TEXT_JUNK), 0, text)


def _line_junk(draw: random.Random) -> str:
    return _part(draw.choice(_LINE_JUNK), 0, _text(draw))


def _comments(draw: random.Random) -> str:
    tag, name = draw.choice((("div", "comment"), ("li", "comment"), ("article", "comment"), ("div", "reply")))
    one = lambda: f'<{tag} class="{name}"><span class="author">{_words(draw, 1, 2)}</span><p>{_text(draw)}</p></{tag}>'
    return _part(draw.choice(_COMMENTS), 0, f"<h3>{_words(draw, 1, 3)}</h3>" + "".join(one() for _ in range(draw.randint(1, 5))))


def _page(draw: random.Random) -> str:
    body = [_paragraph(draw) for _ in range(draw.choice((1, 2, 3, 5, 8, 13)))]
    if draw.random() < 0.75:
        body.insert(0, f"<h1>{_words(draw, 2, 14)}</h1>")
    for part, chance in ((_junk, 0.35), (_line_junk, 0.2), (_form, 0.1), (lambda d: _part(d.choice(_LINK_LISTS[:-1]), 0, _links(d)), 0.2), (_comments, 0.1)):
        if draw.random() < chance:
            body.insert(draw.randint(1, len(body)), part(draw))
    wrapper, main = draw.choice(_WRAPPERS), draw.choice(_MAIN)
    main = main if main.startswith("<td") == wrapper.startswith("<table") else ("<td{}>" if wrapper.startswith("<table") else "<article{}>")
    before, after = [], []
    if draw.random() < 0.5:
        before.append(_part(draw.choice(_HEADERS), 0, (f"<h1>{_words(draw, 1, 4)}</h1>" if draw.random() < 0.4 else _words(draw, 1, 6)) + _links(draw)))
    for part, chance in ((lambda d: _part(d.choice(_LINK_LISTS), 0, _links(d)), 0.8), (_junk, 0.5), (_form, 0.2)):
        if draw.random() < chance:
            before.append(part(draw))
    draw.shuffle(before)
    for part, chance in ((_comments, 0.5), (_junk, 0.5), (lambda d: _part(d.choice(_LINK_LISTS), 0, _links(d)), 0.4), (_form, 0.2)):
        if draw.random() < chance:
            after.append(part(draw))
    draw.shuffle(after)
    if draw.random() < 0.85:
        after.append(_part(draw.choice(_FOOTERS), 0, _words(draw, 2, 30) + (_links(draw) if draw.random() < 0.4 else "")))
    if draw.random() < 0.25:  # content right in the body
        return f"<html><body {LABEL}=\"1\">{''.join(before + body + after)}</body></html>"
    inside = _part(main, 1, "".join(body))
    if wrapper.startswith("<table"):
        return f"<html><body {LABEL}=\"0\">{''.join(before)}{wrapper}{inside}</tr></table>{''.join(after)}</body></html>"
    closing = "".join(f"</{tag}>" for tag in reversed([part.split()[0].rstrip(">") for part in wrapper.split("<")[1:]]))
    return f"<html><body {LABEL}=\"0\">{''.join(before)}{wrapper}{inside}{closing}{''.join(after)}</body></html>"


def _form(draw: random.Random) -> str:
    return _part(draw.choice(_FORMS), 0, f"<label>{_words(draw, 1, 4)}</label><input name=\"q\"><p>{_text(draw)}</p><button>Go</button>")
