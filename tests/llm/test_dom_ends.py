"""Elements whose content is skipped, but that end at once or have no end tag."""

import pytest

from strandline.llm import dom


def text_of(page):
    return " ".join(text for _, text in dom.parse(page)[1])


@pytest.mark.parametrize("lost", ["<svg width='1'/>", "<math />", "<object data=x>", "<select>"])
def test_text_after_it_stays(lost):
    assert "the article" in text_of(f"<body><p>first</p>{lost}<p>the article</p></body>")


def test_content_is_skipped():
    assert text_of("<p>a</p><svg><text>no</text></svg><select><option>no</select><script>no") == "a"
