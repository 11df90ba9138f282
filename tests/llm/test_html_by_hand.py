"""Pages written by hand, of other make than the training pages."""

from weftgraph.llm import html_text

LONG = "This paragraph of the article has enough words to be told from a menu, and it ends with a full stop."


def test_custom_elements_do_not_swallow_the_page():
    for tag in ("title-bar", "template-x", "svg-icon", "script-view", "style-guide", "textarea-field", "iframe-box", "noscript-note"):
        page = f"<html><body><article><{tag}>Hi</{tag}><p>{LONG}</p><p>{LONG}</p></article></body></html>"
        text = html_text.main_text(page)
        assert text.count(LONG) == 2, (tag, text)


def test_elements_without_text_still_go():
    page = f"<title>Top</title><article><script type=x>var a = '<p>no</p>';</script><p>{LONG}</p><style>p {{}}</style><svg/><p>{LONG}</p></article>"
    assert html_text.main_text(page.replace("<svg/>", "<svg></svg>")) == f"{LONG}\n\n{LONG}"
