"""Main text on generated layouts that the tree has not seen, and pages with odd markup."""

from __future__ import annotations

import re
import time

import numpy as np

from weftgraph.llm import html_text


def test_generated_layouts_match_their_labels():
    writer, right, blocks = html_text.Pages(99), 0, 0
    for _ in range(200):
        page = writer.page()
        want = [b.text.strip("{} ") for b in html_text.blocks(page) if "{{" in b.text]
        got = html_text.main_text(page.replace("{{", "").replace("}}", "")).split("\n\n")
        want = [re.sub(r"[{}]{2}", "", w) for w in want]
        blocks += len(want)
        right += len(set(want) & set(got)) - len(set(got) - set(want) - {""})
    assert right >= 0.98 * blocks


def test_neighbours_decide():
    used = html_text.tree().used()
    assert sum(used[f] for f in ("words_before", "density_before", "words_after", "density_after")) >= 5 and used["words"] and used["density"]
    short, text = "<div>Two words</div>", "<div>" + "running text of a page goes on here " * 6 + "</div>"
    among_text, among_links = text + short + text, "<div><a>x y</a></div>" + short + "<div><a>z</a></div>" + text + text
    assert "Two words" in html_text.main_text(among_text) and "Two words" not in html_text.main_text(among_links)


def test_odd_markup():
    text = "running text of a page goes on here " * 6
    clean = text.strip()
    assert html_text.main_text(f"<p title=don't>{text}</p>") == clean
    assert html_text.main_text(f"<article><p>{text}</p></article><p>Copyright 2020 all rights reserved</p>") == clean
    assert html_text.main_text(f"<article><p>{text}</p><section class='social-history'><p>{text}</p></section><p hidden>Kept too.</p></article>") == f"{clean}\n\n{clean}\n\nKept too."
    assert html_text.main_text(f"<article><p>{text}</p><section class='reader-comments'><p>{text}</p></section></article>") == clean
    assert html_text.main_text(f'<p data-x="a > b" class=x>{text}<p data-y=\'"\'>{text}') == f"{clean}\n\n{clean}"
    assert html_text.main_text("<!-- never closed <p>x</p>") == "" and html_text.main_text("&amp;" * 3 + "<p") is not None


def test_long_and_hostile_pages_take_linear_time():
    paragraph = "<p>" + "words of a long page " * 20 + "</p>"
    page = "<article>" + paragraph * 20000 + "</article>"
    began = time.time()
    text = html_text.main_text(page)
    assert text.count("\n\n") == 19999
    for hostile in ("<div>" * 30000 + "</span></p>" * 30000, '<a ="' * 50000, '<a =">"' * 50000, "<a =<a =" * 50000, "<!--" * 50000, "<p" * 50000, "&" * 200000):
        html_text.main_text(hostile)
    assert time.time() - began < 60


def test_rows_repeat_and_steps_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(html_text, "STEP_BYTES", 100)
    text = "running text of a page goes on here " * 6
    rows = [(i % 7 if i % 5 else None, None if i % 3 else "u", f"<p>{text}{i % 4}</p>" if i % 6 else None, i) for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_text.extract(frame).collect()), key=repr)
    want = [(i, u, text + str(n % 4) if h else "", len(text) + 1 if h else 0) for i, u, h, n in rows]
    assert got == sorted(want, key=repr)


def test_tree_grows_by_gini():
    x = np.array([[float(i), float(i % 2)] for i in range(40)])
    tree = html_text.Tree(x, (x[:, 0] > 20).astype(float), depth=3, leaf=2)
    assert tree.root == (0, 20.5, 0.0, 1.0) and tree.main(x) == [i > 20 for i in range(40)]
