"""Hostile pages take time in proportion to their length; the threshold on path ratios decides."""
import time

from strandframe.llm import html_text


def took(page):
    began = time.process_time()
    html_text.main_text(page)
    return time.process_time() - began


def test_hostile_pages():
    for make in (lambda n: '<a "' * n, lambda n: "".join(f"<div class=c{i}>text {i} here." for i in range(n)), lambda n: "<ul>" + "<div><li>x" * n, lambda n: "<p>" * n + "x" + "</b>" * n):
        small, large = took(make(5000)), took(make(20000))
        assert large < 12 * small + 0.5


def test_threshold(monkeypatch):
    page = "<body>" + "<div class=k>Link text</div>" * 60 + "<div class=c>" + "<p>A long line, with words. And more, of them.</p>" * 5 + "</div></body>"
    want = "\n".join(["A long line, with words. And more, of them."] * 5)
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "SHARE", 0.0)
    assert html_text.main_text(page) != want
