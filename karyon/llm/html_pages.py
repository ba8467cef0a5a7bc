"""Labelled pages for training, generated from a seed: known layouts whose blocks are main text or not by construction."""

from __future__ import annotations

import numpy as np

from .html_blocks import page_blocks

#: Names that page authors give to parts of a page.
MAIN_NAMES = "content main post entry article story text body page".split()
AD_NAMES = "ad ads advert advertisement promo sponsored banner sponsor".split()
SIDE_NAMES = "sidebar side related widget recommended popular trending tags".split()
NAV_NAMES = "nav menu navbar breadcrumb breadcrumbs topbar navigation pagination".split()
NOTICE_NAMES = "cookie notice consent alert popup modal banner gdpr".split()
FORM_NAMES = "newsletter subscribe signup search login form".split()
COMMENT_NAMES = "comments comment commentlist respond disqus replies discussion".split()
FOOT_NAMES = "footer copyright legal bottom credits".split()
SHARE_NAMES = "share social sharing buttons toolbar".split()
_MAIN, _OTHER = "\ue000", "\ue001"


class _Page:
    """Text of main blocks is marked by a first character that is taken off again with its label."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int, mark: str) -> str:
        n = int(self.rng.integers(low, high + 1))
        kind = self.rng.random()
        out = ["".join(chr(97 + int(c)) for c in self.rng.integers(0, 26, int(self.rng.integers(1, 10)))) for _ in range(n)]
        if kind < 0.06:
            out = [w.upper() + "!!" for w in out]
        elif kind < 0.12:
            out = [w + self.pick(["***", "###", "$$$", "%%%", "&amp;&amp;"]) for w in out]
        elif kind < 0.16:
            out = [out[0]] * n
        text = " ".join(out)
        return mark + text.capitalize() + ("." if self.chance(0.8) else "")

    def link(self, mark: str, low: int = 1, high: int = 3) -> str:
        return f'<a href="/x">{self.words(low, high, mark)}</a>'

    def named(self, names: list[str], tags=("div",)) -> tuple[str, str]:
        tag = self.pick(tags)
        return f'<{tag} {self.pick(["class", "id"])}="{self.pick(names)}">', f"</{tag}>"

    def wrap(self, names: list[str], inner: str, tags=("div", "section")) -> str:
        a, b = self.named(names, tags)
        return a + inner + b

    def menu(self) -> str:
        inner = "<ul>" + "".join(f"<li>{self.link(_OTHER)}</li>" for _ in range(int(self.rng.integers(2, 8)))) + "</ul>"
        return f"<nav>{inner}</nav>" if self.chance(0.6) else self.wrap(NAV_NAMES, inner)

    def header(self) -> str:
        inner = (f"<h1>{self.words(1, 4, _OTHER)}</h1>" if self.chance(0.3) else f"<div>{self.words(1, 4, _OTHER)}</div>") + f"<p>{self.words(2, 8, _OTHER)}</p>" * self.chance(0.5)
        return f"<header>{inner}</header>" if self.chance(0.7) else self.wrap(["header", "masthead", "logo"], inner, ("div",))

    def advert(self) -> str:
        return self.wrap(AD_NAMES, self.pick(["{}", "<p>{}</p>", "<a href='/b'>{}</a>"]).format(self.words(2, 25, _OTHER)), ("div", "aside", "section"))

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3, _OTHER)}</h3>" + "".join(f"<p>{self.link(_OTHER, 2, 8)}</p>" for _ in range(int(self.rng.integers(1, 5)))) + f"<p>{self.words(8, 30, _OTHER)}</p>" * self.chance(0.4)
        return f"<aside>{inner}</aside>" if self.chance(0.5) else self.wrap(SIDE_NAMES, inner)

    def notice(self) -> str:
        return self.wrap(NOTICE_NAMES, f"<p>{self.words(8, 30, _OTHER)} {self.link(_OTHER)}</p><button>{self.words(1, 2, _OTHER)}</button>", ("div", "section", "dialog"))

    def form(self) -> str:
        return f'<form class="{self.pick(FORM_NAMES)}"><label>{self.words(1, 4, _OTHER)}</label><input name="q"><p>{self.words(2, 15, _OTHER)}</p><button>{self.words(1, 2, _OTHER)}</button></form>'

    def comments(self) -> str:
        each = lambda: self.pick(["<li><p>{}</p></li>", '<div class="comment"><p>{}</p></div>', "<article><p>{}</p></article>"]).format(self.words(3, 60, _OTHER))
        return self.wrap(COMMENT_NAMES, f"<h3>{self.words(1, 3, _OTHER)}</h3>" + "".join(each() for _ in range(int(self.rng.integers(1, 6)))), ("div", "section", "ol"))

    def footer(self) -> str:
        inner = self.pick(["&copy; 2020 {}", "<p>&copy; {}</p>", "<p>{}</p>", "{}"]).format(self.words(2, 20, _OTHER)) + f"<ul><li>{self.link(_OTHER)}</li><li>{self.link(_OTHER)}</li></ul>" * self.chance(0.3)
        return f"<footer>{inner}</footer>" if self.chance(0.7) else self.wrap(FOOT_NAMES, inner, ("div",))

    def paragraph(self) -> str:
        kind = self.rng.random()
        if kind < 0.72:
            body = self.words(1, 120 if self.chance(0.7) else 4, _MAIN)
            return self.pick([f"<p>{body}</p>"] * 5 + [f"<p>{body} {self.link('')}</p>", f"<p><em>{body}</em></p>", f"<p>{body}"])
        if kind < 0.8:
            return f"<h2>{self.words(1, 8, _MAIN)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.words(1, 15, _MAIN)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{self.words(5, 40, _MAIN)}</p></blockquote>"
        if kind < 0.94:
            return f"<table><tr><td>{self.words(1, 4, _MAIN)}</td><td>{self.words(1, 4, _MAIN)}</td></tr></table>"
        if kind < 0.97:
            return f"<figure><img src='a'><figcaption>{self.words(2, 12, _MAIN)}</figcaption></figure>"
        return f"<pre>{self.words(3, 20, _MAIN)}</pre>"

    def article(self) -> str:
        parts = [f"<h1>{self.words(2, 10, _MAIN)}</h1>"] * self.chance(0.8)
        for _ in range(int(self.rng.integers(1, 14))):
            parts.append(self.paragraph())
            if self.chance(0.06):
                parts.append(self.pick([self.advert, self.side, self.form, self.notice])())
        if self.chance(0.15):
            parts.append(self.wrap(SHARE_NAMES, "".join(self.link(_OTHER, 1, 1) for _ in range(3)), ("div",)))
        if self.chance(0.2):
            parts.append(self.comments())
        inner = "".join(parts)
        layout = self.rng.random()
        if layout < 0.55:
            return f"<article>{inner}</article>"
        if layout < 0.7:
            return f"<main>{inner}</main>"
        a, b = self.named(MAIN_NAMES, ("div", "section"))
        return a + inner + b

    def html(self) -> str:
        before = [f for f, p in ((self.notice, 0.2), (self.header, 0.5), (self.menu, 0.8), (self.advert, 0.4), (self.form, 0.15), (self.side, 0.15)) if self.chance(p)]
        after = [f for f, p in ((self.comments, 0.3), (self.side, 0.4), (self.advert, 0.25), (self.form, 0.25), (self.menu, 0.15), (self.notice, 0.1), (self.footer, 0.8)) if self.chance(p)]
        body = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        return f"<html><head><title>x</title><style>p {{ margin: 0 }}</style></head><body>{body}" + "</body></html>" * self.chance(0.9)


class _Blog(_Page):
    """A weblog: header bar, one post with a byline, a column of widgets, replies in a list of definition-like boxes."""

    def html(self) -> str:
        w = self.words
        post = "".join(self.pick([f"<p>{w(10, 90, _MAIN)}</p>"] * 6 + [f"<h3>{w(2, 6, _MAIN)}</h3>", f"<blockquote>{w(8, 30, _MAIN)}</blockquote>", f"<ol><li>{w(3, 12, _MAIN)}</li><li>{w(3, 12, _MAIN)}</li></ol>"]) for _ in range(int(self.rng.integers(2, 9))))
        replies = "".join(f'<div class="reply"><span class="who">{w(1, 2, _OTHER)}</span><p>{w(4, 50, _OTHER)}</p></div>' for _ in range(int(self.rng.integers(0, 5))))
        widgets = "".join(f'<div class="widget"><h4>{w(1, 3, _OTHER)}</h4><ul>{"".join(f"<li>{self.link(_OTHER, 1, 6)}</li>" for _ in range(4))}</ul></div>' for _ in range(int(self.rng.integers(1, 4))))
        bar = f'<div id="topbar"><a href="/">{w(1, 3, _OTHER)}</a> <a href="/about">{w(1, 2, _OTHER)}</a></div>'
        return f'<!doctype html><html><body>{bar}<div id="wrap"><div class="hentry entry"><h1 class="entry-title">{w(2, 9, _MAIN)}</h1><div class="entry-content">{post}</div></div><div id="replies">{replies}</div><div id="secondary">{widgets}</div></div><div id="colophon">{w(3, 9, _OTHER)}</div></body></html>'


class _News(_Page):
    """A newspaper: masthead, sections, story with teasers between its paragraphs, a subscription box, related stories, imprint."""

    def html(self) -> str:
        w = self.words
        parts = []
        for _ in range(int(self.rng.integers(3, 12))):
            parts.append(f"<p>{w(12, 70, _MAIN)}</p>")
            if self.chance(0.1):
                parts.append(f'<div class="teaser related"><h5>{w(1, 2, _OTHER)}</h5>{self.link(_OTHER, 3, 9)}</div>')
            if self.chance(0.08):
                parts.append(f'<figure><figcaption>{w(4, 15, _MAIN)}</figcaption></figure>')
        sections = "".join(f"<a href='/s'>{w(1, 1, _OTHER)}</a>" for _ in range(8))
        return (
            f'<html><body><header role="banner"><div class="masthead">{w(1, 3, _OTHER)}</div><nav class="sections">{sections}</nav></header><div class="consent-banner"><p>{w(10, 30, _OTHER)}</p></div>'
            f'<main><section class="story"><h1>{w(4, 12, _MAIN)}</h1><div class="story-body">{"".join(parts)}</div></section><section class="subscribe-box"><p>{w(5, 15, _OTHER)}</p><button>{w(1, 2, _OTHER)}</button></section></main>'
            f'<aside class="most-read"><ol>{"".join(f"<li>{self.link(_OTHER, 4, 9)}</li>" for _ in range(5))}</ol></aside><footer><p>{w(3, 10, _OTHER)}</p></footer></body></html>'
        )


class _Manual(_Page):
    """Documentation: a tree of links at the left, sections with code and tables, a line of neighbours below."""

    def html(self) -> str:
        w = self.words
        tree = "<ul>" + "".join(f"<li>{self.link(_OTHER, 1, 4)}<ul><li>{self.link(_OTHER, 1, 4)}</li></ul></li>" for _ in range(int(self.rng.integers(3, 9)))) + "</ul>"
        parts = []
        for _ in range(int(self.rng.integers(1, 6))):
            parts += [f"<h2>{w(1, 6, _MAIN)}</h2>", f"<p>{w(8, 60, _MAIN)}</p>"]
            parts.append(self.pick([f"<pre><code>{w(4, 25, _MAIN)}</code></pre>", f"<dl><dt>{w(1, 3, _MAIN)}</dt><dd>{w(3, 20, _MAIN)}</dd></dl>", f"<table><tr><th>{w(1, 2, _MAIN)}</th><td>{w(1, 6, _MAIN)}</td></tr></table>", ""]))
        return (
            f'<html><body><div class="navbar"><input name="q"><a href="/">{w(1, 2, _OTHER)}</a></div><div class="toc sidebar-tree">{tree}</div><div role="main" class="document"><h1>{w(1, 6, _MAIN)}</h1>{"".join(parts)}</div>'
            f'<div class="prev-next"><a href="p">{w(1, 3, _OTHER)}</a> <a href="n">{w(1, 3, _OTHER)}</a></div><div class="foot"><p>{w(3, 12, _OTHER)}</p></div></body></html>'
        )


class _Recipe(_Page):
    """A page of an old shop or hobby site: tables for the layout, few names, an advert column, a sign-up form."""

    def html(self) -> str:
        w = self.words
        body = "".join(self.pick([f"<p>{w(8, 60, _MAIN)}</p>"] * 4 + [f"<ul><li>{w(2, 9, _MAIN)}<li>{w(2, 9, _MAIN)}</ul>", f"<h2>{w(1, 5, _MAIN)}</h2>"]) for _ in range(int(self.rng.integers(2, 8))))
        menu = "".join(f"<tr><td class=\"menu\">{self.link(_OTHER, 1, 2)}</td></tr>" for _ in range(6))
        return (
            f'<html><body><table><tr><td><table>{menu}</table></td><td><div class="content"><h1>{w(2, 7, _MAIN)}</h1>{body}</div></td><td><div class="sponsor-col">{w(3, 18, _OTHER)}</div>'
            f'<form action="/join"><p>{w(3, 10, _OTHER)}</p><input><button>{w(1, 1, _OTHER)}</button></form></td></tr></table><div class="bottom">{w(2, 9, _OTHER)}</div></body></html>'
        )


#: Layouts by name; each is written apart from the others.
LAYOUTS = {"parts": _Page, "blog": _Blog, "news": _News, "manual": _Manual, "table": _Recipe}


def labelled_pages(n: int, layout: str = "parts", seed: int = 5) -> list[tuple[list, list[int]]]:
    """(blocks, label of each: 1 for main text) of n generated pages of a layout."""
    out = []
    for k in range(n):
        blocks = page_blocks(LAYOUTS[layout](seed * 1_000_003 + k).html())
        labels = [int(_MAIN in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(_MAIN, "").replace(_OTHER, "")
        out.append((blocks, labels))
    return out
