"""Labelled pages to fit the extraction model on: layouts of web pages, filled with invented words.

Elements of the main text carry ``data-content="1"``, what does not belong to it
``data-content="0"``; see :func:`lodgeflow.llm.extract_text.fit`. Pages of one's own,
labelled likewise, can take their place.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren ta vor sel un da pri ost el na gi bru fen tor al we shi que dor".split()

#: How sites name the parts of a page.
MAIN = ["article", "main", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "div.articleBody", "section.story",
        "div.story-body", "div.post-content", "div.text", "div#main-content", "div.main", "div.article", "section.article-content", "div.body",
        "div.single-post", "div.page-content", "div.entry"]
MENU = ["nav", "nav.main-nav", "div.menu", "div#menu", "ul.nav", "div.navbar", "div.navigation", "ul.menu", "div.breadcrumb", "ol.breadcrumbs",
        "nav#top-nav", "div.tabs", "div.toolbar", "menu"]
HEADER = ["header", "header.site-header", "div#header", "div.header", "div.masthead", "div.top-bar", "div.page-header", "hgroup"]
FOOTER = ["footer", "footer.site-footer", "div#footer", "div.footer", "div.copyright", "div.site-info", "div.colophon", "div.legal"]
SIDEBAR = ["aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.widget", "div.rail", "div#right-column", "div.related", "div.related-posts",
           "section.recommended", "div.popular", "div.most-read", "div.tags", "div.trending", "div.secondary", "section.more-stories"]
NOTICE = ["div.cookie-notice", "div.notice", "div#cookie-banner", "div.consent", "div.gdpr", "dialog", "div.alert", "p.notice", "div.disclaimer",
          "div.warning", "div.message", "div.paywall", "div.popup", "div.modal", "section.announcement", "div.cookies", "div.privacy", "p.cookie"]
ADVERT = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "aside.promo", "div#banner", "div.banner", "p.ad", "div.ad-slot",
          "section.sponsor", "aside.ad", "div.promotion", "div.adsbygoogle", "div.commercial", "span.ad", "figure.ad"]
COMMENTS = ["section.comments", "section#comments", "div.comments", "div#comments", "ol.commentlist", "div.comment-list", "div#disqus-thread",
            "div.responses", "div.reader-comments", "section.discussion", "div.user-comments", "ul.comments", "div.feedback", "aside.comments",
            "div.replies", "section.reader-comments", "div.comment"]
SHARE = ["div.share", "div.social", "ul.sharing", "div.share-buttons", "div.follow", "div.subscribe", "div.newsletter", "div.signup", "div.pagination",
         "div.pager", "div.skip", "div.tools"]


def _open(kind: str, label: int | None = None, extra: str = "") -> tuple[str, str]:
    """Start and end tag of ``name.class`` or ``name#id``."""
    mark = "." if "." in kind else "#"
    name, _, word = kind.partition(mark)
    named = f' {"class" if mark == "." else "id"}="{word}"' if word else ""
    told = "" if label is None else f' data-content="{label}"'
    return f"<{name}{named}{extra}{told}>", f"</{name}>"


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        text = self.words(self.rng.randrange(3, 18)).capitalize()
        return text.replace(" ", ", ", 1) + "." if self.rng.random() < 0.4 else text + self.rng.choice(".....!?")

    def prose(self) -> str:
        """A paragraph of one word up to some hundred, with and without punctuation."""
        r = self.rng.random()
        if r < 0.09:
            return self.words(self.rng.choice((20, 80, 200)))
        if r < 0.16:
            return self.rng.choice(("! ", ", ", "... ", " 7; ")).join(self.word().upper() for _ in range(self.rng.randrange(2, 60)))
        if r < 0.21:
            return self.words(1).capitalize() + self.rng.choice([".", ""])
        if r < 0.37:
            return self.words(self.rng.randrange(2, 9)).capitalize() + self.rng.choice([".", "", ":"])
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 2, 3, 5, 9, 16))))

    def marked(self, text: str) -> str:
        """Some words of a text in inline elements."""
        out = text.split(" ")
        for _ in range(self.rng.choice((0, 0, 1, 2))):
            i = self.rng.randrange(len(out))
            name = self.rng.choice(("b", "i", "em", "strong", 'a href="/x"', "span", "code"))
            out[i] = f"<{name}>{out[i]}</{name.split()[0]}>"
        return " ".join(out)

    def block(self) -> str:
        """A block of the main text."""
        rng, r = self.rng, self.rng.random()
        if r < 0.6:
            kind = rng.choice(("p", "p", "p", "p", "div", 'p class="x"'))
            end = "" if kind == "p" and rng.random() < 0.15 else f"</{kind.split()[0]}>"
            return f"<{kind}>{rng.choice(('', '', '', '<b>'))}{self.marked(self.prose())}{rng.choice(('', '', '<br>'))}{end}"
        if r < 0.72:
            level = rng.choice((2, 3, 4))
            return f"<h{level}>{self.words(rng.randrange(1, 8)).capitalize()}</h{level}>\n"
        if r < 0.8:
            name = rng.choice(("ul", "ol"))
            return f"<{name}>" + "".join(f"<li>{self.marked(self.prose())}</li>" for _ in range(rng.randrange(2, 6))) + f"</{name}>"
        if r < 0.85:
            return f"<blockquote>{rng.choice(('', '<p>'))}{self.prose()}</blockquote>"
        if r < 0.89:
            return f"<pre>{self.words(rng.randrange(3, 30))}</pre>"
        if r < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(rng.randrange(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if r < 0.96:
            return f'<figure><img src="x.png"><figcaption>{self.prose()}</figcaption></figure>'
        return f"<section><h2>{self.words(3)}</h2><p>{self.prose()}</p><p>{self.prose()}</p></section>"

    def links(self) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">{self.words(rng.randrange(1, 5))}</a>' for i in range(rng.randrange(2, 9))]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice((" | ", " ", "\n", "<br>")).join(items)

    def form(self) -> str:
        rng, parts = self.rng, []
        parts.append(f"<label>{self.words(2)}</label><input name=q>")
        if rng.random() < 0.5:
            parts.append(f"<p>{self.prose()}</p>")
        if rng.random() < 0.4:
            parts.append(f"<fieldset><legend>{self.words(2)}</legend><select><option>{self.word()}<option>{self.word()}</select></fieldset>")
        if rng.random() < 0.4:
            parts.append(f"<textarea>{self.words(5)}</textarea>")
        parts.append(f"<button>{self.words(1)}</button>")
        start, end = _open("form", 0, rng.choice(('', ' action="/s"', ' class="search"', ' class="login"')))
        return start + "".join(parts) + end

    def aside(self, kinds: list[str]) -> str:
        """A part that does not belong to the main text."""
        rng, kind = self.rng, self.rng.choice(kinds)
        start, end = _open(kind, 0)
        r = rng.random()
        if kinds is HEADER and r < 0.7:
            name = rng.choice(("h1", "h1", "h1", "h1", "h2", "p", "div", 'p class="tagline"', 'div class="logo"'))
            body = f"<{name}>{self.words(rng.randrange(1, 6))}</{name.split()[0]}>" + (self.aside(MENU) if r < 0.4 else "")
        elif kinds is MENU or kinds is SHARE and r < 0.5:
            items = "".join(f'<li><a href="/{i}">{self.words(rng.randrange(1, 4))}</a></li>' for i in range(rng.randrange(2, 9)))
            body = items if kind.split(".")[0] in ("ul", "ol", "menu") else self.links()
        elif kinds is COMMENTS:
            one = lambda: rng.choice((f"<p>{self.prose()}</p>", f'<div class="comment"><b>{self.word()}</b><p>{self.prose()}</p></div>',
                                      f"<li>{self.prose()}</li>", f"<p>{self.prose()}</p>", f"<p><b>{self.word()}</b>: {self.prose()}</p>", f"<article class=comment><header>{self.word()}</header><p>{self.prose()}</p></article>"))
            body = rng.choice(("", f"<h2>{self.words(2)}</h2>", f"<h3>{self.words(1)}</h3>")) + "".join(one() for _ in range(rng.randrange(1, 7)))
            body += self.form() if rng.random() < 0.3 else ""
        elif kind.startswith(("p", "span")) or r < 0.3:
            body = self.prose() + rng.choice(("", f' <a href="/y">{self.words(2)}</a>'))
        elif r < 0.55:
            body = f"<p>{self.prose()}</p>" + rng.choice(("", f"<button>{self.word()}</button>"))
        elif r < 0.75:
            level = rng.choice((1, 2, 3, 4))
            body = f"<h{level}>{self.words(2)}</h{level}>{self.links()}"
        else:
            body = f"<h4>{self.words(2)}</h4>" + "".join(f"<p>{self.prose()}</p>" for _ in range(rng.randrange(1, 4)))
        return start + body + end

    def page(self) -> str:
        rng = self.rng
        script = f'<script>var s = "<p>{self.words(4)}</p>";</script>' if rng.random() < 0.5 else f"<style>.{self.word()} {{color: red}}</style>"
        inner = [f"<h1>{self.words(rng.randrange(1, 9))}</h1>"] if rng.random() < 0.8 else []
        if inner and rng.random() < 0.2:
            inner = ["<header>" + inner[0] + "</header>"]
        inner += [self.block() for _ in range(rng.choice((1, 1, 2, 4, 7, 12, 25, 50)))]
        for kinds, chance in ((ADVERT, 0.25), (SHARE, 0.2), (SIDEBAR, 0.15), (NOTICE, 0.12), (COMMENTS, 0.15), (MENU, 0.08), (FOOTER, 0.06)):
            if rng.random() < chance:
                inner.insert(rng.randrange(len(inner) + 1) if kinds in (ADVERT, NOTICE) else len(inner), self.aside(kinds))
        if rng.random() < 0.12:
            inner.append(self.form())
        if rng.random() < 0.3:
            inner.insert(rng.randrange(len(inner) + 1), script)
        r = rng.random()
        if r < 0.08:                                                         # nothing names the main text
            start, end = f'<div data-content="1"{rng.choice(("", " class=q"))}>', "</div>"
            inner.append(f"<p>{' '.join(self.sentence() for _ in range(12))}</p>")
        elif r < 0.12:
            start, end = '<table><tr><td data-content="1">', f'</td><td data-content="0">{self.links()}</td></tr></table>'
            inner.append(f"<p>{' '.join(self.sentence() for _ in range(12))}</p>")
        else:
            kind = "article" if rng.random() < 0.45 else rng.choice(MAIN)
            start, end = _open(kind, 1, rng.choice(("", "", ' role="main"', ' itemprop="articleBody"')) if "." not in kind else "")
            if kind == "main" and rng.random() < 0.4:
                start, end = start + "<article>", "</article>" + end
        before = [self.aside(k) for k, chance in ((NOTICE, 0.25), (HEADER, 0.6), (MENU, 0.7), (ADVERT, 0.4), (SHARE, 0.1), (SIDEBAR, 0.1)) if rng.random() < chance]
        after = [self.aside(k) for k, chance in ((SHARE, 0.2), (SIDEBAR, 0.45), (COMMENTS, 0.35), (ADVERT, 0.3), (MENU, 0.1), (NOTICE, 0.15), (FOOTER, 0.8)) if rng.random() < chance]
        if rng.random() < 0.2:
            rng.choice((before, after)).append(self.form())
        body = "".join(before) + start + "".join(inner) + end + "".join(after)
        for _ in range(rng.choice((0, 0, 1, 2))):
            a, b = _open(rng.choice(("div", "div#page", "div.wrapper", "div.container", "div#wrap", "section", "div.row", "div.layout")))
            body = a + body + b
        return (f"<!DOCTYPE html><html><head><title>{self.words(4)}</title>{script}</head><body><!-- {self.words(2)} -->{body}"
                + rng.choice(("</body></html>", "</body></html>", "")))


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]
