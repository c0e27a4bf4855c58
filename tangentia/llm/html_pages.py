"""Labelled pages to train the page model on, laid out by rule from a fixed seed.

Each page mixes ways in which sites mark the same parts: semantic elements,
named divisions, roles, or nothing at all.  ``data-content`` marks what is
(1) and isn't (0) the article; it is no feature of the model.
"""

from __future__ import annotations

import random
import re

from tangentia.llm.html import Node

PAGES, SEED = 1700, 5
_SAYS = ("wrote", "said", "replied", "says", "commented")
_SYLLABLES = "an be cor de el fi gra ho in jo ka lu mo na or pe qui ra se ti un ve wa zen ing tion der que ent".split()
_NAMES = {
    "menu": "menu navbar nav navigation topnav breadcrumb breadcrumbs toolbar tabs links skip toc main-nav mega-menu".split(),
    "header": "header site-header masthead top topbar branding logo hero-banner page-header".split(),
    "notice": "notice cookie cookies cookie-banner consent gdpr alert popup modal overlay message warning disclaimer announcement paywall toast privacy".split(),
    "advert": "ad ads advert advertisement adsbygoogle ad-slot banner sponsored sponsor promo promotion commercial teaser-ad partner".split(),
    "sidebar": "sidebar side aside widget widgets related rail right-col left-col popular trending recommended more-stories latest secondary see-also".split(),
    "comments": "comments comment-list discussion responses replies reader-comments disqus commentlist feedback thread".split(),
    "form": "search-form subscribe newsletter login signup contact-form search register poll".split(),
    "footer": "footer site-footer bottom copyright colophon legal foot credits".split(),
    "share": "share social sharing tags meta-nav pagination pager follow tools actions".split(),
    "content": "content post entry article article-body story main text page-content body-text post-content entry-content prose".split(),
}
_TAGS = {"menu": "nav", "header": "header", "advert": "aside", "sidebar": "aside", "form": "form", "footer": "footer"}
_ROLES = {"menu": "navigation", "header": "banner", "sidebar": "complementary", "footer": "contentinfo", "form": "search", "notice": "alert"}


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, z: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, z)))

    def sentences(self, a: int, z: int) -> str:
        out = []
        for _ in range(self.r.randint(a, z)):
            s = self.words(4, 14).capitalize()
            if self.r.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            out.append(s + self.r.choice("....?!"))
        return " ".join(out)

    def rich(self, a: int, z: int) -> str:
        """Sentences with links, emphasis, references and breaks among them."""
        parts = self.sentences(a, z).split(" ")
        for k in range(len(parts)):
            x = self.r.random()
            if x < 0.02:
                parts[k] = f'<a href="/{parts[k]}">{parts[k]}</a>'
            elif x < 0.04:
                parts[k] = f"<em>{parts[k]}</em>"
            elif x < 0.05:
                parts[k] += " &amp; co"
            elif x < 0.055:
                parts[k] += "<br>"
        return " ".join(parts)

    def links(self, a: int, z: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(a, z))]
        how = self.r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items) if how < 0.8 else "".join(f"<div>{i}</div>" for i in items)

    def part(self, kind: str, inner: str, label: int = 0) -> str:
        """``inner`` in an element that says what it is in one way or another."""
        names = _NAMES[kind]
        tag, attrs = "div", ""
        if kind in _TAGS and self.r.random() < 0.5:
            tag = _TAGS[kind]
        elif self.r.random() < 0.2:
            tag = "section"
        if tag in ("div", "section") or self.r.random() < 0.4:
            name = self.r.choice(names)
            if self.r.random() < 0.3:
                name += self.r.choice(("-wrapper", " box", "_container", " clearfix", "-inner", "1"))
            if kind in _ROLES and self.r.random() < 0.15:
                attrs = f' role="{_ROLES[kind]}"'
            else:
                attrs = f' {self.r.choice(("class", "class", "id"))}="{name}"'
        return f'<{tag}{attrs} data-content="{label}">{inner}</{tag}>'

    def prose(self) -> str:
        x = self.r.random()
        if x < 0.5:
            return f"<p>{self.rich(1, 6)}</p>"
        if x < 0.8:
            return f"<p>{self.sentences(1, 3)}</p>"
        if x < 0.86:
            return f"<p>{self.words(1, 4).capitalize()}.</p>"
        if x < 0.93:
            return f"<p>{self.plain()}</p>"
        return f"<div>{self.sentences(1, 3)}</div>"

    def plain(self) -> str:
        """Words without punctuation, a word again and again, or words with marks."""
        x = self.r.random()
        if x < 0.4:
            return " ".join([self.word()] * self.r.randint(5, 80))
        mark = self.r.choice(("", "!!", " |", "***", "###"))
        text = " ".join(self.word() + mark for _ in range(self.r.randint(8, 120)))
        return text.upper() if x < 0.6 else text

    def menu(self) -> str:
        return self.part("menu", self.links(3, 9))

    def header(self) -> str:
        title = self.r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.sentences(1, 2)}</p>", f'<a href="/">{self.words(1, 2)}</a>', f"<div>{self.words(2, 6)}</div>"))
        return self.part("header", title + (self.menu() if self.r.random() < 0.4 else ""))

    def notice(self) -> str:
        return self.part("notice", self.r.choice((f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2))) + self.r.choice(("", "<button>OK</button>", f'<a href="/p">{self.word()}</a>')))

    def advert(self) -> str:
        return self.part("advert", self.r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f'<a href="//x">{self.words(3, 9)}</a>', f"<h3>{self.words(2, 5)}</h3><p>{self.sentences(1, 2)}</p>")))

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.r.choice((self.links(3, 8), f"<p>{self.sentences(1, 3)}</p>", self.links(2, 4) + f"<p>{self.sentences(1, 2)}</p>"))
        return self.part("sidebar", inner)

    def comments(self) -> str:
        one = self.r.choice(("div", "li", "article", "div"))
        all_ = "".join(
            f'<{one} class="{self.r.choice(("comment", "reply", "comment-body", "comment depth-1"))}">'
            f"{self.r.choice((f'<b>{self.word()}</b>', f'<span>{self.word()}:</span>', f'<cite>{self.word()}</cite>', ''))}<p>{self.sentences(1, 5)}</p></{one}>"
            for _ in range(self.r.randint(1, 4))
        )
        return self.part("comments", f"<h2>{self.words(1, 3)}</h2>{'<ol>' + all_ + '</ol>' if one == 'li' else all_}")

    def unnamed_comments(self) -> str:
        """Readers' words in elements without names, one like the other: who, when and what."""
        who, when = self.r.randrange(4), self.r.random() < 0.5
        out = []
        for _ in range(self.r.randint(2, 5)):
            name = self.words(1, 2).title()
            time = self.r.choice((f"{self.r.randint(2, 23)} hours ago", f"20{self.r.randint(10, 24)}-0{self.r.randint(1, 9)}-1{self.r.randint(0, 9)}", f"{self.r.randint(10, 23)}:{self.r.randint(10, 59)}")) if when else ""
            says = self.sentences(1, 4)
            out.append(
                (
                    f"<div>{name} {self.r.choice(_SAYS)}: {says}</div>", f"<div><b>{name}</b> {time}<p>{says}</p></div>",
                    f"<div><p>{name} {self.r.choice(_SAYS)} {time}:</p><p>{says}</p></div>", f"<div><span>{name}:</span> <small>{time}</small><div>{says}</div></div>",
                )[who]
            )
        head = self.r.choice(("", f"<h3>{self.words(1, 2)}</h3>", f"<h2>{self.r.randint(2, 40)} {self.word()}</h2>"))
        return f'<div data-content="0">{head}{"".join(out)}</div>'

    def linked_items(self) -> str:
        """A list that is the page's matter, each item a link, with a few words or none."""
        tag = self.r.choice(("ul", "ul", "ol"))
        how = self.r.random()
        items = []
        for _ in range(self.r.randint(3, 10)):
            link = f'<a href="/{self.word()}">{self.words(2, 7)}</a>'
            items.append(link if how < 0.35 else f"{link}: {self.words(2, 8)}" if how < 0.7 else f"{link} {self.sentences(1, 2)}")
        if self.r.random() < 0.4:
            return f'<p>{", ".join(items)}.</p>'
        return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>"

    def details(self) -> str:
        return f"<details><summary>{self.words(1, 8).capitalize()}{self.r.choice(('', '?', '.'))}</summary><p>{self.sentences(1, 4)}</p></details>"

    def in_body(self) -> str:
        """An article without elements of its own: runs of text in the body or one element, with breaks, rules and headings between."""
        gap = self.r.choice(("<br><br>", "<hr>", "<p>", "<br>\n<br>"))
        text = gap.join(self.rich(1, 5) for _ in range(self.r.randint(1, 6)))
        head = self.r.choice(("", f"<h1>{self.words(2, 6)}</h1>", f"<b>{self.words(2, 6)}</b><br>"))
        return head + text

    def neutral(self) -> str:
        """A short article in elements with names that say nothing."""
        names = ["".join(self.r.choices("abcdefghijklmnopqrstuvwxyz", k=self.r.randint(1, 5))) + str(self.r.randint(0, 99)) for _ in range(3)]
        parts = [f"<p>{self.sentences(1, 3)}</p>" if self.r.random() < 0.7 else f'<div class="{names[2]}">{self.sentences(1, 3)}</div>' for _ in range(self.r.choice((1, 1, 2, 3, 4)))]
        head = self.r.choice(("", f"<h1>{self.words(1, 6)}</h1>", f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 6)}</h2>", f'<div class="{names[2]}">{self.words(2, 6)}</div>'))
        inner = f'<div class="{names[1]}">{head}{"".join(parts)}</div>'
        return f'<div class="{names[0]}" data-content="1">{inner}</div>' if self.r.random() < 0.6 else inner.replace(">", ' data-content="1">', 1)

    def list_page(self) -> str:
        """A page whose article is a list of links under a heading."""
        inner = f"<h1>{self.words(1, 6)}</h1>" + (f"<p>{self.sentences(1, 2)}</p>" if self.r.random() < 0.6 else "") + self.linked_items()
        tag = self.r.choice(("article", "main", "div", ""))
        return f'<{tag} data-content="1">{inner}</{tag}>' if tag else self.part("content", inner, 1)

    def form(self) -> str:
        return f'<form class="{self.r.choice(_NAMES["form"])}" data-content="0"><label>{self.words(1, 3)}</label><input name="q"><p>{self.sentences(1, 2)}</p><button>{self.word()}</button></form>'

    def signup(self) -> str:
        """A call to sign up, in an element that need be no form."""
        call = self.r.choice((self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", f"<h3>{self.words(2, 5)}</h3>", f"{self.words(2, 5).capitalize()}!", f"{self.words(3, 6).capitalize()}!"))
        return self.part("form", call + self.r.choice(("", '<input type="email" name="e">')) + self.r.choice(("", f"<button>{self.word()}</button>")))

    def items(self) -> str:
        """A list of an article, of short items or of sentences."""
        tag, how = self.r.choice(("ul", "ol", "ol")), self.r.random()
        inner = [self.words(1, 12) if how < 0.5 else self.sentences(1, 2) if how < 0.85 else f"<p>{self.sentences(1, 2)}</p>" for _ in range(self.r.randint(2, 6))]
        return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in inner) + f"</{tag}>"

    def figure(self) -> str:
        caption = self.r.choice((self.words(2, 9), self.sentences(1, 2), f"{self.words(3, 7).capitalize()}. {self.word()}: {self.word()}"))
        return f'<figure{self.r.choice(("", ""," class=image"))}><img src="/x.png" alt="x"><figcaption>{caption}</figcaption></figure>'

    def footer(self) -> str:
        return self.part("footer", self.r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", self.links(3, 7) + f"<p>&copy; 20{self.r.randint(10, 24)} {self.words(1, 3)}</p>", f"<p>{self.sentences(1, 3)}</p>")))

    def share(self) -> str:
        return self.part("share", self.links(2, 5))

    def article(self) -> str:
        out = [f"<h1>{self.words(2, 9)}</h1>"] if self.r.random() < 0.85 else []
        kind, bare = self.r.random(), self.r.random() < 0.12
        for _ in range(1 if kind > 0.9 else self.r.randint(1, 9) if kind > 0.2 else self.r.randint(1, 30)):
            x = self.r.random()
            if kind < 0.06:
                out.append(f"<p>{self.plain()}</p>")
                continue
            if kind < 0.14 and x < 0.8:
                out.append(f"<p>{self.words(1, 5).capitalize()}{self.r.choice(('.', '.', '', '!'))}</p>")
                continue
            if x < 0.74:
                out.append(self.prose())
            elif x < 0.82:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif x < 0.85:
                out.append(self.items())
            elif x < 0.857:
                out.append(self.linked_items())
            elif x < 0.864:
                out.append(self.details())
            elif x < 0.875:
                out.append(self.figure())
            elif x < 0.885:
                out.append("<dl>" + "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.r.choice((self.words(2, 9), self.sentences(1, 2)))}</dd>" for _ in range(self.r.randint(1, 5))) + "</dl>")
            elif x < 0.90:
                out.append(f"<blockquote>{self.sentences(1, 3)}</blockquote>")
            elif x < 0.93:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif x < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                out.append(f"<p><b>{self.words(3, 9)}.<br>{self.prose()}")
            if not bare and self.r.random() < 0.16:
                out.append(self.r.choice((self.advert, self.share, self.notice, self.sidebar, self.form, self.signup, self.signup))())
        inner = "".join(out)
        if bare:  # nothing around the article but the body
            return re.sub(r"<(p|h1|h2|ul|ol|dl|figure|div|blockquote|pre|table)>", r'<\1 data-content="1">', inner)
        if self.r.random() < 0.3:
            inner = self.part("content", inner, 1) if self.r.random() < 0.5 else f'<section data-content="1">{inner}</section>'
        if self.r.random() < 0.12:
            inner += self.comments()
        elif self.r.random() < 0.05:
            inner += self.unnamed_comments()
        how = self.r.random()
        if how < 0.45:
            return f'<article data-content="1">{inner}</article>'
        if how < 0.6:
            return f'<main data-content="1">{inner}</main>'
        if how < 0.9:
            return self.part("content", inner, 1)
        return f'<div data-content="1">{inner}</div>'

    def table(self) -> str:
        """A page laid out by a table, as they once were: a cell of links, a cell of text, a line below."""
        links = "<br>".join(f'<a href="{self.word()}">{self.words(1, 2)}</a>' for _ in range(self.r.randint(2, 8)))
        text = (f"<h2>{self.words(2, 6)}</h2>" if self.r.random() < 0.7 else "") + "".join(self.prose() for _ in range(self.r.randint(1, 6)))
        cells = [f'<td{self.r.choice(("", " width=120", " class=menu"))} data-content="0">{links}</td>', f'<td data-content="1">{text}</td>']
        if self.r.random() < 0.3:
            cells.reverse()
        below = self.r.choice(("p", "div", "center"))
        return f'<table><tr>{"".join(cells)}</tr></table><{below} data-content="0"><font size=1>Copyright {self.r.randint(1996, 2024)} &copy; {self.words(1, 4)}</font></{below}>'

    def page(self) -> str:
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.form, self.signup) if self.r.random() < 0.5]
        after = [f() for f in (self.share, self.comments, self.sidebar, self.advert, self.notice, self.form, self.signup) if self.r.random() < 0.35]
        if self.r.random() < 0.85:
            after.append(self.footer())
        other = self.r.random()
        body = self.article() if other > 0.24 else self.neutral() if other > 0.14 else self.list_page() if other > 0.06 else ""
        if self.r.random() < 0.07:
            after.insert(0, self.unnamed_comments())
        if self.r.random() < 0.3 and body:
            side = self.sidebar()
            body = f'<div class="{self.r.choice(("wrapper", "container", "row", "layout", "page"))}">{body + side if self.r.random() < 0.6 else side + body}</div>'
        if self.r.random() < 0.08:
            before, body, after = [], self.table(), []
        self.r.shuffle(before)
        if not body:  # the body's own text is the article; its parts say of themselves that they aren't
            return f'<html><head><title>{self.words(2, 5)}</title></head><body data-content="1">{"".join(before)}{self.in_body()}{"".join(after)}</body></html>'
        title = self.words(2, 5)
        start = self.r.choice(("</head><body>", "</head><body>", "</head><body>", "<body>", ""))  # the tags are optional
        empty = self.r.choice(("", "", "", '<svg class="icon"/>', "<canvas/>"))
        return f'<html><head><title>{title}</title>{start}{empty}{"".join(before)}{body}{"".join(after)}</body></html>'


def pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """``n`` labelled pages; the first of a longer list with the same seed are the same."""
    return [_Page(random.Random(f"{seed}/{k}")).page() for k in range(n)]


def labelled(nodes: list[Node]) -> list[Node]:
    """Labels for all nodes: runs take the mark of the nearest element that has one, an element what most of its text is."""
    good = [0] * len(nodes)
    for node in nodes:
        if node.label is None:
            node.label = nodes[node.parent].label if node.parent >= 0 else False
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#":
            good[i] = node.size if node.label else 0
        else:
            node.label = bool(good[i] * 2 > node.size)
        if node.parent >= 0:
            good[node.parent] += good[i]
    return nodes
