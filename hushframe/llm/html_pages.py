"""Made-up web pages with known main texts, on which the classifier of html_text is fitted.

Pages differ in layout (by element, by telling class names, or by neither), in what stands round the article, in
how long the article is, and in misleading names. Each block of an article starts with MARKED, which labels it.
"""

from __future__ import annotations

import random

#: A private-use character in front of an article's blocks.
MARKED = ""

_SYLLABLES = "an be co da el fi ga ho in jo ka lu me no or pa qui re su ta un ve wi ya zo".split()
#: Class names of parts by kind: telling ones, of which a page may use some.
_TELLING = {
    "menu": ["menu", "navbar", "main-navigation", "nav"], "ad": ["ad", "advert", "sponsored", "promo"], "notice": ["cookie-notice", "consent", "gdpr-banner", "alert"], "side": ["sidebar", "widget", "side related"],
    "comments": ["comments", "comment-list", "replies", "respond"], "footer": ["footer", "site-footer", "copyright"], "form": ["newsletter", "signup", "search", "login"], "head": ["header", "masthead", "banner"],
    "share": ["share", "social", "toolbar"], "article": ["content", "post", "entry-content", "story", "article-body"],
}
_ELEMENT = {"menu": "nav", "side": "aside", "footer": "footer", "form": "form", "head": "header", "article": "article"}
_NEUTRAL = ["box", "row", "c1", "col-8", "inner", "panel", "t2", "block", "unit", "reactions", "bottom", "zone"]
_MISLEADING = ["site has-sidebar", "social-history", "search-for-meaning", "page with-menu", "related-work", "sharing-data", "comment-on-law", "no-sidebar"]


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.layout = self.rng.choice(["element", "element", "telling", "neutral"])
        self.small = self.rng.random() < 0.25  # little or nothing round a short article
        self.bare = self.rng.random() < 0.12  # lines of text in div elements

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            parts = [self.words(3, 9) for _ in range(self.rng.randint(1, 3))]
            out.append(", ".join(parts).capitalize() + self.rng.choice("....?!"))
        return " ".join(out)

    def link(self, text: str) -> str:
        return f"<a href='/{self.word()}'>{text}</a>"

    def part(self, kind: str, inside: str, named: bool = False) -> str:
        """An element round a part, named by the page's layout, or in any case (within an article nothing else tells)."""
        rng, name = self.rng, ""
        tag = _ELEMENT.get(kind, "div") if self.layout == "element" and rng.random() < 0.9 or kind == "form" else "div"
        if named or self.layout == "telling" or kind in ("ad", "notice", "share", "comments") and rng.random() < 0.6:
            name = rng.choice(_TELLING[kind])
        elif rng.random() < 0.5:
            name = rng.choice(_NEUTRAL)
        if kind == "article" and rng.random() < 0.15:
            name = rng.choice(_MISLEADING)
        names = f" {rng.choice(['class', 'class', 'id'])}='{name}'" if name else ""
        closed = "" if tag == "article" and rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}{names}>{inside}{closed}"

    def menu(self) -> str:
        items = [self.link(self.words(1, 2)) for _ in range(self.rng.randint(3, 9))]
        return self.part("menu", "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.8 else " | ".join(items))

    def head(self) -> str:
        return self.part("head", f"<h2>{self.words(1, 3)}</h2>" + (f"<p>{self.words(2, 6)}</p>" if self.rng.random() < 0.4 else ""))

    def ad(self, named: bool = False) -> str:
        return self.part("ad", self.rng.choice([self.sentences(1, 1), self.link(self.words(3, 7)), f"<p>{self.sentences(1, 2)}</p>"]), named)

    def notice(self) -> str:
        return self.part("notice", f"<p>{self.sentences(1, 2)}</p>{self.link(self.word())}")

    def side(self, named: bool = False) -> str:
        items = [f"<li>{self.link(self.words(3, 8))}</li>" for _ in range(self.rng.randint(2, 6))]
        return self.part("side", f"<h3>{self.words(1, 3)}</h3>" + self.rng.choice(["<ul>" + "".join(items) + "</ul>", f"<p>{self.sentences(1, 2)}</p>"]), named)

    def form(self) -> str:
        return self.part("form", f"<label>{self.words(1, 3)}</label><input name=x>" + (f"<p>{self.sentences(1, 1)}</p>" if self.rng.random() < 0.5 else ""))

    def share(self, named: bool = False) -> str:
        return self.part("share", " ".join(self.link(self.word()) for _ in range(self.rng.randint(2, 4))), named)

    def comments(self, named: bool = False) -> str:
        one = lambda: f"<div{item}><div>{self.words(1, 2)} {self.rng.randint(1, 28)}</div><p>{self.sentences(1, 3)}</p>{self.link(self.word()) if reply else ''}</div>"
        item, reply = self.rng.choice(["", " class='item'", " class='c1'"]), self.rng.random() < 0.6
        several = "".join(one() for _ in range(self.rng.randint(2, 8)))
        few = "".join(f"<p>{self.sentences(1, 2)}</p>" for _ in range(self.rng.randint(1, 4)))
        return self.part("comments", (f"<h3>{self.words(1, 2)}</h3>" if self.rng.random() < 0.5 else "") + self.rng.choice([several, several, few]), named)

    def related(self, named: bool = False) -> str:
        """Teasers of other texts, which may be as long as an article."""
        name = self.rng.choice(["related", "side related", "promo", "recommended"])
        return f"<div class='{name}'>" + "".join(f"<p>{self.sentences(1, 6)}</p>" for _ in range(self.rng.randint(1, 3))) + "</div>"

    def footer(self) -> str:
        text = self.rng.choice(["&copy; 2020 ", "All rights reserved. ", "&copy; ", ""]) + self.words(2, 6)
        return self.part("footer", self.rng.choice([text, f"<p>{text}</p>", f"{text} &middot; {self.sentences(1, 1)}", text + " " + self.link(self.words(1, 2))]))

    def article(self) -> str:
        rng = self.rng
        odd = rng.random() < 0.1  # signs between the words, no sentences
        prose = lambda low, high: " ".join(w + rng.choice(["***", "%%%", "###", " |"]) for w in self.words(8 * low, 20 * high).split()) if odd else self.sentences(low, high)
        blocks, par = [], "div" if self.bare else "p"
        for _ in range(rng.choice([1, 1, 2, 3]) if self.small else rng.choice([1, 2, 3, 5, 8, 13])):
            kind, size = rng.random(), rng.choice([1, 3, 5])
            if rng.random() < 0.02:
                blocks.append(f"<{par}>{MARKED}{rng.choice(['All rights reserved.', '&copy; 2020 ' + self.words(1, 3), self.words(2, 5) + ' (c) ' + self.words(1, 3)])}</{par}>")
            elif kind < 0.72:
                blocks.append(f"<{par}>{MARKED}{'<b>' if rng.random() < 0.1 else ''}{prose(1, size) if rng.random() < 0.9 else self.words(1, 5)}{self.link(self.words(1, 2)) if rng.random() < 0.2 else ''}</{par}>")
            elif kind < 0.8:
                tag = rng.choice(["h2", "h3"])
                blocks.append(f"<{tag}{' id=' + rng.choice(_MISLEADING).split()[-1] if rng.random() < 0.3 else ''}>{MARKED}{self.words(1, 6)}</{tag}><p>{MARKED}{prose(1, 3)}</p>")
            elif kind < 0.88:
                blocks.append("<ul>" + "".join(f"<li>{MARKED}{self.words(1, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                blocks.append("<table>" + "".join(f"<tr><td>{MARKED}{self.word()}</td><td>{MARKED}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif kind < 0.96:
                blocks.append(f"<blockquote>{MARKED}{prose(1, 2)}</blockquote>")
            else:
                blocks.append(rng.choice([self.ad, self.ad, self.share, self.side, self.related, self.comments])(True))
        if rng.random() < 0.12:
            blocks.append(rng.choice([self.related, self.comments, self.share])(True))
        if rng.random() < 0.2:
            blocks = [f"<section{rng.choice([' id=', ' class=']) + rng.choice(_MISLEADING).split()[-1] if rng.random() < 0.5 else ''}>{b}</section>" if rng.random() < 0.6 else b for b in blocks]
        elif rng.random() < 0.2 and len(blocks) > 2:
            cut = rng.randrange(1, len(blocks))
            blocks[cut:] = [f"<section {rng.choice(['id', 'class'])}='{rng.choice(_MISLEADING)}'>" + "".join(blocks[cut:]) + "</section>"]
        title = f"<h1>{MARKED}{self.words(2, 9)}</h1>" if rng.random() < 0.9 else ""
        if title and self.layout == "element" and rng.random() < 0.15:
            title = f"<header>{title}</header>"
        return self.part("article", title + "".join(blocks))

    def page(self) -> str:
        rng = self.rng
        some = lambda share, *makers: "".join(m() for m in makers if rng.random() < share)
        if self.small and rng.random() < 0.6:
            middle = self.article()
            return middle if rng.random() < 0.5 else f"<html><body>{middle}{some(0.5, self.footer)}</body></html>"
        before = some(0.5, self.head) + some(0.8, self.menu) + some(0.3, self.notice, self.ad, self.form)
        after = some(0.35, self.side, self.share, self.ad, self.form) + some(0.5, self.comments) + some(0.85, self.footer)
        middle = self.article()
        if rng.random() < 0.3:
            middle = f"<div class='{rng.choice(_MISLEADING + _NEUTRAL)}'>{middle}{self.side() if rng.random() < 0.5 else ''}</div>"
        body = before + middle + after
        if rng.random() < 0.15:
            body = f"<form id=frame>{body}</form>"
        elif rng.random() < 0.3:
            body = f"<div class='{rng.choice(_MISLEADING + _NEUTRAL)}'>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


def made_pages(seed: int, n: int) -> list[str]:
    """n pages; the same for the same seed."""
    return [_Maker(seed * 1_000_003 + k).page() for k in range(n)]
