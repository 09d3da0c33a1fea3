"""Invented web pages whose main text is known, to learn extraction from."""

from __future__ import annotations

import random

MAIN, OTHER = "main", "other"
#: Common class and id names of parts of pages; fixed values.
NAMES = {
    "main": "content post entry article story text body main-content post-content entry-content article-body page-content markdown prose".split(),
    "nav": "nav navbar menu navigation site-nav main-menu topnav breadcrumb breadcrumbs pagination tabs toc-links".split(),
    "header": "header site-header masthead top-bar banner-top branding page-header logo".split(),
    "footer": "footer site-footer bottom colophon copyright legal footer-links credits".split(),
    "side": "sidebar side aside widget widget-area right-column related related-posts popular trending recommended more-stories".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay paywall announcement notification".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo banner ad-slot adsbox promotion".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form comment-form".split(),
    "social": "share sharing social social-links follow share-buttons".split(),
    "comments": "comments comment-list comment discussion replies responses disqus comment-section user-comments reply".split(),
    "wrap": "wrapper container row page site layout outer inner grid col main wrap app root".split(),
}


class Page:
    """Builds HTML and the labels of its blocks: every block made in `main` is MAIN, in any other part OTHER."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = seed % 3 == 2
        self.parts = [["th", "er", "on", "an", "re"], ["ka", "lo", "mi", "su"], ["ein", "ch", "ver", "ung"], ["ção", "es", "ra", "do"]][seed % 4]

    def word(self) -> str:
        return "".join(self.r.choices(self.parts, k=self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        w = [self.word() for _ in range(self.r.randint(1, 4) if self.r.random() < 0.15 else self.r.randint(4, 18))]
        if len(w) > 8:
            w[4] += ","
        for tag in ('a href="/x"', "b", "em"):
            if self.r.random() < 0.05:
                at = self.r.randrange(len(w))
                w[at] = f"<{tag}>{w[at]}</{tag.split(' ')[0]}>"
        return " ".join(w).capitalize() + self.r.choice(["."] * 8 + ["?", "!"])

    def prose(self) -> str:
        n = self.r.choice([1, 1, 2, 3, 4, 6, 9])
        return " ".join(self.sentence() for _ in range(n))

    def named(self, kind: str, share: float = 0.8) -> str:
        if self.r.random() > share:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[kind])}"'

    def links(self, n: int) -> str:
        inner = [f'<a href="/{self.word()}">{self.words(1, 3).capitalize()}</a>' for _ in range(n)]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(inner)

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            title = f"<h1>{self.words(2, 10).capitalize()}</h1>"
            out.append(f"<header>{title}<p>{self.sentence()}</p></header>" if r.random() < 0.15 else title)
        if r.random() < 0.08:  # hardly any text, or a title that is said again
            return f"<h1>{(title := self.sentence())}</h1><p>{r.choice([title, self.sentence()])}</p>"
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.66:
                out.append(f"<p>{self.prose()}</p>")
            elif x < 0.72:
                out.append(f"<h2>{self.words(1, 6).capitalize()}</h2><p>{self.prose()}</p>")
            elif x < 0.76:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.80:
                out.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif x < 0.83:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif x < 0.85:
                out.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.87:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            elif x < 0.90:
                out.append(f"<div>{self.prose()}</div>")
            else:
                out.append(OTHER + self.inset() + OTHER)
        return "".join(out)

    def inset(self) -> str:
        kind = self.r.choice(["ad", "social", "side", "form", "notice"])
        return self.part(kind)

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return f"<nav{self.named(kind)}>{self.links(r.randint(2, 9))}</nav>" if r.random() < 0.6 else f"<div{self.named(kind, 0.95)}>{self.links(r.randint(3, 9))}</div>"
        if kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 3)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 6)}</p>"]) + (self.part("nav") if r.random() < 0.4 else "")
            return f"<header{self.named(kind, 0.5)}>{inner}</header>" if r.random() < 0.6 else f"<div{self.named(kind, 1)}>{inner}</div>"
        if kind == "footer":
            inner = r.choice([f"&copy; 2024 {self.words(2, 5)}", f"<p>&copy; {self.words(3, 20)}.</p>", f"{self.links(4)}<p>{self.sentence()}</p>", f"{self.word()}.example &middot; {self.prose()}"])
            return f"<footer{self.named(kind, 0.4)}>{inner}</footer>" if r.random() < 0.7 else f"<div{self.named(kind, 1)}>{inner}</div>"
        if kind == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(5), f"<p>{self.prose()}</p>", f"<p>{self.sentence()}</p>{self.links(3)}"])
            return f"<aside{self.named(kind, 0.5)}>{inner}</aside>" if r.random() < 0.6 else f"<div{self.named(kind, 1)}>{inner}</div>"
        if kind == "notice":
            inner = r.choice([f"<p>{self.sentence()} {self.sentence()}</p><button>OK</button>", f"{self.prose()} <a href=/p>{self.word()}</a>", f"<p>{self.prose()}</p>"])
            return f"<{(t := r.choice(['div', 'div', 'section', 'dialog']))}{self.named(kind, 1)}>{inner}</{t}>"
        if kind == "ad":
            inner = r.choice([self.sentence(), f"<p>{self.sentence()}</p>", f'<a href="/x">{self.words(3, 9)}</a>', f"<p>{self.prose()}</p>", "<ins></ins>"])
            return f"<div{self.named(kind, 1)}>{inner}</div>"
        if kind == "form":
            inner = f"<label>{self.words(1, 5)}</label><input name=q>{r.choice(['', f'<p>{self.sentence()}</p>'])}<button>{self.word()}</button>"
            return f"<form{self.named(kind, 0.6)}>{inner}</form>" if r.random() < 0.8 else f"<div{self.named(kind, 1)}>{inner}</div>"
        if kind == "social":
            return f"<div{self.named(kind, 1)}>{self.links(r.randint(2, 4))}</div>"
        each = [r.choice([f"<p>{self.prose()}</p>", f"<b>{self.word()}</b> {self.prose()}", f"<h4>{self.word()}</h4><p>{self.prose()}</p>"]) for _ in range(r.randint(1, 6))]
        tag = r.choice(["div", "li", "article", "div"])
        inner = "".join(f"<{tag}{self.named(kind, 0.8)}>{x}</{tag}>" for x in each)
        inner = f"<h3>{self.words(1, 2)}</h3>" + (f"<ol>{inner}</ol>" if tag == "li" else inner)
        return f"<{(t := r.choice(['section', 'div', 'div']))}{self.named(kind, 1)}>{inner}</{t}>"

    def loose(self) -> list[str]:
        """Blocks of main text, each by itself."""
        r, out = self.r, []
        if r.random() < 0.5:
            out.append(f"<h1>{self.words(1, 8).capitalize()}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            x = r.random()
            if x < 0.12:
                out.append(f"<h2>{self.words(1, 6).capitalize()}</h2>")
            elif x < 0.17:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.25:
                out.append(f"<{(t := r.choice(['pre', 'blockquote', 'center', 'div']))}>{self.prose()}</{t}>")
            elif x < 0.30:
                out.append(f"<table><tr><td>{self.prose()}</td></tr></table>")
            else:
                out.append(f"<p>{self.prose() if r.random() < 0.85 else self.words(1, 5) + '.'}</p>")
        return out

    def bare(self) -> str:
        """A page in which nothing names the main text: words in no block, blocks in no box, or a box of no or an odd name."""
        r, how = self.r, self.r.randrange(4)
        odd = lambda: r.choice(["", f' class="{"".join(r.choices("bcdfghjklmnpqrstvwxz", k=6))}"'])
        some = lambda kinds: [f"<div{odd()}>{self.links(r.randint(3, 9))}</div>" if r.random() < 0.3 else self.part(k) for k in kinds if r.random() < 0.3]
        alone = r.random() < 0.4
        before = [] if alone else some(("notice", "header", "nav", "ad", "form"))
        after = [] if alone else some(("side", "ad", "comments", "form", "footer", "nav"))
        head = f"<head><title>{self.words(2, 6)}</title></head>" if r.random() < 0.5 else ""
        if how == 0:
            lines = [self.prose() for _ in range(r.choice([1, 2, 3, 6]))] if r.random() < 0.85 else [self.words(1, 6)]
            text = r.choice(["<br>", "<br><br>", "\n\n", " "]).join(lines)
            if alone and r.random() < 0.6:
                return f"{MAIN}<html>{head}{text}</html>{MAIN}"
            first, last = ("".join(OTHER + x + OTHER for x in part) for part in (before, after))
            return f"<html>{head}{MAIN}<body>{first}{text}{last}</body>{MAIN}</html>"
        if how == 1:
            main = "".join(MAIN + x + MAIN for x in self.loose())
        else:
            tag = r.choice(["div", "div", "section", "td"])
            main = f"{MAIN}<{tag}{odd()}>{self.article() if r.random() < 0.6 else ''.join(self.loose())}</{tag}>{MAIN}"
            main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
        for _ in range(r.choice([0, 0, 1, 2])):
            main = f"<div{odd()}>{main}</div>"
        body = "".join(before) + main + "".join(after)
        return f"<html>{head}<body>{body}</body></html>" if r.random() < 0.7 else head + body

    def html(self) -> str:
        """The page, with the main text between marks MAIN and insets in it between marks OTHER (see `htmltext.labelled`)."""
        if self.plain:
            return self.bare()
        r = self.r
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        inner = self.article()
        main = f"{MAIN}<{tag}{self.named('main', 0.97 if tag in ('div', 'section') else 0.4)}>{inner}</{tag}>{MAIN}"
        if r.random() < 0.25:
            main = f"<main{self.named('wrap', 0.3)}>{main}{self.part('comments') if r.random() < 0.5 else ''}</main>"
        before = [k for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.45]
        after = [k for k in ("social", "side", "ad", "comments", "form", "notice", "footer", "nav") if r.random() < 0.4]
        r.shuffle(before)
        body = "".join(map(self.part, before)) + main + "".join(map(self.part, after))
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.named('wrap', 0.7)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"
