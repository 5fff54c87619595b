"""Made-up web pages whose main text is known: what the costs of ``html`` are learnt from.

A page is a site's furniture around one article.  Layouts, element names, class
names and their misuse are drawn at random, so that no name decides alone: an
article may stand in ``<article>``, in named or in bare ``<div>``s, its class
may hold words that furniture uses ("tag-news", "with-sidebar"), and furniture
may have no name at all.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da er fi ga ho in ju ka lo mi no or pe qua ri su ta un ve wi ya ze tion ing ment ell ous".split()
ARTICLE_NAMES = ["article", "post", "post type-post tag-news category-legal", "entry-content", "story", "story legal-affairs", "content", "main-content", "body",
                 "article-body text", "post-body", "article__body", "single-post has-sidebar", "page-content", "blog-post tag-tips", "entry hentry", "text", "news-item share-ready"]
FURNITURE_NAMES = {
    "menu": ["nav", "menu", "main-menu", "navbar", "site-nav", "top-nav menu", "breadcrumb", "breadcrumbs", "toolbar"],
    "head": ["header", "site-header", "masthead", "top-bar", "banner", "branding"],
    "foot": ["footer", "site-footer", "copyright", "legal", "disclaimer", "colophon", "foot"],
    "side": ["sidebar", "side", "widget", "widget-area", "related", "related-posts", "recommended", "popular", "trending", "more-stories", "tags", "tag-cloud", "archive-list"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "announcement", "popup", "modal", "overlay"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot", "banner-ad"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "contact-form", "search-box"],
    "share": ["share", "social", "sharing", "share-buttons", "social-links", "pagination", "pager", "author-box", "meta"],
    "comment": ["comments", "comment-list", "comment", "respond", "replies", "disqus", "discussion", "reader-comments", "responses", "commentlist"],
}
LEADS = {
    "comment": ["Comments", "3 comments", "Leave a reply", "12 responses", "Reader comments", "Discussion"], "side": ["Related", "Read also", "Most popular", "More stories", "Tags", "You may also like"],
    "form": ["Newsletter", "Subscribe", "Search", "Log in", "Sign up"], "share": ["Share this", "Follow us"], "advert": ["Advertisement", "Sponsored"], "notice": ["Notice", "Cookies"],
}
PHRASES = ["We use cookies on this site.", "This site uses cookies, accept them.", "Copyright", "All rights reserved.", "\u00a9", "Reply"]
TAGS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}


def telling_words() -> frozenset[str]:
    """The words of short texts that are not made up, but for small ones, which stand anywhere."""
    texts = [*PHRASES, *(t for lead in LEADS.values() for t in lead)]
    return frozenset(w for t in texts for w in t.lower().replace(".", "").replace(",", "").split() if len(w) > 4 or w == "\u00a9")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi))).capitalize()

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(3, 16) + self.r.choice((".", ".", ".", "?", "!")) for _ in range(self.r.randint(lo, hi)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def named(self, tag: str, names: list[str], inner: str, chance: float) -> str:
        r, attr = self.r, ""
        if r.random() < chance:
            name = r.choice(names)
            if names is ARTICLE_NAMES and r.random() < 0.3:  # names of furniture say little in such places
                other = r.choice(r.choice(list(FURNITURE_NAMES.values())))
                name += " " + r.choice((f"{other}-affairs", f"tag-{other}", f"category-{other}", f"{other}ed", f"with-{other}"))
            attr = f' {r.choice(("class", "class", "id"))}="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def furniture(self, kind: str, named: bool) -> str:
        r = self.r
        lead = f"<{t}>{r.choice(LEADS[kind])}</{t}>" if kind in LEADS and r.random() < 0.6 and (t := r.choice(("h2", "h3", "h4", "p", "div"))) else ""
        if kind == "menu":
            links = [self.link(self.words(1, 3)) for _ in range(r.randint(2, 9))]
            inner = f"<ul><li>{'</li><li>'.join(links)}</li></ul>" if r.random() < 0.7 else r.choice((" | ", " ", " &middot; ")).join(links)
        elif kind == "head":
            inner = r.choice((f"<h1>{self.words(1, 3)}</h1>", self.words(1, 4), f"<p>{self.words(1, 3)}</p><p>{self.words(3, 8)}</p>"))
        elif kind == "foot":
            inner = r.choice((f"&copy; 20{r.randint(10, 30)} {self.words(1, 4)}", f"<p>&copy; {self.words(1, 3)} &middot; {self.words(2, 5)}.</p>", f"Copyright {self.words(1, 3)}. All rights reserved.",
                              f"<p>{self.sentences(1, 2)}</p><ul><li>{self.link(self.words(1, 2))}</li><li>{self.link(self.words(1, 2))}</li></ul>"))
        elif kind == "side":
            inner = r.choice((lambda: "<ul>" + "".join(f"<li>{self.link(self.words(2, 8))}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
                              lambda: "".join(f"<p>{self.link(self.words(3, 9))}</p>" for _ in range(r.randint(1, 4))), lambda: f"<p>{self.sentences(1, 2)}</p>"))()
        elif kind == "notice":
            inner = r.choice((PHRASES[0] + " ", PHRASES[1] + " ", "")) + self.sentences(1, 1)
        elif kind == "advert":
            inner = r.choice((self.sentences(1, 2), self.link(self.words(3, 8))))
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=x><button>Go</button>" + (f"<p>{self.words(4, 9)}</p>" if r.random() < 0.4 else "")
        elif kind == "share":
            inner = " ".join(self.link(self.words(1, 2)) for _ in range(r.randint(2, 5)))
        else:
            one = lambda: r.choice((lambda: f"<div><b>{self.words(1, 2)}</b><p>{self.sentences(1, 3)}</p>{self.link('Reply') if r.random() < 0.5 else ''}</div>",
                                    lambda: f"<p>{self.words(1, 2)}: {self.sentences(1, 3)}</p>", lambda: f"<li>{self.sentences(1, 3)}</li>"))()
            lead = lead or f"<h3>{r.choice(LEADS[kind])}</h3>" if not named else lead
            inner = "".join(one() for _ in range(r.randint(1, 5)))
        tag = TAGS.get(kind) if r.random() < 0.5 else None
        tag = tag or r.choice(("div", "div", "section"))
        return self.named(tag, FURNITURE_NAMES[kind], lead + inner, 1.0 if named else 0.0)

    def article(self, named: bool) -> tuple[str, list[str]]:
        r, blocks, parts = self.r, [], []

        def add(tag: str, text: str, shown: str | None = None, close: bool = True) -> None:
            blocks.append(text)
            parts.append(f"<{tag}>{shown or text}" + (f"</{tag}>" if close else ""))

        title = self.words(2, 9)
        if r.random() < 0.75:
            add("h1", title)
            if r.random() < 0.3:
                parts[-1] = f"<header>{parts[-1]}</header>"
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.7:
                text = self.sentences(1, 6)
                shown = text
                if r.random() < 0.3:
                    first, _, rest = text.partition(" ")
                    shown = f"{self.link(first)} {rest}" if r.random() < 0.5 else f"<b>{first}</b> {rest}"
                add("p", text, shown)
            elif kind < 0.8:
                add(r.choice(("h2", "h3")), self.words(1, 7))
            elif kind < 0.9:
                parts.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    add("li", self.words(2, 14))
                parts.append("</ul>")
            elif kind < 0.95:
                add("blockquote", self.sentences(1, 2))
            else:
                add("p", self.words(1, 3) + ".")
        if r.random() < 0.25:
            at = r.randrange(1, len(parts) + 1)
            parts.insert(at, self.furniture(r.choice(("advert", "side", "share")), True))
        inner = "".join(parts)
        for _ in range(r.randint(0, 2)):
            inner = self.named("div", ARTICLE_NAMES, inner, 0.6 if named else 0.0)
        return self.named(r.choice(("article", "article", "main", "div", "section")) if named else "div", ARTICLE_NAMES, inner, 0.6 if named else 0.0), blocks

    def page(self) -> tuple[str, list[str]]:
        """(html, blocks of the main text)."""
        r, named = self.r, self.r.random() < 0.7
        article, blocks = self.article(named)
        before = [k for k, p in (("notice", 0.3), ("head", 0.6), ("menu", 0.8), ("form", 0.2), ("advert", 0.4), ("side", 0.2)) if r.random() < p]
        after = [k for k, p in (("share", 0.3), ("comment", 0.4), ("side", 0.5), ("form", 0.3), ("advert", 0.3), ("menu", 0.15), ("notice", 0.2), ("foot", 0.85)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.15:
            before, after = [], []
        middle = article
        if r.random() < 0.15:  # comments inside the element of the article
            middle = article[: article.rindex("</")] + self.furniture("comment", True) + article[article.rindex("</") :]
            after = [k for k in after if k != "comment"]
        body = "".join(self.furniture(k, named) for k in before) + middle + "".join(self.furniture(k, named) for k in after)
        if r.random() < 0.4:
            body = self.named("div", ["wrapper", "page", "container", "site with-sidebar", "wrap has-sidebar no-comments", "layout"], body, 0.8)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body>{body}</body></html>", blocks


def pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
