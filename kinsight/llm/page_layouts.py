"""Seeded pages of many layouts whose blocks are marked as main text or not: what the extractor learns from."""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo ya zu en ar ol is".split()


class Layouts:
    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int = 4, most: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        return " ".join(words).capitalize() + self.r.choice("...!?")

    def prose(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(least, most)))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 6)))}</a></li>' for _ in range(n))

    def named(self, *names: str) -> str:
        """An opening name: a tag of its own, or a div with a class, id or role."""
        name = self.r.choice(names)
        if name.startswith("<"):
            return name[1:]
        return self.r.choice(['div class="{}"', 'div id="{}"', 'section class="{}"', 'div class="box {}"', 'div class="{}-wrap"']).format(name)

    def box(self, opening: str, inside: str, mark: int) -> str:
        return f'<{opening} data-k="{mark}">{inside}</{opening.split()[0]}>'

    def boilerplate(self) -> str:
        r = self.r
        kind = r.choice(["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "related", "share", "crumbs", "letter"])
        if kind == "nav":
            return self.box(self.named("<nav", "menu", "navigation", "navbar", "<nav class=\"main-nav\"", "<ul class=\"menu\""), f"<ul>{self.links(r.randint(2, 12))}</ul>", 0)
        if kind == "header":
            return self.box(self.named("<header", "header", "masthead", "site-header", "banner"), r.choice([f"<h1><a href='/'>{self.word()}</a></h1>", f"<p>{self.sentence(2, 6)}</p>", f"<div class='logo'>{self.word()}</div><p class='tagline'>{self.sentence(3, 8)}</p>"]), 0)
        if kind == "footer":
            return self.box(self.named("<footer", "footer", "site-footer", "copyright", "bottom"), r.choice([f"&copy; {self.word()}.com &middot; {self.sentence()}", f"<p>{self.prose(1, 3)}</p><ul>{self.links(3)}</ul>", f"<p>&copy; 2020 {self.word()}</p>"]), 0)
        if kind == "aside":
            return self.box(self.named("<aside", "sidebar", "widget", "rail", "<aside class=\"side\""), r.choice([f"<h3>{self.word()}</h3><ul>{self.links(r.randint(2, 8))}</ul>", f"<p>{self.prose(1, 4)}</p>", f"<h2>{self.sentence(2, 4)}</h2><p>{self.prose(1, 2)}</p><p>{self.prose(1, 3)}</p>"]), 0)
        if kind == "ad":
            return self.box(self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "<ins class=\"adsbygoogle\""), r.choice([self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>", f"<a href='/x'>{self.sentence()}</a>"]), 0)
        if kind == "notice":
            return self.box(self.named("cookie", "cookie-notice", "notice", "alert", "consent", "gdpr", "popup", "modal"), r.choice([f"{self.prose(1, 2)}<button>{self.word()}</button>", f"<p>{self.prose(1, 3)}</p>"]), 0)
        if kind == "form":
            return self.box(self.named("<form", "<form class=\"search\"", "<form id=\"login\"", "search-form"), f"<label>{self.word()}</label><input name=q><p>{self.sentence()}</p><button>{self.word()}</button>", 0)
        if kind == "comments":
            one = lambda: r.choice([f"<li class='comment'><p>{self.prose(1, 4)}</p></li>", f"<div class='comment'><b>{self.word()}</b><p>{self.prose(1, 4)}</p></div>", f"<p>{self.prose(1, 3)}</p>"])
            return self.box(self.named("comments", "comment-list", "discussion", "<section id=\"comments\"", "<ol class=\"commentlist\"", "responses", "replies"), f"<h3>{self.word()}</h3>" + "".join(one() for _ in range(r.randint(1, 6))), 0)
        if kind == "related":
            return self.box(self.named("related", "recommended", "more-stories", "related-posts"), f"<h4>{self.sentence(2, 4)}</h4><ul>{self.links(r.randint(2, 6))}</ul>", 0)
        if kind == "share":
            return self.box(self.named("share", "social", "social-share", "follow"), f"<a href='/f'>{self.word()}</a> <a href='/t'>{self.word()}</a>", 0)
        if kind == "crumbs":
            return self.box(self.named("breadcrumb", "breadcrumbs", "pagination", "pager"), " &gt; ".join(f"<a href='/{self.word()}'>{self.word()}</a>" for _ in range(r.randint(2, 4))), 0)
        return self.box(self.named("newsletter", "subscribe", "signup"), f"<p>{self.prose(1, 2)}</p><form><input><button>{self.word()}</button></form>", 0)

    def content_blocks(self) -> list[str]:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f'<h1 data-k="1">{self.sentence(1, 12)}</h1>')
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            x = r.random()
            if x < 0.68:
                text = self.prose(1, r.choice([1, 3, 8, 16]))
                text = r.choice([text, text, text, f"<b>{text}", f"{text} <a href='/x'>{self.word()}</a> {self.sentence()}", f"{self.sentence(1, 4)}<br>{text}"])
                out.append(f'<p data-k="1">{text}' + r.choice(["</p>", "</p>", "</p>", ""]))
            elif x < 0.76:
                out.append(f'<h2 data-k="1">{self.sentence(2, 6)}</h2>')
            elif x < 0.86:
                out.append('<ul data-k="1">' + "".join(f"<li>{self.sentence(2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.92:
                out.append(f'<blockquote data-k="1"><p>{self.prose(1, 3)}</p></blockquote>')
            elif x < 0.96:
                out.append('<table data-k="1">' + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f'<div data-k="1">{self.prose(1, 5)}</div>')
        return out

    def page(self) -> str:
        r = self.r
        blocks = self.content_blocks()
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            blocks.insert(r.randint(1, len(blocks)), self.boilerplate())
        opening = r.choice(["article", "article", "main", "article class=\"post\"", "div class=\"content\"", "div id=\"content\"", "div class=\"post\"", "div class=\"entry-content\"", "div class=\"article-body\"", "section class=\"story\"", "div id=\"main\"", "div", "div class=\"text\""])
        body = f"<{opening}>" + "".join(blocks) + f"</{opening.split()[0]}>"
        if r.random() < 0.25:
            body = f"<main>{body}</main>" if not opening.startswith("main") else f"<div class='container'>{body}</div>"
        before = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        after = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        whole = before + body + after
        if r.random() < 0.4:
            whole = f"<div class='{r.choice(['page', 'wrapper', 'container', 'site'])}'>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title><script>var t='</p>';</script></head><body>{whole}</body></html>"
