"""Labelled pages to train the extraction model: composed by rule from the parts pages have.

``data-main`` marks what belongs to the main text (1) or not (0); the model never sees it.
"""

from __future__ import annotations

import random

# Words that name parts of pages, in classes, ids and roles. Fixed values, for training only.
OUTSIDE = {
    "menu": "nav navbar navigation menu topmenu mainmenu breadcrumb breadcrumbs toc pagination "
            "pager tabs dropdown skip links",
    "header": "header masthead topbar top branding logo site banner hero toolbar",
    "footer": "footer foot bottom copyright legal colophon imprint credits",
    "sidebar": "sidebar side aside rail widget widgets related recommended popular trending more "
               "recent teaser archive categories tags",
    "notice": "notice cookie cookies consent gdpr privacy popup modal overlay alert message "
              "warning subscribe newsletter paywall signup promo",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promotion banner promo "
              "commercial affiliate dfp",
    "form": "form search login signin register contact subscribe newsletter",
    "comments": "comments comment commentlist reply replies respond discussion disqus responses "
                "feedback reader user reviews thread",
    "social": "share sharing social follow facebook twitter like buttons author byline bio",
}
INSIDE = "article content main post entry story body text maincontent page blog single news"
LETTERS = ["ba", "re", "to", "ni", "sol", "ka", "mer", "du", "li", "an", "est", "or"]


class _Maker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.random
        n = r.randint(least, most)
        return " ".join(
            "".join(r.choice(LETTERS) for _ in range(r.randint(1, 4))) for _ in range(n))

    def sentence(self, least: int = 4, most: int = 18) -> str:
        return self.words(least, most).capitalize() + "."

    def paragraph(self) -> str:
        r = self.random
        text = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
        if r.random() < 0.2:
            text = text.replace(" ", ' <a href="/x">', 1) + "</a>"
        if r.random() < 0.1:
            text = " | ".join(text.split()).upper()
        return text

    def named(self, names: str, chance: float = 0.85) -> str:
        r = self.random
        if r.random() > chance:
            return ""
        own = r.sample(names.split(), r.choice([1, 1, 2]))
        return f' {r.choice(["class", "class", "id"])}="{r.choice("- _").join(own)}"'

    def links(self) -> str:
        r = self.random
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(2, 9))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " ".join(items)

    def outside(self, kind: str) -> str:
        r = self.random
        tags = {
            "menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"],
            "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "p", "aside"],
            "advert": ["div", "aside", "section"], "form": ["form", "div"],
            "comments": ["section", "div", "ol", "ul"], "social": ["div", "ul", "p"],
        }[kind]
        tag = r.choice(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form")
        name = self.named(OUTSIDE[kind], 0.5 if plain else 1.0)
        if kind in ("menu", "social"):
            inner = self.links()
        elif kind == "comments":
            inner = "".join(
                f"<div><p>{self.paragraph()}</p></div>" if r.random() < 0.5
                else f"<p>{self.paragraph()}</p>" for _ in range(r.randint(1, 4)))
            inner = f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + inner
        elif kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 4)}</h2>",
                              f"<h1>{self.words(1, 3)}</h1><p>{self.sentence()}</p>",
                              f"<div>{self.words(1, 3)}</div>{self.links()}", self.sentence()])
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input><button>ok</button>"
        else:
            inner = r.choice([
                self.sentence(), f"<p>{self.sentence()}</p>", self.links(),
                f"<h3>{self.words(1, 4)}</h3><p>{self.sentence(3, 30)}</p>",
                f"<p>{self.sentence()}</p>{self.links()}", self.paragraph(),
                f"<p>{self.paragraph()}</p><p>{self.paragraph()}</p>"])
        return f'<{tag}{name} data-main="0">{inner}</{tag}>'

    def inside(self) -> str:
        r = self.random
        blocks = [f"<h1>{self.words(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 5, 9])):
            blocks.append(r.choices([
                f"<p>{self.paragraph()}</p>", f"<h2>{self.words(1, 6)}</h2>",
                f"<blockquote><p>{self.paragraph()}</p></blockquote>",
                "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(3)) + "</ul>",
                f"<div>{self.paragraph()}</div>", f"<p>{self.words(1, 2)}</p>",
                f"<pre>{self.paragraph()}</pre>",
                f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>",
                f"<figure><figcaption>{self.sentence()}</figcaption></figure>",
            ], [10, 2, 1, 1, 2, 1, 1, 1, 1])[0])
        for kind in r.sample(["advert", "advert", "social", "notice", "sidebar", "comments", "menu"],
                             r.choice([0, 1, 1, 2])):
            at = len(blocks) if kind == "comments" else r.randint(0, len(blocks))
            blocks.insert(at, self.outside(kind))
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        name = self.named(INSIDE, 0.4 if tag in ("article", "main") else 1.0)
        inner = "".join(blocks)
        if r.random() < 0.25:
            inner = f"<div>{inner}</div>"
        return f'<{tag}{name} data-main="1">{inner}</{tag}>'

    def page(self) -> str:
        r = self.random
        before = [k for k in ("notice", "header", "menu", "advert", "form") if r.random() < 0.45]
        after = [k for k in ("comments", "sidebar", "advert", "social", "form", "notice", "footer")
                 if r.random() < 0.45]
        body = "".join(map(self.outside, before)) + self.inside() + "".join(
            map(self.outside, after))
        if r.random() < 0.4:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{body}</div>'
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def labelled_pages(number: int = 300, seed: int = 3) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(number)]
