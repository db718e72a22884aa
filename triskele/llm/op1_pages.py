"""Generated pages of many layouts, with the main text marked, to train the extraction trees on."""

from __future__ import annotations

import random

MARK = "ⵣ"  # stands in every text run of the main text and nowhere else
_SYLLABLES = "an be co da er fi gu ha in jo ka le mi no or pe qui ra so ta un ve wi xo ya zu tion ment lich heit ción ada ez eau ou".split()
NAMES = {
    "nav": "nav menu main-menu navbar site-nav breadcrumbs topnav pagination toc tabs nav-links skip-links".split(),
    "header": "header site-header masthead topbar page-header branding logo".split(),
    "footer": "footer site-footer page-foot colophon legal copyright bottom-bar".split(),
    "side": "sidebar side widget related related-posts popular trending recommended rail share social-share tags more-stories".split(),
    "notice": "cookie-notice cookie consent gdpr-banner notice alert modal popup overlay".split(),
    "ad": "ad ads advert advertisement sponsored promo ad-slot banner-ad sponsor".split(),
    "form": "search-form newsletter signup login subscribe contact-form".split(),
    "comment": "comments comment-list responses discussion replies comment-thread reader-comments".split(),
    "content": "content article post entry-content story-body main-content article-body post-text page-content".split(),
}
TAGS = {
    "nav": ["nav", "div", "ul", "menu"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "side": ["aside", "div", "section"],
    "notice": ["div", "section", "dialog", "p"], "ad": ["div", "aside", "div", "p"], "form": ["form", "form", "div"], "comment": ["section", "div", "ol"],
}


class Maker:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.words = ["".join(rng.choices(_SYLLABLES, k=rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(400)]
        self.named = rng.random() < 0.8  # this page's elements have telling attributes
        self.semantic = rng.random() < 0.75  # this page uses sectioning elements
        self.closed = rng.random() < 0.7  # paragraphs and items are closed
        self.joiner = rng.choices([" ", " | ", "!! ", "*** "], [80, 10, 6, 4])[0]  # some pages hold tables or junk as text

    def sentence(self, low=2, high=24) -> str:
        n = self.r.randint(low, high)
        words = self.r.choices(self.words, k=n)
        s = " ".join(w + ("," if self.r.random() < 0.07 else "") for w in words)
        return s[:1].upper() + s[1:] + self.r.choices([".", "!", "?"], [9, 1, 1])[0]

    def phrase(self, low=1, high=5) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high)))

    def inline(self, text: str) -> str:
        x = self.r.random()
        if x < 0.08:
            return f"<b>{text}"  # never closed
        if x < 0.16:
            return text.replace(" ", " <em>", 1) + "</em>"
        if x < 0.26:
            return text.replace(" ", f' <a href="/{self.phrase(1, 1)}">', 1) + "</a>"
        if x < 0.32:
            return text + "<br>" + self.sentence()
        return text.replace(" ", " &amp; ", 1) if x < 0.4 else text

    def attrs(self, role: str) -> str:
        if not self.named and self.r.random() < 0.85:
            return ""
        name = self.r.choice(NAMES[role])
        more = f" {self.phrase(1, 1)}" if self.r.random() < 0.3 else ""
        return f' {self.r.choice(["class", "class", "id"])}="{name}{more}"'

    def wrap(self, role: str, inner: str) -> str:
        tag = TAGS[role][0] if self.semantic and self.r.random() < 0.7 else self.r.choice(TAGS[role])
        attrs = self.attrs(role)
        if not attrs and tag in ("div", "p", "section", "ul", "ol"):
            if role in ("notice", "ad", "comment") or self.r.random() < 0.5:  # some sign is left
                attrs = f' class="{self.r.choice(NAMES[role])}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, low=3, high=9) -> str:
        n, style = self.r.randint(low, high), self.r.random()
        if style < 0.7:
            end = "</li>" if self.closed else ""
            return "<ul>" + "".join(f'<li><a href="/{self.phrase(1, 1)}">{self.phrase(1, 3)}</a>{end}' for _ in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(f'<a href="#">{self.phrase(1, 3)}</a>' for _ in range(n))

    def noise(self, role: str, signed: bool = False) -> str:
        """An element of no main text; ``signed``: its name or attributes tell, as they must inside the article."""
        out = self._noise(role)
        while signed and not any(f'"{n}' in out or f"<{t}" in out for n in NAMES[role] for t in (TAGS[role][0],) if t not in ("div", "p")) and not any(f'"{n}' in out for n in NAMES[role]):
            out = self._noise(role)
        return out

    def _noise(self, role: str) -> str:
        r = self.r
        if role == "nav":
            return self.wrap(role, self.links())
        if role == "header":
            inner = r.choice([f"<h1>{self.phrase()}</h1>", f'<a href="/">{self.phrase(1, 3)}</a>', f"<div>{self.phrase()}</div>"])
            return self.wrap(role, inner + (f"<p>{self.sentence(3, 10)}</p>" if r.random() < 0.5 else "") + (self.links() if r.random() < 0.4 else ""))
        if role == "footer":
            text = f"&copy; {self.phrase(1, 2)} {r.choice(['&middot; ', '| ', ''])}{self.sentence(2, 30)}"
            return self.wrap(role, r.choice([text, f"<p>{text}</p>", self.links() + f"<p>{text}</p>", f"<div>{self.links(2, 5)}</div>{text}"]))
        if role == "side":
            body = r.choice([self.links(), "".join(f"<p>{self.sentence(4, 30)}</p>" for _ in range(r.randint(1, 4))), "".join(f"<h4>{self.phrase()}</h4><p>{self.sentence(5, 20)}</p>" for _ in range(r.randint(1, 4)))])
            return self.wrap(role, f"<h3>{self.phrase(1, 3)}</h3>{body}" if r.random() < 0.7 else body)
        if role == "notice":
            return self.wrap(role, r.choice(["<p>", ""]) + self.sentence(4, 30) + r.choice(["", f"<button>{self.phrase(1, 2)}</button>", f' <a href="#">{self.phrase(1, 2)}</a>']))
        if role == "ad":
            return r.choice([f"<!-- ad {r.randint(0, 99)} -->", ""]) + self.wrap(role, r.choice(["", "<p>"]) + " ".join(self.sentence(2, 18) for _ in range(r.randint(1, 3))))
        if role == "form":
            return self.wrap(role, f"<label>{self.phrase(1, 3)}</label><input name=q><button>{self.phrase(1, 2)}</button>" + (f"<p>{self.sentence()}</p>" if r.random() < 0.4 else ""))
        one = lambda: r.choice(["<li>", "<div>", '<div class="comment">', "<article>"]) + f"<b>{self.phrase(1, 2)}</b><p>" + " ".join(self.sentence() for _ in range(r.randint(1, 5))) + "</p>"
        end = lambda x: x + ("</li>" if x.startswith("<li") else "</article>" if x.startswith("<article") else "</div>")
        return self.wrap("comment", (f"<h3>{self.phrase(1, 3)}</h3>" if r.random() < 0.7 else "") + "".join(end(one()) for _ in range(r.randint(1, 8))))

    def block(self) -> str:
        """A block of main text; every text run carries the mark."""
        r, x = self.r, self.r.random()
        m = lambda s: MARK + s
        if x < 0.74:
            n = r.choices([1, 2, 3, 5, 9, 20], [5, 4, 4, 4, 2, 1])[0]
            text = " ".join(self.sentence(1, 22) for _ in range(n)) if r.random() < 0.85 else self.phrase(1, 3) + "."
            text = text.replace(" ", self.joiner)
            return f"<p>{self.inline(m(text))}" + ("</p>" if self.closed or r.random() < 0.5 else "")
        if x < 0.8:
            return f"<h{(k := r.randint(2, 4))}>{m(self.phrase(1, 7))}</h{k}>"
        if x < 0.88:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{m(self.inline(self.sentence(1, 16)))}" + "</li>" * self.closed for _ in range(r.randint(2, 7))) + f"</{tag}>"
        if x < 0.92:
            return f"<blockquote><p>{m(self.sentence())}</p></blockquote>"
        if x < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{m(self.phrase(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if x < 0.97:
            return f"<pre>{m(self.phrase(3, 12))}</pre>"
        return f"<figure><img src=x><figcaption>{m(self.sentence())}</figcaption></figure>"

    def page(self) -> str:
        r = self.r
        title = MARK + (self.phrase(1, 1 if r.random() < 0.3 else 12) if r.random() < 0.6 else self.sentence(1, 14))
        body = [self.block() for _ in range(r.choices([1, 2, 4, 7, 12, 25], [2, 3, 4, 4, 3, 1])[0])]
        inside = [x for x in ("ad", "side", "form", "notice") if r.random() < 0.15]
        for role in inside:
            body.insert(r.randint(0, len(body)), self.noise(role, True))
        head = f"<h1>{title}</h1>" if r.random() < 0.9 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        inner = head + (f"<div{self.attrs('content')}>{''.join(body)}</div>" if r.random() < 0.3 else "".join(body))
        tag = r.choice(["article", "article", "main", "section"]) if self.semantic else "div"
        attrs = self.attrs("content") if tag in ("div", "section") or r.random() < 0.3 else ""
        core = f"<{tag}{attrs}>{inner}</{tag}>"
        if r.random() < 0.05:
            core = inner
        comments = self.noise("comment") if r.random() < 0.35 else ""
        if comments and r.random() < 0.3 and core.endswith(f"</{tag}>"):
            core = core[: -len(tag) - 3] + self.noise("comment", True) + f"</{tag}>"
            comments = ""
        if r.random() < 0.25:
            core = f"<main>{core}{comments}</main>" if self.semantic else f'<div id="wrap">{core}{comments}</div>'
            comments = ""
        top = [self.noise(x) for x in ("header", "nav", "notice", "ad", "form") if r.random() < 0.55]
        r.shuffle(top)
        low = [self.noise(x) for x in ("side", "ad", "form", "nav", "notice") if r.random() < 0.3]
        r.shuffle(low)
        side = self.noise("side") if r.random() < 0.3 else ""
        page = "".join(top) + side + core + comments + "".join(low) + (self.noise("footer") if r.random() < 0.85 else "")
        page = f'<!DOCTYPE html><html><head><title>{self.phrase()}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{page}'
        return page if r.random() < 0.15 else page + "</body></html>"


def generate(pages: int, seed: int):
    """(page, mark): text runs that hold the mark are main text."""
    for k in range(pages):
        yield Maker(random.Random(seed * 1_000_003 + k)).page(), MARK
