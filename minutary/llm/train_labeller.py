"""Trains the block labeller of ``html_main`` on generated pages, whose labels are known.

``python -m minutary.llm.train_labeller`` writes the weights and prints held-out accuracy. The
pages vary in layout (semantic, grid, content system, bare, nested boxes, layout table), in
whether anything has a telling name, in script and in how furniture interrupts the main text.
"""

from __future__ import annotations

import random

import numpy as np

from .html_main import DIM, HIDDEN, WEIGHTS, blocks, features, label

#: Words of plain prose, and words that stand in page furniture.
PROSE = "the of and to in a is that it was for on are as with his they at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part over new sound take only little work know place year live me back give most very after thing our just name good sentence man think say great where help through much before line right too mean old any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn here why ask went men read need land different home us move try kind hand picture again change off play spell air away animal house point page letter mother answer found study still learn should world".split()
_SCRIPTS = ("bcdfghjklmnpqrstvwxz:aeiouy", "bdfghklmnprstvz:aäeioöuü", "bcdfglmnpqrstv:aàeéèioôu", "bcdfglmnñprstv:aáeéioóu", "бвгдзклмнпрст:аеиоуы", "βγδκλμνπρσ:αεηιο")
_CUES = {
    "nav": "home about us contact products services news blog shop forum archive login register faq support team pricing start kontakt über uns accueil inicio sport politics business culture travel opinion weather video",
    "head": "welcome menu search login toggle navigation skip to content sign in subscribe language english logo your site slogan just another weblog since daily",
    "foot": "copyright \N{COPYRIGHT SIGN} 2019 2021 2024 all rights reserved terms privacy policy imprint impressum datenschutz mentions légales powered by theme contact address phone follow us sitemap cookies",
    "side": "recent posts categories archives tags popular latest trending most read about the author follow links calendar january march october 2020 2023",
    "ad": "advertisement sponsored ad buy now sale offer discount free shipping deal save % order today click here limited promotion anzeige werbung",
    "cookie": "we use cookies to improve your experience accept all reject settings consent privacy policy learn more agree by continuing",
    "notice": "notice attention our office is closed new please update your browser maintenance javascript is disabled important dismiss close",
    "news": "subscribe to our newsletter enter your email address sign up get the latest never miss weekly inbox unsubscribe at any time",
    "form": "name email message send submit search password username remember me reset required comment website phone",
    "comment": "reply says said wrote posted ago comments comment thanks great article i agree disagree report like share guest anonymous leave a am pm",
    "related": "related you may also like read more more from articles stories recommended next see also further previous",
    "share": "share tweet pin print email facebook twitter linkedin whatsapp follow like copy link",
    "crumb": "home \N{RIGHT-POINTING DOUBLE ANGLE QUOTATION MARK} > / blog news category archive",
    "pager": "previous next older newer post page 1 2 3 \N{LEFTWARDS ARROW} \N{RIGHTWARDS ARROW}",
    "toc": "contents 1 2 3 introduction overview table of on this page summary",
}
#: Class and id words of page furniture and of main text; a page may name them, or not.
_NAMES = {
    "nav": "nav menu navigation navbar topnav main-menu menu-item mainNav primary-menu links nav-list mega-menu",
    "head": "header masthead site-header top topbar branding banner page-head siteHeader brand logo-bar",
    "foot": "footer site-footer colophon bottom page-footer foot legal copyright footer-widgets subfooter",
    "side": "sidebar widget widget-area aside secondary rail right-col sidebar-primary col-side widget_archive sideBar",
    "ad": "ad ads advert advertisement banner-ad sponsor sponsored promo adsbygoogle ad-slot dfp commercial",
    "cookie": "cookie cookie-banner consent gdpr cookie-notice cc-window privacy-bar cookieConsent",
    "notice": "notice alert message info-bar announcement warning site-notice noscript-warning",
    "news": "newsletter subscribe signup mailing newsletter-box email-form optin cta inline-newsletter",
    "form": "form search-form login contact-form field form-group input-group wpcf7",
    "comment": "comments comment-list comment respond disqus discussion comment-body replies thread responses",
    "related": "related related-posts more-stories recommended also-like read-next teaser teaser-list further",
    "share": "share social share-buttons social-links sharing tools addtoany sharedaddy",
    "crumb": "breadcrumb breadcrumbs crumbs path trail yoast-breadcrumb",
    "pager": "pagination pager nav-links post-navigation page-numbers prev-next",
    "toc": "toc table-of-contents on-this-page toc-list jump-links",
    "main": "content main article post entry story body text entry-content post-content article-body main-content story-body page-content hentry single blog-post mainContent primary content-area prose markdown-body article__text",
    "neutral": "container row col wrapper inner outer wrap grid flex block box module clearfix section page site col-md-8 col-md-4 col-sm-12 layout column panel group region view app root unit",
}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
_CUES = {k: v.split() for k, v in _CUES.items()}
_TAGS = {"nav": ["nav"], "head": ["header"], "foot": ["footer"], "side": ["aside"], "form": ["form"], "comment": ["section", "div", "ol"], "related": ["section", "aside", "div"], "crumb": ["nav", "ol", "div"], "pager": ["nav", "div"], "news": ["form", "section", "aside", "div"], "toc": ["nav"], "cookie": ["div", "section", "dialog"]}
_ROLES = {"nav": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "form": "search"}


class Page:
    """One page; main text carries a mark that ``examples`` takes off again."""

    def __init__(self, r: random.Random):
        self.r = r
        consonants, vowels = r.choice(_SCRIPTS).split(":")
        made = ["".join(r.choice(consonants) + r.choice(vowels) + r.choice(["", "", r.choice(consonants)]) for _ in range(r.randint(1, 4))) for _ in range(r.choice([60, 150, 400]))]
        self.words = r.choice([PROSE, made, made, PROSE + made])
        self.dense = r.random() < 0.15  # a page whose main text has short blocks
        self.named, self.semantic, self.lazy = r.choice([0.0, 0.5, 0.9, 1.0, 1.0]), r.choice([0.0, 0.5, 1.0, 1.0]), r.random() < 0.15
        self.cued = r.choice([0.15, 0.5, 0.8])
        self.para = r.choice(["p"] * 7 + ["div"])
        self.noise = r.choice([""] * 8 + ["any"])  # signs between or behind words, in all texts of the page
        self.code = f"{r.choice(['css', 'sc', 'x', 'jss', 'c', 'a'])}-{''.join(r.choice('abcdefghijklmnopqrstuvwxyzABCDEFG0123456789') for _ in range(5))}"

    def some(self, p: float) -> bool:
        return self.r.random() < p

    def text(self, n: int, cue: str = "") -> str:
        r = self.r
        out, sentence = [], 0
        for _ in range(max(1, n)):
            w = r.choice(_CUES[cue]) if cue and self.some(self.cued if n < 15 else self.cued / 3) else r.choice(self.words) if self.some(0.97) else str(r.randint(1, 3000))
            out.append(w.capitalize() if not sentence and self.some(0.8) else w)
            sentence += 1
            if n > 6 and sentence > 4 and self.some(0.12):
                out[-1] += r.choice([".", ".", ".", "?", "!", ";"])
                sentence = 0
            elif n > 6 and self.some(0.08):
                out[-1] += r.choice([",", ",", ":"])
        if self.noise:
            mark = r.choice("!#$%*+-/:=?@^_|~\u2022\u00b7") * r.choice([1, 1, 2, 3])
            out = [x + r.choice([mark, " " + mark, ""]) for x in out]
        return " ".join(out) + (r.choice([".", ".", ".", "!", "?", ":"]) if n > 8 and self.some(0.9) else "")

    def link(self, body: str) -> str:
        return f'<a href="/{self.r.choice(["", "p/", "#"])}{self.r.randint(1, 999)}">{body}</a>'

    def attrs(self, *kinds: str) -> str:
        """class, id and role, from the names of the kinds."""
        r, found = self.r, []
        for k in kinds:
            if self.some(self.named):
                found += r.sample(_NAMES[k], r.choice([1, 1, 2]))
        if self.some(0.25):
            found.append(r.choice([self.code, f"{self.code}{r.randint(0, 9)}", r.choice(_NAMES["neutral"])]))
        out = ""
        if found and self.some(0.25):
            out += f' id="{found.pop(0)}"'
        if found:
            out += f' class="{" ".join(found)}"'
        if kinds[0] in _ROLES and self.some(0.1):
            out += f' role="{_ROLES[kinds[0]]}"'
        elif kinds[0] == "main" and self.some(0.05):
            out += ' role="main"'
        return out

    def tag(self, kind: str) -> str:
        return self.r.choice(_TAGS[kind]) if kind in _TAGS and self.some(self.semantic) else "div"

    def wrap(self, inner: str, depth: int) -> str:
        for _ in range(depth):
            inner = f"<div{self.attrs('neutral')}>{inner}</div>"
        return inner

    def close(self, name: str) -> str:
        return "" if self.lazy and self.some(0.5) else f"</{name}>"

    # page furniture

    def items(self, cue: str, n: int, words: tuple[int, int], linked: float) -> str:
        r, kind = self.r, self.r.choice(["ul", "ul", "ul", "p", "div", "flat", "bar", "br"])
        made = []
        for _ in range(n):
            t = self.text(r.randint(*words), cue)
            made.append(self.link(t) if self.some(linked) else t)
        if kind == "ul":
            return f"<ul{self.attrs('neutral')}>" + "".join(f"<li>{x}{self.close('li')}" for x in made) + "</ul>"
        if kind == "br":
            return "<br>".join(made)
        if kind == "flat":
            return f"<p>{r.choice([' | ', ' - ', ' ', ' &middot; ']).join(made)}</p>"
        if kind == "bar":
            return f"<div>{''.join(f'<span>{x}</span> ' for x in made)}</div>"
        return "".join(f"<{kind}>{x}</{kind}>" for x in made)

    def heading(self, cue: str) -> str:
        return f"<{(h := self.r.choice(['h2', 'h3', 'h4', 'div', 'strong']))}>{self.text(self.r.randint(1, 4), cue)}</{h}>"

    def teasers(self, cue: str) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, 5)):
            t = f"<{(h := r.choice(['h3', 'h4', 'div', 'li']))}>{self.link(self.text(r.randint(3, 10), cue))}</{h}>"
            if self.some(0.6):
                t += f"<p>{self.text(r.randint(8, 45))}</p>"
            out.append(t if self.some(0.5) else f"<div{self.attrs('neutral')}>{t}</div>")
        return "".join(out)

    def other(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            inner = self.items(kind, r.randint(2, 14), (1, 3), 0.95)
        elif kind == "head":
            inner = (f"<{(h := r.choice(['h1', 'div', 'p', 'a']))}>{self.text(r.randint(1, 4), kind)}</{h}>" if self.some(0.8) else "") + (f"<p>{self.text(r.randint(3, 9), kind)}</p>" if self.some(0.4) else "")
            inner += self.other("nav") if self.some(0.5) else ""
        elif kind == "foot":
            inner = "".join(f"<div{self.attrs('neutral')}>{self.heading(kind)}{self.items(kind, r.randint(2, 6), (1, 3), 0.8)}</div>" for _ in range(r.choice([0, 0, 1, 3])))
            inner += self.items(kind, r.randint(0, 4), (1, 3), 0.8) + f"<{(h := r.choice(['p', 'div', 'small']))}>{r.choice(['&copy; ', 'Copyright ', ''])}{self.text(r.randint(2, 30), kind)}</{h}>"
            inner += self.other("form") if self.some(0.1) else ""
        elif kind == "side":
            inner = ""
            for _ in range(r.randint(1, 4)):
                k = r.choice([lambda: self.items(kind, r.randint(2, 8), (1, 7), 0.9), lambda: f"<p>{self.text(r.randint(8, 50), kind)}</p>", lambda: self.other("form"), lambda: self.teasers(kind), lambda: self.other("ad")])
                inner += f"<{(w := r.choice(['div', 'section', 'div', 'li']))}{self.attrs('side')}>{self.heading(kind)}{k()}</{w}>"
        elif kind == "ad":
            inner = r.choice([lambda: self.text(r.randint(2, 25), kind), lambda: f"<p>{self.text(r.randint(2, 25), kind)}</p>", lambda: self.link(self.text(r.randint(2, 9), kind)), lambda: self.heading(kind) + f"<p>{self.text(r.randint(4, 30), kind)}</p>{self.link(self.text(2, kind))}"])()
        elif kind in ("cookie", "notice"):
            inner = f"<p>{self.text(r.randint(4, 35), kind)}</p>" if self.some(0.6) else self.text(r.randint(4, 30), kind)
            inner += "".join(f"<button>{self.text(r.randint(1, 2), kind)}</button>" for _ in range(r.randint(0, 2)))
        elif kind == "news":
            inner = self.heading(kind) + (f"<p>{self.text(r.randint(5, 25), kind)}</p>" if self.some(0.7) else "") + f"<input type=email><button>{self.text(r.randint(1, 2), kind)}</button>"
        elif kind == "form":
            inner = "".join(f"<{(h := r.choice(['label', 'p', 'div', 'label']))}>{self.text(r.randint(1, 3), kind)}</{h}><input name=x>" for _ in range(r.randint(1, 4))) + f"<button>{self.text(r.randint(1, 2), kind)}</button>"
            inner += "<select>" + "".join(f"<option>{self.text(1)}" for _ in range(3)) + "</select>" if self.some(0.2) else ""
        elif kind == "comment":
            inner = self.heading(kind) if self.some(0.7) else ""
            for _ in range(r.randint(1, 6)):
                who = f"<{(h := r.choice(['div', 'p', 'cite', 'h4', 'footer']))}>{self.text(r.randint(1, 5), kind)}</{h}>" if self.some(0.85) else ""
                one = who + "".join(f"<p>{self.text(r.randint(3, 60), kind)}</p>" for _ in range(r.choice([1, 1, 2]))) + (f"<div>{self.link(self.text(1, kind))}</div>" if self.some(0.5) else "")
                inner += f"<{(w := r.choice(['div', 'li', 'article', 'div']))}{self.attrs('comment')}>{one}</{w}>"
            inner += self.other("form") if self.some(0.4) else ""
        elif kind == "related":
            inner = self.heading(kind) + (self.teasers(kind) if self.some(0.5) else self.items(kind, r.randint(2, 6), (3, 10), 1.0))
        else:
            inner = self.items(kind, r.randint(2, 6), (1, 3) if kind != "toc" else (1, 5), 0.9)
        name = self.tag(kind)
        inner = inner if self.some(0.6) else self.wrap(inner, 1)
        return f"<{name}{self.attrs(kind)}>{inner}</{name}>"

    # main text

    def body(self, n: int, inline: bool = True) -> str:
        r, t = self.r, self.text(n).split(" ")
        if inline and n > 6:
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(t))
                t[k] = r.choice([self.link, lambda x: f"<b>{x}</b>", lambda x: f"<em>{x}</em>", lambda x: f"<code>{x}</code>", lambda x: x + "<br>", lambda x: f"<span>{x}</span>", lambda x: f"{x}<sup>[{r.randint(1, 9)}]</sup>"])(t[k])
        return "\x01" + " ".join(t)

    def main_block(self) -> str:
        r, k = self.r, self.r.random()
        n = r.choice([1, 2, 4, 8, 12]) if self.dense else r.choice([1, 3, 8, 15, 25, 40, 60, 90, 130])
        if k < 0.58:
            return f"<{self.para}{self.attrs('neutral') if self.some(0.15) else ''}>{self.body(n)}{self.close('p') if self.para == 'p' else '</div>'}"
        if k < 0.66:
            return f"<{(h := r.choice(['h2', 'h2', 'h3', 'h4']))}>{self.body(r.randint(1, 7), False)}</{h}>"
        if k < 0.74:
            name, linked = r.choice(["ul", "ul", "ol"]), self.some(0.3)
            each = lambda: "\x01" + self.link(self.text(r.randint(2, 9))) + (" " + self.text(r.randint(3, 20)) if self.some(0.4) else "") if linked else self.body(r.randint(1, 25))
            return f"<{name}>" + "".join(f"<li>{each()}{self.close('li')}" for _ in range(r.randint(2, 7))) + f"</{name}>"
        if k < 0.79:
            return f"<blockquote{self.attrs('neutral')}><p>{self.body(r.randint(5, 40))}</p>" + (f"<cite>{self.body(3, False)}</cite>" if self.some(0.2) else "") + "</blockquote>"
        if k < 0.84:
            return f"<figure><img src=x.jpg alt=''><figcaption>{self.body(r.randint(2, 18), False)}</figcaption></figure>"
        if k < 0.88:
            rows = "".join("<tr>" + "".join(f"<{(c := 'th' if not i else 'td')}>\x01{self.text(r.randint(1, 3))}{self.close(c)}" for _ in range(3)) + "</tr>" for i in range(r.randint(2, 5)))
            return f"<table{self.attrs('neutral')}>{rows}</table>"
        if k < 0.91:
            return f"<pre><code>\x01{self.text(r.randint(3, 20)).replace(' ', chr(10))}</code></pre>"
        if k < 0.93:
            return "<dl>" + "".join(f"<dt>\x01{self.text(r.randint(1, 3))}<dd>{self.body(r.randint(3, 25))}" for _ in range(r.randint(1, 4))) + "</dl>"
        if k < 0.96:
            return f"<div{self.attrs('neutral')}>{self.body(n)}</div>"
        if k < 0.98:
            return f"<p>\x01{self.link(self.text(r.randint(3, 14)))}</p>"
        return f"<details><summary>{self.body(r.randint(2, 6), False)}</summary><p>{self.body(n)}</p></details>"

    def main(self) -> str:
        r = self.r
        title = f"<{(h := r.choice(['h1', 'h1', 'h1', 'h2']))}{self.attrs('neutral')}>{self.body(r.randint(1, 12), False)}</{h}>" if self.some(0.92) else ""
        if title and self.some(0.4):
            title += "".join(f"<{(t := r.choice(['p', 'div', 'div', 'address']))}{self.attrs('neutral')}>\x01{r.choice(['By ', 'Posted on ', 'von ', '', ''])}{self.text(r.randint(1, 5))}</{t}>" for _ in range(r.choice([1, 1, 2])))
        if title and self.some(0.45):
            title = f"<{(t := r.choice(['header', 'header', 'div', 'hgroup']))}{self.attrs('neutral', 'main') if self.some(0.6) else ''}>{title}</{t}>"
        out, n = [], r.choice([1, 1, 1, 2, 2, 3, 3, 5, 8, 13, 20, 34])
        for k in range(n):
            out.append(self.main_block())
            if self.some(0.7 / n if n > 2 else 0):
                out.append(self.other(r.choice(["ad", "news", "related", "side", "share", "toc", "ad", "news"])))
        inner = "".join(out)
        if self.some(0.3):
            inner = f"<div{self.attrs('main')}>{inner}</div>"
        tail = "".join(self.other(k) for k in ("share", "related", "pager") if self.some(0.12)) + (f"<footer{self.attrs('foot') if self.some(0.5) else ''}>{self.items('share', 2, (1, 4), 0.7)}</footer>" if self.some(0.12) else "")
        return (self.other("crumb") if self.some(0.08) else "") + title + inner + tail

    def html(self) -> str:
        r = self.r
        before = [k for k, p in (("cookie", 0.12), ("notice", 0.12), ("head", 0.6), ("nav", 0.7), ("ad", 0.25), ("crumb", 0.15), ("form", 0.1)) if self.some(p)]
        if self.some(0.3):
            r.shuffle(before)
        after = [k for k, p in (("share", 0.15), ("related", 0.25), ("comment", 0.3), ("pager", 0.15), ("news", 0.15), ("ad", 0.15), ("foot", 0.8), ("cookie", 0.06)) if self.some(p)]
        side = self.other("side") if self.some(0.45) else ""
        early = self.some(0.3)
        layout = r.choice(["semantic", "semantic", "grid", "cms", "bare", "soup", "soup", "table"])
        inner = self.main()
        if self.some(0.02):
            inner = ""
        if layout == "semantic":
            whole = f"<article{self.attrs('main')}>{inner}</article>" if self.some(0.7) else inner
            whole = f"<main{self.attrs('main')}>{whole}</main>" if self.some(0.5) or not whole.startswith("<article") else whole
        elif layout == "cms":
            whole = f"<div{self.attrs('main')}><{(t := r.choice(['div', 'article', 'section']))}{self.attrs('main')}>{inner}</{t}></div>"
        elif layout == "soup":
            whole = self.wrap(f"<div{self.attrs(r.choice(['main', 'main', 'neutral']))}>{inner}</div>", r.randint(0, 3))
        else:
            whole = f"<div{self.attrs('main', 'neutral')}>{inner}</div>" if layout == "grid" and self.some(0.5) else inner
        pre, post = "".join(self.other(k) for k in before), "".join(self.other(k) for k in after)
        if layout == "grid":
            cells = [f"<div{self.attrs('neutral')}>{whole}</div>"] + ([f"<div{self.attrs('neutral')}>{side}</div>"] if side else [])
            whole = self.wrap("".join(cells[::-1] if early else cells), r.randint(1, 2))
        elif layout == "table":
            cells = [f"<td{self.attrs('neutral') if self.some(0.3) else ''} valign=top>{whole}</td>"] + ([f"<td width=150>{r.choice([side, self.items('nav', r.randint(2, 9), (1, 3), 0.95)])}</td>"] if self.some(0.8) else [])
            head, foot = ((f"<tr><td colspan=2>{x}</td></tr>" if x and self.some(0.6) else x) for x in (pre, post))
            pre, post = (head, "") if head.startswith("<tr") else ("", ""), foot
            inside = "".join(cells[::-1] if early or self.some(0.5) else cells)
            return self.shell(f"{'' if pre[0] else head}<table{self.attrs('neutral') if self.some(0.3) else ''} border=0>{pre[0]}<tr>{inside}</tr>{post if post.startswith('<tr') else ''}</table>{'' if post.startswith('<tr') else post}")
        else:
            whole = side + whole if early else whole + side
        whole = self.wrap(whole, r.choice([0, 0, 1, 2]))
        if self.some(0.2):
            return self.shell(self.wrap(pre + whole + post, r.randint(1, 2)))
        return self.shell(pre + whole + post)

    def shell(self, body: str) -> str:
        end = "" if self.lazy else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.text(4)}</title><script>var a='<p>no</p>';</script></head><body{self.attrs('neutral') if self.some(0.3) else ''}>{body}{end}"


def page(r: random.Random) -> str:
    return Page(r).html()


def examples(n: int, seed: int):
    r, known = random.Random(seed), {}
    xs, ys = [], []
    for _ in range(n):
        found = blocks(page(r), known)
        ys.append(np.array([t.startswith("\x01") for _, t, _ in found], bool))
        xs.append(features([(p, t.lstrip("\x01"), min(k, len(t.lstrip("\x01")))) for p, t, k in found], known))
    return xs, ys


def _forward(x, keep, w, side):
    steps = range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1)
    gates, saved = x @ w[f"x{side}"] + w[f"b{side}"], {}
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.zeros((x.shape[0], x.shape[1], HIDDEN), np.float32)
    for t in steps:
        z = gates[t] + h @ w[f"h{side}"]
        i, f, o = np.split(1 / (1 + np.exp(-z[:, : 3 * HIDDEN])), 3, axis=1)
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        k = keep[t][:, None]
        saved[t] = (h, c, i, f, o, g, np.tanh(new), k)
        c, h = np.where(k, new, c), np.where(k, o * np.tanh(new), h)
        out[t] = h
    return out, saved


def _backward(x, dout, saved, w, side, grad):
    steps = range(x.shape[0] - 1, -1, -1) if side == "f" else range(x.shape[0])
    dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
    dz_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
    for t in steps:
        h, c, i, f, o, g, tc, k = saved[t]
        dh = dh + dout[t]
        live_h, live_c = dh * k, dc * k
        dnew = live_c + live_h * o * (1 - tc * tc)
        dz = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), live_h * tc * o * (1 - o), dnew * i * (1 - g * g)), axis=1)
        dz_all[t] = dz
        grad[f"h{side}"] += h.T @ dz
        dh, dc = dh * ~k + dz @ w[f"h{side}"].T, dc * ~k + dnew * f
    grad[f"x{side}"] += x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, dz_all.shape[2])
    grad[f"b{side}"] += dz_all.sum((0, 1))


def train(pages: int = 18_000, epochs: int = 5, seed: int = 7, rate: float = 0.006) -> dict:
    xs, ys = examples(pages, seed)
    r = np.random.default_rng(seed)
    w = {}
    for side in "fr":
        w[f"x{side}"], w[f"h{side}"] = r.normal(0, 0.15, (DIM, 4 * HIDDEN)), r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        w[f"b{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        w[f"o{side}"] = r.normal(0, 0.3, HIDDEN)
    w["o"] = np.zeros(1)
    w = {k: x.astype(np.float32) for k, x in w.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    order = sorted((i for i in range(pages) if len(xs[i])), key=lambda i: len(xs[i]))
    for epoch in range(epochs):
        groups = [order[i : i + 32] for i in range(0, len(order), 32)]
        r.shuffle(groups)
        loss = n = 0
        for group in groups:
            steps = max(len(xs[i]) for i in group)
            x, y, keep = np.zeros((steps, len(group), DIM), np.float32), np.zeros((steps, len(group)), np.float32), np.zeros((steps, len(group)), bool)
            for k, i in enumerate(group):
                x[: len(xs[i]), k], y[: len(xs[i]), k], keep[: len(xs[i]), k] = xs[i], ys[i], True
            hf, sf = _forward(x, keep, w, "f")
            hr, sr = _forward(x, keep, w, "r")
            p = 1 / (1 + np.exp(-(hf @ w["of"] + hr @ w["or"] + w["o"])))
            loss -= (np.log(np.where(y > 0, p, 1 - p) + 1e-9) * keep).sum()
            n += keep.sum()
            d = ((p - y) * keep / keep.sum()).astype(np.float32)
            grad = {k: np.zeros_like(q) for k, q in w.items()}
            grad["o"] += d.sum()
            for side, h, saved in (("f", hf, sf), ("r", hr, sr)):
                grad[f"o{side}"] += np.einsum("tp,tph->h", d, h)
                _backward(x, d[:, :, None] * w[f"o{side}"], saved, w, side, grad)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - rate * 0.6**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / n:.4f}", flush=True)
    return {k: x.astype(np.float32) for k, x in w.items()}


def accuracy(w: dict, pages: int = 500, seed: int = 99) -> float:
    xs, ys = examples(pages, seed)
    both = np.concatenate((w["xf"], w["xr"]), axis=1)
    return float(np.mean(np.concatenate([a == b for a, b in zip(label([x @ both for x in xs], w), ys)])))


if __name__ == "__main__":
    weights = train()
    np.savez_compressed(WEIGHTS, **weights)
    print("held-out accuracy", accuracy(weights))
