"""Labelled training pages for HTML extraction, made from a seed: each is a list of leaf blocks with
their surroundings, in varied layouts, and a label for each block (1: main text)."""

from __future__ import annotations

import random

#: Class and id names that pages give to parts beside the main text, and to the main text.
BESIDE = {
    "nav": "nav navbar menu navigation topnav mainmenu breadcrumb breadcrumbs pagination pager links toc skip",
    "header": "header masthead banner logo topbar site-title branding tagline",
    "footer": "footer bottom copyright legal colophon credits imprint",
    "aside": "sidebar side aside widget related recommended promo trending popular more rail teaser",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored sponsors commercial banner-ad",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay message subscribe newsletter paywall",
    "form": "form search login signup register contact newsletter-form field",
    "comment": "comment comments reply replies discussion respond reader-comments disqus feedback thread",
    "share": "share social sharing follow tags meta byline toolbar buttons",
}
MAIN = "article content post entry main story body text article-body post-content entry-content main-content prose"
#: Names that say nothing, for either.
NEUTRAL = "c1 c2 x y box wrap wrapper inner outer row col grid block page container layout-1 s-2 cell"
_WORDS = "the of and to in is was for that it with as on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def _sentence(r: random.Random, least: int, most: int) -> str:
    n = r.randint(least, most)
    made = ["".join(r.choice("aeiou") + r.choice("bcdfglmnprstv") for _ in range(r.randint(1, 4))) if r.random() < 0.5 else r.choice(_WORDS) for _ in range(n)]
    style = r.random()
    if style < 0.08:
        return " ".join(w.upper() + "!!" for w in made)
    if style < 0.16:
        return " ".join(w + r.choice(("###", "&amp;&amp;&amp;", "%%%", "***")) for w in made)
    if style < 0.2:
        return " | ".join(made)
    return " ".join(made).capitalize() + r.choice((".", ".", ".", ",", "", "?"))


def _named(r: random.Random, tag: str, names: str, inner: str, always: bool = False) -> str:
    at = f' {r.choice(("class", "class", "id"))}="{r.choice(names.split())}"' if always or r.random() < 0.7 else ""
    return f"<{tag}{at}>{inner}</{tag}>"


def page(seed: int) -> str:
    """HTML in which every block of main text carries the mark \\x01 in its text."""
    r = random.Random(seed)
    para = lambda least=1, most=60: _sentence(r, least, most)

    def main_blocks() -> str:
        out = []
        if r.random() < 0.6:
            out.append(f"<h1>\x01{_sentence(r, 1, 10)}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            k = r.random()
            if k < 0.66:
                out.append(f"<p>\x01{r.choice(('', '', '<b>', '<em>'))}{para()}" + r.choice(("</p>", "</p>", "</p>", "", "<br>")))
            elif k < 0.74:
                out.append(f"<h{(n := r.randint(2, 4))}>\x01{_sentence(r, 1, 8)}</h{n}>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>\x01{_sentence(r, 1, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote><p>\x01{para()}</p></blockquote>")
            elif k < 0.95:
                out.append(f"<div>\x01{para(8)}</div>")
            elif k < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>\x01{_sentence(r, 1, 5)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f'<p>\x01{_sentence(r, 4, 20)} <a href="/x">{_sentence(r, 1, 4)}</a> {_sentence(r, 4, 20)}</p>')
            if r.random() < 0.07:
                out.append(beside(r.choice(("ad", "notice", "share", "aside", "form"))))
        return "".join(out)

    def beside(kind: str) -> str:
        names = BESIDE[kind]
        links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{_sentence(r, 1, 3)}</a></li>' for i in range(r.randint(2, 7))) + "</ul>"
        if kind == "nav":
            return _named(r, "nav", names, links()) if (k := r.random()) < 0.6 else _named(r, "div", names, links(), True) if k < 0.8 else _named(r, "div", NEUTRAL, links())
        if kind in ("header", "footer"):
            inner = r.choice((f"<p>{_sentence(r, 1, 9)}</p>", f"&copy; site.example &middot; {_sentence(r, 1, 12)}", links(), f"<div>{_sentence(r, 1, 9)}</div>", f'<a href="/">{_sentence(r, 1, 3)}</a>'))
            return _named(r, kind, names, inner) if r.random() < 0.7 else _named(r, "div", names, inner, True)
        if kind == "aside":
            inner = r.choice((links(), f"<h3>{_sentence(r, 1, 3)}</h3>" + links(), f"<p>{para(4, 40)}</p>"))
            return _named(r, "aside", names, inner) if r.random() < 0.5 else _named(r, "div", names, inner, True)
        if kind == "form":
            inner = f'<label>{_sentence(r, 1, 3)}</label><input name="q"><button>{_sentence(r, 1, 2)}</button>' + r.choice(("", f"<p>{_sentence(r, 2, 12)}</p>", "<select><option>One</option><option>Two</option></select>"))
            return _named(r, "form", names, inner)
        if kind == "comment":
            one = lambda: _named(r, r.choice(("div", "li", "article")), "comment comment-body reply comment-text", f"<p>{para(2, 30)}</p>", True)
            inner = r.choice(("", f"<h2>{_sentence(r, 1, 3)}</h2>")) + "".join(one() for _ in range(r.randint(1, 4)))
            return _named(r, r.choice(("div", "section", "ol")), names, inner, True)
        return _named(r, r.choice(("div", "div", "section", "aside", "p")), names, r.choice((para(2, 25), f"<p>{para(2, 25)}</p>" if kind != "p" else para(2, 25))), True)

    def plain(tag: str, inner: str) -> str:
        """An element without a name, or with one that says nothing."""
        return _named(r, tag, NEUTRAL, inner)

    core = main_blocks()
    tail = beside("comment") if r.random() < 0.35 else ""
    kind = r.random()
    inside = core + (tail if r.random() < 0.3 else "")
    outside = "" if inside != core else tail
    if kind < 0.36:
        body = f"<article>{inside}</article>" if kind < 0.2 else _named(r, "article", MAIN, inside) if kind < 0.25 else _named(r, "main", MAIN, inside) if kind < 0.3 else _named(r, r.choice(("div", "section", "td")), MAIN, inside, True)
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
    elif kind < 0.6:  # nothing around it
        body = inside
    elif kind < 0.92:
        body = inside
        for _ in range(r.randint(1, 3)):
            body = plain(r.choice(("div", "div", "section")), body)
    else:  # a layout of table cells
        side = f"<td>{beside(r.choice(('nav', 'aside')))}</td>" if r.random() < 0.7 else ""
        body = f"<table><tr>{side}{plain('td', inside)}</tr></table>"
    before = "".join(beside(k) for k in ("header", "nav", "notice", "ad", "form", "aside", "share") if r.random() < 0.35)
    after = outside + "".join(beside(k) for k in ("share", "aside", "ad", "form", "notice", "nav") if r.random() < 0.25) + (beside("footer") if r.random() < 0.8 else "")
    lone = r.random()  # pages of nothing but text, or with something on one side only
    before, after = "" if lone < 0.2 else before, "" if lone < 0.1 or lone > 0.95 else after
    head = f"<head><title>{_sentence(r, 1, 6)}</title><script>var x='<p>no</p>';</script></head>"
    return f"<html>{head}<body>{before}{body}{after}</body></html>"
