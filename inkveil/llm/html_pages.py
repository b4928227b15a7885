"""Labelled pages: invented words in the layouts that sites use, each text block marked as content or not.

A bounded, seeded sample: ``labelled(n)`` gives ``n`` pages. The labels follow from where the generator put a block.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ten ra su vel dor in est ab qui pra nor fel gan tu shi wo ber".split()
_MENU = ["Home", "About", "Contact", "News", "Archive", "Login", "Search", "Terms", "Privacy", "Help"]

#: Each: an opening tag for a part that isn't content; what it holds.
_BOILERPLATE = [
    ("<nav>", "links"), ('<nav class="menu">', "links"), ('<div class="nav">', "links"), ('<div id="menu">', "links"), ('<ul class="navbar">', "items"), ('<div class="breadcrumb">', "links"),
    ("<header>", "short"), ('<div class="header">', "short"), ('<div id="masthead">', "short"), ('<div class="topbar">', "links"),
    ("<footer>", "short"), ('<div class="footer">', "short"), ('<div id="copyright">', "short"),
    ("<aside>", "mixed"), ('<aside class="sidebar">', "prose"), ('<div class="sidebar">', "mixed"), ('<div id="sidebar">', "prose"), ('<section class="widget">', "items"), ('<div class="related">', "links"), ('<div class="recommended">', "items"),
    ('<div class="ad">', "prose"), ('<div class="ads">', "short"), ('<div class="advert">', "prose"), ('<div class="advertisement">', "prose"), ('<div class="banner">', "short"), ('<div class="promo">', "prose"), ('<section class="sponsored">', "prose"), ('<div class="ad">', "short"),
    ('<div class="cookie-notice">', "prose"), ('<div class="notice">', "prose"), ('<div id="cookie-banner">', "short"), ('<div class="consent">', "prose"), ('<div class="popup">', "prose"), ('<div role="alert">', "short"), ('<div class="newsletter">', "form"), ('<div class="subscribe">', "form"),
    ("<form>", "form"), ('<form class="search">', "form"), ('<form id="login">', "form"),
    ('<div class="comments">', "comments"), ('<section id="comments">', "comments"), ('<ol class="comment-list">', "items"), ('<div class="comment">', "prose"), ('<section class="reader-comments">', "comments"), ('<div id="disqus_thread">', "comments"),
    ('<div class="share">', "links"), ('<div class="social">', "links"), ('<div class="tags">', "links"), ('<div class="pagination">', "links"),
]
_CONTENT = [
    "<article>", "<main>", "<main><article>", '<div class="content">', '<div class="post">', '<div class="entry-content">', '<div id="main">', '<div class="article-body">', '<section class="story">', "<div>", "<article>", '<div id="content"><div>',
]


def _close(tags: str) -> str:
    return "".join(f"</{t.split()[0].strip('<>')}>" for t in reversed(tags.replace("><", ">\n<").split("\n")))


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng, self.blocks = rng, []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        ws = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        ws[0] = ws[0].capitalize()
        for k in range(7, len(ws) - 1, 9):
            ws[k] += r.choice([",", ".", ",", ";"])
        return " ".join(ws)

    def block(self, text: str, content: bool, inner: str | None = None) -> str:
        self.blocks.append((" ".join(text.split()), content))
        return text if inner is None else inner

    def boilerplate(self, opening: str, kind: str) -> str:
        r, out = self.rng, []
        plain = lambda low, high: self.block(self.words(low, high), False)
        if kind in ("links", "mixed"):
            items = []
            for _ in range(r.randint(2, 7)):
                w = r.choice(_MENU) if r.random() < 0.4 else self.words(1, 3)
                items.append(w)
            if r.random() < 0.7:
                out.append("<ul>" + "".join(f'<li><a href="/{k}">{self.block(w, False)}</a></li>' for k, w in enumerate(items)) + "</ul>")
            else:
                text = " | ".join(items)
                out.append("<div>" + self.block(text, False, " | ".join(f'<a href="/{k}">{w}</a>' for k, w in enumerate(items))) + "</div>")
        if kind == "items":
            out.append("".join(f"<li>{plain(2, 12)}</li>" for _ in range(r.randint(2, 5))))
        if kind == "short":
            w = self.words(1, 14)
            out.append(self.block(w, False) if r.random() < 0.5 else f"<p>{self.block(w, False)}</p>")
        if kind in ("prose", "mixed"):
            if r.random() < 0.4:
                out.append(f"<h3>{plain(1, 5)}</h3>")
            out.append(f"<p>{plain(3, 45)}</p>" if r.random() < 0.5 else plain(3, 45))
        if kind == "form":
            out.append(f"<p>{plain(2, 14)}</p><input><button>{'' if r.random() < 0.5 else self.block(self.words(1, 2), False)}</button>")
        if kind == "comments":
            for _ in range(r.randint(1, 4)):
                out.append(f"<div class='comment'><h4>{plain(1, 3)}</h4><p>{plain(3, 60)}</p></div>")
        return opening + "".join(out) + _close(opening)

    def article(self) -> str:
        r, out = self.rng, []
        opening = r.choice(_CONTENT)
        if r.random() < 0.8:
            out.append(f"<h1>{self.block(self.words(2, 14), True)}</h1>")
        inside = r.randint(0, 2) if r.random() < 0.35 else 0
        for _ in range(r.choice([0, 1, 1, 2, 4, 9])):
            what = r.random()
            if what < 0.72:
                text = self.words(1, 90) if r.random() < 0.85 else self.words(1, 3)
                kind = r.random()
                inner = None
                if kind < 0.15:
                    inner = f"<b>{text}<br>"
                elif kind < 0.25 and " " in text:
                    first, _, rest = text.partition(" ")
                    inner = f'<a href="#">{first}</a> {rest}'
                out.append(f"<p>{self.block(text, True, inner)}" + ("</p>" if r.random() < 0.9 else ""))
            elif what < 0.80:
                out.append(f"<h2>{self.block(self.words(1, 8), True)}</h2>")
            elif what < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.block(self.words(1, 15), True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif what < 0.93:
                out.append(f"<blockquote>{self.block(self.words(4, 40), True)}</blockquote>")
            elif what < 0.97:
                out.append(f"<pre>{self.block(self.words(2, 20), True)}</pre>")
            else:
                out.append("<table><tr>" + "".join(f"<td>{self.block(self.words(1, 4), True)}</td>" for _ in range(3)) + "</tr></table>")
            if inside:
                inside -= 1
                out.append(self.boilerplate(*r.choice(_BOILERPLATE)))
        return opening + "".join(out) + _close(opening)

    def page(self) -> str:
        r = self.rng
        top = [self.boilerplate(*r.choice(_BOILERPLATE)) for _ in range(r.randint(0, 3))]
        body = self.article()
        end = [self.boilerplate(*r.choice(_BOILERPLATE)) for _ in range(r.randint(0, 3))]
        open_, shut = r.choice([("", ""), ('<div id="page">', "</div>"), ('<div class="container"><div class="row">', "</div></div>")])
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>var a='<p>';</script></head><body>{open_}{''.join(top)}{body}{''.join(end)}{shut}</body></html>"


def labelled(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, bool]]]]:
    """``(html, [(block text, is content)])``, blocks in page order."""
    out = []
    for k in range(n):
        maker = _Maker(random.Random(f"{seed}:{k}"))
        html = maker.page()
        out.append((html, maker.blocks))
    return out
