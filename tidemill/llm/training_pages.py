"""Labelled pages to train the extractor on.

Pages are composed from common layouts, with invented words, so that every block's
label is known: an element's ``data-y`` attribute says whether what is below it is
main text (1) or not (0). The attribute is read for labels only.
"""

import random

# Names that sites give to parts of a page, and wording of such parts.
MAIN_WRAP = (
    ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-body"), ("div", "entry-content"),
    ("div", "article-text"), ("section", "story"), ("div", "main"), ("td", "body-text"), ("div", ""),
)
AD = ("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo")
NOTICE = ("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "newsletter")
SIDE = ("sidebar", "side", "related", "widget", "recommended", "trending")
COMMENT = ("comments", "comment-list", "discussion", "replies", "disqus")
SHARE = ("share", "social", "tools", "breadcrumbs", "breadcrumb", "tags", "pager", "pagination", "byline-tools")
HEAD = ("site-header", "masthead", "top", "header", "branding")
FOOT = ("footer", "site-footer", "bottom", "copyright", "legal")
NAV = ("nav", "menu", "navbar", "navigation", "toc")
NOTICE_TEXT = ("We use cookies to improve this site.", "By continuing you accept our privacy policy.", "Subscribe to our newsletter for updates.", "Please log in to continue reading.")
LONG_TEXT = (
    "We and our partners use cookies to store and read information on your device.", "Read our privacy policy to learn how we handle your data.", "Subscribe to our newsletter for updates.",
    "All rights reserved.", "Copyright of the texts stays with their authors.", "Log in or sign up to manage your choices.", "Adverts help us to keep this site free.", "This site is powered by its readers.",
)
#: Parts of pages of publishing systems: names of wrappers of main text and of boxes beside it, and headings of these.
WRAPPERS = ("wrapper", "container", "inner", "wrap", "row", "col", "page", "site", "body", "layout", "root", "app", "section", "block")
AUTHOR = ("author", "author-bio", "author-box", "about-author", "bio", "profile", "byline", "meta", "post-meta", "entry-meta")
MORE = ("related", "related-posts", "more", "read-more", "also-like", "most-read", "popular", "recent", "recent-posts", "promo-box", "next-prev", "post-navigation")
OVERLAY = ("modal", "modal-body", "overlay", "dialog", "banner", "alert-banner", "popup", "notice-bar", "paywall", "subscribe-box")
SERVICE = ("contact", "contact-box", "feedback", "helpful", "print", "language", "accessibility", "skip-link", "search", "login", "account", "toolbar", "topbar", "tagline", "site-description")
REVIEWS = ("reviews", "review", "ratings", "feedback-list", "responses", "thread", "comments-area")
MORE_HEADS = ("Related", "More on this", "Most read", "You may also like", "Recent posts", "About the author", "Written by", "Contact", "Reviews", "Comments", "Contents", "Follow us", "Tags", "Categories", "Search")
BUTTONS = ("Accept", "Follow", "Share", "Sign in", "Send", "Yes", "No", "Subscribe", "OK", "Menu", "Search")
CUE_WORDS = ("cookie", "privacy", "copyright", "newsletter", "advert", "subscribe")
FOOT_TEXT = ("All rights reserved.", "Privacy Terms Contact", "Powered by")
SYLLABLES = "ba de fi go hu ka le mi no pu ra se ti vo wu xa ye zo ch sch tion ment ing ou".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, low: int = 3, high: int = 20) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        style = self.r.random()
        if style < 0.08:
            return " ".join(w.upper() + "!!" for w in words)
        if style < 0.16:
            return " ".join(w + self.r.choice(("***", "###", "$$$", "&amp;&amp;", "%%%")) for w in words)
        if style < 0.22:
            return words[0].capitalize() + (" " + words[0]) * len(words)
        if style < 0.28:
            return " | ".join(words)
        words[0] = words[0].capitalize()
        return " ".join(w + ("," if self.r.random() < 0.1 else "") for w in words) + self.r.choice((".", ".", ".", "", "?"))

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 4, 8))))

    def inline(self, text: str) -> str:
        style = self.r.random()
        if style < 0.12:
            return f"<b>{text}</b>"
        if style < 0.2:
            return f"<b>{text}<br>"
        if style < 0.3:
            return f'{text} <a href="/x">{self.word()}</a> {self.sentence()}'
        return text

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.word()} {self.word() if self.r.random() < 0.3 else ""}</a></li>' for _ in range(self.r.randint(low, high)))

    def named(self, tags: tuple, names: tuple, inner: str) -> str:
        tag = self.r.choice(tags)
        kind = self.r.choice(("class", "class", "id"))
        label = f' {kind}="{self.r.choice(names)}"' if tag == "div" or self.r.random() < 0.5 else ""
        return f'<{tag}{label} data-y="0">{inner}</{tag}>'

    def other(self) -> str:
        """A part that isn't main text."""
        r = self.r
        kind = r.randrange(8)
        if kind == 0:
            return self.named(("div", "aside", "div"), AD, r.choice((self.prose(), f"<p>{self.sentence()}</p>")))
        if kind == 1:
            return self.named(("div", "section", "div"), NOTICE, f"<p>{r.choice(NOTICE_TEXT)} {r.choice((self.sentence(), ''))}</p>")
        if kind == 2:
            return self.named(("aside", "div"), SIDE, f"<h3>{self.sentence(1, 4)}</h3>" + r.choice((f"<ul>{self.links(2, 6)}</ul>", f"<p>{self.prose()}</p>")))
        if kind == 3:
            return f'<form data-y="0" class="{r.choice(("search", "signup", "login"))}"><label>{self.sentence(1, 4)}</label><input name=q><p>{self.sentence()}</p><button>{self.word()}</button></form>'
        if kind == 4:
            inner = "".join(f'<div class="{r.choice(("comment", "reply"))}"><p>{self.word()} wrote:</p><p>{self.prose()}</p></div>' for _ in range(r.randint(1, 4)))
            return self.named(("section", "div"), COMMENT, f"<h3>{self.sentence(1, 3)}</h3>{inner}")
        if kind == 5:
            return self.named(("div", "ul"), SHARE, self.links(2, 5))
        if kind == 6:
            return self.named(("nav", "nav", "div"), NAV, f"<ul>{self.links(3, 8)}</ul>")
        return self.named(("header", "div"), HEAD, f"<p>{self.sentence(1, 4)}</p>")

    def main(self) -> str:
        r = self.r
        parts = [f"<h1>{self.sentence(1, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 4, 8))):
            kind = r.random()
            if kind < 0.7:
                text = self.inline(self.prose() if r.random() < 0.85 else self.sentence(1, 3))
                parts.append(f"<p>{text}" + ("</p>" if not text.endswith("<br>") else ""))
            elif kind < 0.8:
                parts.append(f"<h2>{self.sentence(1, 6)}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.sentence(1, 10)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            else:
                parts.append(f"<table><tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr></table><pre>{self.sentence()}</pre>")
            if r.random() < 0.12:
                parts.append(self.other())
        tag, name = r.choice(MAIN_WRAP)
        label = f' class="{name}"' if name else ""
        return f'<{tag}{label} data-y="1">{"".join(parts)}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [self.named(("nav", "div"), NAV, f"<ul>{self.links(3, 8)}</ul>")] if r.random() < 0.8 else []
        if r.random() < 0.4:
            before.insert(0, f'<header data-y="0"><h1>{self.sentence(1, 3)}</h1><p>{self.sentence(1, 6)}</p></header>')
        before += [self.other() for _ in range(r.choice((0, 1, 1, 2)))]
        after = [self.other() for _ in range(r.choice((0, 1, 2)))]
        foot = r.choice((f"&copy; {self.word()}.example &middot; {self.prose()}", f"<p>{r.choice(FOOT_TEXT)}</p>", f"{self.sentence()}"))
        after.append(self.named(("footer", "footer", "div"), FOOT, foot))
        main = "".join(self.main() for _ in range(r.choice((1, 1, 1, 2))))
        return f'<html><head><title>{self.sentence(1, 4)}</title></head><body data-y="0">{"".join(before)}{main}{"".join(after)}</body></html>'

    def box(self) -> str:
        """A box of a publishing system that isn't main text."""
        r = self.r
        names = r.choice((AUTHOR, MORE, OVERLAY, SERVICE, REVIEWS, (f"css-{self.word()}",)))
        tag = r.choice(("div", "div", "div", "section", "aside", "nav" if names is MORE else "div"))
        label = f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"' if r.random() < 0.9 else ""
        head = f"<h{(k := r.choice((2, 3, 4)))}>{r.choice(MORE_HEADS)}{r.choice(('', ' ' + self.word()))}</h{k}>" if r.random() < 0.7 else ""
        button = f"<button>{r.choice(BUTTONS)}</button>"
        body = r.choice(
            (
                f"<p>{self.sentence(3, 12)}</p>",
                f"<p>{self.sentence(3, 12)}</p>{button}",
                f"<ul>{self.links(2, 5)}</ul>",
                "".join(f'<div><a href="/{self.word()}">{self.sentence(1, 5)}</a></div>' for _ in range(r.randint(1, 4))),
                "".join(f"<a href=/>{self.word()}</a> " for _ in range(r.randint(1, 5))),
                f"<span>{self.sentence(1, 4)}</span>{button}",
                f"<form><label>{self.sentence(2, 5)}</label><input>{button}</form>",
            )
        )
        return f'<{tag}{label} data-y="0">{head}{body}</{tag}>'

    def site_main(self) -> str:
        """Main text inside neutral wrappers, some with names that tell nothing, with boxes among its paragraphs."""
        r = self.r
        plain = lambda: r.choice(("", f' class="css-{self.word()}"', f' class="{self.word()}"', f' id="{self.word()}"'))
        parts = [f"<h1{plain()}>{self.sentence(1, 9)}</h1>"] if r.random() < 0.9 else []
        if r.random() < 0.3:
            parts.append(f"<h2>{self.sentence(3, 10)}</h2>")
        for _ in range(r.choice((2, 3, 4, 6))):
            kind = r.random()
            if kind < 0.75:
                parts.append(f"<p{plain()}>{self.prose() if r.random() < 0.85 else self.sentence(1, 3)}</p>")
            elif kind < 0.85:
                parts.append(f"<h2>{self.sentence(1, 5)}</h2><p>{self.prose()}</p>")
            elif kind < 0.92:
                parts.append(f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.sentence(1, 12)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif kind < 0.96:
                parts.append(f"<figure><img><figcaption>{self.sentence(2, 8)}</figcaption></figure>")
            else:
                parts.append(f"<table><tr><th>{self.word()}</th><th>{self.word()}</th></tr><tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr></table>")
            if r.random() < 0.2:
                parts.append(self.box())
        inner = "".join(parts)
        for _ in range(r.choice((0, 1, 1, 2))):
            tag = r.choice(("div", "div", "section"))
            inner = f"<{tag}{r.choice((plain(), ' class=' + repr(r.choice(WRAPPERS))))}>{inner}</{tag}>"
        tag, name = r.choice(MAIN_WRAP)
        return f'<{tag}{f""" class="{name}" """ if name else ""} data-y="1">{inner}</{tag}>'

    def site_page(self) -> str:
        """A page of a publishing system: main text and boxes in wrappers."""
        r = self.r
        before = [self.box() for _ in range(r.choice((1, 2, 3)))]
        if r.random() < 0.7:
            before.insert(0, f'<div class="{r.choice((*HEAD, *WRAPPERS))}" data-y="0">' + "".join(f'<a href="/{self.word()}">{self.word()}</a> ' for _ in range(r.randint(1, 5))) + f"<span>{r.choice(BUTTONS)}</span></div>")
        after = [self.box() for _ in range(r.choice((1, 2, 3, 4)))]
        after.append(self.named(("footer", "div"), FOOT, f"<p>{r.choice((*FOOT_TEXT, self.sentence(2, 9)))}</p>"))
        body = "".join(before) + self.site_main() + "".join(after)
        for _ in range(r.choice((0, 1, 2))):
            body = f'<div class="{r.choice(WRAPPERS)}">{body}</div>'
        return f'<html><head><title>{self.sentence(1, 4)}</title></head><body data-y="0">{body}</body></html>'

    def long_prose(self, extra: list[str]) -> str:
        """A block of any length with the given parts among the sentences."""
        parts, least = list(extra), self.r.choice((0, 120, 250, 420, 600))
        while sum(map(len, parts)) < least or self.r.random() < 0.5:
            parts.append(self.sentence(6, 20))
        self.r.shuffle(parts)
        return " ".join(parts)

    def long_page(self) -> str:
        """Notices in elements without telling names, and articles with a cue or two."""
        r = self.r
        tags = lambda y: (t := r.choice(("p", "div")), f'<{t} data-y="{y}">', f"</{t}>")[1:]
        parts = []
        for _ in range(r.choice((3, 4, 6))):
            a, b = tags(1)
            parts.append(a + self.long_prose(r.sample(CUE_WORDS, r.choice((0, 0, 1, 2)))) + b)
        for _ in range(r.choice((1, 1, 2))):
            a, b = tags(0)
            parts.insert(r.choice((0, len(parts), r.randint(0, len(parts)))), a + self.long_prose(r.sample(LONG_TEXT, r.randint(3, len(LONG_TEXT)))) + b)
        return f'<html><body data-y="0">{"".join(parts)}</body></html>'


def pages(count: int, seed: int = 1) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(count)]


def long_notices(count: int, seed: int = 2) -> list[str]:
    writer = Writer(seed)
    return [writer.long_page() for _ in range(count)]


def site_pages(count: int, seed: int = 3) -> list[str]:
    writer = Writer(seed)
    return [writer.site_page() for _ in range(count)]
